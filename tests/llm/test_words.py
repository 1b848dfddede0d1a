"""Spelling variants, periodic runs and quality against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from quillwork.llm import periodic, quality, queries, spelling
from quillwork.llm.words import hashes, repeating

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "solo"), (5, "a b " * 30_000), (5, "a b " * 30_000), (None, "tic tac toe " * 12), (None, None),
       (6, "É x \x1c y   " * 20), (7, "😀 #*$ " * 9 + "\n\n|<>&%\n" * 3)]


# --- 11 ---


def plain_words(docs, divisor=199):
    total = Counter()
    for d, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and h % divisor == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            total[w] += 1
    return total


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(total):
    n = {w: c for w, c in total.items() if len(w) >= 6 and c >= 5}
    near = {w: [o for o in n if abs(len(o) - len(w)) <= 1 and one_edit(w, o)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x)) for w, o in near.items() if o}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def spread_words(rng, count):
    """Words of many lengths, some in crowds of near words, with chains of forms."""
    total = Counter()
    for _ in range(count):
        w = "".join(rng.choices("aebcdéÿ×z", k=rng.randint(6, 11)))
        n = 5 ** rng.randint(1, 5)
        for _ in range(rng.randint(1, 6)):
            total[w] += n
            n = max(5, n // rng.choice((1, 4, 5, 6)))
            i = rng.randrange(len(w))
            w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:]))
    return total


def test_words_are_counted_whole(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices("Hausaufgabe hausAufgabe ÉCOLE École naïveté×÷ don't über-all short xxxxxxx".split(), k=60))) for i in range(120)] + ODD
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = {r["word"]: r["n"] for r in spelling.count_words(df, change=queries.dropped_letter).collect()}
    assert got == {w: c for w, c in plain_words(docs).items() if len(w) >= 6} and len(got) >= 4
    assert spelling.count_words(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 20])
def test_variants_against_all_pairs(spark, monkeypatch, block):
    total = spread_words(random.Random(block), 120)
    total["b" * 300] = total["b" * 301] = 7
    monkeypatch.setattr(spelling, "BLOCK", block)
    df = spark.createDataFrame(list(total.items()), "word string, n long")
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}
    want = plain_variants(total)
    assert got == want and sum(f is not None for _, f, *_ in want) > 20 and any(f not in (None, r) for _, f, r, *_ in want)


def test_anagrams_are_no_variants_and_an_empty_table_has_none(spark):
    rows = [("abcdefg", 100), ("gfedcba", 5), ("abcdegf", 9), ("abcdefgg", 500), ("short", 900), ("abcdefx", 4)]
    df = spark.createDataFrame(rows, "word string, n long")
    got = {tuple(r) for r in spelling.variants(df).collect()}
    assert got == {("abcdefg", "abcdefgg", "abcdefgg", 100, 1, 500), ("gfedcba", None, "gfedcba", 5, 0, None), ("abcdegf", None, "abcdegf", 9, 0, None),
                   ("abcdefgg", None, "abcdefgg", 500, 1, None)}
    assert spelling.variants(df.limit(0)).count() == 0


def test_box_search_finds_all_within_reach():
    rng = np.random.default_rng(3)
    for tight in (True, False):
        x = rng.integers(0, 3, (400, spelling.DIMS)).astype(np.int16) * (rng.random((400, spelling.DIMS)) < 0.06)
        x = x.astype(np.int16)
        tree = spelling.KdTree(x, 8, tight)
        assert sorted(np.concatenate(tree.rows).tolist()) == list(range(400))
        q, leaf = tree.reach(x[:50], 2)
        met = {(int(a), int(b)) for a, k in zip(q, leaf, strict=True) for b in tree.rows[k]}
        far = np.abs(x[:50, None] - x[None]).sum(axis=2)
        assert {(int(a), int(b)) for a, b in np.argwhere(far <= 2)} <= met and len(met) < 50 * 400 * (0.5 if tight else 0.9)
        assert all(i in tree.rows[k] for i, k in enumerate(tree.home(x)))


def test_spelling_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(queries.ORACLES["op11_spelling_variants"])
    got = queries.op11(spark, sf)
    assert got.columns == rel.columns
    assert {tuple(r) for r in got.collect()} == set(rel.fetchall())
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in got.collect()} == plain_variants(plain_words(docs))


# --- 12 ---


def plain_runs(w, least=24, times=3):
    n, out = len(w), set()
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if length >= max(least, times * p) and not any(p % q == 0 and all(w[k] == w[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                out.add((i, length, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_words(rng):
    words = []
    for _ in range(rng.randint(0, 7)):
        if rng.random() < 0.5:
            words += rng.choices("abcdefghijklmnop", k=rng.randint(0, 30))
        else:
            words += (rng.choices("abcd", k=rng.randint(1, 12)) * 60)[: rng.randint(1, 60)]
    return words


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (4, 2), (10, 4)])
def test_runs_against_all_periods(least, times):
    rng = random.Random(least)
    for _ in range(400):
        words = odd_words(rng)
        assert periodic.runs_of([w.encode() for w in words], least, times) == plain_runs(words, least, times), words
        symbols = [ord(w) - 96 for w in words]
        assert periodic.all_runs(symbols, least, times) == plain_runs(symbols, least, times)


def test_extensions_of_suffix_trees():
    rng = random.Random(8)
    for k in (1, 2, 4):
        s = rng.choices(range(1, k + 1), k=300)
        tree = periodic.SuffixTree(s)
        a, b = np.array([(i, j) for i in range(0, 300, 7) for j in range(1, 301, 11) if i != j]).T
        plain = [next((m for m in range(301) if i + m >= 300 or j + m >= 300 or s[i + m] != s[j + m]), 0) for i, j in zip(a, b, strict=True)]
        assert tree.common(a, b).tolist() == plain
        for opposite in (False, True):
            order = np.argsort(tree.ranks(opposite)).tolist()
            assert order == sorted(range(301), key=lambda i: [-c if opposite else c for c in s[i:]])


def plain_op12(d, text, tail=True):
    words = WORD.findall(text or "")
    n = len(words)
    if tail and d is not None:
        h = zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words) if n < 3000 else [(0, n, 2)]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    told = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_query_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    docs = [(i, rng.choice(" \n\t").join(odd_words(rng)) if i % 3 else " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(0, 200)))) for i in range(10, 250)] + ODD
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12(spark, str(tmp_path))
    assert got.columns[:3] == ["doc_id", "n_runs", "start"]
    want = Counter(plain_op12(d, t) for d, t in docs)
    assert Counter(tuple(r) for r in got.collect()) == want and sum(r[1] > 0 and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in want) > 5


def test_runs_of_odd_rows(spark):
    df = spark.createDataFrame([(*d, "r") for d in ODD], "doc_id long, text string, Runs string")
    got = periodic.find(df).collect()
    assert periodic.find(df).columns == ["doc_id", "text", "runs", "collapsed"] and len(got) == len(ODD)
    assert [[tuple(x) for x in r["runs"]] for r in got if r["doc_id"] == 5] == [[(0, 60_000, 2)]] * 2
    assert {r["collapsed"] for r in got if r["doc_id"] in (1, 2, 3)} == {""} and {r["collapsed"] for r in got if r["doc_id"] == 5} == {"a b"}
    assert periodic.find(df.limit(0)).count() == 0


# --- 13 ---


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def test_counts_against_plain_ones(spark, sf):
    rng = random.Random(4)
    made = [(i, "".join(rng.choices(["a b c d e f g h ", "x y\n", "\n", "#|", "é ", "w1 w2 w3 w4 w5 w6 w7 w8 w9 "], k=rng.randint(0, 12)))) for i in range(200)]
    docs = made + ODD + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame([(*d, True, "s") for d in docs], "doc_id long, text string, kept boolean, N_WORDS string")
    got = quality.judge(df, None)
    assert got.columns == ["doc_id", "text", *quality.COUNTS, "score", "base_failed", "kept"]
    rows = Counter((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"], r["kept"]) for r in got.collect())
    want = Counter()
    for d, t in docs:
        c = plain_counts(t)
        failed = c[0] < 20 or 100 * c[-1] > 30 * c[0]
        want[(d, *c, failed, not failed)] += 1
    assert rows == want
    assert quality.judge(df.limit(0), None).count() == 0


def test_windows_that_repeat_are_all_found():
    words = "a b c d a b c x a b".split()
    got = repeating(hashes([w.encode() for w in words]), 3)
    assert got.tolist() == [True, False, False, False, True, False, False, False]


def test_trees_score_as_a_plain_walk_and_never_rise_where_they_must_not():
    rng = np.random.default_rng(1)
    x = rng.random((800, len(quality.FEATURES)))
    sign = list(quality.FEATURES.values())
    y = ((x[:, 5] + 0.3 * rng.random(800) + x[:, 0] * (rng.random(800) < 0.5)) > 0.9).astype(float)  # feature 0 helps, but may not
    trees = quality.grow(x, y, sign)

    def walk(row):
        total = trees.start
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while f[node] >= 0:
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node]
        return 1 / (1 + np.exp(-total))

    got = trees.score(x)
    assert np.allclose(got, [walk(r) for r in x]) and ((got >= 0.5) == y).mean() > 0.8
    for f, s in enumerate(sign):
        if s:
            up = x.copy()
            last = trees.score(up)
            for value in np.linspace(x[:, f].min() - 1, x[:, f].max() + 1, 40):
                up[:, f] = value
                now = trees.score(up)
                if value > x[:, f].min() - 1:
                    assert (s * (now - last) >= -1e-12).all()
                last = now


def test_quality_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    part = "crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 0"
    trees = quality.fit(docs, labels.where(f"NOT {part}"))
    told = quality.judge(docs.join(labels, "doc_id").where(part), trees).where("NOT base_failed").collect()
    good = [r["kept"] for r in told if r["quality"] == 1]
    bad = [r["kept"] for r in told if r["quality"] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.2 and len(bad) >= 7
    assert {r["kept"] == (r["score"] >= 0.5) for r in told} == {True}


def test_quality_of_odd_labels(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    for rows in ([], [(1, 1), (2, 1)], [(None, 1), (99, 0), (4, None), (4, 7)]):
        assert quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int")) is None
