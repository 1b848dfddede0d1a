"""Language ID, toxicity and n-gram scores: held-out accuracy, brute force and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quillwork.llm import langid, ngram_lm, queries, toxicity
from quillwork.llm.common import append_columns

DOCS = "doc_id long, text string, lang string"


def test_an_ngram_binds_permuted_letters():
    p = langid.Profiles()
    a, b, c = 3, 7, 9
    got = p.vectors(np.array([(a * langid.CLASSES + b) * langid.CLASSES + c]))[0]
    want = np.roll(p.letter[a], 2) * np.roll(p.letter[b], 1) * p.letter[c]
    assert (got == want).all()


def test_counts_against_a_plain_walk():
    table, codes = langid.Profiles().counts(["Ab, b", "", "12"])
    letter = {"a": 1, "b": 2, "_": 0}
    want = Counter((letter[x] * 64 + letter[y]) * 64 + letter[z] for x, y, z in ("_ab", "ab_", "b_b", "_b_"))
    assert {int(c): int(n) for c, n in zip(codes, table[0], strict=True) if n} == want
    assert not table[1:].any()


def test_language_accuracy_and_odd_rows(spark, sf):
    got = {r["doc_id"]: r for r in queries.op5(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = [d for d in docs if got[d["doc_id"]]["held_out"]]
    assert len(got) == len(docs) and 0 < len(held) < len(docs)
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = spark.createDataFrame([(None, None, None), (1, "", "en"), (2, "123 !?", "de"), (3, "the and of", None), (3, "the and of", None),
                                 (4, "x" * 100_000, "en")], DOCS)
    told = langid.predict(odd.withColumnRenamed("lang", "Score"), {"en": np.ones(langid.DIM)})
    assert told.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [r["lang_pred"] for r in told.orderBy("doc_id").collect()] == ["und", "und", "und", "en", "en", "en"]
    assert {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}
    assert langid.learn(odd.limit(0)) == {} and list(langid.learn(odd)) == ["en"]


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op4(spark, sf).collect()
    held = [(labels[r["doc_id"]], r["predicted"], r["score"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert np.mean([y == p for y, p, _ in held]) >= 0.9
    # few documents are toxic, so those found and those flagged wrongly are looked at apart
    assert np.mean([p for y, p, _ in held if y]) >= 0.5 and np.mean([p for y, p, _ in held if not y]) <= 0.05


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, "you are an idiot and scum" if i % 3 == 0 else "the house by the sea", "x", 1.0) for i in range(90)]
                                 + [(None, None, "y", 2.0), (91, "", "z", 0.0), (5, "the house by the sea", "x", 1.0)],
                                 "doc_id long, text string, features string, Score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (1000, 1), (4, None), (7, 5)], "doc_id long, toxic int")
    out = toxicity.fit(docs, labels).score(docs)
    assert out.columns == ["doc_id", "text", "features", "score", "predicted"]
    got = out.collect()
    assert len(got) == 93
    assert all(r["predicted"] == int("idiot" in (r["text"] or "")) for r in got)
    one = toxicity.fit(docs, labels.where("toxic = 1")).score(docs)
    assert {r["score"] for r in one.collect()} == {1.0}
    none = toxicity.fit(docs.limit(0), labels).score(docs.limit(0))
    assert none.count() == 0


def test_letters_and_capitals_against_every_character():
    rng = random.Random(6)
    texts = ["".join(rng.choices("aBßΣσİⒶⅧ𝐀º9'’.,!#* \t\n\x1c\u3000É_-你ſŉ", k=rng.randint(1, 80))) for _ in range(2000)]
    for t in (t for t in texts if t.split()):
        f = dict(zip(toxicity.NAMES, toxicity.features(t, {}.get), strict=True))
        assert f["capitals"] == sum(map(str.isupper, t)) / max(1, sum(map(str.isalpha, t))), t
        assert f["shouted"] == sum(len(w) > 2 and w.isupper() for w in t.split()) / len(t.split()), t


def test_a_text_goes_to_python_once(spark, sf, monkeypatch):
    sent = []

    def noted(df, *args, **settings):
        sent.append(df.schema.simpleString())
        return append_columns(df, *args, **settings)

    for module in (langid, toxicity):
        monkeypatch.setattr(module, "append_columns", noted)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.createDataFrame([(r["doc_id"], r["doc_id"] % 2) for r in docs.select("doc_id").collect()], "doc_id long, toxic int")
    monkeypatch.setattr(corpus_pipeline, "read", lambda *_: labels)
    for step in (corpus_pipeline.languages, corpus_pipeline.clean):
        assert step(spark, docs, sf).columns == docs.columns
    assert sent and all(s.count("text:string") == 1 for s in sent), sent  # before: two and three times


def test_near_you_and_masked_words_are_seen():
    f = dict(zip(toxicity.NAMES, toxicity.features("YOU are an 1d!ot, an idiot!", {}.get), strict=True))
    assert f["near_you"] > 0 and f["unmasked"] > 0 and f["seed"] > 0 and f["shouted"] > 0 and f["exclaimed"] > 0


def brute(texts):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    grams = [list(zip([None, *d], d)) for d in docs]  # noqa: B905
    pair = Counter(g for d in grams for g in d)
    begins = Counter(b for d in grams for b, _ in d)
    word = Counter(w for d in docs for w in d)

    def score(b, w):
        return math.log(pair[b, w] / begins[b]) if pair[b, w] >= 2 else math.log(0.4) + math.log(word[w] / word.total())

    return [(len(d), sum(score(*g) for g in d)) for d in grams]


@pytest.mark.parametrize(("frequent", "hot"), [(1 << 16, 1 << 9), (20, 6), (8, 8), (1, 1)])
def test_ngram_scores_against_brute_force(spark, frequent, hot):
    texts = ["", "a b c a b", "a b c\td\n", "the cat sat", "the cat sat", "a", "été à la plage \x00 à la", "zq " * 500, None, " \x0b\n ", "\u2028 \u00a0x the cat"]
    df = spark.createDataFrame([(i % 8, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, pair string").repartition(3)
    got = ngram_lm.score(df, frequent=frequent, hot=hot).collect()
    want = sorted((i % 8, n, round(s, 6) + 0.0) for i, (n, s) in enumerate(brute([t or "" for t in texts])))
    assert sorted((r["doc_id"], r["n_grams"], round(r["score"], 6) + 0.0) for r in got) == want
    assert all((r["mean_score"] is None) == (r["n_grams"] == 0) for r in got)
    assert ngram_lm.score(df.limit(0)).count() == 0


def test_pairs_are_shuffled_as_packed_stretches(spark, monkeypatch):
    """Few rows and bytes leave a map, whatever the number of words, and many parts give the same scores as one."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 400) % 5000) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    moved = []
    group = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *keys: (moved.append(self), group(self, *keys))[1])
    want = [(i, n, round(s, 6)) for i, (n, s) in enumerate(brute(texts))]
    for part in (1 << 20, 3_000):
        monkeypatch.setattr(ngram_lm, "PART", part)
        moved.clear()
        got = ngram_lm.score(df, frequent=500, hot=20).collect()
        assert sorted((r["doc_id"], r["n_grams"], round(r["score"], 6)) for r in got) == want
        pairs = [m for m in moved if "key" not in m.columns and "word" not in m.columns and "pair" not in m.columns]
        sizes = [m.selectExpr("count(*) AS n", "sum(length(data)) AS bytes").first() for m in pairs]
        assert len(sizes) == 2 and all(s["n"] <= 2 * (3 * 40 + 1) and s["bytes"] < 15 * 400 * 300 for s in sizes)


def test_word_hashes_of_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab \n"), n)).encode() for n in (0, 1, 5, 40, 300, 2000, 7, 0)]
    whole, sizes = ngram_lm.Hasher().words(texts)
    words = [w for t in texts for w in t.split()]
    assert sizes.tolist() == [len(t.split()) for t in texts] and len(whole) == len(words)
    assert len(set(zip(words, whole.tolist(), strict=True))) == len(set(words)) == len(set(whole.tolist()))
    monkeypatch.setattr(ngram_lm, "PIECE", 64)
    monkeypatch.setattr(ngram_lm.pieces, "__defaults__", (64,))
    again, sizes_again = ngram_lm.Hasher().words(texts)
    assert (again == whole).all() and (sizes_again == sizes).all()
