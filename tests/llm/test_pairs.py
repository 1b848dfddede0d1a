"""SimHash groups, embedding groups, top-k search and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillwork.llm import embedding, queries, simhash, topk
from quillwork.llm.common import Stage, components


def reach(nodes, linked):
    """The least node reachable, by repeated sweeps."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(4)
    ids = rng.sample(range(-500, 500), 300)
    edges = {"chain": list(zip(ids, ids[1:], strict=False))[:150], "star": [(ids[0], x) for x in ids[1:200]],
             "random": [tuple(rng.sample(ids, 2)) for _ in range(220)], "none": []}[shape]
    stage = Stage(spark, "test")
    got = dict(components(stage, spark.createDataFrame(edges, "a long, b long")).collect())
    want = {n: r for n, r in reach(ids, edges).items() if n != r}
    assert got == want


def plain_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", "One", "one two", "One TWO three\x0bfour", "ÀB é x y\x1cz w", "a b c " * 30_000]
    texts += [" ".join(rng.choices("aa bb cc dd ee ÉÉ".split(), k=rng.randint(1, 40))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t), t[:50]


def groups_by_hand(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = reach(range(len(rows)), linked)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return sorted(str((d, f"{fps[i]:016x}", least.get(root[i]))) for i, (d, _) in enumerate(rows))


def test_simhash_groups_of_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + " tail"), (9, base), (9, base), (None, base), (1, ""), (2, None), (4, "  "), (6, "solo"), (None, "alone here"),
            (10, "x " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, fp int, component_id string").repartition(3)
    got = [str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in simhash.grouped(df).collect()]
    assert sorted(got) == groups_by_hand(rows)
    assert simhash.grouped(df.limit(0)).count() == 0


def test_simhash_groups_of_other_shingles_and_radius(spark):
    rng = random.Random(3)
    base = [rng.choice("aa bb cc dd ee ff gg hh".split()) + str(rng.randrange(50)) for _ in range(300)]
    rows = [(k, " ".join(base[:at] + ["changed"] + base[at + 1 :])) for k, at in enumerate((10, 90, 150, 280))] + [(9, "quite another text of some words")]
    fps = [simhash.fingerprint(t.encode(), 5) for _, t in rows]
    radius = max((a ^ b).bit_count() for a in fps[:4] for b in fps[:4])
    assert 2 < radius < min((a ^ fps[4]).bit_count() for a in fps[:4])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.grouped(spark.createDataFrame(rows, "doc_id long, text string"), size=5, radius=radius).collect()}
    assert got == {d: (f"{fp:016x}", 9 if d == 9 else 0) for (d, _), fp in zip(rows, fps, strict=True)}


@pytest.mark.parametrize("block", [4096, 7])
def test_links_join_what_all_pairs_join(spark, block):
    rng = random.Random(8)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.add(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, block).collect()
    mask = (1 << 64) - 1
    close = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2]
    assert reach(signed, [(r["a"], r["b"]) for r in found]) == reach(signed, close)


def test_near_fingerprints_share_one_of_few_tiles(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for at in rng.sample(range(64), rng.randint(0, 5)):
            y ^= 1 << at
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    tiles = {}
    for r in simhash.tiles(spark.createDataFrame([(x,) for x in {v for p in pairs for v in p}], "fp long"), 5).collect():
        tiles.setdefault(r["fp"], []).append(r["tile"])
    assert all(len(t) == len(set(t)) == 6 for t in tiles.values())  # before: some 300 tiles each
    assert all(set(tiles[x]) & set(tiles[y]) for x, y in pairs)


def test_simhash_query(spark, sf):
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in queries.op6(spark, sf).collect()]
    assert sorted(got) == groups_by_hand(docs)


def vectors(rng, n=160):
    out = []
    for i in range(n):
        label = int(rng.integers(0, 3))
        if i % 3 and out:
            v = np.array(out[int(rng.integers(0, len(out)))][1]) + rng.normal(0, 0.02, 16)
        else:
            v = rng.normal(0, 1, 16)
        out.append((i, [float(x) for x in v.astype(np.float32)], label))
    same = [(1000 + i, out[0][1], out[0][2]) for i in range(5)] + [(7, out[7][1], out[7][2])]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0] * 3, 1), (2004, [2.0] * 3, 1),
           (2005, [None, *[1.0] * 15], 1), (2006, out[0][1], None), (2007, [float("inf"), *[0.0] * 15], 0), (2008, [], 1),
           (2009, [4 * x for x in out[0][1]], out[0][2]), (None, out[0][1], out[0][2])]
    return out + same + odd


def embedding_by_hand(rows, threshold=0.98):
    def fine(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [i for i, (_, v, label) in enumerate(rows) if fine(v, label)]
    unit = {i: np.array(rows[i][1], dtype=np.float64) / np.linalg.norm(np.array(rows[i][1], dtype=np.float64)) for i in ok}
    linked = [(i, j) for i in ok for j in ok if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    root = reach(range(len(rows)), linked)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(r[0], least.get(root[i], r[0]))
    n = [sum(a == i for a, _ in linked) for i in range(len(rows))]
    return sorted(str((r[0], n[i], least.get(root[i]), r[0] is not None and r[0] == least.get(root[i]))) for i, r in enumerate(rows))


@pytest.mark.parametrize("sizes", [{}, {"cell": 10}, {"cell": 10, "block": 4}, {"cell": 40, "most_pivots": 4, "block": 16}])
def test_embedding_groups(spark, sizes):
    rows = vectors(np.random.default_rng(6))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int").repartition(3)
    got = [str(tuple(r)) for r in embedding.grouped(df, **sizes).collect()]
    assert sorted(got) == embedding_by_hand(rows)
    assert embedding.grouped(df.limit(0)).count() == 0


def topk_by_hand(rows, asks, k):
    ok = [(i, v, x) for i, (v, x) in enumerate(rows) if x and all(c is not None for c in x)]
    out = []
    for i, q, w in ok:
        if asks(q):
            best = sorted((-sum(a * b for a, b in zip(w, x, strict=True)), v if v is not None else 1 << 63, j) for j, v, x in ok if j != i and len(x) == len(w))
            out += [(q, r, v if v < 1 << 63 else None, -s) for r, (s, v, _) in enumerate(best[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("spread", [1, 40])
@pytest.mark.parametrize("block", [8192, 30])
def test_topk_against_all_scores(spark, spread, block):
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-spread, spread + 1, 12).tolist()) for i in range(150)]
    rows += [(3, rows[3][1]), (200, None), (220, [1, None]), (240, [5, 5]), (260, [7, -7]), (280, [0] * 12), (None, rows[5][1]), (300, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, v array<long>, score int").repartition(3)
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=6, block=block, chunk=4)
    assert sorted(str(tuple(r)) for r in got.collect()) == topk_by_hand(rows, lambda q: q is not None and q % 20 == 0, 6)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0
    assert topk.search(df, F.lit(False)).count() == 0


def test_search_stops_before_the_end():
    """A block whose best vectors stand out is decided without adding all postings."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    v = rng.integers(-40, 41, (3000, 32))
    v[:50] = v[0] + rng.integers(-3, 4, (50, 32))
    table = pa.table({"size": [32] * 3000, "block": [0] * 3000, "row": range(3000), "vec": range(3000), "v": v.tolist()})
    at = topk.Block(topk.build(table))
    added = []
    reach_of = at.reach
    at.reach = lambda w, level: added.append(reach_of(w, level)) or added[-1]
    place, score = at.best(v[0], 0, 20)
    want = np.sort(v[1:] @ v[0])[::-1][:20]
    assert np.sort(score)[::-1][:20].tolist() == want.tolist()
    assert added[-1].sum() < 3000 * 32 * 0.9
    assert set(place) <= set(range(50))
