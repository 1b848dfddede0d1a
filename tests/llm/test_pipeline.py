"""The pipeline: each stage decides what its operator decides, on all that the one before kept."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from quillwork.llm import langid, near, packing, simhash, toxicity
from quillwork.llm.common import read
from quillwork.llm.queries import WORDS
from tests.llm.test_coding import check_packing
from tests.llm.test_pairs import reach


def plain_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) >= 0.8 if a or b else True


def single_by_hand(rows, radius=5):
    """Ids that stay: candidate groups by all pairs of fingerprints, then by id each text that no kept one of its group resembles."""
    texts = {}
    for d, t in rows:
        t = t or ""
        texts[t] = d if t not in texts or texts[t] is None or (d is not None and d < texts[t]) else texts[t]
    names = sorted(texts, key=lambda t: (texts[t] is None, texts[t] or 0))
    fps = np.array([simhash.fingerprint(t.encode(), 5) for t in names], dtype=np.uint64)
    linked = [(i, j) for i in range(len(names)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius).tolist()]
    root, kept = reach(range(len(names)), linked), {}
    for i, t in enumerate(names):
        s = plain_shingles(t)
        if not any(alike(s, o) for o, _ in kept.get(root[i], [])):
            kept.setdefault(root[i], []).append((s, texts[t]))
    return sorted((d for group in kept.values() for _, d in group), key=str)


@pytest.mark.parametrize("settled", [256, 2])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, settled):
    monkeypatch.setattr(near, "SETTLED", settled)
    rng = random.Random(settled)
    rows, at = [], 0
    for _ in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))]
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.choice((0, 1, 2, 6, 30))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
            rows.append((at, " ".join(words) if rng.random() < 0.8 else "  ".join(words).title()))
            at += rng.randint(1, 3)
    rows += [(900, None), (901, ""), (902, "  "), (None, rows[0][1]), (None, "only without id here"), (None, "only without id here"), (903, "one"), (904, "One"), (905, "b c " * 20_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, h1 int, ROW string").repartition(4)
    got = near.single(df)
    assert got.columns == df.columns and sorted((r["doc_id"] for r in got.collect()), key=str) == single_by_hand(rows)
    assert near.single(df.limit(0)).count() == 0


def test_texts_are_dealt_out_once(spark, sf):
    docs = read(spark, sf, "documents")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = near.single(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # by text and id, so that the copies of one text don't lie together; before: once for the join and once more for the copies
    assert len(re.findall(r"Exchange hashpartitioning\(h1#\w+, h2#\w+, [a-z]", plan)) == 1, plan


def test_planted_near_copies_go_and_clean_documents_stay(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, "/root/testdata/sf0.01", "documents").collect()]
    sets = [(d, plain_shingles(t)) for d, t in docs]
    left = {r["doc_id"] for r in near.single(read(spark, "/root/testdata/sf0.01", "documents")).collect()}
    near_pairs = [(a, b) for i, (a, s) in enumerate(sets) for b, o in sets[:i] if s and o and alike(s, o)]
    met = {d for p in near_pairs for d in p}
    assert {d for d, s in sets if s} - met <= left  # whatever resembles nothing stays
    assert len(near_pairs) > 80 and np.mean([not (a in left and b in left) for a, b in near_pairs]) >= 0.95
    print(len(docs) - len(left), len(near_pairs), sum(a in left and b in left for a, b in near_pairs))


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    names = docs.columns
    learning = docs.where(~langid.held_out())
    prototypes = langid.learn(learning)
    told = langid.predict(docs, prototypes, worth="worth").withColumn("usual", langid.usual_enough(langid.usual(learning, prototypes)))
    want = {r["doc_id"] for r in told.collect() if r["lang_pred"] != "und" and r["usual"]}
    one = corpus_pipeline.languages(spark, docs, sf)
    assert one.columns == names and {r["doc_id"] for r in one.collect()} == want
    two = corpus_pipeline.clean(spark, one, sf)
    scored = toxicity.fit(one, read(spark, sf, "labels")).score(one)
    assert two.columns == names and {r["doc_id"] for r in two.collect()} == {r["doc_id"] for r in scored.where("predicted = 0").collect()}
    kept = [(r["doc_id"], r["text"]) for r in two.collect()]
    three = corpus_pipeline.single(spark, two, sf)
    assert three.columns == names and sorted((r["doc_id"] for r in three.collect()), key=str) == single_by_hand(kept)
    words = packing.words_of(WORDS)
    expected = {r["doc_id"]: list(memoryview(words.text(r["text"]) + words.packed([2])).cast("H")) for r in three.collect()}
    check_packing(corpus_pipeline.run(spark, sf).collect(), expected)


def test_odd_rows(spark, sf):
    docs = read(spark, sf, "documents")
    odd = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "", None, "s", 0), (90003, "#### 1234", "en", "s", 9), (None, "the and of the", "en", None, 14),
                                 (90004, "the and of the", "en", "s", 14), (90004, "the and of the", "en", "s", 14)], docs.schema)
    both = docs.union(odd)
    for _, step in corpus_pipeline.STAGES[:3]:
        both = step(spark, both, sf)
    left = [r["doc_id"] for r in both.collect() if r["doc_id"] is None or r["doc_id"] > 90000]
    assert left == [90004]  # one row of the three with its text
    empty = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, sf)
    assert empty.count() == 0


FOREIGN = ["Wczoraj wieczorem poszliśmy na spacer wzdłuż rzeki i rozmawialiśmy o starych czasach.", "Вчера вечером мы гуляли вдоль реки и говорили о старых временах.",
           "Eilen illalla kävelimme joen rantaa pitkin ja puhuimme vanhoista ajoista.", "昨天晚上我们沿着河边散步，谈论过去的时光。", "昨日の夕方、私たちは川に沿って歩き、昔のことを話しました。",
           "Tegnap este sétáltunk a folyó mentén és a régi időkről beszélgettünk.", "Χθες το βράδυ περπατήσαμε κατά μήκος του ποταμού και μιλήσαμε για τα παλιά."]


def test_language_stage_tells_short_texts_from_foreign_ones(spark):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents")
    rng = random.Random(5)
    held = [r["text"].split() for r in docs.where(langid.held_out()).orderBy("doc_id").collect()]
    clean = []
    for words in (w for w in held if len(w) > 60):
        at = rng.randrange(len(words) - 30)
        clean += [" ".join(words[at : at + n]) for n in (2, 4, 8, 30)]
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=n)) for n in (60, 300, 5000) for _ in range(40)]
    made = [*((100_000 + i, t) for i, t in enumerate(clean)), *((200_000 + i, t) for i, t in enumerate(FOREIGN)), *((300_000 + i, t) for i, t in enumerate(letters))]
    rows = spark.createDataFrame([(d, t, None, "s", len(t)) for d, t in made], docs.schema)
    left = {r["doc_id"] for r in corpus_pipeline.languages(spark, docs.union(rows), sf).collect()}
    assert not {d for d in left if 200_000 <= d < 300_000}
    assert sum(d >= 300_000 for d in left) <= 0.05 * len(letters)
    assert sum(100_000 <= d < 200_000 for d in left) >= 0.97 * len(clean)
    assert sum(d < 100_000 for d in left) >= 990
    print(len(clean), sum(100_000 <= d < 200_000 for d in left), len(letters), sum(d >= 300_000 for d in left), sum(d < 100_000 for d in left))
