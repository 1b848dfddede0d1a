"""BPE, packing and sharding against the libraries and plain computations."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillwork.llm import bpe, packing, queries, sharding

DOCS = "doc_id long, text string"
TEXTS = ["", None, " ", "it's   a 'test'\n\nend ", "Ünïcödé ßtraße 12345 !!!", "日本語のテキスト é ́x", "ΑΣ ΣΑΣ. İstanbul", "<|endoftext|>",
         "a\x1cb c\x85d e", "x" * 3000, "don't we'll 'sabc ''s a's", "the the the", "the the the", " nbsp…"]


def rows(texts):
    return [(i, t) for i, t in enumerate(texts)]


def test_parts_give_the_ids_of_the_whole():
    enc = bpe.coder(queries.RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    letters = "ab1 2'sé\n\t.!?-日 x re ll"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 400)))
        assert bpe.encode_text(enc, text, least=rng.choice([1, 5, 50])) == enc.encode_ordinary(text)
    blank = "word" + " \n" * 800 + "next" + "\t" * 2000
    assert bpe.encode_text(enc, blank, least=64) == enc.encode_ordinary(blank)


def test_white_space_beyond_the_library_is_coded():
    enc = bpe.coder(queries.RANKS, public_tokenizers.PATTERN)
    text = "a" + " " * 1_000_000 + "b"
    ids = bpe.encode_text(enc, text)
    assert enc.decode_bytes(ids).decode() == text
    assert ids[-1] == enc.encode_ordinary(" b")[0] and ids[0] == enc.encode_ordinary("a")[0]


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows(TEXTS)], DOCS + ", Ids int, decoded string")
    out = bpe.decode(bpe.encode(df, queries.RANKS, public_tokenizers.PATTERN), queries.RANKS, public_tokenizers.PATTERN).collect()
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.coder(queries.RANKS, public_tokenizers.PATTERN)._mergeable_ranks)
    assert len(out) == len(TEXTS)
    for r in out:
        text = TEXTS[r["doc_id"]] or ""
        assert r["ids"] == enc.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
        assert bytes(r["decoded"]).decode() == text
    none = bpe.encode(df.limit(0), queries.RANKS, public_tokenizers.PATTERN)
    assert none.count() == 0 and none.columns == ["doc_id", "text", "decoded", "ids", "n_tokens"]


def test_bpe_query_digests(spark, sf):
    got = {r["doc_id"]: r for r in queries.op1(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    enc = bpe.coder(queries.RANKS, public_tokenizers.PATTERN)
    assert len(got) == len(docs)
    for d in docs:
        ids = enc.encode_ordinary(d["text"])
        assert got[d["doc_id"]]["n_tokens"] == len(ids)
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.WORDS)


def test_word_ids_are_those_of_the_library(library):
    words = packing.words_of(queries.WORDS)
    rng = random.Random(5)
    letters = "abcXYZéÈßñÇ'’.,!?-_0123 \n\t ΣσİŉĲſ日한é…"
    special = ["a <|endoftext|> b", "mid<|endoftext|>dle <|startoftext|><|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "x" * 70 + "<|startoftext|>Y"]
    assert 49407 in library.encode(special[0], add_special_tokens=False).ids
    texts = [t or "" for t in TEXTS] + special + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for t in texts:
        ids = np.frombuffer(words.text(t), words.kind).tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids, t


def test_words_are_remembered_within_bounds(library, monkeypatch):
    monkeypatch.setattr(packing, "KEEP", 20)
    words = packing.WordIds(queries.WORDS)
    rng = random.Random(9)
    for _ in range(300):
        t = " ".join(f"w{int(rng.paretovariate(0.7)) % 500}." for _ in range(10))
        assert np.frombuffer(words.text(t), words.kind).tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(words.known) <= 20 and len(words.old) <= 20


def test_points_against_counts_one_by_one():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 49408, n).astype("<u2") for n in [0, 1, 5000, *rng.integers(1, 300, 200)]]
    points = packing.projector(4)
    h = packing.mixed(np.arange(1 << 16))
    bucket, sign = (h % np.uint64(packing.HASHED)).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0)
    turn = np.random.default_rng(7).standard_normal((packing.HASHED, 4))
    for d, got in zip(docs, points(docs), strict=True):
        v = np.zeros(packing.HASHED)
        for i in d:
            v[bucket[i]] += sign[i]
        v = np.sign(v) * np.log1p(np.abs(v))
        assert np.allclose(got, v @ turn / max(np.linalg.norm(v), 1e-12), atol=1e-12)


def check_packing(got, expected, length=4096):
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(expected)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            ids = np.array(expected[d][at : at + p["length"]], dtype="<u4")
            assert p["start"] == at and p["length"] == len(ids) > 0 and p["ids_crc32"] == zlib.crc32(ids.tobytes())
            assert p["doc_tokens"] == len(expected[d])
            at += p["length"]
        assert at == len(expected[d])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length and at & (at - 1) == 0  # full or a power of two: no padding


def test_packing_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    expected = {d["doc_id"]: library.encode(d["text"], add_special_tokens=False).ids + [2] for d in docs}
    check_packing(queries.op2(spark, sf).collect(), expected)


def test_packing_of_odd_rows(spark, library):
    texts = [*TEXTS, "word " * 20_000]
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows(texts)], DOCS + ", key int, point double").repartition(3)
    got = packing.pack(df, queries.WORDS).withColumn("ids_crc32", F.crc32("piece")).collect()
    check_packing(got, {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows(texts)})
    assert packing.pack(df.limit(0), queries.WORDS).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "d")], DOCS)
    out = packing.pack(same, queries.WORDS).collect()
    assert sum(r["length"] for r in out) == 3 + 3 + 2 + 2


def test_hilbert_keys_are_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_neighbours_are_packed_together(spark):
    a, b = "the cat sat on the mat with the other cat ", "quantum fields commute at space like distance "
    df = spark.createDataFrame([(i, (a if i % 2 else b) * 40) for i in range(60)], DOCS)
    seqs = {}
    for r in packing.pack(df, queries.WORDS, length=1024).collect():
        seqs.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 2)
    assert sum(len(kinds) > 1 for kinds in seqs.values()) <= 2


def test_shards_against_a_plain_scan(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([0, 1, 5, 1000]), "x") for i in range(500)] + [(7, 5, "x"), (7, 5, "x"), (None, 3, "y"), (8, None, "z")]
    df = spark.createDataFrame(data, "doc_id long, size long, Slot string").repartition(5)
    got = sharding.shard(df, 8, ["doc_id"]).collect()
    assert len(got) == len(data) and got[0].asDict().keys() == {"doc_id", "size", "shard", "slot"}
    total, at, want = sum(s or 0 for _, s, _ in data), 0, []
    for i, s in sorted(((i, s) for i, s, _ in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want.append((i, s, min(7, (2 * at + (s or 0)) * 8 // (2 * total))))
        at += s or 0
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["size"], r["shard"])) for r in got)
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_shards_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, size long")
    assert sharding.shard(df, 8, ["doc_id"]).count() == 0
    zero = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, size long")
    assert {(r["shard"], r["slot"]) for r in sharding.shard(zero, 8, ["doc_id"]).collect()} == {(0, 0), (0, 1)}


def test_shard_query(spark, sf):
    got = queries.op3(spark, sf).collect()
    docs = {d["doc_id"]: d["text"].encode() for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = [0] * 8
    for r in got:
        assert r["size"] == len(docs[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]])
        sizes[r["shard"]] += r["size"]
    assert len(got) == len(docs) and max(sizes) - min(sizes) <= 2 * max(len(t) + 1 for t in docs.values())
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == sorted(docs)
    assert isinstance(got[0], Row)
