"""Sequences of token ids packed along a space-filling curve, so that a sequence holds neighbouring documents.

One map turns each document into ids and a point: signed hashed counts of its tokens, damped by a logarithm, scaled to
length one and projected to a few dimensions. The points are centred and scaled by the corpus' own mean and deviation,
laid on a grid by the normal distribution and given their key on Hilbert's curve. One range shuffle by (key, id) sorts the
corpus along the curve; ties such as copies are split by the id, so no key is hot. Each partition then fills its sequences
in that order in one streaming pass, cutting documents where a sequence is full. The rest of a partition is closed in
sequences of power-of-two lengths, which need no padding.

Ids travel as two or four little-endian bytes a token, staged once; tokenising never runs twice.
"""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, DoubleType, LongType, StructField, StructType)

from quillwork.llm.common import Stage, append_columns, texts

DIMS, BITS = 4, 12  # of the curve
HASHED = 2048  # length of the hashed document vector
SLICE = 64  # documents counted at once
KEEP = 200_000  # words of one generation that a worker remembers the ids of; it holds two at most
LATIN = regex.compile(r"[\x21-\x7e¡-įĲ-ſ]+")  # composed already, and one small letter for each capital
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")  # white space to Python only
MATCH = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # fixed value: the file's own pattern


class WordIds:
    """The ids that ``tokenizers`` gives a text, word by word.

    The vocabulary drops white space and joins nothing across it, so a text's ids are those of its words in a row and a
    word's ids can be remembered. A word of plain Latin letters is composed and needs no more than lower case, the file's
    pattern and its merges; the merges run in tiktoken with the word's end as a byte that no text has. Every other word,
    and every text with white space that only Python knows or with one of the file's added tokens (which the library takes as
    one id wherever it stands), goes to the library itself.

    Words are remembered in two generations: a full one becomes the old one, and a word met again moves to the young one, so
    frequent words stay known and memory stays bounded.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        special = {t["content"] for t in spec["added_tokens"]}
        end, ranks = spec["model"]["end_of_word_suffix"], {}
        for token, rank in spec["model"]["vocab"].items():
            if token not in special:
                last = token != end and token.endswith(end)
                ranks[bytes(byte_of[c] for c in (token[: -len(end)] if last else token)) + b"\xff" * last] = rank
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.kind = "<u2" if len(spec["model"]["vocab"]) <= 1 << 16 else "<u4"
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind == '<u2' else 'I'}", *ids)

    def word(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is not None:
            return got
        got = self.old.get(word)
        if got is not None:
            pass
        elif not LATIN.fullmatch(word):
            got = self.packed(self.library.encode(word, add_special_tokens=False).ids)
        elif word[-1] in ".," and word[-2:-1].isalpha():
            got = self.word(word[:-1]) + self.word(word[-1])
        elif (small := word.lower()) != word:
            got = self.word(small)
        else:
            ids: list[int] = []
            for match in (word,) if word.isalpha() else MATCH.findall(word):
                ids += self.merge(match.encode() + b"\xff")
            got = self.packed(ids)
        if len(word) <= 64:
            if len(self.known) >= KEEP:
                self.old, self.known = self.known, {}
            self.known[word] = got
        return got

    def text(self, text: str) -> bytes:
        if ODD_SPACE.search(text) or self.added.search(text):
            return self.packed(self.library.encode(text, add_special_tokens=False).ids)
        words = text.split()
        got = list(map(self.known.get, words))
        if None in got:
            got = [self.word(w) if ids is None else ids for w, ids in zip(words, got, strict=True)]
        return b"".join(got)


@lru_cache(maxsize=2)
def words_of(path: str) -> WordIds:
    return WordIds(path)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of whole numbers."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def projector(dims: int, size: int = 1 << 16):
    """From the ids of documents to their points: hashed signed counts, then a fixed random projection."""
    h = mixed(np.arange(size))
    bucket, sign = (h % np.uint64(HASHED)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
    turn = np.random.default_rng(7).standard_normal((HASHED, dims))

    def points(docs: list[np.ndarray]) -> np.ndarray:
        damped = np.zeros((len(docs), HASHED))
        for at in range(0, len(docs), SLICE):
            some = docs[at : at + SLICE]
            ids = np.concatenate(some) & (size - 1)
            row = np.repeat(np.arange(len(some)) * HASHED, [len(d) for d in some])
            counts = np.bincount(bucket[ids] + row, weights=sign[ids], minlength=len(some) * HASHED)
            met = np.flatnonzero(counts)
            flat = damped[at : at + SLICE].reshape(-1)
            flat[met] = np.copysign(np.log1p(np.abs(counts[met])), counts[met])
        return damped @ turn / np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-12)

    return points


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys along Hilbert's curve of grid cells (n, dims), by Skilling's transpose; dims * bits must be under 64."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(df: DataFrame, path: str, text: str = "text", end_id: int = 2, dims: int = DIMS) -> DataFrame:
    """``df`` without its text and with ``ids binary`` (little-endian, ending in ``end_id``; 2 bytes an id up to 65,536 ids, else 4) and
    ``point array<double>``. Null and empty texts are ``end_id`` alone. A map without a shuffle."""

    def make():
        words, points = words_of(path), projector(dims)
        end = words.packed([end_id])

        def fn(batch: pa.RecordBatch) -> list:
            ids = [words.text(t) + end for t in texts(batch, text)]
            where = points([np.frombuffer(i, words.kind) for i in ids]) if ids else np.zeros((0, dims))
            ends = np.arange(0, len(ids) * dims + 1, dims, dtype=np.int32)
            return [pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(where.ravel()))]

        return fn

    return append_columns(df, [StructField("ids", BinaryType()), StructField("point", ArrayType(DoubleType(), False))], make, drop=[text])


def filled(batches: Iterator[pa.RecordBatch], doc: str, length: int, kind: str, part: int) -> Iterator[pa.RecordBatch]:
    """Pieces of documents in the order given. All but the last rows of a partition fill sequences of ``length`` ids; the
    rest is closed at powers of two."""
    names = [doc, "start", "length", "doc_tokens", "sequence_id", "offset", "piece"]
    sequence, held = 0, []  # held: pieces of the open sequence as (doc, start, ids, doc_tokens)
    room = length

    def close(pieces: list, number: int) -> list:
        at, out = 0, []
        for d, start, ids, total in pieces:
            out.append((d, start, len(ids), total, (part << 32) | number, at, ids.astype("<u4").tobytes()))
            at += len(ids)
        return out

    def batch(rows: list, kind_of) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [kind_of, *[pa.int64()] * 5, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    kind_of = pa.int64()
    for b in batches:
        kind_of = b.schema.field(doc).type
        rows = []
        for d, raw in zip(b.column(doc), b.column("ids"), strict=True):
            ids = np.frombuffer(raw.as_buffer(), kind)
            start = 0
            while start < len(ids):
                cut = ids[start : start + room]
                held.append((d.as_py(), start, cut, len(ids)))
                start += len(cut)
                room -= len(cut)
                if room == 0:
                    rows += close(held, sequence)
                    sequence, held, room = sequence + 1, [], length
            if len(rows) >= 1024:
                yield batch(rows, kind_of)
                rows = []
        held = [(d, s, c.copy(), n) for d, s, c, n in held]  # the batch's memory goes
        if rows:
            yield batch(rows, kind_of)
    left = length - room
    while left:
        take = 1 << (left.bit_length() - 1)
        left -= take
        pieces = []
        while take:
            d, start, ids, total = held.pop(0)
            pieces.append((d, start, ids[:take], total))
            if len(ids) > take:
                held.insert(0, (d, start + take, ids[take:], total))
            take -= len(pieces[-1][2])
        yield batch(close(pieces, sequence), kind_of)
        sequence += 1


def pack(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", length: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents: ``doc``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``piece``
    (the ids, little-endian in 4 bytes).

    Every id lies in exactly one piece; offsets in a sequence are gapless from 0; every sequence is full or a power of two
    long, so nothing is padded. Null and empty texts are one id. Rows with the same or no id stay rows of their own. Other
    columns are left out, whatever their names. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "pack")
    coded = stage.put(tokenised(docs.select(F.col(f"`{doc}`").alias(doc), F.col(f"`{text}`").alias("text")), path, "text", end_id))
    middle = coded.agg(*[f(F.col("point")[i]) for i in range(DIMS) for f in (F.avg, F.stddev_pop)]).first()
    mean = [m or 0.0 for m in middle[::2]]
    spread = [s or 1.0 for s in middle[1::2]]

    erf = np.vectorize(math.erf, otypes=[float])

    @F.arrow_udf("long")  # of the points only: the range shuffle works this out twice, and ids need not go to Python for it
    def key(points: pa.Array) -> pa.Array:
        flat = points.flatten().to_numpy().reshape(-1, DIMS)
        share = (1 + erf((flat - mean) / np.array(spread) / math.sqrt(2))) / 2
        return pa.array(hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS))

    along = coded.select(doc, "ids", key("point").alias("key"))
    ordered = along.repartitionByRange("key", doc).sortWithinPartitions("key", doc, "ids")
    kind = "<u2" if vocabulary(path) <= 1 << 16 else "<u4"
    schema = StructType([coded.schema[doc], *[StructField(n, LongType()) for n in
                         ("start", "length", "doc_tokens", "sequence_id", "offset")], StructField("piece", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from filled(batches, doc, length, kind, TaskContext.get().partitionId())

    return ordered.mapInArrow(run, schema)


def vocabulary(path: str) -> int:
    import json

    with open(path, encoding="utf-8") as f:
        return len(json.load(f)["model"]["vocab"])
