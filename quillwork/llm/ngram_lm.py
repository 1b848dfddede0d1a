"""Stupid-backoff scores of documents under a model of pairs of words of the whole corpus, computed relationally.

Words are runs of other characters than the six ASCII white spaces. A word after another scores log(n(pair) / n(pairs that begin so))
if its pair stands ``LEAST`` times or more in the corpus, else log(ALPHA) plus log(n(word) / all words). A document begins with
a mark that counts as a word before its first. Words are told apart by 63 bits of a hash.

1. Count words: a map counts by the slice, Spark sums by hash of the word. Words that make up ``1 / FREQUENT`` of all words or more, at
   most ``FREQUENT`` of them, get short codes; their counts go to every task.
2. Pairs of two words that each make up ``1 / HOT`` or more (at most ``HOT`` squared of them) are hot keys: they are counted
   beforehand, and a map scores them where they stand.
3. Cut: a map takes a stretch of documents at a time and cuts its distinct pairs, each with the documents it stands in, into ``parts``
   of a bounded number of words. A pair whose first word is rare goes where that word belongs, so that all pairs that begin so meet
   there; one whose second word is rare goes where that one belongs, so that all its occurrences meet there; with two rare words it
   goes to both places. Pairs of two frequent words have their words' counts with them and go by themselves. A part of a stretch is one
   row of packed arrays, so that the shuffle moves few bytes and few rows.
4. Score: a task takes a part, counts its pairs and rare words from the distinct pairs of the stretches, and then sums up
   the documents of one stretch after the other: a row of packed sums for each of them. A stretch's rows meet and give its documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from quillwork.llm.common import Stage, raw_texts

LEAST, ALPHA = 2, 0.4
FREQUENT, HOT = 1 << 18, 1 << 9
START = 1  # the code before a document's first word; frequent words have the codes from 2 on, rare words none (0)
CODE = 20  # bits of a code
SLICE = 256
PIECE = 1 << 22  # bytes hashed at a time
CHUNK = 1 << 19  # words whose pairs are put together before they are shuffled
MERGE = 1 << 19  # distinct keys a task holds before it gives its counts away
PART = 1 << 20  # words of a part
RARE_FIRST, RARE_SECOND, FREQUENT_BOTH = range(3)
SCATTER = 0x9E3779B97F | 1  # pairs of codes are multiplied by this, modulo 2**(2 * CODE), to be dealt out evenly
GATHER = pow(SCATTER, -1, 1 << 2 * CODE)
PAIR = (1 << 2 * CODE) - 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTES = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 3
UNBASE = pow(BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of all words of a buffer at once, from prefix sums of its bytes times powers of a base."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", UNBASE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def buffer(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first byte's place) of every word; the sign bit of a hash is set."""
        raw = np.frombuffer(raw, np.uint8)
        inside = np.concatenate(([0], (~SPACE[raw]).view(np.int8), [0]))
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTES[raw] * self.up[: len(raw)], out=sums[1:])
        h = mixed((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64))
        return h | np.uint64(1 << 63), first

    def words(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word of all texts, words of each text). Long texts are hashed in pieces that end at a blank."""
        sizes = np.zeros(len(docs), np.int64)
        parts: list[np.ndarray] = []
        held, held_bytes, at = [], 0, 0

        def flush(upto: int) -> None:
            nonlocal held, held_bytes, at
            if held:
                h, first = self.buffer(b" ".join(held))
                begins = np.cumsum([0, *(len(d) + 1 for d in held[:-1])])
                sizes[at:upto] = np.bincount(np.searchsorted(begins, first, side="right") - 1, minlength=len(held))
                parts.append(h)
            held, held_bytes, at = [], 0, upto

        for i, doc in enumerate(docs):
            if len(doc) > PIECE:
                flush(i)
                for piece in pieces(doc):
                    h, _ = self.buffer(piece)
                    parts.append(h)
                    sizes[i] += len(h)
                at = i + 1
                continue
            if held_bytes + len(doc) > PIECE:
                flush(i)
            held.append(doc)
            held_bytes += len(doc) + 1
        flush(len(docs))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes


def pieces(doc: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``doc`` cut at white space into pieces of about ``size`` bytes; a longer word stays whole."""
    at = 0
    while at < len(doc):
        end = min(at + size, len(doc))
        while end < len(doc) and not SPACE[doc[end]]:
            end += 1
        yield doc[at:end]
        at = end


def counted(docs: DataFrame, rows: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], key: str) -> DataFrame:
    """``(key long, n long, ends long)``: ``rows`` gives a slice's keys, and which of them end a document, from hashes and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return keys, *(np.bincount(where, weights=np.concatenate([h[i] for h in held]), minlength=len(keys)).astype(np.int64) for i in (1, 2))

        def batch_of(k: np.ndarray, n: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n), pa.array(e)], names=[key, "n", "ends"])

        hasher, held, size = Hasher(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                keys, ends = rows(*hasher.words(list(raw_texts(batch.slice(at, SLICE)))))
                keys, where = np.unique(keys, return_inverse=True)
                held.append((keys, np.bincount(where, minlength=len(keys)), np.bincount(where, weights=ends, minlength=len(keys))))
                size += len(keys)
                if size >= MERGE:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size >= MERGE // 2:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*merged(held))

    told = docs.select("text").mapInArrow(run, f"{key} long, n long, ends long")
    return told.groupBy(key).agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def ending(sizes: np.ndarray) -> np.ndarray:
    """Whether a word is the last of its text."""
    out = np.zeros(int(sizes.sum()), np.int64)
    out[np.cumsum(sizes)[sizes > 0] - 1] = 1
    return out


class Codes:
    """Codes of frequent words with their counts, and which of them are hot."""

    def __init__(self, word: np.ndarray, n: np.ndarray, ends: np.ndarray, total: int, begun: int, hot: int):
        order = np.argsort(word)
        self.word, n, ends = word[order], n[order], ends[order]
        self.hot = np.concatenate(([False, True], n * hot >= total))  # of no code, of the start, of the words
        self.n = np.concatenate(([1, 1], n))  # as a second word; the first two are never asked for
        self.begins = np.concatenate(([1, begun], n - ends))  # as a first word
        self.total = max(total, 1)
        self.hot_pair, self.hot_n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return np.where(self.word[at] == h, at + START + 1, 0)

    def pairs(self, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of the word before, code before, code) of every word."""
        code = self.of(h)
        before, code_before = np.roll(h, 1), np.roll(code, 1)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        before[first], code_before[first] = 0, START
        return before, code_before, code


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal rows of sorted ``keys`` begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def part_of(kind: int, key: np.ndarray, parts: int) -> np.ndarray:
    """The part a key belongs to; it does not fall as keys rise."""
    if kind == FREQUENT_BOTH:
        return (key * np.uint64(parts)) >> np.uint64(2 * CODE)
    return (((key >> np.uint64(31)) & np.uint64(0xFFFFFFFF)) * np.uint64(parts)) >> np.uint64(32)


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of numbers of 8 bytes. Bytes of a rank lie together, which zstd shortens."""
    return pa.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), "zstd", asbytes=True)


def opened(data: memoryview, *lengths: int) -> list[np.ndarray]:
    """The columns again, unsigned."""
    raw = np.frombuffer(pa.decompress(data, 8 * sum(lengths), "zstd", asbytes=True), np.uint8)
    ends = np.cumsum([0, *lengths])
    return [np.ascontiguousarray(raw[8 * a : 8 * b].reshape(8, -1).T).view(np.uint64).ravel() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def packed(key: np.ndarray, other: np.ndarray, size: np.ndarray, entries: np.ndarray) -> bytes:
    """Pairs of a stretch in the order of ``key``, with their entries, ``size`` of each."""
    return np.array([len(key), len(entries)]).tobytes() + squeezed(np.diff(key, prepend=np.uint64(0)), other, size, entries)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k, n = np.frombuffer(data, np.int64, 2).tolist()
    steps, other, size, entries = opened(memoryview(data)[16:], k, k, k, n)
    return np.cumsum(steps, dtype=np.uint64), other, size.view(np.int64), entries.view(np.int64)


def cut(docs: DataFrame, codes: Codes, parts: int, least: int, alpha: float) -> DataFrame:
    """``(part, kind, base, data, ids)``: the pairs of stretches of about ``CHUNK`` words, one row for each part and kind of pairs.

    Documents are numbered from ``base`` on. A pair's entries are how often it stands in a document, times 2**16, plus the document's
    number. One more row a stretch has ``ids``, the words of its documents and the sums of their hot pairs."""
    schema = StructType([StructField("part", IntegerType()), StructField("kind", IntegerType()), StructField("base", LongType()),
                         StructField("data", BinaryType()), StructField("ids", ArrayType(docs.schema["id"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, base = Hasher(), TaskContext.get().partitionId() << 33

        def rows(part, kind, data, ids) -> pa.RecordBatch:
            cols = [pa.array(part, pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array([base] * len(part), pa.int64()), pa.array(data, pa.binary()), ids]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        def cut_kind(kind: int, key: np.ndarray, other: np.ndarray, owner: np.ndarray, ids: pa.DataType) -> pa.RecordBatch:
            order = np.lexsort((other, key))
            key, other, owner = key[order], other[order], owner[order]
            entry, pair = runs(key, other, owner), runs(key, other)
            entries = np.diff(np.append(entry, len(key))) << 16 | owner[entry]
            at = np.searchsorted(entry, pair)  # a pair's first entry
            key, other, ends = key[pair], other[pair], np.append(at, len(entry))
            part = part_of(kind, key, parts)
            edge = np.append(runs(part), len(part))
            data = [packed(key[a:b], other[a:b], np.diff(ends[a : b + 1]), entries[ends[a] : ends[b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            return rows(part[edge[:-1]].astype(np.int32), kind, data, pa.nulls(len(data), pa.list_(ids)))

        def give(held: list, ids: list) -> Iterator[pa.RecordBatch]:
            h, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            before, first, second = codes.pairs(h, sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            ids = pa.concat_arrays(ids)
            hot = codes.hot[first] & codes.hot[second]
            a, b = first[hot], second[hot]
            n = codes.hot_n[np.searchsorted(codes.hot_pair, a << CODE | b)] if len(a) else a
            value = np.where(n >= least, np.log(n / codes.begins[a]), np.log(codes.n[b]) + math.log(alpha / codes.total))
            told = np.bincount(owner[hot], weights=value, minlength=len(sizes))
            place = int(mixed(np.array([base], np.uint64))[0] % np.uint64(parts))
            yield rows([place], -1, [sizes.tobytes() + told.tobytes()],
                       pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
            is_rare = first == 0
            if is_rare.any():
                other = np.where(second > 0, second.view(np.uint64), h)[is_rare]
                yield cut_kind(RARE_FIRST, before[is_rare], other, owner[is_rare], ids.type)
            is_rare = second == 0
            if is_rare.any():
                other = np.where(first > 0, first.view(np.uint64), before)[is_rare]
                yield cut_kind(RARE_SECOND, h[is_rare], other, owner[is_rare], ids.type)
            rest = (first > 0) & (second > 0) & ~hot
            if rest.any():
                key = (first[rest] << CODE | second[rest]).view(np.uint64) * np.uint64(SCATTER) & np.uint64(PAIR)
                yield cut_kind(FREQUENT_BOTH, key, np.zeros(len(key), np.uint64), owner[rest], ids.type)

        held, ids, size, count = [], [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                held.append(hasher.words(list(raw_texts(part))))
                ids.append(part.column(0))
                size, count = size + len(held[-1][0]), count + part.num_rows
                if size >= CHUNK or count > (1 << 16) - SLICE:
                    yield from give(held, ids)
                    base += count
                    held, ids, size, count = [], [], 0, 0
        if held:
            yield from give(held, ids)

    return docs.mapInArrow(run, schema)


def values(kind: int, key: np.ndarray, other: np.ndarray, n: np.ndarray, codes: Codes, least: int, alpha: float) -> np.ndarray:
    """The score of each of a part's distinct pairs of stretches (``n`` times in its stretch), from all of them. The other place of a pair
    of two rare words tells the score that is 0 here."""
    order = np.lexsort((other, key))
    key, other, n = key[order], other[order], n[order]
    pair, word = runs(key, other), runs(key)
    n_pair = np.add.reduceat(n, pair)
    n_word = np.repeat(np.add.reduceat(n, word), np.diff(np.append(np.searchsorted(pair, word), len(pair))))  # of the rare word of the place
    key, other = key[pair], other[pair]
    low = math.log(alpha / codes.total)
    if kind == FREQUENT_BOTH:
        code = (key * np.uint64(GATHER) & np.uint64(PAIR)).view(np.int64)
        begins, back = codes.begins[code >> CODE], codes.n[code & ((1 << CODE) - 1)]
    else:
        coded = other < np.uint64(1 << CODE)
        code = np.where(coded, other, 0).astype(np.int64)
        begins, back = (n_word, codes.n[code]) if kind == RARE_FIRST else (codes.begins[code], n_word)
    enough = n_pair >= least
    value = np.where(enough, np.log(n_pair / begins), np.log(back) + low)
    if kind != FREQUENT_BOTH:
        value[~coded & (enough == (kind == RARE_SECOND))] = 0.0
    out = np.empty(len(order))
    out[order] = np.repeat(value, np.diff(np.append(pair, len(order))))
    return out


def summed(codes: Codes, least: int, alpha: float) -> Callable[[pa.Table], pa.Table]:
    """Scores of the documents of a part: one row ``(base, data, ids)`` for each stretch, with the numbers and sums of its documents in
    ``data``. Entries are unpacked for a stretch at a time, only distinct pairs for all of them. Rows with ``ids`` stay as they are."""

    def run(part: pa.Table) -> pa.Table:
        names = ["base", "data", "ids"]
        kinds, bases, found = part["kind"].to_numpy(), part["base"].to_numpy(), {}
        for kind in (RARE_FIRST, RARE_SECOND, FREQUENT_BOTH):
            mine = np.flatnonzero(kinds == kind).tolist()
            if not mine:
                continue
            keys, others, ns = [], [], []
            for at in mine:
                key, other, size, entries = unpacked(part["data"][at].as_py())
                keys.append(key)
                others.append(other)
                ns.append(np.add.reduceat(entries >> 16, np.cumsum(size) - size))
            ends = np.cumsum([0, *map(len, keys)])
            told = values(kind, np.concatenate(keys), np.concatenate(others), np.concatenate(ns), codes, least, alpha)
            del keys, others, ns
            for i, at in enumerate(mine):
                _, _, size, entries = unpacked(part["data"][at].as_py())
                owner = entries & 0xFFFF
                each = np.bincount(owner, weights=np.repeat(told[ends[i] : ends[i + 1]], size) * (entries >> 16))
                there = np.flatnonzero(np.bincount(owner))
                found.setdefault(int(bases[at]), []).append((there, each[there]))
        data = []
        for sums in found.values():
            there, where = np.unique(np.concatenate([x[0] for x in sums]), return_inverse=True)
            each = np.bincount(where, weights=np.concatenate([x[1] for x in sums]))
            data.append(np.array([len(there)]).tobytes() + squeezed(np.diff(there, prepend=0), each))
        ids = part.schema.field("ids").type
        out = pa.table([pa.array(list(found), pa.int64()), pa.array(data, pa.binary()), pa.nulls(len(data), ids)], names=names)
        return pa.concat_tables([part.filter(pa.array(kinds == -1)).select(names), out])

    return run


def gathered(stretch: pa.Table) -> pa.Table:
    """``(id, n_grams, score)`` of the documents of a stretch from the sums of all parts."""
    at = int(np.flatnonzero(stretch["ids"].is_valid().to_numpy())[0])
    ids, raw = stretch["ids"][at].values, stretch["data"][at].as_py()
    sizes, told = np.frombuffer(raw, np.int64, len(ids)), np.frombuffer(raw, np.float64, len(ids), 8 * len(ids)).copy()
    for i in range(stretch.num_rows):
        if i != at:
            data = stretch["data"][i].as_py()
            k = int(np.frombuffer(data, np.int64, 1)[0])
            steps, each = opened(memoryview(data)[8:], k, k)
            told[np.cumsum(steps.view(np.int64))] += each.view(np.float64)
    return pa.table([ids, pa.array(sizes), pa.array(told)], names=["id", "n_grams", "score"])


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, alpha: float = ALPHA,
          frequent: int = FREQUENT, hot: int = HOT) -> DataFrame:
    """One row for each document: ``doc``, ``n_grams long`` (its words), ``score double`` (the sum of their log scores) and
    ``mean_score double`` (null without words). Null and empty texts and texts of nothing but white space have no words and score
    0. Rows stay as they are, with repeated or null ids too, and repeated texts are counted as often as they stand. An empty
    table gives an empty table. Other columns are left out, whatever their names.

    ``frequent`` and ``hot`` bound what every task holds and spread hot keys; scores do not depend on them.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "ngram")
    docs = docs.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").alias("text"))
    words = stage.put(counted(docs, lambda h, sizes: (h, ending(sizes)), "word"))
    total, begun = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0))).first()
    known = words.where(F.col("n") * frequent >= total).toPandas()  # ``frequent`` rows at most
    stage.drop(words)
    codes = Codes(known["word"].to_numpy(np.int64).view(np.uint64), known["n"].to_numpy(np.int64), known["ends"].to_numpy(np.int64), total, begun, hot)

    def hot_pairs(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, second = codes.pairs(h, sizes)
        both = codes.hot[first] & codes.hot[second]
        pair = ((first << CODE) | second)[both].view(np.uint64)
        return pair, np.zeros(len(pair))

    hot_n = counted(docs, hot_pairs, "pair").toPandas().sort_values("pair")  # about ``hot`` squared rows at most
    codes.hot_pair, codes.hot_n = hot_n["pair"].to_numpy(np.int64), hot_n["n"].to_numpy(np.int64)
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    pieces_of = cut(docs, codes, parts, least, alpha)
    kept = StructType([f for f in pieces_of.schema.fields if f.name in ("base", "data", "ids")])
    told = StructType([docs.schema["id"], StructField("n_grams", LongType()), StructField("score", DoubleType())])
    sums = pieces_of.groupBy("part").applyInArrow(summed(codes, least, alpha), kept)
    out = sums.groupBy("base").applyInArrow(gathered, told)
    out = stage.put(out).select(F.col("id").alias(doc), "n_grams", "score")
    return out.withColumn("mean_score", F.col("score") / F.nullif(F.col("n_grams"), F.lit(0)))
