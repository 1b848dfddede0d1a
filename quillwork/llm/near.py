"""One document of each group of near duplicates, by SimHash candidates and exact resemblance.

``simhash.links`` finds texts whose fingerprints of five-word shingles are within a few bits and joins them to candidate
groups. Within a group resemblance is then exact, on sets of shingles: a text goes only if a text that stays resembles it by
``LEAST`` or more. Texts are taken by id, so of a set of near copies the least id stays. Equal texts are folded before
anything is compared.

A group is settled in one task as long as it has ``SETTLED`` different texts and ``HELD`` bytes at most. In a larger one the least text
is held against all others by a join, what resembles it goes, and the rest is a smaller group in the next round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField

from quillwork.llm import simhash
from quillwork.llm.common import Stage, append_columns, components, raw_texts

SHINGLE, RADIUS, LEAST = 5, 5, 0.8
SETTLED, HELD = 4096, 64 << 20  # texts of a group that one task settles, and bytes of shingles they may have
SEED = 42


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted different hashes of a text's shingles of lower-cased words; a text of fewer words is one shingle, of none has none."""
    words = text.lower().split()
    n = max(1, len(words) - size + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(n)], dtype=np.uint64))


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles over all; two texts without any resemble each other fully."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), np.uint64) for v in (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)]


def _settle(table: pa.Table, least: float) -> pa.Table:
    """The texts of one group that go: each resembles a text before it, by id, that stays."""
    table = table.sort_by([("lost_id", "ascending"), ("id", "ascending"), ("h1", "ascending"), ("h2", "ascending")])
    stay, gone = [], []
    for i, s in enumerate(_sets(table.column("shingles"))):
        close = any(len(s) >= least * len(o) and len(o) >= least * len(s) and resemblance(s, o) >= least for o in stay)
        (gone.append(i) if close else stay.append(s))
    return table.take(pa.array(gone, pa.int64())).select(["h1", "h2"])


def staying(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """``(h1, h2, id)`` of the texts that stay: their hashes (``text_key``) and the least id each has. Null and empty texts are one text."""
    stage = Stage(docs.sparkSession, "near")
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc}`").alias("id"), value.alias("text"), *text_key(value))
    keyed = stage.put(simhash.fingerprints(rows, size=size, drop=["text"]))
    distinct = stage.put(keyed.groupBy("h1", "h2", "fp").agg(F.min("id").alias("id")))
    roots = components(stage, stage.put(simhash.links(distinct.select("fp").distinct(), radius)))
    member = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("h1", "h2", "id", F.coalesce("root", "fp").alias("root"))
    many = member.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    member = stage.put(member.join(many, "root").select("root", "h1", "h2", "id"))

    def make():
        return lambda batch: [pa.array([shingles(t, size).tobytes() for t in raw_texts(batch)], pa.binary())]

    # one row of each text: that with its least id
    wanted = member.toDF(*[f"m_{c}" for c in member.columns])
    one = (rows.join(wanted, (F.col("h1") == F.col("m_h1")) & (F.col("h2") == F.col("m_h2")) & F.col("id").eqNullSafe(F.col("m_id")))
           .select("h1", "h2", "id", F.col("m_root").alias("root"), "text").dropDuplicates(["h1", "h2", "id"]))
    left = stage.put(append_columns(one, [StructField("shingles", BinaryType())], make, drop=["text"]).withColumn("lost_id", F.col("id").isNull()))
    gone = []
    key = ["h1", "h2"]
    while True:
        size_of = left.groupBy("root").agg((~((F.count("*") <= SETTLED) & (F.sum(F.length("shingles")) <= HELD))).alias("is_large"))
        large_roots = size_of.where("is_large").select("root")
        gone.append(stage.put(left.join(large_roots, "root", "left_anti").groupBy("root").applyInArrow(lambda t: _settle(t, least), "h1 bigint, h2 bigint")))
        if large_roots.isEmpty():
            break
        large = left.join(large_roots, "root", "left_semi")
        first = large.groupBy("root").agg(F.min_by(F.struct("h1", "h2", F.col("shingles").alias("of")), F.struct("lost_id", "id", "h1", "h2")).alias("first"))

        def compare():
            return lambda batch: [pa.array([resemblance(a, b) >= least for a, b in zip(_sets(batch.column("shingles")), _sets(batch.column("of")), strict=True)])]

        met = large.join(first, "root").select(*large.columns, "first.of", F.expr("h1 = first.h1 AND h2 = first.h2").alias("own"))
        met = stage.put(append_columns(met, [StructField("close", BooleanType())], compare).drop("of"))
        gone.append(stage.put(met.where("close AND NOT own").select(*key)))
        before, left = left, stage.put(met.where("NOT close AND NOT own").select(*left.columns))
        stage.drop(before)
        stage.drop(met)
    stage.drop(left)
    out = gone[0]
    for g in gone[1:]:
        out = out.union(g)
    return distinct.join(out, key, "left_anti").select(*key, "id")


def text_key(value) -> list:
    """Two hashes that tell texts apart."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(value, F.lit(1)).alias("h2")]


def single(docs: DataFrame, doc: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near duplicates, with all its columns.

    Of rows with the same text the one with the least id stays, a row without an id only if none has one; of rows that agree in
    both, one. Null and empty texts are one text. Columns may have any names. An empty table gives an empty table.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # an id in a struct equals itself even if it is null; rows are dealt out once by the keys of both the join and the copies
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(f"`{doc}`").alias("id")).alias("own"), *text_key(value))
    keys = staying(docs, doc, text, **settings).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.struct("id").alias("least"))
    kept = rows.join(keys, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("own") == F.col("least")), "left_semi")
    return kept.dropDuplicates(["h1", "h2", "own"]).select("row.*")  # rows that agree in id and text
