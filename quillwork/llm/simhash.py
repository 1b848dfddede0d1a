"""Near duplicates by SimHash, linked by tiled exact comparison.

A map gives every document its fingerprint. Equal fingerprints are folded into one row before anything is compared. Its
64 bits are cut into r + 1 parts: two fingerprints within a radius of r bits agree in one part at least, so a fingerprint is
put into a tile for each part, by that part's last ``KEY`` bits, and only those that share a tile are compared. A tile of more
than ``BLOCK`` fingerprints is split into blocks. Each block meets itself and the blocks after it in one task by numpy
exclusive-or and bit counts. A task gives back a forest over the links it found, never the pairs, so a dense group costs
rows in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from quillwork.functions.shuffle import spread
from quillwork.llm.common import Forest, Stage, append_columns, components, raw_texts

SEED, SHINGLE, RADIUS = 42, 3, 2
BLOCK = 4096
KEY = 12  # bits of a part that make its tile


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a UTF-8 text: a bit is set if over half of the shingles' hashes set it."""
    words = text.lower().split()  # on bytes: A to Z only, and exactly the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - size + 1)
    stops = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n], stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", size: int = SHINGLE, seed: int = SEED,
                 drop: Iterable[str] = ()) -> DataFrame:
    """``docs`` without ``drop`` and with ``out long``, the fingerprint as a signed number. Texts that are null or have no word have 0."""

    def make():
        def fn(batch: pa.RecordBatch) -> list:
            return [pa.array(np.array([fingerprint(t, size, seed) for t in raw_texts(batch, text)], dtype=np.uint64).view(np.int64))]

        return fn

    return append_columns(docs, [StructField(out, LongType())], make, drop=drop)


def tiles(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, tile)``: the ``radius`` + 1 tiles of each fingerprint. Two within ``radius`` bits share one at least."""
    width = 64 // (radius + 1)
    bits = min(width, KEY)
    keys = [F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + (k << bits) for k in range(radius + 1)]
    return fps.select("fp", F.explode(F.array(*[k.cast("int") for k in keys])).alias("tile"))


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges ``(a, b)`` of a forest for each task, which together join exactly the fingerprints (column fp, distinct) that
    chains of links within ``radius`` bits join."""
    tiled = tiles(fps, radius)
    sizes = (tiled.groupBy("tile").agg(F.count("*").alias("n")).where("n > 1")  # radius + 1 times 2**KEY tiles at most
             .select("tile", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    # every fingerprint goes to its own block of its tile and to the blocks before that
    sent = (tiled.join(F.broadcast(sizes), "tile").select("tile", "fp", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("home"))
            .select("tile", F.explode(F.sequence(F.lit(0), "home")).alias("part"), "fp", "home")
            .select("tile", "part", "fp", (F.col("part") == F.col("home")).alias("own")))

    def compare(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        mine = table.column("own").to_numpy(zero_copy_only=False)
        order = np.argsort(~mine, kind="stable")
        fp, n = fp[order], int(mine.sum())
        forest = Forest(len(fp))
        rows = max(1, (1 << 20) // max(1, len(fp)))
        for at in range(0, n, rows):
            hit = np.bitwise_count(fp[at : min(at + rows, n), None] ^ fp[None, at:]) <= radius
            i, j = np.nonzero(hit)
            if len(i) > len(hit):  # more than each with itself
                for cut in np.split(j, np.flatnonzero(np.diff(i)) + 1):
                    if len(cut) > 1:
                        forest.join(cut + at)
        a, b = forest.edges()
        return pa.table({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    return spread(sent, "tile", "part").groupBy("tile", "part").applyInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, doc: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """One row for each document: ``doc``, ``fingerprint`` (16 lowercase hex digits, from shingles of ``size`` words) and
    ``component_id``, the least id that links of ``radius`` bits reach.

    Documents without a word have fingerprint zero and link like any other. Ids that are null are never the least unless a
    group has no other; then the component is null. Repeated rows stay. Other columns are left out.
    """
    stage = Stage(docs.sparkSession, "simhash")
    keyed = stage.put(fingerprints(docs.select(F.col(f"`{doc}`").alias(doc), F.col(f"`{text}`").alias("text")), size=size)
                      .select(doc, "fp"))
    distinct = stage.put(keyed.groupBy("fp").agg(F.min(doc).alias("least")))
    roots = components(stage, stage.put(links(distinct.select("fp"), radius)))
    whole = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = whole.join(whole.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return keyed.join(named, "fp").select(doc, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
