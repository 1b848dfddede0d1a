"""Exact near duplicates among embeddings by a metric range join.

Two vectors link if their labels are equal and their cosine reaches a threshold. On unit vectors that is a distance of at
most r, and distance is a metric. Equal vectors of a label are folded first. A label with more vectors than a cell should
hold is partitioned by pivots: a vector's home is the cell of its nearest pivot, and it is also sent to every cell where the
triangle inequality leaves room for a partner, that is where its distance to the pivot exceeds neither its distance to its
own by more than 2r nor the cell's radius by more than r. Cells are then joined independently. A vector counts its links in its
home cell, where all its partners are, so nothing is counted twice.

The pivots are a bounded sample, ``PIVOTS`` or so in all. A cell may therefore grow with the data; one of more than ``BLOCK``
vectors is cut into blocks and compared pair of blocks by pair of blocks, so a task never holds more than two blocks. A task
gives back counts and a forest over its links, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, ArrayType, StructField

from quillwork.llm.common import Forest, Stage, append_columns, components

CELL, PIVOTS, BLOCK = 2000, 2048, 2048


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (units(x) @ pivots.T), 0))


class Cells:
    """Pivots (and radii, once known) by label and length of vector."""

    def __init__(self, pivots: dict, radius: float, radii: dict | None = None):
        self.pivots, self.radius, self.radii = pivots, radius, radii or {}

    def each(self, batch: pa.RecordBatch):
        """(rows, key, their distances to the key's pivots) for the parts of a batch that share label and length."""
        keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
        rows: dict = {}
        for i, key in enumerate(keys):
            rows.setdefault(key, []).append(i)
        for key, at in rows.items():
            if key in self.pivots:
                x = matrix(batch.column("vector").take(pa.array(at)), len(at))
                yield np.array(at), key, distances(x, self.pivots[key])

    def homes(self):
        def fn(batch: pa.RecordBatch) -> list:
            home, gap = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, _, d in self.each(batch):
                home[at] = d.argmin(axis=1)
                gap[at] = d.min(axis=1)
            return [pa.array(home), pa.array(gap)]

        return fn

    def sent(self):
        """The cells a vector goes to, its home first."""

        def fn(batch: pa.RecordBatch) -> list:
            cells = [[h] for h in batch.column("home").to_pylist()]
            slack = self.radius + 1e-7
            for at, key, d in self.each(batch):
                home = batch.column("home").take(pa.array(at)).to_numpy()
                own = d[np.arange(len(at)), home]
                near = (d <= own[:, None] + 2 * slack) & (d <= self.radii[key] + slack)
                near[np.arange(len(at)), home] = False
                for i, j in zip(*np.nonzero(near), strict=True):
                    cells[at[i]].append(int(j))
            return [pa.array(cells, pa.list_(pa.int32()))]

        return fn


def compare(threshold: float):
    def fn(table: pa.Table) -> pa.Table:
        n = table.num_rows
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        mine = np.equal(table.column("mine").to_numpy(), table.column("i").to_numpy())
        other = np.equal(table.column("place").to_numpy(), table.column("j").to_numpy())
        x = matrix(table.column("vector"), n)
        x /= np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        a, b = np.flatnonzero(mine), np.flatnonzero(other)
        links, forest = np.zeros(n, np.int64), Forest(n)
        for at in range(0, len(a), 256):
            rows = a[at : at + 256]
            hit = (x[rows] @ x[b].T) / (norm[rows][:, None] * norm[b][None, :]) >= threshold
            hit &= node[rows][:, None] != node[b][None, :]
            links[rows] = hit @ copies[b]
            for r in np.flatnonzero(hit.any(axis=1)):
                forest.join(np.append(b[hit[r]], rows[r]))
        down, up = forest.edges()
        return pa.table({"node": np.concatenate([node[a], node[down]]), "links": np.concatenate([links[a], np.zeros(len(down), np.int64)]),
                         "up": np.concatenate([node[a], node[up]])})

    return fn


def grouped(vectors: DataFrame, threshold: float = 0.98, ident: str = "vec_id", vector: str = "embedding", label: str = "label",
            cell: int = CELL, most_pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """One row for each row: ``ident``, ``n_links long`` (other rows linked directly), ``component_id`` (the least id that
    links reach, the row's own included) and ``kept boolean`` (the id is the component's).

    Rows without a label, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing.
    Vectors of different length don't link. Repeated rows link with each other like any equal vectors. A null id is never
    the least of a group that has another, and such a row is not kept. Other columns are left out, whatever their names.
    """
    stage = Stage(vectors.sparkSession, "embedding")
    rows = vectors.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    good = F.col("label").isNotNull() & usable("vector")
    folded = stage.put(rows.where(good).groupBy("label", "vector").agg(F.min("ident").alias("least"), F.count("*").alias("copies"))
                       .select(F.monotonically_increasing_id().alias("node"), "label", F.size("vector").alias("dim"), "vector", "least",
                               "copies"))
    total = folded.count()
    size = max(cell, -(-total // most_pivots))
    # labels above the size: fewer than most_pivots, as there are total rows
    large = folded.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > size)
    share = F.ceil(F.col("n") / size) / F.col("n")
    draw = (F.xxhash64("vector").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53))
    chosen = (folded.join(F.broadcast(large), ["label", "dim"]).where(draw < share).select("label", "dim", "vector", draw.alias("d"))
              .orderBy("d", "label").limit(4 * most_pivots).collect())
    pivots: dict = {}
    for r in chosen:
        pivots.setdefault((r["label"], r["dim"]), []).append(r["vector"])
    radius = math.sqrt(max(2 - 2 * threshold, 0))
    cells = Cells({k: units(np.array(v, dtype=np.float64)) for k, v in pivots.items() if len(v) > 1}, radius)
    homed = stage.put(append_columns(folded, [StructField("home", IntegerType()), StructField("gap", DoubleType())], cells.homes, 2048))
    known = {k: np.full(len(v), -np.inf) for k, v in cells.pivots.items()}
    if known:
        for r in homed.where("gap > 0 or home > 0").groupBy("label", "dim", "home").agg(F.max("gap").alias("gap")).collect():
            if (r["label"], r["dim"]) in known:
                known[r["label"], r["dim"]][r["home"]] = r["gap"]
    for k in known:
        known[k] = np.maximum(known[k], 0)
    told = append_columns(homed, [StructField("cells", ArrayType(IntegerType()))], Cells(cells.pivots, radius, known).sent, 2048)
    told = stage.put(told.select("node", "label", "dim", "vector", "copies", "home", F.explode("cells").alias("cell")))
    counts = told.groupBy("label", "dim", "cell").agg(F.ceil(F.sum((F.col("home") == F.col("cell")).cast("int")) / block).cast("int").alias("mines"),
                                                      F.ceil(F.count("*") / block).cast("int").alias("places"))
    put = told.join(counts, ["label", "dim", "cell"]).where("mines > 0")
    put = put.withColumn("mine", F.when(F.col("home") == F.col("cell"), F.pmod(F.xxhash64("node"), "mines").cast("int")).otherwise(-1))
    put = put.withColumn("place", F.pmod(F.xxhash64("node", F.lit(1)), "places").cast("int"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    as_other = F.transform(F.sequence(F.lit(0), F.col("mines") - 1), lambda i: pair(i, F.col("place")))
    as_own = F.when(F.col("mine") >= 0, F.transform(F.sequence(F.lit(0), F.col("places") - 1), lambda j: pair(F.col("mine"), j))).otherwise(
        F.array().cast("array<struct<i:int,j:int>>"))
    put = put.select("label", "dim", "cell", "node", "copies", "vector", "mine", "place",
                     F.explode(F.array_distinct(F.concat(as_other, as_own))).alias("p")).select("*", "p.i", "p.j").drop("p")
    found = stage.put(put.groupBy("label", "dim", "cell", "i", "j").applyInArrow(compare(threshold), "node long, links long, up long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(stage, found.where("node <> up").select("node", "up").distinct())
    whole = folded.join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = whole.join(whole.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    told = named.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = rows.where(good).join(told, ["label", "vector"]).select("ident", "n_links", "component_id")
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("ident", F.lit(0).cast("long").alias("n_links"), F.col("ident").alias("component_id"))
    return joined.unionByName(alone).select(F.col("ident").alias(ident), "n_links", "component_id",
                                            F.coalesce(F.col("ident") == F.col("component_id"), F.lit(False)).alias("kept"))
