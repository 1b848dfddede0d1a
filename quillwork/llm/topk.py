"""Exact top-k search by integer inner product with an impact-ordered index, a score at a time.

The index deals the vectors out to blocks. A block has a posting list for every component: its vectors' places by falling
impact, where an impact is the component as a whole number. A run of equal impacts is a segment. A query takes
a block's segments of all lists by falling contribution (its weight times the impact, from the list's other end
for a negative weight), level by level, and adds them to the accumulators. After each level the best accumulators are
rescored exactly, which gives a score that the k-th best cannot fall below. What is left in a list adds no more than its next
contribution. Processing stops only when that bound rules out enough vectors (``FEW``), and the rest are rescored exactly. So
the result is exact whatever the data.

Queries meet blocks chunk by chunk; a task holds one block and one chunk. Each gives its own best k, and a ranking that is pruned
before its shuffle merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.llm.common import Stage

BLOCK, CHUNK = 32_768, 1024  # vectors of a block, queries of a chunk
LEVEL = 16  # from one level to the next, contributions fall by so much; the first lies twice as far below the top
FEW = 0.6  # processing stops when at most this part of a block's vectors may be members; rescoring them costs less than going on


def build(table: pa.Table) -> pa.Table:
    """The posting lists of one block, and in list -1 the rows and ids behind the places."""
    n = table.num_rows
    size, block = table.column("size")[0].as_py(), table.column("block")[0].as_py()
    v = table.column("v").combine_chunks().flatten().to_numpy().reshape(n, size)
    order = np.argsort(-v, axis=0, kind="stable")
    lists = [table.column("row").to_numpy(), *[order[:, d] for d in range(size)]]
    impacts = [table.column("vec").to_numpy(), *[v[order[:, d], d] for d in range(size)]]
    return pa.table({"size": np.full(size + 1, size), "block": np.full(size + 1, block), "list": np.arange(-1, size),
                     "places": pa.array([x.astype(np.int64) for x in lists]), "impacts": pa.array([x.astype(np.int64) for x in impacts])})


class Block:
    """One block of the index in a task."""

    def __init__(self, table: pa.Table):
        lists = table.column("list").to_numpy()
        places = [x.values.to_numpy() for x in table.column("places")]
        impacts = [x.values.to_numpy() for x in table.column("impacts")]
        head = int(np.flatnonzero(lists == -1)[0])
        self.rows, self.ids, self.n = places[head], impacts[head], len(places[head])
        order = np.argsort(lists)[1:]
        self.places = np.stack([places[i] for i in order])
        self.impacts = np.stack([impacts[i] for i in order]).astype(np.float64)
        self.most = np.abs(self.impacts).max() + 1
        self.dense = np.empty((self.n, len(order)))
        np.put_along_axis(self.dense.T, self.places, self.impacts, axis=1)
        # all lists as one rising sequence, so that one search finds a level's end in each of them
        self.start = np.arange(len(order)) * (2 * self.most + 2)
        self.keys = (self.start[:, None] - self.impacts).ravel()
        self.single = self.impacts.astype(np.float32), self.dense.astype(np.float32)

    def reach(self, w: np.ndarray, level: float) -> np.ndarray:
        """How many postings of each list, from the end that suits the weight, contribute ``level`` or more."""
        least = np.clip(level / w, -self.most, self.most)
        at = self.start - least  # keys are whole, so half a step past or before stands for "up to" and "below"
        place = np.searchsorted(self.keys, np.where(w > 0, np.floor(at) + 0.5, np.ceil(at) - 0.5)) - np.arange(len(w)) * self.n
        return np.where(w > 0, place, self.n - place)

    def best(self, weights: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best for the query, without its own row; more on ties for the k-th."""
        n = self.n
        skip = np.flatnonzero(self.rows == own)
        want = min(k, n - len(skip))
        if want <= 0:
            return np.zeros(0, np.int64), np.zeros(0)
        weights = weights.astype(np.float64)
        lists = np.flatnonzero(weights)
        w = np.where(weights == 0, 1e-300, weights)
        # whole numbers below 2**24 are exact in single precision, which halves what is moved
        small = np.abs(weights).sum() * self.most < 1 << 24
        impacts, dense = self.single if small else (self.impacts, self.dense)
        weights = weights.astype(impacts.dtype)
        seen = np.zeros(n, dtype=impacts.dtype)
        seen[skip] = -np.inf
        done = np.zeros(len(w), dtype=np.int64)
        level = max(np.maximum(w * self.impacts[:, 0], w * self.impacts[:, -1]).max(), 0.0) / LEVEL**0.5
        while True:
            level /= LEVEL
            upto = self.reach(w, level)
            upto = np.maximum(done, upto)
            for d in lists:
                cut = slice(done[d], upto[d]) if w[d] > 0 else slice(n - upto[d], n - done[d])
                np.add.at(seen, self.places[d, cut], impacts[d, cut] * weights[d])
            done = upto
            ahead = np.minimum(done, n - 1)
            nxt = w * self.impacts[np.arange(len(w)), np.where(w > 0, ahead, n - 1 - ahead)]
            rest = np.maximum(np.where(done < n, nxt, 0), 0)[lists].sum()
            lead = np.argpartition(seen, n - want)[n - want :] if want < n else np.flatnonzero(seen > -np.inf)
            floor = (dense[lead] @ weights).min()
            may = np.flatnonzero(seen + rest >= floor)
            if len(may) <= max(4 * want, n * FEW) or level < 1:  # below 1, every contribution above 0 has been taken
                break
        may = may[seen[may] > -np.inf]
        scores = dense[may] @ weights
        if len(may) > want:
            least = np.partition(scores, len(may) - want)[len(may) - want]
            may, scores = may[scores >= least], scores[scores >= least]
        return may, scores


def search(vectors: DataFrame, is_query: Column, k: int = 20, ident: str = "vec_id", v: str = "v", block: int = BLOCK,
           chunk: int = CHUNK) -> DataFrame:
    """``query_id``, ``rank int`` (from 1), ``ident``, ``score long`` of each query's ``k`` best other rows, ties to the
    smaller id.

    ``v`` is an array of whole numbers; sums of products must stay under 2**53. Rows with a null vector or a null component
    take no part, and vectors of different lengths never meet. A query has fewer rows if there are fewer candidates, and
    none if there are none. Repeated rows are candidates of each other. Null ids lose ties, and a query may have one.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "topk")
    rows = vectors.select(F.col(f"`{ident}`").cast("long").alias("vec"), F.col(f"`{v}`").cast("array<long>").alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    rows = stage.put(rows.select(F.monotonically_increasing_id().alias("row"), "vec", "v", F.size("v").cast("long").alias("size"), "asks"))
    n, q = rows.agg(F.count("*"), F.sum(F.col("asks").cast("long"))).first()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-(q or 0) // chunk))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    index = stage.put(dealt.select("size", "block", "row", F.coalesce("vec", F.lit((1 << 63) - 1)).alias("vec"), "v").groupBy("size", "block")
                      .applyInArrow(build, "size long, block long, list long, places array<long>, impacts array<long>"))
    asked = rows.where("asks").withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)))
    left = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    right = asked.select("size", "chunk", "row", "vec", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def meet(lists: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict = {"row": [], "query_id": [], "vec": [], "score": []}
        if lists.num_rows and queries.num_rows:
            at = Block(lists)
            rows, ids = queries.column("row").to_pylist(), queries.column("vec").to_pylist()
            for row, vec, w in zip(rows, ids, queries.column("v"), strict=True):
                place, score = at.best(w.values.to_numpy(), row, k)
                first = np.lexsort((at.ids[place], -score))[:k]
                out["row"] += [row] * len(first)
                out["query_id"] += [vec] * len(first)
                out["vec"] += at.ids[place[first]].tolist()
                out["score"] += score[first].astype(np.int64).tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    by = ("size", "block", "chunk")
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "row long, query_id long, vec long, score long")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif(F.col("vec"), F.lit((1 << 63) - 1)).alias(ident), "score")
