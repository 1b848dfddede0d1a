"""What the operators of this subpackage share: staged tables, appended columns, links to components.

A staged table is Parquet in the folder the cluster names in ``spark.checkpoint.dir``. It cuts lineage like
``checkpoint()`` does, survives lost executors, and is read with column pruning and without the row overhead of
checkpointed RDDs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

TEXT_SLICE = 256  # rows of text a task turns at a time; bounds what Python holds besides the Arrow batch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Stage:
    """Tables written by one operator call. ``drop`` removes one that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.at}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add; names clash as Spark compares them."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def apart(df: DataFrame, **own: str) -> tuple[DataFrame, list[str]]:
    """``df`` and its columns' names there: each of ``own`` has the name given, all others have names that no operator uses. So no
    column is lost to an operator's own, and none is sent to Python twice."""
    wanted = {was.lower(): name for name, was in own.items()}
    names = [wanted.get(c.lower(), f"in_{k}") for k, c in enumerate(df.columns)]
    return df.toDF(*names), names


def append_columns(
    df: DataFrame, fields: list[StructField], make: Callable[[], Callable[[pa.RecordBatch], list]], rows: int = TEXT_SLICE, drop: Iterable[str] = ()
) -> DataFrame:
    """Every row of ``df`` with more columns. ``make`` runs once a task and gives the function from a slice of rows to the
    new arrays. Input columns with the name of a new one are replaced by it; those of ``drop`` are read by the function only."""
    names = [f.name for f in fields]
    kept = without(df, [*names, *drop])
    at = [df.columns.index(c) for c in kept.columns]
    schema = StructType([*kept.schema.fields, *fields])
    columns = [*kept.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in at), *fn(part)], names=columns)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch one by one, null as empty."""
    for value in batch.column(column):
        yield value.as_py() or ""


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The same as UTF-8, without decoding."""
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


class Forest:
    """Union-find over a bounded block. A node's root is the least position it is joined with."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        up = self.parent[nodes]
        while True:
            higher = self.parent[up]
            if np.array_equal(higher, up):
                return up
            up = higher

    def join(self, nodes: np.ndarray) -> None:
        """All of ``nodes`` belong together."""
        up = self.roots(nodes)
        least = up.min()
        self.parent[up] = least
        self.parent[nodes] = least

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) for every node that is not its own root."""
        everyone = np.arange(len(self.parent))
        up = self.roots(everyone)
        moved = up != everyone
        return everyone[moved], up[moved]


def components(stage: Stage, edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the least node reachable.

    Alternates two steps until nothing changes. Large star: each node hands its larger neighbours to the least of its
    neighbourhood. Small star: each node hands its smaller neighbours to the least of them. Both are one minimum per node
    (combined before the shuffle) and one join back, so no neighbourhood is ever gathered. Rounds grow with the logarithm of
    the longest chain. Each round is a staged table, and the one before it is dropped.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        pairs = e.union(e.select("b", "a")) if large else e
        pairs = pairs.toDF("u", "v")
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("w", "m").alias("m"))
        met = pairs.join(least, F.col("u") == F.col("w"))
        if large:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                               F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return out.where("a <> b").distinct()

    down = edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stage.put(down), None
    while True:
        nxt = stage.put(star(star(now, True), False))
        sums = [tuple(t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) for t in (now, nxt)]
        if before is not None:
            stage.drop(before)
        now, before = nxt, now
        if sums[0] == sums[1]:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
