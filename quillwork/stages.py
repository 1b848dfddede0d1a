"""Stages of a long job as Parquet tables in the shared folder: written once, read by column, resumed, cleaned up.

A stage that was written whole has Spark's success marker. A job that is run again under the same name reads what is there and
goes on with the rest; a name stands for one input and one set of parameters, which is up to the caller. ``keep`` names the
tables that outlive the job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quillwork.session import shared_dir


@contextmanager
def sized_joins(spark: SparkSession) -> Iterator[None]:
    """Joins choose a broadcast by the size seen at run time only, not by that of a table's files.

    A stage of runs or boxes is many times smaller as Parquet than as rows, and a broadcast is gathered as rows by the driver.
    """
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    static, seen = before
    spark.conf.set(static, "-1")
    spark.conf.set(seen, before[seen] or before[static] or "10MB")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Stages:
    def __init__(self, spark: SparkSession, job: str, name: str | None = None):
        """Stages of ``job``; with ``name`` they can be resumed, without it they are this call's own."""
        self.spark, self.at = spark, f"{shared_dir(spark).rstrip('/')}/{job}/{name or uuid.uuid4().hex}"
        self.names: list[str] = []
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)
        self.files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")

    def done(self, name: str) -> bool:
        return self.files.exists(self._path(f"{name}/_SUCCESS"))

    def put(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage; ``make`` is asked for it only if it is not there yet."""
        if name in self.names:
            raise ValueError(f"stage {name} is made twice")
        self.names.append(name)
        path = f"{self.at}/{name}"
        if not self.done(name):
            with sized_joins(self.spark):
                make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def finish(self, keep: Iterable[str] = ()) -> None:
        """Deletes every table but those to keep, which nothing else reads any more."""
        kept = set(keep)
        for name in self.names:
            if name not in kept:
                self.files.delete(self._path(name), True)
