"""Rolling-window admission: batch over stored hits, and the same rule as a stateful stream.

Only admitted hits count against the limit, so the decision is a recursion along each key and a
count over a window is not the same thing.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# --- fixed values -----------------------------------------------------------------------
DEVICE_LIMIT = 60
ADDRESS_LIMIT = 500
WINDOW_MS = 60_000
FUTURE_MS = 1_000
# ----------------------------------------------------------------------------------------

PIECE = 10_000  # decisions handed on at once
SALTS = 256

DECISION = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("hit_id", T.LongType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("allowed", T.BooleanType()),
    T.StructField("used", T.IntegerType()),
    T.StructField("remaining", T.IntegerType()),
    T.StructField("retry_after_ms", T.LongType()),
])


def spans(hits: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Periods in which a key had live hits: (key, bucket, span), one row per key and bucket.

    Hits of one window-sized bucket are never idle for a whole window, so a period can only start
    with the first hit of a bucket. Hits are therefore reduced to buckets (combined map-side)
    before anything is ordered along a key.
    """
    b = hits.groupBy("key", F.expr(f"ts_ms div {window_ms}").alias("bucket")).agg(
        F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"), F.count("*").alias("n"))
    w = W.partitionBy("key").orderBy("bucket")
    fresh = (F.col("lo") - F.lag("hi").over(w)) >= window_ms
    b = b.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    return b.withColumn("span", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("fresh")


def admissions(hits: DataFrame, limit: int = DEVICE_LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """What is decided about each millisecond of a key: (key, ts_ms, used, admitted, oldest).

    ``used`` hits were live before the first of it, ``admitted`` of its hits are let in, and refused ones wait for ``oldest``. That
    needs counts only, so hits are combined to (key, millisecond) before the shuffle, and the fold along a key and idle period
    costs a row a millisecond however many hits there are. It remembers the admitted hits of one window: ``limit`` at most.
    """
    n = hits.groupBy("key", "ts_ms").agg(F.count("*").alias("n")).withColumn("bucket", F.expr(f"ts_ms div {window_ms}"))
    n = n.join(spans(hits, window_ms).select("key", "bucket", "span"), ["key", "bucket"]).select(F.col("key").cast("string").alias("key"), "span", "ts_ms", "n")
    ordered = n.repartition("key", "span").sortWithinPartitions("key", "span", "ts_ms")

    def fold(batches):
        current, live, used = None, deque(), 0  # live: (time, admitted then)
        for pdf in batches:
            out = []
            for key, span, ts, n in zip(pdf["key"], pdf["span"], pdf["ts_ms"], pdf["n"]):
                if (key, span) != current:
                    current, live, used = (key, span), deque(), 0
                while live and live[0][0] <= ts - window_ms:
                    used -= live.popleft()[1]
                admitted = min(n, limit - used)
                if admitted:
                    live.append((ts, admitted))
                out.append((used, admitted, live[0][0] if live else ts))
                used += admitted
            told = pd.DataFrame(out, columns=["used", "admitted", "oldest"])
            yield pd.concat([pdf[["key", "ts_ms"]].reset_index(drop=True), told], axis=1)

    return ordered.mapInPandas(fold, "key string, ts_ms bigint, used bigint, admitted bigint, oldest bigint")


def admit(hits: DataFrame, limit: int = DEVICE_LIMIT, window_ms: int = WINDOW_MS) -> DataFrame:
    """Decide every hit.

    ``admissions`` decides about milliseconds; each hit then meets its own millisecond by key and time, so the hits of one key
    are spread over all tasks. In a millisecond that admits some the least ids come first.
    """
    told = admissions(hits, limit, window_ms).withColumnsRenamed({"ts_ms": "ms", "key": "k"})
    h = hits.select(F.col("key").cast("string").alias("key"), "hit_id", "ts_ms")
    h = h.join(told, (F.col("key") == F.col("k")) & (F.col("ts_ms") == F.col("ms")))
    # hits that are refused whatever their id are ranked in many small groups, so a crowded millisecond is no hot group
    salt = F.when(F.col("admitted") > 0, -1).otherwise(F.pmod(F.xxhash64("hit_id"), F.lit(SALTS)))
    rank = F.row_number().over(W.partitionBy("key", "ts_ms", salt).orderBy("hit_id")) - 1
    h = h.withColumn("rank", rank)
    return h.withColumn("allowed", F.expr("rank < admitted")).selectExpr(
        "key", "hit_id", "ts_ms", "allowed", f"cast(IF(allowed, used + rank, {limit}) AS int) AS used",
        f"cast(IF(allowed, {limit} - used - rank, 0) AS int) AS remaining", f"IF(allowed, 0L, greatest(0L, oldest + {window_ms} - ts_ms)) AS retry_after_ms")


def retry_seconds(decisions: DataFrame) -> DataFrame:
    """Whole seconds to wait, at least one."""
    return decisions.where("NOT allowed").selectExpr(
        "key", "hit_id", "greatest(1, cast(ceil(retry_after_ms / 1000D) AS int)) AS retry_after")


def expiry(hits: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """When each key's memory can be dropped: a window after the last hit of each period."""
    return spans(hits, window_ms).groupBy("key", "span").agg(
        F.min("lo").alias("first_ms"), F.max("hi").alias("last_ms"), F.sum("n").alias("hits")).selectExpr(
        "key", "first_ms", "last_ms", f"last_ms + {window_ms} AS expires_ms", "hits")


def client_address(requests: DataFrame) -> DataFrame:
    """Key of a page request: first forwarded hop, else the direct address, else ``unknown``.

    Only documents are counted: not assets, sources, vendor files or anything with an extension.
    """
    page = requests.where(
        "path = '/' OR path = '/index.html' OR (NOT path RLIKE '^/(_next|_vercel|assets|src|vendor)'"
        " AND NOT path RLIKE '[.]')")
    return page.selectExpr(
        "coalesce(nullif(trim(split(forwarded, ',')[0]), ''), nullif(real_ip, ''), 'unknown') AS key",
        "ts_ms", "hit_id")


class RollingLimit(StatefulProcessor):
    """The admission rule as streaming state: the admitted hits of one window, and a timer to drop them."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", T.StructType([T.StructField("ts", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        kept = [r[0] for r in self.live.get()] if self.live.exists() else []
        # a key's rows come in pieces in no order; two numbers a hit are held until the micro-batch's are together
        pieces = [pdf[["ts_ms", "hit_id"]].to_numpy(dtype="int64") for pdf in rows]
        hits = np.concatenate(pieces)
        hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
        for at in range(0, len(hits), PIECE):
            out, kept = self.decide(str(key[0]), hits[at : at + PIECE].tolist(), kept)
            yield pd.DataFrame(out, columns=DECISION.names)
        self.live.put([(t,) for t in kept])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if kept:  # once the watermark is past the last hit's window, no hit that is still taken can meet it
            self.handle.registerTimer(max(max(kept) + self.window_ms + FUTURE_MS, timerValues.getCurrentWatermarkInMs() + 1))

    def decide(self, key: str, hits, kept: list) -> tuple[list, list]:
        """Decisions for hits in time order, and the admitted ones that still count."""
        out = []
        for ts, hit in hits:
            ts = int(ts)
            now = [t for t in kept if ts - self.window_ms < t <= ts + FUTURE_MS]
            used = len(now)
            if used < self.limit:
                out.append((key, int(hit), ts, True, used, self.limit - used, 0))
                kept.append(ts)
            else:
                wait = max(0, min(now) + self.window_ms - ts)
                out.append((key, int(hit), ts, False, used, 0, wait))
            # what has left the window of the newest hit can never count again
            newest = max(ts, max(kept, default=ts))
            kept = [t for t in kept if t > newest - self.window_ms - FUTURE_MS]
        return out, kept

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.live.clear()
        return iter([])

    def close(self) -> None:
        pass


def admit_stream(hits: DataFrame, limit: int = DEVICE_LIMIT, window_ms: int = WINDOW_MS, late_ms: int = WINDOW_MS) -> DataFrame:
    """E1, E2 on a stream of (key, ts_ms, hit_id); needs the RocksDB state store.

    A key's memory ends in event time: it lasts until the watermark, ``late_ms`` behind the newest hit of the stream, has
    passed a window after the key's last admitted hit. A micro-batch's hits of a key are decided in time order, 16 bytes
    each in memory; the trigger bounds them. Triggers may therefore be as far apart as they like, and
    a replay decides as the first run did. Hits behind the watermark are dropped undecided.
    """
    timed = hits.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", f"{late_ms} milliseconds")
    return timed.groupBy("key").transformWithStateInPandas(
        RollingLimit(limit, window_ms), outputStructType=DECISION, outputMode="Append", timeMode="EventTime")
