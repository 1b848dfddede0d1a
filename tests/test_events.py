"""Admission and estimates: brute force, and streams against their batch twins."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillwork.streaming import eta as E
from quillwork.streaming import limits as L


def brute(hits, limit, window):
    out, live = {}, {}
    for key, ts, hit in sorted(hits, key=lambda h: (h[1], h[2])):
        now = [t for t in live.get(key, []) if t > ts - window]
        ok = len(now) < limit
        out[hit] = (ok, len(now), 0 if ok else max(0, min(now) + window - ts))
        live[key] = now + [ts] if ok else now
    return out


def sample(n=400, keys=5, span=4000, seed=3):
    rnd = random.Random(seed)
    # one key holds a third of all hits
    return [(0 if rnd.random() < 0.33 else rnd.randrange(keys), rnd.randrange(span), i) for i in range(n)]


HIT = "key bigint, ts_ms bigint, hit_id bigint"


def test_admission_is_exact(spark):
    hits = sample()
    for limit, window in ((3, 100), (5, 1), (60, 500)):
        got = {r.hit_id: (r.allowed, r.used, r.retry_after_ms) for r in
               L.admit(spark.createDataFrame(hits, HIT), limit, window).collect()}
        assert got == brute(hits, limit, window)


def test_only_admitted_hits_count(spark):
    hits = [(1, t, t) for t in range(0, 100, 10)]
    allowed = [r.ts_ms for r in L.admit(spark.createDataFrame(hits, HIT), 2, 50).where("allowed").orderBy("ts_ms").collect()]
    assert allowed == [0, 10, 50, 60]


def test_blocked_past_the_address_limit(spark):
    hits = [(1, 1000 + i, i) for i in range(501)]
    d = L.admit(spark.createDataFrame(hits, HIT), L.ADDRESS_LIMIT, L.WINDOW_MS).where("NOT allowed")
    assert [r.hit_id for r in d.collect()] == [500]
    assert L.retry_seconds(d).first().retry_after == 60


def test_a_hot_key_is_decided_on_many_tasks(spark):
    rnd = random.Random(7)
    hits = [(7, rnd.randrange(300), i) for i in range(3000)] + [(7, 50, 9000 + i) for i in range(400)] + [(7, 50, 9000)]
    hits += [(8, 10, 1), (8, 10, 2)]
    df = spark.createDataFrame(hits, HIT)
    for limit, window in ((3, 20), (50, 7), (1, 1)):
        got = sorted((r.key, r.ts_ms, r.hit_id, r.allowed, r.used, r.retry_after_ms) for r in L.admit(df, limit, window).collect())
        want = []
        for key in (7, 8):
            live = []
            for _, ts, hit in sorted(h for h in hits if h[0] == key):
                now = [t for t in live if t > ts - window]
                ok = len(now) < limit
                want.append((str(key), ts, hit, ok, len(now), 0 if ok else max(0, min(now) + window - ts)))
                live = now + [ts] if ok else now
        assert got == sorted(want)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = L.admit(df, 3, 20).where("key = '7'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(placed) >= 3 and max(r["count"] for r in placed) < 0.7 * len(hits)


def test_streams_decide_in_time_order_whatever_the_pieces(spark):
    class Held:
        def __init__(self):
            self.value, self.timers = None, []

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def put(self, value):
            self.value = value

        update = put
        listTimers = lambda self: iter(())

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        getCurrentWatermarkInMs = lambda self: 0

    rnd = random.Random(4)
    hits = [(rnd.randrange(2000), i) for i in range(300)]
    want = {i: d for i, d in brute([(1, t, i) for t, i in hits], 5, 90).items()}
    for size in (1, 7, 300):
        limit = L.RollingLimit(5, 90)
        limit.handle = limit.live = Held()
        parts = [pd.DataFrame(hits[k : k + size], columns=["ts_ms", "hit_id"]) for k in range(0, 300, size)]
        out = pd.concat(list(limit.handleInputRows((1,), iter(parts), Clock())))
        assert {r.hit_id: (r.allowed, r.used, r.retry_after_ms) for r in out.itertuples()} == want
    readings = [(1000 + 40 * i + rnd.randrange(30), i, min(1.0, i / 250 + rnd.random() / 50)) for i in range(250)]
    rnd.shuffle(readings)
    told = []
    for size in (1, 9, 250):
        run = E.ProgressEta(1000)
        run.state = Held()
        parts = [pd.DataFrame(readings[k : k + size], columns=["ts_ms", "seq", "p"]) for k in range(0, 250, size)]
        told.append(pd.concat(list(run.handleInputRows(("r",), iter(parts), Clock()))).reset_index(drop=True))
    assert told[0].equals(told[1]) and told[1].equals(told[2]) and told[0]["confident"].any()


def _stream(spark, tmp_path, rows, schema, build, order):
    """Feed rows in three files, in time order, through a stateful stream."""
    src = str(tmp_path / "in")
    rows = sorted(rows, key=order)
    step = len(rows) // 3 + 1
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i:i + step], schema).coalesce(1).write.mode("append").parquet(src)
    name = "q" + uuid.uuid4().hex[:8]
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(s).writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_of_hits_equals_batch(spark, tmp_path):
    hits = sample(150)
    got = _stream(spark, tmp_path, hits, HIT, lambda s: L.admit_stream(s, 3, 100), lambda h: (h[1], h[2]))
    want = brute(hits, 3, 100)
    assert {r.hit_id: (r.allowed, r.used, r.retry_after_ms) for r in got.collect()} == want


def test_stream_of_progress_equals_batch(spark, tmp_path):
    rnd = random.Random(5)
    rows, seq = [], 0
    for run in range(4):
        t, p = 0, 0.0
        for _ in range(20):
            t += rnd.randrange(0, 900)
            p = min(1.0, max(0.0, p + rnd.uniform(-0.02, 0.09)))
            rows.append((run, seq, t, p))
            seq += 1
    schema = "run_id bigint, seq bigint, ts_ms bigint, p double"
    got = _stream(spark, tmp_path, rows, schema, E.progress_eta_stream, lambda r: (r[2], r[1]))
    batch = E.progress_eta(spark.createDataFrame(rows, schema))

    def key(df):
        return {r.seq: (None if r.remaining_ms is None or r.remaining_ms != r.remaining_ms else round(r.remaining_ms, 6), r.elapsed_ms, r.confident)
                for r in df.collect()}

    assert key(got) == key(batch) and any(v[2] for v in key(batch).values())


def told_one_by_one(readings):
    """E4 reading by reading: {seq: (remaining, elapsed, confident)} of one run's (ts, seq, p) in order."""
    out, start, last, rate, shown, known = {}, None, None, None, None, False
    for t, seq, p in sorted(readings):
        p = min(max(p, 0.0), 1.0)
        if start is None:
            start, last = t, (t, p)
            out[seq] = (None, 0, False)
            continue
        if t > last[0] and p > last[1]:
            v = (p - last[1]) / (t - last[0])
            rate, last = v if rate is None else rate + 0.25 * (v - rate), (t, p)
        if rate is None or p < 0.06 or t - start < 600 or p >= 1:
            out[seq] = (None, t - start, False)
            continue
        left = (1 - p) / rate
        if shown is not None:
            aged = max(0.0, shown[0] - (t - shown[1]))
            left = left if left < aged else aged + (left - aged) * 0.18
        shown = (max(0.0, left), t)
        known = known or shown[0] >= 1500
        out[seq] = (shown[0], t - start, known)
    return out


@pytest.mark.parametrize("size", [1, 3, 40, 10_000])
def test_a_run_over_many_blocks(spark, size):
    """Blocks of one reading up to all of them; steady, falling and jumping progress, many readings a millisecond, short runs."""
    rnd = random.Random(11)
    rows = []
    for run, (n, gap, back) in enumerate([(150, 90, 0.0), (150, 2, 0.5), (120, 400, 0.02), (90, 1, 1.0), (1, 5, 0), (2, 900, 0), (7, 700, 0.1)]):
        t, p = 1_700_000_000_000, 0.0
        for _ in range(n):
            t += rnd.randrange(gap + 1) if gap > 2 else rnd.choice([0, 0, 0, 300])
            p = rnd.random() if back == 1.0 else min(1.1, max(-0.1, p + rnd.uniform(-back / 4, 0.02)))
            rows.append((run, len(rows), t, p))
    df = spark.createDataFrame(rows, "run_id bigint, seq bigint, ts_ms bigint, p double")
    got = {r.seq: r for r in E.progress_eta(df, size).collect()}
    want = {}
    for run in range(7):
        want |= told_one_by_one([(t, s, p) for r, s, t, p in rows if r == run])
    assert got.keys() == want.keys() and sum(w[2] for w in want.values()) > 50
    for seq, (left, elapsed, known) in want.items():
        r = got[seq]
        assert (r.elapsed_ms, r.confident) == (elapsed, known), seq
        assert (r.remaining_ms is None) == (left is None) and (left is None or r.remaining_ms == pytest.approx(left, rel=1e-9, abs=1e-6)), seq


def test_readings_without_run_time_or_progress(spark):
    schema = "run_id bigint, seq bigint, ts_ms bigint, p double"
    rows = [(1, 0, 0, 0.0), (1, 1, None, 0.5), (1, 2, 4000, None), (1, 3, 5000, 0.5), (None, 4, 0, 0.0), (None, 5, 5000, 0.25)]
    for size in (1, 100):
        got = {r.seq: (r.run_id, r.remaining_ms, r.elapsed_ms, r.confident) for r in E.progress_eta(spark.createDataFrame(rows, schema), size).collect()}
        assert got == {0: ("1", None, 0, False), 1: ("1", None, None, False), 2: ("1", None, 4000, False), 3: ("1", 5000.0, 5000, True),
                       4: (None, None, 0, False), 5: (None, 15000.0, 5000, True)}
    assert E.progress_eta(spark.createDataFrame([], schema)).count() == 0


def test_linear_progress_is_estimated_right(spark):
    rows = [(1, i, i * 500, i / 40) for i in range(40)]
    e = E.progress_eta(spark.createDataFrame(rows, "run_id bigint, seq bigint, ts_ms bigint, p double")).where("confident").collect()
    assert e and all(abs(r.remaining_ms - (40 - r.seq) * 500) < 1 for r in e)


def test_words(spark):
    ms = [500.0, 4000.0, 33000.0, 60000.0, 150000.0]
    got = [r.t for r in spark.createDataFrame([(m,) for m in ms], "ms double").select(E.eta_text(F.col("ms")).alias("t")).collect()]
    assert got == ["almost done", "about 4 seconds left", "about 35 seconds left", "about a minute left", "about 2.5 minutes left"]


def test_last_eight_runs(spark):
    rows = [("capture", i, 1000.0 * i) for i in range(1, 12)] + [("capture", 50, 100.0), ("family", 1, 900.0), ("other", 1, 900.0), ("other", 2, 900.0)]
    got = E.op_estimate(spark.createDataFrame(rows, "op string, o int, ms double"), ["capture", "preview", "family"]).collect()
    assert [(r.op, r.ms, r.samples) for r in got] == [("capture", 7500, 8)]
