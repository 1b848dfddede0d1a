"""Queries over request and progress events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.plans import ctes as C
from quillwork.plans.registry import query
from quillwork.sources import adapters as A
from quillwork.streaming import eta as E
from quillwork.streaming import limits as L

DAY = 86_400_000


def admit_sql(hits: str, limit: int, window: int, tail: str) -> str:
    return f"""WITH RECURSIVE {hits},
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms, hit_id) AS k FROM hits),
rec AS (
  SELECT key, hit_id, ts_ms, k, true AS allowed, 0 AS used, {limit} AS remaining, 0::BIGINT AS retry_after_ms, [ts_ms] AS live
    FROM n WHERE k = 1
  UNION ALL
  SELECT key, hit_id, ts_ms, k, len(kept) < {limit}, len(kept)::INT, greatest(0, {limit} - len(kept))::INT,
      CASE WHEN len(kept) < {limit} THEN 0 ELSE greatest(0, list_min(kept) + {window} - ts_ms) END,
      CASE WHEN len(kept) < {limit} THEN list_append(kept, ts_ms) ELSE kept END
  FROM (SELECT n.key, n.hit_id, n.ts_ms, n.k, list_filter(rec.live, lambda t: t > n.ts_ms - {window}) AS kept
        FROM rec JOIN n ON n.key = rec.key AND n.k = rec.k + 1))
{tail}"""


REQUESTS = """hits AS (SELECT coalesce(nullif(trim(split_part(fwd, ',', 1)), ''), nullif(ip, ''), 'unknown') AS key, ts_ms, hit_id
  FROM (SELECT event_id AS hit_id, epoch_us(ts) // 1000 AS ts_ms,
      CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' , 10.9.9.9' ELSE ' 10.0.0.' || (user_id % 40) || ' , 10.9.9.9' END AS fwd,
      CASE WHEN event_id % 12 = 0 THEN NULL ELSE '192.168.0.' || (user_id % 20) END AS ip,
      CASE event_type WHEN 'click' THEN '/' WHEN 'view' THEN '/index.html' WHEN 'error' THEN '/assets/' || event_id
        WHEN 'signup' THEN '/help/' || event_id ELSE '/' || event_id || '.png' END AS path FROM events)
  WHERE path IN ('/', '/index.html') OR NOT (regexp_matches(path, '^/(_next|_vercel|assets|src|vendor)') OR path LIKE '%.%'))"""


def requests(spark, sf):
    """Page requests told from the events: forwarded header, direct address and path."""
    return A.table(spark, sf, "events").selectExpr(
        "event_id AS hit_id", "unix_micros(cast(ts AS timestamp)) div 1000 AS ts_ms",
        "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' , 10.9.9.9'"
        " ELSE concat(' 10.0.0.', user_id % 40, ' , 10.9.9.9') END AS forwarded",
        "CASE WHEN event_id % 12 = 0 THEN NULL ELSE concat('192.168.0.', user_id % 20) END AS real_ip",
        "CASE event_type WHEN 'click' THEN '/' WHEN 'view' THEN '/index.html'"
        " WHEN 'error' THEN concat('/assets/', event_id) WHEN 'signup' THEN concat('/help/', event_id)"
        " ELSE concat('/', event_id, '.png') END AS path")


@query("device_limit", admit_sql(C.HITS, 3, DAY, """
SELECT key::VARCHAR AS key, hit_id, ts_ms, allowed, used, remaining, retry_after_ms FROM rec"""))
def device_limit(spark, sf):
    return L.admit(A.hits(spark, sf), 3, DAY)


@query("address_limit", admit_sql(REQUESTS, 25, DAY, """
SELECT key, hit_id, ts_ms, allowed, used, remaining, retry_after_ms FROM rec"""))
def address_limit(spark, sf):
    return L.admit(L.client_address(requests(spark, sf)), 25, DAY)


@query("retry_after", admit_sql(C.HITS, 3, DAY, """
SELECT key::VARCHAR AS key, hit_id, greatest(1, ceil(retry_after_ms / 1000.0))::INT AS retry_after,
  CASE WHEN ceil(retry_after_ms / 1000.0) <= 1 THEN 'a moment' WHEN ceil(retry_after_ms / 1000.0) < 60
  THEN ceil(retry_after_ms / 1000.0)::BIGINT || ' seconds' ELSE 'a minute' END AS wait FROM rec WHERE NOT allowed"""))
def retry_after(spark, sf):
    d = L.admit(A.hits(spark, sf), 3, DAY)
    r = L.retry_seconds(d)
    return r.withColumn("wait", E.wait_text(F.col("retry_after") * 1000))


@query("hit_expiry", f"""WITH {C.HITS},
g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY key ORDER BY ts_ms, hit_id) < {DAY} THEN 0 ELSE 1 END AS f FROM hits),
s AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY ts_ms, hit_id) AS span FROM g)
SELECT key, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, max(ts_ms) + {DAY} AS expires_ms, count(*) AS hits
FROM s GROUP BY key, span""")
def hit_expiry(spark, sf):
    return L.expiry(A.hits(spark, sf), DAY)


# readings of a month-long run: time passed, give or take what the event's value adds
PROGRESS = """progress AS (SELECT user_id AS run_id, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms,
  least(greatest((epoch_us(ts) // 1000 - 1704067200000) / 2592000000.0::DOUBLE * 0.9::DOUBLE + floor(value) % 10 / 100, 0), 1) AS p FROM events)"""


def progress(spark, sf):
    return A.table(spark, sf, "events").selectExpr(
        "user_id AS run_id", "event_id AS seq", "unix_micros(cast(ts AS timestamp)) div 1000 AS ts_ms",
        "(unix_micros(cast(ts AS timestamp)) div 1000 - 1704067200000) / 2592000000D * 0.9D"
        " + floor(value) % 10 / 100D AS p")


ETA = f"""WITH RECURSIVE {PROGRESS},
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_ms, seq) AS k FROM progress),
rec AS (
  SELECT run_id, seq, k, ts_ms AS start, ts_ms AS last_t, p AS last_p, NULL::DOUBLE AS rate, NULL::DOUBLE AS shown,
    NULL::BIGINT AS shown_at, false AS announced, NULL::DOUBLE AS remaining_ms, 0::BIGINT AS elapsed_ms, false AS confident FROM n WHERE k = 1
  UNION ALL
  SELECT run_id, seq, k, start, CASE WHEN fwd THEN ts_ms ELSE last_t END, CASE WHEN fwd THEN p ELSE last_p END, rate2,
    CASE WHEN ok THEN new ELSE shown END, CASE WHEN ok THEN ts_ms ELSE shown_at END,
    announced OR (ok AND new >= 1500), CASE WHEN ok THEN new END, ts_ms - start, ok AND (announced OR new >= 1500)
  FROM (SELECT *, CASE WHEN ok THEN greatest(0, CASE WHEN shown IS NULL OR raw < aged THEN raw ELSE aged + (raw - aged) * 0.18::DOUBLE END) END AS new
   FROM (SELECT *, rate2 IS NOT NULL AND p >= 0.06::DOUBLE AND ts_ms - start >= 600 AND p < 1 AS ok, (1 - p) / rate2 AS raw,
      greatest(0, shown - (ts_ms - shown_at)) AS aged
    FROM (SELECT *, CASE WHEN fwd THEN coalesce(rate + 0.25::DOUBLE * ((p - last_p) / (ts_ms - last_t) - rate), (p - last_p) / (ts_ms - last_t)) ELSE rate END AS rate2
     FROM (SELECT n.run_id, n.seq, n.k, n.ts_ms, n.p, rec.start, rec.last_t, rec.last_p, rec.rate, rec.shown, rec.shown_at, rec.announced,
        n.ts_ms > rec.last_t AND n.p > rec.last_p AS fwd FROM rec JOIN n ON n.run_id = rec.run_id AND n.k = rec.k + 1)))))"""


@query("progress_eta", ETA + """
SELECT run_id::VARCHAR AS run_id, seq, round(remaining_ms, 2) AS remaining_ms, elapsed_ms, confident FROM rec""")
def progress_eta(spark, sf):
    e = E.progress_eta(progress(spark, sf))
    return e.withColumn("remaining_ms", F.round("remaining_ms", 2))


@query("eta_text", """WITH v AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value * value * 3 END AS ms FROM events),
s AS (SELECT *, floor(ms / 1000 + 0.5)::BIGINT AS s FROM v), h AS (SELECT *, floor(s / 30.0 + 0.5)::BIGINT AS half FROM s)
SELECT event_id, CASE WHEN ms IS NULL THEN '' WHEN s <= 1 THEN 'almost done' WHEN s < 10 THEN 'about ' || s || ' seconds left'
  WHEN s < 60 THEN 'about ' || floor(s / 5.0 + 0.5)::BIGINT * 5 || ' seconds left' WHEN half = 2 THEN 'about a minute left'
  WHEN half % 2 = 0 THEN 'about ' || half // 2 || ' minutes left' ELSE 'about ' || half // 2 || '.5 minutes left' END AS text FROM h""")
def eta_text(spark, sf):
    v = A.table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_type = 'error' THEN NULL ELSE value * value * 3 END AS ms")
    return v.select("event_id", E.eta_text(F.col("ms")).alias("text"))


OPS = ["click", "purchase", "view"]
EST = """est AS (SELECT op, floor(median(ms) + 0.5)::BIGINT AS ms, count(*) AS samples FROM (
  SELECT event_type AS op, floor(value * 1000 + 0.5) AS ms, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k
  FROM events WHERE event_type IN ('click', 'purchase', 'view') AND value * 1000 BETWEEN 200 AND 600000)
  WHERE k <= 8 GROUP BY op HAVING count(*) >= 2)"""


def op_estimates(spark, sf):
    runs = A.table(spark, sf, "events").selectExpr("event_type AS op", "struct(ts, event_id) AS o", "value * 1000 AS ms")
    return E.op_estimate(runs, OPS)


@query("op_estimate", f"WITH {EST} SELECT * FROM est")
def op_estimate(spark, sf):
    return op_estimates(spark, sf)


@query("remembered_eta", f"""WITH {EST},
r AS (SELECT event_id, event_type AS op, ms * (1 - least(floor(value) % 100 / 100, 0.95::DOUBLE)) - value * 100 AS left_ms, samples
  FROM events JOIN est ON op = event_type)
SELECT event_id, op, round(left_ms, 4) AS left_ms, samples FROM r WHERE left_ms >= 1500""")
def remembered_eta(spark, sf):
    running = A.table(spark, sf, "events").selectExpr(
        "event_id", "event_type AS op", "floor(value) % 100 / 100D AS pct", "value * 100 AS elapsed_ms")
    r = E.remembered_eta(running, op_estimates(spark, sf))
    return r.select("event_id", "op", F.round("left_ms", 4).alias("left_ms"), "samples")
