"""Queries over outlines traced from the 8x8 glyph images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillwork.functions.num import r6
from quillwork.functions.shuffle import held
from quillwork.operators import outline as T
from quillwork.plans import ctes as C
from quillwork.plans.registry import query
from quillwork.sources import adapters as A

EDGES = C.SCANS + """,
ink AS (SELECT scan_id AS glyph_id, (i // 8)::INT AS y, (i % 8)::INT AS x FROM scans, range(64) r(i) WHERE gray[i + 1] < 128),
sides(side, dy, dx, ax, ay, bx, b_y) AS (VALUES (0, -1, 0, 0, 0, 1, 0), (1, 0, 1, 1, 0, 1, 1), (2, 1, 0, 1, 1, 0, 1), (3, 0, -1, 0, 1, 0, 0)),
edges AS (SELECT k.glyph_id, k.y, k.x, s.side, k.x + s.ax AS ax, k.y + s.ay AS ay, k.x + s.bx AS bx, k.y + s.b_y AS b_y FROM ink k, sides s
  WHERE NOT EXISTS (SELECT 1 FROM ink n WHERE n.glyph_id = k.glyph_id AND n.y = k.y + s.dy AND n.x = k.x + s.dx))"""
LOOPS = EDGES + """,
num AS (SELECT *, row_number() OVER (PARTITION BY glyph_id ORDER BY y, x, side) AS e FROM edges),
ord AS (SELECT *, min(e) OVER (PARTITION BY glyph_id, ax, ay) * 100000 + e AS rk FROM num),
suc AS (SELECT a.glyph_id, a.e, arg_min(b.e, (b.side - a.side + 5) % 4) AS nx FROM ord a JOIN ord b ON b.glyph_id = a.glyph_id AND b.ax = a.bx AND b.ay = a.b_y GROUP BY ALL),
rch AS (SELECT glyph_id, e AS a, e AS b, 0 AS d FROM ord UNION ALL SELECT r.glyph_id, r.a, s.nx, r.d + 1 FROM rch r JOIN suc s ON s.glyph_id = r.glyph_id AND s.e = r.b WHERE s.nx <> r.a),
head AS (SELECT r.glyph_id, r.b AS e, arg_min(r.a, o.rk) AS st, arg_min(r.d, o.rk) AS pos FROM rch r JOIN ord o ON o.glyph_id = r.glyph_id AND o.e = r.a GROUP BY ALL),
cnt AS (SELECT h.glyph_id, dense_rank() OVER (PARTITION BY h.glyph_id ORDER BY o.rk) - 1 AS contour, h.pos, m.bx::DOUBLE AS x, m.b_y::DOUBLE AS y
  FROM head h JOIN ord o ON o.glyph_id = h.glyph_id AND o.e = h.st JOIN ord m ON m.glyph_id = h.glyph_id AND m.e = h.e),
loops AS (SELECT glyph_id, contour, list(x ORDER BY pos) AS xs, list(y ORDER BY pos) AS ys, count(*) AS n FROM cnt GROUP BY ALL),
area AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: xs[i] * ys[i % n + 1] - xs[i % n + 1] * ys[i])) / 2 AS area FROM loops),
kept AS (SELECT * FROM area QUALIFY abs(area) >= max(abs(area)) OVER (PARTITION BY glyph_id) * 0.004::DOUBLE)"""
LIMIT = repr(math.cos(math.radians(40)))
CORNERS = LOOPS + f""",
wn AS (SELECT *, greatest(3, least(28, floor(sqrt(power(list_max(xs) - list_min(xs), 2) + power(list_max(ys) - list_min(ys), 2)) * 0.05::DOUBLE + 0.5)))::INT AS win FROM kept),
ps AS (SELECT *, unnest(range(0, n)) AS i FROM wn),
vv AS (SELECT *, xs[i + 1] - xs[(i - win + 2 * n) % n + 1] AS ux, ys[i + 1] - ys[(i - win + 2 * n) % n + 1] AS uy, xs[(i + win) % n + 1] - xs[i + 1] AS vx, ys[(i + win) % n + 1] - ys[i + 1] AS vy FROM ps),
rs AS (SELECT glyph_id, contour, n, win, i, CASE WHEN sqrt(ux * ux + uy * uy) < 0.000001 OR sqrt(vx * vx + vy * vy) < 0.000001 THEN 0
   WHEN (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)) < {LIMIT}::DOUBLE THEN 1 - (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)) ELSE 0 END AS resp FROM vv),
crn AS (SELECT a.glyph_id, a.contour, a.i FROM rs a WHERE a.resp > 0 AND a.n >= 8 AND NOT EXISTS (SELECT 1 FROM rs b WHERE b.glyph_id = a.glyph_id AND b.contour = a.contour
   AND b.resp > a.resp AND least((b.i - a.i + a.n) % a.n, (a.i - b.i + a.n) % a.n) <= greatest(2, floor(a.win * 0.8::DOUBLE + 0.5))))"""
WTS = "[" + ", ".join(f"{math.exp(-d * d / (2 * 1.35 * 1.35))!r}::DOUBLE" for d in range(-4, 5)) + "]"
SMOOTH = CORNERS + f""",
cl AS (SELECT k.glyph_id, k.contour, k.n, k.xs, k.ys, coalesce(c.cs, []) AS cs FROM kept k LEFT JOIN (SELECT glyph_id, contour, list(i ORDER BY i) AS cs FROM crn GROUP BY ALL) c USING (glyph_id, contour)),
pt AS (SELECT *, unnest(range(0, n)) AS i FROM cl), dd AS (SELECT *, unnest(range(-4, 5)) AS d FROM pt),
fr AS (SELECT * FROM dd WHERE CASE WHEN list_contains(cs, i) THEN d = 0 ELSE d = 0 OR len(list_filter(range(1, abs(d) + 1), lambda t: list_contains(cs, (i + sign(d)::INT * t + 2 * n) % n))) = 0 END),
smo AS (SELECT glyph_id, contour, i, sum(xs[(i + d + 2 * n) % n + 1] * {WTS}[d + 5]) / sum({WTS}[d + 5]) AS x, sum(ys[(i + d + 2 * n) % n + 1] * {WTS}[d + 5]) / sum({WTS}[d + 5]) AS y FROM fr GROUP BY ALL)"""


def ink(spark, sf):
    return A.scan_pixels(spark, sf).where("gray < 128").selectExpr("scan_id AS glyph_id", "y", "x")


def coverage(spark, sf):
    return A.scan_arrays(spark, sf).selectExpr("scan_id AS glyph_id", "w", "h", "transform(gray, v -> 1 - v / 255D) AS cov")


def _points(c, extra=()):
    return c.select("glyph_id", "contour", *extra, F.posexplode("pts").alias("i", "p")).select(
        "glyph_id", "contour", *extra, "i", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


def loops(spark, sf):
    """Every contour of each glyph, specks included."""
    return T.traced(ink(spark, sf).selectExpr("glyph_id", "y", "x AS x0", "x + 1 AS x1"), 0.0)


@query("crack_edges", f"""WITH {EDGES} SELECT glyph_id, y, x, side, ax, ay, bx, b_y AS "by" FROM edges""")
def crack_edges(spark, sf):
    return T.crack_edges(ink(spark, sf))


@query("trace_loops", f"WITH RECURSIVE {LOOPS} SELECT glyph_id, contour, pos AS i, x, y FROM cnt")
def trace_loops(spark, sf):
    """T2 over the runs of each glyph, specks included."""
    return _points(loops(spark, sf))


@query("signed_area", f"WITH RECURSIVE {LOOPS} SELECT glyph_id, contour, n, area FROM area")
def signed_area(spark, sf):
    return T.signed_area(loops(spark, sf)).selectExpr("glyph_id", "contour", "size(pts) AS n", "area")


@query("speck_filter", f"WITH RECURSIVE {LOOPS} SELECT glyph_id, contour, area FROM kept")
def speck_filter(spark, sf):
    return T.speck_filter(T.signed_area(loops(spark, sf)).select("glyph_id", "contour", "area"))


@query("corners", f"WITH RECURSIVE {CORNERS} SELECT glyph_id, contour, i FROM crn")
def corners(spark, sf):
    return T.contours_of(ink(spark, sf)).select("glyph_id", "contour", F.explode("corners").alias("i"))


REFINE = CORNERS + """,
cl AS (SELECT k.glyph_id, k.contour, k.n, k.xs, k.ys, coalesce(c.cs, []) AS cs, greatest(1, least(2, (k.n - 1) // 2)) AS rc FROM kept k LEFT JOIN (SELECT glyph_id, contour, list(i ORDER BY i) AS cs FROM crn GROUP BY ALL) c USING (glyph_id, contour)),
pt AS (SELECT *, unnest(range(0, n)) AS i FROM cl),
tg AS (SELECT *, xs[i + 1] AS px, ys[i + 1] AS py, xs[(i + rc) % n + 1] - xs[(i - rc + n) % n + 1] AS tx, ys[(i + rc) % n + 1] - ys[(i - rc + n) % n + 1] AS ty FROM pt),
nm AS (SELECT glyph_id, contour, i, px, py, list_contains(cs, i) OR (tx = 0 AND ty = 0) AS still, ty / sqrt(tx * tx + ty * ty) AS nx, -tx / sqrt(tx * tx + ty * ty) AS ny FROM tg),
sm AS (SELECT *, unnest(range(0, 21)) AS k FROM nm WHERE NOT still),
uv AS (SELECT *, px + nx * (k * 0.125 - 1.25) - 0.5 AS u, py + ny * (k * 0.125 - 1.25) - 0.5 AS v FROM sm),
fl AS (SELECT *, floor(u)::INT AS i0, floor(v)::INT AS j0, u - floor(u) AS fu, v - floor(v) AS fv FROM uv),
cvv AS (SELECT scan_id AS glyph_id, list_transform(gray, lambda g: 1 - g / 255.0::DOUBLE) AS c FROM scans),
vl AS (SELECT glyph_id, contour, i, px, py, nx, ny, k,
   (CASE WHEN i0 BETWEEN 0 AND 7 AND j0 BETWEEN 0 AND 7 THEN c[j0 * 8 + i0 + 1] ELSE 0 END * (1 - fu) + CASE WHEN i0 + 1 BETWEEN 0 AND 7 AND j0 BETWEEN 0 AND 7 THEN c[j0 * 8 + i0 + 2] ELSE 0 END * fu) * (1 - fv)
   + (CASE WHEN i0 BETWEEN 0 AND 7 AND j0 + 1 BETWEEN 0 AND 7 THEN c[j0 * 8 + i0 + 9] ELSE 0 END * (1 - fu) + CASE WHEN i0 + 1 BETWEEN 0 AND 7 AND j0 + 1 BETWEEN 0 AND 7 THEN c[j0 * 8 + i0 + 10] ELSE 0 END * fu) * fv AS val
   FROM fl JOIN cvv USING (glyph_id)),
lg AS (SELECT *, lag(val) OVER (PARTITION BY glyph_id, contour, i ORDER BY k) AS pv FROM vl),
ht AS (SELECT *, (k - 1) * 0.125 - 1.25 + CASE WHEN pv - val > 0.000000001 THEN (pv - 0.5) / (pv - val) * 0.125 ELSE 0 END AS s FROM lg WHERE pv >= 0.5 AND val < 0.5),
bst AS (SELECT glyph_id, contour, i, arg_min(s, row(abs(s), k)) AS s FROM ht GROUP BY ALL)"""


@query("refine_coverage", f"""WITH RECURSIVE {REFINE}
SELECT nm.glyph_id, nm.contour, nm.i, round(CASE WHEN still OR s IS NULL THEN px ELSE px + nx * s END, 6) + 0.0 AS x,
  round(CASE WHEN still OR s IS NULL THEN py ELSE py + ny * s END, 6) + 0.0 AS y FROM nm LEFT JOIN bst USING (glyph_id, contour, i)""")
def refine_coverage(spark, sf):
    return _points(T.refine_coverage(T.contours_of(ink(spark, sf)).join(coverage(spark, sf), "glyph_id")))


@query("smooth_contour", f"WITH RECURSIVE {SMOOTH} SELECT glyph_id, contour, i, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM smo")
def smooth_contour(spark, sf):
    return _points(T.smooth_contour(T.contours_of(ink(spark, sf))))


@query("corner_runs", f"""WITH RECURSIVE {CORNERS},
cl AS (SELECT k.glyph_id, k.contour, k.n, k.xs, k.ys, coalesce(c.cs, []) AS cs FROM kept k LEFT JOIN (SELECT glyph_id, contour, list(i ORDER BY i) AS cs FROM crn GROUP BY ALL) c USING (glyph_id, contour)),
ct AS (SELECT *, unnest(CASE WHEN len(cs) = 0 THEN [0] ELSE range(0, len(cs)) END) AS run FROM cl),
st AS (SELECT *, CASE WHEN len(cs) = 0 THEN 0 ELSE cs[run + 1] END AS a, CASE WHEN len(cs) <= 1 THEN n ELSE (cs[(run + 1) % len(cs) + 1] - cs[run + 1] + n) % n END AS ln FROM ct),
ex AS (SELECT *, unnest(range(0, ln + 1)) AS i FROM st)
SELECT glyph_id, contour, run, i, xs[(a + i) % n + 1] AS x, ys[(a + i) % n + 1] AS y FROM ex""")
def corner_runs(spark, sf):
    return _points(T.corner_runs(T.contours_of(ink(spark, sf))).select("glyph_id", "contour", "run", "pts"), ("run",))


@query("decimate", """WITH l AS (SELECT doc_id AS id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS c FROM documents),
p AS (SELECT id, c, unnest(range(1, len(c) + 1)) AS i FROM l), d AS (SELECT id, c[i] AS v, i FROM p WHERE i = 1 OR c[i] <> c[i - 1]),
g AS (SELECT id, list(v ORDER BY i) AS v, count(*) AS n FROM d GROUP BY id),
k AS (SELECT id, CASE WHEN n <= 2400 THEN v ELSE list_transform(range(0, 2400), lambda i: v[floor(i * (n / 2400::DOUBLE))::BIGINT + 1]) || CASE WHEN floor(2399 * (n / 2400::DOUBLE)) = n - 1 THEN [] ELSE [v[n]] END END AS v FROM g)
SELECT id AS glyph_id, len(v) AS n, list_sum(list_transform(v, lambda x, i: x * (i % 97)))::BIGINT AS mark FROM k""")
def decimate(spark, sf):
    """T7 over long runs: a document's characters as the heights of a line of points."""
    r = A.table(spark, sf, "documents").selectExpr(
        "doc_id AS glyph_id", "transform(filter(split(text, ''), c -> c <> ''), c -> named_struct('x', 0D, 'y', cast(ascii(c) AS double))) AS pts0")
    r = held(r, pts="pts0").drop("pts0")
    return T.decimate(r).selectExpr(
        "glyph_id", "size(pts) AS n", "cast(aggregate(transform(pts, (p, i) -> p.y * ((i + 1) % 97)), 0D, (a, v) -> a + v) AS bigint) AS mark")


def traced(spark, sf, covered: bool = False):
    size = A.table(spark, sf, "embeddings").selectExpr("vec_id AS glyph_id", "8 AS w", "8 AS h")
    return T.vectorize(ink(spark, sf), size, coverage(spark, sf).select("glyph_id", "cov") if covered else None)


@query("fit_cubics")
def fit_cubics(spark, sf):
    c = traced(spark, sf)
    return c.select("glyph_id", "contour", "run", "k", "outer",
                    *[r6(F.col(f"{n}.{a}")).alias(f"{n}_{a}") for n in T.ENDS for a in "xy"])


@query("fit_cubics_covered")
def fit_cubics_covered(spark, sf):
    return traced(spark, sf, covered=True).groupBy("glyph_id").agg(F.count("*").alias("curves"), F.countDistinct("contour").alias("contours"))


@query("fit_deviation")
def fit_deviation(spark, sf):
    return T.fit_deviation(traced(spark, sf), T.contours_of(ink(spark, sf)))
