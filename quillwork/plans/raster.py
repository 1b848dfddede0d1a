"""Queries over page images: 8x8 scans and the sheet pages composed of them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillwork.functions import dims
from quillwork.functions.num import r6
from quillwork.operators import pages as P
from quillwork.operators import raster as R
from quillwork.plans import ctes as C
from quillwork.plans.registry import query
from quillwork.sources import adapters as A
from quillwork.sources import images
from quillwork.stages import Stages


def rgb_pixels(spark, sf):
    s = A.scan_rgb(spark, sf)
    return s.selectExpr("scan_id", "w", "h", "posexplode(arrays_zip(r, g, b)) AS (p, v)").selectExpr(
        "scan_id", "w", "h", "cast(p div w AS int) AS y", "cast(p % w AS int) AS x", "v.r", "v.g", "v.b")


@query("scan_read", f"""WITH {C.SCANS}
SELECT scan_id, (i // 8)::INT AS y, (i % 8)::INT AS x, gray[i + 1] AS r, gray[(i + 1) % 64 + 1] AS g, gray[(i + 2) % 64 + 1] AS b
FROM scans, range(64) t(i)""")
def scan_read(spark, sf):
    """Stored rasters, one binary of blue-green-red bytes per scan, to pixels."""
    s = A.scan_rgb(spark, sf).selectExpr(
        "scan_id", "w", "h", "unhex(concat_ws('', transform(arrays_zip(r, g, b), p ->"
        " concat(lpad(hex(p.b), 2, '0'), lpad(hex(p.g), 2, '0'), lpad(hex(p.r), 2, '0'))))) AS data")
    return images.scan_pixels(s).select("scan_id", "y", "x", "r", "g", "b")


LUMA = """luma AS (SELECT scan_id, (i // 8)::INT AS y, (i % 8)::INT AS x, gray[i + 1] AS r, gray[(i + 1) % 64 + 1] AS g, gray[(i + 2) % 64 + 1] AS b
FROM scans, range(64) t(i))"""


@query("gray_luma", f"""WITH {C.SCANS}, {LUMA}
SELECT scan_id, y, x, (r * 77 + g * 150 + b * 29) // 256 AS plain,
 CASE WHEN b >= r AND b >= g AND b > 0 AND (b - least(r, g)) / b::DOUBLE > 0.22::DOUBLE AND b > 90 AND b - r > 25 THEN 255
  ELSE (r * 77 + g * 150 + b * 29) // 256 END AS no_blue FROM luma""")
def gray_luma(spark, sf):
    px = R.gray_luma(rgb_pixels(spark, sf)).withColumnRenamed("gray", "plain")
    return R.gray_luma(px, drop_blue=True).select("scan_id", "y", "x", "plain", F.col("gray").alias("no_blue"))


@query("box_downscale", f"""WITH {C.PAGE_PIXELS},
s AS (SELECT DISTINCT scan_id, w, h, floor(w * (50 / greatest(w, h)::DOUBLE) + 0.5)::INT AS nw, greatest(1, floor(h * (50 / greatest(w, h)::DOUBLE) + 0.5))::INT AS nh
  FROM pixels WHERE greatest(w, h) > 50),
bx AS (SELECT *, floor(i * (w / nw::DOUBLE))::INT AS a, floor((i + 1) * (w / nw::DOUBLE))::INT AS b FROM s, range(50) r(i) WHERE i < nw),
byy AS (SELECT scan_id, j, floor(j * (h / nh::DOUBLE))::INT AS a, floor((j + 1) * (h / nh::DOUBLE))::INT AS b FROM s, range(50) r(j) WHERE j < nh)
SELECT p.scan_id, bx.nw AS w, bx.nh AS h, byy.j::INT AS y, bx.i::INT AS x, round_even(avg(gray), 0)::INT AS gray
FROM pixels p JOIN bx ON bx.scan_id = p.scan_id AND p.x >= bx.a AND p.x < bx.b
  JOIN byy ON byy.scan_id = p.scan_id AND p.y >= byy.a AND p.y < byy.b GROUP BY ALL
UNION ALL SELECT scan_id, w, h, y, x, gray FROM pixels WHERE greatest(w, h) <= 50""")
def box_downscale(spark, sf):
    return R.box_downscale(A.page_pixels(spark, sf), 50)


INTEGRAL = C.PAGE_PIXELS + """,
r1 AS (SELECT *, sum(gray) OVER (PARTITION BY scan_id, y ORDER BY x) AS s1, sum(gray * gray) OVER (PARTITION BY scan_id, y ORDER BY x) AS q1 FROM pixels),
integral AS (SELECT scan_id, w, h, y, x, gray, sum(s1) OVER (PARTITION BY scan_id, x ORDER BY y)::BIGINT AS s,
  sum(q1) OVER (PARTITION BY scan_id, x ORDER BY y)::BIGINT AS q FROM r1)"""


@query("integral_image", f"WITH {INTEGRAL} SELECT scan_id, y, x, s, q FROM integral")
def integral_image(spark, sf):
    return R.integral_image(A.page_pixels(spark, sf)).select("scan_id", "y", "x", "s", "q")


@query("rect_sum", f"""WITH {C.PAGES}, p AS (SELECT scan_id, w, h, y, x, CASE WHEN x >= x0 AND x < x0 + 8 AND y >= y0 AND y < y0 + 8
   THEN gray[(y - y0) * 8 + x - x0 + 1] ELSE 255 END AS gray FROM placed, range(20) a(y), range(170) b(x)
   WHERE x >= CASE WHEN col = 0 THEN 0 ELSE x0 END AND x <= x0 + 11)
SELECT q.scan_id, q.col AS rect, sum(p.gray)::BIGINT AS s, sum(p.gray * p.gray)::BIGINT AS q FROM placed q JOIN p
  ON p.scan_id = q.scan_id AND p.x >= q.x0 - 6 AND p.x < q.x0 + 8 AND p.y >= 0 AND p.y < q.y0 + 3 GROUP BY ALL""")
def rect_sum(spark, sf):
    rects = A.sheet_pages(spark, sf).selectExpr(
        "scan_id", "col AS rect", "x0 - 6 AS x0", "0 AS y0", "x0 + 8 AS x1", "y0 + 3 AS y1")
    return R.rect_sum(R.integral_image(A.page_pixels(spark, sf)), rects)


OTSU = """hist AS (SELECT scan_id, gray, count(*)::DOUBLE AS n FROM pixels GROUP BY ALL),
cum AS (SELECT scan_id, gray, sum(n) OVER w AS wb, sum(n * gray) OVER w AS sb, sum(n) OVER p AS tot, sum(n * gray) OVER p AS al FROM hist
  WINDOW w AS (PARTITION BY scan_id ORDER BY gray), p AS (PARTITION BY scan_id)),
ot AS (SELECT scan_id, coalesce(arg_max(gray, row(v, -gray)), 0) AS otsu FROM (SELECT scan_id, gray, CASE WHEN tot > wb THEN
  wb * (tot - wb) * (sb / wb - (al - sb) / (tot - wb)) * (sb / wb - (al - sb) / (tot - wb)) ELSE -1 END AS v FROM cum) GROUP BY scan_id)"""


@query("otsu", f"WITH {C.PIXELS}, {OTSU} SELECT * FROM ot")
def otsu(spark, sf):
    return R.otsu(A.scan_pixels(spark, sf))


# window sums along the line and then across lines; frames are cut off at the page's edges like the window is
SAUVOLA = C.PAGE_PIXELS + "," + OTSU + """,
rad AS (SELECT *, (greatest(15, floor(least(w, h) / 16.0 + 0.5)::INT | 1) // 2)::BIGINT AS r FROM pixels),
along AS (SELECT *, sum(gray) OVER f AS ls, sum(gray * gray) OVER f AS lq, count(*) OVER f AS ln FROM rad
  WINDOW f AS (PARTITION BY scan_id, y ORDER BY x ROWS BETWEEN r PRECEDING AND r FOLLOWING)),
box AS (SELECT *, sum(ls) OVER f AS bs, sum(lq) OVER f AS bq, (sum(ln) OVER f)::DOUBLE AS n FROM along
  WINDOW f AS (PARTITION BY scan_id, x ORDER BY y ROWS BETWEEN r PRECEDING AND r FOLLOWING)),
mm AS (SELECT *, bs / n AS m, sqrt(greatest(0::DOUBLE, bq / n - (bs / n) * (bs / n))) AS sd FROM box),
sauv AS (SELECT mm.scan_id, w, h, y, x FROM mm JOIN ot USING (scan_id)
  WHERE gray < least(m * (1 + 0.28::DOUBLE * (sd / 128 - 1)), m - 8) AND gray < least(250, otsu + 55))"""


@query("sauvola", f"WITH {SAUVOLA} SELECT scan_id, y, x FROM sauv")
def sauvola(spark, sf):
    return R.sauvola(A.page_pixels(spark, sf)).select("scan_id", "y", "x")


RUNS = """isl AS (SELECT *, x - row_number() OVER (PARTITION BY scan_id, y ORDER BY x) AS k FROM ink),
runs AS (SELECT scan_id, w, h, y, min(x)::INT AS x0, (max(x) + 1)::INT AS x1 FROM isl GROUP BY scan_id, w, h, y, k)"""
LABELS = RUNS + """,
num AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY y, x0) AS id FROM runs),
adj AS (SELECT a.scan_id, a.id AS u, b.id AS v FROM num a JOIN num b ON a.scan_id = b.scan_id AND b.y = a.y + 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
both_ways AS (SELECT * FROM adj UNION ALL SELECT scan_id, v, u FROM adj),
reach AS (SELECT scan_id, id AS a, id AS b FROM num UNION SELECT r.scan_id, r.a, e.v FROM reach r JOIN both_ways e ON e.scan_id = r.scan_id AND e.u = r.b),
root AS (SELECT scan_id, b AS id, min(a) AS root FROM reach GROUP BY ALL),
lab AS (SELECT n.*, f.y AS ly, f.x0 AS lx FROM num n JOIN root r ON r.scan_id = n.scan_id AND r.id = n.id JOIN num f ON f.scan_id = n.scan_id AND f.id = r.root),
comp AS (SELECT scan_id, w, h, row_number() OVER (PARTITION BY scan_id ORDER BY ly, lx) AS comp_id, * EXCLUDE (scan_id, w, h) FROM
  (SELECT scan_id, w, h, ly, lx, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) + 1 AS y1, sum(x1 - x0)::BIGINT AS area,
    sum((x0 + x1 - 1) * (x1 - x0) / 2.0) / sum(x1 - x0) AS cx, sum(y * (x1 - x0)) / sum(x1 - x0) AS cy FROM lab GROUP BY ALL))"""


def page_labels(spark, sf):
    return R.label_runs(R.ink_runs(A.page_ink(spark, sf)))


@query("components", f"""WITH RECURSIVE {C.PAGE_INK}, {LABELS}
SELECT scan_id, comp_id, x0, y0, x1, y1, area, round(cx, 6) AS cx, round(cy, 6) AS cy FROM comp""")
def components(spark, sf):
    c = R.components(page_labels(spark, sf))
    return c.select("scan_id", "comp_id", "x0", "y0", "x1", "y1", "area", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"))


DESPECKLE = LABELS + """,
srt AS (SELECT scan_id, list_sort(list(area)) AS l FROM comp GROUP BY scan_id),
keep AS (SELECT c.scan_id, ly, lx FROM comp c JOIN srt USING (scan_id) WHERE area >= greatest(6::DOUBLE, l[len(l) // 2 + 1] * 0.02::DOUBLE)),
desp AS (SELECT lab.* FROM lab JOIN keep USING (scan_id, ly, lx))"""


@query("despeckle", f"WITH RECURSIVE {C.PAGE_INK}, {DESPECKLE} SELECT scan_id, y, x0, x1 FROM desp")
def despeckle(spark, sf):
    return R.despeckle(page_labels(spark, sf)).select("scan_id", "y", "x0", "x1")


RULED = C.PAGES + """,
ink AS (SELECT scan_id, w, h, (y0 + i // 8)::INT AS y, (x0 + i % 8)::INT AS x FROM placed, range(64) r(i) WHERE gray[i + 1] < 128 OR (scan_id % 3 = 1 AND i // 8 = 7)
  UNION SELECT scan_id, w, h, y::INT, x::INT FROM placed, range(2) a(d), range(12) b(i), (SELECT 15 AS yy) q, (SELECT unnest([0, 1]) AS dd) z,
    LATERAL (SELECT yy + dd AS y, x0 + i AS x) l WHERE scan_id % 2 = 0)"""


def ruled_ink(spark, sf):
    """Sheet pages on ruled paper: every second page has a rule two pixels thick below the letters."""
    p = A.sheet_pages(spark, sf)
    marks = p.selectExpr("scan_id", "w", "h", "x0", "y0", "posexplode(gray) AS (i, v)").where(
        "v < 128 OR (scan_id % 3 = 1 AND i div 8 = 7)").selectExpr(
        "scan_id", "w", "h", "cast(y0 + i div 8 AS int) AS y", "cast(x0 + i % 8 AS int) AS x")
    rule = p.where("scan_id % 2 = 0").selectExpr("scan_id", "w", "h", "x0", "explode(array(15, 16)) AS y").selectExpr(
        "scan_id", "w", "h", "y", "explode(sequence(x0, x0 + 11)) AS x")
    return marks.unionByName(rule).distinct()


RULES = RULED + """,
hi AS (SELECT *, x - row_number() OVER (PARTITION BY scan_id, y ORDER BY x) AS hk, y - row_number() OVER (PARTITION BY scan_id, x ORDER BY y) AS vk FROM ink),
ln AS (SELECT *, count(*) OVER (PARTITION BY scan_id, y, hk) AS hl, min(x) OVER (PARTITION BY scan_id, y, hk) AS h0,
   count(*) OVER (PARTITION BY scan_id, x, vk) AS vl, min(y) OVER (PARTITION BY scan_id, x, vk) AS v0 FROM hi),
lg AS (SELECT *, hl >= greatest(40, floor(w * 0.3::DOUBLE + 0.5)) AS lh, vl >= greatest(40, floor(h * 0.3::DOUBLE + 0.5)) AS lv FROM ln),
tk AS (SELECT scan_id, list_sort(list(least(vl, 24))) AS l FROM lg WHERE lh AND (x - h0) % 16 = 0 GROUP BY scan_id),
dm AS (SELECT lg.*, (lh AND vl <= t) OR (lv AND hl <= t) AS doomed FROM (SELECT lg.*, coalesce(least(24, greatest(2, floor(l[len(l) // 2 + 1] * 1.7::DOUBLE + 0.5))), 2) AS t
   FROM lg LEFT JOIN tk USING (scan_id)) lg)"""


@query("remove_rules", f"""WITH {RULES}
SELECT scan_id, count(*) FILTER (WHERE lh AND x = h0) + count(*) FILTER (WHERE lv AND y = v0) AS rules, count(*) FILTER (WHERE doomed) AS removed,
  count(*) FILTER (WHERE NOT doomed) AS kept, coalesce(sum(y * 1000 + x) FILTER (WHERE NOT doomed), 0)::BIGINT AS mark FROM dm GROUP BY scan_id""")
def remove_rules(spark, sf):
    ink, stats = R.remove_rules(ruled_ink(spark, sf))
    left = ink.groupBy("scan_id").agg(F.count("*").alias("kept"), F.sum(F.expr("cast(y * 1000 + x AS bigint)")).alias("mark"))
    return stats.join(left, "scan_id", "left").na.fill(0)


def search_sql(angles, coarse: float, at: str, last: str, pad: str, sign: str) -> str:
    first, second = angles
    lit = [(k, 0, float(d), t) for k, d, t in first]
    return f"""
a1 AS ({dims.values_sql(lit, 'k, j, deg, tan', duck=True)}), a2 AS ({dims.values_sql(second, 'k, j, deg, tan', duck=True)}),
t1 AS (SELECT scan_id, k, {at} AS pos, {last} AS last FROM (SELECT *, {pad} AS pad FROM ink, a1)),
p1 AS (SELECT scan_id, k, pos, last, count(*) AS n FROM t1 WHERE pos >= 0 AND pos <= last GROUP BY ALL),
s1 AS (SELECT a.scan_id, a.k, sum((2 - (a.pos = 0)::INT - (a.pos = a.last)::INT) * a.n * a.n - 2 * a.n * coalesce(b.n, 0)) AS score
  FROM p1 a LEFT JOIN p1 b ON b.scan_id = a.scan_id AND b.k = a.k AND b.pos = a.pos - 1 GROUP BY ALL),
b1 AS (SELECT scan_id, arg_max(k, row(score, -k)) AS k, max(score) AS score FROM s1 GROUP BY scan_id),
t2 AS (SELECT scan_id, j, {at} AS pos, {last} AS last FROM (SELECT ink.*, j, tan, {pad} AS pad FROM ink JOIN b1 USING (scan_id) JOIN a2 USING (k))),
p2 AS (SELECT scan_id, j, pos, last, count(*) AS n FROM t2 WHERE pos >= 0 AND pos <= last GROUP BY ALL),
s2 AS (SELECT a.scan_id, a.j, sum((2 - (a.pos = 0)::INT - (a.pos = a.last)::INT) * a.n * a.n - 2 * a.n * coalesce(b.n, 0)) AS score
  FROM p2 a LEFT JOIN p2 b ON b.scan_id = a.scan_id AND b.j = a.j AND b.pos = a.pos - 1 GROUP BY ALL),
walk AS (SELECT b1.scan_id, b1.k, a1.deg AS best, b1.score, -1 AS j, true AS live FROM b1 JOIN a1 ON a1.k = b1.k
  UNION ALL SELECT w.scan_id, w.k, CASE WHEN a2.deg <= w.best + {coarse} AND s2.score > w.score THEN a2.deg ELSE w.best END,
    CASE WHEN a2.deg <= w.best + {coarse} AND s2.score > w.score THEN s2.score ELSE w.score END, w.j + 1, a2.deg <= w.best + {coarse}
  FROM walk w JOIN a2 ON a2.k = w.k AND a2.j = w.j + 1 JOIN s2 ON s2.scan_id = w.scan_id AND s2.j = w.j + 1 WHERE w.live),
fin AS (SELECT scan_id, arg_max(best, j) AS deg FROM walk GROUP BY scan_id)
SELECT scan_id, round({sign}deg, 6) + 0.0 AS deg FROM fin"""


@query("page_skew", f"WITH RECURSIVE {C.PAGE_INK}," + search_sql(
    R.SKEW, 1.0, "y + CASE WHEN tan < 0 THEN pad ELSE 0 END - floor(tan * x + 0.5)::INT", "h + pad + 1", "ceil(abs(tan) * w)::INT", ""))
def page_skew(spark, sf):
    ink = A.page_ink(spark, sf)
    return R.page_skew(ink, ink.select("scan_id").distinct()).select("scan_id", r6(F.col("deg")).alias("deg"))


@query("writing_slant", f"WITH RECURSIVE {C.PAGE_INK}," + search_sql(
    R.SLANT, 2.0, "x + floor(tan * y + 0.5)::INT + pad", "w + 2 * pad - 1", "ceil(abs(tan) * h)::INT + 2", "-"))
def writing_slant(spark, sf):
    ink = A.page_ink(spark, sf)
    return R.writing_slant(ink, ink.select("scan_id").distinct()).select("scan_id", r6(F.col("deg")).alias("deg"))


@query("rotate_gray", f"""WITH {C.PIXELS},
pg AS (SELECT scan_id, a, cos(a) AS c, sin(a) AS s, ceil(abs(8 * cos(a)) + abs(8 * sin(a)))::INT AS n FROM
  (SELECT scan_id, CASE WHEN scan_id % 5 = 0 THEN 0 ELSE (scan_id % 17 - 8) * 0.02::DOUBLE END AS a FROM scans)),
g AS (SELECT pg.*, y::INT AS y, x::INT AS x, c * (x - n / 2.0::DOUBLE) + s * (y - n / 2.0::DOUBLE) + 4 AS sx, -s * (x - n / 2.0::DOUBLE) + c * (y - n / 2.0::DOUBLE) + 4 AS sy
  FROM pg, range(12) u(y), range(12) v(x) WHERE y < n AND x < n),
q AS (SELECT g.*, gray, sx - floor(sx) AS fx, sy - floor(sy) AS fy, (floor(sy) * 8 + floor(sx))::INT + 1 AS i FROM g JOIN scans USING (scan_id))
SELECT scan_id, n AS w, n AS h, y, x, CASE WHEN abs(a) < 0.0001 THEN gray[y * 8 + x + 1] WHEN sx < 0 OR sy < 0 OR sx >= 7 OR sy >= 7 THEN 255
  ELSE round_even(gray[i] * (1 - fx) * (1 - fy) + gray[i + 1] * fx * (1 - fy) + gray[i + 8] * (1 - fx) * fy + gray[i + 9] * fx * fy, 0)::INT END AS gray FROM q""")
def rotate_gray(spark, sf):
    angles = A.table(spark, sf, "embeddings").selectExpr(
        "vec_id AS scan_id", "IF(vec_id % 5 = 0, 0D, (vec_id % 17 - 8) * 0.02D) AS angle")
    return R.rotate_gray(A.scan_pixels(spark, sf), angles)


@query("ink_ratio", """WITH l AS (SELECT doc_id AS scan_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT scan_id, list_sum(list_transform(ls, lambda s: length(regexp_replace(s, '[ \\t\\r\\v\\f]', '', 'g'))))::BIGINT AS n,
  round(list_sum(list_transform(ls, lambda s: length(regexp_replace(s, '[ \\t\\r\\v\\f]', '', 'g')))) / (list_max(list_transform(ls, lambda s: length(s)))::DOUBLE * len(ls)), 6) AS ratio
FROM l WHERE list_sum(list_transform(ls, lambda s: length(regexp_replace(s, '[ \\t\\r\\v\\f]', '', 'g')))) > 0""")
def ink_ratio(spark, sf):
    """R12 over text pages: lines are scanlines, words are ink."""
    r = R.ink_ratio(A.text_runs(spark, sf))
    return r.select("scan_id", F.col("n").cast("bigint").alias("n"), r6(F.col("ratio")).alias("ratio"))


def again(sql: str, mark: str) -> str:
    """The CTEs of a stage under other names, so that a chain may hold the stage twice."""
    names = ("pixels hist cum ot rad along box mm sauv ink isl runs num adj both_ways reach root lab comp srt keep desp hi ln lg tk dm "
             "a1 a2 t1 p1 s1 b1 t2 p2 s2 walk fin").split()
    return re.sub(rf"\b({'|'.join(names)})\b", rf"\1_{mark}", sql)


SKEW_SQL, SLANT_SQL = (search_sql(*a).rsplit("\nSELECT", 1)[0] for a in (
    (R.SKEW, 1.0, "y + CASE WHEN tan < 0 THEN pad ELSE 0 END - floor(tan * x + 0.5)::INT", "h + pad + 1", "ceil(abs(tan) * w)::INT", ""),
    (R.SLANT, 2.0, "x + floor(tan * y + 0.5)::INT + pad", "w + 2 * pad - 1", "ceil(abs(tan) * h)::INT + 2", "-")))
SAUVOLA_ONLY, RULES_ONLY = SAUVOLA[len(C.PAGE_PIXELS) + 1:], RULES[len(RULED) + 1:]
TURN = """
pgs AS (SELECT DISTINCT p.scan_id, w, h, radians(coalesce(deg, -8)::DOUBLE) AS t, coalesce(deg, -8)::DOUBLE AS deg FROM pixels p LEFT JOIN fin_b USING (scan_id)),
pgt AS (SELECT *, cos(a) AS c, sin(a) AS s, ceil(abs(w * cos(a)) + abs(h * sin(a)))::INT AS nw, ceil(abs(w * sin(a)) + abs(h * cos(a)))::INT AS nh
  FROM (SELECT *, CASE WHEN abs(t) < 0.0001 THEN 0 ELSE t END::DOUBLE AS a FROM pgs)),
tgt AS (SELECT *, CASE WHEN a = 0 THEN x ELSE c * (x - nw / 2.0::DOUBLE) + s * (y - nh / 2.0::DOUBLE) + w / 2.0::DOUBLE END AS sx,
    CASE WHEN a = 0 THEN y ELSE -s * (x - nw / 2.0::DOUBLE) + c * (y - nh / 2.0::DOUBLE) + h / 2.0::DOUBLE END AS sy
  FROM (SELECT *, unnest(range(nw))::INT AS x FROM (SELECT *, unnest(range(nh))::INT AS y FROM pgt))),
src AS (SELECT *, floor(sx)::INT AS ix, floor(sy)::INT AS iy, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM tgt),
pixels_c AS (SELECT t.scan_id, nw AS w, nh AS h, t.y, t.x, CASE WHEN a = 0 THEN p.gray WHEN sx < 0 OR sy < 0 OR sx >= t.w - 1 OR sy >= t.h - 1 THEN 255
    ELSE round_even(p.gray * (1 - fx) * (1 - fy) + q.gray * fx * (1 - fy) + u.gray * (1 - fx) * fy + v.gray * fx * fy, 0)::INT END AS gray
  FROM src t LEFT JOIN pixels p ON p.scan_id = t.scan_id AND p.y = iy AND p.x = ix LEFT JOIN pixels q ON q.scan_id = t.scan_id AND q.y = iy AND q.x = ix + 1
  LEFT JOIN pixels u ON u.scan_id = t.scan_id AND u.y = iy + 1 AND u.x = ix LEFT JOIN pixels v ON v.scan_id = t.scan_id AND v.y = iy + 1 AND v.x = ix + 1)"""
# the pages are below the analysis size, so nothing is shrunk
PREPROCESS = f"""WITH RECURSIVE {C.PAGE_PIXELS}, pixels_a AS (SELECT * FROM pixels), {again(SAUVOLA_ONLY, 'a')},
ink_a AS (SELECT * FROM sauv_a), {again(DESPECKLE, 'a')}, ink_b AS (SELECT scan_id, w, h, y, unnest(range(x0, x1))::INT AS x FROM desp_a), {again(SKEW_SQL, 'b')}, {TURN},
{again(SAUVOLA_ONLY, 'c')}, ink_c AS (SELECT * FROM sauv_c), {again(RULES_ONLY, 'c')}, ink_d AS (SELECT scan_id, w, h, y, x FROM dm_c WHERE NOT doomed),
{again(DESPECKLE, 'd')}, ink_e AS (SELECT scan_id, w, h, y, unnest(range(x0, x1))::INT AS x FROM desp_d), {again(SLANT_SQL, 'e')}
SELECT g.scan_id, round(g.deg, 6) + 0.0 AS angle_deg, round(-coalesce(fin_e.deg, -32), 6) + 0.0 AS slant, coalesce(n, 0)::BIGINT AS n,
  round(coalesce(n, 0) / (nw::DOUBLE * nh), 6) AS ratio, coalesce(rules, 0) AS rules, coalesce(removed, 0) AS removed
FROM pgt g LEFT JOIN fin_e USING (scan_id) LEFT JOIN (SELECT scan_id, count(*) AS n FROM ink_e GROUP BY 1) USING (scan_id)
LEFT JOIN (SELECT scan_id, count(*) FILTER (WHERE lh AND x = h0) + count(*) FILTER (WHERE lv AND y = v0) AS rules, count(*) FILTER (WHERE doomed) AS removed FROM dm_c GROUP BY 1) USING (scan_id)"""


@query("preprocess", PREPROCESS)
def preprocess(spark, sf):
    """R13 from images: decoded, shrunk, straightened and cleaned; angle, slant, ink and rules of every page."""
    stages = Stages(spark, "preprocess")
    info = P.preprocess(stages.put("lines", lambda: P.gray_lines(A.sheet_images(spark, sf))), stages.put)[1]
    stages.finish(keep=["info"])
    return info.select("scan_id", r6(F.col("angle_deg")).alias("angle_deg"), r6(F.col("slant")).alias("slant"), F.col("n").cast("bigint").alias("n"),
                       r6(F.col("ratio")).alias("ratio"), "rules", "removed")


STROKES = """st AS (SELECT vec_id AS glyph_id, list_transform(range(0, len(e), 2), lambda i: {'x': 4 + 24 * (e[i + 1] - lo) / (hi - lo),
    'y': 4 + 24 * (e[i + 2] - lo) / (hi - lo), 'r': 1 + (i % 3) * 0.3::DOUBLE}) AS p
  FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)),
sg AS (SELECT glyph_id, p[i] AS a, p[i + 1] AS b FROM (SELECT *, unnest(range(1, len(p))) AS i FROM st)),
sn AS (SELECT *, greatest(1, ceil(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) / 0.6::DOUBLE))::INT AS n FROM sg),
ds AS (SELECT glyph_id, a.x + (b.x - a.x) * (k / n::DOUBLE) AS cx, a.y + (b.y - a.y) * (k / n::DOUBLE) AS cy, a.r + (b.r - a.r) * (k / n::DOUBLE) AS r
  FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM sn)),
pxs AS (SELECT glyph_id, y, x, least(1, greatest(0, r + 0.5::DOUBLE - sqrt(power(x + 0.5::DOUBLE - cx, 2) + power(y + 0.5::DOUBLE - cy, 2)))) AS cov
  FROM (SELECT *, unnest(range(greatest(0, floor(cx - r - 0.5)::INT), least(31, ceil(cx + r + 0.5)::INT) + 1)) AS x FROM
    (SELECT *, unnest(range(greatest(0, floor(cy - r - 0.5)::INT), least(31, ceil(cy + r + 0.5)::INT) + 1)) AS y FROM ds))),
cv AS (SELECT glyph_id, y, x, max(cov) AS cov FROM pxs WHERE cov > 0 GROUP BY ALL)"""


def strokes(spark, sf):
    """One pen stroke per embedding on a 32 x 32 pad, through a point for every two components."""
    e = A.table(spark, sf, "embeddings").selectExpr(
        "vec_id AS glyph_id", "transform(embedding, v -> cast(v AS double)) AS e").selectExpr(
        "*", "array_min(e) AS lo", "array_max(e) AS hi")
    return e.selectExpr(
        "glyph_id", "32 AS width", "32 AS height", "transform(sequence(0, size(e) - 2, 2), i -> named_struct('x', 4 + 24 * (e[i] - lo) / (hi - lo),"
        " 'y', 4 + 24 * (e[i + 1] - lo) / (hi - lo), 'r', 1 + (i % 3) * 0.3D)) AS points")


@query("stroke_raster", f"WITH {STROKES} SELECT glyph_id, y::INT AS y, x::INT AS x, round(cov, 6) AS cov FROM cv WHERE cov >= 0.000001::DOUBLE")
def stroke_raster(spark, sf):
    c = R.stroke_raster(strokes(spark, sf)).where("cov >= 0.000001D")
    return c.select("glyph_id", "y", "x", r6(F.col("cov")).alias("cov"))


@query("drawn_glyphs", f"""WITH {STROKES}
SELECT glyph_id, min(x)::INT AS x0, min(y)::INT AS y0, (max(x) + 1)::INT AS x1, (max(y) + 1)::INT AS y1, count(*) AS area,
  (max(x) - min(x) + 5)::INT AS w, (max(y) - min(y) + 5)::INT AS h FROM cv WHERE cov >= 0.5 GROUP BY glyph_id""")
def drawn_glyphs(spark, sf):
    return R.drawn_glyphs(R.stroke_raster(strokes(spark, sf)))
