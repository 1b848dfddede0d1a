"""Queries over baselines, spacing and kerning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.num import r6
from quillwork.operators import metrics as M
from quillwork.plans import ctes as C
from quillwork.plans.registry import query
from quillwork.sources import adapters as A

ROWS = C.OBS + """,
rm0 AS (SELECT font_id, rw,
    median(y1) FILTER (WHERE zone IN ('x', 'asc')) AS b, median(y0) FILTER (WHERE zone IN ('x', 'desc')) AS x,
    median(y0) FILTER (WHERE zone IN ('asc', 'full')) AS a, median(y1) FILTER (WHERE zone IN ('desc', 'full')) AS d,
    count(*) FILTER (WHERE zone IN ('x', 'asc')) AS n_b, count(*) FILTER (WHERE zone IN ('x', 'desc')) AS n_x,
    count(*) FILTER (WHERE zone IN ('asc', 'full')) AS n_a, count(*) FILTER (WHERE zone IN ('desc', 'full')) AS n_d,
    bool_or(stated) AS stated, any_value(base) AS base, any_value(sheet_no) AS sheet_no,
    median(y1) AS mid_bottom, median(y1 - y0) AS mid_height
  FROM obs GROUP BY font_id, rw),
rm AS (SELECT font_id, rw, sheet_no,
    CASE WHEN stated THEN base ELSE b END AS baseline, CASE WHEN stated THEN base - 100 ELSE x END AS x_line,
    CASE WHEN stated THEN base - 180 ELSE a END AS asc_line, CASE WHEN stated THEN base + 60 ELSE d END AS desc_line,
    CASE WHEN stated THEN 100 ELSE b - x END AS x_height, CASE WHEN stated THEN 180 ELSE b - a END AS asc_height,
    CASE WHEN stated THEN 60 ELSE d - b END AS desc_depth,
    CASE WHEN stated THEN 9223372036854775807 ELSE n_b END AS n_b, CASE WHEN stated THEN 9223372036854775807 ELSE n_x END AS n_x,
    CASE WHEN stated THEN 9223372036854775807 ELSE n_a END AS n_a, CASE WHEN stated THEN 9223372036854775807 ELSE n_d END AS n_d,
    mid_bottom, mid_height FROM rm0)"""
SOLVED = ROWS + """,
gs AS (SELECT font_id, sheet_no, median(x_height) FILTER (WHERE x_height > 0) AS sheet_x FROM rm GROUP BY ALL),
gf AS (SELECT font_id, median(x_height) FILTER (WHERE x_height > 0) AS font_x,
    median(asc_height) FILTER (WHERE asc_height > 0) AS font_asc FROM rm GROUP BY ALL),
sv0 AS (SELECT rm.*, font_asc, CASE WHEN x_height > 0 THEN x_height WHEN asc_height > 0 THEN asc_height * 0.54::DOUBLE
      WHEN sheet_x > 0 THEN sheet_x WHEN font_x > 0 THEN font_x ELSE mid_height * 0.6::DOUBLE END AS xh
    FROM rm LEFT JOIN gs USING (font_id, sheet_no) LEFT JOIN gf USING (font_id)),
solved AS (SELECT font_id, rw, sheet_no, coalesce(baseline, mid_bottom - xh * 0.46::DOUBLE * 0.5) AS baseline,
    xh::DOUBLE AS x_height, 500 / xh::DOUBLE AS scale, n_b >= 3 AS confident,
    CASE WHEN asc_height > 0 THEN asc_height ELSE coalesce(font_asc, xh / 0.54::DOUBLE) END AS asc_height,
    CASE WHEN desc_depth > 0 THEN desc_depth ELSE xh * 0.46::DOUBLE END AS desc_depth FROM sv0)"""
EXTENT = """
extent AS (SELECT font_id, greatest(max(y1), 700::DOUBLE) AS ascender, least(min(y0), -150::DOUBLE) AS descender
  FROM shapes GROUP BY font_id)"""
SPACED = C.PROFILES + "," + EXTENT + """,
wts AS (SELECT p.*, CASE WHEN y >= 0 AND y <= 500 THEN 1::DOUBLE
     WHEN y > 500 THEN greatest(0.25::DOUBLE, 1 - 0.75::DOUBLE * least(1::DOUBLE, (y - 500) / greatest(1::DOUBLE, ascender - 500)))
     ELSE greatest(0.2::DOUBLE, 1 - 0.8::DOUBLE * least(1::DOUBLE, -y / greatest(1::DOUBLE, -descender))) END AS wt
   FROM profiles p JOIN extent USING (font_id)),
margins AS (SELECT glyph_id, font_id, ord, ch, width,
     sum(least(lft, 210::DOUBLE) * wt) / sum(wt) AS perceived_left,
     sum(least(width - rgt, 210::DOUBLE) * wt) / sum(wt) AS perceived_right FROM wts GROUP BY ALL),
spaced0 AS (SELECT *, greatest(-40::DOUBLE, 150 - perceived_left) AS lsb, greatest(-40::DOUBLE, 150 - perceived_right) AS rsb
   FROM margins),
spaced AS (SELECT *, greatest(1::DOUBLE, lsb + width + rsb) AS advance FROM spaced0)"""
GRID = SPACED + """,
grid AS (SELECT font_id, g, descender + g * 12 AS gy FROM extent, range(200) r(g) WHERE descender + g * 12 <= ascender),
near AS (SELECT glyph_id, font_id, g, arg_min(row(lft, rgt), row(abs(y - gy), i)) AS v
   FROM profiles JOIN grid USING (font_id) WHERE abs(y - gy) <= 14 GROUP BY ALL)"""
KERN = GRID + """,
cells AS (SELECT n.font_id, g, s.ch, s.ord, s.lsb, s.advance, v[1] AS lft, v[2] AS rgt
   FROM near n JOIN spaced s USING (glyph_id)),
gaps AS (SELECT a.font_id, a.ch AS left_ch, b.ch AS right_ch, a.ord AS left_ord, b.ord AS right_ord,
     min(a.advance + b.lsb + b.lft - a.lsb - a.rgt) AS gap
   FROM cells a JOIN cells b ON a.font_id = b.font_id AND a.g = b.g GROUP BY ALL HAVING count(*) >= 3),
kref AS (SELECT font_id, CASE WHEN count(*) FILTER (WHERE lo) >= 24 THEN median(gap) FILTER (WHERE lo)
     ELSE median(gap) END AS ref
   FROM (SELECT *, left_ch BETWEEN 'a' AND 'z' AND right_ch BETWEEN 'a' AND 'z' AS lo FROM gaps) GROUP BY font_id),
kern AS (SELECT font_id, left_ch, right_ch, left_ord, right_ord,
     floor(greatest(-220::DOUBLE, least(220::DOUBLE, round((ref - gap) * 0.7::DOUBLE, 9))) + 0.5)::INT AS value
   FROM gaps JOIN kref USING (font_id) WHERE abs(round((ref - gap) * 0.7::DOUBLE, 9)) >= 14)"""


@query("row_metrics", f"""WITH {ROWS}
SELECT font_id, rw, sheet_no::BIGINT AS sheet_no, baseline::DOUBLE AS baseline, x_line::DOUBLE AS x_line,
  asc_line::DOUBLE AS asc_line, desc_line::DOUBLE AS desc_line, x_height::DOUBLE AS x_height,
  asc_height::DOUBLE AS asc_height, desc_depth::DOUBLE AS desc_depth, n_b, n_x, n_a, n_d FROM rm""")
def row_metrics(spark, sf):
    return M.row_metrics(A.glyph_observations(spark, sf)).drop("mid_bottom", "mid_height")


def solved_rows(spark, sf) -> DataFrame:
    return M.solve_rows(M.row_metrics(A.glyph_observations(spark, sf)))


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("solve_rows", f"""WITH {SOLVED}
SELECT font_id, rw, sheet_no, round(baseline, 6) AS baseline, round(x_height, 6) AS x_height,
  round(scale, 6) AS scale, confident, round(asc_height, 6) AS asc_height, round(desc_depth, 6) AS desc_depth
FROM solved""")
def solve_rows(spark, sf):
    return _round(solved_rows(spark, sf))


@query("normalize_glyph", f"""WITH {SOLVED}
SELECT font_id, rw, ch, o[1] AS line, o[2] AS part, round((baseline - y1) * scale, 6) + 0.0 AS ink_y0,
  round((baseline - y0) * scale, 6) + 0.0 AS ink_y1, round(w * scale, 6) AS ink_width
FROM obs JOIN solved USING (font_id, rw)""")
def normalize_glyph(spark, sf):
    g = A.glyph_observations(spark, sf)
    n = M.normalize_boxes(g, M.solve_rows(M.row_metrics(g)))
    return n.select("font_id", "rw", "ch", F.col("o.line").alias("line"), F.col("o.part").alias("part"),
                    *[r6(F.col(c)).alias(c) for c in ("ink_y0", "ink_y1", "ink_width")])


@query("bitmap_profile", f"""WITH {C.SCANS}
SELECT scan_id AS glyph_id, (i // 8)::INT AS line, (300 - (10 + i // 8)) * 5.0::DOUBLE AS y,
  min(i % 8) * 5.0::DOUBLE + 1 AS "left", (max(i % 8) + 1) * 5.0::DOUBLE + 1 AS "right"
FROM scans, range(64) r(i) WHERE gray[i + 1] < 128 GROUP BY scan_id, i // 8""")
def bitmap_profile(spark, sf):
    px = A.scan_pixels(spark, sf).where("gray < 128").selectExpr(
        "scan_id AS glyph_id", "y", "x AS x0", "x + 1 AS x1", "0 AS pad", "10 AS page_y0",
        "300 AS baseline", "5.0D AS scale", "1.0D AS shift")
    return M.bitmap_profile(px)


def shape_extent(spark, sf) -> DataFrame:
    return M.font_extent(A.glyph_shapes(spark, sf))


def shape_spacing(spark, sf) -> DataFrame:
    return M.spacing(M.perceived_margin(A.shape_profiles(spark, sf), shape_extent(spark, sf)))


def shape_kerning(spark, sf) -> DataFrame:
    return M.kerning(shape_gaps(spark, sf))


def shape_gaps(spark, sf) -> DataFrame:
    grid = M.on_grid(A.shape_profiles(spark, sf), shape_extent(spark, sf))
    return M.pair_gaps(shape_spacing(spark, sf), grid)


@query("perceived_margin", f"""WITH {SPACED}
SELECT glyph_id, font_id, ch, round(perceived_left, 6) + 0.0 AS perceived_left,
  round(perceived_right, 6) + 0.0 AS perceived_right FROM margins""")
def perceived_margin(spark, sf):
    m = M.perceived_margin(A.shape_profiles(spark, sf), shape_extent(spark, sf))
    return _round(m.select("glyph_id", "font_id", "ch", "perceived_left", "perceived_right"))


@query("spacing", f"""WITH {SPACED}
SELECT glyph_id, font_id, ch, round(lsb, 6) + 0.0 AS lsb, round(rsb, 6) + 0.0 AS rsb,
  round(advance, 6) + 0.0 AS advance FROM spaced""")
def spacing(spark, sf):
    return _round(shape_spacing(spark, sf).select("glyph_id", "font_id", "ch", "lsb", "rsb", "advance"))


@query("profile_on_grid", f"""WITH {GRID}
SELECT glyph_id, font_id, g, round(v[1], 6) + 0.0 AS "left", round(v[2], 6) + 0.0 AS "right" FROM near""")
def profile_on_grid(spark, sf):
    grid = M.on_grid(A.shape_profiles(spark, sf), shape_extent(spark, sf))
    return _round(grid.selectExpr("glyph_id", "font_id", "posexplode(arrays_zip(left, right)) AS (g, v)")
                  .where("v.left IS NOT NULL").selectExpr(
        "glyph_id", "font_id", "g", "v.left AS left", "v.right AS right"))


@query("kerning", f"""WITH {KERN}
SELECT font_id, left_ch, right_ch, value FROM kern""")
def kerning(spark, sf):
    return shape_kerning(spark, sf).select("font_id", "left_ch", "right_ch", "value")


@query("space_width", f"""WITH {SPACED}
SELECT font_id, floor(coalesce(median(advance) FILTER (WHERE ch IN ('o', 'e', 'a', 'c', 'n')), 450::DOUBLE)
  * 0.62::DOUBLE + 0.5)::INT AS space_width FROM spaced GROUP BY font_id""")
def space_width(spark, sf):
    return M.space_width(shape_spacing(spark, sf))


@query("build_metrics", f"""WITH {KERN},
lk AS (SELECT font_id, left_ch AS ch, count(*) AS kern_left, sum(value)::BIGINT AS kern_sum FROM kern GROUP BY ALL)
SELECT glyph_id, s.font_id, s.ch, round(lsb, 6) + 0.0 AS lsb, round(rsb, 6) + 0.0 AS rsb,
  round(advance, 6) + 0.0 AS advance, coalesce(kern_left, 0) AS kern_left, coalesce(kern_sum, 0) AS kern_sum
FROM spaced s LEFT JOIN lk ON lk.font_id = s.font_id AND lk.ch = s.ch""")
def build_metrics(spark, sf):
    """Spacing and kerning together, one row per glyph."""
    k = shape_kerning(spark, sf).groupBy("font_id", F.col("left_ch").alias("ch")).agg(
        F.count("*").alias("kern_left"), F.sum("value").alias("kern_sum"))
    s = shape_spacing(spark, sf).join(k, ["font_id", "ch"], "left").na.fill(0, ["kern_left", "kern_sum"])
    return _round(s.select("glyph_id", "font_id", "ch", "lsb", "rsb", "advance", "kern_left", "kern_sum"))
