"""Queries of the quality report, over glyph observations and 8x8 glyph images."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillwork.functions import dims
from quillwork.functions.num import r6
from quillwork.functions.shuffle import held
from quillwork.operators import health as H
from quillwork.operators import metrics as M
from quillwork.plans import ctes as C
from quillwork.plans.metrics import SOLVED, solved_rows
from quillwork.plans.registry import query
from quillwork.sources import adapters as A
from quillwork.stages import Stages

SMALL = ", ".join("'" + c.replace("'", "''") + "'" for c in dims.SMALL_MARKS)
# ink area of an observed glyph: its box, thinned where the quantity is lowest
AREAS = C.OBS + """,
areas AS (SELECT font_id, o, ch, w * (y1 - y0) / CASE WHEN o[4] = 1 THEN 40 ELSE 1 END AS area FROM obs)"""
NORM = SOLVED + """,
norm AS (SELECT obs.font_id, o, ch, zone, (baseline - y0) * scale - (baseline - y1) * scale AS height
  FROM obs JOIN solved USING (font_id, rw))"""
# pen width: 4 to 8 px, thrice that where the supplier number ends in 7
WIDTHS = C.OBS + """,
widths AS (SELECT font_id, o, ch, (4 + o[2] % 5) * CASE WHEN o[3] % 10 = 7 THEN 3 ELSE 1 END::DOUBLE AS t FROM obs),
wt AS (SELECT * FROM widths WHERE ch NOT IN (""" + SMALL + """)),
wm AS (SELECT font_id, median(t) AS mid FROM wt GROUP BY font_id),
odd AS (SELECT wt.*, row_number() OVER (PARTITION BY font_id ORDER BY o) AS k, count(*) OVER (PARTITION BY font_id) AS n
  FROM wt JOIN wm USING (font_id) WHERE t > mid * 1.8::DOUBLE OR t < mid * 0.5::DOUBLE)"""
MISSING = C.OBS + "," + C.SHEETS + """,
have AS (SELECT DISTINCT font_id, ch FROM obs),
tried AS (SELECT DISTINCT font_id, sheet_no FROM obs),
need AS (SELECT f.font_id, c.ord, c.ch, c.grp, s.sheet_no FROM (SELECT DISTINCT font_id FROM obs) f, charset c
  JOIN sheets s ON s.ch = c.ch AND s.sheet_no < 14 WHERE c.kind = 'required'),
missing AS (SELECT n.font_id, n.ord, n.ch, CASE WHEN t.font_id IS NULL THEN 'not-written'
    WHEN grp IN ('lower', 'upper') THEN 'missing-letters' ELSE 'missing-symbols' END AS code
  FROM need n LEFT JOIN tried t ON t.font_id = n.font_id AND t.sheet_no = n.sheet_no
  WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.font_id = n.font_id AND h.ch = n.ch))"""
SIG = C.SCANS + """,
px AS (SELECT scan_id AS glyph_id, i // 8 AS y, i % 8 AS x, gray[i + 1] < 128 AS ink FROM scans, range(64) r(i)),
bx AS (SELECT glyph_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM px WHERE ink GROUP BY glyph_id),
sig AS (SELECT glyph_id, (least(13, floor((y - y0) / (y1 - y0)::DOUBLE * 14)) * 14
    + least(13, floor((x - x0) / (x1 - x0)::DOUBLE * 14)))::INT AS cell,
    count(*) FILTER (WHERE ink) / count(*)::DOUBLE AS share
  FROM px JOIN bx USING (glyph_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL)"""
# the same sum written set-wise: sum |u-v| = sum u + sum v - 2 sum min(u, v) over shared cells
# pens too broad for the 8x8 raster: ink is decided on 4 x 2 px blocks
COARSE = SIG.replace("gray[i + 1] < 128 AS ink",
                     "avg(gray[i + 1]) OVER (PARTITION BY scan_id, i // 16, (i % 8) // 4) < 128 AS ink")
LOOK = COARSE + "," + C.CHARSET + """,
lg AS (SELECT scan_id AS glyph_id, scan_id // 62 AS font_id, c.ord, c.ch FROM scans
  JOIN charset c ON c.ord = scan_id % 62),
tot AS (SELECT glyph_id, sum(share) AS s FROM sig GROUP BY glyph_id),
com AS (SELECT u.glyph_id AS ga, v.glyph_id AS gb, sum(least(u.share, v.share)) AS m
  FROM sig u JOIN sig v ON u.cell = v.cell AND u.glyph_id < v.glyph_id AND u.glyph_id // 62 = v.glyph_id // 62 GROUP BY ALL),
look AS (SELECT a.font_id, a.ch AS a, b.ch AS b, a.ord AS a_ord, b.ord AS b_ord,
    1 - (ta.s + tb.s - 2 * coalesce(m, 0)) / 196 AS similarity
  FROM lg a JOIN lg b ON a.font_id = b.font_id AND a.ord < b.ord AND lower(a.ch) <> lower(b.ch)
  JOIN tot ta ON ta.glyph_id = a.glyph_id JOIN tot tb ON tb.glyph_id = b.glyph_id
  LEFT JOIN com ON ga = a.glyph_id AND gb = b.glyph_id)"""
EDGE = C.SCANS + """,
ik AS (SELECT scan_id AS glyph_id, i // 8 AS y, i % 8 AS x FROM scans, range(64) r(i) WHERE gray[i + 1] < 128),
ed AS (SELECT a.glyph_id, a.y, a.x, count(b.x) AS n FROM ik a LEFT JOIN ik b
  ON a.glyph_id = b.glyph_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL)"""


def _obs(spark, sf):
    return A.glyph_observations(spark, sf)


def areas(spark, sf):
    return _obs(spark, sf).selectExpr(
        "font_id", "o", "ch", "w * (y1 - y0) / CASE WHEN o.q = 1 THEN 40D ELSE 1D END AS area")


def heights(spark, sf, solved=None):
    solved = solved_rows(spark, sf) if solved is None else solved
    g = _obs(spark, sf).join(solved.select("font_id", "rw", "baseline", "scale"), ["font_id", "rw"])
    return g.selectExpr("font_id", "o", "ch", "zone", "(baseline - y0) * scale - (baseline - y1) * scale AS height")


def pen_widths(spark, sf):
    return _obs(spark, sf).selectExpr(
        "font_id", "o", "ch", "(4 + o.part % 5) * CASE WHEN o.supp % 10 = 7 THEN 3D ELSE 1D END AS t")


def _ink(spark, sf):
    return A.scan_pixels(spark, sf).selectExpr("scan_id AS glyph_id", "y", "x", "gray < 128 AS ink")


def _coarse_ink(spark, sf):
    block = W.partitionBy("scan_id", F.expr("y div 2"), F.expr("x div 4"))
    return A.scan_pixels(spark, sf).select(
        F.col("scan_id").alias("glyph_id"), "y", "x", (F.avg("gray").over(block) < 128).alias("ink"))


def _letters(spark, sf):
    """Glyph images as letters and digits: 62 of them to a font."""
    cs = dims.required(spark).select("ord", "ch", "grp")
    return A.table(spark, sf, "embeddings").selectExpr(
        "vec_id AS glyph_id", "vec_id div 62 AS font_id", "cast(vec_id % 62 AS int) AS ord").join(cs, "ord")


@query("resolution", f"""WITH {SOLVED},
r AS (SELECT font_id, floor(median(x_height) + 0.5)::INT AS x_height_px, floor(median(scale) + 0.5)::INT AS units_per_pixel
  FROM solved WHERE x_height > 0 AND scale > 0 GROUP BY font_id)
SELECT *, CASE WHEN units_per_pixel > 20 THEN 'warn' WHEN units_per_pixel > 12 THEN 'info' END AS level FROM r""")
def resolution(spark, sf):
    return H.resolution(solved_rows(spark, sf))


@query("missing_chars", f"WITH {MISSING} SELECT * FROM missing")
def missing_chars(spark, sf):
    g = _obs(spark, sf)
    return H.missing_chars(g, g, spark)


@query("faint", f"""WITH {AREAS}
SELECT a.font_id, a.o[2] AS part, a.ch, a.area FROM areas a JOIN (SELECT font_id, median(area) AS mid FROM areas WHERE area > 0 GROUP BY 1) m
  USING (font_id) WHERE area < mid * 0.06::DOUBLE AND ch NOT IN ({SMALL})""")
def faint(spark, sf):
    return H.faint(areas(spark, sf)).select("font_id", F.col("o.part").alias("part"), "ch", "area")


@query("size_outlier", f"""WITH {NORM},
m AS (SELECT font_id, zone, median(height) AS mid FROM norm WHERE zone NOT IN ('full', 'mid') GROUP BY ALL HAVING count(*) >= 4)
SELECT font_id, zone, o[2] AS part, ch, round(height, 6) AS height, round(height / mid, 6) AS ratio
FROM norm JOIN m USING (font_id, zone) WHERE height / mid > 1.5 OR height / mid < 0.6::DOUBLE""")
def size_outlier(spark, sf):
    return H.size_outlier(heights(spark, sf)).select(
        "font_id", "zone", F.col("o.part").alias("part"), "ch",
        r6(F.col("height")).alias("height"), r6(F.col("ratio")).alias("ratio"))


@query("stroke_weight", f"WITH {WIDTHS} SELECT font_id, k, ch, n FROM odd WHERE k <= 8 AND n > 2")
def stroke_weight(spark, sf):
    return H.stroke_weight(pen_widths(spark, sf)).select("font_id", "k", "ch", "n")


@query("row_confidence", f"WITH {SOLVED} SELECT font_id, rw FROM solved WHERE NOT confident")
def row_confidence(spark, sf):
    return solved_rows(spark, sf).where("NOT confident").select("font_id", "rw")


def slants(spark, sf):
    """A natural slant per scan: line discount and tax as degrees either side of upright."""
    return A.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 30 AS font_id", "l_discount * 100 - l_tax * 50 AS slant")


SLANT = """sl AS (SELECT l_orderkey // 30 AS font_id, median(l_discount * 100 - l_tax * 50) AS slant FROM lineitem GROUP BY 1)"""


def font_slant(spark, sf):
    return slants(spark, sf).groupBy("font_id").agg(F.median("slant").alias("slant"))


@query("lean", f"""WITH {SLANT}
SELECT font_id, round(slant, 6) + 0.0 AS slant, CASE WHEN slant > 0 THEN 'forwards' ELSE 'backwards' END AS direction
FROM sl WHERE abs(slant) > 4""")
def lean(spark, sf):
    s = font_slant(spark, sf).where(F.abs("slant") > H.LEAN_DEG)
    return s.select("font_id", r6(F.col("slant")).alias("slant"),
                    F.when(F.col("slant") > 0, "forwards").otherwise("backwards").alias("direction"))


@query("signature", f"WITH {SIG} SELECT glyph_id, cell, round(share, 6) AS share FROM sig")
def signature(spark, sf):
    return H.signature(_ink(spark, sf)).select("glyph_id", "cell", r6(F.col("share")).alias("share"))


def look_pairs(spark, sf, above=H.SIMILAR):
    return H.lookalikes(_letters(spark, sf), H.signature_vectors(H.signature(_coarse_ink(spark, sf))), above)


@query("lookalikes", f"""WITH {LOOK}
SELECT font_id, a, b, round(similarity, 6) AS similarity FROM look WHERE similarity > 0.93::DOUBLE""")
def lookalikes(spark, sf):
    return look_pairs(spark, sf).select("font_id", "a", "b", r6(F.col("similarity")).alias("similarity"))


@query("closest_pairs", f"""WITH {LOOK},
rk AS (SELECT *, row_number() OVER (PARTITION BY font_id ORDER BY round(similarity, 9) DESC, a_ord, b_ord) AS k FROM look)
SELECT font_id, k, a, b, round(similarity, 6) AS similarity FROM rk WHERE k <= 4""")
def closest_pairs(spark, sf):
    """The ranking step of the look-alike check with the threshold lowered to show every font."""
    pairs = look_pairs(spark, sf, -1.0)
    top = H.top_lookalikes(pairs.withColumn("similarity", F.round("similarity", 9)))
    return top.select("font_id", "k", "a", "b", r6(F.col("similarity")).alias("similarity"))


@query("stroke_width", f"""WITH {EDGE}
SELECT glyph_id, count(*) AS area, count(*) FILTER (WHERE n < 4) AS perimeter,
  round(2.0::DOUBLE * count(*) / count(*) FILTER (WHERE n < 4), 6) AS stroke_width FROM ed GROUP BY glyph_id""")
def stroke_width(spark, sf):
    return H.stroke_width(_ink(spark, sf).where("ink").drop("ink")).select(
        "glyph_id", "area", "perimeter", r6(F.col("stroke_width")).alias("stroke_width"))


FINDINGS = SOLVED + "," + AREAS.split(C.OBS + ",", 1)[1] + "," + NORM.split(SOLVED + ",", 1)[1] + "," \
    + WIDTHS.split(C.OBS + ",", 1)[1] + "," + MISSING.split(C.OBS + ",", 1)[1] + "," + SLANT + "," + LOOK.replace("," + C.CHARSET, "") + """,
lk AS (SELECT *, row_number() OVER (PARTITION BY font_id ORDER BY round(similarity, 9) DESC, a_ord, b_ord) AS k FROM look WHERE similarity > 0.93::DOUBLE),
fd AS (
  SELECT font_id, 0 AS rank, CASE WHEN floor(median(scale) + 0.5) > 20 THEN 'warn' ELSE 'info' END AS level,
    'low-resolution' AS code, 0 AS n FROM solved WHERE x_height > 0 GROUP BY font_id HAVING floor(median(scale) + 0.5) > 12
  UNION ALL SELECT font_id, CASE code WHEN 'missing-letters' THEN 1 WHEN 'missing-symbols' THEN 2 ELSE 3 END,
    CASE code WHEN 'missing-letters' THEN 'error' WHEN 'missing-symbols' THEN 'warn' ELSE 'info' END, code, count(*)
    FROM missing GROUP BY font_id, code
  UNION ALL SELECT a.font_id, 4, 'warn', 'faint', count(*) FROM areas a
    JOIN (SELECT font_id, median(area) AS mid FROM areas WHERE area > 0 GROUP BY 1) m USING (font_id)
    WHERE area < mid * 0.06::DOUBLE AND ch NOT IN (""" + SMALL + """) GROUP BY 1
  UNION ALL SELECT font_id, 5, 'warn', 'lookalike', count(DISTINCT ch) FROM (SELECT font_id, unnest([a, b]) AS ch FROM lk WHERE k <= 4) GROUP BY 1
  UNION ALL SELECT n.font_id, 6, 'warn', 'size-outlier', count(*) FROM norm n JOIN (SELECT font_id, zone, median(height) AS mid
    FROM norm WHERE zone NOT IN ('full', 'mid') GROUP BY ALL HAVING count(*) >= 4) m ON m.font_id = n.font_id AND m.zone = n.zone
    WHERE height / mid > 1.5 OR height / mid < 0.6::DOUBLE GROUP BY 1
  UNION ALL SELECT font_id, 7, 'info', 'stroke-weight', count(*) FROM odd WHERE k <= 8 AND n > 2 GROUP BY 1
  UNION ALL SELECT font_id, 8, 'info', 'row-confidence', count(*) FROM solved WHERE NOT confident GROUP BY 1
  UNION ALL SELECT font_id, 9, 'info', 'slant', 0 FROM sl WHERE abs(slant) > 4),
ct AS (SELECT font_id, count(DISTINCT ch) AS captured FROM obs GROUP BY 1),
ex AS (SELECT t.font_id, count(*) AS expected FROM tried t JOIN sheets s ON s.sheet_no = t.sheet_no GROUP BY 1),
sc AS (SELECT ct.font_id, captured, expected, greatest(0, least(100, 100
    - coalesce((SELECT sum(CASE level WHEN 'error' THEN 12 + 2 * n WHEN 'warn' THEN 5 + least(8, n) ELSE 1 END) FROM fd
        WHERE fd.font_id = ct.font_id), 0)
    - floor((1 - least(1, captured / expected::DOUBLE)) * 25 + 0.5)))::INT AS score
  FROM ct JOIN ex USING (font_id))"""


def reported(spark, sf):
    """H13, one row a font. Observations are read once and stored by row of writing; the images are read once, slants once."""
    st = Stages(spark, "report")
    glyph = F.expr("struct(ch, zone, y0, y1, w * (y1 - y0) / CASE WHEN o.q = 1 THEN 40D ELSE 1D END AS area,"
                   " (4 + o.part % 5) * CASE WHEN o.supp % 10 = 7 THEN 3D ELSE 1D END AS t)")
    rows = st.put("rows", lambda: M.row_metrics(_obs(spark, sf), glyph))
    solved = st.put("solved", lambda: M.solved_from(rows))
    # pens too broad for the 8x8 raster: ink is decided on blocks of 4 x 2 px, i div 16 and i % 8 div 4
    images = held(A.scan_arrays(spark, sf).withColumnRenamed("gray", "levels"), gray="levels")
    images = held(images, blocks="transform(sequence(0, 7), b -> aggregate(sequence(0, 7), 0, (a, k) -> a + gray[b div 2 * 16 + k div 4 * 8 + b % 2 * 4 + k % 4]))")
    images = images.selectExpr("scan_id AS glyph_id", "w", "transform(sequence(0, 63), i -> blocks[i div 16 * 2 + i % 8 div 4] / 8D < 128) AS ink")
    alike = H.alike_chars(_letters(spark, sf), H.box_vectors(images))
    out = st.put("report", lambda: H.report(H.measures(solved), alike, font_slant(spark, sf)))
    st.finish(keep=["report"])
    return out


@query("health_report", f"WITH {FINDINGS} SELECT font_id, rank, level, code, n FROM fd")
def health_report(spark, sf):
    return reported(spark, sf).select("font_id", F.explode("findings").alias("f")).select("font_id", "f.*")


@query("health_score", f"""WITH {FINDINGS}
SELECT font_id, captured, expected, score, CASE WHEN score >= 92 THEN 'Excellent' WHEN score >= 78 THEN 'Good'
  WHEN score >= 60 THEN 'Usable' ELSE 'Needs work' END AS label FROM sc""")
def health_score(spark, sf):
    return reported(spark, sf).drop("findings")


@query("score_label", f"""WITH {FINDINGS}
SELECT CASE WHEN score >= 92 THEN 'Excellent' WHEN score >= 78 THEN 'Good' WHEN score >= 60 THEN 'Usable'
  ELSE 'Needs work' END AS label, count(*) AS fonts, min(score) AS lowest, max(score) AS highest FROM sc GROUP BY 1""")
def score_label(spark, sf):
    return reported(spark, sf).groupBy("label").agg(
        F.count("*").alias("fonts"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


@query("audit_sheets", f"""WITH {C.CHARSET}, {C.SHEETS},
used AS (SELECT c.ch, count(*) AS n FROM lineitem JOIN charset c ON c.ord = l_partkey % 112 GROUP BY 1)
SELECT u.ch, u.n, (SELECT count(*) FROM sheets s WHERE s.ch = u.ch AND s.sheet_no < 14) AS cells,
  (SELECT count(*) FROM charset c WHERE c.ch = u.ch AND c.kind = 'required') AS entries FROM used u""")
def audit_sheets(spark, sf):
    """How often each observed character is laid out (1 is right, 0 missing, 2 duplicated)."""
    used = _obs(spark, sf).groupBy("ch").agg(F.count("*").alias("n"))
    cells = dims.sheets(spark, ligatures=False).groupBy("ch").agg(F.count("*").alias("cells"))
    entries = dims.required(spark).groupBy("ch").agg(F.count("*").alias("entries"))
    return used.join(F.broadcast(cells), "ch", "left").join(F.broadcast(entries), "ch", "left").na.fill(0)


@query("layout_audit", f"""WITH {C.CHARSET},
ly AS (SELECT p_partkey // 112 AS layout_id, c.ch FROM part JOIN charset c ON c.ord = (p_partkey + p_size) % 138),
rq AS (SELECT ch FROM charset WHERE kind = 'required'), n AS (SELECT layout_id, ch, count(*) AS cells FROM ly GROUP BY ALL),
du AS (SELECT l.layout_id, rq.ch FROM (SELECT DISTINCT layout_id FROM ly) l, rq)
SELECT coalesce(du.layout_id, n.layout_id) AS layout_id, coalesce(du.ch, n.ch) AS ch, coalesce(cells, 0) AS cells,
  CASE WHEN du.ch IS NULL THEN 'unknown' WHEN cells IS NULL THEN 'missing' WHEN cells > 1 THEN 'duplicated' ELSE 'ok' END AS verdict
FROM du FULL JOIN n ON n.layout_id = du.layout_id AND n.ch = du.ch""")
def layout_audit(spark, sf):
    """H14 over layouts of 112 parts each, which repeat, lack and make up characters."""
    cells = A.table(spark, sf, "part").selectExpr("p_partkey div 112 AS layout_id", "cast((p_partkey + p_size) % 138 AS int) AS ord")
    return H.audit(cells.join(dims.charset(spark).select("ord", "ch"), "ord"), dims.required(spark))


@query("shown_chars", f"""WITH {C.OBS}, {C.SHEETS}
SELECT font_id, s.sheet_no, string_agg(s.ch, '' ORDER BY s.k) AS shown
FROM (SELECT DISTINCT font_id, ch FROM obs) h JOIN sheets s ON s.ch = h.ch AND s.sheet_no < 14 GROUP BY ALL""")
def shown_chars(spark, sf):
    """A sheet's characters that were captured, in sheet order (at most one sheet's worth)."""
    s = dims.sheets(spark, ligatures=False).select("ch", "sheet_no", "k")
    have = _obs(spark, sf).select("font_id", "ch").distinct().join(s, "ch")
    return have.groupBy("font_id", "sheet_no").agg(F.sort_array(F.collect_list(F.struct("k", "ch"))).alias("a")).selectExpr(
        "font_id", "sheet_no", "concat_ws('', transform(a, e -> e.ch)) AS shown")
