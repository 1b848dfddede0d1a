"""Queries over imported outlines and the families built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.functions.num import r6
from quillwork.functions.shuffle import spread
from quillwork.operators import family as Y
from quillwork.operators import imports as I
from quillwork.operators import metrics as M
from quillwork.operators import outline as T
from quillwork.plans import ctes as C
from quillwork.plans.health import SLANT, slants
from quillwork.plans.metrics import KERN, shape_kerning
from quillwork.plans.registry import query
from quillwork.sources import adapters as A

XY = [f"{n}_{a}" for n in T.ENDS for a in "xy"]
XY_SQL = ", ".join(f"round({n}{a}, 6) + 0.0 AS {n}_{a}" for n in T.ENDS for a in "xy")


def curves_of(o, *keep):
    c = I.exploded(o, *keep)
    return c.select("glyph_id", *keep, "seq", *[r6(F.col(f"{n}.{a}")).alias(f"{n}_{a}") for n in T.ENDS for a in "xy"])


def paths(spark, sf):
    """Imported outlines. The parts are handed out by font while they are small, so that drawing them is not left to the few tasks of a
    small file and what is gathered by font later is there."""
    return I.path_to_cubics(spread(A.font_paths(spark, sf), "font_id"))


def imported(spark, sf):
    g = paths(spark, sf)
    return I.normalise_import(g, I.import_scale(g))


def _rounded(df, *cols):
    return df.select(*cols, *[r6(F.col(c)).alias(c) for c, t in df.dtypes if t == "double"])


@query("path_to_cubics", f"WITH {C.PATHS} SELECT glyph_id, false AS outer_side, seq, {XY_SQL} FROM cv")
def path_to_cubics(spark, sf):
    return curves_of(paths(spark, sf)).withColumn("outer_side", F.lit(False))


@query("outer_contours", f"""WITH {C.PATHS}
SELECT glyph_id, 0 AS contour, count(*) AS n, sum(p0x * p3y - p3x * p0y) > 0 AS is_outer FROM cv GROUP BY glyph_id""")
def outer_contours(spark, sf):
    return I.exploded(paths(spark, sf)).groupBy("glyph_id", "contour").agg(F.count("*").alias("n"), F.max("outer").alias("is_outer"))


@query("import_scale", f"WITH {C.PATHS} SELECT font_id, round(scale, 9) AS scale FROM scl")
def import_scale(spark, sf):
    return I.import_scale(paths(spark, sf)).select("font_id", F.round("scale", 9).alias("scale"))


NUMS = "round(ink_width, 6) AS ink_width, round(ink_y0, 6) + 0.0 AS ink_y0, round(ink_y1, 6) AS ink_y1, round(lsb, 6) AS lsb, round(rsb, 6) AS rsb, round(advance, 6) AS advance"


@query("normalise_import", f"WITH {C.PATHS} SELECT glyph_id, font_id, ch, {NUMS} FROM imp")
def normalise_import(spark, sf):
    return _rounded(imported(spark, sf).drop("curves"), "glyph_id", "font_id", "ch")


@query("outline_bounds", f"""WITH {C.PATHS}, q AS (SELECT glyph_id, unnest([p0x, c1x, c2x, p3x]) AS x, unnest([p0y, c1y, c2y, p3y]) AS y FROM icv)
SELECT glyph_id, round(min(x), 6) + 0.0 AS bx0, round(min(y), 6) + 0.0 AS by0, round(max(x), 6) + 0.0 AS bx1, round(max(y), 6) + 0.0 AS by1 FROM q GROUP BY glyph_id""")
def outline_bounds(spark, sf):
    return _rounded(T.bounds(imported(spark, sf).select("glyph_id", "curves")).drop("curves"), "glyph_id")


FLAT = C.PATHS + """,
hl AS (SELECT *, greatest(2, least(64, ceil((sqrt(power(c1x - p0x, 2) + power(c1y - p0y, 2)) + sqrt(power(c2x - c1x, 2) + power(c2y - c1y, 2)) + sqrt(power(p3x - c2x, 2) + power(p3y - c2y, 2))) / 4)))::INT AS n FROM icv),
fk AS (SELECT *, unnest(range(0, n + 1)) AS k FROM hl), ft AS (SELECT *, k / n::DOUBLE AS t FROM fk),
fl AS (SELECT glyph_id, seq, n, k::INT AS k, CASE WHEN k = 0 THEN p0x ELSE (1 - t) * (1 - t) * (1 - t) * p0x + 3 * (1 - t) * (1 - t) * t * c1x + 3 * (1 - t) * t * t * c2x + t * t * t * p3x END AS x,
   CASE WHEN k = 0 THEN p0y ELSE (1 - t) * (1 - t) * (1 - t) * p0y + 3 * (1 - t) * (1 - t) * t * c1y + 3 * (1 - t) * t * t * c2y + t * t * t * p3y END AS y FROM ft)"""


@query("flatten_cubic", f"WITH {FLAT} SELECT glyph_id, seq, n, k, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM fl")
def flatten_cubic(spark, sf):
    return _rounded(M.flatten_cubic(I.exploded(imported(spark, sf))).drop("contour", "outer"), "glyph_id", "seq", "n", "k")


@query("outline_profile", f"""WITH {FLAT},
ed AS (SELECT glyph_id, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y FROM fl WINDOW w AS (PARTITION BY glyph_id, seq ORDER BY k)),
nz AS (SELECT glyph_id, CASE WHEN ay < b_y THEN ax ELSE bx END AS x0, least(ay, b_y) AS y0, CASE WHEN ay < b_y THEN bx ELSE ax END AS x1, greatest(ay, b_y) AS y1 FROM ed WHERE bx IS NOT NULL AND ay <> b_y),
sl AS (SELECT *, unnest(range(-30, 120)) * 8 AS y FROM nz)
SELECT glyph_id, y::DOUBLE AS y, round(min(x0 + ((y - y0) / (y1 - y0)) * (x1 - x0)), 6) + 0.0 AS "left", round(max(x0 + ((y - y0) / (y1 - y0)) * (x1 - x0)), 6) + 0.0 AS "right"
FROM sl WHERE y >= y0 AND y < y1 GROUP BY ALL""")
def outline_profile(spark, sf):
    return _rounded(M.outline_profile(imported(spark, sf).select("glyph_id", "curves")), "glyph_id")


@query("preserve_bearings", f"""WITH {C.PATHS}
SELECT glyph_id, font_id, ch, round(CASE WHEN glyph_id % 3 = 0 THEN 10 ELSE lsb END, 6) AS lsb, round(CASE WHEN glyph_id % 3 = 0 THEN 20 ELSE rsb END, 6) AS rsb,
  round(CASE WHEN glyph_id % 3 = 0 THEN ink_width + 30 ELSE advance END, 6) AS advance FROM imp""")
def preserve_bearings(spark, sf):
    """I4: every third glyph came without bearings and keeps those computed for it."""
    g = imported(spark, sf).drop("curves")
    spaced = g.selectExpr("glyph_id", "font_id", "ch", "10D AS lsb", "20D AS rsb", "ink_width + 30 AS advance")
    return _rounded(M.keep_original_bearings(spaced, g.where("glyph_id % 3 <> 0")), "glyph_id", "font_id", "ch")


@query("licence_flags", """SELECT s_suppkey AS font_id, (s_nationkey * 37 + s_suppkey * 2) % 1024 AS fs_type,
  ((s_nationkey * 37 + s_suppkey * 2) % 1024 & 2) <> 0 AS restricted, ((s_nationkey * 37 + s_suppkey * 2) % 1024 & 256) <> 0 AS no_subset,
  ((s_nationkey * 37 + s_suppkey * 2) % 1024 & 512) <> 0 AS bitmap_only,
  CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'fr ' || s_name END AS family FROM supplier""")
def licence_flags(spark, sf):
    f = A.table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS font_id", "(s_nationkey * 37 + s_suppkey * 2) % 1024 AS fs_type",
        "IF(s_suppkey % 3 = 0, array(named_struct('lang', 'fr', 'family', concat('fr ', s_name)), named_struct('lang', 'en', 'family', concat(' ', s_name))),"
        " array(named_struct('lang', 'fr', 'family', IF(s_suppkey % 5 = 0, '  ', concat('fr ', s_name))))) AS names")
    return I.licence_flags(f)


NAMED = """fonts AS (SELECT s_suppkey AS font_id, CASE WHEN s_suppkey % 11 <> 0 THEN (s_nationkey * 37 + s_suppkey * 2) % 1024 END AS fs_type,
  CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 5 <> 0 THEN 'fr ' || s_name WHEN s_suppkey % 4 = 0 THEN 'P ' || s_name END AS family,
  CASE WHEN s_suppkey % 2 = 0 THEN 'de ' || s_name END AS designer,
  CASE WHEN s_suppkey % 7 = 0 THEN 'my terms ' || s_suppkey WHEN s_suppkey % 7 = 1 THEN 'terms ' || s_suppkey END AS description,
  CASE WHEN s_suppkey % 6 = 1 THEN 'https://a/' || s_suppkey WHEN s_suppkey % 6 = 2 THEN 'https://b/' || s_suppkey END AS url FROM supplier)"""


def named_fonts(spark, sf):
    """Suppliers as fonts with name records: foreign, English, blank and missing ones under every name a record goes by."""
    def rec(when, record, lang, text):
        return f"IF({when}, array(struct('{record}' AS record, '{lang}' AS lang, {text} AS text)), array())"
    names = ", ".join([
        rec("true", "fontFamily", "fr", "IF(s_suppkey % 5 = 0, '  ', concat('fr ', s_name))"),
        rec("s_suppkey % 3 = 0", "fontFamily", "en", "concat(' ', s_name, '\\n')"),
        rec("s_suppkey % 4 = 0", "preferredFamily", "en", "concat('P ', s_name)"),
        rec("s_suppkey % 2 = 0", "designer", "de", "concat('de ', s_name)"),
        rec("s_suppkey % 7 = 0", "license", "en", "' '"), rec("s_suppkey % 7 = 1", "license", "en", "concat('terms ', s_suppkey)"),
        rec("s_suppkey % 7 <= 1", "licence", "en", "concat('my terms ', s_suppkey)"),
        rec("s_suppkey % 6 = 1", "licenseURL", "en", "concat('https://a/', s_suppkey)"),
        rec("s_suppkey % 6 = 2", "licenceURL", "en", "concat('https://b/', s_suppkey)")])
    return A.table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS font_id", "IF(s_suppkey % 11 <> 0, (s_nationkey * 37 + s_suppkey * 2) % 1024, NULL) AS fs_type", f"concat({names}) AS names")


@query("licence_records", f"""WITH {NAMED}, r AS (SELECT font_id, unnest([struct_pack(record := 'family', text := family), struct_pack(record := 'designer', text := designer),
  struct_pack(record := 'description', text := description), struct_pack(record := 'url', text := url)]) AS r FROM fonts) SELECT font_id, r.record, r.text FROM r""")
def licence_records(spark, sf):
    return I.licence_records(named_fonts(spark, sf))


@query("import_gate", f"""WITH {NAMED}, g AS (SELECT p_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS font_id, count(*) AS n FROM part GROUP BY 1)
SELECT font_id, coalesce(fs_type & 2, 0) <> 0 AS restricted, coalesce(fs_type & 256, 0) <> 0 AS no_subset, coalesce(fs_type & 512, 0) <> 0 AS bitmap_only,
  CASE WHEN coalesce(fs_type & 2, 0) <> 0 THEN 'restricted' END AS refused, CASE WHEN coalesce(fs_type & 2, 0) <> 0 THEN 0 ELSE coalesce(n, 0) END AS taken
FROM fonts LEFT JOIN g USING (font_id)""")
def import_gate(spark, sf):
    """The gate's verdict on each font and how many glyphs it lets through."""
    fonts = named_fonts(spark, sf)
    n = A.table(spark, sf, "supplier").select(F.max("s_suppkey")).scalar()
    glyphs = A.table(spark, sf, "part").select((F.col("p_partkey") % n + 1).alias("font_id"))
    taken = I.importable(glyphs, fonts).groupBy("font_id").agg(F.count("*").alias("taken"))
    return I.import_gate(fonts).join(taken, "font_id", "left").na.fill(0, ["taken"])


WANTED = [*"AEIOUaeiou059.,&", "\u00e9", "\u03a9", "A"]


@query("import_found", "WITH " + C.CHARSET + """, g AS (SELECT p_partkey // 130 AS font_id, c.ch, p_size % 7 <> 0 AND p_size % 11 <> 0 AND p_size % 5 <> 0 AS ok
  FROM part LEFT JOIN charset c ON c.ord = p_partkey % 130)
SELECT font_id, k, w.ch, EXISTS (SELECT 1 FROM g WHERE g.font_id = f.font_id AND g.ch = w.ch AND ok) AS found FROM (SELECT DISTINCT font_id FROM g) f,
  (SELECT unnest(range(""" + str(len(WANTED) - 1) + """)) AS k, unnest([""" + ", ".join(f"'{c}'" for c in WANTED[:-1]) + """]) AS ch) w""")
def import_found(spark, sf):
    """I6 over every part as a slot of a font: some have no glyph, some another code point, some no ink."""
    from quillwork.functions import dims
    cs = dims.charset(spark).select("ord", "ch", "name", "unicode")
    line = "array(named_struct('p0', {0}, 'c1', {0}, 'c2', {1}, 'p3', {1}))".format(
        "named_struct('x', 0D, 'y', 0D)", "named_struct('x', 9D, 'y', cast(p_size AS double))")
    g = A.table(spark, sf, "part").selectExpr("p_partkey AS glyph_id", "p_partkey div 130 AS font_id", "cast(p_partkey % 130 AS int) AS ord", "p_size").join(
        cs, "ord", "left").selectExpr("glyph_id", "font_id", "ch", "IF(p_size % 7 = 0, '.notdef', name) AS glyph_name",
                                      "IF(p_size % 11 = 0, 0, unicode) AS unicode", f"IF(p_size % 5 = 0, slice({line}, 1, 0), {line}) AS curves")
    return I.import_found(g, WANTED)


@query("import_coverage", """WITH """ + C.CHARSET + """,
cm AS (SELECT p_partkey // 130 AS font_id, c.ch FROM part JOIN charset c ON c.ord = p_partkey % 130 AND c.kind = 'required' WHERE p_size % 7 <> 0 AND p_size % 11 <> 0)
SELECT f.font_id, c.ord, c.ch, EXISTS (SELECT 1 FROM cm WHERE cm.font_id = f.font_id AND cm.ch = c.ch) AS found
FROM (SELECT DISTINCT p_partkey // 130 AS font_id FROM part WHERE p_partkey % 130 < 112) f, charset c WHERE c.kind = 'required'""")
def import_coverage(spark, sf):
    """Some glyphs of every font are .notdef, and some carry another code point."""
    from quillwork.functions import dims
    cs = dims.required(spark).select("ord", "ch", "name", "unicode")
    cm = A.table(spark, sf, "part").selectExpr("p_partkey div 130 AS font_id", "cast(p_partkey % 130 AS int) AS ord", "p_size").join(cs, "ord").selectExpr(
        "font_id", "ch", "IF(p_size % 7 = 0, '.notdef', name) AS glyph_name", "IF(p_size % 11 = 0, 0, unicode) AS unicode")
    return I.import_coverage(cm, spark)


@query("svg_path", f"""WITH {C.PATHS},
n AS (SELECT glyph_id, seq, list_transform([p0x, p0y, c1x, c1y, c2x, c2y, p3x, p3y], lambda v: regexp_replace(regexp_replace(
   (floor(v * 100 + 0.5)::BIGINT / 100)::DECIMAL(18, 2)::VARCHAR, '0+$', ''), '\\.$', '')) AS s FROM icv)
SELECT glyph_id, string_agg(CASE WHEN seq = 0 THEN 'M' || s[1] || ' ' || s[2] ELSE '' END || 'C' || s[3] || ' ' || s[4] || ' ' || s[5] || ' ' || s[6] || ' ' || s[7] || ' ' || s[8], '' ORDER BY seq) || 'Z' AS path
FROM n GROUP BY glyph_id""")
def svg_path(spark, sf):
    return T.svg_path(imported(spark, sf).select("glyph_id", "curves"))


def slanted_sql(src: str, deg: str) -> str:
    return ", ".join(f"round({n}x + ({n}y - 250) * tan(radians({deg}::DOUBLE)), 6) + 0.0 AS {n}_x, round({n}y, 6) + 0.0 AS {n}_y" for n in T.ENDS)


@query("slant", f"WITH {C.PATHS} SELECT glyph_id, seq, {slanted_sql('icv', '11')} FROM icv")
def slant(spark, sf):
    return curves_of(Y.slant(imported(spark, sf), "11D"))


@query("unslant", f"WITH {C.PATHS} SELECT cv.glyph_id, seq, " + ", ".join(
    f"round({n}x + ({n}y - (d - c) * 0.62::DOUBLE) * tan(radians(-7.5::DOUBLE)), 6) + 0.0 AS {n}_x, round({n}y, 6) + 0.0 AS {n}_y" for n in T.ENDS)
    + " FROM cv JOIN pth ON pth.glyph_id = cv.glyph_id")
def unslant(spark, sf):
    g = T.bounds(paths(spark, sf)).selectExpr("glyph_id", "curves", "by1 - by0 AS h")
    return curves_of(Y.unslant(g, "7.5D", "h"))


BOLD = C.PATHS + """,
pt AS (SELECT glyph_id, seq * 3 + j AS i, CASE j WHEN 0 THEN p0x WHEN 1 THEN c1x ELSE c2x END AS x, CASE j WHEN 0 THEN p0y WHEN 1 THEN c1y ELSE c2y END AS y FROM icv, range(3) r(j)),
ar AS (SELECT glyph_id, count(*) * 3 AS n, CASE WHEN sum(p0x * p3y - p3x * p0y) < 0 THEN -1 ELSE 1 END AS dir FROM icv GROUP BY glyph_id),
nb AS (SELECT p.glyph_id, p.i, p.x, p.y, dir, n, s, b.x - a.x AS tx, b.y - a.y AS ty FROM pt p JOIN ar USING (glyph_id), range(1, 4) r(s), pt a, pt b
  WHERE a.glyph_id = p.glyph_id AND b.glyph_id = p.glyph_id AND a.i = (p.i - s + n) % n AND b.i = (p.i + s) % n),
ch AS (SELECT glyph_id, i, x, y, dir, n, arg_min(row(tx, ty), CASE WHEN sqrt(tx * tx + ty * ty) > 0.000001 THEN s ELSE 10 END) AS t FROM nb GROUP BY ALL),
mv AS (SELECT glyph_id, i, n, x + dir * (t[2] / sqrt(t[1] * t[1] + t[2] * t[2])) * 20 AS x, y + dir * (-t[1] / sqrt(t[1] * t[1] + t[2] * t[2])) * 20 AS y FROM ch),
bcv AS (SELECT a.glyph_id, a.i // 3 AS seq, a.x AS p0x, a.y AS p0y, b.x AS c1x, b.y AS c1y, c.x AS c2x, c.y AS c2y, d.x AS p3x, d.y AS p3y FROM mv a
  JOIN mv b ON b.glyph_id = a.glyph_id AND b.i = a.i + 1 JOIN mv c ON c.glyph_id = a.glyph_id AND c.i = a.i + 2 JOIN mv d ON d.glyph_id = a.glyph_id AND d.i = (a.i + 3) % a.n WHERE a.i % 3 = 0)"""


@query("embolden", f"WITH {BOLD} SELECT glyph_id, seq, {XY_SQL} FROM bcv")
def embolden(spark, sf):
    return curves_of(Y.embolden(imported(spark, sf), "20"))


@query("italic_angle", f"""WITH {SLANT}
SELECT font_id, round(slant, 6) + 0.0 AS "natural", round(greatest(11 * 0.55::DOUBLE, 11 - greatest(0, slant) * 0.5), 6) AS italic FROM sl""")
def italic_angle(spark, sf):
    return _rounded(Y.italic_angle(slants(spark, sf)), "font_id")


@query("merge_captures", """WITH t AS (SELECT l_orderkey // 30 AS font_id, l_orderkey AS scan_id, max(l_linenumber) + 1 AS n FROM lineitem GROUP BY ALL),
o AS (SELECT font_id, scan_id, coalesce(sum(n) OVER (PARTITION BY font_id ORDER BY scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t)
SELECT font_id, scan_id, l_partkey AS part, (l_linenumber + off)::BIGINT AS row FROM lineitem JOIN o ON scan_id = l_orderkey AND font_id = l_orderkey // 30""")
def merge_captures(spark, sf):
    g = A.table(spark, sf, "lineitem").selectExpr("l_orderkey div 30 AS font_id", "l_orderkey AS scan_id", "l_partkey AS part", "l_linenumber AS row")
    return Y.merge_captures(g)


DEFS = C.PATHS + "," + C.DERIVED + """,
tk AS (SELECT *, row_number() OVER (PARTITION BY font_id, ch ORDER BY glyph_id) - 1 AS take FROM imp),
base AS (SELECT font_id, glyph_id, name, ch, unicode, kind, NULL AS variant_of, 0 AS v, ord, lsb, rsb, ink_width, advance, ink_y0, ink_y1 FROM tk WHERE take = 0),
defs AS (SELECT font_id, glyph_id, name, ch, unicode, kind, variant_of, v, ord, lsb, rsb, ink_width, advance FROM base
  UNION ALL SELECT b.font_id, coalesce(t.glyph_id, b.glyph_id), b.name || '.alt' || r.v, NULL, NULL, CASE WHEN t.font_id IS NULL THEN 'jitter' ELSE 'take' END, b.name, r.v, b.ord,
     coalesce(t.lsb, b.lsb), b.rsb, b.ink_width, coalesce(t.advance, b.advance) FROM base b CROSS JOIN range(1, 3) r(v) LEFT JOIN tk t ON t.font_id = b.font_id AND t.ch = b.ch AND t.take = r.v WHERE b.kind = 'required'
  UNION ALL SELECT b.font_id, b.glyph_id, d.name, d.ch, unicode(d.ch), 'derived', NULL, 0, 200 + d.ord, lsb, rsb,
     CASE op WHEN 'stretch' THEN ink_width * amount WHEN 'repeat' THEN ink_width + 2 * advance * gap ELSE ink_width END,
     CASE op WHEN 'stretch' THEN lsb + ink_width * amount + rsb WHEN 'repeat' THEN lsb + advance * gap * 2 + ink_width + rsb ELSE advance END
   FROM base b JOIN derived d ON d.src = b.name WHERE b.kind = 'required')"""
DEF_NUMS = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("lsb", "rsb", "ink_width", "advance"))


def defs(spark, sf):
    return Y.glyph_defs(imported(spark, sf))


@query("glyph_defs", f"WITH {DEFS} SELECT font_id, name, ch, coalesce(unicode, 0) AS unicode, kind, variant_of, v, ord, {DEF_NUMS} FROM defs")
def glyph_defs(spark, sf):
    return _rounded(defs(spark, sf).drop("curves").na.fill(0, ["unicode"]), "font_id", "name", "ch", "unicode", "kind", "variant_of", "v", "ord")


@query("derived_glyphs", f"""WITH {DEFS},
dc AS (SELECT d.font_id, d.name, CASE WHEN dr.op = 'repeat' THEN k * n.c + i.seq WHEN dr.op = 'mirror' THEN n.c - 1 - i.seq ELSE i.seq END AS pos,
   CASE dr.op WHEN 'stretch' THEN i.p0x * dr.amount WHEN 'mirror' THEN b.ink_width - i.p3x ELSE i.p0x + k * b.advance * dr.gap END AS p0_x, CASE dr.op WHEN 'mirror' THEN i.p3y ELSE i.p0y END AS p0_y,
   CASE dr.op WHEN 'stretch' THEN i.c1x * dr.amount WHEN 'mirror' THEN b.ink_width - i.c2x ELSE i.c1x + k * b.advance * dr.gap END AS c1_x, CASE dr.op WHEN 'mirror' THEN i.c2y ELSE i.c1y END AS c1_y
  FROM defs d JOIN derived dr ON dr.name = d.name JOIN base b ON b.glyph_id = d.glyph_id JOIN icv i ON i.glyph_id = d.glyph_id
  JOIN (SELECT glyph_id, count(*) AS c FROM icv GROUP BY 1) n ON n.glyph_id = d.glyph_id, range(3) r(k) WHERE k < CASE WHEN dr.op = 'repeat' THEN dr.amount ELSE 1 END)
SELECT font_id, name, pos, round(p0_x, 6) + 0.0 AS p0_x, round(p0_y, 6) + 0.0 AS p0_y, round(c1_x, 6) + 0.0 AS c1_x, round(c1_y, 6) + 0.0 AS c1_y FROM dc""")
def derived_glyphs(spark, sf):
    t = Y.takes(imported(spark, sf)).where("take = 0 AND kind = 'required'").selectExpr("*", "cast(NULL AS string) AS variant_of", "0 AS v")
    d = Y.derived_glyphs(t)
    return d.select("font_id", "name", F.posexplode("curves").alias("pos", "c")).select(
        "font_id", "name", "pos", *[r6(F.col(f"c.{n}.{a}")).alias(f"{n}_{a}") for n in ("p0", "c1") for a in "xy"])


@query("variants", f"""WITH {DEFS},
j AS (SELECT d.font_id, d.name, d.kind, seq, CASE WHEN d.v % 2 = 0 THEN 1 ELSE -1 END AS sg, p0x, p0y, c1x, c1y, b.ink_width / 2 AS cx, (b.ink_y0 + b.ink_y1) / 2 AS cy
  FROM defs d JOIN icv USING (glyph_id) JOIN base b ON b.font_id = d.font_id AND b.name = d.variant_of WHERE d.variant_of IS NOT NULL),
k AS (SELECT *, radians(1.1::DOUBLE * sg) AS t, 1 + 0.014::DOUBLE * sg * 0.6::DOUBLE AS g, 500 * 0.016::DOUBLE * sg * 0.5 AS dy FROM j)
SELECT font_id, name, kind, seq, round(CASE kind WHEN 'take' THEN p0x ELSE cx + (p0x - cx) * g * cos(t) - (p0y - cy) * g * sin(t) END, 6) + 0.0 AS p0_x,
  round(CASE kind WHEN 'take' THEN p0y ELSE cy + (p0x - cx) * g * sin(t) + (p0y - cy) * g * cos(t) + dy END, 6) + 0.0 AS p0_y,
  round(CASE kind WHEN 'take' THEN c1x ELSE cx + (c1x - cx) * g * cos(t) - (c1y - cy) * g * sin(t) END, 6) + 0.0 AS c1_x,
  round(CASE kind WHEN 'take' THEN c1y ELSE cy + (c1x - cx) * g * sin(t) + (c1y - cy) * g * cos(t) + dy END, 6) + 0.0 AS c1_y FROM k""")
def variants(spark, sf):
    v = defs(spark, sf).where("variant_of IS NOT NULL")
    return v.select("font_id", "name", "kind", F.explode("curves").alias("c")).select(
        "font_id", "name", "kind", "c.seq", *[r6(F.col(f"c.{n}.{a}")).alias(f"{n}_{a}") for n in ("p0", "c1") for a in "xy"])


INDEX = DEFS + "," + C.STYLES + """,
idx AS (SELECT d.*, s.style, s.bold, s.lean, row_number() OVER (PARTITION BY font_id, style ORDER BY variant_of IS NOT NULL, d.ord, d.v) + 1 AS gid FROM defs d, styles s)"""


@query("style_glyphs", f"""WITH {INDEX}
SELECT font_id, style, name, gid, CASE WHEN bold = 0 AND lean = 0 AND kind IN ('required', 'ligature') THEN greatest(1, floor(advance + 0.5))::INT ELSE 0 END AS plain_advance FROM idx""")
def style_glyphs(spark, sf):
    s = Y.style_glyphs(defs(spark, sf))
    plain = F.expr("style = 'Regular' AND kind IN ('required', 'ligature')")
    return s.select("font_id", "style", "name", "gid", F.when(plain, F.col("styled_advance")).otherwise(0).alias("plain_advance"))


@query("style_boxes", f"""WITH {BOLD},
fc AS (SELECT * FROM (SELECT glyph_id, font_id, kind, lsb, rsb, row_number() OVER (PARTITION BY font_id, ch ORDER BY glyph_id) AS k FROM imp) WHERE k = 1),
al AS (SELECT 'Regular' AS style, glyph_id, unnest([p0x, c1x, c2x, p3x]) AS x, unnest([p0y, c1y, c2y, p3y]) AS y FROM icv
  UNION ALL SELECT 'Bold', glyph_id, unnest([p0x, c1x, c2x, p3x]), unnest([p0y, c1y, c2y, p3y]) FROM bcv),
bx AS (SELECT style, glyph_id, x, y FROM al UNION ALL SELECT CASE style WHEN 'Bold' THEN 'Bold Italic' ELSE 'Italic' END, glyph_id, x + (y - 250) * tan(radians(11::DOUBLE)), y FROM al)
SELECT f.font_id, style, f.glyph_id, round(min(x), 5) + 0.0 AS bx0, round(max(x), 5) + 0.0 AS bx1, round(min(y), 5) + 0.0 AS by0, round(max(y), 5) + 0.0 AS by1,
  greatest(1, floor(lsb + (max(x) - min(x)) + rsb + 0.5))::INT AS styled_advance
FROM bx JOIN fc f USING (glyph_id) GROUP BY f.font_id, style, f.glyph_id, lsb, rsb""")
def style_boxes(spark, sf):
    """Boxes and advances of the base glyphs in all four styles."""
    g = Y.takes(imported(spark, sf)).where("take = 0").selectExpr("*", "cast(NULL AS string) AS variant_of", "0 AS v")
    s = Y.style_glyphs(g)
    return s.select("font_id", "style", "glyph_id", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("bx0", "bx1", "by0", "by1")], "styled_advance")


@query("style_extent")
def style_extent(spark, sf):
    return Y.style_extent(Y.style_glyphs(defs(spark, sf)))


def index(spark, sf):
    return Y.style_index(imported(spark, sf))


@query("style_kerning", f"""WITH {KERN}, {INDEX.split(C.CHARSET + ',', 1)[1]}
SELECT k.font_id, l.style, l.gid AS left_gid, r.gid AS right_gid, k.value FROM kern k JOIN idx l ON l.font_id = k.font_id AND l.ch = k.left_ch
JOIN idx r ON r.font_id = k.font_id AND r.ch = k.right_ch AND r.style = l.style""")
def style_kerning(spark, sf):
    return Y.style_kerning(shape_kerning(spark, sf), index(spark, sf))


@query("kern_classes", f"""WITH {KERN},
l AS (SELECT font_id, left_ch, row_number() OVER (PARTITION BY font_id ORDER BY o) AS c1 FROM (SELECT font_id, left_ch, min(left_ord) AS o FROM kern GROUP BY ALL)),
r AS (SELECT font_id, right_ch, row_number() OVER (PARTITION BY font_id ORDER BY o) AS c2 FROM (SELECT font_id, right_ch, min(left_ord * 1000 + right_ord) AS o FROM kern GROUP BY ALL)),
nl AS (SELECT font_id, unnest(range(0, m + 1)) AS c1 FROM (SELECT font_id, max(c1) AS m FROM l GROUP BY 1)),
nr AS (SELECT font_id, unnest(range(0, m + 1)) AS c2 FROM (SELECT font_id, max(c2) AS m FROM r GROUP BY 1)),
v AS (SELECT k.font_id, c1, c2, value FROM kern k JOIN l USING (font_id, left_ch) JOIN r USING (font_id, right_ch))
SELECT nl.font_id, nl.c1, nr.c2, coalesce(value, 0) AS value FROM nl JOIN nr ON nl.font_id = nr.font_id LEFT JOIN v ON v.font_id = nl.font_id AND v.c1 = nl.c1 AND v.c2 = nr.c2""")
def kern_classes(spark, sf):
    return Y.kern_classes(shape_kerning(spark, sf))


WIDE = """pairs AS (SELECT DISTINCT l_suppkey % 23 AS font_id, l_partkey % (40 + 12 * (l_suppkey % 23)) AS l, l_orderkey % (40 + 9 * (l_suppkey % 23)) AS r FROM lineitem)"""


@query("kern_tables", f"""WITH {WIDE}, n AS (SELECT font_id, count(DISTINCT l) + 1 AS n1, count(DISTINCT r) + 1 AS n2 FROM pairs GROUP BY 1)
SELECT font_id, n1 AS left_classes, n2 AS right_classes, n1 * n2 * 2 AS matrix_bytes, n1 * n2 * 2 <= 65535 AS fits FROM n""")
def kern_tables(spark, sf):
    """F8's sizes over order lines as pairs of 23 fonts, from small character sets to ones whose matrix does not fit."""
    p = A.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey % 23 AS font_id", "l_partkey % (40 + 12 * (l_suppkey % 23)) AS l", "l_orderkey % (40 + 9 * (l_suppkey % 23)) AS r").distinct()
    return Y.kern_tables(p.selectExpr("font_id", "cast(l AS string) AS left_ch", "cast(r AS string) AS right_ch", "l AS left_ord", "r AS right_ord", "0 AS value"))


@query("ligature_sets", f"""WITH {INDEX},
p AS (SELECT l.font_id, l.style, l.gid AS lig_gid, l.ord, a.gid AS first_gid, b.gid AS second_gid FROM idx l
  JOIN idx a ON a.font_id = l.font_id AND a.style = l.style AND a.ch = l.ch[1] JOIN idx b ON b.font_id = l.font_id AND b.style = l.style AND b.ch = l.ch[2] WHERE l.kind = 'ligature')
SELECT font_id, style, first_gid, lig_gid, second_gid, row_number() OVER (PARTITION BY font_id, style, first_gid ORDER BY ord) AS k FROM p""")
def ligature_sets(spark, sf):
    return Y.ligature_sets(index(spark, sf)).selectExpr("font_id", "style", "first_gid", "lig_gid", "rest[0] AS second_gid", "k")


@query("alternate_map", f"""WITH {INDEX}
SELECT b.font_id, b.style, b.gid, a.gid AS alt1, coalesce(c.gid, a.gid) AS alt2 FROM idx b JOIN idx a ON a.font_id = b.font_id AND a.style = b.style AND a.name = b.name || '.alt1'
LEFT JOIN idx c ON c.font_id = b.font_id AND c.style = b.style AND c.name = b.name || '.alt2'""")
def alternate_map(spark, sf):
    return Y.alternate_map(index(spark, sf))


@query("style_manifest", f"""WITH {KERN}, {INDEX.split(C.CHARSET + ',', 1)[1]},
sk AS (SELECT k.font_id, l.style, count(*) AS kern_count FROM kern k JOIN idx l ON l.font_id = k.font_id AND l.ch = k.left_ch JOIN idx r ON r.font_id = k.font_id AND r.ch = k.right_ch AND r.style = l.style GROUP BY ALL),
n AS (SELECT font_id, style, count(*) + 2 AS glyph_count, count(*) FILTER (WHERE name NOT LIKE '%.alt%') + 1 AS char_count FROM idx GROUP BY ALL)
SELECT n.font_id, n.style, trim(regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g'), '-') || '-' || replace(n.style, ' ', '-') || '.otf' AS file, glyph_count, char_count, coalesce(kern_count, 0) AS kern_count
FROM n LEFT JOIN sk USING (font_id, style) JOIN supplier ON s_suppkey = n.font_id""")
def style_manifest(spark, sf):
    i = index(spark, sf)
    fam = A.table(spark, sf, "supplier").selectExpr("s_suppkey AS font_id", "s_name AS family")
    return Y.style_manifest(i, Y.style_kerning(shape_kerning(spark, sf), i), fam)


@query("glyph_snapshot", f"WITH {C.PATHS} SELECT 1 AS version, i.glyph_id, i.font_id, i.ch, c.seq, " + ", ".join(
    f"floor({n}{a} * 100 + 0.5) / 100 + 0.0 AS {n}_{a}" for n in T.ENDS for a in "xy")
    + ", floor(advance * 100 + 0.5) / 100 AS advance FROM imp i JOIN icv c USING (glyph_id)")
def glyph_snapshot(spark, sf):
    s = Y.snapshot(imported(spark, sf).select("glyph_id", "font_id", "ch", "curves", "advance"))
    return s.select("version", "glyph_id", "font_id", "ch", "advance", F.explode("curves").alias("c")).select(
        "version", "glyph_id", "font_id", "ch", "advance", "c.seq", *[(F.col(f"c.{n}.{a}") + F.lit(0.0)).alias(f"{n}_{a}") for n in T.ENDS for a in "xy"])


@query("snapshot_weight")
def snapshot_weight(spark, sf):
    g = Y.snapshot(imported(spark, sf).select("glyph_id", "font_id", "ch", "curves", "advance"))
    r = A.scan_arrays(spark, sf).selectExpr("scan_id AS glyph_id", "unhex(concat_ws('', transform(gray, v -> lpad(hex(v), 2, '0')))) AS raster")
    return Y.weigh(g.join(r, "glyph_id", "left"), "raster")
