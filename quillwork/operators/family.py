"""From normalised glyphs to a family: variants, derived glyphs, four styles, kerning classes.

Glyphs are one row each with their curves as an array, so every change of shape is a projection.
A font's glyph list is bounded by its characters.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions import dims
from quillwork.functions.num import half_up
from quillwork.functions.shuffle import held
from quillwork.operators.imports import map_points
from quillwork.operators.outline import bounds

# --- fixed values -----------------------------------------------------------------------
BOLD, ITALIC_DEG = 0.020, 11.0
VARIANTS = 3
TURN_DEG, GROW, SHIFT = 1.1, 0.014, 0.016
PIVOT = 250.0
SPACE_NOTDEF = 1.4
MAX_TABLE_BYTES = 0xFFFF
# ----------------------------------------------------------------------------------------


def embolden(o: DataFrame, amount: str) -> DataFrame:
    """move every control point along the normal of its neighbours; ``amount`` is SQL.

    Which way is out follows the glyph's largest contour. Neighbours are looked for up to three
    points away where the nearer ones coincide.
    """
    o = held(o, _amt=f"cast({amount} AS double)", _loops=(
        "transform(array_distinct(transform(curves, c -> c.contour)), k -> named_struct('k', k, 'c', filter(curves, c -> c.contour = k)))"))
    o = held(o, _flat="transform(_loops, l -> named_struct('k', l.k, 'outer', l.c[0].outer, 'seq', l.c[0].seq, 'c0', transform(l.c, c -> c.p0),"
                      " 'p', flatten(transform(l.c, c -> array(c.p0, c.c1, c.c2)))))")
    o = held(o, _big="array_max(transform(_flat, (l, j) -> struct(abs(aggregate(transform(l.c0, (p, i) -> p.x * l.c0[(i + 1) % size(l.c0)].y"
                     " - l.c0[(i + 1) % size(l.c0)].x * p.y), 0D, (a, v) -> a + v)) AS a, -j AS j,"
                     " aggregate(transform(l.c0, (p, i) -> p.x * l.c0[(i + 1) % size(l.c0)].y - l.c0[(i + 1) % size(l.c0)].x * p.y), 0D, (a, v) -> a + v) AS s)))")

    def tangent(v: str) -> str:
        d = "l.p[pmod(i + {s}, size(l.p))].{v} - l.p[pmod(i - {s}, size(l.p))].{v}"
        dx = {s: d.format(s=s, v="x") for s in (1, 2, 3)}
        dy = {s: d.format(s=s, v="y") for s in (1, 2, 3)}
        far = {s: f"sqrt(power({dx[s]}, 2) + power({dy[s]}, 2)) > 1e-6" for s in (1, 2)}
        pick = dx if v == "x" else dy
        return f"CASE WHEN {far[1]} THEN {pick[1]} WHEN {far[2]} THEN {pick[2]} ELSE {pick[3]} END"

    o = held(o, _tan=f"transform(_flat, l -> transform(l.p, (p, i) -> named_struct('x', {tangent('x')}, 'y', {tangent('y')})))")
    way = "IF(_big.s < 0, -1, 1) * _amt"
    ln = "sqrt(t.x * t.x + t.y * t.y)"
    o = held(o, _new=f"transform(_flat, (l, j) -> zip_with(l.p, _tan[j], (p, t) -> IF(size(l.p) < 3 OR {ln} < 1e-6, p, named_struct("
                     f"'x', p.x + {way} * (t.y / {ln}), 'y', p.y + {way} * (-t.x / {ln})))))")
    curve = ("named_struct('contour', l.k, 'seq', l.seq + i, 'outer', l.outer, 'p0', _new[j][3 * i], 'c1', _new[j][3 * i + 1],"
             " 'c2', _new[j][3 * i + 2], 'p3', _new[j][(3 * (i + 1)) % size(l.p)])")
    cols = [c for c in o.columns if not c.startswith("_")]
    out = held(o.withColumnRenamed("curves", "_was"), curves=(
        f"IF(_amt = 0, _was, flatten(transform(_flat, (l, j) -> transform(sequence(0, size(l.c0) - 1), i -> {curve}))))"))
    return out.select(*cols)


def slant(o: DataFrame, deg: str) -> DataFrame:
    """lean by an angle in degrees about half the x-height; ``deg`` is SQL."""
    return map_points(o, f"{{p}}.x + ({{p}}.y - {PIVOT}D) * tan(radians({deg}))", "{p}.y")


def unslant(o: DataFrame, deg: str, height: str) -> DataFrame:
    """stand a traced glyph upright before it is measured; y grows down here."""
    return map_points(o, f"{{p}}.x + ({{p}}.y - {height} * 0.62D) * tan(radians(-({deg})))", "{p}.y")


def italic_angle(slants: DataFrame, angle: float = ITALIC_DEG, straighten: bool = False) -> DataFrame:
    """lean of the italics, less where the hand leans already; slants(font_id, slant) one row per scan."""
    s = slants.groupBy("font_id").agg(F.coalesce(F.median("slant"), F.lit(0.0)).alias("natural"))
    own = F.lit(angle) if straighten else F.greatest(
        F.lit(angle * 0.55), angle - F.greatest(F.lit(0.0), F.col("natural")) * 0.5)
    return s.withColumn("italic", own)


def merge_captures(glyphs: DataFrame) -> DataFrame:
    """glyphs of a font's scans with rows numbered through; glyphs(font_id, scan_id, row, ...).

    Offsets come from one row per scan, not from the glyphs.
    """
    tops = glyphs.groupBy("font_id", "scan_id").agg((F.max("row") + 1).alias("n"))
    before = W.partitionBy("font_id").orderBy("scan_id").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return glyphs.join(tops, ["font_id", "scan_id"]).withColumn("row", F.col("row") + F.col("offset")).drop("offset")


def takes(glyphs: DataFrame, most: int = VARIANTS) -> DataFrame:
    """First takes of every character of a font, numbered; later ones beyond ``most`` are never used."""
    k = F.row_number().over(W.partitionBy("font_id", "ch").orderBy("glyph_id")) - 1
    return glyphs.withColumn("take", k).where(F.col("take") < most)


DEF = ["font_id", "name", "ch", "unicode", "kind", "variant_of", "v", "ord", "curves", "lsb", "rsb", "ink_width", "advance"]


def variants(base: DataFrame, later: DataFrame, count: int = VARIANTS) -> DataFrame:
    """alternates of every base glyph: a real later take where there is one, else a small change of the base."""
    b = bounds(base.withColumn("v", F.explode(F.expr(f"sequence(1, {count - 1})"))))
    b = b.selectExpr("*", "(bx0 + bx1) / 2 AS cx", "(by0 + by1) / 2 AS cy", "IF(v % 2 = 0, 1, -1) AS sg").drop("bx0", "bx1", "by0", "by1")
    turn = f"radians({TURN_DEG}D * sg)"
    px, py = (f"({{p}}.{a} - c{a}) * (1 + {GROW}D * sg * 0.6D)" for a in "xy")
    j = map_points(b, f"cx + {px} * cos({turn}) - {py} * sin({turn})",
                   f"cy + {px} * sin({turn}) + {py} * cos({turn}) + 500 * {SHIFT}D * sg * 0.5D")
    real = later.select("font_id", "ch", F.col("take").alias("v"), F.col("curves").alias("r_curves"), F.col("lsb").alias("r_lsb"),
                        F.col("advance").alias("r_adv"))
    x = j.join(real, ["font_id", "ch", "v"], "left")
    return x.select(
        "font_id", F.concat("name", F.lit(".alt"), F.col("v").cast("string")).alias("name"), F.lit(None).cast("string").alias("ch"),
        F.lit(None).cast("int").alias("unicode"), F.when(F.col("r_adv").isNotNull(), "take").otherwise("jitter").alias("kind"),
        F.col("name").alias("variant_of"), "v", "ord", F.coalesce("r_curves", "curves").alias("curves"),
        F.coalesce("r_lsb", "lsb").alias("lsb"), "rsb", "ink_width", F.coalesce("r_adv", "advance").alias("advance"))


def derived_glyphs(defs: DataFrame) -> DataFrame:
    """glyphs made from others: copied, mirrored with their winding kept, stretched or repeated."""
    spark = defs.sparkSession
    d = dims.derived(spark).select(F.col("name").alias("d_name"), F.col("ch").alias("d_ch"), "src", "op", "amount", "gap",
                                   F.col("ord").alias("d_ord"))
    s = bounds(defs.join(d, defs["name"] == d["src"]))
    s = s.selectExpr("*", "IF(op = 'repeat', advance * gap, 0D) AS step", "cast(IF(op = 'repeat', amount, 1) AS int) AS times",
                     "aggregate(curves, 0, (a, c) -> greatest(a, c.contour)) + 1 AS nc")
    x = "CASE op WHEN 'mirror' THEN bx1 - ({p}.x - bx0) WHEN 'stretch' THEN {p}.x * amount ELSE {p}.x END"

    def pt(n, shift=""):
        return f"named_struct('x', {x.format(p='c.' + n)}{shift}, 'y', c.{n}.y)"

    order = {True: ("p3", "c2", "c1", "p0"), False: ("p0", "c1", "c2", "p3")}

    def curve(rev, shift=""):
        pts = ", ".join(f"'{n}', {pt(m, shift)}" for n, m in zip(order[False], order[rev]))
        return f"named_struct('contour', c.contour + t * nc, 'seq', c.seq + t * size(curves), 'outer', c.outer, {pts})"

    copies = f"flatten(transform(sequence(0, times - 1), t -> transform(curves, c -> {curve(False, ' + t * step')})))"
    back = f"transform(reverse(curves), c -> {curve(True)})".replace(" + t * nc", "").replace(" + t * size(curves)", "")
    s = held(s, made=f"IF(op = 'mirror', {back}, {copies})")
    s = s.selectExpr(
        "font_id", "d_name AS name", "d_ch AS ch", "ascii(d_ch) AS unicode", "'derived' AS kind", "cast(NULL AS string) AS variant_of",
        "0 AS v", "200 + d_ord AS ord", "made AS curves", "lsb", "rsb",
        "CASE op WHEN 'stretch' THEN lsb + ink_width * amount + rsb WHEN 'repeat' THEN lsb + step * (times - 1) + ink_width + rsb ELSE advance END AS advance")
    return bounds(s).withColumn("ink_width", F.expr("bx1 - bx0")).select(*DEF)


def glyph_defs(glyphs: DataFrame) -> DataFrame:
    """every glyph of a font: required ones with alternates, ligatures, and those derived from them.

    glyphs(font_id, glyph_id, ch, name, unicode, kind, ord, curves, lsb, rsb, ink_width, advance).
    """
    t = takes(glyphs)
    first = t.where("take = 0").withColumn("variant_of", F.lit(None).cast("string")).withColumn("v", F.lit(0))
    base = first.where("kind = 'required'").select(*DEF)
    lig = first.where("kind = 'ligature'").select(*DEF)
    alt = variants(base, t.where("take > 0 AND kind = 'required'")).select(*DEF)
    return reduce(DataFrame.unionByName, [base, alt, lig, derived_glyphs(base)])


def style_glyphs(defs: DataFrame, weight: float = 0.0, bold: float = BOLD, italic: float | str = ITALIC_DEG) -> DataFrame:
    """the glyphs of all four styles with box, offset, advance and index; 0 and 1 are .notdef and space.

    Alternates come after all others. ``italic`` is an angle, or SQL for each font's own (``italic_angle``).
    """
    def deg(lean: int) -> str:
        return f"cast({lean} * ({italic}) AS double)" if isinstance(italic, str) else f"{lean * italic!r}D"

    st = ", ".join(f"named_struct('style', '{n}', 'amount', {(b * bold + weight) * 1000!r}D, 'deg', {deg(lean)},"
                   f" 'italic', {str(it).lower()}, 'weight_class', {wc})" for n, b, lean, wc, _, it in dims.STYLES)
    g = defs.selectExpr("*", f"explode(array({st})) AS s").select(*defs.columns, "s.*")
    g = bounds(slant(embolden(g, "amount"), "deg")).where("bx0 IS NOT NULL")
    k = F.row_number().over(W.partitionBy("font_id", "style").orderBy(F.col("variant_of").isNotNull(), "ord", "v"))
    return g.withColumn("gid", k + 1).selectExpr(
        "*", "lsb - bx0 AS offset", "cast(greatest(1, floor(lsb + (bx1 - bx0) + rsb + 0.5)) AS int) AS styled_advance")


def style_index(glyphs: DataFrame) -> DataFrame:
    """F6's numbering alone: index(font_id, style, name, ch, kind, variant_of, v, ord, gid) of what ``glyph_defs`` and ``style_glyphs``
    give for the same glyphs, without drawing any of it.

    No change of shape adds or takes a glyph's ink, so a glyph stands in every style or in none, under the same number.
    """
    spark = glyphs.sparkSession
    inked = "size(curves) > 0 AS inked"
    t = takes(glyphs.selectExpr("font_id", "glyph_id", "ch", "name", "kind", "ord", inked))
    one = t.groupBy("font_id", "ch").agg(
        F.min_by(F.struct("name", "kind", "ord", "inked"), "take").alias("f"),
        F.collect_list(F.when((F.col("take") > 0) & (F.col("kind") == "required"), F.struct("take", "inked"))).alias("later"))
    one = one.where("f.kind IN ('required', 'ligature')").select("font_id", "ch", "f.*", "later")
    made = dims.derived(spark).groupBy("src").agg(F.collect_list(F.struct("name", "ch", "ord")).alias("made"))
    one = one.join(F.broadcast(made), F.expr("kind = 'required' AND name = src"), "left")
    fields = ("'name', {name}, 'ch', {ch}, 'kind', {kind}, 'variant_of', {of}, 'v', {v}, 'ord', {ord}, 'inked', {inked}")

    def row(**f):
        return "named_struct(" + fields.format(**f) + ")"

    none = "cast(NULL AS string)"
    own = row(name="name", ch="ch", kind="kind", of=none, v="0", ord="ord", inked="inked")
    take = "filter(later, t -> t.take = n)"
    alt = row(name="concat(name, '.alt', cast(n AS string))", ch=none, kind=f"IF(size({take}) > 0, 'take', 'jitter')", of="name", v="n", ord="ord",
              inked=f"IF(size({take}) > 0, {take}[0].inked, inked)")
    other = row(name="d.name", ch="d.ch", kind="'derived'", of=none, v="0", ord="200 + d.ord", inked="inked")
    every = (f"concat(array({own}), IF(kind = 'required', transform(sequence(1, {VARIANTS - 1}), n -> {alt}), array()),"
             f" transform(coalesce(made, array()), d -> {other}))")
    g = one.selectExpr("font_id", f"inline({every})").where("inked").drop("inked")
    k = F.row_number().over(W.partitionBy("font_id").orderBy(F.col("variant_of").isNotNull(), "ord", "v"))
    styles = ", ".join(f"'{s[0]}'" for s in dims.STYLES)
    return g.withColumn("gid", k + 1).selectExpr("font_id", f"explode(array({styles})) AS style", "name", "ch", "kind", "variant_of", "v", "ord", "gid")


def style_extent(styled: DataFrame) -> DataFrame:
    """Ascender and descender of each style, the box of .notdef (650 high) included."""
    e = styled.groupBy("font_id", "style").agg(F.greatest(F.lit(650.0), F.max("by1")).alias("hi"), F.least(F.lit(0.0), F.min("by0")).alias("lo"))
    return e.selectExpr("font_id", "style", "cast(greatest(ceil(hi * 1.06D), 750) AS int) AS ascender",
                        "cast(least(floor(lo * 1.06D), -200) AS int) AS descender")


def style_kerning(kerns: DataFrame, index: DataFrame) -> DataFrame:
    """pairs as glyph numbers of each style; pairs with an absent glyph drop out."""
    i = index.where("ch IS NOT NULL").select("font_id", "style", "ch", "gid")
    left = i.select("font_id", "style", F.col("ch").alias("left_ch"), F.col("gid").alias("left_gid"))
    right = i.select("font_id", "style", F.col("ch").alias("right_ch"), F.col("gid").alias("right_gid"))
    return kerns.join(left, ["font_id", "left_ch"]).join(right, ["font_id", "style", "right_ch"]).select(
        "font_id", "style", "left_gid", "right_gid", "value")


def kern_tables(kerns: DataFrame) -> DataFrame:
    """F8, one row a font with pairs: its classes, the bytes of its matrix and whether that fits its table.

    The fonts that do not fit are the ones ``kern_classes`` has no rows for.
    """
    n = kerns.groupBy("font_id").agg((F.countDistinct("left_ch") + 1).cast("int").alias("n1"), (F.countDistinct("right_ch") + 1).cast("int").alias("n2"))
    return n.selectExpr("font_id", "n1 AS left_classes", "n2 AS right_classes", "cast(n1 AS bigint) * n2 * 2 AS matrix_bytes",
                        f"cast(n1 AS bigint) * n2 * 2 <= {MAX_TABLE_BYTES} AS fits")


def kern_classes(kerns: DataFrame) -> DataFrame:
    """F8: kerning as a dense matrix of classes numbered by first appearance, class 0 included.

    kerns(font_id, left_ch, right_ch, left_ord, right_ord, value), in order of left then right
    glyph. Fonts whose matrix would not fit its table have no rows; ``kern_tables`` names them. Alternates share the class of
    their base, so classes are named by base character. The pairs are read once, a font (characters squared at most) at a time.
    """
    k = kerns.select("font_id", "left_ch", "right_ch", "left_ord", "right_ord", "value")
    return k.groupBy("font_id").applyInArrow(_class_matrix, T.StructType([
        k.schema["font_id"], *[T.StructField(c, T.IntegerType()) for c in ("c1", "c2", "value")]]))


def _class_matrix(font: pa.Table) -> pa.Table:
    """The cells of one font's matrix; none if it does not fit."""
    font = font.sort_by([(c, "ascending") for c in ("left_ord", "right_ord", "left_ch", "right_ch")])
    (left, lefts), (right, rights) = (pd.factorize(font[c].to_pandas()) for c in ("left_ch", "right_ch"))
    n1, n2 = len(lefts) + 1, len(rights) + 1
    fits = n1 * n2 * 2 <= MAX_TABLE_BYTES
    cells = np.zeros((n1, n2) if fits else (0, n2), np.int32)
    if fits:
        cells[left + 1, right + 1] = np.clip(font["value"].fill_null(0).to_numpy(), -32768, 32767)
    c1, c2 = (at.ravel().astype(np.int32) for at in np.indices(cells.shape))
    return pa.table({"font_id": font["font_id"].take(pa.array(np.zeros(cells.size, np.int64))), "c1": c1, "c2": c2, "value": cells.ravel()})


def ligature_sets(index: DataFrame) -> DataFrame:
    """ligatures by their first letter's glyph, longest first; left out if any letter has no glyph.

    index(font_id, style, name, ch, kind, ord, gid).
    """
    lig = index.where("kind = 'ligature'").select("font_id", "style", F.col("gid").alias("lig_gid"), F.col("ord").alias("o"),
                                                  F.posexplode(F.filter(F.split("ch", ""), lambda c: c != "")).alias("i", "part"))
    base = index.where("kind = 'required'").select("font_id", "style", F.col("ch").alias("part"), "gid")
    p = lig.join(base, ["font_id", "style", "part"], "left").groupBy("font_id", "style", "lig_gid", "o").agg(
        F.sort_array(F.collect_list(F.struct("i", "gid"))).alias("p"))
    p = p.where("size(p) >= 2 AND NOT exists(p, e -> e.gid IS NULL)").selectExpr(
        "font_id", "style", "p[0].gid AS first_gid", "lig_gid", "o", "transform(slice(p, 2, size(p)), e -> e.gid) AS rest")
    k = F.row_number().over(W.partitionBy("font_id", "style", "first_gid").orderBy(F.desc(F.size("rest")), "o"))
    return p.withColumn("k", k).drop("o")


def alternate_map(index: DataFrame) -> DataFrame:
    """base glyph to its first and second alternate; the first stands in for a missing second."""
    a = index.where("variant_of IS NOT NULL").groupBy("font_id", "style", F.col("variant_of").alias("name")).agg(
        F.max(F.when(F.col("v") == 1, F.col("gid"))).alias("alt1"), F.max(F.when(F.col("v") == 2, F.col("gid"))).alias("alt2"))
    b = index.where("variant_of IS NULL").select("font_id", "style", "name", "gid")
    return b.join(a.where("alt1 IS NOT NULL"), ["font_id", "style", "name"]).select(
        "font_id", "style", "gid", "alt1", F.coalesce("alt2", "alt1").alias("alt2"))


def slug(c: str, unnamed: str = "family") -> str:
    """SQL: a name made safe for a file; runs of other characters become one dash, and ``unnamed`` stands for nothing left."""
    return f"coalesce(nullif(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9]+', '-'), '^-|-$', ''), ''), '{unnamed}')"


def style_manifest(index: DataFrame, kerns: DataFrame, families: DataFrame) -> DataFrame:
    """Files of a family and what is in them; .notdef and space are counted as the styles have them."""
    n = index.groupBy("font_id", "style").agg(
        (F.count("*") + 2).alias("glyph_count"), (F.count_if(~F.col("name").contains(".alt")) + 1).alias("char_count"))
    k = kerns.groupBy("font_id", "style").agg(F.count("*").alias("kern_count"))
    f = families.selectExpr("font_id", f"{slug('family')} AS slug")
    return n.join(k, ["font_id", "style"], "left").na.fill(0, ["kern_count"]).join(f, "font_id").selectExpr(
        "font_id", "style", f"concat(slug, '-', {slug('style')}, '.otf') AS file", "glyph_count", "char_count", "kern_count")


SHAPE_VERSION = 1


def snapshot(glyphs: DataFrame) -> DataFrame:
    """Glyphs as they are stored: no rasters, numbers to two decimals, a version to tell shapes apart."""
    two = "floor({p}.{a} * 100 + 0.5) / 100"
    g = map_points(glyphs, two.format(p="{p}", a="x"), two.format(p="{p}", a="y"))
    nums = [c for c, t in glyphs.dtypes if t == "double"]
    return g.select(F.lit(SHAPE_VERSION).alias("version"), *[
        (half_up(F.col(c) * 100) / 100).alias(c) if c in nums else F.col(c) for c in g.columns])


def save_snapshot(glyphs: DataFrame, path: str) -> None:
    """Compressed JSON lines, one folder per version; other versions' folders stay."""
    snapshot(glyphs).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy(
        "version").json(path)


def load_snapshot(spark, path: str, schema) -> DataFrame:
    """Stored glyphs of this version; any other is left alone, and its folder is not even read."""
    return spark.read.schema(schema).json(path).where(F.col("version") == SHAPE_VERSION)


def weigh(glyphs: DataFrame, raster: str) -> DataFrame:
    """Size of each font's snapshot in bytes: its glyphs' JSON before compression, in UTF-8, and their rasters."""
    body = F.octet_length(F.to_json(F.struct(*[c for c in glyphs.columns if c != raster])))
    return glyphs.groupBy("font_id").agg(F.sum(body).alias("body"), F.sum(F.length(raster)).alias("rasters"))
