"""Outlines that come as path commands of an existing font."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions import dims
from quillwork.functions.shuffle import held
from quillwork.operators import metrics as M
from quillwork.operators.outline import bounds

# --- fixed values -----------------------------------------------------------------------
RESTRICTED, NO_SUBSET, BITMAP_ONLY = 0x0002, 0x0100, 0x0200
MIN_X_SHARE = 0.05
RECORDS = {"family": ["fontFamily", "preferredFamily"], "designer": ["designer"], "description": ["license", "licence"],
           "url": ["licenseURL", "licenceURL"]}
# ----------------------------------------------------------------------------------------
PT = "struct<x: double, y: double>"
CURVES = f"array<struct<contour: int, p0: {PT}, c1: {PT}, c2: {PT}, p3: {PT}>>"


def _pt(x: str, y: str) -> str:
    return f"named_struct('x', {x}, 'y', {y})"


def _toward(a: str, b: str, num: int) -> str:
    """The point num/3 of the way from a to b."""
    f = "{a}.{v} + ({n} * ({b}.{v} - {a}.{v})) / 3" if num == 2 else "{a}.{v} + ({b}.{v} - {a}.{v}) / 3"
    return _pt(*[f.format(a=a, b=b, v=v, n=num) for v in "xy"])


def _line(a: str, b: str) -> str:
    return f"named_struct('contour', s.k, 'p0', {a}, 'c1', {_toward(a, b, 1)}, 'c2', {_toward(a, b, 2)}, 'p3', {b})"


def path_to_cubics(glyphs: DataFrame) -> DataFrame:
    """Path commands to cubic curves, folded along the commands of one glyph.

    glyphs(..., cmds array<struct<type, x, y, x1, y1, x2, y2>>). Straight lines take handles at
    thirds, quadratics at two thirds, open contours are closed, commands of any other kind are
    passed over, and a contour with positive area is an outer one.
    """
    to = _pt("c.x", "c.y")
    quad = ("named_struct('contour', s.k, 'p0', s.cur,"
            f" 'c1', {_pt('s.cur.x + 2D / 3 * (c.x1 - s.cur.x)', 's.cur.y + 2D / 3 * (c.y1 - s.cur.y)')},"
            f" 'c2', {_pt('c.x + 2D / 3 * (c.x1 - c.x)', 'c.y + 2D / 3 * (c.y1 - c.y)')}, 'p3', {to})")
    has_x2 = "x2" in glyphs.schema["cmds"].dataType.elementType.names
    cubic = (f"named_struct('contour', s.k, 'p0', s.cur, 'c1', {_pt('c.x1', 'c.y1')}, 'c2', {_pt('c.x2', 'c.y2')}, 'p3', {to})"
             if has_x2 else f"cast(NULL AS struct<contour: int, p0: {PT}, c1: {PT}, c2: {PT}, p3: {PT}>)")
    state = "named_struct('cur', {cur}, 'start', {start}, 'k', {k}, 'open', {open}, 'out', {out})"
    closing = f"IF(s.open AND (s.cur.x <> s.start.x OR s.cur.y <> s.start.y), concat(s.out, array({_line('s.cur', 's.start')})), s.out)"
    next_k = "s.k + IF(s.open, 1, 0)"
    none = f"cast(NULL AS {PT})"

    def draw(curve: str) -> str:
        return state.format(cur=to, start="s.start", k="s.k", open="s.open OR s.cur IS NOT NULL",
                            out=f"IF(s.cur IS NULL, s.out, concat(s.out, array({curve})))")

    fold = ("aggregate(cmds, " + state.format(cur=none, start=none, k="0", open="false", out=f"cast(array() AS {CURVES})") + ", (s, c) -> CASE c.type"
            " WHEN 'M' THEN " + state.format(cur=to, start=to, k=next_k, open="false", out=closing) +
            f" WHEN 'L' THEN {draw(_line('s.cur', to))} WHEN 'C' THEN {draw(cubic)} WHEN 'Q' THEN {draw(quad)}"
            " WHEN 'Z' THEN " + state.format(cur="s.start", start="s.start", k=next_k, open="false", out=closing) + " ELSE s END, s -> " + closing + ")")
    g = held(glyphs, raw=fold)
    # area of each contour, from the starting points of its curves
    g = held(g, loops="transform(array_distinct(transform(raw, r -> r.contour)), k -> named_struct('k', k, 'p',"
                      " transform(filter(raw, r -> r.contour = k), r -> r.p0)))")
    g = held(g, areas="transform(loops, l -> named_struct('k', l.k, 'a', aggregate(transform(l.p, (p, i) ->"
                      " p.x * l.p[(i + 1) % size(l.p)].y - l.p[(i + 1) % size(l.p)].x * p.y), 0D, (a, v) -> a + v)))")
    g = held(g, curves="transform(raw, (r, i) -> named_struct('contour', r.contour, 'seq', i,"
                       " 'outer', filter(areas, a -> a.k = r.contour)[0].a > 0, 'p0', r.p0, 'c1', r.c1, 'c2', r.c2, 'p3', r.p3))")
    return g.drop("raw", "loops", "areas", "cmds")


def map_points(o: DataFrame, x: str, y: str, col: str = "curves") -> DataFrame:
    """Replace every control point; ``x`` and ``y`` are SQL over ``{p}``."""
    pts = ", ".join(f"'{n}', named_struct('x', {x.format(p='c.' + n)}, 'y', {y.format(p='c.' + n)})" for n in ("p0", "c1", "c2", "p3"))
    moved = f"transform({col}, c -> named_struct('contour', c.contour, 'seq', c.seq, 'outer', c.outer, {pts}))"
    return held(o.withColumnRenamed(col, "_was"), **{col: moved.replace(f"transform({col},", "transform(_was,")}).drop("_was")


def import_scale(glyphs: DataFrame) -> DataFrame:
    """Font units to ours: by the height of the x where it has one, else by the em."""
    b = bounds(glyphs.select("font_id", "ch", "upm", "curves"))
    m = b.groupBy("font_id").agg(F.max("upm").alias("upm"), F.max(
        F.when(F.col("ch") == "x", F.col("by1") - F.greatest(F.lit(0.0), F.col("by0")))).alias("x"))
    return m.select("font_id", F.when(F.col("x") > F.col("upm") * MIN_X_SHARE, M.X / F.col("x")).otherwise(
        F.lit(1000.0) / F.col("upm")).alias("scale"))


def normalise_import(glyphs: DataFrame, scales: DataFrame) -> DataFrame:
    """Glyphs in our units with ink from x = 0, their box, and the bearings they came with."""
    g = map_points(glyphs.join(scales, "font_id"), "{p}.x * scale", "{p}.y * scale")
    g = bounds(g).where("bx0 IS NOT NULL").withColumnRenamed("bx0", "left0")
    g = map_points(g, "{p}.x - left0", "{p}.y")
    keep = [c for c in glyphs.columns if c not in ("curves", "advance", "upm")]
    return g.selectExpr(*keep, "curves", "bx1 - left0 AS ink_width", "by0 AS ink_y0", "by1 AS ink_y1",
                        "left0 AS lsb", "advance * scale - bx1 AS rsb", "advance * scale AS advance")


def exploded(o: DataFrame, *keep: str) -> DataFrame:
    """One row per curve."""
    return o.select("glyph_id", *keep, F.explode("curves").alias("c")).select("glyph_id", *keep, "c.*")


def licence_flags(fonts: DataFrame) -> DataFrame:
    """What a font's embedding bits allow, and its names: the first that is not blank, English first.

    fonts(font_id, fs_type, names array<struct<lang, family>>).
    """
    own = "array_min(transform(names, (n, i) -> struct(IF(n.lang = 'en', -1, i) AS k, trim(n.family) AS v))).v"
    return fonts.selectExpr(
        "font_id", "fs_type", f"(fs_type & {RESTRICTED}) <> 0 AS restricted", f"(fs_type & {NO_SUBSET}) <> 0 AS no_subset",
        f"(fs_type & {BITMAP_ONLY}) <> 0 AS bitmap_only", f"nullif({own}, '') AS family")


def import_coverage(cmap: DataFrame, spark) -> DataFrame:
    """Wanted characters a font has or lacks; cmap(font_id, ch, glyph_name, unicode).

    A character counts as found only if its glyph is a real one and carries its own code point.
    """
    req = dims.required(spark).select("ord", "ch", "unicode")
    wanted = cmap.select("font_id").distinct().withColumn("ord", F.explode(F.expr("sequence(0, 111)"))).join(req, "ord")
    has = cmap.where("glyph_name <> '.notdef'").select("font_id", "ch", "unicode").distinct().withColumn("found", F.lit(True))
    return wanted.join(has, ["font_id", "ch", "unicode"], "left").na.fill(False, ["found"]).select("font_id", "ord", "ch", "found")


def name_text(record: str) -> str:
    """SQL for a font's name record: the English text, else the first one it carries; NULL where that is blank."""
    own = f"filter(names, n -> n.record = '{record}')"
    text = f"coalesce(get(filter({own}, n -> n.lang = 'en'), 0).text, get({own}, 0).text)"
    return f"nullif(regexp_replace({text}, r'^\\s+|\\s+$', ''), '')"


def licence_records(fonts: DataFrame) -> DataFrame:
    """What a font says about itself, one row for each kind of record: (font_id, record, text).

    fonts(font_id, names array<struct<record, lang, text>>). A kind that goes by two names is looked for under the second where
    the first says nothing; a record that is not there or blank has a NULL text.
    """
    each = ", ".join(f"struct('{kind}' AS record, coalesce({', '.join(map(name_text, names))}) AS text)" for kind, names in RECORDS.items())
    return fonts.selectExpr("font_id", f"inline(array({each}))")


def import_gate(fonts: DataFrame) -> DataFrame:
    """Whether a font may be built on: (font_id, restricted, no_subset, bitmap_only, refused).

    Only the restricted bit refuses, whatever permissive bits stand beside it. Without embedding bits nothing is forbidden.
    """
    bits = "coalesce(fs_type, 0)"
    return fonts.selectExpr("font_id", f"({bits} & {RESTRICTED}) <> 0 AS restricted", f"({bits} & {NO_SUBSET}) <> 0 AS no_subset",
                            f"({bits} & {BITMAP_ONLY}) <> 0 AS bitmap_only", f"IF(({bits} & {RESTRICTED}) <> 0, 'restricted', NULL) AS refused")


def importable(glyphs: DataFrame, fonts: DataFrame) -> DataFrame:
    """Glyphs of the fonts that the gate lets through; a font without a licence row is one that says nothing and passes."""
    return glyphs.join(import_gate(fonts).where("restricted").select("font_id"), "font_id", "left_anti")


def import_found(glyphs: DataFrame, wanted: list[str]) -> DataFrame:
    """I6 by outline: for each font and wanted character, whether the font gives it: (font_id, k, ch, found).

    glyphs(font_id, ch, glyph_name, unicode, curves). A character is found if its glyph is a real one, carries its own code
    point and has ink. ``wanted`` is any list of characters, numbered from 0; repeats count once, at their first place.
    """
    each = [F.struct(F.lit(k).alias("k"), F.lit(ch).alias("ch")) for k, ch in enumerate(dict.fromkeys(wanted))]
    drawn = bounds(glyphs.where("glyph_name <> '.notdef' AND unicode = ascii(ch)")).where("bx0 IS NOT NULL")
    asked = glyphs.select("font_id").distinct().withColumn("w", F.explode(F.array(*each))).select("font_id", "w.*")
    return asked.join(drawn.select("font_id", "ch", F.lit(True).alias("found")).distinct(), ["font_id", "ch"], "left").na.fill(
        False, ["found"]).select("font_id", "k", "ch", "found")
