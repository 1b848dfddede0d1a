"""The quality report: findings per font, their score, and the checks behind them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillwork.functions import dims
from quillwork.functions.num import half_up

# --- fixed values -----------------------------------------------------------------------
COARSE = 12
VERY_COARSE = 20
SIMILAR = 0.93
SIG = 14
WANTED_MOST = 5000  # characters of a charset
LEAN_DEG = 4.0
FAINT = 0.06
TALL, SHORT, ENOUGH = 1.5, 0.6, 4
BROAD, FINE, ODD_PENS, NAMED = 1.8, 0.5, 2, 8
ERROR, EACH, WARN, WARN_MOST, COVERED = 12, 2, 5, 8, 25
EXCELLENT, GOOD, USABLE = 92, 78, 60
# ----------------------------------------------------------------------------------------


def resolution(solved: DataFrame) -> DataFrame:
    """H4: typical x-height in pixels and units per pixel of each font."""
    s = solved.where("x_height > 0 AND scale > 0").groupBy("font_id").agg(
        half_up(F.median("x_height")).cast("int").alias("x_height_px"),
        half_up(F.median("scale")).cast("int").alias("units_per_pixel"))
    return s.withColumn("level", F.when(F.col("units_per_pixel") > VERY_COARSE, "warn")
                        .when(F.col("units_per_pixel") > COARSE, "info"))


def missing_chars(captured: DataFrame, attempted: DataFrame | None, spark) -> DataFrame:
    """H5: required characters a font lacks, split by whether their sheet was photographed.

    captured(font_id, ch), attempted(font_id, sheet_no) or None when every sheet counts.
    """
    req = dims.required(spark).join(
        F.broadcast(dims.sheets(spark, ligatures=False).select("ch", "sheet_no")), "ch")
    have = captured.select("font_id", "ch").distinct()
    fonts = have.select("font_id").distinct()
    # a literal array of the required characters: one explode per font, no cross product of tables
    need = fonts.withColumn("ord", F.explode(F.expr("sequence(0, 111)"))).join(
        req.select("ord", "ch", "grp", "sheet_no"), "ord")
    miss = need.join(have, ["font_id", "ch"], "left_anti")
    if attempted is None:
        miss = miss.withColumn("tried", F.lit(True))
    else:
        a = attempted.select("font_id", "sheet_no").distinct().withColumn("tried", F.lit(True))
        miss = miss.join(a, ["font_id", "sheet_no"], "left").na.fill(False, ["tried"])
    letter = F.col("grp").isin("lower", "upper")
    return miss.select(
        "font_id", "ord", "ch",
        F.when(F.col("tried") & letter, "missing-letters").when(F.col("tried"), "missing-symbols")
        .otherwise("not-written").alias("code"))


def faint(areas: DataFrame) -> DataFrame:
    """H6: glyphs whose ink is far below the font's median; areas(font_id, o, ch, area)."""
    mid = areas.where("area > 0").groupBy("font_id").agg(F.median("area").alias("mid"))
    a = areas.join(mid, "font_id", "left").na.fill(1.0, ["mid"])
    return a.where((F.col("area") < F.col("mid") * FAINT) & ~F.col("ch").isin(*dims.SMALL_MARKS)).drop("mid")


def size_outlier(glyphs: DataFrame) -> DataFrame:
    """H7: glyphs out of proportion within their zone; glyphs(font_id, o, ch, zone, height)."""
    g = glyphs.where(~F.col("zone").isin("full", "mid"))
    mid = g.groupBy("font_id", "zone").agg(F.median("height").alias("mid"), F.count("*").alias("n"))
    g = g.join(mid.where(f"n >= {ENOUGH}"), ["font_id", "zone"])
    return g.withColumn("ratio", F.try_divide("height", "mid")).where(f"ratio > {TALL} OR ratio < {SHORT}").drop("mid", "n")


def stroke_weight(widths: DataFrame) -> DataFrame:
    """H8: glyphs of odd pen weight, when a font has more than two; the first eight are named.

    widths(font_id, o, ch, t). The threshold filter runs before the ranking, and ranking to eight
    is pruned before the shuffle.
    """
    w = widths.where((F.col("t") > 0) & ~F.col("ch").isin(*dims.SMALL_MARKS))
    mid = w.groupBy("font_id").agg(F.median("t").alias("mid"))
    odd = w.join(mid, "font_id").where(f"t > mid * {BROAD} OR t < mid * {FINE}")
    many = odd.groupBy("font_id").agg(F.count("*").alias("n")).where(f"n > {ODD_PENS}")
    rank = F.row_number().over(W.partitionBy("font_id").orderBy("o"))
    return odd.withColumn("k", rank).where(f"k <= {NAMED}").join(many, "font_id").select("font_id", "k", "ch", "o", "n")


def signature(pixels: DataFrame, n: int = SIG) -> DataFrame:
    """H1: share of ink in each cell of an n x n grid over the ink box.

    pixels(glyph_id, x, y, ink) of one glyph's bitmap. The box is a small aggregate joined back.
    """
    box = pixels.where("ink").groupBy("glyph_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"),
        (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    p = pixels.join(box, "glyph_id").where("x >= x0 AND x < x1 AND y >= y0 AND y < y1").selectExpr(
        "glyph_id", "ink",
        f"least({n - 1}, cast(floor((y - y0) / cast(y1 - y0 AS double) * {n}) AS int)) AS gy",
        f"least({n - 1}, cast(floor((x - x0) / cast(x1 - x0 AS double) * {n}) AS int)) AS gx")
    return p.groupBy("glyph_id", (F.col("gy") * n + F.col("gx")).alias("cell")).agg(
        (F.count_if(F.col("ink")) / F.count("*")).alias("share"))


def signature_vectors(sig: DataFrame, n: int = SIG) -> DataFrame:
    """Dense signature per glyph: cells without pixels are zero."""
    cells = sig.groupBy("glyph_id").agg(F.sort_array(F.collect_list(F.struct("cell", "share"))).alias("s"))
    # walk the sorted cells once, padding the holes before each with zeros
    return cells.select("glyph_id", F.expr(
        f"""aggregate(s, array_repeat(0D, 0), (acc, e) ->
             concat(acc, array_repeat(0D, e.cell - size(acc)), array(e.share)),
             acc -> concat(acc, array_repeat(0D, {n * n} - size(acc))))""").alias("sig"))


def lookalikes(glyphs: DataFrame, sigs: DataFrame, above: float = SIMILAR) -> DataFrame:
    """H2: pairs of letters or digits of a font that nearly coincide.

    glyphs(glyph_id, font_id, ord, ch, grp). One glyph per character takes part, so a font yields
    at most 62 x 61 / 2 pairs however large the corpus is.
    """
    g = glyphs.where(F.col("grp").isin("lower", "upper", "digit")).groupBy("font_id", "ch").agg(
        F.min_by(F.struct("glyph_id", "ord"), F.struct("ord", "glyph_id")).alias("s")).select(
        "font_id", "ch", "s.glyph_id", "s.ord").join(sigs, "glyph_id")
    a = g.selectExpr("font_id", "ch AS a", "ord AS a_ord", "sig AS a_sig")
    b = g.selectExpr("font_id", "ch AS b", "ord AS b_ord", "sig AS b_sig")
    p = a.join(b, "font_id").where("a_ord < b_ord AND lower(a) <> lower(b)")
    s = p.withColumn("similarity", F.expr(
        "1 - aggregate(zip_with(a_sig, b_sig, (u, v) -> abs(u - v)), 0D, (s, d) -> s + d) / size(a_sig)"))
    return s.where(F.col("similarity") > above).select("font_id", "a", "b", "a_ord", "b_ord", "similarity")


def top_lookalikes(pairs: DataFrame, k: int = 4) -> DataFrame:
    """The k closest pairs of each font, in reading order among equals."""
    w = W.partitionBy("font_id").orderBy(F.desc("similarity"), "a_ord", "b_ord")
    return pairs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)


def stroke_width(ink: DataFrame) -> DataFrame:
    """H3: twice the area over the edge length; ink(glyph_id, y, x) of the bitmap.

    An ink pixel is an edge unless all four neighbours are ink. Neighbours are found by handing
    every pixel to the four beside it: one shuffle instead of four joins.
    """
    near = ink.selectExpr(
        "glyph_id", "explode(array(named_struct('y', y, 'x', x, 'me', 1), named_struct('y', y - 1, 'x', x, 'me', 0),"
        " named_struct('y', y + 1, 'x', x, 'me', 0), named_struct('y', y, 'x', x - 1, 'me', 0),"
        " named_struct('y', y, 'x', x + 1, 'me', 0))) AS e").select("glyph_id", "e.*")
    px = near.groupBy("glyph_id", "y", "x").agg(F.max("me").alias("me"), F.count("*").alias("n")).where("me = 1")
    return px.groupBy("glyph_id").agg(
        F.count("*").alias("area"), F.count_if(F.col("n") < 5).alias("perimeter")).select(
        "glyph_id", "area", "perimeter",
        F.when(F.col("perimeter") > 0, 2.0 * F.col("area") / F.col("perimeter")).otherwise(0.0).alias("stroke_width"))


def _finding(df: DataFrame, rank: int, level, code: str) -> DataFrame:
    lvl = F.lit(level) if isinstance(level, str) else level
    return df.select("font_id", F.lit(rank).alias("rank"), lvl.alias("level"), F.lit(code).alias("code"), "n")


def findings(res, missing, faint_, look, outliers, weight, shaky, lean) -> DataFrame:
    """Every finding of a font in fixed order, with the number of characters it names."""
    def per_font(df):
        return df.groupBy("font_id").agg(F.count("*").alias("n"))

    def of(code):
        return per_font(missing.where(F.col("code") == code))

    parts = [
        _finding(res.where("level IS NOT NULL").withColumn("n", F.lit(0).cast("bigint")), 0, F.col("level"), "low-resolution"),
        _finding(of("missing-letters"), 1, "error", "missing-letters"),
        _finding(of("missing-symbols"), 2, "warn", "missing-symbols"),
        _finding(of("not-written"), 3, "info", "not-written"),
        _finding(per_font(faint_), 4, "warn", "faint"),
        _finding(per_font(look.select("font_id", F.explode(F.array("a", "b")).alias("ch")).distinct()), 5, "warn", "lookalike"),
        _finding(per_font(outliers), 6, "warn", "size-outlier"),
        _finding(per_font(weight), 7, "info", "stroke-weight"),
        _finding(per_font(shaky), 8, "info", "row-confidence"),
        _finding(lean.withColumn("n", F.lit(0).cast("bigint")), 9, "info", "slant"),
    ]
    return reduce(DataFrame.unionByName, parts)


def health_score(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Score and label; counts(font_id, captured, expected)."""
    cost = (F.when(F.col("level") == "error", ERROR + EACH * F.col("n"))
            .when(F.col("level") == "warn", WARN + F.least(F.lit(WARN_MOST), F.col("n"))).otherwise(F.lit(1)))
    c = counts.join(found.groupBy("font_id").agg(F.sum(cost).alias("cost")), "font_id", "left").na.fill(0, ["cost"])
    share = F.least(F.lit(1.0), F.col("captured") / F.greatest(F.lit(1), F.col("expected")))
    score = 100 - F.col("cost") - half_up((1 - share) * COVERED)
    c = c.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"))
    return c.withColumn("label", score_label(F.col("score"))).drop("cost")


def score_label(score):
    """H12"""
    return (F.when(score >= EXCELLENT, "Excellent").when(score >= GOOD, "Good")
            .when(score >= USABLE, "Usable").otherwise("Needs work"))


# --- the whole report from one row a font ---------------------------------------------------
SIZED = ("x", "asc", "desc", "base", "high")  # zones whose glyphs are held against each other


def measures(solved: DataFrame) -> DataFrame:
    """What H4 to H9 count, one row a font: two passes over the glyphs in their rows, each one aggregate by font.

    solved: rows as ``metrics.solved_from`` gives them, with glyphs array<struct<ch, zone, y0, y1, area, t>>. The first pass takes
    every median a font is held against, the second counts what departs from them and which characters and sheets there are.
    """
    g = solved.select("font_id", "sheet_no", "x_height", "scale", "baseline", "confident", F.posexplode("glyphs").alias("pos", "g")).select(
        "font_id", "sheet_no", "x_height", "scale", "confident", "pos", "g.ch", "g.zone", "g.area", "g.t",
        ((F.col("baseline") - F.col("g.y0")) * F.col("scale") - (F.col("baseline") - F.col("g.y1")) * F.col("scale")).alias("height"))
    row = (F.col("pos") == 0) & (F.col("x_height") > 0) & (F.col("scale") > 0)
    small = F.col("ch").isin(*dims.SMALL_MARKS)
    pen = (F.col("t") > 0) & ~small
    zone = {z: F.col("zone") == z for z in SIZED}
    mid = g.groupBy("font_id").agg(
        F.median(F.when(row, F.col("x_height"))).alias("row_x"), F.median(F.when(row, F.col("scale"))).alias("row_scale"),
        F.median(F.when(F.col("area") > 0, F.col("area"))).alias("mid_area"), F.median(F.when(pen, F.col("t"))).alias("mid_t"),
        *[F.median(F.when(c, F.col("height"))).alias(f"mid_{z}") for z, c in zone.items()], *[F.count_if(c).alias(f"n_{z}") for z, c in zone.items()])
    ratio = F.coalesce(*[F.when(c & (F.col(f"n_{z}") >= ENOUGH), F.try_divide("height", F.col(f"mid_{z}"))) for z, c in zone.items()])
    held = ["row_x", "row_scale"]
    return g.join(mid, "font_id").groupBy("font_id").agg(
        *[F.first(c).alias(c) for c in held], F.collect_set("ch").alias("captured"), F.collect_set("sheet_no").alias("tried"),
        F.count_if((F.col("area") < F.coalesce("mid_area", F.lit(1.0)) * FAINT) & ~small).alias("faint"),
        F.count_if((ratio > TALL) | (ratio < SHORT)).alias("outliers"),
        F.count_if(pen & ((F.col("t") > F.col("mid_t") * BROAD) | (F.col("t") < F.col("mid_t") * FINE))).alias("odd_pens"),
        F.count_if((F.col("pos") == 0) & ~F.col("confident")).alias("shaky"))


def alike_chars(glyphs: DataFrame, vectors: DataFrame, k: int = 4) -> DataFrame:
    """H2 for the report: (font_id, n), the characters in a font's ``k`` closest look-alike pairs, found inside its row.

    A font has one glyph for each of 62 characters there, so its row is bounded.
    """
    first = glyphs.where(F.col("grp").isin("lower", "upper", "digit")).join(vectors, "glyph_id").groupBy("font_id", "ch").agg(
        F.min_by(F.struct("ord", "sig"), F.struct("ord", "glyph_id")).alias("s"))
    font = first.groupBy("font_id").agg(F.sort_array(F.collect_list(F.struct(F.col("s.ord").alias("ord"), "ch", F.col("s.sig").alias("sig")))).alias("g"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for font_id, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sig = np.array([e["sig"] for e in g])
                pairs = []
                for i, e in enumerate(g):
                    near = np.round(1 - np.abs(sig[i] - sig[i + 1 :]).sum(axis=1) / sig.shape[1], 9)
                    pairs += [(-near[j], i, i + 1 + j) for j in np.flatnonzero(near > SIMILAR) if e["ch"].lower() != g[i + 1 + j]["ch"].lower()]
                named = {g[i]["ch"] for _, *both in sorted(pairs)[:k] for i in both}
                if named:
                    out.append((font_id, len(named)))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], names=["font_id", "n"])

    return font.mapInArrow(go, "font_id bigint, n bigint")


def box_vectors(images: DataFrame, n: int = SIG) -> DataFrame:
    """H1 inside the row: images(glyph_id, w, ink array<boolean> in raster order) to (glyph_id, sig), without a shuffle. Images without
    ink have no row."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for gid, w, ink in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                m = np.array(ink, dtype=bool).reshape(-1, w)
                if not m.any():
                    continue
                ys, xs = np.flatnonzero(m.any(axis=1)), np.flatnonzero(m.any(axis=0))
                m = m[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1]
                gy, gx = (np.minimum(n - 1, np.floor(np.arange(k) / k * n)).astype(int) for k in m.shape)
                cell = (gy[:, None] * n + gx[None]).ravel()
                all_, inked = np.bincount(cell, minlength=n * n), np.bincount(cell, weights=m.ravel(), minlength=n * n)
                ids.append(gid)
                out.append(inked / np.maximum(all_, 1))
            ends = pa.array(np.arange(0, len(out) * n * n + 1, n * n, dtype=np.int32))
            flat = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["glyph_id", "sig"])

    return images.select("glyph_id", "w", "ink").mapInArrow(go, "glyph_id bigint, sig array<double>")


def report(told: DataFrame, alike: DataFrame, slant: DataFrame) -> DataFrame:
    """H11 to H13 from one row a font: captured, expected, findings array<struct<rank, level, code, n>>, score and label.

    told: ``measures``; alike(font_id, n): ``alike_chars``; slant(font_id, slant). Missing characters are looked up in the literal
    list of required ones, inside the row.
    """
    sheet = {r[6]: r[0] for r in dims.sheet_rows() if r[0] < len(dims.SHEETS)}
    need = F.array(*[F.struct(F.lit(r[1]).alias("ch"), F.lit(r[6] in ("lower", "upper")).alias("letter"), F.lit(sheet[r[1]]).alias("sheet"))
                     for r in dims.charset_rows() if r[7] == "required" and r[1] in sheet])
    sizes = F.array(*[F.struct(F.lit(no).alias("no"), F.lit(sum(r[0] == no for r in dims.sheet_rows())).alias("n")) for no in range(len(dims.SHEETS))])
    t = told.join(alike.withColumnRenamed("n", "alike"), "font_id", "left").join(slant.select("font_id", "slant"), "font_id", "left")
    t = t.withColumn("units", half_up(F.col("row_scale")))
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a generator, so that what several columns use is worked out once a row
    t = t.withColumn("missing", once(F.array_except(F.transform(need, lambda e: e.ch), "captured"))).withColumn(
        "missing", once(F.filter(need, lambda e: F.array_contains(F.col("missing"), e.ch))))
    tried = lambda e: F.array_contains(F.col("tried"), e.sheet)
    zero = F.lit(0).cast("bigint")

    def finding(rank: int, level, code: str, when, n):
        level = F.lit(level) if isinstance(level, str) else level
        return F.when(when, F.struct(F.lit(rank).alias("rank"), level.alias("level"), F.lit(code).alias("code"), n.cast("bigint").alias("n")))

    letters = F.size(F.filter("missing", lambda e: tried(e) & e.letter))
    symbols = F.size(F.filter("missing", lambda e: tried(e) & ~e.letter))
    unwritten = F.size(F.filter("missing", lambda e: ~tried(e)))
    col = F.col
    found = F.array_compact(F.array(
        finding(0, F.when(col("units") > VERY_COARSE, "warn").otherwise("info"), "low-resolution", col("units") > COARSE, zero),
        finding(1, "error", "missing-letters", letters > 0, letters), finding(2, "warn", "missing-symbols", symbols > 0, symbols),
        finding(3, "info", "not-written", unwritten > 0, unwritten), finding(4, "warn", "faint", col("faint") > 0, col("faint")),
        finding(5, "warn", "lookalike", col("alike") > 0, col("alike")), finding(6, "warn", "size-outlier", col("outliers") > 0, col("outliers")),
        finding(7, "info", "stroke-weight", col("odd_pens") > ODD_PENS, F.least(F.lit(NAMED), col("odd_pens"))),
        finding(8, "info", "row-confidence", col("shaky") > 0, col("shaky")), finding(9, "info", "slant", F.abs("slant") > LEAN_DEG, zero)))
    t = t.select("font_id", F.size("captured").cast("bigint").alias("captured"), once(found).alias("findings"),
                 F.aggregate(F.filter(sizes, lambda e: F.array_contains(F.col("tried"), e.no)), F.lit(0).cast("bigint"), lambda a, e: a + e.n).alias("expected"))
    cost = F.aggregate("findings", zero, lambda a, e: a + F.when(e.level == "error", ERROR + EACH * e.n).when(
        e.level == "warn", WARN + F.least(F.lit(WARN_MOST), e.n)).otherwise(1))
    share = F.least(F.lit(1.0), col("captured") / F.greatest(F.lit(1), col("expected")))
    t = t.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - cost - half_up((1 - share) * COVERED))).cast("int"))
    return t.select("font_id", "captured", "expected", "findings", "score", score_label(col("score")).alias("label"))


def audit(layouts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every character of a layout or of the wanted ones, with its number of cells and a verdict.

    layouts(layout_id, ch) has one row per cell, wanted(ch) the characters each layout should hold once. ``missing`` has no
    cell, ``duplicated`` more than one, ``unknown`` is laid out but not wanted.
    """
    cells = layouts.groupBy("layout_id", "ch").agg(F.count("*").alias("cells"))
    # the wanted characters meet the layouts through the cells they have; what a layout has none of is what is left of the list
    want = wanted.select("ch").distinct().withColumn("wanted", F.lit(True))
    told = cells.join(want, "ch", "left").select("layout_id", "ch", "cells", "wanted")
    chars = [r["ch"] for r in want.select("ch").limit(WANTED_MOST + 1).collect()]
    if len(chars) > WANTED_MOST:
        raise ValueError(f"a layout is audited against {WANTED_MOST} characters at most")
    held = cells.groupBy("layout_id").agg(F.collect_set(F.when(F.col("ch").isin(chars), F.col("ch"))).alias("has"))
    lacking = held.select("layout_id", F.explode(F.array_except(F.array(*map(F.lit, chars)).cast("array<string>"), "has")).alias("ch"))
    both = told.unionByName(lacking.select("layout_id", "ch", F.lit(0).cast("bigint").alias("cells"), F.lit(True).alias("wanted")))
    verdict = (F.when(F.col("wanted").isNull(), "unknown").when(F.col("cells") == 0, "missing")
               .when(F.col("cells") > 1, "duplicated").otherwise("ok"))
    return both.select("layout_id", "ch", "cells", verdict.alias("verdict"))
