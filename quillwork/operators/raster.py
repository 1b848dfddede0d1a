"""Page images as pixel and run tables.

A page is capped at 4200 px a side before anything here runs, so a scanline, a column and a strip
of lines are bounded; those are the units work is grouped by. Pixels are exploded only up to
thresholding. After it, ink travels as runs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.functions import dims
from quillwork.functions.num import byte, upper_median
from quillwork.session import cut_lineage

# --- fixed values -----------------------------------------------------------------------
MAX_DIM = 4200
MAX_SKEW_DEG = 8
ANALYSIS_DIM = 1200
SAUVOLA_K, SAUVOLA_R, MIN_CONTRAST = 0.28, 128, 8
PAPER = 255
# ----------------------------------------------------------------------------------------
STRIP = 256
WORKING_DIM = math.floor(MAX_DIM / (math.cos(math.radians(MAX_SKEW_DEG)) + math.sin(math.radians(MAX_SKEW_DEG))))


def gray_luma(rgb: DataFrame, drop_blue: bool = False) -> DataFrame:
    """Integer luma of r, g, b; optionally blue printing becomes paper."""
    luma = F.shiftright(F.col("r") * 77 + F.col("g") * 150 + F.col("b") * 29, 8)
    if drop_blue:
        hi, lo = F.greatest("r", "g", "b"), F.least("r", "g", "b")
        blue = ((F.col("b") == hi) & ((hi - lo) / F.when(hi == 0, 1).otherwise(hi) > 0.22)
                & (F.col("b") > 90) & (F.col("b") - F.col("r") > 25))
        luma = F.when(blue, PAPER).otherwise(luma)
    return rgb.withColumn("gray", luma)


def box_downscale(pixels: DataFrame, max_dim: int = ANALYSIS_DIM) -> DataFrame:
    """Block means down to ``max_dim``; blocks do not overlap, so it is one aggregation."""
    p = pixels.selectExpr("*", f"least(1D, {max_dim}D / greatest(w, h)) AS s").selectExpr(
        "*", "cast(greatest(1, floor(w * s + 0.5)) AS int) AS nw", "cast(greatest(1, floor(h * s + 0.5)) AS int) AS nh")
    p = p.selectExpr("*", "w / cast(nw AS double) AS fx", "h / cast(nh AS double) AS fy")

    def cell(v: str, f: str) -> str:
        i = f"(ceil(({v} + 1) / {f}) - 1)"
        return f"cast(CASE WHEN floor({i} * {f}) > {v} THEN {i} - 1 WHEN floor(({i} + 1) * {f}) <= {v} THEN {i} + 1 ELSE {i} END AS int)"

    p = p.selectExpr("scan_id", "nw AS w", "nh AS h", f"{cell('y', 'fy')} AS y", f"{cell('x', 'fx')} AS x", "gray")
    # the last block edge may fall short of the page by a rounding error; what lies beyond is not read
    p = p.where("y < h AND x < w")
    return p.groupBy("scan_id", "w", "h", "y", "x").agg(byte(F.avg("gray")).alias("gray"))


def integral_image(pixels: DataFrame) -> DataFrame:
    """R2: sums of gray and its square over everything above and to the left, the pixel included."""
    along = W.partitionBy("scan_id", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("scan_id", "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    g = F.col("gray").cast("bigint")
    p = pixels.withColumn("s", F.sum(g).over(along)).withColumn("q", F.sum(g * g).over(along))
    return p.withColumn("s", F.sum("s").over(down)).withColumn("q", F.sum("q").over(down))


def rect_sum(integral: DataFrame, rects: DataFrame) -> DataFrame:
    """Sums over half-open rectangles; rects(scan_id, rect, x0, y0, x1, y1).

    Each rectangle asks for its four corners; outside the page a corner counts zero.
    """
    corners = rects.selectExpr(
        "scan_id", "rect", "explode(array(named_struct('x', x1, 'y', y1, 'k', 1), named_struct('x', x1, 'y', y0, 'k', -1),"
        " named_struct('x', x0, 'y', y1, 'k', -1), named_struct('x', x0, 'y', y0, 'k', 1))) AS c").selectExpr(
        "scan_id", "rect", "c.x - 1 AS x", "c.y - 1 AS y", "c.k")
    j = corners.join(integral.select("scan_id", "x", "y", "s", "q"), ["scan_id", "x", "y"], "left").na.fill(0, ["s", "q"])
    return j.groupBy("scan_id", "rect").agg(F.sum(F.expr("s * k")).alias("s"), F.sum(F.expr("q * k")).alias("q"))


def otsu(pixels: DataFrame) -> DataFrame:
    """The gray level that best parts ink from paper; at most 256 rows a page after counting."""
    return otsu_of(pixels.groupBy("scan_id", "gray").agg(F.count("*").cast("double").alias("n")))


def otsu_of(hist: DataFrame) -> DataFrame:
    """The same from counts, hist(scan_id, gray, n)."""
    page = W.partitionBy("scan_id")
    run = page.orderBy("gray").rowsBetween(W.unboundedPreceding, 0)
    t = hist.select(
        "scan_id", "gray", F.sum("n").over(run).alias("wb"), F.sum(F.expr("n * gray")).over(run).alias("sb"),
        F.sum("n").over(page).alias("total"), F.sum(F.expr("n * gray")).over(page).alias("whole"))
    t = t.selectExpr("scan_id", "gray", "wb", "total - wb AS wf", "sb / wb AS mb",
                     "try_divide(whole - sb, total - wb) AS mf")
    best = t.groupBy("scan_id").agg(F.max_by(
        "gray", F.when(F.col("wf") > 0, F.struct(F.expr("wb * wf * (mb - mf) * (mb - mf)"), -F.col("gray")))).alias("t"))
    return best.select("scan_id", F.coalesce("t", F.lit(0)).alias("otsu"))


def _slide(px: DataFrame, line: str, at: str, r: str, sums: list[str], keep: list[str]) -> DataFrame:
    """Sum ``sums`` over ``at`` - r .. ``at`` + r along each line, clipped at its ends.

    A running sum along the line is folded into one array, and each cell takes the difference of
    two of its entries: the radius may differ from page to page, which a window frame cannot.
    """
    w = W.partitionBy("scan_id", line).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    run = px.select("scan_id", line, at, r, *keep, *[F.sum(c).over(w).alias(c) for c in sums])
    rows = run.groupBy("scan_id", line, r).agg(
        F.sort_array(F.collect_list(F.struct(at, *keep, *sums))).alias("s"))
    hi = f"s[least(size(s) - 1, i + {r})]"
    lo = f"s[i - {r} - 1]"
    diff = ", ".join(f"{hi}.{c} - IF(i - {r} - 1 < 0, 0, {lo}.{c}) AS {c}" for c in sums)
    kept = "".join(f", e.{c} AS {c}" for c in keep)
    return rows.selectExpr("scan_id", line, r, f"inline(transform(s, (e, i) -> struct(e.{at} AS {at}{kept}, {diff})))")


def sauvola(pixels: DataFrame) -> DataFrame:
    """Local threshold; ink(scan_id, w, h, y, x) keeps only ink.

    Window sums are taken along lines and then along columns, two shuffles whatever the window.
    """
    p = pixels.selectExpr(
        "scan_id", "w", "h", "y", "x", "gray",
        "cast(greatest(15, cast(floor(least(w, h) / 16D + 0.5) AS int) | 1) div 2 AS int) AS r",
        "cast(gray AS bigint) AS s", "cast(gray * gray AS bigint) AS q")
    p = _slide(p, "y", "x", "r", ["s", "q"], ["w", "h", "gray"])
    p = _slide(p, "x", "y", "r", ["s", "q"], ["w", "h", "gray"])
    p = p.selectExpr(
        "*", "cast((least(w, x + r + 1) - greatest(0, x - r)) * (least(h, y + r + 1) - greatest(0, y - r)) AS double) AS n")
    p = p.selectExpr("*", "s / n AS m").selectExpr("*", "sqrt(greatest(0D, q / n - m * m)) AS sd")
    p = p.join(otsu(pixels), "scan_id")
    return p.where(f"gray < least(m * (1 + {SAUVOLA_K}D * (sd / {SAUVOLA_R} - 1)), m - {MIN_CONTRAST})"
                   " AND gray < least(250, otsu + 55)").select("scan_id", "w", "h", "y", "x")


def ink_runs(ink: DataFrame) -> DataFrame:
    """runs(scan_id, w, h, y, x0, x1) of ink pixels; one shuffle by scanline."""
    k = F.col("x") - F.row_number().over(W.partitionBy("scan_id", "y").orderBy("x"))
    return ink.withColumn("k", k).groupBy("scan_id", "y", "k", "w", "h").agg(
        F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).select("scan_id", "w", "h", "y", "x0", "x1")


def run_pixels(runs: DataFrame) -> DataFrame:
    return runs.selectExpr("scan_id", "w", "h", "y", "explode(sequence(x0, x1 - 1)) AS x")


def _join_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Root index of each run under 8-connection; runs are in raster order, roots are the first."""
    parent = np.arange(len(y))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    lines = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    bounds = list(zip(lines, np.r_[lines[1:], len(y)]))
    for (a0, a1), (b0, b1) in zip(bounds, bounds[1:]):
        if y[b0] != y[a0] + 1:
            continue
        i, j = a0, b0
        while i < a1 and j < b1:
            if x0[i] <= x1[j] and x0[j] <= x1[i]:
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
            if x1[i] < x1[j]:
                i += 1
            else:
                j += 1
    return np.array([find(i) for i in range(len(y))], dtype=int)


def _label_strip(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["y", "x0"], ignore_index=True)
    root = _join_runs(pdf["y"].to_numpy(), pdf["x0"].to_numpy(), pdf["x1"].to_numpy())
    return pdf.assign(ly=pdf["y"].to_numpy()[root], lx=pdf["x0"].to_numpy()[root])


def _merge_strips(pdf: pd.DataFrame) -> pd.DataFrame:
    """Roots of strip labels that touch across a strip boundary; sees boundary lines only."""
    pdf = pdf.sort_values(["y", "x0"], ignore_index=True)
    label = list(zip(pdf["ly"], pdf["lx"]))
    touch = _join_runs(pdf["y"].to_numpy(), pdf["x0"].to_numpy(), pdf["x1"].to_numpy())
    parent: dict = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, r in enumerate(touch):
        a, b = find(label[i]), find(label[r])
        parent[max(a, b)] = min(a, b)
    out = [(a[0], a[1], *find(a)) for a in list(parent) if find(a) != a]
    return pd.DataFrame(out, columns=["ly", "lx", "ry", "rx"]).assign(scan_id=pdf["scan_id"].iloc[0])


def label_runs(runs: DataFrame, strip: int = STRIP) -> DataFrame:
    """Runs with ``ly, lx``, the first pixel of their 8-connected component.

    Strips of lines are labelled on their own, then only the lines on either side of a strip
    boundary are looked at again, so no task holds a page.
    """
    cols = "scan_id bigint, w int, h int, y int, x0 int, x1 int"
    r = runs.selectExpr("scan_id", "cast(w AS int) AS w", "cast(h AS int) AS h", "cast(y AS int) AS y",
                        "cast(x0 AS int) AS x0", "cast(x1 AS int) AS x1")
    lab = r.groupBy("scan_id", F.expr(f"y div {strip}").alias("strip")).applyInPandas(
        _label_strip, f"{cols}, ly int, lx int")
    edge = lab.where(f"(y % {strip} = 0 AND y > 0) OR y % {strip} = {strip - 1}")
    up = edge.groupBy("scan_id").applyInPandas(
        _merge_strips, "ly int, lx int, ry int, rx int, scan_id bigint")
    return lab.join(up, ["scan_id", "ly", "lx"], "left").selectExpr(
        "scan_id", "w", "h", "y", "x0", "x1", "coalesce(ry, ly) AS ly", "coalesce(rx, lx) AS lx")


def components(labelled: DataFrame) -> DataFrame:
    """Boxes, areas and centres; ids follow the first pixel in raster order."""
    n = F.expr("cast(x1 - x0 AS bigint)")
    c = labelled.groupBy("scan_id", "w", "h", "ly", "lx").agg(
        F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"),
        F.sum(n).alias("area"), F.sum(F.expr("(x0 + x1 - 1) * cast(x1 - x0 AS bigint) / 2")).alias("sx"),
        F.sum(F.col("y") * n).alias("sy"))
    k = F.row_number().over(W.partitionBy("scan_id").orderBy("ly", "lx"))
    return c.select("scan_id", "w", "h", k.alias("comp_id"), "ly", "lx", "x0", "y0", "x1", "y1", "area",
                    (F.col("sx") / F.col("area")).alias("cx"), (F.col("sy") / F.col("area")).alias("cy"))


def despeckle(labelled: DataFrame, relative: float = 0.02, absolute: int = 6) -> DataFrame:
    """Drop components far smaller than the page's median one."""
    area = labelled.groupBy("scan_id", "ly", "lx").agg(F.sum(F.expr("x1 - x0")).alias("area"))
    mid = area.groupBy("scan_id").agg(upper_median("area").alias("mid"))
    keep = area.join(mid, "scan_id").where(f"area >= greatest({absolute}D, mid * {relative}D)").select("scan_id", "ly", "lx")
    return labelled.join(keep, ["scan_id", "ly", "lx"], "left_semi")


def remove_rules(ink: DataFrame, min_fraction: float = 0.3, min_absolute: int = 40, tolerance: float = 1.7,
                 min_thick: int = 2, cap: int = 24) -> tuple[DataFrame, DataFrame]:
    """The ink without printed rules, and per page (rules, removed).

    Every pixel learns the length of the horizontal and of the vertical run it lies in. It goes
    if one is long and the other no thicker than the page's rules are.
    """
    def runs_along(df, line, at, name):
        isl = W.partitionBy("scan_id", line).orderBy(at)
        df = df.withColumn("k", F.col(at) - F.row_number().over(isl))
        grp = W.partitionBy("scan_id", line, "k")
        return df.withColumn(name, F.count("*").over(grp)).withColumn(name + "0", F.min(at).over(grp)).drop("k")

    p = runs_along(runs_along(ink, "y", "x", "hl"), "x", "y", "vl")
    p = p.selectExpr(
        "*", f"hl >= greatest({min_absolute}, floor(w * {min_fraction}D + 0.5)) AS long_h",
        f"vl >= greatest({min_absolute}, floor(h * {min_fraction}D + 0.5)) AS long_v")
    thick = p.where("long_h AND (x - hl0) % 16 = 0").selectExpr("scan_id", f"least(vl, {cap}) AS n").groupBy("scan_id").agg(
        upper_median("n").alias("mid")).selectExpr(
        "scan_id", f"least({cap}, greatest({min_thick}, floor(mid * {tolerance}D + 0.5))) AS thick")
    p = p.join(thick, "scan_id", "left").na.fill(min_thick, ["thick"]).withColumn(
        "doomed", F.expr("(long_h AND vl <= thick) OR (long_v AND hl <= thick)"))
    stats = p.groupBy("scan_id").agg(
        (F.count_if(F.expr("long_h AND x = hl0")) + F.count_if(F.expr("long_v AND y = vl0"))).alias("rules"),
        F.count_if("doomed").alias("removed"))
    return p.where("NOT doomed").select("scan_id", "w", "h", "y", "x"), stats


def _steps(start: float, stop: float, step: float) -> list[float]:
    """Angles by repeated addition, drift included."""
    out, v = [], start
    while v <= stop:
        out.append(v)
        v += step
    return out


def angle_rows(limit: float, coarse: float, fine: float) -> tuple[list[tuple], list[tuple]]:
    """Coarse angles (k, deg, tan) and for each the fine ones (k, j, deg, tan).

    The fine search goes on to a coarse step beyond the best found so far, so the list reaches
    three steps past its start.
    """
    first = [(k, d, math.tan(math.radians(d))) for k, d in enumerate(_steps(-limit, limit, coarse))]
    second = [(k, j, d, math.tan(d * math.pi / 180)) for k, c, _ in first
              for j, d in enumerate(_steps(c - coarse, c + 3 * coarse, fine))]
    return first, second


SKEW = angle_rows(8.0, 1.0, 0.1)
SLANT = angle_rows(32.0, 2.0, 0.25)


def _sharpness(tilted: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of squared steps of each dense profile, from the rows that are not zero.

    With p the profile, sum (p[i]-p[i-1])^2 = 2 sum p^2 - p[0]^2 - p[last]^2 - 2 sum p[i] p[i-1].
    """
    prof = tilted.groupBy("scan_id", *keys, "last", "at").agg(F.count("*").alias("n"))
    w = W.partitionBy("scan_id", *keys).orderBy("at")
    prof = prof.withColumn("before", F.when(F.lag("at").over(w) == F.col("at") - 1, F.lag("n").over(w)).otherwise(0))
    ends = F.when(F.col("at").isin(0), 1).otherwise(0) + F.when(F.col("at") == F.col("last"), 1).otherwise(0)
    return prof.groupBy("scan_id", *keys).agg(
        F.sum((2 - ends) * F.col("n") * F.col("n") - 2 * F.col("n") * F.col("before")).alias("score"))


def _tilt_rows(ink: DataFrame) -> DataFrame:
    """Where each pixel falls in the page's line profile; what is sheared off the page is lost."""
    return ink.selectExpr(
        "*", "cast(ceil(abs(tan) * w) AS int) AS over", "cast(floor(tan * x + 0.5) AS int) AS sh").selectExpr(
        "*", "y + IF(tan < 0, over, 0) - sh AS at", "h + over + 1 AS last").where("at >= 0 AND at <= last")


def _tilt_columns(ink: DataFrame) -> DataFrame:
    return ink.selectExpr("*", "cast(ceil(abs(tan) * h) AS int) + 2 AS pad").selectExpr(
        "*", "x + cast(floor(tan * y + 0.5) AS int) + pad AS at", "w + 2 * pad - 1 AS last")


def _search(ink: DataFrame, pages: DataFrame, angles, coarse: float, tilt) -> DataFrame:
    first, second = angles
    spark = ink.sparkSession
    lit = "array(" + ", ".join(f"named_struct('k', {k}, 'tan', {t!r}D)" for k, _, t in first) + ")"
    c = tilt(ink.selectExpr("scan_id", "w", "h", "y", "x", f"explode({lit}) AS a").selectExpr(
        "scan_id", "w", "h", "y", "x", "a.k", "a.tan"))
    best = _sharpness(c, ["k"]).groupBy("scan_id").agg(
        F.max_by(F.struct("k", "score"), F.struct("score", -F.col("k"))).alias("b")).select(
        "scan_id", "b.k", F.col("b.score").alias("s0"))
    dim = spark.sql(dims.values_sql(second, "k, j, deg, tan"))
    lists = dim.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("j", "tan"))).alias("l"))
    f = ink.join(best.join(F.broadcast(lists), "k").select("scan_id", "l"), "scan_id").selectExpr(
        "scan_id", "w", "h", "y", "x", "explode(l) AS a").selectExpr("scan_id", "w", "h", "y", "x", "a.j", "a.tan")
    fine = _sharpness(tilt(f), ["j"]).join(best, "scan_id").join(F.broadcast(dim.select("k", "j", "deg")), ["k", "j"])
    seen = fine.groupBy("scan_id", "k", "s0").agg(F.sort_array(F.collect_list(F.struct("j", "deg", "score"))).alias("l"))
    deg0 = "element_at(array(" + ", ".join(f"{d!r}D" for _, d, _ in first) + "), k + 1)"
    # the search stops at the first angle a coarse step past the best so far; at most 41 entries
    found = seen.selectExpr("scan_id", f"""aggregate(l, named_struct('b', {deg0}, 's', s0, 'on', true), (a, e) ->
        CASE WHEN NOT a.on OR e.deg > a.b + {coarse}D THEN named_struct('b', a.b, 's', a.s, 'on', false)
        WHEN e.score > a.s THEN named_struct('b', e.deg, 's', e.score, 'on', true) ELSE a END).b AS deg""")
    return pages.select("scan_id").join(found, "scan_id", "left")


def page_skew(ink: DataFrame, pages: DataFrame) -> DataFrame:
    """Tilt of each page in degrees; a page without ink keeps the first angle tried."""
    return _search(ink, pages, SKEW, 1.0, _tilt_rows).na.fill(-8.0, ["deg"])


def writing_slant(ink: DataFrame, pages: DataFrame) -> DataFrame:
    """Lean of the writing in degrees, forwards positive."""
    s = _search(ink, pages, SLANT, 2.0, _tilt_columns).na.fill(-32.0, ["deg"])
    return s.select("scan_id", (-F.col("deg") + F.lit(0.0)).alias("deg"))


def rotate_gray(pixels: DataFrame, angles: DataFrame) -> DataFrame:
    """Turn each page by its angle in radians with bilinear sampling; outside is paper.

    Target pixels meet the two scanlines they are read from, each one array, instead of four
    single pixels.
    """
    lines = pixels.groupBy("scan_id", "y").agg(
        F.expr("transform(sort_array(collect_list(struct(x, gray))), e -> e.gray)").alias("v"))
    page = pixels.groupBy("scan_id").agg(F.max("w").alias("w"), F.max("h").alias("h")).join(angles, "scan_id")
    page = page.selectExpr("*", "IF(abs(angle) < 1e-4, 0D, angle) AS a").selectExpr(
        "*", "cos(a) AS cs", "sin(a) AS sn").selectExpr(
        "*", "cast(ceil(abs(w * cs) + abs(h * sn)) AS int) AS nw", "cast(ceil(abs(w * sn) + abs(h * cs)) AS int) AS nh")
    t = page.selectExpr("*", "explode(sequence(0, nh - 1)) AS ty").selectExpr("*", "explode(sequence(0, nw - 1)) AS tx")
    t = t.selectExpr("*", "tx - nw / 2D AS dx", "ty - nh / 2D AS dy").selectExpr(
        "scan_id", "w", "h", "nw", "nh", "ty", "tx", "a",
        "IF(a = 0, cast(tx AS double), cs * dx + sn * dy + w / 2D) AS sx",
        "IF(a = 0, cast(ty AS double), -sn * dx + cs * dy + h / 2D) AS sy")
    t = t.selectExpr("*", "cast(floor(sx) AS int) AS x0", "cast(floor(sy) AS int) AS y0",
                     "a = 0 OR (sx >= 0 AND sy >= 0 AND sx < w - 1 AND sy < h - 1) AS inside")
    up = lines.select("scan_id", F.col("y").alias("y0"), F.col("v").alias("u"))
    dn = lines.select("scan_id", (F.col("y") - 1).alias("y0"), F.col("v").alias("d"))
    t = t.join(up, ["scan_id", "y0"], "left").join(dn, ["scan_id", "y0"], "left")
    t = t.selectExpr("*", "sx - x0 AS fx", "sy - y0 AS fy")
    mix = F.expr("CASE WHEN a = 0 THEN cast(get(u, x0) AS double) ELSE get(u, x0) * (1 - fx) * (1 - fy) + get(u, x0 + 1) * fx * (1 - fy)"
                 " + get(d, x0) * (1 - fx) * fy + get(d, x0 + 1) * fx * fy END")
    return t.select("scan_id", F.col("nw").alias("w"), F.col("nh").alias("h"), F.col("ty").alias("y"), F.col("tx").alias("x"),
                    F.when(F.col("inside"), byte(mix)).otherwise(PAPER).alias("gray"))


def ink_ratio(runs: DataFrame) -> DataFrame:
    """Share of each page that is ink."""
    return runs.groupBy("scan_id", "w", "h").agg(F.sum(F.expr("x1 - x0")).alias("n")).selectExpr(
        "scan_id", "n", "n / (cast(w AS double) * h) AS ratio")


def clean(ink: DataFrame) -> DataFrame:
    """Despeckled, labelled runs of an ink table."""
    return despeckle(label_runs(ink_runs(ink)))


def preprocess(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A gray page to clean labelled runs, and its angle, slant, ink share and rules removed.

    Every stage reads its input more than once, so stages are written to the checkpoint folder:
    the chain costs the sum of its stages, and a lost executor redoes one stage at most.
    """
    pages = pixels.select("scan_id").distinct()
    small = cut_lineage(sauvola(box_downscale(pixels)))
    skew = cut_lineage(page_skew(cut_lineage(run_pixels(clean(small))), pages))
    straight = cut_lineage(rotate_gray(pixels, skew.select("scan_id", F.radians("deg").alias("angle"))))
    unruled, rules = remove_rules(cut_lineage(sauvola(straight)))
    runs = cut_lineage(clean(unruled))
    slant = writing_slant(cut_lineage(run_pixels(runs)), pages)
    info = skew.withColumnRenamed("deg", "angle_deg").join(slant.withColumnRenamed("deg", "slant"), "scan_id").join(
        ink_ratio(runs), "scan_id", "left").join(rules, "scan_id", "left").na.fill(0)
    return runs, info


def stroke_raster(strokes: DataFrame) -> DataFrame:
    """Pen strokes to coverage(glyph_id, y, x, cov).

    strokes(glyph_id, width, height, points array<struct<x, y, r>>), one row per stroke. Discs
    are stamped at most 0.6 px apart, radius interpolated; overlapping stamps keep the greatest
    coverage, so they combine map-side.
    """
    seg = strokes.selectExpr(
        "glyph_id", "width", "height",
        "explode(IF(size(points) = 1, array(struct(points[0] AS a, points[0] AS b)),"
        " transform(sequence(1, size(points) - 1), i -> struct(points[i - 1] AS a, points[i] AS b)))) AS s")
    seg = seg.selectExpr("*", "cast(greatest(1, ceil(sqrt(power(s.b.x - s.a.x, 2) + power(s.b.y - s.a.y, 2)) / 0.6D)) AS int) AS n")
    disc = seg.selectExpr("*", "explode(sequence(0, n)) AS k").selectExpr("*", "k / cast(n AS double) AS t").selectExpr(
        "glyph_id", "width", "height", "s.a.x + (s.b.x - s.a.x) * t AS cx", "s.a.y + (s.b.y - s.a.y) * t AS cy",
        "s.a.r + (s.b.r - s.a.r) * t AS r").selectExpr(
        "*", "cast(greatest(0, floor(cy - r - 0.5)) AS int) AS y0", "cast(least(height - 1, ceil(cy + r + 0.5)) AS int) AS y1",
        "cast(greatest(0, floor(cx - r - 0.5)) AS int) AS x0", "cast(least(width - 1, ceil(cx + r + 0.5)) AS int) AS x1")
    px = disc.where("y1 >= y0 AND x1 >= x0").selectExpr("*", "explode(sequence(y0, y1)) AS y").selectExpr("*", "explode(sequence(x0, x1)) AS x")
    px = px.selectExpr("glyph_id", "y", "x", "least(1D, greatest(0D, r + 0.5D - sqrt(power(x + 0.5D - cx, 2) + power(y + 0.5D - cy, 2)))) AS cov")
    return px.where("cov > 0").groupBy("glyph_id", "y", "x").agg(F.max("cov").alias("cov"))


def drawn_glyphs(coverage: DataFrame, pad: int = 2, threshold: float = 0.5) -> DataFrame:
    """Box of each drawn glyph; a glyph without ink has no row."""
    return coverage.where(F.col("cov") >= threshold).groupBy("glyph_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"),
        F.count("*").alias("area")).selectExpr(
        "*", f"x1 - x0 + {2 * pad} AS w", f"y1 - y0 + {2 * pad} AS h")
