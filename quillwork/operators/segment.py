"""From ink to labelled cells: bands of writing, groups of parts, one cell per expected character.

Greedy steps depend on the order marks are met in, so they run as small functions over one row
of writing at a time. A page with too many marks is refused before that, which bounds a row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.functions import dims
from quillwork.functions.num import overlap_ratio
from quillwork.functions.shuffle import held
from quillwork.operators.raster import _slide

# --- fixed values -----------------------------------------------------------------------
H_OVERLAP, V_OVERLAP = 0.45, 0.35
STRAY_AREA = 0.25
FUSED_WIDTH = 1.75
MAX_PER_PART = 12
BAND_GAP, BAND_REACH = 0.45, 0.6
MIN_BAND = 0.012
PAD = 2
SHEET_SCORE = 0.75
# ----------------------------------------------------------------------------------------


def sheet_rows(spark, ligatures: bool = True) -> DataFrame:
    """(sheet_no, rw, want, parts, small): what each sheet row should hold."""
    rows: dict = {}
    info = {r[1]: r for r in dims.charset_rows()}
    for no, sid, _, rw, _, _, ch in dims.sheet_rows():
        if ligatures or sid != "ligatures":
            want, parts, small = rows.get((no, rw), (0, 0, False))
            rows[no, rw] = (want + 1, parts + info[ch][5], small or info[ch][3] in ("base", "mid", "high"))
    return F.broadcast(spark.sql(dims.values_sql([(*k, *v) for k, v in rows.items()], "sheet_no, rw, want, parts, small")))


def find_lines(runs: DataFrame) -> DataFrame:
    """G1: bands(scan_id, h, band, y0, y1) of writing, top to bottom."""
    pages = runs.select("scan_id", "h").distinct()
    spine = pages.selectExpr("scan_id", "h", "explode(sequence(0, h - 1)) AS y", "cast(0 AS bigint) AS s")
    prof = runs.selectExpr("scan_id", "h", "y", "cast(x1 - x0 AS bigint) AS s").unionByName(spine).groupBy(
        "scan_id", "h", "y").agg(F.sum("s").alias("s"))
    prof = prof.selectExpr("scan_id", "h", "y", "s", "0 AS page",
                           "cast(greatest(3, cast(floor(h / 200D + 0.5) AS int) | 1) div 2 AS int) AS r")
    sm = _slide(prof, "page", "y", "r", ["s"], ["h"]).selectExpr(
        "scan_id", "h", "y", "s / cast(least(h - 1, y + r) - greatest(0, y - r) + 1 AS double) AS v")
    page = W.partitionBy("scan_id")
    on = sm.withColumn("peak", F.max("v").over(page)).where("peak > 0 AND v > greatest(0.5D, peak * 0.04D)")
    isl = on.withColumn("k", F.col("y") - F.row_number().over(page.orderBy("y"))).groupBy("scan_id", "h", "k").agg(
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")).where(f"y1 - y0 >= greatest(4D, h * {MIN_BAND}D)")
    return isl.select("scan_id", "h", (F.row_number().over(page.orderBy("y0")) - 1).alias("band"), "y0", "y1")


def box_overlap(a: str, b: str) -> tuple[Column, Column]:
    """Horizontal and vertical overlap of two box structs, each over the shorter side."""
    c = F.col
    return (overlap_ratio(c(f"{a}.x0"), c(f"{a}.x1"), c(f"{b}.x0"), c(f"{b}.x1")),
            overlap_ratio(c(f"{a}.y0"), c(f"{a}.y1"), c(f"{b}.y0"), c(f"{b}.y1")))


def band_counts(bands: DataFrame, comps: DataFrame) -> DataFrame:
    """Marks whose centre lies in each band. Bands hold whole lines, so centres meet them by line."""
    lines = bands.selectExpr("scan_id", "band", "explode(sequence(y0, y1 - 1)) AS line")
    n = comps.selectExpr("scan_id", "cast(floor(cy) AS int) AS line").join(lines, ["scan_id", "line"]).groupBy(
        "scan_id", "band").agg(F.count("*").alias("n"))
    return bands.join(n, ["scan_id", "band"], "left").na.fill(0, ["n"])


def _each(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Run ``fn(row) -> list of tuples`` over rows, batch by batch."""
    names = [f.split()[0] for f in schema.split(", ") if "<" not in f.split()[0]]

    def go(batches):
        for pdf in batches:
            out = [t for row in pdf.itertuples(index=False) for t in fn(row)]
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(go, schema)


def _median(xs: list) -> float:
    s = sorted(xs)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 if s else 0.0


def reconcile_bands(counted: DataFrame, pages: DataFrame) -> DataFrame:
    """As many bands as the sheet has rows: close sparse ones fused, then the densest kept.

    pages(scan_id, sheet_no). Output bands are numbered as rows, with how many were fused or dropped. A page's bands are one array
    (bounded by its height). Each turn looks at the gaps beside a band too sparse for a row and closes the narrowest, the upper
    one of equals, while it is narrow against the page's median band; what is over is then left out by count of marks.
    """
    want = sheet_rows(pages.sparkSession).groupBy("sheet_no").agg(
        F.count("*").alias("want"), F.min("want").alias("sparsest"))
    b = counted.groupBy("scan_id").agg(F.sort_array(F.collect_list(
        F.struct("y0", "y1", F.col("n").cast("int").alias("n")))).alias("bands"))
    b = b.join(pages.join(F.broadcast(want), "sheet_no"), "scan_id")
    gaps = ("filter(transform(sequence(0, size(s.bands) - 2), i -> struct(s.bands[i + 1].y0 - s.bands[i].y1 AS gap, i AS i,"
            " least(s.bands[i].n, s.bands[i + 1].n) AS fewest)), g -> g.fewest < sparsest - 1)")
    heights = "array_sort(transform(s.bands, v -> v.y1 - v.y0))"
    closed = ("struct(concat(slice(s.bands, 1, g.i), array(struct(s.bands[g.i].y0 AS y0, s.bands[g.i + 1].y1 AS y1,"
              " s.bands[g.i].n + s.bands[g.i + 1].n AS n)), slice(s.bands, g.i + 3, size(s.bands))) AS bands, s.fused + 1 AS fused)")
    turn = (f"transform(array(struct(array_min({gaps}) AS g, {heights} AS h)), k -> IF("
            f"k.g.gap <= (k.h[(size(k.h) - 1) div 2] + k.h[size(k.h) div 2]) / 2D * {BAND_GAP}D, {closed.replace('g.i', 'k.g.i')}, s))[0]")
    b = held(b, met=f"aggregate(sequence(1, greatest(1, size(bands) - want)), struct(bands, 0 AS fused),"
                    f" (s, _) -> IF(size(s.bands) > want, {turn}, s))")
    densest = "slice(array_sort(transform(met.bands, (v, i) -> struct(-v.n AS few, i AS i))), 1, cast(want AS int))"
    return held(b, kept=f"array_sort(transform({densest}, d -> met.bands[d.i]))").selectExpr(
        "scan_id", "met.fused", "greatest(0, size(met.bands) - cast(want AS int)) AS dropped", "posexplode(kept) AS (rw, v)").selectExpr(
        "scan_id", "rw", "v.y0", "v.y1", "v.n", "fused", "dropped")


def assign_band(bands: DataFrame, comps: DataFrame) -> DataFrame:
    """The row of each mark: the band its centre lies in, else the nearest one within reach."""
    reach = bands.groupBy("scan_id").agg((F.median(F.col("y1") - F.col("y0")) * BAND_REACH).alias("reach"))
    lines = bands.selectExpr("scan_id", "rw", "explode(sequence(y0, y1 - 1)) AS line")
    c = comps.selectExpr("*", "cast(floor(cy) AS int) AS line").join(lines, ["scan_id", "line"], "left").drop("line")
    inside, outside = c.where("rw IS NOT NULL"), c.where("rw IS NULL").drop("rw")
    d = outside.select("scan_id", "comp_id", "cy").join(bands.select("scan_id", "rw", "y0", "y1"), "scan_id").withColumn(
        "d", F.expr("IF(cy < y0, y0 - cy, cy - y1)"))
    near = d.groupBy("scan_id", "comp_id").agg(F.min(F.struct("d", "rw")).alias("m")).join(reach, "scan_id").where(
        "m.d <= reach").select("scan_id", "comp_id", F.col("m.rw").alias("rw"))
    return inside.unionByName(outside.join(near, ["scan_id", "comp_id"]))


def component_cap(comps: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages refused before any sorting: no ink, or far more marks than the sheet accounts for."""
    parts = sheet_rows(pages.sparkSession).groupBy("sheet_no").agg(F.sum("parts").alias("parts"))
    n = comps.groupBy("scan_id").agg(F.count("*").alias("found"))
    p = pages.join(F.broadcast(parts), "sheet_no").join(n, "scan_id", "left").na.fill(0, ["found"])
    code = F.when(F.col("found") == 0, "no-ink").when(F.col("found") > F.col("parts") * MAX_PER_PART, "too-many-marks")
    return p.select("scan_id", F.lit("fatal").alias("level"), code.alias("code"), F.col("parts").alias("expected"),
                    "found").where("code IS NOT NULL")


# --- one row of writing -------------------------------------------------------------------
def _overlap(a0, a1, b0, b1) -> float:
    short = min(a1 - a0, b1 - b0)
    return max(0, min(a1, b1) - max(a0, b0)) / short if short > 0 else 0.0


def _union(a: dict, b: dict) -> dict:
    return dict(x0=min(a["x0"], b["x0"]), y0=min(a["y0"], b["y0"]), x1=max(a["x1"], b["x1"]), y1=max(a["y1"], b["y1"]),
                area=a["area"] + b["area"], parts=a["parts"] + b["parts"])


def _boxes(comps) -> list[dict]:
    return [dict(x0=c["x0"], y0=c["y0"], x1=c["x1"], y1=c["y1"], area=c["area"], parts=[(c["comp_id"], c["x0"], c["x1"])])
            for c in comps]


def merge_stacked(items: list[dict]) -> list[dict]:
    """Join parts that lie above one another, first pair first, until none is left."""
    items, i = list(items), 0
    while i < len(items):
        a = items[i]
        j = next((j for j in range(i + 1, len(items))
                  if _overlap(a["x0"], a["x1"], items[j]["x0"], items[j]["x1"]) >= H_OVERLAP
                  and _overlap(a["y0"], a["y1"], items[j]["y0"], items[j]["y1"]) <= V_OVERLAP), None)
        if j is None:
            i += 1
        else:
            items[i] = _union(a, items.pop(j))
            i = 0  # the joined box may now meet an earlier one
    return sorted(items, key=lambda g: g["x0"])


def fuse_closest(items: list[dict], expected: int) -> list[dict]:
    """Join nearest neighbours until the row has as many groups as characters."""
    items = list(items)
    while len(items) > max(expected, 1):
        i = min(range(len(items) - 1), key=lambda k: items[k + 1]["x0"] - items[k]["x1"])
        items[i] = _union(items[i], items.pop(i + 1))
    return items


def drop_strays(items: list[dict], small: bool) -> list[dict]:
    """Leave out marks far smaller than the row's groups, unless small characters are due."""
    if len(items) < 4 or small:
        return items
    mid = _median([g["area"] for g in items])
    kept = [g for g in items if g["area"] >= mid * STRAY_AREA]
    return kept if len(kept) >= (len(items) + 1) // 2 else items


def split_waist(g: dict, runs: dict) -> list[dict] | None:
    """Cut a group at the thinnest column of its middle; None where nothing is left on a side."""
    x0, width = g["x0"], g["x1"] - g["x0"]
    if width < 8:
        return None
    mine = [(y, max(a, x0), min(b, g["x1"])) for p in {p[0] for p in g["parts"]} for y, a, b in runs[p]
            if g["y0"] <= y < g["y1"] and a < g["x1"] and b > x0]
    cols = [0] * (width + 1)
    for _, a, b in mine:
        cols[a - x0] += 1
        cols[b - x0] -= 1
    for k in range(1, width + 1):
        cols[k] += cols[k - 1]
    lo, hi = width * 2 // 10, -(-width * 8 // 10)
    at = x0 + min(range(lo, hi), key=lambda k: cols[k])
    out = []
    for a, b in ((x0, at), (at, g["x1"])):
        part = [(y, max(u, a), min(v, b)) for y, u, v in mine if u < b and v > a]
        ids = [(i, max(u, a), min(v, b)) for i, u, v in g["parts"] if u < b and v > a]
        if not part or not ids:
            return None
        out.append(dict(x0=min(u for _, u, _ in part), x1=max(v for _, _, v in part), y0=min(y for y, _, _ in part),
                        y1=max(y for y, _, _ in part) + 1, area=sum(v - u for _, u, v in part), parts=ids))
    return out


class RowWork:
    """A row being sorted: its groups from left to right, the runs of its marks, and how often it was cut."""

    def __init__(self, row):
        self.want, self.cuts, self.runs = row.want, 0, {}
        for r in row.runs:
            self.runs.setdefault(r["comp_id"], []).append((r["y"], r["x0"], r["x1"]))
        self.merged = merge_stacked(_boxes(row.comps))
        self.groups = list(drop_strays(self.merged, row.small))
        self.strays = len(self.merged) - len(self.groups)

    def widths(self) -> list[int]:
        return [g["x1"] - g["x0"] for g in self.groups]

    def cut_while(self, due: Callable[[list[int]], bool]) -> None:
        """Cut the widest group (the first of equals) as long as the widths say so and it can be cut; once for each character at most."""
        for _ in range(self.want):
            widths = self.widths()
            if not due(widths):
                return
            at = widths.index(max(widths))
            halves = split_waist(self.groups[at], self.runs)
            if not halves:
                return
            self.groups = sorted([*self.groups[:at], *halves, *self.groups[at + 1:]], key=lambda g: g["x0"])
            self.cuts += 1


def cut_fused(work: RowWork) -> None:
    """Groups out of proportion to the row's middle one hold several characters."""
    work.cut_while(lambda w: _median(w) > 0 and max(w) >= _median(w) * FUSED_WIDTH)


def cut_missing(work: RowWork) -> None:
    """A row that is short of groups has characters that touch."""
    work.cut_while(lambda w: 0 < len(w) < work.want)


def fuse_surplus(work: RowWork) -> None:
    """A row with too many groups has characters in pieces."""
    if len(work.groups) > work.want:
        work.groups = fuse_closest(work.groups, work.want)


def sorted_row(row) -> list[tuple]:
    """The groups of one row after merging, leaving strays out, and the three passes above in turn."""
    work = RowWork(row)
    for each in (cut_fused, cut_missing, fuse_surplus):
        each(work)
    about = (len(work.merged), work.strays, work.cuts, len(work.groups))
    return [(row.scan_id, row.rw, i, g["x0"], g["y0"], g["x1"], g["y1"], g["area"], [p[0] for p in g["parts"]], *about)
            for i, g in enumerate(work.groups)]


def row_groups(assigned: DataFrame, runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Groups of each row, one per character where it can be made so.

    assigned: marks with their row; runs: labelled runs with comp_id; pages(scan_id, sheet_no).
    """
    key = ["scan_id", "rw"]
    box = F.struct("comp_id", "x0", "y0", "x1", "y1", "area")
    c = assigned.groupBy(*key).agg(F.sort_array(F.collect_list(box)).alias("comps"))
    r = runs.join(assigned.select("scan_id", "comp_id", "rw"), ["scan_id", "comp_id"]).groupBy(*key).agg(
        F.collect_list(F.struct("comp_id", "y", "x0", "x1")).alias("runs"))
    want = pages.join(sheet_rows(pages.sparkSession), "sheet_no").select("scan_id", "rw", "want", "small")
    j = c.join(r, key).join(want, key)
    return _each(j, sorted_row, "scan_id bigint, rw int, col int, x0 int, y0 int, x1 int, y1 int, area bigint, "
                              "part_ids array<int>, observed int, strays int, splits int, found int")


def waist_cut(runs: DataFrame) -> DataFrame:
    """One cut of every mark at least 8 px wide: the first thinnest column of its middle.

    runs carry comp_id and the mark's bx0, bx1. Ends of runs are summed along the columns, so a
    run costs two rows however long it is.
    """
    r = runs.where("bx1 - bx0 >= 8").selectExpr(
        "scan_id", "comp_id", "bx0", "bx1 - bx0 AS width", "explode(array(named_struct('x', x0 - bx0, 'd', 1),"
        " named_struct('x', x1 - bx0, 'd', -1))) AS e").selectExpr("scan_id", "comp_id", "bx0", "width", "e.x", "e.d")
    spine = r.select("scan_id", "comp_id", "bx0", "width").distinct().selectExpr("*", "explode(sequence(0, width - 1)) AS x", "0 AS d")
    col = r.unionByName(spine).groupBy("scan_id", "comp_id", "bx0", "width", "x").agg(F.sum("d").alias("d"))
    w = W.partitionBy("scan_id", "comp_id").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    col = col.withColumn("ink", F.sum("d").over(w)).where("x >= floor(width * 0.2D) AND x < ceil(width * 0.8D)")
    best = col.groupBy("scan_id", "comp_id", "bx0").agg(F.min(F.struct("ink", "x")).alias("m"))
    return best.selectExpr("scan_id", "comp_id", "bx0 + m.x AS cut", "m.ink AS ink")


def sheet_cells(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """One cell per expected character; a cell without a group is marked missing."""
    layout = dims.sheets(pages.sparkSession).select("sheet_no", "rw", "col", "ch")
    want = pages.join(layout, "sheet_no")
    g = groups.select("scan_id", "rw", "col", "x0", "y0", "x1", "y1", "part_ids")
    return want.join(g, ["scan_id", "rw", "col"], "left").withColumn("missing", F.col("x0").isNull())


def issues(bands: DataFrame, groups: DataFrame, pages: DataFrame) -> DataFrame:
    """What a page's owner is told: rows that do not match, adjusted rows, and bands fused or ignored."""
    rows = sheet_rows(pages.sparkSession)
    expected = pages.join(rows, "sheet_no").select("scan_id", "rw", "want")
    seen = bands.groupBy("scan_id").agg(F.count("*").alias("found"), F.max("fused").alias("fused"), F.max("dropped").alias("dropped"))
    page = expected.groupBy("scan_id").agg(F.count("*").alias("expected")).join(seen, "scan_id", "left").na.fill(0)
    none = F.lit(None).cast("int")

    def of(df, level, code, rw, expected, found):
        lvl = level if isinstance(level, Column) else F.lit(level)
        return df.select("scan_id", lvl.alias("level"), F.lit(code).alias("code"), rw.cast("int").alias("rw"),
                         expected.cast("int").alias("expected"), found.cast("int").alias("found"))

    per_row = groups.groupBy("scan_id", "rw").agg(F.max("found").alias("found"), F.max("strays").alias("strays"),
                                                  F.max("splits").alias("splits"))
    met = bands.select("scan_id", "rw").join(expected, ["scan_id", "rw"]).join(per_row, ["scan_id", "rw"], "left").na.fill(0)
    return (of(page.where("fused > 0"), "info", "merged-band", none, none, F.col("fused"))
            .unionByName(of(page.where("dropped > 0"), "info", "stray-band", none, none, F.col("dropped")))
            .unionByName(of(page.where("found <> expected"), F.when(F.col("found") == 0, "fatal").otherwise("warn"),
                            "row-count", none, F.col("expected"), F.col("found")))
            .unionByName(of(met.where("strays > 0 OR splits > 0"), "info", "row-adjusted", F.col("rw"), none, none))
            .unionByName(of(met.where("found <> want"), "warn", "cell-count", F.col("rw"), F.col("want"), F.col("found"))))


def sheet_scores(observed: DataFrame) -> DataFrame:
    """Score of every sheet with as many rows as were seen; observed(scan_id, rw, n), rows from 0.

    The score is the share of rows whose count is within one of the sheet's.
    """
    spark = observed.sparkSession
    lens = sheet_rows(spark).select("sheet_no", "rw", "want")
    total = lens.groupBy("sheet_no").agg(F.count("*").alias("n_rows"))
    seen = observed.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("rw", "n"))).alias("o")).withColumn("n_rows", F.size("o"))
    cand = seen.join(F.broadcast(total), "n_rows").join(lens, "sheet_no")
    hit = F.expr("int(abs(get(o, rw).n - want) <= 1)")
    return cand.groupBy("scan_id", "sheet_no").agg(F.avg(hit).alias("score")).where("score > 0")


def identify_sheet(observed: DataFrame) -> DataFrame:
    """The sheet a page looks most like; the first of equals."""
    return sheet_scores(observed).groupBy("scan_id").agg(
        F.max(F.struct("score", -F.col("sheet_no"))).alias("m")).selectExpr(
        "scan_id", "-m.col2 AS sheet_no", "m.score AS score")


def wrong_sheet(observed: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that do not look like the sheet asked for but do look like another."""
    s = sheet_scores(observed).join(pages.withColumnRenamed("sheet_no", "asked"), "scan_id")
    best = s.groupBy("scan_id", "asked").agg(
        F.max(F.when(F.col("sheet_no") == F.col("asked"), F.col("score"))).alias("own"),
        F.max(F.when(F.col("sheet_no") != F.col("asked"), F.struct("score", -F.col("sheet_no")))).alias("m"))
    return best.where(f"coalesce(own, 0) < {SHEET_SCORE} AND m.score >= {SHEET_SCORE}").selectExpr(
        "scan_id", "asked", "-m.col2 AS suggest", "m.score AS score")


def extract_glyphs(cells: DataFrame, runs: DataFrame, pad: int = PAD) -> DataFrame:
    """Each cell's own ink, as runs within its padded box.

    A cell without part ids would take all ink of its box; cells made here always have them.
    """
    c = cells.where("NOT missing").selectExpr(
        "scan_id", "rw", "col", "ch", "x0 AS bx0", "y0 AS by0", "x1 AS bx1", "y1 AS by1", "explode(array_distinct(part_ids)) AS comp_id")
    j = c.join(runs.select("scan_id", "comp_id", "y", "x0", "x1"), ["scan_id", "comp_id"]).where(
        "y >= by0 AND y < by1 AND x0 < bx1 AND x1 > bx0")
    return j.selectExpr(
        "scan_id", "rw", "col", "ch", f"bx1 - bx0 + {2 * pad} AS w", f"by1 - by0 + {2 * pad} AS h", "bx0", "by0", "bx1", "by1",
        f"y - by0 + {pad} AS y", f"greatest(x0, bx0) - bx0 + {pad} AS x0", f"least(x1, bx1) - bx0 + {pad} AS x1")


def with_ids(labelled: DataFrame, comps: DataFrame) -> DataFrame:
    """Labelled runs with the id of their component."""
    return labelled.join(comps.select("scan_id", "ly", "lx", "comp_id"), ["scan_id", "ly", "lx"])


def observed_rows(bands: DataFrame, groups: DataFrame) -> DataFrame:
    """What G11 and G12 look at: (scan_id, rw, n) for every band of a page, 0 where nothing was found in it."""
    n = groups.groupBy("scan_id", "rw").agg(F.max("observed").alias("n"))
    return bands.select("scan_id", "rw").join(n, ["scan_id", "rw"], "left").na.fill(0, ["n"])


def accepted(df: DataFrame, refused: DataFrame) -> DataFrame:
    """Rows of the pages that are not refused."""
    return df.join(refused.select("scan_id"), "scan_id", "left_anti")


def segment(labelled: DataFrame, comps: DataFrame, pages: DataFrame):
    """Bands, groups and cells of every page that is not refused; returns (bands, groups, cells, refused).

    A refused page has its fatal row and nothing else: none of its lines, marks or cells is worked on, and it is no
    longer one of ``pages`` to whoever asks for its issues (``accepted``).
    """
    refused = component_cap(comps, pages)
    labelled, comps, pages = (accepted(df, refused) for df in (labelled, comps, pages))
    bands = reconcile_bands(band_counts(find_lines(labelled), comps), pages)
    groups = row_groups(assign_band(bands, comps), with_ids(labelled, comps), pages)
    return bands, groups, sheet_cells(groups, pages), refused
