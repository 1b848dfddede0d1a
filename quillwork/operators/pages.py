"""Page images as scanlines: one binary row a line, from decoding to clean runs.

A row is a line of gray bytes, lines(scan_id, w, h, y, line). An image is cut into strips where it was decoded and shrunk there,
so no pixel is shuffled to be shrunk. What looks at neighbours (local threshold, rotation) is grouped by strips of
``STRIP`` lines together with the lines around them that it needs, so a task holds a few hundred lines of at most 4200
bytes whatever the page. From the threshold on ink travels as runs. Each operator gives the rows of its pixel-wise counterpart in
``raster``; the tests hold them against each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.operators import raster as R

STRIP = 256  # lines
CUT = 64  # shrunken lines made from one strip of a decoded image
LINES = "scan_id bigint, w int, h int, y int, line binary"
RUNS = "scan_id bigint, w int, h int, y int, x0 int, x1 int"


def _line_rows(scan: int, w: int, h: int, first: int, gray: np.ndarray) -> pa.RecordBatch:
    n = len(gray)
    ends = pa.array(np.arange(0, n * w + 1, w, dtype=np.int32) if w else np.zeros(n + 1, np.int32))
    data = pa.Array.from_buffers(pa.binary(), n, [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(gray, np.uint8))])
    whole = lambda v, t: pa.array(np.full(n, v, t))
    return pa.RecordBatch.from_arrays(
        [whole(scan, np.int64), whole(w, np.int32), whole(h, np.int32), pa.array(np.arange(first, first + n, dtype=np.int32)), data],
        names=["scan_id", "w", "h", "y", "line"])


def _run_rows(scan: int, w: int, h: int, first: int, ink: np.ndarray) -> pa.Table:
    """Runs of a strip of ink whose first line is ``first``."""
    padded = np.zeros((ink.shape[0], ink.shape[1] + 2), np.int8)
    padded[:, 1:-1] = ink
    step = np.diff(padded, axis=1)
    y, x0 = np.nonzero(step == 1)
    x1 = np.nonzero(step == -1)[1]
    whole = lambda v, t: pa.array(np.full(len(y), v, t))
    return pa.table({"scan_id": whole(scan, np.int64), "w": whole(w, np.int32), "h": whole(h, np.int32),
                     "y": pa.array((y + first).astype(np.int32)), "x0": pa.array(x0.astype(np.int32)), "x1": pa.array(x1.astype(np.int32))})


def _stacked(table: pa.Table) -> tuple[int, int, np.ndarray]:
    """(scan, first line, lines as a matrix) of the consecutive lines of a group."""
    table = table.sort_by("y")
    raw = table.column("line").combine_chunks()
    gray = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(raw), -1)
    return table.column("scan_id")[0].as_py(), table.column("y")[0].as_py(), gray


def _scaled(gray: np.ndarray, first: int, y0: int, y1: int, fy: float, fx: float, nw: int) -> np.ndarray:
    """Block means for target lines y0 to y1 from source lines that start at ``first``."""
    down = np.floor(np.arange(y0, y1 + 1) * fy).astype(np.int64)
    across = np.floor(np.arange(nw + 1) * fx).astype(np.int64)
    part = gray[down[0] - first : down[-1] - first, : across[-1]].astype(np.int64)
    sums = np.add.reduceat(np.add.reduceat(part, down[:-1] - down[0], axis=0), across[:-1], axis=1)
    return np.round(sums / (np.diff(down)[:, None] * np.diff(across)[None])).astype(np.uint8)


def _target(most: int) -> list[str]:
    """Size after shrinking to ``most`` px, and source pixels a target pixel."""
    s = f"least(1D, {most}D / greatest(w, h))"
    return [f"cast(greatest(1, floor(w * {s} + 0.5)) AS int) AS nw", f"cast(greatest(1, floor(h * {s} + 0.5)) AS int) AS nh"]


def gray_lines(scans: DataFrame, max_dim: int = R.WORKING_DIM, drop_blue: bool = False) -> DataFrame:
    """S1, P1 and R1 in one map: decoded images (scan_id, w, h, data, n channels where not 3) to gray lines of ``max_dim`` px at most.

    data is blue-green-red bytes, or with a fourth channel that is ignored, or gray alone. The buffer is cut into strips in the
    row that holds it, and a strip is turned to gray and shrunk in one go. Images without a pixel or with too few bytes give no
    line; ``unreadable`` lists them.
    """
    n = "n" if "n" in scans.columns else "3"
    s = scans.selectExpr("scan_id", "w", "h", f"{n} AS n", "data").where("w > 0 AND h > 0 AND length(data) >= cast(w AS bigint) * h * n")
    s = s.selectExpr("*", *_target(max_dim)).selectExpr("*", "w / cast(nw AS double) AS fx", "h / cast(nh AS double) AS fy")
    a, b = "cast(floor(t * fy) AS int)", f"cast(floor(least(nh, t + {CUT}) * fy) AS int)"
    cut = f"transform(sequence(0, nh - 1, {CUT}), t -> struct(t AS t, substring(data, {a} * w * n + 1, ({b} - {a}) * w * n) AS bytes))"
    s = s.selectExpr("scan_id", "w", "n", "nw", "nh", "fx", "fy", f"explode({cut}) AS s").selectExpr("* EXCEPT (s)", "s.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                scan, w, n, nw, nh, fx, fy, t = (batch.column(k)[i].as_py() for k in range(8))
                px = np.frombuffer(batch.column(8)[i].as_buffer(), np.uint8).reshape(-1, w, n)
                blue, green, red = (px[..., min(k, n - 1) if n >= 3 else 0].astype(np.int32) for k in range(3))
                gray = (red * 77 + green * 150 + blue * 29) >> 8
                if drop_blue:
                    low, high = np.minimum(np.minimum(red, green), blue), np.maximum(np.maximum(red, green), blue)
                    gray[(blue == high) & ((high - low) / np.maximum(high, 1) > 0.22) & (blue > 90) & (blue - red > 25)] = R.PAPER
                last = min(nh, t + CUT)
                yield _line_rows(scan, nw, nh, t, _scaled(gray, int(np.floor(t * fy)), t, last, fy, fx, nw))

    return s.mapInArrow(run, LINES)


def shrunk(lines: DataFrame, max_dim: int = R.ANALYSIS_DIM) -> DataFrame:
    """R1 over lines: block means down to ``max_dim``. Each line goes to the one strip of the small page that it is part of."""
    s = lines.selectExpr("*", *_target(max_dim)).selectExpr("*", "w / cast(nw AS double) AS fx", "h / cast(nh AS double) AS fy")
    i = "(ceil((y + 1) / fy) - 1)"
    row = f"CASE WHEN floor({i} * fy) > y THEN {i} - 1 WHEN floor(({i} + 1) * fy) <= y THEN {i} + 1 ELSE {i} END"
    s = s.selectExpr("*", f"cast({row} AS int) AS ty").where("ty < nh").withColumn("strip", F.expr(f"ty div {STRIP}"))

    def mean(table: pa.Table) -> pa.Table:
        first_row = {c: table.column(c)[0].as_py() for c in ("nw", "nh", "fx", "fy", "strip")}
        scan, first, gray = _stacked(table)
        y0 = first_row["strip"] * STRIP
        y1 = min(first_row["nh"], y0 + STRIP)
        out = _scaled(gray, first, y0, y1, first_row["fy"], first_row["fx"], first_row["nw"])
        return pa.Table.from_batches([_line_rows(scan, first_row["nw"], first_row["nh"], y0, out)])

    return s.groupBy("scan_id", "strip").applyInArrow(mean, LINES)


def otsu(lines: DataFrame) -> DataFrame:
    """R4 over lines: levels are counted where the lines are; 256 counts a page and batch at most are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, np.ndarray] = {}
            for scan, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = np.bincount(np.frombuffer(line.as_buffer(), np.uint8), minlength=256)
                seen[scan] = seen[scan] + n if scan in seen else n
            rows = [(scan, g, n) for scan, hist in seen.items() for g, n in enumerate(hist.tolist()) if n]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64()), strict=True)],
                                             names=["scan_id", "gray", "n"])

    hist = lines.select("scan_id", "line").mapInArrow(count, "scan_id bigint, gray int, n bigint")
    return R.otsu_of(hist.groupBy("scan_id", "gray").agg(F.sum("n").cast("double").alias("n")))


def _window_sums(v: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """Sums over ``radius`` to either side along an axis, clipped at the ends."""
    n = v.shape[axis]
    total = np.concatenate([np.zeros_like(np.take(v, [0], axis)), np.cumsum(v, axis=axis)], axis=axis)
    at = np.arange(n)
    return np.take(total, np.minimum(at + radius + 1, n), axis) - np.take(total, np.maximum(at - radius, 0), axis)


def threshold(lines: DataFrame) -> DataFrame:
    """R5 over lines, to runs. A strip is worked on with the lines that its windows reach into; sums are whole numbers, so strips
    agree with the page to the last bit."""
    p = lines.selectExpr("*", "cast(greatest(15, cast(floor(least(w, h) / 16D + 0.5) AS int) | 1) div 2 AS int) AS r")
    p = p.join(otsu(lines), "scan_id").selectExpr(
        "*", f"explode(sequence(greatest(0, y - r) div {STRIP}, least(h - 1, y + r) div {STRIP})) AS strip")

    def ink(table: pa.Table) -> pa.Table:
        w, h, r, level, strip = (table.column(c)[0].as_py() for c in ("w", "h", "r", "otsu", "strip"))
        scan, first, gray = _stacked(table)
        y0, y1 = strip * STRIP, min(h, (strip + 1) * STRIP)
        mine = slice(y0 - first, y1 - first)
        at = np.arange(y0, y1)
        lines_in = np.minimum(h, at + r + 1) - np.maximum(0, at - r)
        x = np.arange(w)
        n = (lines_in[:, None] * (np.minimum(w, x + r + 1) - np.maximum(0, x - r))[None]).astype(np.float64)
        g = gray.astype(np.int64)
        s = _window_sums(_window_sums(g, r, 1), r, 0)[mine]
        q = _window_sums(_window_sums(g * g, r, 1), r, 0)[mine]
        m = s / n
        sd = np.sqrt(np.maximum(0.0, q / n - m * m))
        own = gray[mine]
        below = own < np.minimum(m * (1 + R.SAUVOLA_K * (sd / R.SAUVOLA_R - 1)), m - R.MIN_CONTRAST)
        return _run_rows(scan, w, h, y0, below & (own < min(250, level + 55)))

    return p.groupBy("scan_id", "strip").applyInArrow(ink, RUNS)


def turned(lines: DataFrame, angles: DataFrame) -> DataFrame:
    """R11 over lines: each page by its angle in radians, bilinear, on a canvas that holds all of it; outside is paper. A strip of the
    turned page gets the lines that cross it."""
    page = lines.join(angles.select("scan_id", "angle"), "scan_id").selectExpr("*", "IF(abs(angle) < 1e-4, 0D, angle) AS a").selectExpr(
        "*", "cos(a) AS cs", "sin(a) AS sn").selectExpr(
        "*", "cast(ceil(abs(w * cs) + abs(h * sn)) AS int) AS nw", "cast(ceil(abs(w * sn) + abs(h * cs)) AS int) AS nh")
    centre, reach = "(y - h / 2D) / cs + nh / 2D", "(abs(sn) * nw / 2D + 2) / cs + 1"
    page = page.selectExpr(
        "*", f"least(nh - 1, greatest(0, cast(floor({centre} - ({reach})) AS int))) AS t0", f"least(nh - 1, greatest(0, cast(ceil({centre} + ({reach})) AS int))) AS t1")
    page = page.selectExpr("* EXCEPT (t0, t1, angle)", f"explode(sequence(t0 div {STRIP}, t1 div {STRIP})) AS strip")

    def turn(table: pa.Table) -> pa.Table:
        w, h, a, cs, sn, nw, nh, strip = (table.column(c)[0].as_py() for c in ("w", "h", "a", "cs", "sn", "nw", "nh", "strip"))
        scan, first, gray = _stacked(table)
        y0, y1 = strip * STRIP, min(nh, (strip + 1) * STRIP)
        if a == 0:
            return pa.Table.from_batches([_line_rows(scan, w, h, y0, gray[y0 - first : y1 - first])])
        out = np.full((y1 - y0, nw), R.PAPER, np.uint8)
        dx = np.arange(nw) - nw / 2.0
        for k in range(y1 - y0):  # a line at a time, so that only numbers of one line are held as doubles
            dy = y0 + k - nh / 2.0
            sx, sy = cs * dx + sn * dy + w / 2.0, -sn * dx + cs * dy + h / 2.0
            at = np.flatnonzero((sx >= 0) & (sy >= 0) & (sx < w - 1) & (sy < h - 1))
            sx, sy = sx[at], sy[at]
            ix, iy = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
            fx, fy = sx - ix, sy - iy
            up, down = gray[iy - first], gray[iy + 1 - first]
            own = np.arange(len(at))
            mix = (up[own, ix] * (1 - fx) * (1 - fy) + up[own, ix + 1] * fx * (1 - fy)
                   + down[own, ix] * (1 - fx) * fy + down[own, ix + 1] * fx * fy)
            out[k, at] = np.clip(np.round(mix), 0, 255)
        return pa.Table.from_batches([_line_rows(scan, nw, nh, y0, out)])

    return page.groupBy("scan_id", "strip").applyInArrow(turn, LINES)


# --- angles from runs ---------------------------------------------------------------------
def _steps_squared(profile: np.ndarray) -> int:
    d = np.diff(profile)
    return int((d * d).sum())


def _row_profile(y, x0, x1, w: int, h: int, tan: float) -> np.ndarray:
    """Ink on each line after a shear of the lines. A run is cut where the shear steps, so it costs a row a step, not a pixel."""
    over = int(np.ceil(abs(tan) * w))
    shift = np.floor(tan * np.arange(w) + 0.5).astype(np.int64)
    change = np.flatnonzero(np.diff(shift)) + 1
    starts = np.concatenate([[0], change, [w]])
    first, last = np.searchsorted(change, x0, side="right"), np.searchsorted(change, x1 - 1, side="right")
    many = last - first + 1
    run = np.repeat(np.arange(len(y)), many)
    part = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + first[run]
    length = np.minimum(x1[run], starts[part + 1]) - np.maximum(x0[run], starts[part])
    at = y[run] + (over if tan < 0 else 0) - shift[starts[part]]
    size = h + over + 2
    inside = (at >= 0) & (at < size)
    return np.bincount(at[inside], weights=length[inside], minlength=size).astype(np.int64)


def _column_profile(y, x0, x1, w: int, h: int, tan: float) -> np.ndarray:
    """Ink on each column after a shear of the columns: two ends a run, summed along the profile."""
    pad = int(np.ceil(abs(tan) * h)) + 2
    shift = np.floor(tan * y + 0.5).astype(np.int64) + pad
    size = w + 2 * pad
    ends = np.bincount(x0 + shift, minlength=size + 1) - np.bincount(x1 + shift, minlength=size + 1)
    return np.cumsum(ends)[:size]


def _sharpest(score: Callable[[float], int], angles, coarse: float) -> float:
    """The coarse angle of the sharpest profile (the first of equals), then finer ones as long as they lie within a coarse step of the
    best so far."""
    first, second = angles
    k, best, top = max(((k, d, score(t)) for k, d, t in first), key=lambda r: (r[2], -r[0]))
    for kk, _, deg, tan in second:
        if kk != k:
            continue
        if deg > best + coarse:
            break
        now = score(tan)
        if now > top:
            best, top = deg, now
    return best


def _angles(runs: DataFrame, profile, angles, coarse: float) -> DataFrame:
    def one(table: pa.Table) -> pa.Table:
        y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        w, h = table.column("w")[0].as_py(), table.column("h")[0].as_py()
        deg = _sharpest(lambda tan: _steps_squared(profile(y, x0, x1, w, h, tan)), angles, coarse)
        return pa.table({"scan_id": pa.array([table.column("scan_id")[0].as_py()], pa.int64()), "deg": pa.array([deg], pa.float64())})

    return runs.select("scan_id", "w", "h", "y", "x0", "x1").groupBy("scan_id").applyInArrow(one, "scan_id bigint, deg double")


def page_skew(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """R9 over runs: tilt of each page in degrees. A page's runs, which its size bounds, are scored in one task; fine angles only as far
    as the search goes. A page without ink keeps the first angle."""
    return pages.select("scan_id").join(_angles(runs, _row_profile, R.SKEW, 1.0), "scan_id", "left").na.fill(-8.0, ["deg"])


def writing_slant(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """R10 over runs: lean of the writing in degrees, forwards positive."""
    s = pages.select("scan_id").join(_angles(runs, _column_profile, R.SLANT, 2.0), "scan_id", "left").na.fill(-32.0, ["deg"])
    return s.select("scan_id", (-F.col("deg") + F.lit(0.0)).alias("deg"))


# --- rules --------------------------------------------------------------------------------
def _along(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel of ink the length of its run along the last axis, and where the run starts."""
    edge = np.zeros((ink.shape[0], ink.shape[1] + 2), np.int8)
    edge[:, 1:-1] = ink
    step = np.diff(edge, axis=1)
    first, last = np.nonzero(step == 1), np.nonzero(step == -1)
    length = (last[1] - first[1]).astype(np.int16)
    out, start = np.zeros(ink.shape, np.int16), np.zeros(ink.shape, np.int16)
    out[ink] = np.repeat(length, length)
    start[ink] = np.repeat(first[1].astype(np.int16), length)
    return out, start


def without_rules(runs: DataFrame, min_fraction: float = 0.3, min_absolute: int = 40, tolerance: float = 1.7, min_thick: int = 2,
                  cap: int = 24) -> DataFrame:
    """R8 over runs: what is left of each page, and a row with y = -1 a page that carries (rules, removed) instead of a run.

    A page's mask is one byte a pixel in one task, and its run lengths two; pages are capped, so that is bounded.
    """

    def one(table: pa.Table) -> pa.Table:
        scan, w, h = (table.column(c)[0].as_py() for c in ("scan_id", "w", "h"))
        y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        ends = np.zeros((h, w + 1), np.int8)
        ends[y, x0] += 1
        ends[y, x1] -= 1
        ink = np.cumsum(ends, axis=1, dtype=np.int8)[:, :w].astype(bool)
        across, x_first = _along(ink)
        down, y_first = (v.T for v in _along(np.ascontiguousarray(ink.T)))
        long_h = ink & (across >= max(min_absolute, np.floor(w * min_fraction + 0.5)))
        long_v = ink & (down >= max(min_absolute, np.floor(h * min_fraction + 0.5)))
        yy, xx = np.nonzero(long_h)
        sampled = (xx - x_first[yy, xx]) % 16 == 0
        seen = np.sort(np.minimum(down[yy, xx][sampled], cap))
        thick = min(cap, max(min_thick, np.floor(int(seen[len(seen) >> 1]) * tolerance + 0.5))) if len(seen) else min_thick
        doomed = (long_h & (down <= thick)) | (long_v & (across <= thick))
        rules = int((xx == x_first[yy, xx]).sum())
        yv, xv = np.nonzero(long_v)
        rules += int((yv == y_first[yv, xv]).sum())
        left = _run_rows(scan, w, h, 0, ink & ~doomed)
        nothing = pa.nulls(len(left), pa.int64())
        told = pa.table({"scan_id": [scan], "w": pa.array([w], pa.int32()), "h": pa.array([h], pa.int32()), "y": pa.array([-1], pa.int32()),
                         "x0": pa.array([0], pa.int32()), "x1": pa.array([0], pa.int32()), "rules": [rules], "removed": [int(doomed.sum())]})
        return pa.concat_tables([told, left.append_column("rules", nothing).append_column("removed", nothing)])

    return runs.select("scan_id", "w", "h", "y", "x0", "x1").groupBy("scan_id").applyInArrow(one, RUNS + ", rules bigint, removed bigint")


def preprocess(lines: DataFrame, put: Callable[[str, Callable[[], DataFrame]], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """R13 over lines: clean labelled runs, and each page's angle, slant, ink share and rules removed.

    ``put(name, make)`` stages a table that several steps read (``stages.Stages.put``).
    """
    pages = put("pages", lambda: lines.select("scan_id").distinct())
    skew = put("skew", lambda: page_skew(R.despeckle(R.label_runs(threshold(shrunk(lines)))), pages))
    straight = put("straight", lambda: turned(lines, skew.select("scan_id", F.radians("deg").alias("angle"))))
    left = put("unruled", lambda: without_rules(threshold(straight)))
    labelled = put("labelled", lambda: R.label_runs(left.where("y >= 0").select("scan_id", "w", "h", "y", "x0", "x1")))
    runs = put("runs", lambda: R.despeckle(labelled))
    slant = writing_slant(runs, pages)
    info = skew.withColumnRenamed("deg", "angle_deg").join(slant.withColumnRenamed("deg", "slant"), "scan_id").join(
        R.ink_ratio(runs), "scan_id", "left").join(left.where("y < 0").select("scan_id", "rules", "removed"), "scan_id", "left").na.fill(0)
    return runs, put("info", lambda: info)
