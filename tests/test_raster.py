"""Page operators against plain numpy on small pages."""

import random
import statistics
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.operators import health as H
from quillwork.operators import raster as R
from quillwork.operators import segment as G
from quillwork.sources import images


def ink_df(spark, *pages):
    rows = [(k, p.shape[1], p.shape[0], int(y), int(x)) for k, p in enumerate(pages) for y, x in zip(*np.nonzero(p))]
    return spark.createDataFrame(rows, "scan_id bigint, w int, h int, y int, x int")


def flood(p):
    """Boxes of 8-connected components in raster order of their first pixel."""
    seen, out = np.zeros(p.shape, bool), []
    for y, x in zip(*np.nonzero(p)):
        if seen[y, x]:
            continue
        todo, mine = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            mine.append((a, b))
            for c in range(max(0, a - 1), min(p.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(p.shape[1], b + 2)):
                    if p[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        ys, xs = zip(*mine)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(mine)))
    return out


@pytest.mark.parametrize("strip", [4, 7, 256])
def test_components_across_strips(spark, strip):
    rnd = np.random.default_rng(strip)
    pages = [rnd.random((30, 25)) < d for d in (0.2, 0.4, 0.55)]
    snake = np.zeros((31, 9), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    pages.append(snake)
    lab = R.label_runs(R.ink_runs(ink_df(spark, *pages)), strip)
    got = {}
    for r in R.components(lab).orderBy("scan_id", "comp_id").collect():
        got.setdefault(r.scan_id, []).append((r.x0, r.y0, r.x1, r.y1, r.area))
    assert [got[k] for k in range(4)] == [flood(p) for p in pages]


def ruled(w=300, h=220, thick=2):
    p = np.zeros((h, w), bool)
    for y in range(20, h, 60):
        p[y:y + thick] = True
    p[:, 30:32] = True
    p[50:110, 100:112] = True  # a stem across a rule
    return p


def test_rules_go_and_stems_stay(spark):
    page, blank = ruled(), np.zeros((60, 60), bool)
    blank[5:9, 5:9] = True
    ink, stats = R.remove_rules(ink_df(spark, page, blank))
    left = np.zeros(page.shape, bool)
    for r in ink.where("scan_id = 0").collect():
        left[r.y, r.x] = True
    assert left[50:110, 100:112].all() and not left[20:22, 200:].any() and not left[:19, 30:32].any()
    assert ink.where("scan_id = 1").count() == 16
    by = {r.scan_id: r for r in stats.collect()}
    assert by[0].rules > 0 and by[1].rules == 0 and by[1].removed == 0


def test_tilted_lines_are_measured(spark):
    deg = 3.0
    p = np.zeros((200, 300), bool)
    for base in range(30, 170, 30):
        for x in range(300):
            y = int(round(base + np.tan(np.radians(deg)) * x))
            if y + 3 < 200:
                p[y:y + 3, x] = True
    ink = ink_df(spark, p)
    assert abs(R.page_skew(ink, ink.select("scan_id").distinct()).first().deg - deg) <= 0.3


def test_blank_page_keeps_the_first_angle(spark):
    ink = ink_df(spark, np.eye(4, dtype=bool)).where("scan_id < 0")
    pages = spark.range(1).withColumnRenamed("id", "scan_id")
    assert R.page_skew(ink, pages).first().deg == -8.0


def test_stamped_dot(spark):
    s = spark.createDataFrame([(1, 20, 20, [(10.0, 10.0, 3.0)])], "glyph_id bigint, width int, height int, points array<struct<x: double, y: double, r: double>>")
    d = R.drawn_glyphs(R.stroke_raster(s)).first()
    assert (d.x0, d.y0, d.x1, d.y1) == (7, 7, 13, 13) and d.w == 10


def _png(a: np.ndarray) -> bytes:
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + row.tobytes() for row in a.astype(np.uint8))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files_are_read(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (5, 7, 3))
    (tmp_path / "a.png").write_bytes(_png(a))
    (tmp_path / "b.png").write_bytes(b"no image")
    px = images.scan_pixels(images.read_scans(spark, str(tmp_path))).collect()
    assert len(px) == 35 and all((a[r.y, r.x] == (r.r, r.g, r.b)).all() for r in px)
    g = images.working_gray(images.read_scans(spark, str(tmp_path))).collect()
    assert all(r.gray == (a[r.y, r.x] * (77, 150, 29)).sum() >> 8 for r in g)


# --- cells --------------------------------------------------------------------------------
def sheet(n, fused=(), split=(), noise=False, h=120):
    """A row of blocks: some touching their neighbour, some in two stacked parts, some stray specks."""
    p = np.zeros((h, 20 + 46 * n), bool)
    for i in range(n):
        x = 10 + 46 * i
        if i in split:
            p[30:45, x:x + 30] = p[52:90, x:x + 30] = True
        else:
            p[30:90, x:x + 30] = True
        if i in fused:
            p[60:62, x + 30:x + 46] = True
    if noise:
        p[60:63, 41:44] = True
    return p


def cells(spark, page, sheet_no):
    lab = R.label_runs(R.ink_runs(ink_df(spark, page)))
    pages = spark.createDataFrame([(0, sheet_no)], "scan_id bigint, sheet_no int")
    comps = R.components(lab)
    return G.segment(lab, comps, pages)


@pytest.mark.parametrize("kind", [{}, {"fused": (3,)}, {"split": (2, 8)}, {"noise": True}])
def test_thirteen_cells_however_written(spark, kind):
    _, groups, c, refused = cells(spark, sheet(13, **kind), 0)
    rows = c.orderBy("col").collect()
    assert refused.count() == 0 and [r.ch for r in rows] == list("abcdefghijklm")
    assert not any(r.missing for r in rows)
    xs = [r.x0 for r in rows]
    assert all(abs(x - (10 + 46 * i)) <= 16 for i, x in enumerate(xs))  # a bridge stays with its right half


def test_missing_cells_are_marked_and_told(spark):
    bands, groups, c, _ = cells(spark, sheet(10), 0)
    # ten plain blocks are cut until thirteen are found, as no block is told apart from a pair
    assert c.where("NOT missing").count() == 13
    pages = spark.createDataFrame([(0, 0)], "scan_id bigint, sheet_no int")
    assert "row-adjusted" in [r.code for r in G.issues(bands, groups, pages).collect()]


def test_refused_pages(spark):
    p = np.zeros((60, 400), bool)
    p[::2, ::2] = False
    p[1::3, 1::3] = True
    pages = spark.createDataFrame([(0, 0), (1, 0)], "scan_id bigint, sheet_no int")
    comps = R.components(R.label_runs(R.ink_runs(ink_df(spark, p))))
    assert {r.scan_id: r.code for r in G.component_cap(comps, pages).collect()} == {0: "too-many-marks", 1: "no-ink"}


def test_greedy_steps():
    box = lambda i, x0, y0, x1, y1: dict(comp_id=i, x0=x0, y0=y0, x1=x1, y1=y1, area=(x1 - x0) * (y1 - y0))
    dot_and_stem = [box(1, 10, 0, 14, 4), box(2, 10, 8, 14, 30), box(3, 30, 8, 44, 30)]
    merged = G.merge_stacked(G._boxes(dot_and_stem))
    assert [len(g["parts"]) for g in merged] == [2, 1]
    row = G._boxes([box(i, x, 0, x + 8, 8) for i, x in enumerate((0, 20, 30, 60))])
    assert [g["x0"] for g in G.fuse_closest(row, 3)] == [0, 20, 60]
    strays = G._boxes([box(i, 20 * i, 0, 20 * i + 10, 10) for i in range(4)] + [box(9, 90, 0, 91, 1)])
    assert len(G.drop_strays(strays, False)) == 4 and len(G.drop_strays(strays, True)) == 5


def test_bands_are_fused_then_the_densest_kept(spark):
    counted = spark.createDataFrame([(0, 0, 30, 6), (0, 33, 60, 0), (0, 100, 130, 6), (0, 170, 200, 6), (0, 300, 330, 1)],
                                    "scan_id bigint, y0 int, y1 int, n int")
    pages = spark.createDataFrame([(0, 14)], "scan_id bigint, sheet_no int")
    got = G.reconcile_bands(counted, pages).orderBy("rw").collect()
    assert [(r.y0, r.y1) for r in got] == [(0, 60), (100, 130), (170, 200)] and got[0].fused == 1 and got[0].dropped == 1


def test_stroke_width_of_a_bar(spark):
    ink = spark.createDataFrame([(1, y, x) for y in range(20) for x in range(6)], "glyph_id bigint, y int, x int")
    r = H.stroke_width(ink).first()
    assert r.area == 120 and r.perimeter == 120 - 18 * 4


def test_refused_pages_get_one_fatal_and_nothing_else(spark):
    """Page 0 is far too full, page 1 is blank, page 2 is a row of marks."""
    full = np.zeros((120, 200), bool)
    full[::3, ::3] = True
    plain = np.zeros((120, 200), bool)
    for k in range(5):
        plain[40:80, 10 + 35 * k:30 + 35 * k] = True
    pages = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "scan_id bigint, sheet_no int")
    runs = R.label_runs(R.ink_runs(ink_df(spark, full)).unionByName(R.ink_runs(ink_df(spark, plain)).withColumn("scan_id", F.lit(2).cast("bigint"))))
    bands, groups, cells, refused = G.segment(runs, R.components(runs), pages)
    assert {r.scan_id: (r.level, r.code) for r in refused.collect()} == {0: ("fatal", "too-many-marks"), 1: ("fatal", "no-ink")}
    assert {r.scan_id for r in cells.collect()} == {2} == {r.scan_id for r in bands.collect()}
    told = G.issues(bands, groups, G.accepted(pages, refused)).collect()
    assert {r.scan_id for r in told} <= {2}


def test_blank_rows_keep_their_place(spark):
    bands = spark.createDataFrame([(7, 0), (7, 1), (7, 2)], "scan_id bigint, rw int")
    groups = spark.createDataFrame([(7, 0, 5), (7, 0, 5), (7, 2, 4)], "scan_id bigint, rw int, observed int")
    assert sorted((r.rw, r.n) for r in G.observed_rows(bands, groups).collect()) == [(0, 5), (1, 0), (2, 4)]


def test_bands_of_every_kind(spark):
    """Random pages against the rule taken step by step: the narrowest open gap first, then the densest bands."""
    rnd = random.Random(3)
    want = {r.sheet_no: (r.rows, r.sparsest) for r in G.sheet_rows(spark).groupBy("sheet_no").agg(
        F.count("*").alias("rows"), F.min("want").alias("sparsest")).collect()}
    counted, pages, due = [], [], {}
    for scan in range(60):
        sheet, y, bands = rnd.choice(sorted(want)), 0, []
        for _ in range(rnd.randrange(1, 9)):
            h = rnd.randrange(20, 40)
            bands.append((y, y + h, rnd.randrange(0, 14)))
            y += h + rnd.choice([1, 4, 9, 9, 60])
        pages.append((scan, sheet))
        counted += [(scan, *b) for b in bands]
        rows, sparsest = want[sheet]
        fused = 0
        while len(bands) > rows:
            open_gaps = {i: bands[i + 1][0] - bands[i][1] for i in range(len(bands) - 1) if min(bands[i][2], bands[i + 1][2]) < sparsest - 1}
            if not open_gaps or min(open_gaps.values()) > statistics.median(b[1] - b[0] for b in bands) * 0.45:
                break
            i = min(open_gaps, key=open_gaps.get)
            bands[i : i + 2] = [(bands[i][0], bands[i + 1][1], bands[i][2] + bands[i + 1][2])]
            fused += 1
        over = max(0, len(bands) - rows)
        keep = sorted(bands, key=lambda b: (-b[2], b[0]))[:rows]
        due |= {(scan, k): (*b, fused, over) for k, b in enumerate(sorted(keep))}
    assert {d[3] for d in due.values()} >= {0, 1, 2} and {d[4] for d in due.values()} >= {0, 1, 2}
    got = G.reconcile_bands(spark.createDataFrame(counted, "scan_id bigint, y0 int, y1 int, n int"),
                            spark.createDataFrame(pages, "scan_id bigint, sheet_no int"))
    assert {(r.scan_id, r.rw): (r.y0, r.y1, r.n, r.fused, r.dropped) for r in got.collect()} == due
