"""Pages as scanlines against the same operators pixel by pixel, and stages that are resumed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.operators import pages as P
from quillwork.operators import raster as R
from quillwork.stages import Stages


def drawn(seed: int, h: int, w: int) -> np.ndarray:
    """Gray paper with a gradient, noise, words and a rule."""
    rng = np.random.default_rng(seed)
    g = 200 + 40 * np.arange(w)[None] / w + rng.normal(0, 4, (h, w))
    for _ in range(h * w // 700):
        y, x = rng.integers(0, h - 4), rng.integers(0, w - 4)
        g[y : y + rng.integers(2, 12), x : x + rng.integers(2, 9)] -= rng.integers(60, 180)
    g[h // 2 : h // 2 + 2, : w - 2] = 40
    return np.clip(g, 0, 255).astype(np.uint8)


PAGES = {1: drawn(1, 70, 110), 2: drawn(2, 131, 47), 3: np.full((20, 30), 255, np.uint8), 4: drawn(4, 9, 300)}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(k, g.shape[1], g.shape[0], y, bytearray(g[y].tobytes())) for k, g in PAGES.items() for y in range(len(g))]
    return spark.createDataFrame(rows, P.LINES).repartition(3)


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(k, g.shape[1], g.shape[0], y, x, int(g[y, x])) for k, g in PAGES.items() for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows, "scan_id bigint, w int, h int, y int, x int, gray int")


@pytest.fixture(params=[256, 16])
def strip(request, monkeypatch):
    monkeypatch.setattr(P, "STRIP", request.param)


def opened(lines):
    return {(r.scan_id, r.w, r.h, r.y, x, v) for r in lines.collect() for x, v in enumerate(r.line)}


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


KEY = ("scan_id", "w", "h", "y", "x", "gray")
RUN = ("scan_id", "w", "h", "y", "x0", "x1")


@pytest.mark.parametrize("most", [50, 33, 1000])
def test_lines_are_shrunk_like_pixels(lines, pixels, most, strip):
    assert opened(P.shrunk(lines, most)) == rows(R.box_downscale(pixels, most), *KEY)


def test_images_become_the_gray_lines_of_their_pixels(spark, monkeypatch):
    from quillwork.sources import images

    monkeypatch.setattr(P, "CUT", 8)
    rng = np.random.default_rng(3)
    made = [(k, w, h, n, bytearray(rng.integers(0, 256, h * w * n, dtype=np.uint8).tobytes())) for k, (w, h, n) in enumerate([(61, 83, 3), (40, 7, 4), (9, 30, 1), (1, 1, 3)])]
    scans = spark.createDataFrame(made, "scan_id bigint, w int, h int, n int, data binary")
    for blue in (False, True):
        for most in (40, 37, 500):
            want = rows(R.box_downscale(R.gray_luma(images.scan_pixels(scans), blue), most), *KEY)
            assert opened(P.gray_lines(scans, most, blue)) == want
    short = spark.createDataFrame([(7, 10, 10, 3, bytearray(5)), (8, 0, 0, 3, bytearray())], scans.schema)
    assert P.gray_lines(short).count() == 0


def test_threshold_of_lines_and_pixels(lines, pixels, strip):
    assert rows(P.otsu(lines), "scan_id", "otsu") == rows(R.otsu(pixels), "scan_id", "otsu")
    assert rows(P.threshold(lines), *RUN) == rows(R.ink_runs(R.sauvola(pixels)), *RUN)


def test_turned_lines_and_pixels(spark, lines, pixels, strip):
    angles = spark.createDataFrame([(1, 0.13), (2, -0.08), (3, 0.0), (4, 0.02)], "scan_id bigint, angle double")
    assert opened(P.turned(lines, angles)) == rows(R.rotate_gray(pixels, angles), *KEY)


def test_angles_from_runs_and_pixels(spark, pixels):
    ink = R.sauvola(pixels).checkpoint()
    runs, pages = R.ink_runs(ink), pixels.select("scan_id").distinct()
    assert rows(P.page_skew(runs, pages), "scan_id", "deg") == rows(R.page_skew(ink, pages), "scan_id", "deg")
    assert rows(P.writing_slant(runs, pages), "scan_id", "deg") == rows(R.writing_slant(ink, pages), "scan_id", "deg")


def test_rules_from_runs_and_pixels(spark, pixels):
    ink = R.sauvola(pixels).checkpoint()
    for options in ({}, {"min_absolute": 8, "min_fraction": 0.1}):
        left, stats = R.remove_rules(ink, **options)
        got = P.without_rules(R.ink_runs(ink), **options)
        assert rows(got.where("y >= 0"), *RUN) == rows(R.ink_runs(left), *RUN)
        assert rows(got.where("y < 0"), "scan_id", "rules", "removed") == rows(stats, "scan_id", "rules", "removed")


def test_preprocess_of_lines_and_pixels(spark, lines, pixels):
    stages = Stages(spark, "test-preprocess")
    runs, info = P.preprocess(lines, stages.put)
    want_runs, want = R.preprocess(pixels)
    assert rows(runs, *RUN, "ly", "lx") == rows(want_runs, *RUN, "ly", "lx")
    cols = ("scan_id", "angle_deg", "slant", "n", "ratio", "rules", "removed")
    assert rows(info, *cols) == rows(want, *cols)
    stages.finish()


def test_a_job_goes_on_where_it_stopped(spark):
    made = []

    def table(name, n, fail=False):
        def make():
            made.append(name)
            if fail:
                raise RuntimeError("lost")
            return spark.range(n)

        return make

    name = f"resumed-{np.random.randint(1 << 30)}"
    first = Stages(spark, "test-stages", name)
    first.put("a", table("a", 3))
    with pytest.raises(RuntimeError):
        first.put("b", table("b", 4, fail=True))
    again = Stages(spark, "test-stages", name)
    assert again.put("a", table("a", 3)).count() == 3 and again.put("b", table("b", 4)).count() == 4
    assert made == ["a", "b", "b"]
    with pytest.raises(ValueError):
        again.put("b", table("b", 4))
    again.finish(keep=["b"])
    assert not again.done("a") and again.done("b")
    assert spark.read.parquet(f"{again.at}/b").agg(F.sum("id")).first()[0] == 6
