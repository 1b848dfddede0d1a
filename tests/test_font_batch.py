"""From image files to a family: drawn pages, a broken file, a file that is not there, and a job that is lost on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.functions import dims
from quillwork.operators import metrics as M
from quillwork.plans import pipeline as X
from tests.test_raster import _png

TOP = {"x": -40, "desc": -40, "asc": -72, "full": -72, "base": -8, "mid": -24, "high": -72}
BOTTOM = {"x": 0, "desc": 24, "asc": 0, "full": 24, "base": 0, "mid": -16, "high": -60}


def drawn_page(sheet_no: int, seed: int) -> np.ndarray:
    """Each character of a sheet as an open or closed shape of its own, of the height of its zone."""
    info = {r[1]: r for r in dims.charset_rows()}
    cells = [r for r in dims.sheet_rows() if r[0] == sheet_no]
    rows = max(r[3] for r in cells) + 1
    page = np.full((140 * rows + 40, 60 * 13 + 40, 3), 245, np.int64)
    rng = np.random.default_rng(seed)
    for _, _, _, rw, col, _, ch in cells:
        x, base = 40 + 60 * col, 110 + 140 * rw
        top, bottom = base + TOP[info[ch][3]], base + BOTTOM[info[ch][3]]
        wide = 22 + ord(ch) % 14
        page[top:bottom, x : x + 6] = 30
        page[bottom - 6 : bottom, x : x + wide] = 30
        if ord(ch) % 2:
            page[top:bottom, x + wide - 6 : x + wide] = 30
        if ord(ch) % 3 == 0:
            page[top : top + 6, x : x + wide] = 30
    return np.clip(page + rng.integers(-4, 5, page.shape), 0, 255)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    for no in (0, 1):
        (at / f"own_{no}.png").write_bytes(_png(drawn_page(no, no)))
    (at / "blank.png").write_bytes(_png(np.full((60, 90, 3), 250)))
    (at / "torn.png").write_bytes(b"not an image")
    return str(at)


def tables(family):
    out = {}
    for name, cols in {"glyphs": ("font_id", "ch", "lsb", "rsb", "advance", "ink_width"), "kerning": ("left_ch", "right_ch", "value"), "classes": ("c1", "c2", "value"),
                       "styles": ("style", "name", "gid", "styled_advance"), "style_kerning": ("style", "left_gid", "right_gid", "value"),
                       "extents": ("style", "ascender", "descender"), "manifest": ("file", "glyph_count", "kern_count"), "findings": ("code", "n"),
                       "report": ("font_id", "captured", "expected", "score", "label"), "refused": ("scan_id", "code")}.items():
        out[name] = sorted(map(str, getattr(family, name).select(*cols).collect()))
    return out


def test_files_become_a_family_and_a_lost_job_goes_on(spark, folder, monkeypatch):
    pages = spark.createDataFrame([("own_0.png", 5, 0), ("own_1.png", 5, 1), ("blank.png", 5, 2), ("torn.png", 5, 3), ("gone.png", 5, 4)], "file string, font_id bigint, sheet_no int")
    families = spark.createDataFrame([(5, "Own hand")], "font_id bigint, family string")
    name = f"lost-{np.random.randint(1 << 30)}"
    kerning = M.kerning
    monkeypatch.setattr(M, "kerning", lambda gaps: (_ for _ in ()).throw(RuntimeError("executor lost")))
    with pytest.raises(RuntimeError):
        X.font_batch_files(spark, folder, pages, families, name)
    monkeypatch.setattr(M, "kerning", kerning)
    made = []
    monkeypatch.setattr(X.T, "vectorize", lambda *a: made.append("outlines"))
    family = X.font_batch_files(spark, folder, pages, families, name)
    assert not made  # what was there is not made again
    got = tables(family)
    monkeypatch.undo()
    assert got == tables(X.font_batch_files(spark, folder, pages, families))

    chars = [r[6] for r in dims.sheet_rows() if r[0] in (0, 1)]
    glyphs = {r.ch: r for r in family.glyphs.collect()}
    assert sorted(glyphs) == sorted(chars)
    assert all(abs(r.ink_width / glyphs["a"].ink_width - (22 + ord(c) % 14) / (22 + ord("a") % 14)) < 0.12 for c, r in glyphs.items())
    report = family.report.first()
    assert report.captured == len(chars) and report.expected == len([r for r in dims.sheet_rows() if r[0] in (0, 1, 2)])
    assert {r.style for r in family.styles.collect()} == {"Regular", "Bold", "Italic", "Bold Italic"}
    assert [r.file for r in family.manifest.orderBy("file").collect()] == [f"Own-hand-{s}.otf" for s in ("Bold-Italic", "Bold", "Italic", "Regular")]
    wide = {r.style: r.w for r in family.styles.where("kind = 'required'").groupBy("style").agg(F.sum(F.expr("bx1 - bx0")).alias("w")).collect()}
    assert wide["Bold"] > wide["Regular"] and wide["Italic"] > wide["Regular"]
    assert sorted(r.code for r in family.refused.collect()) == ["no-file", "no-ink", "not-an-image"]
    n = family.classes.agg(F.max("c1"), F.max("c2"), F.count("*")).first()
    assert family.kerning.count() > 0 and n[2] == (n[0] + 1) * (n[1] + 1)
    assert {r.code for r in family.findings.collect()} >= {"missing-symbols", "not-written"}
    turned = {r.scan_id: r for r in family.pages.collect()}
    assert len(turned) == 3 and all(abs(r.angle_deg) <= 8 for r in turned.values())
