"""Imported outlines, snapshots, search and triage on small literal inputs."""

from pyspark.sql import functions as F

from quillwork.operators import corpus as X
from quillwork.operators import family as Y
from quillwork.operators import imports as I
from quillwork.operators import outline as T
from quillwork.operators import search as D
from quillwork.operators import triage as S
from quillwork.sources import adapters as A

CMD = "type string, x double, y double, x1 double, y1 double, x2 double, y2 double"


def glyph(spark, *cmds):
    rows = [(c[0], *map(float, c[1:]), *[None] * (7 - len(c))) for c in cmds]
    return spark.createDataFrame([(1, rows)], f"glyph_id bigint, cmds array<struct<{CMD}>>")


def test_paths_of_every_command(spark):
    g = glyph(spark, ("M", 0, 0), ("L", 10, 0), ("C", 0, 10, 20, 0, 20, 10), ("Z",), ("M", 50, 0), ("Q", 60, 0, 55, 9), ("L", 55, -5))
    c = I.path_to_cubics(g).first().curves
    assert [(k.contour, k.seq) for k in c] == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (1, 5)]
    assert (c[1].c1.x, c[1].c2.y) == (20, 10) and (c[2].p3.x, c[2].p3.y) == (0, 0) and (c[5].p3.x, c[5].p3.y) == (50, 0)
    assert abs(c[3].c1.y - 6) < 1e-9 and c[0].outer and not c[3].outer


def test_bold_grows_and_lean_keeps_height(spark):
    g = I.path_to_cubics(glyph(spark, ("M", 0, 0), ("L", 100, 0), ("L", 100, 200), ("L", 0, 200), ("Z",)))
    b = T.bounds(Y.embolden(g, "20")).first()
    assert b.bx0 < -5 and b.bx1 > 105 and b.by0 < -5 and b.by1 > 205
    s = T.bounds(Y.slant(g, "11D")).first()
    assert (s.by0, s.by1) == (0, 200) and s.bx0 < 0


def test_path_text(spark):
    g = I.path_to_cubics(glyph(spark, ("M", 0, 0), ("C", 1.5, -2.25, 0.004, 0.126, 3, 10)))
    assert T.svg_path(g.select("glyph_id", "curves")).first().path.startswith("M0 0C0 0.13 3 10 1.5 -2.25C")


def test_snapshot_round_trip(spark, tmp_path, sf):
    from quillwork.plans.family import imported
    g = imported(spark, sf).select("glyph_id", "font_id", "ch", "curves", "advance")
    path = str(tmp_path / "snap")
    Y.save_snapshot(g, path)
    spark.createDataFrame([(1, 9)], "glyph_id bigint, version int").write.mode("append").partitionBy("version").json(path)
    back = Y.load_snapshot(spark, path, Y.snapshot(g).schema)
    assert back.count() == g.count()
    key = F.sum(F.xxhash64("glyph_id", "ch", "curves", "advance").cast("decimal(38,0)"))
    assert back.select(key).first()[0] == Y.snapshot(g).select(key).first()[0]


DOCS = [
    ("l1", "lesson", "Pick the right pen", "A gel pen or fineliner gives a dark line. Avoid pencil."),
    ("l2", "lesson", "Lighting and shadows", "Shoot in even light. Uneven lighting is corrected."),
    ("l3", "lesson", "Spacing", "Side bearings are measured from the ink."),
    ("f1", "faq", "Is anything I write uploaded?", "No. Everything happens here."),
    ("f2", "faq", "Who owns the font?", "You do. There is no licence to follow."),
    ("i1", "install", "Installing on Windows", "Select all four .otf files. Right-click and choose Install. Open the zip."),
    ("i2", "install", "Installing on macOS", "Double-click each file, then Install Font."),
]


def look(spark, text):
    docs = spark.createDataFrame(DOCS, "doc_id string, kind string, title string, body string")
    q = spark.createDataFrame([(1, text)], "query_id int, query string")
    return [r.doc_id for r in D.rank(D.match(q, docs), q).orderBy("k").collect()]


def test_search(spark):
    assert look(spark, "pen")[0] == "l1" and "i1" not in look(spark, "pen")
    assert look(spark, "install windows") == ["i1"] and look(spark, "windows kangaroo") == []
    assert look(spark, "wind") == ["i1"] and look(spark, "lighting")[0] == "l2"
    assert look(spark, "who owns the font?")[0] == "f2" and look(spark, ".otf") == ["i1"]
    assert look(spark, "***") == [] and look(spark, "") == []


def test_snippet_is_cut_around_the_match(spark):
    docs = spark.createDataFrame([("x", "lesson", "Long", "pad " * 60 + "NEEDLE " + "pad " * 60)], "doc_id string, kind string, title string, body string")
    q = spark.createDataFrame([(1, "needle")], "query_id int, query string")
    s = D.snippets(D.rank(D.match(q, docs), q), q, docs).first().snippet
    assert "NEEDLE" in s and s[0] == s[-1] == "…" and len(s) < 200


def test_files(spark):
    rows = [("a.PY", ""), ("x.jpg", ""), ("clip.py", "image/png"), ("song", "audio/mpeg"), (".js", ""), ("a.", ""), ("b.tar.gz", ""), ("f.woff2", None)]
    got = {r.name: r.what for r in S.classify(spark.createDataFrame(rows, "name string, type string")).collect()}
    assert got == {"a.PY": "code", "x.jpg": None, "clip.py": None, "song": "sound", ".js": None, "a.": None, "b.tar.gz": "archive", "f.woff2": "font"}


def test_pictures_are_carved(spark):
    pic = lambda n: b"\xff\xd8\xff" + b"\x00" * (n - 5) + b"\xff\xd9"
    blob = bytearray(b"\xff\xd9noise" + pic(4096) + b"more" + pic(40000) + pic(100) + b"\xff\xd8\xff")
    r = S.carve_jpegs(spark.createDataFrame([(1, blob)], "id int, content binary")).first()
    assert (r.n_found, r.n_bytes) == (2, 40000) and bytes(r.jpeg) == pic(40000)


def test_links(spark):
    rows = [(1, "https://a.example/dir/p?x=1", h) for h in ("b", "//b.example/", "https://A.example:443/z", "ftp://c.example/", "http://a.example/q")]
    got = {r.href: (r.host, r.rest, r.secure) for r in X.outbound_links(spark.createDataFrame(rows, "page_id int, base string, href string")).collect()}
    assert got == {"//b.example/": ("b.example", "", True), "http://a.example/q": ("a.example", "/q", False)}


def test_adapter_words_are_runs(spark, sf):
    r = A.text_runs(spark, sf).where("scan_id = 1").collect()
    text = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 1").first().text
    assert sum(x.x1 - x.x0 for x in r) == sum(len(w) for w in text.split()) and len(r) == len(text.split())


def test_name_records_and_the_gate(spark):
    names = "font_id int, fs_type int, names array<struct<record: string, lang: string, text: string>>"
    fonts = spark.createDataFrame([
        (1, 2 | 4, [("fontFamily", "ko", "K"), ("fontFamily", "en", " E\n"), ("licence", "en", "T"), ("designer", "de", " ")]),
        (2, None, [("fontFamily", "en", " "), ("preferredFamily", "fr", "P"), ("licenseURL", "fr", "u")]),
        (3, 0x300, []), (4, 8, None)], names)
    told = {(r.font_id, r.record): r.text for r in I.licence_records(fonts).collect()}
    assert len(told) == 16 and {k: v for k, v in told.items() if v is not None} == {
        (1, "family"): "E", (1, "description"): "T", (2, "family"): "P", (2, "url"): "u"}
    gate = {r.font_id: (r.refused, r.no_subset, r.bitmap_only) for r in I.import_gate(fonts).collect()}
    assert gate == {1: ("restricted", False, False), 2: (None, False, False), 3: (None, True, True), 4: (None, False, False)}
    glyphs = spark.createDataFrame([(f, c) for f in (1, 2, 3, 9) for c in "ab"], "font_id int, ch string")
    assert {r.font_id for r in I.importable(glyphs, fonts).collect()} == {2, 3, 9}


def test_wanted_characters_by_outline(spark):
    ink = I.path_to_cubics(glyph(spark, ("M", 0, 0), ("L", 10, 0), ("L", 10, 9), ("Z",))).first().curves
    none = I.path_to_cubics(glyph(spark, ("M", 0, 0))).schema["curves"].dataType.simpleString()
    rows = [(1, 1, "a", "a", 97, ink), (2, 1, "b", ".notdef", 98, ink), (3, 1, "c", "c", 98, ink), (4, 1, "d", "d", 100, []), (5, 1, "d", "d2", 100, ink),
            (6, 2, "é", "eacute", 233, ink), (7, 2, "e", "e", 101, None)]
    g = spark.createDataFrame(rows, f"glyph_id int, font_id int, ch string, glyph_name string, unicode int, curves {none}")
    got = {(r.font_id, r.ch): (r.k, r.found) for r in I.import_found(g, ["a", "b", "c", "d", "é", "a", "e"]).collect()}
    assert {k for k, v in got.items() if v[1]} == {(1, "a"), (1, "d"), (2, "é")} and len(got) == 12 and got[1, "e"] == (5, False)


def test_kerning_too_large_is_named(spark):
    rows = [(1, f"l{i}", "r0", i, 0, 5) for i in range(4)] + [(2, f"l{i}", f"r{i}", i, i, 1) for i in range(200)]
    k = spark.createDataFrame(rows, "font_id int, left_ch string, right_ch string, left_ord int, right_ord int, value int")
    assert {r.font_id: (r.left_classes, r.right_classes, r.matrix_bytes, r.fits) for r in Y.kern_tables(k).collect()} == {
        1: (5, 2, 20, True), 2: (201, 201, 80802, False)}
    assert {r.font_id for r in Y.kern_classes(k).collect()} == {1}


def test_a_kept_index_serves_many_batches(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id string, kind string, title string, body string")
    index = D.write_index(docs, str(tmp_path / "index"))
    for texts in (["pen", "install windows"], ["even light", "o", "***", None]):
        q = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
        kept = sorted(map(tuple, D.match(q, None, index).collect()))
        assert kept == sorted(map(tuple, D.match(q, docs).collect())) and kept
    words = [r.word for r in index.collect()]
    assert len(words) == D.postings(docs).count()
    assert D.match(q, docs.limit(0)).count() == 0
