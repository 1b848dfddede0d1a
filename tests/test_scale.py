"""Steps that must not grow with their input: what a task holds, what the driver gathers, what is shuffled."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillwork.operators import corpus as X
from quillwork.operators import family as Y
from quillwork.operators import imports as I
from quillwork.operators import metrics as M
from quillwork.operators import outline as T
from quillwork.operators import search as D
from quillwork.plans import family as PF
from quillwork.plans import outline as PO
from quillwork.plans import segment as PS
from quillwork.sources import adapters as A
from quillwork.stages import Stages


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stage_is_not_broadcast_for_the_size_of_its_files(spark):
    st = Stages(spark, "test-sizes")
    rows = spark.range(300_000).selectExpr("id", "id div 100000 AS same", "0 AS y")
    small = st.put("runs", lambda: rows)
    seen = []

    def joined():
        out = small.join(small.select("id", F.col("same").alias("other")), "id")
        seen.append(plan(out))
        return out

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert st.put("joined", joined).count() == 300_000
    assert "SortMergeJoin" in seen[0] and "BroadcastHashJoin" not in seen[0]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    st.finish()


def test_search_looks_only_where_the_rarest_term_is(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), "faq", "common", f"common words here {'zebra' if i % 50 == 0 else ''}") for i in range(200)] +
                                 [("t", "lesson", "zebras", "uncommon wordy text")], "doc_id string, kind string, title string, body string")
    queries = spark.createDataFrame([(1, "zebra common"), (2, "zeb word"), (3, "absent zebra"), (4, "common")], "query_id bigint, query string")
    pairs = []
    put = Stages.put

    def watched(self, name, make):
        out = put(self, name, make)
        if name == "pairs":
            pairs.append(out)
        return out

    monkeypatch.setattr(Stages, "put", watched)
    got = {(r.query_id, r.doc_id): (r.title_hits, r.body_hits) for r in D.match(queries, docs).collect()}
    want = {(1, str(i)): (1, 2) for i in range(0, 200, 50)} | {(2, str(i)): (0, 2) for i in range(0, 200, 50)} | {(2, "t"): (1, 1)}
    assert got == want | {(4, str(i)): (1, 1) for i in range(200)}
    assert pairs[0].where("query_id IN (1, 2)").count() == 10 and not pairs[0].where("query_id = 3").count()
def test_contours_are_traced_in_slices_of_a_batch(spark, monkeypatch):
    assert [list(range(*c)) for c in T._cuts(np.array([3, 3, 9, 1, 1, 0]), 6)] == [[0, 1], [2], [3, 4, 5]]
    ink = spark.range(200).selectExpr("id AS glyph_id", "explode(sequence(0, 3)) AS y").selectExpr("glyph_id", "y", "explode(array(0, 1, 3)) AS x")
    edges, runs = T.crack_edges(ink), ink.selectExpr("glyph_id", "y", "x AS x0", "x + 1 AS x1")

    def found(df):
        return sorted((r.glyph_id, r.contour, tuple((p.x, p.y) for p in r.pts)) for r in df.collect())

    whole = found(T.trace_loops(edges))
    assert len(whole) == 400 and whole[0][2][:2] == ((1.0, 0.0), (2.0, 0.0))
    assert whole == found(T.traced(runs, 0.0))
    moved = found(T.trace_loops(T.crack_edges(ink.selectExpr("glyph_id", "y - 2 AS y", "x - 5 AS x"))))
    assert moved == [(g, k, tuple((x - 5, y - 2) for x, y in pts)) for g, k, pts in whole]
    monkeypatch.setattr(T._cuts, "__defaults__", (7,))
    assert whole == found(T.traced(runs, 0.0))


def test_areas_and_specks_gather_runs_and_not_edges(spark, sf):
    for q in (PO.signed_area, PO.speck_filter):
        assert "collect_set" not in plan(q(spark, sf))


def test_numbering_without_drawing(spark, sf):
    cols = ["font_id", "style", "name", "ch", "kind", "variant_of", "v", "ord", "gid"]
    drawn = Y.style_glyphs(PF.defs(spark, sf)).select(*cols)
    numbered = Y.style_index(PF.imported(spark, sf)).select(*cols)
    assert numbered.count() == drawn.count() > 0
    assert not numbered.exceptAll(drawn).count()
    assert "_tan" not in plan(PF.index(spark, sf))


def test_class_matrix_reads_its_pairs_once(spark):
    k = spark.createDataFrame([(1, "b", "x", 2, 9, 40000), (1, "a", "x", 1, 9, -5), (1, "a", "y", 1, 8, 7), (2, "a", "a", 1, 1, 3)],
                              "font_id bigint, left_ch string, right_ch string, left_ord int, right_ord int, value int")
    out = Y.kern_classes(k)
    assert plan(out).count("Scan ExistingRDD") == 1
    got = {(r.font_id, r.c1, r.c2): r.value for r in out.collect()}
    assert got == {(1, a, b): {(1, 1): 7, (1, 2): -5, (2, 2): 32767}.get((a, b), 0) for a in range(3) for b in range(3)} | {
        (2, a, b): 3 * a * b for a in range(2) for b in range(2)}


def test_pairs_of_texts_leave_a_task_in_pieces(spark):
    texts = spark.createDataFrame([(i, 1, "abcdefghijklmnopqrstuvwxyz") for i in range(2_000)], "doc_id bigint, font_id bigint, text string").coalesce(1)
    pieces = X.pair_counts(texts).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n bigint")
    assert X.pair_counts(texts).groupBy("doc_id").count().where("count = 26").count() == 2_000
    n = [r.n for r in pieces.collect()]
    assert sum(n) == 52_000 and max(n) < X.PAIRS + 26


def test_an_outline_profile_shuffles_no_points(spark, sf):
    outlines = PF.imported(spark, sf).select("glyph_id", "curves")
    by_rows = {(r.glyph_id, r.y): (r.left, r.right) for r in M.outline_profile(I.exploded(outlines)).collect()}
    by_glyph = {(r.glyph_id, r.y): (r.left, r.right) for r in M.outline_profile(outlines).collect()}
    assert by_rows == by_glyph and len(by_glyph) > 10_000
    assert plan(M.outline_profile(outlines)).count("Exchange") == plan(outlines).count("Exchange")
    p = "struct<x: double, y: double>"
    odd = spark.createDataFrame([("a", [(0, 0, (0., 0.), (0., 8.), (0., 16.), (0., 24.)), (0, 1, (0., 24.), (5., 24.), (9., 24.), (30., 24.))]),
                                 ("b", []), ("c", None), ("d", [(0, 0, None, (0., 8.), (0., 16.), (0., 24.))])],
                                f"glyph_id string, curves array<struct<contour: int, seq: int, p0: {p}, c1: {p}, c2: {p}, p3: {p}>>")
    assert [tuple(r) for r in M.outline_profile(odd).orderBy("y").collect()] == [("a", 0., 0., 0.), ("a", 8., 0., 10.), ("a", 16., 0., 20.)]


def test_words_are_found_for_many_texts_at_once(spark, sf):
    odd = [None, "", "\n", " \t\r\x0b\x0c", "a", "\n\né 😀x \u2028y\n z\n", "😀 " * 3 + "\n\xa0b\x1cc", "w" * 40 + "\n" + "x y\n" * 3]
    texts = spark.createDataFrame(list(enumerate(odd * 3)) + [(None, "lost word")], "scan_id int, text string").coalesce(1)
    want = []
    for k, t in [*enumerate(odd * 3), (None, "lost word")]:
        lines = (t or "").split("\n")
        w = max(map(len, lines))
        want += [(k, w, len(lines), y, m.start(), m.end()) for y, s in enumerate(lines) for m in re.finditer(r"[^ \t\r\x0b\x0c]+", s)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, A.runs_of(texts).collect()), key=key) == sorted(want, key=key)
    assert not A.runs_of(texts.limit(0)).count()
    assert "lambda" not in plan(PS.component_cap(spark, sf))
