"""Queries over sheet pages: bands, groups, cells."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillwork.functions.num import r6
from quillwork.operators import raster as R
from quillwork.operators import segment as G
from quillwork.plans import ctes as C
from quillwork.plans.raster import LABELS, page_labels
from quillwork.plans.registry import query
from quillwork.session import cut_lineage
from quillwork.sources import adapters as A

BASE = C.PAGE_INK + "," + LABELS
BANDS = BASE + """,
pgs AS (SELECT DISTINCT scan_id, h FROM ink),
prof AS (SELECT p.scan_id, p.h, y, coalesce(n, 0) AS n, greatest(3, floor(p.h / 200.0 + 0.5)::INT | 1) // 2 AS r FROM (SELECT *, unnest(range(h)) AS y FROM pgs) p
  LEFT JOIN (SELECT scan_id, y, count(*) AS n FROM ink GROUP BY ALL) i USING (scan_id, y)),
smo AS (SELECT a.scan_id, a.h, a.y, avg(b.n) AS v FROM prof a JOIN prof b ON a.scan_id = b.scan_id AND abs(a.y - b.y) <= a.r GROUP BY ALL),
on_ AS (SELECT *, y - row_number() OVER (PARTITION BY scan_id ORDER BY y) AS k FROM (SELECT *, max(v) OVER (PARTITION BY scan_id) AS peak FROM smo)
  WHERE v > greatest(0.5, peak * 0.04::DOUBLE)),
bands AS (SELECT scan_id, h, row_number() OVER (PARTITION BY scan_id ORDER BY y0) - 1 AS band, y0, y1 FROM
  (SELECT scan_id, h, min(y) AS y0, max(y) + 1 AS y1 FROM on_ GROUP BY scan_id, h, k) WHERE y1 - y0 >= greatest(4, h * 0.012::DOUBLE))"""


def pages(spark, sf):
    """The sheet each page is handed in as: its own, but for every fifth page the next one."""
    return A.sheet_pages(spark, sf).selectExpr(
        "scan_id", "cast((sheet_no + IF(scan_id % 5 = 0, 1, 0)) % 14 AS int) AS sheet_no").distinct()


PAGES_SQL = "pages AS (SELECT DISTINCT scan_id, (sheet_no + CASE WHEN scan_id % 5 = 0 THEN 1 ELSE 0 END) % 14 AS sheet_no FROM placed)"


def marks(spark, sf):
    return R.components(page_labels(spark, sf))


@query("find_lines", f"WITH RECURSIVE {BANDS} SELECT scan_id, h, band, y0, y1 FROM bands")
def find_lines(spark, sf):
    return G.find_lines(page_labels(spark, sf))


@query("text_lines", """WITH l AS (SELECT doc_id AS scan_id, string_split(text, chr(10)) AS ls FROM documents),
pgs AS (SELECT scan_id, len(ls) AS h, unnest(range(len(ls))) AS y, unnest(list_transform(ls, lambda s: length(regexp_replace(s, '[ \\t\\r\\v\\f]', '', 'g')))) AS n FROM l),
prof AS (SELECT * FROM pgs WHERE scan_id IN (SELECT scan_id FROM pgs WHERE n > 0)),
smo AS (SELECT a.scan_id, a.h, a.y, avg(b.n) AS v FROM prof a JOIN prof b ON a.scan_id = b.scan_id AND abs(a.y - b.y) <= greatest(3, floor(a.h / 200.0 + 0.5)::INT | 1) // 2 GROUP BY ALL),
on_ AS (SELECT *, y - row_number() OVER (PARTITION BY scan_id ORDER BY y) AS k FROM (SELECT *, max(v) OVER (PARTITION BY scan_id) AS peak FROM smo)
  WHERE v > greatest(0.5, peak * 0.04::DOUBLE))
SELECT scan_id, h, row_number() OVER (PARTITION BY scan_id ORDER BY y0) - 1 AS band, y0, y1 FROM
  (SELECT scan_id, h, min(y) AS y0, max(y) + 1 AS y1 FROM on_ GROUP BY scan_id, h, k) WHERE y1 - y0 >= greatest(4, h * 0.012::DOUBLE)""")
def text_lines(spark, sf):
    """G1 over text pages: blocks of lines."""
    return G.find_lines(A.text_runs(spark, sf))


@query("box_overlap", f"""WITH RECURSIVE {BASE},
n AS (SELECT *, lead(row(x0, y0, x1, y1)) OVER (PARTITION BY scan_id ORDER BY x0, comp_id) AS b FROM comp)
SELECT scan_id, comp_id, round(greatest(0, least(x1, b[3]) - greatest(x0, b[1])) / least(x1 - x0, b[3] - b[1])::DOUBLE, 6) AS hx,
  round(greatest(0, least(y1, b[4]) - greatest(y0, b[2])) / least(y1 - y0, b[4] - b[2])::DOUBLE, 6) AS vy FROM n WHERE b IS NOT NULL""")
def box_overlap(spark, sf):
    """G2 between each mark and the next to its right."""
    box = F.struct("x0", "y0", "x1", "y1")
    nxt = F.lead(box).over(W.partitionBy("scan_id").orderBy("x0", "comp_id"))
    c = marks(spark, sf).select("scan_id", "comp_id", box.alias("a"), nxt.alias("b")).where("b IS NOT NULL")
    hx, vy = G.box_overlap("a", "b")
    return c.select("scan_id", "comp_id", r6(hx).alias("hx"), r6(vy).alias("vy"))


ST = "{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'area': area, 'n': 1}"
UNION = ("{'x0': least(a.x0, b.x0), 'y0': least(a.y0, b.y0), 'x1': greatest(a.x1, b.x1), 'y1': greatest(a.y1, b.y1),"
         " 'area': a.area + b.area, 'n': a.n + b.n}")
MERGE = BASE + f""",
mg AS (SELECT scan_id, 0 AS step, list({ST} ORDER BY comp_id) AS items FROM comp GROUP BY scan_id
  UNION ALL
  SELECT scan_id, step + 1, items[:i - 1] || [{UNION}] || items[i + 1:j - 1] || items[j + 1:]
  FROM (SELECT scan_id, step, items, p.i AS i, p.j AS j, items[p.i] AS a, items[p.j] AS b FROM (
    SELECT scan_id, step, any_value(items) AS items, min({{'i': i, 'j': j}}) AS p FROM (
      SELECT scan_id, step, items, i, j, items[i] AS a, items[j] AS b FROM (SELECT *, unnest(range(i + 1, len(items) + 1)) AS j FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM mg)))
    WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) >= 0.45::DOUBLE * least(a.x1 - a.x0, b.x1 - b.x0)
      AND greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) <= 0.35::DOUBLE * least(a.y1 - a.y0, b.y1 - b.y0)
    GROUP BY scan_id, step))),
merged AS (SELECT scan_id, arg_max(items, step) AS items FROM mg GROUP BY scan_id)"""


def _page_rows(spark, sf):
    """All marks of a page as one row of writing."""
    box = F.struct("comp_id", "x0", "y0", "x1", "y1", "area")
    return marks(spark, sf).groupBy("scan_id").agg(F.sort_array(F.collect_list(box)).alias("comps"))


@query("merge_stacked", f"""WITH RECURSIVE {MERGE}
SELECT scan_id, g.x0, g.y0, g.x1, g.y1, g.area, g.n::BIGINT AS n FROM (SELECT scan_id, unnest(items) AS g FROM merged)""")
def merge_stacked(spark, sf):
    def one(row):
        return [(row.scan_id, g["x0"], g["y0"], g["x1"], g["y1"], g["area"], len(g["parts"]))
                for g in G.merge_stacked(G._boxes(row.comps))]

    return G._each(_page_rows(spark, sf), one, "scan_id bigint, x0 int, y0 int, x1 int, y1 int, area bigint, n bigint")


FUSE = MERGE + f""",
fu AS (SELECT scan_id, 0 AS step, list_sort(items) AS items FROM merged
  UNION ALL
  SELECT scan_id, step + 1, items[:i - 1] || [{UNION}] || items[i + 2:]
  FROM (SELECT scan_id, step, items, p.i AS i, items[p.i] AS a, items[p.i + 1] AS b FROM (
    SELECT scan_id, step, any_value(items) AS items, min({{'g': items[i + 1].x0 - items[i].x1, 'i': i}}) AS p
    FROM (SELECT *, unnest(range(1, len(items))) AS i FROM fu WHERE len(items) > 5) GROUP BY scan_id, step)))"""


@query("fuse_closest", f"""WITH RECURSIVE {FUSE}
SELECT scan_id, g.x0, g.y0, g.x1, g.y1, g.area, g.n::BIGINT AS n FROM (SELECT scan_id, unnest(arg_max(items, step)) AS g FROM fu GROUP BY scan_id)""")
def fuse_closest(spark, sf):
    """G4 brought down to five groups a page."""
    def one(row):
        m = sorted(G.merge_stacked(G._boxes(row.comps)), key=lambda g: (g["x0"], g["y0"], g["x1"], g["y1"]))
        return [(row.scan_id, g["x0"], g["y0"], g["x1"], g["y1"], g["area"], len(g["parts"])) for g in G.fuse_closest(m, 5)]

    return G._each(_page_rows(spark, sf), one, "scan_id bigint, x0 int, y0 int, x1 int, y1 int, area bigint, n bigint")


@query("drop_strays", f"""WITH RECURSIVE {MERGE},
g AS (SELECT scan_id, unnest(items) AS g, len(items) AS n FROM merged), m AS (SELECT scan_id, median(g.area) AS mid FROM g GROUP BY scan_id),
k AS (SELECT g.*, g.g.area >= mid * 0.25::DOUBLE AS big, count(*) FILTER (WHERE g.g.area >= mid * 0.25::DOUBLE) OVER (PARTITION BY g.scan_id) AS kept FROM g JOIN m USING (scan_id))
SELECT scan_id, g.x0, g.y0, g.x1, g.y1, g.area FROM k WHERE n < 4 OR kept < ceil(n / 2.0) OR big""")
def drop_strays(spark, sf):
    def one(row):
        return [(row.scan_id, g["x0"], g["y0"], g["x1"], g["y1"], g["area"])
                for g in G.drop_strays(G.merge_stacked(G._boxes(row.comps)), False)]

    return G._each(_page_rows(spark, sf), one, "scan_id bigint, x0 int, y0 int, x1 int, y1 int, area bigint")


@query("waist_cut", f"""WITH RECURSIVE {BASE},
c AS (SELECT lab.scan_id, comp_id, comp.x0 AS bx0, comp.x1 - comp.x0 AS width, unnest(range(lab.x0, lab.x1)) AS x FROM lab JOIN comp USING (scan_id, ly, lx) WHERE comp.x1 - comp.x0 >= 8),
n AS (SELECT scan_id, comp_id, bx0, width, x, count(*) AS ink FROM c GROUP BY ALL),
d AS (SELECT s.*, coalesce(ink, 0) AS ink FROM (SELECT *, unnest(range(bx0, bx0 + width)) AS x FROM (SELECT DISTINCT scan_id, comp_id, bx0, width FROM n)) s
  LEFT JOIN (SELECT scan_id, comp_id, x, ink FROM n) n USING (scan_id, comp_id, x))
SELECT scan_id, comp_id, arg_min(x, row(ink, x)) AS cut, min(ink) AS ink FROM d
WHERE x - bx0 >= floor(width * 0.2::DOUBLE) AND x - bx0 < ceil(width * 0.8::DOUBLE) GROUP BY ALL""")
def waist_cut(spark, sf):
    lab = page_labels(spark, sf)
    c = R.components(lab).select("scan_id", "ly", "lx", "comp_id", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    return G.waist_cut(lab.join(c, ["scan_id", "ly", "lx"]))


@query("component_cap", f"""WITH {C.CHARSET}, {C.SHEETS},
prt AS (SELECT s.sheet_no, sum(c.parts) AS parts FROM sheets s JOIN charset c ON c.ch = s.ch GROUP BY 1),
wd AS (SELECT doc_id AS scan_id, len(regexp_extract_all(text, '[^ \\t\\r\\n\\v\\f]+')) AS found, doc_id % 14 AS sheet_no FROM documents)
SELECT scan_id, 'fatal' AS level, CASE WHEN found = 0 THEN 'no-ink' ELSE 'too-many-marks' END AS code, parts::BIGINT AS expected, found
FROM wd JOIN prt USING (sheet_no) WHERE found = 0 OR found > parts * 12""")
def component_cap(spark, sf):
    """G7 over text pages handed in as sheets, each word a mark."""
    p = A.table(spark, sf, "documents").selectExpr("doc_id AS scan_id", "cast(doc_id % 14 AS int) AS sheet_no")
    return G.component_cap(A.text_runs(spark, sf), p)


BAND_LINES = """counted AS (SELECT l_orderkey AS scan_id, y0, y0 + height AS y1, n FROM (
  SELECT *, sum(height + gap) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, n
    ROWS UNBOUNDED PRECEDING) - height - gap AS y0 FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (20 + l_partkey % 21)::INT AS height, (l_suppkey % 3 * 7 + 2)::INT AS gap, (l_quantity::INT % 15)::INT AS n FROM lineitem)))"""


def band_lines(spark, sf):
    """Bands of writing from order lines: an order is a page, a line a band whose height, gap below and marks come from its part,
    supplier and quantity. Pages hold few bands and many, close and far, sparse and full."""
    line = A.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS scan_id", "l_linenumber", "l_partkey", "l_suppkey", "cast(20 + l_partkey % 21 AS int) AS height",
        "cast(l_suppkey % 3 * 7 + 2 AS int) AS gap", "cast(cast(round(l_quantity) AS int) % 15 AS int) AS n")
    above = F.sum(F.col("height") + F.col("gap")).over(W.partitionBy("scan_id").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "n").rowsBetween(W.unboundedPreceding, 0)) - F.col("height") - F.col("gap")
    return line.withColumn("y0", above.cast("int")).selectExpr("scan_id", "y0", "y0 + height AS y1", "n")


@query("reconcile_bands", f"""WITH RECURSIVE {C.SHEETS}, {BAND_LINES},
want AS (SELECT sheet_no, count(*) AS want, min(n) AS sparsest FROM (SELECT sheet_no, rw, count(*) AS n FROM sheets GROUP BY ALL) GROUP BY 1),
page AS (SELECT scan_id, list(struct_pack(y0 := y0, y1 := y1, n := n) ORDER BY y0) AS b FROM counted GROUP BY 1),
rec AS (
  SELECT scan_id, want, sparsest, b, 0 AS fused FROM page JOIN want ON sheet_no = scan_id % 15
  UNION ALL
  SELECT scan_id, want, sparsest, list_concat(list_concat(b[:g.i - 1], [struct_pack(y0 := b[g.i].y0, y1 := b[g.i + 1].y1, n := b[g.i].n + b[g.i + 1].n)]), b[g.i + 2:]), fused + 1
  FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(b)), lambda i: b[i].n < sparsest - 1 OR b[i + 1].n < sparsest - 1),
      lambda i: struct_pack(gap := b[i + 1].y0 - b[i].y1, i := i))) AS g FROM rec WHERE len(b) > want)
  WHERE g.gap <= list_median(list_transform(b, lambda x: x.y1 - x.y0)) * 0.45::DOUBLE),
met AS (SELECT scan_id, any_value(want) AS want, arg_max(b, fused) AS b, max(fused) AS fused FROM rec GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY v.n DESC, v.y0) AS place FROM (SELECT scan_id, want, fused, len(b) AS bands, unnest(b) AS v FROM met))
SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY v.y0) - 1 AS rw, v.y0, v.y1, v.n, fused, greatest(0, bands - want) AS dropped
FROM r WHERE place <= want""")
def reconcile_bands(spark, sf):
    pages = A.table(spark, sf, "lineitem").selectExpr("l_orderkey AS scan_id", "cast(l_orderkey % 15 AS int) AS sheet_no").distinct()
    return G.reconcile_bands(band_lines(spark, sf), pages)


@query("assign_band", f"""WITH RECURSIVE {BANDS},
m AS (SELECT scan_id, median(y1 - y0) * 0.6::DOUBLE AS reach FROM bands GROUP BY 1),
j AS (SELECT c.scan_id, comp_id, band, CASE WHEN cy >= b.y0 AND cy < b.y1 THEN -1 WHEN cy < b.y0 THEN b.y0 - cy ELSE cy - b.y1 END AS d
  FROM comp c JOIN bands b USING (scan_id))
SELECT scan_id, comp_id, arg_min(band, row(d, band)) AS rw FROM j JOIN m USING (scan_id) WHERE d <= reach GROUP BY ALL""")
def assign_band(spark, sf):
    b = G.find_lines(page_labels(spark, sf)).withColumnRenamed("band", "rw")
    return G.assign_band(b, marks(spark, sf)).select("scan_id", "comp_id", "rw")


def _segmented(spark, sf):
    lab = cut_lineage(page_labels(spark, sf))
    comps = cut_lineage(R.components(lab))
    bands, groups, _, refused = G.segment(lab, comps, pages(spark, sf))
    bands, groups = cut_lineage(bands), cut_lineage(groups)
    return lab, comps, bands, groups, G.sheet_cells(groups, G.accepted(pages(spark, sf), refused)), refused


@query("split_waist")
def split_waist(spark, sf):
    """G6 in full: the groups of every row, with how many cuts, strays and parts went into them."""
    return _segmented(spark, sf)[3]


@query("sheet_cells")
def sheet_cells(spark, sf):
    return _segmented(spark, sf)[4].selectExpr(
        "scan_id", "sheet_no", "rw", "col", "ch", "x0", "y0", "x1", "y1", "missing", "coalesce(size(part_ids), 0) AS n_parts")


@query("sheet_issues")
def sheet_issues(spark, sf):
    _, _, bands, groups, _, refused = _segmented(spark, sf)
    told = G.issues(bands, groups, G.accepted(pages(spark, sf), refused))
    r = refused.selectExpr("scan_id", "level", "code", "cast(NULL AS int) AS rw", "cast(expected AS int) AS expected", "cast(found AS int) AS found")
    return told.unionByName(r)


@query("extract_glyphs")
def extract_glyphs(spark, sf):
    lab, comps, _, _, cells, _ = _segmented(spark, sf)
    return G.extract_glyphs(cells, G.with_ids(lab, comps)).drop("bx0", "by0", "bx1", "by1")


OBSERVED = """o AS (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY k) - 1 AS rw, n FROM
  (SELECT l_orderkey // 3 AS scan_id, l_orderkey % 3 AS k, count(*) AS n FROM lineitem GROUP BY ALL)),
lens AS (SELECT sheet_no, rw, count(*) AS want FROM sheets GROUP BY ALL), tot AS (SELECT sheet_no, count(*) AS n_rows FROM lens GROUP BY 1),
seen AS (SELECT scan_id, count(*) AS n_rows FROM o GROUP BY 1),
score AS (SELECT seen.scan_id, lens.sheet_no, avg((abs(o.n - want) <= 1)::INT) AS score FROM seen JOIN tot USING (n_rows) JOIN lens ON lens.sheet_no = tot.sheet_no
  JOIN o ON o.scan_id = seen.scan_id AND o.rw = lens.rw GROUP BY ALL HAVING score > 0)"""


def observed(spark, sf):
    """Characters seen per row: the lines of three consecutive orders make the rows of a page."""
    n = A.table(spark, sf, "lineitem").groupBy(F.expr("l_orderkey div 3").alias("scan_id"), F.expr("l_orderkey % 3").alias("k")).agg(F.count("*").alias("n"))
    rw = F.row_number().over(W.partitionBy("scan_id").orderBy("k")) - 1
    return n.select("scan_id", rw.alias("rw"), "n")


@query("identify_sheet", f"""WITH {C.SHEETS}, {OBSERVED}
SELECT scan_id, arg_max(sheet_no, row(score, -sheet_no)) AS sheet_no, round(max(score), 6) AS score FROM score GROUP BY scan_id""")
def identify_sheet(spark, sf):
    return G.identify_sheet(observed(spark, sf)).select("scan_id", "sheet_no", r6(F.col("score")).alias("score"))


@query("wrong_sheet", f"""WITH {C.SHEETS}, {OBSERVED},
a AS (SELECT s.*, scan_id % 15 AS asked FROM score s),
b AS (SELECT scan_id, asked, coalesce(max(score) FILTER (WHERE sheet_no = asked), 0) AS own, max(score) FILTER (WHERE sheet_no <> asked) AS score,
  arg_max(sheet_no, row(score, -sheet_no)) FILTER (WHERE sheet_no <> asked) AS suggest FROM a GROUP BY ALL)
SELECT scan_id, asked, suggest, round(score, 6) AS score FROM b WHERE own < 0.75 AND score >= 0.75""")
def wrong_sheet(spark, sf):
    o = observed(spark, sf)
    asked = o.select("scan_id").distinct().selectExpr("scan_id", "cast(scan_id % 15 AS int) AS sheet_no")
    return G.wrong_sheet(o, asked).select("scan_id", "asked", "suggest", r6(F.col("score")).alias("score"))
