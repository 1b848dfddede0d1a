"""Views of the corpus tables as page images, glyphs, outlines, hits and documents.

Every adapter is a projection, at most joined with a fixed dimension, so its cost is one pass
over the columns it names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import dims
from quillwork.functions.shuffle import spread
from quillwork.operators.outline import _cuts
from quillwork.sources.tables import table

GLYPHS_PER_FONT = 112
TEXT_BYTES = 1 << 20  # bytes of text cut into words at a time
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# what of a page is not its text
MARKUP = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>"


def scan_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """One 8x8 image per embedding: scan_id, w, h, gray array in raster order."""
    e = table(spark, sf, "embeddings").selectExpr(
        "vec_id AS scan_id", "transform(embedding, v -> cast(v AS double)) AS e")
    e = e.selectExpr("scan_id", "e", "array_min(e) AS lo", "array_max(e) AS hi")
    return e.selectExpr(
        "scan_id", "8 AS w", "8 AS h",
        "transform(e, v -> CASE WHEN hi > lo THEN cast(floor(255 * (v - lo) / (hi - lo)) AS int)"
        " ELSE 0 END) AS gray")


def scan_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """pixels(scan_id, y, x, gray, w, h) of the 8x8 images."""
    return explode_pixels(scan_arrays(spark, sf))


def explode_pixels(scans: DataFrame) -> DataFrame:
    keep = [c for c in scans.columns if c != "gray"]
    return scans.select(*keep, F.posexplode("gray").alias("p", "gray")).selectExpr(
        *keep, "cast(p div w AS int) AS y", "cast(p % w AS int) AS x", "gray")


def scan_rgb(spark: SparkSession, sf: str) -> DataFrame:
    """Colour images: the three channels are the raster shifted by 0, 1 and 2 cells."""
    g = scan_arrays(spark, sf)
    return g.selectExpr(
        "scan_id", "w", "h", "gray AS r",
        "concat(slice(gray, 2, 63), slice(gray, 1, 1)) AS g",
        "concat(slice(gray, 3, 62), slice(gray, 1, 2)) AS b")


def sheet_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Sheet pages made of the 8x8 images, set in writing order on white paper.

    112 images fill the sheets of one font. Cells are 12 px apart with a 6 px margin, so a page
    is 12 n + 6 px wide and 20 px high.
    Returns placed(scan_id, font_id, sheet_no, w, h, x0, y0, gray array).
    """
    n = GLYPHS_PER_FONT
    g = scan_arrays(spark, sf).selectExpr(
        "scan_id AS vec_id", f"scan_id div {n} AS font_id", f"cast(scan_id % {n} AS int) AS k", "gray")
    s = dims.sheets(spark, ligatures=False)
    w = "cast(12 * (max(col) OVER (PARTITION BY font_id, sheet_no) + 1) + 6 AS int) AS w"
    return g.join(s, "k").selectExpr(
        f"font_id * {len(dims.SHEETS)} + sheet_no AS scan_id", "font_id", "sheet_no", "sheet_id",
        w, "20 AS h", "6 + col * 12 AS x0", "6 AS y0", "col", "ch", "gray")


def page_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Every pixel of the sheet pages, white paper included, without a join per pixel.

    Each placed image paints its own 12 px column strip over the full height; the first one also
    paints the left margin.
    """
    p = sheet_pages(spark, sf)
    strips = p.selectExpr(
        "scan_id", "w", "h", "gray", "x0", "y0",
        "explode(sequence(IF(col = 0, 0, x0), x0 + 11)) AS x")
    cells = strips.selectExpr("scan_id", "w", "h", "gray", "x0", "y0", "x",
                              "explode(sequence(0, h - 1)) AS y")
    return cells.selectExpr(
        "scan_id", "w", "h", "y", "x",
        "CASE WHEN x >= x0 AND x < x0 + 8 AND y >= y0 AND y < y0 + 8"
        " THEN gray[(y - y0) * 8 + x - x0] ELSE 255 END AS gray")


def sheet_images(spark: SparkSession, sf: str) -> DataFrame:
    """The sheet pages as decoded images, scans(scan_id, w, h, n, data): what the image source gives for a gray file.

    A page holds a row of at most 13 of the small images, so it is painted in one row.
    """
    p = sheet_pages(spark, sf).groupBy("scan_id", "w", "h").agg(F.collect_list(F.struct("x0", "y0", "gray")).alias("g"))

    def paint(batches):
        for batch in batches:
            data = []
            for w, h, placed in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                page = np.full((h, w), 255, np.uint8)
                for g in placed:
                    page[g["y0"] : g["y0"] + 8, g["x0"] : g["x0"] + 8] = np.reshape(g["gray"], (8, 8))
                data.append(page.tobytes())
            ones = pa.array([1] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), ones, pa.array(data, pa.binary())], names=["scan_id", "w", "h", "n", "data"])

    return p.mapInArrow(paint, "scan_id bigint, w int, h int, n int, data binary")


def page_ink(spark: SparkSession, sf: str) -> DataFrame:
    """ink(scan_id, w, h, y, x) of the sheet pages: gray below 128."""
    p = sheet_pages(spark, sf).select(
        "scan_id", "w", "h", "x0", "y0", F.posexplode("gray").alias("p", "v")).where("v < 128")
    return p.selectExpr("scan_id", "w", "h", "cast(y0 + p div 8 AS int) AS y",
                        "cast(x0 + p % 8 AS int) AS x")


def text_runs(spark: SparkSession, sf: str) -> DataFrame:
    """runs(scan_id, w, h, y, x0, x1): words of each document line as ink runs.

    Lines are cut inside the row that holds the text, so no shuffle is needed.
    """
    return runs_of(table(spark, sf, "documents").selectExpr("doc_id AS scan_id", "text"))


def runs_of(texts: DataFrame) -> DataFrame:
    """The same of texts(scan_id, text): places are counted in characters, found for ``TEXT_BYTES`` of texts (or one text) at once."""

    def go(batches):
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy()
            for lo, hi in _cuts(sizes, TEXT_BYTES):
                docs = [t or b"" for t in text.slice(lo, hi - lo).to_pylist()]
                of, *cols = _word_runs(docs)
                if len(of):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + lo)), *(pa.array(c, pa.int32()) for c in cols)],
                                                     names=["scan_id", "w", "h", "y", "x0", "x1"])

    return texts.mapInArrow(go, f"scan_id {texts.schema['scan_id'].dataType.simpleString()}, w int, h int, y int, x0 int, x1 int")


def _word_runs(docs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(document, w, h, y, x0, x1) of every word of UTF-8 texts. Joined by line feeds, their lines are each other's neighbours."""
    raw = np.frombuffer(b"\n".join(docs), np.uint8)
    chars = np.zeros(len(raw) + 1, np.int32)  # characters before each byte
    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
    feeds = np.flatnonzero(raw == 10)
    begin, end = np.concatenate(([0], feeds + 1)), np.append(feeds, len(raw))  # of lines
    first = np.searchsorted(begin, np.cumsum([0, *(len(d) + 1 for d in docs[:-1])]))  # a document's first line
    h = np.diff(np.append(first, len(begin)))
    w = np.maximum.reduceat(chars[end] - chars[begin], first)
    edge = np.diff(np.concatenate(([0], (~BLANK[raw]).view(np.int8), [0])))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.searchsorted(begin, start, side="right") - 1
    of = np.repeat(np.arange(len(docs)), h)[line]
    return of, w[of], h[of], line - first[of], chars[start] - chars[begin[line]], chars[stop] - chars[begin[line]]


def glyph_observations(spark: SparkSession, sf: str) -> DataFrame:
    """glyphs(font_id, sheet_no, rw, o, ch, zone, y0, y1, w, guides) from order lines.

    ``o`` orders the glyphs of a row. Some rows state their guide lines.
    """
    li = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS rw", "l_orderkey div 30 AS font_id", "cast(l_orderkey % 14 AS int) AS sheet_no",
        "cast(l_partkey % 112 AS int) AS ord", "cast(l_quantity AS int) AS q", "l_partkey",
        "named_struct('line', l_linenumber, 'part', l_partkey, 'supp', l_suppkey, 'q', l_quantity,"
        " 'p', l_extendedprice) AS o",
        "l_returnflag = 'R' AND l_linenumber = 1 AND l_orderkey % 10 = 0 AS stated")
    cs = dims.required(spark).select("ord", "ch", "zone", "grp")
    g = li.join(cs, "ord").selectExpr(
        "*", "300 + cast(rw % 7 AS int) AS base", "q % 5 - 2 AS j")
    g = g.selectExpr(
        "*",
        "CASE zone WHEN 'x' THEN base - 100 WHEN 'desc' THEN base - 100 WHEN 'asc' THEN base - 181"
        " WHEN 'full' THEN base - 181 WHEN 'base' THEN base - 20 WHEN 'mid' THEN base - 60"
        " ELSE base - 181 END + j - IF(q = 50, 120, 0) AS y0",
        "CASE zone WHEN 'x' THEN base WHEN 'asc' THEN base WHEN 'desc' THEN base + 59"
        " WHEN 'full' THEN base + 59 WHEN 'base' THEN base WHEN 'mid' THEN base - 40"
        " ELSE base - 150 END + j AS y1")
    return g.selectExpr(
        "font_id", "sheet_no", "rw", "o", "ord", "ch", "zone", "grp", "y0", "y1",
        "20 + cast(l_partkey % 40 AS int) AS w",
        "IF(stated, named_struct('baseline', cast(base AS double), 'x_height', 100D,"
        " 'asc_height', 180D, 'desc_depth', 60D), NULL) AS guides")


def glyph_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """shapes(glyph_id, font_id, ord, ch, zone, width, shape, y0, y1): one per part.

    112 parts make one font; shape is flat, round, up or down.
    """
    p = table(spark, sf, "part").selectExpr(
        "p_partkey AS glyph_id", f"p_partkey div {GLYPHS_PER_FONT} AS font_id",
        f"cast(p_partkey % {GLYPHS_PER_FONT} AS int) AS ord",
        "cast(200 + p_size * 8 AS double) AS width",
        "element_at(array('flat', 'round', 'up', 'down'), cast(p_partkey % 4 AS int) + 1) AS shape")
    cs = dims.required(spark).select("ord", "ch", "name", "zone", "grp")
    return p.join(cs, "ord").selectExpr(
        "*",
        "CASE zone WHEN 'desc' THEN -200D WHEN 'full' THEN -200D WHEN 'mid' THEN 150D"
        " WHEN 'high' THEN 500D ELSE 0D END AS y0",
        "CASE zone WHEN 'x' THEN 500D WHEN 'desc' THEN 500D WHEN 'base' THEN 100D"
        " WHEN 'mid' THEN 350D ELSE 700D END AS y1")


def shape_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """profiles(glyph_id, font_id, ord, ch, ..., i, y, left, right): 41 scanlines per shape, handed out by font before they are drawn."""
    s = spread(glyph_shapes(spark, sf), "font_id").selectExpr("*", "explode(sequence(0, 40)) AS i")
    s = s.selectExpr("*", "y1 - i * (y1 - y0) / 40 AS y", "i / 40D AS t")
    s = s.selectExpr(
        "*",
        "CASE shape WHEN 'flat' THEN 0D WHEN 'up' THEN width / 2 * (1 - t)"
        " WHEN 'down' THEN width / 2 * t"
        " ELSE width / 2 * (1 - sqrt(greatest(0D, 1 - (2 * t - 1) * (2 * t - 1)))) END AS left")
    return s.selectExpr("*", "width - left AS right").drop("t")


def font_paths(spark: SparkSession, sf: str) -> DataFrame:
    """paths(glyph_id, font_id, ord, ch, name, kind, unicode, upm, advance, cmds): fonts as outline commands.

    260 parts make one font: the required characters and the joined pairs, each written up to
    twice. Design units are those of a 2000-unit em, drawn a quarter larger from font to font.
    """
    p = table(spark, sf, "part").selectExpr(
        "p_partkey AS glyph_id", "p_partkey div 260 AS font_id", "cast(p_partkey % 130 AS int) AS k",
        "cast(200 + p_size * 8 AS double) AS width", "cast(p_partkey % 4 AS int) AS shape",
        "1 + (p_partkey div 260) % 3 * 0.25D AS f").selectExpr("*", "IF(k < 112, k, k + 8) AS ord")
    cs = dims.charset(spark).select("ord", "ch", "name", "zone", "kind", "unicode")
    s = p.join(cs, "ord").selectExpr(
        "*", "60 * f AS a", "(60 + 2 * width) * f AS b",
        "2 * f * CASE WHEN zone IN ('desc', 'full') THEN -200D WHEN zone = 'mid' THEN 150D WHEN zone = 'high' THEN 500D ELSE 0D END AS c",
        "2 * f * CASE WHEN zone IN ('x', 'desc') THEN 500D WHEN zone = 'base' THEN 100D WHEN zone = 'mid' THEN 350D ELSE 700D END AS d")

    def cmd(t, *xy):
        vals = [*xy, *["CAST(NULL AS DOUBLE)"] * (4 - len(xy))]
        return f"named_struct('type', '{t}', " + ", ".join(f"'{n}', {v}" for n, v in zip(("x", "y", "x1", "y1"), vals)) + ")"

    mid, vmid = "(a + b) / 2", "(c + d) / 2"
    flat = [cmd("M", "a", "c"), cmd("L", "a", "d"), cmd("L", "b", "d"), cmd("L", "b", "c"), cmd("Z")]
    rnd = [cmd("M", "a", vmid), cmd("Q", mid, "d", "a", "d"), cmd("Q", "b", vmid, "b", "d"),
           cmd("Q", mid, "c", "b", "c"), cmd("Q", "a", vmid, "a", "c"), cmd("Z")]
    up = [cmd("M", "a", "c"), cmd("L", mid, "d"), cmd("L", "b", "c"), cmd("L", "a", "c"), cmd("Z")]
    down = [cmd("M", "a", "d"), cmd("L", "b", "d"), cmd("L", mid, "c")]
    arr = ", ".join("array(" + ", ".join(x) + ")" for x in (flat, rnd, up, down))
    return s.selectExpr("glyph_id", "font_id", "ord", "ch", "name", "kind", "unicode", "2000 AS upm",
                        "(2 * width + 150) * f AS advance", f"element_at(array({arr}), shape + 1) AS cmds")


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """hits(key, ts_ms, hit_id): one request per event."""
    return table(spark, sf, "events").selectExpr(
        "user_id AS key", "unix_micros(cast(ts AS timestamp)) div 1000 AS ts_ms", "event_id AS hit_id")


def search_docs(spark: SparkSession, sf: str) -> DataFrame:
    """docs(doc_id string, kind, title, body): guides by their first line, questions, and pages without markup."""
    d = table(spark, sf, "documents").selectExpr(
        "concat('d', doc_id) AS doc_id", "'lesson' AS kind", "split(text, '\n')[0] AS title", "text AS body")
    c = table(spark, sf, "conversations").selectExpr(
        "concat('c', conv_id, '-', turn) AS doc_id", "'faq' AS kind", "role AS title", "text AS body")
    p = table(spark, sf, "pages").selectExpr(
        "concat('p', page_id) AS doc_id", "'install' AS kind",
        "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title", f"regexp_replace(html, r'{MARKUP}', ' ') AS body")
    return d.unionByName(c).unionByName(p)
