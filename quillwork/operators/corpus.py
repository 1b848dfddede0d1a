"""Text corpora set in a font: coverage, widths, frequent letter pairs, outbound links."""

from __future__ import annotations

from collections import Counter
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions import dims

LETTER_PAIR = "^[a-z][a-z]$"
PAIRS = 20_000  # counted pairs a task holds before it hands them on, a text more at most


def characters(texts: DataFrame, *keys: str) -> DataFrame:
    """Count of every character by key; counting starts before the shuffle."""
    return texts.select(*keys, F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy(*keys, "ch").agg(
        F.count("*").alias("n"))


def text_coverage(counts: DataFrame, fonts: DataFrame) -> DataFrame:
    """Which characters of a text its font has; counts(font_id, ch, n), fonts(font_id, ch)."""
    have = fonts.select("font_id", "ch").distinct().withColumn("covered", F.lit(True))
    return counts.join(have, ["font_id", "ch"], "left").na.fill(False, ["covered"])


def bigrams(texts: DataFrame, *keys: str) -> DataFrame:
    """Every character with the next one (null at the end), without a shuffle."""
    c = texts.select(*keys, F.split("text", "").alias("c"))
    c = c.select(*keys, F.explode(F.arrays_zip(F.col("c").alias("ch"), F.expr("slice(c, 2, size(c))").alias("nx"))).alias("e"))
    return c.select(*keys, "e.ch", "e.nx").where("ch <> ''")


def pair_counts(texts: DataFrame) -> DataFrame:
    """Distinct pairs of a character and the next one (null at the end) of each document, counted inside its row;
    texts(doc_id, font_id, text)."""
    def rows(ids, fonts, found):
        at, ch, nx, n = zip(*found)
        at = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([ids.take(at), fonts.take(at), pa.array(ch, pa.string()), pa.array(nx, pa.string()),
                                           pa.array(n, pa.int64())], names=["doc_id", "font_id", "ch", "nx", "n"])

    def count(batches):
        for b in batches:
            ids, fonts, found = b.column("doc_id"), b.column("font_id"), []
            for i, text in enumerate(b.column("text")):
                t = text.as_py() or ""
                found += [(i, ch, nx, n) for (ch, nx), n in Counter(zip_longest(t, t[1:])).items()]
                if len(found) >= PAIRS:
                    yield rows(ids, fonts, found)
                    found = []
            if found:
                yield rows(ids, fonts, found)

    t = texts.select("doc_id", "font_id", "text")
    fields = T.StructType([t.schema["doc_id"], t.schema["font_id"], T.StructField("ch", T.StringType()), T.StructField("nx", T.StringType()),
                           T.StructField("n", T.LongType())])
    return t.mapInArrow(count, fields)


def text_width(texts: DataFrame, advances: DataFrame, kerns: DataFrame) -> DataFrame:
    """Width of each document with and without kerning; texts(doc_id, font_id, text).

    Pairs are counted inside a document's row, so nothing is shuffled before the joins and both see one row per
    distinct pair of a document. The font tables have at most characters-squared rows a font;
    whether they are small enough to broadcast is left to the sizes seen at run time.
    """
    b = pair_counts(texts)
    a = advances.select("font_id", "ch", "advance")
    k = kerns.select("font_id", F.col("left_ch").alias("ch"), F.col("right_ch").alias("nx"), "value")
    j = b.join(a, ["font_id", "ch"], "left").join(k, ["font_id", "ch", "nx"], "left")
    w = j.groupBy("doc_id", "font_id").agg(
        F.sum(F.coalesce("advance", F.lit(0.0)) * F.col("n")).alias("plain"),
        F.sum(F.coalesce("value", F.lit(0)) * F.col("n")).alias("kern"))
    return w.select("doc_id", "font_id", "plain", (F.col("plain") + F.col("kern")).alias("kerned"),
                    (F.try_divide(F.col("kern").cast("double"), F.col("plain")) * 100).alias("shift_pct"))


def digraph_frequency(texts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent letter pairs, and whether a joined form of them is collected."""
    low = texts.select(F.lower("text").alias("text"))
    n = bigrams(low).where(F.col("ch").between("a", "z") & F.col("nx").between("a", "z")) \
        .where(F.length("ch") == 1).groupBy(F.concat("ch", "nx").alias("pair")).agg(F.count("*").alias("n"))
    n = n.where(F.col("pair").rlike(LETTER_PAIR))
    top = n.orderBy(F.desc("n"), "pair").limit(k)
    return top.withColumn("covered", F.col("pair").isin(*dims.LIGATURES))


URL = "^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)([?][^#]*)?(#.*)?$"


def _part(c: str, i: int) -> str:
    return f"regexp_extract({c}, r'{URL}', {i})"


def outbound_links(links: DataFrame) -> DataFrame:
    """L1: resolve every link against its page and describe those that leave its origin.

    links(page_id, base, href). Only http and https links count; the host keeps a port that is
    not the scheme's own; a lone ``/`` is described as nothing.
    """
    L = links.selectExpr(
        "*", f"lower({_part('base', 1)}) AS bs", f"lower({_part('base', 2)}) AS bh", f"{_part('base', 3)} AS bp",
        f"{_part('base', 4)} AS bq")
    L = L.selectExpr(
        "page_id", "href", "bs", "bh",
        "CASE WHEN href RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:' THEN href"
        " WHEN href LIKE '//%' THEN concat(bs, ':', href)"
        " WHEN href LIKE '/%' THEN concat(bs, '://', bh, href)"
        " WHEN href = '' THEN concat(bs, '://', bh, bp, bq)"
        " WHEN href LIKE '#%' THEN concat(bs, '://', bh, bp, bq, href)"
        " WHEN href LIKE '?%' THEN concat(bs, '://', bh, bp, href)"
        " ELSE concat(bs, '://', bh, regexp_replace(bp, '[^/]*$', ''), href) END AS url")
    L = L.selectExpr(
        "page_id", "href", "bs", "bh", f"lower({_part('url', 1)}) AS scheme", f"lower({_part('url', 2)}) AS host",
        f"split({_part('url', 3)}, '/') AS segs", f"{_part('url', 4)} AS q", f"{_part('url', 5)} AS frag")
    # dot segments, folded left to right over the path of one link
    path = ("concat('/', concat_ws('/', aggregate(slice(segs, 2, size(segs)), cast(array() AS array<string>), (a, s) ->"
            " CASE WHEN s = '..' THEN slice(a, 1, greatest(size(a) - 1, 0)) WHEN s = '.' THEN a"
            " ELSE concat(a, array(s)) END)))")
    bare = "regexp_replace({h}, IF({s} = 'https', ':443$', ':80$'), '')"
    L = L.where("scheme IN ('http', 'https')").selectExpr(
        "page_id", "href", f"{bare.format(h='host', s='scheme')} AS host", "scheme",
        f"concat({path}, q, frag) AS rest", "bs", f"{bare.format(h='bh', s='bs')} AS bh")
    return L.where("scheme <> bs OR host <> bh").selectExpr(
        "page_id", "href", "host", "IF(rest = '/', '', rest) AS rest", "scheme = 'https' AS secure")
