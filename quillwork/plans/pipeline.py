"""The whole way from image files to a family of four styles and its report, for every font of a corpus at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import dims
from quillwork.functions.num import r6
from quillwork.operators import family as Y
from quillwork.operators import health as H
from quillwork.operators import metrics as M
from quillwork.operators import outline as T
from quillwork.operators import pages as P
from quillwork.operators import raster as R
from quillwork.operators import segment as G
from quillwork.plans.registry import query
from quillwork.sources import adapters as A
from quillwork.sources import images
from quillwork.stages import Stages


@dataclass
class Family:
    """What a job leaves behind, each table keyed by font or page."""

    glyphs: DataFrame  # one row a captured glyph: outline in font units, bearings, advance
    kerning: DataFrame  # pairs by character
    classes: DataFrame  # dense class matrix of the kerning
    styles: DataFrame  # every glyph of the four styles
    style_kerning: DataFrame  # pairs by glyph number
    extents: DataFrame  # ascender and descender of each style
    manifest: DataFrame  # files of the family and what is in them
    findings: DataFrame
    report: DataFrame  # captured, expected, score, label
    pages: DataFrame  # angle, slant, ink share and rules of each page
    refused: DataFrame  # (scan_id, code): pages that gave no glyph, and why


def font_batch(scans: DataFrame, pages: DataFrame, families: DataFrame | None = None, name: str | None = None,
               weight: float = 0.0, bold: float = Y.BOLD, lean: float = Y.ITALIC_DEG) -> Family:
    """Decoded page images to a family and its report.

    scans(scan_id, w, h, data, n) as ``images.read_scans`` gives them; pages(scan_id, font_id, sheet_no); families(font_id, family)
    names the files. Work is keyed by page up to the cells, by glyph up to the outlines, and by font from the metrics on. Each
    stage is a Parquet table that later ones read by column; with ``name`` a job that was lost goes on where it stopped, so a
    name stands for one input. When the last table is written the others are deleted.
    """
    spark = scans.sparkSession
    st = Stages(spark, "font-batch", name)
    asked = st.put("asked", lambda: pages.select("scan_id", "font_id", "sheet_no").distinct())
    of_sheet = asked.select("scan_id", "sheet_no")

    # by page
    lines = st.put("lines", lambda: P.gray_lines(scans.join(asked.select("scan_id"), "scan_id", "left_semi")))
    runs, info = P.preprocess(lines, st.put)
    comps = st.put("components", lambda: R.components(runs))
    fatal = st.put("fatal", lambda: G.component_cap(comps, of_sheet).select("scan_id", "code"))
    good_runs, good_comps, due = (G.accepted(df, fatal) for df in (runs, comps, of_sheet))
    bands = st.put("bands", lambda: G.reconcile_bands(G.band_counts(G.find_lines(good_runs), good_comps), due))
    marked = st.put("marked", lambda: G.with_ids(good_runs, good_comps))
    groups = st.put("groups", lambda: G.row_groups(G.assign_band(bands, good_comps), marked, due))
    wrong = st.put("wrong", lambda: G.wrong_sheet(G.observed_rows(bands, groups), due).selectExpr("scan_id", "'wrong-sheet' AS code"))
    refused = fatal.unionByName(wrong)

    # by glyph
    def cut_out() -> DataFrame:
        cells = G.accepted(G.sheet_cells(groups, due), wrong)
        return G.extract_glyphs(cells, marked).select(F.xxhash64("scan_id", "rw", "col").alias("glyph_id"), "*")

    ex = st.put("glyph_runs", cut_out)
    boxes = st.put("boxes", lambda: ex.select("glyph_id", "scan_id", "rw", "col", "ch", "bx0", "by0", "bx1", "by1", "w", "h").distinct())
    o = st.put("outlines", lambda: T.outlines(T.vectorize(ex.select("glyph_id", "y", "x0", "x1"), boxes)))
    known = dims.charset(spark).select("ord", "ch", F.col("name").alias("glyph_name"), "zone", "grp", "unicode", "kind")

    def captured() -> DataFrame:
        g = boxes.join(asked, "scan_id").join(o.select("glyph_id"), "glyph_id", "left_semi").join(known, "ch")
        return Y.merge_captures(g.withColumnRenamed("rw", "row")).withColumnRenamed("row", "rw")

    g = st.put("captured", captured)

    # by font
    guides = "cast(NULL AS struct<baseline: double, x_height: double, asc_height: double, desc_depth: double>) AS guides"
    solved = st.put("solved", lambda: M.solve_rows(M.row_metrics(g.selectExpr(
        "font_id", "rw", "sheet_no", "col AS o", "zone", "by0 AS y0", "by1 AS y1", guides))))
    place = g.join(solved.select("font_id", "rw", "baseline", "scale"), ["font_id", "rw"]).selectExpr(
        "glyph_id", "font_id", "ord", "ch", "zone", f"{G.PAD} AS pad", "by0 AS page_y0", "baseline", "scale")
    norm = st.put("normalised", lambda: M.normalize_curves(o.join(place, "glyph_id")))

    def profiles() -> DataFrame:
        within = ex.select("glyph_id", "y", "x0", "x1").join(norm.select("glyph_id", "pad", "page_y0", "baseline", "scale", "shift"), "glyph_id")
        return M.bitmap_profile(within).join(
            norm.select("glyph_id", "font_id", "ord", "ch", F.col("ink_width").alias("width")), "glyph_id").withColumnRenamed("line", "i")

    prof = st.put("profiles", profiles)
    extent = M.font_extent(norm.selectExpr("font_id", "ink_y0 AS y0", "ink_y1 AS y1"))
    spaced = st.put("spaced", lambda: M.spacing(M.perceived_margin(prof, extent)))
    glyphs = st.put("glyphs", lambda: norm.select("glyph_id", "font_id", "ord", "ch", "zone", "curves", "ink_width", "ink_y0", "ink_y1").join(
        spaced.select("glyph_id", "lsb", "rsb", "advance"), "glyph_id").join(
        known.select("ord", F.col("glyph_name").alias("name"), "unicode", "kind", "grp"), "ord"))
    kerns = st.put("kerning", lambda: M.kerning(M.pair_gaps(spaced, M.on_grid(prof, extent))))
    classes = st.put("classes", lambda: Y.kern_classes(kerns))

    # the four styles
    slants = info.join(asked, "scan_id").select("font_id", "slant")
    angle = Y.italic_angle(slants, lean).select("font_id", F.col("italic").alias("own_lean"))
    styles = st.put("styles", lambda: Y.style_glyphs(Y.glyph_defs(glyphs).join(angle, "font_id"), weight, bold, "own_lean"))
    style_kerning = st.put("style_kerning", lambda: Y.style_kerning(kerns, styles))
    extents = st.put("extents", lambda: Y.style_extent(styles))
    named = asked.select("font_id").distinct()
    named = named.join(families, "font_id", "left") if families is not None else named.withColumn("family", F.lit(None).cast("string"))
    manifest = st.put("manifest", lambda: Y.style_manifest(styles, style_kerning, named))

    # the report
    def findings() -> DataFrame:
        ink = ex.groupBy("glyph_id").agg(F.sum(F.expr("x1 - x0")).alias("area"))
        seen = g.select("glyph_id", "font_id", "ord", "ch", "zone", "grp", F.struct("rw", "col").alias("o"))
        pen = H.stroke_width(ex.selectExpr("glyph_id", "y", "explode(sequence(x0, x1 - 1)) AS x")).select("glyph_id", F.col("stroke_width").alias("t"))
        alike = H.top_lookalikes(H.lookalikes(seen, H.signature_vectors(H.signature(_bitmap(ex)))))
        leaning = slants.groupBy("font_id").agg(F.median("slant").alias("slant")).where(F.abs("slant") > H.LEAN_DEG)
        return H.findings(
            H.resolution(solved), H.missing_chars(seen, asked, spark), H.faint(seen.join(ink, "glyph_id")), alike,
            H.size_outlier(norm.selectExpr("font_id", "ch", "zone", "ink_y1 - ink_y0 AS height")),
            H.stroke_weight(seen.join(pen, "glyph_id")), solved.where("NOT confident"), leaning)

    found = st.put("findings", findings)
    sizes = dims.sheets(spark, ligatures=False).groupBy("sheet_no").agg(F.count("*").alias("n"))
    expected = asked.select("font_id", "sheet_no").distinct().join(F.broadcast(sizes), "sheet_no").groupBy("font_id").agg(F.sum("n").alias("expected"))
    counts = g.groupBy("font_id").agg(F.countDistinct("ch").alias("captured"))
    report = st.put("report", lambda: H.health_score(found, expected.join(counts, "font_id", "left").na.fill(0, ["captured"])))
    told = st.put("refused", lambda: refused)
    st.finish(keep=["glyphs", "kerning", "classes", "styles", "style_kerning", "extents", "manifest", "findings", "report", "info", "refused"])
    return Family(glyphs, kerns, classes, styles, style_kerning, extents, manifest, found, report, info, told)


def font_batch_files(spark: SparkSession, path: str, pages: DataFrame, families: DataFrame | None = None, name: str | None = None, **settings) -> Family:
    """X4 from image files; pages(file, font_id, sheet_no) names each by the end of its path. Files that are no images, and pages without
    a file, are among the refused (``not-an-image``, ``no-file``; the latter under a hash of their name)."""
    read = images.read_all(spark, path)
    listed = pages.join(read.select("scan_id", "origin", "w"), F.expr("origin LIKE concat('%/', replace(replace(file, '%', '\\\\%'), '_', '\\\\_'))"), "left")
    listed = listed.select(F.coalesce("scan_id", F.xxhash64("file")).alias("scan_id"), "font_id", "sheet_no", F.col("origin").isNull().alias("lost"), (F.col("w") <= 0).alias("bad"))
    out = font_batch(read.where("w > 0"), listed.where("NOT lost AND NOT bad").select("scan_id", "font_id", "sheet_no"), families, name, **settings)
    unread = listed.where("lost OR bad").select("scan_id", F.when(F.col("lost"), "no-file").otherwise("not-an-image").alias("code"))
    out.refused = out.refused.unionByName(unread)
    return out


def _bitmap(ex: DataFrame) -> DataFrame:
    """Every pixel of each glyph's box, ink or not: runs laid over their lines."""
    lines = ex.select("glyph_id", "w", "h").distinct().selectExpr("glyph_id", "w", "explode(sequence(0, h - 1)) AS y")
    runs = ex.groupBy("glyph_id", "y").agg(F.collect_list(F.struct("x0", "x1")).alias("r"))
    return lines.join(runs, ["glyph_id", "y"], "left").selectExpr("glyph_id", "y", "r", "explode(sequence(0, w - 1)) AS x").selectExpr(
        "glyph_id", "y", "x", "coalesce(exists(r, e -> x >= e.x0 AND x < e.x1), false) AS ink")


def batch(spark: SparkSession, sf: str) -> Family:
    pages = A.sheet_pages(spark, sf).select("scan_id", "font_id", "sheet_no").distinct()
    families = A.table(spark, sf, "supplier").selectExpr("s_suppkey AS font_id", "s_name AS family")
    return font_batch(A.sheet_images(spark, sf), pages, families)


@query("font_batch")
def font_batch_query(spark, sf):
    """One row per font: glyphs, kerning, styles, files, findings and score."""
    f = batch(spark, sf)
    parts = [
        f.glyphs.groupBy("font_id").agg(F.count("*").alias("glyphs"), r6(F.avg("advance")).alias("mean_advance")),
        f.kerning.groupBy("font_id").agg(F.count("*").alias("kerning_pairs")),
        f.classes.groupBy("font_id").agg(F.count("*").alias("class_cells")),
        f.styles.groupBy("font_id").agg(F.count("*").alias("style_glyphs"), F.sum("styled_advance").alias("styled_advance")),
        f.style_kerning.groupBy("font_id").agg(F.count("*").alias("style_pairs")),
        f.manifest.groupBy("font_id").agg(F.count("*").alias("files"), F.sum("glyph_count").alias("listed_glyphs")),
        f.findings.groupBy("font_id").agg(F.count("*").alias("findings")),
    ]
    out = f.report
    for p in parts:
        out = out.join(p, "font_id", "left")
    return out.na.fill(0)
