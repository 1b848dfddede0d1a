"""File triage: what a name or the first bytes say, and photographs buried in other files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import dims

# --- fixed values -----------------------------------------------------------------------
REFUSED = {
    "code": "js mjs cjs ts tsx jsx py rb go rs java c h cpp cc cs php sh bash zsh fish ps1 bat cmd sql json yaml "
            "yml toml ini css scss less html htm vue svelte swift kt lua pl r scala dart ex exs hs clj",
    "archive": "zip rar 7z tar gz bz2 xz iso dmg",
    "program": "exe dll so dylib msi deb rpm apk app bin jar",
    "sound": "mp3 wav flac m4a ogg aac",
    "font": "otf ttf woff woff2 eot",
}
REFUSED_TYPES = {"sound": "audio/"}
HEIC_BRANDS = "heic heix hevc hevx heim heis hevm hevs mif1 msf1".split()
MIN_JPEG_BYTES = 2048
# ----------------------------------------------------------------------------------------


def extension_rows() -> list[tuple]:
    """(ext, what, rank); the first group naming an extension wins."""
    seen, rows = set(), []
    for rank, (what, exts) in enumerate(REFUSED.items()):
        for e in exts.split():
            if e not in seen:
                seen.add(e)
                rows.append((e, what, rank))
    return rows


def extension(name: Column) -> Column:
    """What follows the last dot, lower-case; nothing for a leading or a trailing dot."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def classify(files: DataFrame) -> DataFrame:
    """Accept or refuse a file by its type and name; files(..., name, type)."""
    spark = files.sparkSession
    ext = F.broadcast(spark.sql(dims.values_sql(extension_rows(), "ext, by_ext, ext_rank")))
    f = files.withColumn("ext", extension(F.col("name"))).join(ext, "ext", "left")
    kind = F.lower(F.coalesce("type", F.lit("")))
    ranks = list(REFUSED)
    by_type = F.coalesce(*[F.when(kind.startswith(p), F.lit(ranks.index(w))) for w, p in REFUSED_TYPES.items()])
    best = F.least(F.col("ext_rank"), by_type)  # least skips nulls: the earlier group of the two
    what = F.coalesce(*[F.when(best == i, F.lit(w)) for i, w in enumerate(ranks)])
    image = kind.startswith("image/")
    return f.select(*files.columns, "ext", F.when(~image, what).alias("what"),
                    (image | what.isNull()).alias("ok"))


def sniff(content: str) -> Column:
    """The format its first bytes give away, or null; ``content`` is a binary column."""
    head = f"hex(substring({content}, 1, 12))"
    brands = ", ".join("'" + b.encode().hex().upper() + "'" for b in HEIC_BRANDS)

    def text(s: str) -> str:
        return s.encode().hex().upper()

    lower_brand = f"hex(encode(lower(decode(substring({content}, 9, 4), 'ISO-8859-1')), 'ISO-8859-1'))"
    return F.expr(
        f"CASE WHEN length({content}) < 12 THEN NULL"
        f" WHEN startswith({head}, 'FFD8FF') THEN 'jpeg'"
        f" WHEN startswith({head}, '89{text('PNG')}') THEN 'png'"
        f" WHEN startswith({head}, '{text('GIF')}') THEN 'gif'"
        f" WHEN startswith({head}, '{text('RIFF')}') AND endswith({head}, '{text('WEBP')}') THEN 'webp'"
        f" WHEN startswith({head}, '{text('%PDF')}') THEN 'pdf'"
        f" WHEN startswith({head}, '{text('PK')}') THEN 'zip'"
        f" WHEN substring({head}, 9, 8) = '{text('ftyp')}' AND {lower_brand} IN ({brands}) THEN 'heic' END")


def carve_jpegs(blobs: DataFrame) -> DataFrame:
    """The longest photograph held in each file, with its place; blobs(id, content).

    Bytes are read as Latin-1 text, one character per byte, so the built-in regular expressions
    find them. Spans never nest; short ones are thumbnails' noise; the first of equals wins.
    """
    b = blobs.selectExpr("id", "decode(content, 'ISO-8859-1') AS s")
    b = b.selectExpr("id", r"regexp_extract_all(s, '(?s)\\xFF\\xD8\\xFF.*?\\xFF\\xD9', 0) AS found")
    b = b.selectExpr("id", f"filter(transform(found, (f, i) -> struct(length(f) AS n, -i AS o, f AS f)), r -> r.n >= {MIN_JPEG_BYTES}) AS runs")
    b = b.selectExpr("id", "size(runs) AS n_found", "array_max(transform(runs, r -> struct(r.n, r.o))) AS best", "runs")
    return b.where("n_found > 0").selectExpr(
        "id", "n_found", "best.n AS n_bytes",
        "encode(filter(runs, r -> r.o = best.o)[0].f, 'ISO-8859-1') AS jpeg")
