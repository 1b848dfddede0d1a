"""Page images: reading files with the built-in image source, and binaries to pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwork.operators import pages, raster


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """scans(scan_id, origin, w, h, n, data) of image files; data is blue-green-red bytes.

    Spark decodes each file in the task that reads it. Files that are no images have no row here but one in ``unreadable``.
    """
    return read_all(spark, path).where("w > 0")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(scan_id, origin) of the files that are no images."""
    return read_all(spark, path).where("w <= 0").select("scan_id", "origin")


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """Every file; one that is no image has w = -1 and no data."""
    img = spark.read.format("image").load(path)
    return img.selectExpr(
        "xxhash64(image.origin) AS scan_id", "image.origin AS origin", "image.width AS w", "image.height AS h",
        "image.nChannels AS n", "image.data AS data")


def scan_pixels(scans: DataFrame) -> DataFrame:
    """pixels(scan_id, w, h, y, x, r, g, b); a byte is read through its two hex digits.

    Channels: 3 (blue-green-red), 4 (with a leading or trailing alpha ignored), 1 (gray).
    """
    n = "n" if "n" in scans.columns else "3"
    # one decode to Latin-1 text per image; ascii() of a character is then its byte
    s = scans.selectExpr("scan_id", "w", "h", f"{n} AS n", "split(decode(data, 'ISO-8859-1'), '') AS c")
    s = s.selectExpr("scan_id", "w", "h", "n", "c", "explode(sequence(0, w * h - 1)) AS p")
    return s.selectExpr(
        "scan_id", "w", "h", "cast(p div w AS int) AS y", "cast(p % w AS int) AS x",
        "ascii(c[p * n + IF(n >= 3, 2, 0)]) AS r", "ascii(c[p * n + IF(n >= 3, 1, 0)]) AS g", "ascii(c[p * n]) AS b")


def working_gray(scans: DataFrame, drop_blue: bool = False) -> DataFrame:
    """Gray pages capped so that a turned page still fits the largest working size, pixel by pixel; shrunk where they were decoded."""
    lines = pages.gray_lines(scans, raster.WORKING_DIM, drop_blue)
    return lines.selectExpr("scan_id", "w", "h", "y", "explode(sequence(0, w - 1)) AS x", "line").selectExpr(
        "scan_id", "w", "h", "y", "x", "cast(conv(hex(substring(line, x + 1, 1)), 16, 10) AS int) AS gray")
