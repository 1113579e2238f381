"""Reading dropped files and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.sources import folders

LISTED = ("batch_id", "path", "name", "mime", "size", "head_hex", "modified")
# Extensions browsers map to a type; everything else has no type.
MIME_BY_EXTENSION = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "gif": "image/gif",
    "pdf": fixed.PDF_MIME,
}


def _named(files: DataFrame, batch_id: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    mime = F.lit("")
    for ext, kind in MIME_BY_EXTENSION.items():
        mime = F.when(extension == ext, F.lit(kind)).otherwise(mime)
    return files.withColumn("batch_id", F.lit(batch_id)).withColumn("name", name).withColumn("mime", mime)


def listing(spark: SparkSession, path: str, batch_id: str, most_bytes: int = fixed.MAX_DOCUMENT_BYTES) -> DataFrame:
    """S-01: files of a folder, and of those below it, with size and first twelve bytes.

    Files over ``most_bytes``, which the size gate (F-05) refuses anyway, are not opened and have no head.
    """
    folders.register(spark)
    raw = spark.read.format(folders.FORMAT).option("most_bytes", most_bytes).load(path)
    return _named(raw, batch_id).select(*LISTED)


def listing_stream(
    spark: SparkSession, path: str, batch_id: str, most_bytes: int = fixed.MAX_DOCUMENT_BYTES, settle: float = 5
) -> DataFrame:
    """S-01 as a stream: files are picked up once they are ``settle`` seconds old, behind the same gate."""
    folders.register(spark)
    raw = spark.readStream.format(folders.FORMAT).option("most_bytes", most_bytes).option("settle", settle).load(path)
    return _named(raw, batch_id).select(*LISTED)


def images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S-02: (decoded images, unreadable files).

    Spark's image source keeps undecodable files with negative sizes; those are the
    rejects.  ``rgba`` is left to ``rgba_bytes`` because the source stores BGR.
    """
    found = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True)
    raw = found.load(path).select("image.*")
    good = raw.filter((F.col("height") > 0) & (F.col("width") > 0))
    bad = raw.filter((F.col("height") <= 0) | (F.col("width") <= 0)).select(
        F.col("origin").alias("path"), F.lit("ilegible").alias("reason")
    )
    return good, bad


def bitmap(data: Column, width: Column, height: Column) -> Column:
    """A 24-bit BMP file of packed RGBA pixels (four bytes a pixel), without their alpha; rows go from the top."""
    number = lambda value, size: F.unhex(F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.lpad(F.hex(F.call_function("shiftright", value.cast("bigint"), i * 8).bitwiseAND(255)), 2, "0")), ""
    ))
    stride = F.floor((width * 3 + 3) / 4) * 4
    packed = F.hex(data)

    def row(y: Column) -> Column:
        pixels = F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda x: F.array_join(F.transform(F.array(F.lit(2), F.lit(1), F.lit(0)), lambda c: F.substring(packed, ((y * width + x) * 4 + c) * 2 + 1, F.lit(2))), ""),
        )
        return F.rpad(F.array_join(pixels, ""), stride * 2, "0")

    body = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), height - 1), row), ""))
    size = stride * height
    head = [F.lit("BM").cast("binary"), number(size + 54, 4), number(F.lit(0), 4), number(F.lit(54), 4), number(F.lit(40), 4), number(width, 4)]
    head += [number(F.lit(0) - height, 4), number(F.lit(1), 2), number(F.lit(24), 2), number(F.lit(0), 4), number(size, 4), *[number(F.lit(0), 4)] * 4]
    return F.concat(*head, body)
