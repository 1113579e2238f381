"""The whole way of a batch: files to pages, receipts, sheets and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.functions.amounts import well_formed
from slipstack.operators import extraction, intake, packing

ORDER = ["batch_id", "seq", "page_no"]


def take_in(files: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending receipts, refused files): one receipt per image and per useful page.

    An image has page 0.  An admitted document without a useful page is refused as
    unreadable, so every file is on one side.
    """
    accepted, refused = intake.split(intake.classify(files))
    documents = accepted.filter(F.col("kind") == "pdf")
    of_pages = intake.receipts_from_pages(documents, pages)
    of_images = accepted.filter(F.col("kind") == "image").select(
        "batch_id", "seq", F.lit(0).alias("page_no"), well_formed(F.col("name")).alias("name"), F.lit(fixed.PENDING).alias("status")
    )
    return of_images.unionByName(of_pages), refused.unionByName(intake.files_without_pages(documents, of_pages))


def on_sheets(receipts: DataFrame) -> DataFrame:
    """Receipts of new batches on sheets, in the order of files and pages.

    ``receipt_id`` is made of ``seq`` and ``page_no``; a file has ten pages at most.
    """
    spark = receipts.sparkSession
    number = (F.col("seq") * 16 + F.col("page_no")).cast("bigint")
    items = receipts.select("batch_id", number.alias("seq"), number.alias("receipt_id"))
    sheets = spark.createDataFrame([], "batch_id string, sheet_no bigint, layout string")
    placed = spark.createDataFrame([], "batch_id string, sheet_no bigint, slot bigint, receipt_id bigint")
    return packing.place(sheets, placed, items)


def read(receipts: DataFrame, texts: DataFrame) -> DataFrame:
    """Receipts after reading: ``texts`` is ``seq, page_no, text, ocr_error``; without one a text is empty."""
    met = receipts.join(texts, ["seq", "page_no"], "left")
    return extraction.settle(
        met.withColumn("text", well_formed(F.col("text")))
        .withColumn("cents", F.lit(None).cast("bigint"))
        .withColumn("draft", F.lit(None).cast("string"))
        .withColumn("removed", F.lit(False))
    )


def batch_report(files: DataFrame, pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Per batch: receipts, amounts found, exact total, sheets and refused files."""
    receipts, refused = take_in(files, pages)
    totals = extraction.batch_totals(read(receipts, texts))
    sheets = on_sheets(receipts).groupBy("batch_id").agg(F.max("sheet_no").alias("sheets"))
    no = refused.groupBy("batch_id").agg(F.count(F.lit(1)).alias("refused"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    return totals.join(sheets, "batch_id").join(no, "batch_id", "full").select(
        "batch_id", zero("receipts"), zero("with_amount"), zero("total_cents"), zero("sheets"), zero("refused")
    )
