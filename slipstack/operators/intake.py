"""Intake: routing, admission, quarantine, page fan-out, page names, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.functions import quads
from slipstack.functions.amounts import well_formed


def is_image(mime: Column) -> Column:
    """F-01."""
    return F.coalesce(F.regexp_like(mime, F.lit(fixed.IMAGE_MIME_PATTERN)), F.lit(False))


def is_pdf(mime: Column, name: Column) -> Column:
    """F-02: exact type, or the extension in any case."""
    return F.coalesce(mime == fixed.PDF_MIME, F.lit(False)) | F.coalesce(
        F.lower(name).endswith(".pdf"), F.lit(False)
    )


def route(mime: Column, name: Column) -> Column:
    """F-03: image before PDF before refusal."""
    return F.when(is_image(mime), "image").when(is_pdf(mime, name), "pdf").otherwise("unsupported")


def is_direct_format(mime: Column, head: Column) -> Column:
    """F-04: kept without re-encoding; the bytes decide only when no type is given."""
    kind = F.trim(F.lower(F.coalesce(mime, F.lit(""))))
    bytes_hex = F.hex(F.substring(head, 1, 12))
    signature = (
        bytes_hex.startswith("FFD8FF")
        | bytes_hex.startswith("89504E470D0A1A0A")
        | (bytes_hex.startswith("52494646") & (F.substring(bytes_hex, 17, 8) == "57454250"))
    )
    sniffed = F.coalesce((F.length(bytes_hex) >= 8) & signature, F.lit(False))
    return F.when(kind != "", kind.isin(*fixed.DIRECT_MIMES)).otherwise(sniffed)


def passes_through(direct: Column, width: Column, height: Column, trimmed: Column) -> Column:
    """F-11: nothing to correct, the original bytes stay."""
    return direct & (quads.resize_scale(width, height) == 1.0) & ~trimmed


def size_admits(size: Column, limit: int = fixed.MAX_DOCUMENT_BYTES) -> Column:
    """F-05: neither empty nor over the limit (inclusive)."""
    return size.between(1, limit)


def refusal(size: Column, open_error: Column, pages: Column) -> Column:
    """F-06: reason of refusal of a PDF in fixed order, null when admitted."""
    return (
        F.when(size == 0, "ilegible")
        .when(~size_admits(size), "tamano")
        .when(open_error == "password", "cifrado")
        .when(open_error.isNotNull(), "ilegible")
        .when(pages.isNull(), "ilegible")
        .when(pages > fixed.MAX_DOCUMENT_PAGES, "paginas")
    )


def classify(files: DataFrame) -> DataFrame:
    """F-03 and F-06 in one pass: adds ``kind`` and ``reason`` (null = accepted).

    Size and type are read from the listing; page counts only matter for the
    rows that got that far, so a caller can compute them lazily.
    """
    kind = route(F.col("mime"), F.col("name"))
    return files.withColumn("kind", kind).withColumn(
        "reason",
        F.when(F.col("kind") == "unsupported", "formato").when(
            F.col("kind") == "pdf",
            refusal(F.col("size"), F.col("open_error"), F.col("page_count")),
        ),
    )


def split(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U-S1: (accepted, rejected), which together are the whole intake."""
    return classified.filter(F.col("reason").isNull()), classified.filter(F.col("reason").isNotNull())


def unite(*sources: DataFrame | None) -> DataFrame:
    """S-03: one list of files out of several; a missing source counts as empty."""
    given = [s for s in sources if s is not None]
    if not given:
        raise ValueError("at least one source must be given for the schema")
    whole = given[0]
    for more in given[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return whole


def reason_table(spark) -> DataFrame:
    """The texts of the reasons: five fixed rows."""
    rows = [(k, t, d) for k, (t, d) in fixed.REASONS.items()]
    rows.append(("formato", fixed.FORMAT_TITLE, fixed.FORMAT_TEXT))
    values = ", ".join("('{}', '{}', '{}')".format(*r) for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(reason, title, detail)")


def with_reason_text(rejects: DataFrame) -> DataFrame:
    """J-01: reason to title and message (broadcast of five fixed rows)."""
    return rejects.join(F.broadcast(reason_table(rejects.sparkSession)), "reason")


def quarantine(rejected: DataFrame) -> DataFrame:
    """S-10: one readable row per refused file."""
    named = rejected.withColumn("file", well_formed(F.col("name")))
    return with_reason_text(named).select("batch_id", "seq", "file", "reason", "title", "detail")


def fan_out(files: DataFrame) -> DataFrame:
    """P-01: one row per page; at most ten rows per file."""
    usable = files.filter(F.col("page_count").between(1, fixed.MAX_DOCUMENT_PAGES))
    return usable.withColumn("page_no", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int")))).withColumn(
        "page_total", F.col("page_count")
    )


def is_useful_page(width: Column, height: Column, white: Column, black: Column) -> Column:
    """F-08 with F-09 / F-10 on measured ratios; an unmeasured page is no page."""
    kept = (
        quads.is_safe_page(width, height)
        & (white < fixed.BLANK_RATIO)
        & (black < fixed.BLANK_RATIO)
    )
    return F.coalesce(kept, F.lit(False))


def page_name(name: Column, page_no: Column, page_total: Column) -> Column:
    """C-23: ``base p.i/N``."""
    base = F.regexp_replace(well_formed(name), r"(?i)\.pdf$", "")
    return F.concat(base, F.lit(" p."), page_no.cast("string"), F.lit("/"), page_total.cast("string"))


def receipts_from_pages(files: DataFrame, pages: DataFrame) -> DataFrame:
    """J-11: one pending receipt per useful page of an admitted file."""
    useful = pages.filter(
        is_useful_page(F.col("width"), F.col("height"), F.col("white_ratio"), F.col("black_ratio"))
    ).select("seq", "page_no")
    return (
        fan_out(files)
        .join(useful, ["seq", "page_no"])
        .select(
            "batch_id",
            "seq",
            "page_no",
            page_name(F.col("name"), F.col("page_no"), F.col("page_total")).alias("name"),
            F.lit(fixed.PENDING).alias("status"),
        )
    )


def files_without_pages(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """F-07: admitted files that yielded nothing become unreadable."""
    return files.join(receipts.select("seq").distinct(), "seq", "left_anti").withColumn(
        "reason", F.lit("ilegible")
    )


def notice_digest(notices: DataFrame, key: str = "batch_id", seq: str = "seq") -> DataFrame:
    """A-16: up to four notices as they are, else the first three and a summary row.

    Each task keeps only its first four rows of a batch before anything is shuffled
    (Spark's window group limit), and the batch sizes are counted map-side, so a batch
    with very many refusals sends a handful of rows.
    """
    first = Window.partitionBy(key).orderBy(seq)
    head = notices.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= fixed.MAX_NOTICES)
    sizes = notices.groupBy(key).agg(F.count(F.lit(1)).alias("_total"))
    many = F.col("_total") > fixed.MAX_NOTICES
    lead = F.first(F.when(F.col("grp") == "intake", "intake")).over(first)
    numbered = head.withColumn("_lead", lead).join(sizes, key)
    summed = many & (F.col("_rank") == fixed.MAX_NOTICES)
    text = F.concat(F.lit("…y "), (F.col("_total") - 3).cast("string"), F.lit(" más descartados"))
    return numbered.select(
        key,
        F.col("_rank").cast("bigint").alias("position"),
        F.when(summed, text).otherwise(F.col("title")).alias("title"),
        F.when(~summed, F.col("file")).alias("file"),
        F.when(summed, F.col("_lead")).otherwise(F.col("grp")).alias("grp"),
    )
