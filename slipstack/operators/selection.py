"""Confidence-driven choices: best boxes, rotation, width-sorted chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.operators.ordered import running


def top_boxes(boxes: DataFrame, n: int = fixed.TOP_BOXES) -> DataFrame:
    """T-01: the best ``n`` boxes of a (receipt, rotation); ties keep box order.

    A map yields at most 3000 boxes, so the window groups are bounded, and Spark
    cuts each group to ``n`` rows before the shuffle (window group limit).
    """
    best = Window.partitionBy("receipt_id", "deg").orderBy(F.desc("box_score"), F.asc("box_no"))
    return boxes.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= n).drop("_rank")


def confidence(boxes: DataFrame) -> DataFrame:
    """A-09: mean recognition score of the top boxes that gave text, else 0."""
    legible = F.when(F.col("text") != "", F.col("score"))
    return top_boxes(boxes).groupBy("receipt_id", "deg").agg(
        F.coalesce(F.avg(legible), F.lit(0.0)).alias("confidence")
    )


def rotation_order(deg: Column) -> Column:
    """Position in the fixed trial order."""
    order = F.array(*[F.lit(d) for d in fixed.ROTATION_ORDER])
    return F.array_position(order, deg)


def choose_rotation(trials: DataFrame) -> DataFrame:
    """W-06 with W-07: one row per receipt with the winning rotation.

    ``trials`` is ``receipt_id, deg, confidence, det_mass`` with at most four rows
    per receipt.  The first trial that convinces wins, else the best (earliest on
    ties).  Without text at 0 degrees the receipt stays as it is.
    """
    ranked = trials.withColumn("_ord", rotation_order(F.col("deg")))
    sure = F.when(F.col("confidence") >= fixed.CONFIDENT, F.struct("_ord", "deg"))
    best = F.max(F.struct(F.col("confidence"), (-F.col("_ord")).alias("o"), F.col("deg")))
    empty = F.bool_or((F.col("deg") == 0) & (F.col("det_mass") < fixed.EMPTY_MAP_MASS))
    return ranked.groupBy("receipt_id").agg(
        F.when(empty, F.lit(0))
        .otherwise(F.coalesce(F.min(sure)["deg"], best["deg"]))
        .alias("deg"),
        F.coalesce(empty, F.lit(False)).alias("no_text"),
    )


def can_read(width: Column, height: Column) -> Column:
    """F-16: images under eight pixels a side skip the reader."""
    return (width >= fixed.MIN_OCR_SIDE) & (height >= fixed.MIN_OCR_SIDE)


def width_chunks(lines: DataFrame, size: int = fixed.LINES_PER_CHUNK) -> DataFrame:
    """T-02: lines of a receipt by padded width, cut into chunks of ``size``.

    Adds ``chunk`` and ``chunk_width``.  The place of a line is a running rank, so a receipt may have any number of
    lines; only the lines of one chunk meet.
    """
    placed = running(lines, ["receipt_id"], ["width", "line_no"], rank="_place")
    chunked = placed.withColumn("chunk", F.floor((F.col("_place") - 1) / size)).drop("_place")
    return chunked.withColumn(
        "chunk_width", F.max("width").over(Window.partitionBy("receipt_id", "chunk"))
    )


def equal_areas(lines: DataFrame, parts: int, key: str, width: str = "width", step: int = 8) -> DataFrame:
    """Lines dealt to ``parts`` tasks, in order of width, so that every task has the same padded area.

    Adds ``_part``. Widths are padded to multiples of ``step``. A task takes a stretch of the area under the widths,
    put in order; a common width is cut at a hash of the unique ``key``. Only the counts of the padded widths are
    put in order, so that is bounded by the widest line, not by the lines. A line without width counts as empty.
    """
    padded = F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(width), F.lit(0)) / step)).cast("bigint")
    sized = lines.withColumn("_padded", padded)
    counted = sized.groupBy("_padded").agg((F.count(F.lit(1)) * F.col("_padded")).cast("double").alias("_area"))
    before = Window.orderBy("_padded").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        "_padded", "_area", F.coalesce(F.sum("_area").over(before), F.lit(0.0)).alias("_start"), F.sum("_area").over(Window.partitionBy()).alias("_all")
    )
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    at = (F.col("_start") + share * F.col("_area")) / F.col("_all")
    part = F.least(F.lit(parts - 1), F.floor(at * parts)).cast("int")
    return sized.join(starts, "_padded").withColumn("_part", part).drop("_padded", "_area", "_start", "_all").repartitionById(parts, "_part")


def diagnostics(lines: DataFrame, size: int = fixed.LINES_PER_CHUNK) -> DataFrame:
    """A-18: boxes, lines, widest line, chunk runs and fallback per receipt."""
    usable = F.count("width")
    return lines.groupBy("receipt_id").agg(
        F.count(F.lit(1)).alias("boxes"),
        usable.alias("lines"),
        F.coalesce(F.max("width"), F.lit(0)).alias("max_width"),
        F.ceil(usable / size).alias("runs"),
        F.coalesce(F.bool_or("failed"), F.lit(False)).alias("fallback"),
    )
