"""From OCR text to totals: candidates, guarded application, batch outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.functions.amounts import collapse_spaces, has_text, with_fast_total


def is_candidate() -> Column:
    """F-12: read, without amount, not manual, with some text."""
    return (
        (F.col("status") == fixed.DONE)
        & F.col("cents").isNull()
        & ~F.col("manual")
        & has_text(F.col("text"))
    )


def join_lines(lines: DataFrame) -> DataFrame:
    """S-05: the non-empty lines of a receipt in box order, one per text row.

    A receipt holds at most 3000 lines (the box cap), so the list is bounded.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("line_no", "text"))))
    return lines.groupBy("receipt_id").agg(
        F.array_join(F.transform(ordered, lambda l: l["text"]), "\n").alias("text")
    )


def live(results: DataFrame, receipts: DataFrame) -> DataFrame:
    """J-03: results of removed receipts are dropped."""
    return results.join(receipts.filter(~F.col("removed")), "receipt_id", "left_semi")


def may_apply(new_cents: Column, seen_text: Column) -> Column:
    """J-05: whether an amount read from ``seen_text`` may be set on a row of receipts.

    A draft wins, a removed receipt stays removed, an amount that is there stays, and
    a text that has changed meanwhile makes the reading stale.
    """
    ok = (
        new_cents.isNotNull()
        & (F.coalesce(F.col("draft"), F.lit("")) == "")
        & ~F.col("removed")
        & F.col("cents").isNull()
        & (collapse_spaces(F.col("text")) == seen_text)
    )
    return F.coalesce(ok, F.lit(False))


def apply_totals(receipts: DataFrame, results: DataFrame) -> DataFrame:
    """J-05: compare-and-set of extracted cents.

    ``results`` holds ``receipt_id, new_cents, seen_text`` (the text that was
    evaluated, already normalised) and may hold ``seq``.  Adds ``applied`` and the
    resulting ``cents``.  Of several results that fit a receipt the first by ``seq``
    counts, without it the smallest amount; receipts are never multiplied.
    """
    order = F.struct("seq", "new_cents") if "seq" in results.columns else F.struct("new_cents")
    given = (
        results.filter(F.col("new_cents").isNotNull())
        .groupBy("receipt_id", F.col("seen_text").alias("_now"))
        .agg(F.min_by("new_cents", order).alias("new_cents"))
    )
    joined = receipts.withColumn("_now", collapse_spaces(F.col("text"))).join(given, ["receipt_id", "_now"], "left")
    return (
        joined.withColumn("applied", may_apply(F.col("new_cents"), F.col("_now")))
        .withColumn("cents", F.when(F.col("applied"), F.col("new_cents")).otherwise(F.col("cents")))
        .drop("new_cents", "_now")
    )


def batch_outcome(receipts: DataFrame, listed: Column | None = None) -> DataFrame:
    """A-07: what a recalculation of each batch would find.

    ``listed`` selects the rows put to the test (by default F-12).  One shuffle by
    batch of map-side counters, so a huge batch sends one partial row per task.
    """
    chosen = is_candidate() if listed is None else listed
    marked = receipts.withColumn("_listed", chosen).withColumn(
        "_text", F.when(F.col("_listed"), F.col("text"))
    )
    marked = with_fast_total(marked, "_text", "_total")
    count = F.count_if(F.col("_listed"))
    texts = F.count_if(has_text(F.col("_text")))
    totals = F.count("_total")
    return marked.groupBy("batch_id").agg(
        count.alias("candidates"),
        texts.alias("with_text"),
        totals.alias("with_total"),
        F.coalesce(F.sum(F.col("_total").cast("decimal(38,0)")), F.lit(0)).alias("found_cents"),
        F.when(count == 0, "sin-candidatos")
        .when(texts == 0, "sin-texto")
        .when(totals == 0, "sin-totales")
        .otherwise("listo")
        .alias("outcome"),
    )


def batch_message(applied: Column, total: Column, prior: Column) -> Column:
    """A-08: full success gives an earlier notice back."""
    text = F.concat(F.lit("Local: "), applied.cast("string"), F.lit("/"), total.cast("string"), F.lit(" totales."))
    earlier = F.coalesce(prior, F.lit(""))
    return F.when((applied == total) & has_text(earlier), earlier).otherwise(text)


def batch_messages(receipts: DataFrame, prior: Column) -> DataFrame:
    """A-08: what a recalculation asked for by hand says, per batch of live receipts.

    Applied out of the candidates with text; a batch without candidates or without
    totals has a text of its own, one without any text says nothing.  ``prior`` gives
    the earlier notice of the batch as an aggregate over its receipts.
    """
    live_rows = receipts.filter(~F.col("removed")).withColumn("_mine", is_candidate())
    read = with_fast_total(live_rows.withColumn("_text", F.when(F.col("_mine"), F.col("text"))), "_text", "_total")
    applied = F.col("_mine") & may_apply(F.col("_total"), collapse_spaces(F.col("text")))
    summed = read.groupBy("batch_id").agg(
        F.count_if(F.col("_mine")).alias("_listed"),
        F.count_if(has_text(F.col("_text"))).alias("_texts"),
        F.count("_total").alias("_totals"),
        F.count_if(applied).alias("_applied"),
        prior.alias("_prior"),
    )
    message = (
        F.when(F.col("_listed") == 0, fixed.NOTHING_PENDING)
        .when(F.col("_texts") == 0, F.lit(None).cast("string"))
        .when(F.col("_totals") == 0, fixed.NOTHING_READ)
        .otherwise(batch_message(F.col("_applied"), F.col("_texts"), F.col("_prior")))
    )
    return summed.select("batch_id", message.alias("message"))


def batch_totals(receipts: DataFrame) -> DataFrame:
    """A-01, A-02, A-03: exact sum in cents, count and progress per batch."""
    total = F.count(F.lit(1))
    done = F.count("cents")
    return receipts.groupBy("batch_id").agg(
        F.sum(F.coalesce(F.col("cents"), F.lit(0)).cast("decimal(38,0)")).alias("total_cents"),
        total.alias("receipts"),
        done.alias("with_amount"),
        F.when(total > 0, done / total).otherwise(F.lit(0.0)).alias("progress"),
    )


def first_pending(receipts: DataFrame) -> DataFrame:
    """T-05: the pending receipt that comes first in visual order, per batch."""
    return receipts.filter(F.col("status") == fixed.PENDING).groupBy("batch_id").agg(
        F.min(F.struct("ord", "receipt_id"))["receipt_id"].alias("receipt_id")
    )


def settle(receipts: DataFrame) -> DataFrame:
    """R-02: status after reading the pending, live receipts; all others stay as they are.

    ``ocr_error`` marks a poisoned item: it ends in error without text and amount, its
    siblings go on; nothing raises inside a task.  A total found is set under the
    guards of J-05, so a draft keeps the amount open.
    """
    mine = (F.col("status") == fixed.PENDING) & ~F.col("removed")
    failed = F.col("_mine") & F.col("ocr_error").isNotNull()
    read = (
        receipts.withColumn("_mine", F.coalesce(mine, F.lit(False)))
        .withColumn("text", F.when(failed, F.lit("")).otherwise(F.col("text")))
        .withColumn("cents", F.when(~F.col("_mine"), F.col("cents")))
        .withColumn("status", F.when(failed, fixed.FAILED).when(F.col("_mine"), fixed.DONE).otherwise(F.col("status")))
    )
    read = with_fast_total(read, "text", "_total")
    found = F.col("_mine") & may_apply(F.col("_total"), collapse_spaces(F.col("text")))
    return read.withColumn("cents", F.when(found, F.col("_total")).otherwise(F.col("cents"))).drop("_mine", "_total")
