"""Greedy decoding of class-score sequences.

A line is one row: the flat ``[steps, classes]`` scores as ``array<float>``, as the
recogniser hands them over.  Arg-max, collapsing and scoring are array functions
inside that row, so decoding needs no shuffle however many lines there are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shape_fits(scores: Column, steps: Column, classes: Column) -> Column:
    """F-20: at least one step, an even split, one class per dictionary entry."""
    return F.coalesce(
        (steps >= 1) & (F.size(scores) % F.greatest(steps, F.lit(1)) == 0)
        & (F.size(scores) == steps * classes),
        F.lit(False),
    )


def step_classes(scores: Column, steps: Column, classes: Column) -> Column:
    """Best class (first on ties) and its score for every step."""
    return F.transform(
        F.sequence(F.lit(0), steps - 1),
        lambda t: F.transform(
            F.array(F.slice(scores, t * classes + 1, classes)),
            lambda part: F.struct(
                (F.array_position(part, F.array_max(part)) - 1).cast("int").alias("c"),
                F.array_max(part).cast("double").alias("v"),
            ),
        )[0],
    )


def collapse(best: Column) -> Column:
    """W-05: drop class 0 and repeats of the step just before."""
    return F.filter(
        best,
        lambda s, t: (s["c"] != 0)
        & ((t == 0) | (s["c"] != F.get(best, t - 1)["c"])),
    )


def decode(lines: DataFrame, dictionary: list[str], scores: str = "scores", steps: str = "steps") -> DataFrame:
    """F-20, W-05 and J-08 together: adds ``text`` and ``score``.

    The dictionary travels as one constant array (18 710 entries at most).  Lines
    whose shape does not fit give empty text and score 0.
    """
    symbols = F.from_json(F.lit(json.dumps(dictionary)), "array<string>")
    classes = F.lit(len(dictionary))
    fits = shape_fits(F.col(scores), F.col(steps), classes)
    staged = lines.withColumn(
        "_best", F.when(fits, step_classes(F.col(scores), F.col(steps), classes))
    ).withColumn("_kept", collapse(F.col("_best")))
    text = F.array_join(F.transform("_kept", lambda s: F.get(symbols, s["c"])), "")
    total = F.aggregate("_kept", F.lit(0.0), lambda acc, s: acc + s["v"])
    return (
        staged.withColumn("text", F.coalesce(text, F.lit("")))
        .withColumn(
            "score", F.when(F.size("_kept") > 0, total / F.size("_kept")).otherwise(F.lit(0.0))
        )
        .drop("_best", "_kept")
    )


def best_classes_of_rows(cells: DataFrame) -> DataFrame:
    """Long form: one row per (line, step) out of (line, step, class, value)."""
    top = F.max(F.struct(F.col("value"), (-F.col("class")).alias("n")))
    return cells.groupBy("line_id", "step").agg(
        (-top["n"]).alias("class"), top["value"].alias("value")
    )


def decode_rows(best: DataFrame, dictionary: DataFrame, lines: DataFrame) -> DataFrame:
    """W-05 and J-08 in long form, for score tables stored one row per step.

    One row for each of ``lines(line_id)``: a line without kept steps has no text and
    score 0.  Windows and lists are per line; a line has a few hundred steps at most.
    The dictionary join is left to Spark, which broadcasts it while it is small.
    """
    along = Window.partitionBy("line_id").orderBy("step")
    kept = best.withColumn("_prev", F.lag("class").over(along)).filter(
        (F.col("class") != 0) & ~F.col("class").eqNullSafe(F.col("_prev"))
    )
    named = kept.join(dictionary, "class")
    ordered = F.array_sort(F.collect_list(F.struct("step", "symbol")))
    found = named.groupBy("line_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["symbol"]), "").alias("text"),
        F.avg("value").alias("score"),
    )
    return lines.select("line_id").join(found, "line_id", "left").select(
        "line_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
