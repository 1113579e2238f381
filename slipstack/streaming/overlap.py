"""R-13 as a stream: how many intakes of a key are open, over slices of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipstack.streaming.slices import Rule


class OpenCount(Rule):
    """The number of open intakes; a closing waits for the timer of the slice in which it falls."""

    fields = "step bigint"
    summary = "moved bigint"
    state = "before bigint"
    start = (0,)

    def sums(self, rows: list[tuple]) -> tuple:
        return (sum(r[2] for r in rows),)

    def after(self, state: tuple, summary: tuple) -> tuple:
        return (state[0] + summary[0],)


def moves_stream(intakes: DataFrame, key: str) -> DataFrame:
    """Intakes (``key, ts, until, seq``) as openings and closings; both come with the intake."""
    move = lambda at, step: F.struct(F.unix_micros(at).alias("us"), F.lit(step).cast("bigint").alias("step"))
    return intakes.select(F.col(key).alias("key"), "ts", "seq", F.explode(F.array(move("ts", 1), move("until", -1))).alias("m")).select(
        "key", "ts", "m.us", "seq", "m.step"
    )


def open_flags(sealed: DataFrame) -> DataFrame:
    """``key, seq, step, open, busy``: the running count inside each slice on top of the count that it began with."""
    inside = Window.partitionBy("key", "slice").orderBy("us", "seq", "step").rowsBetween(Window.unboundedPreceding, 0)
    counted = sealed.withColumn("open", F.col("before") + F.sum("step").over(inside))
    return counted.select("key", "seq", "step", "open", (F.col("open") > 0).alias("busy"))
