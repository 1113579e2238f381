"""R-03 and R-04 as streams: one re-read per receipt after a quiet time, unless a crop commits first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipstack import fixed


def quiet_sessions(turns: DataFrame, key: str, gap_ms: int = fixed.QUIET_MS, delay_ms: int = 10_000) -> DataFrame:
    """R-03: a stream of turns (``key, ts, deg``) to closed sessions ``key, session_start, last_turn, turns, degrees, due``.

    A session comes out once the watermark has passed its end, one gap after its last turn; ``due`` still carries the
    watermark. Turns behind the watermark are dropped, as everywhere in Spark's windows, and counted in the progress
    of the query (``numRowsDroppedByWatermark``); turns without a time are in no session.
    """
    timed = turns.withWatermark("ts", f"{delay_ms} milliseconds")
    found = timed.groupBy(key, F.session_window("ts", f"{gap_ms} milliseconds").alias("session_window")).agg(
        F.max("ts").alias("last_turn"), F.count(F.lit(1)).alias("turns"), F.pmod(F.sum("deg"), F.lit(360)).alias("degrees")
    )
    return found.select(
        key, F.col("session_window.start").alias("session_start"), "last_turn", "turns", "degrees", F.window_time("session_window").alias("due")
    )


def uncancelled(
    turns: DataFrame, commits: DataFrame, key: str, gap_ms: int = fixed.QUIET_MS, delay_ms: int = 10_000
) -> DataFrame:
    """R-04: sessions whose re-read no commit (``key, ts``) overtook, as a left outer join of two streams.

    A commit after the last turn and at most one gap later cancels. Both sides have a watermark and the condition
    bounds their distance, so each side is kept for one gap and the delay only.
    """
    sessions = quiet_sessions(turns, key, gap_ms, delay_ms)
    done = commits.select(F.col(key).alias("_key"), F.col("ts").alias("_commit")).withWatermark("_commit", f"{delay_ms} milliseconds")
    gap = F.expr(f"INTERVAL {gap_ms} MILLISECONDS")
    # ``due`` is a microsecond before the end of the session.
    near = (F.col("_commit") >= F.col("due") - gap) & (F.col("_commit") <= F.col("due") + F.expr("INTERVAL 1 MICROSECOND"))
    after = F.col("_commit") > F.col("last_turn")
    met = sessions.join(done, (F.col(key) == F.col("_key")) & near & after, "leftOuter")
    return met.where(F.col("_commit").isNull()).select(key, "session_start", "last_turn", "turns", "degrees")
