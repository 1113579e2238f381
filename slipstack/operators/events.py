"""Event-time rules over logs: debounce, cancel, last editor, strikes, cooldown, alerts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.functions.amounts import collapse_spaces, has_text, parse_amount, well_formed, with_fast_total
from slipstack.operators.extraction import may_apply
from slipstack.operators.ordered import cut_points, running, sessions, with_buckets
from slipstack.session import cut_lineage


def quiet_sessions(turns: DataFrame, key: str, gap_ms: int = fixed.QUIET_MS, seq: list[str] | None = None) -> DataFrame:
    """R-03: turns (``key, ts, deg``) joined while the pause is at most the gap.

    One re-read per session, due one gap after its last turn; degrees add up.
    """
    marked = sessions(turns, key, "ts", gap_ms * 1000, "session_start", seq)
    return marked.groupBy(key, "session_start").agg(
        F.max("ts").alias("last_turn"),
        F.count(F.lit(1)).alias("turns"),
        F.pmod(F.sum("deg"), F.lit(360)).alias("degrees"),
    )


def cancelled_by_commit(
    session_table: DataFrame, turns: DataFrame, commits: DataFrame, key: str,
    gap_ms: int = fixed.QUIET_MS, seq: list[str] | None = None,
) -> DataFrame:
    """R-04: sessions whose pending re-read was not overtaken by a crop commit.

    A commit cancels what the turn just before it had scheduled, if that is still
    pending.  Finding that turn is a running maximum, so the interval condition
    becomes an equality and no pairs are enumerated.
    """
    both = turns.select(key, "ts", F.col("ts").alias("_turn")).unionByName(
        commits.select(key, "ts", F.lit(None).cast("timestamp").alias("_turn"))
    )
    followed = running(both, [key], ["ts"], maxes={"_seen": F.col("_turn")})
    hits = followed.filter(
        F.col("_turn").isNull()
        & (F.unix_micros("ts") > F.unix_micros("_seen"))
        & (F.unix_micros("ts") - F.unix_micros("_seen") <= gap_ms * 1000)
    ).select(key, F.col("_seen").alias("last_turn"))
    return session_table.join(hits, [key, "last_turn"], "left_anti")


def last_editor(edits: DataFrame, key: str, value: str) -> DataFrame:
    """R-05: the value of the latest edit per key; ties by sequence number."""
    return edits.groupBy(key).agg(F.max_by(value, F.struct("ts", "seq")).alias(value))


def reread(receipts: DataFrame, results: DataFrame) -> DataFrame:
    """R-06: effect of a re-read (``receipt_id, new_text``, null text = it failed) on live receipts.

    The old text never survives.  A manual amount does; any other is given up and, after
    a reading that worked, set again under the guards of J-05: a draft keeps it open.
    Removed receipts stay as they are.  Of several re-reads of a receipt one that
    worked counts, the smallest text first.
    """
    once = results.groupBy("receipt_id").agg(F.min("new_text").alias("new_text"))
    joined = receipts.join(once.withColumn("_read", F.lit(True)), "receipt_id", "left")
    hit = F.coalesce(F.col("_read") & ~F.col("removed"), F.lit(False))
    renewed = (
        joined.withColumn("_hit", hit)
        .withColumn("text", F.when(F.col("_hit"), well_formed(F.col("new_text"))).otherwise(F.col("text")))
        .withColumn("status", F.when(F.col("_hit"), F.lit(fixed.DONE)).otherwise(F.col("status")))
        .withColumn("cents", F.when(~F.col("_hit") | F.col("manual"), F.col("cents")))
    )
    renewed = with_fast_total(renewed, "text", "_total")
    reopened = F.col("_hit") & ~F.col("manual") & may_apply(F.col("_total"), collapse_spaces(F.col("text")))
    return renewed.withColumn("cents", F.when(reopened, F.col("_total")).otherwise(F.col("cents"))).drop(
        "_read", "_hit", "_total", "new_text"
    )


def manual_edits(edits: DataFrame, key: str) -> DataFrame:
    """R-07: per receipt the latest valid amount and a draft left by an invalid one.

    ``edits`` is ``key, ts, seq, typed``.  Only three running maxima per key travel.
    """
    cents = parse_amount(F.col("typed"))
    when = F.struct("ts", "seq")
    staged = edits.withColumn("_cents", cents)
    valid = F.max_by(
        F.when(F.col("_cents").isNotNull(), F.col("_cents")),
        F.when(F.col("_cents").isNotNull(), when),
    )
    last = F.max_by(F.struct("typed", "_cents"), when)
    return staged.groupBy(key).agg(valid.alias("cents"), last.alias("_last")).select(
        key,
        "cents",
        F.col("cents").isNotNull().alias("manual"),
        F.when(
            F.col("_last._cents").isNull() & has_text(F.col("_last.typed")),
            F.col("_last.typed"),
        ).alias("draft"),
    )


def verdicts(receipts: DataFrame, results: DataFrame) -> DataFrame:
    """R-08: what becomes of each late result, by the first rule that refuses it."""
    facts = receipts.select(
        "receipt_id",
        F.col("removed").alias("_removed"),
        F.coalesce(F.col("draft"), F.lit("")).alias("_draft"),
        F.col("cents").alias("_cents"),
        collapse_spaces(F.col("text")).alias("_now"),
    )
    verdict = (
        F.when(F.col("new_cents").isNull(), "sin-total")
        .when(F.col("_draft") != "", "borrador")
        .when(F.col("_removed").isNull() | F.col("_removed"), "quitado")
        .when(F.col("_cents").isNotNull(), "ya-tiene")
        .when(F.col("_now") != F.col("seen_text"), "rancio")
        .otherwise("aplicado")
    )
    return results.join(facts, "receipt_id", "left").select(
        "receipt_id", "new_cents", verdict.alias("verdict")
    )


def strikes(
    attempts: DataFrame, key: str, limit: int = fixed.STRIKES, seq: str = "event_id"
) -> DataFrame:
    """R-09: position in the current run of failures and whether it evicts.

    ``attempts`` is ``key, ts, failed`` and a sequence number that orders equal times.
    The position is the running count of failures less that count at the latest success.
    """
    order = ["ts", seq]
    cuts = cut_points(attempts, [key], order)
    bad = F.col("failed").cast("bigint")
    counted = running(attempts, [key], order, sums={"_fails": bad}, cuts=cuts)
    based = running(
        counted, [key], order, maxes={"_base": F.when(~F.col("failed"), F.col("_fails"))}, cuts=cuts
    )
    position = F.when(F.col("failed"), F.col("_fails") - F.coalesce(F.col("_base"), F.lit(0)))
    return based.withColumn("strike", F.when(F.col("failed"), F.pmod(position - 1, F.lit(limit)) + 1)).withColumn(
        "evicts", F.coalesce(F.col("strike") == limit, F.lit(False))
    ).drop("_fails", "_base")


def alerts(attempts: DataFrame, key: str, seq: str = "event_id") -> DataFrame:
    """R-12: only the failures that open a run raise a notice."""
    order = ["ts", seq]
    seen = running(attempts, [key], order, previous={"_was": F.col("failed")})
    return seen.filter(F.col("failed") & ~F.coalesce(F.col("_was"), F.lit(False))).drop("_was")


def open_flags(intakes: DataFrame, key: str) -> DataFrame:
    """R-13: intakes (``key, ts, until, seq``) to a stream of open counts and the flag."""
    opened = intakes.select(key, "ts", "seq", F.lit(1).alias("step"))
    closed = intakes.select(key, F.col("until").alias("ts"), "seq", F.lit(-1).alias("step"))
    moves = opened.unionByName(closed)
    out = running(
        moves, [key], ["ts", "seq", "step"], sums={"open": F.col("step")}
    )
    return out.withColumn("busy", F.col("open") > 0)


# --- cooldown ----------------------------------------------------------------
# Inside a burst the state is "cold until t".  A large key is cut into slices of about
# equal numbers of rows, so a burst at one moment is cut like one of many days;
# each slice first tells where every possible entry would leave it (most entries soon
# coincide), the slices are chained on that, and then every slice is walked once with
# its true entry.  No task holds more than one slice.


#: Not cooling down: before any time.
FREE = -(1 << 62)


def _walk(ts: list[int], failed: list[bool], cold: int, wait: int) -> tuple[np.ndarray, int]:
    tried = np.zeros(len(ts), dtype=bool)
    i = bisect_left(ts, cold)
    while i < len(ts):
        tried[i] = True
        cold = ts[i] + wait if failed[i] else FREE
        i = bisect_left(ts, cold, i + 1) if failed[i] else i + 1
    return tried, cold


def exits(ts: list[int], failed: list[bool], wait: int) -> list[int]:
    """State after the slice if the attempt at row i happens, for every i."""
    out = [FREE] * len(ts)
    for i in range(len(ts) - 1, -1, -1):
        after = ts[i] + wait if failed[i] else FREE
        j = bisect_left(ts, after, i + 1) if failed[i] else i + 1
        out[i] = out[j] if j < len(ts) else after
    return out


def whole_groups(
    frames: Iterator[pd.DataFrame], names: list[str]
) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Sorted Arrow batches recut so that no group spans two, with the group bounds."""

    def bounds(frame: pd.DataFrame) -> list[tuple[int, int]]:
        changed = np.zeros(len(frame), dtype=bool)
        changed[0] = True
        for n in names:
            values, absent = frame[n].to_numpy(), frame[n].isna().to_numpy()
            changed[1:] |= (values[1:] != values[:-1]) & ~(absent[1:] & absent[:-1])
        starts = np.flatnonzero(changed).tolist()
        return list(zip(starts, [*starts[1:], len(frame)]))

    held: pd.DataFrame | None = None
    for frame in frames:
        whole = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if whole.empty:
            continue
        cuts = bounds(whole)
        last = cuts.pop()[0]
        held = whole.iloc[last:]
        if cuts:
            yield whole.iloc[:last], cuts
    if held is not None:
        yield held, [(0, len(held))]


def _same(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on columns where null meets null; the columns of ``right`` that are joined on go."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    met = left.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]), how)
    return met.drop(*[f"_r_{c}" for c in on])


def sorted_by(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*group).sortWithinPartitions(*group, *order)


def cooldown(
    attempts: DataFrame, key: str, wait_ms: int = fixed.COOLDOWN_MS, seq: str = "event_id"
) -> DataFrame:
    """R-10: adds ``tried``: false while a failed attempt is still cooling down.

    ``attempts`` is ``key, ts, failed`` and a sequence number, unique per key, that
    orders equal times.  Refused requests do
    not extend the wait and a success clears it.  A pause of at least the wait starts
    afresh, so bursts are independent.  A null key is a key like any other; an attempt
    without a time has no place in the order and no ``tried``; one without an outcome
    counts as good.  Calling this runs jobs: the bursts are written
    to the checkpoint folder, because several steps read them.
    """
    untimed = attempts.filter(F.col("ts").isNull()).withColumn("tried", F.lit(None).cast("boolean"))
    attempts = attempts.filter(F.col("ts").isNotNull())
    wait = wait_ms * 1000
    order = ["ts", seq]
    cuts = cut_points(attempts, [key], order)
    burst = sessions(attempts, key, "ts", wait - 1, "_burst", [seq], cuts).withColumn("_us", F.unix_micros("ts"))
    if cuts.table is None:
        cut = burst.withColumn("_slice", F.lit(0).cast("bigint"))
    else:
        sliced = with_buckets(burst, [key], order, cuts)
        cut = sliced.withColumn("_slice", F.coalesce("_bucket", F.lit(0)).cast("bigint")).drop("_bucket")
    # Read four times below, after four passes to find the bursts: written once.
    cut = cut_lineage(cut)
    unit = [key, "_burst", "_slice"]
    slim = cut.select(*unit, "_us", seq, F.coalesce("failed", F.lit(False)).alias("failed"))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cuts in whole_groups(frames, unit):
            stamps, flags = frame["_us"].tolist(), frame["failed"].tolist()
            picked, entry, leaves = [], [], []
            for a, b in cuts:
                ts = stamps[a:b]
                out = exits(ts, flags[a:b], wait)
                stop = min(len(ts), bisect_left(ts, ts[0] + wait) + 1)
                # Neighbouring entries with one exit need one row, kept under the last of them.
                keep = [i for i in range(stop) if i + 1 == stop or out[i] != out[i + 1]]
                picked += [a] * len(keep)
                entry += [ts[i] for i in keep]
                leaves += [out[i] for i in keep]
            yield frame[unit].iloc[picked].assign(entry=entry, leaves=leaves)

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, cold = None, FREE
        for frame, cuts in whole_groups(frames, unit):
            owners = list(zip(frame[key].astype(object).where(frame[key].notna(), None).tolist(), frame["_burst"].tolist()))
            entries, leaves = frame["entry"].tolist(), frame["leaves"].tolist()
            colds = []
            for a, b in cuts:
                if owners[a] != current:
                    current, cold = owners[a], FREE
                colds.append(cold)
                at = bisect_left(entries, cold, a, b)
                cold = leaves[at] if at < b else cold
            yield frame[unit].iloc[[a for a, _ in cuts]].assign(cold=colds)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cuts in whole_groups(frames, unit):
            stamps, flags, colds = frame["_us"].tolist(), frame["failed"].tolist(), frame["cold"].tolist()
            tried = [_walk(stamps[a:b], flags[a:b], colds[a], wait)[0] for a, b in cuts]
            yield frame[[*unit, seq]].assign(tried=np.concatenate(tried))

    key_type = attempts.schema[key].dataType.simpleString()
    head = f"{key} {key_type}, _burst timestamp, _slice bigint"
    # Bursts that fit one slice need no chaining: they enter cold-free.
    long_bursts = slim.filter("_slice > 0").select(key, "_burst").distinct()
    if long_bursts.isEmpty():
        ready = slim.withColumn("cold", F.lit(FREE))
    else:
        probes = sorted_by(_same(slim, long_bursts, [key, "_burst"], "left_semi"), unit, ["_us", seq]).mapInPandas(
            probe, f"{head}, entry bigint, leaves bigint"
        )
        chained = sorted_by(probes, [key, "_burst"], ["_slice", "entry"]).mapInPandas(
            chain, f"{head}, cold bigint"
        )
        ready = _same(slim, chained, unit, "left").withColumn("cold", F.coalesce("cold", F.lit(FREE)))
    seq_type = attempts.schema[seq].dataType.simpleString()
    walked = sorted_by(ready, unit, ["_us", seq]).mapInPandas(walk, f"{head}, {seq} {seq_type}, tried boolean")
    done = _same(cut, walked, [*unit, seq], "inner").drop("_burst", "_slice", "_us")
    return done.unionByName(untimed)
