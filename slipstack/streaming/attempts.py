"""R-09, R-10 and R-12 as a stream: strikes, cooldown and alerts over slices of a key."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.operators.events import FREE, exits, sorted_by, whole_groups
from slipstack.streaming.slices import Rule


class Watch(Rule):
    """The run of failures, the cooldown and whether the last attempt failed."""

    fields = "failed boolean"
    summary = "fails bigint, clean boolean, down boolean, enters array<bigint>, leaves array<bigint>"
    state = "run bigint, cold bigint, was_down boolean"
    start = (0, FREE, False)

    def __init__(self, wait_ms: int = fixed.COOLDOWN_MS):
        self.wait = wait_ms * 1000

    def sums(self, rows: list[tuple]) -> tuple:
        ts, failed = [r[0] for r in rows], [bool(r[2]) for r in rows]
        fails = next((i for i, bad in enumerate(reversed(failed)) if not bad), len(failed))
        left = exits(ts, failed, self.wait)
        stop = min(len(ts), bisect_left(ts, ts[0] + self.wait) + 1)
        kept = [i for i in range(stop) if i + 1 == stop or left[i] != left[i + 1]]
        return fails, fails == len(failed), failed[-1], [ts[i] for i in kept], [left[i] for i in kept]

    def after(self, state: tuple, summary: tuple) -> tuple:
        run, cold, _ = state
        fails, clean, down, enters, leaves = summary
        at = bisect_left(enters, cold)
        return fails + (run if clean else 0), leaves[at] if at < len(leaves) else cold, down


def attempts_stream(attempts: DataFrame, key: str, seq: str = "event_id") -> DataFrame:
    """Attempts (``key, ts, failed, seq``) as the slices take them; an attempt without an outcome counts as good."""
    failed = F.coalesce("failed", F.lit(False)).alias("failed")
    return attempts.select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("us"), F.col(seq).alias("seq"), failed)


def watched(sealed: DataFrame, wait_ms: int = fixed.COOLDOWN_MS, limit: int = fixed.STRIKES) -> DataFrame:
    """``key, seq, strike, evicts, tried, alert`` of sealed rows, each slice walked once from the state it began with."""
    wait = wait_ms * 1000

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cuts in whole_groups(frames, ["key", "slice"]):
            stamps, flags = frame["us"].tolist(), frame["failed"].tolist()
            runs, colds, downs = frame["run"].tolist(), frame["cold"].tolist(), frame["was_down"].tolist()
            out = []
            for a, b in cuts:
                run, cold, down = runs[a], colds[a], downs[a]
                for us, failed in zip(stamps[a:b], flags[a:b]):
                    tried = us >= cold
                    if tried:
                        cold = us + wait if failed else FREE
                    run = run + 1 if failed else 0
                    strike = (run - 1) % limit + 1 if failed else None
                    out.append((strike, strike == limit, tried, failed and not down))
                    down = failed
            told = pd.DataFrame(out, columns=["strike", "evicts", "tried", "alert"], index=frame.index)
            yield pd.concat([frame[["key", "seq"]], told.astype({"strike": "Int64"})], axis=1)

    kinds = {c: sealed.schema[c].dataType.simpleString() for c in ("key", "seq")}
    schema = f"key {kinds['key']}, seq {kinds['seq']}, strike bigint, evicts boolean, tried boolean, alert boolean"
    return sorted_by(sealed, ["key", "slice"], ["us", "seq"]).mapInPandas(walk, schema)
