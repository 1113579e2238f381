"""Registered queries: event-time rules over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipstack.operators import events as op
from slipstack.plans.inputs import cte, load

QUIET_MS = 6 * 3600 * 1000  # users act about every eleven hours
WAIT_MS = 36 * 3600 * 1000


def _attempts(spark, d):
    return load(spark, d, "attempts")


def _turns(spark, d):
    turned = F.when(F.col("event_type") == "click", 90).otherwise(270).cast("bigint")
    return _attempts(spark, d).filter("event_type <> 'purchase'").select("user_id", "ts", "event_id", turned.alias("deg"))


def _sessions(spark, d):
    return op.quiet_sessions(_turns(spark, d), "user_id", QUIET_MS, ["event_id"])


def _shown(sessions):
    return sessions.select(
        "user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("last_turn").alias("last_us"), "turns", "degrees"
    )


def r03(spark, d):
    return _shown(_sessions(spark, d))


def r04(spark, d):
    commits = _attempts(spark, d).filter("event_type = 'purchase'").select("user_id", "ts")
    return _shown(
        op.cancelled_by_commit(_sessions(spark, d), _turns(spark, d), commits, "user_id", QUIET_MS)
    )


def r09(spark, d):
    tries = _attempts(spark, d).select("event_id", "user_id", "ts", "failed")
    return op.strikes(tries, "user_id").select("event_id", "strike", "evicts")


def r10(spark, d):
    tries = _attempts(spark, d).select("event_id", "user_id", "ts", "failed")
    return op.cooldown(tries, "user_id", WAIT_MS).select("event_id", "tried")


def r12(spark, d):
    tries = _attempts(spark, d).select("event_id", "user_id", "ts", "failed")
    return op.alerts(tries, "user_id").select("event_id", "user_id")


def r13(spark, d):
    opened = _attempts(spark, d).select(
        "user_id", "ts", F.col("event_id").alias("seq"),
        F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 600000000)).alias("until"),
    )
    return op.open_flags(opened, "user_id").select(
        "user_id", "seq", F.col("step").cast("bigint").alias("step"), F.col("open").cast("bigint").alias("open"), "busy"
    )


QUERIES = {"R-03": r03, "R-04": r04, "R-09": r09, "R-10": r10, "R-12": r12, "R-13": r13}

A = cte("attempts").rstrip()
TURNS = A + """, turns AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN event_type = 'click' THEN 90 ELSE 270 END AS deg FROM attempts WHERE event_type <> 'purchase'),
 stepped AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS prev FROM turns),
 numbered AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS n FROM stepped),
 sess AS (SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS turns, CAST(sum(deg) % 360 AS BIGINT) AS degrees FROM numbered GROUP BY user_id, n)"""
STRIKES = A + """, o AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM attempts),
        p AS (SELECT event_id, epoch_us(ts) AS us, failed, row_number() OVER (PARTITION BY user_id, run, failed ORDER BY ts) AS pos FROM o)"""
STRIKE = "event_id, CASE WHEN failed THEN (pos - 1) % 2 + 1 END AS strike, failed AND pos % 2 = 0 AS evicts"
COOLED = A.replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT event_id, user_id, epoch_us(ts) AS us, failed, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM attempts),
        w AS (SELECT event_id, user_id, us, k, true AS tried, CASE WHEN failed THEN us + {WAIT_MS * 1000} ELSE 0 END AS cold FROM o WHERE k = 1
          UNION ALL SELECT o.event_id, o.user_id, o.us, o.k, o.us >= w.cold, CASE WHEN o.us < w.cold THEN w.cold WHEN o.failed THEN o.us + {WAIT_MS * 1000} ELSE 0 END
          FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)"""
EDGES = A + ", o AS (SELECT event_id, user_id, epoch_us(ts) AS us, failed, lag(failed) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM attempts)"
MOVES = A + """, m AS (SELECT user_id, epoch_us(ts) AS us, event_id AS seq, 1 AS step FROM attempts
          UNION ALL SELECT user_id, epoch_us(ts) + CAST(floor(value * 600000000) AS BIGINT), event_id, -1 FROM attempts),
        c AS (SELECT *, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY us, seq, step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open FROM m)"""
ORACLES = {
    "R-03": TURNS + " SELECT * FROM sess",
    "R-04": TURNS + """ SELECT * FROM sess s WHERE NOT EXISTS (SELECT 1 FROM attempts c WHERE c.user_id = s.user_id AND event_type = 'purchase'
        AND epoch_us(c.ts) > last_us AND epoch_us(c.ts) <= last_us + 21600000000)""",
    "R-09": STRIKES + f" SELECT {STRIKE} FROM p",
    "R-10": COOLED + " SELECT event_id, tried FROM w",
    "R-12": EDGES + " SELECT event_id, user_id FROM o WHERE failed AND was IS DISTINCT FROM true",
    "R-13": MOVES + " SELECT user_id, seq, step, open, open > 0 AS busy FROM c",
}
