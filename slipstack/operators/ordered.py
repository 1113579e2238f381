"""Ordered per-key computations that survive one huge key.

A plain window over ``partitionBy(key)`` sends a whole key to one task.  Keys are counted
first.  Without a large one the plain window is all there is.  A large key is cut into
buckets of about equal size at order values drawn from its own rows, so that sparse
numbers, dense numbers and a burst at one moment are cut alike; ties are split by the
last order column.  The window runs per bucket, and only one summary row per bucket is
ever put in order over the whole key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipstack.session import cut_lineage

# Keys with more rows than this are cut; one such key takes this many rows of input.
HOT_ROWS = 1_000_000
# Rows drawn from a large key for its cut points, on average.
DRAWN = 4096
MOST_BUCKETS = 1024
# Large keys whose cut points are broadcast; with more of them they are joined by shuffle.
MOST_BROADCAST = 10_000


@dataclass(frozen=True)
class Cuts:
    """Cut points of the large keys (``keys, _cuts``) and how many keys there are."""

    table: DataFrame | None
    count: int


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys, where null meets null."""
    renamed = right.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate(keys)})
    same = [left[k].eqNullSafe(renamed[f"_k_{i}"]) for i, k in enumerate(keys)]
    met = left.join(renamed, reduce(lambda a, b: a & b, same), how)
    return met.drop(*[f"_k_{i}" for i in range(len(keys))])


def _attach(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of each key, by plain equality so that rows stay dealt as they are for the window.

    The facts of a single null key are one row, which is broadcast.
    """
    if len(keys) > 1:
        return _meet(rows, per_key, keys, "left")
    facts = [c for c in per_key.columns if c not in keys]
    met = rows.join(per_key, keys, "left")
    of_null = per_key.filter(F.col(keys[0]).isNull()).select(*[F.col(c).alias(f"_z_{c}") for c in facts]).limit(1)
    both = met.join(F.broadcast(of_null), F.col(keys[0]).isNull(), "left")
    return both.withColumns({c: F.coalesce(c, f"_z_{c}") for c in facts}).drop(*[f"_z_{c}" for c in facts])


def cut_points(df: DataFrame, keys: list[str], order: list[str]) -> Cuts:
    """Count the keys and draw cut points for the large ones; runs a job."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > HOT_ROWS)
    n = counts.count()
    if not n:
        return Cuts(None, 0)
    large = cut_lineage(counts)
    rows = _meet(df.select(*keys, F.struct(*order).alias("_o")), F.broadcast(large) if n <= MOST_BROADCAST else large, keys, "inner")
    every = F.greatest(F.lit(1), F.floor(F.col("_rows") / DRAWN))
    drawn = rows.filter(F.pmod(F.xxhash64("_o"), every) == 0)
    points = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list("_o")).alias("_p"), F.max("_rows").alias("_rows"))
    buckets = F.least(F.lit(MOST_BUCKETS), F.floor(F.col("_rows") / HOT_ROWS) + 1, F.size("_p"))
    picked = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), buckets - 1)),
        lambda i: F.get("_p", F.floor(i * F.size("_p") / F.greatest(F.lit(1), buckets)).cast("int")),
    )
    return Cuts(cut_lineage(points.select(*keys, picked.alias("_cuts"))), n)


def with_buckets(df: DataFrame, keys: list[str], order: list[str], cuts: Cuts) -> DataFrame:
    """Adds ``_bucket``, which grows along the order of a large key; null for small keys."""
    table = F.broadcast(cuts.table) if cuts.count <= MOST_BROADCAST else cuts.table
    here = F.struct(*order)
    bucket = F.size(F.filter("_cuts", lambda c: c <= F.col("_here_o"))).cast("bigint")
    met = _meet(df.withColumn("_here_o", here), table, keys, "left")
    return met.withColumn("_bucket", F.when(F.col("_cuts").isNotNull(), bucket)).drop("_cuts", "_here_o")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    rank: str | None = None,
    count: str | None = None,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    per_key: DataFrame | None = None,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Add running values of ``keys`` in ``order``.

    ``rank`` is 1-based, ``count`` is the size of the key, ``sums`` include the current
    row, ``maxes`` also its ties, ``previous`` reads the row before.  Null order values
    come first, null keys are a key.  ``per_key`` (one row per key) is attached through the
    bucket summaries, so that a hot key does not become a hot join key.  ``cuts`` saves
    the counting when the cut points are already known.
    """
    sums, maxes, previous = sums or {}, maxes or {}, previous or {}
    for name, column in {**sums, **maxes, **previous}.items():
        df = df.withColumn(f"_in_{name}", column)
    cuts = cut_points(df, keys, order) if cuts is None else cuts
    spread = cuts.table is not None
    unit = [*keys, "_bucket"] if spread else keys
    if spread:
        df = with_buckets(df, keys, order, cuts).repartition(*unit)

    inside = Window.partitionBy(*unit).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("_row", F.row_number().over(inside))
    if count:
        out = out.withColumn("_here", F.count(F.lit(1)).over(Window.partitionBy(*unit)))
    for n in sums:
        out = out.withColumn(f"_in_{n}", F.sum(f"_in_{n}").over(upto))
    for n in maxes:
        # The default frame takes in the ties of the current row.
        out = out.withColumn(f"_in_{n}", F.max(f"_in_{n}").over(inside))
    for n in previous:
        out = out.withColumn(f"_in_{n}", F.lag(f"_in_{n}").over(inside))
    before_key, all_key = F.lit(0), F.col("_here")
    carried_sum = {n: F.lit(0) for n in sums}
    carried_max = {n: F.lit(None) for n in maxes}
    carried_last = {n: F.lit(None) for n in previous}
    helpers = ["_bucket", "_row", "_here", *[f"_in_{n}" for n in (*sums, *maxes, *previous)]]
    if spread:
        summary = _summaries(df.filter(F.col("_bucket").isNotNull()), keys, order, sums, maxes, previous)
        if per_key is not None:
            summary = _meet(summary, per_key, keys, "left")
            small = _meet(per_key, cuts.table.select(*keys), keys, "left_anti").withColumn("_bucket", F.lit(None).cast("bigint"))
            summary = summary.unionByName(small, allowMissingColumns=True)
        out = _meet(out, summary, unit, "left")
        before_key, all_key = F.coalesce("_before", F.lit(0)), F.coalesce("_all", F.col("_here") if count else F.lit(0))
        carried_sum = {n: F.coalesce(f"_s_{n}", F.lit(0)) for n in sums}
        carried_max = {n: F.col(f"_m_{n}") for n in maxes}
        carried_last = {n: F.col(f"_p_{n}") for n in previous}
        helpers += ["_before", "_all", *[f"_s_{n}" for n in sums], *[f"_m_{n}" for n in maxes], *[f"_p_{n}" for n in previous]]
    elif per_key is not None:
        out = _attach(out, per_key, keys)
    if rank:
        out = out.withColumn(rank, (before_key + F.col("_row")).cast("bigint"))
    if count:
        out = out.withColumn(count, all_key)
    for n in sums:
        out = out.withColumn(n, carried_sum[n] + F.coalesce(F.col(f"_in_{n}"), F.lit(0)))
    for n in maxes:
        out = out.withColumn(n, F.greatest(carried_max[n].cast(out.schema[f"_in_{n}"].dataType), F.col(f"_in_{n}")))
    for n in previous:
        out = out.withColumn(n, F.when(F.col("_row") == 1, carried_last[n]).otherwise(F.col(f"_in_{n}")))
    return out.drop(*helpers)


def _summaries(df: DataFrame, keys: list[str], order: list[str], sums: dict, maxes: dict, previous: dict) -> DataFrame:
    """What the earlier buckets of a large key carry into each bucket."""
    last = F.struct(*order)
    aggregates = [F.count(F.lit(1)).alias("_n")]
    aggregates += [F.sum(f"_in_{n}").alias(f"_s_{n}") for n in sums]
    aggregates += [F.max(f"_in_{n}").alias(f"_m_{n}") for n in maxes]
    aggregates += [F.max_by(F.struct(f"_in_{n}"), last).alias(f"_p_{n}") for n in previous]
    found = df.groupBy(*keys, "_bucket").agg(*aggregates)
    chain = Window.partitionBy(*keys).orderBy("_bucket")  # a bucket each: a thousand rows at most
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum("_n").over(before).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all")]
    carried += [F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums]
    carried += [F.max(f"_m_{n}").over(before).alias(f"_m_{n}") for n in maxes]
    carried += [F.lag(f"_p_{n}").over(chain)[f"_in_{n}"].alias(f"_p_{n}") for n in previous]
    return found.select(*keys, "_bucket", *carried)


def sessions(
    df: DataFrame, key: str, ts: str, gap_us: int, start: str, seq: list[str] | None = None, cuts: Cuts | None = None
) -> DataFrame:
    """Gap-separated sessions: adds the first timestamp of the row's session.

    Two rows exactly one gap apart share a session.  ``seq`` orders equal timestamps,
    which does not change the sessions but lets a burst at one moment be cut.
    """
    order = [ts, *(seq or [])]
    micros, cuts = F.unix_micros(F.col(ts)), cuts or cut_points(df, [key], order)
    stepped = running(df, [key], order, previous={"_before_us": micros}, cuts=cuts)
    opens = F.col("_before_us").isNull() | (micros - F.col("_before_us") > gap_us)
    stepped = stepped.withColumn("_opens", F.when(opens, F.col(ts)))
    return running(stepped, [key], order, maxes={start: F.col("_opens")}, cuts=cuts).drop("_before_us", "_opens")
