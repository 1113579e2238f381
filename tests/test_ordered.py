from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slipstack.operators import ordered
from slipstack.operators.ordered import cut_points, running, with_buckets


@pytest.mark.parametrize("hot", [20, 10**9])
def test_running_equals_plain_windows_with_one_hot_key(rows, monkeypatch, hot):
    """The same with and without large keys, with null keys, null order values and ties."""
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    rng = random.Random(7)
    keys = ["hot"] * 6 + [None] * 3 + [f"k{i}" for i in range(5)]
    data = [(rng.choice(keys), rng.choice([None, 1, 1, i]), i, rng.choice([None, 1, 2, 5])) for i in range(0, 3000, 3)]
    df = rows(data, "k string, seq bigint, id bigint, v int").repartition(6)
    got = running(
        df, ["k"], ["seq", "id"], rank="rank", count="n",
        sums={"total": F.col("v")}, maxes={"top": F.col("v")}, previous={"before": F.col("v")},
        per_key=rows([("hot", 7), (None, 8), ("k1", 9)], "k string, room bigint"),
    )
    w = Window.partitionBy("k").orderBy("seq", "id")
    want = (
        df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k")))
        .withColumn("rank", F.row_number().over(w).cast("bigint"))
        .withColumn("total", F.coalesce(F.sum("v").over(w), F.lit(0)))
        .withColumn("top", F.max("v").over(w))
        .withColumn("before", F.lag("v").over(w))
        .withColumn("room", F.when(F.col("k") == "hot", 7).when(F.col("k").isNull(), 8).when(F.col("k") == "k1", 9))
    )
    names = ["k", "seq", "id", "v", "n", "rank", "total", "top", "before", "room"]
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(map(tuple, want.select(names).collect()), key=repr)


@pytest.mark.parametrize("spread", [1, 5000, 0])
def test_buckets_of_a_large_key_are_even(rows, monkeypatch, spread):
    """Dense numbers, sparse numbers, and a burst at one moment."""
    monkeypatch.setattr(ordered, "HOT_ROWS", 200)
    start = dt.datetime(2024, 1, 1)
    data = [("a", start + dt.timedelta(seconds=i * spread), i) for i in range(4000)] + [("b", start, i) for i in range(100)]
    df = rows(data, "k string, ts timestamp, id bigint").repartition(5)
    cuts = cut_points(df, ["k"], ["ts", "id"])
    found = with_buckets(df, ["k"], ["ts", "id"], cuts)
    sizes = [r["count"] for r in found.where("k = 'a'").groupBy("_bucket").count().collect()]
    assert cuts.count == 1 and len(sizes) >= 15 and max(sizes) <= 0.1 * 4000
    assert {r[0] for r in found.where("k = 'b'").select("_bucket").collect()} == {None}


def test_per_key_values_ride_on_the_summaries(rows):
    df = rows([("a", i) for i in range(30)] + [("b", 1)], "k string, seq bigint")
    extra = rows([("a", 99)], "k string, room bigint")
    got = running(df, ["k"], ["seq"], rank="rank", per_key=extra)
    assert {(r.k, r.rank, r.room) for r in got.collect()} == {("a", i + 1, 99) for i in range(30)} | {("b", 1, None)}
