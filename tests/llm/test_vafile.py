from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from slipstack.llm import vafile


def plain(rows, asked, k):
    """Full sorting of all products."""
    found = []
    usable = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable[(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v))] = True
    for i, q in usable:
        if not asked(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in usable if j != i)[:k]
        found += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(found)


def search(spark, rows, k, asked):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("v", F.lit(0))
    found = vafile.integers(df)
    return sorted(map(tuple, vafile.search(found, found.where(asked), k).collect()))


def test_against_full_sorting(spark, monkeypatch):
    monkeypatch.setattr(vafile.build, "__defaults__", (64,))
    monkeypatch.setattr(vafile, "QUERIES", 4)
    draw = random.Random(1)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    same = [0.5, -0.25] * 4
    rows += [(1000 + i, same) for i in range(90)]  # a common vector: ties by id
    rows += [(2000, None), (2001, [None] * 8), (2002, [math.nan] * 8), (2003, [math.inf] + [0.0] * 7), (None, same), (2004, []), (2005, [9e5] * 8)]
    rows += [rows[3], rows[100]]
    assert search(spark, rows, 10, "vec_id % 10 = 0") == plain(rows, lambda i: i % 10 == 0, 10)


def test_few_rows_and_no_rows(spark):
    rows = [(0, [0.1, 0.2]), (1, [0.3, -0.1]), (2, [0.0, 0.0])]
    assert search(spark, rows, 10, "vec_id % 2 = 0") == plain(rows, lambda i: i % 2 == 0, 10)
    assert search(spark, rows[:1], 10, "true") == []
    assert search(spark, rows, 10, "vec_id > 99") == []


def test_bounds_hold():
    draw = np.random.default_rng(2)
    found = draw.integers(-1000, 1000, (300, 12))
    asked = draw.integers(-1000, 1000, (20, 12))
    low, high = vafile.bounds(asked, *vafile.approximate(found, 16))
    exact = asked @ found.T
    assert (low <= exact).all() and (exact <= high).all()
