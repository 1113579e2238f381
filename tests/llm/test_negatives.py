from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipstack.llm import negatives


def plain(rows, asked, positives=5, negatives=5, least=80, most=100):
    usable = sorted(
        {
            (i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
            for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
        }
    )
    found = []
    for i, label, q in usable:
        if not asked(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j, other) for j, other, v in usable if j != i)
        for ps, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(s, j) for s, j, other in scored if other != label and least * -ps <= 100 * -s <= most * -ps][:negatives]
            found += [(i, p, r + 1, j, -ps, -s) for r, (s, j) in enumerate(fits)]
    return sorted(found)


def mined(spark, rows, asked, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"anchor": F.lit("clash"), "v": F.lit(0), "rank": F.lit(1)})
    found = negatives.integers(df)
    return sorted(map(tuple, negatives.hard_negatives(found, found.where(asked), **how).collect()))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(negatives.build, "__defaults__", (32,))
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    monkeypatch.setattr(negatives, "MOST_BROADCAST", 100)


def test_against_all_products(spark, small):
    draw = random.Random(5)
    centres = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x * scale + draw.gauss(0, 0.2) for x in draw.choice(centres)], draw.randrange(4)) for i in range(400) for scale in [draw.choice([0.2, 1, 3])]]
    same = [0.5, -0.25] * 4
    rows += [(1000 + i, same, i % 2) for i in range(120)]  # a common vector: ties by id
    rows += [(2000, None, 1), (2001, [None] * 8, 1), (2002, [math.nan] * 8, 1), (2003, [math.inf] + [0.0] * 7, 1), (2004, same, None), (None, same, 1)]
    rows += [(2005, [], 1), (2006, [0.0] * 8, 1), (2007, [9e5] * 8, 1), (2010, [0.1, 0.2], 2), (2011, [0.1] * 12, 2)]
    rows += [rows[10], rows[10], (1000, same, 1)]  # repeated, and one id with two labels
    assert mined(spark, rows, "vec_id % 20 = 0") == plain(rows, lambda i: i % 20 == 0)
    how = {"positives": 2, "negatives": 3, "least": 50, "most": 90}
    assert mined(spark, rows[:200], "vec_id % 50 = 0", **how) == plain(rows[:200], lambda i: i % 50 == 0, **how)


def test_few_rows(spark):
    rows = [(0, [0.1, 0.2], 1), (1, [0.3, 0.1], 1), (2, [0.1, 0.19], 2), (3, [-1.0, -1.0], 2)]
    assert mined(spark, rows, "vec_id = 0") == plain(rows, lambda i: i == 0) != []
    assert mined(spark, rows[:1], "true") == []
    assert mined(spark, rows, "vec_id > 99") == []


def test_pruning_keeps_what_can_reach_the_score():
    draw = np.random.default_rng(1)
    vectors = draw.normal(0, 100, (500, 16)).astype(np.int64)
    vectors[:40] = draw.normal(0, 5, (40, 16)) + vectors[499]
    lengths, unit = negatives.units(vectors)
    orders = np.argsort(unit, axis=0).T
    pruned = 0
    for q in vectors[::7]:
        scores = vectors @ q
        for share in (0.2, 0.5, 0.8, 1.0, 1.2):
            least = int(scores.max() * share)
            found = negatives.hopeful(unit, orders, lengths.max(), q.astype(float), least)
            assert set(np.flatnonzero(scores >= least)) <= set(found)
            pruned += len(found) < len(vectors)
    assert pruned > 200
