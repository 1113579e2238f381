from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from invented import prose
from pyspark.sql import functions as F

from slipstack.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_keeps_every_rule(sizes):
    lengths = (8, 16, 64)
    sizes = sorted(sizes, reverse=True)
    where, capacity = packing.best_fit(sizes, lengths)
    filled = [0] * len(capacity)
    for size, b in zip(sizes, where, strict=True):
        filled[b] += size
    assert all(f for f in filled)
    # each bin has the least permitted length that holds it
    assert all(c == min(x for x in lengths if x >= f) for c, f in zip(capacity, filled, strict=True))


def test_best_fit_by_hand():
    # 10 opens 16 (the cheapest for what is to come), 6 fills it exactly, 3 has a bin of 8 of its own.
    where, capacity = packing.best_fit([10, 6, 3], (8, 16), 0)
    assert (where, capacity) == ([0, 0, 1], [16, 8])
    assert packing.best_fit([], (8,)) == ([], [])


def test_the_chosen_length_follows_what_is_to_come():
    assert packing.cheapest(5, 0, (8, 64), 4) == 8
    assert packing.cheapest(5, 1000, (8, 64), 16) == 64


def test_cost_beats_single_lengths():
    draw = random.Random(1)
    sizes = sorted((min(4096, int(draw.paretovariate(1.1) * 60)) for _ in range(3000)), reverse=True)
    cost = lambda found: sum(c + packing.OVERHEAD for c in found[1])
    several = cost(packing.best_fit(sizes, packing.LENGTHS))
    assert several <= cost(packing.best_fit(sizes, (4096,)))
    assert several < sum(sizes) * 1.02 + packing.OVERHEAD * len(sizes) / 4


def test_every_token_has_one_place(spark, make_docs):
    rows = [(i, prose(i, i * 7 % 90)) for i in range(120)] + [(1000, prose(5, 700)), (1001, None), (1002, ""), (3, prose(3, 21)), (None, "a b")]
    docs = make_docs(rows).withColumn("lot", F.lit("clash")).withColumn("piece", F.lit(1))
    counted = packing.counted(docs)
    sizes = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in counted.collect())
    assert sizes == sorted((i is None, i or 0, len((t or "").split()) + 1) for i, t in rows)
    for group in (40, 100_000):
        out = packing.pack(counted, (32, 64, 256), group=group).collect()
        total: dict = {}
        bins: dict = {}
        for r in out:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            bins.setdefault(r.bin_id, []).append(r)
            assert r.start == 256 * r.piece and (r.piece == 0 or r.n_tokens >= 1)
        want: dict = {}
        for i, t in rows:
            want[i] = want.get(i, 0) + len((t or "").split()) + 1
        assert total == want
        for placed in bins.values():
            placed.sort(key=lambda r: r.bin_offset)
            at = 0
            for r in placed:
                assert r.bin_offset == at
                at += r.n_tokens
            assert {(r.bin_tokens, r.capacity) for r in placed} == {(at, min(c for c in (32, 64, 256) if c >= at))}
    again = packing.pack(counted.repartition(7), (32, 64, 256), group=40)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, packing.pack(counted, (32, 64, 256), group=40).collect()), key=str)


def test_empty_and_unusable_lengths(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, -4), (4, 5)], "doc_id long, n_tokens long")
    assert [r.doc_id for r in packing.pack(df).collect()] == [4]
    assert packing.pack(df.limit(0)).collect() == []


def test_lots_of_null_and_equal_ids_are_bounded(spark):
    rows = [(None, 3 + k % 40) for k in range(3000)] + [(7, 30)] * 2000 + [(k, 20) for k in range(100, 1100)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), (64, 128), group=500).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == sorted((i or 0, n) for i, n in rows)
    lots = {}
    for r in out:
        lots[r.bin_id >> 32] = lots.get(r.bin_id >> 32, 0) + 1
    assert len(lots) == 12 and max(lots.values()) < 700


def test_cost_against_the_best_packing_of_few_pieces():
    draw = random.Random(3)

    def best(sizes, lengths):
        """Least summed capacity by trying every way to fill bins."""
        if not sizes:
            return 0
        first, rest = sizes[0], sizes[1:]
        costs = []
        for mask in range(1 << len(rest)):
            inside = [first] + [x for k, x in enumerate(rest) if mask >> k & 1]
            fits = [c for c in lengths if c >= sum(inside)]
            if fits:
                costs.append(min(fits) + best([x for k, x in enumerate(rest) if not mask >> k & 1], lengths))
        return min(costs)

    total, least = 0, 0
    for _ in range(60):
        sizes = sorted((draw.randint(1, 20) for _ in range(draw.randint(1, 6))), reverse=True)
        capacity = packing.best_fit(sizes, (5, 10, 20), 0)[1]
        cost, bound = sum(capacity), best(sizes, (5, 10, 20))
        assert bound <= cost <= 2 * bound
        total, least = total + cost, least + bound
    assert total <= 1.15 * least
