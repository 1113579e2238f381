from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from slipstack.functions import quads
from slipstack.operators import selection as op
from slipstack.operators import sequences as seq

DICT = ["blank", "a", "b", " ", "c"]


def _line(steps, values=None):
    out = []
    for t, c in enumerate(steps):
        row = [0.0] * 5
        row[c] = values[t] if values else 0.9
        out += row
    return out


@pytest.mark.parametrize(
    "trials,want",
    [
        ([(0, 0.95, 1.0)], 0),
        ([(0, 0.2, 1.0), (270, 0.97, 1.0), (90, 0.99, 1.0), (180, 0.1, 1.0)], 270),
        ([(0, 0.24, 1.0), (90, 0.61, 1.0), (270, 0.8, 1.0), (180, 0.26, 1.0)], 270),
        ([(0, 0.5, 1.0), (90, 0.5, 1.0), (270, 0.5, 1.0)], 0),
        ([(0, 0.1, 0.0004), (270, 0.99, 1.0)], 0),
        ([(270, 0.3, 0.0), (90, 0.4, 0.0)], 90),
    ],
)
def test_rotation(rows, trials, want):
    df = rows([(1, *t) for t in trials], "receipt_id bigint, deg int, confidence double, det_mass double")
    assert op.choose_rotation(df).first().deg == want


def test_top_two_keep_box_order_on_ties(rows):
    df = rows([(1, 0, i, s, "x", s) for i, s in [(1, 0.5), (2, 0.7), (3, 0.5), (4, 0.1)]], "receipt_id bigint, deg int, box_no int, box_score double, text string, score double")
    assert sorted(r.box_no for r in op.top_boxes(df).collect()) == [1, 2]
    assert op.confidence(df).first().confidence == pytest.approx(0.6)


def test_chunks_of_sixteen(rows):
    df = rows([(1, i, 320 + (i * 7) % 20) for i in range(20)], "receipt_id bigint, line_no bigint, width bigint")
    got = op.width_chunks(df).groupBy("chunk").agg(F.count("*").alias("n"), F.max("chunk_width").alias("w")).orderBy("chunk").collect()
    assert [r.n for r in got] == [16, 4] and got[1].w == 339


@pytest.mark.parametrize(
    "steps,values,text,score",
    [
        ([1, 1, 0, 2, 2, 2, 4], [0.9, 0.8, 0.99, 0.7, 0.6, 0.5, 0.95], "abc", (0.9 + 0.7 + 0.95) / 3),
        ([1, 3, 2], None, "a b", 0.9),
        ([0, 0], None, "", 0.0),
        ([1, 0, 1], None, "aa", 0.9),
    ],
)
def test_decoding(rows, steps, values, text, score):
    df = rows([(1, _line(steps, values), len(steps))], "line_id bigint, scores array<float>, steps int")
    r = seq.decode(df, DICT).first()
    assert (r.text, r.score) == (text, pytest.approx(score, abs=1e-6))


@pytest.mark.parametrize("steps", [0, 2, 4, None])
def test_wrong_shapes_decode_to_nothing(rows, steps):
    df = rows([(1, _line([1, 2, 1]), steps)], "line_id bigint, scores array<float>, steps int")
    r = seq.decode(df, DICT).first()
    assert (r.text, r.score) == ("", 0.0)


def test_rows_and_arrays_decode_alike(rows, spark):
    rng = random.Random(3)
    lines = [(i, [rng.random() for _ in range(60)], 12) for i in range(40)]
    arrays = seq.decode(rows(lines, "line_id bigint, scores array<float>, steps int"), DICT)
    cells = rows(
        [(i, p // 5, p % 5, v) for i, scores, _ in lines for p, v in enumerate(scores)],
        "line_id bigint, step int, class int, value float",
    )
    dictionary = rows(list(enumerate(DICT)), "class int, symbol string")
    long = seq.decode_rows(seq.best_classes_of_rows(cells), dictionary, cells.select("line_id").distinct())
    a = {r.line_id: (r.text, round(r.score, 5)) for r in arrays.collect() if r.text}
    assert a == {r.line_id: (r.text, round(r.score, 5)) for r in long.collect()}


@pytest.mark.parametrize("w,h,want", [(2000, 1000, (960, 480)), (100, 50, (96, 64)), (10, 10, (32, 32)), (0, 5, (0, 0))])
def test_detector_size(rows, w, h, want):
    df = rows([(float(w), float(h))], "w double, h double")
    assert tuple(df.select(*quads.detector_size(F.col("w"), F.col("h"))).first()) == want


@pytest.mark.parametrize("w,h,want", [(4, 2, (96, 320)), (640, 30, (1024, 1024)), (4800, 10, (48 * 32, 48 * 32)), (0, 5, (None, None))])
def test_line_widths(rows, w, h, want):
    df = rows([(float(w), float(h))], "w double, h double")
    assert tuple(df.select(*quads.line_widths(F.col("w"), F.col("h"))).first()) == want


def _quad(rows, pts):
    return rows([([{"x": float(x), "y": float(y)} for x, y in pts],)], "p array<struct<x:double,y:double>>")


def _points(value):
    return [(p.x, p.y) for p in value]


def test_orders_and_unclip(rows):
    mixed = _quad(rows, [(9, 9), (0, 0), (9, 0), (0, 9)])
    square = [(0, 0), (9, 0), (9, 9), (0, 9)]
    r = mixed.select(quads.order_by_angle(F.col("p")).alias("a"), quads.order_by_x(F.col("p")).alias("x")).first()
    assert _points(r.a) == square and _points(r.x) == square
    grown = _quad(rows, [(0, 0), (10, 0), (10, 10), (0, 10)]).select(quads.unclip(F.col("p")).alias("g")).first().g
    assert _points(grown) == [(-3.5, -3.5), (13.5, -3.5), (13.5, 13.5), (-3.5, 13.5)]
    flat = _quad(rows, [(0, 0), (10, 0), (10, 0), (0, 0)]).select(quads.unclip(F.col("p")).alias("g")).first().g
    assert flat is None


@pytest.mark.parametrize(
    "pts,conf,good",
    [
        ([(2, 2), (98, 2), (98, 98), (2, 98)], [0.9] * 4, True),
        ([(0, 0), (9, 9), (9, 0), (0, 9)], [0.9] * 4, False),
        ([(48, 48), (52, 48), (52, 52), (48, 52)], [0.9] * 4, False),
        ([(2, 2), (98, 2), (98, 98), (2, 98)], [0.9, 0.9, 0.9, 0.1], False),
        ([(0, 0), (100, 0), (100, 100), (0, 100)], [0.9] * 4, False),
    ],
)
def test_plausible(rows, pts, conf, good):
    df = _quad(rows, pts)
    check = quads.is_plausible(quads.from_points(F.col("p")), [F.lit(c) for c in conf], F.lit(100.0), F.lit(100.0))
    assert df.select(check).first()[0] is good


def test_output_size(rows):
    df = _quad(rows, [(0, 0), (100, 0), (100, 50), (0, 50)])
    assert tuple(df.select(*quads.output_size(quads.from_points(F.col("p")))).first()) == (100, 50)


def test_tasks_get_equal_padded_areas_on_skewed_widths(spark):
    # A third of the lines has one width; few are very wide.
    wide = F.when(F.col("id") % 3 == 0, 320).when(F.col("id") % 100 == 1, 1536).otherwise(40 + F.pmod(F.hash("id"), F.lit(280)))
    lines = spark.range(60_000).withColumn("width", wide).withColumn("_padded_w", F.ceil(F.col("width") / 8) * 8)
    tasks = op.equal_areas(lines, 16, "id").withColumn("task", F.spark_partition_id()).groupBy("task").agg(
        F.sum("_padded_w").alias("area"), F.count("*").alias("n"), F.min("width").alias("low"), F.max("width").alias("high"), F.count_distinct("_part").alias("parts")
    ).orderBy("task").collect()
    areas = [t.area for t in tasks]
    assert len(tasks) == 16 and all(t.parts == 1 for t in tasks) and sum(t.n for t in tasks) == 60_000
    assert max(areas) < 1.1 * sum(areas) / 16  # load
    # Padding every task to its widest line would cost less than a quarter more.
    assert sum(t.n * t.high for t in tasks) < 1.25 * sum(areas)
    assert all(a.high <= b.low + 8 for a, b in zip(tasks, tasks[1:]))


def test_equal_areas_of_nothing_and_of_lines_without_width(spark, rows):
    assert op.equal_areas(rows([], "id bigint, width bigint"), 4, "id").count() == 0
    assert op.equal_areas(rows([(1, None), (2, 0), (None, 50)], "id bigint, width bigint"), 4, "id").count() == 3


def test_chunks_of_a_receipt_with_very_many_lines(rows):
    lines = rows([(r, i, (i * 7) % 50) for r, n in ((1, 100), (2, 5), (None, 40)) for i in range(n)], "receipt_id bigint, line_no bigint, width bigint")
    got = op.width_chunks(lines, 16).collect()
    for r, n in ((1, 100), (2, 5), (None, 40)):
        want = sorted(((i * 7) % 50, i) for i in range(n))
        chunks = {line: k // 16 for k, (_, line) in enumerate(want)}
        widest = {}
        for w, line in want:
            widest[chunks[line]] = max(w, widest.get(chunks[line], 0))
        assert {x.line_no: (x.chunk, x.chunk_width) for x in got if x.receipt_id == r} == {line: (c, widest[c]) for line, c in chunks.items()}
