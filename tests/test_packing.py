from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.functions import quads
from slipstack.operators import packing as op

SHEETS = "batch_id string, sheet_no bigint, layout string"
PLACED = "batch_id string, sheet_no bigint, slot bigint, receipt_id bigint"


def _state(rows, sheets):
    """[(layout, [items or None])] -> sheets and placements of one batch."""
    s = [("b", n, layout) for n, (layout, _) in enumerate(sheets, 1)]
    p = [("b", n, i, r) for n, (_, slots) in enumerate(sheets, 1) for i, r in enumerate(slots) if r is not None]
    return rows(s, SHEETS), rows(p, PLACED)


def _packed(df):
    got: dict = {}
    for r in df.collect():
        got.setdefault((r.sheet_no, r.layout), {})[r.slot] = r.receipt_id
    return [(layout, [slots.get(i) for i in range(len(fixed.LAYOUTS[layout][2]))]) for (_, layout), slots in sorted(got.items())]


REFLOW = [
    ([("u4x2", [1, None, 2, None])], "u4x2", [("u4x2", [1, 2, None, None])]),
    ([("u2h", [1, 2]), ("u2h", [3, None]), ("u2h", [4, 5])], "u4x2", [("u2h", [1, 2]), ("u2h", [3, 4]), ("u2h", [5, None])]),
    ([("u1", [1, 2, 3, 4])], "u4x2", [("u1", [1]), ("u4x2", [2, 3, 4, None])]),
    ([("u1", [1, 2]), ("u2h", [3, 4])], "u4x2", [("u1", [1]), ("u2h", [2, 3]), ("u4x2", [4, None, None, None])]),
    ([("u1", [1, 2, 3, 4])], "u1", [("u1", [i]) for i in (1, 2, 3, 4)]),
    ([("u4x2", []), ("u4x2", []), ("u4x2", [9])], "u4x2", [("u4x2", [9, None, None, None])]),
]


@pytest.mark.parametrize("before,new,after", REFLOW)
def test_reflow(rows, before, new, after):
    assert _packed(op.reflow(*_state(rows, before), new)) == after


def test_place_fills_the_target_then_new_sheets(rows):
    sheets, placed = _state(rows, [("u2h", [1, None])])
    items = rows([("b", i, 10 + i) for i in range(3)], "batch_id string, seq bigint, receipt_id bigint")
    got = sorted((r.sheet_no, r.slot, r.receipt_id, r.layout) for r in op.place(sheets, placed, items).collect())
    assert got == [(1, 1, 10, "u2h"), (2, 0, 11, "u2h"), (2, 1, 12, "u2h")]


def test_place_on_an_asked_sheet_skips_earlier_holes(rows):
    sheets, placed = _state(rows, [("u2h", [1, None]), ("u1", [2]), ("u3h", [None, 3, None])])
    items = rows([("b", i, 10 + i) for i in range(3)], "batch_id string, seq bigint, receipt_id bigint")
    wanted = rows([("b", 3)], "batch_id string, sheet_no bigint")
    got = sorted((r.sheet_no, r.slot, r.receipt_id) for r in op.place(sheets, placed, items, wanted).collect())
    assert got == [(3, 0, 10), (3, 2, 11), (4, 0, 12)]


def test_place_without_sheets_and_into_a_full_batch(rows):
    items = rows([("b", 1, 5), ("c", 1, 6)], "batch_id string, seq bigint, receipt_id bigint")
    sheets, placed = _state(rows, [("u1", [1])])
    got = sorted((r.batch_id, r.sheet_no, r.slot, r.layout) for r in op.place(sheets, placed, items).collect())
    assert got == [("b", 2, 0, "u1"), ("c", 1, 0, "u4x2")]


@pytest.mark.parametrize(
    "sheet,slot,want",
    [(1, 1, (1, 1, "u2h")), (1, 0, (1, 1, "u2h")), (2, 0, (1, 1, "u2h")), (9, 0, (1, 1, "u2h"))],
)
def test_paste(rows, sheet, slot, want):
    sheets, placed = _state(rows, [("u2h", [1, None]), ("u1", [2])])
    ask = rows([("b", 50, sheet, slot)], "batch_id string, receipt_id bigint, sheet_no bigint, slot bigint")
    r = op.paste(sheets, placed, ask).first()
    assert (r.sheet_no, r.slot, r.layout) == want


def test_paste_into_full_sheets_opens_one_with_the_asked_layout(rows):
    sheets, placed = _state(rows, [("u1", [1]), ("u2h", [2, 3])])
    ask = rows([("b", 50, 2, 0)], "batch_id string, receipt_id bigint, sheet_no bigint, slot bigint")
    r = op.paste(sheets, placed, ask).first()
    assert (r.sheet_no, r.slot, r.layout) == (3, 0, "u2h")


def test_sweep_keeps_one_default_sheet(rows):
    sheets, placed = _state(rows, [("u1", [1]), ("u2h", [None, None])])
    gone = rows([(1,)], "receipt_id bigint")
    got = op.sweep(sheets, op.remove(placed, gone)).collect()
    assert [(r.sheet_no, r.layout) for r in got] == [(3, "u4x2")]


@pytest.mark.parametrize("corner", fixed.CODE_CORNERS)
def test_slots_lie_on_the_page_and_apart(spark, corner):
    slots = op.slot_table(spark).select("layout", "slot").withColumn("batch_id", F.lit("b"))
    by_layout: dict = {}
    for r in op.with_rects(slots, F.lit(corner)).collect():
        by_layout.setdefault(r.layout, []).append((r.rect_x, r.rect_y, r.rect_w, r.rect_h))
    emu, gap = fixed.EMU_PER_INCH, int(0.15 * fixed.EMU_PER_INCH + 0.5) - 2
    assert {k: len(v) for k, v in by_layout.items()} == {k: len(v[2]) for k, v in fixed.LAYOUTS.items()}
    for rects in by_layout.values():
        for x, y, w, h in rects:
            assert x >= 0 and y >= 0 and x + w <= 8.5 * emu and y + h <= 11 * emu
        for i, (x, y, w, h) in enumerate(rects):
            for u, v, a, b in rects[i + 1 :]:
                assert max(u - (x + w), x - (u + a), v - (y + h), y - (v + b)) >= gap


@pytest.mark.parametrize("w,h,want", [(1600, 600, (800, 300)), (600, 1200, (300, 600)), (0, 0, (800, 600))])
def test_fit(rows, w, h, want):
    df = rows([(w, h, 800 * 9525, 600 * 9525)], "w bigint, h bigint, rw bigint, rh bigint")
    a, b = quads.fit(F.col("w"), F.col("h"), F.col("rw"), F.col("rh"))
    assert tuple(df.select(a, b).first()) == want


@pytest.mark.parametrize("code,ok", [("123456", True), ("2", True), ("1234567", True), ("12345a", False), ("", False), ("12\n", False)])
def test_export_gate(rows, code, ok):
    df = rows([(code,)], "c string")
    gate = op.export_gate(F.lit(True), F.col("c"), F.lit(1))
    assert df.select(gate.isNull()).first()[0] is ok
    assert df.select(op.export_gate(F.lit(False), F.col("c"), F.lit(0))).first()[0] == fixed.NOTHING_TO_EXPORT


def test_hot_batch_is_packed_whole(rows):
    n = 5000
    sheets = rows([("hot", i, "u4x2") for i in range(1, n // 4 + 1)], SHEETS)
    placed = rows([("hot", i // 2 + 1, i % 2, i) for i in range(n // 2)], PLACED)
    got = op.reflow(sheets, placed).collect()
    assert len(got) == n // 2 and len({(r.sheet_no, r.slot) for r in got}) == n // 2
    assert all((r.sheet_no - 1) * 4 + r.slot == r.receipt_id for r in got)


def test_manifest_breaks_pages_between_sheets(rows):
    data = [("b", 4, 1, "u2h", 1, 10, 10), ("b", 4, 0, "u2h", 2, 10, 10), ("b", 7, 1, "u2h", 3, 10, 10), ("b", 7, 5, "u2h", 4, 10, 10)]
    placed = rows(data, "batch_id string, sheet_no bigint, slot bigint, layout string, receipt_id bigint, width bigint, height bigint")
    out = op.manifest(placed, F.lit("inf-der")).collect()
    assert {r.receipt_id: r.page_break for r in out} == {1: False, 2: False, 3: True, 4: False}
    # A placement beyond its template is reported, not lost.
    assert {r.receipt_id: r.refused for r in out if r.refused} == {4: fixed.NO_SUCH_SLOT}
    assert op.print_cells(placed.withColumn("name", F.lit("x"))).filter("refused IS NOT NULL").count() == 1


@pytest.mark.parametrize(
    "state,slot,want",
    [
        ([("u2h", [1, None]), ("u2v", [2, None])], 0, (2, 1, "u2v")), ([("u2h", [1, None]), ("u2v", [None, None])], 1, (2, 1, "u2v")),
        ([("u2h", [1, None]), ("u1", [2])], 0, (1, 1, "u2h")), ([("u2h", [1, 3]), ("u1", [2])], 0, (3, 0, "u1")),
    ],
)
def test_paste_without_a_sheet(rows, state, slot, want):
    sheets, placed = _state(rows, state)
    ask = rows([("b", 50, None, slot)], "batch_id string, receipt_id bigint, sheet_no bigint, slot bigint")
    r = op.paste(sheets, placed, ask).first()
    assert (r.sheet_no, r.slot, r.layout) == want


def test_sheets_after_a_reflow(rows):
    sheets, placed = _state(rows, [("u1", [1]), ("u2h", [2, 3]), ("u1", [None])])
    bare = rows([("c", 4, "u1")], SHEETS)
    moved = op.reflow(sheets, placed)
    got = {(r.batch_id, r.sheet_no, r.layout) for r in op.sheets_after(sheets.unionByName(bare), moved).collect()}
    assert got == {("b", 1, "u1"), ("b", 2, "u2h"), ("c", 5, "u4x2")}


def test_gates_of_batches(rows):
    codes = rows([("a", True, "12"), ("b", True, "1x"), ("c", False, None), ("d", True, "5")], "batch_id string, active boolean, code string")
    receipts = rows([("a", 1), ("b", 2), ("c", 3)], "batch_id string, receipt_id bigint")
    got = {r.batch_id: r.message for r in op.batch_gates(codes, receipts).collect()}
    assert got == {"a": None, "b": fixed.CODE_INVALID, "c": None, "d": fixed.NOTHING_TO_EXPORT}


def test_manifest_is_written_flat_and_nested(spark, rows, tmp_path):
    from slipstack.sinks.tables import write_manifest

    data = [("b", 4, 1, "u2h", 1, 10, 10), ("b", 4, 0, "u2h", 2, 10, 10), ("c", 7, 0, "u1", 3, 10, 10)]
    placed = rows(data, "batch_id string, sheet_no bigint, slot bigint, layout string, receipt_id bigint, width bigint, height bigint")
    flat = op.manifest(placed, F.lit("inf-der"))
    write_manifest(flat, op.nested_manifest(flat), str(tmp_path), buckets=3)
    assert spark.read.parquet(f"{tmp_path}/slots").drop("bucket").exceptAll(flat).isEmpty()
    sheets = {r.sheet_no: [i.receipt_id for i in r.images] for r in spark.read.json(f"{tmp_path}/sheets").collect()}
    assert sheets == {4: [2, 1], 7: [3]}
