from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from slipstack.functions import amounts as am
from slipstack.operators import extraction as ex

FAST = [
    ("TOTAL 12.50", 1250),
    ("TOTAL 1,234.56 ... total 1234.56", 123456),
    ("TOTAL 12.50 PROPINA 1.00", None),
    ("sin montos", None),
    ("SUBTOTAL 45.00", 4500),
    ("1.23", 123),
    ("SUBTOTAL 45.00 " + "x " * 1000 + "TOTAL 50.00", None),
    ("TOTAL 50.00 " + "x " * 1000, 5000),
    ("TOTAL -12.50", None),
    ("TOTAL (12.50)", None),
    ("TOTAL - 12.50", None),
    ("TOTAL ---------- 12.50", 1250),
    ("TOTAL ---- 12.50", 1250),
    ("12.05.2024", 1205),
    ("1234,567.89", 23456789),
    ("12.50-13.00", None),
    ("-$12.50", None),
    ("- Bs 12.50", None),
    ("9999999999999.99 5.00", 500),
    ("-9999999999999.99 5.00", None),
    ("TOTAL  12.50", 1250),
    (None, None),
]

PARSED = [
    ("1,234.56", 123456), ("1234.56", 123456), ("1,234,567.89", 123456789), ("500", 50000), ("12.5", 1250),
    ("  $ 1,234.56 ", 123456), ("", None), ("abc", None), ("1234,56", None), ("1,234", None), ("12.345", None),
    ("-5", None), ("1,,234.56", None), ("1.234.56", None), ("1,234,56", None), ("1.2.3", None), ("12,34.56", None),
    ("999999999999", 99999999999900), ("9999999999999", None),
]


def test_fast_total(rows):
    df = am.with_fast_total(rows([(i, t) for i, (t, _) in enumerate(FAST)], "i int, text string"))
    got = {r.i: r.total_cents for r in df.collect()}
    assert [got[i] for i in range(len(FAST))] == [want for _, want in FAST]


def test_candidates(rows):
    df = rows([("Bs 18,490.34 Cuenta 40005189200",), ("x Bs 8.2500 = Bs 1,650.00",)], "t string")
    got = [r.v for r in df.select(am.candidates(F.col("t")).alias("v")).collect()]
    assert got == [["18,490.34"], ["1,650.00"]]


def test_parse(rows):
    df = rows([(i, t) for i, (t, _) in enumerate(PARSED)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", am.parse_amount(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(PARSED))] == [want for _, want in PARSED]


@pytest.mark.parametrize(
    "cents,code,shown",
    [(123456, "USD", "US$ 1,234.56"), (0, "USD", "US$ 0.00"), (5, "USD", "US$ 0.05"), (100, "ARS", "AR$ 1.00"),
     (100, "EUR", "€ 1.00"), (100, "BOB", "Bs 1.00"), (100, "XYZ", "US$ 1.00")],
)
def test_format(rows, cents, code, shown):
    df = rows([(cents, code)], "c bigint, m string")
    assert df.select(am.format_amount(F.col("c"), F.col("m"))).first()[0] == shown


def test_collapse_spaces(rows):
    long = "y" * 5000
    df = rows([("  TOTAL   12.50\n\nIVA 1 ",), (long,)], "t string")
    assert [r[0] for r in df.select(am.collapse_spaces(F.col("t"))).collect()] == ["TOTAL 12.50 IVA 1", long]


def _receipts(rows, data):
    return rows(data, "batch_id string, receipt_id bigint, text string, cents bigint, manual boolean, status string, draft string, removed boolean")


def test_candidates_of_a_batch(rows):
    df = _receipts(rows, [
        ("b", 1, "TOTAL 1.00", None, False, "ok", None, False),
        ("b", 2, "TOTAL 1.00", 500, False, "ok", None, False),
        ("b", 3, "   ", None, False, "ok", None, False),
        ("b", 4, "TOTAL 1.00", None, False, "pendiente", None, False),
        ("b", 5, "TOTAL 1.00", None, True, "ok", None, False),
    ])
    assert [r.receipt_id for r in df.filter(ex.is_candidate()).collect()] == [1]


def test_batch_outcomes(rows):
    def one(batch, i, text, cents=None):
        return (batch, i, text, cents, False, "ok", None, False)

    df = _receipts(rows, [
        one("none", 1, "TOTAL 1.00", 100), one("blank", 2, " "), one("blank", 3, ""), one("words", 4, "hola"),
        one("ready", 5, "TOTAL 12.50"), one("ready", 6, "TOTAL 7.00"),
    ])
    listed = F.col("cents").isNull()
    got = {r.batch_id: (r.outcome, r.with_total, r.found_cents) for r in ex.batch_outcome(df, listed).collect()}
    assert got == {
        "none": ("sin-candidatos", 0, 0), "blank": ("sin-texto", 0, 0), "words": ("sin-totales", 0, 0), "ready": ("listo", 2, 1950),
    }


def test_apply_totals_guards(rows):
    df = _receipts(rows, [
        ("b", 1, "a  1.00", None, False, "ok", None, False),
        ("b", 2, "a 1.00", 7, False, "ok", None, False),
        ("b", 3, "a 2.00", None, False, "ok", None, False),
        ("b", 4, "a 1.00", None, False, "ok", "12,", False),
        ("b", 5, "a 1.00", None, False, "ok", "", True),
        ("b", 6, "a 1.00", None, True, "ok", "", False),
        ("b", 7, "a 1.00", None, False, "ok", None, False),
    ])
    results = rows([(i, None if i == 7 else 100, "a 1.00") for i in range(1, 8)], "receipt_id bigint, new_cents bigint, seen_text string")
    got = {r.receipt_id: (r.cents, r.applied) for r in ex.apply_totals(df, results).collect()}
    # A manual mark without amount does not stop the setter; only F-12 looks at it.
    assert {k for k, (_, ok) in got.items() if ok} == {1, 6}
    assert got[2] == (7, False) and got[1] == (100, True) and got[7] == (None, False)


def test_several_results_never_multiply_a_receipt(rows):
    df = _receipts(rows, [("b", 1, "a 1.00", None, False, "ok", None, False), ("b", 2, "x", None, False, "ok", None, False)])
    late = rows([(1, 300, "a 1.00", 2), (1, 400, "a 1.00", 1), (1, 1, "old", 0), (1, None, "a 1.00", 0), (2, 5, "y", 1), (2, 6, "z", 1)], "receipt_id bigint, new_cents bigint, seen_text string, seq bigint")
    for results, want in ((late, 400), (late.drop("seq"), 300)):
        assert sorted((r.receipt_id, r.cents) for r in ex.apply_totals(df, results).collect()) == [(1, want), (2, None)]


def test_settle_takes_live_pending_rows_only(rows):
    kinds = [
        (1, "TOTAL 1.00", None, "pendiente", None, False, None), (2, "TOTAL 1.00", 7, "pendiente", None, False, None), (3, "TOTAL 1.00", None, "pendiente", "1", False, None),
        (4, "TOTAL 1.00", None, "pendiente", None, True, None), (5, "TOTAL 1.00", 7, "ok", None, False, "x"), (6, "TOTAL 1.00", 7, "pendiente", None, False, "x"),
        (7, "nada", 7, "pendiente", None, False, None), (8, "TOTAL 1.00", 9, "procesando", None, False, None),
    ]
    df = rows(kinds, "receipt_id bigint, text string, cents bigint, status string, draft string, removed boolean, ocr_error string")
    got = {r.receipt_id: (r.text, r.cents, r.status) for r in ex.settle(df).collect()}
    assert got == {
        1: ("TOTAL 1.00", 100, "ok"), 2: ("TOTAL 1.00", 100, "ok"), 3: ("TOTAL 1.00", None, "ok"), 4: ("TOTAL 1.00", None, "pendiente"),
        5: ("TOTAL 1.00", 7, "ok"), 6: ("", None, "error"), 7: ("nada", None, "ok"), 8: ("TOTAL 1.00", 9, "procesando"),
    }


@pytest.mark.parametrize("ok,total,prior,text", [(2, 2, "antes", "antes"), (2, 2, " ", "Local: 2/2 totales."), (1, 2, "antes", "Local: 1/2 totales.")])
def test_message(rows, ok, total, prior, text):
    df = rows([(ok, total, prior)], "a int, b int, c string")
    assert df.select(ex.batch_message(F.col("a"), F.col("b"), F.col("c"))).first()[0] == text


def test_totals_do_not_depend_on_partitioning(rows):
    data = [("b", i, "", (i * 37) % 1000 if i % 3 else None, False, "ok", None, False) for i in range(2000)]
    seen = set()
    for n in (1, 8, 64):
        r = ex.batch_totals(_receipts(rows, data).repartition(n)).first()
        seen.add((r.total_cents, r.receipts, r.with_amount, r.progress))
    assert len(seen) == 1


def test_lines_join(rows):
    df = rows([(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (2, 1, "")], "receipt_id bigint, line_no bigint, text string")
    assert {r.receipt_id: r.text for r in ex.join_lines(df).collect()} == {1: "a\nb", 2: ""}
