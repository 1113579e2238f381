"""A few files on their whole way, against counting by hand."""

from __future__ import annotations

from slipstack.operators import composed

FILES = "batch_id string, seq bigint, name string, mime string, size bigint, page_count int, open_error string"
PAGES = "seq bigint, page_no int, width double, height double, white_ratio double, black_ratio double"
TEXTS = "seq bigint, page_no int, text string, ocr_error string"


def _inputs(rows):
    files = [
        ("a", 1, "one.jpg", "image/jpeg", 10, None, None), ("a", 2, "two.pdf", "application/pdf", 10, 3, None), ("a", 3, "no.txt", "text/plain", 10, None, None),
        ("a", 4, "big.pdf", "application/pdf", 6_000_000, 1, None), ("b", 5, "blank.pdf", "application/pdf", 10, 1, None), ("c", 6, "x.png", "image/png", 10, None, None),
        ("a", 7, "last.pdf", "application/pdf", 10, 2, None),
    ]
    pages = [(s, p, 700.0, 900.0, 1.0 if s == 5 or (s, p) == (2, 2) else 0.5, 0.1) for s, n in ((2, 3), (5, 1), (7, 2)) for p in range(1, n + 1)]
    texts = [(1, 0, "TOTAL 1.00", None), (2, 1, "TOTAL 2.50", None), (2, 3, "1.00 2.00", None), (7, 1, "TOTAL 4.00", "broken"), (6, 0, None, None)]
    return rows(files, FILES), rows(pages, PAGES), rows(texts, TEXTS)


def test_every_file_is_on_one_side(rows):
    files, pages, _ = _inputs(rows)
    receipts, refused = composed.take_in(files, pages)
    assert sorted((r.batch_id, r.seq, r.page_no) for r in receipts.collect()) == [("a", 1, 0), ("a", 2, 1), ("a", 2, 3), ("a", 7, 1), ("a", 7, 2), ("c", 6, 0)]
    assert {r.seq: r.reason for r in refused.collect()} == {3: "formato", 4: "tamano", 5: "ilegible"}


def test_sheets_follow_files_and_pages(rows):
    files, pages, _ = _inputs(rows)
    spots = {r.receipt_id: (r.sheet_no, r.slot) for r in composed.on_sheets(composed.take_in(files, pages)[0]).collect()}
    assert [spots[s * 16 + p] for s, p in ((1, 0), (2, 1), (2, 3), (7, 1), (7, 2))] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    assert spots[96] == (1, 0)


def test_report(rows):
    got = {r.batch_id: tuple(r)[1:] for r in composed.batch_report(*_inputs(rows)).collect()}
    assert got == {"a": (5, 2, 350, 2, 2), "b": (0, 0, 0, 0, 1), "c": (1, 0, 0, 1, 0)}
