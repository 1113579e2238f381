from __future__ import annotations

import datetime as dt
import random

import pytest

from slipstack.operators import events as op
from slipstack.operators import ordered

T0 = dt.datetime(2024, 1, 1, 12)


@pytest.fixture(autouse=True)
def every_key_is_large(monkeypatch, small_large_keys):
    monkeypatch.setattr(ordered, "HOT_ROWS", 1)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def _attempts(rows, data):
    return rows([(i, k, at(s), f) for i, (k, s, f) in enumerate(data)], "event_id bigint, k string, ts timestamp, failed boolean")


def test_debounce_joins_quick_turns(rows):
    turns = rows([("a", at(0), 90), ("a", at(1.4), 90), ("a", at(2.9), 270), ("a", at(10), 90), ("b", at(1), 270)], "k string, ts timestamp, deg bigint")
    for _ in (1,):
        got = {(r.k, r.session_start): (r.turns, r.degrees, r.last_turn) for r in op.quiet_sessions(turns, "k").collect()}
        assert got == {("a", at(0)): (3, 90, at(2.9)), ("a", at(10)): (1, 90, at(10)), ("b", at(1)): (1, 270, at(1))}


def test_turns_at_the_same_instant_share_a_session(rows):
    turns = rows([("a", at(0), 90), ("a", at(0), 90), ("a", at(9), 90), ("a", at(9), 270)], "k string, ts timestamp, deg bigint")
    got = {(r.session_start, r.turns, r.degrees) for r in op.quiet_sessions(turns, "k").collect()}
    assert got == {(at(0), 2, 180), (at(9), 2, 0)}


def test_commit_cancels_only_what_is_pending(rows):
    turns = rows([("a", at(0), 90), ("a", at(10), 90), ("a", at(20), 90), ("a", at(21), 90), ("b", at(0), 90)], "k string, ts timestamp, deg bigint")
    commits = rows([("a", at(1)), ("a", at(12)), ("a", at(20.5)), ("c", at(0))], "k string, ts timestamp")
    sessions = op.quiet_sessions(turns, "k")
    left = op.cancelled_by_commit(sessions, turns, commits, "k")
    # At 20.5 a later turn schedules again, so that session stays.
    assert {(r.k, r.last_turn) for r in left.collect()} == {("a", at(10)), ("a", at(21)), ("b", at(0))}


def test_strikes(rows):
    data = [("m", s, f) for s, f in enumerate([True, True, True, False, True, False, True, True])]
    got = sorted(op.strikes(_attempts(rows, data), "k").collect(), key=lambda r: r.event_id)
    assert [r.strike for r in got] == [1, 2, 1, None, 1, None, 1, 2]
    assert [r.evicts for r in got] == [False, True, False, False, False, False, False, True]


def test_alert_once_until_recovery(rows):
    data = [("m", s, f) for s, f in enumerate([True, True, False, True, True])]
    assert sorted(r.event_id for r in op.alerts(_attempts(rows, data), "k").collect()) == [0, 3]


def test_open_flag(rows):
    data = [("b", at(0), at(10), 1), ("b", at(5), at(6), 2), ("b", at(20), at(21), 3)]
    moves = op.open_flags(rows(data, "k string, ts timestamp, until timestamp, seq bigint"), "k")
    got = [(r.ts, r.open, r.busy) for r in sorted(moves.collect(), key=lambda r: r.ts)]
    assert got == [(at(0), 1, True), (at(5), 2, True), (at(6), 1, True), (at(10), 0, False), (at(20), 1, True), (at(21), 0, False)]


def _fold(data, wait):
    cold, out = {}, []
    for k, s, failed in data:
        tried = s >= cold.get(k, -1e9)
        if tried:
            cold[k] = s + wait if failed else -1e9
        out.append(tried)
    return out


def test_cooldown_examples(rows):
    data = [("m", s, f) for s, f in [(0, True), (30, False), (59.999, False), (60, True), (90, True), (120, False), (121, True)]]
    got = sorted(op.cooldown(_attempts(rows, data), "k").collect(), key=lambda r: r.event_id)
    assert [r.tried for r in got] == [True, False, False, True, False, True, True]


def test_equal_times_follow_the_sequence(rows):
    data = [("m", 0, True), ("m", 0, False), ("m", 5, True), ("m", 60, False), ("m", 60, True), ("m", 61, True)]
    df = _attempts(rows, data)
    got = sorted(op.cooldown(df, "k").collect(), key=lambda r: r.event_id)
    assert [r.tried for r in got] == _fold(data, 60)
    strikes = sorted(op.strikes(df, "k").collect(), key=lambda r: r.event_id)
    assert [r.strike for r in strikes] == [1, None, 1, None, 1, 2]


@pytest.mark.parametrize("hot,step", [(1, 1), (40, 1), (40, 0.01), (500, 1)])
def test_cooldown_of_a_hot_key_in_slices(rows, monkeypatch, hot, step):
    """One key with traffic that never pauses, cut into slices of some rows, against a plain fold; also as a burst."""
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    rng = random.Random(hot)
    stamps = [s * step for s in sorted(rng.sample(range(0, 6000), 900))]
    data = [("hot", s, rng.random() < 0.5) for s in stamps]
    data += [("calm", s * 40, rng.random() < 0.7) for s in range(60)]
    got = {r.event_id: r.tried for r in op.cooldown(_attempts(rows, data), "k").collect()}
    assert [got[i] for i in range(len(data))] == _fold(data, 60)


def test_manual_edits(rows):
    data = [(1, 1, "12.50"), (1, 2, "12,5"), (2, 1, "7"), (2, 2, " "), (3, 1, "x"), (3, 2, "8"), (4, 1, "bad")]
    edits = rows([(k, at(s), s, t) for k, s, t in data], "k bigint, ts timestamp, seq bigint, typed string")
    got = {r.k: (r.cents, r.manual, r.draft) for r in op.manual_edits(edits, "k").collect()}
    assert got == {1: (1250, True, "12,5"), 2: (700, True, None), 3: (800, True, None), 4: (None, False, "bad")}


def test_last_editor(rows):
    edits = rows([(1, at(1), 1, "a"), (1, at(2), 2, "b"), (1, at(2), 3, "c")], "k bigint, ts timestamp, seq bigint, v string")
    assert op.last_editor(edits, "k", "v").first().v == "c"


def test_reread(rows):
    receipts = rows(
        [
            (1, "viejo", 500, False, "ok", None, False), (2, "viejo", 500, True, "ok", None, False), (3, "viejo", 500, False, "ok", None, False),
            (4, "viejo", 500, False, "ok", None, False), (5, "viejo", 500, False, "ok", None, True), (6, "viejo", 500, False, "ok", "7,", False),
            (7, "viejo", None, True, "error", "7,", False), (8, "viejo", 500, False, "ok", "", False),
        ],
        "receipt_id bigint, text string, cents bigint, manual boolean, status string, draft string, removed boolean",
    )
    results = [(i, "TOTAL 9.00") for i in (1, 2, 5, 6, 7, 8)] + [(3, None), (8, None), (99, "TOTAL 1.00")]
    out = op.reread(receipts, rows(results, "receipt_id bigint, new_text string"))
    got = {r.receipt_id: (r.text, r.cents, r.status) for r in out.collect()}
    assert out.count() == 8 and got == {
        1: ("TOTAL 9.00", 900, "ok"), 2: ("TOTAL 9.00", 500, "ok"), 3: ("", None, "ok"), 4: ("viejo", 500, "ok"), 5: ("viejo", 500, "ok"),
        6: ("TOTAL 9.00", None, "ok"), 7: ("TOTAL 9.00", None, "ok"), 8: ("TOTAL 9.00", 900, "ok"),
    }


def test_verdicts_agree_with_the_setter(rows):
    from slipstack.operators.extraction import apply_totals

    receipts = rows(
        [(1, "a 1.00", None, None, False), (2, "a 1.00", 5, None, False), (3, "b", None, None, False), (4, "a 1.00", None, "x", False), (5, "a 1.00", None, None, True)],
        "receipt_id bigint, text string, cents bigint, draft string, removed boolean",
    )
    results = rows([(i, 100, "a 1.00") for i in range(1, 7)], "receipt_id bigint, new_cents bigint, seen_text string")
    said = {r.receipt_id: r.verdict for r in op.verdicts(receipts, results).collect()}
    assert said == {1: "aplicado", 2: "ya-tiene", 3: "rancio", 4: "borrador", 5: "quitado", 6: "quitado"}
    assert {r.receipt_id for r in apply_totals(receipts, results).filter("applied").collect()} == {1}


def test_cooldown_keeps_null_keys_and_null_times(rows, monkeypatch):
    from slipstack.operators import ordered

    times = [(0, None, at(0), True), (1, None, at(30), False), (2, "a", at(0), True), (3, "a", None, True), (4, None, at(70), True), (5, None, at(80), None)]
    times += [(6, "old", at(-10**10), True), (7, "old", at(30 - 10**10), True), (8, "old", at(60 - 10**10), True)]
    want = {0: True, 1: False, 2: True, 3: None, 4: True, 5: False, 6: True, 7: False, 8: True}
    for hot in (1000, 2):  # null keys as whole keys and cut into slices
        monkeypatch.setattr(ordered, "HOT_ROWS", hot)
        got = op.cooldown(rows(times, "event_id bigint, k string, ts timestamp, failed boolean"), "k").collect()
        assert {r.event_id: r.tried for r in got} == want and len(got) == len(times)


def test_other_rules_keep_null_keys(rows):
    data = [(0, None, at(0), True), (1, None, at(5), True), (2, "a", at(0), False), (3, None, at(9), False)]
    tries = rows(data, "event_id bigint, k string, ts timestamp, failed boolean")
    assert {r.event_id: r.strike for r in op.strikes(tries, "k").collect()} == {0: 1, 1: 2, 2: None, 3: None}
    assert {r.event_id for r in op.alerts(tries, "k").collect()} == {0}
    turns = rows([(0, None, at(0), 90), (1, None, at(1), 90)], "event_id bigint, k string, ts timestamp, deg bigint")
    assert [(r.k, r.turns) for r in op.quiet_sessions(turns, "k").collect()] == [(None, 2)]
