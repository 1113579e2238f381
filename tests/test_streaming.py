from __future__ import annotations

import os
import random

import pytest
from test_events import at

from slipstack.operators import events as batch
from slipstack.streaming import attempts, debounce, intake, overlap, slices, totals
from slipstack.streaming.runner import drain_to_end, drain_to_table


def _stream(spark, df, folder, order, parts=3):
    """The rows as ``parts`` files in event order, read one file per micro-batch."""
    count, rows = df.count(), df.orderBy(order).collect()
    for i in range(parts):
        piece = spark.createDataFrame(rows[i * count // parts : (i + 1) * count // parts], df.schema)
        piece.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _shuffled(spark, df, folder, rng, parts=4, jitter=40):
    """Files out of event order by some seconds."""
    found = sorted(df.collect(), key=lambda r: (r.ts.timestamp() if r.ts else 0) + rng.randrange(jitter))
    for i in range(parts):
        piece = spark.createDataFrame(found[i * len(found) // parts : (i + 1) * len(found) // parts], df.schema)
        piece.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


MINUTE = 60_000
TRIES = "event_id bigint, k string, ts timestamp, failed boolean"


def _tries(seed):
    """Attempts of three keys, one of them null, some at one moment, some years before, and one row that moves time on."""
    rng = random.Random(seed)
    data = [(i, [None, "a", "b"][rng.randrange(3)], at(i * 11 // 3 * 3 + rng.random() - 10**8 * (i < 5)), rng.random() < 0.6) for i in range(200)]
    return [*data, (998, "clock", at(10**6), True)]


@pytest.mark.parametrize("slice_ms", [2 * MINUTE, 60 * MINUTE])
def test_watch_equals_batch_on_files_out_of_order(spark, rows, tmp_path, slice_ms):
    data = _tries(2)
    df = rows([*data, (999, "a", None, True)], TRIES)
    stream = attempts.attempts_stream(_shuffled(spark, df, str(tmp_path), random.Random(1)), "k")
    sealed, aside, waiting = slices.drained(stream, attempts.Watch(), str(tmp_path), slice_ms, 60 * MINUTE)
    got = {r.seq: r for r in attempts.watched(sealed).collect()}
    assert [(r.seq, r.reason) for r in aside.collect()] == [(999, slices.UNTIMED)]
    assert [(r.seq, r.reason) for r in waiting.collect()] == [(998, slices.OPEN)]
    whole = rows(data[:-1], TRIES)
    assert {i: (r.strike, r.evicts) for i, r in got.items()} == {r.event_id: (r.strike, r.evicts) for r in batch.strikes(whole, "k").collect()}
    assert {i: r.tried for i, r in got.items()} == {r.event_id: r.tried for r in batch.cooldown(whole, "k").collect()}
    assert {i for i, r in got.items() if r.alert} == {r.event_id for r in batch.alerts(whole, "k").collect()}


def test_late_rows_stand_aside_and_the_rest_is_judged_without_them(spark, rows, tmp_path):
    data = _tries(3)
    df = rows(data, TRIES)
    stream = attempts.attempts_stream(_shuffled(spark, df, str(tmp_path), random.Random(1), jitter=400), "k")
    sealed, aside, waiting = slices.drained(stream, attempts.Watch(), str(tmp_path), MINUTE, 1)
    late, judged, held = aside.collect(), attempts.watched(sealed).collect(), waiting.collect()
    assert late and {r.reason for r in late} == {slices.LATE}
    assert sorted(r.seq for r in [*late, *judged, *held]) == sorted(r[0] for r in data)
    gone = {r.seq for r in [*late, *held]}
    on_time = rows([r for r in data if r[0] not in gone], TRIES)
    assert {r.seq: r.strike for r in judged} == {r.event_id: r.strike for r in batch.strikes(on_time, "k").collect()}
    assert {r.seq: r.tried for r in judged} == {r.event_id: r.tried for r in batch.cooldown(on_time, "k").collect()}


def test_a_second_run_goes_on_with_the_state(spark, rows, tmp_path):
    data = sorted(_tries(4), key=lambda r: r[2])
    folder = str(tmp_path)
    for part in (data[:90], data[90:]):
        rows(part, TRIES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        found = attempts.attempts_stream(spark.readStream.schema(TRIES).parquet(f"{folder}/in"), "k")
        sealed, _, _ = slices.drained(found, attempts.Watch(), folder, 5 * MINUTE, 1000)
    whole = rows(data[:-1], TRIES)
    assert {r.seq: r.tried for r in attempts.watched(sealed).collect()} == {r.event_id: r.tried for r in batch.cooldown(whole, "k").collect()}


def test_an_ended_stream_judges_every_row(spark, rows, tmp_path):
    data = _tries(7)
    stream = attempts.attempts_stream(_shuffled(spark, rows(data, TRIES), str(tmp_path), random.Random(1)), "k")
    sealed, aside, waiting = slices.drained(stream, attempts.Watch(), str(tmp_path), 60 * MINUTE, 60 * MINUTE, ended=True)
    assert aside.count() == waiting.count() == 0
    whole, got = rows(data, TRIES), attempts.watched(sealed).collect()
    assert len(got) == len(data)
    assert {r.seq: (r.strike, r.evicts) for r in got} == {r.event_id: (r.strike, r.evicts) for r in batch.strikes(whole, "k").collect()}
    assert {r.seq: r.tried for r in got} == {r.event_id: r.tried for r in batch.cooldown(whole, "k").collect()}
    assert {r.seq for r in got if r.alert} == {r.event_id for r in batch.alerts(whole, "k").collect()}


def test_an_ended_stream_gives_every_session(spark, rows, tmp_path):
    rng = random.Random(8)
    turns = rows([(i, rng.choice([None, "a", "b"]), at(i * 0.75), 90) for i in range(60)], "event_id bigint, k string, ts timestamp, deg bigint")
    stream = _shuffled(spark, turns, str(tmp_path), rng, jitter=5)
    found = drain_to_end(stream, lambda both: debounce.quiet_sessions(both, "k", delay_ms=MINUTE).drop("due"), str(tmp_path / "out"))
    shape = ["k", "session_start", "last_turn", "turns", "degrees"]
    shown = lambda sessions: sorted(map(tuple, sessions.select(shape).collect()), key=repr)
    assert shown(found) == shown(batch.quiet_sessions(turns, "k"))


def test_keys_share_their_waiting_rows(spark, rows, tmp_path):
    df = rows([(i, f"u{i // 2}", at(i % 50), i % 3 == 0) for i in range(4000)], TRIES)
    stream = attempts.attempts_stream(_stream(spark, df, str(tmp_path), "event_id", parts=1), "k")
    _, _, waiting = slices.drained(stream, attempts.Watch(), str(tmp_path), 60 * MINUTE, 60 * MINUTE)
    assert sorted(r.seq for r in waiting.collect()) == list(range(4000))
    held = spark.read.format("statestore").option("path", f"{tmp_path}/sealed/progress").option("stateVarName", "rows").load()
    assert held.count() <= slices.BUCKETS


def test_open_count_equals_batch(spark, rows, tmp_path):
    rng = random.Random(6)
    data = [(i, rng.choice(["a", None]), at(i * 7), at(i * 7 + rng.randrange(200))) for i in range(120)] + [(500, "clock", at(10**6), at(10**6))]
    df = rows(data, "seq bigint, k string, ts timestamp, until timestamp")
    stream = overlap.moves_stream(_shuffled(spark, df, str(tmp_path), rng, jitter=20), "k")
    sealed, aside, waiting = slices.drained(stream, overlap.OpenCount(), str(tmp_path), 2 * MINUTE, MINUTE)
    assert aside.count() == 0 and waiting.count() == 2
    every = batch.open_flags(df.where("seq < 500"), "k").select("k", "seq", "step", "open", "busy")
    shown = lambda found: sorted(map(tuple, found.collect()), key=repr)
    assert shown(overlap.open_flags(sealed)) == shown(every)


def test_debounce_and_cancelling_equal_batch(spark, rows, tmp_path):
    rng = random.Random(5)
    turns = [(i, rng.choice([None, "a", "b", "c"]), at(i * 0.75), 90 * rng.randrange(1, 4)) for i in range(150)]
    done = [(i, rng.choice([None, "a", "b", "c"]), at(rng.randrange(1200) / 10)) for i in range(80)]
    turns, done = [*turns, (999, "clock", at(9000), 90), (1000, "later", at(9500), 90)], [*done, (999, "clock", at(9500)), (1000, "d", None)]
    taken, commits = rows(turns, "event_id bigint, k string, ts timestamp, deg bigint"), rows(done, "event_id bigint, k string, ts timestamp")
    streams = [_shuffled(spark, df, str(tmp_path / n), rng, jitter=5) for n, df in (("turns", taken), ("commits", commits))]
    shape = ["k", "session_start", "last_turn", "turns", "degrees"]
    shown = lambda found: sorted((tuple(r) for r in found.select(shape).collect() if r.k not in ("clock", "later")), key=repr)
    sessions = batch.quiet_sessions(taken, "k")
    found = drain_to_table(debounce.quiet_sessions(streams[0], "k", delay_ms=MINUTE).drop("due"), str(tmp_path / "one"))
    assert shown(found) == shown(sessions)
    met = drain_to_table(debounce.uncancelled(*streams, "k", delay_ms=MINUTE), str(tmp_path / "two"))
    want = batch.cancelled_by_commit(sessions, taken, commits.where("ts is not null"), "k")
    assert shown(met) == shown(want) != shown(sessions)


RECEIPTS = "bucket int, receipt_id bigint, text string, cents bigint, draft string, removed boolean"
LATE_RESULTS = "bucket int, receipt_id bigint, seq bigint, new_cents bigint, seen_text string"


def _table(rows, tmp_path):
    """Six receipts in two buckets and results for them; one has an amount, one is removed."""
    receipts = rows([(i % 2, i, "TOTAL 1.00" if i else "otro", 7 if i == 3 else None, None, i == 4) for i in range(6)], RECEIPTS)
    totals.create(receipts, str(tmp_path / "receipts"))
    late = [(i % 2, i, i, 100, "TOTAL 1.00") for i in range(5)]
    late += [(1, 5, 50, 300, "otro texto"), (1, 5, 51, 400, "TOTAL 1.00"), (1, 5, 52, 500, "TOTAL 1.00"), (0, 2, 53, None, "TOTAL 1.00")]
    return str(tmp_path / "receipts"), rows(late, LATE_RESULTS), {0: None, 1: 100, 2: 100, 3: 7, 4: None, 5: 400}


def _now(spark, table):
    found = totals.current(spark, table).collect()
    assert len(found) == len({r.receipt_id for r in found})
    return {r.receipt_id: r.cents for r in found}


def test_late_results_reach_the_table_once(spark, rows, tmp_path):
    table, results, want = _table(rows, tmp_path)
    stream = _stream(spark, results, str(tmp_path), "seq", 3)
    for run in ("one", "two"):  # the second run reads everything again
        totals.start_applying(spark, stream, table, str(tmp_path / run)).awaitTermination()
        assert _now(spark, table) == want
        assert totals.compact(spark, table) is not None if run == "one" else True
        assert _now(spark, table) == want
    assert {v.upto for v in totals.versions(spark, table).collect()} == {2}
    assert totals.compact(spark, table) is None


def test_a_replayed_epoch_and_a_broken_compaction_change_nothing(spark, rows, tmp_path):
    table, results, want = _table(rows, tmp_path)
    # An epoch that broke off while it wrote its part of the log.
    rows([(0, 2, 1)], "bucket int, receipt_id bigint, new_cents bigint").write.parquet(f"{table}/changes/epoch=0")
    os.remove(f"{table}/changes/epoch=0/_SUCCESS")
    assert _now(spark, table)[2] is None
    totals.start_applying(spark, _stream(spark, results, str(tmp_path), "seq", 1), table, str(tmp_path / "p")).awaitTermination()
    assert _now(spark, table) == want
    # A compaction that broke off before its record was complete.
    totals.compact(spark, table)
    os.remove(f"{table}/commits/upto=0/_SUCCESS")
    assert _now(spark, table) == want and {v.upto for v in totals.versions(spark, table).collect()} == {totals.FIRST}
    assert totals.compact(spark, table) == 0 and _now(spark, table) == want


def test_only_accepted_results_are_written(spark, rows, tmp_path):
    receipts = spark.range(20_000).selectExpr("cast(id % 4 as int) bucket", "id receipt_id", "'TOTAL 1.00' text", "cast(null as bigint) cents", "'' draft", "false removed")
    table = str(tmp_path / "receipts")
    totals.create(receipts, table)
    late = rows([(i % 4, i, i, 5, "TOTAL 1.00") for i in range(10)], LATE_RESULTS)
    totals.start_applying(spark, _stream(spark, late, str(tmp_path), "seq", 1), table, str(tmp_path / "p")).awaitTermination()
    assert totals.changes(spark, table).count() == 10
    assert _now(spark, table)[9] == 5 and _now(spark, table)[10] is None


def test_intake_runs_again_without_doubles(spark, rows, tmp_path):
    df = rows(
        [("b", i, f"f{i}.pdf", "application/pdf", i % 3 * 4_000_000, 1, None) for i in range(30)],
        "batch_id string, seq bigint, name string, mime string, size bigint, page_count int, open_error string",
    )
    files = _stream(spark, df, str(tmp_path), "seq")
    for _ in range(2):
        intake.start_intake(files, str(tmp_path / "out")).awaitTermination()
    accepted, rejects = (spark.read.parquet(str(tmp_path / "out" / side)) for side in ("accepted", "rejects"))
    assert accepted.count() == 10 and rejects.count() == 20
    assert accepted.select("seq").unionByName(rejects.select("seq")).distinct().count() == 30
