"""Rules over the events of a key, in event order, on a stream whose rows come in any order.

A key is cut into time slices. Rows wait in list state under (bucket of keys, slice) until the watermark passes the end
of the slice; an event-time timer then gives them out together with a summary of what the slice does to the state of each
key. A second query chains the summaries of each key and tells with which state every slice begins. With both, the rows
of a slice are judged without the rest of the key, so a key of any size is spread over its slices and a group
never holds more than one slice of the keys of one bucket. Keys share buckets because every call to the state store costs
the same for one row as for thousands.

Nothing is lost: a row is ``sealed``, or its slice was over when it came (``late``), or it has no time
(``untimed``), or it still waits (``open``, read from the state store).
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from slipstack.streaming.runner import END, drain_to_end, drain_to_table

SEALED, LATE, UNTIMED, OPEN, SUMMARY = "sealed", "late", "untimed", "open", "summary"
#: Buckets of keys; fixed for as long as a checkpoint is used.
BUCKETS = 256
#: Rows given out in one piece.
PIECE = 10_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rule(ABC):
    """What a slice does to the state of its key."""

    #: Columns of a row besides key, us and seq; of a summary; of the state between slices.
    fields: str
    summary: str
    state: str
    start: tuple

    @abstractmethod
    def sums(self, rows: list[tuple]) -> tuple:
        """Summary of the rows (us, seq, *fields) of a slice, in order."""

    @abstractmethod
    def after(self, state: tuple, summary: tuple) -> tuple:
        """State of the key after a slice that it entered with ``state``."""


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.split(" ", 1)) for part in schema.split(", ")]


def _names(schema: str) -> list[str]:
    return [name for name, _ in _fields(schema)]


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


def _in_order(row: tuple) -> tuple:
    return row[0], row[1] is not None, row[1]


class Sealer(StatefulProcessor):
    """Holds the rows (key, us, seq, *fields) of a (bucket, slice) until its end has passed."""

    def __init__(self, rule: Rule, slice_ms: int, kind: str):
        self.rule, self.slice_ms = rule, slice_ms
        row = [("key", kind), ("us", "bigint"), ("seq", "bigint"), *_fields(rule.fields)]
        self.names = [name for name, _ in row]
        self.shape = ", ".join(f"{name} array<{of}>" for name, of in row)

    def init(self, handle) -> None:
        self.handle = handle
        # The rows that come together are one element, column by column.
        self.rows = handle.getListState("rows", self.shape)

    def _out(self, number: int | None, kind: str, held: list[tuple], sums: list[tuple]) -> Iterator[Row]:
        for i in range(0, max(len(held), len(sums)), PIECE):
            yield Row("slice", "kind", "held", "sums")(number, kind, held[i : i + PIECE], sums[i : i + PIECE])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        number, found, pick = key[1], [], None
        for row in rows:
            pick = pick or itemgetter(*[row.__fields__.index(name) for name in self.names])
            found.append(pick(row))
        if number is None:
            yield from self._out(None, UNTIMED, found, [])
            return
        end = (number + 1) * self.slice_ms
        waiting = self.rows.exists()
        if end <= timerValues.getCurrentWatermarkInMs():
            # Only a key whose rows of this slice still wait may add to them.
            known = {k for part in self.rows.get() for k in part[0]} if waiting else set()
            yield from self._out(number, LATE, [r for r in found if r[0] not in known], [])
            found = [r for r in found if r[0] in known]
        if found:
            self.rows.appendValue(tuple(map(list, zip(*found))))
            if not waiting:
                self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        by_key = {}
        for part in self.rows.get():
            for row in zip(*part):
                by_key.setdefault(row[0], []).append(row[1:])
        self.rows.clear()
        held, sums = [], []
        for owner, rows in by_key.items():
            rows.sort(key=_in_order)
            held += [(owner, *row) for row in rows]
            sums.append((owner, *self.rule.sums(rows)))
        yield from self._out(key[1], SEALED, held, sums)

    def close(self) -> None:
        pass


class Chain(StatefulProcessor):
    """Takes the states of the keys of a bucket through the summaries of their slices."""

    def __init__(self, rule: Rule, kind: str):
        self.rule, self.names = rule, ["key", "slice", *_names(rule.summary)]
        self.shape = f"key {kind}, {rule.state}"

    def init(self, handle) -> None:
        self.states = handle.getListState("states", self.shape)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, found, pick = {owner: tuple(state) for owner, *state in self.states.get()}, [], None
        for row in rows:
            pick = pick or itemgetter(*[row.__fields__.index(name) for name in self.names])
            found.append(pick(row))
        found.sort(key=itemgetter(1))
        entries = []
        for owner, number, *summary in found:
            state = known.get(owner, self.rule.start)
            entries.append((owner, number, *state))
            known[owner] = self.rule.after(state, tuple(summary))
        self.states.put([(owner, *state) for owner, state in known.items()])
        for i in range(0, len(entries), PIECE):
            yield Row("entries")(entries[i : i + PIECE])

    def close(self) -> None:
        pass


def sealed_stream(rows: DataFrame, rule: Rule, slice_ms: int, delay_ms: int) -> DataFrame:
    """Stream of ``key, slice, kind, us, seq, <fields>, <summary>`` from a stream of ``key, ts, us, seq, <fields>``.

    ``ts`` moves the watermark; ``us`` is when the row takes effect, in microseconds, which may be later.
    A row at ``runner.END`` only moves the watermark.
    """
    _needs_rocksdb(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()
    fields, summary = _names(rule.fields), _names(rule.summary)
    timed = rows.withWatermark("ts", f"{delay_ms} milliseconds").where(F.col("ts").isNull() | (F.col("ts") != F.lit(END)))
    # Only the number goes on: rows behind the watermark must reach the processor, which says so.
    told = timed.select("key", "us", "seq", *fields)
    number = F.floor(F.col("us") / (slice_ms * 1000)).cast("bigint")
    grouped = told.withColumns({"bucket": _bucket("key"), "slice": number}).groupBy("bucket", "slice")
    held, sums = f"key: {kind}, us: bigint, seq: bigint", f"key: {kind}"
    held += "".join(f", {name}: {of}" for name, of in _fields(rule.fields))
    sums += "".join(f", {name}: {of}" for name, of in _fields(rule.summary))
    out = f"slice bigint, kind string, held array<struct<{held}>>, sums array<struct<{sums}>>"
    packed = grouped.transformWithState(Sealer(rule, slice_ms, kind), out, "append", "eventTime")
    types = {"key": kind, "us": "bigint", "seq": "bigint", **dict(_fields(rule.fields)), **dict(_fields(rule.summary))}

    def row(of: Column, names: list[str], said: Column) -> Column:
        values = [(of[n] if n in names else F.lit(None).cast(t)).alias(n) for n, t in types.items()]
        return F.struct(said.alias("kind"), *values)

    every = F.concat(
        F.transform("held", lambda r: row(r, ["key", "us", "seq", *fields], F.col("kind"))),
        F.transform("sums", lambda r: row(r, ["key", *summary], F.lit(SUMMARY))),
    )
    return packed.select("slice", F.explode(every).alias("r")).select("r.key", "slice", "r.kind", "r.us", "r.seq", *[f"r.{n}" for n in (*fields, *summary)])


def entry_stream(sealed: DataFrame, rule: Rule) -> DataFrame:
    """Stream of ``key, slice, <state>``: the state with which every slice begins.

    ``sealed`` must be read with whole epochs at a time, as a folder written by a streaming query is.
    """
    _needs_rocksdb(sealed.sparkSession)
    kind = sealed.schema["key"].dataType.simpleString()
    summaries = sealed.where(F.col("kind") == SUMMARY).select("key", "slice", *_names(rule.summary))
    entry = f"key: {kind}, slice: bigint" + "".join(f", {name}: {of}" for name, of in _fields(rule.state))
    grouped = summaries.withColumn("bucket", _bucket("key")).groupBy("bucket")
    packed = grouped.transformWithState(Chain(rule, kind), f"entries array<struct<{entry}>>", "append", "none")
    return packed.select(F.explode("entries").alias("e")).select("e.*")


def _needs_rocksdb(spark: SparkSession) -> None:
    """Typed state needs Spark's RocksDB store; set where the session has no choice of its own."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def drained(
    stream: DataFrame, rule: Rule, folder: str, slice_ms: int, delay_ms: int, ended: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run both queries over all that is there: (sealed rows with the state their slice began with, late and untimed, open).

    With ``ended`` nothing is to follow: after the last row time moves on to its end, so that no slice stays open.
    """
    spark = stream.sparkSession
    fields = _names(rule.fields)
    sealing = lambda rows: sealed_stream(rows, rule, slice_ms, delay_ms)
    found = drain_to_end(stream, sealing, f"{folder}/sealed") if ended else drain_to_table(sealing(stream), f"{folder}/sealed")
    summaries = spark.readStream.schema(found.schema).parquet(f"{folder}/sealed/rows")
    entries = drain_to_table(entry_stream(summaries, rule), f"{folder}/entries")
    owner = entries.withColumnsRenamed({"key": "_key", "slice": "_slice"})
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice"))
    columns = ["key", "slice", "us", "seq", *fields]
    sealed = found.where(F.col("kind") == SEALED).select(*columns).join(owner, same).drop("_key", "_slice")
    aside = found.where(F.col("kind").isin(LATE, UNTIMED)).select(*columns, F.col("kind").alias("reason"))
    held = spark.read.format("statestore").option("path", f"{folder}/sealed/progress").option("stateVarName", "rows").load()
    each = F.explode(F.arrays_zip(*[F.col(f"list_element.{n}").alias(n) for n in ("key", "us", "seq", *fields)]))
    waiting = held.select("key.slice", each.alias("r")).select("r.key", "slice", *[f"r.{n}" for n in ("us", "seq", *fields)], F.lit(OPEN).alias("reason"))
    return sealed, aside, waiting
