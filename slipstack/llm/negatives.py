"""Hard negatives by inner product, candidates found by pruning coordinates within length buckets.

Rows are put in order of their length (norm) and cut into buckets. A bucket keeps its vectors and, for every
coordinate, the order of its rows by the value that the vector has there once it is scaled to length one. An anchor that
needs a score of at least t passes over a bucket whose longest vector is too short for it. Otherwise t sets the least
cosine, and that bounds the values which a row can have at a coordinate: the anchor's largest coordinates are its focus,
each gives one range of its sorted list, and only rows in all of these ranges are multiplied exactly.

Both searches are exact. The positives of an anchor are its best rows of the same label; each positive then sets a
range of scores in which the best rows of other labels are its hard negatives. Each search goes over the first bucket of
every file part to raise the least useful score, then over all the others.

Scale: buckets are made by range partitions on (length, id), so equal vectors are spread; anchors are broadcast in
blocks of bounded size, so vectors are shuffled once; more anchors than a broadcast holds go over the file in
turns. A bucket gives an anchor at most k rows for a positive, and these are reduced per task and per salt before they
meet per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipstack.llm.common import stored
from slipstack.llm.vafile import matrix

ROWS = 2048
ANCHORS = 256
FOCUS = 4
SALTS = 64
#: Anchors are broadcast in turns of up to this many components (8 bytes each).
MOST_BROADCAST = 2_000_000
NONE, ALL = -(1 << 62), 1 << 62
FILE = "first boolean, rows int, dims int, kind string, longest double, ids binary, labels binary, vectors binary, orders binary"
BLOCK = "block int, anchors binary, a_dims int, slots int, a_ids binary, a_labels binary, a_vectors binary, floors binary, ceilings binary"
FOUND = "anchor long, slot int, vec_id long, score long"


def integers(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v): components as floor(scale * x); rows without id, label or a usable vector go."""
    x = F.col("embedding")
    bad = F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad)
    v = F.transform(x, lambda y: F.floor(F.lit(scale) * y.cast("double")).cast("long"))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def smallest(values: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = values.min(initial=0), values.max(initial=0)
    kinds = (np.int8, np.int16, np.int32, np.int64)
    return values.astype(next(k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the vectors scaled to length one (a zero vector stays)."""
    real = vectors.astype(np.float64)
    lengths = np.sqrt(np.einsum("ij,ij->i", real, real))
    return lengths, real / np.where(lengths > 0, lengths, 1)[:, None]


def record(values: dict, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values[n]], kinds[k]) for n, k in fields], [n for n, _ in fields])


def build(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """The file of buckets; rows that are equal in id, label and vector count once."""

    def bucket(first: bool, ids: np.ndarray, labels: np.ndarray, found: pa.ListArray) -> pa.RecordBatch:
        vectors = matrix(found)
        lengths, unit = units(vectors)
        kept, orders = smallest(vectors), np.argsort(unit, axis=0, kind="stable").astype(np.uint32)
        values = {"first": first, "rows": len(vectors), "dims": vectors.shape[1], "kind": kept.dtype.str, "longest": float(lengths.max(initial=0))}
        values |= {"ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": kept.tobytes(), "orders": smallest(orders).T.tobytes()}
        return record(values, FILE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, first, last = None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, vectors = (batch.column(i) for i in range(3))
            keep = np.ones(batch.num_rows, bool)
            near = np.r_[True, ids.to_numpy()[1:] == ids.to_numpy()[:-1]]
            for i in np.flatnonzero(near):  # equal rows are neighbours
                before = last if i == 0 else (ids[i - 1].as_py(), labels[i - 1].as_py(), vectors[i - 1])
                keep[i] = before != (ids[i].as_py(), labels[i].as_py(), vectors[i])
            last = (ids[-1].as_py(), labels[-1].as_py(), vectors[-1])
            table = pa.Table.from_batches([batch]).filter(pa.array(keep))
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            while waiting.num_rows >= size:
                full, waiting = waiting.slice(0, size).combine_chunks(), waiting.slice(size)
                yield bucket(first, full["vec_id"].to_numpy(), full["label"].to_numpy(), full["v"].combine_chunks())
                first = False
        if waiting is not None and waiting.num_rows:
            full = waiting.combine_chunks()
            yield bucket(first, full["vec_id"].to_numpy(), full["label"].to_numpy(), full["v"].combine_chunks())

    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dealt = rows.select("vec_id", "label", "v", length.alias("length")).repartitionByRange(F.desc("length"), F.desc("vec_id"))
    ordered = dealt.sortWithinPartitions(F.desc("length"), F.desc("vec_id"), "label", "v").select("vec_id", "label", "v")
    return ordered.mapInArrow(cut, FILE)


def blocks(anchors: DataFrame) -> tuple[DataFrame, int, int]:
    """Anchors (anchor, vec_id, label, v, floors, ceilings) dealt evenly into blocks; their number, and blocks per turn."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).combine_chunks()
        vectors, floors, ceilings = (matrix(table[c].combine_chunks()) for c in ("v", "floors", "ceilings"))
        values = {"block": TaskContext.get().partitionId(), "a_dims": vectors.shape[1], "slots": floors.shape[1]}
        values |= {n: table[c].to_numpy().tobytes() for n, c in (("anchors", "anchor"), ("a_ids", "vec_id"), ("a_labels", "label"))}
        values |= {n: m.astype(np.int64).tobytes() for n, m in (("a_vectors", vectors), ("floors", floors), ("ceilings", ceilings))}
        yield record(values, BLOCK)

    size = anchors.agg(F.count("*"), F.sum(F.size("v"))).first()
    n = max(1, -(-size[0] // ANCHORS))
    turn = max(1, MOST_BROADCAST * n // max(1, size[1] or 0))
    columns = anchors.select("anchor", "vec_id", "label", "v", "floors", "ceilings")
    return stored(columns.repartition(n).mapInArrow(pack, BLOCK)), n, turn


def hopeful(unit: np.ndarray, orders: np.ndarray, longest: float, q: np.ndarray, least: int) -> np.ndarray | None:
    """Rows of a bucket that can score ``least`` with q, by the focus coordinates of q; None for all of them."""
    length = float(np.sqrt(q @ q))
    if least <= 0:
        return None
    if least > length * longest * (1 + 1e-9):
        return np.empty(0, np.int64)
    cosine, direction = least / (length * longest) * (1 - 1e-9), q / length
    focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
    hits = np.zeros(len(unit), np.int64)
    for f in focus:
        x = direction[f]
        reach = np.sqrt(max(0.0, (1 - x * x) * (1 - cosine * cosine)))
        low = -1.0 if -x >= cosine else x * cosine - reach
        high = 1.0 if x >= cosine else x * cosine + reach
        values = unit[orders[f], f]
        a, b = np.searchsorted(values, low - 1e-9, "left"), np.searchsorted(values, high + 1e-9, "right")
        hits[orders[f][a:b]] += 1
    return np.flatnonzero(hits == len(focus))


def scan(pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, slot, vec_id, score): the best k of each bucket for each anchor and slot, within its range of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, asked = row["rows"], np.frombuffer(row["anchors"], np.int64)
                dims = min(row["dims"], row["a_dims"])
                vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(n, row["dims"])
                unit = units(vectors)[1][:, :dims]
                orders = np.frombuffer(row["orders"], f"i{len(row['orders']) // max(1, n * row['dims'])}" if row["dims"] else "i1").reshape(row["dims"], n)
                ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
                own_ids, own_labels = (np.frombuffer(row[c], np.int64) for c in ("a_ids", "a_labels"))
                questions = np.frombuffer(row["a_vectors"], np.int64).reshape(len(asked), row["a_dims"])[:, :dims]
                floors, ceilings = (np.frombuffer(row[c], np.int64).reshape(len(asked), row["slots"]) for c in ("floors", "ceilings"))
                most = float(np.abs(vectors.astype(np.float64)).max(initial=0)) * float(np.abs(questions.astype(np.float64)).max(initial=0))
                exact = np.float64 if most * max(1, dims) < 1 << 53 else np.int64  # sums of doubles are exact below 2**53
                numbers = vectors[:, :dims].astype(exact)
                out = []
                for i, q in enumerate(questions):
                    open_slots = np.flatnonzero(floors[i] <= ceilings[i])
                    if not len(open_slots):
                        continue
                    at = hopeful(unit, orders, row["longest"], q.astype(np.float64), int(floors[i][open_slots].min()))
                    at = np.arange(n) if at is None else at
                    at = at[((labels[at] == own_labels[i]) == same) & (ids[at] != own_ids[i])]
                    scores = (numbers[at] @ q.astype(exact)).astype(np.int64)
                    order = np.lexsort((ids[at], -scores))
                    at, scores = at[order], scores[order]
                    for slot in open_slots:
                        chosen = np.flatnonzero((scores >= floors[i][slot]) & (scores <= ceilings[i][slot]))[:k]
                        out += [(asked[i], slot, ids[at[j]], scores[j]) for j in chosen]
                found = np.array(out, np.int64).reshape(-1, 4)
                columns = [pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2]), pa.array(found[:, 3])]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "slot", "vec_id", "score"])

    return pairs.mapInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The best k of each anchor and slot as ``rank``: first per salt, then over all."""
    order = [F.desc("score"), "vec_id"]
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    some = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "slot", "salt").orderBy(*order)))
    few = some.where(F.col("rank") <= k).drop("salt", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*order)).cast("int")).where(F.col("rank") <= k)


def search(file: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, slot, rank, vec_id, score): the best k rows for each slot of the anchors.

    A slot takes rows of the anchor's own label (``same``) or of others with floor <= score <= ceiling; ties go to
    the smaller vec_id; rows with the vec_id of the anchor are left out.
    """

    def meet(part: DataFrame, anchors: DataFrame) -> DataFrame:
        asked, n, turn = blocks(anchors)
        turns = []
        for start in range(0, n, turn):
            numbered = part.withColumn("block", F.explode(F.sequence(F.lit(start), F.lit(min(n, start + turn) - 1))))
            now = asked.where(F.col("block").between(start, start + turn - 1))
            turns.append(stored(best(scan(numbered.join(F.broadcast(now), "block"), k, same), k)))
        return reduce(DataFrame.unionByName, turns)

    first = meet(file.where("first"), anchors)
    reached = first.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    by_slot = reached.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("reached"))
    floors = F.transform("floors", lambda f, i: F.greatest(f, F.coalesce(F.col("reached")[i], f)))
    raised = stored(anchors.join(by_slot, "anchor", "left").withColumn("floors", floors).drop("reached"))
    second = meet(file.where("not first"), raised)
    return best(first.drop("rank").unionByName(second.drop("rank")), k)


def hundredth(x: Column, up: bool) -> Column:
    """x / 100 rounded up or down, in whole numbers."""
    part = lambda y: F.call_function("div", y, F.lit(100).cast("long"))
    return F.when(x >= 0, part(x + 99 if up else x)).otherwise(part(x if up else x - 99))


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """Hard negatives of each anchor and positive among ``vectors`` (both vec_id, label, v as ``integers`` gives them).

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. The positives are the best
    rows of the anchor's label; the negatives are the best rows of other labels whose score lies between ``least`` and
    ``most`` percent of the positive's. Equal rows count once; different rows with one vec_id are rows of their own and as
    anchors give results of their own. Anchors without positives or negatives give no rows; empty tables neither.
    """
    file = stored(build(vectors))
    asked = stored(anchors.select("vec_id", "label", "v").distinct()).withColumn("anchor", F.monotonically_increasing_id())
    asked = stored(asked)
    open_ended = asked.withColumns({"floors": F.array(F.lit(NONE)), "ceilings": F.array(F.lit(ALL))})
    chosen = search(file, open_ended, positives, True)
    per_anchor = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    ranges = {
        "floors": F.transform("positives", lambda x: hundredth(x["score"] * least, up=True)),
        "ceilings": F.transform("positives", lambda x: hundredth(x["score"] * most, up=False)),
    }
    asked = stored(asked.join(per_anchor, "anchor").withColumns(ranges))
    found = search(file, asked, negatives, False)
    facts = asked.select("anchor", F.col("vec_id").alias("anchor_id"), "positives")
    positive = F.col("positives")[F.col("slot")]
    return found.join(facts, "anchor").select(
        "anchor_id", positive["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
