"""Variable-capacity best-fit packing of documents into training sequences.

A document is cut into pieces no longer than the largest permitted length. Pieces are dealt into
groups of bounded size by a hash; each group is packed by itself, longest piece first. A piece goes
into the open bin that it fills best. Where none has room, the permitted lengths compete: a length is
priced by its cost per token that it can be expected to hold, which is the piece itself and as much of
the shorter pieces still to come as fits, and the cheapest is opened. At the end every bin is reduced
to the least permitted length that holds its contents.

Scale: only ids and lengths are shuffled, never text. A group is one Arrow batch of fixed expected
size whatever the input; its last bins are the only loss against packing all at once.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipstack.llm.common import lookup, stored

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16
GROUP = 50_000
#: Rows of one id and piece that are more than this part of a group are dealt one by one.
MANY = 10
PACKED = "doc_id long, piece int, start long, n_tokens int, bin_id long, bin_offset int, bin_tokens int, capacity int"


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens: the words of the text at ASCII white space, and one end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(text.split()) + 1 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select("doc_id", text).mapInArrow(count, "doc_id long, n_tokens long")


def pieces(lengths: DataFrame, longest: int) -> DataFrame:
    """doc_id, piece, start, n_tokens: documents cut at multiples of the longest length."""
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_tokens") - 1, F.lit(0)), F.lit(longest).cast("long"))
    return lengths.where("n_tokens > 0").select("doc_id", "n_tokens", F.posexplode(cuts).alias("piece", "start")).select(
        "doc_id", "piece", "start", F.least(F.lit(longest), F.col("n_tokens") - F.col("start")).cast("int").alias("n_tokens")
    )


def cheapest(need: int, coming: int, lengths: tuple[int, ...], overhead: float) -> int:
    """The permitted length with the least cost per token it can be expected to hold; ties: the shortest."""
    return min((c for c in lengths if c >= need), key=lambda c: ((c + overhead) / min(c, need + coming), c))


def best_fit(sizes: list[int], lengths: tuple[int, ...], overhead: float = OVERHEAD) -> tuple[list[int], list[int]]:
    """Pack sizes, given longest first: the bin of each, and the final capacity of each bin.

    Of bins with equal room the one opened last is taken.
    """
    coming = sum(sizes)
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    bins_by_room: dict[int, list[int]] = {}
    where, filled = [], []
    for size in sizes:
        coming -= size
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            chosen = bins_by_room[room].pop()
            if not bins_by_room[room]:
                del bins_by_room[room], rooms[at]
        else:
            room, chosen = cheapest(size, coming, lengths, overhead), len(filled)
            filled.append(0)
        where.append(chosen)
        filled[chosen] += size
        room -= size
        if room:
            if room not in bins_by_room:
                bins_by_room[room] = []
                insort(rooms, room)
            bins_by_room[room].append(chosen)
    return where, [lengths[bisect_left(lengths, x)] for x in filled]


def pack(lengths_of: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, group: int = GROUP) -> DataFrame:
    """Pack ``lengths_of(doc_id, n_tokens)``; one row per piece, columns as in PACKED.

    Rows with a null or non-positive length have no piece. A null doc_id packs like any other, equal
    rows are packed as often as they occur. The result depends only on the rows, not on their order.
    """
    lengths = tuple(sorted(set(lengths)))
    cut = stored(pieces(lengths_of.select("doc_id", "n_tokens"), lengths[-1]))  # counted, then dealt
    n = max(1, -(-cut.count() // group))
    key = F.xxhash64("doc_id", "piece")
    # Many rows of one id and piece, or of none, would make one lot: they are dealt by their place in the stored table.
    many = stored(cut.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > max(1, group // MANY)).withColumn("common", F.lit(True)))
    lot = key
    if not many.isEmpty():
        cut = lookup(cut.withColumns({"key": key, "place": F.monotonically_increasing_id()}), many, "key")
        lot = F.when(F.col("common"), F.xxhash64("key", "place")).otherwise(F.col("key"))
    dealt = cut.withColumn("lot", F.pmod(lot, F.lit(n))).select("doc_id", "piece", "start", "n_tokens", "lot")

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = table["n_tokens"].to_pylist()
        where, capacity = best_fit(sizes, lengths, overhead)
        filled, offsets = [0] * len(capacity), []
        for bin_no, size in zip(where, sizes, strict=True):
            offsets.append(filled[bin_no])
            filled[bin_no] += size
        first = table["lot"][0].as_py() << 32
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "piece": table["piece"],
                "start": table["start"],
                "n_tokens": table["n_tokens"],
                "bin_id": pa.array([first + x for x in where], pa.int64()),
                "bin_offset": pa.array(offsets, pa.int32()),
                "bin_tokens": pa.array([filled[x] for x in where], pa.int32()),
                "capacity": pa.array([capacity[x] for x in where], pa.int32()),
            }
        )

    return dealt.groupBy("lot").applyInArrow(fill, PACKED)
