"""Exact top-k by inner product over a vector-approximation file.

Vectors are dealt evenly into blocks. A block keeps one byte per component (the cell of a uniform
grid between the least and the largest value of that component in the block) beside its ids. A search
first scans the cells only: the centre of the cells gives an estimate, half a cell per component its
largest error, and with them every vector has a lower and an upper bound of its score. What cannot be
among the best k by these bounds is dropped in its block and again over all blocks. Exact vectors are
then read in the order of the bounds, in two waves: the k most promising, whose exact scores fix the
score to beat, and after that the ones whose bound still reaches it. Nothing that could belong to the
result is left out, so recall is 1.

Scale: queries come in blocks as well; blocks of queries meet blocks of cells by an equality join on
the pair of numbers, so the work is spread evenly. Equal vectors of a block count once, with the k + 1
smallest ids, which is all that the result can need of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slipstack.llm.common import stored

ROWS = 4096
QUERIES = 512
CELLS = 256
EXACT = float(1 << 52)


def integers(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); rows with unusable vectors or no id go."""
    x = F.col("embedding")
    bad = F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select(
        "vec_id", F.transform(x, lambda y: F.floor(F.lit(scale) * y.cast("double")).cast("long")).alias("v")
    )


def blocks(rows: DataFrame, size: int, number: str) -> DataFrame:
    """Deal rows evenly into numbered blocks of about the given size."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn(number, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int"))


def matrix(arrays: pa.ListArray) -> np.ndarray:
    """Rows of integers; shorter vectors are padded with zeros, which add nothing to a product."""
    lengths = np.diff(arrays.offsets.to_numpy())
    values = arrays.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if len(lengths) and lengths.min() == width:
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def approximate(found: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lower ends and cell widths; a value x of cell c lies in [low + c * width, low + (c + 1) * width]."""
    low = found.min(axis=0, initial=0).astype(np.float64)
    width = np.maximum((found.max(axis=0, initial=0) - low) / cells, 1e-9)
    return np.minimum((found - low) // width, cells - 1).astype(np.uint8), low, width


def build(rows: DataFrame, k: int, size: int = ROWS) -> DataFrame:
    """The approximation file: vb, rows, dims, ids, codes, low, width (binary), one row per block."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("vec_id")
        ids = group["vec_id"].to_numpy()
        found = matrix(group["v"].combine_chunks())
        if found.shape[1]:
            _, kind = np.unique(found, axis=0, return_inverse=True)
            kind = kind.ravel()
            order = np.argsort(kind, kind="stable")
            first = np.r_[True, kind[order][1:] != kind[order][:-1]]
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            kept = np.sort(order[place <= k])
            ids, found = ids[kept], found[kept]
        codes, low, width = approximate(found)
        return pa.table(
            {
                "vb": pa.array([group["vb"][0].as_py()], pa.int32()),
                "rows": pa.array([len(ids)], pa.int32()),
                "dims": pa.array([found.shape[1]], pa.int32()),
                "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                "codes": pa.array([codes.tobytes()], pa.binary()),
                "low": pa.array([low.tobytes()], pa.binary()),
                "width": pa.array([width.tobytes()], pa.binary()),
            }
        )

    schema = "vb int, rows int, dims int, ids binary, codes binary, low binary, width binary"
    return blocks(rows, size, "vb").groupBy("vb").applyInArrow(pack, schema)


def bounds(asked: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries x vectors) of the products, from the cells alone."""
    dims = min(asked.shape[1], codes.shape[1])
    q = asked[:, :dims].astype(np.float64)
    centre = low[:dims] + (codes[:, :dims] + 0.5) * width[:dims]
    estimate = q @ centre.T
    error = np.abs(q) @ (0.5 * width[:dims])
    slack = 1 + 1e-12 * (np.abs(q) @ np.abs(centre).max(axis=0, initial=0))  # rounding of the sums
    return estimate - (error + slack)[:, None], estimate + (error + slack)[:, None]


def candidates(queries: DataFrame, file: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, low, high): all that can be among the best k of its block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(row["rows"], row["dims"])
                asked_ids = np.frombuffer(row["asked_ids"], np.int64)
                asked = np.frombuffer(row["asked"], np.int64).reshape(len(asked_ids), -1)
                least, most = bounds(asked, codes, np.frombuffer(row["low"]), np.frombuffer(row["width"]))
                own = asked_ids[:, None] == ids[None, :]
                least[own] = -np.inf
                keep = ~own
                if len(ids) > k:
                    keep &= most >= np.partition(least, len(ids) - k, axis=1)[:, [len(ids) - k]]
                a, b = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked_ids[a]), pa.array(ids[b]), pa.array(least[a, b]), pa.array(most[a, b])], ["query_id", "vec_id", "low", "high"]
                )

    def gather(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("vec_id")
        return pa.table(
            {
                "qb": pa.array([group["qb"][0].as_py()], pa.int32()),
                "asked_ids": pa.array([group["vec_id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
                "asked": pa.array([matrix(group["v"].combine_chunks()).astype(np.int64).tobytes()], pa.binary()),
            }
        )

    asked = stored(blocks(queries, QUERIES, "qb").groupBy("qb").applyInArrow(gather, "qb int, asked_ids binary, asked binary"))
    n_asked, n_blocks = asked.agg(F.max("qb")).first()[0], file.agg(F.max("vb")).first()[0]
    left = file.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_asked or 0))))
    right = asked.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks or 0))))
    pairs = left.join(right.hint("shuffle_hash"), ["vb", "qb"]).select("rows", "dims", "ids", "codes", "low", "width", "asked_ids", "asked")
    return pairs.mapInArrow(scan, "query_id long, vec_id long, low double, high double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Best k of ``vectors`` for each of ``queries`` (both vec_id, v as ``integers`` gives them).

    Returns query_id, rank, vec_id, score; ties go to the smaller vec_id, a query is never its own
    result, repeated rows of one id count once if their vectors agree. Sums are exact 64-bit integers.
    """
    rows, asked = vectors.distinct(), queries.distinct()
    file = stored(build(rows, k))
    found = stored(candidates(asked, file, k))
    best_low = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")
    floor = (
        found.select("query_id", "vec_id", "low")
        .withColumn("place", F.row_number().over(best_low))
        .where(F.col("place") <= k)
        .groupBy("query_id")
        .agg(F.min("low").alias("floor"), F.count("*").alias("have"))
    )
    hopeful = (
        found.join(floor, "query_id").where((F.col("high") >= F.col("floor")) | (F.col("have") < k)).select("query_id", "vec_id", "high")
    )
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id")
    ordered = stored(hopeful.withColumn("place", F.row_number().over(by_bound)))

    def exact(pairs: DataFrame) -> DataFrame:
        product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
        return (
            pairs.join(rows, "vec_id")
            .join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
            .select("query_id", "vec_id", product.alias("score"))
        )

    first = stored(exact(ordered.where(F.col("place") <= k)))
    to_beat = first.groupBy("query_id").agg(F.min("score").alias("least"))
    second = exact(ordered.where(F.col("place") > k).join(to_beat, "query_id").where("high >= least").select("query_id", "vec_id"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(second)
        .withColumn("rank", F.row_number().over(by_score).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
