"""Helpers that several operators share: words, tables, scratch tables, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipstack.session import cut_lineage, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the words of a text, split at ASCII white space."""
    return F.array_remove(F.split(fold(text), SPACE), "")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; -1 for a null id, which is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % by, F.lit(-1)).cast("int")


def stored(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage is cut, executors may go."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class WordHashes(dict):
    """64-bit hash of each word, kept for as many words as fit the bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public domain constants), for whole arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component): the smallest node that each can reach.

    Large-star and small-star steps in turn: every step replaces edges by links to the smallest
    neighbour, so the number of edges does not grow and the depth falls geometrically. Ends when every
    node but the roots has one link, to a root.
    """
    current = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        ends = current.select("a", F.lit(1).alias("up")).unionAll(current.select("b", F.lit(0)))
        knots = ends.groupBy("a").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 or (up = 1 and n > 1)")
        if knots.isEmpty():
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join deals out both sides anew and a node with very many links can be split.
        lowest = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        down = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        pair = lambda x: F.struct(F.col(x).alias("a"), F.col("m").alias("b"))
        small = down.join(least, "a").select(F.explode(F.array(pair("a"), pair("b"))).alias("e")).select("e.*")
        current = cut_lineage(small.where("a > b").distinct())


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", salts: int = 64) -> DataFrame:
    """Join ``right`` (one row per key, with the size of the group in ``n``) to the rows of ``left``.

    Keys with a thousandth of all rows or more, thus a thousand at most, are spread over salts on the
    left and repeated on the right; all others join as they are. ``right`` should be a stored table.
    """
    rows = right.agg(F.sum("n")).first()[0] or 0
    least = max(10_000, rows // 1000)
    hot = right.where(F.col("n") >= least).select(F.col(key), F.lit(True).alias("_hot"))
    if hot.isEmpty():
        return left.join(right.drop("n"), key, how)
    salted = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    )
    spread = right.withColumn(
        "_salt", F.explode(F.when(F.col("n") >= least, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return salted.join(spread.drop("n"), [key, "_salt"], how).drop("_salt", "_hot")


def streamed_sha256(rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """(key, one lower-case SHA-256 per value column) over the binary values of each key, chained in order.

    The rows of a key meet in one task because the digest is sequential, but they pass through it one after the
    other: nothing but the state of the digests is held, however many rows a key has. Null values add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digests = None, []

        def done(ended: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([k for k, _ in ended], type=kind)]
            columns += [pa.array([d[i].hexdigest() for _, d in ended], pa.string()) for i in range(len(values))]
            return pa.RecordBatch.from_arrays(columns, [key, *values])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            ended = []
            for found, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not digests or found != current:
                    if digests:
                        ended.append((current, digests))
                    current, digests = found, [hashlib.sha256() for _ in values]
                for digest, text in zip(digests, texts, strict=True):
                    digest.update(text or b"")
            if ended:
                yield done(ended)
        if digests:
            yield done([(current, digests)])

    schema = T.StructType([rows.schema[key], *[T.StructField(v, T.StringType()) for v in values]])
    dealt = rows.repartition(key).sortWithinPartitions(key, order)
    return dealt.select(key, *values).mapInArrow(run, schema)
