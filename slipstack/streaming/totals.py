"""R-08 as a stream: late results for a receipts table, merged on read.

The table has a base and a change log. A micro-batch appends the results that are accepted, so what it writes grows
with them and not with the table. Readers put the log over the base. ``compact`` folds the log into a new version
of the buckets that it touches; a version counts once its commit record is complete, so a crash leaves the old one.

    base/bucket=<b>/upto=<epoch>/   receipts of a bucket with all changes up to an epoch
    changes/epoch=<epoch>/          accepted results
    commits/upto=<epoch>/           buckets that have a base of that version
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipstack.operators.extraction import apply_totals

#: The version that ``create`` writes, before any epoch.
FIRST = -1
CHANGES = "bucket int, receipt_id bigint, new_cents bigint, epoch bigint"


def _folder(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a finished job has written there."""
    path, files = _folder(spark, f"{folder}/_SUCCESS")
    return files.exists(path)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete parts (``name=<number>``) of a folder."""
    path, files = _folder(spark, folder)
    if not files.exists(path):
        return []
    parts = [status.getPath().toString() for status in files.listStatus(path)]
    return sorted(int(p.rsplit("=", 1)[1]) for p in parts if "=" in p.rsplit("/", 1)[1] and is_complete(spark, p))


def create(receipts: DataFrame, table: str) -> None:
    """Write the first version; ``receipts`` has an integer ``bucket``, such as a hash of the receipt id."""
    _publish(receipts, table, FIRST)


def _publish(receipts: DataFrame, table: str, upto: int) -> None:
    written = receipts.withColumns({"bucket": F.col("bucket").cast("int"), "upto": F.lit(upto).cast("bigint")})
    dynamic = written.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    dynamic.partitionBy("bucket", "upto").parquet(f"{table}/base")
    done = receipts.sparkSession.read.parquet(f"{table}/base").where(F.col("upto") == upto)
    done.select("bucket").distinct().coalesce(1).write.mode("overwrite").parquet(f"{table}/commits/upto={upto}")


def versions(spark: SparkSession, table: str) -> DataFrame:
    """``bucket, upto``: the newest version of every bucket; a row per bucket, so small."""
    found = _numbers(spark, f"{table}/commits")
    commits = spark.read.option("basePath", f"{table}/commits").parquet(*[f"{table}/commits/upto={n}" for n in found])
    return commits.groupBy("bucket").agg(F.max("upto").cast("bigint").alias("upto"))


def changes(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """The accepted results of complete epochs, of those before an epoch if given."""
    epochs = [n for n in _numbers(spark, f"{table}/changes") if before is None or n < before]
    if not epochs:
        return spark.createDataFrame([], CHANGES)
    paths = [f"{table}/changes/epoch={n}" for n in epochs]
    return spark.read.schema(CHANGES).option("basePath", f"{table}/changes").parquet(*paths)


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """The receipts as they are now: the newest base of each bucket under the changes that it does not hold yet."""
    newest = F.broadcast(versions(spark, table))
    base = spark.read.parquet(f"{table}/base").join(newest, ["bucket", "upto"]).drop("upto")
    log = changes(spark, table, before).join(newest, "bucket").where("epoch > upto")
    first = log.groupBy("bucket", "receipt_id").agg(F.min_by("new_cents", "epoch").alias("_new"))
    return base.join(first, ["bucket", "receipt_id"], "left").withColumn("cents", F.coalesce("cents", "_new")).drop("_new")


def start_applying(spark: SparkSession, results: DataFrame, table: str, progress: str):
    """Apply a stream of ``bucket, receipt_id, seq, new_cents, seen_text`` to the receipts at ``table``.

    Only buckets with a usable result are read. If several results fit a receipt, the earliest wins. An
    epoch that is replayed judges against the epochs before it and writes its part of the log anew.
    """

    def apply(rows: DataFrame, epoch: int) -> None:
        usable = rows.filter(F.col("new_cents").isNotNull())
        before = current(spark, table, epoch).join(usable.select("bucket").distinct(), "bucket", "left_semi")
        done = apply_totals(before.filter(F.col("cents").isNull()), usable).filter(F.col("cents").isNotNull())
        accepted = done.select("bucket", "receipt_id", F.col("cents").alias("new_cents"))
        accepted.write.mode("overwrite").parquet(f"{table}/changes/epoch={epoch}")

    return (
        results.writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{progress}/offsets")
        .trigger(availableNow=True)
        .start()
    )


def compact(spark: SparkSession, table: str) -> int | None:
    """Write the buckets with changes anew, with all complete epochs in them; gives the version, None if there is nothing to do."""
    epochs = _numbers(spark, f"{table}/changes")
    held = changes(spark, table).join(F.broadcast(versions(spark, table)), "bucket").where("epoch > upto")
    touched = held.select("bucket").distinct()
    if not epochs or touched.isEmpty():
        return None
    _publish(current(spark, table).join(touched, "bucket", "left_semi"), table, epochs[-1])
    return epochs[-1]
