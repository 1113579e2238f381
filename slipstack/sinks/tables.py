"""Result tables on shared storage.

Batches are small and there are very many of them, so tables are partitioned by a hash
bucket of the batch, not by the batch itself.  Spark rebalances the rows before the
write: small buckets share a task, an oversized one is split over several files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256


def bucket_of(key: str = "batch_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, folder: str, kind: str = "parquet", buckets: int = BUCKETS) -> None:
    """Replace ``folder`` with ``df``, partitioned by the bucket of ``batch_id``."""
    placed = df.withColumn("bucket", bucket_of(buckets=buckets)).hint("rebalance", "bucket")
    placed.write.mode("overwrite").partitionBy("bucket").format(kind).save(folder)


def write_sides(accepted: DataFrame, rejects: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """S-10: accepted and refused files side by side."""
    write_bucketed(accepted, f"{folder}/accepted", buckets=buckets)
    write_bucketed(rejects, f"{folder}/rejects", buckets=buckets)


def write_manifest(rows: DataFrame, nested: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """S-06: the export rows as parquet and one JSON object per sheet."""
    write_bucketed(rows, f"{folder}/slots", buckets=buckets)
    write_bucketed(nested, f"{folder}/sheets", "json", buckets)
