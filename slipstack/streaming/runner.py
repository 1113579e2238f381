"""Common pieces of the streaming jobs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipstack.session import scratch_path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint area."""
    return scratch_path(spark, f"stream-{name}")


def drain_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process everything that is there now into a parquet table and read it back."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


#: The time of a row that belongs to no key and only moves the watermark on.
END = datetime(9999, 1, 1, tzinfo=timezone.utc)


def drain_to_end(rows: DataFrame, query: Callable[[DataFrame], DataFrame], folder: str, ts: str = "ts") -> DataFrame:
    """Process everything that is there now, then end the stream: a last row at ``END`` closes whatever waits for time."""
    spark, last = rows.sparkSession, f"{folder}/end"
    spark.createDataFrame([], rows.schema).write.parquet(last)
    both = rows.unionByName(spark.readStream.schema(rows.schema).parquet(last))
    drain_to_table(query(both), folder)
    blank = [F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in rows.schema]
    spark.range(1).select(*blank).write.mode("append").parquet(last)
    return drain_to_table(query(both), folder)
