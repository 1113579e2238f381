"""R-01: continuous intake: files are judged as they arrive, late comers included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipstack.operators.intake import classify, quarantine, split


def start_intake(files: DataFrame, folder: str):
    """Judge a stream of files into ``accepted`` and ``rejects`` under ``folder``.

    Each micro-batch writes its own ``epoch`` partition and overwrites only that, so
    a replay after a lost driver writes the same rows again instead of twice.
    """

    def judge(rows: DataFrame, epoch: int) -> None:
        # Both sides are written from one reading of the micro-batch.
        judged = classify(rows).persist()
        try:
            accepted, refused = split(judged)
            sides = {"accepted": accepted, "rejects": quarantine(refused)}
            for name, side in sides.items():
                (
                    side.withColumn("epoch", F.lit(epoch))
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy("epoch")
                    .parquet(f"{folder}/{name}")
                )
        finally:
            judged.unpersist()

    return (
        files.writeStream.foreachBatch(judge)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
