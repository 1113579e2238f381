"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Collection
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_scratch: list[str] = []


def local_session(app: str = "slipstack", cores: str = "*") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    parallel = "8" if cores == "*" else cores
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; one of our own only for local masters."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="slipstack-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables in the shared checkpoint area, noted for ``clear_scratch``."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"
    _scratch.append(path)
    return path


def noted_scratch() -> list[str]:
    """The intermediate folders noted so far, oldest first."""
    return list(_scratch)


def clear_scratch(spark: SparkSession, keep: Collection[str] = ()) -> None:
    """Remove the intermediate folders of this process but those to keep.

    For after a result has been written: frames that still read from such a folder end with it.
    """
    for path in [p for p in _scratch if p not in keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _scratch.remove(path)
