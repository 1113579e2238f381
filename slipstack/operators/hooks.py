"""Seams: what a caller plugs in (page counters, scorers), run once per row or chunk.

The library decodes no documents and runs no models.  A caller's function is called
inside Spark tasks; its failures become data, never failed tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipstack.operators.selection import equal_areas
from slipstack.session import scratch_path

# A piece of a failed batch with no more lines than this is set aside, to be taken apart by all tasks.
TOGETHER = 64
COUNTED = T.StructType().add("page_count", T.IntegerType()).add("open_error", T.StringType())


def with_page_counts(files: DataFrame, count: Callable[[bytes], int], content: str = "content") -> DataFrame:
    """U-02: adds ``page_count`` and ``open_error`` by a caller's counter.

    ``PermissionError`` means a password, any other failure an unreadable file.  Put
    the size gate (F-05) in front, so that refused files are never opened.
    """

    def one(data) -> tuple[int | None, str | None]:
        try:
            return int(count(bytes(data))), None
        except PermissionError:
            return None, "password"
        except Exception:  # noqa: BLE001 - any other reason reads the same
            return None, "other"

    @F.pandas_udf(COUNTED)
    def counted(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(d) for d in data], columns=COUNTED.names).astype({"page_count": "Int32"})

    return files.withColumn("_c", counted(content)).select(
        *files.columns, F.col("_c.page_count").alias("page_count"), F.col("_c.open_error").alias("open_error")
    )


def scored(
    lines: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str, width: str = "width", parts: int | None = None
) -> DataFrame:
    """U-03: a caller's scorer over lines of like width, one result row per line.

    ``schema`` is that of the scorer's frame, which names its lines by the unique ``key``.
    Tasks get lines of like width and the same padded area each (``equal_areas``), so the batches a scorer
    gets need little padding, a common width is cut and wide lines do not pile up.  A batch that fails is
    halved and tried again; a line that fails alone, or that the scorer leaves out,
    has nulls and the reason in ``error``.  Lines of one width that fail stand in one task, so
    pieces that still fail are dealt to all tasks before each line is tried alone.  Calling this runs the
    scorer: results are written to the checkpoint folder, so that no batch is scored twice for that.
    """
    parts = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = equal_areas(lines, parts, key, width).drop("_part")
    names = T.StructType.fromDDL(schema).names

    line = [f"_line_{c}" for c in near.columns]
    columns = [*names, "error"]

    def tries(frame: pd.DataFrame, least: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame | None, str]]:
        """Pieces with their results, or with none and the reason: these have at most ``least`` lines."""
        pieces = [(0, len(frame))] if len(frame) else []
        while pieces:
            a, b = pieces.pop()
            piece = frame.iloc[a:b]
            try:
                found = score(piece)
            except Exception as failed:  # noqa: BLE001 - one bad row must not lose its batch
                if b - a > least:
                    middle = (a + b) // 2
                    pieces += [(middle, b), (a, middle)]
                else:
                    yield piece, None, str(failed) or type(failed).__name__
                continue
            yield piece, found, ""

    def explained(piece: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        whole = piece[[key]].merge(found, on=key, how="left", indicator="_met")
        whole["error"] = [None if m == "both" else "no result" for m in whole["_met"]]
        return whole[columns]

    def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            late = []
            for piece, found, _ in tries(frame, TOGETHER):
                if found is None:
                    late.append(piece)
                else:
                    yield explained(piece, found).assign(**dict.fromkeys(line), _aside=False)
            if late:
                yield pd.concat(late).add_prefix("_line_").assign(**dict.fromkeys(columns), _aside=True)[[*columns, *line, "_aside"]]

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lost = []  # a frame for each would cost more than trying it
            for piece, found, reason in tries(frame, 1):
                if found is None:
                    lost.append((piece[key].iat[0], reason))
                else:
                    yield explained(piece, found)
            if lost:
                told = pd.DataFrame(lost, columns=[key, "error"]).astype({key: frame[key].dtype})
                yield told.assign(**{n: None for n in names if n != key})[columns]

    told = T.StructType.fromDDL(f"{schema}, error string")
    held = T.StructType([*told, *[T.StructField(f"_line_{f.name}", f.dataType) for f in near.schema], T.StructField("_aside", T.BooleanType())])
    folder = scratch_path(lines.sparkSession, "scored")
    near.sortWithinPartitions(width, key).mapInPandas(together, held).write.parquet(folder)
    first = lines.sparkSession.read.schema(held).parquet(folder)
    aside = first.filter("_aside").select(*[F.col(f"_line_{c}").alias(c) for c in near.columns]).repartition(parts)
    again = aside.sortWithinPartitions(width, key).mapInPandas(alone, told)
    return first.filter("not _aside").select(*columns).unionByName(again)
