"""Registered queries: the two seams with small callers' functions plugged in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from slipstack.operators import hooks as op
from slipstack.operators.intake import refusal
from slipstack.plans.inputs import cte, load, table


def u02(spark, d):
    """Pages counted in the page sources; Spanish ones play the locked files."""

    def count(data: bytes) -> int:
        if b'lang="es"' in data:
            raise PermissionError("locked")
        return data.count(b"<p>")

    files = table(spark, d, "pages").select(
        F.col("page_id").alias("seq"), F.encode("html", "UTF-8").alias("content")
    ).withColumn("size", F.length("content").cast("bigint"))
    counted = op.with_page_counts(files, count)
    return counted.select(
        "seq", F.col("page_count").cast("bigint").alias("page_count"), "open_error",
        refusal(F.col("size"), F.col("open_error"), F.col("page_count")).alias("reason"),
    )


def u03(spark, d):
    """A scorer that rates each line by its ink, and refuses lines of width 40."""

    def rate(frame: pd.DataFrame) -> pd.DataFrame:
        if (frame["width"] == 40).any():
            raise ValueError("line too thin")
        return pd.DataFrame({"line_id": frame["line_id"], "rate": frame["width"] * 2 + frame["box_no"]})

    lines = load(spark, d, "boxes").select(
        (F.col("receipt_id") * 10000 + F.col("deg") * 10 + F.col("box_no")).alias("line_id"),
        F.col("width").cast("bigint").alias("width"), F.col("box_no").cast("bigint").alias("box_no"),
    )
    return op.scored(lines, rate, "line_id bigint, rate bigint", "line_id")


QUERIES = {"U-02": u02, "U-03": u03}

COUNT = "(length(html) - length(replace(html, '<p>', ''))) // 3"
LOCKED = """contains(html, 'lang="es"')"""
ORACLES = {
    "U-02": f"""SELECT page_id AS seq, CASE WHEN NOT {LOCKED} THEN {COUNT} END AS page_count, CASE WHEN {LOCKED} THEN 'password' END AS open_error,
        CASE WHEN strlen(html) = 0 THEN 'ilegible' WHEN strlen(html) > 5242880 THEN 'tamano' WHEN {LOCKED} THEN 'cifrado' WHEN {COUNT} > 10 THEN 'paginas' END AS reason FROM pages""",
    "U-03": cte("boxes") + "SELECT receipt_id * 10000 + deg * 10 + box_no AS line_id, CASE WHEN width <> 40 THEN CAST(width AS BIGINT) * 2 + box_no END AS rate, CASE WHEN width = 40 THEN 'line too thin' END AS error FROM boxes",
}
