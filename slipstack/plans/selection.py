"""Registered queries: boxes, rotation, chunks and sequence decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipstack.operators import selection as op
from slipstack.operators import sequences as seq
from slipstack.plans.inputs import cte, load, table

DICTIONARY = ["blank", "a", "b", " ", "c", "1", ".", "5"]
STEPS = "CASE WHEN label = 3 THEN 7 WHEN label = 4 THEN 4 WHEN label = 5 THEN 0 ELSE 8 END"


def _lines(spark, d):
    """Each embedding is the flat score array of one line: eight steps, eight classes."""
    emb = table(spark, d, "embeddings")
    return emb.select(F.col("vec_id").alias("line_id"), F.col("embedding").alias("scores"), F.expr(STEPS).alias("steps"))


def t01(spark, d):
    return op.top_boxes(load(spark, d, "boxes")).select(
        "receipt_id", "deg", F.col("box_no").cast("bigint").alias("box_no"), "box_score"
    )


def a09(spark, d):
    return op.confidence(load(spark, d, "boxes")).select(
        "receipt_id", "deg", F.round("confidence", 6).alias("confidence")
    )


def w06(spark, d):
    trials = op.confidence(load(spark, d, "boxes")).join(
        load(spark, d, "masses").withColumn("det_mass", F.lit(1.0)), ["receipt_id", "deg"]
    )
    return op.choose_rotation(trials).select("receipt_id", F.col("deg").cast("bigint").alias("deg"))


def w07(spark, d):
    trials = op.confidence(load(spark, d, "boxes")).join(load(spark, d, "masses"), ["receipt_id", "deg"])
    return op.choose_rotation(trials).select("receipt_id", F.col("deg").cast("bigint").alias("deg"), "no_text")


def f16(spark, d):
    big = load(spark, d, "boxes").filter(op.can_read(F.col("width"), F.col("height")))
    return big.groupBy("receipt_id").agg(F.count(F.lit(1)).alias("readable"))


def _widths(spark, d):
    boxes = load(spark, d, "boxes")
    return boxes.select(
        "receipt_id", (F.col("deg") * 10 + F.col("box_no")).alias("line_no"),
        F.when(F.col("text") != "", F.col("width").cast("bigint")).alias("width"),
        (F.col("score") == 0).alias("failed"),
    )


def t02(spark, d):
    lines = _widths(spark, d).filter(F.col("width").isNotNull())
    return op.width_chunks(lines, 2).select(
        "receipt_id", F.col("line_no").cast("bigint").alias("line_no"), "chunk", "chunk_width"
    )


def a18(spark, d):
    return op.diagnostics(_widths(spark, d), 2)


def w05(spark, d):
    """Long form: score table with one row per step and class, then collapse."""
    lines, n = _lines(spark, d), len(DICTIONARY)
    fitting = F.when(seq.shape_fits(F.col("scores"), F.col("steps"), F.lit(n)), F.col("scores"))
    cells = lines.select("line_id", F.posexplode(fitting).alias("pos", "value")).select(
        "line_id", (F.col("pos") / n).cast("int").alias("step"), (F.col("pos") % n).alias("class"), "value"
    )
    symbols = ", ".join(f"({i}, '{s}')" for i, s in enumerate(DICTIONARY))
    dictionary = spark.sql(f"SELECT * FROM VALUES {symbols} AS t(class, symbol)")
    return seq.decode_rows(seq.best_classes_of_rows(cells), dictionary, lines).select(
        "line_id", "text", F.round(F.col("score"), 5).alias("score")
    )


def j08(spark, d):
    return seq.decode(_lines(spark, d), DICTIONARY).select("line_id", "text", F.round("score", 5).alias("score"))


def f20(spark, d):
    fits = seq.shape_fits(F.col("scores"), F.col("steps"), F.lit(len(DICTIONARY)))
    return _lines(spark, d).select("line_id", fits.alias("fits"))


QUERIES = {
    "T-01": t01, "T-02": t02, "A-09": a09, "A-18": a18, "W-05": w05, "W-06": w06, "W-07": w07, "F-16": f16,
    "F-20": f20, "J-08": j08,
}

X = cte("boxes", "masses")
TOP2 = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id, deg ORDER BY box_score DESC, box_no) AS k FROM boxes) WHERE k <= 2)"
CONF = f"(SELECT receipt_id, deg, coalesce(avg(score) FILTER (text <> ''), 0) AS confidence FROM {TOP2} GROUP BY receipt_id, deg)"
ORDER = "CASE deg WHEN 0 THEN 1 WHEN 270 THEN 2 WHEN 90 THEN 3 ELSE 4 END"
PICK = f"coalesce(arg_min(deg, {ORDER}) FILTER (confidence >= 0.9), arg_max(deg, (confidence, -({ORDER}))))"
WIDTHS = "w AS (SELECT receipt_id, deg * 10 + box_no AS line_no, CASE WHEN text <> '' THEN CAST(width AS BIGINT) END AS width, score = 0 AS failed FROM boxes)"
BEST = f"""cells AS (SELECT vec_id AS line_id, i // 8 AS step, i % 8 AS class, embedding[i + 1] AS value FROM embeddings, range(64) r(i) WHERE {STEPS} = 8),
 best AS (SELECT line_id, step, arg_max(class, (value, -class)) AS class, max(value) AS value FROM cells GROUP BY line_id, step),
 kept AS (SELECT *, ['blank','a','b',' ','c','1','.','5'][class + 1] AS symbol FROM (SELECT *, lag(class) OVER (PARTITION BY line_id ORDER BY step) AS prev FROM best) WHERE class <> 0 AND prev IS DISTINCT FROM class),
 out AS (SELECT line_id, string_agg(symbol, '' ORDER BY step) AS text, round(avg(CAST(value AS DOUBLE)), 5) AS score FROM kept GROUP BY line_id)"""
ORACLES = {
    "T-01": X + f"SELECT receipt_id, deg, box_no, box_score FROM {TOP2}",
    "T-02": X.rstrip() + f""", {WIDTHS}, c AS (SELECT receipt_id, line_no, width, (row_number() OVER (PARTITION BY receipt_id ORDER BY width, line_no) - 1) // 2 AS chunk FROM w WHERE width IS NOT NULL)
        SELECT receipt_id, line_no, chunk, max(width) OVER (PARTITION BY receipt_id, chunk) AS chunk_width FROM c""",
    "A-09": X + f"SELECT receipt_id, deg, round(confidence, 6) AS confidence FROM {CONF}",
    "A-18": X.rstrip() + f", {WIDTHS} SELECT receipt_id, count(*) AS boxes, count(width) AS lines, coalesce(max(width), 0) AS max_width, CAST(ceil(count(width) / 2) AS BIGINT) AS runs, bool_or(failed) AS fallback FROM w GROUP BY receipt_id",
    "J-08": f"WITH {BEST} SELECT vec_id AS line_id, coalesce(text, '') AS text, coalesce(score, 0) AS score FROM embeddings LEFT JOIN out ON line_id = vec_id",
    "W-05": f"WITH {BEST} SELECT vec_id AS line_id, coalesce(text, '') AS text, coalesce(score, 0) AS score FROM embeddings LEFT JOIN out ON line_id = vec_id",
    "W-06": X + f"SELECT receipt_id, CAST({PICK} AS BIGINT) AS deg FROM {CONF} GROUP BY receipt_id",
    "W-07": X + f"""SELECT receipt_id, CAST(CASE WHEN coalesce(bool_or(deg = 0 AND det_mass < 0.0005), false) THEN 0 ELSE {PICK} END AS BIGINT) AS deg,
        coalesce(bool_or(deg = 0 AND det_mass < 0.0005), false) AS no_text FROM {CONF} JOIN masses USING (receipt_id, deg) GROUP BY receipt_id""",
    "F-16": X + "SELECT receipt_id, count(*) AS readable FROM boxes WHERE width >= 8 AND height >= 8 GROUP BY receipt_id",
    "F-20": f"SELECT vec_id AS line_id, s >= 1 AND len(embedding) = s * 8 AS fits FROM (SELECT *, {STEPS} AS s FROM embeddings)",
}
