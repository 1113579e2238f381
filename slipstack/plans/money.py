"""Registered queries: text, amounts, extraction and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.functions import amounts as am
from slipstack.operators import events as ev
from slipstack.operators import extraction as ex
from slipstack.plans import sql as q
from slipstack.plans.inputs import cte, load, table


def _results(spark, d):
    """Late results with the text that was evaluated: some have gone stale since."""
    seen = load(spark, d, "receipts").select("receipt_id", am.collapse_spaces(F.col("text")).alias("_t"))
    return (
        load(spark, d, "results")
        .join(seen, "receipt_id")
        .select(
            "receipt_id",
            "new_cents",
            F.when(F.col("flag") == "R", F.concat(F.col("_t"), F.lit(" !"))).otherwise(F.col("_t")).alias("seen_text"),
        )
    )


RESULTS_SQL = (
    "late AS (SELECT receipt_id, new_cents, CASE WHEN flag = 'R' THEN t || ' !' ELSE t END AS seen_text "
    "FROM results JOIN (SELECT receipt_id, " + q.clean("text") + " AS t FROM receipts) USING (receipt_id))"
)
LISTED = f"(status = 'ok' AND cents IS NULL AND NOT manual AND {q.clean('text')} <> '')"


def c01(spark, d):
    text = am.well_formed(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("chars")
    )


def c02(spark, d):
    text = am.collapse_spaces(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("chars")
    )


def c03(spark, d):
    docs = table(spark, d, "documents").select("doc_id", am.candidates(F.col("text")).alias("v"))
    return docs.select(
        "doc_id", F.size("v").cast("bigint").alias("found"), F.array_join("v", "|").alias("amounts")
    )


def c04(spark, d):
    return load(spark, d, "receipts").select(
        "receipt_id", am.has_signed_amount(am.collapse_spaces(F.col("text"))).alias("signed")
    )


def c05(spark, d):
    return am.with_fast_total(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", "total_cents"
    )


def c06(spark, d):
    return load(spark, d, "typed").select("receipt_id", am.parse_amount(F.col("typed")).alias("cents"))


CURRENCY = "CASE pr WHEN '1-URGENT' THEN 'ARS' WHEN '2-HIGH' THEN 'EUR' WHEN '3-MEDIUM' THEN 'BOB' WHEN '5-LOW' THEN 'USD' ELSE 'GBP' END"


def c07(spark, d):
    return load(spark, d, "receipts").select(
        "receipt_id", am.format_amount(F.col("amt"), F.expr(CURRENCY)).alias("shown")
    )


def c08(spark, d):
    return load(spark, d, "receipts").select("receipt_id", am.editable_amount(F.col("amt")).alias("shown"))


def s05(spark, d):
    return ex.join_lines(load(spark, d, "ocr_lines"))


def f12(spark, d):
    return load(spark, d, "receipts").filter(ex.is_candidate()).select("batch_id", "receipt_id")


def j03(spark, d):
    return ex.live(load(spark, d, "results"), load(spark, d, "receipts")).select("receipt_id", "new_cents")


def j05(spark, d):
    return ex.apply_totals(load(spark, d, "receipts"), _results(spark, d)).select(
        "receipt_id", "cents", "applied"
    )


def a01(spark, d):
    return ex.batch_totals(load(spark, d, "receipts")).select(
        "batch_id", F.col("total_cents").cast("bigint").alias("total_cents")
    )


def a02(spark, d):
    return ex.batch_totals(load(spark, d, "receipts")).select("batch_id", "receipts")


def a03(spark, d):
    return ex.batch_totals(load(spark, d, "receipts")).select(
        "batch_id", "with_amount", F.round("progress", 6).alias("progress")
    )


def a06(spark, d):
    return am.with_fast_total(load(spark, d, "receipts")).select("receipt_id", "total_cents")


def a07(spark, d):
    return ex.batch_outcome(load(spark, d, "receipts")).select(
        "batch_id",
        "candidates",
        "with_text",
        "with_total",
        F.col("found_cents").cast("bigint").alias("found_cents"),
        "outcome",
    )


def a08(spark, d):
    prior = F.max(F.when(F.col("st") == "F", F.lit("aviso")))
    return ex.batch_messages(load(spark, d, "receipts"), prior)


def t05(spark, d):
    return ex.first_pending(load(spark, d, "receipts"))


# Pending receipts of every kind: amounts of old, drafts, manual and removed ones.
PENDING = "CASE WHEN mon IN (1, 2, 6, 7, 8) AND st <> 'F' THEN 'pendiente' ELSE status END"
PENDING_SQL = f"SELECT * REPLACE ({PENDING} AS status) FROM receipts"


def r02(spark, d):
    receipts = load(spark, d, "receipts").withColumn("status", F.expr(PENDING))
    poisoned = F.when(F.col("pr") == "2-HIGH", F.lit("decoder"))
    return ex.settle(receipts.withColumn("ocr_error", poisoned)).select("receipt_id", "status", F.md5("text").alias("digest"), "cents")


def r06(spark, d):
    turned = load(spark, d, "ocr_lines").groupBy("receipt_id").agg(
        F.min("line_no").alias("k"), F.min("text").alias("t")
    ).select(
        "receipt_id",
        F.when(F.col("t") != "", F.concat(F.lit("TOTAL "), (F.col("k") % 1000000000).cast("string"), F.lit(".50"))).alias("new_text"),
    )
    return ev.reread(load(spark, d, "receipts"), turned).select("receipt_id", "text", "cents", "status")


def r05(spark, d):
    return ev.last_editor(load(spark, d, "typed"), "editor", "typed")


def r07(spark, d):
    return ev.manual_edits(load(spark, d, "typed"), "editor")


def r08(spark, d):
    return ev.verdicts(load(spark, d, "receipts"), _results(spark, d))


def flagship(spark, d):
    """Per document source: how many texts, totals found, and their exact sum."""
    docs = am.with_fast_total(table(spark, d, "documents").select("source", "text"))
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count("total_cents").alias("with_total"),
        F.coalesce(F.sum(F.col("total_cents").cast("decimal(38,0)")), F.lit(0)).cast("bigint").alias("sum_cents"),
    )


QUERIES = {
    "totals-by-source": flagship,
    "C-01": c01, "C-02": c02, "C-03": c03, "C-04": c04, "C-05": c05, "C-06": c06, "C-07": c07, "C-08": c08,
    "S-05": s05, "F-12": f12, "J-03": j03, "J-05": j05, "A-01": a01, "A-02": a02, "A-03": a03, "A-06": a06,
    "A-07": a07, "A-08": a08, "T-05": t05, "R-02": r02, "R-05": r05, "R-06": r06, "R-07": r07, "R-08": r08,
}

R = cte("receipts")
LATE = cte("receipts", "results").rstrip() + ",\n" + RESULTS_SQL + "\n"
APPLIED = (
    "new_cents IS NOT NULL AND coalesce(draft, '') = '' AND NOT removed AND cents IS NULL AND "
    + q.clean("text") + " = seen_text"
)
ORACLES = {
    "totals-by-source": (
        f"SELECT source, count(*) AS documents, count(t) AS with_total, CAST(coalesce(sum(t), 0) AS BIGINT) AS sum_cents "
        f"FROM (SELECT source, {q.fast_total('c')} AS t FROM (SELECT source, {q.clean('text')} AS c FROM documents)) GROUP BY source"
    ),
    "C-01": "SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars FROM documents",
    "C-02": f"SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM (SELECT doc_id, {q.clean('text')} AS t FROM documents)",
    "C-03": f"SELECT doc_id, len(v) AS found, array_to_string(v, '|') AS amounts FROM (SELECT doc_id, {q.found('text')} AS v FROM documents)",
    "C-04": R + f"SELECT receipt_id, {q.signed(q.clean('text'))} AS signed FROM receipts",
    "C-05": f"SELECT doc_id, {q.fast_total('c')} AS total_cents FROM (SELECT doc_id, {q.clean('text')} AS c FROM documents)",
    "C-06": cte("typed") + f"SELECT receipt_id, {q.parse_amount('typed')} AS cents FROM typed",
    "C-07": R + f"SELECT receipt_id, CASE {CURRENCY} WHEN 'ARS' THEN 'AR$' WHEN 'EUR' THEN '€' WHEN 'BOB' THEN 'Bs' ELSE 'US$' END || ' ' || {q.grouped('amt')} AS shown FROM receipts",
    "C-08": R + f"SELECT receipt_id, {q.grouped('amt')} AS shown FROM receipts",
    "S-05": cte("ocr_lines") + "SELECT receipt_id, coalesce(string_agg(text, chr(10) ORDER BY line_no, text) FILTER (text <> ''), '') AS text FROM ocr_lines GROUP BY receipt_id",
    "F-12": R + f"SELECT batch_id, receipt_id FROM receipts WHERE {LISTED}",
    "J-03": cte("receipts", "results") + "SELECT receipt_id, new_cents FROM results WHERE EXISTS (SELECT 1 FROM receipts r WHERE r.receipt_id = results.receipt_id AND NOT removed)",
    "J-05": LATE + f"SELECT receipt_id, CASE WHEN ok THEN new_cents ELSE cents END AS cents, ok AS applied FROM (SELECT *, coalesce({APPLIED}, false) AS ok FROM receipts LEFT JOIN late USING (receipt_id))",
    "A-01": R + "SELECT batch_id, CAST(sum(coalesce(cents, 0)) AS BIGINT) AS total_cents FROM receipts GROUP BY batch_id",
    "A-02": R + "SELECT batch_id, count(*) AS receipts FROM receipts GROUP BY batch_id",
    "A-03": R + "SELECT batch_id, count(cents) AS with_amount, round(count(cents) / count(*), 6) AS progress FROM receipts GROUP BY batch_id",
    "A-06": R + f"SELECT receipt_id, {q.fast_total('c')} AS total_cents FROM (SELECT *, {q.clean('text')} AS c FROM receipts)",
    "A-07": R + f"""SELECT batch_id, n AS candidates, w AS with_text, k AS with_total, found_cents,
        CASE WHEN n = 0 THEN 'sin-candidatos' WHEN w = 0 THEN 'sin-texto' WHEN k = 0 THEN 'sin-totales' ELSE 'listo' END AS outcome
        FROM (SELECT batch_id, count(*) FILTER (l) AS n, count(*) FILTER (l AND c <> '') AS w, count(t) FILTER (l) AS k,
              CAST(coalesce(sum(t) FILTER (l), 0) AS BIGINT) AS found_cents
              FROM (SELECT batch_id, {LISTED} AS l, c, {q.fast_total('c')} AS t FROM (SELECT *, {q.clean('text')} AS c FROM receipts)) GROUP BY batch_id)""",
    "A-08": R + f"""SELECT batch_id, CASE WHEN n = 0 THEN '{fixed.NOTHING_PENDING}' WHEN w = 0 THEN NULL WHEN k = 0 THEN '{fixed.NOTHING_READ}'
        WHEN ok = w AND coalesce(prior, '') <> '' THEN prior ELSE 'Local: ' || ok || '/' || w || ' totales.' END AS message
        FROM (SELECT batch_id, count(*) FILTER (l) AS n, count(*) FILTER (l AND c <> '') AS w, count(t) FILTER (l) AS k,
              count(t) FILTER (l AND coalesce(draft, '') = '') AS ok, max(CASE WHEN st = 'F' THEN 'aviso' END) AS prior
              FROM (SELECT *, {LISTED} AS l, {q.fast_total('c')} AS t FROM (SELECT *, {q.clean('text')} AS c FROM receipts WHERE NOT removed)) GROUP BY batch_id)""",
    "T-05": R + "SELECT batch_id, arg_min(receipt_id, ord) AS receipt_id FROM receipts WHERE status = 'pendiente' GROUP BY batch_id",
    "R-02": R + f"""SELECT receipt_id, CASE WHEN NOT p THEN status WHEN bad THEN 'error' ELSE 'ok' END AS status, md5(CASE WHEN p AND bad THEN '' ELSE text END) AS digest,
        CASE WHEN NOT p THEN cents WHEN NOT bad AND coalesce(draft, '') = '' THEN {q.fast_total('c')} END AS cents
        FROM (SELECT *, status = 'pendiente' AND NOT removed AS p, pr = '2-HIGH' AS bad, {q.clean('text')} AS c FROM ({PENDING_SQL}))""",
    "R-05": cte("typed") + "SELECT editor, arg_max(typed, (ts, seq)) AS typed FROM typed GROUP BY editor",
    "R-06": cte("receipts", "ocr_lines") + """, turned AS (SELECT receipt_id, CASE WHEN min(text) <> '' THEN 'TOTAL ' || (min(line_no) % 1000000000) || '.50' END AS new_text, min(line_no) % 1000000000 AS k FROM ocr_lines GROUP BY receipt_id)
        SELECT receipt_id, CASE WHEN NOT hit THEN text ELSE coalesce(new_text, '') END AS text,
        CASE WHEN hit AND NOT manual THEN CASE WHEN new_text IS NOT NULL AND coalesce(draft, '') = '' THEN k * 100 + 50 END ELSE cents END AS cents,
        CASE WHEN NOT hit THEN status ELSE 'ok' END AS status FROM (SELECT *, k IS NOT NULL AND NOT removed AS hit FROM receipts LEFT JOIN turned USING (receipt_id))""",
    "R-07": cte("typed") + f""", e AS (SELECT *, {q.parse_amount('typed')} AS c FROM typed),
        r AS (SELECT *, row_number() OVER (PARTITION BY editor ORDER BY ts DESC, seq DESC) AS back FROM e)
        SELECT editor, arg_max(c, (ts, seq)) FILTER (c IS NOT NULL) AS cents, count(c) > 0 AS manual,
        max(CASE WHEN back = 1 AND c IS NULL AND {q.clean('typed')} <> '' THEN typed END) AS draft FROM r GROUP BY editor""",
    "R-08": LATE + f"""SELECT receipt_id, new_cents, CASE WHEN new_cents IS NULL THEN 'sin-total' WHEN coalesce(draft, '') <> '' THEN 'borrador'
        WHEN removed THEN 'quitado' WHEN cents IS NOT NULL THEN 'ya-tiene' WHEN {q.clean('text')} <> seen_text THEN 'rancio' ELSE 'aplicado' END AS verdict
        FROM late JOIN receipts USING (receipt_id)""",
}
