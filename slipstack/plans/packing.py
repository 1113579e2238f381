"""Registered queries: sheets, order, reflow, placement, geometry, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.operators import packing as op
from slipstack.plans import sql as q
from slipstack.plans.inputs import cte, load, table


def _sheets(spark, d):
    return load(spark, d, "sheets")


def _placed(spark, d):
    return load(spark, d, "placed")


def w01(spark, d):
    return op.with_visual_order(_placed(spark, d)).select("batch_id", "receipt_id", "position")


def w02(spark, d):
    return op.with_intervals(_sheets(spark, d)).select("batch_id", "sheet_no", "lo", "hi")


def w03(spark, d):
    return op.place(_sheets(spark, d), _placed(spark, d), load(spark, d, "arrivals"))


def w03_chosen(spark, d):
    sheets = _sheets(spark, d)
    wanted = sheets.filter("layout IN ('u6m', 'u3v')").groupBy("batch_id").agg(F.max("sheet_no").alias("sheet_no"))
    return op.place(sheets, _placed(spark, d), load(spark, d, "arrivals"), wanted)


def w04(spark, d):
    """A paste per batch into its first order's first sheet; every third batch names no sheet."""
    asked = load(spark, d, "arrivals").groupBy("batch_id").agg(
        F.max("receipt_id").alias("receipt_id"), F.min("seq").alias("_s")
    ).select("batch_id", "receipt_id", F.when(F.col("_s") % 3 > 0, F.col("_s") * 8).alias("sheet_no"), (F.col("_s") % 6).alias("slot"))
    return op.paste(_sheets(spark, d), _placed(spark, d), asked)


def j02(spark, d):
    ids = load(spark, d, "receipts").select((F.col("receipt_id") * 8 + 1).alias("receipt_id"))
    return op.locate(ids, _placed(spark, d))


def j04(spark, d):
    placed = _placed(spark, d)
    gone = placed.filter(F.col("cents").isNull()).select("receipt_id")
    return op.sweep(_sheets(spark, d), op.remove(placed, gone))


def j06(spark, d):
    return op.reflow(_sheets(spark, d), _placed(spark, d))


def j06_sheets(spark, d):
    """Batches with only unread receipts are emptied, then every batch is reflowed."""
    left = _placed(spark, d).filter(F.col("cents").isNotNull())
    sheets = _sheets(spark, d)
    return op.sheets_after(sheets, op.reflow(sheets, left))


def j07(spark, d):
    return op.with_rects(_placed(spark, d), F.col("corner")).select(
        "receipt_id", "rect_x", "rect_y", "rect_w", "rect_h"
    )


def c09(spark, d):
    layout = op.known_layout(F.col("layout"))
    return _sheets(spark, d).select("sheet_no", layout.alias("layout"), op.capacity(layout).alias("capacity"))


def c10(spark, d):
    sheets = _sheets(spark, d).withColumn(
        "slot", F.explode(F.sequence(F.lit(0).cast("bigint"), op.capacity(F.col("layout")) - 1))
    )
    return op.with_rects(sheets, F.col("corner")).select("sheet_no", "slot", "rect_x", "rect_y", "rect_w", "rect_h")


def c11(spark, d):
    return op.fitted(_placed(spark, d), F.col("corner")).select("receipt_id", "width_px", "height_px")


def c12(spark, d):
    return op.fitted(_placed(spark, d), F.col("corner")).select("receipt_id", "offset_x", "offset_y")


def a04(spark, d):
    return op.occupancy(_sheets(spark, d), _placed(spark, d))


def a04_full(spark, d):
    return op.all_full(_sheets(spark, d), _placed(spark, d))


def a05(spark, d):
    return op.counters(_sheets(spark, d), _placed(spark, d))


def f19(spark, d):
    return op.non_empty(_sheets(spark, d), _placed(spark, d)).select("batch_id", "sheet_no")


CODE = "CASE st WHEN 'F' THEN CAST(receipt_id AS STRING) WHEN 'O' THEN CASE WHEN pr = '2-HIGH' THEN '' ELSE CAST(receipt_id AS STRING) || 'a' END ELSE '77' END AS code"
ACTIVE = "st <> 'P' AS active"


def _codes(spark, d):
    return load(spark, d, "receipts").selectExpr("receipt_id", "batch_id", "pr", CODE, ACTIVE)


BATCH_CODE = "CASE c_mktsegment WHEN 'BUILDING' THEN CAST(c_custkey AS STRING) WHEN 'MACHINERY' THEN '' WHEN 'FURNITURE' THEN CAST(c_custkey AS STRING) || 'a' ELSE '7' END AS code"
BATCH_ACTIVE = "c_nationkey < 20 AS active"


def f18(spark, d):
    codes = table(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS batch_id", BATCH_CODE, BATCH_ACTIVE)
    return op.batch_gates(codes, load(spark, d, "receipts").filter(~F.col("removed")))


def f21(spark, d):
    return _codes(spark, d).select("receipt_id", op.code_digits(F.col("code")).alias("code"))


def s08(spark, d):
    return _codes(spark, d).select(
        "receipt_id",
        op.output_name(F.col("active"), F.col("code")).alias("docx"),
        op.output_name(F.col("active"), F.col("code"), "pdf").alias("pdf"),
    )


def s06(spark, d):
    return op.manifest(_placed(spark, d), F.col("corner")).drop("refused")


def s06_nested(spark, d):
    nested = op.nested_manifest(op.manifest(_placed(spark, d), F.col("corner")))
    return nested.select(
        "batch_id",
        "sheet_no",
        "page_break",
        F.array_join(F.transform("images", lambda i: i["receipt_id"].cast("string")), ",").alias("receipts"),
    )


def s07(spark, d):
    return op.print_cells(_placed(spark, d)).select(
        "sheet_no", "slot", "name", *[F.col(c).cast("bigint").alias(c) for c in ("grid_row", "row_span", "grid_col", "col_span")]
    )


QUERIES = {
    "W-01": w01, "W-02": w02, "W-03": w03, "W-03-chosen": w03_chosen, "W-04": w04, "J-02": j02, "J-04": j04, "J-06": j06, "J-06-sheets": j06_sheets, "J-07": j07,
    "C-09": c09, "C-10": c10, "C-11": c11, "C-12": c12, "A-04": a04, "A-04-full": a04_full, "A-05": a05,
    "F-18": f18, "F-19": f19, "F-21": f21, "S-06": s06, "S-06-nested": s06_nested, "S-07": s07, "S-08": s08,
}

B = cte("sheets", "placed").rstrip() + f",\n {q.SLOTS}\n"
SHEETS_CAP = "SELECT batch_id, sheet_no, layout, cap FROM sheets"
TOP = "(0.3::DOUBLE + CASE WHEN corner LIKE 'sup%' THEN 0.3::DOUBLE ELSE 0 END)"
BOTTOM = "(0.3::DOUBLE + CASE WHEN corner LIKE 'inf%' THEN 0.3::DOUBLE ELSE 0 END)"
CELL_W, CELL_H = "((8.5::DOUBLE - 0.3::DOUBLE * 2) / n_cols)", f"((11.0::DOUBLE - {TOP} - {BOTTOM}) / n_rows)"
RECT = (
    f"{q.js_round(f'(0.3::DOUBLE + (grid_col - 1) * {CELL_W}) * 914400')} + 68580 AS rect_x, "
    f"{q.js_round(f'({TOP} + (grid_row - 1) * {CELL_H}) * 914400')} + 68580 AS rect_y, "
    f"greatest(1, {q.js_round(f'col_span * {CELL_W} * 914400')} - 137160) AS rect_w, "
    f"greatest(1, {q.js_round(f'row_span * {CELL_H} * 914400')} - 137160) AS rect_h"
)


def _rects(source: str) -> str:
    return f"(SELECT p.*, {RECT} FROM (SELECT * REPLACE ({q.KNOWN} AS layout) FROM {source}) p JOIN slots USING (layout, slot))"


PX_W, PX_H = f"greatest(1, {q.js_round('rect_w / 9525')})", f"greatest(1, {q.js_round('rect_h / 9525')})"
SCALE = f"least({PX_W} / width, {PX_H} / height)"
FIT = (
    f"CASE WHEN width < 1 OR height < 1 THEN {PX_W} ELSE greatest(1, CAST(floor(width * {SCALE}) AS BIGINT)) END AS width_px, "
    f"CASE WHEN width < 1 OR height < 1 THEN {PX_H} ELSE greatest(1, CAST(floor(height * {SCALE}) AS BIGINT)) END AS height_px"
)
FITTED = f"(SELECT *, {FIT} FROM {_rects('placed')})"
OFFSETS = (
    f"rect_x + {q.js_round('(rect_w - width_px * 9525) / 2')} AS offset_x, rect_y + {q.js_round('(rect_h - height_px * 9525) / 2')} AS offset_y"
)
MANIFEST = (
    f"(SELECT batch_id, sheet_no, slot, receipt_id, {OFFSETS}, width_px, height_px, "
    "coalesce(lag(sheet_no) OVER (PARTITION BY batch_id ORDER BY sheet_no, slot) <> sheet_no, false) AS page_break "
    f"FROM {FITTED})"
)
CODED = cte("receipts").rstrip() + f",\n coded AS (SELECT receipt_id, batch_id, pr, {CODE}, {ACTIVE} FROM receipts)\n"
VALID = "(NOT active OR regexp_full_match(code, '[0-9]+'))"
TARGET = f"""st AS (SELECT s.*, coalesce(u.n, 0) AS used FROM ({SHEETS_CAP}) s LEFT JOIN (SELECT batch_id, sheet_no, count(*) AS n FROM placed GROUP BY ALL) u USING (batch_id, sheet_no)),
 target AS (SELECT batch_id, coalesce(min(sheet_no) FILTER (used < cap), max(sheet_no)) AS t, max(sheet_no) AS last FROM st GROUP BY batch_id),
 free AS (SELECT batch_id, sheet_no, layout, unnest(range(cap)) AS slot FROM ({SHEETS_CAP})),
 holes AS (SELECT * FROM free ANTI JOIN placed USING (batch_id, sheet_no, slot))"""
ORACLES = {
    "W-01": B + "SELECT batch_id, receipt_id, row_number() OVER (PARTITION BY batch_id ORDER BY sheet_no, slot) AS position FROM placed",
    "W-02": B + f"SELECT batch_id, sheet_no, CAST(sum(cap) OVER w - cap AS BIGINT) AS lo, CAST(sum(cap) OVER w AS BIGINT) AS hi FROM ({SHEETS_CAP}) WINDOW w AS (PARTITION BY batch_id ORDER BY sheet_no)",
    "W-03": cte("sheets", "placed", "arrivals").rstrip() + f""", {TARGET},
 h AS (SELECT batch_id, slot, row_number() OVER (PARTITION BY batch_id ORDER BY slot) AS k, count(*) OVER (PARTITION BY batch_id) AS n FROM holes JOIN target USING (batch_id) WHERE sheet_no = t),
 r AS (SELECT batch_id, receipt_id, row_number() OVER (PARTITION BY batch_id ORDER BY seq) AS k FROM arrivals),
 f AS (SELECT r.*, t, last, st.layout, st.cap, coalesce((SELECT max(n) FROM h WHERE h.batch_id = r.batch_id), 0) AS n FROM r JOIN target USING (batch_id) JOIN st ON st.batch_id = r.batch_id AND st.sheet_no = t)
 SELECT f.batch_id, receipt_id, CASE WHEN f.k <= f.n THEN t ELSE last + 1 + (f.k - f.n - 1) // cap END AS sheet_no,
 CASE WHEN f.k <= f.n THEN h.slot ELSE (f.k - f.n - 1) % cap END AS slot, layout FROM f LEFT JOIN h ON h.batch_id = f.batch_id AND h.k = f.k""",
    "W-04": cte("sheets", "placed", "arrivals").rstrip() + f""", {TARGET},
 open AS (SELECT batch_id, max(sheet_no) AS o FROM holes GROUP BY batch_id),
 ask AS (SELECT a.*, CASE WHEN s % 3 > 0 THEN s * 8 WHEN o = last THEN o END AS w FROM (SELECT batch_id, max(receipt_id) AS receipt_id, min(seq) AS s, min(seq) % 6 AS l FROM arrivals GROUP BY batch_id) a
      JOIN target USING (batch_id) LEFT JOIN open USING (batch_id)),
 c AS (SELECT a.batch_id, coalesce(min(p) FILTER (h.sheet_no = w AND h.slot = l), min(p) FILTER (h.sheet_no = w), min(p)) AS p
      FROM ask a JOIN (SELECT *, {{'sheet_no': sheet_no, 'slot': slot, 'layout': layout}} AS p FROM holes) h USING (batch_id) GROUP BY a.batch_id)
 SELECT ask.batch_id, receipt_id, coalesce(c.p.sheet_no, last + 1) AS sheet_no, coalesce(c.p.slot, 0) AS slot, coalesce(c.p.layout, m.layout) AS layout
 FROM ask JOIN target USING (batch_id) JOIN sheets m ON m.batch_id = ask.batch_id AND m.sheet_no = coalesce(w, last) LEFT JOIN c ON c.batch_id = ask.batch_id""",
    "J-02": cte("sheets", "placed", "receipts") + "SELECT r.id AS receipt_id, sheet_no, slot FROM (SELECT receipt_id * 8 + 1 AS id FROM receipts) r LEFT JOIN placed ON placed.receipt_id = r.id",
    "J-04": B.rstrip() + """, kept AS (SELECT * FROM placed WHERE cents IS NOT NULL)
 SELECT batch_id, sheet_no, layout FROM sheets WHERE sheet_no IN (SELECT sheet_no FROM kept)
 UNION ALL SELECT batch_id, max(sheet_no) + 1, 'u4x2' FROM sheets WHERE batch_id NOT IN (SELECT batch_id FROM kept) GROUP BY batch_id""",
    "J-06": B.rstrip() + f""", iv AS (SELECT *, sum(cap) OVER (PARTITION BY batch_id ORDER BY sheet_no) AS hi FROM ({SHEETS_CAP})),
 tot AS (SELECT batch_id, sum(cap) AS room, max(sheet_no) AS last FROM ({SHEETS_CAP}) GROUP BY batch_id),
 it AS (SELECT batch_id, receipt_id, row_number() OVER (PARTITION BY batch_id ORDER BY sheet_no, slot) - 1 AS k FROM placed)
 SELECT it.batch_id, receipt_id, coalesce(iv.sheet_no, CAST(last + 1 + (k - room) // 4 AS BIGINT)) AS sheet_no,
 CAST(coalesce(k - (hi - cap), (k - room) % 4) AS BIGINT) AS slot, coalesce(layout, 'u4x2') AS layout
 FROM it JOIN tot USING (batch_id) LEFT JOIN iv ON iv.batch_id = it.batch_id AND k >= hi - cap AND k < hi""",
    "J-07": B + f"SELECT receipt_id, rect_x, rect_y, rect_w, rect_h FROM {_rects('placed')}",
    "C-09": B + f"SELECT sheet_no, {q.KNOWN} AS layout, {q.CAPACITY} AS capacity FROM sheets",
    "C-10": B + f"SELECT sheet_no, slot, rect_x, rect_y, rect_w, rect_h FROM (SELECT p.*, slot, {RECT} FROM (SELECT * REPLACE ({q.KNOWN} AS layout) FROM sheets) p JOIN slots USING (layout))",
    "C-11": B + f"SELECT receipt_id, width_px, height_px FROM {FITTED}",
    "C-12": B + f"SELECT receipt_id, {OFFSETS} FROM {FITTED}",
    "A-04": B + f"SELECT batch_id, sheet_no, coalesce(n, 0) AS items, cap AS capacity FROM ({SHEETS_CAP}) LEFT JOIN (SELECT batch_id, sheet_no, count(*) AS n FROM placed GROUP BY ALL) USING (batch_id, sheet_no)",
    "A-04-full": B + f"SELECT batch_id, bool_and(coalesce(n, 0) >= cap) AS all_full FROM ({SHEETS_CAP}) LEFT JOIN (SELECT batch_id, sheet_no, count(*) AS n FROM placed GROUP BY ALL) USING (batch_id, sheet_no) GROUP BY batch_id",
    "A-05": B + "SELECT batch_id, count(*) AS sheets, CAST(coalesce(sum(n), 0) AS BIGINT) AS receipts FROM sheets LEFT JOIN (SELECT sheet_no, count(*) AS n FROM placed GROUP BY 1) USING (sheet_no) GROUP BY batch_id",
    "F-18": cte("receipts").rstrip() + f""", codes AS (SELECT CAST(c_custkey AS VARCHAR) AS batch_id, {BATCH_CODE}, {BATCH_ACTIVE} FROM customer)
 SELECT batch_id, CASE WHEN NOT {VALID} THEN '{fixed.CODE_INVALID}' WHEN coalesce(n, 0) = 0 THEN '{fixed.NOTHING_TO_EXPORT}' END AS message
 FROM codes LEFT JOIN (SELECT batch_id, count(*) AS n FROM receipts WHERE NOT removed GROUP BY batch_id) USING (batch_id)""",
    "F-19": B + "SELECT batch_id, sheet_no FROM sheets WHERE sheet_no IN (SELECT sheet_no FROM placed)",
    "F-21": CODED + "SELECT receipt_id, regexp_replace(code, '[^0-9]', '', 'g') AS code FROM coded",
    "S-06": B + f"SELECT * FROM {MANIFEST}",
    "S-06-nested": B + f"SELECT batch_id, sheet_no, bool_or(page_break) AS page_break, string_agg(receipt_id, ',' ORDER BY slot) AS receipts FROM {MANIFEST} GROUP BY batch_id, sheet_no",
    "S-07": B + f"SELECT sheet_no, slot, name, grid_row, row_span, grid_col, col_span FROM (SELECT * REPLACE ({q.KNOWN} AS layout) FROM placed) JOIN slots USING (layout, slot)",
    "S-08": CODED + "SELECT receipt_id, CASE WHEN active THEN code ELSE 'sincodigo' END || '-comprobante.docx' AS docx, CASE WHEN active THEN code ELSE 'sincodigo' END || '-comprobante.pdf' AS pdf FROM coded",
}
CHOSEN = TARGET.replace(
    "coalesce(min(sheet_no) FILTER (used < cap)", "coalesce(max(sheet_no) FILTER (layout IN ('u6m', 'u3v')), min(sheet_no) FILTER (used < cap)"
)
ORACLES["W-03-chosen"] = ORACLES["W-03"].replace(TARGET, CHOSEN)
LEFT = "(SELECT * FROM placed WHERE cents IS NOT NULL)"
ORACLES["J-06-sheets"] = (
    "WITH moved AS (" + ORACLES["J-06"].replace("FROM placed)", f"FROM {LEFT})") + "),\n" + cte("sheets").removeprefix("WITH ") + """
 SELECT DISTINCT batch_id, sheet_no, layout FROM moved UNION ALL
 SELECT batch_id, max(sheet_no) + 1, '""" + fixed.DEFAULT_LAYOUT + """' FROM sheets WHERE batch_id NOT IN (SELECT batch_id FROM moved) GROUP BY batch_id"""
)
