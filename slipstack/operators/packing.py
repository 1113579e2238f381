"""Sheets: templates, visual order, reflow, placement, geometry, export rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.functions import quads
from slipstack.operators.ordered import running


def layout_table(spark: SparkSession) -> DataFrame:
    """Ten fixed templates: layout, capacity, rows, cols."""
    values = ", ".join(
        f"('{k}', {len(slots)}L, {rows}, {cols})" for k, (rows, cols, slots) in fixed.LAYOUTS.items()
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(layout, capacity, n_rows, n_cols)")


def slot_table(spark: SparkSession) -> DataFrame:
    """Thirty-five fixed slots: layout, slot, grid position, grid size."""
    values = ", ".join(
        f"('{k}', {i}L, {r}, {c}, {cs}, {rs}, {rows}, {cols})"
        for k, (rows, cols, slots) in fixed.LAYOUTS.items()
        for i, (r, c, cs, rs) in enumerate(slots)
    )
    return spark.sql(
        f"SELECT * FROM VALUES {values} "
        "AS t(layout, slot, grid_row, grid_col, col_span, row_span, n_rows, n_cols)"
    )


def rect_table(spark: SparkSession) -> DataFrame:
    """C-10: the rectangle of every slot in EMU, for each side that the code band may take.

    A hundred fixed rows: 35 slots with the band above, below or nowhere.
    """
    emu, half = fixed.EMU_PER_INCH, int(fixed.GUTTER / 2 * fixed.EMU_PER_INCH + 0.5)
    whole = lambda inches: math.floor(inches * emu + 0.5)
    rows = []
    for name, (n_rows, n_cols, slots) in fixed.LAYOUTS.items():
        for side in fixed.BAND_SIDES:
            top, bottom = (fixed.MARGIN + (fixed.CODE_BAND if side == s else 0) for s in ("sup", "inf"))
            cell_w, cell_h = (fixed.PAGE_WIDTH - fixed.MARGIN * 2) / n_cols, (fixed.PAGE_HEIGHT - top - bottom) / n_rows
            for i, (row, col, wide, tall) in enumerate(slots):
                x, y = whole(fixed.MARGIN + (col - 1) * cell_w) + half, whole(top + (row - 1) * cell_h) + half
                w, h = max(1, whole(wide * cell_w) - 2 * half), max(1, whole(tall * cell_h) - 2 * half)
                rows.append(f"('{name}', {i}L, '{side}', {x}L, {y}L, {w}L, {h}L)")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(layout, slot, side, rect_x, rect_y, rect_w, rect_h)")


def known_layout(layout: Column) -> Column:
    """C-09: unknown templates read as the four-slot one."""
    return F.when(layout.isin(*fixed.LAYOUTS), layout).otherwise(F.lit(fixed.DEFAULT_LAYOUT))


def capacity(layout: Column) -> Column:
    """Slots of a template (unknown: four)."""
    known = F.lit(len(fixed.LAYOUTS[fixed.DEFAULT_LAYOUT][2])).cast("bigint")
    for name, (_, _, slots) in fixed.LAYOUTS.items():
        known = F.when(layout == name, F.lit(len(slots)).cast("bigint")).otherwise(known)
    return known


def with_visual_order(placements: DataFrame) -> DataFrame:
    """W-01: 1-based position by (sheet, slot) inside the batch, holes skipped."""
    return running(
        placements, ["batch_id"], ["sheet_no", "slot"], rank="position"
    )


def with_intervals(sheets: DataFrame) -> DataFrame:
    """W-02: cumulative capacity interval ``[lo, hi)`` of every sheet of a batch."""
    cap = capacity(F.col("layout"))
    out = running(
        sheets.withColumn("capacity", cap),
        ["batch_id"],
        ["sheet_no"],
        sums={"hi": F.col("capacity")},
    )
    return out.withColumn("lo", F.col("hi") - F.col("capacity"))


def non_empty(sheets: DataFrame, placements: DataFrame) -> DataFrame:
    """F-19: sheets that hold something."""
    return sheets.join(placements.select("batch_id", "sheet_no"), ["batch_id", "sheet_no"], "left_semi")


def sweep(sheets: DataFrame, placements: DataFrame) -> DataFrame:
    """F-19 / J-04: drop empty sheets; a batch left with none gets one default sheet."""
    kept = non_empty(sheets, placements).select("batch_id", "sheet_no", "layout")
    bare = (
        sheets.groupBy("batch_id")
        .agg(F.max("sheet_no").alias("_last"))
        .join(placements.select("batch_id").distinct(), "batch_id", "left_anti")
    )
    fresh = bare.select(
        "batch_id",
        (F.col("_last") + 1).alias("sheet_no"),
        F.lit(fixed.DEFAULT_LAYOUT).alias("layout"),
    )
    return kept.unionByName(fresh)


def remove(placements: DataFrame, gone: DataFrame) -> DataFrame:
    """J-04: placements without the removed receipts."""
    return placements.join(gone.select("receipt_id"), "receipt_id", "left_anti")


def reflow(sheets: DataFrame, placements: DataFrame, new_layout: str = fixed.DEFAULT_LAYOUT) -> DataFrame:
    """J-06: repack every batch in visual order, overflow onto new sheets.

    The k-th item meets the k-th slot: sheets are opened into their (at most six)
    slots, so the range condition becomes an equality on ``(batch_id, k)``, whose
    keys are unique on both sides.  A batch of any size spreads over all tasks.
    Items beyond the last slot have no partner and are placed by arithmetic.
    """
    intervals = with_intervals(sheets.select("batch_id", "sheet_no", "layout"))
    slots = intervals.select(
        "batch_id",
        "sheet_no",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("capacity") - 1)).alias("slot"),
        "lo",
        "layout",
    ).select("batch_id", (F.col("lo") + F.col("slot") + 1).alias("k"), "sheet_no", "slot", "layout")
    room = sheets.groupBy("batch_id").agg(
        F.sum(capacity(F.col("layout"))).alias("_room"), F.max("sheet_no").alias("_last")
    )
    items = running(
        placements.select("batch_id", "sheet_no", "slot", "receipt_id"),
        ["batch_id"],
        ["sheet_no", "slot"],
        rank="k",
        per_key=room,
    ).select("batch_id", "k", "receipt_id", "_room", "_last")
    cap = len(fixed.LAYOUTS[new_layout][2])
    over = F.col("k") - 1 - F.coalesce(F.col("_room"), F.lit(0))
    joined = items.join(slots, ["batch_id", "k"], "left")
    return joined.select(
        "batch_id",
        "receipt_id",
        F.coalesce(
            F.col("sheet_no"), F.coalesce(F.col("_last"), F.lit(0)) + 1 + F.floor(over / cap)
        ).alias("sheet_no"),
        F.coalesce(F.col("slot"), F.pmod(over, F.lit(cap))).alias("slot"),
        F.coalesce(F.col("layout"), F.lit(new_layout)).alias("layout"),
    )


def sheets_after(sheets: DataFrame, moved: DataFrame) -> DataFrame:
    """J-06: the sheets of every batch after a reflow: those that hold something, new ones
    included, and one default sheet for a batch that is left with none.  Emptied sheets go.
    """
    held = moved.select("batch_id", "sheet_no", "layout").distinct()
    bare = sheets.groupBy("batch_id").agg(F.max("sheet_no").alias("_last")).join(held.select("batch_id"), "batch_id", "left_anti")
    fresh = bare.select("batch_id", (F.col("_last") + 1).alias("sheet_no"), F.lit(fixed.DEFAULT_LAYOUT).alias("layout"))
    return held.unionByName(fresh)


def _target_sheet(sheets: DataFrame, placements: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """W-03: the asked sheet, else the first with a hole, else the last one."""
    # Sheets, taken slots and wishes of a sheet meet in one aggregate: six slots at most.
    no_slot, no_layout = F.lit(None).cast("bigint").alias("slot"), F.lit(None).cast("string").alias("layout")
    key = ["batch_id", "sheet_no"]
    parts = sheets.select(*key, "layout", no_slot, F.lit(False).alias("_asked")).unionByName(
        placements.select(*key, no_layout, F.col("slot").cast("bigint").alias("slot"), F.lit(False).alias("_asked"))
    )
    if wanted is not None:
        parts = parts.unionByName(wanted.select(*key, no_layout, no_slot, F.lit(True).alias("_asked")))
    all_slots = F.sequence(F.lit(0).cast("bigint"), capacity(F.col("layout")) - 1)
    state = (
        parts.groupBy(*key)
        .agg(F.max("layout").alias("layout"), F.collect_set("slot").alias("_taken"), F.max("_asked").alias("_asked"))
        .filter(F.col("layout").isNotNull())
        .withColumn("_holes", F.array_except(all_slots, F.col("_taken")))
    )
    here = F.struct("sheet_no", "layout", "_holes")
    chosen = F.coalesce(
        F.min(F.when(F.col("_asked"), here)),
        F.min(F.when(F.size("_holes") > 0, here)),
        F.max(here),
    )
    return state.groupBy("batch_id").agg(
        chosen.alias("_t"), F.max("sheet_no").alias("_last")
    ).select(
        "batch_id",
        F.col("_t.sheet_no").alias("_sheet"),
        F.col("_t.layout").alias("_layout"),
        F.col("_t._holes").alias("_holes"),
        "_last",
    )


def place(
    sheets: DataFrame, placements: DataFrame, items: DataFrame, wanted: DataFrame | None = None
) -> DataFrame:
    """W-03: new receipts (``batch_id, seq, receipt_id``) into sheets.

    The holes of the target sheet first, then new sheets of the same template.
    Other sheets with holes are left alone.  ``wanted`` optionally names a sheet
    per batch.  A batch without sheets starts at sheet 1.
    """
    plan = _target_sheet(sheets, placements, wanted)
    ranked = running(items, ["batch_id"], ["seq"], rank="_rank", per_key=plan)
    layout = F.coalesce(F.col("_layout"), F.lit(fixed.DEFAULT_LAYOUT))
    holes = F.when(F.col("_holes").isNull(), F.lit(0)).otherwise(F.size("_holes"))
    over = F.col("_rank") - 1 - holes
    cap = capacity(layout)
    return ranked.select(
        "batch_id",
        "receipt_id",
        F.when(over < 0, F.col("_sheet"))
        .otherwise(F.coalesce(F.col("_last"), F.lit(0)) + 1 + F.floor(over / cap))
        .cast("bigint")
        .alias("sheet_no"),
        F.when(over < 0, F.get("_holes", (F.col("_rank") - 1).cast("int")))
        .otherwise(F.pmod(over, cap))
        .alias("slot"),
        layout.alias("layout"),
    )


def paste(sheets: DataFrame, placements: DataFrame, requests: DataFrame) -> DataFrame:
    """W-04: one pasted receipt per batch: the slot asked for, if free; else the first
    hole of that sheet; else the first sheet with a hole; else a new sheet.

    ``requests`` is ``batch_id, receipt_id, sheet_no, slot`` (one row per batch).  Without
    a sheet the last one is meant, if it has a hole; a new sheet is then like the last.
    """
    here = F.struct("sheet_no", "slot", "layout")
    free = (
        sheets.select("batch_id", "sheet_no", "layout")
        .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), capacity(F.col("layout")) - 1)))
        .join(placements.select("batch_id", "sheet_no", "slot"), ["batch_id", "sheet_no", "slot"], "left_anti")
    )
    # Facts of a batch are minima and maxima, taken before rows move.
    holes = free.groupBy("batch_id").agg(F.min(here).alias("_any"), F.max("sheet_no").alias("_last_open"))
    tail = sheets.groupBy("batch_id").agg(F.max(F.struct("sheet_no", "layout")).alias("_tail"))
    meant = F.when(F.col("sheet_no").isNotNull(), F.col("sheet_no")).when(
        F.col("_last_open") == F.col("_tail.sheet_no"), F.col("_last_open")
    )
    asked = (
        requests.select("batch_id", "receipt_id", "sheet_no", F.col("slot").alias("_slot"))
        .join(holes, "batch_id", "left")
        .join(tail, "batch_id", "left")
        .withColumn("_meant", meant)
    )
    near = (
        free.join(asked.select("batch_id", F.col("_meant").alias("sheet_no"), "_slot"), ["batch_id", "sheet_no"])
        .groupBy("batch_id")
        .agg(F.min(F.when(F.col("slot") == F.col("_slot"), here)).alias("_exact"), F.min(here).alias("_near"))
    )
    model = sheets.select("batch_id", F.col("sheet_no").alias("_meant"), F.col("layout").alias("_asked"))
    met = asked.drop("sheet_no").join(near, "batch_id", "left").join(model, ["batch_id", "_meant"], "left")
    fresh = F.struct(
        (F.coalesce(F.col("_tail.sheet_no"), F.lit(0)) + 1).cast("bigint").alias("sheet_no"),
        F.lit(0).cast("bigint").alias("slot"),
        F.coalesce(F.col("_asked"), F.col("_tail.layout"), F.lit(fixed.DEFAULT_LAYOUT)).alias("layout"),
    )
    return met.withColumn("_pick", F.coalesce("_exact", "_near", "_any", fresh)).select(
        "batch_id", "receipt_id", "_pick.sheet_no", "_pick.slot", "_pick.layout"
    )


def occupancy(sheets: DataFrame, placements: DataFrame) -> DataFrame:
    """A-04: items and capacity per sheet."""
    used = placements.groupBy("batch_id", "sheet_no").agg(F.count(F.lit(1)).alias("items"))
    return sheets.join(used, ["batch_id", "sheet_no"], "left").select(
        "batch_id",
        "sheet_no",
        F.coalesce(F.col("items"), F.lit(0)).alias("items"),
        capacity(F.col("layout")).alias("capacity"),
    )


def all_full(sheets: DataFrame, placements: DataFrame) -> DataFrame:
    """A-04: batches whose every sheet is full."""
    return occupancy(sheets, placements).groupBy("batch_id").agg(
        F.every(F.col("items") >= F.col("capacity")).alias("all_full")
    )


def counters(sheets: DataFrame, placements: DataFrame) -> DataFrame:
    """A-05: sheets and receipts per batch."""
    n_sheets = sheets.groupBy("batch_id").agg(F.count(F.lit(1)).alias("sheets"))
    n_receipts = placements.groupBy("batch_id").agg(F.count(F.lit(1)).alias("receipts"))
    return n_sheets.join(n_receipts, "batch_id", "left").select(
        "batch_id", "sheets", F.coalesce(F.col("receipts"), F.lit(0)).alias("receipts")
    )


def locate(receipts: DataFrame, placements: DataFrame) -> DataFrame:
    """J-02: receipt to (sheet, slot), null when it is nowhere."""
    spots = placements.select("receipt_id", "sheet_no", "slot")
    return receipts.select("receipt_id").join(spots, "receipt_id", "left")


def with_slots(placed: DataFrame) -> DataFrame:
    """J-07 base: template slot of each placement.

    A placement beyond its template stays, with nulls and the reason in ``refused``.
    """
    slots = F.broadcast(slot_table(placed.sparkSession))
    met = placed.withColumn("layout", known_layout(F.col("layout"))).join(slots, ["layout", "slot"], "left")
    return met.withColumn("refused", F.when(F.col("grid_row").isNull(), fixed.NO_SUCH_SLOT))


def with_rects(placed: DataFrame, corner: Column) -> DataFrame:
    """J-07 / C-10: rectangle in EMU of each placement; beyond the template nulls and ``refused``."""
    rects = F.broadcast(rect_table(placed.sparkSession))
    side = F.coalesce(*[F.when(corner.startswith(s), s) for s in fixed.BAND_SIDES if s], F.lit(""))
    met = placed.withColumn("layout", known_layout(F.col("layout"))).withColumn("side", side)
    return met.join(rects, ["layout", "slot", "side"], "left").drop("side").withColumn(
        "refused", F.when(F.col("rect_x").isNull(), fixed.NO_SUCH_SLOT)
    )


def fitted(placed: DataFrame, corner: Column) -> DataFrame:
    """C-11, C-12: size in pixels and centring offset of each placement in its slot."""
    rects = with_rects(placed, corner)
    width_px, height_px = quads.fit(F.col("width"), F.col("height"), F.col("rect_w"), F.col("rect_h"))
    there = F.col("refused").isNull()
    sized = rects.withColumn("width_px", F.when(there, width_px)).withColumn("height_px", F.when(there, height_px))
    return sized.withColumn("offset_x", quads.centre(F.col("rect_x"), F.col("rect_w"), F.col("width_px"))).withColumn(
        "offset_y", quads.centre(F.col("rect_y"), F.col("rect_h"), F.col("height_px"))
    )


def manifest(placed: DataFrame, corner: Column) -> DataFrame:
    """S-06: export rows: one per occupied slot, with fitted size and page breaks.

    Needs ``batch_id, sheet_no, slot, layout, receipt_id, width, height``.  The
    page break flag is set on the lowest slot of every sheet but the batch's lowest: a
    minimum over a sheet, which has six slots at most, and one over a batch, taken
    before rows move.
    """
    there = F.col("slot") < capacity(F.col("layout"))
    lowest = placed.groupBy("batch_id").agg(F.min(F.when(there, F.col("sheet_no"))).alias("_lowest"))
    first = F.min(F.when(F.col("refused").isNull(), F.col("slot"))).over(Window.partitionBy("batch_id", "sheet_no"))
    opens = F.col("refused").isNull() & (F.col("slot") == first)
    return (
        fitted(placed, corner)
        .withColumn("_opens", opens)
        .join(lowest, "batch_id")
        .select(
            "batch_id", "sheet_no", "slot", "receipt_id", "offset_x", "offset_y", "width_px", "height_px",
            F.coalesce(F.col("_opens") & (F.col("sheet_no") != F.col("_lowest")), F.lit(False)).alias("page_break"), "refused",
        )
    )


def nested_manifest(rows: DataFrame) -> DataFrame:
    """S-06, nested: one row per sheet with its (at most six) images in slot order.

    Refused placements are in the flat rows only.
    """
    image = F.struct("slot", "receipt_id", "offset_x", "offset_y", "width_px", "height_px")
    return rows.filter(F.col("refused").isNull()).groupBy("batch_id", "sheet_no").agg(
        F.array_sort(F.collect_list(image)).alias("images"),
        F.bool_or("page_break").alias("page_break"),
    )


def print_cells(placed: DataFrame) -> DataFrame:
    """S-07: grid coordinates for a print view."""
    return with_slots(placed).select(
        "batch_id", "sheet_no", "slot", "name", "grid_row", "row_span", "grid_col", "col_span", "refused"
    )


def output_name(active: Column, code: Column, ext: str = "docx") -> Column:
    """S-08."""
    return F.concat(F.when(active, code).otherwise(F.lit("sincodigo")), F.lit(f"-comprobante.{ext}"))


def code_digits(code: Column) -> Column:
    """F-21."""
    return F.regexp_replace(code, "[^0-9]", "")


def code_valid(active: Column, code: Column) -> Column:
    """F-18: an inactive code is fine, an active one is all digits."""
    return ~active | F.regexp_like(code, F.lit(r"^[0-9]+\z"))


def export_gate(active: Column, code: Column, receipts: Column) -> Column:
    """F-18: message that stops the export, null when it may go on."""
    return F.when(~code_valid(active, code), fixed.CODE_INVALID).when(
        receipts == 0, fixed.NOTHING_TO_EXPORT
    )


def batch_gates(codes: DataFrame, receipts: DataFrame) -> DataFrame:
    """F-18 per batch: ``codes`` is ``batch_id, active, code``, one row per batch.

    A batch needs a valid code and at least one receipt (A-02).
    """
    counted = receipts.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
    gate = export_gate(F.col("active"), F.col("code"), F.coalesce(F.col("_n"), F.lit(0)))
    return codes.join(counted, "batch_id", "left").select("batch_id", gate.alias("message"))
