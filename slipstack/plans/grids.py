"""Registered queries: score maps, components, boxes, corner points and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipstack.functions import pixels as px
from slipstack.functions import quads
from slipstack.operators import grids as op
from slipstack.plans import geometry as geo
from slipstack.plans.inputs import table


def text_maps(spark, d):
    """Each embedding as an 8 x 8 map of text scores for an 80 x 80 image."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("map_id"), F.lit(0).alias("channel"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.transform("embedding", lambda v: F.least(F.lit(1.0), F.abs(v.cast("double")) * (F.col("label") * 0.5 + 2))).alias("p"),
        F.lit(80).alias("image_w"), F.lit(80).alias("image_h"),
    )


def heat_maps(spark, d):
    """Each embedding as four 4 x 4 corner channels for a 100 x 60 image."""
    p = F.transform("embedding", lambda v: F.abs(v.cast("double")) * 4)
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("map_id"), p.alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("channel")
    ).select(
        "map_id", "channel", F.lit(4).alias("width"), F.lit(4).alias("height"),
        F.slice("_p", F.col("channel") * 16 + 1, 16).alias("p"), F.lit(100).alias("image_w"), F.lit(60).alias("image_h"),
    )


BASE = "CASE WHEN label < 3 THEN 250 WHEN label < 5 THEN 8 ELSE 200 END"
INK = "CASE label WHEN 0 THEN -0.35 WHEN 1 THEN -0.25 WHEN 3 THEN -0.3 ELSE -0.12 END"


def pictures(spark, d):
    """Each embedding as an 8 x 8 RGBA picture: paper, some ink, some holes."""
    base = F.expr(BASE)
    ink = F.expr(INK).cast("double")

    def pixel(v):
        v = v.cast("double")
        shade = F.floor(v * 5)
        paper = [base + shade, base + 2 + shade, base - 2 + shade]
        channels = [F.when(v < ink, F.lit(120)).otherwise(c).cast("bigint") for c in paper]
        channels.append(F.when(v > 0.3, F.lit(0)).otherwise(F.lit(255)).cast("bigint"))
        return F.concat(*[F.lpad(F.hex(c), 2, "0") for c in channels])

    data = F.unhex(F.array_join(F.transform("embedding", pixel), ""))
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"), data.alias("data"), F.lit(8).alias("w"), F.lit(8).alias("h")
    )


def a10(spark, d):
    return text_maps(spark, d).select("map_id", F.round(op.mass(F.col("p")), 6).alias("mass"))


def w12(spark, d):
    return op.runs(text_maps(spark, d), op.is_text_cell).select(
        "map_id", *[F.col(c).cast("bigint").alias(c) for c in ("y", "x0", "x1", "start", "cells")]
    )


def j10(spark, d):
    return op.adjacency(op.runs(text_maps(spark, d), op.is_text_cell), diagonal=True).select("map_id", "lo", "hi")


def g01(spark, d):
    return op.labelled_runs(text_maps(spark, d), op.is_text_cell, diagonal=True).select("map_id", "start", "label")


def g01_rounds(spark, d):
    found = op.components(op.runs(text_maps(spark, d), op.is_text_cell), diagonal=True)
    return found.select("map_id", "start", "label")


def _heat(spark, d):
    return op.labelled_runs(heat_maps(spark, d), op.is_heat_cell, diagonal=False)


def g02(spark, d):
    return _heat(spark, d).select("map_id", F.col("channel").cast("bigint").alias("channel"), "start", "label")


def a11(spark, d):
    return op.component_sums(_heat(spark, d)).select(
        "map_id", F.col("channel").cast("bigint").alias("channel"), "label", "cells",
        *[F.round(c, 6).alias(c) for c in ("mass", "cx", "cy")],
    )


def a11_peak(spark, d):
    return heat_maps(spark, d).select(
        "map_id", F.col("channel").cast("bigint").alias("channel"), F.round(op.peak(F.col("p")), 6).alias("peak")
    )


def _corner_points(spark, d):
    sizes = heat_maps(spark, d).filter("channel = 0").select("map_id", "width", "height", "image_w", "image_h")
    return op.corner_points(op.heaviest(op.component_sums(_heat(spark, d))), sizes)


def a12(spark, d):
    return _corner_points(spark, d).select(
        "map_id", F.col("channel").cast("bigint").alias("channel"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y")
    )


def a13(spark, d):
    peaks = heat_maps(spark, d).select("map_id", "channel", op.peak(F.col("p")).alias("peak"))
    found = op.heat_quads(_corner_points(spark, d), peaks)
    quad = quads.from_points(F.col("quad"))
    shown = F.array_join(F.transform("confidences", lambda c: F.format_string("%.4f", c)), "|")
    return found.select(
        "map_id", shown.alias("confidences"),
        *[F.round(c, 6).alias(f"{n}{i}") for i, (x, y) in enumerate(quad) for n, c in (("x", x), ("y", y))],
    )


def _boxes(spark, d):
    """The shaken rectangles, shrunk from 200 x 100 onto the 8 x 8 maps."""
    small = F.transform(
        "points", lambda p: F.struct((p["x"] / 25).alias("x"), (p["y"] / 12.5).alias("y"))
    )
    return geo.shaken(spark, d).select(
        F.col("vec_id").alias("map_id"), F.lit(0).alias("channel"), F.col("vec_id").alias("label"), small.alias("quad")
    )


def j09(spark, d):
    return op.box_scores(_boxes(spark, d), text_maps(spark, d)).select("map_id", F.col("inside").cast("bigint").alias("inside"))


def a14(spark, d):
    return op.box_scores(_boxes(spark, d), text_maps(spark, d)).select("map_id", F.round("score", 6).alias("score"))


def a17(spark, d):
    q = quads.from_points(F.col("quad"))
    mod = F.sqrt((q[1][0] - q[0][0]) * (q[1][0] - q[0][0]) + (q[1][1] - q[0][1]) * (q[1][1] - q[0][1]))
    e = op.extents(F.col("quad"), (q[1][0] - q[0][0]) / mod, (q[1][1] - q[0][1]) / mod)
    return _boxes(spark, d).withColumn("e", e).select("map_id", *[F.round(f"e.{n}", 6).alias(n) for n in ("u0", "u1", "v0", "v1")])


def g03(spark, d):
    """Area of the smallest rectangle round every component."""
    rects = op.hulls(text_maps(spark, d)).withColumn("quad", op.smallest_rect(F.col("hull"))).filter("quad IS NOT NULL")
    return rects.select(
        "map_id", "label", "cells", F.round(quads.area(quads.from_points(F.col("quad"))), 6).alias("area")
    )


def text_boxes(spark, d):
    q = quads.from_points(F.col("quad"))
    return op.text_boxes(text_maps(spark, d)).select(
        "map_id", "box_no", F.round("score", 6).alias("score"),
        *[F.round(c, 4).alias(f"{n}{i}") for i, (x, y) in enumerate(q) for n, c in (("x", x), ("y", y))],
    )


def _bounding(spark, d):
    labelled = op.labelled_runs(text_maps(spark, d), op.is_text_cell, diagonal=True)
    b = labelled.groupBy("map_id", "channel", "label").agg(
        F.sum("cells").alias("cells"), F.min("x0").cast("double").alias("l"), F.max("x1").cast("double").alias("r"),
        F.min("y").cast("double").alias("t"), F.max("y").cast("double").alias("b"),
    ).filter("cells >= 3 AND r > l AND b > t")
    ring = [("l", "t"), ("r", "t"), ("r", "b"), ("l", "b")]
    return b.select("map_id", "channel", "label", quads.to_points([(F.col(x), F.col(y)) for x, y in ring]).alias("quad"))


def f15(spark, d):
    """The box filters on the bounding boxes of the components."""
    scored = op.box_scores(_bounding(spark, d), text_maps(spark, d), "width", "height", "image_w", "image_h")
    q = quads.from_points(F.col("quad"))
    return op.finish_boxes(scored).select(
        "map_id", F.col("box_no").cast("bigint").alias("box_no"), "label",
        F.round(q[0][0], 4).alias("x0"), F.round(q[0][1], 4).alias("y0"), F.round(q[2][0], 4).alias("x2"), F.round(q[2][1], 4).alias("y2"),
    )


def t06(spark, d):
    return f15(spark, d).select("map_id", "box_no", "label")


def _stats(spark, d):
    return pictures(spark, d).withColumn("s", px.pixel_stats("data", "w", "h"))


def u01(spark, d):
    return _stats(spark, d).select("image_id", F.round("s.white", 6).alias("white"), F.round("s.black", 6).alias("black"), F.col("s.sampled").alias("sampled"))


def f09(spark, d):
    return _stats(spark, d).select("image_id", px.is_blank(F.col("s")).alias("blank"))


def f10(spark, d):
    return _stats(spark, d).select("image_id", px.is_dark(F.col("s")).alias("dark"))


def a15(spark, d):
    found = pictures(spark, d).withColumn("b", px.border_colours("data", "w", "h"))
    return found.select("image_id", *[F.array_join(f"b.{s}", ",").alias(f"{s}_rgb") for s in px.SIDES])


def w08(spark, d):
    rows = pictures(spark, d).select("image_id", F.posexplode(px.background_lines("data", "w", "h")).alias("y", "background"))
    return rows.select("image_id", F.col("y").cast("bigint").alias("y"), "background")


def w09(spark, d):
    found = pictures(spark, d).withColumn("b", px.trim_box("data", "w", "h"))
    return found.select("image_id", *[F.col(f"b.{n}").cast("bigint").alias(n) for n in ("x0", "y0", "x1", "y1")])


def c22(spark, d):
    """Pixels that match the top border colour, per picture."""
    seen = pictures(spark, d).withColumn("n", px.matching_pixels("data", "w", "h"))
    return seen.select("image_id", F.col("n").alias("matching"))


QUERIES = {
    "A-10": a10, "W-12": w12, "J-10": j10, "G-01": g01, "G-01-rounds": g01_rounds, "G-02": g02, "A-11": a11,
    "A-11-peak": a11_peak, "A-12": a12, "A-13": a13, "J-09": j09, "A-14": a14, "A-17": a17, "G-03": g03,
    "text-boxes": text_boxes, "F-15": f15, "T-06": t06, "U-01": u01, "F-09": f09, "F-10": f10, "A-15": a15,
    "W-08": w08, "W-09": w09, "C-22": c22,
}


def _cells(width: int, scale: str, hot: str, per: int) -> str:
    return (
        f"cells AS (SELECT vec_id AS map_id, i // {per} AS channel, (i % {per}) % {width} AS x, (i % {per}) // {width} AS y, i % {per} AS pos, "
        f"{scale} AS p FROM (SELECT vec_id, label, i, abs(CAST(embedding[i + 1] AS DOUBLE)) AS v FROM embeddings, range(64) r(i))),\n"
        f"hot AS (SELECT * FROM cells WHERE p {hot})"
    )


def _reach(near: str) -> str:
    """Smallest reachable position per hot cell, by exhaustive reachability."""
    return f""", walk(map_id, channel, pos, x, y, seed) AS (SELECT map_id, channel, pos, x, y, pos FROM hot
        UNION SELECT h.map_id, h.channel, h.pos, h.x, h.y, w.seed FROM walk w JOIN hot h ON h.map_id = w.map_id AND h.channel = w.channel AND {near}),
        labels AS (SELECT map_id, channel, pos, min(seed) AS label FROM walk GROUP BY ALL)"""


RUNS = """, marked AS (SELECT *, x - row_number() OVER (PARTITION BY map_id, channel, y ORDER BY x) AS isle FROM hot),
 runs AS (SELECT map_id, channel, y, min(x) AS x0, max(x) AS x1, min(pos) AS start, count(*) AS cells FROM marked GROUP BY map_id, channel, y, isle)"""
TEXT = "WITH RECURSIVE " + _cells(8, "least(1.0::DOUBLE, v * (label * 0.5 + 2))", "> 0.2", 64) + RUNS
HEAT = "WITH RECURSIVE " + _cells(4, "v * 4", ">= 0.3", 16) + RUNS
EIGHT, FOUR = "abs(h.x - w.x) <= 1 AND abs(h.y - w.y) <= 1", "abs(h.x - w.x) + abs(h.y - w.y) = 1"
RUN_LABELS = "JOIN labels l ON l.map_id = r.map_id AND l.channel = r.channel AND l.pos = r.start"
SUMS = HEAT + _reach(FOUR) + """, comp AS (SELECT map_id, channel, label, count(*) AS cells, sum(p) AS mass, sum(x * p) / sum(p) AS cx, sum(y * p) / sum(p) AS cy
 FROM hot JOIN labels USING (map_id, channel, pos) GROUP BY ALL),
 pts AS (SELECT map_id, channel, (arg_max(cx, (mass, -label)) + 0.5) / 4 * 100 AS x, (arg_max(cy, (mass, -label)) + 0.5) / 4 * 60 AS y FROM comp GROUP BY map_id, channel)"""
SMALL = geo.P + ", b AS (SELECT vec_id, " + ", ".join(f"x{i} / 25 AS x{i}, y{i} / 12.5 AS y{i}" for i in range(4)) + " FROM p)"
INSIDE = " AND ".join(
    f"((x{b} - x{a}) * (y - y{a}) - (y{b} - y{a}) * (x - x{a})) * sgn >= 0" for a, b in geo.NEXT
)
SCORED = SMALL + f""", grid AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, least(1.0::DOUBLE, abs(CAST(embedding[i + 1] AS DOUBLE)) * (label * 0.5 + 2)) AS v FROM embeddings, range(64) r(i)),
 inn AS (SELECT vec_id, v FROM grid JOIN (SELECT *, CASE WHEN {geo.AREA2} < 0 THEN -1 ELSE 1 END AS sgn FROM b) USING (vec_id)
   WHERE x BETWEEN greatest(0, floor(least(x0, x1, x2, x3))) AND ceil(greatest(x0, x1, x2, x3)) AND y BETWEEN greatest(0, floor(least(y0, y1, y2, y3))) AND ceil(greatest(y0, y1, y2, y3)) AND {INSIDE})"""
UX, UY = f"(x1 - x0) / {geo.LEN[0]}", f"(y1 - y0) / {geo.LEN[0]}"
ALONG = ", ".join(f"x{i} * ({UX}) + y{i} * ({UY})" for i in range(4))
ACROSS = ", ".join(f"-x{i} * ({UY}) + y{i} * ({UX})" for i in range(4))
BOUNDS = TEXT + _reach(EIGHT) + """, bb AS (SELECT map_id, label, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b, count(*) AS n FROM hot JOIN labels USING (map_id, channel, pos) GROUP BY ALL),
 sc AS (SELECT bb.map_id, label, l, r, t, b, avg(p) AS score, (r - l) * (b - t) * 1.4::DOUBLE / (2 * (r - l + b - t)) AS push
   FROM bb JOIN cells c ON c.map_id = bb.map_id AND x BETWEEN l AND r AND y BETWEEN t AND b WHERE n >= 3 AND r > l AND b > t GROUP BY ALL),
 fin AS (SELECT map_id, label, greatest(0, (l - push) * 10) AS x0, greatest(0, (t - push) * 10) AS y0, least(80, (r + push) * 10) AS x2, least(80, (b + push) * 10) AS y2 FROM sc WHERE score >= 0.45),
 num AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY label) AS box_no FROM fin WHERE (x2 - x0) * (y2 - y0) >= 4)"""
RING = [("u0", "v0"), ("u1", "v0"), ("u1", "v1"), ("u0", "v1")]
# From cells to finished boxes: every pair of cells with the component on its left is tried as an edge.
BOXES = TEXT + _reach(EIGHT) + f""", c AS (SELECT map_id, label, x, y, count(*) OVER (PARTITION BY map_id, label) AS cells FROM hot JOIN labels USING (map_id, channel, pos)),
 d AS (SELECT a.map_id, a.label, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM c a JOIN c b ON a.map_id = b.map_id AND a.label = b.label AND (a.x <> b.x OR a.y <> b.y) WHERE a.cells >= 3),
 r AS (SELECT map_id, d.label, dx, dy, dx * dx + dy * dy AS sq, min(x * dx + y * dy) AS u0, max(x * dx + y * dy) AS u1, min(y * dx - x * dy) AS v0, max(y * dx - x * dy) AS v1, ay * dx - ax * dy AS own,
   CASE WHEN dx = 0 AND dy < 0 THEN 9 ELSE atan2(dy, dx) + CASE WHEN dx < 0 AND dy < 0 THEN 2 * pi() ELSE 0 END END AS turn FROM d JOIN c USING (map_id, label) GROUP BY map_id, d.label, ax, ay, dx, dy),
 best AS (SELECT * FROM r WHERE v0 = own AND v1 > own QUALIFY row_number() OVER (PARTITION BY map_id, label ORDER BY CAST((u1 - u0) * (v1 - v0) AS DOUBLE) / sq, turn) = 1),
 rect AS (SELECT map_id, label, {', '.join(f'CAST({u} * dx - {v} * dy AS DOUBLE) / sq AS x{i}, CAST({u} * dy + {v} * dx AS DOUBLE) / sq AS y{i}' for i, (u, v) in enumerate(RING))} FROM best),
 sc AS (SELECT q.map_id, label, avg(p) AS score FROM (SELECT *, CASE WHEN {geo.AREA2} < 0 THEN -1 ELSE 1 END AS sgn FROM rect) q JOIN cells c ON c.map_id = q.map_id
   WHERE x BETWEEN floor(least(x0, x1, x2, x3)) AND ceil(greatest(x0, x1, x2, x3)) AND y BETWEEN floor(least(y0, y1, y2, y3)) AND ceil(greatest(y0, y1, y2, y3)) AND {INSIDE} GROUP BY ALL HAVING avg(p) >= 0.45),
 k AS ({' UNION ALL '.join(f'SELECT map_id, label, score, {i} AS i, x{i} AS x, y{i} AS y FROM rect JOIN sc USING (map_id, label)' for i in range(4))}),
 h AS (SELECT *, row_number() OVER (PARTITION BY map_id, label ORDER BY x, i) AS bx FROM k),
 o AS (SELECT *, (bx - 1) // 2 AS side, row_number() OVER (PARTITION BY map_id, label, (bx - 1) // 2 ORDER BY y, bx) AS by_ FROM h),
 z AS (SELECT map_id, label, score, x, y, CASE WHEN side = 0 THEN CASE by_ WHEN 1 THEN 0 ELSE 3 END ELSE CASE by_ WHEN 1 THEN 1 ELSE 2 END END AS pos FROM o),
 w AS (SELECT map_id, label, score, {', '.join(f'max(x) FILTER (pos = {i}) AS x{i}, max(y) FILTER (pos = {i}) AS y{i}' for i in range(4))} FROM z GROUP BY map_id, label, score)
 """ + geo.grown("map_id, label, score", "w") + f""",
 fin AS (SELECT map_id, label, score, {', '.join(f'least(80, greatest(0, {x} * 10)) AS x{i}, least(80, greatest(0, {y} * 10)) AS y{i}' for i, (x, y) in enumerate(geo.CROSSED))} FROM l)"""
PX = f"""WITH px AS (SELECT vec_id AS image_id, i % 8 AS x, i // 8 AS y, i,
   CASE WHEN v < ink THEN 120 ELSE base + s END AS r, CASE WHEN v < ink THEN 120 ELSE base + 2 + s END AS g, CASE WHEN v < ink THEN 120 ELSE base - 2 + s END AS b,
   CASE WHEN v > 0.3 THEN 0 ELSE 255 END AS a FROM (SELECT *, CAST(floor(v * 5) AS BIGINT) AS s FROM
     (SELECT vec_id, i, {BASE} AS base, CAST({INK} AS DOUBLE) AS ink, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i)))),
 shares AS (SELECT image_id, avg(CASE WHEN a < 128 OR (r > 245 AND g > 245 AND b > 245) THEN 1.0 ELSE 0 END) AS white,
   avg(CASE WHEN a < 128 OR (r < 20 AND g < 20 AND b < 20) THEN 1.0 ELSE 0 END) AS black, count(*) AS sampled FROM px WHERE i % 4 = 0 GROUP BY image_id)"""


def _middle(channel: str) -> str:
    solid = f"list({channel} ORDER BY {channel}) FILTER (a >= 128)"
    return f"coalesce(({solid})[len({solid}) // 2 + 1], 0) AS {channel}"


SIDES = PX + ", ref AS (" + " UNION ALL ".join(
    f"SELECT image_id, '{side}' AS side, {_middle('r')}, {_middle('g')}, {_middle('b')} FROM px WHERE {where} GROUP BY image_id"
    for side, where in (("top", "y = 0"), ("bottom", "y = 7"), ("left", "x = 0"), ("right", "x = 7"))
) + ")"


def _match(ref: str) -> str:
    return f"(p.a < 128 OR (abs(p.r - {ref}.r) <= 15 AND abs(p.g - {ref}.g) <= 15 AND abs(p.b - {ref}.b) <= 15))"


def _lines(name: str, idx: str, pos: str, first: str, last: str, middle: str) -> str:
    return f""", {name} AS (SELECT image_id, idx, NOT coalesce(list_bool_or([k BETWEEN lo AND hi for k in bad]), false) AS bg FROM
      (SELECT p.image_id, p.{idx} AS idx, coalesce(min(p.{pos}) FILTER (NOT {_match('f')}), 99) AS lo, coalesce(max(p.{pos}) FILTER (NOT {_match('l')}), -1) AS hi,
        coalesce(list(p.{pos}) FILTER (NOT {_match('m')}), []) AS bad
       FROM px p JOIN ref f ON f.image_id = p.image_id AND f.side = '{first}' JOIN ref l ON l.image_id = p.image_id AND l.side = '{last}'
       JOIN ref m ON m.image_id = p.image_id AND m.side = '{middle}' GROUP BY 1, 2))"""


LINES = (
    SIDES + _lines("r_top", "y", "x", "left", "right", "top") + _lines("r_bot", "y", "x", "left", "right", "bottom")
    + _lines("c_left", "x", "y", "top", "bottom", "left") + _lines("c_right", "x", "y", "top", "bottom", "right")
)
TRIM = LINES + """, ys AS (SELECT image_id, coalesce(min(idx) FILTER (NOT bg), 7) AS y0 FROM r_top GROUP BY image_id),
 ye AS (SELECT image_id, y0, greatest(y0, max(CASE WHEN NOT bg AND idx > y0 THEN idx ELSE 0 END)) AS y1 FROM r_bot b JOIN ys USING (image_id) GROUP BY image_id, y0),
 xs AS (SELECT image_id, coalesce(min(idx) FILTER (NOT bg), 7) AS x0 FROM c_left GROUP BY image_id),
 xe AS (SELECT image_id, x0, greatest(x0, max(CASE WHEN NOT bg AND idx > x0 THEN idx ELSE 0 END)) AS x1 FROM c_right b JOIN xs USING (image_id) GROUP BY image_id, x0),
 allb AS (SELECT *, (SELECT bg FROM r_top t WHERE t.image_id = ye.image_id AND idx = y0) AND (SELECT bg FROM c_left t WHERE t.image_id = ye.image_id AND idx = x0) AS flat FROM ye JOIN xe USING (image_id))"""
ORACLES = {
    "A-10": TEXT + " SELECT map_id, round(avg(p), 6) AS mass FROM cells GROUP BY map_id",
    "W-12": TEXT + " SELECT map_id, y, x0, x1, start, cells FROM runs",
    "J-10": TEXT + " SELECT u.map_id, u.start AS lo, d.start AS hi FROM runs u JOIN runs d ON d.map_id = u.map_id AND d.y = u.y + 1 AND d.x0 <= u.x1 + 1 AND u.x0 <= d.x1 + 1",
    "G-01": TEXT + _reach(EIGHT) + f" SELECT r.map_id, start, label FROM runs r {RUN_LABELS}",
    "G-02": HEAT + _reach(FOUR) + f" SELECT r.map_id, r.channel, start, label FROM runs r {RUN_LABELS}",
    "A-11": SUMS + " SELECT map_id, channel, label, cells, round(mass, 6) AS mass, round(cx, 6) AS cx, round(cy, 6) AS cy FROM comp",
    "A-11-peak": HEAT + " SELECT map_id, channel, round(greatest(0, max(p)), 6) AS peak FROM cells GROUP BY map_id, channel",
    "A-12": SUMS + " SELECT map_id, channel, round(x, 6) AS x, round(y, 6) AS y FROM pts",
    "A-13": SUMS + f""", g AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy, count(*) OVER w AS n FROM pts WINDOW w AS (PARTITION BY map_id)),
        o AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY atan2(y - cy, x - cx), channel) - 1 AS r FROM g WHERE n = 4),
        f AS (SELECT map_id, arg_min(r, (x + y, r)) AS first FROM o GROUP BY map_id),
        z AS (SELECT map_id, x, y, (r - first + 4) % 4 AS pos FROM o JOIN f USING (map_id)),
        qd AS (SELECT map_id, {', '.join(f'max(x) FILTER (pos = {i}) AS x{i}, max(y) FILTER (pos = {i}) AS y{i}' for i in range(4))} FROM z GROUP BY map_id),
        good AS (SELECT map_id, {geo.ROUNDED} FROM qd WHERE {geo.CONVEX}),
        peaks AS (SELECT map_id, string_agg(printf('%.4f', m), '|' ORDER BY channel) AS confidences FROM (SELECT map_id, channel, greatest(0, max(p)) AS m FROM cells GROUP BY map_id, channel) GROUP BY map_id)
        SELECT peaks.map_id, confidences, {', '.join(f'x{i}, y{i}' for i in range(4))} FROM peaks LEFT JOIN good USING (map_id)""",
    "J-09": SCORED + " SELECT b.vec_id AS map_id, count(v) AS inside FROM b LEFT JOIN inn USING (vec_id) GROUP BY 1",
    "A-14": SCORED + " SELECT b.vec_id AS map_id, round(coalesce(avg(v), 0), 6) AS score FROM b LEFT JOIN inn USING (vec_id) GROUP BY 1",
    "A-17": SMALL + f" SELECT vec_id AS map_id, round(least({ALONG}), 6) AS u0, round(greatest({ALONG}), 6) AS u1, round(least({ACROSS}), 6) AS v0, round(greatest({ACROSS}), 6) AS v1 FROM b",
    # Every pair of cells that has the whole component on one side is tried as an edge.
    "G-03": TEXT + _reach(EIGHT) + """, c AS (SELECT map_id, label, x, y FROM hot JOIN labels USING (map_id, channel, pos)),
        d AS (SELECT a.map_id, a.label, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS m
              FROM c a JOIN c b ON a.map_id = b.map_id AND a.label = b.label AND (a.x <> b.x OR a.y <> b.y)),
        e AS (SELECT d.map_id, d.label, ax, ay, dx, dy, max((x * dx + y * dy) / m) - min((x * dx + y * dy) / m) AS u, max((y * dx - x * dy) / m) - min((y * dx - x * dy) / m) AS v,
              min(dx * (y - ay) - dy * (x - ax)) AS low, max(dx * (y - ay) - dy * (x - ax)) AS high FROM d JOIN c ON c.map_id = d.map_id AND c.label = d.label GROUP BY ALL),
        n AS (SELECT map_id, label, count(*) AS cells FROM c GROUP BY ALL)
        SELECT map_id, label, any_value(cells) AS cells, round(min(u * v), 6) AS area FROM e JOIN n USING (map_id, label) WHERE low >= 0 AND high > 0 GROUP BY map_id, label""",
    "text-boxes": BOXES + f" SELECT map_id, row_number() OVER (PARTITION BY map_id ORDER BY label) AS box_no, round(score, 6) AS score, {', '.join(f'round(x{i}, 4) AS x{i}, round(y{i}, 4) AS y{i}' for i in range(4))} FROM fin WHERE abs({geo.AREA2}) / 2 >= 4",
    "F-15": BOUNDS + " SELECT map_id, box_no, label, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM num",
    "T-06": BOUNDS + " SELECT map_id, box_no, label FROM num",
    "U-01": PX + " SELECT image_id, round(white, 6) AS white, round(black, 6) AS black, sampled FROM shares",
    "F-09": PX + " SELECT image_id, white >= 0.995 AS blank FROM shares",
    "F-10": PX + " SELECT image_id, black >= 0.995 AS dark FROM shares",
    "A-15": SIDES + " SELECT image_id, " + ", ".join(f"max(r || ',' || g || ',' || b) FILTER (side = '{s}') AS {s}_rgb" for s in px.SIDES) + " FROM ref GROUP BY image_id",
    "W-08": LINES + " SELECT image_id, idx AS y, bg AS background FROM r_top",
    "W-09": TRIM + " SELECT image_id, " + ", ".join(f"CASE WHEN NOT flat THEN {n} END AS {n}" for n in ("x0", "y0", "x1", "y1")) + " FROM allb",
    "C-22": SIDES + f" SELECT p.image_id, count(*) FILTER ({_match('t')}) AS matching FROM px p JOIN ref t ON t.image_id = p.image_id AND t.side = 'top' GROUP BY 1",
}
ORACLES["G-01-rounds"] = ORACLES["G-01"]
