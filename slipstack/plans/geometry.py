"""Registered queries: quads and image sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipstack import fixed
from slipstack.functions import quads as op
from slipstack.plans.inputs import cte, load, table

# Corner i of an embedding: a rectangle of a 200 x 100 frame, shaken by eight values.
BASE = ((20, 15), (180, 15), (180, 85), (20, 85))


def shaken(spark, d, order=(0, 1, 2, 3)):
    """One quad per embedding; ``order`` shuffles the corners of ``points``."""
    v = F.col("embedding")
    rows = table(spark, d, "embeddings")
    for i, (x, y) in enumerate(BASE):
        rows = rows.withColumn(f"x{i}", v[2 * i].cast("double") * 150 + x).withColumn(
            f"y{i}", v[2 * i + 1].cast("double") * 90 + y
        )
    for i in range(4):
        rows = rows.withColumn(f"c{i}", F.abs(v[8 + i].cast("double")) * 3 + 0.2)
    mixed = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in order]
    rows = rows.withColumn("points", op.to_points(mixed))
    return rows.select("vec_id", "points", *[f"{n}{i}" for n in "xyc" for i in range(4)])


def _flat(points, digits: int = 6):
    quad = op.from_points(points)
    return [F.round(c, digits).alias(f"{n}{i}") for i, (x, y) in enumerate(quad) for n, c in (("x", x), ("y", y))]


def c15(spark, d):
    return shaken(spark, d).select("vec_id", op.is_convex(op.corners()).alias("convex"))


def c16(spark, d):
    quad = op.corners()
    w, h = op.output_size(quad)
    top, right, bottom, left = op.sides(quad)
    return shaken(spark, d).select(
        "vec_id", F.round(op.area(quad), 6).alias("area"), F.round(top, 6).alias("top"), F.round(right, 6).alias("right_"),
        F.round(bottom, 6).alias("bottom"), F.round(left, 6).alias("left_"), w.alias("out_w"), h.alias("out_h"),
    )


def f13(spark, d):
    sure = [F.col(f"c{i}") for i in range(4)]
    good = op.is_plausible(op.corners(), sure, F.lit(200.0), F.lit(100.0))
    return shaken(spark, d).select("vec_id", good.alias("plausible"))


def t03(spark, d):
    return shaken(spark, d, (2, 0, 3, 1)).withColumn("q", op.order_by_x(F.col("points"))).select("vec_id", *_flat(F.col("q")))


def t04(spark, d):
    return shaken(spark, d, (2, 0, 3, 1)).withColumn("q", op.order_by_angle(F.col("points"))).select("vec_id", *_flat(F.col("q")))


def c17(spark, d):
    return shaken(spark, d).withColumn("q", op.unclip(F.col("points"))).select("vec_id", *_flat(F.col("q"), 3))


def c18(spark, d):
    scaled = op.scale_clamp(op.corners(), F.lit(200.0), F.lit(100.0), F.lit(160.0), F.lit(160.0))
    rows = shaken(spark, d).withColumn("q", op.to_points(scaled))
    return rows.select(
        "vec_id", (op.area(op.from_points(F.col("q"))) >= fixed.MIN_BOX_AREA).alias("kept"), *_flat(F.col("q"))
    )


def c20(spark, d):
    return shaken(spark, d).withColumn("q", op.to_points(op.shift(op.corners()))).select("vec_id", *_flat(F.col("q")))


def _sizes(spark, d):
    return load(spark, d, "sizes")


def c13(spark, d):
    w, h = op.detector_size(F.col("w").cast("double"), F.col("h").cast("double"))
    return _sizes(spark, d).select("image_id", w.alias("det_w"), h.alias("det_h"))


def c14(spark, d):
    useful, total = op.line_widths(F.col("w").cast("double"), (F.col("h") / 100 + 1))
    return _sizes(spark, d).select("image_id", useful.alias("useful"), total.alias("total"))


def c21(spark, d):
    w, h = op.resized(F.col("w").cast("double"), F.col("h").cast("double"))
    return _sizes(spark, d).select("image_id", w.alias("new_w"), h.alias("new_h"))


def c27(spark, d):
    w, h = op.rotated(F.col("w"), F.col("h"), F.col("deg"))
    return _sizes(spark, d).select("image_id", w.alias("rot_w"), h.alias("rot_h"))


def _crop():
    return op.crop_rect(
        F.col("rx"), F.col("ry"), F.col("rw"), F.col("rh"), F.col("scale"), F.col("w").cast("bigint"), F.col("h").cast("bigint")
    )


def c28(spark, d):
    x, y, w, h = _crop()
    return _sizes(spark, d).select("image_id", x.alias("x"), y.alias("y"), w.alias("cw"), h.alias("ch"))


def f17(spark, d):
    _, _, w, h = _crop()
    verdict = F.when(F.least(w, h) < fixed.MIN_CROP_SIDE, "reject").otherwise("crop")
    return _sizes(spark, d).select("image_id", verdict.alias("verdict"))


def f14(spark, d):
    x, y, w, h = _crop()
    return _sizes(spark, d).select("image_id", op.crop_viable(w * 8, h * 8, F.col("w"), F.col("h")).alias("viable"))


QUERIES = {
    "C-13": c13, "C-14": c14, "C-15": c15, "C-16": c16, "C-17": c17, "C-18": c18, "C-20": c20, "C-21": c21,
    "C-27": c27, "C-28": c28, "F-13": f13, "F-14": f14, "F-17": f17, "T-03": t03, "T-04": t04,
}

COORDS = ", ".join(
    f"CAST(embedding[{2 * i + 1}] AS DOUBLE) * 150 + {x} AS x{i}, CAST(embedding[{2 * i + 2}] AS DOUBLE) * 90 + {y} AS y{i}, "
    f"abs(CAST(embedding[{9 + i}] AS DOUBLE)) * 3 + 0.2 AS c{i}"
    for i, (x, y) in enumerate(BASE)
)
P = f"WITH p AS (SELECT vec_id, {COORDS} FROM embeddings)"
NEXT = [(i, (i + 1) % 4) for i in range(4)]
TURNS = [
    f"((x{b} - x{a}) * (y{c} - y{b}) - (y{b} - y{a}) * (x{c} - x{b}))" for a, b, c in ((i, (i + 1) % 4, (i + 2) % 4) for i in range(4))
]
CONVEX = "((" + " AND ".join(f"{t} > 0" for t in TURNS) + ") OR (" + " AND ".join(f"{t} < 0" for t in TURNS) + "))"
AREA2 = "(" + " + ".join(f"(x{a} * y{b} - x{b} * y{a})" for a, b in NEXT) + ")"
LEN = [f"sqrt((x{b} - x{a}) * (x{b} - x{a}) + (y{b} - y{a}) * (y{b} - y{a}))" for a, b in NEXT]
ROUNDED = ", ".join(f"round(x{i}, 6) AS x{i}, round(y{i}, 6) AS y{i}" for i in range(4))
# One row per corner, in the shuffled input order, for the two orderings.
LONG = P + ", k AS (" + " UNION ALL ".join(
    f"SELECT vec_id, {n} AS i, x{c} AS x, y{c} AS y FROM p" for n, c in enumerate((2, 0, 3, 1))
) + ")"
WIDE = ", ".join(f"round(max(x) FILTER (pos = {i}), 6) AS x{i}, round(max(y) FILTER (pos = {i}), 6) AS y{i}" for i in range(4))
# Offset lines of the edges, then crossings of neighbours.
def grown(keys: str, source: str) -> str:
    """CTEs up to ``l``: the offset lines of the edges of ``source`` (keys, x0 to y3)."""
    return f""", e AS (SELECT *, abs({AREA2}) / 2 * 1.4 / ({' + '.join(LEN)}) AS push, (x0 + x1 + x2 + x3) / 4 AS gx, (y0 + y1 + y2 + y3) / 4 AS gy FROM {source}),
 n AS (SELECT *, {', '.join(f'(y{b} - y{a}) / {LEN[a]} AS nx{a}, -(x{b} - x{a}) / {LEN[a]} AS ny{a}' for a, b in NEXT)} FROM e),
 s AS (SELECT *, {', '.join(f'CASE WHEN nx{a} * ((x{a} + x{b}) / 2 - gx) + ny{a} * ((y{a} + y{b}) / 2 - gy) < 0 THEN -1 ELSE 1 END AS s{a}' for a, b in NEXT)} FROM n),
 l AS (SELECT {keys}, {', '.join(f'nx{a} * s{a} AS a{a}, ny{a} * s{a} AS b{a}, nx{a} * s{a} * (x{a} + nx{a} * s{a} * push) + ny{a} * s{a} * (y{a} + ny{a} * s{a} * push) AS c{a}' for a, _ in NEXT)} FROM s)"""


#: Corner i of the grown box: where its two lines cross.
CROSSED = [
    (f"(c{p} * b{i} - c{i} * b{p}) / (a{p} * b{i} - a{i} * b{p})", f"(a{p} * c{i} - a{i} * c{p}) / (a{p} * b{i} - a{i} * b{p})")
    for i, p in ((i, (i + 3) % 4) for i in range(4))
]
UNCLIP = P + grown("vec_id", "p") + " SELECT vec_id, " + ", ".join(f"round({x}, 3) AS x{i}, round({y}, 3) AS y{i}" for i, (x, y) in enumerate(CROSSED)) + " FROM l"
Z = cte("sizes")
RATIO = "CASE WHEN greatest(w, h) > 960 THEN 960.0::DOUBLE / greatest(w, h) ELSE 1 END"
SNAP = "CASE WHEN w < 1 OR h < 1 THEN 0 ELSE greatest(32, CAST(floor({0} * " + RATIO + " / 32 + 0.5) AS BIGINT) * 32) END"
LINE = "least(w / (h / 100 + 1), 32.0::DOUBLE)"
TOTAL = f"greatest(320, CAST(floor(48 * greatest(320.0::DOUBLE / 48, {LINE})) AS BIGINT))"
K = "least(1.0::DOUBLE, 2000.0::DOUBLE / greatest(w, h))"
CROP = (
    "crop AS (SELECT *, least(CAST(floor(rw * scale + 0.5) AS BIGINT), w - x) AS cw, least(CAST(floor(rh * scale + 0.5) AS BIGINT), h - y) AS ch "
    "FROM (SELECT *, least(CAST(floor(rx * scale + 0.5) AS BIGINT), w - 1) AS x, least(CAST(floor(ry * scale + 0.5) AS BIGINT), h - 1) AS y FROM sizes))"
)
ORACLES = {
    "C-13": Z + f"SELECT image_id, {SNAP.format('w')} AS det_w, {SNAP.format('h')} AS det_h FROM sizes",
    "C-14": Z + f"SELECT image_id, CASE WHEN w >= 1 THEN least({TOTAL}, greatest(1, CAST(ceil(48 * {LINE}) AS BIGINT))) END AS useful, CASE WHEN w >= 1 THEN {TOTAL} END AS total FROM sizes",
    "C-15": P + f"SELECT vec_id, {CONVEX} AS convex FROM p",
    "C-16": P + f"SELECT vec_id, round(abs({AREA2}) / 2, 6) AS area, round({LEN[0]}, 6) AS top, round({LEN[1]}, 6) AS right_, round({LEN[2]}, 6) AS bottom, round({LEN[3]}, 6) AS left_, "
    f"greatest(1, CAST(floor(({LEN[0]} + {LEN[2]}) / 2 + 0.5) AS BIGINT)) AS out_w, greatest(1, CAST(floor(({LEN[3]} + {LEN[1]}) / 2 + 0.5) AS BIGINT)) AS out_h FROM p",
    "C-17": UNCLIP,
    "C-18": P + ", z AS (SELECT vec_id, " + ", ".join(f"least(160.0::DOUBLE, greatest(0.0::DOUBLE, x{i} * 0.8::DOUBLE)) AS x{i}, least(160.0::DOUBLE, greatest(0.0::DOUBLE, y{i} * 1.6::DOUBLE)) AS y{i}" for i in range(4))
    + f" FROM p) SELECT vec_id, abs({AREA2}) / 2 >= 4 AS kept, {ROUNDED} FROM z",
    "C-20": P + ", z AS (SELECT vec_id, " + ", ".join(f"x{i} - 100 AS x{i}, y{i} - 100 AS y{i}" for i in range(4)) + f" FROM p) SELECT vec_id, {ROUNDED} FROM z",
    "C-21": Z + f"SELECT image_id, greatest(1, CAST(floor(w * {K} + 0.5) AS BIGINT)) AS new_w, greatest(1, CAST(floor(h * {K} + 0.5) AS BIGINT)) AS new_h FROM sizes",
    "C-27": Z + "SELECT image_id, CASE WHEN deg IN (90, 270) THEN h ELSE w END AS rot_w, CASE WHEN deg IN (90, 270) THEN w ELSE h END AS rot_h FROM sizes",
    "C-28": Z.rstrip() + f", {CROP} SELECT image_id, x, y, cw, ch FROM crop",
    "F-13": P + f"""SELECT vec_id, least(c0, c1, c2, c3) >= 0.3 AND {CONVEX} AND abs({AREA2}) / 2 BETWEEN 20000 * 0.05 AND 20000 * 0.98
        AND least({', '.join(LEN)}) >= sqrt(50000.0::DOUBLE) * 0.05 AS plausible FROM p""",
    "F-14": Z.rstrip() + f", {CROP} SELECT image_id, cw * 8 * ch * 8 >= w * h * 0.15 AND NOT (cw * 8 >= w AND ch * 8 >= h) AS viable FROM crop",
    "F-17": Z.rstrip() + f", {CROP} SELECT image_id, CASE WHEN least(cw, ch) < 8 THEN 'reject' ELSE 'crop' END AS verdict FROM crop",
    "T-03": LONG + f""", h AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) AS bx FROM k),
        o AS (SELECT *, (bx - 1) // 2 AS side, row_number() OVER (PARTITION BY vec_id, (bx - 1) // 2 ORDER BY y, bx) AS by_ FROM h),
        z AS (SELECT vec_id, x, y, CASE WHEN side = 0 THEN CASE by_ WHEN 1 THEN 0 ELSE 3 END ELSE CASE by_ WHEN 1 THEN 1 ELSE 2 END END AS pos FROM o)
        SELECT vec_id, {WIDE} FROM z GROUP BY vec_id""",
    "T-04": LONG + f""", g AS (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS cx, avg(y) OVER (PARTITION BY vec_id) AS cy FROM k),
        o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY atan2(y - cy, x - cx), i) - 1 AS r FROM g),
        f AS (SELECT vec_id, arg_min(r, (x + y, r)) AS first FROM o GROUP BY vec_id),
        z AS (SELECT vec_id, x, y, (r - first + 4) % 4 AS pos FROM o JOIN f USING (vec_id))
        SELECT vec_id, {WIDE} FROM z GROUP BY vec_id""",
}
