"""Geometry of four-corner boxes and of sheet slots, as column expressions.

A quad is a Python list of four ``(x, y)`` column pairs.  All of it is closed
form, so it stays inside generated code and never moves a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipstack import fixed

Corners = list[tuple[Column, Column]]


def js_round(value: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(value + F.lit(0.5))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def corners(prefix: str = "") -> Corners:
    return [(F.col(f"{prefix}x{i}"), F.col(f"{prefix}y{i}")) for i in range(4)]


def from_points(points: Column) -> Corners:
    """Corners of an array<struct<x,y>> column."""
    return [(F.get(points, F.lit(i))["x"], F.get(points, F.lit(i))["y"]) for i in range(4)]


def to_points(quad: Corners) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in quad])


def _pairs(quad: Corners):
    return [(quad[i], quad[(i + 1) % 4]) for i in range(4)]


def length(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    return F.sqrt(dx * dx + dy * dy)


def sides(quad: Corners) -> list[Column]:
    """C-16: top, right, bottom, left."""
    return [length(a, b) for a, b in _pairs(quad)]


def double_area(quad: Corners) -> Column:
    """Signed twice-the-area; negative when the winding is clockwise."""
    return reduce(lambda s, t: s + t, [a[0] * b[1] - b[0] * a[1] for a, b in _pairs(quad)])


def area(quad: Corners) -> Column:
    """C-16."""
    return F.abs(double_area(quad)) / 2


def is_convex(quad: Corners) -> Column:
    """C-15: the four turns share one non-zero sign."""
    turns = []
    for i in range(4):
        a, b, c = quad[i], quad[(i + 1) % 4], quad[(i + 2) % 4]
        turns.append((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]))
    left = reduce(lambda s, t: s & t, [t > 0 for t in turns])
    right = reduce(lambda s, t: s & t, [t < 0 for t in turns])
    return left | right


def output_size(quad: Corners) -> tuple[Column, Column]:
    """C-16: mean of opposite sides, rounded, at least one."""
    top, right, bottom, left = sides(quad)
    one = F.lit(1).cast("bigint")
    return (
        F.greatest(one, js_round((top + bottom) / 2)),
        F.greatest(one, js_round((left + right) / 2)),
    )


def is_plausible(quad: Corners, confidences: list[Column], width: Column, height: Column) -> Column:
    """F-13: confident, convex, neither tiny nor the whole frame, no sliver side."""
    sure = F.least(*confidences) >= fixed.HEAT_CELL_MIN if len(confidences) == 4 else F.lit(True)
    frame = width * height
    size = area(quad)
    diagonal = F.sqrt(width * width + height * height)
    return F.coalesce(
        sure
        & is_convex(quad)
        & (size >= frame * 0.05)
        & (size <= frame * 0.98)
        & (F.least(*sides(quad)) >= diagonal * 0.05),
        F.lit(False),
    )


def order_by_x(points: Column) -> Column:
    """T-03: left pair and right pair by x, each then by y (both sorts stable)."""
    keyed = F.transform(
        points, lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y"))
    )
    ranked = F.transform(
        F.array_sort(keyed),
        lambda p, i: F.struct(p["y"].alias("y"), i.alias("i"), p["x"].alias("x")),
    )
    halves = let(ranked, lambda r: F.array(F.array_sort(F.slice(r, 1, 2)), F.array_sort(F.slice(r, 3, 2))))

    def at(h: Column, side: int, i: int) -> Column:
        p = F.get(F.get(h, F.lit(side)), F.lit(i))
        return F.struct(p["x"].alias("x"), p["y"].alias("y"))

    return let(halves, lambda h: F.array(at(h, 0, 0), at(h, 1, 0), at(h, 1, 1), at(h, 0, 1)))


def order_by_angle(points: Column) -> Column:
    """T-04: by angle round the centroid, starting at the smallest x + y."""

    def turn(four: Column) -> Column:
        quad = from_points(four)
        cx = (quad[0][0] + quad[1][0] + quad[2][0] + quad[3][0]) / 4
        cy = (quad[0][1] + quad[1][1] + quad[2][1] + quad[3][1]) / 4
        return F.array_sort(
            F.transform(
                four,
                lambda p, i: F.struct(
                    F.atan2(p["y"] - cy, p["x"] - cx).alias("t"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y")
                ),
            )
        )

    def rotate(turned: Column) -> Column:
        plain = F.transform(turned, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
        start = let(F.transform(plain, lambda p: p["x"] + p["y"]), lambda v: F.array_position(v, F.array_min(v)))
        return let(
            F.struct(plain.alias("p"), start.cast("int").alias("s")),
            lambda r: F.concat(F.slice(r["p"], r["s"], 4), F.slice(r["p"], 1, r["s"] - 1)),
        )

    return let(let(points, turn), rotate)


def unclip(points: Column, ratio: float = fixed.UNCLIP_RATIO) -> Column:
    """C-17: the box grown on all sides by area * ratio / perimeter.

    A corner between edges with outward unit normals m and n moves by
    push * (m + n) / (1 + m . n), which keeps both edges parallel to where they were.
    Takes and gives points.  Null for boxes without area and where two neighbouring
    edges are parallel.
    """
    ring = F.sequence(F.lit(0), F.lit(3))

    def framed(q: Column) -> Column:
        quad = from_points(q)
        perimeter = reduce(lambda s, t: s + t, sides(quad))
        return F.struct(
            q.alias("q"),
            (F.nullif(area(quad), F.lit(0.0)) * ratio / F.nullif(perimeter, F.lit(0.0))).alias("push"),
            F.signum(double_area(quad)).alias("turn"),
        )

    def with_normals(f: Column) -> Column:
        def outward(i: Column) -> Column:
            step = let(
                F.struct(F.get(f["q"], i).alias("a"), F.get(f["q"], (i + 1) % 4).alias("b")),
                lambda e: F.struct((e["b"]["x"] - e["a"]["x"]).alias("dx"), (e["b"]["y"] - e["a"]["y"]).alias("dy")),
            )
            return let(
                let(step, lambda d: F.struct(d["dx"], d["dy"], F.nullif(F.hypot(d["dx"], d["dy"]), F.lit(0.0)).alias("n"))),
                lambda d: F.struct((f["turn"] * d["dy"] / d["n"]).alias("x"), (-f["turn"] * d["dx"] / d["n"]).alias("y")),
            )

        return F.struct(f["q"].alias("q"), f["push"].alias("push"), F.transform(ring, outward).alias("out"))

    def grown(f: Column) -> Column:
        def corner(i: Column) -> Column:
            met = F.struct(F.get(f["q"], i).alias("c"), F.get(f["out"], (i + 3) % 4).alias("m"), F.get(f["out"], i).alias("n"))
            return let(
                let(
                    met,
                    lambda e: F.struct(
                        e["c"].alias("c"), (e["m"]["x"] + e["n"]["x"]).alias("x"), (e["m"]["y"] + e["n"]["y"]).alias("y"),
                        F.when(
                            F.abs(e["m"]["x"] * e["n"]["y"] - e["m"]["y"] * e["n"]["x"]) >= fixed.PARALLEL_BELOW,
                            f["push"] / (1 + e["m"]["x"] * e["n"]["x"] + e["m"]["y"] * e["n"]["y"]),
                        ).alias("k"),
                    ),
                ),
                lambda e: F.struct((e["c"]["x"] + e["k"] * e["x"]).alias("x"), (e["c"]["y"] + e["k"] * e["y"]).alias("y")),
            )

        return F.transform(ring, corner)

    out = let(let(let(points, framed), with_normals), grown)
    return let(out, lambda g: F.when(F.forall(g, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), g))


def scale_clamp(quad: Corners, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Corners:
    """C-18: map cells to image pixels, kept inside the image."""
    zero = F.lit(0.0)
    return [
        (
            F.least(to_w, F.greatest(zero, x * (to_w / from_w))),
            F.least(to_h, F.greatest(zero, y * (to_h / from_h))),
        )
        for x, y in quad
    ]


def shift(quad: Corners, by: int = fixed.FRAME_PAD) -> Corners:
    """C-20: take a frame of ``by`` pixels away."""
    return [(x - by, y - by) for x, y in quad]


# --- sizes -------------------------------------------------------------------


def resize_scale(width: Column, height: Column) -> Column:
    """C-21: shrink factor so that no side exceeds the cap."""
    return F.least(F.lit(1.0), F.lit(float(fixed.MAX_IMAGE_SIDE)) / F.greatest(width, height))


def resized(width: Column, height: Column) -> tuple[Column, Column]:
    """C-21: rounded target size, at least one pixel a side."""
    k, one = resize_scale(width, height), F.lit(1).cast("bigint")
    return F.greatest(one, js_round(width * k)), F.greatest(one, js_round(height * k))


def detector_size(width: Column, height: Column) -> tuple[Column, Column]:
    """C-13: longest side at most 960, each side a multiple of 32, at least 32."""
    longest = F.greatest(width, height)
    cap, step = fixed.DETECTOR_MAX_SIDE, fixed.DETECTOR_MULTIPLE
    ratio = F.when(longest > cap, F.lit(float(cap)) / longest).otherwise(F.lit(1.0))
    zero, least = F.lit(0).cast("bigint"), F.lit(step).cast("bigint")

    def snap(side: Column) -> Column:
        snapped = js_round(side * ratio / step) * step
        return F.when((width < 1) | (height < 1), zero).otherwise(F.greatest(least, snapped))

    return snap(width), snap(height)


def line_widths(width: Column, height: Column) -> tuple[Column, Column]:
    """C-14: (useful, total) width of a text line scaled to height 48."""
    tall, base = fixed.LINE_HEIGHT, fixed.LINE_BASE_WIDTH
    ratio = F.least(width / height, F.lit(float(fixed.LINE_MAX_RATIO)))
    total = F.greatest(
        F.lit(base).cast("bigint"), F.floor(F.lit(tall) * F.greatest(F.lit(base / tall), ratio))
    )
    useful = F.least(total, F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(tall) * ratio)))
    good = (width >= 1) & (height >= 1)
    return F.when(good, useful), F.when(good, total)


def rotated(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """C-27."""
    turned = degrees.isin(90, 270)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def crop_rect(x: Column, y: Column, w: Column, h: Column, scale: Column, width: Column, height: Column):
    """C-28: a crop drawn on a scaled view, in natural pixels and inside the image."""
    left = F.least(js_round(x * scale), width - 1)
    top = F.least(js_round(y * scale), height - 1)
    return left, top, F.least(js_round(w * scale), width - left), F.least(js_round(h * scale), height - top)


def crop_viable(w: Column, h: Column, width: Column, height: Column) -> Column:
    """F-14: at least 15 % of the area and not the whole image."""
    return (w * h >= width * height * fixed.MIN_CROP_SHARE) & ~((w >= width) & (h >= height))


def is_safe_view(width: Column, height: Column) -> Column:
    """F-08, one reading: finite, at least 1 x 1, not too tall, not too large."""
    finite = ~F.isnan(width) & ~F.isnan(height) & (F.abs(width) < float("inf")) & (F.abs(height) < float("inf"))
    return F.coalesce(
        finite
        & (width >= 1)
        & (height >= 1)
        & (height <= fixed.MAX_RENDER_HEIGHT)
        & (width * height <= fixed.MAX_RENDER_AREA),
        F.lit(False),
    )


def is_safe_page(width: Column, height: Column) -> Column:
    """F-08: safe as it is and again when scaled to the render width."""
    scale = F.when(width != 0, F.lit(float(fixed.RENDER_WIDTH)) / width)
    return is_safe_view(width, height) & is_safe_view(width * scale, height * scale)


# --- sheet slots -------------------------------------------------------------


def fit(width: Column, height: Column, rect_w: Column, rect_h: Column) -> tuple[Column, Column]:
    """C-11: image size in pixels inside a slot, aspect kept; an unknown size takes the slot.

    The side that is the first to touch sets the scale for both.
    """
    one = F.lit(1).cast("bigint")
    room_w, room_h = (F.greatest(one, js_round(r / fixed.EMU_PER_PX)) for r in (rect_w, rect_h))
    known = (width >= 1) & (height >= 1)
    scale = F.when(room_w / width <= room_h / height, room_w / width).otherwise(room_h / height)
    return tuple(
        F.when(known, F.greatest(one, F.floor(side * scale))).otherwise(room) for side, room in ((width, room_w), (height, room_h))
    )


def centre(start: Column, room: Column, size_px: Column) -> Column:
    """C-12: offset that centres an image of ``size_px`` in ``room``."""
    return start + js_round((room - size_px * fixed.EMU_PER_PX) / 2)
