"""Pixel buffers: blank and dark pages, border colours, background lines, trimming.

An image is one row with its bytes (at most 2000 x 2000 after C-21).  Spark has no
operators on packed bytes, so these few whole-buffer statistics run as Arrow-batched
functions: no row moves, and one image at a time is in memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipstack import fixed

STATS = (
    T.StructType()
    .add("white", T.DoubleType())
    .add("black", T.DoubleType())
    .add("sampled", T.LongType())
)
SIDES = ("top", "bottom", "left", "right")
BORDERS = T.StructType([T.StructField(side, T.ArrayType(T.IntegerType())) for side in SIDES])
BOX = T.StructType([T.StructField(name, T.IntegerType()) for name in ("x0", "y0", "x1", "y1")])


def _pixels(data: bytes, width: int, height: int) -> np.ndarray:
    """(height, width, 4) view of RGBA bytes."""
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4).astype(np.int16)


def _grid(data, width, height) -> np.ndarray | None:
    if data is None or width < 1 or height < 1 or len(data) != width * height * 4:
        return None
    return _pixels(data, int(width), int(height))


def _shares(img: np.ndarray | None) -> tuple:
    if img is None:
        return (None, None, 0)
    seen = img.reshape(-1, 4)[:: fixed.PIXEL_STEP]
    clear = seen[:, 3] < fixed.ALPHA_OPAQUE
    white = clear | (seen[:, :3] > fixed.WHITE_ABOVE).all(axis=1)
    black = clear | (seen[:, :3] < fixed.BLACK_BELOW).all(axis=1)
    return (float(white.mean()), float(black.mean()), len(seen))


def middle_colour(line: np.ndarray) -> list[int]:
    """Element floor(n/2) of each sorted channel, transparent pixels left out."""
    solid = line[line[:, 3] >= fixed.ALPHA_OPAQUE, :3]
    if not len(solid):
        return [0, 0, 0]
    return np.sort(solid, axis=0)[len(solid) // 2].tolist()


def _borders(img: np.ndarray) -> dict[str, list[int]]:
    edges = {"top": img[0], "bottom": img[-1], "left": img[:, 0], "right": img[:, -1]}
    return {side: middle_colour(line) for side, line in edges.items()}


def matches(img: np.ndarray, ref: list[int]) -> np.ndarray:
    """C-22 for every pixel at once."""
    near = np.abs(img[..., :3] - np.asarray(ref, dtype=np.int16)) <= fixed.COLOUR_TOLERANCE
    return near.all(axis=-1) | (img[..., 3] < fixed.ALPHA_OPAQUE)


def background_rows(img: np.ndarray, first: list[int], last: list[int], middle: list[int]) -> np.ndarray:
    """W-08 for every row: a lead-in of ``first``, a tail of ``last``, only ``middle`` between."""
    lead = np.logical_and.accumulate(matches(img, first), axis=1)
    tail = np.logical_and.accumulate(matches(img, last)[:, ::-1], axis=1)[:, ::-1]
    return (lead | tail | matches(img, middle)).all(axis=1)


def _trim(img: np.ndarray | None) -> tuple:
    """W-09: content bounds, or nothing for a picture of one colour."""
    if img is None:
        return (None,) * 4
    side = _borders(img)
    across = img.swapaxes(0, 1)

    def bounds(block, ends, sides):
        above = background_rows(block, sides[0], sides[1], ends[0])
        below = background_rows(block, sides[0], sides[1], ends[1])
        stop = len(above) - 1
        start = int(np.argmin(above)) if not above.all() else stop
        start = min(start, stop)
        upward = below[start + 1 :][::-1]
        kept = int(np.argmin(upward)) if len(upward) and not upward.all() else len(upward)
        return start, stop - kept, bool(above[start])

    y0, y1, flat_row = bounds(img, (side["top"], side["bottom"]), (side["left"], side["right"]))
    x0, x1, flat_col = bounds(across, (side["left"], side["right"]), (side["top"], side["bottom"]))
    return (None,) * 4 if flat_row and flat_col else (x0, y0, x1, y1)


def _per_image(fn, data: pd.Series, width: pd.Series, height: pd.Series, names: list[str]) -> pd.DataFrame:
    rows = [fn(_grid(d, w, h)) for d, w, h in zip(data, width, height)]
    return pd.DataFrame(rows, columns=names, dtype=object)


@F.pandas_udf(STATS)
def pixel_stats(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """U-01: share of white and of black among every fourth pixel."""
    return _per_image(_shares, data, width, height, ["white", "black", "sampled"])


@F.pandas_udf(BORDERS)
def border_colours(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """A-15: the middle colour of each side."""
    names = list(SIDES)

    def four(img):
        found = _borders(img) if img is not None else {}
        return tuple(found.get(n) for n in names)

    return _per_image(four, data, width, height, names)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def background_lines(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """W-08: which rows are background, judged with the top colour in the middle."""

    def flags(img):
        if img is None:
            return None
        side = _borders(img)
        return background_rows(img, side["left"], side["right"], side["top"]).tolist()

    return pd.Series([flags(_grid(d, w, h)) for d, w, h in zip(data, width, height)])


@F.pandas_udf(BOX)
def trim_box(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """W-09: first and last content column and row."""
    return _per_image(_trim, data, width, height, ["x0", "y0", "x1", "y1"])


def is_blank(stats):
    """F-09 on U-01: no pixels, no verdict."""
    return F.coalesce((stats["sampled"] > 0) & (stats["white"] >= fixed.BLANK_RATIO), F.lit(False))


def is_dark(stats):
    """F-10 on U-01."""
    return F.coalesce((stats["sampled"] > 0) & (stats["black"] >= fixed.BLANK_RATIO), F.lit(False))


@F.pandas_udf(T.LongType())
def matching_pixels(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """C-22: how many pixels match the top border colour."""
    grids = (_grid(d, w, h) for d, w, h in zip(data, width, height))
    return pd.Series([None if g is None else int(matches(g, middle_colour(g[0])).sum()) for g in grids])


@F.pandas_udf(T.BinaryType())
def rgba_bytes(data: pd.Series, channels: pd.Series) -> pd.Series:
    """U-01: Spark's image source bytes (BGR, BGRA or grey) as RGBA."""

    def turned(raw: bytes, n: int) -> bytes:
        flat = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
        out = np.full((len(flat), 4), 255, dtype=np.uint8)
        out[:, :3] = flat[:, [2, 1, 0]] if n >= 3 else flat[:, [0]]
        if n == 4:
            out[:, 3] = flat[:, 3]
        return out.tobytes()

    return pd.Series([turned(d, int(n)) for d, n in zip(data, channels)])
