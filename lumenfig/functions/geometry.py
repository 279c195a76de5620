"""Boxes as columns: overlap, containment, gaps and padding, all inside the JVM.

A box is a struct or prefix of four columns x0, y0, x1, y1 in pixels. Inverted and empty boxes have no area;
a null coordinate gives null.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels per inch of the raster, points per inch, padding of a crop.
DPI, POINTS, PAD = 250, 72.0, 4


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "", table: str = "") -> Box:
        """The columns of one box: ``prefix`` before each name, in the aliased ``table``."""
        at = f"{table}." if table else ""
        return cls(*[F.col(f"{at}{prefix}{c}").cast("double") for c in ("x0", "y0", "x1", "y1")])

    @property
    def w(self) -> Column:
        return self.x1 - self.x0

    @property
    def h(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return positive(self.w) * positive(self.h)


def positive(v: Column) -> Column:
    return F.greatest(F.lit(0.0), v)


def at_least_one(v: Column) -> Column:
    return F.greatest(F.lit(1.0), v)


def clamp(v: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.greatest(F.lit(lo) if not isinstance(lo, Column) else lo, F.least(F.lit(hi) if not isinstance(hi, Column) else hi, v))


def to_pixels(points: Column, dpi: int = DPI) -> Column:
    return points * F.lit(dpi / POINTS)


def to_points(pixels: Column, dpi: int = DPI) -> Column:
    return pixels * F.lit(POINTS / dpi)


def across(a: Box, b: Box) -> Column:
    """Width that two boxes share."""
    return positive(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))


def upright(a: Box, b: Box) -> Column:
    """Height that two boxes share."""
    return positive(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def intersection(a: Box, b: Box) -> Column:
    return across(a, b) * upright(a, b)


def v_overlap(a: Box, b: Box) -> Column:
    """Shared height over the smaller height."""
    return upright(a, b) / at_least_one(F.least(a.h, b.h))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; exactly 0 for boxes that only touch."""
    inter = intersection(a, b)
    union = positive(a.w) * positive(a.h) + positive(b.w) * positive(b.h) - inter
    return F.when(inter > 0, inter / F.greatest(F.lit(1e-9), union)).otherwise(0.0)


def ios(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    inter = intersection(a, b)
    least = F.least(F.greatest(F.lit(1e-9), a.w * a.h), F.greatest(F.lit(1e-9), b.w * b.h))
    return F.when(inter > 0, inter / least).otherwise(0.0)


def gap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), a.x0 - b.x1, b.x0 - a.x1)


def gap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), a.y0 - b.y1, b.y0 - a.y1)


def padded(a: Box, width: Column, height: Column, pad: int = PAD, left: Column | None = None) -> Box:
    """Whole pixels with padding, inside the page; ``left`` is the edge of a watermark."""
    x0 = clamp(F.floor(a.x0) - pad, 0, width - 1)
    return Box(
        F.greatest(x0, left) if left is not None else x0,
        clamp(F.floor(a.y0) - pad, 0, height - 1),
        clamp(F.ceil(a.x1) + pad, 0, width - 1),
        clamp(F.ceil(a.y1) + pad, 0, height - 1),
    )


def cut_above(bottom: Column, caption_top: Column) -> Column:
    """A box ends two pixels above its caption."""
    return F.least(bottom, caption_top - 2.0)


def large_enough(a: Box, high: float = 10) -> Column:
    """The least size of a crop: more than 10 pixels wide, and more than ``high`` high (30 for a seeded box)."""
    return (a.x1 > a.x0 + 10) & (a.y1 > a.y0 + high)
