"""Planar geometry as Column expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Deepest quadtree level; it bounds addresses where many points coincide.
MAX_DEPTH = 20


def _c(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def distance(x1: Column | float, y1: Column | float, x2: Column | float, y2: Column | float) -> Column:
    """Euclidean distance."""
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def _gap(low: Column | float, high: Column | float, low2: Column | float, high2: Column | float) -> Column:
    return F.greatest(_c(low) - _c(high2), F.lit(0.0), _c(low2) - _c(high))


def mindist_point_rect(x, y, x1, y1, x2, y2) -> Column:
    """Least distance from a point to the rectangle [x1, x2] x [y1, y2]; 0 inside."""
    return mindist_rect_rect(x, y, x, y, x1, y1, x2, y2)


def mindist_rect_rect(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    """Least distance between two rectangles given by their lower left and upper right corners; 0 if they touch."""
    dx, dy = _gap(x1, x2, x3, x4), _gap(y1, y2, y3, y4)
    return F.sqrt(dx * dx + dy * dy)


def rects_meet(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    """Closed rectangles share a point."""
    return (_c(x1) <= _c(x4)) & (_c(x2) >= _c(x3)) & (_c(y1) <= _c(y4)) & (_c(y2) >= _c(y3))


def disk_meets_rect(x, y, radius, x1, y1, x2, y2, closed: bool = True) -> Column:
    """A disk, with or without its rim, meets a rectangle."""
    gap = mindist_point_rect(x, y, x1, y1, x2, y2)
    return gap <= _c(radius) if closed else gap < _c(radius)


def in_unit_square(x: Column, y: Column) -> Column:
    """Coordinates that the partitionings accept: 0 <= x < 1 and 0 <= y < 1; false for null and NaN."""
    return F.coalesce((x >= 0) & (x < 1) & (y >= 0) & (y < 1), F.lit(False))


def grid_cell(x: Column, y: Column, n: int) -> Column:
    """Row-major cell number in an n x n grid. Coordinates are divided by the width, for multiplying by n truncates differently."""
    width = 1.0 / n
    return F.floor(y / width).cast("long") * n + F.floor(x / width).cast("long")


def grid_bounds(cell: Column, n: int) -> tuple[Column, Column, Column]:
    """(x0, y0, ds) of a grid cell."""
    width = 1.0 / n
    i = F.pmod(cell, F.lit(n))
    return i * F.lit(width), ((cell - i) / F.lit(n)).cast("long") * F.lit(width), F.lit(width)


def quad_digit(x: Column, y: Column, level: int) -> Column:
    """Quadrant at a level, counted from 1: 0 NW, 1 NE, 2 SW, 3 SE, half-open."""
    scale = float(2**level)
    return (2 * (1 - F.floor(y * scale) % 2) + F.floor(x * scale) % 2).cast("string")


def quad_address(x: Column, y: Column, depth: int = MAX_DEPTH) -> Column:
    """The quadrants of a point from the root down, one character each."""
    return F.concat(*[quad_digit(x, y, level) for level in range(1, depth + 1)]) if depth else F.lit("")


def quad_bounds(address: Column, depth: int = MAX_DEPTH) -> tuple[Column, Column, Column]:
    """(x0, y0, ds) of a quadtree cell of at most ``depth`` levels."""
    digits = [F.substring(address, level, 1) for level in range(1, depth + 1)]
    x0 = reduce(lambda a, p: a + F.when(p[1].isin("1", "3"), 0.5 ** (p[0] + 1)).otherwise(0.0), enumerate(digits), F.lit(0.0))
    y0 = reduce(lambda a, p: a + F.when(p[1].isin("0", "1"), 0.5 ** (p[0] + 1)).otherwise(0.0), enumerate(digits), F.lit(0.0))
    return x0, y0, F.pow(F.lit(0.5), F.length(address))
