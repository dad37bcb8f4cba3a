"""Uniform grid partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.geometry import grid_bounds, grid_cell
from nearfold.sources.points import valid


def assign(points: DataFrame, n: int) -> DataFrame:
    """Points of the unit square with the long number of their cell in an n x n grid; others are left out."""
    if n < 1:
        raise ValueError("the grid needs at least one cell")
    return valid(points).withColumn("cell", grid_cell(F.col("x"), F.col("y"), n))


def with_bounds(cells: DataFrame, n: int) -> DataFrame:
    x0, y0, ds = grid_bounds(F.col("cell"), n)
    return cells.withColumn("x0", x0).withColumn("y0", y0).withColumn("ds", ds)


def histogram(points: DataFrame, n: int) -> DataFrame:
    """cell, x0, y0, ds, n for each cell that holds points; counts combine on the map side."""
    return with_bounds(assign(points, n).groupBy("cell").agg(F.count("*").alias("n")), n)
