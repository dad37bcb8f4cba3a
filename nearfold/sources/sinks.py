"""Output: neighbours, cells, summaries and trees, as text or parquet, and prepartitioned points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators import grid, quadtree

SUMMARY_FIELDS = ("xmin", "xmax", "ymin", "ymax", "xc", "yc", "sum_dist_cq")


def neighbor_lines(neighbors: DataFrame) -> DataFrame:
    """value string: "id<TAB>distance", ten decimals, nearest first."""
    return neighbors.orderBy("dist", "id").select(F.format_string("%d\t%.10f", "id", "dist").alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    """One text file for a small result; its lines are data, never format strings."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_neighbors(neighbors: DataFrame, path: str) -> None:
    write_text(neighbor_lines(neighbors), path)


def write_cells(cells: DataFrame, path: str) -> None:
    write_text(cells.select(F.col("cell").cast("string").alias("value")).orderBy("value"), path)


def summary_lines(summary: DataFrame) -> DataFrame:
    return summary.select(F.format_string("\t".join(["%.10f"] * len(SUMMARY_FIELDS)), *SUMMARY_FIELDS).alias("value"))


def write_summary(summary: DataFrame, path: str, text: bool = False) -> None:
    """Parquet keeps full precision; text has ten decimals."""
    write_text(summary_lines(summary), path) if text else summary.write.mode("overwrite").parquet(path)


def write_leaves(leaves: DataFrame, path: str) -> None:
    leaves.write.mode("overwrite").parquet(path)


def write_shape(leaves: DataFrame, path: str) -> None:
    write_text(quadtree.shape(leaves).select(F.col("shape").alias("value")), path)


def sorted_lines(lines: DataFrame) -> DataFrame:
    """Lines of text in byte order."""
    return lines.select("value").orderBy("value")


def write_prepartitioned(points: DataFrame, path: str, n: int | None = None, tree: DataFrame | None = None) -> None:
    """Points with their cell, clustered by it, so that a filter on cells or coordinates skips row groups. tree: the split nodes of a quadtree."""
    placed = grid.assign(points, n) if n else quadtree.assign(points, tree)
    placed.repartitionByRange("cell").sortWithinPartitions("cell", "x").write.mode("overwrite").parquet(path)


def write_run(run, path: str) -> None:
    """The lists and cells of a finished run: neighbours among the seeds, the answer, the seed cells."""
    write_neighbors(run.frames["first"], f"{path}/neighbors_first")
    write_neighbors(run.frames["answer"], f"{path}/neighbors")
    write_cells(run.frames["seeds"], f"{path}/seeds")
