"""Seed cells: grow a region in rounds until the cells it touches hold enough points.

Every region only grows, so each cell has one round in which it is first touched. Counts are summed by round, the running
total gives the last round that is needed, and the seeds are the cells touched by then. If even all rounds aren't enough, all cells are seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.functions.geometry import mindist_point_rect
from nearfold.operators.summary import Summary

#: Growth of the box in each round, and the most rounds that it is followed for.
SHRINK, GROW, MOST_ROUNDS = 0.9, 1.1, 400


def box_ladder(summary: Summary, narrowest: float) -> list[tuple[float, float, float, float]]:
    """(xmin, xmax, ymin, ymax) by round, until no cell as wide as ``narrowest`` can be touched anew."""
    box = (summary.xmin, summary.xmax, summary.ymin, summary.ymax)
    ladder = [box]
    while len(ladder) < MOST_ROUNDS:
        xmin, xmax, ymin, ymax = box
        grown = (SHRINK * xmin, GROW * xmax if GROW * xmax <= 1.0 else xmax, SHRINK * ymin, GROW * ymax if GROW * ymax <= 1.0 else ymax)
        if grown[1] == xmax and grown[3] == ymax and xmin <= narrowest and ymin <= narrowest:
            break
        box = grown
        ladder.append(box)
    return ladder


def _rounds_until(column: Column, bounds: list[float], upper: bool) -> Column:
    """The first round whose bound reaches the column; bounds are monotone, so that is the number of rounds that don't."""
    values = F.array(*[F.lit(b) for b in bounds])
    missed = F.size(F.filter(values, (lambda b: b < column) if upper else (lambda b: b > column)))
    return F.when(missed < len(bounds), missed)


def box_rounds(cells: DataFrame, summary: Summary) -> DataFrame:
    """cells with the round m in which the growing box first touches them; null: never. Closed rectangles."""
    narrowest = cells.agg(F.min("ds")).first()[0] or 1.0
    ladder = box_ladder(summary, narrowest)
    sides = [
        _rounds_until(F.col("x0") + F.col("ds"), [b[0] for b in ladder], False), _rounds_until(F.col("x0"), [b[1] for b in ladder], True),
        _rounds_until(F.col("y0") + F.col("ds"), [b[2] for b in ladder], False), _rounds_until(F.col("y0"), [b[3] for b in ladder], True),
    ]
    known = sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull() & sides[3].isNotNull()
    return cells.withColumn("m", F.when(known, F.greatest(*sides)).cast("long"))


def disk_rounds(cells: DataFrame, summary: Summary, home: Column, width: Column, closed: bool) -> DataFrame:
    """cells with the round m in which a disk around the centre first meets them; -1 for the centre's own cell.

    The radius begins at half the width and grows by a quarter of it. closed: the rim counts.
    """
    gap = mindist_point_rect(summary.xc, summary.yc, F.col("x0"), F.col("y0"), F.col("x0") + F.col("ds"), F.col("y0") + F.col("ds"))
    first, step = width * 0.5, width * 0.25
    if closed:
        m = F.greatest(F.lit(0), F.ceil((gap - first) / step))
    else:
        m = F.greatest(F.lit(0), F.floor((gap - first) / step) + 1)
    return cells.withColumn("m", F.when(home, F.lit(-1)).otherwise(m).cast("long"))


def cut(rounds: DataFrame, k: int, at_least: bool) -> DataFrame:
    """The cells touched up to the first round whose running total is >= k (at_least) or > k."""
    total = 0
    for row in sorted(rounds.where("m is not null").groupBy("m").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["m"]):  # one row for each round
        total += row["n"]
        if total >= k if at_least else total > k:
            return rounds.where(F.col("m") <= row["m"])
    return rounds


def box_seeds(cells: DataFrame, summary: Summary, k: int) -> DataFrame:
    """Seeds by the growing bounding box, for either partitioning: more than k points."""
    return cut(box_rounds(cells, summary), k, at_least=False)


def disk_seeds_grid(cells: DataFrame, summary: Summary, k: int, n: int) -> DataFrame:
    """Seeds by a growing open disk over a grid: at least k points."""
    width = 1.0 / n
    home = F.col("cell") == int(summary.yc / width) * n + int(summary.xc / width)
    return cut(disk_rounds(cells, summary, home, F.lit(width), closed=False), k, at_least=True)


def disk_seeds_tree(cells: DataFrame, leaves: DataFrame, summary: Summary, k: int) -> DataFrame:
    """Seeds by a growing closed disk over quadtree leaves: more than k points. leaves: every leaf with its bounds."""
    inside = (F.col("x0") <= summary.xc) & (summary.xc < F.col("x0") + F.col("ds")) & (F.col("y0") <= summary.yc) & (summary.yc < F.col("y0") + F.col("ds"))
    row = leaves.where(inside).select("cell", "ds").first()
    name, width = (row["cell"], row["ds"]) if row else ("", 1.0)
    return cut(disk_rounds(cells, summary, F.col("cell") == name, F.lit(width), closed=True), k, at_least=False)
