"""Lower bounds that rule out cells and points.

With n query points, centre c, S the sum of their distances to c, and dm the distance of the k-th best answer so far, a
cell can hold no better answer if
  H1  n * mindist(cell, c) >= dm + S          (triangle inequality, for any c)
  H2  n * mindist(cell, bounding box) >= dm
  H3  sum over q of mindist(cell, q) >= dm
and a point t can't if  H4  n * distance(t, c) >= dm + S.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.functions.geometry import distance, mindist_point_rect, mindist_rect_rect
from nearfold.operators.queryset import ROUNDING, TILE, QuerySet, load
from nearfold.operators.summary import Summary


def _corners() -> tuple[Column, Column, Column, Column]:
    return F.col("x0"), F.col("y0"), F.col("x0") + F.col("ds"), F.col("y0") + F.col("ds")


def passes_h1(summary: Summary, dm: float) -> Column:
    return mindist_point_rect(summary.xc, summary.yc, *_corners()) * summary.n < dm + summary.sum_dist_cq


def passes_h2(summary: Summary, dm: float) -> Column:
    return mindist_rect_rect(*_corners(), summary.xmin, summary.ymin, summary.xmax, summary.ymax) * summary.n < dm


def passes_h4(summary: Summary, dm: float) -> Column:
    return distance(F.col("x"), F.col("y"), summary.xc, summary.yc) * summary.n < dm + summary.sum_dist_cq


def in_reach(summary: Summary, dm: float) -> Column:
    """What H2 says of a point's coordinates alone: plain ranges, which a scan can use to skip row groups."""
    reach = dm / summary.n
    return F.col("x").between(summary.xmin - reach, summary.xmax + reach) & F.col("y").between(summary.ymin - reach, summary.ymax + reach)


def sum_mindist(cells: DataFrame, query: DataFrame | QuerySet) -> DataFrame:
    """cells with bound: the sum over the query set of mindist(cell, q), summed where the cell is read.

    A condensed chunk is summed by the cells of its finest grid; as the distance to a rectangle is convex, that is a lower bound of its sum, and close to it.
    """
    chunks = load(query).reader()
    places = [cells.columns.index(c) for c in ("x0", "y0", "ds")]
    names = [*cells.columns, "bound"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = chunks()
        for batch in batches:
            x0, y0, ds = (np.asarray(batch.column(k), dtype=np.float64) for k in places)
            bound = np.zeros(batch.num_rows)
            for chunk in held:
                ax, ay, aw = chunk.coarse[-1] if chunk.coarse else (chunk.x, chunk.y, chunk.w)
                aw = aw * (1 - ROUNDING) if chunk.coarse else aw
                for low in range(0, len(ax), TILE):
                    qx, qy, w = ax[low : low + TILE], ay[low : low + TILE], aw[low : low + TILE]
                    rows = max(1, TILE // len(qx))
                    for s in range(0, len(x0), rows):
                        a, b, d = x0[s : s + rows, None], y0[s : s + rows, None], ds[s : s + rows, None]
                        dx, dy = np.maximum(np.maximum(a - qx, qx - a - d), 0), np.maximum(np.maximum(b - qy, qy - b - d), 0)
                        bound[s : s + rows] += np.sqrt(dx * dx + dy * dy) @ w
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], names)

    return cells.mapInArrow(each, f"{kinds}, bound double")


def h1(cells: DataFrame, summary: Summary, dm: float) -> DataFrame:
    return cells.where(passes_h1(summary, dm))


def h2(cells: DataFrame, summary: Summary, dm: float) -> DataFrame:
    return cells.where(passes_h2(summary, dm))


def h3(cells: DataFrame, query: DataFrame, dm: float) -> DataFrame:
    return sum_mindist(cells, query).where(F.col("bound") < dm).drop("bound")


def surviving_cells(cells: DataFrame, query: DataFrame, summary: Summary, dm: float, heuristics: bool = True) -> DataFrame:
    """The cells that may hold a better answer; all of them without heuristics."""
    return h3(h2(h1(cells, summary, dm), summary, dm), query, dm) if heuristics else cells


def cascade_counts(cells: DataFrame, query: DataFrame, summary: Summary, dm: float) -> DataFrame:
    """One row: how many cells each bound rules out (success) or lets pass (fail), one after the other."""
    judged = sum_mindist(cells, query).select(passes_h1(summary, dm).alias("p1"), passes_h2(summary, dm).alias("p2"), (F.col("bound") < dm).alias("p3"))
    p1, p2, p3 = F.col("p1"), F.col("p2"), F.col("p3")
    return judged.agg(
        F.count_if(~p1).alias("h1_success"), F.count_if(p1).alias("h1_fail"), F.count_if(p1 & ~p2).alias("h2_success"), F.count_if(p1 & p2).alias("h2_fail"),
        F.count_if(p1 & p2 & ~p3).alias("h3_success"), F.count_if(p1 & p2 & p3).alias("h3_fail"),
    )
