"""Exact distances to the query set, top-k lists, and the plane-sweep bound.

A point's distances are summed where the point is read, in numpy over Arrow batches, with the query set as an array in each task. So points are
never shuffled: only per-id minima, or k rows of each partition, leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.operators.queryset import Chunk, QuerySet, able, exact, load, sums, sums_dx

#: Relative slack for the rounding of closed forms and of sums in another order.
SLACK = 1e-9
RAW = "id long, dist double, read long, swept long, summed long"


def _numbers(batch: pa.RecordBatch, *columns: int) -> list[np.ndarray]:
    return [np.asarray(batch.column(k), dtype=np.float64) for k in columns]


def sum_distances(points: DataFrame, query: DataFrame | QuerySet) -> DataFrame:
    """(id, dist) for each id: the sum of distances to the query set; of several points with one id the nearest counts."""
    chunks = load(query).reader()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = chunks()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums(*_numbers(batch, 1, 2), held)[1])], ["id", "dist"])

    return points.select("id", "x", "y").mapInArrow(each, "id long, dist double").groupBy("id").agg(F.min("dist").alias("dist"))


class Best:
    """The k nearest different ids so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.dist = k, np.empty(0, np.int64), np.empty(0)

    def add(self, ids: np.ndarray, dist: np.ndarray) -> None:
        ids, dist = np.concatenate([self.ids, ids]), np.concatenate([self.dist, dist])
        order = np.lexsort((dist, ids))
        ids, dist = ids[order], dist[order]
        first = np.append(True, ids[1:] != ids[:-1])[: len(ids)]
        ids, dist = ids[first], dist[first]
        order = np.lexsort((ids, dist))[: self.k]
        self.ids, self.dist = ids[order], dist[order]

    @property
    def bound(self) -> float:
        return self.dist[-1] if len(self.ids) == self.k else math.inf


def _likely_first(best: Best, ids: np.ndarray, x: np.ndarray, y: np.ndarray, chunks: list[Chunk], dm: float) -> int:
    """Add what is near enough to ``best``, in order of lower bounds and as long as these are within the bound that falls meanwhile. How many points were summed."""
    summed, first = 0, True
    while len(ids):
        bound = min(dm, best.bound) * (1 + SLACK)
        places, _ = able(x, y, chunks, bound)
        # Without a bound, or with the first one, a few likely points are summed to get a better one; then all that it leaves.
        if first and len(places) > best.k:
            places, left = places[: best.k], places[best.k :]
        else:
            left = places[:0]
        best.add(ids[places], exact(x[places], y[places], chunks))
        summed += len(places)
        ids, x, y, first = ids[left], x[left], y[left], math.isinf(best.bound)
    return summed


def nearest(points: DataFrame, query: DataFrame | QuerySet, k: int, dm: float = math.inf, by_sweep: bool = False, fast: bool = True) -> DataFrame:
    """Rows (id, dist, ...) that hold the k nearest points, k of each partition at most, and one with a null id for each partition that counts points:
    read, ruled out by the sweep bound, and summed to the end. Points farther than ``dm`` may be left out.

    by_sweep: the sum of x-distances alone rules points out first. fast: a sum is given up when it exceeds the bound.
    """
    chunks = load(query).reader()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, read, swept, summed = chunks(), Best(k), 0, 0, 0
        for batch in batches:
            ids, (x, y) = np.asarray(batch.column(0)), _numbers(batch, 1, 2)
            bound = min(dm, best.bound) * (1 + SLACK)
            read += len(ids)
            if by_sweep:
                passed = sums_dx(x, held) * (1 - SLACK) <= bound
                swept += len(ids) - int(passed.sum())
                ids, x, y = ids[passed], x[passed], y[passed]
            if fast and any(c.coarse for c in held):
                summed += _likely_first(best, ids, x, y, held, dm)
                continue
            places, dist = sums(x, y, held, bound if fast else math.inf)
            summed += len(places)
            best.add(ids[places], dist)
        zeros, one = np.zeros(len(best.ids), np.int64), [read, swept, summed]
        ids = pa.array([*best.ids.tolist(), None], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.append(best.dist, 0.0)), *(pa.array(np.append(zeros, n)) for n in one)], ["id", "dist", "read", "swept", "summed"])

    return points.select("id", "x", "y").mapInArrow(each, RAW)


def by_id(raw: DataFrame) -> DataFrame:
    """The rows of ``nearest`` with each id once; counts are added up."""
    return raw.groupBy("id").agg(F.min("dist").alias("dist"), *[F.sum(c).alias(c) for c in ("read", "swept", "summed")])


def top_k(neighbors: DataFrame, k: int) -> DataFrame:
    """The k nearest by (dist, id): a bounded list for each partition, then one merge."""
    return neighbors.orderBy("dist", "id").limit(k)


def top_k_per_cell(placed: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(cell, id, dist, rank) with rank <= k in each cell; each partition keeps only k rows of a cell before the shuffle."""
    chunks = load(query).reader()
    kind = placed.schema["cell"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = chunks()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums(*_numbers(batch, 2, 3), held)[1])], ["cell", "id", "dist"])

    distances = placed.select("cell", "id", "x", "y").mapInArrow(each, f"cell {kind}, id long, dist double").groupBy("cell", "id").agg(F.min("dist").alias("dist"))
    ranked = distances.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("dist", "id")))
    return ranked.where(F.col("rank") <= k)


def merge(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Two lists as one: each id once, with its least distance."""
    return top_k(without_duplicates(first.unionByName(second)), k)


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of first whose id isn't in second."""
    return first.join(second.select("id").distinct(), "id", "left_anti")


def without_duplicates(neighbors: DataFrame) -> DataFrame:
    return neighbors.groupBy("id").agg(F.min("dist").alias("dist"))


def kth_distance(neighbors: DataFrame, k: int) -> float:
    """The largest distance of a list with k rows; infinity while it has fewer."""
    row = neighbors.agg(F.count("*").alias("n"), F.max("dist").alias("d")).first()
    return row["d"] if row["n"] >= k else math.inf


def sum_dx(points: DataFrame, query: DataFrame | QuerySet) -> DataFrame:
    """points with sumdx, the sum of |qx - x| over the query set, in closed form: a lower bound of the distance sum."""
    chunks = load(query).reader()
    place, names = points.columns.index("x"), [*points.columns, "sumdx"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = chunks()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums_dx(*_numbers(batch, place), held))], names)

    return points.mapInArrow(each, f"{kinds}, sumdx double")


def sweep(points: DataFrame, query: DataFrame | QuerySet, dm: float) -> DataFrame:
    """The points that the x-distances alone don't rule out."""
    return sum_dx(points, query).where(F.col("sumdx") * (1 - SLACK) < dm).drop("sumdx")


def order_by_x(points: DataFrame, descending: bool = False) -> DataFrame:
    return points.orderBy(F.col("x").desc() if descending else F.col("x").asc(), "id")


def order_by_y(points: DataFrame, descending: bool = False) -> DataFrame:
    return points.orderBy(F.col("y").desc() if descending else F.col("y").asc(), "id")
