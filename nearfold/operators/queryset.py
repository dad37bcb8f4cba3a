"""The query set as arrays: read once, then used by every task without joins.

Up to ``CHUNK`` points it is one array. A larger set is aggregated to different places with their multiplicity and dealt into chunks by
place, and sums over chunks are added up, so it may be as large as a machine's memory (24 bytes for each different place).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of an array; those that a task's function carries itself instead of a broadcast; distances held at a time.
CHUNK, CARRIED, TILE = 2_000_000, 4096, 1 << 17
#: Cells on a side of the grids that condense a chunk of more than ``CARRIED`` points; slack for the rounding of their centres and sums.
SIDES, ROUNDING = (1, 4, 16, 64), 1e-9


class Chunk:
    """Points of the query set with their weights, in order of x. coarse: a larger one by cells of ever finer grids, each cell with its centre of gravity and its weight."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        order = np.argsort(x, kind="stable")
        self.x, self.y, self.w = x[order], y[order], w[order]
        self.coarse = [self._condensed(side) for side in SIDES] if len(x) > CARRIED else []

    def _condensed(self, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = np.zeros(len(self.x), np.int64)
        for v in (self.x, self.y):
            width = (v.max() - v.min()) / side or 1.0
            cell = cell * side + np.minimum((v - v.min()) / width, side - 1).astype(np.int64)
        weight = np.bincount(cell, self.w)
        full = weight > 0
        return tuple((np.bincount(cell, self.w * v)[full] / weight[full]) for v in (self.x, self.y)) + (weight[full],)

    def prefix(self) -> tuple[np.ndarray, np.ndarray]:
        """Running totals of weight and of weighted x, from 0."""
        return np.append(0.0, np.cumsum(self.w)), np.append(0.0, np.cumsum(self.w * self.x))


@dataclass
class QuerySet:
    """frame: the points (qid, qx, qy) as given; n: how many; chunks: each one a Chunk, or a broadcast of one."""

    frame: DataFrame
    n: int
    chunks: list

    @property
    def one(self) -> Chunk | None:
        """The whole set, if one array holds it."""
        return self.arrays()[0] if len(self.chunks) == 1 else None

    def arrays(self) -> list[Chunk]:
        return [c if isinstance(c, Chunk) else c.value for c in self.chunks]

    def reader(self):
        """What a task calls to get the chunks; small enough to be sent with its function."""
        chunks = self.chunks
        return lambda: [c if isinstance(c, Chunk) else c.value for c in chunks]


def _chunk(table: pa.Table) -> Chunk:
    return Chunk(*(table.column(k).to_numpy().astype(np.float64) for k in range(3)))


def load(query: DataFrame | QuerySet, chunk: int = CHUNK) -> QuerySet:
    """Read a query set. Points with a null coordinate are left out."""
    if isinstance(query, QuerySet):
        return query
    known = query.where("qx is not null and qy is not null").select("qx", "qy", F.lit(1.0).alias("w"))
    few = known.limit(CARRIED + 1).toArrow()
    if few.num_rows <= min(CARRIED, chunk):
        return QuerySet(query, few.num_rows, [_chunk(few)])
    known = known.cache()
    n = known.count()
    parts = max(1, -(-n // chunk))
    if parts == 1:
        frames = [known]
    else:
        places = known.groupBy("qx", "qy").agg(F.count("*").cast("double").alias("w")).cache()
        frames = [places.where(F.pmod(F.xxhash64("qx", "qy"), F.lit(parts)) == k) for k in range(parts)]
    chunks: list = []
    for frame in frames:
        held = _chunk(frame.toArrow())  # about ``chunk`` rows
        chunks.append(held if len(held.x) <= CARRIED else query.sparkSession.sparkContext.broadcast(held))
    if parts > 1:
        places.unpersist()
    known.unpersist()
    return QuerySet(query, n, chunks)


def sums(x: np.ndarray, y: np.ndarray, chunks: list[Chunk], bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums of distances) of the points whose sum doesn't exceed the bound; others are given up as soon as a part of theirs does."""
    places, total = np.arange(len(x)), np.zeros(len(x))
    for chunk in chunks:
        step = len(chunk.x) if np.isinf(bound) else 64
        step = max(1, min(step, TILE))
        for low in range(0, len(chunk.x), step):
            qx, qy, w = chunk.x[low : low + step], chunk.y[low : low + step], chunk.w[low : low + step]
            rows = max(1, TILE // len(qx))
            for s in range(0, len(places), rows):
                dx, dy = x[places[s : s + rows], None] - qx, y[places[s : s + rows], None] - qy
                total[s : s + rows] += np.sqrt(dx * dx + dy * dy) @ w
            if not np.isinf(bound):
                near = total <= bound
                places, total = places[near], total[near]
    return places, total


def _each(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of distances, each added up in the same order wherever its point stands, so that points of one place tie."""
    total = np.zeros(len(x))
    for low in range(0, len(qx), TILE):
        a, b, c = qx[low : low + TILE], qy[low : low + TILE], w[low : low + TILE]
        rows = max(1, TILE // len(a))
        for s in range(0, len(x), rows):
            dx, dy = x[s : s + rows, None] - a, y[s : s + rows, None] - b
            total[s : s + rows] += (np.sqrt(dx * dx + dy * dy) * c).sum(axis=1)
    return total


def exact(x: np.ndarray, y: np.ndarray, chunks: list[Chunk]) -> np.ndarray:
    """The sums of distances; points of one place are summed once, and tie."""
    place, back = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
    return sum((_each(place[:, 0], place[:, 1], c.x, c.y, c.w) for c in chunks), np.zeros(len(place)))[back.reshape(-1)]


def able(x: np.ndarray, y: np.ndarray, chunks: list[Chunk], bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, lower bounds), least first, of all points whose sum may be within the bound; without a bound, of all points.

    Distance is convex, so a cell's weight times the distance to its centre of gravity never exceeds the sum of the distances to its points.
    """
    places, low = np.arange(len(x)), np.zeros(len(x))
    for level in range(len(SIDES) - np.isinf(bound)):  # the finest grid pays for few points only
        low = np.zeros(len(places))
        for chunk in chunks:
            low += _each(x[places], y[places], *(chunk.coarse[level] if chunk.coarse else (chunk.x, chunk.y, chunk.w)))
        low *= 1 - ROUNDING
        near = low <= bound
        places, low = places[near], low[near]
    order = np.argsort(low, kind="stable")
    return places[order], low[order]


def sums_dx(x: np.ndarray, chunks: list[Chunk]) -> np.ndarray:
    """Sums of |qx - x| in closed form: with r the weight at or below x and p that part's sum, x (2 r - n) + all - 2 p."""
    total = np.zeros(len(x))
    for chunk in chunks:
        weight, along = chunk.prefix()
        at = np.searchsorted(chunk.x, x, side="right")
        total += x * (2 * weight[at] - weight[-1]) + along[-1] - 2 * along[at]
    return total
