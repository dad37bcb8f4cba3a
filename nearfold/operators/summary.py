"""Summaries of the query set: bounding rectangle, mean, geometric median."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.geometry import distance
from nearfold.operators.queryset import CARRIED, QuerySet, load
from nearfold.sources.points import SUMMARY


def bounding_box(query: DataFrame) -> DataFrame:
    return query.agg(F.min("qx").alias("xmin"), F.max("qx").alias("xmax"), F.min("qy").alias("ymin"), F.max("qy").alias("ymax"))


def mean_point(query: DataFrame) -> DataFrame:
    return query.agg(F.avg("qx").alias("xm"), F.avg("qy").alias("ym"))


def median_query_point(query: DataFrame) -> DataFrame:
    """The query point in the middle of the order by x (the upper one of two); ties by id."""
    return query.orderBy("qx", "qid").offset(query.count() // 2).limit(1).select("qid", "qx", "qy")


def _pull(query: QuerySet, x: float, y: float) -> tuple[float, float, float]:
    """At (x, y): the gradient of the sum of distances, where a query point at distance 0 adds nothing, and the sum."""
    if query.one is not None:
        dx, dy = x - query.one.x, y - query.one.y
        d = np.sqrt(dx * dx + dy * dy)
        each = query.one.w / np.where(d > 0, d, np.inf)
        return float(dx @ each), float(dy @ each), float(d @ query.one.w)
    d = distance(F.col("qx"), F.col("qy"), x, y)
    part = F.when(d > 0, d)
    row = query.frame.agg(F.sum((F.lit(x) - F.col("qx")) / part), F.sum((F.lit(y) - F.col("qy")) / part), F.sum(d)).first()
    return tuple(v or 0.0 for v in row)


def _box(query: QuerySet) -> tuple[float, ...]:
    """xmin, xmax, ymin, ymax and the mean."""
    if query.one is not None:
        x, y, w = query.one.x, query.one.y, query.one.w
        return tuple(float(v) for v in (x.min(), x.max(), y.min(), y.max(), x @ w / w.sum(), y @ w / w.sum()))
    return tuple(query.frame.agg(F.min("qx"), F.max("qx"), F.min("qy"), F.max("qy"), F.avg("qx"), F.avg("qy")).first())


def describe(query: DataFrame | QuerySet, step: float = 1e-6, min_dist: float = 10.0, limit: int = 100, diff: float = 1e-6) -> Summary | None:
    """The query set's summary with the geometric median by descent from the mean; None if it is empty.

    Each round moves against the gradient by ``step``; it goes on while the sum of distances exceeds ``min_dist``, fewer than ``limit`` rounds
    are done and the move was longer than ``diff``. A query point that the centre falls on adds nothing to the gradient. A set that
    one array holds is summed there; a larger one by an aggregation for each round.
    """
    held = load(query)
    if not held.n:
        return None
    xmin, xmax, ymin, ymax, x, y = _box(held)
    gx, gy, _ = _pull(held, x, y)
    for done in range(1, max(1, limit) + 1):
        moved = (x - step * gx, y - step * gy)
        far = math.hypot(moved[0] - x, moved[1] - y)
        x, y = moved
        gx, gy, total = _pull(held, x, y)
        if not (total > min_dist and done < limit and far > diff):
            break
    return Summary(xmin, xmax, ymin, ymax, x, y, total, held.n)


def geometric_median(query: DataFrame, **options) -> DataFrame:
    """One row: xmin, xmax, ymin, ymax, xc, yc, sum_dist_cq; none for an empty set."""
    found = describe(query, **options)
    row = [] if found is None else [tuple(getattr(found, f.name) for f in SUMMARY.fields)]
    return query.sparkSession.createDataFrame(row, SUMMARY)


@dataclass(frozen=True)
class Summary:
    """The one row of ``geometric_median`` and the number of query points."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float
    xc: float
    yc: float
    sum_dist_cq: float
    n: int


def summarize(query: DataFrame | QuerySet, **options) -> Summary:
    found = describe(query, **options)
    if found is None:
        raise ValueError("the query set is empty")
    held = load(query)
    if held.n > CARRIED:  # the gradient of a large set makes fixed steps overshoot; any centre is valid, and a near one finds better seeds
        *_, x, y = _box(held)
        total = _pull(held, x, y)[2]
        if total < found.sum_dist_cq:
            found = replace(found, xc=x, yc=y, sum_dist_cq=total)
    return found


def stored(row: DataFrame, n: int) -> Summary:
    """A summary that was written before, for a query set of n points."""
    found = row.select(*[f.name for f in SUMMARY.fields]).first()
    if found is None or not n:
        raise ValueError("the query set is empty")
    return Summary(**found.asDict(), n=n)
