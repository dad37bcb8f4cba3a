"""Side tables whose size is known: brought to the driver once if small, joined without a shuffle if they may be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A counted table is broadcast, or held on the driver, up to so many rows (some tens of MB); beyond it, it stays in the cluster and joins shuffle.
BROADCAST_ROWS = 500_000
#: Values that a predicate lists; beyond it they are joined.
LISTED = 1000


def rows_of(frame: DataFrame) -> int:
    """The number of rows, counted once for a frame."""
    if not hasattr(frame, "_nearfold_rows"):
        frame._nearfold_rows = frame.count()
    return frame._nearfold_rows


def local(frame: DataFrame, most: int | None = None) -> DataFrame:
    """The same rows, without a plan below them: on the driver if their count allows it, else cached in the cluster. most: a bound of the count, if one is known."""
    if hasattr(frame, "_nearfold_local"):
        return frame
    held, rows = frame, most
    if most is None or most > BROADCAST_ROWS:
        held = frame.cache()
        rows = held.count()
    out = held
    if rows <= BROADCAST_ROWS:
        table = held.toArrow()
        rows, out = table.num_rows, frame.sparkSession.createDataFrame(table, frame.schema)
        out._nearfold_table = table
        if held is not frame or most is None:
            held.unpersist()
    out._nearfold_rows, out._nearfold_local = rows, rows <= BROADCAST_ROWS
    return out


def held(frame: DataFrame) -> bool:
    """The rows are on the driver."""
    return getattr(frame, "_nearfold_local", False)


def release(*frames: DataFrame | None) -> None:
    """Free what ``local`` cached in the cluster."""
    for frame in frames:
        if frame is not None and not getattr(frame, "_nearfold_local", True):
            frame.unpersist()


def small(side: DataFrame) -> DataFrame:
    """Mark for broadcast if the counted size allows it."""
    return F.broadcast(side) if rows_of(side) <= BROADCAST_ROWS else side


def listed(frame: DataFrame) -> list | None:
    """The rows, if there are few."""
    if not hasattr(frame, "_nearfold_list"):
        frame._nearfold_list = frame.collect() if rows_of(frame) <= LISTED else None
    return frame._nearfold_list
