"""Plumbing shared by the corpus operators: shared storage, distributed running totals, components.

Everything that must outlive an executor goes through ``keep`` (a reliable checkpoint in the folder
that ``spark.checkpoint.dir`` names) or through files in a ``new_folder`` there.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfold.sources.store import shared_dir

#: A side table is broadcast only up to this many rows; beyond it, it is joined by a shuffle.
BROADCAST_ROWS = 100_000


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a URI of Hadoop's, and the path there; ValueError for stores that pyarrow can't reach."""
    scheme, _, rest = uri.partition(":")
    if scheme == "dbfs":  # mounted on every machine
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    if scheme in ("wasb", "wasbs"):  # the same containers under the store's newer protocol
        uri = f"abfs{'s' if scheme == 'wasbs' else ''}:{rest.replace('.blob.', '.dfs.')}"
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as unknown:
        raise ValueError(f"token files can't be kept at {uri}; use a file, hdfs, s3a, gs, abfs or dbfs folder") from unknown


def keep(df: DataFrame) -> DataFrame:
    """Run ``df`` now and cut its lineage with a reliable checkpoint, so that lost executors cost no rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of rounds that are done: it does so when the driver collects the garbage that names them, which may else be late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def group_key(column: Column) -> Column:
    """A string that is never null and keeps null apart from every real value."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), text))


def small(side: DataFrame, most: int | None = None) -> DataFrame:
    """Mark ``side`` for broadcast if its counted size allows it (``most`` rows, else ``BROADCAST_ROWS``); otherwise leave the join to a shuffle."""
    return F.broadcast(side) if side.count() <= (BROADCAST_ROWS if most is None else most) else side


def release_memory() -> None:
    """Give back what earlier tasks of this worker have freed but its allocators still hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(batches: Iterator[pa.RecordBatch], sized: str, most_bytes: int = 4 << 20, most_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that column ``sized`` holds about ``most_bytes`` in each; a longer row stands alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(sized))
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        start, held = 0, 0
        for row, length in enumerate(lengths):
            if row > start and (held + length > most_bytes or row - start >= most_rows):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(length)
        if batch.num_rows > start:
            yield batch.slice(start)


def running_totals(df: DataFrame, group: Column | None, order: Sequence[Column], measure: Column, prefix: str) -> DataFrame:
    """Add ``{prefix}_before`` (sum of ``measure`` over the rows before this one in its group) and ``{prefix}_all``.

    The order is total over distinct rows, so the result does not depend on partition bounds. No group
    meets in one task: rows are range-partitioned by (group, order), summed within each partition, and
    the partitions' own totals (at most partitions + groups rows) are added up beside them.
    """
    names = df.columns
    keyed = df.withColumn("__g", F.lit("") if group is None else group).withColumn("__m", measure.cast("long"))
    ordering = [F.col("__g"), *order]
    placed = keyed.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(batch.schema.get_field_index("__g"))
            values = batch.column(batch.schema.get_field_index("__m")).to_numpy(zero_copy_only=False).astype(np.int64)
            fresh = np.ones(len(values), dtype=bool)
            fresh[1:] = np.asarray(pc.not_equal(groups[1:], groups[:-1]))
            starts = np.flatnonzero(fresh)
            before = np.cumsum(values) - values
            spans = np.diff(np.append(starts, len(values)))
            before -= np.repeat(before[starts], spans)
            if groups[0].as_py() == last:
                before[: spans[0]] += carried
            last, carried = groups[len(values) - 1].as_py(), int(before[-1] + values[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(before), pa.array(np.full(len(values), part, dtype=np.int32))],
                [*batch.schema.names, "__before", "__part"],
            )

    held = keep(placed.mapInArrow(local, f"{kinds}, __before long, __part int"))
    parts = held.groupBy("__g", "__part").agg(F.sum("__m").alias("__sum"))
    along = Window.partitionBy("__g").orderBy("__part")
    offsets = parts.select(
        F.col("__g"), F.col("__part"),
        (F.sum("__sum").over(along) - F.col("__sum")).alias("__offset"),
        F.sum("__sum").over(Window.partitionBy("__g")).alias("__all"),
    )
    return held.join(small(keep(offsets)), ["__g", "__part"]).select(
        *[F.col(f"`{n}`") for n in names],
        (F.col("__before") + F.col("__offset")).alias(f"{prefix}_before"),
        F.col("__all").alias(f"{prefix}_all"),
    )


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reduce links (a[i], b[i]) to (node, least node of its component), one row for each node that isn't least."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) links to (node, root) with root the least node reachable; nodes without links are absent.

    Alternating large-star and small-star steps: each is a map-side combined minimum and an equi-join, so a hub's
    links are split over tasks by adaptive skew joins. Every round is checkpointed; it ends when all links are stars.
    """
    links = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        free_shuffles(edges.sparkSession)
        loose = links.groupBy("u").count().where("count > 1").limit(1).count()
        if not loose and not links.join(links.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
        links = keep(large.join(least, "u").select(pairs.alias("p")).select("p.u", "p.v").where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
