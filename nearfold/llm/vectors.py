"""Embedding near-dedup by an epsilon grid order join.

Valid vectors are merged where equal and scaled to unit length, so cosine >= c is distance <= sqrt(2 - 2 c) = epsilon.
They are rotated to principal axes, put on a grid of width epsilon over the leading ``AXES`` of them, and sorted by length, then by
grid cells in lexicographic order. Intervals of that sequence are blocks; two blocks meet in a task if their
boxes (leading axes, and the length of what is left) are no more than epsilon apart. There the two sequences are joined recursively: halves whose boxes
are provably farther apart are skipped, small ones are compared exactly. A task returns each vector's number of links and a spanning forest, never the pairs of a group.

The axes are fitted on a bounded sample (``FIT_ROWS`` vectors, their first ``FIT_WIDTH`` components); any orthonormal axes give the same links, so the sample
decides the speed only. A block has as many rows as ``BLOCK_BYTES`` holds, but the sequence has ``FEWEST`` blocks or more, so a vector travels to ``FEWEST`` tasks at least and, where
boxes rule nothing out, to all blocks.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do rows with a null
vec_id (their component is null); vectors of different length never link; equal rows are links of one another; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import connected_components, keep, local_forest, running_totals

LEAF, AXES, FIT_ROWS, FIT_WIDTH = 192, 8, 20_000, 512
BLOCK_BYTES, FEWEST, LEAST_ROWS = 64 << 20, 6, 1024


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, safe for very large and small components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the lists of each length."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    lengths, flat = np.diff(offsets), np.asarray(column.values, dtype=np.float64)
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        yield places, units(flat[offsets[places][:, None] + np.arange(length)])


def on_axes(column: pa.Array, rotation: np.ndarray) -> np.ndarray:
    """Coordinates of the lists' unit vectors on the axes, and last the length of what is left of each."""
    out = np.zeros((len(column), rotation.shape[1] + 1))
    for places, x in by_length(column):
        width = min(x.shape[1], len(rotation))
        at = x[:, :width] @ rotation[:width]
        out[places, :-1] = at
        out[places, -1] = np.sqrt(np.maximum(0, 1 - (at * at).sum(axis=1)))
    return out


def principal_axes(classes: DataFrame, width: int, rows: int) -> np.ndarray:
    """width x AXES orthonormal columns, fitted on about FIT_ROWS of the ``rows`` classes (cid, v)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                head = x[:, :width]
                total[: head.shape[1], : head.shape[1]] += head.T @ head
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    part = -(-rows // FIT_ROWS)
    drawn = classes.where(F.pmod(F.xxhash64("cid"), F.lit(max(1, part))) == 0).select("v")
    found = drawn.coalesce(1).mapInArrow(each, "m array<double>").first()  # FIT_ROWS at most, or thereabouts
    moments = np.array(found["m"]).reshape(width, width)
    return np.linalg.eigh(moments)[1][:, ::-1][:, :AXES].copy()


class Join:
    """The recursive join of two sorted sequences of unit vectors."""

    def __init__(self, cosine: float, epsilon: float):
        self.cosine, self.epsilon = cosine, epsilon
        self.us: list[np.ndarray] = []
        self.vs: list[np.ndarray] = []
        self.held = 0

    def run(self, a: dict, b: dict | None) -> None:
        """b is None: a with itself. Each side: x (unit rows), at (axis coordinates), ids, weights, links (counted here)."""
        work = [(0, len(a["ids"]), 0, len((b or a)["ids"]))]
        other = b or a
        while work:
            s, t, p, q = work.pop()
            if b is None and p < s:
                continue
            low, high = a["at"][s:t].min(axis=0), a["at"][s:t].max(axis=0)
            low2, high2 = other["at"][p:q].min(axis=0), other["at"][p:q].max(axis=0)
            gap = np.maximum(0, np.maximum(low - high2, low2 - high))
            if math.sqrt(float(gap @ gap)) > self.epsilon + 1e-9:
                continue
            if t - s <= LEAF and q - p <= LEAF:
                self.compare(a, s, t, other, p, q, b is None and s == p)
                continue
            mine = [(s, (s + t) // 2), ((s + t) // 2, t)] if t - s > LEAF else [(s, t)]
            theirs = [(p, (p + q) // 2), ((p + q) // 2, q)] if q - p > LEAF else [(p, q)]
            work += [(*m, *h) for m in mine for h in theirs]

    def compare(self, a: dict, s: int, t: int, b: dict, p: int, q: int, own: bool) -> None:
        near = a["x"][s:t] @ b["x"][p:q].T >= self.cosine
        if own:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        a["links"][s:t] += near @ b["weights"][p:q]
        if not own:
            b["links"][p:q] += near.T @ a["weights"][s:t]
        x, y = np.nonzero(near)
        self.us.append(a["ids"][s + x])
        self.vs.append(b["ids"][p + y])
        self.held += len(x)
        if self.held > 1_000_000:
            u, v = local_forest(np.concatenate(self.us), np.concatenate(self.vs))
            self.us, self.vs, self.held = [u], [v], len(u)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.us:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return local_forest(np.concatenate(self.us), np.concatenate(self.vs))


def near_classes(classes: DataFrame, cosine: float, block_rows: int | None = None) -> DataFrame:
    """(cid, links, root) partial results of the join over classes (cid long, n long, v array of float or double)."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    usual = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()  # the most frequent length
    rows = classes.count()
    width = min(FIT_WIDTH, usual["d"]) if usual else 1
    rotation = principal_axes(classes, width, rows)
    axes = rotation.shape[1]
    if block_rows is None:
        block_rows = max(LEAST_ROWS, min(BLOCK_BYTES // (8 * (usual["d"] if usual else 1)), -(-rows // FEWEST)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = on_axes(batch.column(2), rotation)
            cells = np.floor(at[:, :-1] / epsilon).astype(np.int32) if epsilon else at[:, :-1].astype(np.int32)
            more = [pa.array(list(cells), pa.list_(pa.int32())), pa.array(list(at), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["cid", "n", "v", "cell", "at"])

    kind = classes.schema["v"].dataType.simpleString()
    placed = classes.select("cid", "n", "v").mapInArrow(place, f"cid long, n long, v {kind}, cell array<int>, at array<double>").withColumn("d", F.size("v"))
    blocks = running_totals(placed, None, [F.col("d"), F.col("cell"), F.col("cid")], F.lit(1), "row").withColumn("block", F.floor(F.col("row_before") / block_rows))
    sides = [F.struct(F.min(F.col("at")[k]).alias("low"), F.max(F.col("at")[k]).alias("high")) for k in range(axes + 1)]
    boxes = keep(
        blocks.groupBy("block").agg(F.array(*sides).alias("box"), F.min(F.col("cell")[0]).alias("first"), F.max(F.col("cell")[0]).alias("last"), F.min("d").alias("short"), F.max("d").alias("long"))
    )
    # Blocks that come near each other share a cell of the first axis, or have neighbouring ones: an equi-join on that cell.
    mine = boxes.select(F.col("block").alias("a"), F.col("box").alias("box_a"), "short", "long", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("on"))
    theirs = boxes.select(F.col("block").alias("b"), F.col("box").alias("box_b"), F.col("short").alias("short_b"), F.col("long").alias("long_b"), F.explode(F.sequence("first", "last")).alias("on"))
    gap = F.expr("aggregate(zip_with(box_a, box_b, (x, y) -> greatest(0D, x.low - y.high, y.low - x.high)), 0D, (s, g) -> s + g * g)")
    meet = mine.join(theirs, "on").where("a <= b and short <= long_b and short_b <= long")
    pairs = keep(meet.where(F.sqrt(gap) <= epsilon + 1e-9).select("a", "b").distinct())
    ends = pairs.select(F.col("a").alias("block"), "a", "b", F.lit(False).alias("second")).unionByName(
        pairs.where("a <> b").select(F.col("b").alias("block"), "a", "b", F.lit(True).alias("second"))
    )
    dealt = blocks.select("block", "row_before", "cid", "n", "v").join(ends, "block").select("a", "b", "second", "row_before", "cid", "n", "v")

    def match(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("row_before")
        second = np.asarray(table.column("second"))
        own = table.column("a")[0] == table.column("b")[0]
        halves: list[dict[int, dict]] = []
        for which in (False, True):
            part = table.filter(pa.array(second == which)).combine_chunks()
            column = part.column("v").combine_chunks() if part.num_rows else pa.array([], part.schema.field("v").type)
            ids, weights = np.asarray(part.column("cid")), np.asarray(part.column("n"))
            halves.append({x.shape[1]: {"x": x, "at": on_axes(column.take(pa.array(places)), rotation), "ids": ids[places], "weights": weights[places], "links": np.zeros(len(places), np.int64)} for places, x in by_length(column)})
        join = Join(cosine, epsilon)
        for length, side in halves[0].items():
            if own:
                join.run(side, None)
            elif length in halves[1]:
                join.run(side, halves[1][length])
        u, v = join.forest()
        every = [side for half in halves for side in half.values()]
        ids, links = np.concatenate([s["ids"] for s in every]), np.concatenate([s["links"] for s in every])
        ids, links = ids[links > 0], links[links > 0]
        roots = dict(zip(u.tolist(), v.tolist()))
        return pa.table({"cid": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array([roots.get(i, i) for i in ids.tolist()], pa.int64())})

    return dealt.groupBy("a", "b").applyInArrow(match, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, block_rows: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(valid, F.col("v")))
    classes = keep(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()))
    found = keep(near_classes(classes, cosine, block_rows))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    forest = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    rooted = classes.join(forest.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").join(counts, "cid", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = rows.join(named, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
  WHERE list_dot_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9::DOUBLE),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.reach = l.x),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT embeddings.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.component_id = embeddings.vec_id AS kept
FROM embeddings JOIN c ON embeddings.vec_id = c.vec_id LEFT JOIN n ON n.x = embeddings.vec_id
"""

QUERIES = {"op9_embeddings": op9_embeddings}
ORACLES = {"op9_embeddings": ORACLE}
