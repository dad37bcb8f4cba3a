"""The group-nearest-neighbour query: the k points with the least sum of distances to all query points.

Every configuration gives the same rows, the exact k nearest by (dist, id); options change only the work done. A run has five steps, most of
them one job: the query set is read and summarised, points are counted by cell, the nearest points of seed cells give the distance dm of the k-th
candidate, bounds rule cells and points out, and what is left is summed where it is read. The query set, the cell counts and the lists of k
come to the driver if they are counted small (``operators.tables``, ``operators.queryset``); the points never do.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.operators import evaluate, grid, prune, quadtree, queryset, seeds
from nearfold.operators.summary import Summary, stored, summarize
from nearfold.operators.tables import LISTED, listed, local, release, rows_of, small
from nearfold.sources.points import NEIGHBOR, sample, valid

PARTITIONINGS, METHODS, SEEDS = ("gd", "qt"), ("bf", "ps"), ("mbr", "centroid")
COUNTS = ("read", "swept", "summed")


@dataclass
class Run:
    """What a run found. frames: cells, seeds, rest, survivors (cell, x0, y0, ds, n), first (neighbours among seeds), answer (id, dist);
    counts: of the points in seeds (first) and in survivors (second); millis: wall time of each step."""

    summary: Summary
    dm: float
    frames: dict[str, DataFrame]
    counts: dict[str, dict[str, int]]
    millis: dict[str, int]


@dataclass
class Query:
    """A configured query. n: cells on a side of the grid; capacity, sample_rate, kind, max_depth: of the quadtree.

    Stored results can be used again: about, a summary of the query set (one row, as ``geometric_median`` gives it); leaves, a quadtree's
    leaf table; prepartitioned: points that ``write_prepartitioned`` stored with their cell (for a quadtree, together with its leaves).
    """

    points: DataFrame
    query: DataFrame
    k: int
    partitioning: str = "gd"
    method: str = "bf"
    seed: str = "centroid"
    n: int = 50
    capacity: int = 500
    sample_rate: int = 100
    kind: str = "capacity"
    max_depth: int = quadtree.MAX_DEPTH
    heuristics: bool = True
    fast_sums: bool = True  # a sum is given up when it exceeds the bound; the answer doesn't depend on it
    step: float = 1e-6
    min_dist: float = 10.0
    limit: int = 100
    diff: float = 1e-6
    about: DataFrame | None = None
    leaves: DataFrame | None = None
    prepartitioned: bool = False
    done: Run | None = field(default=None, init=False, repr=False)

    def __post_init__(self) -> None:
        for name, value, known in (("partitioning", self.partitioning, PARTITIONINGS), ("method", self.method, METHODS), ("seed", self.seed.lower(), SEEDS)):
            if value not in known:
                raise ValueError(f"{name} is one of {known}")
        self.seed = self.seed.lower()
        if self.k < 1:
            raise ValueError("k must be at least 1")
        if not 1 <= self.sample_rate <= 100:
            raise ValueError("sample_rate is a percentage from 1 to 100")
        if self.prepartitioned and "cell" not in self.points.columns:
            raise ValueError("prepartitioned points have a column cell")
        if self.prepartitioned and self.partitioning == "qt" and self.leaves is None:
            raise ValueError("points that are partitioned by a quadtree need its leaves")
        self.points = valid(self.points.select("id", "x", "y", *(["cell"] if self.prepartitioned else [])))
        self._held: queryset.QuerySet | None = None

    @property
    def held(self) -> queryset.QuerySet:
        """The query set, read once."""
        if self._held is None:
            self._held = queryset.load(self.query)
        return self._held

    def summary(self) -> Summary:
        if self.about is not None:
            return stored(self.about, self.held.n)
        return summarize(self.held, step=self.step, min_dist=self.min_dist, limit=self.limit, diff=self.diff)

    def partition(self) -> tuple[DataFrame, DataFrame | None]:
        """The histogram of cells, and all leaves (quadtree only)."""
        if self.partitioning == "gd":
            if self.prepartitioned:
                return local(grid.with_bounds(self.points.groupBy("cell").agg(F.count("*").alias("n")), self.n)), None
            return local(grid.histogram(self.points, self.n), self.n**2), None
        depth = self.max_depth
        if self.leaves is not None:
            leaves = local(self.leaves.select("cell", "x0", "y0", "ds"))
            if self.prepartitioned:
                counted = self.points.groupBy("cell").agg(F.count("*").alias("n"))
            else:
                deepest = leaves.agg(F.max(F.length("cell"))).first()[0] or 0
                counted = quadtree.counts(quadtree.addresses(self.points, max(1, deepest)), quadtree.internal_of_leaves(leaves), max(1, deepest))
            return local(leaves.join(counted, "cell").select("cell", "x0", "y0", "ds", "n")), leaves
        counted = local(quadtree.addresses(self.points, depth), 4**depth)
        drawn = counted if self.sample_rate == 100 else local(quadtree.addresses(sample(self.points, self.sample_rate), depth), 4**depth)
        inner = quadtree.internal_of(drawn, self.capacity, self.kind, depth)
        most = 3 * rows_of(inner) + 1
        cells = local(quadtree.with_bounds(quadtree.counts(counted, inner, depth), depth), most)
        leaves = local(quadtree.with_bounds(quadtree.leaves_of(inner, depth), depth), most)
        release(counted, inner)
        return cells, leaves

    def seeds(self, cells: DataFrame, leaves: DataFrame | None, summary: Summary) -> DataFrame:
        if self.seed == "mbr":
            return seeds.box_seeds(cells, summary, self.k)
        if self.partitioning == "gd":
            return seeds.disk_seeds_grid(cells, summary, self.k, self.n)
        return seeds.disk_seeds_tree(cells, leaves, summary, self.k)

    def within(self, cells: DataFrame) -> DataFrame:
        """The points in these cells. A short list becomes a predicate, with the cells' common box as plain ranges that reach a scan; a longer one a semi-join."""
        points, rows = self.points, listed(cells)
        if rows is not None:
            if not rows:
                return points.where(F.lit(False))
            x0, x1, y0, y1 = min(r["x0"] for r in rows), max(r["x0"] + r["ds"] for r in rows), min(r["y0"] for r in rows), max(r["y0"] + r["ds"] for r in rows)
            slack = 1e-9  # a grid's borders are rounded
            points = points.where(F.col("x").between(x0 - slack, x1 + slack) & F.col("y").between(y0 - slack, y1 + slack))
        if self.partitioning == "qt" and not self.prepartitioned:
            return quadtree.within(points, cells)
        placed = points if self.prepartitioned else grid.assign(points, self.n)
        return placed.where(F.col("cell").isin([r["cell"] for r in rows])) if rows is not None else placed.join(small(cells.select("cell")), "cell", "left_semi")

    def nearest(self, points: DataFrame, dm: float) -> tuple[DataFrame, dict[str, int]]:
        """(id, dist) of the k nearest of these points, those farther than dm left out or not, and what was counted on the way.

        For a short list the k + 1 rows of each partition are merged on the driver, else in the cluster.
        """
        raw = evaluate.nearest(points, self.held, self.k, dm, self.method == "ps", self.fast_sums)
        if self.k <= LISTED:
            table = raw.toArrow()
            counts = {c: int(table.column(c).to_numpy().sum()) for c in COUNTS}
            return self.short_list(table.filter(pc.is_valid(table.column("id")))), counts
        found = local(evaluate.by_id(raw).orderBy(F.col("id").isNotNull(), "dist", "id").limit(self.k + 1))
        counts = found.where("id is null").select(*COUNTS).collect()  # one row, or none where there are no partitions
        return found.where("id is not null").select("id", "dist"), counts[0].asDict() if counts else dict.fromkeys(COUNTS, 0)

    def short_list(self, *tables: pa.Table) -> DataFrame:
        """The k nearest different ids of these tables."""
        best = evaluate.Best(self.k)
        for table in tables:
            best.add(table.column("id").to_numpy(), table.column("dist").to_numpy())
        table = pa.table({"id": pa.array(best.ids, pa.int64()), "dist": pa.array(best.dist, pa.float64())})
        found = self.points.sparkSession.createDataFrame(table, NEIGHBOR)
        found._nearfold_table = table
        return found

    def merged(self, first: DataFrame, second: DataFrame) -> DataFrame:
        if self.k <= LISTED:
            return self.short_list(first._nearfold_table, second._nearfold_table)
        return local(evaluate.merge(first, second, self.k))

    def kth(self, found: DataFrame) -> float:
        if self.k <= LISTED:
            dist = found._nearfold_table.column("dist").to_numpy()
            return float(dist[-1]) if len(dist) == self.k else math.inf
        return evaluate.kth_distance(found, self.k)

    def run(self) -> Run:
        """Run all steps once; later calls return the same results."""
        if self.done is not None:
            return self.done
        millis: dict[str, int] = {}
        began = time.monotonic()

        def lap(name: str) -> None:
            nonlocal began
            now = time.monotonic()
            millis[name], began = round(1000 * (now - began)), now

        summary = self.summary()
        lap("summary")
        cells, leaves = self.partition()
        lap("partition")
        every = rows_of(cells)
        seeded = local(self.seeds(cells, leaves, summary).select(*cells.columns), every)
        lap("seeds")
        first, first_counts = self.nearest(self.within(seeded), math.inf)
        dm = self.kth(first)
        # A point tied with the k-th can still win by its id, so bounds are compared with a slightly larger distance.
        dm = dm if math.isinf(dm) else math.nextafter(dm, math.inf) * (1 + 1e-12)
        lap("first")
        chosen = listed(seeded)
        rest = cells.join(small(seeded.select("cell")), "cell", "left_anti") if chosen is None else cells.where(~F.col("cell").isin([r["cell"] for r in chosen]))
        survivors = local(prune.surviving_cells(rest, self.held, summary, dm, self.heuristics), every)
        lap("pruning")
        others = self.within(survivors)
        if self.heuristics and not math.isinf(dm):
            others = others.where(prune.in_reach(summary, dm) & prune.passes_h4(summary, dm))
        second, second_counts = self.nearest(others, dm)
        answer = self.merged(first, second)
        lap("second")
        frames = {"cells": cells, "seeds": seeded, "rest": rest, "survivors": survivors, "first": first, "answer": answer}
        self.done = Run(summary, dm, frames, {"first": first_counts, "second": second_counts}, millis)
        return self.done

    def phases(self) -> dict[str, DataFrame]:
        return self.run().frames

    def answer(self) -> DataFrame:
        """(id, dist), at most k rows, nearest first."""
        return evaluate.top_k(self.phases()["answer"].select("id", "dist"), self.k)

    def metrics(self) -> DataFrame:
        """One row about the run: cells and points in all, in the seeds and in the survivors (num_cells); what each bound ruled out (zeros without heuristics); and of the points in
        survivors: dpc_count, ruled out by their distance to the centre or the box; sumdx, tested by the sweep bound, and sumdx_success, ruled out by it;
        sumdist, summed to the end; skipped_tpoints, given up while they were summed; and the milliseconds of each step."""
        run = self.run()

        def of(name: str) -> DataFrame:
            return run.frames[name].agg(F.count("*").alias(f"{name}_cells"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_points"))

        row = of("cells").crossJoin(of("seeds")).crossJoin(of("survivors"))  # single rows
        row = row.crossJoin(prune.cascade_counts(run.frames["rest"] if self.heuristics else run.frames["rest"].limit(0), self.held, run.summary, run.dm))
        read, swept, summed = (run.counts["second"][c] for c in COUNTS)
        row = row.withColumn("num_cells", F.col("survivors_cells")).withColumn("dpc_count", F.col("survivors_points") - read)
        sweeping = self.method == "ps"
        for name, value in (("sumdx", read if sweeping else 0), ("sumdx_success", swept), ("sumdist", summed), ("skipped_tpoints", read - swept - summed)):
            row = row.withColumn(name, F.lit(value).cast("long"))
        for name, value in run.millis.items():
            row = row.withColumn(f"{name}_millis", F.lit(value).cast("long"))
        return row


def group_knn(points: DataFrame, query: DataFrame, k: int, partitioning: str = "gd", method: str = "bf", seed: str = "centroid", **options) -> DataFrame:
    """(id, dist) of the k points nearest to the whole query set; see ``Query`` for the options."""
    return Query(points, query, k, partitioning, method, seed, **options).answer()


def brute_force(points: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The same without any pruning: every point is summed where it is read, k rows of each partition are merged."""
    found = evaluate.nearest(valid(points), query, k).where("id is not null").select("id", "dist")
    return evaluate.top_k(evaluate.without_duplicates(found), k)
