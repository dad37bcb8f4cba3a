"""Command line: python -m nearfold knn|summary|tree|partition name=value ...

knn        query=PATH points=PATH out=DIR [k=10 partitioning=gd method=bf seed=centroid n=1000 capacity=100 samplerate=100 type=1 depth=10 heuristics=true fastsums=true
           summary=PATH tree=PATH prepartitioned=false]
           writes the neighbours among the seeds, the neighbours, the seed cells and one row of counters and times
summary    query=PATH out=DIR [step=1e-6 mindist=10 limit=100 diff=1e-6]
tree       points=PATH out=DIR [samplerate=10 capacity=100 type=1 depth=10 seed=0 distinct=false]      type: 1 capacity, 2 all children, 3 average width
partition  points=PATH out=DIR [n=1000 | tree=PATH]      stores points with their cell, for knn with prepartitioned=true

summary= and tree= of knn and partition name what summary and tree wrote before (summary.parquet or its text, leaves.parquet). Paths that end in .parquet are tables of (id, x, y);
others are tab-separated text. Every result replaces what was there.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from nearfold.operators import quadtree, summary
from nearfold.plans.engine import Query
from nearfold.sources import points as sources
from nearfold.sources import sinks


def _points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", "x", "y") if path.endswith(".parquet") else sources.read_points(spark, path)


def _switch(text: str) -> bool:
    if text.lower() not in ("true", "false", "1", "0"):
        raise ValueError(f"{text!r} is neither true nor false")
    return text.lower() in ("true", "1")


def _kind(text: str) -> str:
    if text not in ("1", "2", "3"):
        raise ValueError("type is 1, 2 or 3")
    return quadtree.KINDS[int(text) - 1]


def _descent(given: dict[str, str]) -> dict:
    return {"step": float(given.pop("step", "1e-6")), "min_dist": float(given.pop("mindist", "10")), "limit": int(given.pop("limit", "100")), "diff": float(given.pop("diff", "1e-6"))}


def _summary(spark: SparkSession, path: str | None) -> DataFrame | None:
    if path is None:
        return None
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else sources.read_summary(spark, path)


def _leaves(spark: SparkSession, path: str | None) -> DataFrame | None:
    return None if path is None else sources.read_leaves(spark, path)


def knn(spark: SparkSession, given: dict[str, str]) -> None:
    out, whole = given.pop("out"), _switch(given.pop("prepartitioned", "false"))
    path = given.pop("points")
    config = Query(
        spark.read.parquet(path) if whole else _points(spark, path), sources.as_query(_points(spark, given.pop("query"))), int(given.pop("k", "10")),
        given.pop("partitioning", "gd"), given.pop("method", "bf"), given.pop("seed", "centroid"), n=int(given.pop("n", "1000")),
        capacity=int(given.pop("capacity", "100")), sample_rate=int(given.pop("samplerate", "100")), kind=_kind(given.pop("type", "1")),
        max_depth=int(given.pop("depth", str(quadtree.MAX_DEPTH))), about=_summary(spark, given.pop("summary", None)), leaves=_leaves(spark, given.pop("tree", None)), prepartitioned=whole,
        heuristics=_switch(given.pop("heuristics", "true")), fast_sums=_switch(given.pop("fastsums", "true")), **_descent(given),
    )
    _nothing_left(given)
    sinks.write_run(config.run(), out)
    config.metrics().coalesce(1).write.mode("overwrite").json(f"{out}/metrics")


def summarize(spark: SparkSession, given: dict[str, str]) -> None:
    out, query = given.pop("out"), sources.as_query(_points(spark, given.pop("query")))
    row = summary.geometric_median(query, **_descent(given))
    _nothing_left(given)
    sinks.write_summary(row, f"{out}/summary.parquet")
    sinks.write_summary(row, f"{out}/summary.txt", text=True)


def tree(spark: SparkSession, given: dict[str, str]) -> None:
    out, points = given.pop("out"), _points(spark, given.pop("points"))
    rate, depth, seed = int(given.pop("samplerate", "10")), int(given.pop("depth", str(quadtree.MAX_DEPTH))), int(given.pop("seed", "0"))
    drawn = sources.sample(points, rate, seed)
    if _switch(given.pop("distinct", "false")):
        drawn = sources.one_each(drawn)
    counted = quadtree.addresses(drawn, depth).cache()
    inner = quadtree.internal_of(counted, int(given.pop("capacity", "100")), _kind(given.pop("type", "1")), depth)
    _nothing_left(given)
    leaves = quadtree.leaf_table(drawn, inner, depth, counted)
    sinks.write_leaves(leaves, f"{out}/leaves.parquet")
    sinks.write_shape(leaves.select("cell"), f"{out}/shape")


def partition(spark: SparkSession, given: dict[str, str]) -> None:
    out, points, leaves = given.pop("out"), _points(spark, given.pop("points")), _leaves(spark, given.pop("tree", None))
    n = int(given.pop("n", "1000")) if leaves is None else None
    _nothing_left(given)
    sinks.write_prepartitioned(points, out, n, None if leaves is None else quadtree.internal_of_leaves(leaves))


def _nothing_left(given: dict[str, str]) -> None:
    if given:
        raise ValueError(f"unknown arguments: {', '.join(sorted(given))}")


COMMANDS = {"knn": knn, "summary": summarize, "tree": tree, "partition": partition}


def main(arguments: list[str], spark: SparkSession | None = None) -> None:
    command, *rest = arguments or [""]
    if command not in COMMANDS or any("=" not in a for a in rest):
        raise SystemExit(__doc__)
    given = {name.lower(): value for name, _, value in (a.partition("=") for a in rest)}
    COMMANDS[command](spark or SparkSession.builder.appName("nearfold").getOrCreate(), given)


if __name__ == "__main__":
    main(sys.argv[1:])
