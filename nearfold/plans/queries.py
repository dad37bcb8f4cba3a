"""Every registered query of the engine and the SQL that states the same result.

All use the derived sets of ``sources.points``: orders (or, for the skewed tree, events) as points, customers as query points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions import geometry
from nearfold.operators import evaluate, grid, prune, quadtree, seeds, summary
from nearfold.plans import engine
from nearfold.sources import points as sources
from nearfold.sources import sinks, store
from nearfold.streaming.neighbors import RunningNeighbors

K, N, CAPACITY, DEPTH = 10, 50, 500, 10
SEED_K = 40

# ---- SQL building blocks -------------------------------------------------------------------------------------------

T = """t AS MATERIALIZED (SELECT o_orderkey::BIGINT AS id, o_totalprice / 500000::DOUBLE AS x,
  datediff('day', DATE '1994-12-31', CAST(o_orderdate AS DATE)) / 2500.0::DOUBLE AS y FROM orders)"""
E = """t AS MATERIALIZED (SELECT event_id::BIGINT AS id, (epoch_us(ts) / 1000000.0::DOUBLE - 1704067200) / 2678400::DOUBLE AS x, (value + 1) / 602::DOUBLE AS y FROM events)"""
Q = """q AS MATERIALIZED (SELECT c_custkey::BIGINT AS qid, (c_acctbal + 1000) / 11000::DOUBLE * 0.2::DOUBLE + 0.4::DOUBLE AS qx,
  ((c_custkey * 37) % 101 + 0.5::DOUBLE) / 101::DOUBLE * 0.2::DOUBLE + 0.4::DOUBLE AS qy FROM customer WHERE c_custkey <= 200)"""
V = "v AS MATERIALIZED (SELECT * FROM t WHERE x >= 0 AND x < 1 AND y >= 0 AND y < 1)"
DIST = "d AS MATERIALIZED (SELECT id, sum(sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy))) AS dist FROM v, q GROUP BY id)"
TOP = f"top AS MATERIALIZED (SELECT id, dist FROM d ORDER BY dist, id LIMIT {K})"
# The descent from the mean: each row is a round; its move is judged when the next one is made.
MEDIAN = """r(i, x, y, p) AS (
  SELECT 0, avg(qx), avg(qy), 0.0::DOUBLE FROM q UNION ALL
  SELECT i + 1, x - 1e-6::DOUBLE * gx, y - 1e-6::DOUBLE * gy, 1e-6::DOUBLE * sqrt(gx * gx + gy * gy) FROM (
    SELECT any_value(i) AS i, any_value(x) AS x, any_value(y) AS y, any_value(p) AS p, count(*) AS c, sum(sqrt((x - qx) ** 2 + (y - qy) ** 2)) AS s,
      sum(coalesce((x - qx) / nullif(sqrt((x - qx) ** 2 + (y - qy) ** 2), 0), 0)) AS gx, sum(coalesce((y - qy) / nullif(sqrt((x - qx) ** 2 + (y - qy) ** 2), 0), 0)) AS gy
    FROM r, q) WHERE c > 0 AND (i = 0 OR (s > 10 AND i < 100 AND p > 1e-6::DOUBLE))),
c AS MATERIALIZED (SELECT x AS xc, y AS yc FROM r ORDER BY i DESC LIMIT 1),
s AS MATERIALIZED (SELECT min(qx) AS xmin, max(qx) AS xmax, min(qy) AS ymin, max(qy) AS ymax, any_value(xc) AS xc, any_value(yc) AS yc,
  sum(sqrt((xc - qx) ** 2 + (yc - qy) ** 2)) AS sc, count(*) AS nq FROM q, c)"""
GRID = f"g AS MATERIALIZED (SELECT CAST(floor(y / (1.0::DOUBLE / {N})) AS BIGINT) * {N} + CAST(floor(x / (1.0::DOUBLE / {N})) AS BIGINT) AS cell, * FROM v)"
GRID_CELLS = f"""h AS MATERIALIZED (SELECT cell, (cell % {N}) * (1.0::DOUBLE / {N}) AS x0, (cell // {N}) * (1.0::DOUBLE / {N}) AS y0, 1.0::DOUBLE / {N} AS ds, n
  FROM (SELECT cell, count(*) AS n FROM g GROUP BY cell))"""
ADDRESS = f"""lv AS (SELECT unnest(range(1, {DEPTH + 1})) AS l),
a AS MATERIALIZED (SELECT id, any_value(x) AS x, any_value(y) AS y, string_agg(CAST(CAST(2 * (1 - floor(y * 2 ** l) % 2) + floor(x * 2 ** l) % 2 AS INT) AS VARCHAR), '' ORDER BY l) AS addr FROM v, lv GROUP BY id),
p AS MATERIALIZED (SELECT substr(addr, 1, l) AS pre, count(*) AS n FROM a, (SELECT unnest(range(0, {DEPTH})) AS l) GROUP BY ALL)"""


def _internal(kind: str = "capacity", capacity: int = CAPACITY) -> str:
    if kind == "capacity":
        return f"i AS MATERIALIZED (SELECT pre FROM p WHERE n > {capacity})"
    if kind == "all_children":
        return f"""i AS MATERIALIZED (SELECT pre FROM p WHERE n > {capacity} AND pre = '' UNION
          SELECT substr(pre, 1, length(pre) - 1) || dig FROM p, (VALUES ('0'), ('1'), ('2'), ('3')) AS dg(dig) WHERE n > {capacity} AND pre <> '')"""
    return f"""i0 AS MATERIALIZED (SELECT pre FROM p WHERE n > {capacity}),
      k0 AS (SELECT pre || dig AS cell FROM i0, (VALUES ('0'), ('1'), ('2'), ('3')) AS dg(dig) WHERE pre || dig NOT IN (SELECT pre FROM i0)
             UNION ALL SELECT '' WHERE NOT EXISTS (SELECT * FROM i0)),
      w AS (SELECT avg(w) AS w FROM (SELECT DISTINCT 0.5::DOUBLE ** length(cell) AS w FROM k0)),
      z(pre) AS (SELECT '' FROM w WHERE 1.0 > w UNION ALL SELECT pre || dig FROM z, w, (VALUES ('0'), ('1'), ('2'), ('3')) AS dg(dig) WHERE 0.5::DOUBLE ** (length(pre) + 1) > w AND length(pre) + 1 < {DEPTH}),
      i AS MATERIALIZED (SELECT pre FROM i0 UNION SELECT pre FROM z)"""


TREE = "u AS MATERIALIZED (SELECT a.id, any_value(x) AS x, any_value(y) AS y, substr(any_value(addr), 1, CAST(count(i.pre) AS INT)) AS cell FROM a LEFT JOIN i ON starts_with(a.addr, i.pre) GROUP BY a.id)"
LEAVES = """k AS MATERIALIZED (SELECT pre || dig AS cell FROM i, (VALUES ('0'), ('1'), ('2'), ('3')) AS dg(dig) WHERE pre || dig NOT IN (SELECT pre FROM i)
  UNION ALL SELECT '' WHERE NOT EXISTS (SELECT * FROM i))"""


def _bounds(source: str, name: str) -> str:
    """x0, y0, ds of the quadtree cells of a relation (cell, ...)."""
    east = " + ".join(f"CASE WHEN substr(cell, {d}, 1) IN ('1', '3') THEN {0.5**d}::DOUBLE ELSE 0 END" for d in range(1, DEPTH + 1))
    north = " + ".join(f"CASE WHEN substr(cell, {d}, 1) IN ('0', '1') THEN {0.5**d}::DOUBLE ELSE 0 END" for d in range(1, DEPTH + 1))
    return f"{name} AS MATERIALIZED (SELECT *, {east} AS x0, {north} AS y0, 0.5::DOUBLE ** length(cell) AS ds FROM {source})"


TREE_CELLS = "uc AS (SELECT cell, count(*) AS n FROM u GROUP BY cell),\n" + _bounds("uc", "h")
MIND_C = "sqrt(greatest(x0 - xc, 0, xc - x0 - ds) ** 2 + greatest(y0 - yc, 0, yc - y0 - ds) ** 2)"
MIND_BOX = "sqrt(greatest(x0 - xmax, 0, xmin - (x0 + ds)) ** 2 + greatest(y0 - ymax, 0, ymin - (y0 + ds)) ** 2)"
LADDER = """b(m, x1, x2, y1, y2) AS (SELECT 0, xmin, xmax, ymin, ymax FROM s UNION ALL
  SELECT m + 1, 0.9::DOUBLE * x1, CASE WHEN 1.1::DOUBLE * x2 <= 1 THEN 1.1::DOUBLE * x2 ELSE x2 END, 0.9::DOUBLE * y1, CASE WHEN 1.1::DOUBLE * y2 <= 1 THEN 1.1::DOUBLE * y2 ELSE y2 END FROM b WHERE m < 150),
e AS MATERIALIZED (SELECT cell, any_value(n) AS n, min(m) AS m FROM h, b WHERE x1 <= x0 + ds AND x2 >= x0 AND y1 <= y0 + ds AND y2 >= y0 GROUP BY cell)"""


def _seeded(rounds: str, test: str) -> str:
    return f"""{rounds},
f AS (SELECT m, sum(sum(n)) OVER (ORDER BY m) AS total FROM e GROUP BY m)
SELECT cell, n, m::BIGINT AS m FROM e WHERE m <= (SELECT min(m) FROM f WHERE total {test} {SEED_K})"""


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


ANSWER = _with(T, Q, V, DIST, TOP, select="SELECT id, round(dist, 6) AS dist FROM top")

# ---- queries -------------------------------------------------------------------------------------------------------


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sources.orders_points(spark, sf_dir), sources.customer_queries(spark, sf_dir)


def _rounded(neighbors: DataFrame, *names: str) -> DataFrame:
    names = names or ("dist",)
    return neighbors.withColumns({n: F.round(n, 6) for n in names})


def _knn(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    points, query = _sets(spark, sf_dir)
    return _rounded(engine.group_knn(points, query, K, n=N, capacity=CAPACITY, **options))


def gnn_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(engine.brute_force(*_sets(spark, sf_dir), K))


def gnn_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, query = _sets(spark, sf_dir)
    return _rounded(evaluate.top_k(evaluate.sum_distances(sources.valid(points), query), K))


def gnn_tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as lines of text and parsed again, then the neighbours' own lines."""
    points, query = _sets(spark, sf_dir)
    lines = points.select(F.concat_ws("\t", F.col("id"), F.col("x"), F.col("y"), F.lit("more")).alias("value"))
    found = engine.brute_force(sources.parse_points(lines), query, K)
    back = sinks.neighbor_lines(found).select(F.split("value", "\t").alias("f"))
    return back.select(F.col("f")[0].cast("long").alias("id"), F.round(F.col("f")[1].cast("double"), 6).alias("dist"))


def grid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.assign(sources.orders_points(spark, sf_dir), N).select("id", "cell")


def grid_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.histogram(sources.orders_points(spark, sf_dir), N).select("cell", "n")


def grid_cell_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.histogram(sources.orders_points(spark, sf_dir), N).select("cell", "x0", "y0", "ds"), "x0", "y0", "ds")


def _tree(points: DataFrame, kind: str = "capacity", capacity: int = CAPACITY) -> DataFrame:
    return quadtree.internal_nodes(points, capacity, kind, DEPTH)


def quadtree_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sources.orders_points(spark, sf_dir)
    return quadtree.assign(points, _tree(points), DEPTH).select("id", "cell")


def quadtree_leaves(spark: SparkSession, sf_dir: str, kind: str = "capacity", events: bool = False) -> DataFrame:
    points = (sources.events_points if events else sources.orders_points)(spark, sf_dir)
    return quadtree.leaf_table(points, _tree(points, kind), DEPTH).select("cell", F.col("depth").cast("long").alias("depth"), "n")


def quadtree_cell_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sources.orders_points(spark, sf_dir)
    return quadtree.leaf_table(points, _tree(points), DEPTH).select("cell", "x0", "y0", "ds")


def quadtree_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sources.orders_points(spark, sf_dir)
    return quadtree.shape(quadtree.leaves_of(_tree(points), DEPTH))


def query_mbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.bounding_box(sources.customer_queries(spark, sf_dir)), "xmin", "xmax", "ymin", "ymax")


def query_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.mean_point(sources.customer_queries(spark, sf_dir)), "xm", "ym")


def query_geometric_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.geometric_median(sources.customer_queries(spark, sf_dir))
    return _rounded(found, *found.columns)


def median_query_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.median_query_point(sources.customer_queries(spark, sf_dir)), "qx", "qy")


def seed_cells(spark: SparkSession, sf_dir: str, partitioning: str, seed: str) -> DataFrame:
    points, query = _sets(spark, sf_dir)
    config = engine.Query(points, query, SEED_K, partitioning, "bf", seed, n=N, capacity=CAPACITY, max_depth=DEPTH)
    cells, leaves = config.partition()
    return config.seeds(cells, leaves, config.summary()).select("cell", "n", "m")


def _pruning(spark: SparkSession, sf_dir: str):
    points, query = _sets(spark, sf_dir)
    about = summary.summarize(query)
    dm = evaluate.kth_distance(engine.brute_force(points, query, K), K)
    return points, query, grid.histogram(points, N), about, dm


def prune_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, cells, about, dm = _pruning(spark, sf_dir)
    return prune.h1(cells, about, dm).select("cell", "n")


def prune_h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, cells, about, dm = _pruning(spark, sf_dir)
    return prune.h2(cells, about, dm).select("cell", "n")


def prune_h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, query, cells, about, dm = _pruning(spark, sf_dir)
    return prune.h3(cells, query, dm * 1.001).select("cell", "n")


def prune_h4_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, _, _, about, dm = _pruning(spark, sf_dir)
    return sources.valid(points).where(prune.passes_h4(about, dm)).select("id")


def prune_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, query, cells, about, dm = _pruning(spark, sf_dir)
    return prune.cascade_counts(cells, query, about, dm * 1.001)


def cell_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and points in all and in the seeds."""
    points, query = _sets(spark, sf_dir)
    config = engine.Query(points, query, SEED_K, n=N)
    cells, leaves = config.partition()
    seeded = config.seeds(cells, leaves, config.summary())
    return cells.agg(F.count("*").alias("cells"), F.sum("n").alias("points")).crossJoin(seeded.agg(F.count("*").alias("seed_cells"), F.sum("n").alias("seed_points")))  # single rows


def topk_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, query = _sets(spark, sf_dir)
    return _rounded(evaluate.top_k_per_cell(grid.assign(points, 4), query, 3).select("cell", "id", "dist", F.col("rank").cast("long").alias("rank")))


#: Overlapping parts that cover all ids.
PARTS = ("0, 1, 2, 3", "2, 3, 4, 5")


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points, query = _sets(spark, sf_dir)
    return tuple(evaluate.top_k(evaluate.sum_distances(sources.valid(points).where(f"id % 6 in ({a})"), query), K) for a in PARTS)


def merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.merge(*_lists(spark, sf_dir), K))


def topk_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.difference(*_lists(spark, sf_dir)))


def neighbors_without_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _lists(spark, sf_dir)
    return _rounded(evaluate.without_duplicates(first.unionByName(second)))


def gnn_all_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all customers as query points, without pruning."""
    return _rounded(engine.brute_force(sources.orders_points(spark, sf_dir), sources.customer_queries(spark, sf_dir, None), K))


def gnn_all_customers_pruned(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    points, query = sources.orders_points(spark, sf_dir), sources.customer_queries(spark, sf_dir, None)
    return _rounded(engine.group_knn(points, query, K, n=N, capacity=CAPACITY, **options))


def _config(spark: SparkSession, sf_dir: str, points: DataFrame | None = None, **options) -> engine.Query:
    own, query = _sets(spark, sf_dir)
    return engine.Query(own if points is None else points, query, K, n=N, capacity=CAPACITY, **options)


def gnn_stored_summary_and_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a summary and a tree that were written and read again."""
    points, query = _sets(spark, sf_dir)
    folder = store.new_folder(spark, "stored")
    sinks.write_summary(summary.geometric_median(query), f"{folder}/summary.parquet")
    sinks.write_leaves(quadtree.leaf_table(points, _tree(points), DEPTH), f"{folder}/leaves.parquet")
    about, leaves = spark.read.parquet(f"{folder}/summary.parquet"), sources.read_leaves(spark, f"{folder}/leaves.parquet")
    return _rounded(_config(spark, sf_dir, partitioning="qt", about=about, leaves=leaves).answer())


def gnn_prepartitioned(spark: SparkSession, sf_dir: str, partitioning: str) -> DataFrame:
    """Over points that were stored with their cell."""
    points, folder, leaves = sources.orders_points(spark, sf_dir), store.new_folder(spark, "points"), None
    if partitioning == "gd":
        sinks.write_prepartitioned(points, folder, n=N)
    else:
        tree = _tree(points)
        leaves = quadtree.leaf_table(points, tree, DEPTH)
        sinks.write_prepartitioned(points, folder, tree=tree)
    return _rounded(_config(spark, sf_dir, spark.read.parquet(folder), partitioning=partitioning, leaves=leaves, prepartitioned=True).answer())


def prepartitioned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.new_folder(spark, "points")
    sinks.write_prepartitioned(sources.orders_points(spark, sf_dir), folder, n=N)
    return spark.read.parquet(folder).select("id", "cell")


def _neighbor_file(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    return lines.select(F.col("f")[0].cast("long").alias("id"), F.round(F.col("f")[1].cast("double"), 6).alias("dist"))


def neighbors_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest points of the seed cells, written as lines and read again."""
    folder = store.new_folder(spark, "run")
    sinks.write_run(_config(spark, sf_dir).run(), folder)
    return _neighbor_file(spark, f"{folder}/neighbors_first")


def neighbors_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer, written over an earlier one and read again."""
    folder = store.new_folder(spark, "run")
    run = _config(spark, sf_dir).run()
    for _ in range(2):
        sinks.write_run(run, folder)
    return _neighbor_file(spark, f"{folder}/neighbors")


def seed_cells_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.new_folder(spark, "run")
    sinks.write_run(_config(spark, sf_dir).run(), folder)
    return spark.read.text(f"{folder}/seeds").select(F.col("value").alias("cell"))


def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.new_folder(spark, "summary")
    sinks.write_summary(summary.geometric_median(sources.customer_queries(spark, sf_dir)), folder, text=True)
    found = sources.read_summary(spark, folder)
    return _rounded(found, *found.columns)


def leaves_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, folder = sources.orders_points(spark, sf_dir), store.new_folder(spark, "leaves")
    sinks.write_leaves(quadtree.leaf_table(points, _tree(points), DEPTH), folder)
    return sources.read_leaves(spark, folder).select("cell", F.col("depth").cast("long").alias("depth"), "n")


def shape_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, folder = sources.orders_points(spark, sf_dir), store.new_folder(spark, "shape")
    sinks.write_shape(quadtree.leaves_of(_tree(points), DEPTH), folder)
    return spark.read.text(folder).select(F.col("value").alias("shape"))


COUNTERS = [f"{k}_{c}" for k in ("cells", "seeds", "survivors") for c in ("cells", "points")] + [f"h{k}_{r}" for k in (1, 2, 3) for r in ("success", "fail")] + ["num_cells", "dpc_count"]


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a run that don't depend on the order in which points are read."""
    found = _config(spark, sf_dir).metrics()
    return found.select(*[F.col(n).cast("long").alias(n) for n in COUNTERS])


def leftmost_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.order_by_x(sources.orders_points(spark, sf_dir)).limit(100).select("id", "x")


def topmost_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.order_by_y(sources.orders_points(spark, sf_dir), descending=True).limit(100).select("id", "y")


def sample_one_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample with one row for each id, of points that all occur twice."""
    points = sources.orders_points(spark, sf_dir)
    return sources.one_each(sources.sample(points.unionByName(points.withColumn("x", F.col("x") / 2)), 10, seed=None))


def running_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list that is kept over batches of points, one of them added twice."""
    points, query = _sets(spark, sf_dir)
    running = RunningNeighbors(spark, query, K, store.new_folder(spark, "list"))
    for batch in (0, 1, 1, 2):
        running.add(points.where(F.pmod("id", F.lit(3)) == batch), batch)
    return _rounded(running.value())


def sumdx_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, query = _sets(spark, sf_dir)
    # Nine decimals, for these sums often lie halfway between values of six.
    return evaluate.sum_dx(sources.valid(points), query).select("id", F.round("sumdx", 9).alias("sumdx"))


def mindist_point_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sources.orders_points(spark, sf_dir)
    value = geometry.mindist_point_rect(F.col("x"), F.col("y"), 0.4, 0.4, 0.6, 0.6)
    return _rounded(points.select("id", value.alias("gap"), geometry.disk_meets_rect(F.col("x"), F.col("y"), 0.1, 0.4, 0.4, 0.6, 0.6).alias("near")), "gap")


def mindist_rect_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid.histogram(sources.orders_points(spark, sf_dir), N)
    corners = (F.col("x0"), F.col("y0"), F.col("x0") + F.col("ds"), F.col("y0") + F.col("ds"))
    value = geometry.mindist_rect_rect(*corners, 0.41, 0.41, 0.59, 0.59)
    return _rounded(cells.select("cell", value.alias("gap"), geometry.rects_meet(*corners, 0.41, 0.41, 0.59, 0.59).alias("meet")), "gap")


def sample_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.sample(sources.orders_points(spark, sf_dir), 10, seed=None).select("id")


def sorted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sorted_lines(sources.orders_points(spark, sf_dir).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("value")))


def set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points of each derived set the partitionings accept and reject."""
    frames = []
    for name, make in (("orders", sources.orders_points), ("events", sources.events_points)):
        points = make(spark, sf_dir)
        frames.append(sources.valid(points).agg(F.lit(name).alias("name"), F.lit("valid").alias("kind"), F.count("*").alias("n")))
        frames.append(sources.rejected(points).agg(F.lit(name).alias("name"), F.lit("rejected").alias("kind"), F.count("*").alias("n")))
    first, *others = frames
    for other in others:
        first = first.unionByName(other)
    return first


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "gnn_bruteforce": gnn_bruteforce,
    "gnn_arrow": gnn_arrow,
    **{f"gnn_{p}_{m}_{s}": partial(_knn, partitioning=p, method=m, seed=s) for p in engine.PARTITIONINGS for m in engine.METHODS for s in engine.SEEDS},
    "gnn_no_heuristics": partial(_knn, heuristics=False),
    "gnn_fastsums_off": partial(_knn, fast_sums=False),
    "gnn_qt_all_children": partial(_knn, partitioning="qt", kind="all_children"),
    "gnn_qt_average_width": partial(_knn, partitioning="qt", kind="average_width"),
    "gnn_tsv_roundtrip": gnn_tsv_roundtrip,
    "grid_assign": grid_assign,
    "grid_histogram": grid_histogram,
    "grid_cell_bounds": grid_cell_bounds,
    "quadtree_assign": quadtree_assign,
    "quadtree_leaves": quadtree_leaves,
    "quadtree_all_children": partial(quadtree_leaves, kind="all_children"),
    "quadtree_avg_width": partial(quadtree_leaves, kind="average_width"),
    "quadtree_skewed": partial(quadtree_leaves, events=True),
    "quadtree_cell_bounds": quadtree_cell_bounds,
    "quadtree_shape": quadtree_shape,
    "query_mbr": query_mbr,
    "query_mean": query_mean,
    "query_geometric_median": query_geometric_median,
    "median_query_point": median_query_point,
    **{f"seed_{s}_{p}": partial(seed_cells, partitioning=p, seed=s) for p in engine.PARTITIONINGS for s in engine.SEEDS},
    "prune_h1": prune_h1,
    "prune_h2": prune_h2,
    "prune_h3": prune_h3,
    "prune_h4_points": prune_h4_points,
    "prune_cascade_counts": prune_cascade_counts,
    "cell_totals": cell_totals,
    "topk_per_cell": topk_per_cell,
    "merge_topk": merge_topk,
    "topk_difference": topk_difference,
    "sumdx_bound": sumdx_bound,
    "mindist_point_rect": mindist_point_rect,
    "mindist_rect_rect": mindist_rect_rect,
    "sample_deterministic": sample_deterministic,
    "sorted_lines": sorted_lines,
    "set_counts": set_counts,
    "neighbors_without_duplicates": neighbors_without_duplicates,
    "gnn_all_customers": gnn_all_customers,
    "gnn_all_customers_gd": gnn_all_customers_pruned,
    "gnn_all_customers_qt": partial(gnn_all_customers_pruned, partitioning="qt", method="ps"),
    "gnn_stored_summary_and_tree": gnn_stored_summary_and_tree,
    "gnn_prepartitioned_gd": partial(gnn_prepartitioned, partitioning="gd"),
    "gnn_prepartitioned_qt": partial(gnn_prepartitioned, partitioning="qt"),
    "prepartitioned_points": prepartitioned_points,
    "neighbors_first": neighbors_first,
    "neighbors_file": neighbors_file,
    "seed_cells_file": seed_cells_file,
    "summary_file": summary_file,
    "leaves_file": leaves_file,
    "shape_file": shape_file,
    "run_metrics": run_metrics,
    "leftmost_points": leftmost_points,
    "topmost_points": topmost_points,
    "sample_one_each": sample_one_each,
    "running_topk": running_topk,
}

_DM = "m AS (SELECT max(dist) AS dm FROM top)"
_PRUNE = (T, Q, MEDIAN, V, DIST, TOP, _DM, GRID, GRID_CELLS)
_H3 = "o AS (SELECT cell, any_value(n) AS n, any_value(x0) AS x0, any_value(y0) AS y0, any_value(ds) AS ds, sum(sqrt(greatest(x0 - qx, 0, qx - x0 - ds) ** 2 + greatest(y0 - qy, 0, qy - y0 - ds) ** 2)) AS bound FROM h, q GROUP BY cell)"
_HOME = f"CAST(floor(yc / (1.0::DOUBLE / {N})) AS BIGINT) * {N} + CAST(floor(xc / (1.0::DOUBLE / {N})) AS BIGINT)"
_DISK_GRID = f"e AS MATERIALIZED (SELECT h.cell, n, CASE WHEN cell = {_HOME} THEN -1 ELSE greatest(0, floor(({MIND_C} - 0.5 * ds) / (0.25 * ds)) + 1) END AS m FROM h, s)"
_DISK_TREE = (
    _bounds("k", "kb")
    + """, home AS (SELECT cell AS home, ds AS w FROM kb, s WHERE x0 <= xc AND xc < x0 + ds AND y0 <= yc AND yc < y0 + ds),
e AS MATERIALIZED (SELECT h.cell, n, CASE WHEN cell = home THEN -1 ELSE greatest(0, ceil(("""
    + MIND_C
    + " - 0.5 * w) / (0.25 * w))) END AS m FROM h, s, home)"
)
#: The seed cells z of a run with K neighbours over the grid, the first list n1, and the other cells with their bounds.
_RUN = (
    T, Q, MEDIAN, V, DIST, GRID, GRID_CELLS, _DISK_GRID, "f AS (SELECT m, sum(sum(n)) OVER (ORDER BY m) AS total FROM e GROUP BY m)",
    f"z AS MATERIALIZED (SELECT cell, n FROM e WHERE m <= (SELECT min(m) FROM f WHERE total >= {K}))",
    f"n1 AS MATERIALIZED (SELECT d.id, d.dist FROM d JOIN g USING (id) JOIN z USING (cell) ORDER BY dist, id LIMIT {K})", "m AS (SELECT max(dist) AS dm FROM n1)",
)
_LEAF_LIST = "SELECT k.cell, length(k.cell)::BIGINT AS depth, coalesce(n, 0)::BIGINT AS n FROM k LEFT JOIN (SELECT cell, count(*) AS n FROM u GROUP BY cell) x ON k.cell = x.cell"
_HALF = "(SELECT id, dist FROM d WHERE id % 6 IN ({}) ORDER BY dist, id LIMIT {})"

ORACLES: dict[str, str] = {name: ANSWER for name in QUERIES if name.startswith("gnn_")} | {
    "grid_assign": _with(T, V, GRID, select="SELECT id, cell FROM g"),
    "grid_histogram": _with(T, V, GRID, select="SELECT cell, count(*) AS n FROM g GROUP BY cell"),
    "grid_cell_bounds": _with(T, V, GRID, GRID_CELLS, select="SELECT cell, round(x0, 6) AS x0, round(y0, 6) AS y0, round(ds, 6) AS ds FROM h"),
    "quadtree_assign": _with(T, V, ADDRESS, _internal(), TREE, select="SELECT id, cell FROM u"),
    "quadtree_leaves": _with(T, V, ADDRESS, _internal(), TREE, LEAVES, select=_LEAF_LIST),
    "quadtree_all_children": _with(T, V, ADDRESS, _internal("all_children"), TREE, LEAVES, select=_LEAF_LIST),
    "quadtree_avg_width": _with(T, V, ADDRESS, _internal("average_width"), TREE, LEAVES, select=_LEAF_LIST),
    "quadtree_skewed": _with(E, V, ADDRESS, _internal(), TREE, LEAVES, select=_LEAF_LIST),
    "quadtree_cell_bounds": _with(T, V, ADDRESS, _internal(), LEAVES, _bounds("k", "kb"), select="SELECT cell, x0, y0, ds FROM kb"),
    "quadtree_shape": _with(
        T, V, ADDRESS, _internal(), LEAVES, select="SELECT string_agg(mark, '' ORDER BY cell) AS shape FROM (SELECT cell, '0' AS mark FROM k UNION ALL SELECT pre, '1' FROM i)"
    ),
    "query_mbr": _with(Q, select="SELECT round(min(qx), 6) AS xmin, round(max(qx), 6) AS xmax, round(min(qy), 6) AS ymin, round(max(qy), 6) AS ymax FROM q"),
    "query_mean": _with(Q, select="SELECT round(avg(qx), 6) AS xm, round(avg(qy), 6) AS ym FROM q"),
    "query_geometric_median": _with(
        Q, MEDIAN, select="SELECT round(xmin, 6) AS xmin, round(xmax, 6) AS xmax, round(ymin, 6) AS ymin, round(ymax, 6) AS ymax, round(xc, 6) AS xc, round(yc, 6) AS yc, round(sc, 6) AS sum_dist_cq FROM s"
    ),
    "median_query_point": _with(
        Q, select="SELECT qid, round(qx, 6) AS qx, round(qy, 6) AS qy FROM (SELECT *, row_number() OVER (ORDER BY qx, qid) AS k, count(*) OVER () AS n FROM q) WHERE k = n // 2 + 1"
    ),
    "seed_mbr_gd": _with(T, Q, MEDIAN, V, GRID, GRID_CELLS, _seeded(LADDER, ">"), select=""),
    "seed_mbr_qt": _with(T, Q, MEDIAN, V, ADDRESS, _internal(), TREE, TREE_CELLS, _seeded(LADDER, ">"), select=""),
    "seed_centroid_gd": _with(T, Q, MEDIAN, V, GRID, GRID_CELLS, _seeded(_DISK_GRID, ">="), select=""),
    "seed_centroid_qt": _with(T, Q, MEDIAN, V, ADDRESS, _internal(), TREE, TREE_CELLS, LEAVES, _seeded(_DISK_TREE, ">"), select=""),
    "prune_h1": _with(*_PRUNE, select=f"SELECT cell, n FROM h, s, m WHERE {MIND_C} * nq < dm + sc"),
    "prune_h2": _with(*_PRUNE, select=f"SELECT cell, n FROM h, s, m WHERE {MIND_BOX} * nq < dm"),
    "prune_h3": _with(*_PRUNE, _H3, select="SELECT cell, n FROM o, m WHERE bound < dm * 1.001::DOUBLE"),
    "prune_h4_points": _with(*_PRUNE, select="SELECT id FROM v, s, m WHERE sqrt((x - xc) * (x - xc) + (y - yc) * (y - yc)) * nq < dm + sc"),
    "prune_cascade_counts": _with(
        *_PRUNE, _H3, f"j AS (SELECT {MIND_C} * nq < dm * 1.001::DOUBLE + sc AS p1, {MIND_BOX} * nq < dm * 1.001::DOUBLE AS p2, bound < dm * 1.001::DOUBLE AS p3 FROM o, s, m)",
        select="""SELECT count(*) FILTER (NOT p1) AS h1_success, count(*) FILTER (p1) AS h1_fail, count(*) FILTER (p1 AND NOT p2) AS h2_success, count(*) FILTER (p1 AND p2) AS h2_fail,
          count(*) FILTER (p1 AND p2 AND NOT p3) AS h3_success, count(*) FILTER (p1 AND p2 AND p3) AS h3_fail FROM j""",
    ),
    "cell_totals": _with(
        T, Q, MEDIAN, V, GRID, GRID_CELLS, _DISK_GRID, "f AS (SELECT m, sum(sum(n)) OVER (ORDER BY m) AS total FROM e GROUP BY m)",
        select=f"""SELECT (SELECT count(*) FROM h) AS cells, (SELECT sum(n)::BIGINT FROM h) AS points, count(*) AS seed_cells, sum(n)::BIGINT AS seed_points
          FROM e WHERE m <= (SELECT min(m) FROM f WHERE total >= {SEED_K})""",
    ),
    "topk_per_cell": _with(
        T, Q, V, DIST,
        select="""SELECT cell, id, round(dist, 6) AS dist, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY dist, id) AS k
          FROM d JOIN (SELECT id, CAST(floor(y / 0.25::DOUBLE) AS BIGINT) * 4 + CAST(floor(x / 0.25::DOUBLE) AS BIGINT) AS cell FROM v) USING (id)) WHERE k <= 3""",
    ),
    "merge_topk": _with(
        T, Q, V, DIST, select=f"SELECT id, round(dist, 6) AS dist FROM (SELECT DISTINCT * FROM ({_HALF.format(PARTS[0], K)} UNION ALL {_HALF.format(PARTS[1], K)})) ORDER BY dist, id LIMIT {K}"
    ),
    "topk_difference": _with(T, Q, V, DIST, select=f"SELECT id, round(dist, 6) AS dist FROM {_HALF.format(PARTS[0], K)} WHERE id NOT IN (SELECT id FROM {_HALF.format(PARTS[1], K)})"),
    "neighbors_without_duplicates": _with(T, Q, V, DIST, select=f"SELECT DISTINCT id, round(dist, 6) AS dist FROM ({_HALF.format(PARTS[0], K)} UNION ALL {_HALF.format(PARTS[1], K)})"),
    "sumdx_bound": _with(T, Q, V, select="SELECT id, round(sum(abs(qx - x)), 9) AS sumdx FROM v, q GROUP BY id"),
    "mindist_point_rect": _with(
        T,
        select="""SELECT id, round(gap, 6) AS gap, gap <= 0.1::DOUBLE AS near FROM (SELECT id, sqrt(greatest(x - 0.6::DOUBLE, 0, 0.4::DOUBLE - x) ** 2 + greatest(y - 0.6::DOUBLE, 0, 0.4::DOUBLE - y) ** 2) AS gap FROM t)""",
    ),
    "mindist_rect_rect": _with(
        T, V, GRID, GRID_CELLS,
        select="""SELECT cell, round(sqrt(greatest(x0 - 0.59::DOUBLE, 0, 0.41::DOUBLE - x0 - ds) ** 2 + greatest(y0 - 0.59::DOUBLE, 0, 0.41::DOUBLE - y0 - ds) ** 2), 6) AS gap,
          x0 <= 0.59::DOUBLE AND x0 + ds >= 0.41::DOUBLE AND y0 <= 0.59::DOUBLE AND y0 + ds >= 0.41::DOUBLE AS meet FROM h""",
    ),
    "sample_deterministic": _with(T, select="SELECT id FROM t WHERE id % 100 < 10"),
    "sorted_lines": _with(T, select="SELECT 'p' || id AS value FROM t ORDER BY value"),
    "set_counts": "\nUNION ALL ".join(
        f"(WITH {prelude} SELECT '{name}' AS name, '{kind}' AS kind, count(*) FILTER ({'' if kind == 'valid' else 'NOT '}(x >= 0 AND x < 1 AND y >= 0 AND y < 1)) AS n FROM t)"
        for name, prelude in (("orders", T), ("events", E)) for kind in ("valid", "rejected")
    ),
    **{f"gnn_all_customers{x}": _with(T, Q.replace(" WHERE c_custkey <= 200", ""), V, DIST, TOP, select="SELECT id, round(dist, 6) AS dist FROM top") for x in ("", "_gd", "_qt")},
    "prepartitioned_points": _with(T, V, GRID, select="SELECT id, cell FROM g"),
    "neighbors_first": _with(*_RUN, select="SELECT id, round(dist, 6) AS dist FROM n1"),
    "neighbors_file": ANSWER,
    "running_topk": ANSWER,
    "seed_cells_file": _with(*_RUN, select="SELECT cell::VARCHAR AS cell FROM z"),
    "run_metrics": _with(
        *_RUN, _H3, f"j AS MATERIALIZED (SELECT cell, n, {MIND_C} * nq < dm + sc AS p1, {MIND_BOX} * nq < dm AS p2, bound < dm AS p3 FROM o, s, m WHERE cell NOT IN (SELECT cell FROM z))",
        "k AS MATERIALIZED (SELECT cell, n FROM j WHERE p1 AND p2 AND p3)",
        select="""SELECT (SELECT count(*) FROM h) AS cells_cells, (SELECT sum(n)::BIGINT FROM h) AS cells_points, (SELECT count(*) FROM z) AS seeds_cells, (SELECT sum(n)::BIGINT FROM z) AS seeds_points,
          (SELECT count(*) FROM k) AS survivors_cells, (SELECT coalesce(sum(n), 0)::BIGINT FROM k) AS survivors_points, count(*) FILTER (NOT p1) AS h1_success, count(*) FILTER (p1) AS h1_fail,
          count(*) FILTER (p1 AND NOT p2) AS h2_success, count(*) FILTER (p1 AND p2) AS h2_fail, count(*) FILTER (p1 AND p2 AND NOT p3) AS h3_success, count(*) FILTER (p1 AND p2 AND p3) AS h3_fail,
          (SELECT count(*) FROM k) AS num_cells, (SELECT count(*) FROM g JOIN k USING (cell), s, m WHERE NOT (sqrt((x - xc) ** 2 + (y - yc) ** 2) * nq < dm + sc
            AND x BETWEEN xmin - dm / nq AND xmax + dm / nq AND y BETWEEN ymin - dm / nq AND ymax + dm / nq)) AS dpc_count FROM j""",
    ),
    "leftmost_points": _with(T, select="SELECT id, x FROM t ORDER BY x, id LIMIT 100"),
    "topmost_points": _with(T, select="SELECT id, y FROM t ORDER BY y DESC, id LIMIT 100"),
    "sample_one_each": _with(T, select="SELECT id, x / 2 AS x, y FROM t WHERE id % 100 < 10"),
}
ORACLES |= {"summary_file": ORACLES["query_geometric_median"], "leaves_file": ORACLES["quadtree_leaves"], "shape_file": ORACLES["quadtree_shape"]}
