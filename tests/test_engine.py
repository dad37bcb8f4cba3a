"""The engine against plain Python on small hand-made sets."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfold.functions import geometry
from nearfold.operators import evaluate, grid, prune, quadtree, queryset, seeds, summary, tables
from nearfold.plans import engine
from nearfold.plans import queries as plans
from nearfold.sources import points as sources
from nearfold.sources import sinks
from nearfold.streaming.neighbors import RunningNeighbors


def points(spark, rows):
    return spark.createDataFrame(rows, sources.POINT)


def queries(spark, rows):
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(rows)], sources.QUERY_POINT)


def nearest(rows, query, k):
    best = {}
    for i, x, y in rows:
        if i is not None and 0 <= x < 1 and 0 <= y < 1:
            d = sum(math.hypot(x - a, y - b) for a, b in query)
            best[i] = min(best.get(i, math.inf), d)
    return sorted((d, i) for i, d in best.items())[:k]


def same(found, expected):
    rows = [(r["dist"], r["id"]) for r in found.collect()]
    assert [i for _, i in sorted(rows)] == [i for _, i in expected]
    for (d, _), (e, _) in zip(sorted(rows), expected, strict=True):
        assert d == pytest.approx(e, abs=1e-9)


CONFIGS = [*itertools.product(engine.PARTITIONINGS, engine.METHODS, engine.SEEDS, (True,)), ("gd", "bf", "centroid", False), ("qt", "ps", "mbr", False)]


@pytest.mark.parametrize("partitioning,method,seed,heuristics", CONFIGS)
def test_every_configuration_gives_the_same_answer(spark, partitioning, method, seed, heuristics):
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.random() ** 3) for i in range(400)]
    query = [(0.4 + 0.2 * rng.random(), 0.1 + 0.2 * rng.random()) for _ in range(7)]
    found = engine.group_knn(points(spark, rows), queries(spark, query), 6, partitioning, method, seed, n=8, capacity=20, heuristics=heuristics)
    same(found, nearest(rows, query, 6))


CASES = {
    "fewer points than k": ([(1, 0.1, 0.1), (2, 0.2, 0.9)], [(0.5, 0.5)], 10),
    "as many points as k": ([(i, i / 10, 0.5) for i in range(5)], [(0.5, 0.5), (0.6, 0.1)], 5),
    "ties": ([(2, 0.25, 0.5), (1, 0.75, 0.5), (3, 0.5, 0.25), (4, 0.5, 0.75)], [(0.5, 0.5)], 2),
    "one query point on a point": ([(1, 0.5, 0.5), (2, 0.5, 0.6)], [(0.5, 0.5)], 1),
    "the mean is a query point": ([(i, i / 20, i / 20) for i in range(20)], [(0.4, 0.5), (0.5, 0.5), (0.6, 0.5)], 3),
    "repeated ids": ([(1, 0.5, 0.5), (1, 0.5, 0.5), (2, 0.5, 0.6), (2, 0.9, 0.9), (3, 0.1, 0.1)], [(0.5, 0.55), (0.4, 0.5)], 2),
    "many ids at one place": ([(i, 0.3, 0.3) for i in range(50)], [(0.5, 0.5)], 4),
    "far corner": ([(i, 0.95 + i / 1000, 0.97) for i in range(30)], [(0.02, 0.03), (0.05, 0.01)], 3),
    "outside the square": ([(1, 1.0, 0.5), (2, -0.01, 0.5), (3, float("nan"), 0.5), (4, 0.2, 0.2), (None, 0.5, 0.5)], [(0.5, 0.5)], 3),
    "five points, median between the last two": ([(i, x, 0.5) for i, x in enumerate((0.41, 0.42, 0.43, 0.44, 0.47))], [(0.455, 0.5), (0.46, 0.5)], 2),
    "beyond the box": ([(1, 0.7, 0.5), (2, 0.9, 0.5)], [(0.4, 0.5), (0.4, 0.5), (0.6, 0.5)], 1),
    "no points": ([], [(0.5, 0.5)], 3),
}


@pytest.mark.parametrize("case", CASES)
def test_edge_cases(spark, case):
    rows, query, k = CASES[case]
    for partitioning, method in (("gd", "bf"), ("qt", "ps")):
        found = engine.group_knn(points(spark, rows), queries(spark, query), k, partitioning, method, "mbr", n=10, capacity=3)
        same(found, nearest(rows, query, k))


def test_arguments(spark):
    p, q = points(spark, [(1, 0.5, 0.5)]), queries(spark, [(0.5, 0.5)])
    for bad in ({"partitioning": "kd"}, {"method": "x"}, {"seed": "none"}, {"k": 0}, {"sample_rate": 0}):
        with pytest.raises(ValueError):
            engine.Query(p, q, **({"k": 1} | bad))
    assert engine.Query(p, q, 1, seed="MBR").seed == "mbr"
    with pytest.raises(ValueError):
        engine.group_knn(p, queries(spark, []), 1)


def test_metrics_add_up(spark):
    rng = random.Random(6)
    rows = [(i, rng.random(), rng.random()) for i in range(300)]
    config = engine.Query(points(spark, rows), queries(spark, [(0.5, 0.5), (0.52, 0.48)]), 3, n=10)
    row = config.metrics().first()
    assert row["cells_points"] == 300
    assert row["h1_success"] + row["h1_fail"] == row["cells_cells"] - row["seeds_cells"]
    assert row["h1_fail"] == row["h2_success"] + row["h2_fail"] and row["h2_fail"] == row["h3_success"] + row["h3_fail"]


def tree_by_recursion(rows, capacity, depth, rule="capacity", cell="", x0=0.0, y0=0.0, ds=1.0, forced=False):
    inside = [r for r in rows if x0 <= r[1] < x0 + ds and y0 <= r[2] < y0 + ds]
    if (len(inside) > capacity or forced) and len(cell) < depth:
        h = ds / 2
        quads = [("0", x0, y0 + h), ("1", x0 + h, y0 + h), ("2", x0, y0), ("3", x0 + h, y0)]
        force = rule == "all_children" and any(sum(a <= r[1] < a + h and b <= r[2] < b + h for r in inside) > capacity for _, a, b in quads)
        return {k: v for d, a, b in quads for k, v in tree_by_recursion(inside, capacity, depth, rule, cell + d, a, b, h, force).items()}
    return {cell: len(inside)}


@pytest.mark.parametrize("rule", ["capacity", "all_children"])
def test_quadtree_equals_recursion(spark, rule):
    rng = random.Random(7)
    rows = [(i, rng.random() ** 2, rng.random() ** 3) for i in range(500)] + [(500, 0.5, 0.5), (501, 0.25, 0.75)]
    p = points(spark, rows)
    leaves = quadtree.leaf_table(p, quadtree.internal_nodes(p, 25, rule, 6), 6).collect()
    assert {r["cell"]: r["n"] for r in leaves} == tree_by_recursion(rows, 25, 6, rule)
    for r in leaves:
        assert r["ds"] == 0.5 ** len(r["cell"])


def test_average_width_and_shape(spark):
    rows = [(i, 0.01 + i / 10000, 0.01) for i in range(40)]
    p = points(spark, rows)
    inner = quadtree.internal_nodes(p, 10, "average_width", 5)
    base = {r["cell"] for r in quadtree.leaves_of(quadtree.internal_nodes(p, 10, "capacity", 5), 5).collect()}
    mean = sum({0.5 ** len(c) for c in base}) / len({0.5 ** len(c) for c in base})
    leaves = {r["cell"] for r in quadtree.leaves_of(inner, 5).collect()}
    assert all(0.5 ** len(c) <= mean for c in leaves)
    assert sum(0.25 ** len(c) for c in leaves) == 1
    assert quadtree.shape(quadtree.leaves_of(quadtree.internal_nodes(p, 100, "capacity", 5))).first()["shape"] == "0"
    one = points(spark, [(1, 0.1, 0.1), (2, 0.9, 0.9)])
    assert quadtree.shape(quadtree.leaves_of(quadtree.internal_nodes(one, 1, "capacity", 5))).first()["shape"] == "10000"


def test_grid_divides_by_the_width(spark):
    xs = [0.3, 0.47, 0.59, 0.6, 0.7, 0.94]
    for n in (10, 100):
        rows = [(k, x, xs[-1 - k]) for k, x in enumerate(xs)]
        found = {r["id"]: r["cell"] for r in grid.assign(points(spark, rows), n).collect()}
        assert found == {i: int(y / (1.0 / n)) * n + int(x / (1.0 / n)) for i, x, y in rows}


def walk_box(cells, box, k):
    xmin, xmax, ymin, ymax = box
    for _ in range(300):
        touched = {c for c, (x0, y0, ds, _) in cells.items() if xmin <= x0 + ds and xmax >= x0 and ymin <= y0 + ds and ymax >= y0}
        if sum(cells[c][3] for c in touched) > k:
            return touched
        xmin, ymin = 0.9 * xmin, 0.9 * ymin
        xmax, ymax = (1.1 * xmax if 1.1 * xmax <= 1 else xmax), (1.1 * ymax if 1.1 * ymax <= 1 else ymax)
    return set(cells)


def walk_disk(cells, c, home, width, k, closed):
    if home in cells and (cells[home][3] > k if closed else cells[home][3] >= k):
        return {home}
    r = width / 2
    for _ in range(2000):
        gap = {n: math.hypot(max(x0 - c[0], 0, c[0] - x0 - ds), max(y0 - c[1], 0, c[1] - y0 - ds)) for n, (x0, y0, ds, _) in cells.items()}
        touched = {n for n, g in gap.items() if (g <= r if closed else g < r) or n == home}
        total = sum(cells[n][3] for n in touched)
        if total > k if closed else total >= k:
            return touched
        r += width / 4
    return set(cells)


@pytest.mark.parametrize("k", [1, 12, 60, 10_000])
def test_seeds_equal_growing_regions(spark, k):
    rng = random.Random(k)
    rows = [(i, rng.random(), rng.random()) for i in range(250)]
    p, q = points(spark, rows), queries(spark, [(0.3 + 0.1 * rng.random(), 0.5 + 0.1 * rng.random()) for _ in range(5)])
    about = summary.summarize(q)
    box, centre = (about.xmin, about.xmax, about.ymin, about.ymax), (about.xc, about.yc)
    counted = grid.histogram(p, 9)
    cells = {r["cell"]: (r["x0"], r["y0"], r["ds"], r["n"]) for r in counted.collect()}
    assert {r["cell"] for r in seeds.box_seeds(counted, about, k).collect()} == walk_box(cells, box, k)
    home = int(centre[1] / (1 / 9)) * 9 + int(centre[0] / (1 / 9))
    assert {r["cell"] for r in seeds.disk_seeds_grid(counted, about, k, 9).collect()} == walk_disk(cells, centre, home, 1 / 9, k, False)
    inner = quadtree.internal_nodes(p, 12, "capacity", 6)
    counted = quadtree.histogram(p, inner, 6)
    cells = {r["cell"]: (r["x0"], r["y0"], r["ds"], r["n"]) for r in counted.collect()}
    leaves = quadtree.leaf_table(p, inner, 6)
    (home,) = [r for r in leaves.collect() if r["x0"] <= centre[0] < r["x0"] + r["ds"] and r["y0"] <= centre[1] < r["y0"] + r["ds"]]
    assert {r["cell"] for r in seeds.box_seeds(counted, about, k).collect()} == walk_box(cells, box, k)
    assert {r["cell"] for r in seeds.disk_seeds_tree(counted, leaves, about, k).collect()} == walk_disk(cells, centre, home["cell"], home["ds"], k, True)


def test_median_descent_equals_a_loop(spark):
    rng = random.Random(9)
    q = [(rng.random(), rng.random()) for _ in range(30)]
    x, y = sum(a for a, _ in q) / 30, sum(b for _, b in q) / 30
    for rounds in range(1, 201):
        d = [math.hypot(x - a, y - b) for a, b in q]
        nx, ny = x - 1e-3 * sum((x - a) / e for (a, _), e in zip(q, d)), y - 1e-3 * sum((y - b) / e for (_, b), e in zip(q, d))
        moved, (x, y) = math.hypot(nx - x, ny - y), (nx, ny)
        if not (sum(math.hypot(x - a, y - b) for a, b in q) > 1 and rounds < 200 and moved > 1e-4):
            break
    row = summary.geometric_median(queries(spark, q), step=1e-3, min_dist=1, limit=200, diff=1e-4).first()
    assert (row["xc"], row["yc"]) == pytest.approx((x, y), abs=1e-12)
    lone = summary.summarize(queries(spark, [(0.3, 0.4)]))
    assert (lone.xc, lone.yc, lone.sum_dist_cq, lone.n) == (0.3, 0.4, 0.0, 1)


coordinate = st.floats(0, 0.999, allow_nan=False)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(coordinate, coordinate), min_size=1, max_size=12), st.lists(st.tuples(coordinate, coordinate), min_size=1, max_size=6))
def test_bounds_never_exceed_the_distance(spark, at, q):
    rows = [(i, x, y) for i, (x, y) in enumerate(at)]
    p, query = points(spark, rows), queries(spark, q)
    true = {i: sum(math.hypot(x - a, y - b) for a, b in q) for i, x, y in rows}
    about = summary.summarize(query)
    for r in evaluate.sum_dx(p, query).collect():
        assert r["sumdx"] <= true[r["id"]] + 1e-9
        assert r["sumdx"] == pytest.approx(sum(abs(r["x"] - a) for a, _ in q), abs=1e-9)
    cells = prune.sum_mindist(grid.histogram(p, 7), query)
    judged = cells.select("cell", "bound", *[F.lit(1).alias("one")]).collect()
    placed = {r["id"]: r["cell"] for r in grid.assign(p, 7).collect()}
    bound = {r["cell"]: r["bound"] for r in judged}
    for i, d in true.items():
        assert bound[placed[i]] <= d + 1e-9
    for dm in (0.5, 2.0):
        kept = {r["id"] for r in p.where(prune.passes_h4(about, dm) & prune.in_reach(about, dm)).collect()}
        assert {i for i, d in true.items() if d < dm - 1e-9} <= kept
        alive = {r["cell"] for r in prune.surviving_cells(grid.histogram(p, 7), query, about, dm).collect()}
        assert {placed[i] for i, d in true.items() if d < dm - 1e-9} <= alive


def test_text_input_and_output(spark, tmp_path):
    path = tmp_path / "points.txt"
    path.write_text("1\t0.25\t0.5\r\n 2\t0.75\t0.125\textra\n")
    found = sources.read_points(spark, str(path))
    assert sorted(map(tuple, found.collect())) == [(1, 0.25, 0.5), (2, 0.75, 0.125)]
    for bad in ("x\t1\t2", "", "3\t0.1"):
        broken = spark.createDataFrame([(bad,)], "value string")
        with pytest.raises(Exception, match=r"CAST_INVALID|INVALID_ARRAY|malformed"):
            sources.parse_points(broken).collect()
    assert [tuple(r) for r in sources.parse_points(spark.createDataFrame([("7|0.5|0.5",)], "value string"), "|").collect()] == [(7, 0.5, 0.5)]
    neighbors = spark.createDataFrame([(5, 2.0), (3, 1.5), (4, 1.5)], sources.NEIGHBOR)
    sinks.write_neighbors(neighbors, str(tmp_path / "n"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "n")).collect()] == ["3\t1.5000000000", "4\t1.5000000000", "5\t2.0000000000"]
    about = summary.geometric_median(queries(spark, [(0.25, 0.5), (0.75, 0.5)]))
    sinks.write_summary(about, str(tmp_path / "s"), text=True)
    assert sources.read_summary(spark, str(tmp_path / "s")).first()["xmax"] == 0.75
    sinks.write_summary(about, str(tmp_path / "sp"))
    assert spark.read.parquet(str(tmp_path / "sp")).count() == 1
    p = points(spark, [(i, i / 40, 0.5) for i in range(40)])
    inner = quadtree.internal_nodes(p, 5, "capacity", 5)
    sinks.write_leaves(quadtree.leaf_table(p, inner, 5), str(tmp_path / "l"))
    assert sources.read_leaves(spark, str(tmp_path / "l")).agg(F.sum("n")).first()[0] == 40
    sinks.write_shape(quadtree.leaves_of(inner, 5), str(tmp_path / "shape"))
    sinks.write_cells(grid.histogram(p, 4), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 4
    sinks.write_prepartitioned(p, str(tmp_path / "g"), n=4)
    sinks.write_prepartitioned(p, str(tmp_path / "t"), tree=inner)
    assert spark.read.parquet(str(tmp_path / "g")).count() == spark.read.parquet(str(tmp_path / "t")).count() == 40


def test_normalize_and_sample(spark):
    p = points(spark, [(i, -5.0 + i, 100.0 + i / 2) for i in range(200)])
    assert sources.valid(sources.normalize(p)).count() == 200
    assert sources.sample(p, 10, None).count() == 20
    assert sources.sample(p, 100).count() == 200
    with pytest.raises(ValueError):
        sources.sample(p, 101)


def test_lists(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], sources.NEIGHBOR)
    b = spark.createDataFrame([(2, 1.5), (4, 0.5)], sources.NEIGHBOR)
    assert [tuple(r) for r in evaluate.merge(a, b, 3).collect()] == [(4, 0.5), (1, 1.0), (2, 1.5)]
    assert [r["id"] for r in evaluate.difference(a, b).orderBy("id").collect()] == [1, 3]
    assert evaluate.kth_distance(a, 3) == 3.0 and math.isinf(evaluate.kth_distance(a, 4))
    p = points(spark, [(1, 0.2, 0.9), (2, 0.8, 0.1)])
    assert [r["id"] for r in evaluate.order_by_x(p, True).collect()] == [2, 1] and [r["id"] for r in evaluate.order_by_y(p).collect()] == [2, 1]


def test_rectangles(spark):
    one = spark.range(1)
    assert one.select(geometry.mindist_rect_rect(0, 0, 1, 1, 4, 5, 6, 7)).first()[0] == 5.0
    assert one.select(geometry.rects_meet(0, 0, 1, 1, 1, 1, 2, 2)).first()[0]
    assert one.select(geometry.disk_meets_rect(2, 0.5, 1, 0, 0, 1, 1)).first()[0]
    assert not one.select(geometry.disk_meets_rect(2, 0.5, 1, 0, 0, 1, 1, closed=False)).first()[0]


def test_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.random(), rng.random()) for i in range(60)]
    query = [(0.5, 0.5), (0.4, 0.6)]
    for k in range(3):
        points(spark, rows[20 * k : 20 * k + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    running = RunningNeighbors(spark, queries(spark, query), 4, str(tmp_path / "list"))
    stream = spark.readStream.schema(sources.POINT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running.start(stream, str(tmp_path / "check")).awaitTermination()
    same(running.value(), nearest(rows, query, 4))
    running.add(points(spark, rows[40:]), 2)
    same(running.value(), nearest(rows, query, 4))
    running.reset()
    assert running.value().count() == 0


def test_whole_queries_leave_no_ids_out(spark):
    data = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{data}/orders.parquet")
    assert [r["value"] for r in plans.QUERIES["sorted_lines"](spark, data).collect()] == sorted(f"p{r[0]}" for r in orders.select("o_orderkey").collect())
    rows = [[tuple(r) for r in plans.QUERIES[name](spark, data).collect()] for name in ("merge_topk", "gnn_bruteforce")]
    assert sorted(rows[0]) == sorted(rows[1]) and {i % 6 for i, _ in rows[0]} - set(range(5))
    larger = "/root/testdata/sf0.01"
    assert sources.customer_queries(spark, larger, None).count() == spark.read.parquet(f"{larger}/customer.parquet").count() > 1000


def test_a_large_query_set(spark):
    """600,000 query points, in one chunk and in several, against numpy."""
    rng = np.random.default_rng(4)
    q = rng.random((600_000, 2)) * 0.2 + 0.4
    q[100_000:300_000] = q[0]  # a third of all at one place
    query = spark.createDataFrame(pa.table({"qid": np.arange(len(q)), "qx": q[:, 0], "qy": q[:, 1]}))
    at = rng.random((40, 2))
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(at)]
    true = sorted((float(np.sqrt(((q - p) ** 2).sum(axis=1)).sum()), i) for i, p in enumerate(at))
    for chunk in (queryset.CHUNK, 50_000):
        held = queryset.load(query, chunk)
        assert held.n == 600_000 and (len(held.chunks) > 5) == (chunk == 50_000)
        for method, heuristics in (("bf", True), ("ps", False)):
            config = engine.Query(points(spark, rows), query, 5, "gd", method, n=4, limit=3, heuristics=heuristics)
            config._held = held
            found = [(r["dist"], r["id"]) for r in config.answer().collect()]
            assert [i for _, i in found] == [i for _, i in true[:5]] and [d for d, _ in found] == pytest.approx([d for d, _ in true[:5]], rel=1e-9)
            about = config.run().summary
            assert (about.xmin, about.ymax) == (q[:, 0].min(), q[:, 1].max())
    assert summary.median_query_point(query.limit(7)).first()["qid"] == sorted(zip(q[:7, 0], range(7)))[3][1]


def test_stored_results_are_used_again(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, rng.random(), rng.random() ** 2) for i in range(300)]
    query = [(0.3, 0.2), (0.35, 0.25), (0.4, 0.1)]
    p, q = points(spark, rows), queries(spark, query)
    tree = quadtree.internal_nodes(p, 15, "capacity", 6)
    leaves = quadtree.leaf_table(p, tree, 6)
    about = summary.geometric_median(q)
    sinks.write_prepartitioned(p, str(tmp_path / "gd"), n=6)
    sinks.write_prepartitioned(p, str(tmp_path / "qt"), tree=tree)
    gd, qt = (spark.read.parquet(str(tmp_path / k)) for k in ("gd", "qt"))
    for frame, options in ((p, {"partitioning": "qt", "leaves": leaves}), (gd, {"n": 6, "prepartitioned": True}), (qt, {"partitioning": "qt", "leaves": leaves, "prepartitioned": True})):
        for seed in engine.SEEDS:
            same(engine.Query(frame, q, 4, seed=seed, about=about, **options).answer(), nearest(rows, query, 4))
    plan = engine.Query(gd, q, 4, n=6, prepartitioned=True).within(spark.createDataFrame([(7, 1 / 6, 1 / 6, 1 / 6, 1)], "cell long, x0 double, y0 double, ds double, n long"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(cell,7)" in text.replace(" ", "") and "GreaterThanOrEqual(x," in text
    for bad in ({"prepartitioned": True}, {"partitioning": "qt", "prepartitioned": True}):
        with pytest.raises(ValueError):
            engine.Query(p if "partitioning" not in bad else qt, q, 4, **bad)


def test_points_are_not_shuffled(spark):
    rng = random.Random(13)
    p, q = points(spark, [(i, rng.random(), rng.random()) for i in range(500)]), queries(spark, [(0.5, 0.5), (0.4, 0.6)])
    plan = engine.brute_force(p, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("MapInArrow") :]
    context = spark.sparkContext
    for partitioning, most in (("gd", 20), ("qt", 30)):
        context.setJobGroup(f"jobs {partitioning}", "")
        engine.Query(p, q, 3, partitioning, n=10, capacity=50).run()
        context.setLocalProperty("spark.jobGroup.id", None)
        assert len(context.statusTracker().getJobIdsForGroup(f"jobs {partitioning}")) <= most


def test_sums_are_given_up_early():
    rng = np.random.default_rng(5)
    chunk = queryset.Chunk(rng.random(500), rng.random(500), np.ones(500))
    x, y = rng.random(200), rng.random(200)
    places, every = queryset.sums(x, y, [chunk])
    assert len(places) == 200 and every == pytest.approx([sum(math.hypot(a - c, b - d) for c, d in zip(chunk.x, chunk.y)) for a, b in zip(x, y)])
    bound = float(np.sort(every)[20])
    places, few = queryset.sums(x, y, [chunk], bound)
    assert set(places) == set(np.flatnonzero(every <= bound)) and few == pytest.approx(every[places])


def test_run_metrics(spark):
    rng = random.Random(14)
    rows = [(i, rng.random(), rng.random()) for i in range(400)]
    config = engine.Query(points(spark, rows), queries(spark, [(0.5, 0.5), (0.52, 0.48)]), 3, method="ps", n=10)
    row = config.metrics().first().asDict()
    assert row["dpc_count"] + row["sumdx"] == row["survivors_points"] and row["sumdx"] == row["sumdx_success"] + row["sumdist"] + row["skipped_tpoints"]
    assert all(row[f"{step}_millis"] >= 0 for step in ("summary", "partition", "seeds", "first", "pruning", "second"))
    assert config.run() is config.run()


def test_nothing_comes_to_the_driver_where_nothing_is_small(spark, monkeypatch):
    """With all bounds at 0 every table stays in the cluster, and the rows are the same."""
    rng = random.Random(15)
    rows = [(i, rng.random() ** 2, rng.random()) for i in range(300)]
    query = [(0.2, 0.5), (0.25, 0.45), (0.3, 0.6)]
    p, q = points(spark, rows), queries(spark, query)
    wanted = tree_by_recursion(rows, 20, 5), tree_by_recursion(rows, 20, 5, "all_children")
    wide = {r["cell"]: r["n"] for r in quadtree.leaf_table(p, quadtree.internal_nodes(p, 20, "average_width", 5), 5).collect()}
    for module, name in ((tables, "BROADCAST_ROWS"), (tables, "LISTED"), (engine, "LISTED")):
        monkeypatch.setattr(module, name, 0)
    for kind, expected in zip(quadtree.KINDS, (*wanted, wide), strict=True):
        inner = quadtree.internal_nodes(p, 20, kind, 5)
        assert not tables.held(inner)
        assert {r["cell"]: r["n"] for r in quadtree.leaf_table(p, inner, 5).collect()} == expected
    inner = quadtree.internal_nodes(p, 20, "capacity", 5)
    assert {r["cell"] for r in quadtree.assign(p, inner, 5).collect()} == {c for c, n in wanted[0].items() if n}
    for partitioning, method, seed in (("gd", "bf", "mbr"), ("qt", "ps", "centroid")):
        same(engine.Query(p, q, 4, partitioning, method, seed, n=6, capacity=20, max_depth=5).answer(), nearest(rows, query, 4))


def test_large_query_sets_sum_few_points(spark):
    """Points near their centre of gravity are summed, others ruled out by condensed chunks; copies of a place tie and go by id."""
    rng = np.random.default_rng(5)
    qx, qy = rng.uniform(0.4, 0.6, 6000), rng.uniform(0.3, 0.6, 6000)
    x, y = np.repeat(rng.uniform(0, 1, 2000), 3), np.repeat(rng.uniform(0, 1, 2000), 3)
    ids = rng.permutation(6000)
    dist = np.array([np.sqrt((a - qx) ** 2 + (b - qy) ** 2).sum() for a, b in zip(x, y, strict=True)])
    chunk = queryset.Chunk(qx, qy, np.ones(6000))
    for side in range(len(queryset.SIDES)):
        low = queryset._each(x, y, *chunk.coarse[side])
        assert (low <= dist * (1 + 1e-12)).all() and (side == 0 or (low >= before * (1 - 1e-12)).all())
        before = low
    bound = np.sort(dist)[20]
    places, _ = queryset.able(x, y, [chunk], bound)
    assert set(np.flatnonzero(dist <= bound)) <= set(places.tolist()) and len(places) < 60
    points = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), y.tolist(), strict=True)), "id long, x double, y double")
    query = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(qx.tolist(), qy.tolist(), strict=True))], "qid long, qx double, qy double")
    expected = sorted(zip((d.round(6) for d in dist), ids.tolist(), strict=True))[:10]
    for found in (engine.brute_force(points, query, 10), *(engine.Query(points, query, 10, p, m, n=10, capacity=300).answer() for p, m in (("gd", "bf"), ("qt", "ps")))):
        assert [(round(r["dist"], 6), r["id"]) for r in found.collect()] == [(round(d, 6), i) for d, i in expected]
    summed = engine.evaluate.nearest(points, query, 10).where("id is null").selectExpr("sum(summed)").first()[0]
    assert summed < 600
