"""Linear quadtrees: a tree is a table of prefixes, built by counting instead of recursion.

A node is internal if it holds more than ``capacity`` points (plus the rules of the other kinds) and lies above ``max_depth``. Counts never grow
downwards, so internal prefixes are closed under ancestors and a point's leaf is the first of its prefixes that isn't
internal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.geometry import quad_address, quad_bounds
from nearfold.operators import quadcount
from nearfold.operators.tables import held, listed, local, small
from nearfold.sources.points import valid

KINDS = ("capacity", "all_children", "average_width")
MAX_DEPTH = 10
#: Leaves of a tree that is written as one string.
MOST_SHAPE = 20_000_000


def addresses(points: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(address, n): points by their full address, 4^max_depth rows at most. Trees are counted, and points located, on these rows, on the driver if they are few (``quadcount``)."""
    return valid(points).groupBy(quad_address(F.col("x"), F.col("y"), max_depth).alias("address")).agg(F.count("*").alias("n"))


def prefix_counts(counted: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(prefix, n) of all nodes that hold points, from the root "" to depth max_depth - 1; counted: ``addresses``."""
    levels = counted.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_depth - 1)), lambda d: F.substring("address", F.lit(1), d))).alias("prefix"))
    return levels.groupBy("prefix").agg(F.sum("n").alias("n"))


def internal_nodes(points: DataFrame, capacity: int, kind: str = "capacity", max_depth: int = MAX_DEPTH) -> DataFrame:
    """(prefix) of the nodes that are split.

    capacity: more than ``capacity`` points. all_children: if one of four siblings is, all four are. average_width: also every node wider
    than the mean of the distinct leaf widths of the capacity tree.
    """
    return internal_of(local(addresses(points, max_depth), 4**max_depth), capacity, kind, max_depth)


def internal_of(counted: DataFrame, capacity: int, kind: str = "capacity", max_depth: int = MAX_DEPTH) -> DataFrame:
    """The same from ``addresses``; a table of prefixes that is read again and again, so it is computed once."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    if held(counted):
        split = quadcount.Counted.of(counted, max_depth).split(capacity, kind)
        found = local(counted.sparkSession.createDataFrame([(p,) for p in quadcount.names(split)], "prefix string"), sum(map(len, split)))
        found._nearfold_split = split
        return found
    crowded = local(prefix_counts(counted, max_depth).where(F.col("n") > capacity).select("prefix"))
    if kind == "capacity":
        return crowded
    if kind == "all_children":
        below = crowded.where("prefix <> ''").select(F.expr("substring(prefix, 1, length(prefix) - 1)").alias("parent")).distinct()
        family = below.select(F.explode(F.array(*[F.concat("parent", F.lit(d)) for d in "0123"])).alias("prefix"))
        return local(crowded.where("prefix = ''").unionByName(family))
    mean = leaves_of(crowded, max_depth).select(F.pow(F.lit(0.5), F.length("cell")).alias("w")).distinct().agg(F.avg("w")).first()[0]
    wide = [d for d in range(max_depth) if 0.5**d > mean]
    spark = counted.sparkSession
    complete = [spark.range(4**d).select(_address_of(F.col("id"), d).alias("prefix")) for d in wide]
    for level in complete:
        crowded = crowded.unionByName(level)
    return local(crowded.distinct())


def internal_of_leaves(leaves: DataFrame) -> DataFrame:
    """(prefix) of the nodes that are split, from a stored leaf table (cell, ...): every proper prefix of a leaf."""
    above = F.explode(F.transform(F.sequence(F.lit(0), F.length("cell") - 1), lambda d: F.substring("cell", F.lit(1), d)))
    return local(leaves.where("cell <> ''").select(above.alias("prefix")).distinct())


def _address_of(number, depth: int):
    """A node's number within its level as base-4 digits."""
    return F.lpad(F.conv(number.cast("string"), 10, 4), depth, "0") if depth else F.lit("")


def leaves_of(internal: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(cell) of all leaves, empty ones too; the root if nothing is split."""
    if hasattr(internal, "_nearfold_split"):
        return internal.sparkSession.createDataFrame([(c,) for c in quadcount.names(quadcount.leaves(internal._nearfold_split))], "cell string")
    children = internal.select(F.explode(F.array(*[F.concat("prefix", F.lit(d)) for d in "0123"])).alias("cell"))
    found = children.join(internal, children["cell"] == internal["prefix"], "left_anti")
    alone = internal.agg(F.count("*").alias("k")).where("k = 0").select(F.lit("").alias("cell"))
    return found.unionByName(alone)


def _deepest(internal: DataFrame) -> int:
    found = internal.agg(F.max(F.length("prefix"))).first()[0]
    return -1 if found is None else found


def _leaf(located: DataFrame, internal: DataFrame) -> DataFrame:
    """located (address, ...) with ``cell``, the leaf of the address: as many digits as prefixes of it are split.

    A short list of split nodes is looked up in place; a longer one by one hash join for each level that is split at all.
    """
    rows = listed(internal)
    if rows is not None:
        known = [r["prefix"] for r in rows]
        by_level = {d: [p for p in known if len(p) == d] for d in sorted({len(p) for p in known})}
        depth = sum((F.substring("address", 1, d).isin(level).cast("int") if d else F.lit(1) for d, level in by_level.items()), F.lit(0))
        return located.withColumn("__d", depth).withColumn("cell", F.expr("substring(address, 1, __d)")).drop("__d")
    nodes = small(internal)
    located = located.withColumn("__d", F.lit(0))
    for depth in range(_deepest(internal) + 1):
        hit = nodes.select(F.col("prefix").alias(f"__p{depth}"))
        located = located.join(hit, F.substring("address", 1, depth) == F.col(f"__p{depth}"), "left")
        located = located.withColumn("__d", F.col("__d") + F.col(f"__p{depth}").isNotNull().cast("int")).drop(f"__p{depth}")
    return located.withColumn("cell", F.expr("substring(address, 1, __d)")).drop("__d")


def locate(points: DataFrame, internal: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Points with the address of their leaf. For a long list of split nodes the different addresses are located, not the points, and joined to them."""
    placed = valid(points).withColumn("address", quad_address(F.col("x"), F.col("y"), max_depth))
    if listed(internal) is not None:
        return _leaf(placed, internal).drop("address")
    return placed.join(_leaf(addresses(points, max_depth).select("address"), internal), "address").drop("address")


def assign(points: DataFrame, internal: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    return locate(points, internal, max_depth)


def within(points: DataFrame, cells: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The points whose leaf is among ``cells`` (cell): one comparison, or semi-join, for each depth of those leaves."""
    rows = listed(cells)
    known = None if rows is None else [r["cell"] for r in rows]
    depths = sorted({len(c) for c in known} if known is not None else {r[0] for r in cells.select(F.length("cell").alias("d")).distinct().collect()})
    placed = points.withColumn("__a", quad_address(F.col("x"), F.col("y"), max(depths, default=0)))
    found = F.lit(False)
    for d in depths:
        if known is not None:
            found = found | F.substring("__a", 1, d).isin([c for c in known if len(c) == d])
            continue
        own = cells.select(F.col("cell").alias(f"__c{d}")).where(F.length(f"__c{d}") == d)
        placed = placed.join(small(own), F.substring("__a", 1, d) == F.col(f"__c{d}"), "left")
        found = found | F.col(f"__c{d}").isNotNull()
    return placed.where(found).select(*points.columns)


def with_bounds(cells: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    x0, y0, ds = quad_bounds(F.col("cell"), max_depth)
    return cells.withColumn("x0", x0).withColumn("y0", y0).withColumn("ds", ds)


def counts(counted: DataFrame, internal: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(cell, n) for each leaf that holds points, from ``addresses``."""
    if held(counted) and hasattr(internal, "_nearfold_split"):
        found = quadcount.Counted.of(counted, max_depth).cells(internal._nearfold_split)
        return counted.sparkSession.createDataFrame(list(found.items()), "cell string, n long")
    return _leaf(counted, internal).groupBy("cell").agg(F.sum("n").alias("n"))


def histogram(points: DataFrame, internal: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """cell, x0, y0, ds, n for each leaf that holds points."""
    return with_bounds(counts(local(addresses(points, max_depth), 4**max_depth), internal, max_depth), max_depth)


def leaf_table(points: DataFrame, internal: DataFrame, max_depth: int = MAX_DEPTH, counted: DataFrame | None = None) -> DataFrame:
    """cell, depth, x0, y0, ds, n for every leaf, empty ones with n = 0. counted: ``addresses`` of the points, if known."""
    counted = counts(local(addresses(points, max_depth), 4**max_depth) if counted is None else counted, internal, max_depth)
    filled = leaves_of(internal, max_depth).join(counted, "cell", "left").fillna(0, ["n"])
    return with_bounds(filled.withColumn("depth", F.length("cell")), max_depth).select("cell", "depth", "x0", "y0", "ds", "n")


def shape(leaves: DataFrame) -> DataFrame:
    """One string for the whole tree: 1 for a split node, 0 for a leaf, parents first, in the order NW, NE, SW, SE.

    The order of addresses as strings is that pre-order. One row by definition; leaves (cell) are tree metadata, not points, and more than ``MOST_SHAPE`` are an error.
    """
    if leaves.count() > MOST_SHAPE:
        raise ValueError(f"the tree has more than {MOST_SHAPE} leaves; write its leaf table instead")
    inner = leaves.where("cell <> ''").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.length("cell") - 1), lambda d: F.substring("cell", F.lit(1), d))).alias("cell")
    ).distinct()
    nodes = leaves.select("cell", F.lit("0").alias("mark")).unionByName(inner.select("cell", F.lit("1").alias("mark")))
    ordered = F.array_sort(F.collect_list(F.struct("cell", "mark")))
    return nodes.agg(F.array_join(F.transform(ordered, lambda s: s["mark"]), "").alias("shape"))
