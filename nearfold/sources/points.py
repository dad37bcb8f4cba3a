"""Point sets: schemas, text and parquet input, samples, and the derived sets that the queries use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.functions.geometry import in_unit_square

POINT = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
QUERY_POINT = T.StructType([T.StructField("qid", T.LongType()), T.StructField("qx", T.DoubleType()), T.StructField("qy", T.DoubleType())])
SUMMARY = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "xmax", "ymin", "ymax", "xc", "yc", "sum_dist_cq")])
NEIGHBOR = T.StructType([T.StructField("id", T.LongType()), T.StructField("dist", T.DoubleType())])
#: What Java's trim() takes off, as far as it occurs in lines of text.
BLANK = " \t\r"


def parse_points(lines: DataFrame, separator: str = "\t", column: str = "value") -> DataFrame:
    """Lines "id x y" to points. More fields are ignored; a short, blank or malformed line fails the query."""
    # Literal separators need no regular expression; split() takes one, so special characters are quoted.
    fields = F.split(F.btrim(F.col(column), F.lit(BLANK)), rf"\Q{separator}\E")
    return lines.select(fields[0].cast("long").alias("id"), fields[1].cast("double").alias("x"), fields[2].cast("double").alias("y"))


def read_points(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """Points from text files."""
    return parse_points(spark.read.text(path), separator)


def read_query_points(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """The small set, with its own column names so that both sets join without clashes."""
    return as_query(read_points(spark, path, separator))


def as_query(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A summary that was written as one line of seven tab-separated numbers."""
    return spark.read.schema(SUMMARY).option("sep", "\t").option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).csv(path)


def read_leaves(spark: SparkSession, path: str) -> DataFrame:
    """A quadtree's leaf table from parquet."""
    return spark.read.parquet(path)


def valid(points: DataFrame) -> DataFrame:
    """Points of the unit square with an id; others can't be placed in a cell."""
    return points.where(F.col("id").isNotNull() & in_unit_square(F.col("x"), F.col("y")))


def rejected(points: DataFrame) -> DataFrame:
    """The points that ``valid`` leaves out."""
    return points.where(~(F.col("id").isNotNull() & in_unit_square(F.col("x"), F.col("y"))))


def normalize(points: DataFrame) -> DataFrame:
    """Scale coordinates into [0, 1) by the set's own bounds, the same factor for both axes."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    scale = F.when(side > 0, F.lit(1 - 2.0**-40) / side).otherwise(0.0)
    joined = points.crossJoin(F.broadcast(box))  # one row
    return joined.select("id", ((F.col("x") - F.col("x0")) * scale).alias("x"), ((F.col("y") - F.col("y0")) * scale).alias("y"))


def sample(points: DataFrame, rate: int, seed: int | None = 0) -> DataFrame:
    """Each point with probability rate percent; with seed None, by id, so that any engine draws the same."""
    if not 0 <= rate <= 100:
        raise ValueError("rate is a percentage")
    return points.where(F.pmod(F.col("id"), F.lit(100)) < rate) if seed is None else points.sample(False, rate / 100, seed)


def one_each(points: DataFrame) -> DataFrame:
    """One row for each id: of several the one with the least coordinates."""
    least = points.groupBy("id").agg(F.min(F.struct("x", "y")).alias("at"))
    return least.select("id", "at.x", "at.y")


def _days(column: str) -> Column:
    return F.datediff(F.col(column), F.lit("1994-12-31").cast("date"))


def orders_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points: total price across, order day up."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").cast("long").alias("id"), (F.col("o_totalprice") / F.lit(500000.0)).alias("x"), (_days("o_orderdate") / F.lit(2500.0)).alias("y"))


def events_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: time across, value up; most lie near the lower edge."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)
    return events.select(F.col("event_id").cast("long").alias("id"), ((seconds - 1704067200.0) / F.lit(2678400.0)).alias("x"), ((F.col("value") + 1) / F.lit(602.0)).alias("y"))


def customer_queries(spark: SparkSession, sf_dir: str, last: int | None = 200) -> DataFrame:
    """Customers up to a key as query points in the middle of the square: some two hundred (set Q1 of FIXTURES.md), or all with None."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    customers = customers if last is None else customers.where(F.col("c_custkey") <= last)
    x = (F.col("c_acctbal") + 1000) / F.lit(11000.0) * F.lit(0.2) + F.lit(0.4)
    y = ((F.col("c_custkey") * 37) % 101 + F.lit(0.5)) / F.lit(101.0) * F.lit(0.2) + F.lit(0.4)
    return customers.select(F.col("c_custkey").cast("long").alias("qid"), x.alias("qx"), y.alias("qy"))
