"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The documents of a source, in a seeded order, form one stream of words that is cut into blocks of
``block_words``. The mix is a house of seats, one block each; seats go to sources by highest quotient
target / (2 k + 1), where targets share the mix by weight up to each source's cap. Divisor methods are house monotone, so
consecutive runs of seats give each output shard an integer quota of every source. The quotas of a source, one after the other, are a line
that passes over its stream again and again: shard 0 gets the first blocks of the line, the last shard the last ones, and the
line ends within the last pass. So a pass selects blocks in the seeded order, and at most one document is cut at the end of each quota.
Sources of fewer than ``FINE`` blocks have a house of their own, with blocks of one word, so they too come near their targets.

Only per-source totals (checked against ``MOST_SOURCES``) reach the driver. Positions in a stream are distributed running totals over
narrow rows; from them come the few documents at which a quota ends, a row for each source and shard, and every other document is
whole in a quota or out of it by its place in the seeded order alone. So texts are never shuffled, and no source meets in one task.

Cases: null text has size 0 and is never taken; a null source is a source of its own, last in order; rows that share their place in the order (repeated
rows do) share a cut between them in proportion, rounded down; an empty table gives no rows; extra columns pass through ``mix``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import group_key, keep, running_totals, small
from nearfold.llm.sharding import seeded

MOST_SOURCES = 100_000
BLOCK_WORDS, FINE = 64, 1000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checksum(text: Column) -> Column:
    """The CRC-32 of a text, null taken as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def water_fill(weights: Sequence[float], caps: Sequence[float], total: float) -> list[float]:
    """Shares of ``total`` by weight, none above its cap; what a cap cuts off is shared again by weight."""
    shares, open_ = [0.0] * len(weights), list(range(len(weights)))
    left = float(total)
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / weight > caps[k]]
        if not over:
            for k in open_:
                shares[k] = left * weights[k] / weight
            break
        for k in over:
            shares[k] = float(caps[k])
        left -= sum(caps[k] for k in over)
        gone = set(over)
        open_ = [k for k in open_ if k not in gone]
    return shares


def sainte_lague(weights: Sequence[float], caps: Sequence[int], house: int) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), at most caps[i] each; equal quotients go to the earlier source."""
    house = min(house, sum(caps))

    def seats(divisor: float) -> list[int]:
        return [min(c, int(w / divisor + 0.5)) for w, c in zip(weights, caps, strict=True)]

    low, high = 0.0, 2.0 * max(weights, default=1.0) + 1.0  # at high nobody has a seat
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if sum(seats(middle)) > house else (low, middle)
    given = seats(high)
    queue = [(-w / (2 * g + 1), k) for k, (w, g, c) in enumerate(zip(weights, given, caps, strict=True)) if g < c]
    heapq.heapify(queue)
    while sum(given) < house and queue:
        for _ in range(house - sum(given)):
            if not queue:
                break
            _, k = heapq.heappop(queue)
            given[k] += 1
            if given[k] < caps[k]:
                heapq.heappush(queue, (-weights[k] / (2 * given[k] + 1), k))
    return given


def plan(sizes: dict[str | None, int], pattern: Sequence[float], share: float, most: float, block_words: int, n_shards: int) -> list[dict]:
    """For each source: its target and, for each shard, how many words of its line lie before the shard's end."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = [float(pattern[k % len(pattern)]) for k in range(len(names))]
    caps = [most * sizes[s] for s in names]
    targets = water_fill(weights, caps, share * sum(sizes.values()))
    ends: list[list[int]] = [[0] * n_shards for _ in names]
    for unit, own in ((block_words, [k for k, s in enumerate(names) if sizes[s] >= FINE * block_words]), (1, [k for k, s in enumerate(names) if sizes[s] < FINE * block_words])):
        house = round(sum(targets[k] for k in own) / unit)
        limits = [int(caps[k]) // unit for k in own]
        for j in range(n_shards):
            for k, seats in zip(own, sainte_lague([targets[k] for k in own], limits, house * (j + 1) // n_shards), strict=True):
                ends[k][j] = seats * unit
    return [
        {
            "__s": "n" if name is None else f"v{name}", "source_size": sizes[name], "target": target,
            "ends": [{"i": j, "pass": e // sizes[name] if sizes[name] else 0, "at": e % sizes[name] if sizes[name] else 0} for j, e in enumerate(end)],
        }
        for name, target, end in zip(names, targets, ends, strict=True)
    ]


PLAN = "__s string, source_size long, target double, ends array<struct<i: int, pass: long, at: long>>"
#: The columns that mix() adds; columns of these names in its input are replaced.
ADDED = ("source_size", "target", "spans", "taken")


def _cuts(narrow: DataFrame, pattern: Sequence[float], share: float, most: float, block_words: int, n_shards: int) -> DataFrame:
    """(__s, source_size, target, __cuts): where each shard's part of a source's line ends. narrow: source, __s, __h, __n.

    A cut: the pass, the place in the seeded order, the words of that place before the cut, and all its words.
    """
    spark = narrow.sparkSession
    totals = narrow.groupBy("source").agg(F.sum("__n").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    planned = spark.createDataFrame(plan({r["source"]: r["n"] or 0 for r in totals}, pattern, share, most, block_words, n_shards), PLAN)
    ends = planned.select("__s", F.explode("ends").alias("e")).select("__s", "e.*")
    placed = running_totals(narrow.where("__n > 0").select("__s", "__h", "__n"), F.col("__s"), [F.col("__h")], F.col("__n"), "__at")
    inside = F.expr("filter(ends, e -> e.at > 0 and __at_before <= e.at and e.at < __at_before + __n)")
    hit = placed.join(F.broadcast(planned), "__s").select("__s", "__h", F.explode(inside).alias("e")).select("__s", "__h", F.col("e.at").alias("at")).distinct()  # planned: checked above
    hit = keep(hit)  # a row for each source and shard at most
    words = placed.join(small(hit.select("__s", "__h").distinct()), ["__s", "__h"], "left_semi").groupBy("__s", "__h").agg(F.min("__at_before").alias("start"), F.sum("__n").alias("words"))
    known = ends.join(hit.join(words, ["__s", "__h"]), ["__s", "at"], "left")
    one = F.struct(
        "i", "pass", F.coalesce("__h", F.lit("")).alias("h"), F.coalesce(F.col("at") - F.col("start"), F.lit(0).cast("long")).alias("before"), F.coalesce("words", F.lit(1).cast("long")).alias("words")
    )
    cuts = known.groupBy("__s").agg(F.array_sort(F.collect_list(one)).alias("__cuts"))
    return keep(planned.drop("ends").join(cuts, "__s"))


def _spans(size: Column, passes: int, n_shards: int) -> Column:
    """The parts of a document that the cuts of its source take: (pass, first, stop, shard), in words."""

    def before(cut: Column, turn: Column) -> Column:
        within = F.floor(cut["before"].cast("decimal(19,0)") * size.cast("decimal(19,0)") / cut["words"].cast("decimal(19,0)")).cast("long")
        out = F.when((turn < cut["pass"]) | ((turn == cut["pass"]) & (F.col("__h") < cut["h"])), size)
        return out.when((turn == cut["pass"]) & (F.col("__h") == cut["h"]), within).otherwise(F.lit(0).cast("long"))

    def part(turn: Column, j: Column) -> Column:
        first = F.when(j == 0, F.lit(0).cast("long")).otherwise(before(F.get("__cuts", j - 1), turn))
        return F.struct(turn.alias("pass"), first.alias("first"), before(F.get("__cuts", j), turn).alias("stop"), j.alias("shard"))

    shards = F.sequence(F.lit(0), F.lit(n_shards - 1))
    turns = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: F.filter(F.transform(shards, lambda j: part(p, j)), lambda x: x["first"] < x["stop"]))
    return F.flatten(turns)


def _keyed(rows: DataFrame, ties: Sequence[Column], seed: int) -> DataFrame:
    return rows.withColumn("__s", group_key(F.col("source"))).withColumn("__h", seeded(seed, *ties))


def mix(rows: DataFrame, size: str = "size", pattern: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, n_shards: int = 1, seed: int = 11, ties: Sequence[str] = ("doc_id",)) -> DataFrame:
    """rows (with source and a size in words) plus source_size, target, spans, taken. rows are read several times.

    spans: the parts of the document in the mix as (pass, first, stop, shard) in words; taken: the words in them.
    """
    rows = rows.drop(*ADDED)
    names = rows.columns
    keyed = _keyed(rows, [F.col(t) for t in ties], seed)
    cuts = _cuts(keyed.select("source", "__s", "__h", F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__n")), pattern, share, most, block_words, n_shards)
    spans = _spans(F.coalesce(F.col(size), F.lit(0)).cast("long"), math.ceil(most), n_shards)
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["first"])
    return keyed.join(small(cuts), "__s").withColumn("spans", spans).withColumn("taken", taken).select(*names, *ADDED)


def cut_words(text: Column, first: Column, stop: Column) -> Column:
    """Words first to stop of the text with the white space between them."""
    words = F.regexp_extract_all(text, F.lit(rf"({WORD})[\x20\x09-\x0D]*"), F.lit(0))
    return F.regexp_replace(F.array_join(F.slice(words, first.cast("int") + 1, (stop - first).cast("int")), ""), r"[\x20\x09-\x0D]+$", "")


def mixed_documents(docs: DataFrame, pattern: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, n_shards: int = 1, seed: int = 11) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each part of a document that is taken, with that part as its text.

    n_chars, if docs has it, is set for documents that are cut. Documents that aren't taken go.
    """
    names = docs.columns
    keyed = _keyed(docs, [F.col("doc_id"), checksum(F.col("text"))], seed)
    cuts = _cuts(keep(keyed.select("source", "__s", "__h", word_count(F.col("text")).alias("__n"))), pattern, share, most, block_words, n_shards)
    joined = keyed.join(small(cuts.select("__s", "__cuts")), "__s")
    # Only documents at which a quota ends need their number of words; of any other all words are taken, or none.
    at_cut = F.exists("__cuts", lambda x: x["h"] == F.col("__h"))
    words = F.when(at_cut, word_count(F.col("text"))).when(F.col("text").rlike(WORD), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    parts = joined.withColumn("__n", words).withColumn("__x", F.explode(_spans(F.col("__n"), math.ceil(most), n_shards)))
    whole = (F.col("__x.first") == 0) & (F.col("__x.stop") == F.col("__n"))
    out = parts.withColumn("__cut", F.when(~whole, cut_words(F.col("text"), F.col("__x.first"), F.col("__x.stop"))))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__cut").isNotNull(), F.length("__cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.coalesce("__cut", "text")).select(*names)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = keep(docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), checksum(F.col("text")).alias("crc")))
    return mix(rows, ties=("doc_id", "crc"), n_shards=16).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mixing": op5_mixing}
