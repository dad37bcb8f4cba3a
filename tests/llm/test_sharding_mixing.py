import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from nearfold.llm import mixing, sharding
from nearfold.llm.common import running_totals
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 5), k, rng.randint(0, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, k int, w long").repartition(7)
    found = running_totals(df, F.coalesce("g", F.lit("")), [F.col("o"), F.col("k")], F.col("w"), "t").collect()
    for r in found:
        own = [x for x in rows if x[0] == r["g"]]
        assert r["t_before"] == sum(x[3] for x in own if (x[1], x[2]) < (r["o"], r["k"])) and r["t_all"] == sum(x[3] for x in own)
    assert running_totals(df.limit(0), None, [F.col("k")], F.lit(1), "t").count() == 0


def interleaved(rows, n_shards, seed=7):
    """The method by sorting in one place; rows: (doc_id, source, crc)."""
    key = lambda r: (hashlib.md5("|".join([str(seed), *("" if x is None else str(x) for x in (r[0], r[2]))]).encode()).hexdigest(), -1 if r[0] is None else r[0], r[2])
    by_source = {}
    for r in rows:
        by_source.setdefault("n" if r[1] is None else "v" + r[1], []).append(r)
    spread = []
    for s, own in by_source.items():
        for k, r in enumerate(sorted(own, key=key)):
            spread.append(((k + 0.5) / len(own), hashlib.md5(s.encode()).hexdigest(), key(r), r))
    ordered = [x[-1] for x in sorted(spread, key=lambda x: x[:3])]
    base, more = divmod(len(ordered), n_shards)
    out, at = [], 0
    for shard in range(n_shards):
        size = base + (shard < more)
        out += [(r, shard, slot) for slot, r in enumerate(ordered[at : at + size])]
        at += size
    return out


@pytest.mark.parametrize("n_rows,n_shards", [(0, 4), (3, 16), (250, 16), (64, 1)])
def test_interleaving_equals_sorting(spark, n_rows, n_shards):
    rng = random.Random(n_rows)
    rows = [(k if k % 17 else None, rng.choice(["x", "x", "x", "y", None]), k * 7) for k in range(n_rows)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, crc long, shard int")
    found = sharding.interleave(df, n_shards, "source", ("doc_id", "crc"))
    assert found.columns == ["doc_id", "source", "crc", "shard", "slot"]
    assert sorted(map(str, (((r[0], r[1], r[2]), r[3], r[4]) for r in found.collect()))) == sorted(map(str, interleaved(rows, n_shards)))


def test_sharding_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    found = sharding.op4_sharding(spark, DATA).collect()
    expected = {r[0]: (shard, slot) for r, shard, slot in interleaved([(d["doc_id"], d["source"], zlib.crc32((d["text"] or "").encode())) for d in docs], 16)}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in found} == expected
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["law"] == "rows" and r["grown_shard"] is None for r in found)
    counts = Counter(r["shard"] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    by_source = Counter((d["source"]) for d in docs)
    source = {d["doc_id"]: d["source"] for d in docs}
    for s, n in by_source.items():
        each = Counter(r["shard"] for r in found if source[r["doc_id"]] == s)
        assert all(abs(each[k] - n / 16) <= 2 for k in range(16))


def test_write_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sharding.write_shards(sharding.interleave(docs, 4), str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("shard=*")) == [f"shard={k}" for k in range(4)]
    with pytest.raises(ValueError):
        sharding.interleave(docs, 0)


def naive_seats(weights, caps, house):
    given = [0] * len(weights)
    for _ in range(min(house, sum(caps))):
        k = max((k for k in range(len(weights)) if given[k] < caps[k]), key=lambda k: (weights[k] / (2 * given[k] + 1), -k))
        given[k] += 1
    return given


def test_apportionment():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 9)
        weights, caps = [float(rng.choice([5, 2, 1])) for _ in range(n)], [rng.choice([0, 3, 20, 10**6]) for _ in range(n)]
        for house in (0, 1, 7, 50, 300):
            assert mixing.sainte_lague(weights, caps, house) == naive_seats(weights, caps, house)
    assert mixing.sainte_lague([], [], 5) == []


def test_water_filling():
    assert mixing.water_fill([5, 2, 1], [100, 100, 100], 80) == [50, 20, 10]
    shares = mixing.water_fill([5, 2, 1, 5], [10, 100, 100, 30], 120)
    assert shares[0] == 10 and shares[3] == 30 and shares[1] == pytest.approx(80 * 2 / 3) and sum(shares) == pytest.approx(120)
    assert mixing.water_fill([], [], 0) == []


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long, crc long, passes long")


def targets_of(totals, pattern=(5, 2, 1), share=1.5, most=2.0):
    """Targets by filling all sources at one level, found by bisection."""
    names = sorted(n for n in totals if n is not None) + [None] * (None in totals)
    weight = {n: pattern[k % len(pattern)] for k, n in enumerate(names)}
    wanted, low, high = share * sum(totals.values()), 0.0, 1e15
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * totals[n], level * weight[n]) for n in names) < wanted else (low, level)
    return {n: min(most * totals[n], high * weight[n]) for n in names}


def walked(rows, quotas, seed=11):
    """What a line of so many words takes of each document, word by word through the source's stream, as (doc_id, crc, words)."""
    out = []
    for name, quota in quotas.items():
        own = sorted((r for r in rows if r[1] == name), key=lambda r: hashlib.md5(f"{seed}|{r[0]}|{r[3]}".encode()).hexdigest())
        stream = [k for k, r in enumerate(own) for _ in range(r[2])]
        took = Counter(stream[w % len(stream)] for w in range(quota)) if stream else Counter()
        out += [(r[0], r[3], took[k]) for k, r in enumerate(own)]
    return sorted(out)


def test_mix_equals_walking(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.choice([0, 1, 5, 40, 300]), k % 3, 1) for k in range(120)]
    for block_words in (8, 64):
        found = mixing.mix(sized(spark, rows), block_words=block_words, n_shards=3, ties=("doc_id", "crc")).collect()
        totals, taken, given = Counter(), Counter(), {}
        for r in found:
            totals[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            given[r["source"]] = r["target"]
            assert r["taken"] <= 2 * r["size"] and r["taken"] == sum(x["stop"] - x["first"] for x in r["spans"])
            assert all(0 <= x["shard"] < 3 and 0 <= x["first"] < x["stop"] <= r["size"] for x in r["spans"])
        assert given == pytest.approx(targets_of(totals))
        assert all(abs(taken[s] - given[s]) <= 2 and taken[s] <= 2 * totals[s] for s in totals)
        assert sorted((r["doc_id"], r["crc"], r["taken"]) for r in found) == walked(rows, taken)
        shards = Counter()
        for r in found:
            for x in r["spans"]:
                shards[r["source"], x["shard"]] += x["stop"] - x["first"]
        assert all(abs(shards[s, j] - taken[s] / 3) <= 2 for s in totals for j in range(3))
    assert mixing.mix(sized(spark, []), block_words=8).count() == 0


def test_sources_of_every_size_meet_their_targets(spark):
    sizes = {f"s{n:05d}": n for n in [*range(1, 301, 7), 2, 3, 17, 20, 21, 64, 65, 100, 299, 300]}
    rng, rows = random.Random(6), []
    for name, n in sizes.items():
        left = n
        while left:
            take = rng.randint(1, left)
            rows.append((len(rows), name, take, 0, 0))
            left -= take
    for pattern, share in (((5, 2, 1), 1.5), ((1,), 0.9), ((1, 50), 1.9)):
        taken, target = Counter(), {}
        for r in mixing.mix(sized(spark, rows), pattern=pattern, share=share, n_shards=4).collect():
            assert r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
        assert target == pytest.approx(targets_of(sizes, pattern, share))
        assert all(abs(taken[s] - t) <= 1.5 for s, t in target.items()), [(s, taken[s], t) for s, t in target.items() if abs(taken[s] - t) > 1.5]


def test_plan_of_a_very_large_source():
    planned = {p["__s"]: p for p in mixing.plan({"a": 10**12, "b": 10**15, "c": 50, None: 0}, (5, 2, 1), 1.5, 2.0, 64, 16)}
    for name, size in (("va", 10**12), ("vb", 10**15), ("vc", 50)):
        end = planned[name]["ends"][-1]
        assert abs(planned[name]["target"] - (end["pass"] * size + end["at"])) <= max(64, 1e-9 * size)
    assert planned["n"]["ends"] == [{"i": j, "pass": 0, "at": 0} for j in range(16)]


def test_repeated_rows_share_alike(spark):
    rows = [(1, "a", 10, 0, 0)] * 7 + [(2, "a", 3, 0, 0), (None, "a", 4, 0, 0), (None, "a", 4, 0, 0)]
    found = mixing.mix(sized(spark, rows), share=0.8, ties=("doc_id", "crc")).collect()
    assert len(found) == 10 and len({(r["doc_id"], r["taken"]) for r in found}) == 3
    assert abs(sum(r["taken"] for r in found) - 0.8 * 81) <= 7


def test_mixing_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    found = mixing.op5_mixing(spark, DATA).collect()
    assert {r["doc_id"]: r["size"] for r in found} == {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    taken, target = Counter(), {}
    for r in found:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = (r["target"], r["source_size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sum(t for t, _ in target.values()) == pytest.approx(1.5 * sum(s for _, s in target.values()))
    assert all(abs(taken[s] - t) <= 64 for s, (t, _) in target.items())
    assert {s: t for s, (t, _) in target.items()} == pytest.approx(targets_of({s: n for s, (_, n) in target.items()}))
    rows = [(d["doc_id"], d["source"], len(WORD.findall(d["text"] or "")), zlib.crc32((d["text"] or "").encode()), 0) for d in docs]
    assert sorted((r["doc_id"], r["taken"]) for r in found) == sorted((d, n) for d, _, n in walked(rows, taken))
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.op5_mixing(spark, DATA).collect()))


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    originals = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
        assert all(part in originals[r["doc_id"]] for part in r["text"].split("\n"))
    placed = mixing.mix(docs.withColumn("size", mixing.word_count(F.col("text"))).withColumn("crc", F.crc32(F.col("text").cast("binary"))), ties=("doc_id", "crc")).collect()
    assert {r["doc_id"]: r["taken"] for r in placed if r["taken"]} == dict(words)
    odd = spark.createDataFrame([(1, None, None), (2, "", "s"), (2, "", "s"), (None, "a b c", None)], "doc_id long, text string, source string")
    assert sorted(r["text"] for r in mixing.mixed_documents(odd).collect()) == ["a", "a b c"]
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_cut_words(spark):
    frame = spark.createDataFrame([(" a  b\tc\nd e ", 0, 3), (" a  b\tc\nd e ", 3, 5), ("\u00a0x y\u2003z", 0, 1), ("q", 0, 1)], "text string, first long, stop long")
    found = frame.select(mixing.cut_words(F.col("text"), F.col("first"), F.col("stop")).alias("x")).collect()
    assert [r["x"].strip(" ") for r in found] == ["a  b\tc", "d e", "\u00a0x", "q"]


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 5, "x"), (2, "d e", "s", 3, "y")], "doc_id long, text string, source string, target long, spans string")
    mixed = mixing.mixed_documents(docs, share=0.5)
    assert mixed.columns == docs.columns and mixed.count() >= 1
    assert mixing.mix(docs.withColumn("size", mixing.word_count(F.col("text")))).columns[:4] == ["doc_id", "text", "source", "size"]
