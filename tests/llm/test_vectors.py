import math

import numpy as np
import pytest

from nearfold.llm import vectors


def brute(rows, cosine=0.9):
    """(n_links, component) for each row by comparing all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    n = len(rows)
    links = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                links[a, b] = links[b, a] = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine
    root = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in np.flatnonzero(links[a]):
                if root[b] < root[a]:
                    root[a], changed = root[b], True
    return sorted(((i, int(links[k].sum()), root[k], i is None or root[k] == i) for k, (i, _) in enumerate(rows)), key=str)


def clustered(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = [(k, (centres[rng.integers(6)] + rng.normal(size=dims) * rng.choice([0.05, 0.3, 0.5])).astype(np.float32).tolist()) for k in range(n)]
    return rows + [(n + k, rows[3][1]) for k in range(15)] + [(n + 20, [2 * x for x in rows[3][1]]), (n + 21, [-x for x in rows[3][1]])]


@pytest.mark.parametrize("block_rows,leaf", [(37, 8), (None, 192)])
def test_equals_all_pairs(spark, monkeypatch, block_rows, leaf):
    rows = clustered(1, 260, 12)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    if leaf != vectors.LEAF:
        monkeypatch.setattr(vectors, "LEAF", leaf)
    found = vectors.near_duplicates(df, 0.9, block_rows)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1e-30, 0.0]), (10, [1e30, 0.0]), (11, [-1.0, 0.0]), (None, [1.0, 0.0]),
        (1, [1.0, 0.0]), (12, [0.0, 0.0, 1.0]),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n int")
    found = {r["vec_id"]: tuple(r)[1:] for r in vectors.near_duplicates(df).collect()}
    assert found[1] == (3, 1, True) and found[9] == (3, 1, False) and found[10] == (3, 1, False)
    for k in (2, 3, 4, 5, 6, 7, 8, 11, 12):
        assert found[k] == (0, k, True)
    assert found[None] == (0, None, True)
    assert vectors.near_duplicates(df).count() == len(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    assert vectors.near_duplicates(df.where("vec_id = 2")).collect()[0]["component_id"] == 2


def test_query_equals_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    links = (x @ x.T >= 0.9).sum(axis=1) - 1
    found = {r["vec_id"]: r["n_links"] for r in vectors.op9_embeddings(spark, "/root/testdata/sf0.001").collect()}
    assert found == {i: int(n) for (i, _), n in zip(rows, links)}


def test_a_very_long_vector_among_others(spark):
    """One row of 60,000 components, and lengths that take turns, change nothing for the rest."""
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=(3, 5, 8)[k % 3]).tolist()) for k in range(90)] + [(200, rng.normal(size=60_000).tolist())]
    rows += [(201, rows[90][1]), (202, [3 * x for x in rows[0][1]])]
    for block_rows in (None, 20):
        found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9, block_rows)
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
