"""Exact ranks and percentiles; neighbours against all pairs; the map."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators.neighbours import nearest_neighbours, neighbour_map, recall
from quire.operators.order import percentiles, ranked, ranked_in


def test_ranks_of_hot_groups(spark):
    rows = [("a" if i % 3 else None if i % 2 else "b", i % 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    assert [(r.i, r["rank"]) for r in ranked(df, "x", "i").orderBy("rank").collect()] == [(i, n) for n, (_, i) in enumerate(sorted((x, i) for _, x, i in rows))]
    got = {(r.g, r.i): (r["rank"], r.n) for r in ranked_in(df, ["g"], "x", "i", size="n").collect()}
    for g in ("a", "b", None):
        mine = sorted((x, i) for h, x, i in rows if h == g)
        assert [got[g, i] for _, i in mine] == [(n, len(mine)) for n in range(len(mine))]


@pytest.mark.parametrize("by", [["g"], []])
def test_percentiles(spark, by):
    r = np.random.default_rng(1)
    rows = [("hot" if i % 3 else None if i % 2 else "few", None if i % 11 == 0 else float(v)) for i, v in enumerate(r.integers(0, 400, 4000))] + [("one", 5.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    got = {tuple(x[c] for c in by): (x.n, x.q) for x in percentiles(df, by, "v", at).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault((g,) if by else (), []).append(v)
    assert got.keys() == groups.keys()
    for g, v in groups.items():
        assert got[g][0] == len(v) and got[g][1] == pytest.approx(list(np.quantile(v, at)))
    same = df.where("v IS NOT NULL").groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q")).collect()
    assert {tuple(x[c] for c in by): x.q for x in same} == {g: q for g, (_, q) in got.items()}
    assert percentiles(df.limit(0), by, "v", at).collect() == []


def true_neighbours(ids, v, k):
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return {i: [ids[j] for j in np.lexsort((ids, row))[:k]] for i, row in zip(ids, d, strict=True)}


def test_recall_and_reruns_on_the_embeddings(spark):
    """Recall of fifteen neighbours against all pairs is 0.9 or more; two runs give the same rows."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = nearest_neighbours(e, 15, key="vec_id")
    rows = e.collect()
    true = true_neighbours(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows]), 15)
    pairs = spark.createDataFrame([(int(i), int(j)) for i, near in true.items() for j in near], "id long, neighbour long")
    assert recall(found, pairs) >= 0.9
    few = e.where("vec_id < 300").repartition(3)
    a, b = (sorted(map(tuple, nearest_neighbours(x, 5, key="vec_id", leaf=30, trees=3).collect())) for x in (few, few.repartition(8)))
    assert a == b


def test_exact_in_one_leaf_copies_and_odd_vectors(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((40, 3))
    rows = [(i, [float(x) for x in v[i]]) for i in range(40)] + [(100 + i, [9.0, 9.0, 9.0]) for i in range(30)]
    odd = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, math.nan, 2.0]), (203, [1.0, 2.0]), (204, [math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "paper_id long, embedding array<double>")
    got = {}
    for x in nearest_neighbours(df, 4, leaf=100, rounds=0).orderBy("id", "rank").collect():
        got.setdefault(x.id, []).append(x.neighbour)
    ids, every = np.array([i for i, _ in rows]), np.array([e for _, e in rows])
    assert got == {int(i): [int(j) for j in near] for i, near in true_neighbours(ids, every, 4).items()}
    assert nearest_neighbours(df.limit(0), 4).collect() == []


def test_map_keeps_neighbours_near(spark):
    r = np.random.default_rng(4)
    centres = r.standard_normal((4, 8)) * 20
    rows = [(i, [float(x) for x in centres[i % 4] + r.standard_normal(8)], float(r.standard_normal()), float(r.standard_normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "paper_id long, embedding array<double>, x double, y double")
    graph = nearest_neighbours(df, 8, leaf=60, trees=4).cache()
    start = df.select(F.col("paper_id").alias("id"), "x", "y")
    a, b = (neighbour_map(graph, s, rounds=15).orderBy("id").toPandas() for s in (start, start.repartition(5)))
    assert a.equals(b)
    xy = a[["x", "y"]].to_numpy()
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    same = np.equal.outer(np.arange(200) % 4, np.arange(200) % 4) & ~np.eye(200, dtype=bool)
    before = np.array([x[2:] for x in rows])
    first = np.sqrt(((before[:, None] - before[None]) ** 2).sum(-1))
    assert d[same].mean() / d[~same].mean() < 0.6 * first[same].mean() / first[~same].mean()
