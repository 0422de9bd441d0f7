"""Layout by component, shelves, and communities of large components."""

import math
import random

import numpy as np
import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from quire.operators import drawing, graph
from quire.plans import graphs
from quire.plans.catalog import ORACLE_SQL, QUERIES
from quire.plans.registry import Tables


def test_shelf_packing(spark, sf):
    same_rows(spark, QUERIES["shelf_packing"], ORACLE_SQL["shelf_packing"], sf)


@pytest.mark.parametrize("seed", range(3))
def test_boxes_do_not_overlap(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([1, 1, 1, 2, 3, 9, 50, 400][: 4 + seed * 2])) for i in range(300)]
    got = drawing.pack_shelves(spark.createDataFrame(rows, "id long, n long")).collect()
    assert sorted((x.id, x.n) for x in got) == rows
    box = np.array([(x.left, x.top, x.left + max(math.sqrt(x.n), 1), x.top + max(math.sqrt(x.n), 1)) for x in got])
    # Shelves go down: a box stands on top with its height upwards, and the highest of a shelf is its first.
    for i in range(len(box)):
        meets = (box[:, 0] < box[i, 2] - 1e-9) & (box[i, 0] < box[:, 2] - 1e-9) & (box[:, 1] < box[i, 3] - 1e-9) & (box[i, 1] < box[:, 3] - 1e-9)
        assert meets.sum() == 1


def drawn(spark, edges, vertices, **more):
    e = spark.createDataFrame(edges, "u long, v long, weight double")
    v = spark.createDataFrame([(i,) for i in vertices], "id long")
    return drawing.component_layout(e, v, **more).orderBy("id").toPandas()


def grid(n, at=0):
    """Edges of an n x n grid."""
    return [(at + i * n + j, at + i * n + j + d, 1.0) for i in range(n) for j in range(n) for d in (1, n) if (d == 1 and j + 1 < n) or (d == n and i + 1 < n)]


def lengths(d, edges):
    xy = {r.id: (r.x, r.y) for r in d.itertuples()}
    return np.array([math.dist(xy[u], xy[v]) for u, v, _ in edges])


def test_layout_of_components(spark):
    edges = grid(12) + [(1000, 1001, 1.0), (1001, 1002, 2.0), (1002, 1000, 1.0), (1001, 1001, 5.0), (1002, 1001, 1.0)]
    vertices = [*range(144), 1000, 1001, 1002, 2000, 2001]
    a = drawn(spark, edges, vertices, rounds=15, small=50)
    b = drawn(spark, list(reversed(edges)), vertices, rounds=15, small=50)
    assert a.equals(b), "the same on every run, whatever the order of rows"
    assert dict(zip(a.id, a.component, strict=True)) == {i: 0 if i < 144 else 1000 if i < 2000 else i for i in vertices}
    big = a[a.component == 0]
    assert big[["x", "y"]].min().min() >= -1e-9 and big[["x", "y"]].max().max() <= 12 + 1e-9
    xy = big[["x", "y"]].to_numpy()
    every = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))[np.triu_indices(144, 1)]
    near = lengths(a, grid(12)).mean() / every.mean()
    boxes = a.groupby("component")[["x", "y"]].agg(["min", "max"])
    assert boxes["y"]["max"][1000] < 0 and a[a.component == 2001].x.iloc[0] != a[a.component == 2000].x.iloc[0]
    whole = drawn(spark, edges, vertices, rounds=15)
    xy = whole[whole.component == 0][["x", "y"]].to_numpy()
    plain = lengths(whole, grid(12)).mean() / np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))[np.triu_indices(144, 1)].mean()
    print(near, plain)
    assert max(near, plain) < 0.7 and near < 1.2 * plain, "neighbours are nearer than others, by cells as by all pairs"
    none = drawing.component_layout(spark.createDataFrame([], "u long, v long, weight double"), spark.createDataFrame([], "id long"))
    assert none.collect() == []


def planted(groups, size, inside, between, seed):
    r = random.Random(seed)
    n = groups * size
    return [(a, b, 1.0) for a in range(n) for b in range(a + 1, n) if r.random() < (inside if a // size == b // size else between)]


def test_parallel_communities_find_planted_groups(spark):
    edges = planted(8, 25, 0.4, 0.01, 1)
    e, v = spark.createDataFrame(edges, "u long, v long, weight double"), spark.range(200)
    got = graph.parallel_communities(e, v, merge_edges=200).cache()
    sets = {}
    for r in got.collect():
        sets.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, sets.values())) == [list(range(i * 25, i * 25 + 25)) for i in range(8)]
    again = graph.parallel_communities(e.repartition(7), v, merge_edges=200).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got.collect()))


def test_parallel_communities_are_as_good_as_greedy_ones(spark):
    """Modularity on all pairs of suppliers at sf0.01, and on a graph that has few groups."""
    cases = [graphs.pairs(Tables(spark, "/root/testdata/sf0.01")).cache(), spark.createDataFrame(planted(5, 40, 0.15, 0.04, 2), "u long, v long, weight double")]
    for e in cases:
        v = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
        greedy = graph.modularity(e, graph.communities(e, v))
        assert graph.modularity(e, graph.parallel_communities(e, v)) >= greedy
