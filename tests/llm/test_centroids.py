"""Centroid clustering: oracle, plain search in Python, ties, bounds, edge rows."""

import hashlib
import math
import random

import numpy as np
from helpers import same_rows

from quire.llm import centroids as module
from quire.llm.centroids import Round, cluster_vectors, op13_centroid_clusters, squares, whole_vectors


def brute(vectors, k, rounds, seed=2):
    start = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in vectors]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(vectors, at, strict=True) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(d, *nearest(v)[::-1]) for d, v in vectors]
    total = sum(r[2] for r in out)
    return sorted(((d, j, x, sum(r[2] for r in out if r[1] == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for d, j, x in out), key=repr)


def clustered(spark, vectors, **more):
    df = spark.createDataFrame(vectors, "vec_id long, v array<int>")
    return sorted((tuple(r)[:6] for r in cluster_vectors(df, **more).collect()), key=repr)


def test_oracle(spark, sf):
    same_rows(spark, op13_centroid_clusters, module.OP13_SQL, sf)


def test_grid_full_of_ties(spark):
    """Points of a small grid lie at equal distances from many centroids; copies make empty clusters."""
    r = random.Random(3)
    vectors = [(i, [r.randint(-2, 2), r.randint(-2, 2)]) for i in range(300)]
    for k in (1, 2, 7, 25):
        assert clustered(spark, vectors, k=k, rounds=4) == brute(vectors, k, 4)


def test_wide_values_and_skew(spark):
    r = random.Random(4)
    near = 2**27 - 1
    vectors = [(i, [r.randint(-near, near) for _ in range(3)]) for i in range(60)] + [(60 + i, [5, 5, 5]) for i in range(90)]
    assert clustered(spark, vectors, k=9, rounds=5) == brute(vectors, 9, 5)


def test_bounds_hold_and_save_work():
    r = np.random.default_rng(5)
    centres = r.integers(-300, 300, (12, 8))
    v = (centres[r.integers(0, 12, 2000)] + r.integers(-40, 40, (2000, 8))).astype(np.int64)
    c, before = v[:12].copy(), None
    state, done = None, 0
    for _ in range(6):
        now = Round(c, before)
        state = now.start(v) if before is None else now.step(v, *state[:3])
        cluster, upper, lower, counts, _ = state
        exact = np.stack([squares(v, x) for x in c], axis=1)
        assert (cluster == exact.argmin(axis=1)).all()
        assert (upper.astype(float) ** 2 >= exact[np.arange(len(v)), cluster]).all() and (lower.astype(float) ** 2 <= exact).all()
        done += counts.sum() * (before is not None)
        before, c = c, np.array([v[cluster == j].sum(axis=0) // max((cluster == j).sum(), 1) if (cluster == j).any() else c[j] for j in range(12)])
    assert done < 0.5 * 5 * 2000 * 12


def test_vectors_that_are_left_out(spark):
    good = [0.5] * 3
    rows = [(1, good), (2, None), (3, [0.5, None, 0.5]), (4, [0.5, math.nan, 0.5]), (5, [math.inf, 0.0, 0.0]), (6, [0.5, 0.5]), (7, []), (8, [-0.001, 1e30, 0.0]), (9, [-0.001, 0.0, 2.0]), (None, good), (1, good)]
    df = spark.createDataFrame([(a, b, 0, 0) for a, b in rows], "vec_id long, embedding array<float>, v int, cluster int")
    got = sorted(((r.vec_id, r.v) for r in whole_vectors(df, dims=3).collect()), key=repr)
    assert got == [(1, [128] * 3), (1, [128] * 3), (9, [-1, 0, 512]), (None, [128] * 3)]
    out = sorted(map(tuple, cluster_vectors(whole_vectors(df, dims=3), k=3).select("vec_id", "cluster", "distance").collect()), key=repr)
    assert len(out) == 4 and all(d == 0 for *_, d in out)
    assert cluster_vectors(whole_vectors(df.limit(0))).collect() == []
