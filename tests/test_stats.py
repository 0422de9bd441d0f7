"""Known answers of intervals, effect sizes, densities and bootstrap."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import stats


def delta(spark, a, b):
    rows = [(float(x), True) for x in a] + [(float(x), False) for x in b]
    df = spark.createDataFrame(rows, "v double, s boolean").withColumn("g", F.lit(1))
    r = stats.cliffs_delta(df, ["g"], "v", "s").collect()
    return (r[0].delta, r[0].magnitude) if r else (None, "n/a")


@pytest.mark.parametrize(("a", "b", "d", "m"), [
    ([4, 5, 6], [1, 2, 3], 1.0, "large"), ([1, 2], [3, 4], -1.0, "large"), ([1, 2, 3], [1, 2, 3], 0.0, "negligible"),
    ([1, 3], [2, 2], 0.0, "negligible"), ([3, 3], [1, 2], 1.0, "large"), ([1], [], None, "n/a"),
])
def test_cliffs_delta(spark, a, b, d, m):
    assert delta(spark, a, b) == (d, m)


@pytest.mark.parametrize(("above", "d", "m"), [(50, 0.0, "negligible"), (57, 0.14, "negligible"), (60, 0.20, "small"), (70, 0.40, "medium"), (80, 0.60, "large")])
def test_magnitudes(spark, above, d, m):
    got = delta(spark, [1] * above + [-1] * (100 - above), [0])
    assert got[0] == pytest.approx(d) and got[1] == m


def test_wilson(spark):
    df = spark.createDataFrame([(1, 10), (0, 0), (0, 5), (5, 5)], "k int, n int")
    got = [tuple(r) for r in df.select(*stats.wilson(F.col("k"), F.col("n"))).collect()]
    assert got[0] == pytest.approx((0.1, 0.0179, 0.4042), abs=1e-3)
    assert got[1] == (None, None, None) and got[2][1] == 0.0 and got[3][2] == 1.0


def test_bootstrap(spark):
    df = spark.createDataFrame([("c", 2.0) for i in range(9)] + [("two", float(i)) for i in range(2)] + [("v", float(i % 7)) for i in range(60)] + [(None, None), (None, 1.0), ("none", None)], "g string, v double")
    run = lambda d: {r.g: r for r in stats.bootstrap_mean(d, ["g"], "v", n_boot=500).withColumn("sd", F.round("sd", 9)).collect()}
    a = run(df)
    assert a == run(df.repartition(7)) == run(df.coalesce(1)), "the same for any partitions"
    assert (a["c"].low, a["c"].high, a["c"].sd) == (2.0, 2.0, 0.0)
    assert a["two"].estimate == 0.5 and a["two"].low is None and a["two"].high is None
    assert (a["none"].n, a["none"].estimate, a[None].n, a[None].estimate, a[None].low) == (0, None, 1, 1.0, None)
    assert a["v"].low < a["v"].estimate < a["v"].high


def classical(rng, draw, n_boot=4000):
    return np.percentile([draw(rng) for _ in range(n_boot)], [2.5, 97.5])


def test_bounds_are_near_those_of_drawing_rows(spark):
    r = np.random.default_rng(7)
    v, s = np.round(r.gamma(2, 50, 400)), r.random(400) < 0.4
    v[s] += 20
    df = spark.createDataFrame([(float(x), bool(y)) for x, y in zip(v, s, strict=True)], "v double, s boolean").withColumn("g", F.lit("g")).repartition(5)
    m = stats.bootstrap_mean(df, ["g"], "v").first()
    low, high = classical(r, lambda g: v[g.integers(0, 400, 400)].mean())
    assert m.estimate == pytest.approx(v.mean()) and m.low == pytest.approx(low, abs=0.15 * (high - low)) and m.high == pytest.approx(high, abs=0.15 * (high - low))
    d = stats.bootstrap_delta(df, ["g"], "v", "s").first()
    a, b = v[s], v[~s]
    delta = lambda x, y: np.sign(x[:, None] - y).mean()
    low, high = classical(r, lambda g: delta(a[g.integers(0, len(a), len(a))], b[g.integers(0, len(b), len(b))]), 2000)
    assert d.delta == pytest.approx(delta(a, b)) and d.low == pytest.approx(low, abs=0.15 * (high - low)) and d.high == pytest.approx(high, abs=0.15 * (high - low))


def test_no_task_holds_a_group(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), (F.col("id") % 3 == 0).alias("s"))
    for d in (stats.bootstrap_mean(df, ["g"], "v", n_boot=50), stats.bootstrap_delta(df, ["g"], "v", "s", n_boot=50)):
        assert "FlatMapGroups" not in d._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_delta(spark):
    df = spark.createDataFrame([(i, float(i), i >= 10) for i in range(20)], "i int, v double, s boolean").withColumn("g", F.lit(0))
    r = stats.bootstrap_delta(df, ["g"], "v", "s", n_boot=50).first()
    assert (r.delta, r.low, r.high) == (1.0, 1.0, 1.0)
    few = stats.bootstrap_delta(df.where("i < 12"), ["g"], "v", "s", n_boot=50).first()
    assert (few.n_b, few.n_a, few.low) == (10, 2, None)


def test_histograms(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (3.0,), (None,)], "v double")
    assert [(r.bin, r.n) for r in stats.histogram_discrete(df, "v").orderBy("bin").collect()] == [(1, 1), (2, 0), (3, 2)]
    h = stats.histogram_binned(df, "v", 4).orderBy("bin").collect()
    assert [r.n for r in h] == np.histogram([1, 3, 3], 4)[0].tolist()
    assert stats.histogram_discrete(df.limit(0), "v").collect() == []


@pytest.mark.parametrize("values", [[1.0] * 12, [float(i) for i in range(40)], [0.0] * 9])
def test_kde(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("g", F.lit("g"))
    got = stats.kde(df, ["g"], "v").orderBy("x").collect()
    if len(values) < 10:
        assert got == []
        return
    v = np.array(values)
    q = np.percentile(v, [25, 75])
    sd = v.std(ddof=1)
    sigma = min(sd, (q[1] - q[0]) / 1.349) if q[1] > q[0] else sd
    sigma = sigma if sigma > 0 else 0.5
    bw = max(0.9 * sigma * len(v) ** -0.2, 0.45)
    x = np.linspace(v.min() - 0.75, v.max() + 0.75, 240)
    want = np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
    assert np.allclose([r.density for r in got], want)
