"""Statistics as columns or grouped operators: intervals, effect sizes, densities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.order import percentiles, ranged
from quire.runtime import ship

Z95 = 1.959963985
#: Upper bounds of |delta| for each magnitude.
MAGNITUDES = ((0.147, "negligible"), (0.33, "small"), (0.474, "medium"))
GRID_POINTS = 240


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """(rate, low, high) of the Wilson score interval, clamped to [0, 1]; null if n is 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = (F.lit(z) / d) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    # greatest and least skip nulls, so the bounds need the test of their own
    return p, F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), centre + half))


def magnitude(delta: Column) -> Column:
    out = F.when(delta.isNull(), "n/a")
    for bound, name in MAGNITUDES:
        out = out.when(F.abs(delta) < bound, name)
    return out.otherwise("large")


def cliffs_delta(df: DataFrame, by: list[str], value: str, side: str) -> DataFrame:
    """by..., n_a, n_b, delta, magnitude of ``value`` where ``side`` is true (a) against false (b).

    Counts by distinct value and a running sum give the number of pairs above
    and below, so no pair is formed.  Rows with a null value or side are left
    out; delta is null if a side is empty.
    """
    held = df.where(F.col(value).isNotNull() & F.col(side).isNotNull())
    counts = held.groupBy(*by, F.col(value).alias("_v")).agg(F.sum(F.col(side).cast("long")).alias("_a"), F.sum((~F.col(side)).cast("long")).alias("_b"))
    below = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_below", F.coalesce(F.sum("_b").over(below), F.lit(0)))
    out = counts.groupBy(*by).agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(F.col("_a") * F.col("_below")).alias("_under"), F.sum(F.col("_a") * F.col("_b")).alias("_tied"),
    )
    pairs = F.col("n_a") * F.col("n_b")
    delta = F.when(pairs > 0, (2 * F.col("_under") + F.col("_tied") - pairs) / pairs)
    return out.withColumn("delta", delta).withColumn("magnitude", magnitude(F.col("delta"))).drop("_under", "_tied")


def _draws(group: int, value: float, side: int, count: int, n_boot: int, seed: int) -> np.ndarray:
    """How often a value that occurs ``count`` times is in each resample.

    Rows enter a resample by independent Poisson numbers of mean 1, so a value's
    rows together by one of mean ``count``; the seed is the value's own, so the
    draws don't depend on partitions or the order of rows.
    """
    bits = np.float64(value).view(np.uint64)
    return np.random.default_rng([seed, group & (2**64 - 1), int(bits), side]).poisson(count, n_boot)


def _sums(df: DataFrame, by: list[str], value: str, side: Column | None, n_boot: int, seed: int) -> DataFrame:
    """by..., _part, _b (resample), and what the values of a range give to it.

    With ``side``: a, b (rows of each side) and under (pairs of the range in which
    a's value is the larger, ties half, both doubled); without: a (rows), total (their sum).
    Values are counted first; a task holds one group's sums at a time.
    """
    ship(df.sparkSession)
    v = F.col(value).cast("double")
    held = df.where(v.isNotNull() & ~F.isnan(v))
    held = held if side is None else held.where(side.isNotNull())
    sides = [F.count(F.lit(1)).alias("_a"), F.lit(0).cast("long").alias("_c")] if side is None else [F.sum(side.cast("long")).alias("_a"), F.sum((~side).cast("long")).alias("_c")]
    counts = held.groupBy(*by, (v + 0.0).alias("_v")).agg(*sides).withColumn("_h", F.xxhash64(*by) if by else F.lit(0).cast("long"))
    ranges = ranged(counts, ["_h", *by, "_v"])
    names = [f"_by{i}" for i in range(len(by))]
    kinds = [f"{n} {counts.schema[c].dataType.simpleString()}" for n, c in zip(names, by, strict=True)]
    cols = ranges.select("_part", *[F.col(c).alias(n) for n, c in zip(names, by, strict=True)], "_i", "_h", "_v", "_a", "_c")

    one_side = side is None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = sums = last = None

        def row() -> pd.DataFrame:
            return pd.DataFrame([[*key, *(x.tolist() for x in sums)]], columns=["_part", *names, "_from", "a", "b", "x"])

        for pdf in batches:
            for *head, i, h, value, a, c in pdf.itertuples(index=False):
                # Another group or range, or another piece of the range's file, has sums of its own.
                if key is None or i != last + 1 or not all(x == y or (x != x and y != y) for x, y in zip(head, key, strict=False)):
                    if key is not None:
                        yield row()
                    key, sums = [*head, i], [np.zeros(n_boot, np.int64), np.zeros(n_boot, np.int64), np.zeros(n_boot)]
                last = i
                first = _draws(int(h), value, 0, a, n_boot, seed) if a else 0
                if one_side:
                    sums[2] += first * value
                else:
                    second = _draws(int(h), value, 1, c, n_boot, seed) if c else 0
                    sums[2] += first * (2 * sums[1] + second)
                    sums[1] += second
                sums[0] += first
        if key is not None:
            yield row()

    out = cols.mapInPandas(run, ", ".join(["_part long", *kinds, "_from long", "a array<long>", "b array<long>", "x array<double>"]))
    both = F.posexplode(F.arrays_zip("a", "b", "x")).alias("_b", "z")
    return out.select("_part", "_from", *[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], both).select("_part", "_from", *by, "_b", "z.*")


def _bounds(draws: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """by..., low, high of ``d`` over resamples, rounded where the order of sums could show."""
    q = F.percentile("d", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    cut = lambda c: F.when(c == 0, 0.0).otherwise(F.round(c / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c)))), 9) * F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c)))))
    return draws.groupBy(*by).agg(q.alias("q")).select(*by, cut(F.get("q", F.lit(0))).alias("low"), cut(F.get("q", F.lit(1))).alias("high"))


def _with_bounds(found: DataFrame, bounds: DataFrame, by: list[str], enough: Column) -> DataFrame:
    names = [f"_by{i}" for i in range(len(by))]
    b = bounds.select(*[F.col(c).alias(n) for n, c in zip(names, by, strict=True)], "low", "high")
    on = [F.col(c).eqNullSafe(F.col(n)) for n, c in zip(names, by, strict=True)] or [F.lit(True)]
    return found.join(b, on, "left").drop(*names).withColumn("low", F.when(enough, F.col("low"))).withColumn("high", F.when(enough, F.col("high")))


def bootstrap_mean(df: DataFrame, by: list[str], value: str, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """by..., n, estimate, sd (of the population), low, high: mean with percentile bootstrap bounds.

    Resamples are Poisson ones (see ``_draws``), summed by ranges of values: no
    task holds a group.  Below three values the bounds are null; so is the
    estimate of none.  A resample without rows has no mean and is left out.
    """
    v = F.col(value).cast("double")
    found = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("estimate"), F.stddev_pop(v).alias("sd"))
    draws = _sums(df, by, value, None, n_boot, seed).groupBy(*by, "_b").agg(F.sum("a").alias("a"), F.sum("x").alias("x")).where("a > 0").withColumn("d", F.col("x") / F.col("a"))
    return _with_bounds(found, _bounds(draws, by, alpha), by, F.col("n") >= 3)


def bootstrap_delta(df: DataFrame, by: list[str], value: str, side: str, n_boot: int = 2_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """by..., n_a, n_b, delta, magnitude, low, high: Cliff's delta with percentile bootstrap bounds (null below three a side).

    A range of values counts its own pairs and its rows of each side; the rows of
    the lower ranges then add theirs, so pairs are never formed.
    """
    found = cliffs_delta(df, by, value, side)
    parts = _sums(df, by, value, F.col(side), n_boot, seed)
    lower = Window.partitionBy(*by, "_b").orderBy("_part", "_from").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("below", F.coalesce(F.sum("b").over(lower), F.lit(0)))
    sums = parts.groupBy(*by, "_b").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("x") + 2.0 * F.col("a") * F.col("below")).alias("x"))
    pairs = F.col("a").cast("double") * F.col("b")
    draws = sums.where("a > 0 AND b > 0").withColumn("d", F.col("x") / pairs - 1)
    return _with_bounds(found, _bounds(draws, by, alpha), by, (F.col("n_a") >= 3) & (F.col("n_b") >= 3))


def histogram_discrete(df: DataFrame, value: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """bin, n of unit bins from the smallest to the largest value, empty ones included."""
    v = F.col(value).cast("long")
    bounds = df.agg((F.lit(low) if low is not None else F.min(v)).cast("long").alias("lo"), (F.lit(high) if high is not None else F.max(v)).cast("long").alias("hi"))
    bins = bounds.where("lo IS NOT NULL AND lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("bin"))
    counts = df.where(v.isNotNull()).groupBy(v.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_binned(df: DataFrame, value: str, bins: int, by: list[str] | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """by..., bin (0-based), left, right, n of equal bins; the last one is closed on the right.

    Edges come from all rows unless they are given, so groups share them;
    values outside given edges are left out.
    """
    by = by or []
    v = F.col(value).cast("double")
    edges = df.agg((F.lit(low) if low is not None else F.min(v)).cast("double").alias("_lo"), (F.lit(high) if high is not None else F.max(v)).cast("double").alias("_hi"))
    d = df.where(v.isNotNull()).crossJoin(F.broadcast(edges)).where((v >= F.col("_lo")) & (v <= F.col("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = d.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = edges.select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    if by:
        frame = frame.crossJoin(d.select(*by).distinct())
    out = frame.join(counts, [*by, "bin"], "left")
    return out.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("left"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("right"), F.coalesce("n", F.lit(0)).alias("n"))


def kde(df: DataFrame, by: list[str], value: str, points: int = GRID_POINTS, floor: float = 0.45, margin: float = 0.75, min_n: int = 10) -> DataFrame:
    """by..., x, density: Gaussian kernel estimate on a grid over all values.

    Bandwidth: 0.9 sigma n^-0.2, at least ``floor``; sigma is the smaller of the
    sample deviation and IQR / 1.349 (the deviation alone if the IQR is 0; if it
    is 0 too, 0.5).  Groups of fewer than ``min_n`` values have no curve.
    Values are counted before they meet the grid.
    """
    v = F.col(value).cast("double")
    held = df.where(v.isNotNull())
    counts = held.groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    quartiles = percentiles(held, by, value, (0.25, 0.75), "_q").drop("n")
    shape = held.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(v).alias("_sd")).where(F.col("_n") >= min_n)
    shape = shape.join(quartiles, by) if by else shape.join(quartiles, F.lit(True))
    iqr = F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))
    sd = F.coalesce("_sd", F.lit(0.0))
    sigma = F.when(iqr > 0, F.least(sd, iqr / 1.349)).otherwise(sd)
    sigma = F.when(sigma > 0, sigma).otherwise(F.greatest(sd, F.lit(0.5)))
    shape = shape.withColumn("_bw", F.greatest(0.9 * sigma * F.pow(F.col("_n").cast("double"), F.lit(-0.2)), F.lit(floor)))
    ends = held.agg((F.min(v) - margin).alias("_lo"), (F.max(v) + margin).alias("_hi"))
    grid = ends.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("_lo") + i * (F.col("_hi") - F.col("_lo")) / (points - 1))).alias("x"))
    d = counts.join(shape, by) if by else counts.crossJoin(F.broadcast(shape))
    u = (F.col("x") - F.col("_v")) / F.col("_bw")
    part = F.col("_c") * F.exp(-0.5 * u * u) / (F.col("_n") * F.col("_bw") * F.sqrt(2 * F.pi()))
    return d.crossJoin(F.broadcast(grid)).groupBy(*by, "x").agg(F.sum(part).alias("density"))
