"""Exact ranks and order statistics of a whole table or of large groups, without a task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.runtime import materialize

#: Bits of monotonically_increasing_id below the partition's number.
ROW_BITS = 33


def ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` written in ranges of the keys, sorted; ``_part`` and ``_i`` are a row's range and place in it."""
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    d = materialize(d)
    return d.select(*df.columns, F.shiftright("_id", ROW_BITS).alias("_part"), F.col("_id").bitwiseAND(2**ROW_BITS - 1).alias("_i"))


def ranked(df: DataFrame, *keys: str, name: str = "rank") -> DataFrame:
    """Rows plus their place (0-based, long) in the order of the keys, which should leave no ties.

    Ranges are sorted apart; the rows before a range are a running sum with a row a range.
    """
    d = ranged(df, keys)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return d.join(starts, "_part").select(*df.columns, (F.col("_start") + F.col("_i")).alias(name))


def ranked_in(df: DataFrame, by: Sequence[str], *keys: str, name: str = "rank", size: str | None = None) -> DataFrame:
    """Rows plus their place in their group, and the group's size; a group may be most of the table."""
    d = ranked(df, *by, *keys, name="_place")
    groups = d.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size"))
    on = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    out = d.join(groups, on).select(*df.columns, (F.col("_place") - F.col("_first")).alias(name), F.col("_size").alias(size or "_size"))
    return out if size else out.drop("_size")


def percentiles(df: DataFrame, by: Sequence[str], value: str, at: Sequence[float], name: str = "q") -> DataFrame:
    """by..., n, name: exact percentiles (interpolated between neighbours, as ``percentile``) of the values that aren't null.

    Values are counted first.  Ranges of (group, value) sum their counts; the
    running sum over ranges says which range holds a wanted rank, and only rows
    that hold one leave their range.  A group without values has no row.
    """
    by = list(by)
    held = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    d = ranged(held, [*by, "_v"])
    # What a range holds of a group, and what lies before it in the same group: a row a range and group.
    per_range = d.groupBy("_part", *by).agg(F.sum("_c").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
    places = F.array(*[F.lit(float(q)) for q in at])
    rank = F.transform(places, lambda q: q * (F.col("_total") - 1))
    wanted = F.array_distinct(F.concat(F.transform(rank, lambda r: F.floor(r)), F.transform(rank, lambda r: F.ceil(r))))
    starts = starts.withColumn("_wanted", F.filter(wanted, lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_n"))))
    asked = starts.where(F.size("_wanted") > 0).select("_part", *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_start", "_total", "_wanted")
    asked = asked.withColumnRenamed("_part", "_p")
    on = [F.col("_part") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]]
    run = Window.partitionBy("_part", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    inside = d.join(asked, on).withColumn("_below", F.col("_start") + F.coalesce(F.sum("_c").over(run), F.lit(0)))
    hits = F.filter("_wanted", lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_c")))
    found = inside.select(*by, "_total", "_v", F.explode(hits).alias("_r"))
    g = found.groupBy(*by, F.col("_total").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))

    def one(q: Column) -> Column:
        r = q * (F.col("n") - 1)
        low, high = F.element_at("_m", F.floor(r)), F.element_at("_m", F.ceil(r))
        return F.when(low == high, low).otherwise((F.ceil(r) - r) * low + (r - F.floor(r)) * high)

    return g.select(*by, "n", F.transform(places, one).alias(name))
