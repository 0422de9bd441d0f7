"""Ranks, top-k, changes between years, carried-forward scores.  Every order ends in a key that breaks ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import bare_int, short_subject, verdict, verdict_rank


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, by: Sequence[str], k: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def rank_in(df: DataFrame, by: Sequence[str], *order: Column | str, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_of_each(df: DataFrame, key: Sequence[str], *order: Column | str) -> DataFrame:
    """First-wins distinct."""
    return top_k_per(df, key, 1, *order, rank="_r").drop("_r")


def sample_each(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group, those with the smallest hashes of seed and key; reruns and other partitionings give the same.

    Equal keys go by the key's order and then as Spark finds them; each task
    passes on n rows a group only.
    """
    mixed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_hash", key))
    return df.withColumn("_hash", mixed).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_hash", "_rank")


def both_ends(df: DataFrame, k: int, value: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """The k smallest and the k largest rows, of all or of each group, with ``end``; rows that are both come twice."""
    if not by:
        # Each task passes on k rows of an end.
        low = df.orderBy(value, tie).limit(k).withColumn("end", F.lit("low"))
        return low.unionByName(df.orderBy(F.desc(value), F.desc(tie)).limit(k).withColumn("end", F.lit("high")))
    r = df.withColumn("_l", F.row_number().over(Window.partitionBy(*by).orderBy(value, tie))).withColumn("_h", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.desc(tie))))
    ends = F.filter(F.array(F.when(F.col("_l") <= k, F.lit("low")), F.when(F.col("_h") <= k, F.lit("high"))), lambda x: x.isNotNull())
    return r.where((F.col("_l") <= k) | (F.col("_h") <= k)).withColumn("end", F.explode(ends)).drop("_l", "_h")


def half_and_half(df: DataFrame, top: int, value: str, tie: str) -> DataFrame:
    """All rows if there are at most ``top``, else half of them from each end; (value, tie) is unique."""
    if df.limit(top + 1).count() <= top:
        return df
    return both_ends(df, top // 2, value, tie).drop("end")


def movers(shares: DataFrame, k: int = 8, min_total: int = 30, area: str = "area", year: str = "year") -> DataFrame:
    """y0, y1, area, s0, s1, change, end for every pair of years: the k largest falls and rises.

    An area counts if its total is large enough and it is present in both years.
    """
    held = shares.where((F.col("total") >= min_total) & (F.col("share") > 0)).select(area, year, "share")
    a, b = held.alias("a"), held.alias("b")
    pairs = a.join(b, (F.col(f"a.{area}") == F.col(f"b.{area}")) & (F.col(f"a.{year}") < F.col(f"b.{year}")))
    pairs = pairs.select(F.col(f"a.{year}").alias("y0"), F.col(f"b.{year}").alias("y1"), F.col(f"a.{area}").alias(area), F.col("a.share").alias("s0"), F.col("b.share").alias("s1"), (F.col("b.share") - F.col("a.share")).alias("change"))
    return both_ends(pairs, k, "change", area, ["y0", "y1"])


def cumulative(df: DataFrame, by: Sequence[str], order: str, value: str, name: str = "before") -> DataFrame:
    """Running sum of the rows before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def title_extremes(papers: DataFrame, k: int = 5) -> DataFrame:
    """kind (longest, shortest, most_authors), rank, paper_id, title, size, by year."""
    t = papers.select("year", "paper_id", "title", F.size(F.split(F.trim("title"), r"\s+")).alias("words"), F.coalesce(F.size("authors"), F.lit(0)).alias("n_authors"))
    out = [
        top_k_per(t, ["year"], k, order, "paper_id").select("year", F.lit(kind).alias("kind"), "rank", "paper_id", "title", F.col(size).alias("size"))
        for kind, size, order in (("longest", "words", F.desc("words")), ("shortest", "words", F.asc("words")), ("most_authors", "n_authors", F.desc("n_authors")))
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


def scored_papers(papers: DataFrame) -> DataFrame:
    """One row a paper with a score: means before and after rebuttal, carried forward.

    A reviewer without a score after rebuttal keeps the one before; a bare
    number in the label is such a score.  ``mode`` is scores, verdicts or null.
    """
    score = lambda r: F.coalesce(r["post_rebuttal_score_raw"], bare_int(r["post_rebuttal_label"]))
    pre_rank = lambda r: verdict_rank(verdict(r["recommendation_label"]))
    post_rank = lambda r: verdict_rank(verdict(r["post_rebuttal_label"]))
    known = lambda c: F.filter(c, lambda x: x.isNotNull())
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c))
    p = papers.select(
        "year", "paper_id", "title", "url", F.when(F.size("subject_areas") > 0, short_subject(F.get("subject_areas", F.lit(0)))).otherwise("n/a").alias("subject"),
        F.coalesce("early_accepted", F.lit(False)).alias("early"), "presentation_type",
        known(F.transform("reviews", lambda r: r["score_raw"])).alias("pre"), known(F.transform("reviews", score)).alias("updated"),
        known(F.transform("reviews", lambda r: F.coalesce(score(r), r["score_raw"]))).alias("post"),
        known(F.transform("reviews", pre_rank)).alias("pre_ranks"), known(F.transform("reviews", post_rank)).alias("post_only"),
        known(F.transform("reviews", lambda r: F.coalesce(post_rank(r), pre_rank(r)))).alias("ranks"),
    ).where(F.size("pre") > 0)
    p = p.withColumn("mean", mean(F.col("pre"))).withColumn("mean_post", F.when(F.size("updated") > 0, mean(F.col("post"))))
    p = p.withColumn("mean_rank", F.when(F.col("mean_post").isNull() & (F.size("post_only") > 0), mean(F.col("ranks"))))
    p = p.withColumn("improvement", F.coalesce(F.col("mean_post") - F.col("mean"), F.col("mean_rank") - F.coalesce(mean(F.col("pre_ranks")), F.col("mean_rank"))))
    mode = F.when(F.max("mean_post").over(Window.partitionBy("year")).isNotNull(), "scores").when(F.max("mean_rank").over(Window.partitionBy("year")).isNotNull(), "verdicts")
    return p.withColumn("mode", mode).drop("updated", "post_only", "pre_ranks")


def top_papers(papers: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """(overall, after rebuttal), each ranked within its year."""
    s = scored_papers(papers)
    overall = top_k_per(s, ["year"], n, F.desc("mean"), "title", "paper_id")
    first = F.when(F.col("mode") == "scores", F.col("mean_post")).otherwise(F.col("mean_rank"))
    last = F.when(F.col("mode") == "verdicts", F.col("mean"))
    rebuttal = top_k_per(s.where(first.isNotNull()), ["year"], n, first.desc(), F.desc("improvement"), last.desc(), "title", "paper_id")
    return overall, rebuttal
