"""Aggregations: year statistics, shares, rates, transitions, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.stats import bootstrap_delta, cliffs_delta, wilson
from quire.functions.text import accepts, any_pattern, canonical_subject, chars_without_space, confidence_level, first_word, short_subject, verdict, verdict_rank


def flag(col: Column) -> Column:
    """1 for true, 0 for false or null."""
    return F.coalesce(col.cast("int"), F.lit(0))


def review_rollup(papers: DataFrame) -> DataFrame:
    """paper_id, num_reviews, averages and the range of scores, null scores aside.

    ``reviews.score_raw`` is exploded alone, so the scan reads no review text.
    """
    scores = papers.select("paper_id", F.explode_outer(F.arrays_zip(F.col("reviews.score_raw").alias("raw"), F.col("reviews.score_normalized").alias("norm"))).alias("s"), F.size(F.col("reviews.score_raw")).alias("n"))
    return scores.groupBy("paper_id").agg(
        F.max("n").alias("num_reviews"), F.avg("s.raw").alias("avg_score_raw"), F.avg("s.norm").alias("avg_score_normalized"), (F.max("s.raw") - F.min("s.raw")).alias("score_range"),
    )


def year_stats(papers: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """Per year: papers, distinct authors, percentages of code and early acceptance, mean score.

    ``pct_early`` is of accepted papers, ``pct_early_subs`` of submissions
    (null without ``n_submitted`` in ``years``).
    """
    per = papers.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_papers"), (100 * F.avg(flag(F.col("has_code")))).alias("pct_code"), F.avg("avg_score_raw").alias("avg_score"),
        (100 * F.avg(flag(F.col("early_accepted")))).alias("pct_early"), F.sum(flag(F.col("early_accepted"))).alias("n_early"),
    )
    authors = papers.select("year", F.explode("authors").alias("author")).groupBy("year").agg(F.countDistinct("author").alias("n_authors"))
    out = per.join(authors, "year", "left").withColumn("n_authors", F.coalesce("n_authors", F.lit(0)))
    if years is None:
        return out.drop("n_early")
    out = out.join(years.select("year", "n_submitted", "city"), "year", "left")
    return out.withColumn("pct_early_subs", 100 * F.col("n_early") / F.nullif("n_submitted", F.lit(0))).withColumn("accept_rate", 100 * F.col("n_papers") / F.nullif("n_submitted", F.lit(0))).drop("n_early")


def metric_panel(papers: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """Year statistics with population deviation of normalised scores and of review length."""
    reviews = papers.select("year", F.explode("reviews").alias("r")).select("year", "r.score_normalized", chars_without_space(*[F.col(f"r.text_{c}") for c in ("contribution", "strengths", "weaknesses", "detailed_comments")]).alias("chars"))
    length = F.when(F.col("chars") > 0, F.col("chars"))
    spread = reviews.groupBy("year").agg(F.stddev_pop("score_normalized").alias("score_sd"), F.avg(length).alias("review_chars"), F.stddev_pop(length).alias("review_chars_sd"))
    return year_stats(papers, years).join(spread, "year", "left")


def totals(papers: DataFrame, talks: DataFrame | None = None) -> DataFrame:
    """One row: papers, distinct authors, code, clusters, reviews (and talks)."""
    out = papers.agg(
        F.count(F.lit(1)).alias("n_papers"), F.sum(flag(F.col("has_code"))).alias("n_code"), F.countDistinct("cluster_id").alias("n_clusters"),
        F.sum(F.coalesce(F.size("reviews"), F.lit(0))).alias("n_reviews"),
    )
    authors = papers.select(F.explode("authors").alias("a")).agg(F.countDistinct("a").alias("n_authors"))
    out = out.crossJoin(authors)  # one row each
    return out if talks is None else out.crossJoin(talks.agg(F.count(F.lit(1)).alias("n_talks")))


def count_tags(papers: DataFrame, tag: str = "subject_areas", by: Sequence[str] = ()) -> DataFrame:
    """by..., tag, n: tags are counted, not papers."""
    return papers.select(*by, F.explode(tag).alias("tag")).groupBy(*by, "tag").agg(F.count(F.lit(1)).alias("n"))


def count_short_subjects(papers: DataFrame) -> DataFrame:
    return papers.select(F.explode("subject_areas").alias("s")).groupBy(short_subject(F.col("s")).alias("subject")).agg(F.count(F.lit(1)).alias("n"))


def rate_by(df: DataFrame, by: Sequence[str], predicate: Column, min_n: int = 0) -> DataFrame:
    """by..., k, n, rate and Wilson bounds of a boolean; groups below ``min_n`` go."""
    out = df.groupBy(*by).agg(F.sum(flag(predicate)).alias("k"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
    p, low, high = wilson(F.col("k"), F.col("n"))
    return out.select(*by, "k", "n", p.alias("rate"), low.alias("low"), high.alias("high"))


def subject_shares(papers: DataFrame) -> DataFrame:
    """year, area, n, share (% of the year's papers), presence (years with the area), total.

    A paper counts once for an area, however many of its tags mean it.
    """
    areas = F.array_distinct(F.filter(F.transform("subject_areas", canonical_subject), lambda a: a.isNotNull()))
    return share_with_presence(papers.select("paper_id", "year", F.explode(areas).alias("area")), papers.select("paper_id", "year"))


def share_with_presence(items: DataFrame, all_rows: DataFrame, key: str = "paper_id", year: str = "year", area: str = "area") -> DataFrame:
    """The same for any (key, year, area) rows and all (key, year)."""
    n = items.groupBy(year, area).agg(F.countDistinct(key).alias("n"))
    per_year = all_rows.groupBy(year).agg(F.countDistinct(key).alias("_of"))
    w = Window.partitionBy(area)
    out = n.join(per_year, year).withColumn("share", 100 * F.col("n") / F.col("_of"))
    return out.withColumn("presence", F.count(F.lit(1)).over(w)).withColumn("total", F.sum("n").over(w)).drop("_of")


def complete_areas(shares: DataFrame, n_years: int, top: int, area: str = "area") -> DataFrame:
    """Areas present in all years, the ``top`` ones by total (ties by name)."""
    full = shares.where(F.col("presence") == n_years).select(area, "total").distinct()
    return shares.join(full.orderBy(F.desc("total"), area).limit(top).select(area), area, "left_semi")


def verdict_flows(papers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., pre, post, n of reviews whose verdicts before and after rebuttal are both known."""
    r = papers.select(*by, F.explode(F.arrays_zip(F.col("reviews.recommendation_label").alias("a"), F.col("reviews.post_rebuttal_label").alias("b"))).alias("r"))
    r = r.select(*by, verdict(F.col("r.a")).alias("pre"), verdict(F.col("r.b")).alias("post"))
    r = r.where(verdict_rank(F.col("pre")).isNotNull() & verdict_rank(F.col("post")).isNotNull())
    return r.groupBy(*by, "pre", "post").agg(F.count(F.lit(1)).alias("n"))


def flow_summary(flows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., pairs, raised, lowered, rejected, rejected_to_accept and its percentage."""
    a, b, n = verdict_rank(F.col("pre")), verdict_rank(F.col("post")), F.col("n")
    out = flows.groupBy(*by).agg(
        F.sum("n").alias("pairs"), F.sum(F.when(b > a, n).otherwise(0)).alias("raised"), F.sum(F.when(b < a, n).otherwise(0)).alias("lowered"),
        F.sum(F.when(~accepts(a), n).otherwise(0)).alias("rejected"), F.sum(F.when(~accepts(a) & accepts(b), n).otherwise(0)).alias("rejected_to_accept"),
    )
    return out.withColumn("pct_to_accept", 100 * F.col("rejected_to_accept") / F.nullif("rejected", F.lit(0)))


def crossing_rates(flows: DataFrame, by: Sequence[str], min_pairs: int = 30) -> DataFrame:
    """by..., pairs, up and down: % of pairs that cross the accept line, with minimum support."""
    a, b, n = accepts(verdict_rank(F.col("pre"))), accepts(verdict_rank(F.col("post"))), F.col("n")
    out = flows.groupBy(*by).agg(F.sum("n").alias("pairs"), F.sum(F.when(~a & b, n).otherwise(0)).alias("_up"), F.sum(F.when(a & ~b, n).otherwise(0)).alias("_down")).where(F.col("pairs") >= min_pairs)
    return out.select(*by, "pairs", (100 * F.col("_up") / F.col("pairs")).alias("up"), (100 * F.col("_down") / F.col("pairs")).alias("down"))


def has_verdicts_after_rebuttal(papers: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    known = F.exists("reviews", lambda r: verdict_rank(verdict(r["post_rebuttal_label"])).isNotNull())
    return papers.groupBy(*by).agg(F.coalesce(F.bool_or(known), F.lit(False)).alias("has_verdicts"))


def pattern_counts(df: DataFrame, text: Column, patterns: dict[str, list[str]], by: Sequence[str] = ()) -> DataFrame:
    """by..., topic, n, pct of rows where any of the topic's patterns is found; one pass over the texts."""
    hits = df.select(*by, *[flag(any_pattern(text, p)).alias(f"_{i}") for i, p in enumerate(patterns.values())])
    sums = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(patterns))])
    rows = F.array(*[F.struct(F.lit(name).alias("topic"), F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("n")) for i, name in enumerate(patterns)])
    return sums.select(*by, "_n", F.inline(rows)).select(*by, "topic", "n", (100 * F.col("n") / F.nullif("_n", F.lit(0))).alias("pct"))


def first_words(df: DataFrame, title: str, stopwords: Sequence[str]) -> DataFrame:
    w = first_word(F.col(title))
    return df.select(w.alias("word")).where((F.col("word") != "") & ~F.col("word").isin(*stopwords)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def type_overview(papers: DataFrame) -> DataFrame:
    """year, oral, spotlight, poster, selected (%) of papers with a type."""
    n = lambda t: F.sum(flag(F.col("presentation_type") == t))
    out = papers.where("presentation_type IS NOT NULL").groupBy("year").agg(n("oral").alias("oral"), n("spotlight").alias("spotlight"), n("poster").alias("poster"), F.count(F.lit(1)).alias("_n"))
    return out.withColumn("selected", 100 * (F.col("oral") + F.col("spotlight")) / F.col("_n")).drop("_n")


def group_mean_of_means(df: DataFrame, item: str, by: Sequence[str], value: str, min_n: int = 3) -> DataFrame:
    """by..., n, mean of the per-item means of a value; groups of fewer than ``min_n`` items go."""
    per = df.where(F.col(value).isNotNull()).groupBy(*by, item).agg(F.avg(value).alias("_m"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_m").alias("mean")).where(F.col("n") >= min_n)


def year_span(years: Column, all_years: Column) -> Column:
    """Empty if all years are there, else one year, a range, or a list."""
    n = F.size(years)
    first, last = F.get(years, F.lit(0)), F.element_at(years, -1)
    return F.when(n == F.size(all_years), "").when(n == 1, first.cast("string")).when(last - first + 1 == n, F.concat_ws("-", first.cast("string"), last.cast("string"))).otherwise(F.array_join(F.transform(years, lambda y: y.cast("string")), ", "))


def selection_rates(items: DataFrame, rows: DataFrame, *, key: str, area: str, selected: str, window: str | None = None, years: str | None = None, min_n: int = 25) -> DataFrame:
    """Selection rate by area against its window's baseline, for all rows together and each window.

    ``rows`` has (key, selected[, window]); ``items`` the same with ``area``, a
    row for each of a key's areas.  Adds Wilson bounds, the difference from the
    baseline in points and, with ``years``, the sorted years of the area.  Null
    windows in the result stand for all rows.
    """
    chosen = F.sum(flag(F.col(selected)))
    more = [F.sort_array(F.collect_set(years)).alias("years")] if years else []
    agg = [chosen.alias("k"), F.count(F.lit(1)).alias("n"), *more]
    if window:
        sets = items.groupingSets([(window, area), (area,)], window, area).agg(*agg, F.grouping(window).alias("_all"))
        base = rows.groupingSets([(window,), ()], window).agg((100 * F.avg(flag(F.col(selected)))).alias("baseline"), F.grouping(window).alias("_all"))
        out = sets.join(base.withColumnRenamed(window, "_w"), (sets["_all"] == base["_all"]) & sets[window].eqNullSafe(F.col("_w"))).drop(base["_all"]).drop("_w")
        head = [F.when(F.col("_all") == 0, F.col(window)).alias(window), area]
    else:
        base = rows.agg((100 * F.avg(flag(F.col(selected)))).alias("baseline"))
        out = items.groupBy(area).agg(*agg).crossJoin(F.broadcast(base))
        head = [area]
    out = out.where(F.col("n") >= min_n)
    p, low, high = wilson(F.col("k"), F.col("n"))
    return out.select(*head, "k", "n", (100 * p).alias("rate"), (100 * low).alias("low"), (100 * high).alias("high"), "baseline", (100 * p - F.col("baseline")).alias("diff"), *(["years"] if years else []))


def page_summary(papers: DataFrame) -> DataFrame:
    """Per year: papers, talks by type, selection share, code and early rates by selection, whether all talks are matched."""
    sel = F.col("presentation_type").isin("oral", "spotlight")
    return papers.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_papers"), F.sum(flag(F.col("presentation_type") == "oral")).alias("n_oral"), F.sum(flag(F.col("presentation_type") == "spotlight")).alias("n_spotlight"),
        (100 * F.avg(flag(sel))).alias("pct_selected"), (100 * F.avg(F.when(sel, flag(F.col("early_accepted"))))).alias("early_selected"),
        (100 * F.avg(F.when(~sel, flag(F.col("early_accepted"))))).alias("early_poster"), F.coalesce(F.bool_and(F.col("presentation_type").isNotNull()), F.lit(False)).alias("all_matched"),
    )


def page_report(papers: DataFrame, talks: DataFrame | None = None, n_boot: int = 2_000) -> DataFrame:
    """A row a year with talks: its page_summary, the effect of orals against posters with bounds, and its match.

    early_oral is the share of early accepted orals; without ``n_boot`` there are
    no bounds, without ``talks`` (year, paper_id, type, match) no match.
    """
    oral, spotlight = F.col("n_oral"), F.col("n_spotlight")
    early = papers.groupBy("year").agg((100 * F.avg(F.when(F.col("presentation_type") == "oral", flag(F.col("early_accepted"))))).alias("early_oral"))
    out = page_summary(papers).drop("all_matched", "early_selected").where(oral + spotlight > 0).withColumn("n_selected", oral + spotlight).join(early, "year")
    sides = compared(papers.select("year", "presentation_type", "avg_score_raw"), COMPARISONS[:1])
    effect = bootstrap_delta(sides, ["year"], "avg_score_raw", "first_side", n_boot) if n_boot else cliffs_delta(sides, ["year"], "avg_score_raw", "first_side")
    out = out.join(effect.drop("n_a", "n_b"), "year", "left")
    return out if talks is None else out.join(match_summary(talks).select("year", "extracted", "matched", F.col("match_rate_pct").alias("match_rate")), "year", "left")


def page_totals(report: DataFrame) -> DataFrame:
    """One row over a page_report with its match: totals, extremes with their years (ties: the first year), whether all talks are matched."""
    known = F.col("delta").isNotNull()
    total = lambda c: F.sum(c).alias(f"total_{c[2:]}")
    return report.agg(
        F.sort_array(F.collect_list("year")).alias("years"), *[total(c) for c in ("n_papers", "n_oral", "n_spotlight", "n_selected")], (100 * F.sum("n_selected") / F.sum("n_papers")).alias("pct_selected"),
        F.min("delta").alias("delta_min"), F.min(F.when(known, F.struct("delta", "year")))["year"].alias("delta_min_year"),
        F.max("delta").alias("delta_max"), F.min(F.when(known, F.struct((-F.col("delta")).alias("d"), "year")))["year"].alias("delta_max_year"),
        F.min("pct_selected").alias("pct_selected_min"), F.max("pct_selected").alias("pct_selected_max"),
        F.sort_array(F.collect_list(F.when(F.col("n_spotlight") > 0, F.col("year")))).alias("spotlight_years"), F.coalesce(F.bool_and(F.col("match_rate") == 100), F.lit(True)).alias("all_matched"),
    )


def _scores(papers: DataFrame) -> DataFrame:
    """year, early, score (whole), top of reviews with a score and a scale."""
    r = papers.select("year", flag(F.col("early_accepted")).alias("early"), F.explode("reviews").alias("r"))
    return r.where("r.score_raw IS NOT NULL").select("year", "early", F.floor("r.score_raw").alias("score"), F.col("r.score_max").alias("top"))


def score_distribution(papers: DataFrame) -> DataFrame:
    """year, score, n, n_early of reviews with scores from 1 to the year's scale, empty scores included; others are left out."""
    counts = _scores(papers).groupBy("year", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("early").alias("n_early"), F.max("top").alias("top"))
    # From the counts: a row a year and score.
    frame = counts.groupBy("year").agg(F.max("top").alias("top")).where("top >= 1").select("year", F.explode(F.sequence(F.lit(1).cast("long"), F.floor("top"))).alias("score"))
    return frame.join(counts.drop("top"), ["year", "score"], "left").select("year", "score", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_early", F.lit(0)).alias("n_early"))


def average_histograms(papers: DataFrame) -> DataFrame:
    """year, bin, left, right, n, n_early of the papers' average scores: 2 (scale - 1) equal bins a year, that early papers share.

    The last bin is closed on the right; a single value lies in the middle of a width of 1.
    """
    held = papers.where("avg_score_raw IS NOT NULL").select("year", F.col("avg_score_raw").cast("double").alias("v"), flag(F.col("early_accepted")).alias("early"))
    edges = held.groupBy("year").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).join(scales(papers), "year")
    one = F.col("lo") == F.col("hi")
    edges = edges.select("year", F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(one, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), F.greatest(2 * (F.col("scale") - 1), F.lit(1)).cast("int").alias("bins"))
    edges = edges.withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.col("bins") - 1).cast("int")
    counts = held.join(edges, "year").groupBy("year", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("early").alias("n_early"))
    frame = edges.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    left = F.col("lo") + F.col("bin") * F.col("width")
    return frame.join(counts, ["year", "bin"], "left").select("year", "bin", left.alias("left"), (left + F.col("width")).alias("right"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_early", F.lit(0)).alias("n_early"))


def disagreement(papers: DataFrame) -> DataFrame:
    """year, score_range, n of papers that weren't accepted early, from the year's smallest to its largest range."""
    known = F.filter(F.col("reviews.score_raw"), lambda x: x.isNotNull())
    spread = F.floor(F.array_max(known) - F.array_min(known))
    counts = papers.where(flag(F.col("early_accepted")) == 0).select("year", spread.alias("score_range")).where("score_range IS NOT NULL").groupBy("year", "score_range").agg(F.count(F.lit(1)).alias("n"))
    frame = counts.groupBy("year").agg(F.min("score_range").alias("a"), F.max("score_range").alias("b")).select("year", F.explode(F.sequence("a", "b")).alias("score_range"))
    return frame.join(counts, ["year", "score_range"], "left").select("year", "score_range", F.coalesce("n", F.lit(0)).alias("n"))


def mean_confidence(papers: DataFrame) -> DataFrame:
    """paper_id, year, n, confidence: mean of the known confidence levels of a paper's reviews (null if there are none)."""
    levels = F.filter(F.transform("reviews", lambda r: confidence_level(r["confidence_label"])), lambda x: x.isNotNull())
    mean = F.when(F.size(levels) > 0, F.aggregate(levels, F.lit(0.0), lambda a, x: a + x) / F.size(levels))
    return papers.select("paper_id", "year", F.coalesce(F.size(levels), F.lit(0)).alias("n"), mean.alias("confidence"))


def extremes(df: DataFrame, by: str, value: str) -> DataFrame:
    """One row: (by, value) of the smallest and the largest value; ties to the smallest ``by``."""
    return df.where(F.col(value).isNotNull()).agg(
        F.min(F.struct(F.col(value).alias("v"), F.col(by).alias("k"))).alias("lowest"), F.min(F.struct((-F.col(value)).alias("v"), F.col(by).alias("k"))).alias("highest"),
    ).select(F.col("lowest.k").alias("low_key"), F.col("lowest.v").alias("low_value"), F.col("highest.k").alias("high_key"), (-F.col("highest.v")).alias("high_value"))


def scales(papers: DataFrame) -> DataFrame:
    """year, scale: the largest score_max of its reviews."""
    return papers.groupBy("year").agg(F.max(F.array_max(F.col("reviews.score_max"))).alias("scale"))


def match_summary(talks: DataFrame) -> DataFrame:
    """Per year: extracted, matched, skipped, unmatched, rate, counts by type and by method."""
    done = F.col("paper_id").isNotNull()
    base = talks.groupBy("year").agg(
        F.count(F.lit(1)).alias("extracted"), F.sum(flag(done)).alias("matched"), F.sum(flag(F.col("match") == "skipped")).alias("skipped"), F.sum(flag(F.col("match") == "unmatched")).alias("unmatched"),
    )
    base = base.withColumn("match_rate_pct", 100 * F.col("matched") / F.greatest(F.col("extracted") - F.col("skipped"), F.lit(1)))

    def counted(col: str, name: str) -> DataFrame:
        c = talks.where(done).groupBy("year", col).agg(F.count(F.lit(1)).alias("_c"))
        return c.groupBy("year").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(col, "_c")))).alias(name))

    return base.join(counted("type", "types"), "year", "left").join(counted("match", "methods"), "year", "left")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def error_gate(df: DataFrame, error: str = "error", limit: float = 0.05) -> float:
    """The share of error rows; raises if it is above the limit."""
    share = df.agg(F.avg(flag(F.col(error).isNotNull()))).first()[0] or 0.0
    if share > limit:
        raise ValueError(f"{share:.1%} of rows have errors; the limit is {limit:.0%}")
    return share


def with_strata(df: DataFrame, of: Column, names: tuple[str, str, str] = ("all", "yes", "no"), name: str = "stratum") -> DataFrame:
    """Each row once for all rows and once for its side of a boolean (null counts as false)."""
    side = F.when(F.coalesce(of, F.lit(False)), names[1]).otherwise(names[2])
    return df.withColumn(name, F.explode(F.array(F.lit(names[0]), side)))


def years_with_talks(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("presentation_type").isin("oral", "spotlight")).select("year").distinct()


#: Comparisons of presentation types: name, types on the first side, types on the second.
COMPARISONS = (("oral vs poster", ("oral",), ("poster",)), ("spotlight vs poster", ("spotlight",), ("poster",)), ("oral vs spotlight", ("oral",), ("spotlight",)))


def compared(papers: DataFrame, comparisons: Sequence[tuple[str, tuple[str, ...], tuple[str, ...]]] = COMPARISONS) -> DataFrame:
    """papers once for each comparison they take part in, with ``comparison`` and ``first_side``."""
    kind = F.col("presentation_type")
    sides = F.array(*[F.when(kind.isin(*a, *b), F.struct(F.lit(n).alias("comparison"), kind.isin(*a).alias("first_side"))) for n, a, b in comparisons])
    return papers.withColumn("_c", F.explode(F.filter(sides, lambda s: s.isNotNull()))).select(*papers.columns, "_c.*")


def effects(papers: DataFrame, value: str, by: Sequence[str] = ("year",), least: int = 3) -> DataFrame:
    """by..., comparison, n_a, n_b, delta, magnitude of a value between presentation types, with enough papers on both sides."""
    out = cliffs_delta(compared(papers), [*by, "comparison"], value, "first_side")
    return out.where((F.col("n_a") >= least) & (F.col("n_b") >= least))
