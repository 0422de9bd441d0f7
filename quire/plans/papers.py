"""Paper and review operators over orders (as papers) and their lines (as reviews)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import VERDICT_ORDER, score_changed
from quire.operators import clustering, metrics, ranking
from quire.plans.clusters import vectors
from quire.plans.registry import Tables, query

YEARS = ((1992, 3000, "Oslo"), (1995, 2500, "Lima"), (1997, None, "Kyoto"), (2050, 10, "Nowhere"))


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def papers(t: Tables) -> DataFrame:
    """Papers with nested reviews, in the shape that the parsers give."""
    verdicts = F.array(*[F.lit(v) for v in VERDICT_ORDER])
    verdict = lambda n: F.get(verdicts, (n % 6).cast("int"))
    lines = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q")).alias("line"))
    lines = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))

    def review(x: Column) -> Column:
        raw = F.when(x["l_partkey"] % 11 != 0, (x["q"] % 6 + 1).cast("double"))
        return F.struct(
            raw.alias("score_raw"), (raw / 6).alias("score_normalized"), F.when(x["l_partkey"] % 2 == 0, 6).otherwise(5).alias("score_max"),
            F.concat(verdict(x["q"]), F.when(x["l_suppkey"] % 2 == 1, " — must be so").otherwise("")).alias("recommendation_label"),
            F.when(x["l_partkey"] % 3 == 1, "N/A").when(x["l_partkey"] % 3 == 2, verdict(x["q"] + x["l_partkey"])).alias("post_rebuttal_label"),
            F.when((x["l_suppkey"] % 5 == 0) & (F.col("year") % 2 == 0), (x["l_partkey"] % 6 + 1).cast("double")).alias("post_rebuttal_score_raw"),
            F.repeat(F.lit("ab "), x["q"]).alias("text_contribution"), F.lit("c d").alias("text_strengths"), F.lit(None).cast("string").alias("text_weaknesses"), F.lit("").alias("text_detailed_comments"),
        )

    o = t.orders.withColumn("year", F.year("o_orderdate")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    price = F.col("o_totalprice")
    o = o.withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType))).withColumn("reviews", F.transform("lines", review))
    scores = F.filter(F.col("reviews.score_raw"), lambda s: s.isNotNull())
    return o.select(
        F.col("o_orderkey").cast("string").alias("paper_id"), "year", F.concat(F.lit("Order of"), F.repeat(F.lit(" item"), (F.col("o_custkey") % 7).cast("int"))).alias("title"), F.lit("u").alias("url"),
        F.array_distinct(F.transform("lines", lambda x: F.concat(F.lit("S"), x["l_suppkey"].cast("string")))).alias("authors"),
        F.array(F.concat(F.lit("Area - "), "o_orderstatus"), F.concat(F.lit("Deep -> "), F.substring("o_orderpriority", 3, 99))).alias("subject_areas"),
        (F.col("o_orderstatus") == "F").alias("has_code"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority") == "1-URGENT").alias("early_accepted"),
        F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).alias("avg_score_raw"), (F.col("o_custkey") % 40).alias("cluster_id"),
        F.when(price >= 250000, "oral").when(price >= 150000, "spotlight").when(F.col("o_orderstatus") != "P", "poster").alias("presentation_type"), "reviews",
    )


_V = "[" + ", ".join(f"'{v}'" for v in VERDICT_ORDER) + "]"
_P = f"""
WITH p AS (
  SELECT o_orderkey, o_orderkey::VARCHAR AS paper_id, year(o_orderdate)::INT AS year, 'Order of' || repeat(' item', (o_custkey % 7)::INT) AS title, o_custkey, o_orderstatus AS status, o_orderpriority AS priority,
         o_orderstatus = 'F' AS code, o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT' AS early, o_custkey % 40 AS cluster_id,
         CASE WHEN o_totalprice >= 250000 THEN 'oral' WHEN o_totalprice >= 150000 THEN 'spotlight' WHEN o_orderstatus <> 'P' THEN 'poster' END AS type FROM orders),
r AS (
  SELECT p.*, l_suppkey, CASE WHEN l_partkey % 11 <> 0 THEN (l_quantity::INT % 6 + 1)::DOUBLE END AS raw, CASE WHEN l_partkey % 2 = 0 THEN 6 ELSE 5 END AS top,
         (l_quantity::INT % 6)::INT AS pre, CASE WHEN l_partkey % 3 = 2 THEN ((l_quantity::INT + l_partkey) % 6)::INT END AS post, l_partkey % 3 = 1 AS na,
         CASE WHEN l_suppkey % 5 = 0 AND year % 2 = 0 THEN (l_partkey % 6 + 1)::DOUBLE END AS post_raw, 2 * l_quantity::INT + 2 AS chars
  FROM p JOIN lineitem ON l_orderkey = o_orderkey),
s AS (SELECT paper_id, avg(raw) AS score FROM r GROUP BY 1),
y(year, n_submitted, city) AS (VALUES {", ".join(f"({a}, {'NULL' if b is None else b}, '{c}')" for a, b, c in YEARS)})
"""


def years(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(YEARS, "year int, n_submitted int, city string")


@query(_P + """
SELECT p.paper_id, (CASE WHEN max(r.paper_id) IS NULL THEN 0 ELSE count(*) END)::INT AS num_reviews, round(avg(raw), 6) AS avg_score_raw, round(avg(raw / 6), 6) AS avg_score_normalized, max(raw) - min(raw) AS score_range
FROM p LEFT JOIN r ON p.paper_id = r.paper_id GROUP BY 1
""")
def paper_review_rollup(t: Tables) -> DataFrame:
    """Reviews, mean scores and their range by paper."""
    return metrics.review_rollup(papers(t)).select("paper_id", "num_reviews", *r6("avg_score_raw", "avg_score_normalized"), "score_range")


_YEAR = _P + """,
a AS (SELECT year, count(DISTINCT l_suppkey) AS n_authors FROM r GROUP BY 1),
st AS (SELECT year, count(*) AS n_papers, 100 * avg(code::INT) AS pct_code, avg(score) AS avg_score, 100 * avg(early::INT) AS pct_early, sum(early::INT) AS n_early FROM p LEFT JOIN s USING (paper_id) GROUP BY 1)
"""


@query(_YEAR + """
SELECT year, n_papers, round(pct_code, 6) AS pct_code, round(avg_score, 6) AS avg_score, round(pct_early, 6) AS pct_early, coalesce(n_authors, 0) AS n_authors, n_submitted::DOUBLE AS n_submitted, city,
       round(100 * n_early / nullif(n_submitted, 0), 6) AS pct_early_subs, round(100 * n_papers / nullif(n_submitted, 0), 6) AS accept_rate
FROM st LEFT JOIN a USING (year) LEFT JOIN y USING (year)
""")
def paper_year_stats(t: Tables) -> DataFrame:
    """Statistics of each year, with submissions where they are known."""
    return metrics.year_stats(papers(t), years(t)).select("year", "n_papers", *r6("pct_code", "avg_score", "pct_early"), "n_authors", F.col("n_submitted").cast("double").alias("n_submitted"), "city", *r6("pct_early_subs", "accept_rate"))


@query(_YEAR + """,
sp AS (SELECT year, stddev_pop(raw / 6) AS score_sd, avg(chars) AS review_chars, stddev_pop(chars) AS review_chars_sd FROM r GROUP BY 1)
SELECT year, n_papers, round(score_sd, 6) AS score_sd, round(review_chars, 6) AS review_chars, round(review_chars_sd, 6) AS review_chars_sd FROM st LEFT JOIN sp USING (year)
""")
def paper_metric_panel(t: Tables) -> DataFrame:
    """Deviations of scores and of review lengths by year."""
    return metrics.metric_panel(papers(t)).select("year", "n_papers", *r6("score_sd", "review_chars", "review_chars_sd"))


@query(_P + """
SELECT count(*) AS n_papers, sum(code::INT)::BIGINT AS n_code, count(DISTINCT cluster_id) AS n_clusters, (SELECT count(*) FROM r) AS n_reviews, (SELECT count(DISTINCT l_suppkey) FROM r) AS n_authors FROM p
""")
def paper_totals(t: Tables) -> DataFrame:
    """Totals over all years."""
    return metrics.totals(papers(t))


_FLOWS = _P + f", f AS (SELECT year, pre, post, count(*) AS n FROM r WHERE post IS NOT NULL GROUP BY ALL), v AS (SELECT {_V} AS v)"


@query(_FLOWS + "SELECT year, v[pre + 1] AS pre, v[post + 1] AS post, n FROM f, v")
def paper_verdict_flows(t: Tables) -> DataFrame:
    """Verdicts before and after rebuttal, counted by pair."""
    return metrics.verdict_flows(papers(t), ["year"])


@query(_FLOWS + """
SELECT year, sum(n)::BIGINT AS pairs, (coalesce(sum(n) FILTER (post > pre), 0))::BIGINT AS raised, (coalesce(sum(n) FILTER (post < pre), 0))::BIGINT AS lowered, (coalesce(sum(n) FILTER (pre < 3), 0))::BIGINT AS rejected,
       (coalesce(sum(n) FILTER (pre < 3 AND post >= 3), 0))::BIGINT AS rejected_to_accept, round(100 * coalesce(sum(n) FILTER (pre < 3 AND post >= 3), 0) / nullif(sum(n) FILTER (pre < 3), 0), 6) AS pct_to_accept
FROM f GROUP BY 1
""")
def paper_flow_summary(t: Tables) -> DataFrame:
    """Raised, lowered and turned verdicts by year."""
    s = metrics.flow_summary(metrics.verdict_flows(papers(t), ["year"]), ["year"])
    return s.select(*s.columns[:-1], *r6("pct_to_accept"))


@query(_FLOWS + """
SELECT year, sum(n)::BIGINT AS pairs, round(100 * coalesce(sum(n) FILTER (pre < 3 AND post >= 3), 0) / sum(n), 6) AS up, round(100 * coalesce(sum(n) FILTER (pre >= 3 AND post < 3), 0) / sum(n), 6) AS down
FROM f GROUP BY 1 HAVING sum(n) >= 30
""")
def paper_crossing_rates(t: Tables) -> DataFrame:
    """Shares of reviews that cross the line of acceptance, with minimum support."""
    return metrics.crossing_rates(metrics.verdict_flows(papers(t), ["year"]), ["year"]).select("year", "pairs", *r6("up", "down"))


@query(_P + "SELECT year, coalesce(bool_or(post IS NOT NULL), false) AS has_verdicts FROM p LEFT JOIN r USING (paper_id, year) GROUP BY 1")
def paper_has_verdicts(t: Tables) -> DataFrame:
    """Years in which any review has a verdict after rebuttal."""
    return metrics.has_verdicts_after_rebuttal(papers(t))


@query(_P + "SELECT paper_id, count(*) FILTER (post IS NOT NULL AND post <> pre) AS n_changed FROM r GROUP BY 1")
def paper_score_changes(t: Tables) -> DataFrame:
    """Reviews whose verdict after rebuttal is another, by paper."""
    r = papers(t).select("paper_id", F.explode("reviews").alias("r"))
    return r.groupBy("paper_id").agg(F.count_if(score_changed(F.col("r.recommendation_label"), F.col("r.post_rebuttal_label"))).alias("n_changed"))


@query(_P + "SELECT year, count(*) FILTER (type = 'oral') AS oral, count(*) FILTER (type = 'spotlight') AS spotlight, count(*) FILTER (type = 'poster') AS poster, round(100 * count(*) FILTER (type IN ('oral', 'spotlight')) / count(*), 6) AS selected FROM p WHERE type IS NOT NULL GROUP BY 1")
def paper_type_overview(t: Tables) -> DataFrame:
    """Presentation types and the selected share by year."""
    return metrics.type_overview(papers(t)).select("year", "oral", "spotlight", "poster", *r6("selected"))


@query(_P + """
SELECT year, count(*) AS n_papers, count(*) FILTER (type = 'oral') AS n_oral, count(*) FILTER (type = 'spotlight') AS n_spotlight, round(100 * avg(coalesce(type IN ('oral', 'spotlight'), false)::INT), 6) AS pct_selected,
       round(100 * avg(early::INT) FILTER (type IN ('oral', 'spotlight')), 6) AS early_selected, round(100 * avg(early::INT) FILTER (type = 'poster'), 6) AS early_poster, bool_and(type IS NOT NULL) AS all_matched
FROM p GROUP BY 1
""")
def paper_page_summary(t: Tables) -> DataFrame:
    """A year's papers, talks and early rates on one row."""
    s = metrics.page_summary(papers(t))
    return s.select("year", "n_papers", "n_oral", "n_spotlight", *r6("pct_selected", "early_selected", "early_poster"), "all_matched")


_REPORT = _P + """,
sel AS (SELECT * FROM p WHERE type IN ('oral', 'spotlight')),
tk AS (SELECT year, count(*) AS extracted, count(*) FILTER (cluster_id <> 7 OR year % 2 = 0) AS matched FROM sel GROUP BY 1),
g AS (SELECT year, type, round(score, 9) AS score, count(*) AS n FROM p JOIN s USING (paper_id) WHERE score IS NOT NULL AND type IN ('oral', 'poster') GROUP BY ALL),
dl AS (SELECT a.year, sum(a.n * b.n * CASE WHEN a.score > b.score THEN 1 WHEN a.score < b.score THEN -1 ELSE 0 END) / sum(a.n * b.n) AS delta FROM g a JOIN g b ON a.year = b.year AND a.type = 'oral' AND b.type = 'poster' GROUP BY 1),
rep AS (
  SELECT year, count(*) AS n_papers, count(*) FILTER (type = 'oral') AS n_oral, count(*) FILTER (type = 'spotlight') AS n_spotlight, count(*) FILTER (type IN ('oral', 'spotlight')) AS n_selected,
         100 * count(*) FILTER (type IN ('oral', 'spotlight')) / count(*) AS pct_selected, 100 * avg(coalesce(early, false)::INT) FILTER (type = 'oral') AS early_oral, 100 * avg(coalesce(early, false)::INT) FILTER (type = 'poster') AS early_poster
  FROM p GROUP BY 1 HAVING count(*) FILTER (type IN ('oral', 'spotlight')) > 0),
rp AS (SELECT rep.*, delta, extracted, matched, 100 * matched / extracted AS match_rate FROM rep LEFT JOIN dl USING (year) LEFT JOIN tk USING (year))
"""


def report(t: Tables) -> DataFrame:
    """The page report of papers whose talks are matched but for one group of odd years."""
    p = papers(t).withColumn("avg_score_raw", F.round("avg_score_raw", 9))
    found = (F.col("cluster_id") != 7) | (F.col("year") % 2 == 0)
    talks = p.where(F.col("presentation_type").isin("oral", "spotlight")).select("year", F.when(found, F.col("paper_id")).alias("paper_id"), F.col("presentation_type").alias("type"), F.when(found, "exact").otherwise("unmatched").alias("match"))
    return metrics.page_report(p, talks, n_boot=0)


@query(_REPORT + "SELECT year, n_papers, n_oral, n_spotlight, n_selected, round(pct_selected, 6) AS pct_selected, round(early_oral, 6) AS early_oral, round(early_poster, 6) AS early_poster, round(delta, 6) AS delta, extracted, matched, round(match_rate, 6) AS match_rate FROM rp")
def paper_page_report(t: Tables) -> DataFrame:
    """A year's page: papers, talks, early rates, effect of orals against posters, match."""
    return report(t).select("year", "n_papers", "n_oral", "n_spotlight", "n_selected", *r6("pct_selected", "early_oral", "early_poster", "delta"), "extracted", "matched", *r6("match_rate"))


@query(_REPORT + """
SELECT array_to_string(list(year ORDER BY year), ',') AS years, sum(n_papers)::BIGINT AS total_papers, sum(n_selected)::BIGINT AS total_selected, round(100 * sum(n_selected) / sum(n_papers), 6) AS pct_selected,
       round(min(delta), 6) AS delta_min, arg_min(year, (delta, year)) FILTER (delta IS NOT NULL) AS delta_min_year, round(max(delta), 6) AS delta_max, arg_min(year, (-delta, year)) FILTER (delta IS NOT NULL) AS delta_max_year,
       round(min(pct_selected), 6) AS pct_selected_min, round(max(pct_selected), 6) AS pct_selected_max, bool_and(match_rate = 100) AS all_matched FROM rp
""")
def paper_page_totals(t: Tables) -> DataFrame:
    """Totals and extremes over the years of the page report."""
    out = metrics.page_totals(report(t)).withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))
    return out.select("years", "total_papers", "total_selected", *r6("pct_selected", "delta_min"), "delta_min_year", *r6("delta_max"), "delta_max_year", *r6("pct_selected_min", "pct_selected_max"), "all_matched")


@query(_P + """,
c AS (SELECT year, raw::BIGINT AS score, count(*) AS n, sum(coalesce(early, false)::INT)::BIGINT AS n_early, max(top) AS top FROM r WHERE raw IS NOT NULL GROUP BY 1, 2),
f AS (SELECT year, unnest(range(1, max(top) + 1)) AS score FROM c GROUP BY 1)
SELECT year, score::BIGINT AS score, coalesce(n, 0)::BIGINT AS n, coalesce(n_early, 0)::BIGINT AS n_early FROM f LEFT JOIN c USING (year, score)
""")
def paper_score_distribution(t: Tables) -> DataFrame:
    """Reviewers' scores by year, of all papers and of those accepted early."""
    return metrics.score_distribution(papers(t))


@query(_P + """,
v AS (SELECT year, round(score, 9) AS v, coalesce(early, false)::INT AS early FROM p JOIN s USING (paper_id) WHERE score IS NOT NULL),
sc AS (SELECT year, max(top) AS scale FROM r GROUP BY 1),
e AS (SELECT year, min(v) AS lo, max(v) AS hi, 2 * (any_value(scale) - 1) AS bins FROM v JOIN sc USING (year) GROUP BY 1),
c AS (SELECT year, least(floor((v - lo) / ((hi - lo) / bins)), bins - 1)::INT AS bin, count(*) AS n, sum(early)::BIGINT AS n_early FROM v JOIN e USING (year) GROUP BY 1, 2),
f AS (SELECT year, lo, (hi - lo) / bins AS width, unnest(range(0, bins))::INT AS bin FROM e)
SELECT year, bin, round(lo + bin * width, 6) AS "left", round(lo + bin * width + width, 6) AS "right", coalesce(n, 0)::BIGINT AS n, coalesce(n_early, 0)::BIGINT AS n_early FROM f LEFT JOIN c USING (year, bin)
""")
def paper_average_histograms(t: Tables) -> DataFrame:
    """Papers' average scores in bins that early papers share."""
    d = metrics.average_histograms(papers(t).withColumn("avg_score_raw", F.round("avg_score_raw", 9)))
    return d.select("year", "bin", *r6("left", "right"), "n", "n_early")


@query(_P + """,
c AS (SELECT year, score_range, count(*) AS n FROM (SELECT year, paper_id, (max(raw) - min(raw))::BIGINT AS score_range FROM r WHERE NOT coalesce(early, false) GROUP BY 1, 2 HAVING count(raw) > 0) GROUP BY 1, 2),
f AS (SELECT year, unnest(range(min(score_range), max(score_range) + 1)) AS score_range FROM c GROUP BY 1)
SELECT year, score_range, coalesce(n, 0)::BIGINT AS n FROM f LEFT JOIN c USING (year, score_range)
""")
def paper_disagreement(t: Tables) -> DataFrame:
    """Score ranges of papers that weren't accepted early."""
    return metrics.disagreement(papers(t))


@query(_P + "SELECT DISTINCT year FROM p WHERE type IN ('oral', 'spotlight')")
def paper_years_with_talks(t: Tables) -> DataFrame:
    return metrics.years_with_talks(papers(t))


@query(_P + "SELECT year, max(top)::INT AS scale FROM p LEFT JOIN r USING (paper_id, year) GROUP BY 1")
def paper_scales(t: Tables) -> DataFrame:
    """The largest score a year's reviews could give."""
    return metrics.scales(papers(t))


@query(_P + "SELECT subject, count(*) AS n FROM (SELECT unnest([status, substr(priority, 3)]) AS subject FROM p) GROUP BY 1")
def paper_short_subjects(t: Tables) -> DataFrame:
    """Papers by short subject."""
    return metrics.count_short_subjects(papers(t))


@query(_P + "SELECT tag, count(*) AS n FROM (SELECT DISTINCT paper_id, 'S' || l_suppkey AS tag FROM r) GROUP BY 1")
def paper_author_counts(t: Tables) -> DataFrame:
    """Papers by author."""
    return metrics.count_tags(papers(t), "authors")


@query(_P + """,
w AS (SELECT year, paper_id, title, len(string_split(title, ' '))::INT AS words, (SELECT count(DISTINCT l_suppkey) FROM r WHERE r.paper_id = p.paper_id)::INT AS n_authors FROM p),
x AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY words DESC, paper_id) AS a, row_number() OVER (PARTITION BY year ORDER BY words, paper_id) AS b, row_number() OVER (PARTITION BY year ORDER BY n_authors DESC, paper_id) AS c FROM w)
SELECT year, 'longest' AS kind, a::INT AS rank, paper_id, title, words AS size FROM x WHERE a <= 5
UNION ALL SELECT year, 'shortest', b::INT, paper_id, title, words FROM x WHERE b <= 5
UNION ALL SELECT year, 'most_authors', c::INT, paper_id, title, n_authors FROM x WHERE c <= 5
""")
def paper_title_extremes(t: Tables) -> DataFrame:
    """Longest and shortest titles, most authors, five of each by year."""
    return ranking.title_extremes(papers(t))


_SCORED = _P + """,
m AS (
  SELECT year, paper_id, any_value(title) AS title, avg(raw) AS mean, CASE WHEN count(post_raw) > 0 THEN avg(coalesce(post_raw, raw)) END AS mean_post,
         CASE WHEN count(post_raw) = 0 AND count(post) > 0 THEN avg(coalesce(post, pre)) END AS mean_rank, avg(pre) AS mean_pre
  FROM r GROUP BY 1, 2 HAVING count(raw) > 0),
k AS (SELECT *, coalesce(mean_post - mean, mean_rank - coalesce(mean_pre, mean_rank)) AS improvement,
             CASE WHEN max(mean_post) OVER (PARTITION BY year) IS NOT NULL THEN 'scores' WHEN max(mean_rank) OVER (PARTITION BY year) IS NOT NULL THEN 'verdicts' END AS mode FROM m),
b AS (SELECT *, CASE WHEN mode = 'scores' THEN mean_post ELSE mean_rank END AS first, CASE WHEN mode = 'verdicts' THEN mean END AS last FROM k)
"""


@query(_SCORED + "SELECT year, rank, paper_id, round(mean, 6) AS mean FROM (SELECT *, (row_number() OVER (PARTITION BY year ORDER BY mean DESC, title, paper_id))::INT AS rank FROM b) WHERE rank <= 20")
def paper_top_overall(t: Tables) -> DataFrame:
    """Best papers of each year by mean score."""
    return ranking.top_papers(papers(t))[0].select("year", "rank", "paper_id", *r6("mean"))


@query(_SCORED + """
SELECT year, rank, paper_id, mode, round(mean_post, 6) AS mean_post, round(mean_rank, 6) AS mean_rank, round(improvement, 6) AS improvement FROM (
  SELECT *, (row_number() OVER (PARTITION BY year ORDER BY first DESC, improvement DESC, last DESC, title, paper_id))::INT AS rank FROM b WHERE first IS NOT NULL) WHERE rank <= 20
""")
def paper_top_after_rebuttal(t: Tables) -> DataFrame:
    """Best papers after rebuttal, earlier scores carried forward; by verdicts in years without scores."""
    return ranking.top_papers(papers(t))[1].select("year", "rank", "paper_id", "mode", *r6("mean_post", "mean_rank", "improvement"))


@query(_P + """,
c(comparison, a, b) AS (VALUES ('oral vs poster', 'oral', 'poster'), ('spotlight vs poster', 'spotlight', 'poster'), ('oral vs spotlight', 'oral', 'spotlight')),
g AS (SELECT year, type, score, count(*) AS n FROM p JOIN s USING (paper_id) WHERE score IS NOT NULL AND type IS NOT NULL GROUP BY ALL),
t AS (SELECT year, type, sum(n)::BIGINT AS n FROM g GROUP BY ALL),
d AS (SELECT g.year, comparison, sum(g.n * h.n * CASE WHEN g.score > h.score THEN 1 WHEN g.score < h.score THEN -1 ELSE 0 END) AS won
      FROM c JOIN g ON g.type = c.a JOIN g h ON h.type = c.b AND h.year = g.year GROUP BY ALL)
SELECT d.year, d.comparison, x.n AS n_a, z.n AS n_b, round(won / (x.n * z.n), 6) AS delta
FROM d JOIN c ON d.comparison = c.comparison JOIN t x ON x.type = c.a AND x.year = d.year JOIN t z ON z.type = c.b AND z.year = d.year WHERE x.n >= 3 AND z.n >= 3
""")
def paper_effects(t: Tables) -> DataFrame:
    """Cliff's delta of scores between presentation types, by year."""
    p = papers(t).select("year", "presentation_type", F.round("avg_score_raw", 9).alias("score"))
    return metrics.effects(p, "score").select("year", "comparison", "n_a", "n_b", *r6("delta"))


@query("""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
c AS (SELECT label AS k, pos, avg(x) AS c FROM e GROUP BY 1, 2),
d AS (SELECT vec_id, any_value(label) AS label, k, sum((x - c) * (x - c)) AS d2 FROM e JOIN c USING (pos) GROUP BY vec_id, k),
n AS (SELECT vec_id, any_value(label) AS label, arg_min(k, (d2, k)) AS nearest FROM d GROUP BY 1)
SELECT round(avg((label = nearest)::INT), 6) AS agreement FROM n
""")
def cluster_agreement_gate(t: Tables) -> DataFrame:
    """The gate's own figure: members nearest to their centroid, with no lower limit."""
    _, share = clustering.self_agreement(vectors(t), least=0.0)
    return t.spark.createDataFrame([(round(share, 6),)], "agreement double")
