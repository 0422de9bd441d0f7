"""Aggregations, shares, rates, effect sizes, densities and ranks on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import stats
from quire.functions.text import BUZZWORDS, FIRST_WORD_STOPWORDS, chars_without_space
from quire.operators import metrics, ranking
from quire.plans.registry import Tables, query

R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]

_WILSON = """round(k / n, 6) AS rate,
  round(greatest(0, ((k / n + 3.841458818926600225 / (2 * n)) / (1 + 3.841458818926600225 / n)) - (1.959963985 / (1 + 3.841458818926600225 / n)) * sqrt((k / n) * (1 - k / n) / n + 3.841458818926600225 / (4 * n * n))), 6) AS low,
  round(least(1, ((k / n + 3.841458818926600225 / (2 * n)) / (1 + 3.841458818926600225 / n)) + (1.959963985 / (1 + 3.841458818926600225 / n)) * sqrt((k / n) * (1 - k / n) / n + 3.841458818926600225 / (4 * n * n))), 6) AS high"""


def labelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")


@query(f"""
WITH d AS (SELECT lang AS area, quality FROM documents JOIN labels USING (doc_id)),
base AS (SELECT 100 * avg(quality) AS baseline FROM d),
c AS (SELECT area, sum(quality)::BIGINT AS k, count(*) AS n FROM d GROUP BY area HAVING count(*) >= 5),
w AS (SELECT area, k, n, {_WILSON} FROM c)
SELECT area, k, n, round(100 * k / n, 4) AS rate, round(100 * low, 4) AS low, round(100 * high, 4) AS high,
       round(baseline, 4) AS baseline, round(100 * k / n - baseline, 4) AS diff FROM w, base
""")
def selection_rate_wilson(t: Tables) -> DataFrame:
    """Share of good documents by language against the baseline, Wilson bounds, minimum support."""
    d = labelled(t).select(F.col("lang").alias("area"), "doc_id", (F.col("quality") == 1).alias("selected"))
    out = metrics.selection_rates(d, d, key="doc_id", area="area", selected="selected", min_n=5)
    low = F.round(F.round(F.col("low") / 100, 6) * 100, 4)
    return out.select("area", "k", "n", F.round("rate", 4).alias("rate"), low.alias("low"), F.round(F.round(F.col("high") / 100, 6) * 100, 4).alias("high"), F.round("baseline", 4).alias("baseline"), F.round("diff", 4).alias("diff"))


@query("""
WITH o AS (SELECT o_orderstatus AS area, year(o_orderdate)::INT AS y, o_orderpriority = '1-URGENT' AS s FROM orders),
g AS (SELECT y, area, count(*) FILTER (s) AS k, count(*) AS n FROM o GROUP BY GROUPING SETS ((y, area), (area))),
b AS (SELECT y, 100 * avg(s::INT) AS baseline FROM o GROUP BY GROUPING SETS ((y), ()))
SELECT coalesce(g.y, 0) AS y, area, k, n, round(100 * k / n, 6) AS rate, round(100 * k / n - baseline, 6) AS diff
FROM g JOIN b ON g.y IS NOT DISTINCT FROM b.y WHERE n >= 25
""")
def grouping_all_plus_each(t: Tables) -> DataFrame:
    """The same for all orders together and each year."""
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("area"), (F.col("o_orderpriority") == "1-URGENT").alias("s"))
    return metrics.selection_rates(o, o, key="id", area="area", selected="s", window="y").select(F.coalesce("y", F.lit(0)).alias("y"), "area", "k", "n", *R6("rate", "diff"))


@query(f"""
WITH c AS (SELECT lang, source, sum(toxic)::BIGINT AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, source)
SELECT lang, source, k, n, {_WILSON} FROM c
""")
def rate_by_type_wilson(t: Tables) -> DataFrame:
    """Rate of a boolean by group with Wilson bounds."""
    return metrics.rate_by(labelled(t), ["lang", "source"], F.col("toxic") == 1).select("lang", "source", "k", "n", *R6("rate", "low", "high"))


@query("""
SELECT year(o_orderdate)::INT AS y, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers,
       round(100 * avg((o_orderpriority = '1-URGENT')::INT), 6) AS pct_urgent, round(avg(o_totalprice), 4) AS avg_price,
       round(stddev_pop(o_totalprice), 4) AS sd_price, sum((o_orderstatus = 'F')::INT)::BIGINT AS n_done
FROM orders GROUP BY y
""")
def year_panel(t: Tables) -> DataFrame:
    """Year statistics: counts, distinct counts, percentages, mean and population deviation."""
    return t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers"), F.round(100 * F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")), 6).alias("pct_urgent"),
        F.round(F.avg("o_totalprice"), 4).alias("avg_price"), F.round(F.stddev_pop("o_totalprice"), 4).alias("sd_price"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("n_done"),
    )


def type_shares(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"))
    i = t.lineitem.select(F.col("l_orderkey").alias("paper_id"), "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("area")), "l_partkey")
    return metrics.share_with_presence(i.join(o, "paper_id").select("paper_id", "year", "area"), o)


_SHARES = """
WITH o AS (SELECT o_orderkey AS id, year(o_orderdate)::INT AS year FROM orders),
n AS (SELECT year, p_type AS area, count(DISTINCT id) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN o ON l_orderkey = id GROUP BY year, area),
y AS (SELECT year, count(*) AS total FROM o GROUP BY year),
shares AS (SELECT year, area, n, 100 * n / y.total AS share, count(*) OVER (PARTITION BY area) AS presence, (sum(n) OVER (PARTITION BY area))::BIGINT AS total FROM n JOIN y USING (year))
"""


@query(_SHARES + "SELECT year, area, n, round(share, 6) AS share, presence, total FROM shares")
def share_presence_all_years(t: Tables) -> DataFrame:
    """Distinct items per year and area, share of the year, presence over years."""
    return type_shares(t).select("year", "area", "n", F.round("share", 6).alias("share"), "presence", "total")


@query(_SHARES + "SELECT year, area, row_number() OVER (PARTITION BY year ORDER BY share DESC, area)::INT AS rank FROM shares")
def rank_by_year(t: Tables) -> DataFrame:
    """Rank of an area within its year."""
    return ranking.rank_in(type_shares(t), ["year"], F.desc("share"), "area").select("year", "area", "rank")


@query(_SHARES + """,
pairs AS (SELECT a.year AS y0, b.year AS y1, a.area, a.share AS s0, b.share AS s1, b.share - a.share AS change
          FROM shares a JOIN shares b ON a.area = b.area AND a.year < b.year WHERE a.total >= 30 AND a.share > 0 AND b.share > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y0, y1 ORDER BY change, area) AS l,
                  row_number() OVER (PARTITION BY y0, y1 ORDER BY change DESC, area DESC) AS h FROM pairs)
SELECT y0, y1, area, round(s0, 6) AS s0, round(s1, 6) AS s1, round(change, 6) AS change, 'low' AS "end" FROM ranked WHERE l <= 2
UNION ALL
SELECT y0, y1, area, round(s0, 6), round(s1, 6), round(change, 6), 'high' FROM ranked WHERE h <= 2
""")
def movers_window(t: Tables) -> DataFrame:
    """Largest falls and rises of shares for every pair of years."""
    return ranking.movers(type_shares(t), k=2).select("y0", "y1", "area", *R6("s0", "s1", "change"), "end")


@query("""
WITH e AS (SELECT event_type AS post, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pre FROM events)
SELECT pre, post, count(*) AS n FROM e WHERE pre IS NOT NULL GROUP BY pre, post
""")
def transition_matrix(t: Tables) -> DataFrame:
    """Counts of consecutive event types of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.select(F.lag("event_type").over(w).alias("pre"), F.col("event_type").alias("post"))
    return e.where("pre IS NOT NULL").groupBy("pre", "post").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (SELECT user_id, event_type IN ('purchase', 'click') AS b, lag(event_type IN ('purchase', 'click')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events),
c AS (SELECT user_id, count(*) AS pairs, count(*) FILTER (NOT a AND b) AS u, count(*) FILTER (a AND NOT b) AS d FROM e WHERE a IS NOT NULL GROUP BY user_id HAVING count(*) >= 30)
SELECT user_id, pairs, round(100 * u / pairs, 6) AS up, round(100 * d / pairs, 6) AS down FROM c
""")
def crossing_rate(t: Tables) -> DataFrame:
    """Rates at which users cross between two sides, with minimum support."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    side = F.col("event_type").isin("purchase", "click")
    e = t.events.select("user_id", "ts", "event_id", side.alias("b")).select("user_id", "b", F.lag("b").over(w).alias("a")).where("a IS NOT NULL")
    c = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(~F.col("a") & F.col("b")).alias("u"), F.count_if(F.col("a") & ~F.col("b")).alias("d")).where("pairs >= 30")
    return c.select("user_id", "pairs", F.round(100 * F.col("u") / F.col("pairs"), 6).alias("up"), F.round(100 * F.col("d") / F.col("pairs"), 6).alias("down"))


@query("""
WITH b AS (SELECT unnest(range(min(l_quantity)::BIGINT, max(l_quantity)::BIGINT + 1)) AS bin FROM lineitem),
c AS (SELECT l_quantity::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1)
SELECT b.bin, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bin = c.bin
""")
def histogram_discrete(t: Tables) -> DataFrame:
    """Unit bins, empty ones included."""
    return stats.histogram_discrete(t.lineitem, "l_quantity")


@query("""
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
c AS (SELECT o_orderstatus, least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9)::INT AS bin, count(*) AS n FROM orders, e GROUP BY 1, 2),
f AS (SELECT s.o_orderstatus, r.bin, lo, (hi - lo) / 10 AS w FROM (SELECT DISTINCT o_orderstatus FROM orders) s, (SELECT unnest(range(10))::INT AS bin) r, e)
SELECT f.o_orderstatus, f.bin, round(lo + f.bin * w, 4) AS "left", round(lo + (f.bin + 1) * w, 4) AS "right", coalesce(n, 0) AS n
FROM f LEFT JOIN c ON f.o_orderstatus = c.o_orderstatus AND f.bin = c.bin
""")
def histogram_binned(t: Tables) -> DataFrame:
    """Equal bins with shared edges by group, the last one closed on the right."""
    h = stats.histogram_binned(t.orders, "o_totalprice", 10, ["o_orderstatus"])
    return h.select("o_orderstatus", "bin", F.round("left", 4).alias("left"), F.round("right", 4).alias("right"), "n")


@query("""
WITH s AS (SELECT l_returnflag AS g, count(*)::DOUBLE AS n, stddev_samp(l_quantity) AS sd, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr FROM lineitem GROUP BY 1 HAVING count(*) >= 10),
b AS (SELECT g, n, greatest(0.9 * (CASE WHEN iqr > 0 THEN least(sd, iqr / 1.349) ELSE sd END) * pow(n, -0.2), 0.45) AS bw FROM s),
x AS (SELECT lo + i * (hi - lo) / 239 AS x FROM (SELECT min(l_quantity) - 0.75 AS lo, max(l_quantity) + 0.75 AS hi FROM lineitem), (SELECT unnest(range(240)) AS i)),
c AS (SELECT l_returnflag AS g, l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1, 2)
SELECT c.g AS l_returnflag, round(x, 6) AS x, round(sum(c.c * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw)) / (n * bw * sqrt(2 * pi()))), 8) AS density
FROM c JOIN b ON c.g = b.g, x GROUP BY c.g, x.x
""")
def kde_grid(t: Tables) -> DataFrame:
    """Gaussian densities by group on a shared grid."""
    d = stats.kde(t.lineitem, ["l_returnflag"], "l_quantity")
    return d.select("l_returnflag", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


_DELTA = """
WITH d AS (SELECT n_chars::DOUBLE AS v, quality = 1 AS s, toxic FROM documents JOIN labels USING (doc_id)),
g AS (SELECT 'all' AS stratum, v, s FROM d UNION ALL SELECT 'toxic', v, s FROM d WHERE toxic = 1 UNION ALL SELECT 'clean', v, s FROM d WHERE toxic = 0),
r AS (SELECT a.stratum, avg(sign(a.v - b.v)) AS delta FROM g a JOIN g b ON a.stratum = b.stratum WHERE a.s AND NOT b.s GROUP BY a.stratum),
n AS (SELECT stratum, count(*) FILTER (s) AS n_a, count(*) FILTER (NOT s) AS n_b FROM g GROUP BY stratum)
SELECT stratum, n_a, n_b, round(delta, 6) AS delta,
       CASE WHEN delta IS NULL THEN 'n/a' WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude
FROM n LEFT JOIN r USING (stratum)
"""


@query(_DELTA)
def stratified_delta(t: Tables) -> DataFrame:
    """Cliff's delta of text length between good and bad documents: all, toxic, clean."""
    strata = F.filter(F.array(F.lit("all"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("toxic") == 0, "clean")), lambda s: s.isNotNull())
    d = labelled(t).select("n_chars", (F.col("quality") == 1).alias("s"), F.explode(strata).alias("stratum"))
    return stats.cliffs_delta(d, ["stratum"], "n_chars", "s").select("stratum", "n_a", "n_b", F.round("delta", 6).alias("delta"), "magnitude")


@query()
def bootstrap_mean_ci(t: Tables) -> DataFrame:
    """Percentile bootstrap of the mean length by language."""
    return stats.bootstrap_mean(labelled(t), ["lang"], "n_chars")


@query()
def bootstrap_delta_ci(t: Tables) -> DataFrame:
    """Cliff's delta with bootstrap bounds by language."""
    return stats.bootstrap_delta(labelled(t).withColumn("s", F.col("quality") == 1), ["lang"], "n_chars", "s")


@query("""
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, n FROM c ORDER BY n DESC, o_custkey LIMIT 20
""")
def top_k_ties(t: Tables) -> DataFrame:
    """The twenty most frequent values; ties by key."""
    c = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_k(c, 20, F.desc("n"), "o_custkey")


@query("""
WITH d AS (SELECT lang, doc_id, n_chars FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INT AS a, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id)::INT AS b FROM d)
SELECT lang, 'longest' AS kind, a AS rank, doc_id, n_chars FROM r WHERE a <= 5
UNION ALL SELECT lang, 'shortest', b, doc_id, n_chars FROM r WHERE b <= 5
""")
def extremes(t: Tables) -> DataFrame:
    """The five longest and shortest documents of each language."""
    d = t.documents.select("lang", "doc_id", "n_chars")
    parts = [ranking.top_k_per(d, ["lang"], 5, o, "doc_id").select("lang", F.lit(k).alias("kind"), "rank", "doc_id", "n_chars") for k, o in (("longest", F.desc("n_chars")), ("shortest", F.asc("n_chars")))]
    return parts[0].unionByName(parts[1])


@query("""
WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT user_id, event_type, max(value) FILTER (i = 1) AS pre, max(value) FILTER (i = 2) AS post FROM e WHERE i <= 2 GROUP BY 1, 2),
m AS (SELECT user_id, avg(pre) AS mean, avg(coalesce(post, pre)) AS mean_post FROM p GROUP BY 1)
SELECT user_id, round(mean, 6) AS mean, round(mean_post, 6) AS mean_post, round(mean_post - mean, 6) AS improvement
FROM m ORDER BY m.mean_post DESC, user_id LIMIT 20
""")
def carry_forward_rank(t: Tables) -> DataFrame:
    """Means of second values, the first one carried forward where there is none."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = t.events.select("user_id", "event_type", "value", F.row_number().over(w).alias("i")).where("i <= 2")
    p = e.groupBy("user_id", "event_type").agg(F.max(F.when(F.col("i") == 1, F.col("value"))).alias("pre"), F.max(F.when(F.col("i") == 2, F.col("value"))).alias("post"))
    m = p.groupBy("user_id").agg(F.avg("pre").alias("mean"), F.avg(F.coalesce("post", "pre")).alias("mean_post"))
    top = ranking.top_k(m.withColumn("improvement", F.col("mean_post") - F.col("mean")), 20, F.desc("mean_post"), "user_id")
    return top.select("user_id", *R6("mean", "mean_post", "improvement"))


_TOPICS = {"and": [r"\band\b"], "the": [r"\bthe\b"], "symbols": [r"[#$%&]{3}"], "licence": [r"licen[cs]e", r"rights reserved"]}


@query("SELECT lang, topic, sum(hit)::BIGINT AS n, round(100 * sum(hit) / count(*), 6) AS pct FROM (" + " UNION ALL ".join(f"SELECT lang, '{k}' AS topic, regexp_matches(text, '(?i)" + "|".join(f"(?:{p})" for p in v) + "')::INT AS hit FROM documents" for k, v in _TOPICS.items()) + ") GROUP BY lang, topic")
def pattern_counts(t: Tables) -> DataFrame:
    """Documents in which any pattern of a topic is found."""
    return metrics.pattern_counts(t.documents, F.col("text"), _TOPICS, ["lang"]).select("lang", "topic", "n", F.round("pct", 6).alias("pct"))


@query()
def buzzword_counts(t: Tables) -> DataFrame:
    """The fixed topics of titles and abstracts, counted over documents."""
    return metrics.pattern_counts(t.documents, F.col("text"), BUZZWORDS)


@query("SELECT word, count(*) AS n FROM (SELECT rtrim(lower(regexp_extract(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^\\S+')), ':') AS word FROM documents) WHERE word <> '' AND word NOT IN (" + ", ".join(f"'{w}'" for w in FIRST_WORD_STOPWORDS) + ") GROUP BY word")
def first_word(t: Tables) -> DataFrame:
    """First words without stop words."""
    return metrics.first_words(t.documents, "text", FIRST_WORD_STOPWORDS)


@query("SELECT lang, count(*) AS n, sum(length(regexp_replace(text, '\\s', '', 'g')))::BIGINT AS chars, max(length(regexp_replace(text, '\\s', '', 'g')))::INT AS longest FROM documents GROUP BY lang")
def text_length(t: Tables) -> DataFrame:
    """Characters without white space."""
    return t.documents.select("lang", chars_without_space(F.col("text")).alias("c")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("chars"), F.max("c").alias("longest"))


@query("""
WITH m AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS n, round(avg(m), 6) AS mean FROM m GROUP BY 1 HAVING count(*) >= 3
""")
def mean_of_means(t: Tables) -> DataFrame:
    """Mean over users of their mean value by event type."""
    return metrics.group_mean_of_means(t.events, "user_id", ["event_type"], "value").select("event_type", "n", F.round("mean", 6).alias("mean"))


@query("""
SELECT c_mktsegment, count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (c_acctbal BETWEEN 0 AND 5000) AS middle,
       count(*) FILTER (c_acctbal > 5000) AS high, round(100 * count(*) FILTER (c_acctbal > 5000) / count(*), 6) AS pct_high
FROM customer GROUP BY 1
""")
def type_overview(t: Tables) -> DataFrame:
    """Counts by type as columns, and the selected share."""
    kind = F.when(F.col("c_acctbal") < 0, "negative").when(F.col("c_acctbal") <= 5000, "middle").otherwise("high")
    p = t.customer.withColumn("kind", kind).groupBy("c_mktsegment").pivot("kind", ["negative", "middle", "high"]).count()
    p = p.na.fill(0)
    return p.withColumn("pct_high", F.round(100 * F.col("high") / (F.col("negative") + F.col("middle") + F.col("high")), 6))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) AS n_types FROM events")
def grand_totals(t: Tables) -> DataFrame:
    return t.events.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("event_type").alias("n_types"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    """Keys that occur more than once."""
    return metrics.duplicate_keys(t.documents.select("text"), "text")


@query("""
WITH a AS (SELECT o_orderstatus AS k, avg(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT (SELECT k FROM a ORDER BY v, k LIMIT 1) AS low_key, round((SELECT min(v) FROM a), 4) AS low_value, (SELECT k FROM a ORDER BY v DESC, k LIMIT 1) AS high_key, round((SELECT max(v) FROM a), 4) AS high_value
""")
def extreme_groups(t: Tables) -> DataFrame:
    """Groups of the smallest and the largest mean."""
    a = t.orders.groupBy(F.col("o_orderstatus").alias("k")).agg(F.avg("o_totalprice").alias("v"))
    return metrics.extremes(a, "k", "v").select("low_key", F.round("low_value", 4).alias("low_value"), "high_key", F.round("high_value", 4).alias("high_value"))


@query("""
WITH c AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT v, n, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM c
""")
def cumulative_counts(t: Tables) -> DataFrame:
    """How many values lie below each one."""
    c = t.lineitem.groupBy(F.col("l_quantity").alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    return ranking.cumulative(c, ["one"], "v", "n", "below").drop("one")


_BRANDS = """
WITH b AS (SELECT p_brand AS brand, p_type AS kind, count(*) AS n, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (ORDER BY price, brand, kind) AS lo, row_number() OVER (ORDER BY price DESC, brand DESC, kind DESC) AS hi FROM b)
"""


def _brands(t: Tables) -> DataFrame:
    g = t.part.groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("price"))
    return g.withColumn("key", F.struct("brand", "kind"))


@query(_BRANDS + "SELECT brand, kind, n, price, 'low' AS \"end\" FROM k WHERE lo <= 8 UNION ALL SELECT brand, kind, n, price, 'high' FROM k WHERE hi <= 8")
def both_ends(t: Tables) -> DataFrame:
    """The eight cheapest and the eight dearest kinds of parts."""
    return ranking.both_ends(_brands(t), 8, "price", "key").drop("key")


@query(_BRANDS + "SELECT brand, kind, n, price FROM k WHERE lo <= 15 OR hi <= 15 OR (SELECT count(*) FROM b) <= 30")
def half_and_half(t: Tables) -> DataFrame:
    """Thirty kinds of parts, half of them from each end, or all where there are fewer."""
    return ranking.half_and_half(_brands(t), 30, "price", "key").drop("key")
