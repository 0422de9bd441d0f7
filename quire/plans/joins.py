"""Joins, matching, set operations and ingestion on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import layout, matching, metrics, ranking
from quire.plans.registry import Tables, query
from quire.runtime import work_dir
from quire.sources import readers
from quire.streaming import incremental


@query("SELECT d.doc_id, lang, coalesce(quality, -1)::INT AS quality, coalesce(toxic, 0)::INT AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_default(t: Tables) -> DataFrame:
    """Left join whose missing values take defaults."""
    return matching.join_default(t.documents.select("doc_id", "lang"), t.labels, "doc_id", {"quality": -1, "toxic": 0})


@query("SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'oral' WHEN l.doc_id IS NOT NULL THEN 'spotlight' ELSE 'poster' END AS presentation_type FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def attach_types(t: Tables) -> DataFrame:
    """Types from a second table, a default for the rest."""
    talks = t.labels.select(F.col("doc_id").alias("paper_id"), F.when(F.col("toxic") == 1, "oral").otherwise("spotlight").alias("type"), F.lit("s").alias("session_title"), F.lit("1").alias("session_id"))
    return matching.attach_types(t.documents.select(F.col("doc_id").alias("paper_id")), talks).select(F.col("paper_id").alias("doc_id"), "presentation_type")


@query("SELECT item_id AS needle_id, doc_id AS hay_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def exact_containment(t: Tables) -> DataFrame:
    """Benchmark items that stand whole in a document."""
    return matching.contained_in(t.benchmark, t.documents, needle_id="item_id", needle="text", hay_id="doc_id", text="text")


@query("SELECT item_id AS needle_id, doc_id AS hay_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 3, 34))")
def inner_containment(t: Tables) -> DataFrame:
    """Short pieces of benchmark items, cut inside words, that stand in a document."""
    pieces = t.benchmark.select("item_id", F.substring("text", 3, 34).alias("text"))
    return matching.contained_in(pieces, t.documents, needle_id="item_id", needle="text", hay_id="doc_id", text="text")


@query()
def fuzzy_match_cascade(t: Tables) -> DataFrame:
    """Part names with a lost or doubled letter, matched to the parts of their type."""
    parts = t.part.select(F.col("p_type").alias("year"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string"), F.hex(F.xxhash64("p_partkey"))).alias("title"))
    papers = parts.select("year", F.col("id").cast("string").alias("paper_id"), "title", F.array(F.concat(F.lit("Maker"), F.col("id") % 7, F.lit(", A"))).alias("authors"))
    changed = F.when(F.col("id") % 3 == 0, F.expr("overlay(title PLACING '' FROM 4 FOR 1)")).when(F.col("id") % 3 == 1, F.upper("title")).otherwise(F.expr("overlay(title PLACING 'xyzw' FROM 2 FOR 4)"))
    talks = parts.select("year", F.col("id").alias("ord"), changed.alias("title_raw"), F.concat(F.lit("A Maker"), F.col("id") % 7, F.lit(", Lab")).alias("speaker"))
    none = t.spark.createDataFrame([], "year string, norm_title string, paper_id string, is_skip boolean")
    m = matching.match_talks(talks, papers, none)
    return m.select("year", "ord", "paper_id", "match", F.round("best_score", 4).alias("best_score"))


@query("""
WITH m AS (SELECT o_orderkey % 7 AS year, o_orderpriority AS type, CASE WHEN o_orderstatus = 'P' THEN 'unmatched' WHEN o_totalprice < 20000 THEN 'skipped' ELSE 'exact' END AS match FROM orders)
SELECT year, count(*) AS extracted, count(*) FILTER (match = 'exact') AS matched, count(*) FILTER (match = 'skipped') AS skipped, count(*) FILTER (match = 'unmatched') AS unmatched,
       round(100 * count(*) FILTER (match = 'exact') / greatest(count(*) - count(*) FILTER (match = 'skipped'), 1), 6) AS match_rate_pct
FROM m GROUP BY year
""")
def match_summary(t: Tables) -> DataFrame:
    """Counts and rate of a match by year."""
    kind = F.when(F.col("o_orderstatus") == "P", "unmatched").when(F.col("o_totalprice") < 20000, "skipped").otherwise("exact")
    m = t.orders.select((F.col("o_orderkey") % 7).alias("year"), F.col("o_orderpriority").alias("type"), kind.alias("match"), "o_orderkey")
    m = m.withColumn("paper_id", F.when(F.col("match") == "exact", F.col("o_orderkey").cast("string")))
    return metrics.match_summary(m).select("year", "extracted", *[F.col(c).cast("long").alias(c) for c in ("matched", "skipped", "unmatched")], F.round("match_rate_pct", 6).alias("match_rate_pct"))


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 45")
def join_exactly_one(t: Tables) -> DataFrame:
    """Inner join on a key that must be unique on the right."""
    left = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_orderkey").cast("string").alias("name"))
    out = matching.join_exactly_one(left, t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus"), "k", "name")
    return out.select(F.col("k").alias("l_orderkey"), "l_linenumber", "o_orderstatus")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def missing_ids(t: Tables) -> DataFrame:
    """Keys of one table that another lacks."""
    return incremental.resume(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id")), "id")


@query("SELECT n_nationkey::INT AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey::INT, r_name FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)")
def worklist_union(t: Tables) -> DataFrame:
    """First list, then what the second has beyond it."""
    a = t.nation.select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("name"))
    return matching.worklist(a, t.region.select(F.col("r_regionkey").cast("int").alias("k"), F.col("r_name").alias("name")), "name")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_wins_distinct(t: Tables) -> DataFrame:
    """The first event of each user."""
    return ranking.first_of_each(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s FROM events),
f AS (SELECT *, (s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) >= 21600 OR lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) IS NULL)::INT AS start FROM e),
b AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM f)
SELECT user_id, max(block)::BIGINT AS blocks, count(*) AS n FROM b GROUP BY user_id
""")
def sessionise_gap(t: Tables) -> DataFrame:
    """Blocks of events parted by gaps of six hours."""
    e = t.events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    b = layout.sessionise(e, ["user_id"], ["s", "event_id"], layout.gap_starts("s", ["user_id"], ["s", "event_id"], 21600.0), "block")
    return b.groupBy("user_id").agg(F.max("block").alias("blocks"), F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT conv_id, turn, (role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS start FROM conversations),
b AS (SELECT conv_id, turn, sum(start) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM c)
SELECT conv_id, block::BIGINT AS block, min(turn) AS first_turn, count(*) AS n FROM b GROUP BY 1, 2
""")
def sessionise_blocks(t: Tables) -> DataFrame:
    """Runs of one role in a conversation."""
    from pyspark.sql.window import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = layout.sessionise(t.conversations.select("conv_id", "turn", "role").withColumn("start", ~F.col("role").eqNullSafe(before)), ["conv_id"], ["turn"], F.col("start"), "block")
    return c.groupBy("conv_id", "block").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(t: Tables) -> DataFrame:
    """Events by hour and type."""
    return incremental.windowed_counts(t.events).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY event_type")
def incremental_ingest(t: Tables) -> DataFrame:
    """The events, written in two parts and ingested in two runs; a third finds nothing new."""
    base = f"{work_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    e = t.events
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema.fields)
    args = {"schema": schema, "sink": f"{base}/sink", "checkpoint": f"{base}/check", "key": "event_id"}
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        e.where(part).write.mode("append").parquet(f"{base}/in")
        incremental.ingest(t.spark, f"{base}/in", **args)
    incremental.ingest(t.spark, f"{base}/in", **args)
    return t.spark.read.parquet(f"{base}/sink").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"))


@query("SELECT r_name, count(n_name) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def optional_source(t: Tables) -> DataFrame:
    """A join with a source that is there, and a union with one that isn't."""
    absent = readers.optional(t.spark, f"{t.sf_dir}/absent.json", "n_regionkey int, n_name string")
    n = t.nation.select("n_regionkey", "n_name").unionByName(absent)
    return t.region.join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name").agg(F.count("n_name").alias("n"))
