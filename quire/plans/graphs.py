"""Co-occurrence graphs on the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import drawing, graph
from quire.plans.registry import Tables, query

_PAIRS = """
WITH RECURSIVE d AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS x FROM lineitem),
edges AS (SELECT a.x AS u, b.x AS v, count(*) AS weight FROM d a JOIN d b ON a.g = b.g AND a.x < b.x GROUP BY 1, 2)
"""


def pairs(t: Tables) -> DataFrame:
    return graph.cooccurrence(t.lineitem, "l_orderkey", "l_suppkey")


def strong(t: Tables) -> DataFrame:
    """Pairs of parts ordered together: sparse, so that there are several components."""
    o = t.orders.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return graph.cooccurrence(t.lineitem.join(o, "l_orderkey", "left_semi").where("l_quantity > 40"), "l_orderkey", "l_partkey")


@query(_PAIRS + "SELECT u, v, weight FROM edges")
def coappearance_pairs(t: Tables) -> DataFrame:
    """Weighted pairs of suppliers in one order."""
    return pairs(t)


@query(_PAIRS + "SELECT id, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT u AS id, weight FROM edges UNION ALL SELECT v, weight FROM edges) GROUP BY id")
def degrees(t: Tables) -> DataFrame:
    return graph.degrees(pairs(t))


_STRONG = """
WITH RECURSIVE d AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND l_quantity > 40),
edges AS (SELECT DISTINCT a.x AS u, b.x AS v FROM d a JOIN d b ON a.g = b.g AND a.x <> b.x),
reach AS (SELECT u AS id, u AS r FROM edges UNION SELECT e.v, reach.r FROM reach JOIN edges e ON e.u = reach.id)
"""


@query(_STRONG + "SELECT id, min(r) AS component FROM reach GROUP BY id")
def connected_components(t: Tables) -> DataFrame:
    """Components by repeated minima, named by their smallest member."""
    return graph.connected_components(strong(t))


@query()
def connected_components_all(t: Tables) -> DataFrame:
    """Components of all parts, linked by any order; a chain through an order's parts links as much as all its pairs."""
    d = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("v")).where("l_orderkey IS NOT NULL AND v IS NOT NULL")
    e = d.join(d.groupBy("l_orderkey").agg(F.min("v").alias("u")), "l_orderkey").select("u", "v")
    return graph.connected_components(e, d.select(F.col("v").alias("id")))


@query()
def communities(t: Tables) -> DataFrame:
    """Greedy modularity over all pairs of suppliers."""
    return graph.communities(pairs(t), t.lineitem.where("l_suppkey IS NOT NULL").select(F.col("l_suppkey").alias("id")).distinct())


@query("""
WITH c AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
t AS (SELECT min(n) AS least FROM (SELECT n FROM c ORDER BY n DESC LIMIT 25))
SELECT id, n FROM c, t WHERE n >= least
""")
def labelled_vertices(t: Tables) -> DataFrame:
    """Vertices with at least the 25th largest count, ties included."""
    return graph.label_threshold(graph.active_items(t.lineitem, "l_partkey", "l_orderkey", 1).withColumnRenamed("l_partkey", "id"), 25)


@query("""
WITH RECURSIVE b AS (SELECT doc_id AS id, n_chars % 40 + 1 AS n, greatest(sqrt(n_chars % 40 + 1), 1.0) AS side FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, id) AS i FROM b),
lim AS MATERIALIZED (SELECT greatest(sqrt(sum(side)) * 1.6, max(side)) AS width FROM b),
s AS (
  SELECT i, id, n, 0.0::DOUBLE AS l, 0.0::DOUBLE AS t, side AS high, side + 0.35::DOUBLE AS x FROM o WHERE i = 1
  UNION ALL
  SELECT o.i, o.id, o.n, CASE WHEN x + side > width THEN 0 ELSE x END, CASE WHEN x + side > width THEN t - high - 0.35 ELSE t END,
         CASE WHEN x + side > width THEN side ELSE greatest(high, side) END, CASE WHEN x + side > width THEN 0 ELSE x END + side + 0.35
  FROM s JOIN o ON o.i = s.i + 1, lim)
SELECT id, n, round(l, 6) AS "left", round(t, 6) AS top FROM s
""")
def shelf_packing(t: Tables) -> DataFrame:
    """Boxes of the documents on shelves, largest first."""
    d = drawing.pack_shelves(t.documents.select(F.col("doc_id").alias("id"), (F.col("n_chars") % 40 + 1).alias("n")))
    return d.select("id", "n", F.round("left", 6).alias("left"), F.round("top", 6).alias("top"))


@query()
def graph_layout(t: Tables) -> DataFrame:
    """Layout of the parts of urgent orders: one component of most parts, many small ones."""
    v = t.part.select(F.col("p_partkey").alias("id"))
    return drawing.component_layout(strong(t), v, rounds=10)
