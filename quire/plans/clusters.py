"""Embedding clusters on the driver's vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import clustering, neighbours
from quire.plans.registry import Tables, query


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("paper_id"), "embedding", F.col("label").alias("cluster_id"))


_CENTRES = """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
c AS (SELECT label AS k, pos, avg(x) AS c FROM e GROUP BY 1, 2),
d AS (SELECT vec_id, e.label, k, sum((x - c) * (x - c)) AS d2 FROM e JOIN c USING (pos) GROUP BY 1, 2, 3),
n AS (SELECT vec_id, label, arg_min(k, (d2, k)) AS nearest, min(d2) AS d2 FROM d GROUP BY 1, 2)
"""


@query(_CENTRES + "SELECT k AS cluster_id, count(*) AS dims, round(sum(c), 6) AS total, round(max(c), 6) AS largest FROM c GROUP BY k")
def centroid_means(t: Tables) -> DataFrame:
    """Centroids, summed up."""
    c = clustering.centroids(vectors(t)).select("cluster_id", F.explode("centroid").alias("x"))
    return c.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("dims"), F.round(F.sum("x"), 6).alias("total"), F.round(F.max("x"), 6).alias("largest"))


@query(_CENTRES + "SELECT vec_id AS paper_id, nearest, round(d2, 6) AS distance2 FROM n")
def nearest_centroid(t: Tables) -> DataFrame:
    """Nearest centroid of every vector; ties to the lowest cluster."""
    v = vectors(t)
    return clustering.nearest_centroid(v, clustering.centroids(v)).select("paper_id", "nearest", F.round("distance2", 6).alias("distance2"))


@query(_CENTRES + "SELECT count(*) AS n, round(avg((label = nearest)::INT), 6) AS agreement FROM n")
def self_agreement(t: Tables) -> DataFrame:
    """Share of members nearest to their own centroid."""
    v = vectors(t)
    n = clustering.nearest_centroid(v, clustering.centroids(v))
    return n.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("nearest") == F.col("cluster_id")).cast("int")), 6).alias("agreement"))


@query("""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
c AS (SELECT label AS k, pos, avg(x) AS c FROM e WHERE vec_id % 5 <> 0 GROUP BY 1, 2),
d AS (SELECT vec_id, k, sum((x - c) * (x - c)) AS d2 FROM e JOIN c USING (pos) GROUP BY 1, 2),
m AS (SELECT vec_id, sqrt(min(d2)) AS d FROM d GROUP BY 1),
f AS (SELECT quantile_cont(d, [0.5, 0.9, 0.99]) AS q FROM m WHERE vec_id % 5 <> 0)
SELECT round(q[1], 6) AS fit50, round(q[2], 6) AS fit90, round(q[3], 6) AS fit99, round(quantile_cont(d, 0.5), 6) AS new50, round(quantile_cont(d, 0.99), 6) AS new99, count(*) FILTER (d > q[3]) AS beyond
FROM m, f WHERE vec_id % 5 = 0 GROUP BY q
""")
def drift_percentiles(t: Tables) -> DataFrame:
    """Distances of a fitted part and of an added part of the vectors to the fitted centroids."""
    v = vectors(t)
    fit, new = v.where("paper_id % 5 <> 0"), v.where("paper_id % 5 = 0")
    d = clustering.drift(fit, new, clustering.centroids(fit))
    q = lambda c, i, n: F.round(F.get(c, F.lit(i)), 6).alias(n)
    return d.select(q("fit", 0, "fit50"), q("fit", 1, "fit90"), q("fit", 2, "fit99"), q("new", 0, "new50"), q("new", 2, "new99"), "beyond")


@query("""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
c AS (SELECT label AS k, pos, avg(x) AS c FROM e WHERE vec_id % 5 <> 0 GROUP BY 1, 2),
d AS (SELECT vec_id, k, sum((x - c) * (x - c)) AS d2 FROM e JOIN c USING (pos) WHERE vec_id % 5 = 0 GROUP BY 1, 2)
SELECT vec_id AS paper_id, arg_min(k, (d2, k)) AS cluster_id FROM d GROUP BY 1
UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0
""")
def extend_assign(t: Tables) -> DataFrame:
    """Clusters extended to new vectors without a new fit; old vectors keep theirs."""
    v = vectors(t)
    fit, new = v.where("paper_id % 5 <> 0"), v.where("paper_id % 5 = 0").drop("cluster_id")
    placed = clustering.nearest_centroid(new, clustering.centroids(fit)).select("paper_id", F.col("nearest").alias("cluster_id"))
    return fit.select("paper_id", "cluster_id").unionByName(placed)


@query("SELECT sha256(string_agg(vec_id::VARCHAR || chr(9) || label::VARCHAR || chr(10), '' ORDER BY vec_id::VARCHAR)) AS fingerprint, count(*) AS n FROM embeddings")
def partition_fingerprint(t: Tables) -> DataFrame:
    """Digest of the whole assignment of vectors to clusters."""
    return clustering.partition_fingerprint(vectors(t))


@query("""
WITH c AS (SELECT sha256(vec_id::VARCHAR)[1:6] AS node, vec_id::VARCHAR || chr(9) || label::VARCHAR || chr(10) AS line, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY ALL),
l AS (SELECT node, sha256(string_agg(line || ' ' || n, '' ORDER BY line, n)) AS digest, sum(n) AS n FROM c GROUP BY node),
m AS (SELECT node[1:4] AS up, sha256(string_agg(node || ' ' || digest, '' ORDER BY node)) AS digest, sum(n) AS n FROM l GROUP BY up),
t AS (SELECT up[1:2] AS top, sha256(string_agg(up || ' ' || digest, '' ORDER BY up)) AS digest, sum(n) AS n FROM m GROUP BY top)
SELECT 'tree:' || sha256(string_agg(top || ' ' || digest, '' ORDER BY top)) AS fingerprint, sum(n)::BIGINT AS n FROM t
""")
def partition_stamp(t: Tables) -> DataFrame:
    """Digest of the assignment as a tree of ranges of the keys' hashes."""
    return clustering.partition_stamp(vectors(t))


@query("SELECT label AS cluster_id, count(*) AS n FROM embeddings GROUP BY 1")
def cluster_sizes(t: Tables) -> DataFrame:
    return vectors(t).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def kmeans_sizes(t: Tables) -> DataFrame:
    """Sizes of ten fitted clusters, the best of three runs."""
    return clustering.fit_kmeans(vectors(t).drop("cluster_id"), k=10, n_init=3).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def projection_2d(t: Tables) -> DataFrame:
    """Principal components as a map of the vectors."""
    return clustering.project_2d(vectors(t)).select("paper_id", F.round(F.abs("x"), 4).alias("x"), F.round(F.abs("y"), 4).alias("y"))


@query("""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
c AS (SELECT label AS k, pos, avg(x) AS c FROM e GROUP BY 1, 2),
s AS (SELECT vec_id, label, sum(x * c) / sqrt(sum(x * x) * sum(c * c)) AS cosine FROM e JOIN c ON label = k AND e.pos = c.pos GROUP BY 1, 2)
SELECT label AS cluster_id, vec_id AS paper_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 3
""")
def nearest_members(t: Tables) -> DataFrame:
    """The three members of each cluster closest to its centroid by cosine."""
    v = vectors(t)
    return clustering.nearest_members(v, clustering.centroids(v), 3).select("cluster_id", "paper_id", "rank")


@query()
def cluster_terms(t: Tables) -> DataFrame:
    """Class-based TF-IDF terms of each language."""
    return clustering.cluster_terms(t.documents, "lang", F.lit(""), F.col("text"), n=10).select("cluster", "rank", "term", F.round("score", 6).alias("score"))


@query()
def neighbour_graph(t: Tables) -> DataFrame:
    """The fifteen nearest neighbours of each vector, by projection trees and neighbours' neighbours."""
    return neighbours.nearest_neighbours(t.embeddings, 15, key="vec_id")


@query()
def neighbour_map(t: Tables) -> DataFrame:
    """A map of the neighbour graph that starts from the first two principal components."""
    flat = clustering.project_2d(t.embeddings.where("size(embedding) = 64 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x))")).select(F.col("vec_id").alias("id"), "x", "y")
    return neighbours.neighbour_map(neighbours.nearest_neighbours(t.embeddings, 15, key="vec_id"), flat)
