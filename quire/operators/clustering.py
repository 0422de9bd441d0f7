"""Embedding clusters: fit, centroids, extension without refitting, fingerprints, class-based terms."""

from __future__ import annotations

import hashlib

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.order import percentiles


class LabelMismatch(ValueError):
    """Labels that were made for another partition."""


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def centroids(vectors: DataFrame, cluster: str = "cluster_id", embedding: str = "embedding") -> DataFrame:
    """cluster, centroid (mean of members in double precision)."""
    parts = vectors.where(F.col(cluster).isNotNull()).select(F.col(cluster), F.posexplode(F.col(embedding).cast("array<double>")).alias("pos", "x"))
    means = parts.groupBy(cluster, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))


def nearest_centroid(vectors: DataFrame, centres: DataFrame, cluster: str = "cluster_id", embedding: str = "embedding", name: str = "nearest") -> DataFrame:
    """vectors plus nearest and distance2; equal distances go to the lowest cluster.

    Centroids (one row a cluster) are folded into one array that every row
    scans, so no row is multiplied by the number of clusters.
    """
    table = centres.agg(F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("id"), "centroid"))).alias("_all"))
    d = vectors.crossJoin(F.broadcast(table))
    best = F.array_min(F.transform("_all", lambda c: F.struct(squared_distance(F.col(embedding).cast("array<double>"), c["centroid"]).alias("d2"), c["id"].alias("id"))))
    return d.withColumn("_b", best).withColumn(name, F.col("_b.id")).withColumn("distance2", F.col("_b.d2")).drop("_all", "_b")


def fit_kmeans(vectors: DataFrame, k: int = 20, n_init: int = 10, seed: int = 42, embedding: str = "embedding", max_iter: int = 50) -> DataFrame:
    """vectors plus cluster_id of the best of ``n_init`` runs."""
    v = vectors.withColumn("_v", array_to_vector(F.col(embedding).cast("array<double>"))).cache()
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="cluster_id", maxIter=max_iter).fit(v) for i in range(n_init)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        return best.transform(vectors.withColumn("_v", array_to_vector(F.col(embedding).cast("array<double>")))).drop("_v")
    finally:
        v.unpersist()


def project_2d(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vectors plus x, y: the first two principal components.

    A substitute for neighbour-embedding maps, which need libraries that aren't
    a part of Spark; not equivalent to them.
    """
    v = vectors.withColumn("_v", array_to_vector(F.col(embedding).cast("array<double>")))
    out = PCA(k=2, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("_a", vector_to_array("_p"))
    return out.withColumn("x", F.get("_a", F.lit(0))).withColumn("y", F.get("_a", F.lit(1))).drop("_v", "_p", "_a")


def _lines(assignments: DataFrame, key: str, cluster: str) -> DataFrame:
    line = F.concat(F.col(key).cast("string"), F.lit("\t"), F.col(cluster).cast("string"), F.lit("\n"))
    return assignments.where(F.col(cluster).isNotNull()).select(F.col(key).cast("string").alias("k"), F.coalesce(line, F.lit("")).alias("line"))


def partition_fingerprint(assignments: DataFrame, key: str = "paper_id", cluster: str = "cluster_id") -> DataFrame:
    """One row: SHA-256 of the sorted lines ``key TAB cluster``, and their number n.

    The stamp of label files made elsewhere.  The lines are sorted by ranges and
    pass through the driver in order, a partition at a time, into one running
    digest; they are never held together.  ``partition_stamp`` has no such stream.
    """
    digest, n = hashlib.sha256(), 0
    for r in _lines(assignments, key, cluster).orderBy(F.asc_nulls_last("k"), "line").select("line").toLocalIterator():
        digest.update(r.line.encode())
        n += 1
    return assignments.sparkSession.createDataFrame([(digest.hexdigest(), n)], "fingerprint string, n long")


#: Hexadecimal digits of a key's hash that a leaf of the stamp's tree stands for, and the levels above it.
LEAF, LEVELS = 6, (4, 2)
TREE = "tree:"


def partition_stamp(assignments: DataFrame, key: str = "paper_id", cluster: str = "cluster_id") -> DataFrame:
    """One row: ``tree:`` and the root of a tree of SHA-256 over the lines ``key TAB cluster``, and their number n.

    A leaf digests the sorted distinct lines, with their counts, of the keys
    whose hash begins with its six digits; a node digests its up to 256 children
    in order.  No task holds more than a leaf, which is the 16,777,216th part of
    the keys, or a node; neither order nor partitioning of the rows matters.  An
    empty partition has the digest of no bytes.  A null key's line is empty.
    """
    counted = _lines(assignments, key, cluster).groupBy("line", F.substring(F.sha2(F.coalesce("k", F.lit("")), 256), 1, LEAF).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    digest = lambda parts: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda x: F.concat_ws(" ", *[x[p].cast("string") for p in parts])), ""), 256)
    tree = counted.groupBy("node").agg(digest(["line", "n"]).alias("digest"), F.sum("n").alias("n"))
    for digits in LEVELS:
        tree = tree.groupBy(F.substring("node", 1, digits).alias("up")).agg(digest(["node", "digest"]).alias("digest"), F.sum("n").alias("n")).withColumnRenamed("up", "node")
    root = tree.agg(digest(["node", "digest"]).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    return root.select(F.concat(F.lit(TREE), F.col("digest")).alias("fingerprint"), "n")


def verify_labels(assignments: DataFrame, stamp: str | None, key: str = "paper_id", cluster: str = "cluster_id") -> str:
    """The partition's fingerprint, of the stamp's kind; raises unless it is the labels' stamp."""
    if not stamp:
        raise LabelMismatch("the labels have no fingerprint")
    found = (partition_stamp if stamp.startswith(TREE) else partition_fingerprint)(assignments, key, cluster).first()["fingerprint"]
    if found != stamp:
        raise LabelMismatch(f"the labels are for {stamp[:17]}, the partition is {found[:17]}")
    return found


def attach_labels(papers: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster_label by cluster_id, ``Cluster N`` where none is given."""
    out = papers.drop("cluster_label").join(labels.select("cluster_id", F.col("label").alias("_l")), "cluster_id", "left")
    named = F.when(F.col("cluster_id").isNotNull(), F.coalesce("_l", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))))
    return out.withColumn("cluster_label", named).drop("_l")


def self_agreement(vectors: DataFrame, key: str = "paper_id", least: float = 0.999) -> tuple[DataFrame, float]:
    """(centroids, share of members nearest to their own centroid); raises below ``least``."""
    c = centroids(vectors)
    share = nearest_centroid(vectors, c).agg(F.avg((F.col("nearest") == F.col("cluster_id")).cast("int"))).first()[0]
    if share is not None and share < least:
        raise ValueError(f"only {share:.4f} of members are nearest to their own centroid")
    return c, share or 0.0


def drift(fitted: DataFrame, added: DataFrame, centres: DataFrame) -> DataFrame:
    """One row: distance percentiles of fitted and added vectors, and how many added ones lie beyond the fitted 99th."""
    q = (0.5, 0.9, 0.99)
    dist = lambda df: nearest_centroid(df, centres).select(F.sqrt("distance2").alias("d"))
    far = dist(added)
    a = percentiles(dist(fitted), [], "d", q, "fit").select("fit")
    new = percentiles(far, [], "d", q, "new").select("new")
    # One row each; counted last, so that the limit is known.
    limit = a.first()
    beyond = far.agg(F.count_if(F.col("d") > F.lit(limit.fit[2] if limit else None)).alias("beyond"))
    return a.join(new, F.lit(True), "full").join(beyond, F.lit(True), "full").select("fit", "new", "beyond")


def extend(vectors: DataFrame, incoming: DataFrame, stamp: str, key: str = "paper_id") -> tuple[DataFrame, DataFrame, str]:
    """(all vectors with clusters, drift, new stamp): new rows join the nearest cluster, old ones keep theirs."""
    verify_labels(vectors, stamp, key)
    centres, _ = self_agreement(vectors, key)
    new = incoming.join(vectors.select(key), key, "left_anti")
    placed = nearest_centroid(new, centres).withColumn("cluster_id", F.col("nearest").cast(vectors.schema["cluster_id"].dataType)).select(*[c for c in vectors.columns])
    both = vectors.unionByName(placed)
    return both, drift(vectors, new, centres), partition_stamp(both, key).first()["fingerprint"]


def nearest_members(vectors: DataFrame, centres: DataFrame, n: int = 12, key: str = "paper_id") -> DataFrame:
    """The n members of each cluster closest to its centroid by cosine."""
    d = vectors.join(centres, "cluster_id").withColumn("cosine", cosine(F.col("embedding").cast("array<double>"), F.col("centroid")))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("cosine"), key))).where(F.col("rank") <= n).drop("embedding", "centroid")


def cluster_terms(docs: DataFrame, cluster: str, title: Column, body: Column, n: int = 18, title_weight: int = 3, min_df: int = 1) -> DataFrame:
    """cluster, rank, term, score: class-based TF-IDF of one- and two-word terms.

    A cluster's documents are one text, titles weighing ``title_weight`` times;
    term frequency is sublinear, document frequency counts clusters (smoothed),
    rows are scaled to length 1.  English stop words are left out first.
    """
    stop = StopWordsRemover.loadDefaultStopWords("english")
    words = lambda c: F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(*stop))
    pairs = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
    d = docs.select(F.col(cluster).alias("cluster"), words(title).alias("t"), words(body).alias("b"))
    terms = d.select("cluster", F.explode(F.concat("t", pairs(F.col("t")))).alias("term"), F.lit(title_weight).alias("w")).unionByName(d.select("cluster", F.explode(F.concat("b", pairs(F.col("b")))).alias("term"), F.lit(1).alias("w")))
    tf = terms.groupBy("cluster", "term").agg(F.sum("w").alias("tf"))
    total = docs.select(F.countDistinct(cluster).alias("total"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    s = tf.join(df, "term").crossJoin(F.broadcast(total)).withColumn("raw", (1 + F.log("tf")) * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    norms = s.groupBy("cluster").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    out = s.join(norms, "cluster").withColumn("score", F.col("raw") / F.col("norm"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "term"))).where(F.col("rank") <= n).select("cluster", "rank", "term", "score")


def unnamed_clusters(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    return assignments.select("cluster_id").where("cluster_id IS NOT NULL").distinct().join(labels.select("cluster_id"), "cluster_id", "left_anti")


def map_patch(vectors: DataFrame, coords: DataFrame, labels: DataFrame, key: str = "paper_id", digits: int = 3) -> DataFrame:
    """key, umap_x, umap_y (rounded), cluster_id, cluster_label of the vectors that are in a cluster.

    Raises where coordinates and vectors aren't of the same keys.
    """
    v = vectors.where("cluster_id IS NOT NULL").select(key, "cluster_id")
    both = v.withColumn("_v", F.lit(1)).join(coords.select(key, "x", "y", F.lit(1).alias("_c")), key, "full")
    lost = both.agg(F.count_if(F.col("_c").isNull()).alias("c"), F.count_if(F.col("_v").isNull()).alias("v")).first()
    if lost.c or lost.v:
        raise ValueError(f"{lost.c} vectors without coordinates, {lost.v} coordinates without a vector")
    placed = both.select(key, F.round("x", digits).alias("umap_x"), F.round("y", digits).alias("umap_y"), "cluster_id")
    return attach_labels(placed, labels).select(key, "umap_x", "umap_y", "cluster_id", "cluster_label")
