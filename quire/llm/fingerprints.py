"""Canonical exact digests (operator 5), DataFrame and SQL functions only.

A text's canonical form is NFKC, full case folding, NFKC again, and runs of
white space as one blank, without any at the ends.  Spark has no function for
the Unicode steps; ``reflect`` calls the ICU library that Spark itself carries.
The digest is 128 bits of xxhash (two chained 64-bit hashes).  Digests that more
than one document has are the buckets in which canonical bytes are compared:
grouping by digest and bytes gives the classes.

Copies of one text are combined by partial aggregation before they are grouped.
Texts cross two shuffles, one to meet their bucket and one to meet the next
document, by the same plan at every size.

Defined cases: null text is empty; the empty text is a text like others, with
its own class; a null id is ordered after all others and never a class id;
rows with the same id are documents of their own, side by side in the order of
their texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm._common import materialize, read

SPACES = r"[\s\p{Z}]+"
ROWS_PER_RANGE = 4_000
MAX_RANGE_BITS = 16
FIRST = -(2**63)


def canonical(text: Column) -> Column:
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    t = nfkc(F.coalesce(text, F.lit("")))
    t = nfkc(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), t, F.lit(True)))
    return F.trim(F.regexp_replace(t, SPACES, " "))


def digest(canon: Column) -> tuple[Column, Column]:
    return F.xxhash64(canon), F.xxhash64(F.lit(5), canon)


def as_text(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def classes(docs: DataFrame, narrow: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of equal canonical bytes among documents with a digest in common.

    ``narrow`` has (doc_id, h1, h2) of all of ``docs``.  Returns (h1, h2,
    class_id, copies) of digests that stand for one text, and (h1, h2, canon,
    class_id, copies) of those on which different texts collide.
    """
    shared = materialize(narrow.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    canon = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("canon"))
    h1, h2 = digest(F.col("canon"))
    rows = canon.withColumn("h1", h1).withColumn("h2", h2).join(shared.hint("merge"), ["h1", "h2"])
    found = rows.groupBy("h1", "h2", "canon").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    # A third of all rows may be copies of one text: their side of the join is split, and combined again.
    found = materialize(found, **{"spark.sql.adaptive.forceOptimizeSkewedJoin": "true"})
    variants = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("variants"))
    # Written, so that the join with it is one of two plain shuffles, whose hot buckets Spark can split.
    single = materialize(found.join(variants.where("variants = 1"), ["h1", "h2"]).select("h1", "h2", "class_id", "copies"))
    collided = found.join(variants.where("variants > 1"), ["h1", "h2"]).select("h1", "h2", "canon", "class_id", "copies")
    return single, collided


def fingerprint(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, class_id (smallest id with the same canonical bytes), copies."""
    d = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("canon"))
    h1, h2 = digest(F.col("canon"))
    narrow = materialize(d.select("doc_id", h1.alias("h1"), h2.alias("h2")))
    single, collided = classes(docs, narrow, doc_id=doc_id, text=text)
    return _with_classes(narrow, single, collided, docs, doc_id, text).select("doc_id", as_text(F.col("h1"), F.col("h2")).alias("fingerprint"), "class_id", "copies")


def _with_classes(rows: DataFrame, single: DataFrame, collided: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Adds class_id and copies by digest; where texts collide on one, by their bytes."""
    out = rows.join(single.hint("merge"), ["h1", "h2"], "left")
    if not collided.isEmpty():
        canon = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("canon"))
        h1, h2 = digest(F.col("canon"))
        exact = canon.withColumn("h1", h1).withColumn("h2", h2).join(collided.withColumnRenamed("class_id", "c").withColumnRenamed("copies", "k"), ["h1", "h2", "canon"]).select("doc_id", "h1", "h2", "c", "k")
        out = out.join(exact.dropDuplicates(["doc_id", "h1", "h2"]), ["doc_id", "h1", "h2"], "left")
        out = out.withColumn("class_id", F.coalesce("c", "class_id")).withColumn("copies", F.coalesce("k", "copies")).drop("c", "k")
    return out.withColumn("class_id", F.coalesce("class_id", "doc_id")).withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long"))


def next_in_order(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the next document by descending id, cyclic.

    Ids are cut into ranges of about equal numbers of rows.  A range's first
    document is also sent to the end of the range before it, so that one window
    in each range sees all neighbours, and texts are shuffled once.  ``ids`` has
    the ids of ``docs``.  Bounds (at most 2**16 ids) are all the driver holds.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(FIRST))
    n = ids.count()
    bits = min(MAX_RANGE_BITS, max(0, math.ceil(math.log2(max(1, n) / ROWS_PER_RANGE))))
    bounds = [FIRST]
    if bits:
        found = ids.select(F.percentile_approx(key, [i / 2**bits for i in range(1, 2**bits)], 2 ** (bits + 4))).first()[0]
        bounds = sorted({FIRST, *found})
    table = [*bounds, *[2**63 - 1] * (2**bits - len(bounds))]
    at = F.lit(0)
    if bits:
        # Binary search: the last range whose lower bound isn't above the id.
        lower = F.lit(table)
        steps = F.array(*[F.lit(1 << j) for j in range(bits - 1, -1, -1)])
        at = F.aggregate(steps, F.lit(0), lambda pos, step: F.when(F.get(lower, pos + step) <= F.col("key"), pos + step).otherwise(pos))
    ranged = ids.select(key.alias("key")).withColumn("range", at)
    heads = ranged.groupBy("range").agg(F.max("key").alias("key"))
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.desc("range"))
    last = F.min("range").over(Window.partitionBy(F.lit(0)))
    # One row a range (2**16 at most): the range before, in descending order, gets the head too.
    heads = heads.select("key", F.coalesce(F.lag("range").over(ordered), last).alias("also"))
    d = docs.withColumn("key", key).withColumn("range", at).join(F.broadcast(heads), "key", "left")
    own = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")))
    both = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("also").alias("range"), F.lit(1).alias("guest")))
    d = d.select("doc_id", "text", "key", F.explode(F.when(F.col("also").isNull(), own).otherwise(both)).alias("place"))
    w = Window.partitionBy("place.range").orderBy("place.guest", F.desc("key"), "text")
    return d.withColumn("next_text", F.lead("text").over(w)).where("place.guest = 0").select("doc_id", "text", "next_text")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h1, h2 = digest(canonical(F.col("text")))
    narrow = materialize(docs.select("doc_id", h1.alias("h1"), h2.alias("h2")))
    single, collided = classes(docs, narrow)
    d = next_in_order(docs, narrow.select("doc_id"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - CAST(floor(char_length(text) / 2) AS INT))"), F.expr("substring(next_text, 1, CAST(floor(char_length(text) / 2) AS INT))"))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), F.when(half > 0, edited).otherwise(F.col("text")).alias("edited"), canonical(F.col("text")).alias("own"), canonical(F.col("next_text")).alias("next"))
    d = d.withColumn("changed", canonical(F.col("edited")))
    h1, h2 = digest(F.col("own"))
    e1, e2 = digest(F.col("changed"))
    d = d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), h1.alias("h1"), h2.alias("h2"), as_text(e1, e2).alias("edited_fingerprint"),
        (F.col("own") == F.col("changed")).cast("double").alias("near_edited"), (F.col("own") == F.col("next")).cast("double").alias("near_next"),
    )
    out = _with_classes(d, single, collided, docs, "doc_id", "text")
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("h1"), F.col("h2")).alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "class_id", "copies")
