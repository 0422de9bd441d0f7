"""Line deduplication (operator 9).

Lines are exploded, their normalised keys hashed to 128 bits, documents counted
by hash, and the lines of keys found in enough documents dropped everywhere but
in the smallest id that holds the key.  Positions of dropped lines come back by
row, and the text is put together again from the others.

Counting is a hash aggregate, so a line that a third of all documents holds is
combined before the shuffle; only hashes, ids and positions move.  The join
back to the lines has a unique side, so that Spark may split a hot hash.  Texts
cross one join, by a key that every row has for itself.

Defined cases: null or empty text is one empty line; lines whose key is shorter
than ``min_chars`` stay; rows of one id are one document, whatever their texts,
and what the document may keep each of its rows keeps; rows with null ids come
after all others, each a document of its own (those of equal text are copies of
one document); an empty table gives no rows; columns beyond id and text are
carried along unless they are named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import ASCII_SPACE, UPPER, keyed, materialize, read


def line_keys(text: Column) -> Column:
    """Keys of all lines: stripped of ASCII white space at both ends, A-Z lower-cased."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), "\n")
    return F.transform(lines, lambda x: F.btrim(x, F.lit(ASCII_SPACE)))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of ``docs`` with ``text`` deduplicated, and n_lines, n_dropped (long)."""
    rows = keyed(docs)
    body, d = F.col("row").getField(text), F.col("row").getField(doc_id).cast("long")
    # A document is an id or, without one, a text.
    lines = rows.select("r1", "r2", d.alias("d"), F.when(d.isNull(), F.xxhash64(body)).alias("t"), F.posexplode(line_keys(body)).alias("pos", "key"))
    hashed = lines.where(F.char_length("key") >= min_chars).select("r1", "r2", "d", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(9), "key").alias("h2"))
    firsts = [F.min("d").alias("first_d"), F.min("t").alias("first_t")]
    if min_docs == 2:
        several = "first_d < last_d OR first_t < last_t OR (first_d IS NOT NULL AND first_t IS NOT NULL)"
        repeated = hashed.groupBy("h1", "h2").agg(*firsts, F.max("d").alias("last_d"), F.max("t").alias("last_t")).where(several)
    else:
        repeated = hashed.groupBy("h1", "h2").agg(*firsts, F.countDistinct(F.struct("d", "t")).alias("n")).where(F.col("n") >= min_docs)
    # Written first: joined as it stands, its aggregate would keep Spark from splitting a hot hash.
    repeated = materialize(repeated.select("h1", "h2", "first_d", "first_t"))
    later = "d > first_d OR (d IS NULL AND (first_d IS NOT NULL OR t > first_t))"
    drops = hashed.join(repeated, ["h1", "h2"]).where(later).groupBy("r1", "r2").agg(F.collect_list("pos").alias("gone"))
    kept = rows.join(drops.hint("merge"), ["r1", "r2"], "left").withColumn("lines", F.split(F.coalesce(body, F.lit("")), "\n"))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    rest = F.array_join(F.transform(F.array_except(places, "gone"), lambda i: F.get("lines", i)), "\n")
    new = F.when(F.col("gone").isNull(), F.coalesce(body, F.lit(""))).otherwise(rest)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return kept.select(
        *[(new if c == text else F.col("row").getField(c)).alias(c) for c in names],
        F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id > r.first_id AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
