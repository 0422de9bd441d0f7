"""Mixing sources to target weights (operator 10), DataFrame functions only.

Every document gets a hash-random key.  Sizes are summed by source, targets are
water-filled on the per-source table, and each source's documents are taken in
key order until the source's budget is met.  The running sum is two-level: keys
are uniform, so their leading bits cut a source of any size into even ranges;
sums of ranges give each range its start, and a window inside the range gives
the rest.  Only narrow rows (id, source, size and the like) are ever shuffled:
``apply_mix`` compares each row with its source's cut, one row a source.

Defined cases: null text or one without words has size 0 and is never taken;
a null source is a source of its own, ordered last; a null id is a document
whose key comes from its text; repeated rows are separate documents that stand
side by side in key order, of which the mix may take some and leave others; an
empty table gives no rows; other columns of the input are ignored by ``mix``
and carried along by ``apply_mix``, where their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm._common import WORD, content, keyed, materialize, read, words_in

WEIGHTS = (1.0, 2.0, 3.0)
ROWS_PER_RANGE = 500
KEY_BITS = 60


def random_key(name: Column, seed: int) -> Column:
    """60 pseudo-random bits of a string."""
    text = F.concat(name, F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_repeat: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, source_size).

    The grand total times ``share`` is divided by weight; a target stops at
    ``max_repeat`` times its source's size and the excess goes to the others by
    weight until none is above.  With sources ordered by cap / weight, those
    that reach their cap are a prefix, hence one pass of running sums over the
    per-source table (one row a source) gives the fixed point.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("w", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    t = t.withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    ahead = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything).cast("double") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(ahead), F.lit(0.0))
    t = t.withColumn("level", left / weight)
    t = t.withColumn("capped", F.col("level") * F.col("w") > F.col("cap"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    t = t.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w")))
    return t.select("source", "source_size", "target")


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    """The random key of an id; of a text where the id is null."""
    return random_key(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.xxhash64(text).cast("string"))), seed)


def _placed(rows: DataFrame, *, doc_id: str, text: str, source: str, weights: Sequence[float], share: float, max_repeat: float, seed: int) -> DataFrame:
    """Rows (see ``keyed``) without their struct: r1, r2, doc_id, source, size, key, c1, source_size, target, epochs, extra.

    ``epochs`` is how often the mix takes all of the source, ``extra`` how many
    words of the row it takes beyond that.
    """
    row = F.col("row")
    d, t = row.getField(doc_id), row.getField(text)
    sizes = materialize(rows.select("r1", "r2", d.alias("doc_id"), row.getField(source).alias("source"), words_in(t).alias("size"), _key(d, t, seed).alias("key"), content(rows).alias("c1")))
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    most = sums.agg(F.max("n")).first()[0] or 0
    bits = min(20, max(0, math.ceil(math.log2(max(1, most) / ROWS_PER_RANGE))))
    targets = materialize(source_targets(sums.select("source", "source_size"), weights, share, max_repeat))
    ranged = sizes.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("source", "range").agg(F.sum("size").alias("in_range")).select("source", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "c1", "r1", "r2").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("in_front", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    s, t = starts.alias("s"), targets.alias("t")
    p = placed.alias("p").join(s, F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.range") == F.col("s.range")))
    p = p.join(t, F.col("p.source").eqNullSafe(F.col("t.source")))
    budget = F.floor(F.col("t.target") + 0.5).cast("long")
    size, total = F.col("p.size"), F.col("t.source_size")
    epochs = F.when(total > 0, F.expr("CAST(floor(t.target + 0.5) AS BIGINT) DIV t.source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * total - F.col("s.range_start") - F.col("p.in_front")
    extra = F.greatest(F.lit(0).cast("long"), F.least(size, rest))
    return p.select(*[F.col(f"p.{c}") for c in sizes.columns], total.alias("source_size"), F.col("t.target").alias("target"), epochs.alias("epochs"), extra.alias("extra"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_repeat: float = 3.0, seed: int = 10) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` counts words with repeats: whole epochs of the source, then
    documents in key order up to the source's exact (rounded) budget, the last
    one in part.
    """
    p = _placed(keyed(docs), doc_id=doc_id, text=text, source=source, weights=weights, share=share, max_repeat=max_repeat, seed=seed)
    return p.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))


def apply_mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_repeat: float = 3.0, seed: int = 10) -> DataFrame:
    """The mixed documents: as many rows of each document as its epochs, and for
    a remainder one row with the first words only (joined by single blanks).

    Documents that the mix doesn't take go.  ``n_chars``, if there is such a
    column, follows the text.  Rows are told apart by their place in the table,
    so null and repeated ids are mixed like others.
    """
    rows = keyed(docs)
    p = _placed(rows, doc_id=doc_id, text=text, source=source, weights=weights, share=share, max_repeat=max_repeat, seed=seed)
    # One row a source: its epochs, and the first row in order that isn't taken whole beyond them.
    order = ("key", "doc_id", "size", "c1", "r1", "r2")
    cut = F.min(F.when((F.col("extra") < F.col("size")), F.struct(*order, "extra"))).alias("cut")
    cuts = materialize(p.groupBy("source").agg(F.max("epochs").alias("epochs"), cut).withColumnRenamed("source", "of"))
    row = F.col("row")
    d, t = row.getField(doc_id), row.getField(text)
    m = rows.join(cuts, row.getField(source).eqNullSafe(F.col("of"))).withColumns({"doc_id": d, "size": words_in(t), "key": _key(d, t, seed), "c1": content(rows)})
    place, at = F.struct(*order), F.struct(*[F.col("cut").getField(c).alias(c) for c in order])
    extra = F.when(F.col("cut").isNull() | (place < at), F.col("size")).when(place == at, F.col("cut").getField("extra")).otherwise(F.lit(0))
    m = m.where("size > 0").withColumn("extra", extra)
    whole = F.array_repeat(F.lit(-1).cast("long"), F.col("epochs").cast("int") + (F.col("extra") == F.col("size")).cast("int"))
    part = F.when((F.col("extra") > 0) & (F.col("extra") < F.col("size")), F.array("extra"))
    m = m.select("row", F.explode(F.when(part.isNull(), whole).otherwise(F.concat(whole, part))).alias("keep"))
    words = F.slice(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), 1, F.col("keep").cast("int"))
    new = F.when(F.col("keep") < 0, t).otherwise(F.array_join(words, " "))

    def column(c: str) -> Column:
        if c == text:
            return new
        return F.char_length(new).cast(docs.schema[c].dataType) if c == n_chars else row.getField(c)

    return m.select(*[column(c).alias(c) for c in docs.columns])


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '#10'), 1, 15))::BIGINT AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighted AS (
  SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
         3.0::DOUBLE * source_size AS cap FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / ((sum(w) OVER ())
             - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size,
         CASE WHEN level * w > cap THEN cap
              ELSE max(CASE WHEN level * w > cap THEN NULL ELSE level END) OVER () * w END AS target
  FROM levels),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS in_front FROM sizes),
budgets AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM targets)
SELECT p.doc_id, p.size, b.source_size, b.target,
       (b.epochs * p.size + greatest(0, least(p.size, b.budget - b.epochs * b.source_size - p.in_front)))::BIGINT AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
"""
