"""A corpus pipeline of five training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result of a
stage is written and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.  SQL can't express the near-duplicate and
packing stages, so there is no oracle; tests hold the stages against brute force.

No stage looks rows up by id: each row is judged by itself or by its place in
the table, so a null or repeated id loses nothing.  Every stage has one plan,
whatever the number of rows.

Defined cases: null or empty texts fail the base rules and go; rows of one id
and different texts are judged by their texts, as one document in line dedup;
rows of null ids are judged like others, in line dedup as documents after all
others; of equal ids in a class of near copies any one row stays; a null source
is a source; a text that line dedup empties has no words, so the mix leaves it;
an empty table gives empty tables, with the same columns; extra columns are
carried along up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import materialize, read
from quire.llm.line_dedup import dedup_lines
from quire.llm.mixing import apply_mix
from quire.llm.near_duplicates import keep_one
from quire.llm.packing import pack
from quire.llm.quality import keep_good
from quire.runtime import CLEANUP, ship


def begin(spark: SparkSession) -> None:
    """Before each stage: code for the workers; shuffle files go when the stage's result is written."""
    ship(spark)
    spark.conf.set(CLEANUP, "true")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or diverge from their language go."""
    begin(spark)
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; the mix leaves out what is empty then."""
    begin(spark)
    out = dedup_lines(docs)
    out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest id."""
    begin(spark)
    return keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    begin(spark)
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    begin(spark)
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicate join", near_duplicate_join),
    ("source mix", source_mix),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
