"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import SMALL_BATCHES, discard, materialize, ship, work_dir

__all__ = ["ASCII_SPACE", "SMALL_BATCHES", "UPPER", "WORD", "content", "discard", "fixed_partitions", "keyed", "materialize", "read", "slices", "words_in"]

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fixed_partitions(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps rows, their order and the partitions they are in."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _plain_scan(df: DataFrame) -> bool:
    """Whether every row of ``df`` is one row of a file, the same ones whenever it is read."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def keyed(df: DataFrame) -> DataFrame:
    """row (a struct of all columns), r1, r2: 128 bits that no two rows share, equal rows included.

    The key is a hash of a row's file and place in it, so it is the same each
    time the table is read, by whatever tasks.  Tables that aren't plain scans
    of Parquet files are written first.  Ids may thus be null or repeated; and
    as the columns travel in one struct, no name clashes with one used beside it.
    """
    for again in (False, True):
        if again or not _plain_scan(df):
            df = materialize(df)
        place = df.metadataColumn("_metadata")
        try:
            return df.select(F.struct("*").alias("row"), *[F.xxhash64(F.lit(seed), place["file_path"], place["row_index"]).alias(f"r{seed}") for seed in (1, 2)])
        except AnalysisException:  # files without row numbers
            if again:
                raise
    raise AssertionError


def content(rows: DataFrame) -> Column:
    """A hash of all of a row's columns (see ``keyed``), for ties: rows that share it are equal,
    so that it doesn't matter which of them comes first.  Maps and variants can't be hashed and are left out.
    """
    fields = [f.name for f in rows.schema["row"].dataType.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(F.lit(5), *[F.col("row").getField(c) for c in fields])


def words_in(text: Column) -> Column:
    """Number of words (see WORD), 0 for null, as long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` in batches that are sorted by it, one table for each run."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[i - 1]:
                continue
            piece = batch.slice(start, i - start)
            if held and keys[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
            last = keys[start]
            start = i
    if held:
        yield pa.Table.from_batches(held)
