"""Files that arrive are ingested once: availableNow runs, a checkpoint, and sinks that can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, *, fmt: str = "parquet", key: str | None = None, transform: Callable[[DataFrame], DataFrame] | None = None, options: dict[str, str] | None = None) -> int:
    """Read new files of ``source`` to the end, append them to the Parquet ``sink``; the number of new rows.

    A rerun without new files does nothing.  With ``key``, rows whose key the
    sink or the batch has already are left out, and a batch that is run again
    after a failure writes to its own folder again: no row comes twice.
    """
    added = spark.sparkContext.accumulator(0)

    def write(batch: DataFrame, batch_id: int) -> None:
        d = transform(batch) if transform else batch
        if key:
            d = d.dropDuplicates([key])
            old = _before(spark, sink, batch_id)
            if old is not None:
                d = d.join(old.select(key), key, "left_anti")
        path = f"{sink}/batch={batch_id}"
        d.write.mode("overwrite").parquet(path)
        added.add(spark.read.parquet(path).count())

    stream = spark.readStream.format(fmt).schema(schema).options(**(options or {})).load(source)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return added.value


def _before(spark: SparkSession, sink: str, batch_id: int) -> DataFrame | None:
    from quire.sources.readers import exists

    if not exists(spark, f"{sink}/batch=*"):
        return None
    return spark.read.parquet(sink).where(F.col("batch") < batch_id)


def resume(todo: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Work that isn't done yet, in order of the key."""
    left = todo.join(done.select(key), key, "left_anti").orderBy(key)
    return left if limit is None else left.limit(limit)


def windowed_counts(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", size: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts by event-time window with a watermark; batch and streaming inputs alike."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    return d.groupBy(F.window(time, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
