"""Pages by HTTP: a batch source for a list of urls, a stream over a table of urls, and the cache that the stream fills."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterator

import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from quire.operators.order import ranked
from quire.runtime import discard, materialize, ship
from quire.sources.document import filesystem
from quire.sources.readers import exists
from quire.streaming.incremental import ingest

SCHEMA = "url string, html string, error string"
#: Tasks of a batch at most; beyond pertask times this, a task takes more urls.
TASKS = 10_000


class _Urls(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _Places(InputPartition):
    def __init__(self, first: int, end: int) -> None:
        self.first, self.end = first, end


class _Fetcher:
    def __init__(self, options: dict) -> None:
        self.tries, self.delay, self.timeout = int(options.get("tries", 3)), float(options.get("delay", 5)), float(options.get("timeout", 30))
        self.per_task = int(options.get("pertask", 50))

    def page(self, url: str | None) -> tuple[str | None, str | None, str | None]:
        html, error = None, "no url"
        for attempt in range(self.tries if url else 0):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as r:
                    return url, r.read().decode("utf-8", "replace"), None
            except (OSError, ValueError) as e:
                error = str(e)
                if attempt + 1 < self.tries:
                    time.sleep(self.delay)
        return url, html, error


class _Pages(_Fetcher, DataSourceReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.urls = options.get("urls", "").split()

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self.urls[i : i + self.per_task]) for i in range(0, len(self.urls), self.per_task)] or [_Urls([])]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        return map(self.page, partition.urls)


class _PageStream(_Fetcher, DataSourceStreamReader):
    """Offsets are places of the table; a task reads the urls of its places itself."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.table = options["table"]

    def _files(self) -> ds.Dataset | None:
        there, root = filesystem(self.table)
        if there.get_file_info(root).type == fs.FileType.NotFound:
            return None
        found = ds.dataset(root, filesystem=there, format="parquet", exclude_invalid_files=False)
        return found if found.files else None

    def initialOffset(self) -> dict:
        return {"place": 0}

    def latestOffset(self) -> dict:
        # From the footers; no row is read.
        found, end = self._files(), 0
        for file in found.get_fragments() if found else ():
            for group in file.row_groups:
                if group.num_rows:
                    end = max(end, group.statistics["place"]["max"] + 1)
        return {"place": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["place"], end["place"]
        step = max(self.per_task, -(-(last - first) // TASKS))
        return [_Places(i, min(i + step, last)) for i in range(first, last, step)]

    def read(self, partition: _Places) -> Iterator[tuple]:
        place = ds.field("place")
        for batch in self._files().to_batches(columns=["url"], filter=(place >= partition.first) & (place < partition.end), batch_size=1000):
            yield from map(self.page, batch.column("url").to_pylist())


class PageSource(DataSource):
    """``spark.read.format("quire-pages").option("urls", "...")``, or ``readStream`` with ``table``: url, html, error.

    Fetches with a constant delay between tries; pages are UTF-8 whatever the
    server says, and a page that can't be had is a row with its error.  As a
    stream it reads a table that ``add_urls`` writes, from the place where its
    checkpoint ends.
    """

    @classmethod
    def name(cls) -> str:
        return "quire-pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Pages(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _PageStream(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PageSource)


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """url, html of the pages that the cache holds, each once; errors are not held."""
    if not exists(spark, f"{cache}/batch=*"):
        return spark.createDataFrame([], "url string, html string")
    return spark.read.schema(SCHEMA).parquet(f"{cache}/batch=*").where("error IS NULL").select("url", "html").dropDuplicates(["url"])


def missing_pages(urls: DataFrame, cache: DataFrame, key: str = "url", limit: int | None = None) -> DataFrame:
    """Urls that the page cache lacks."""
    out = urls.join(cache.select(key), key, "left_anti")
    return out if limit is None else out.orderBy(key).limit(limit)


def add_urls(urls: DataFrame, table: str) -> int:
    """Append distinct urls to a stream's table, in places after those it has; their number.  One writer at a time."""
    spark = urls.sparkSession
    start = 0
    if exists(spark, f"{table}/*.parquet"):
        start = spark.read.schema("place long, url string").parquet(table).agg(F.coalesce(F.max("place") + 1, F.lit(0))).first()[0]
    rows = materialize(ranked(urls.select("url").where("url IS NOT NULL").distinct(), "url", name="place"))
    try:
        rows.select((F.col("place") + start).alias("place"), "url").sortWithinPartitions("place").write.mode("append").parquet(table)
        return rows.count()
    finally:
        discard(rows)


def fetch(urls: DataFrame, table: str, cache: str, checkpoint: str, **options: str) -> int:
    """Bring the pages of urls that the cache lacks into it; the number of rows added, errors included.

    What an earlier run put into the table and didn't fetch comes first, from
    the checkpoint, and isn't put there again.  Pages that failed are tried again
    by the next call that has no such rest.
    """
    spark = urls.sparkSession
    register(spark)
    go = lambda: ingest(spark, table, SCHEMA, cache, checkpoint, fmt="quire-pages", options={"table": table} | options)
    added = go() if exists(spark, f"{table}/*.parquet") else 0
    wanted = urls.select("url").distinct()
    if added:
        # The rest may have failed a moment ago.
        wanted = wanted.join(spark.read.schema(SCHEMA).parquet(f"{cache}/batch=*").select("url"), "url", "left_anti")
    return added + (go() if add_urls(missing_pages(wanted, cached(spark, cache)), table) else 0)
