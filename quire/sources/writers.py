"""Sinks: Parquet and JSON tables, the browse index, CSV exports, talks, labels, versioned updates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import browse
from quire.operators.browse import BOM, BrowseQuery, csv_lines
from quire.sources.document import filesystem, section, write_document


def write_papers(papers: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by year; rows of a year are gathered first, a large year in several tasks of the size Spark aims at."""
    papers.hint("rebalance", F.col("year")).write.mode(mode).partitionBy("year").parquet(path)


def write_exploded(papers: DataFrame, path: str) -> None:
    """reviews, authors and areas as tables of their own beside papers: queries on them read no other column."""
    write_papers(papers.drop("reviews", "authors", "subject_areas"), f"{path}/papers")
    papers.select("paper_id", "year", F.inline("reviews")).write.mode("overwrite").parquet(f"{path}/reviews")
    papers.select("paper_id", "year", F.posexplode("authors").alias("ord", "author")).write.mode("overwrite").parquet(f"{path}/authors")
    papers.select("paper_id", "year", F.posexplode("subject_areas").alias("ord", "area")).write.mode("overwrite").parquet(f"{path}/areas")


def write_index(index: DataFrame, scales: DataFrame, built: str, path: str) -> None:
    """The compact browse index as one JSON file; its rows are written by the tasks that hold them."""
    head = f'{{"built":{json.dumps(built, ensure_ascii=False)},"areas":['
    sections = [section(head, ",", "],"), section('"scales":{', ",", "},"), section('"papers":[', ",\n", "]}\n")]
    write_document(browse.compact_index(index, scales).orderBy("section", "place"), path, sections)


def write_export(index: DataFrame, query: BrowseQuery, scales: DataFrame, built: str, exported: str, path: str, link: str = "") -> None:
    """A query's records as one JSON file that says which filters, order and counts made them.

    The driver sees counts and the scales, a row a year.
    """
    query = query.checked()
    by_year = {str(r.year): r.scale for r in scales.orderBy("year").collect()}
    head = {
        "link": link, "exported": exported, "index_built": built, "filters": browse.filters(query), "sort": query.sort,
        "count": index.where(query.predicate()).count(), "total_papers": index.count(), "review_scale_max_by_year": by_year,
    }
    rows = browse.json_export(index, query, scales).select(F.lit(0).alias("section"), "value")
    write_document(rows, path, [section(json.dumps(head, ensure_ascii=False)[:-1] + ', "papers": [\n', ",\n", "\n]}\n")])


def write_csv(table: DataFrame, path: str) -> None:
    """CSV with a byte order mark, CRLF line ends and a header in each file.

    Lines are made beforehand, since the quoting differs from Spark's writer.
    """
    header = BOM + ",".join(table.columns)
    lines = csv_lines(table)
    parts = lines.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    heads = parts.groupBy("p").agg((F.min("i") - 1).alias("i")).select(F.lit(header).alias("line"), "p", "i")
    both = heads.unionByName(parts).repartition("p").sortWithinPartitions("p", "i")
    both.select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_labels(names: dict[str, str], stamp: str, path: str, model: str | None = None) -> None:
    """A label file that is bound to a partition by its stamp."""
    there, place = filesystem(path)
    made = f"{place}.new"
    with there.open_output_stream(made) as f:
        f.write(json.dumps({"model": model, "clustering": stamp, "labels": dict(sorted(names.items(), key=lambda x: int(x[0])))}, indent=2, ensure_ascii=False).encode())
    there.move(made, place)


def unmatched_stub(unmatched: DataFrame) -> DataFrame:
    """Lines of a YAML file to fill in: a block a year, a title a line with its best candidate as a comment."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.concat(F.lit("  "), quoted("title_raw"), F.lit(": null  # "), F.coalesce(F.format_string("%.1f %s", F.col("best_score"), F.col("best_title")), F.lit("no candidate")))
    rows = unmatched.select("year", F.lit(1).alias("k"), F.col("title_raw").alias("t"), line.alias("line"))
    heads = unmatched.select("year").distinct().select("year", F.lit(0).alias("k"), F.lit("").alias("t"), F.concat(F.col("year").cast("string"), F.lit(":")).alias("line"))
    return heads.unionByName(rows).orderBy("year", "k", "t").select("line")


def write_talks(talks: DataFrame, summary: DataFrame, path: str) -> None:
    """Talks by paper id, and the summary by year, as one JSON file."""
    entry = lambda k, v: F.concat(F.substring(F.to_json(F.array(k)), F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(": "), F.to_json(v))
    t = talks.select(F.lit(0).alias("section"), F.col("paper_id").alias("place"), entry(F.col("paper_id"), F.struct("type", "session_id", "session_title", "day", "match")).alias("value"))
    year = F.col("year").cast("string")
    s = summary.select(F.lit(1).alias("section"), year.alias("place"), entry(year, F.struct("*")).alias("value"))
    write_document(t.unionByName(s).orderBy("section", "place"), path, [section('{"papers": {\n', ",\n", "},\n"), section('"summary": {', ",\n", "}}\n")])
