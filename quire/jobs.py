"""Jobs: ``python -m quire.jobs JOB ...``.  Each exits with 1 where its check fails.

    normalise   RAW_GLOB OUT            yearly JSON files to Parquet tables, without error rows
    parse       PAGES CONFIG OUT        pages (paper_id, url, year, html) to papers; fails above 5 % errors
    audit       PAGES CONFIG [--year Y] [--sample N] [--seed 42]   questions that parsing would lose, in all pages
                or in N of each year; fails if there are any, or no page of the year
    ingest      SOURCE SCHEMA SINK CHECKPOINT [--key K]   new Parquet files, once
    fetch       URLS QUEUE CACHE CHECKPOINT [--limit N] [--delay 5]   pages of urls (url) that the cache lacks, resumed where a run ended
    match       PROGRAMS PAPERS OUT [--overrides YAML] [--json FILE] [--report]   talks to papers; fails if any is unmatched
    program     WORDS OUT --year Y --posters P [--venue V] [--orals N] [--spotlights N] [--names PAPERS]   booklet of talk
                pages (before page P, three columns) and a poster table (from P): OUT/papers, OUT/talks; fails if a
                talk isn't one paper's or a number doesn't hold
    cluster     VECTORS OUT [--k 20]    fit, and print the partition's stamp
    extend      VECTORS INCOMING STAMP OUT
    describe    VECTORS PAPERS [--terms 18] [--titles 12]
    check       VECTORS LABELS          labels made for this partition, and for all its clusters
    stamp       VECTORS LABELS [--model NAME]   bind a label file to this partition; fails if a cluster has no name
    switch      MASTER VECTORS COORDS LABELS   map and clusters of a model into the next version of the master; fails
                if labels or coordinates (paper_id, x, y) aren't those of the vectors
    active      MASTER                  version, vectors and coordinates in use
    export      PAPERS OUT [QUERY] [--format csv|json|index|array]   a browse query (``year=2022&sort=score-desc``) as CSV files
                or one JSON file; the whole corpus as one file: the compact browse index, or an array of all papers
"""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.errors import SparkRuntimeException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire import runtime
from quire.operators import booklet, browse, clustering, layout, matching, metrics, pages, ranking
from quire.sources import document, readers, snapshots, writers
from quire.sources import pages as page_source
from quire.streaming import incremental


def _config(spark: SparkSession, path: str):
    years = readers.year_config(spark, readers.yaml_rows(path))
    pages.check_eras(years)
    return years


def normalise(spark: SparkSession, a: argparse.Namespace) -> int:
    if not readers.exists(spark, a.raw):
        print("no input files", file=sys.stderr)
        return 1
    good, bad = readers.without_errors(readers.papers_json(spark, a.raw))
    twice = metrics.duplicate_keys(good, "paper_id").count()
    if twice:
        print(f"{twice} ids occur more than once", file=sys.stderr)
    writers.write_exploded(good.drop("file", "error"), a.out)
    print(f"{good.count()} papers, {bad.count()} errors")
    return 0


def parse(spark: SparkSession, a: argparse.Namespace) -> int:
    d = pages.parse_papers(spark.read.parquet(a.pages), _config(spark, a.config))
    writers.write_papers(d, a.out)
    try:
        metrics.error_gate(spark.read.parquet(a.out))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def audit(spark: SparkSession, a: argparse.Namespace) -> int:
    held = spark.read.parquet(a.pages)
    if a.year:
        held = held.where(F.col("year") == a.year)
    if held.isEmpty():
        print("no pages", file=sys.stderr)
        return 1
    if a.sample:
        held = ranking.sample_each(held, "year", "paper_id", a.sample, a.seed)
    faults = pages.audit_fields(held, _config(spark, a.config)).orderBy(F.desc("n_papers"), "kind", "detail")
    faults.show(100, truncate=False)
    return int(not faults.isEmpty())


def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    print(incremental.ingest(spark, a.source, a.schema, a.sink, a.checkpoint, key=a.key))
    return 0


def fetch(spark: SparkSession, a: argparse.Namespace) -> int:
    urls = page_source.missing_pages(spark.read.parquet(a.urls).select("url").distinct(), page_source.cached(spark, a.cache), limit=a.limit or None)
    print(page_source.fetch(urls, a.queue, a.cache, a.checkpoint, delay=str(a.delay)))
    return 0


def match(spark: SparkSession, a: argparse.Namespace) -> int:
    papers = spark.read.parquet(a.papers)
    over = readers.overrides(spark, readers.yaml_rows(a.overrides) if a.overrides else {})
    m = matching.match_talks(readers.programs_json(spark, a.programs), papers, over).cache()
    metrics.match_summary(m).show(truncate=False)
    left = m.where(F.col("match") == "unmatched").count()
    if left:
        if a.report:
            for r in writers.unmatched_stub(matching.best_guesses(m, papers)).toLocalIterator():
                print(r.line)
        return 1
    matching.talk_of_paper(m).write.mode("overwrite").parquet(a.out)
    if a.json:
        writers.write_talks(spark.read.parquet(a.out), metrics.match_summary(m), a.json)
    return 0


def program(spark: SparkSession, a: argparse.Namespace) -> int:
    words = spark.read.parquet(a.words)
    known = matching.name_lookup(spark.read.parquet(a.names)) if a.names else None
    talk_lines = layout.to_lines(words.where(F.col("page") < a.posters), 3, "gaps")
    poster_lines = layout.to_lines(words.where(F.col("page") >= a.posters), 1)
    talks = runtime.materialize(booklet.talk_records(talk_lines))
    records = runtime.materialize(booklet.poster_records(poster_lines, year=a.year, venue=a.venue or "conf", lookup=known))
    try:
        both = booklet.program(records, talks, *(None if n is None else int(n) for n in (a.orals, a.spotlights)))
        both.drop("doc").write.mode("overwrite").json(f"{a.out}/papers")
    except (ValueError, SparkRuntimeException) as e:
        print(e, file=sys.stderr)
        return 1
    booklet.talks_program(talks, a.year, a.words).drop("doc").write.mode("overwrite").json(f"{a.out}/talks")
    print(f"{records.count()} papers, {talks.count()} talks")
    return 0


def cluster(spark: SparkSession, a: argparse.Namespace) -> int:
    clustering.fit_kmeans(spark.read.parquet(a.vectors).drop("cluster_id"), a.k).write.mode("overwrite").parquet(a.out)
    print(clustering.partition_stamp(spark.read.parquet(a.out)).first().fingerprint)
    return 0


def extend(spark: SparkSession, a: argparse.Namespace) -> int:
    both, drift, stamp = clustering.extend(spark.read.parquet(a.vectors), spark.read.parquet(a.incoming), a.stamp)
    both.write.mode("overwrite").parquet(a.out)
    drift.show(truncate=False)
    print(stamp)
    return 0


def describe(spark: SparkSession, a: argparse.Namespace) -> int:
    v, p = spark.read.parquet(a.vectors), spark.read.parquet(a.papers).drop("cluster_id")
    clustering.cluster_terms(p.join(v.select("paper_id", "cluster_id"), "paper_id"), "cluster_id", F.col("title"), F.col("abstract"), a.terms).orderBy("cluster", "rank").show(1000, truncate=False)
    near = clustering.nearest_members(v, clustering.centroids(v), a.titles)
    near.join(p.select("paper_id", "title"), "paper_id").select("cluster_id", "rank", "title").orderBy("cluster_id", "rank").show(1000, truncate=False)
    return 0


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    v, labels = spark.read.parquet(a.vectors), readers.labels_json(spark, a.labels)
    first = labels.first()
    try:
        clustering.verify_labels(v, first.clustering if first else None)
    except clustering.LabelMismatch as e:
        print(e, file=sys.stderr)
        return 1
    unnamed = clustering.unnamed_clusters(v, labels).count()
    print(f"{unnamed} clusters without a name")
    return int(unnamed > 0)


def stamp(spark: SparkSession, a: argparse.Namespace) -> int:
    v = spark.read.parquet(a.vectors)
    # A row a cluster.
    names = {str(r.cluster_id): r.label for r in readers.labels_json(spark, a.labels).collect()}
    missing = sorted(r.cluster_id for r in clustering.unnamed_clusters(v, readers.labels_json(spark, a.labels)).collect())
    if missing:
        print(f"no name for clusters {missing}", file=sys.stderr)
        return 1
    writers.write_labels(names, clustering.partition_stamp(v).first().fingerprint, a.labels, a.model)
    return 0


def switch(spark: SparkSession, a: argparse.Namespace) -> int:
    v, coords, labels = spark.read.parquet(a.vectors), spark.read.parquet(a.coords), readers.labels_json(spark, a.labels)
    first = labels.first()
    try:
        clustering.verify_labels(v, first.clustering if first else None)
        patch = clustering.map_patch(v, coords, labels)
        version, n = snapshots.update(spark, a.master, patch, vectors=a.vectors, coords=a.coords, labels=a.labels)
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    print(f"version {version}, {n} papers changed")
    return 0


def active(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        m = snapshots.manifest(a.master)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    print(f"version {m['version']}, " + ", ".join(f"{k} {x}" for k, x in sorted(m["notes"].items())))
    return 0


def export(spark: SparkSession, a: argparse.Namespace) -> int:
    papers = spark.read.parquet(a.papers)
    query, today = browse.BrowseQuery.from_url(a.query), datetime.now(UTC).date().isoformat()
    index, scales = browse.browse_index(papers), metrics.scales(papers)
    kind = a.format or "csv"
    if kind == "csv":
        writers.write_csv(browse.csv_rows(browse.rows(index, query), scales), a.out)
    elif kind == "json":
        writers.write_export(index, query, scales, today, today, a.out)
    elif kind == "index":
        writers.write_index(index, scales, today, a.out)
    elif kind == "array":
        document.write_json_array(papers, a.out, "paper_id")
    else:
        print(f"no format {kind}", file=sys.stderr)
        return 1
    return 0


JOBS = {
    normalise: ["raw", "out"], parse: ["pages", "config", "out"], audit: ["pages", "config", "--year=0", "--sample=0", "--seed=42"], ingest: ["source", "schema", "sink", "checkpoint", "--key"], fetch: ["urls", "queue", "cache", "checkpoint", "--limit=0", "--delay=5"],
    match: ["programs", "papers", "out", "--overrides", "--json", "+report"],
    program: ["words", "out", "--year=2026", "--posters=1", "--venue", "--orals", "--spotlights", "--names"], cluster: ["vectors", "out", "--k=20"], extend: ["vectors", "incoming", "stamp", "out"],
    describe: ["vectors", "papers", "--terms=18", "--titles=12"], check: ["vectors", "labels"], stamp: ["vectors", "labels", "--model"], switch: ["master", "vectors", "coords", "labels"], active: ["master"], export: ["papers", "out", "?query", "--format"],
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(required=True)
    for f, names in JOBS.items():
        s = sub.add_parser(f.__name__)
        for n in names:
            if n.startswith("+"):
                s.add_argument(f"--{n[1:]}", action="store_true")
            elif n.startswith("?"):
                s.add_argument(n[1:], nargs="?", default="")
            elif "=" in n:
                name, value = n.split("=")
                s.add_argument(name, type=int, default=int(value))
            else:
                s.add_argument(n)
        s.set_defaults(job=f)
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"quire {a.job.__name__}").getOrCreate()
    return a.job(spark, a)


if __name__ == "__main__":
    sys.exit(main())
