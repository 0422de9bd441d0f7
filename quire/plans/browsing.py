"""Faceted browsing on the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import browse
from quire.operators.browse import BrowseQuery
from quire.plans.registry import Tables, query


def index(t: Tables) -> DataFrame:
    """Documents as a browsable index: language and source are areas, quality is the score."""
    d = t.documents.join(t.labels, "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("id"), (2020 + F.col("doc_id") % 5).cast("int").alias("year"), F.col("text").alias("title"), F.array("lang", "source").alias("areas"),
        F.when(F.col("toxic") == 1, "oral").otherwise("poster").alias("type"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("has_code"), F.lit(False).alias("early"),
        (F.col("n_chars") / 1000).alias("score_norm"), F.lower("text").alias("search"),
    )


_INDEX = """
WITH d AS (
  SELECT doc_id AS id, (2020 + doc_id % 5)::INT AS year, lang, source, CASE WHEN toxic = 1 THEN 'oral' ELSE 'poster' END AS type,
         coalesce(quality = 1, false) AS has_code, n_chars / 1000 AS score_norm, lower(text) AS search
  FROM documents LEFT JOIN labels USING (doc_id))
"""


@query(_INDEX + """
SELECT id, year, type, round(score_norm, 6) AS score_norm FROM d
WHERE year = 2022 AND lang = 'en' AND contains(search, 'the') AND contains(search, 'ing')
ORDER BY d.score_norm DESC, d.year DESC, id LIMIT 10 OFFSET 10
""")
def browse_page(t: Tables) -> DataFrame:
    """Second page of a search within one year and area, by score."""
    q = BrowseQuery(q="The ing", year=2022, area="en", sort="score-desc", per=10, page=2)
    return browse.page(index(t), q).select("id", "year", "type", F.round("score_norm", 6).alias("score_norm"))


@query(_INDEX + """
SELECT value, count(*) AS n FROM (SELECT unnest([lang, source]) AS value FROM d WHERE has_code AND type = 'poster' AND contains(search, 'la')) GROUP BY value
""")
def browse_facets(t: Tables) -> DataFrame:
    """Counts of areas under all other filters."""
    return browse.facet(index(t), BrowseQuery(q="la", area="fr", code=True, type="poster"))


@query(_INDEX + "SELECT year AS value, count(*) AS n FROM d WHERE lang = 'de' AND has_code GROUP BY year")
def browse_year_facets(t: Tables) -> DataFrame:
    return browse.facet(index(t), BrowseQuery(area="de", code=True, year=2021), by="year")


@query(_INDEX + '''
SELECT '"' || id || ', ""' || type || '"""' || ',' || year || ',' || lang || '; ' || source AS line FROM d WHERE year = 2024 AND type = 'oral'
''')
def browse_export(t: Tables) -> DataFrame:
    """All rows of a query as CSV lines, quoted where it is needed."""
    rows = browse.rows(index(t).withColumn("title", F.lit("")), BrowseQuery(year=2024, type="oral"))
    table = rows.select(F.format_string('%d, "%s"', "id", "type").alias("key"), F.col("year").cast("string").alias("year"), F.array_join("areas", "; ").alias("areas"))
    return browse.csv_lines(table)


@query(_INDEX + ", a AS (SELECT DISTINCT unnest([lang, source]) AS area FROM d) SELECT area, (row_number() OVER (ORDER BY area) - 1)::INT AS area_id FROM a")
def encoded_areas(t: Tables) -> DataFrame:
    """Dictionary of areas."""
    return browse.encoded_areas(index(t))


@query("SELECT doc_id, regexp_replace(lower(strip_accents(lang || ' ' || source)), '\\s+', ' ', 'g') AS search FROM documents")
def search_text(t: Tables) -> DataFrame:
    """Search text without accents and case."""
    from quire.functions.text import searchable

    return t.documents.select("doc_id", searchable(F.concat_ws(" ", "lang", "source")).alias("search"))


@query(_INDEX + """, a AS (SELECT area, row_number() OVER (ORDER BY area) - 1 AS k FROM (SELECT DISTINCT unnest([lang, source]) AS area FROM d) WHERE area IS NOT NULL)
SELECT id::BIGINT AS id, year, concat('[', coalesce(concat_ws(',', x.k, y.k), ''), ']') AS areas, (type = 'oral')::INT AS type, score_norm
FROM d LEFT JOIN a x ON lang = x.area LEFT JOIN a y ON source = y.area
""")
def compact_papers(t: Tables) -> DataFrame:
    """Papers of the compact index, areas as numbers."""
    missing = [c for c in ("authors", "url", "score", "reviews", "session", "pdf_url", "doi", "sharedit_url", "code_url", "supp_url", "lncs", "dataset_urls")]
    whole = index(t).drop("title").select("*", *[F.lit(None).cast("array<string>" if c in ("authors", "dataset_urls") else "string").alias(c) for c in missing], F.lit("").alias("title"))
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return browse.compact_records(whole).select("id", field("year").cast("int").alias("year"), field("areas").alias("areas"), field("type").cast("int").alias("type"), field("score_norm").cast("double").alias("score_norm"))
