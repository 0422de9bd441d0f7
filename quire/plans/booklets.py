"""Program booklets made from the documents: each document's words are set as the lines of a poster or a talk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import booklet, layout
from quire.operators.matching import name_lookup
from quire.plans.registry import Tables, query

#: Documents of one booklet; a page has PER_PAGE of them.
POSTERS, TALKS, PER_PAGE = 60, 63, 5

#: Words of a text, eight a line; a line's last word is cut by a hyphen where (doc_id + line) % 5 = 0.
_SET = """
WITH words AS (SELECT doc_id, source, lang, regexp_extract_all(coalesce(text, ''), '[a-z]{2,}') AS w FROM documents),
set_lines AS (
  SELECT doc_id, source, lang, list_transform(range(0, (len(w) + 7) // 8), lambda i: array_to_string(w[i * 8 + 1 : i * 8 + 8], ' ') || CASE WHEN (doc_id + i) % 5 = 0 THEN '-' ELSE '' END) AS ls
  FROM words),
titles AS (SELECT *, replace(replace(array_to_string(ls, chr(10)), '-' || chr(10), '-'), chr(10), ' ') AS title FROM set_lines)
"""


def set_lines(t: Tables) -> DataFrame:
    """doc_id, source, lang, ls (lines of a document's words)."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{2,}"), F.lit(0))
    d = t.documents.select("doc_id", "source", "lang", words.alias("w")).withColumn("n", F.ceil(F.size("w") / 8).cast("int"))

    def one(i: Column) -> Column:
        return F.concat(F.array_join(F.slice("w", i * 8 + 1, F.lit(8)), " "), F.when((F.col("doc_id") + i) % 5 == 0, "-").otherwise(""))

    return d.select("doc_id", "source", "lang", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), one)).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)")).alias("ls"))


def _line(text: Column | str, bold: bool = False, size: float = 11.0) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(bold).alias("bold"), F.lit(size).alias("size"))


def _bold(lines: Column, size: float = 11.0) -> Column:
    return F.transform(lines, lambda x: _line(x, True, size))


def _when(test: Column, *lines: Column) -> Column:
    """The lines where the test holds."""
    return F.when(test, F.array(*lines)).otherwise(F.slice(F.array(lines[0]), 1, 0))


def poster_lines(t: Tables) -> DataFrame:
    """Lines of poster tables: zero to two title lines above the row, headings between them, wrapped authors and addresses."""
    d = set_lines(t)
    above = F.least((F.col("doc_id") % 3).cast("int"), F.size("ls"))
    tail = F.coalesce(F.get("ls", above), F.lit(""))
    row = F.concat((F.col("doc_id") % 10_000).cast("string"), F.lit(" "), (F.col("doc_id") % 4 + 1).cast("string"), F.lit(" T-PM-"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit(" "), tail)
    below = F.slice("ls", above + 2, F.greatest(F.size("ls") - above - 1, F.lit(0)))
    lab = F.concat(F.lit("Lab "), F.coalesce("source", F.lit("none")))
    every = F.concat(
        _bold(F.slice("ls", F.lit(1), above)), _when(F.col("doc_id") % 4 == 0, _line("Board"), _line("Paper Title")), F.array(_line(row, True)), _bold(below),
        F.array(_line(F.concat(F.lit("Authors: Ann van der Lee, Bo "), F.coalesce("lang", F.lit("xx")), F.lit(","))), _line("  Cy-  "), _line("Ann Dee , , Solo")),
        _when(F.col("doc_id") % 2 == 0, _line("poster ")),
        F.array(_line(F.concat(F.lit("PRESENTERS : Bo van Dee, "), lab, F.lit(", Speaker:")))), _when(F.col("doc_id") % 3 == 1, _line("Speaker: Hall,"), _line("United")), F.array(_line("Kingdom")),
    )
    lines = d.select("doc_id", F.posexplode(every).alias("ord", "l"))
    place = (F.col("doc_id") % POSTERS).cast("int")
    return lines.select(
        F.floor(F.col("doc_id") / POSTERS).cast("string").alias("doc"), (F.floor(place / PER_PAGE) + 1).cast("int").alias("page"), F.lit(0).alias("col"),
        ((place % PER_PAGE) * 1_000_000 + F.col("ord")).cast("int").alias("ord"), "l.text", "l.bold", "l.size",
    )


@query(_SET + f"""
SELECT (doc_id // {POSTERS})::VARCHAR AS doc, 'conf-2026-Paper' || lpad((doc_id % 10000)::VARCHAR, 4, '0') AS paper_id, (doc_id % 4 + 1)::INT AS poster_session,
       'T-PM-' || lpad((doc_id % 1000)::VARCHAR, 3, '0') AS board_number, title,
       'van der Lee, Ann; ' || coalesce(lang, 'xx') || ', Bo; Dee, Cy-Ann; Solo' AS authors, 'van Dee, Bo' AS presenter,
       'Lab ' || coalesce(source, 'none') || CASE WHEN doc_id % 3 = 1 THEN ', Speaker: Speaker: Hall' ELSE '' END AS presenter_affiliation,
       CASE WHEN doc_id % 3 = 1 THEN 'United Kingdom' ELSE 'Speaker: Kingdom' END AS presenter_country
FROM titles
""")
def booklet_posters(t: Tables) -> DataFrame:
    """Poster records of tables with titles that wrap upwards."""
    r = booklet.poster_records(poster_lines(t), year=2026, venue="conf")
    return r.select("doc", "paper_id", "poster_session", "board_number", "title", F.array_join("authors", "; ").alias("authors"), "presenter", "presenter_affiliation", "presenter_country")


@query(_SET + f"""
SELECT (doc_id // {POSTERS})::VARCHAR AS doc, 'conf-2026-Paper' || lpad((doc_id % 10000)::VARCHAR, 4, '0') AS paper_id,
       'Van Der LEE, Ann; ' || CASE WHEN lang IN ('en', 'de') THEN 'Known ' || lang || ', B.' ELSE coalesce(lang, 'xx') || ', Bo' END || '; Dee, Cy-Ann; Solo' AS authors, 'van Dee, Bo' AS presenter
FROM titles
""")
def booklet_names(t: Tables) -> DataFrame:
    """The same with canonical names of papers that are known already; a name with two forms is no help."""
    known = t.spark.createDataFrame([(["Van Der LEE, Ann", "Solo", "DEE, Bo van", "Dee, Bo Van"],)], "authors array<string>")
    lookup = name_lookup(known).unionByName(t.documents.select("lang").distinct().where("lang IN ('en', 'de')").select(F.concat(F.lit("bo "), "lang").alias("folded"), F.concat(F.lit("Known "), "lang", F.lit(", B.")).alias("canonical")))
    r = booklet.poster_records(poster_lines(t), year=2026, venue="conf", lookup=lookup)
    return r.select("doc", "paper_id", F.array_join("authors", "; ").alias("authors"), "presenter")


def talk_lines(t: Tables) -> DataFrame:
    """Lines of talk pages in three columns; a session has five talks of a column, seven of which stand on a page."""
    d = set_lines(t)
    place = (F.col("doc_id") % TALKS).cast("int")
    d = d.withColumn("col", place % 3).withColumn("k", F.floor(place / 3).cast("int"))
    name = F.concat(F.lit("Theme "), (F.floor(F.col("doc_id") / TALKS) * 100 + F.col("col") * 10 + F.floor(F.col("k") / 5)).cast("string"))
    first = F.col("k") % 5 == 0
    every = F.concat(
        _when(F.col("k") % 7 == 0, _line("Day and time", True, 14.0)),
        _when(first, _line("Oral & Spotlight Session O1", False, 12.0), _line(name, True, 12.0), _line("Revised lately", False, 12.0), _line("and Outcome", True, 12.0), _line("Room 5", True, 11.0), _line("Oral Presentations:", True, 10.0)),
        _when(F.col("k") % 5 == 3, _line("spotlight presentation", False, 10.0)), _when(F.col("k") % 5 == 4, _line("Stamp", True, 12.0)),
        _bold(F.col("ls"), 10.0), F.array(_line("Ann Lee, Lab,", False, 10.0), _line("Chile", False, 10.04)),
    )
    lines = d.select("doc_id", "col", "k", F.posexplode(every).alias("ord", "l"))
    return lines.select(
        F.floor(F.col("doc_id") / TALKS).cast("string").alias("doc"), (F.floor(F.col("k") / 7) + 2).cast("int").alias("page"), "col", ((F.col("k") % 7) * 1_000_000 + F.col("ord")).cast("int").alias("ord"),
        "l.text", "l.bold", "l.size",
    )


_TALKS = _SET + f""",
placed AS (SELECT *, (doc_id // {TALKS})::VARCHAR AS doc, (doc_id % {TALKS}) % 3 AS col, (doc_id % {TALKS}) // 3 AS k FROM titles),
talks AS (
  SELECT doc, doc_id, title, col, k, CASE WHEN k % 5 >= 3 THEN 'spotlight' ELSE 'oral' END AS presentation_type,
         'Theme ' || ((doc_id // {TALKS}) * 100 + col * 10 + k // 5) || ' and Outcome' AS oral_session
  FROM placed WHERE title <> '')
"""


@query(_TALKS + "SELECT doc, title, presentation_type, oral_session FROM talks")
def booklet_talks(t: Tables) -> DataFrame:
    """Talks of sessions that go on in the same column of the next page."""
    return booklet.talk_records(talk_lines(t)).select("doc", "title", "presentation_type", "oral_session")


@query(_TALKS + """
, ended AS (
  SELECT *, min(CASE WHEN title <> '' OR k % 5 IN (0, 3) THEN k END) OVER (PARTITION BY doc, col ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_k, min(k // 7) OVER (PARTITION BY doc, col) AS seen FROM placed),
numbered AS (
  SELECT doc, oral_session, row_number() OVER (PARTITION BY doc ORDER BY next_k IS NULL, CASE WHEN next_k IS NULL THEN seen ELSE next_k // 7 END, col, next_k) AS n
  FROM (SELECT e.*, 'Theme ' || ((doc_id // 63) * 100 + col * 10 + k // 5) || ' and Outcome' AS oral_session FROM ended e) WHERE title <> ''),
firsts AS (SELECT doc, oral_session, min(n) AS first_n, count(*)::INT AS n_talks FROM numbered GROUP BY ALL)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY first_n)::VARCHAR AS session_id, oral_session AS session_title, n_talks,
       (count(*) OVER (PARTITION BY doc))::INT AS n_sessions, (sum(n_talks) OVER (PARTITION BY doc))::INT AS n_presentations
FROM firsts
""")
def booklet_program(t: Tables) -> DataFrame:
    """Program documents of the talk pages: sessions in the order in which their first talk ends."""
    d = booklet.talks_program(booklet.talk_records(talk_lines(t)), 2026, "booklet")
    return d.select("doc", "n_sessions", "n_presentations", F.explode("sessions").alias("s")).select("doc", "s.session_id", "s.session_title", F.size("s.presentations").alias("n_talks"), "n_sessions", "n_presentations")


@query("""
WITH c AS (SELECT doc_id, source, text, (doc_id % 12)::INT AS i FROM documents)
SELECT doc_id, CASE WHEN i % 4 = 1 THEN 'session' WHEN i % 4 = 2 THEN 'content' WHEN i % 4 = 3 THEN 'meta' END AS role FROM c WHERE i <> 5
""")
def line_roles(t: Tables) -> DataFrame:
    """Roles of lines by type size, the venue's boilerplate left out."""
    i = (F.col("doc_id") % 12).cast("int")
    size = F.when(i % 4 == 1, 14.05).when(i % 4 == 2, 9.93).when(i % 4 == 3, 12.0).otherwise(20.0)
    text = F.when(i == 5, F.concat((F.col("doc_id") % 100).cast("string"), F.lit("th International"))).otherwise(F.concat(F.lit("A line of "), F.coalesce("source", F.lit("none"))))
    d = t.documents.select("doc_id", size.alias("size"), text.alias("text"))
    return layout.roles(d, 14.0, 10.0, 12.0).select("doc_id", "role")
