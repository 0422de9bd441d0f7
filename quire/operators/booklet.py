"""Program booklets: a poster table and pages of talks, set as lines, to records.

Both readers are islands over window functions.  A poster record owns the lines
from the first title line above its row to the last line of its presenter; a talk
owns the bold lines between two places that end one.  What a line means depends on
the lines before it only through running sums, running last values and the line
just before, so nothing is read by a loop and a booklet's lines are never held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import join_lines, last_first, presenter
from quire.operators.layout import sessionise
from quire.operators.matching import canonical_names, join_talks

# Patterns of the poster table.
POSTER_ROW = r"^(\d+)\s+(\d+)\s+([MTW]-(?:AM|PM)-\d{3})\s*(.*)$"
POSTER_AUTHORS = r"(?i)^Authors?\s*:\s*(.*)$"
POSTER_PRESENTER = r"(?i)^(?:Presenters?|Speakers?)\s*:\s*(.*)$"
POSTER_HEADINGS = r"(?i)^(Poster|Paper Poster|Board Paper Title|ID Session|Number|Paper Title|Board|Paper ID)\s*$"
# Patterns and type sizes of the talk pages.
SESSION_HEAD = r"(?i)^Oral(?: & Spotlight)? Session\s+(\S+)"
ORAL_MARKER = r"(?i)^Oral Presentations?\s*:?\s*$"
SPOTLIGHT_MARKER = r"(?i)^Spotlight Presentations?\s*:?\s*$"
BANNER_SIZE, SESSION_SIZE, BODY_SIZE = 13.0, 11.5, 10.5

ORDER = ["page", "col", "ord"]


def _lines(lines: DataFrame, first_page: int, last_page: int | None) -> DataFrame:
    pages = F.col("page") >= first_page
    if last_page is not None:
        pages &= F.col("page") <= last_page
    text = F.trim(F.coalesce("text", F.lit("")))
    return lines.where(pages).select("doc", *ORDER, text.alias("text"), F.coalesce("bold", F.lit(False)).alias("bold"), "size")


def _pieces(part: str) -> Column:
    """A record's lines of one part, joined in the order of the pages."""
    held = F.collect_list(F.when(F.col("part") == part, F.struct(*ORDER, "said")))
    return join_lines(F.transform(F.array_sort(held), lambda x: x["said"]))


def poster_records(lines: DataFrame, *, year: int, venue: str, first_page: int = 1, lookup: DataFrame | None = None) -> DataFrame:
    """doc, paper_id, year, poster_session, board_number, title, authors, presenter,
    presenter_affiliation, presenter_country of a poster table.

    A row (number, session, board, perhaps the title) begins a record.  A title may
    wrap upwards: lines after a presenter, or before the first row, are of the next
    row's title.  A presenter's address goes on over the lines that aren't bold, up
    to a heading of the table, a row or a bold line; markers in it are address.
    Every other line continues what was last marked.  Lines that wait for a row
    which never comes are dropped.  ``lookup`` has canonical names (folded,
    canonical); other names are turned around by rule.
    """
    d = _lines(lines, first_page, None)
    d = d.withColumn("blank", (F.col("text") == "") | F.col("text").rlike(POSTER_HEADINGS)).withColumn("row", ~F.col("blank") & F.col("text").rlike(POSTER_ROW))
    breaks = F.col("bold") | F.col("blank") | F.col("row")
    d = sessionise(d, ["doc"], ORDER, F.col("row"), "poster")
    d = sessionise(d, ["doc"], ORDER, breaks, "island")
    inside = (F.col("poster") > 0) & ~F.col("blank") & ~F.col("row")
    presents = inside & F.col("text").rlike(POSTER_PRESENTER)
    earlier = Window.partitionBy("doc", "island").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("address", ~breaks & F.coalesce(F.max(presents).over(earlier), F.lit(False)))
    marked = F.when(F.col("row"), "title").when(presents & ~F.col("address"), "presenter").when(inside & ~F.col("address") & F.col("text").rlike(POSTER_AUTHORS), "authors")
    d = d.withColumn("mark", marked)
    so_far = Window.partitionBy("doc", "poster").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("field", F.last("mark", ignorenulls=True).over(so_far))
    waits = F.col("mark").isNull() & ~F.col("address") & ((F.col("poster") == 0) | (F.col("field") == "presenter"))
    got = lambda pattern, i: F.regexp_extract("text", pattern, i)
    said = (
        F.when(F.col("row"), got(POSTER_ROW, 4)).when(F.col("mark") == "authors", got(POSTER_AUTHORS, 1)).when(F.col("mark") == "presenter", got(POSTER_PRESENTER, 1)).otherwise(F.col("text"))
    )
    part = F.when(waits, "title").when(F.col("address"), "presenter").otherwise(F.col("field"))
    d = d.where("NOT blank").withColumn("waits", waits).withColumn("owner", F.col("poster") + F.col("waits").cast("int")).withColumn("part", part).withColumn("said", said)
    head = F.max(F.when(F.col("row"), F.struct(*[got(POSTER_ROW, i).alias(n) for i, n in ((1, "number"), (2, "session"), (3, "board"))])))
    r = d.groupBy("doc", "owner").agg(head.alias("head"), *[_pieces(p).alias(p) for p in ("title", "authors", "presenter")]).where("head IS NOT NULL")
    names = F.filter(F.transform(F.split("authors", ","), lambda a: F.trim(a)), lambda a: a != "")
    who = presenter(F.col("presenter"))
    r = r.select(
        "doc", "owner", F.format_string("%s-%d-Paper%04d", F.lit(venue), F.lit(year), F.col("head.number").cast("long")).alias("paper_id"), F.lit(year).alias("year"),
        F.col("head.session").cast("int").alias("poster_session"), F.col("head.board").alias("board_number"), "title", names.alias("authors"), F.coalesce(who["name"], F.lit("")).alias("presenter"),
        F.coalesce(who["affiliation"], F.lit("")).alias("presenter_affiliation"), F.coalesce(who["country"], F.lit("")).alias("presenter_country"),
    )
    if lookup is None:
        r = r.withColumn("authors", F.transform("authors", lambda a: last_first(a)["name"])).withColumn("presenter", last_first(F.col("presenter"))["name"])
    else:
        every = F.concat(F.array(F.col("presenter")), F.col("authors"))
        named = canonical_names(r.select("doc", "owner", F.posexplode(every).alias("at", "name")), lookup)
        back = named.groupBy("doc", "owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "canonical"))), lambda x: x["canonical"]).alias("names"))
        r = r.join(back, ["doc", "owner"]).withColumn("presenter", F.get("names", F.lit(0))).withColumn("authors", F.slice("names", F.lit(2), F.size("names"))).drop("names")
    return r.drop("owner")


def talk_records(lines: DataFrame, *, first_page: int = 1, last_page: int | None = None, banner: float = BANNER_SIZE, session: float = SESSION_SIZE, body: float = BODY_SIZE) -> DataFrame:
    """doc, ord, title, presentation_type, oral_session of talk pages in columns.

    Type size tells the parts: banners (``banner`` and above), session heads and
    names (``session``), rooms and chairs (``body``), talks (below).  A session's
    state belongs to its column, over all pages: what a column's page begins with
    goes on with what the same column of the page before ended with.  A title is a
    run of bold lines; the next one begins at the bold line after a presenter, at a
    marker of a kind, or with the next session.  ``ord`` is the order in which talks
    end on the pages, those still open at the end by their columns.
    """
    d = _lines(lines, first_page, last_page).withColumn("size", F.round("size", 1)).where((F.col("text") != "") & (F.col("size") < banner))
    small = F.col("size") < body
    head = (F.col("size") >= session) & F.col("text").rlike(SESSION_HEAD)
    kind = (
        F.when(head, "head").when((F.col("size") >= session) & F.col("bold"), "name").when(small & F.col("text").rlike(ORAL_MARKER), "oral").when(small & F.col("text").rlike(SPOTLIGHT_MARKER), "spotlight")
        .when(small & F.col("bold"), "title").when(small, "plain")
    )
    by, order = ["doc", "col"], ["page", "ord"]
    w = Window.partitionBy(*by).orderBy(*order)
    seen = d.groupBy(*by).agg(F.min("page").alias("seen"))
    d = d.withColumn("kind", kind).where("kind IS NOT NULL")
    d = sessionise(d, by, order, F.col("kind") == "head", "session")
    # Names stand between a session's head and its first line of a talk.
    began = F.max(F.col("kind").isin("oral", "spotlight", "title", "plain")).over(Window.partitionBy(*by, "session").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("began", began)
    name = F.collect_list(F.when((F.col("kind") == "name") & ~F.col("began") & (F.col("session") > 0), F.struct("page", "ord", "text")))
    names = F.trim(F.array_join(F.transform(F.array_sort(name.over(Window.partitionBy(*by, "session"))), lambda x: x["text"]), " "))
    d = d.withColumn("oral_session", names).where("kind <> 'name'")
    ends = F.col("kind").isin("head", "oral", "spotlight") | ((F.col("kind") == "title") & (F.lag("kind").over(w) == "plain"))
    d = sessionise(d, by, order, F.coalesce(ends, F.lit(False)), "talk")
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = F.last(F.when(F.col("kind").isin("head", "oral"), "oral").when(F.col("kind") == "spotlight", "spotlight"), ignorenulls=True).over(before)
    d = d.withColumn("presentation_type", F.coalesce(of, F.lit("oral")))
    title = F.collect_list(F.when(F.col("kind") == "title", F.struct("page", "ord", "text")))
    t = d.groupBy("doc", "col", "talk").agg(
        join_lines(F.transform(F.array_sort(title), lambda x: x["text"])).alias("title"), F.max(F.when(F.col("kind") == "title", F.col("presentation_type"))).alias("presentation_type"),
        F.max(F.when(F.col("kind") == "title", F.col("oral_session"))).alias("oral_session"), F.min(F.struct("page", "ord")).alias("at"),
    )
    # A talk ends where the next one of its column begins, with or without a title.
    t = t.withColumn("end", F.lead("at").over(Window.partitionBy(*by).orderBy("talk"))).join(seen, by).where("title <> ''")
    last = F.col("end").isNull()
    place = F.struct(last.alias("l"), F.when(last, F.col("seen")).otherwise(F.col("end.page")).alias("p"), F.col("col").alias("c"), F.col("end.ord").alias("o"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy(place))
    return t.select("doc", number.alias("ord"), "title", "presentation_type", F.coalesce("oral_session", F.lit("")).alias("oral_session"))


def program(records: DataFrame, talks: DataFrame, n_orals: int | None = None, n_spotlights: int | None = None) -> DataFrame:
    """records with presentation_type (poster without a talk) and oral_session ('' without one).

    An error if a talk doesn't have exactly one record, or the numbers don't hold.
    """
    return join_talks(records, talks, n_orals, n_spotlights).withColumn("oral_session", F.coalesce("oral_session", F.lit("")))


def talks_program(talks: DataFrame, year: int, source: str) -> DataFrame:
    """A row a booklet: year, source_pdf, n_sessions, n_presentations and its sessions with their
    presentations, numbered as they first end, in the schema that ``programs_json`` reads.
    """
    first = Window.partitionBy("doc", "oral_session")
    t = talks.withColumn("at", F.min("ord").over(first)).withColumn("order", F.row_number().over(first.orderBy("ord")))
    one = F.struct(
        F.col("presentation_type").alias("type"), F.col("title").alias("title_raw"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("authors_raw"), F.lit(None).cast("string").alias("speaker"), "order",
    )
    s = t.groupBy("doc", "oral_session", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", one.alias("p")))), lambda x: x["p"]).alias("presentations"))
    s = s.withColumn("session_id", F.row_number().over(Window.partitionBy("doc").orderBy("at")))
    session = F.struct(F.col("session_id").cast("string").alias("session_id"), F.col("oral_session").alias("session_title"), F.lit("").alias("day"), "presentations")
    nested = F.transform(F.array_sort(F.collect_list(F.struct("session_id", session.alias("s")))), lambda x: x["s"])
    d = s.groupBy("doc").agg(F.count(F.lit(1)).cast("int").alias("n_sessions"), F.sum(F.size("presentations")).cast("int").alias("n_presentations"), nested.alias("sessions"))
    return d.select("doc", F.lit(year).alias("year"), F.lit(source).alias("source_pdf"), "n_sessions", "n_presentations", "sessions")
