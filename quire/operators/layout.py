"""Laid-out pages to programs: columns, lines, roles, blocks, sessions, talks.

Words come as a table (one row a word).  Cutting columns, telling roles and
finding where blocks begin are window functions; grouping words to lines
depends on the first word of the line before and is a grouped pandas step.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import is_bold, is_italic, join_lines
from quire.runtime import ship
from quire.schemas import LINES

LINE_STEP = 4.0
GUTTER_MARGIN = 0.08
# Lines that belong to no session.
BOILERPLATE = (
    r"^\d{1,3}$",
    r"^MICCAI\s*\d{4}",
    r"presentation Schedule",
    r"Resorts World Convention Centre",
    r"(?i:International Conference on Medical Image Computing)",
    r"^AND COMPUTER ASSISTED INTERVENTION$",
    r"^ORAL AND SPOTLIGHT PRESENTATIONS$",
    r"^ORAL PRESENTATION PROGRAM$",
    r"(?i:^\d+\s*(TH|ST|ND|RD)\b)",
    r"^(Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,?$",
    r"^\d{1,2}:\d{2}\s*[–-]$",
    r"^\d{1,2}:\d{2}\s*\(UTC\)$",
    r"^(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s*\d{4}$",
)
# Patterns of entries of a program.
TIME_PREFIX = r"^\d{1,2}:\d{2}\s*[-–—]\s*\d{1,2}:\d{2}\s*"
TYPE_LINE = r"(?i)^(Oral|Spotlight)\s+Presentations\s*:\s*$"
INVITED = r"(?i)^Invited\s+Session\s+Speakers?"
PANEL = r"(?i)^Panel\s+Discussion\b|^Panell?ists\s*:"
CHAIRS = r"(?i)^Session\s+Chairs?\s*:?|^Chairs\s*:"


def boilerplate(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in BOILERPLATE))


def column_bounds(words: DataFrame, n_columns: int, margin: float = GUTTER_MARGIN) -> DataFrame:
    """doc, page, bounds: the centres of the n - 1 widest gaps between the words' midpoints whose centres are inside the margin; of equal gaps the right one."""
    mid = (F.col("x0") + F.col("x1")) / 2
    w = Window.partitionBy("doc", "page").orderBy("mid")
    gaps = words.select("doc", "page", mid.alias("mid"), "page_width").withColumn("next", F.lead("mid").over(w)).where("next IS NOT NULL")
    gaps = gaps.select("doc", "page", "page_width", (F.col("next") - F.col("mid")).alias("gap"), ((F.col("mid") + F.col("next")) / 2).alias("centre"))
    inside = gaps.where((F.col("centre") > margin * F.col("page_width")) & (F.col("centre") < (1 - margin) * F.col("page_width")))
    widest = Window.partitionBy("doc", "page").orderBy(F.desc("gap"), F.desc("centre"))
    return inside.withColumn("r", F.row_number().over(widest)).where(F.col("r") <= n_columns - 1).groupBy("doc", "page").agg(F.sort_array(F.collect_list("centre")).alias("bounds"))


def to_columns(words: DataFrame, n_columns: int, split: str = "midpoint") -> DataFrame:
    """words plus col; a midpoint on a bound belongs to the right."""
    mid = (F.col("x0") + F.col("x1")) / 2
    if n_columns == 1:
        return words.withColumn("col", F.lit(0))
    if split == "midpoint":
        return words.withColumn("col", F.least(F.floor(mid * n_columns / F.col("page_width")).cast("int"), F.lit(n_columns - 1)))
    b = column_bounds(words, n_columns)
    return words.join(b, ["doc", "page"], "left").withColumn("col", F.size(F.filter(F.coalesce("bounds", F.expr("CAST(array() AS ARRAY<DOUBLE>)")), lambda x: mid >= x))).drop("bounds")


def to_lines(words: DataFrame, n_columns: int, split: str = "midpoint", step: float = LINE_STEP) -> DataFrame:
    """Lines of each column: words whose top is within ``step`` of the line's first word.

    A line's size is the mean of its words'; it is bold or italic if most of them
    are, a number sign with digits in the margin aside.
    """
    ship(words.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(row=pdf["top"].round(1)).sort_values(["row", "x0"], kind="stable")
        rows, group, first = [], [], None

        def flush() -> None:
            if not group:
                return
            g = pd.DataFrame(group).sort_values("x0", kind="stable")
            text = " ".join(g["text"]).strip()
            if not text:
                return
            voters = g[~g["text"].str.match(r"#\d+$")]
            voters = voters if len(voters) else g
            rows.append((g["doc"].iloc[0], int(g["page"].iloc[0]), int(g["col"].iloc[0]), len(rows), text, float(g["size"].mean()), float(g["x0"].min()), float(g["top"].min()), bool(voters["bold"].mean() > 0.5), bool(voters["italic"].mean() > 0.5), len(rows) == 0))

        for w in pdf.to_dict("records"):
            if group and abs(w["top"] - first) >= step:
                flush()
                group = []
            if not group:
                first = w["top"]
            group.append(w)
        flush()
        return pd.DataFrame(rows, columns=["doc", "page", "col", "ord", "text", "size", "x0", "top", "bold", "italic", "new_flow"])

    d = to_columns(words, n_columns, split).withColumn("bold", is_bold(F.col("fontname"))).withColumn("italic", is_italic(F.col("fontname")))
    return d.select("doc", "page", "col", "text", "size", "x0", "top", "bold", "italic").groupBy("doc", "page", "col").applyInPandas(one, LINES)


def roles(lines: DataFrame, session: float, content: float, meta: float, tolerance: float = 0.08) -> DataFrame:
    """lines without boilerplate, plus role: session, content or meta by type size, the first that fits."""
    near = lambda size: F.abs(F.col("size") - size) <= tolerance
    return lines.where(~boilerplate(F.col("text"))).withColumn("role", F.when(near(session), "session").when(near(content), "content").when(near(meta), "meta"))


def sessionise(rows: DataFrame, by: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """rows plus a running number of starts (0 before the first)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.sum(F.coalesce(starts.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def gap_starts(value: str, by: list[str], order: list[str], gap: float) -> Column:
    """A row begins a block if its value is at least ``gap`` above the row before, below it, or there is none."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return before.isNull() | (F.col(value) - before >= gap) | (F.col(value) < before)


def block_starts(mode: str, by: list[str], order: list[str], gap: float) -> Column:
    """time: a time at the line's head; gap: a vertical gap; style: bold after a line that isn't."""
    if mode == "time":
        return F.col("text").rlike(TIME_PREFIX)
    if mode == "style":
        return F.col("bold") & ~F.coalesce(F.lag("bold").over(Window.partitionBy(*by).orderBy(*order)), F.lit(False))
    return gap_starts("top", by, order, gap)


def program_blocks(lines: DataFrame, *, session_re: str, mode: str, gap: float = 16.0, authors_re: str | None = None, speaker_re: str | None = None, bold_title: bool = False) -> DataFrame:
    """doc, session, session_line, block, type, title_raw, authors_raw, speaker, page, col, order of talks.

    ``lines`` have roles.  Sessions and blocks are islands between heading lines
    and block starts; invited talks and panels are left out.
    """
    order = ["col", "page", "ord"]
    heading = (F.col("role") == "session") & F.col("text").rlike(session_re)
    d = sessionise(lines.where("role IS NOT NULL"), ["doc"], order, heading, "session").where("session > 0")
    d = d.withColumn("session_line", F.first(F.when(heading, F.col("text")), ignorenulls=True).over(Window.partitionBy("doc", "session").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kind = F.last(F.when(F.col("text").rlike(TYPE_LINE), F.lower(F.regexp_extract("text", TYPE_LINE, 1))), ignorenulls=True)
    d = d.withColumn("type", F.coalesce(kind.over(Window.partitionBy("doc", "session").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit("oral")))
    d = d.where((F.col("role") == "content") & ~F.col("text").rlike(TYPE_LINE) & ~F.col("text").rlike(CHAIRS))
    by = ["doc", "session"]
    d = sessionise(d, by, order, block_starts(mode, by, order, gap), "block").where("block > 0")
    text = F.regexp_replace("text", TIME_PREFIX, "") if mode == "time" else F.col("text")
    w = Window.partitionBy("doc", "session", "block").orderBy(*order)
    marker = lambda pattern: F.col("t").rlike(f"(?i){pattern}") if pattern else F.lit(False)
    d = d.withColumn("t", F.trim(text)).withColumn("i", F.row_number().over(w))
    part = F.when(marker(speaker_re), "speaker").when(marker(authors_re), "authors")
    if bold_title:
        part = F.coalesce(part, F.when(~F.col("bold"), "authors"))
    d = d.withColumn("part", F.coalesce(F.last(part, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit("title")))
    strip = "|".join(f"(?:{p})" for p in (speaker_re, authors_re) if p) or "^$a"
    pieces = lambda name: join_lines(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("i", F.regexp_replace("t", f"(?i){strip}", "").alias("t"))))), lambda x: x["t"]))
    talks = d.groupBy("doc", "session", "session_line", "block").agg(
        F.min("type").alias("type"), F.bool_or(F.col("t").rlike(INVITED) | F.col("t").rlike(PANEL)).alias("_none"), pieces("title").alias("title_raw"), pieces("authors").alias("authors"), pieces("speaker").alias("speaker"),
        F.min("page").alias("page"), F.min("col").alias("col"),
    ).where("NOT _none AND title_raw <> ''")
    talks = talks.withColumn("authors_raw", F.filter(F.transform(F.split("authors", r"[,;]"), lambda a: F.trim(a)), lambda a: a != "")).withColumn("speaker", F.nullif("speaker", F.lit("")))
    number = F.row_number().over(Window.partitionBy("doc", "session").orderBy("block"))
    return talks.withColumn("order", number).select("doc", "session", "session_line", "block", "type", "title_raw", "authors_raw", "speaker", "page", "col", "order")


def check_sessions(talks: DataFrame, expected: int) -> None:
    """Raises unless the sessions are numbered 1 to ``expected`` without a gap."""
    found = sorted(r.session for r in talks.select("session").distinct().collect())
    if found != list(range(1, expected + 1)):
        raise ValueError(f"sessions {found}, expected 1 to {expected}")


def program_document(talks: DataFrame) -> DataFrame:
    """One row a session with its talks nested in order; sessions numbered as first seen."""
    first = talks.groupBy("doc", "session_line").agg(F.min(F.struct("session", "block")).alias("at"))
    first = first.withColumn("session_id", F.dense_rank().over(Window.partitionBy("doc").orderBy("at"))).drop("at")
    t = talks.join(first, ["doc", "session_line"])
    nested = F.array_sort(F.collect_list(F.struct("order", "type", "title_raw", "authors_raw", "speaker", "page", "col")))
    return t.groupBy("doc", "session_id", "session_line").agg(nested.alias("presentations"))
