"""Faceted browsing: one predicate for filters, facets, sorting, pages and exports."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean, searchable
from quire.operators.order import ranked

TYPE_NAMES = ("poster", "oral", "spotlight")
SORTS = ("year-desc", "year-asc", "score-desc", "score-asc", "title-asc")
PAGE_SIZES = (10, 50, 100)
DEFAULT_SCALE = 6
BOM = "﻿"


@dataclass(frozen=True)
class BrowseQuery:
    """State of a query; ``checked`` puts invalid parts back to their defaults."""

    q: str = ""
    year: int | None = None
    type: str | None = None
    area: str | None = None
    code: bool = False
    early: bool = False
    sort: str = "year-desc"
    per: int = 50
    page: int = 1

    def checked(self) -> BrowseQuery:
        sort = self.sort if self.sort in SORTS else "year-desc"
        if self.year is None and sort.startswith("score"):  # scores compare within one year only
            sort = "year-desc"
        return replace(self, sort=sort, per=self.per if self.per in PAGE_SIZES else 50, page=max(1, self.page), type=self.type if self.type in TYPE_NAMES else None)

    @classmethod
    def from_url(cls, query: str) -> BrowseQuery:
        p = {k: v[0] for k, v in parse_qs(query.lstrip("?")).items()}
        number = lambda k, d: int(p[k]) if p.get(k, "").isdigit() else d
        return cls(
            q=p.get("q", ""), year=number("year", None), type=p.get("type"), area=p.get("area"), code=p.get("code") == "1", early=p.get("early") == "1",
            sort=p.get("sort", "year-desc"), per=number("per", 50), page=number("page", 1),
        ).checked()

    def to_url(self) -> str:
        d = BrowseQuery()
        shown = {k: getattr(self, k) for k in ("q", "year", "type", "area", "code", "early", "sort", "per", "page")}
        return urlencode({k: int(v) if isinstance(v, bool) else v for k, v in shown.items() if v != getattr(d, k)})

    def changed(self, **filters) -> BrowseQuery:
        """Another filter begins at page 1; another page size keeps the first row in view."""
        if set(filters) == {"per"}:
            first = (self.page - 1) * self.per
            return replace(self, per=filters["per"], page=first // filters["per"] + 1).checked()
        return replace(self, **{"page": 1} | filters).checked()

    def predicate(self, skip: str = "", terms: list[str] | None = None) -> Column:
        """Conjunction of the filters that are set, but for the one in ``skip``."""
        c = F.lit(True)
        if self.year is not None and skip != "year":
            c &= F.col("year") == self.year
        if self.type and skip != "type":
            c &= F.col("type") == self.type
        if self.area and skip != "area":
            c &= F.array_contains("areas", self.area)
        if self.code and skip != "code":
            c &= F.coalesce(F.col("has_code"), F.lit(False))
        if self.early and skip != "early":
            c &= F.coalesce(F.col("early"), F.lit(False))
        if self.q and skip != "q":
            for t in terms if terms is not None else fold(self.q).split():
                c &= F.contains("search", F.lit(t))
        return c

    def order(self, title: str = "title", key: str = "id") -> list[Column]:
        """Sort keys; titles collate by the Unicode root locale, the id breaks ties."""
        name = F.collate(F.col(title), "UNICODE") if title else F.lit("")
        return {
            "year-desc": [F.desc("year"), name, F.asc(key)],
            "year-asc": [F.asc("year"), name, F.asc(key)],
            "score-desc": [F.desc("score_norm"), F.desc("year"), F.asc(key)],
            "score-asc": [F.asc("score_norm"), F.asc("year"), F.asc(key)],
            "title-asc": [name, F.asc(key)],
        }[self.checked().sort]


def fold(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def browse_index(papers: DataFrame) -> DataFrame:
    """The table that queries run on: search text made once, links cleaned, null scores dropped."""
    links = {"pdf_url": "pdf_url", "doi": "doi", "sharedit_url": "shared_it_url", "code_url": "code_url", "supp_url": "supp_url", "lncs": "lncs_volume"}
    nothing = F.expr("CAST(array() AS ARRAY<STRING>)")
    authors, areas = F.coalesce("authors", nothing), F.coalesce("subject_areas", nothing)
    kind = F.when(F.col("presentation_type").isin("oral", "spotlight"), F.col("presentation_type")).otherwise("poster")
    return papers.select(
        F.col("paper_id").alias("id"), "year", "title", authors.alias("authors"), areas.alias("areas"), "url",
        F.col("avg_score_raw").alias("score"), F.col("avg_score_normalized").alias("score_norm"),
        F.filter(F.col("reviews.score_raw"), lambda s: s.isNotNull()).alias("reviews"), F.coalesce("early_accepted", F.lit(False)).alias("early"),
        kind.alias("type"), clean(F.col("oral_session")).alias("session"), *[clean(F.col(src)).alias(out) for out, src in links.items()],
        F.filter(F.coalesce("dataset_urls", nothing), lambda d: clean(d).isNotNull()).alias("dataset_urls"), clean(F.col("code_url")).isNotNull().alias("has_code"),
        searchable(F.concat_ws(" ", "title", F.array_join(authors, " "), F.array_join(areas, " "))).alias("search"),
    )


def rows(index: DataFrame, query: BrowseQuery, title: str = "title", key: str = "id") -> DataFrame:
    """All rows of the query in order (exports take them all)."""
    query = query.checked()
    return index.where(query.predicate()).orderBy(*query.order(title, key))


def page(index: DataFrame, query: BrowseQuery, title: str = "title", key: str = "id") -> DataFrame:
    """One page; a page beyond the end becomes the last one."""
    query = query.checked()
    if query.page > 1:
        n = index.where(query.predicate()).count()
        query = replace(query, page=min(query.page, max(1, -(-n // query.per))))
    return rows(index, query, title, key).offset((query.page - 1) * query.per).limit(query.per)


def facet(index: DataFrame, query: BrowseQuery, by: str = "area") -> DataFrame:
    """value, n under all filters but the facet's own; most frequent first."""
    held = index.where(query.predicate(skip=by))
    value = F.explode("areas") if by == "area" else F.col(by)
    return held.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def encoded_areas(index: DataFrame) -> DataFrame:
    """area, area_id: the dictionary of the compact index, in order of the name."""
    names = index.select(F.explode("areas").alias("area")).where("area IS NOT NULL").distinct()
    return ranked(names, "area", name="area_id").withColumn("area_id", F.col("area_id").cast("int"))


def compact_records(index: DataFrame) -> DataFrame:
    """id and value: each paper of the compact index as JSON, areas as numbers, null links omitted; ids are unique."""
    named = index.select("id", F.posexplode("areas").alias("pos", "area")).join(encoded_areas(index), "area")
    numbers = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "area_id"))), lambda x: x["area_id"]).alias("area_ids"))
    code = F.element_at(F.create_map(*[x for i, t in enumerate(TYPE_NAMES) for x in (F.lit(t), F.lit(i))]), F.col("type"))
    record = F.struct(
        "id", "year", "title", "authors", F.coalesce("area_ids", F.expr("CAST(array() AS ARRAY<INT>)")).alias("areas"), "url", "score", "score_norm", "reviews",
        F.col("early").cast("int").alias("early"), code.alias("type"), "session", "pdf_url", "doi", "sharedit_url", "code_url", "supp_url", "lncs",
        F.when(F.size("dataset_urls") > 0, F.col("dataset_urls")).alias("dataset_urls"),
    )
    return index.join(numbers, "id", "left").select("id", F.to_json(record).alias("value"))


def compact_index(index: DataFrame, scales: DataFrame) -> DataFrame:
    """section, place, value of the compact index: 0 area names in order, 1 scales by year, 2 papers by id."""
    inner = lambda c: F.substring(F.to_json(c), F.lit(2), F.length(F.to_json(c)) - 2)
    areas = index.select(F.explode("areas").alias("area")).where("area IS NOT NULL").distinct().select(F.lit(0).alias("section"), F.col("area").alias("place"), inner(F.array("area")).alias("value"))
    year = F.col("year").cast("string")
    by_year = scales.select(F.lit(1).alias("section"), year.alias("place"), inner(F.create_map(year, F.col("scale"))).alias("value"))
    return areas.unionByName(by_year).unionByName(compact_records(index).select(F.lit(2).alias("section"), F.col("id").alias("place"), "value"))


def csv_rows(index: DataFrame, scales: DataFrame) -> DataFrame:
    """The nineteen columns of the CSV export, in order, all strings."""
    s = index.join(scales, "year", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "; ")
    return s.select(
        text("year").alias("year"), text("title").alias("title"), join("authors").alias("authors"), join("areas").alias("subject_areas"),
        F.coalesce(F.format_string("%.2f", "score"), F.lit("")).alias("mean_score"), F.coalesce("scale", F.lit(DEFAULT_SCALE)).cast("string").alias("scale_max"),
        F.coalesce(F.floor(F.col("score_norm") * 100 + 0.5).cast("string"), F.lit("")).alias("score_pct_of_scale"), join("reviews").alias("reviewer_scores"),
        text("type").alias("presentation_type"), text("session").alias("session"), F.when(F.col("early"), "yes").otherwise("no").alias("early_accepted"),
        text("url").alias("paper_url"), text("pdf_url").alias("pdf_url"), text("doi").alias("doi"), text("sharedit_url").alias("sharedit_url"),
        text("code_url").alias("code_url"), text("supp_url").alias("supp_url"), join("dataset_urls").alias("dataset_urls"), text("lncs").alias("lncs_volume"),
    )


def csv_lines(table: DataFrame) -> DataFrame:
    """Each row as a CSV line: quoted only where a quote, comma or line end asks for it."""
    cell = lambda c: F.when(F.col(c).rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return table.select(F.concat_ws(",", *[cell(c) for c in table.columns]).alias("line"))


def record_columns() -> list[Column]:
    """Fields of a record of the JSON export, from the index and its year's scale."""
    return [
        F.col("id").alias("paper_id"), F.col("year"), F.col("title"), F.col("authors"), F.col("areas").alias("subject_areas"), F.col("score").alias("mean_score"),
        F.coalesce("scale", F.lit(DEFAULT_SCALE)).alias("scale_max"), F.col("reviews").alias("reviewer_scores"), F.col("type").alias("presentation_type"),
        F.col("early").alias("early_accepted"), F.col("url").alias("paper_url"), *[F.col(c) for c in ("session", "pdf_url", "doi", "sharedit_url", "code_url", "supp_url")],
        F.when(F.size("dataset_urls") > 0, F.col("dataset_urls")).alias("dataset_urls"), F.col("lncs").alias("lncs_volume"),
    ]


def json_records(index: DataFrame, scales: DataFrame) -> DataFrame:
    """Records of the JSON export; null fields are left out by the writer."""
    return index.join(scales, "year", "left").select(*record_columns())


def export_name(query: BrowseQuery, extension: str, stem: str = "papers") -> str:
    """File name from the filters that are set."""
    slug = lambda s: re.sub("[^A-Za-z0-9]+", "-", s)
    bits = [stem, str(query.year) if query.year else "", query.type or "", slug(query.area or "").strip("-").lower()[:40], "with-code" if query.code else "", "early" if query.early else "", slug(query.q)[:20]]
    return "-".join(b for b in bits if b) + "." + extension


def filters(query: BrowseQuery) -> dict:
    """The filters that are set, by the names of the JSON export."""
    shown = {"search": query.q, "year": query.year, "presentation_type": query.type, "subject_area": query.area, "has_code": query.code, "early_accepted": query.early}
    return {k: v for k, v in shown.items() if v}


def json_export(index: DataFrame, query: BrowseQuery, scales: DataFrame) -> DataFrame:
    """value: the query's records as JSON, in its order."""
    query = query.checked()
    return index.where(query.predicate()).join(scales, "year", "left").orderBy(*query.order()).select(F.to_json(F.struct(*record_columns())).alias("value"))
