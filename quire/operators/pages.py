"""Page parsing by era: paper records, index and category pages, label routing, field audit.

Pages become blocks in one vectorised Python step; everything after it is
column expressions over arrays, so parsing needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.html import categories, page_blocks
from quire.functions.text import bare_int, blank_to_null, int_in_parens, label_without_score, verdict_lower
from quire.runtime import materialize, ship
from quire.schemas import META_REVIEW, REVIEW

# Fields of a review, the parts of a label that lead to them, the eras, and a part that must be there as well.
ROUTES = (
    ("text_contribution", ("describe the contribution",), "all", None),
    ("text_strengths", ("major strengths", "main strengths"), "all", None),
    ("text_weaknesses", ("major weaknesses", "main weaknesses"), "all", None),
    ("clarity_label", ("rate the clarity",), "all", None),
    ("text_ethics", ("code of ethics",), "new", None),
    ("text_reproducibility", ("reproducibility",), "all", None),
    ("text_detailed_comments", ("additional comments", "detailed and constructive comments"), "all", None),
    ("score", (), "all", None),
    ("post_rebuttal_label", ("final opinion", "overall opinion"), "all", "[post rebuttal]"),
    ("text_post_rebuttal_justification", ("justify your final", "justify your decision"), "all", "[post rebuttal]"),
    ("text_detailed_comments", ("justify your recommendation",), "all", None),
    ("confidence", ("reviewer confidence",), "all", None),
)
# Classes of links by words of their paragraph.
LINK_WORDS = {"pdf": ("main paper",), "shared": ("sharedit",), "supp": ("supplementary",), "new doi": ("springerlink", "doi"), "old doi": ("doi", "springer")}
TITLE_SUFFIX = r"\s*-\s*MICCAI\s+\d{4}.*$"
NOT_SUBMITTED, SHARED_HOST, DOI_HOST = "not submitted", "rdcu.be", "doi.org"

ERAS = ("2021", "2022_2023", "2024_2025")
NEW_ERA = "2024_2025"
APPEND = ("text_reproducibility", "text_detailed_comments")


def check_eras(years: DataFrame) -> None:
    """Raises for a year whose era has no parser."""
    unknown = [r.era for r in years.select("era").distinct().collect() if r.era not in ERAS]
    if unknown:
        raise NotImplementedError(f"no parser for eras {sorted(map(str, unknown))}")


def route(label: Column, score_field: Column, new_era: Column, extra: Column | None = None) -> Column:
    """Field of a review that a question's label (lower case) belongs to; the first rule of ROUTES that fits wins.

    ``extra`` is an array of (label_substring, store_as) for questions that the
    year's configuration names; they come last.
    """
    out = None
    for field, parts, era, also in ROUTES:
        fits = F.contains(label, F.lower(score_field)) if field == "score" else _any(label, parts)
        if era != "all":
            fits &= new_era if era == "new" else ~new_era
        if also:
            fits &= F.contains(label, F.lit(also))
        out = F.when(fits, field) if out is None else out.when(F.coalesce(fits, F.lit(False)), field)
    if extra is None:
        return out
    named = F.get(F.filter(extra, lambda x: F.contains(label, F.lower(x["label_substring"]))), F.lit(0))["store_as"]
    return out.otherwise(F.when(~new_era, named))


def _any(text: Column, parts: Sequence[str]) -> Column:
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out |= F.contains(text, F.lit(p))
    return out


def _under(blocks: Column, *ids: str) -> Column:
    """Blocks after the first heading with one of the ids, the ids in order of preference."""
    def below(i: str) -> Column:
        return F.filter(blocks, lambda b: b["head_id"] == i)

    found = [below(i) for i in ids]
    out = found[-1]
    for f in reversed(found[:-1]):
        out = F.when(F.size(f) > 0, f).otherwise(out)
    return out


def _first(blocks: Column, kind: str) -> Column:
    return F.get(F.filter(blocks, lambda b: b["kind"] == kind), F.lit(0))


def _last_href(blocks: Column, test) -> Column:
    hit = F.filter(blocks, lambda b: (b["kind"] == "p") & b["href"].isNotNull() & test(F.lower(b["joined"]), b["href"]))
    return F.get(F.transform(F.slice(hit, F.greatest(F.size(hit), F.lit(1)), F.lit(1)), lambda b: b["href"]), F.lit(0))


def _links(blocks: Column, new_era: Column) -> dict[str, Column]:
    """Link urls of the blocks below their heading: each paragraph is of the first class that fits; a later one replaces an earlier."""
    def kind(t: Column, href: Column) -> Column:
        has = lambda name: _any(t, LINK_WORDS[name])
        shared = has("shared") | F.contains(href, F.lit(SHARED_HOST))
        supp = has("supp") & ~F.contains(t, F.lit(NOT_SUBMITTED))
        new = F.when(has("pdf"), "pdf").when(shared, "shared").when(has("new doi"), "doi").when(supp, "supp")
        old = F.when(F.endswith(F.lower(href), F.lit(".pdf")) | has("pdf"), "pdf").when(shared, "shared").when(F.contains(href, F.lit(DOI_HOST)) | has("old doi"), "doi").when(supp, "supp")
        return F.when(new_era, new).otherwise(old)

    return {out: _last_href(blocks, lambda t, h, k=k: kind(t, h) == k) for out, k in (("pdf_url", "pdf"), ("shared_it_url", "shared"), ("doi", "doi"), ("supp_url", "supp"))}


def _reviews(numbers: Column, routed: Column, cfg: dict[str, Column]) -> Column:
    """Reviews by number from the routed fields (struct head_id, route, lines, inline in page order).

    Three passes, since what a lambda's body names twice is calculated twice: a
    review's own fields, the answers among them, then what is read from the answers.
    """
    bare, new, top = F.coalesce(cfg["score_parse_mode"] == "bare_integer", F.lit(False)), cfg["new_era"], cfg["review_scale_max"]

    def answers(x: Column) -> Column:
        of = lambda name: F.filter(x["fields"], lambda f: f["route"] == name)
        last = lambda name, what: F.try_element_at(of(name), F.lit(-1))[what]
        block = lambda name: F.array_join(F.transform(of(name), lambda f: f["lines"]), "\n\n")
        return F.struct(
            x["no"].alias("no"), last("score", "inline").alias("score"), last("confidence", "inline").alias("confidence"), last("post_rebuttal_label", "inline").alias("post"), last("clarity_label", "inline").alias("clarity"),
            *[last(f"text_{n}", "lines").alias(n) for n in ("contribution", "strengths", "weaknesses", "post_rebuttal_justification", "ethics")],
            *[block(f"text_{n}").alias(n) for n in ("detailed_comments", "reproducibility")],
            *[last(n, "inline").alias(n) for n in ("review_stack_rank", "review_stack_size")],
        )

    def read(x: Column) -> Column:
        return F.struct(
            x.alias("x"), F.when(bare, bare_int(x["score"])).otherwise(int_in_parens(x["score"])).alias("score"),
            F.when(new, label_without_score(x["score"])).otherwise(x["score"]).alias("label"), F.when(new, label_without_score(x["post"])).otherwise(x["post"]).alias("post_label"),
        )

    def review(r: Column) -> Column:
        x, score, label, post_label = r["x"], r["score"], r["label"], r["post_label"]
        text = lambda name: blank_to_null(x[name])
        post_score = F.when(F.coalesce(cfg["post_rebuttal_has_score"], F.lit(False)), F.coalesce(int_in_parens(x["post"]), bare_int(x["post"])))
        given = post_label.isNotNull() & ~F.upper(F.trim(post_label)).isin("", "N/A")
        changed = F.coalesce(given & (verdict_lower(label) != verdict_lower(post_label)), F.lit(False))
        return F.struct(
            x["no"].alias("reviewer_num"), score.alias("score_raw"), top.alias("score_max"), ((score - 1) / (top - 1)).alias("score_normalized"),
            label.alias("recommendation_label"), post_label.alias("post_rebuttal_label"), post_score.alias("post_rebuttal_score_raw"), changed.alias("score_changed"),
            int_in_parens(x["confidence"]).alias("confidence_raw"), label_without_score(x["confidence"]).alias("confidence_label"), x["clarity"].alias("clarity_label"),
            text("contribution").alias("text_contribution"), text("strengths").alias("text_strengths"), text("weaknesses").alias("text_weaknesses"),
            text("detailed_comments").alias("text_detailed_comments"), text("reproducibility").alias("text_reproducibility"),
            text("post_rebuttal_justification").alias("text_post_rebuttal_justification"), text("ethics").alias("text_ethics"),
            bare_int(x["review_stack_rank"]).alias("review_stack_rank"), bare_int(x["review_stack_size"]).alias("review_stack_size"),
        )

    own = F.transform(numbers, lambda n: F.struct(n.alias("no"), F.filter(routed, lambda f: f["head_id"] == F.concat(F.lit("review-"), n.cast("string"))).alias("fields")))
    return F.transform(F.transform(F.transform(own, answers), read), review)


def _meta_reviews(blocks: Column, headings: Column, new_era: Column) -> Column:
    """Meta-reviews: numbered from 1 without a gap (new era), or all headings, or a bare list."""
    ids = F.transform(F.filter(headings, lambda h: h["id"].rlike("^meta-review-") & h["tag"].isin("h2", "h3")), lambda h: h["id"])
    numbers = F.transform(F.filter(ids, lambda i: i.rlike(r"^meta-review-\d+$")), lambda i: F.regexp_extract(i, r"(\d+)$", 1).cast("int"))
    run = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))), lambda n: F.when(F.forall(F.sequence(F.lit(1), n), lambda k: F.array_contains(numbers, k)), F.concat(F.lit("meta-review-"), n.cast("string")))), lambda i: i.isNotNull())
    chosen = F.when(new_era, run).otherwise(ids)
    usable = lambda f: ~F.upper(F.trim(f["lines"])).isin("", "N/A")

    def one(x: Column) -> Column:
        f = x["fields"]
        low = lambda b: F.lower(b["label"])
        final = F.filter(f, lambda b: F.contains(low(b), F.lit("after you have reviewed the rebuttal")))
        pre = F.filter(f, lambda b: F.startswith(low(b), F.lit("your recommendation")) & ~F.contains(low(b), F.lit("after you have reviewed the rebuttal")))
        other = F.filter(f, lambda b: usable(b) & ~F.contains(low(b), F.lit("after you have reviewed the rebuttal")) & F.when(
            new_era, ~F.startswith(low(b), F.lit("your recommendation")) & (F.contains(low(b), F.lit("justify your")) | ~F.contains(low(b), F.lit("recommendation"))),
        ).otherwise(F.contains(low(b), F.lit("provide your assessment")) | F.contains(low(b), F.lit("justify your recommendation")) | ~F.contains(low(b), F.lit("rank"))))
        at = lambda c, what: F.try_element_at(F.transform(c, lambda b: b[what]), F.lit(-1))
        rec = F.when(new_era, F.coalesce(blank_to_null(at(final, "lines")), at(pre, "lines"))).otherwise(at(final, "inline"))
        return F.struct(x["no"].alias("meta_reviewer_num"), rec.alias("recommendation"), blank_to_null(F.array_join(F.transform(other, lambda b: b["lines"]), "\n\n")).alias("text"))

    bare = F.filter(blocks, lambda b: (b["head_id"] == "metareview-id") & (b["kind"] == "field"))
    filled = F.filter(bare, usable)
    kept = F.filter(filled, lambda b: ~F.contains(F.lower(b["label"]), F.lit("rank")))
    alone = F.array(F.struct(F.lit(1).alias("meta_reviewer_num"), F.lit(None).cast("string").alias("recommendation"), blank_to_null(F.array_join(F.transform(kept, lambda b: b["lines"]), "\n\n")).alias("text")))
    own = F.transform(chosen, lambda i, n: F.struct((n + 1).alias("no"), F.filter(blocks, lambda b: (b["head_id"] == i) & (b["kind"] == "field")).alias("fields")))
    listed = F.transform(own, one)
    return F.when(~new_era & (F.size(ids) == 0) & (F.size(filled) > 0), alone).otherwise(listed)


def parse_papers(pages: DataFrame, years: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Paper records of pages (paper_id, url, year, html).

    ``areas`` (filename, areas) gives subject areas by the url's last part.  A
    page without html has ``error`` set and nothing parsed.
    """
    ship(pages.sparkSession)
    cfg = years.select("year", "era", "score_field_substring", "score_parse_mode", "post_rebuttal_has_score", "review_scale_max", "extra_review_fields")
    # A row a year: the pages stay where they are.
    d = pages.join(F.broadcast(cfg), "year", "left").withColumn("p", page_blocks("html"))
    new = F.coalesce(F.col("era") == NEW_ERA, F.lit(True))
    b, heads = F.col("p.blocks"), F.col("p.headings")
    has = lambda i: F.exists(heads, lambda h: h["id"] == i)

    sections = ("abstract", "abstract-id", "link-to-paper", "link-id", "reviews", "review-id", "primary-meta-review", "metareview-id", "author-feedback", "authorFeedback-id")
    loose = F.get(F.transform(F.filter(heads, lambda h: (h["tag"] == "h1") & ~h["id"].isin(*sections) & (h["text"] != "")), lambda h: h["text"]), F.lit(0))
    suffix = F.regexp_replace(F.col("p.title_tag"), TITLE_SUFFIX, "")
    title = F.when(new, F.coalesce("p.title_b", "p.title_h")).otherwise(F.coalesce(F.col("p.title_b"), F.col("p.title_h"), loose, blank_to_null(suffix)))

    named = _under(b, "author-id")
    tagged = F.flatten(F.transform(named, lambda x: F.when(F.exists(x["hrefs"], lambda h: F.contains(h, F.lit("/tags#")) | F.contains(h, F.lit("/papers/tags"))), F.array(x["joined"])).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))))
    authors = F.when(new | (F.size("p.tags") > 0), F.col("p.tags")).otherwise(tagged)

    abstract = _first(_under(b, "abstract-id", "abstract"), "p")["joined"]
    abstract = blank_to_null(F.regexp_replace(F.regexp_replace(abstract, r"\\url\{[^}]*\}", ""), r"\$[^$]+\$", ""))
    code = F.trim(_first(_under(b, "code-id"), "p")["href"])
    code = F.when(~F.upper(code).isin("", "N/A"), code)
    data = F.coalesce(_first(_under(b, "dataset-id"), "p")["hrefs"], F.expr("CAST(array() AS ARRAY<STRING>)"))
    bib = F.when(new, F.trim(_first(_under(b, "bibtex-id"), "pre")["joined"]))
    feedback = _first(_under(b, "authorFeedback-id", "author-feedback"), "blockquote")["lines"]
    feedback = F.when(~F.upper(F.trim(feedback)).isin("", "N/A"), feedback)

    numbers = F.array_sort(F.array_distinct(F.transform(F.filter(heads, lambda h: (h["tag"] == "h3") & h["id"].rlike(r"^review-\d+$")), lambda h: F.regexp_extract(h["id"], r"(\d+)$", 1).cast("int"))))
    config = {c: F.col(c) for c in ("score_parse_mode", "post_rebuttal_has_score", "review_scale_max")} | {"new_era": new}
    routed = F.transform(F.filter(b, lambda x: x["kind"] == "field"), lambda x: F.struct(x["head_id"].alias("head_id"), route(F.lower(x["label"]), F.col("score_field_substring"), new, F.col("extra_review_fields")).alias("route"), x["lines"].alias("lines"), x["inline"].alias("inline")))
    d = d.withColumn("routed", routed).withColumn("numbers", F.when(has("review-id") | ~new, numbers))
    reviews = _reviews(F.col("numbers"), F.col("routed"), config)
    d = d.withColumn("reviews", F.coalesce(reviews, F.expr("array()").cast(f"array<{REVIEW}>")))

    said = F.coalesce(F.contains(F.lower(_first(_under(b, "metareview-id"), "p")["joined"]), F.lit("early accepted")), F.lit(False))
    meta = F.when(new & said, F.expr("array()").cast(f"array<{META_REVIEW}>")).otherwise(_meta_reviews(b, heads, new))
    d = d.withColumn("meta_reviews", F.coalesce(meta, F.expr("array()").cast(f"array<{META_REVIEW}>")))
    one = F.get("meta_reviews", F.lit(0))["recommendation"]
    early = F.when(~new, ~has("postrebuttal-id")).when(F.col("year") >= 2025, (F.size("meta_reviews") == 1) & F.coalesce(F.contains(F.lower(one), F.lit("provisional accept")), F.lit(False))).otherwise(said)

    known = lambda f: F.filter(F.col(f"reviews.{f}"), lambda x: x.isNotNull())
    mean = lambda c: F.when(F.size(c) > 0, F.round(F.aggregate(c.cast("array<double>"), F.lit(0.0), lambda a, x: a + x) / F.size(c), 4))
    raw, norm = known("score_raw"), known("score_normalized")
    filename = F.element_at(F.split(F.rtrim("url", F.lit("/")), "/"), -1)
    d = d.withColumn("linked", _under(b, "link-id", "link-to-paper"))
    out = d.select(
        "paper_id", title.alias("title"), abstract.alias("abstract"), "url", "year", authors.alias("authors"),
        *[c.alias(n) for n, c in _links(F.col("linked"), new).items()], code.alias("code_url"), data.alias("dataset_urls"), code.isNotNull().alias("has_code"), early.alias("early_accepted"),
        feedback.isNotNull().alias("rebuttal_provided"), F.nullif(F.regexp_extract(bib, r"(?i)volume\s*=\s*\{?\s*([^},\n]+)", 1), F.lit("")).alias("lncs_volume"),
        F.nullif(F.trim(F.regexp_extract(bib, r"@\w+\{([^,\n]+)", 1)), F.lit("")).alias("bibtex_key"), bib.alias("bibtex_raw"),
        F.size("reviews").alias("num_reviews"), (F.array_max(raw) - F.array_min(raw)).alias("score_range"), mean(raw).alias("avg_score_raw"), mean(norm).alias("avg_score_normalized"),
        feedback.alias("author_feedback_text"), "reviews", "meta_reviews", F.when(F.col("html").isNull(), "no page").alias("error"),
    )
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    first = out.columns[:6]
    rest = out.columns[6:]
    if areas is None:
        return out.select(*first, none.alias("subject_areas"), *rest)
    # Records are joined, not pages or their blocks, which are several times as large.
    out = out.withColumn("_file", filename).join(areas.select(F.col("filename").alias("_file"), F.col("areas").alias("_areas")), "_file", "left")
    return out.select(*first, F.coalesce("_areas", none).alias("subject_areas"), *rest)


def parse_index(pages: DataFrame, dated: bool = False, *, venue: str) -> DataFrame:
    """year, paper_id, filename, paper_url, ord of index pages (year, base_url, html).

    The first link to a file wins; the order is that of the page.  Dated paths
    (``Y/M/D/...``) stay in the url.
    """
    pattern = r"(\d{4}/\d{2}/\d{2}/\d{3,4}-Paper\d{4}\.html)" if dated else r"(\d{3,4}-Paper\d{4}\.html)"
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    d = pages.select("year", "base_url", F.posexplode(hrefs).alias("ord", "href")).withColumn("path", F.regexp_extract("href", pattern, 1)).where("path <> ''")
    d = d.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("year", "filename").orderBy("ord"))).where("_r = 1")
    number = F.regexp_extract("filename", r"Paper(\d{4})", 1)
    return d.select("year", F.concat_ws("-", F.lit(venue), F.col("year").cast("string"), F.concat(F.lit("Paper"), number)).alias("paper_id"), "filename", F.concat(F.rtrim("base_url", F.lit("/")), F.lit("/"), F.col("path")).alias("paper_url"), "ord")


def parse_categories(pages: DataFrame) -> DataFrame:
    """filename, areas (in page order) of category pages."""
    ship(pages.sparkSession)
    d = pages.select(F.posexplode(categories("html")).alias("ord", "c")).select("ord", "c.filename", "c.area")
    return d.groupBy("filename").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "area"))), lambda x: x["area"]).alias("areas"))


def audit_fields(pages: DataFrame, years: DataFrame) -> DataFrame:
    """kind, detail, n_papers, n of questions that parsing loses or mixes up.

    DROPPED: no rule takes the label.  OVERWRITTEN: two answers of one review
    go to a field that keeps one.  SPLIT: the fields of a review stand in more
    than one list.  LOOSE: a quotation stands between them, outside any list.
    """
    ship(pages.sparkSession)
    cfg = years.select("year", "era", "score_field_substring", "extra_review_fields")
    d = pages.join(F.broadcast(cfg), "year", "left").withColumn("p", page_blocks("html"))
    new = F.coalesce(F.col("era") == NEW_ERA, F.lit(True))
    d = d.select("paper_id", "score_field_substring", "extra_review_fields", new.alias("new"), F.explode("p.blocks").alias("b")).where(F.col("b.head_id").rlike(r"^review-\d+$"))
    field = F.col("b.kind") == "field"
    d = d.select("paper_id", F.struct("b.no", "b.head_id", "b.kind", F.when(field, F.col("b.label")).alias("label")).alias("b"), F.when(field, route(F.lower("b.label"), F.col("score_field_substring"), F.col("new"), F.col("extra_review_fields"))).alias("route"))
    # Each fault is looked for in the same rows, so the pages are parsed once; answers aren't among the columns.
    d = materialize(d)
    review = ["paper_id", "b.head_id"]
    dropped = d.where((F.col("b.kind") == "field") & F.col("route").isNull()).select("paper_id", F.lit("DROPPED").alias("kind"), F.col("b.label").alias("detail"))
    twice = d.where(F.col("route").isNotNull() & ~F.col("route").isin(*APPEND)).groupBy(*review, "route").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("paper_id", F.lit("OVERWRITTEN").alias("kind"), F.col("route").alias("detail"))
    w = Window.partitionBy("paper_id", "b.head_id").orderBy("b.no")
    gaps = d.withColumn("prev", F.lag(F.col("b.kind")).over(w))
    split = gaps.where((F.col("b.kind") == "field") & F.col("prev").isNotNull() & (F.col("prev") != "field")).select("paper_id", F.lit("SPLIT").alias("kind"), F.col("b.head_id").alias("detail"))
    loose = d.where(F.col("b.kind") == "blockquote").select("paper_id", F.lit("LOOSE").alias("kind"), F.col("b.head_id").alias("detail"))
    faults = dropped.unionByName(twice).unionByName(split).unionByName(loose)
    return faults.groupBy("kind", "detail").agg(F.countDistinct("paper_id").alias("n_papers"), F.count(F.lit(1)).alias("n"))
