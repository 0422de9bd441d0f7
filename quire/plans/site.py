"""Page parsing on pages made from the documents: a paper page each, of five years and three eras, index and category pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import pages
from quire.plans.registry import Tables, query
from quire.schemas import YEARS

RANK, STACK = ("ranking of this paper in your review stack", "review_stack_rank"), ("number of papers in your stack", "review_stack_size")
_YEARS = [
    (2021, "2021", "your overall opinion", "parens", False, 10, 2, 20, None, None, [RANK, STACK]),
    (2022, "2022_2023", "scale of 1-8", "bare_integer", True, 8, 2, 20, None, None, [RANK]),
    (2023, "2022_2023", "scale of 1-8", "bare_integer", False, 8, 2, 20, None, None, []),
    (2024, "2024_2025", "scale of 1-6", "parens", False, 6, 2, 20, None, None, []),
    (2025, "2024_2025", "scale of 1-6", "parens", False, 6, 2, 20, None, None, [RANK]),
]

#: What stands on the page of document k; a year's scale, its reviews' numbers, and each review's score s.
_PAPERS = """
WITH d AS (SELECT doc_id AS k, (2021 + doc_id % 5)::INT AS year, coalesce(lang, 'xx') AS lang, 'Comments ' || array_to_string(regexp_extract_all(coalesce(text, ''), '[a-z]{2,}'), ' ') AS w FROM documents),
p AS (
  SELECT *, 'p' || k AS paper_id, year >= 2024 AS new_era, CASE year WHEN 2021 THEN 10 WHEN 2022 THEN 8 WHEN 2023 THEN 8 ELSE 6 END AS top,
         CASE k % 3 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [1, 3] ELSE [2, 10] END AS numbers FROM d),
r AS (SELECT *, unnest(numbers) AS n FROM p),
s AS (SELECT *, ((k + n) % 6 + 1)::INT AS s FROM r)
"""


def years(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(_YEARS, YEARS)


def _html(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _item(label: str | Column, body: Column | str) -> Column:
    return _html("<li><strong>", label, "</strong><blockquote>", body, "</blockquote></li>")


def paper_pages(t: Tables) -> DataFrame:
    """paper_id, url, year, html; a page is dear to parse, so the documents are dealt out evenly, however their files are cut."""
    k, year = F.col("k"), F.col("year")
    new = year >= 2024
    words = F.concat(F.lit("Comments "), F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{2,}"), F.lit(0)), " "))
    documents = t.documents.select("doc_id", "lang", "text").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    d = documents.select(F.col("doc_id").alias("k"), (F.col("doc_id") % 5 + 2021).cast("int").alias("year"), F.coalesce("lang", F.lit("xx")).alias("lang"), words.alias("w"))

    name = _html("Title ", k, " in ", F.col("lang"))
    title = (
        F.when(k % 4 == 0, _html('<div class="x post-title"><h1 class="a"><b>', name, "</b> aside</h1></div>")).when(k % 4 == 1, _html('<div class="post-title"><h2>', name, "</h2></div>"))
        .when(k % 4 == 2, _html("<h1> </h1><h1>", name, "</h1>")).otherwise("")
    )
    tags = _html('<div class="post-tags"><a class="post-category" href="/tags#a">Doe, Ann</a><a href="/y">no</a><a class="post-category" href="/categories#x">Area</a><a class="big post-category" href="/tags#b">Roe, ', F.col("lang"), "</a></div>")
    named = '<h2 id="author-id">Authors</h2><p><a href="/x/tags#q">Poe, Bo</a></p><p><a href="/other">Nobody</a></p>'
    links = _html(
        F.when(k % 2 == 0, '<h1 id="link-id">Links</h1>').otherwise('<h1 id="link-to-paper">Links</h1>'), '<p>Main Paper (Open Access): <a href="https://x/old.pdf">x</a></p><p>Main paper: <a href="https://x/', k, '.pdf">x</a></p>',
        '<p>SharedIt Link: <a href="https://rdcu.be/', k, '">x</a></p><p>SpringerLink (DOI): <a href="https://doi.org/10.1/', k, '">x</a></p>', F.when(k % 3 == 0, "<p>Supplementary Material: Not Submitted <a href='/none'>x</a></p>").otherwise("<p>Supplementary Material: <a href='/s.zip'>x</a></p>"),
    )
    rest = _html(
        '<h1 id="abstract-id">Abstract</h1><p> ', F.col("w"), ' \\url{http://x} about $x^2$ maths</p><h2 id="code-id">Code</h2><p><a href="', F.when(k % 3 == 0, " n/a ").otherwise(_html("https://code/", k)), '">c</a></p><h2 id="dataset-id">Data</h2><p><a href="d1">1</a>, <a href="d2">2</a></p>',
        '<h2 id="bibtex-id">Bib</h2><pre><code>@InProceedings{ Key', k, ',\n author = {x},\n Volume = {LNCS 150', k % 10, "},\n}</code></pre>",
    )
    feedback = F.when(k % 3 == 0, '<h1 id="authorFeedback-id">F</h1><blockquote> n/a </blockquote>').when(k % 3 == 1, _html('<h1 id="author-feedback">F</h1><blockquote><p>We thank ', F.col("lang"), "</p><p>all</p></blockquote>")).otherwise("")

    def review(n: int) -> Column:
        s = (k + n) % 6 + 1
        score = F.when(new, _html("(", s, ") Weak Accept — could be")).when(year == 2021, _html("probably accept (", s, ")")).otherwise(s.cast("string"))
        asked = F.when(new, "Rate the paper on a scale of 1-6").when(year == 2021, "Please state your OVERALL opinion of the paper").otherwise("Rate the paper on a scale of 1-8, 8 being best")
        post = F.when(F.lit(n % 2 == 0), " N/A ").when(new, "(6) Strong Accept — yes").when(year == 2021, "Accept").otherwise("5")
        return _html(
            f'<h3 id="review-{n}">Review #{n}</h3><ul>', _item("Please describe the contribution", f"<p>good {n}</p><p>work</p>"), _item("Main strengths", F.col("lang")), _item("Major WEAKNESSES", "<p> </p>"),
            _item("Please rate the clarity", "Very <i>Good</i>"), _item("Code of Ethics and reproducibility", f"r{n}"), _item("Additional comments", F.col("w")), _item(asked, score),
            "<li><strong>No answer</strong></li></ul><blockquote>loose</blockquote><ul>", _item("Please justify your recommendation", f"because {n}"), _item("Reviewer confidence", "Very confident (4)"),
            _item("[Post rebuttal] your FINAL opinion", post), _item("[Post rebuttal] Please justify your final decision", f"final {n}"), _item("What is the ranking of this paper in your review stack?", " 2 "), _item("Number of papers in your stack", "5"), "</ul>",
        )

    reviews = F.when(k % 3 == 0, _html(review(1), review(2), review(3))).when(k % 3 == 1, _html(review(3), review(1))).otherwise(_html(review(10), review(2)))
    said = F.when((year == 2024) & (k % 7 == 0), "<p>This paper was Early Accepted.</p>").otherwise("")

    def meta(n: int, final: bool) -> Column:
        return _html(
            f'<h2 id="meta-review-{n}">M</h2><ul>', _item("Your recommendation", F.when(k % 2 == 0, "Invite").otherwise("Provisional Accept")), _item("Please justify your recommendation", f"since {n}"), _item("What is the rank of the paper?", "3"), _item("Remarks", " n/a "),
            _item("After you have reviewed the rebuttal, say more", _html("Accept ", k)) if final else "", "</ul>",
        )

    alone = _html("<ul>", _item("Please provide your assessment", _html("fine ", k)), _item("Rank", "1"), _item("More", "N/A"), _item("Else", "also"), "</ul>")
    metas = F.when((k % 11 == 0) & ~new, alone).when(k % 2 == 0, _html(meta(1, True), meta(2, False), meta(4, True))).otherwise(meta(1, False))
    after = F.when(k % 2 == 0, '<h2 id="postrebuttal-id">P</h2>').otherwise("")
    html = _html(
        "<html><head><title>", name, " - MICCAI 2021 - Accepted</title></head><body>", title, F.when(k % 6 == 5, named).otherwise(tags), links, rest, '<h1 id="review-id">Reviews</h1>', reviews, feedback,
        '<h1 id="metareview-id">Meta</h1>', said, metas, after, "</body></html>",
    )
    return d.select(F.concat(F.lit("p"), k.cast("string")).alias("paper_id"), F.concat(F.lit("https://x/papers/"), k.cast("string"), F.lit("-Paper.html/")).alias("url"), "year", html.alias("html"))


def parsed(t: Tables) -> DataFrame:
    areas = t.documents.where("doc_id % 4 = 0").select(F.concat(F.col("doc_id").cast("string"), F.lit("-Paper.html")).alias("filename"), F.array(F.lit("X -> CT"), F.coalesce("lang", F.lit("xx"))).alias("areas"))
    return pages.parse_papers(paper_pages(t), years(t), areas)


@query(_PAPERS + """,
score AS (SELECT k, round(avg(s), 4) AS avg_raw, round(avg((s - 1) / (top - 1)), 4) AS avg_norm, (max(s) - min(s))::INT AS score_range FROM s GROUP BY k)
SELECT paper_id, year, CASE WHEN new_era AND k % 4 >= 2 THEN NULL ELSE 'Title ' || k || ' in ' || lang END AS title,
       CASE WHEN k % 6 <> 5 THEN 'Doe, Ann; Roe, ' || lang WHEN new_era THEN '' ELSE 'Poe, Bo' END AS authors, w || '  about  maths' AS abstract,
       CASE WHEN k % 4 = 0 THEN 'X -> CT; ' || lang ELSE '' END AS areas,
       'https://x/' || k || '.pdf' AS pdf_url, 'https://rdcu.be/' || k AS shared_it_url, 'https://doi.org/10.1/' || k AS doi, CASE WHEN k % 3 <> 0 THEN '/s.zip' END AS supp_url,
       CASE WHEN k % 3 <> 0 THEN 'https://code/' || k END AS code_url, k % 3 <> 0 AS has_code, 'd1 d2' AS data, CASE WHEN new_era THEN 'Key' || k END AS bibtex_key, CASE WHEN new_era THEN 'LNCS 150' || k % 10 END AS lncs_volume,
       len(numbers)::INT AS num_reviews, score_range, avg_raw, avg_norm, CASE WHEN k % 3 = 1 THEN 'We thank ' || lang || chr(10) || 'all' END AS feedback, k % 3 = 1 AS rebuttal_provided,
       CASE WHEN year = 2025 THEN k % 2 = 1 WHEN year = 2024 THEN k % 7 = 0 ELSE k % 2 = 1 END AS early_accepted
FROM p JOIN score USING (k)
""")
def page_papers(t: Tables) -> DataFrame:
    """Paper records of pages of all eras."""
    return parsed(t).select(
        "paper_id", "year", "title", F.array_join("authors", "; ").alias("authors"), "abstract", F.array_join("subject_areas", "; ").alias("areas"), "pdf_url", "shared_it_url", "doi", "supp_url", "code_url", "has_code",
        F.array_join("dataset_urls", " ").alias("data"), "bibtex_key", "lncs_volume", "num_reviews", "score_range", F.col("avg_score_raw").alias("avg_raw"), F.col("avg_score_normalized").alias("avg_norm"),
        F.col("author_feedback_text").alias("feedback"), "rebuttal_provided", "early_accepted",
    )


@query(_PAPERS + """
SELECT paper_id, n AS reviewer_num, s AS score_raw, top AS score_max, (s - 1) / (top - 1) AS score_normalized,
       CASE WHEN new_era THEN 'Weak Accept — could be' WHEN year = 2021 THEN 'probably accept (' || s || ')' ELSE s::VARCHAR END AS recommendation_label,
       CASE WHEN n % 2 = 0 THEN 'N/A' WHEN new_era THEN 'Strong Accept — yes' WHEN year = 2021 THEN 'Accept' ELSE '5' END AS post_rebuttal_label,
       CASE WHEN year = 2022 AND n % 2 = 1 THEN 5 ELSE -1 END AS post_rebuttal_score_raw, n % 2 = 1 AND (year NOT IN (2022, 2023) OR s <> 5) AS score_changed,
       4 AS confidence_raw, 'Very confident' AS confidence_label, 'Very Good' AS clarity_label, 'good ' || n || chr(10) || 'work' AS text_contribution, lang AS text_strengths, NULL::VARCHAR AS text_weaknesses,
       trim(w) || chr(10) || chr(10) || 'because ' || n AS text_detailed_comments, CASE WHEN NOT new_era THEN 'r' || n END AS text_reproducibility, CASE WHEN new_era THEN 'r' || n END AS text_ethics,
       'final ' || n AS text_post_rebuttal_justification, CASE WHEN year IN (2021, 2022) THEN 2 ELSE -1 END AS review_stack_rank, CASE WHEN year = 2021 THEN 5 ELSE -1 END AS review_stack_size
FROM s
""")
def page_reviews(t: Tables) -> DataFrame:
    """Reviews of those pages, their questions routed to fields."""
    return pages.parse_papers(paper_pages(t), years(t)).select("paper_id", F.inline("reviews")).fillna(-1, ["post_rebuttal_score_raw", "review_stack_rank", "review_stack_size"])


@query(_PAPERS + """,
m AS (
  SELECT *, unnest(CASE WHEN year = 2024 AND k % 7 = 0 THEN [] WHEN NOT new_era AND k % 11 = 0 THEN [0] WHEN k % 2 = 1 THEN [1] WHEN new_era THEN [1, 2] ELSE [1, 2, 4] END) AS i FROM p),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i)::INT AS meta_reviewer_num FROM m)
SELECT paper_id, meta_reviewer_num, CASE WHEN i = 0 THEN NULL WHEN k % 2 = 0 AND i <> 2 THEN 'Accept ' || k WHEN NOT new_era THEN NULL WHEN k % 2 = 0 THEN 'Invite' ELSE 'Provisional Accept' END AS recommendation,
       CASE WHEN i = 0 THEN 'fine ' || k || chr(10) || chr(10) || 'also' WHEN new_era THEN 'since ' || i || chr(10) || chr(10) || '3'
            ELSE CASE WHEN k % 2 = 0 THEN 'Invite' ELSE 'Provisional Accept' END || chr(10) || chr(10) || 'since ' || i END AS text
FROM numbered
""")
def page_meta_reviews(t: Tables) -> DataFrame:
    """Meta-reviews of those pages: numbered without a gap, all headings, or a bare list, by era."""
    return pages.parse_papers(paper_pages(t), years(t)).select("paper_id", F.inline("meta_reviews"))


@query(_PAPERS + """,
faults AS (
  SELECT paper_id, 'DROPPED' AS kind, unnest(CASE WHEN new_era OR year = 2023 THEN ['What is the ranking of this paper in your review stack?', 'Number of papers in your stack']
         WHEN year = 2022 THEN ['Number of papers in your stack'] ELSE []::VARCHAR[] END) AS detail FROM s
  UNION ALL SELECT paper_id, unnest(['SPLIT', 'LOOSE']), 'review-' || n FROM s)
SELECT kind, detail, count(DISTINCT paper_id) AS n_papers, count(*) AS n FROM faults GROUP BY ALL
""")
def page_audit(t: Tables) -> DataFrame:
    """Questions of those pages that parsing loses, and lists that are broken."""
    return pages.audit_fields(paper_pages(t), years(t))


_INDEX = """
WITH d AS (SELECT doc_id // 50 AS page, doc_id % 50 AS i, doc_id FROM documents),
named AS (SELECT *, lpad((doc_id % 977)::VARCHAR, 4, '0') AS number FROM d)
"""


def index_pages(t: Tables, dated: bool) -> DataFrame:
    """Index pages of fifty documents each: a link a document, those of ids that end in 7 given again, and links to other things."""
    d = t.documents.select(F.floor(F.col("doc_id") / 50).cast("int").alias("year"), (F.col("doc_id") % 50).alias("i"), F.lpad((F.col("doc_id") % 977).cast("string"), 4, "0").alias("number"), "doc_id")
    path = F.concat(F.lit("2021/09/01/") if dated else F.lit(""), F.lpad((F.col("i") + 1).cast("string"), 3, "0"), F.lit("-Paper"), F.col("number"), F.lit(".html"))
    link = _html("<li><A class='x' HREF='/base/", path, "'>t</a> <a href='/about.html'>x</a></li>", F.when(F.col("i") % 10 == 7, _html('<a href="', path, '">again</a>')).otherwise(""))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", link.alias("l")))), lambda x: x["l"]), "")
    return d.groupBy("year").agg(_html("<html><ul>", one, "</ul></html>").alias("html")).withColumn("base_url", F.lit("https://x/papers/"))


@query(_INDEX + """
SELECT page::INT AS year, 'conf-' || page || '-Paper' || number AS paper_id, lpad((i + 1)::VARCHAR, 3, '0') || '-Paper' || number || '.html' AS filename,
       'https://x/papers/' || lpad((i + 1)::VARCHAR, 3, '0') || '-Paper' || number || '.html' AS paper_url FROM named
""")
def page_index(t: Tables) -> DataFrame:
    """Papers of index pages; the first link to a file wins."""
    return pages.parse_index(index_pages(t, False), venue="conf").drop("ord")


@query(_INDEX + """
SELECT page::INT AS year, 'conf-' || page || '-Paper' || number AS paper_id, lpad((i + 1)::VARCHAR, 3, '0') || '-Paper' || number || '.html' AS filename,
       'https://x/papers/2021/09/01/' || lpad((i + 1)::VARCHAR, 3, '0') || '-Paper' || number || '.html' AS paper_url FROM named
""")
def page_index_dated(t: Tables) -> DataFrame:
    """The same with dated paths, which stay in the url."""
    return pages.parse_index(index_pages(t, True), dated=True, venue="conf").drop("ord")


@query("""
WITH d AS (SELECT doc_id, doc_id // 50 AS page, doc_id % 50 AS i, 'A' || doc_id % 3 AS first_area, 'B' || doc_id % 5 AS second_area FROM documents)
SELECT doc_id || '.html' AS filename, first_area || '; ' || second_area AS areas FROM d
""")
def page_categories(t: Tables) -> DataFrame:
    """Areas of papers from category pages, in page order."""
    d = t.documents.select("doc_id", F.explode(F.array(F.concat(F.lit("A"), (F.col("doc_id") % 3).cast("string")), F.concat(F.lit("B"), (F.col("doc_id") % 5).cast("string")))).alias("area"))
    d = d.groupBy(F.floor(F.col("doc_id") / 50).alias("page"), "area").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: _html('<div><p><a href="/papers/', x, '.html/">t</a><a href="/z.html">u</a></p></div>')), "").alias("links"))
    section = _html('<h3 id=" ', F.col("area"), ' ">x</h3><p><a href="/no.html">n</a></p><div><a href="/no.pdf">n</a></div>', F.col("links"))
    html = d.groupBy("page").agg(_html("<div><a href='/early.html'>e</a></div>", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("area", section.alias("s")))), lambda x: x["s"]), "")).alias("html"))
    return pages.parse_categories(html).select("filename", F.array_join("areas", "; ").alias("areas"))
