"""Page parsing of all eras against the statements that say what stands on the pages."""

import inspect
import re

import pandas as pd
import pytest
from helpers import same_rows

from quire.functions import html
from quire.operators import pages
from quire.plans.catalog import ORACLE_SQL, QUERIES
from quire.sources import readers


@pytest.mark.parametrize("name", ["page_papers", "page_reviews", "page_meta_reviews", "page_audit", "page_index", "page_index_dated", "page_categories"])
def test_oracle(spark, sf, name):
    same_rows(spark, QUERIES[name], ORACLE_SQL[name], sf)


def test_extra_fields_come_from_the_configuration(spark):
    """A question that only the year's configuration names; the first label that fits; not in the newest era."""
    extra = [{"label_substring": "STACK rank", "store_as": "review_stack_rank"}, {"label_substring": "stack", "store_as": "review_stack_size", "parse_mode": "x"}]
    base = {"score_field_substring": "overall", "score_parse_mode": "parens", "years": {2021: {"era": "2021", "extra_review_fields": extra}, 2022: {"era": "2022_2023"}, 2024: {"era": "2024_2025", "extra_review_fields": extra}}}
    html = '<h1 id="review-id">R</h1><h3 id="review-1">R</h3><ul><li><strong>Your Stack Rank</strong><blockquote>3</blockquote></li><li><strong>The stack</strong><blockquote> 7 </blockquote></li></ul>'
    rows = [(str(y), "u/x.html", y, html) for y in (2021, 2022, 2024)]
    d = pages.parse_papers(spark.createDataFrame(rows, "paper_id string, url string, year int, html string"), readers.year_config(spark, base))
    got = {r.year: (r.reviews[0].review_stack_rank, r.reviews[0].review_stack_size) for r in d.collect()}
    assert got == {2021: (3, 7), 2022: (None, None), 2024: (None, None)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["page_papers", "page_reviews", "page_meta_reviews"])
def test_pages_are_parsed_once_and_stay_where_they_are(spark, sf, name):
    """No second call for a derived filter, and no shuffle by year, of which there are five."""
    plan = _plan(QUERIES[name](spark, sf))
    assert plan.count("ArrowEvalPython [page_blocks") == 1
    assert "hashpartitioning(year" not in plan


def test_audit_parses_pages_once(spark, sf, monkeypatch):
    """The faults are looked for in a table without the answers' texts."""
    plans = []
    kept = pages.materialize
    monkeypatch.setattr(pages, "materialize", lambda df: plans.append(df) or kept(df))
    assert "page_blocks" not in _plan(QUERIES["page_audit"](spark, sf))
    assert _plan(plans[0]).count("ArrowEvalPython [page_blocks") == 1 and "hashpartitioning(year" not in _plan(plans[0])
    assert plans[0].schema["b"].dataType.names == ["no", "head_id", "kind", "label"]


def test_blocks_go_back_in_pieces(monkeypatch):
    """Memory of a batch doesn't grow with the number of pages in it."""
    monkeypatch.setattr(html, "PIECE", 100)
    seen = pd.Series(["<h1 id='a'>x</h1><p>" + "y" * 60 + "</p>", None] * 5)
    parts = list(inspect.unwrap(html.page_blocks)(iter([seen, seen[:0]])))
    assert len(parts) > 2
    assert pd.concat(parts).to_dict("records") == [html.parse_page(x) for x in seen]


@pytest.mark.parametrize("text", ["<a href='q=\"r' b=\"x''y=z\">t</a>", "<p a=\" b=\" c>t", "<a href=\"?a=b&amp;c\">t</a>", "<script><p>x</p></script><p x=1>t</P >", "<DIV Class='X'>t<br/><li a='1' b=\"2\">u"])
def test_plain_tags_are_read_like_all_others(monkeypatch, text):
    got = html.parse_page(text)
    never = re.compile("(?!)")
    monkeypatch.setattr(html, "PLAIN_START", never)
    monkeypatch.setattr(html, "PLAIN_END", never)
    assert html.parse_page(text) == got
