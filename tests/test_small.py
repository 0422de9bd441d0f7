"""Small operators with known answers: spans of years, complete areas, unions, ends, settings, formats, confidence, page report."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import metrics, ranking
from quire.sources import readers


@pytest.mark.parametrize(("years", "span"), [([2021, 2022, 2023, 2024], ""), ([2022], "2022"), ([2021, 2022, 2023], "2021-2023"), ([2021, 2023], "2021, 2023")])
def test_year_span(spark, years, span):
    d = spark.createDataFrame([(years, [2021, 2022, 2023, 2024])], "y array<int>, a array<int>")
    assert d.select(metrics.year_span(F.col("y"), F.col("a")).alias("s")).first().s == span


def test_complete_areas(spark):
    rows = [(y, a, 0.1, 2 if a != "part" else 1, t) for a, t in (("b", 9), ("a", 9), ("c", 20), ("d", 1)) for y in (1, 2)] + [(1, "part", 0.1, 1, 99)]
    d = spark.createDataFrame(rows, "year int, area string, share double, presence int, total int")
    assert {(r.year, r.area) for r in metrics.complete_areas(d, 2, 2).collect()} == {(1, "c"), (2, "c"), (1, "a"), (2, "a")}


def test_union_of_years(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, t string"), spark.createDataFrame([(2.5, 2)], "score double, id int")
    assert sorted((r.id, r.t, r.score) for r in readers.union_years(a, b).collect()) == [(1, "x", None), (2, None, 2.5)]


def test_ends(spark):
    d = spark.createDataFrame([(i, i % 5) for i in range(20)], "k int, v int")
    got = [(r.k, r.end) for r in ranking.both_ends(d, 3, "v", "k").collect()]
    assert got == [(0, "low"), (5, "low"), (10, "low"), (19, "high"), (14, "high"), (9, "high")]
    assert sorted(r.k for r in ranking.half_and_half(d, 6, "v", "k").collect()) == [0, 5, 9, 10, 14, 19]
    assert ranking.half_and_half(d, 20, "v", "k").count() == 20 and ranking.half_and_half(d.where("false"), 4, "v", "k").count() == 0


def test_settings_and_formats(spark):
    assert readers.chart_settings({"a": "y", "b": "odd", "c": 1}, {"a": ("x", "y"), "b": ("p", "q"), "d": (3,)}) == {"a": "y", "b": "p", "d": 3}
    d = spark.createDataFrame([("one", None, "two", 1234567), (None, None, None, 12)], "a string, b string, c string, n long")
    got = d.select(text.append_block(F.col("a"), F.col("b"), F.col("c")).alias("t"), text.thousands(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("one\n\ntwo", "1,234,567"), (None, "12")]


def papers(spark):
    review = lambda s, label=None: (s, 6, label)
    rows = []
    for year in (2022, 2023):
        for i in range(12):
            kind = ("oral", "poster", "spotlight" if year == 2023 else "poster")[i % 3]
            score = float(1 + (i % 3 == 0) * 3 + i % 2)
            rows.append((f"{year}-{i}", year, kind, i % 4 == 0, score, [review(score, "Very confident"), review(score + i % 3, " somewhat  Confident"), review(None, "other"), review(9.0 if i == 5 else 0.0)]))
    rows += [("x", 2021, None, None, None, None), ("y", 2021, "poster", None, 3.0, [review(3.0)])]
    return spark.createDataFrame(rows, "paper_id string, year int, presentation_type string, early_accepted boolean, avg_score_raw double, reviews array<struct<score_raw:double,score_max:int,confidence_label:string>>")


def test_page_report_with_bounds(spark):
    p = papers(spark)
    talks = p.where("presentation_type IN ('oral', 'spotlight')").select("year", F.when(F.col("paper_id") != "2023-0", F.col("paper_id")).alias("paper_id"), F.col("presentation_type").alias("type"), F.when(F.col("paper_id") == "2023-0", "unmatched").otherwise("exact").alias("match"))
    report = metrics.page_report(p, talks)
    got = {r.year: r for r in report.collect()}
    assert sorted(got) == [2022, 2023] and (got[2023].n_oral, got[2023].n_spotlight, got[2023].n_selected) == (4, 4, 8)
    assert got[2022].delta == 1.0 and got[2022].low == got[2022].high == 1.0 and got[2022].magnitude == "large"
    assert got[2022].match_rate == 100 and got[2023].match_rate == 87.5 and got[2022].early_oral == 25.0
    total = metrics.page_totals(report).first()
    assert (total.years, total.total_papers, total.total_selected, total.spotlight_years, total.all_matched) == ([2022, 2023], 24, 12, [2023], False)
    assert (total.delta_min_year, total.delta_max_year, total.pct_selected) == (2022, 2022, 50.0)
    none = metrics.page_totals(metrics.page_report(p.where("false"), talks.where("false"), n_boot=0)).first()
    assert none.years == [] and none.total_papers is None and none.delta_min_year is None and none.all_matched


def test_scores_and_confidence(spark):
    p = papers(spark)
    d = {(r.year, r.score): (r.n, r.n_early) for r in metrics.score_distribution(p).collect()}
    # 0 and 9 lie off the scale of 1 to 6; scores that nobody gave are there with 0.
    assert sorted(d) == [(y, s) for y in (2021, 2022, 2023) for s in range(1, 7)] and d[2021, 3] == (1, 0) and d[2021, 4] == (0, 0)
    assert sum(n for (y, _), (n, _) in d.items() if y == 2022) == 24 and sum(e for (y, _), (_, e) in d.items() if y == 2022) == 6
    h = metrics.average_histograms(p).orderBy("year", "bin").collect()
    assert [(r.left, r.right, r.n) for r in h if r.year == 2021 and r.n] == [(3.0, 3.1, 1)] and [len([r for r in h if r.year == y]) for y in (2021, 2022)] == [10, 10]
    assert sum(r.n for r in h if r.year == 2022) == 12 and [r for r in h if r.year == 2022][-1].right == 5.0
    c = {r.paper_id: (r.n, r.confidence) for r in metrics.mean_confidence(p).collect()}
    assert c["2022-0"] == (2, 3.0) and c["x"] == (0, None) and c["y"] == (0, None)
    g = {(r.year, r.score_range): r.n for r in metrics.disagreement(p).collect()}
    assert g[2021, 0] == 1 and sum(n for (y, _), n in g.items() if y == 2022) == 9
