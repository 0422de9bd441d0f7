"""Papers from pages to metrics, ranks, browsing, exports and ingestion."""

import collections
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import browse, clustering, graph, layout, metrics, pages, ranking
from quire.operators.browse import BrowseQuery
from quire.schemas import LINES, PAPERS, WORDS, YEARS
from quire.sources import pages as page_source
from quire.sources import readers, writers
from quire.streaming import incremental


@pytest.fixture(scope="module")
def years(spark):
    return spark.createDataFrame([(2025, "2024_2025", "scale of 1-6", "parens", False, 6, 2, 20, 4, "A", []), (2022, "2022_2023", "overall score", "bare_integer", True, 8, 2, 20, None, None, [])], YEARS)


def review(n, score, post="N/A"):
    return (
        f'<h3 id="review-{n}">R</h3><ul><li><strong>Please describe the contribution</strong><blockquote><p>good</p><p>work</p></blockquote></li>'
        f"<li><strong>Rate the paper on a scale of 1-6</strong><blockquote>({score}) Weak Accept — could be</blockquote></li>"
        "<li><strong>Additional comments on reproducibility</strong><blockquote>r1</blockquote></li><li><strong>Additional comments</strong><blockquote>c1</blockquote></li>"
        f"</ul><blockquote>loose</blockquote><ul><li><strong>Please justify your recommendation</strong><blockquote>c2</blockquote></li><li><strong>[Post rebuttal] final opinion</strong><blockquote>{post}</blockquote></li></ul>"
    )


def page(reviews="", feedback=None, meta=""):
    fb = "" if feedback is None else f'<h1 id="authorFeedback-id">F</h1><blockquote>{feedback}</blockquote>'
    return f'<html><body><div class="post-title"><h1><b>T</b></h1></div><h1 id="review-id">Reviews</h1>{reviews}{fb}<h1 id="metareview-id">M</h1>{meta}</body></html>'


def parse(spark, years, html, year=2025):
    return pages.parse_papers(spark.createDataFrame([("p", "http://x/1-Paper0001.html", year, html)], "paper_id string, url string, year int, html string"), years).first()


@pytest.mark.parametrize("year", [2025, 2022])
@pytest.mark.parametrize(("feedback", "given"), [("<p>N/A</p>", False), ("<p>n/a</p>", False), ("  N/A ", False), ("", False), (None, False), ("<p>We thank</p><p>all</p>", True)])
def test_feedback(spark, years, year, feedback, given):
    r = parse(spark, years, page(feedback=feedback), year)
    assert r.rebuttal_provided is given and r.author_feedback_text == ("We thank\nall" if given else None)


@pytest.mark.parametrize("numbers", [[1, 2, 3], [3, 4, 5], [1, 2, 4], [4, 1, 3]])
def test_review_numbers(spark, years, numbers):
    r = parse(spark, years, page("".join(review(n, n + 1 if n < 5 else 6) for n in numbers)))
    assert [x.reviewer_num for x in r.reviews] == sorted(numbers) and r.num_reviews == len(numbers) and not r.early_accepted


def test_review_fields(spark, years):
    r = parse(spark, years, page(review(1, 4, "Accept") + review(2, 5) + review(3, 3)))
    x = r.reviews[0]
    assert (r.avg_score_raw, r.score_range, x.score_normalized) == (4.0, 2, pytest.approx(0.6))
    assert (x.text_contribution, x.text_reproducibility, x.text_detailed_comments) == ("good\nwork", "r1", "c1\n\nc2")
    assert x.score_changed and not r.reviews[1].score_changed
    none = parse(spark, years, page())
    assert none.num_reviews == 0 and none.early_accepted is False


def test_audit(spark, years):
    html = page(review(1, 4).replace("Additional comments on reproducibility", "Please describe the contribution").replace("final opinion", "mood"))
    df = spark.createDataFrame([("p", 2025, html)], "paper_id string, year int, html string")
    assert {r.kind for r in pages.audit_fields(df, years).collect()} == {"DROPPED", "OVERWRITTEN", "SPLIT", "LOOSE"}


def test_index_and_categories(spark):
    html = '<a href="/p/0012-Paper0007.html">x</a><a href="0012-Paper0007.html">again</a><a href="x.html">no</a><a href="0002-Paper0003.html">y</a>'
    got = pages.parse_index(spark.createDataFrame([(2024, "http://b/", html)], "year int, base_url string, html string"), venue="miccai").orderBy("ord").collect()
    assert [(r.paper_id, r.paper_url) for r in got] == [("miccai-2024-Paper0007", "http://b/0012-Paper0007.html"), ("miccai-2024-Paper0003", "http://b/0002-Paper0003.html")]
    cats = '<h3 id="B">b</h3><div><a href="/1.html">1</a></div><h3 id="A">a</h3><div><a href="/1.html">1</a></div><div><a href="/2.html">2</a></div>'
    areas = pages.parse_categories(spark.createDataFrame([(cats,)], "html string")).collect()
    assert {r.filename: r.areas for r in areas} == {"1.html": ["B", "A"], "2.html": ["A"]}


def paper(i, year, **k):
    r = lambda s, rec=None, post=None, ps=None: {"score_raw": s, "score_max": 6, "score_normalized": (s - 1) / 5 if s is not None else None, "recommendation_label": rec, "post_rebuttal_label": post, "post_rebuttal_score_raw": ps, "text_strengths": "a b"}
    base = {"paper_id": f"p{i}", "title": f"Title {i}", "year": year, "authors": ["Doe, J", f"A{i}, B"], "subject_areas": ["X -> CT", "X-Ray", "Other"], "has_code": i % 2 == 0, "early_accepted": i == 1, "url": "u", "code_url": "N/A" if i % 2 else "http://c", "dataset_urls": [], "reviews": [r(*a) for a in k.pop("reviews", [(4,)])]}
    scores = [x["score_raw"] for x in base["reviews"] if x["score_raw"] is not None]
    base |= {"avg_score_raw": sum(scores) / len(scores) if scores else None, "avg_score_normalized": (sum(scores) / len(scores) - 1) / 5 if scores else None}
    return base | k


@pytest.fixture(scope="module")
def papers(spark):
    rows = [
        paper(1, 2022, reviews=[(4, None, "5"), (3,)], presentation_type="oral"), paper(2, 2022, reviews=[(4,), (4,)], presentation_type="poster"),
        paper(3, 2025, reviews=[(5, "Accept - x", "Strong Accept"), (3, "Weak Reject", None)], subject_areas=["Skin"]), paper(4, 2025, reviews=[(6, "Reject", "Weak Accept — y")], title='Quo"te, é'),
        paper(5, 2021, reviews=[(None,)]),
    ]
    return spark.read.schema(PAPERS).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows])).cache()


def test_metrics(spark, papers, years):
    got = {r.year: r for r in metrics.metric_panel(papers, years).collect()}
    assert (got[2022].n_papers, got[2022].n_authors, got[2022].pct_code, got[2022].pct_early) == (2, 3, 50.0, 50.0)
    assert got[2025].accept_rate == 50.0 and got[2022].pct_early_subs is None and got[2025].review_chars == 2.0
    shares = {(r.year, r.area): (r.n, r.share, r.presence, r.total) for r in metrics.subject_shares(papers).collect()}
    assert shares[2022, "CT / X-Ray"] == (2, 100.0, 3, 4) and shares[2025, "Skin"] == (1, 50.0, 1, 1)
    flows = metrics.verdict_flows(papers)
    assert sorted((r.pre, r.post, r.n) for r in flows.collect()) == [("Accept", "Strong Accept", 1), ("Reject", "Weak Accept", 1)]
    s = metrics.flow_summary(flows.withColumn("g", F.lit(1)), ["g"]).first()
    assert (s.pairs, s.raised, s.rejected_to_accept, s.pct_to_accept) == (2, 2, 1, 100.0)
    assert {r.year: r.scale for r in metrics.scales(papers).collect()} == {2021: 6, 2022: 6, 2025: 6}
    assert {r.year: r.has_verdicts for r in metrics.has_verdicts_after_rebuttal(papers).collect()} == {2021: False, 2022: False, 2025: True}
    t = metrics.totals(papers).first()
    assert (t.n_papers, t.n_reviews, t.n_authors) == (5, 8, 6)
    r = {x.paper_id: x for x in metrics.review_rollup(papers).collect()}
    assert r["p3"].score_range == 2 and r["p5"].avg_score_raw is None and r["p5"].num_reviews == 1


def test_error_gate(spark):
    df = spark.createDataFrame([(None,)] * 9 + [("x",)], "error string")
    with pytest.raises(ValueError, match="10.0%"):
        metrics.error_gate(df)
    assert metrics.error_gate(df, limit=0.2) == 0.1


def test_top_papers(papers):
    overall, rebuttal = ranking.top_papers(papers)
    assert [r.paper_id for r in overall.orderBy("year", "rank").collect()] == ["p2", "p1", "p4", "p3"]
    got = {r.paper_id: r for r in rebuttal.collect()}
    assert set(got) == {"p1", "p3", "p4"}
    assert (got["p1"].mode, got["p1"].mean_post, got["p1"].improvement) == ("scores", 4.0, 0.5)
    assert (got["p3"].mode, got["p3"].mean_rank, got["p3"].rank) == ("verdicts", 3.5, 1) and got["p4"].mean_rank == 3.0


def test_movers_overlap(spark):
    rows = [(y, a, float(s), 50, 2) for a, (s, e) in {"a": (1, 5), "b": (3, 2)}.items() for y, s in ((1, s), (2, e))]
    shares = spark.createDataFrame([(y, a, s, t) for y, a, s, t, _ in rows], "year int, area string, share double, total int")
    assert sorted((r.area, r.end) for r in ranking.movers(shares).collect()) == [("a", "high"), ("a", "low"), ("b", "high"), ("b", "low")]


def test_browse(spark, papers):
    index = browse.browse_index(papers).cache()
    one = {r.id: r for r in index.collect()}
    assert one["p1"].code_url is None and one["p2"].has_code and one["p5"].reviews == []
    ids = lambda q: [r.id for r in browse.page(index, q).collect()]
    assert ids(BrowseQuery()) == ["p4", "p3", "p1", "p2", "p5"]
    assert ids(BrowseQuery(sort="score-desc")) == ids(BrowseQuery())
    assert ids(BrowseQuery(year=2022, sort="score-desc")) == ["p2", "p1"]
    assert ids(BrowseQuery(q="É quo")) == ["p4"] and ids(BrowseQuery(type="oral")) == ["p1"] and ids(BrowseQuery(per=10, page=9)) == ids(BrowseQuery(per=10))
    assert [(r.value, r.n) for r in browse.facet(index, BrowseQuery(area="Skin", year=2025)).collect()] == [("Other", 1), ("Skin", 1), ("X -> CT", 1), ("X-Ray", 1)]
    q = BrowseQuery.from_url("?q=a+b&year=2022&sort=bad&per=7&page=3&code=1")
    assert (q.q, q.year, q.sort, q.per, q.page, q.code) == ("a b", 2022, "year-desc", 50, 3, True)
    assert BrowseQuery.from_url(q.to_url()) == q and q.changed(area="x").page == 1 and q.changed(per=10).page == 11
    assert browse.export_name(BrowseQuery(year=2022, area="X -> CT", early=True), "csv") == "papers-2022-x-ct-early.csv"


def test_exports(spark, papers, tmp_path):
    index, scales = browse.browse_index(papers), metrics.scales(papers)
    table = browse.csv_rows(index, scales).orderBy("title")
    assert len(table.columns) == 19
    writers.write_csv(table.where("year = '2025'").coalesce(1), str(tmp_path / "csv"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")) if p.stat().st_size)
    assert raw.startswith("﻿year,title".encode()) and raw.endswith(b"\r\n") and '"Quo""te, é"'.encode() in raw
    writers.write_index(index, scales, "2026-01-01", str(tmp_path / "index.json"))
    got = json.loads((tmp_path / "index.json").read_text())
    assert got["areas"] == ["Other", "Skin", "X -> CT", "X-Ray"] and got["scales"]["2022"] == 6
    assert [p["id"] for p in got["papers"]] == ["p1", "p2", "p3", "p4", "p5"] and got["papers"][0]["areas"] == [2, 3, 0] and "session" not in got["papers"][0]
    assert browse.json_records(index, scales).count() == 5


def test_sources_and_sinks(spark, papers, tmp_path):
    for y in (2022, 2025):
        rows = [json.loads(x) for x in papers.where(F.col("year") == y).toJSON().collect()]
        (tmp_path / f"papers_{y}.json").write_text(json.dumps([*rows, {"paper_id": "bad", "url": "u", "error": "x"}]))
    d = readers.papers_json(spark, str(tmp_path / "papers_????.json"))
    good, bad = readers.without_errors(d)
    assert good.count() == 4 and bad.count() == 2
    writers.write_exploded(good.drop("file"), str(tmp_path / "t"))
    assert readers.papers_table(spark, str(tmp_path / "t/papers")).where("year = 2022").count() == 2
    assert spark.read.parquet(str(tmp_path / "t/reviews")).count() == 7
    assert readers.talks_json(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "talks.json").write_text(json.dumps({"papers": {"p1": {"type": "oral", "session_id": "1", "match": "exact"}}, "summary": {}}))
    assert [tuple(r)[:2] for r in readers.talks_json(spark, str(tmp_path / "talks.json")).collect()] == [("p1", "oral")]
    (tmp_path / "new.json").write_text(json.dumps({"labels": {"0": "A", "1": "B"}, "clustering": "abc"}))
    (tmp_path / "old.json").write_text(json.dumps({"0": "A"}))
    assert {(r.cluster_id, r.clustering) for r in readers.labels_json(spark, str(tmp_path / "new.json")).collect()} == {(0, "abc"), (1, "abc")}
    assert [(r.cluster_id, r.clustering) for r in readers.labels_json(spark, str(tmp_path / "old.json")).collect()] == [(0, None)]
    o = readers.overrides(spark, {2022: {"A Tïtle!": "p1", "Skip": None}, "note": {}}).orderBy("norm_title").collect()
    assert [(r.norm_title, r.paper_id, r.is_skip) for r in o] == [("a title", "p1", False), ("skip", None, True)]
    prog = {"year": 2021, "sessions": [{"session_id": "1", "session_title": "S", "presentations": [{"type": "oral", "title_raw": "T", "authors_raw": ["a"], "order": 1}]}]}
    (tmp_path / "orals_x.json").write_text(json.dumps(prog))
    assert [(r.year, r.title_raw) for r in readers.programs_json(spark, str(tmp_path / "orals_*.json")).collect()] == [(2021, "T")]
    y = readers.year_config(spark, {"score_parse_mode": "parens", "years": {2021: {"era": "2021", "review_scale_max": 9}, 2024: None}}, {2021: 9}).orderBy("year").collect()
    assert [(r.year, r.era, r.review_scale_max, r.n_submitted) for r in y] == [(2021, "2021", 9, 9), (2024, None, 6, None)]


def test_page_source(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>é</p>", encoding="utf-8")
    page_source.register(spark)
    urls = f"file://{tmp_path}/a.html file://{tmp_path}/b.html"
    got = spark.read.format("quire-pages").option("urls", urls).option("delay", "0").load().collect()
    assert [(r.html, r.error is None) for r in got] == [("<p>é</p>", True), (None, False)]


def test_ingest_is_idempotent(spark, tmp_path):
    src, args = str(tmp_path / "in"), {"schema": "id long, v string", "sink": str(tmp_path / "out"), "checkpoint": str(tmp_path / "c"), "key": "id"}
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string").coalesce(1).write.parquet(src)
    assert incremental.ingest(spark, src, **args) == 2
    assert incremental.ingest(spark, src, **args) == 0
    spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string").coalesce(1).write.mode("append").parquet(src)
    assert incremental.ingest(spark, src, **args) == 1
    assert spark.read.parquet(args["sink"]).count() == 3


def test_clusters(spark):
    rows = [(f"p{i}", [float(i % 2) * 10 + i * 0.01, 1.0], i % 2, i) for i in range(20)]
    v = spark.createDataFrame(rows, "paper_id string, embedding array<float>, cluster_id int, ord long")
    stamp = clustering.partition_fingerprint(v).first().fingerprint
    import hashlib

    assert stamp == hashlib.sha256("".join(f"{p}\t{c}\n" for p, _, c, _ in sorted(rows)).encode()).hexdigest()
    assert clustering.verify_labels(v, stamp) == stamp
    moved = v.withColumn("cluster_id", F.when(F.col("paper_id") == "p3", 0).otherwise(F.col("cluster_id")))
    renamed = v.withColumn("cluster_id", 1 - F.col("cluster_id"))
    for wrong, s in ((moved, stamp), (renamed, stamp), (v, None)):
        with pytest.raises(clustering.LabelMismatch):
            clustering.verify_labels(wrong, s)
    new = spark.createDataFrame([("q1", [9.0, 1.0]), ("q2", [-1.0, 1.0]), ("p1", [0.0, 0.0])], "paper_id string, embedding array<float>").withColumn("ord", F.lit(99).cast("long"))
    both, drift, again = clustering.extend(v, new, stamp)
    got = {r.paper_id: r.cluster_id for r in both.collect()}
    assert len(got) == 22 and (got["q1"], got["q2"], got["p1"]) == (1, 0, 1) and again != stamp
    assert drift.first().beyond == 2
    with pytest.raises(ValueError, match="nearest"):
        clustering.self_agreement(moved)
    labels = spark.createDataFrame([(0, "Zero")], "cluster_id int, label string")
    assert {r.cluster_label for r in clustering.attach_labels(v, labels).collect()} == {"Zero", "Cluster 1"}
    assert [r.cluster_id for r in clustering.unnamed_clusters(v, labels).collect()] == [1]


def test_graph(spark):
    p = spark.createDataFrame([("1", ["a", "b", "c"]), ("2", ["a", "b"]), ("3", ["d", "e"]), ("4", ["d", "e", "a"]), ("5", ["f"])], "paper_id string, authors array<string>")
    v, e = graph.coauthors(p, 2)
    assert sorted(tuple(r) for r in e.collect()) == [("a", "b", 2), ("a", "d", 1), ("a", "e", 1), ("d", "e", 2)]
    assert {r.id: (r.degree, r.strength) for r in graph.degrees(e).collect()}["a"] == (3, 4)
    _, every = graph.coauthors(p, 1)
    comp = graph.connected_components(every.where("weight > 1"), p.select(F.explode("authors").alias("id")))
    assert {r.id: r.component for r in comp.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "f"}
    got = {r.id: r.community for r in graph.communities(e, v).collect()}
    assert got["a"] == got["b"] != got["d"] == got["e"]


def plain_communities(edges, nodes):
    """Merges the pair of largest gain, found by looking at all pairs each time."""
    total = sum(w for *_, w in edges)
    groups = {n: {n} for n in nodes}
    while True:
        weight = {}
        where = {x: n for n, g in groups.items() for x in g}
        strength = dict.fromkeys(groups, 0.0)
        for a, b, w in edges:
            strength[where[a]] += w / (2 * total)
            strength[where[b]] += w / (2 * total)
            if where[a] != where[b]:
                key = tuple(sorted((where[a], where[b])))
                weight[key] = weight.get(key, 0) + w / (2 * total)
        gains = sorted((-round(2 * (w - strength[a] * strength[b]), 12), a, b) for (a, b), w in weight.items())
        if not gains or gains[0][0] >= 0:
            return {x: i for i, g in enumerate(sorted((sorted(g) for g in groups.values()), key=lambda g: (-len(g), g[0]))) for x in g}
        _, a, b = gains[0]
        groups[a] |= groups.pop(b)


def test_communities_of_all_pairs(spark):
    rng = random.Random(5)
    # three components of their own sizes, and two vertices without an edge
    edges = [(a, b, rng.randint(1, 4)) for lo, hi, p in ((0, 25, 0.25), (30, 45, 0.3), (50, 53, 1.0)) for a in range(lo, hi) for b in range(a + 1, hi) if rng.random() < p]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | {98, 99})
    e = spark.createDataFrame(edges, "u long, v long, weight long")
    v = spark.createDataFrame([(n,) for n in nodes], "id long")
    assert {r.id: r.community for r in graph.communities(e, v).collect()} == plain_communities(edges, nodes)
    assert {r.id: r.community for r in graph.communities(e.limit(0), v).collect()} == {n: i for i, n in enumerate(nodes)}
    got = {r.id: r.community for r in graph.communities(e, v, component_edges=2).collect()}
    assert got.keys() == set(nodes) and sorted(set(got.values())) == list(range(len(set(got.values()))))
    assert not {got[n] for n in nodes if n < 25} & {got[n] for n in nodes if n >= 30}


def test_dense_components_merge_as_others_do_without_a_heap(monkeypatch):
    rng = random.Random(8)
    for n, p in ((1, 1.0), (9, 0.4), (24, 0.7), (40, 1.0)):
        nodes = sorted(f"n{i}" for i in range(n))
        edges = [(a, b, rng.choice([1.0, 2.0, 0.5])) for i, a in enumerate(nodes) for b in nodes[i:] if rng.random() <= p]
        for total in (None, 3.0 * len(edges)):
            with monkeypatch.context() as m:
                m.setattr(graph, "DENSE", 0)
                want = graph.greedy_modularity(edges, nodes, total)
            with monkeypatch.context() as m:
                m.setattr(graph.heapq, "heapify", lambda heap: pytest.fail("a heap of all pairs"))
                assert graph.greedy_modularity(edges, nodes, total) == want


def test_fingerprint_is_of_the_sorted_lines(spark):
    rows = [("b", 1), ("a", 2), ("é", 3), ("B", 4), ("a\U0001f600", 5), ("x", None)]
    lines = sorted(f"{k}\t{c}\n".encode() for k, c in rows if c is not None)
    got = clustering.partition_fingerprint(spark.createDataFrame(rows, "paper_id string, cluster_id int").repartition(3)).first()
    assert (got.fingerprint, got.n) == (hashlib.sha256(b"".join(lines)).hexdigest(), 5)


def test_stamp_is_a_tree_over_the_keys(spark):
    rows = [(f"k{i}", i % 3) for i in range(500)] + [("k1", 1), ("k2", 0), ("é", 3), (None, 1), ("x", None)]
    kind = "paper_id string, cluster_id int"
    lines = collections.Counter()
    for k, c in rows:
        if c is not None:
            lines[hashlib.sha256((k or "").encode()).hexdigest()[:6], "" if k is None else f"{k}\t{c}\n"] += 1
    level = collections.defaultdict(list)
    for (node, line), n in lines.items():
        level[node].append((line.encode(), n))
    tree = {k: hashlib.sha256(b"".join(x + f" {n}".encode() for x, n in sorted(v))).hexdigest() for k, v in level.items()}
    for digits in (4, 2, 0):
        up = collections.defaultdict(str)
        for k in sorted(tree):
            up[k[:digits]] += f"{k} {tree[k]}"
        tree = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in up.items()}
    stamps = [clustering.partition_stamp(spark.createDataFrame(d, kind).repartition(p)).first() for d, p in ((rows, 3), (rows[::-1], 1))]
    assert [(s.fingerprint, s.n) for s in stamps] == [("tree:" + tree[""], 504)] * 2
    d = spark.createDataFrame(rows, kind)
    assert clustering.verify_labels(d, stamps[0].fingerprint) == stamps[0].fingerprint
    with pytest.raises(clustering.LabelMismatch):
        clustering.verify_labels(d.where("paper_id <> 'k7'"), stamps[0].fingerprint)
    empty = clustering.partition_stamp(spark.createDataFrame([], kind)).first()
    assert (empty.fingerprint, empty.n) == ("tree:" + hashlib.sha256(b"").hexdigest(), 0)


def test_components_of_a_path(spark):
    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    assert {r.component for r in graph.connected_components(e).collect()} == {0}


def test_columns_and_lines(spark):
    w = [("d", 1, t, f, 10.0, x, x + 10, y, 100.0) for t, f, x, y in [("a", "Bold", 0.0, 10.0), ("b", "Bold", 20.0, 11.0), ("c", "R", 0.0, 30.0), ("right", "R", 60.0, 10.0), ("mid", "R", 45.0, 50.0)]]
    lines = layout.to_lines(spark.createDataFrame(w, WORDS), 2).orderBy("col", "ord").collect()
    assert [(r.col, r.text, r.bold) for r in lines] == [(0, "a b", True), (0, "c", False), (1, "right", False), (1, "mid", False)]
    one = layout.to_columns(spark.createDataFrame(w, WORDS), 1)
    assert {r.col for r in one.collect()} == {0}
    gutter = layout.to_columns(spark.createDataFrame(w[:4], WORDS), 2, "gutter")
    assert {r.text: r.col for r in gutter.collect()} == {"a": 0, "b": 0, "c": 0, "right": 1}


def line(ord, text, size=10.0, top=0.0, bold=False, col=0, page=1):
    return ("d", page, col, ord, text, float(size), 0.0, float(top), bold, False, ord == 0)


def test_program(spark):
    rows = [
        line(0, "MICCAI 2024", 13.0), line(1, "Oral Session 1: Hearts", 13.0, 10), line(2, "Oral Presentations:", 10, 30), line(3, "A title that wraps semi-", 10, 50), line(4, "supervised", 10, 60), line(5, "Authors: Doe, J; Roe, R", 10, 70),
        line(6, "Speaker: Jane Doe, Lab", 10, 80), line(7, "Spotlight Presentations:", 10, 110), line(8, "Second", 10, 140), line(9, "Panel Discussion", 10, 170), line(10, "Oral Session 2: Lungs", 13.0, 200), line(11, "Third talk", 10, 230),
    ]
    lines = layout.roles(spark.createDataFrame(rows, LINES), 13.0, 10.0, 12.0)
    talks = layout.program_blocks(lines, session_re=r"^Oral Session \d+", mode="gap", gap=16.0, authors_re=r"^Authors?\s*:", speaker_re=r"^Speakers?\s*:").cache()
    got = sorted((r.session, r.order, r.type, r.title_raw, r.speaker) for r in talks.collect())
    assert got == [(1, 1, "oral", "A title that wraps semi-supervised", "Jane Doe, Lab"), (1, 2, "spotlight", "Second", None), (2, 1, "oral", "Third talk", None)]
    layout.check_sessions(talks, 2)
    with pytest.raises(ValueError, match="expected"):
        layout.check_sessions(talks, 3)
    doc = {r.session_id: [p.title_raw for p in r.presentations] for r in layout.program_document(talks).collect()}
    assert doc == {1: ["A title that wraps semi-supervised", "Second"], 2: ["Third talk"]}


def test_components_of_all_parts(spark, sf, tmp_path):
    from quire.plans.catalog import QUERIES

    rows = [(r.l_orderkey, r.l_partkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").where("l_partkey % 7 < 2 AND l_orderkey % 5 = 0").select("l_orderkey", "l_partkey").collect()]
    rows += [(-1, 10**9), (-2, 10**9 + 2), (-2, 10**9 + 1), (-3, 10**9 + 2), (-3, 10**9 + 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    parent = {p: p for _, p in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for o, p in rows:
        a, b = find(first.setdefault(o, p)), find(p)
        parent[max(a, b)] = min(a, b)
    got = [tuple(r) for r in QUERIES["connected_components_all"](spark, str(tmp_path)).select("id", "component").collect()]
    assert sorted(got) == sorted((p, find(p)) for p in parent)
