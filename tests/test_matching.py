"""Joins and every stage of the title match, with ties and margins."""

import random

import numpy as np
import pytest

from quire.functions.text import cut_places, indel_ratio, lcs_of_all, lcs_of_pairs, most_alike, ratio_bounds
from quire.operators import matching, metrics
from quire.schemas import OVERRIDES, TALKS


def test_types_by_left_join(spark):
    papers = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "paper_id string")
    talks = spark.createDataFrame([("p1", "oral", "1", "s", None, "exact"), ("p2", "spotlight", "1", "s", None, "exact")], TALKS)
    got = {r.paper_id: r.presentation_type for r in matching.attach_types(papers, talks).collect()}
    assert got == {"p1": "oral", "p2": "spotlight", "p3": "poster"}
    none = matching.attach_types(papers, talks.limit(0)).collect()
    assert {r.presentation_type for r in none} == {None}


def test_cascade(spark):
    papers = spark.createDataFrame([
        (1, "a", "Deep learning for liver segmentation", ["Doe, Jane"]), (1, "b", "Unpaired translation of images by contrast", ["Ma, Lei"]), (1, "c", "Unpaired translation of images by contrasts", ["Li, X"]),
        (1, "d", "Same title here", ["One, A"]), (1, "e", "Same title here", ["Two, B"]), (1, "f", "Override target", ["Z, Z"]), (2, "g", "Deep learning for liver segmentation", ["Doe, Jane"]),
    ], "year int, paper_id string, title string, authors array<string>")
    talks = spark.createDataFrame([
        (1, 0, "Deep Learning for Liver Segmentation", None), (1, 1, "Deep learning for liver segmentatin", None), (1, 2, "Unpaired translation of images by contrastx", "Xi Li, Lab"),
        (1, 3, "Same title here", "B Two"), (1, 4, "Hand written", None), (1, 5, "Skip me", None), (1, 6, "Nothing like it at all", "Jane Doe"), (1, 7, "Unpaired translation of images by contrastx", None), (2, 8, "Deep learning for liver segmentation", None),
    ], "year int, ord int, title_raw string, speaker string")
    over = spark.createDataFrame([(1, "hand written", "f", False), (1, "skip me", None, True)], OVERRIDES)
    m = matching.match_talks(talks, papers, over).cache()
    got = {r.ord: (r.paper_id, r.match) for r in m.collect()}
    assert got == {0: ("a", "exact"), 1: ("a", "fuzzy"), 2: ("c", "speaker"), 3: ("e", "speaker"), 4: ("f", "override"), 5: (None, "skipped"), 6: (None, "unmatched"), 7: (None, "unmatched"), 8: ("g", "exact")}
    last = {r.paper_id: r.ord for r in matching.talk_of_paper(m).collect()}
    assert last["a"] == 1
    guesses = {r.title_raw: r for r in matching.best_guesses(m, papers).collect()}
    assert sorted(guesses) == ["Nothing like it at all", "Unpaired translation of images by contrastx"]
    assert guesses["Nothing like it at all"].best_score < 82 < guesses["Unpaired translation of images by contrastx"].best_score
    s = {r.year: r for r in metrics.match_summary(m.withColumn("type", m["match"])).collect()}
    assert (s[1].extracted, s[1].matched, s[1].skipped, s[1].unmatched) == (8, 5, 1, 2)
    assert s[1].match_rate_pct == pytest.approx(500 / 7) and s[1].methods == {"exact": 1, "fuzzy": 1, "override": 1, "speaker": 2}


def _strings(n, seed):
    r = random.Random(seed)
    base = ["".join(r.choices("abcd é\U0001f600 xyz0123", k=r.choice([0, 1, 2, 5, 20, 45, 60]))) for _ in range(n // 3)]
    near = ["".join(c for c in s if r.random() > 0.1) + r.choice(["", "a", "zz"]) for s in base for _ in range(2)]
    return sorted(set(base + near + ["", "a" * 300, "a" * 290 + "b"]))


def test_bounds_hold_and_the_search_finds_what_all_pairs_give():
    a, b = _strings(90, 1), _strings(90, 1)[::2] + _strings(60, 2)
    bounds = ratio_bounds(a, b)
    assert all(bounds[i, j] >= indel_ratio(s, t) - 1e-9 for i, s in enumerate(a) for j, t in enumerate(b))
    for least, top in ((82.0, 3), (0.0, 1), (50.0, 2)):
        want = [(i, t, -m) for i, s in enumerate(a) for m, t in sorted((-indel_ratio(s, t), t) for t in b)[:top] if -m >= least]
        assert most_alike(a, b, least, top) == want


@pytest.mark.parametrize("least", [82.0, 0.0])
def test_tiles_give_what_all_pairs_give(spark, monkeypatch, least):
    monkeypatch.setattr(matching, "TILE", 20)
    a, b = _strings(120, 3), sorted(set(_strings(120, 3)[::2] + _strings(60, 4)))
    talks = spark.createDataFrame([(k, i, s) for k in (1, None) for i, s in enumerate(a)] + [(1, 9999, None), (2, 0, "x")], "_b int, ord int, norm string")
    titles = spark.createDataFrame([(k, s) for k in (1, 3, None) for s in b] + [(1, None)], "_b int, norm string")
    got: dict = {}
    for r in matching.alike(talks, titles, least, 2).collect():
        assert r._b == 1
        got.setdefault(r.ord, []).append((-r.score, r.title))
    want = {i: [x for x in sorted((-indel_ratio(s, t), t) for t in b)[:2] if -x[0] >= least] for i, s in enumerate(a)}
    assert {i: sorted(v)[:2] for i, v in got.items()} == {i: v for i, v in want.items() if v}


def test_common_subsequences_of_long_strings_too():
    r = random.Random(5)
    a = [*_strings(60, 1), "x" * 64, "y" * 65 + "b" * 64, "".join(r.choices("ab", k=200))]
    b = [*_strings(60, 1)[::2], "x" * 63 + "y" * 64, "".join(r.choices("abx", k=131))]
    want = np.array([[round(indel_ratio(s, t) * (len(s) + len(t)) / 200) for t in b] for s in a])
    i, j = (x.ravel() for x in np.indices(want.shape))
    assert (lcs_of_all(a, b) == want).all() and (lcs_of_pairs(a, b, i, j) == want.ravel()).all()


def _edited(n, seed):
    """Titles that differ in digits, and talks some edits away from them."""
    r = random.Random(seed)
    titles = sorted({f"{r.choice(['old', 'large', 'é blue'])} ring {r.randrange(99)} {r.getrandbits(40):010x}" for _ in range(n)} | {"ring", "a", "", "ring " * 30})
    talks = []
    for s in titles:
        t = list(s)
        for _ in range(r.randrange(10)):
            k = r.randrange(len(t) + 1)
            t[k : k + r.choice([0, 1, 1])] = r.choice(["", "", "x", "7"])
        talks.append("".join(t))
    return talks, titles


@pytest.mark.parametrize("edits", [4, 8])
def test_pieces_find_all_titles_within_the_edits(spark, monkeypatch, edits):
    monkeypatch.setattr(matching, "TILE", 7)
    a, b = _edited(150, edits)
    talks = spark.createDataFrame([(k, i, s) for k in (1, None) for i, s in enumerate(a)] + [(1, 9999, None), (2, 0, "x")], "_b int, ord int, norm string")
    titles = spark.createDataFrame([(k, s) for k in (1, 3, None) for s in b] + [(1, None)], "_b int, norm string")
    places, _ = cut_places([s for s in b if len(s) > 9], edits)
    assert len(places) == edits + 1
    got = {(r.ord, r.title): r.score for r in matching.within_edits(talks, titles, edits, places, 50.0).collect()}
    distance = lambda s, t: len(s) + len(t) - round(indel_ratio(s, t) * (len(s) + len(t)) / 100)
    near = {(i, t): indel_ratio(s, t) for i, s in enumerate(a) for t in b if len(t) > places[-1] and distance(s, t) <= edits and indel_ratio(s, t) >= 50}
    assert got == near and len(near) > 50
    beyond = {r.ord: r.beyond for r in matching.out_of_reach(talks, titles, edits, places[-1]).collect() if r._b == 1}
    assert all(indel_ratio(s, t) <= beyond[i] + 1e-9 for i, s in enumerate(a) for t in b if (i, t) not in near and (distance(s, t) > edits or len(t) <= places[-1]))


def test_the_staged_match_gives_what_all_pairs_give(spark, monkeypatch):
    monkeypatch.setattr(matching, "SELECTIVE", 9.0)
    a, b = _edited(150, 3)
    papers = spark.createDataFrame([(k, f"{k}-{i}", s, [f"Maker{i % 5}, A"]) for k in (1, 2) for i, s in enumerate(b + b[:9])], "year int, paper_id string, title string, authors array<string>")
    talks = spark.createDataFrame([(k, i, s, f"A Maker{i % 5}, Lab" if i % 3 else None) for k in (1, 2) for i, s in enumerate(a)], "year int, ord int, title_raw string, speaker string")
    none = spark.createDataFrame([], OVERRIDES)
    want = sorted(map(tuple, matching.match_talks(talks, papers, none).collect()), key=repr)
    asked = []
    plain = matching.alike
    monkeypatch.setattr(matching, "alike", lambda t, *rest: asked.append(t.count()) or plain(t, *rest))
    monkeypatch.setattr(matching, "INDEXED", 1)
    assert sorted(map(tuple, matching.match_talks(talks, papers, none).collect()), key=repr) == want
    assert {x[5] for x in want} >= {"exact", "fuzzy", "speaker", "unmatched"}
    # What the pieces settle isn't held against all titles again.
    assert 0 < asked[0] < len(want) - sum(x[5] == "exact" for x in want)


def test_cascade_of_empty_tables_nulls_and_repeated_talks(spark):
    papers = spark.createDataFrame([(1, "a", "Deep learning for liver segmentation", ["Doe, Jane"]), (1, "n", None, None), (None, "m", "Some title", None)], "year int, paper_id string, title string, authors array<string>")
    talk = (1, 0, "Deep learning for liver segmentatin", None)
    talks = spark.createDataFrame([talk, talk, (1, 1, None, "Jane Doe"), (None, 2, "Some titl", None)], "year int, ord int, title_raw string, speaker string")
    none = spark.createDataFrame([], OVERRIDES)
    m = matching.match_talks(talks, papers, none)
    assert sorted((r.ord, r.paper_id, r.match) for r in m.collect()) == [(0, "a", "fuzzy"), (0, "a", "fuzzy"), (1, None, "unmatched"), (2, None, "unmatched")]
    assert matching.match_talks(talks.limit(0), papers, none).collect() == []
    assert {r.match for r in matching.match_talks(talks, papers.limit(0), none).collect()} == {"unmatched"}
    assert {r.best_title for r in matching.best_guesses(m, papers.limit(0)).collect()} == {None}


def test_exactly_one(spark):
    records = spark.createDataFrame([("1", "A title"), ("2", "B title"), ("3", "B  Title")], "paper_id string, title string")
    talks = spark.createDataFrame([("a TITLE", "oral", "S1")], "title string, presentation_type string, oral_session string")
    got = {r.paper_id: (r.presentation_type, r.oral_session) for r in matching.join_talks(records, talks, 1, 0).collect()}
    assert got == {"1": ("oral", "S1"), "2": ("poster", None), "3": ("poster", None)}
    with pytest.raises(ValueError, match="expected 2"):
        matching.join_talks(records, talks, 2)
    twice = spark.createDataFrame([("b title", "oral", "S")], "title string, presentation_type string, oral_session string")
    with pytest.raises(Exception, match="not exactly one"):
        matching.join_talks(records, twice).collect()


def test_name_lookup(spark):
    papers = spark.createDataFrame([(["van Gogh, Vincent", "Kim, A B"],), (["Kim A, B"],), (["Yu, Yi", "yu, yi"],)], "authors array<string>")
    lookup = matching.name_lookup(papers)
    names = spark.createDataFrame([("VINCENT van gogh",), ("Yi Yu",), ("New Name",), (None,)], "name string")
    got = {r.name: (r.canonical, r.rule) for r in matching.canonical_names(names, lookup).collect()}
    assert got == {"VINCENT van gogh": ("van Gogh, Vincent", "lookup"), "Yi Yu": ("Yu, Yi", "particle"), "New Name": ("Name, New", "particle"), None: ("", "empty")}


def test_containment(spark):
    a = spark.createDataFrame([(1, "one two three four five six"), (2, "short one"), (3, "absent words are not found here")], "i long, t string")
    b = spark.createDataFrame([(10, "x one two three four five six y"), (11, "a short one"), (12, None), (13, "one two three four five seven")], "d long, t string")
    got = sorted(tuple(r) for r in matching.contained_in(a, b, needle_id="i", needle="t", hay_id="d", text="t").collect())
    assert (1, 10) in got and (3, 10) not in got and (1, 13) not in got


def test_containment_of_short_needles_and_inner_starts(spark):
    needles = [(1, "two three four"), (2, "wo three fo"), (3, "ne two three four five si"), (4, "short one"), (5, "absent"), (6, " "), (7, None), (8, "three  four five six")]
    hay = [(10, "one two three four five six seven"), (11, "a short one"), (12, None), (13, "three  four five six"), (14, "two three")]
    a, b = spark.createDataFrame(needles, "i long, t string"), spark.createDataFrame(hay, "d long, t string")
    got = sorted(tuple(r) for r in matching.contained_in(a, b, needle_id="i", needle="t", hay_id="d", text="t").collect())
    assert got == sorted((i, d) for i, x in needles for d, y in hay if (x or "").strip() and y and x in y)


def test_every_part_is_a_talk(spark, sf):
    from quire.plans.catalog import QUERIES

    got = [r.ord for r in QUERIES["fuzzy_match_cascade"](spark, sf).select("ord").collect()]
    assert sorted(got) == sorted(r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").collect())
