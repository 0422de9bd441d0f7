"""Ranked lexical search: oracle, brute force over many small blocks, edge rows."""

import math
import random
import re

import pytest
from helpers import same_rows

from quire.llm import search as module
from quire.llm.search import op11_lexical_search, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(d, terms_of(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in set(items):
        scores = []
        for d, t in held:
            m = 25 + 75 * len(t) * n_docs // n_terms
            score = 0
            for x in terms_of(text):
                if tf := t.count(x):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **more):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, search(a, b, **more).collect()), key=repr)


def test_oracle(spark, sf):
    same_rows(spark, op11_lexical_search, module.OP11_SQL, sf)


@pytest.mark.parametrize("leaf", [1, 3])
def test_deep_trees_and_ties(spark, leaf):
    """Blocks of a few documents make several levels; many documents share a score."""
    r = random.Random(leaf)
    words = ["Alpha", "beta", "gamma", "Äther", "x1", "delta", "eps", "zeta"]
    docs = [(i, " ".join(r.choices(words, [30, 20, 10, 5, 3, 2, 1, 1], k=r.choice([1, 2, 2, 3, 9])))) for i in range(700)]
    r.shuffle(docs)
    items = [(i, ", ".join(r.choices(words, k=r.randint(1, 4)))) for i in range(12)]
    assert ranked(spark, docs, items, leaf=leaf, block_docs=5) == brute(docs, items)
    assert ranked(spark, docs, items[:3], k=3, leaf=leaf, block_docs=5) == brute(docs, items[:3], 3)


def test_few_blocks_are_opened(spark, monkeypatch):
    """A rare term's bound is positive in its own blocks only; the others stay closed."""
    opened = []
    plain = module.open_blocks

    def counted(index, pairs, *rest):
        opened.append(pairs.count())
        return plain(index, pairs, *rest)

    monkeypatch.setattr(module, "open_blocks", counted)
    docs = [(i, f"common w{i % 50}" + (" rare" if i in (3, 399) else "")) for i in range(400)]
    assert [r[2] for r in ranked(spark, docs, [(1, "rare")], block_docs=4)] == [3, 399]
    assert sum(opened) == 2


def test_edge_rows(spark):
    docs = [
        (5, "Straße straße STRASSE"), (1, None), (2, ""), (3, "!!! ..."), (7, "one two"), (7, "one two"), (7, "one three three"), (None, "one two"), (9, "two\x00one x"),
        (4, "one " * 50_000), (8, "a_b`c^d[e]f{g}h~i\x7fj"),
    ]
    items = [(1, "one"), (1, "one"), (1, "two two"), (2, None), (3, "?"), (4, "straße ONE"), (None, "three"), (6, "nowhere"), (8, "j h"), (9, "one x")]
    assert ranked(spark, docs, items) == brute(docs, items)
    assert ranked(spark, [], [(1, "one")]) == [] and ranked(spark, docs, []) == []
    assert ranked(spark, [(1, None)], [(1, "one")]) == []


def test_columns_of_other_names_and_clashing_ones(spark):
    docs = spark.createDataFrame([(1, "one two", 5, "t", 0.5)], "id int, body string, task int, term string, rank double")
    items = spark.createDataFrame([("a", "two", 1, "x")], "name string, ask string, q1 int, weight string")
    got = search(docs, items, doc_id="id", text="body", item_id="name", item_text="ask").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [("a", 1, 1)]
