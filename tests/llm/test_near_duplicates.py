"""The banded join against all pairs by brute force."""

import random

import pytest

from quire.llm import near_duplicates as nd


def brute(docs, threshold=0.8):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = {d: set() for d in sets}
    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, set()).add(d)
    for d, s in sets.items():
        near = set().union(*(index[x] for x in s)) - {d} if s else set()
        links[d] = {e for e in near if len(s & sets[e]) / len(s | sets[e]) >= threshold}
    root = {}
    for d in sorted(sets):
        if d in root:
            continue
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = d
                todo += links[x]
    return {d: (root[d], len(links[d])) for d in sets}


def family(rng, n, base=300):
    words = [f"w{rng.randrange(10**6)}" for _ in range(base)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(base)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_bands_reach_the_recall():
    b, r = nd.choose_bands(0.8, 0.999, 256)
    assert b * r <= 256 and 1 - (1 - 0.8**r) ** b >= 0.999


def test_table_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.op3_near_duplicates(spark, sf).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("limits", [(1000, 32), (12, 3)])
def test_families_against_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(nd, "GROUP_DOCS", limits[0])
    monkeypatch.setattr(nd, "SMALL_BUCKET", limits[1])
    rng = random.Random(3)
    texts = [t for n in (2, 3, 5, 30) for t in family(rng, n)]
    docs = [(7 * i, t) for i, t in enumerate(texts)] + [(10_001, texts[0]), (10_002, texts[9])]
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs)
    wrong = [d for d in want if got[d] != want[d]]
    assert len(wrong) <= 1


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "a b", 0), (5, "a\tb", 0), (6, "a b c", 0), (None, "a b", 0), (7, "x " * 5000, 0), (7, "x " * 5000, 0), (8, "x x x x x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp int")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in nd.near_duplicates(df).collect())
    assert got == [(-1, 4, 2), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (5, 4, 2), (6, 6, 0), (7, 7, 2), (7, 7, 2), (8, 7, 2)]
    assert nd.near_duplicates(df.limit(0)).collect() == []


def test_one_document_of_each_class_stays(spark):
    df = spark.createDataFrame([(1, "a b c", 0), (2, "a b c", 0), (2, "a b c", 0), (3, "z", 0), (None, "a b c", 0), (None, "y", 0), (None, "y", 0), (None, None, 0)], "doc_id long, text string, r1 int")
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "y"), (1, "a b c"), (3, "z")]


@pytest.mark.parametrize("limits", [(1000, 32, 10**6), (12, 3, 2_000)])
def test_repeated_ids_with_other_texts(spark, monkeypatch, limits):
    """Rows are judged by their texts: two families under the same ids, each linked within itself."""
    for name, value in zip(("GROUP_DOCS", "SMALL_BUCKET", "GROUP_SHINGLES"), limits, strict=True):
        monkeypatch.setattr(nd, name, value)
    rng = random.Random(8)
    one, two = family(rng, 20), family(rng, 20)
    rows = [(i % 5 if i % 5 else None, t) for i, t in enumerate(one + two)]
    plain = brute(list(enumerate(t for _, t in rows)))
    members = {}
    for i, (root, _) in plain.items():
        members.setdefault(root, []).append(rows[i][0])
    want = sorted((rows[i][0] or 0, min((d for d in members[root] if d), default=0), n) for i, (root, n) in plain.items())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in nd.near_duplicates(df).collect()) == want
    kept = nd.keep_one(df).collect()
    assert len(kept) == len(members)
    text_of = {t: root for (i, (root, _)), (_, t) in zip(plain.items(), rows, strict=True)}
    assert sorted(text_of[r.text] for r in kept) == sorted(members)


def test_the_same_copy_stays_in_every_run(spark, tmp_path):
    """Near copies of one id, or without one: the one that stays doesn't depend on files or their order."""
    words = [f"w{i}" for i in range(200)]
    docs = [(None if k > 5 else 3, " ".join([*words[:k], f"other{k}", *words[k + 1 :]]), f"s{k % 2}") for k in (1, 3, 5, 30, 40, 50)] + [(3, " ".join([*words[:5], "other5", *words[6:]]), "s9")]
    runs = set()
    for i, order in enumerate((docs, docs[::-1], docs[3:] + docs[:3])):
        spark.createDataFrame(order, "doc_id long, text string, source string").repartition(i + 1).write.parquet(str(tmp_path / f"{i}"))
        runs.add(tuple(map(tuple, nd.keep_one(spark.read.parquet(str(tmp_path / f"{i}"))).collect())))
    assert len(runs) == 1 and len(next(iter(runs))) == 1


def test_components_in_few_written_tables(spark, monkeypatch):
    """A star around its smallest node takes one round; paths, in order and against it, and stars of stars a few."""
    written, write = [], nd.materialize
    monkeypatch.setattr(nd, "materialize", lambda df, **values: written.append(df) or write(df, **values))

    def roots(edges):
        written.clear()
        found = [tuple(r) for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()]
        assert len(found) == len(dict(found)) == len({x for a, b in edges if a != b for x in (a, b)})
        return dict(found)

    assert set(roots([(x, 1) for x in range(2, 500)] + [(7, 7)]).values()) == {1} and len(written) <= 4
    path = [(x, x + 1) for x in range(1000, 1060)]
    assert len(set(roots(path).values())) == 1 and len(written) <= 20
    rng = random.Random(4)
    stars = [(x, x // 20) for x in range(2000, 4000)] + [(100 + x, 100 + x // 5) for x in range(50)]
    mixed = [e[:: rng.choice((1, -1))] for e in stars + [(9000 + a, 9000 + b) for a, b in path] + stars[:30]]
    rng.shuffle(mixed)
    groups, want = {}, {}
    for n, root in roots(mixed).items():
        groups.setdefault(root, set()).add(n)
    for a, b in mixed:
        both = want.get(a, {a}) | want.get(b, {b})
        want |= dict.fromkeys(both, both)
    assert all(root in members for root, members in groups.items())
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}
    assert roots([]) == {}


def test_taking_a_large_group_apart_writes_few_tables(spark, monkeypatch):
    """Each table costs at least a task for every shuffle partition, however small it is."""
    monkeypatch.setattr(nd, "GROUP_DOCS", 12)
    monkeypatch.setattr(nd, "SMALL_BUCKET", 3)
    written, write = [], nd.materialize
    monkeypatch.setattr(nd, "materialize", lambda df, **values: written.append(df) or write(df, **values))
    docs = list(enumerate(family(random.Random(6), 40)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert len(written) <= 40
