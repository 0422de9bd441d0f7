"""Mixing: oracle, exact budgets, water-filling by the iterated rule, edge rows."""

import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from quire.llm import mixing
from quire.llm.mixing import apply_mix, mix


def iterated(sizes, weights=(1, 2, 3), cap=3.0):
    """The stated rule, step by step."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_oracle(spark, sf):
    same_rows(spark, mixing.op10_mix_sources, mixing.OP10_SQL, sf)


@pytest.mark.parametrize("rows", [2_000, 7])
def test_budgets_are_exact(spark, sf, monkeypatch, rows):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mix(docs).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = iterated(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert mine[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in mine) == int(want[s] + 0.5)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(tuple, mix(docs).collect())) == sorted(map(tuple, got))


def test_caps_and_edge_rows(spark):
    rows = [(1, "a " * 10, "x"), (2, "b " * 1000, "y"), (3, None, "y"), (4, "", "z"), (5, "c", None), (None, "d d", "y"), (2, "b " * 1000, "y"), (6, "e\u00a0e", "w")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, target int, size int")
    got = mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    assert sizes == {"x": 10, "y": 2002, "z": 0, None: 1, "w": 1}
    want = iterated(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in got)
    assert mix(df.limit(0)).collect() == []


def test_mixed_documents(spark):
    df = spark.createDataFrame([(i, f"w{i} " * 10, "a" if i < 5 else "b", 1, 2, "k") for i in range(50)], "doc_id long, text string, source string, n_chars long, size int, keep string")
    m = mix(df)
    out = apply_mix(df)
    words = out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()
    taken = {r.source: r.n for r in m.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert {r.source: r.n for r in words} == taken
    assert out.columns == df.columns and {(r.size, r.keep) for r in out.collect()} == {(2, "k")}
    assert all(r.n_chars == len(r.text) for r in out.collect())


@pytest.mark.parametrize("rows", [500, 2])
def test_mixed_rows_without_or_with_one_id(spark, monkeypatch, rows):
    """Null and repeated ids are mixed as rows of their own, to the word."""
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", rows)
    data = [(None, f"n{i} " * (i % 5), "a" if i % 3 else None, 7, 8) for i in range(30)] + [(4, "same text here", "b", 7, 8)] * 9 + [(4, f"other {i}", "b", 7, 8) for i in range(9)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, key int, extra int")
    m = mix(df).collect()
    want = {}
    for r in m:
        want[r.source] = want.get(r.source, 0) + r.taken
    target = iterated({s: sum(r.size for r in m if r.source == s) for s in want})
    assert want == {s: int(t + 0.5) for s, t in target.items()}
    out = apply_mix(df)
    assert out.columns == df.columns
    got = dict.fromkeys(want, 0)
    for r in out.collect():
        got[r.source] += len(r.text.split())
        assert (r.key, r.extra) == (7, 8) and r.text.split()
    assert got == want
    taken = sorted((r.size, r.taken) for r in m if r.source == "b")
    assert all(t <= 3 * s for s, t in taken)
    assert apply_mix(df.limit(0)).collect() == []


def test_reruns_agree_where_ids_are_repeated(spark, tmp_path):
    """Texts of one id and one size: the same ones are taken, from whatever files and in whatever order."""
    docs = [(7, f"word{i} two three", "a" if i % 4 else "b", 5) for i in range(40)] + [(8, "x " * 50, "b", 100)] * 2
    runs = []
    for i, order in enumerate((docs, docs[::-1], sorted(docs, key=str))):
        spark.createDataFrame(order, "doc_id long, text string, source string, n_chars long").repartition(i + 1).write.parquet(str(tmp_path / f"{i}"))
        table = spark.read.parquet(str(tmp_path / f"{i}"))
        runs.append(sorted(map(tuple, mixing.apply_mix(table, share=0.6).collect())))
    assert runs[0] == runs[1] == runs[2] and 0 < len(runs[0])
