"""Line deduplication: oracle, brute force, edge rows."""

import hashlib

from helpers import same_rows

from quire.llm import line_dedup
from quire.llm.line_dedup import dedup_lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(docs, least=2):
    held = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held.get(key(x), ())) < least or d == min(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def test_oracle(spark, sf):
    same_rows(spark, line_dedup.op9_line_dedup, line_dedup.OP9_SQL, sf)


def test_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(docs)]
    assert sorted(map(tuple, line_dedup.op9_line_dedup(spark, sf).collect())) == want


def test_edge_rows(spark):
    docs = [(5, "A line of TEXT\r\nshort\nÄ line that is long"), (2, "  a line of text\t\nshort"), (9, None), (8, ""), (7, "\n\n"), (3, "ä line that is long\na line of text" + "\nx" * 20_000), (2, "  a line of text\t\nshort")]
    df = spark.createDataFrame([(d, t, 0, "p", 1, "l") for d, t in docs], "doc_id long, text string, n_lines int, pos string, d int, lines string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(df).collect())
    assert got == brute(docs)
    assert dedup_lines(df.limit(0)).collect() == []


def test_null_ids_come_last(spark):
    df = spark.createDataFrame([(None, "the same long line"), (4, "the same long line")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(df).collect()} == {None: "", 4: "the same long line"}


def test_rows_of_one_id_or_none(spark):
    """Rows lose their own repeated lines only, at their own places."""
    docs = [
        (1, "a line of text\nown line one"), (7, "own line seven\na line of text"), (7, "a line of text\nanother line of seven"),
        (None, "first of none\na line of text"), (None, "a line of text\nsecond of none"), (None, "only without id\nx"), (None, "y\nonly without id"), (None, "y\nonly without id"),
    ]
    got = sorted(((r.doc_id or 0), r.text, r.n_dropped) for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    named = [(0, "first of none", 1), (0, "second of none", 1), (1, "a line of text\nown line one", 0), (7, "another line of seven", 1), (7, "own line seven", 1)]
    assert [g for g in got if "only" not in g[1] and g[1] not in ("x", "y")] == named
    # One of the texts without id keeps their common line, in all its rows.
    rest = sorted(g[1] for g in got if g not in named)
    assert rest in (["only without id\nx", "y", "y"], ["x", "y\nonly without id", "y\nonly without id"])


def test_higher_threshold(spark):
    docs = [(i, "the same long line\nown line number %d" % i) for i in range(4)] + [(9, "in two documents\nx"), (10, "in two documents\ny")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(df, min_docs=3).collect()) == brute(docs, 3)
