"""Digests against Python's own Unicode functions and the neighbours by plain sorting."""

import hashlib
import re
import unicodedata

import pytest

from quire.llm import fingerprints
from quire.llm.fingerprints import fingerprint, op5_fingerprints


def canon(t):
    x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"[\s  ]+", " ", x).strip(" ")


def brute(docs):
    docs = sorted(docs, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + nxt[:k]
        same = [x for x, u in docs if canon(u) == canon(t)]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(t) == canon(edited)), float(canon(t) == canon(nxt)), min(same), len(same))
    return out


@pytest.mark.parametrize("rows", [4_000, 16])
def test_query_against_brute_force(spark, sf, monkeypatch, rows):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", rows)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op5_fingerprints(spark, sf).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.class_id, r.copies) for r in got} == brute(docs)
    of = dict(docs)
    assert len({r.fingerprint for r in got}) == len({canon(t) for t in of.values()})


def test_canonical_forms_and_edge_rows(spark):
    rows = [(1, "Straße  Ａ\n"), (2, "STRASSE a"), (3, "é"), (4, "É"), (5, None), (6, ""), (7, " \t"), (8, "ﬁn"), (8, "FIN"), (None, "x")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, canon int")
    got = fingerprint(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert sorted(map(sorted, (x for x in by.values() if None not in x))) == [[1, 2], [3, 4], [5, 6, 7], [8]]
    assert {r.doc_id: r.copies for r in got if r.doc_id} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3, 6: 3, 7: 3, 8: 2}
    assert fingerprint(df.limit(0)).collect() == []


def test_collisions_are_told_apart_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "digest", lambda c: (F.lit(1).cast("long"), F.lit(2).cast("long")))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "c")], "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.copies) for r in fingerprint(df).collect()} == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}
