"""Quality rules: oracle, base counts by brute force, accuracy on labels, edge rows."""

import re
from collections import Counter

from helpers import same_rows

from quire.llm import quality
from quire.llm.quality import judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    wins = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_oracle(spark, sf):
    same_rows(spark, quality.op2_quality_rules, quality.OP2_SQL, sf)


def test_base_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[1:7]) for r in quality.op2_quality_rules(spark, sf).collect()}
    assert got == {r.doc_id: base(r.text) for r in docs}


def test_good_documents_stay_and_bad_ones_go(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op2_quality_rules(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not got[r.doc_id].base_failed]
    good = [got[r.doc_id].kept for r in labels if r.quality == 1]
    bad = [got[r.doc_id].kept for r in labels if r.quality == 0]
    assert sum(good) / len(good) >= 0.99 and sum(bad) / len(bad) <= 0.2


def test_edge_rows(spark):
    texts = [None, "", " \n\t", "one", "a b", "a b c a b c", "x " * 30_000, "é\u00a0ß " * 60, "l\nl\n\nl  \n \nq", "a b c\n" * 40, "# * $ % & | < >" * 9]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", i, True) for i, t in enumerate(texts)] + [(None, "no id", "en", 0, True)] * 2, "doc_id long, text string, lang string, n int, kept boolean")
    got = judge(df, min_reference=1).collect()
    assert len(got) == len(texts) + 2
    assert {r.doc_id: tuple(r[1:7]) for r in got if r.doc_id is not None} == {i: base(t) for i, t in enumerate(texts)}
    assert all(not r.kept for r in got if r.base_failed)
    assert judge(df.limit(0)).collect() == []
