"""The pipeline's stages against brute force on a small table."""

import corpus_pipeline
from llm.test_line_dedup import brute as plain_lines
from llm.test_near_duplicates import brute as plain_near
from llm.test_packing import check as check_packing

from quire.llm._common import materialize
from quire.llm.mixing import mix
from quire.llm.quality import judge


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in judge(docs).where("kept").collect()}
    a = stage["quality rules"](spark, docs, sf).cache()
    assert a.columns == names and {r.doc_id for r in a.collect()} == kept
    b = stage["line dedup"](spark, a, sf).cache()
    assert b.columns == names
    rows = [(r.doc_id, r.text) for r in a.collect()]
    assert {r.doc_id: r.text for r in b.collect()} == {d: t for d, _, _, t in plain_lines(rows)}
    assert all(r.n_chars == len(r.text) for r in b.collect())
    c = stage["near-duplicate join"](spark, b, sf).cache()
    groups = plain_near([(r.doc_id, r.text) for r in b.collect()])
    assert c.columns == names and {r.doc_id for r in c.collect()} == {root for root, _ in groups.values()}
    d = stage["source mix"](spark, c, sf).cache()
    assert d.columns == names
    taken = {r.doc_id: r.taken for r in mix(c).collect()}
    words = {}
    for r in d.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {k: v for k, v in taken.items() if v}
    whole = d.dropDuplicates(["doc_id"])
    check_packing([r.asDict() for r in stage["packing"](spark, whole, sf).collect()], [(r.doc_id, r.text) for r in whole.collect()])


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_empty_table_and_nulls(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "n_chars")
    odd = odd.unionByName(docs.limit(3).selectExpr("doc_id + 100000 AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars"))
    for d in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, sf).cache()
            d.count()


def test_ids_do_not_matter(spark, sf):
    """Without ids, or with one for all, the filters keep the same texts as with unique ids."""
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda d: sorted(r.text for r in d.select("text").collect())
    want = texts(stage["quality rules"](spark, docs, sf))
    for same in ("CAST(NULL AS BIGINT)", "CAST(5 AS BIGINT)"):
        odd = docs.selectExpr(f"{same} AS doc_id", "text", "lang", "source", "n_chars")
        good = materialize(stage["quality rules"](spark, odd, sf))
        assert texts(good) == want
        groups = plain_near(list(enumerate(want)))
        assert stage["near-duplicate join"](spark, good, sf).count() == len({root for root, _ in groups.values()})
