"""Plans: what is pushed down and pruned, and that small tables are left to the optimizer's own check."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import browse, metrics, ranking
from quire.plans.browsing import index
from quire.plans.registry import Tables
from quire.sources import writers


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    p = plan(metrics.rate_by(o.where("o_totalprice > 1000"), ["o_orderstatus"], F.col("o_orderpriority") == "1-URGENT"))
    assert "GreaterThan(o_totalprice,1000.0)" in p
    assert re.search(r"ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderpriority:string>", p)


def test_years_are_partitions(spark, tmp_path):
    d = spark.range(30).select(F.col("id").cast("string").alias("paper_id"), (2020 + F.col("id") % 3).cast("int").alias("year"), F.rand(1).alias("s"))
    writers.write_papers(d, str(tmp_path))
    p = plan(spark.read.parquet(str(tmp_path)).where("year = 2021").select("s"))
    assert re.search(r"PartitionFilters: \[.*year.*2021", p)


def test_pages_are_top_k(spark, sf):
    q = browse.BrowseQuery(year=2022, sort="score-desc", per=10)
    assert "TakeOrderedAndProject" in plan(browse.page(index(Tables(spark, sf)), q))


def test_ranks_are_limited_early(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    assert "WindowGroupLimit" in plan(ranking.top_k_per(o, ["o_orderstatus"], 3, F.desc("o_totalprice"), "o_orderkey"))


@pytest.mark.parametrize("field", ["score_raw"])
def test_reviews_are_read_by_field(spark, tmp_path, field):
    r = spark.createDataFrame([("a", [(1, 0.5, "long text")])], "paper_id string, reviews array<struct<score_raw:int,score_normalized:double,text:string>>")
    r.write.parquet(str(tmp_path / "p"))
    p = plan(metrics.review_rollup(spark.read.parquet(str(tmp_path / "p"))))
    schema = re.search(r"ReadSchema: .*", p).group(0)
    assert field in schema and "text" not in schema
