"""Versions of the master, the switch of maps, stamps and seeded samples."""

import json

import pytest
from helpers import rows_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire import jobs
from quire.operators import clustering, ranking
from quire.sources import snapshots


@pytest.fixture
def root(spark, tmp_path):
    d = spark.createDataFrame([(f"p{i}", 2020 + i % 4, f"t{i}", None if i % 3 else 1.5) for i in range(40)] + [("n", None, "t", 2.0), (None, 2021, "no id", 3.0)], "paper_id string, year int, title string, umap_x double")
    assert snapshots.create(d, str(tmp_path / "m")) == 1
    return str(tmp_path / "m")


def test_update_by_id(spark, root):
    before = snapshots.read(spark, root)
    old = rows_of(before.toPandas())
    kept = snapshots.manifest(root)["parts"]
    assert len(kept) == 5
    patch = spark.createDataFrame([("p1", 9.0), ("p5", None), ("zz", 1.0), ("p3", 1.5), (None, 7.0)], "paper_id string, umap_x double")
    # p5 had no value and p3 its own already: one row changes, of 2021.
    assert snapshots.update(spark, root, patch) == (2, 1)
    parts = snapshots.manifest(root)["parts"]
    assert [k for k in kept if kept[k] != parts[k]] == ["year=2021"]
    now = {r.paper_id: r.umap_x for r in snapshots.read(spark, root).collect()}
    was = {r.paper_id: r.umap_x for r in before.collect()}
    assert now == was | {"p1": 9.0} and len(now) == 42
    assert rows_of(before.toPandas()) == rows_of(snapshots.read(spark, root, 1).toPandas()) == old
    assert snapshots.update(spark, root, patch) == (2, 0)
    assert snapshots.update(spark, root, spark.createDataFrame([("n", "x")], "paper_id string, label string")) == (3, 1)
    got = {r.paper_id: (r.label, r.year) for r in snapshots.read(spark, root).collect()}
    assert got["n"] == ("x", None) and got["p1"] == (None, 2021) and len(got) == 42
    for wrong in (patch.union(patch), spark.createDataFrame([("p1", 1)], "paper_id string, year int")):
        with pytest.raises(ValueError, match="repeats|partition"):
            snapshots.update(spark, root, wrong)


def test_failed_update_changes_nothing(spark, root):
    bad = spark.createDataFrame([("p1", 1.0)], "paper_id string, umap_x double").withColumn("umap_x", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(PySparkException):
        snapshots.update(spark, root, bad)
    assert snapshots.manifest(root)["version"] == 1 and snapshots.read(spark, root).count() == 42


def test_empty_master(spark, tmp_path):
    d = spark.createDataFrame([], "paper_id string, year int")
    snapshots.create(d, str(tmp_path / "m"))
    assert snapshots.read(spark, str(tmp_path / "m")).columns == ["paper_id", "year"]
    assert snapshots.update(spark, str(tmp_path / "m"), spark.createDataFrame([("a",)], "paper_id string")) == (1, 0)
    assert snapshots.update(spark, str(tmp_path / "m"), spark.createDataFrame([("a", 1)], "paper_id string, x int")) == (2, 0)
    assert snapshots.read(spark, str(tmp_path / "m")).columns == ["paper_id", "year", "x"]
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, str(tmp_path / "other"))


def test_switch_and_stamp(spark, root, tmp_path, capsys):
    v, c, names = str(tmp_path / "v"), str(tmp_path / "c"), str(tmp_path / "l.json")
    spark.createDataFrame([(f"p{i}", i % 2) for i in range(30)], "paper_id string, cluster_id int").write.parquet(v)
    spark.createDataFrame([(f"p{i}", i / 7, 0.0) for i in range(30)], "paper_id string, x double, y double").write.parquet(c)
    (tmp_path / "l.json").write_text(json.dumps({"0": "Zero"}))
    assert jobs.main(["active", str(tmp_path / "none")]) == 1
    assert jobs.main(["switch", root, v, c, names]) == 1
    assert jobs.main(["stamp", v, names]) == 1
    (tmp_path / "l.json").write_text(json.dumps({"0": "Zero", "1": "Öne"}))
    assert jobs.main(["stamp", v, names, "--model", "m"]) == 0
    assert jobs.main(["check", v, names]) == 0
    assert json.loads((tmp_path / "l.json").read_text())["labels"] == {"0": "Zero", "1": "Öne"}
    assert jobs.main(["switch", root, v, c, names]) == 0
    got = {r.paper_id: r for r in snapshots.read(spark, root).collect()}
    assert (got["p1"].umap_x, got["p1"].cluster_id, got["p1"].cluster_label) == (0.143, 1, "Öne")
    assert got["p35"].cluster_label is None and got["n"].umap_x == 2.0
    capsys.readouterr()
    assert jobs.main(["active", root]) == 0
    assert f"version 2, coords {c}" in capsys.readouterr().out
    short = str(tmp_path / "short")
    spark.read.parquet(c).where("paper_id <> 'p7'").write.parquet(short)
    assert jobs.main(["switch", root, v, short, names]) == 1
    assert "1 vectors without coordinates, 0 coordinates" in capsys.readouterr().err
    with pytest.raises(ValueError, match="0 vectors without coordinates, 1 coordinates"):
        clustering.map_patch(spark.read.parquet(v).where("paper_id <> 'p7'"), spark.read.parquet(c), spark.createDataFrame([], "cluster_id int, label string"))


def test_seeded_sample(spark):
    d = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    a = {r.k for r in ranking.sample_each(d, "g", "k", 20, 42).collect()}
    assert a == {r.k for r in ranking.sample_each(d.repartition(7), "g", "k", 20, 42).collect()}
    assert len(a) == 60 and a != {r.k for r in ranking.sample_each(d, "g", "k", 20, 43).collect()}
    assert ranking.sample_each(d, "g", "k", 5000, 1).count() == 1000
    plan = ranking.sample_each(d, "g", "k", 20, 42)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
