"""One-document sinks: order, sections, aborted writes, the browse index and exports as files."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire.operators import browse, metrics
from quire.schemas import PAPERS
from quire.sources import document, readers, writers


def test_array_in_order(spark, tmp_path):
    n = 200_000
    d = spark.range(n).repartition(7).select(F.col("id"), F.concat(F.lit('é "x"\n'), F.col("id").cast("string")).alias("t"), F.when(F.col("id") % 2 == 0, F.col("id") / 4).alias("x"))
    path = str(tmp_path / "a.json")
    document.write_json_array(d, path, F.desc("id"))
    text = (tmp_path / "a.json").read_text(encoding="utf-8")
    got = json.loads(text)
    assert [r["id"] for r in got] == list(range(n - 1, -1, -1))
    assert got[0] == {"id": n - 1, "t": f'é "x"\n{n - 1}', "x": None} and got[1]["x"] == (n - 2) / 4
    assert text == json.dumps(got, indent=2, ensure_ascii=False) + "\n"
    assert [p.name for p in tmp_path.iterdir()] == ["a.json"]


def test_empty_and_compact(spark, tmp_path):
    path = str(tmp_path / "a.json")
    document.write_json_array(spark.createDataFrame([], "a int"), path)
    assert (tmp_path / "a.json").read_text() == "[]\n"
    document.write_json_array(spark.createDataFrame([(1, None), (2, "b")], "a int, b string").coalesce(1), path, "a", pretty=False, nulls=False)
    assert (tmp_path / "a.json").read_text() == '[{"a":1},\n{"a":2,"b":"b"}]\n'


def test_sections(spark, tmp_path):
    sections = [document.section('{"a":[', ",", "],"), document.section('"b":[', ",", "],"), document.section('"c":{', ",", "}}")]
    rows = spark.range(1000).select(F.when(F.col("id") < 10, 0).otherwise(2).alias("section"), "id", F.when(F.col("id") < 10, F.col("id").cast("string")).otherwise(F.format_string('"%d":%d', "id", "id")).alias("value"))
    path = str(tmp_path / "s.json")
    document.write_document(rows.repartition(5).orderBy("section", "id"), path, sections)
    got = json.loads((tmp_path / "s.json").read_text())
    assert got["a"] == list(range(10)) and got["b"] == [] and list(got["c"].values()) == list(range(10, 1000))
    with pytest.raises(PySparkException):
        document.write_document(rows.coalesce(1).orderBy(F.col("id") % 2, "id"), path, sections)
    assert json.loads((tmp_path / "s.json").read_text()) == got


def test_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(1000).repartition(4).select(F.lit(0).alias("section"), F.when(F.col("id") == 777, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(PySparkException):
        document.write_document(bad, str(tmp_path / "x.json"), [document.section("[", ",", "]")])
    assert list(tmp_path.iterdir()) == []
    one = spark.range(3).select(F.lit(0).alias("section"), F.col("id").cast("string").alias("value")).coalesce(1)
    document.write_document(one, str(tmp_path / "x.json"), [document.section("[", ",", "]")], replace=False)
    with pytest.raises(PySparkException):
        document.write_document(one, str(tmp_path / "x.json"), [document.section("<", ",", ">")], replace=False)
    assert (tmp_path / "x.json").read_text() == "[0,1,2]" and len(list(tmp_path.iterdir())) == 1


@pytest.fixture
def papers(spark, tmp_path):
    rows = [
        {"paper_id": f"p{i:02d}", "year": 2022 + i % 3, "title": f'Títle "{i}"', "authors": ["Doe, Jane"], "subject_areas": [["B", "A"], [], ["Ü", "B"], None][i % 4],
         "reviews": [{"score_raw": 4, "score_max": 6}], "avg_score_raw": 4.0 + i % 5, "avg_score_normalized": 0.6, "presentation_type": ["oral", "poster"][i % 2]}
        for i in range(24)
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/papers.json").write_text(json.dumps(rows))
    return spark.read.schema(PAPERS).json(str(tmp_path / "in/papers.json"), multiLine=True)


def test_index_file(spark, papers, tmp_path):
    index, scales = browse.browse_index(papers), metrics.scales(papers)
    path = str(tmp_path / "index.json")
    writers.write_index(index, scales, 'b"1', path)
    got = json.loads((tmp_path / "index.json").read_text(encoding="utf-8"))
    assert got["built"] == 'b"1' and got["areas"] == ["A", "B", "Ü"] and got["scales"] == {"2022": 6, "2023": 6, "2024": 6}
    assert [p["id"] for p in got["papers"]] == [f"p{i:02d}" for i in range(24)]
    assert [p["areas"] for p in got["papers"][:4]] == [[1, 0], [], [2, 1], []]
    assert got["papers"][0]["type"] == browse.TYPE_NAMES.index("oral") and got["papers"][0]["early"] == 0 and "doi" not in got["papers"][0]
    back = {r.id: r for r in readers.index_json(spark, path).collect()}
    assert back["p02"].areas == ["Ü", "B"] and back["p02"].title == 'Títle "2"'
    writers.write_index(index.where("false"), scales.where("false"), "b", path)
    assert json.loads((tmp_path / "index.json").read_text()) == {"built": "b", "areas": [], "scales": {}, "papers": []}


def test_export_file(spark, papers, tmp_path):
    index, scales = browse.browse_index(papers), metrics.scales(papers)
    q = browse.BrowseQuery(year=2022, type="oral", sort="score-desc")
    writers.write_export(index, q, scales, "b", "e", str(tmp_path / "x.json"), link="l")
    got = json.loads((tmp_path / "x.json").read_text(encoding="utf-8"))
    held = browse.rows(index, q).select("id").collect()
    assert [p["paper_id"] for p in got["papers"]] == [r.id for r in held] and got["count"] == len(held) == 4
    assert list(got) == ["link", "exported", "index_built", "filters", "sort", "count", "total_papers", "review_scale_max_by_year", "papers"]
    assert got["filters"] == {"year": 2022, "presentation_type": "oral"} and got["total_papers"] == 24 and got["review_scale_max_by_year"]["2023"] == 6
    assert got["papers"][0]["scale_max"] == 6 and "doi" not in got["papers"][0]
