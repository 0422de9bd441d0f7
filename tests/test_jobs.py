"""Jobs end to end on small files."""

import json

import pytest

from quire import jobs
from quire.operators import browse, clustering, metrics
from quire.schemas import PAPERS
from quire.sources import readers, writers


@pytest.fixture
def raw(tmp_path):
    r = {"score_raw": 4, "score_max": 6, "score_normalized": 0.6}
    for y in (2022, 2025):
        rows = [{"paper_id": f"{y}-{i}", "year": y, "title": f"Title number {i} of {y}", "abstract": "words about hearts" if i % 2 else "text on lungs", "authors": ["Doe, Jane"], "subject_areas": ["A -> B"], "reviews": [r], "avg_score_raw": 4.0 + i, "avg_score_normalized": 0.6, "presentation_type": ["oral", "poster"][i % 2]} for i in range(8)]
        (tmp_path / f"papers_{y}.json").write_text(json.dumps([*rows, {"paper_id": "x", "url": "u", "error": "e"}]))
    return tmp_path


def test_normalise_match_and_export(spark, raw, capsys):
    out = str(raw / "t")
    assert jobs.main(["normalise", str(raw / "none_*.json"), out]) == 1
    assert jobs.main(["normalise", str(raw / "papers_*.json"), out]) == 0
    assert "16 papers, 2 errors" in capsys.readouterr().out
    papers = str(raw / "p")
    spark.read.schema(PAPERS).json(str(raw / "papers_*.json"), multiLine=True).where("error IS NULL").write.parquet(papers)
    talk = lambda t, n: {"type": "oral", "title_raw": t, "authors_raw": [], "order": n}
    prog = {"year": 2022, "sessions": [{"session_id": "1", "session_title": "S", "presentations": [talk("Title number 3 of 2022", 1), talk("TITLE NUMBER 4 of 2022!", 2)]}]}
    (raw / "prog.json").write_text(json.dumps(prog))
    assert jobs.main(["match", str(raw / "prog.json"), papers, str(raw / "m"), "--json", str(raw / "talks.json")]) == 0
    assert json.loads((raw / "talks.json").read_text())["summary"]["2022"]["matched"] == 2
    assert {(r.paper_id, r.type, r.session_id) for r in readers.talks_json(spark, str(raw / "talks.json")).collect()} == {("2022-3", "oral", "1"), ("2022-4", "oral", "1")}
    assert {r.paper_id for r in spark.read.parquet(str(raw / "m")).collect()} == {"2022-3", "2022-4"}
    prog["sessions"][0]["presentations"].append(talk("Something else entirely", 3))
    (raw / "prog.json").write_text(json.dumps(prog))
    capsys.readouterr()
    assert jobs.main(["match", str(raw / "prog.json"), papers, str(raw / "m"), "--report"]) == 1
    assert '"Something else entirely": null  #' in capsys.readouterr().out
    assert jobs.main(["export", papers, str(raw / "csv"), "year=2022&sort=score-desc"]) == 0
    lines = "".join(p.read_text() for p in sorted((raw / "csv").glob("part-*"))).replace("﻿", "").split("\n")
    assert sum("Title number" in x for x in lines) == 8
    assert jobs.main(["export", papers, str(raw / "q.json"), "year=2022&sort=score-desc", "--format", "json"]) == 0
    assert [p["title"] for p in json.loads((raw / "q.json").read_text())["papers"]] == [f"Title number {i} of 2022" for i in range(8)]  # equal scores: by id
    assert jobs.main(["export", papers, str(raw / "i.json"), "--format", "index"]) == jobs.main(["export", papers, str(raw / "a.json"), "--format", "array"]) == 0
    assert len(json.loads((raw / "i.json").read_text())["papers"]) == len(json.loads((raw / "a.json").read_text())) == 16
    assert jobs.main(["export", papers, str(raw / "n"), "--format", "none"]) == 1


def test_effects_and_documents(spark, raw):
    papers = spark.read.schema(PAPERS).json(str(raw / "papers_*.json"), multiLine=True).where("error IS NULL")
    got = metrics.effects(papers, "avg_score_raw").collect()
    assert {(r.year, r.comparison, r.n_a, r.n_b) for r in got} == {(2022, "oral vs poster", 4, 4), (2025, "oral vs poster", 4, 4)}
    assert got[0].delta == -0.25
    assert metrics.with_strata(papers, papers.presentation_type == "oral").groupBy("stratum").count().count() == 3
    index, scales = browse.browse_index(papers), metrics.scales(papers)
    writers.write_export(index, browse.BrowseQuery(year=2025, type="oral", sort="score-desc"), scales, "b", "e", str(raw / "x.json"))
    doc = json.loads((raw / "x.json").read_text())
    assert doc["filters"] == {"year": 2025, "presentation_type": "oral"} and doc["count"] == 4 and doc["total_papers"] == 16
    assert [p["paper_id"] for p in doc["papers"]] == sorted(p["paper_id"] for p in doc["papers"])
    writers.write_index(index, scales, "b", str(raw / "index.json"))
    back = readers.index_json(spark, str(raw / "index.json")).collect()
    assert len(back) == 16 and back[0].areas == ["A -> B"] and back[0].scale == 6


def test_clusters(spark, tmp_path, capsys):
    v = spark.createDataFrame([(f"p{i}", [float(i % 2) * 9, float(i)], i) for i in range(12)], "paper_id string, embedding array<float>, ord long")
    v.write.parquet(str(tmp_path / "v"))
    assert jobs.main(["cluster", str(tmp_path / "v"), str(tmp_path / "c"), "--k", "2"]) == 0
    stamp = capsys.readouterr().out.split()[-1]
    c = spark.read.parquet(str(tmp_path / "c"))
    assert stamp == clustering.partition_stamp(c).first().fingerprint
    (tmp_path / "l.json").write_text(json.dumps({"labels": {"0": "A", "1": "B"}, "clustering": stamp}))
    assert jobs.main(["check", str(tmp_path / "c"), str(tmp_path / "l.json")]) == 0
    (tmp_path / "l.json").write_text(json.dumps({"labels": {"0": "A"}, "clustering": "other"}))
    assert jobs.main(["check", str(tmp_path / "c"), str(tmp_path / "l.json")]) == 1
    spark.createDataFrame([("q", [9.0, 3.0], 1)], "paper_id string, embedding array<float>, ord long").write.parquet(str(tmp_path / "n"))
    assert jobs.main(["extend", str(tmp_path / "c"), str(tmp_path / "n"), stamp, str(tmp_path / "e")]) == 0
    assert spark.read.parquet(str(tmp_path / "e")).count() == 13
