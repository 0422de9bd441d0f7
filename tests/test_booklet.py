"""Booklets: poster tables and talk pages against a reader that goes line by line, and against wrapped cases."""

import json
import random
import re

import pytest
from helpers import same_rows

from quire import jobs
from quire.operators import booklet
from quire.plans.catalog import ORACLE_SQL, QUERIES
from quire.schemas import LINES


def frame(spark, lines):
    """(doc, page, col, text, bold, size) in order."""
    return spark.createDataFrame([(d, p, c, i, t, float(s), 0.0, 0.0, b, False, False) for i, (d, p, c, t, b, s) in enumerate(lines)], LINES)


@pytest.mark.parametrize("name", ["booklet_posters", "booklet_names", "booklet_talks", "booklet_program", "line_roles"])
def test_oracle(spark, sf, name):
    same_rows(spark, QUERIES[name], ORACLE_SQL[name], sf)


def glued(parts):
    out = ""
    for p in (" ".join(x.split()) for x in parts):
        out += p if not out or out.endswith("-") or not p else f" {p}"
    return out


def posters_by_line(lines):
    """What each line does to the record that is open, one after another."""
    records, waiting, open_, field, address = [], [], None, "", False
    for text, bold in ((t.strip(), b) for t, b in lines):
        row = re.match(booklet.POSTER_ROW, text)
        blank = not text or re.match(booklet.POSTER_HEADINGS, text)
        if address and not (bold or blank or row):
            open_["presenter"].append(text)
            continue
        address = False
        if blank:
            continue
        if row:
            open_ = {"number": row[1], "title": [*waiting, row[4]], "authors": [], "presenter": []}
            records.append(open_)
            waiting, field = [], "title"
        elif open_ and (m := re.match(booklet.POSTER_AUTHORS, text)):
            field = "authors"
            open_[field].append(m[1])
        elif open_ and (m := re.match(booklet.POSTER_PRESENTER, text)):
            field, address = "presenter", True
            open_[field].append(m[1])
        elif open_ is None or field == "presenter":
            waiting.append(text)
        else:
            open_[field].append(text)
    return [(int(r["number"]), glued(r["title"]), glued(r["authors"]), glued(r["presenter"])) for r in records]


def test_posters_against_line_by_line(spark):
    r = random.Random(1)
    texts = ["7 2 M-AM-001 Some title", "12 1 W-PM-010", "Authors: Ann Lee, Bo-", "author : Cy", "Presenter: Dee, Lab,", "Speakers: Eve", "Board", "paper id ", "", "plain words", "more-", "France", "Poster"]
    docs = {f"d{k}": [(r.choice(texts), r.random() < 0.35) for _ in range(r.randint(1, 60))] for k in range(60)}
    got = {}
    d = booklet.poster_records(frame(spark, [(k, 1 + i // 9, 0, t, b, 11) for k, v in docs.items() for i, (t, b) in enumerate(v)]), year=2026, venue="v")
    for x in d.collect():
        got.setdefault(x.doc, []).append((x.paper_id, x.title, x.presenter_affiliation, x.presenter_country))
    for k, v in docs.items():
        want = []
        for number, title, _, who in posters_by_line(v):
            parts = [p.strip() for p in who.split(",") if p.strip()]
            want.append((f"v-2026-Paper{number:04d}", title, ", ".join(parts[1:-1] if len(parts) > 2 else parts[1:]), parts[-1] if len(parts) > 2 else ""))
        assert sorted(got.get(k, [])) == sorted(want), v


def test_title_above_the_row_and_a_tail(spark):
    rows = [
        ("Deep learning for the segmentation of", True), ("12 1 M-AM-012 very small hearts", True), ("and lungs", True), ("Authors: Ann van der Lee, Bo", False), ("Chi", False), ("Presenter: Ann van der Lee, Lab, Inst, United", False),
        ("Kingdom", False), ("Next title", True), ("Paper ID", False), ("13 2 W-PM-200", False), ("Author : Solo", False), ("Presenters: Kun & Haochao", False),
    ]
    d = booklet.poster_records(frame(spark, [("d", 11 + i // 7, 0, t, b, 11) for i, (t, b) in enumerate(rows)] + [("d", 3, 0, "1 1 M-AM-001 on a talk page", True, 11)]), year=2026, venue="conf", first_page=11)
    got = {x.paper_id: x for x in d.collect()}
    a, b = got["conf-2026-Paper0012"], got["conf-2026-Paper0013"]
    assert (a.title, a.authors, a.year, a.poster_session, a.board_number) == ("Deep learning for the segmentation of very small hearts and lungs", ["van der Lee, Ann", "Chi, Bo"], 2026, 1, "M-AM-012")
    assert (a.presenter, a.presenter_affiliation, a.presenter_country) == ("van der Lee, Ann", "Lab, Inst", "United Kingdom")
    assert (b.title, b.authors, b.presenter, b.presenter_affiliation, b.presenter_country) == ("Next title", ["Solo"], "Haochao, Kun &", "", "") and len(got) == 2


def talks_by_line(lines):
    """Talks in the order in which they end, from lines (col, text, bold, size) in page order."""
    cols, out = {}, []

    def end(s):
        if s["title"]:
            out.append((glued(s["title"]), s["kind"], s["session"]))
        s.update(title=[], spoken=False)

    for col, text, bold, size in lines:
        if not text or size >= booklet.BANNER_SIZE:
            continue
        s = cols.setdefault(col, {"session": "", "kind": "oral", "title": [], "spoken": False, "naming": False})
        marker = next((k for k, p in (("oral", booklet.ORAL_MARKER), ("spotlight", booklet.SPOTLIGHT_MARKER)) if re.match(p, text)), None)
        if size >= booklet.SESSION_SIZE:
            if re.match(booklet.SESSION_HEAD, text):
                end(s)
                s.update(session="", kind="oral", naming=True)
            elif bold and s["naming"]:
                s["session"] = f"{s['session']} {text}".strip()
        elif size < booklet.BODY_SIZE:
            s["naming"] = False
            if marker or (bold and s["spoken"]):
                end(s)
            if marker:
                s["kind"] = marker
            elif bold:
                s["title"].append(text)
            else:
                s["spoken"] = True
    for s in cols.values():
        end(s)
    return out


def test_talks_against_line_by_line(spark):
    r = random.Random(2)
    kinds = [("Oral Session O1", False, 12), ("Oral & Spotlight Session X", True, 12), ("Theme", True, 12), ("wrapped", True, 11.54), ("stamp", False, 12), ("Room", False, 11), ("Day", True, 14), ("Oral Presentations:", False, 10), ("Spotlight Presentation", True, 10), ("", True, 10)]
    body = [("A title", True, 10), ("that wraps-", True, 10.4), ("Ann Lee", False, 10)]
    docs = {}
    for k in range(50):
        lines = [(p, c, *r.choice(kinds if r.random() < 0.3 else body)) for p in range(1, r.randint(2, 5)) for c in range(3) for _ in range(r.randint(0, 9))]
        docs[f"d{k}"] = lines
    got = {}
    for x in booklet.talk_records(frame(spark, [(k, *x) for k, v in docs.items() for x in v])).orderBy("doc", "ord").collect():
        got.setdefault(x.doc, []).append((x.title, x.presentation_type, x.oral_session))
    for k, v in docs.items():
        assert got.get(k, []) == talks_by_line([x[1:] for x in v]), v


def test_session_goes_on_in_its_column_of_the_next_page(spark):
    rows = [
        (2, 0, "Oral Session O1", True, 12), (2, 0, "Hearts", True, 12), (2, 0, "First", True, 10), (2, 0, "Ann", False, 10), (2, 1, "Oral Session O2", True, 12), (2, 1, "Lungs &", True, 12), (2, 1, "Livers", True, 12), (2, 1, "Second in", True, 10),
        (3, 0, "Spotlight Presentations:", False, 10), (3, 0, "Third", True, 10), (3, 0, "Bo", False, 10), (3, 1, "two lines", True, 10), (3, 1, "Cy", False, 10),
    ]
    talks = booklet.talk_records(frame(spark, [("d", *x) for x in rows]))
    assert [(x.title, x.presentation_type, x.oral_session) for x in talks.orderBy("ord").collect()] == [("First", "oral", "Hearts"), ("Third", "spotlight", "Hearts"), ("Second in two lines", "oral", "Lungs & Livers")]
    doc = booklet.talks_program(talks, 2026, "x.pdf").first()
    assert (doc.n_sessions, doc.n_presentations) == (2, 3) and [(s.session_id, s.session_title, [p.order for p in s.presentations]) for s in doc.sessions] == [("1", "Hearts", [1, 2]), ("2", "Lungs & Livers", [1])]


def words(page, x, top, text, size, font="Regular"):
    return [("b", page, w, font, float(size), x + 30.0 * i, x + 30.0 * i + 25, float(top), 600.0) for i, w in enumerate(text.split())]


def test_program_job(spark, tmp_path, capsys):
    from quire.schemas import WORDS

    rows = []
    for col, (session, title) in enumerate([("Hearts", "Small hearts"), ("Lungs", "Big lungs"), ("Livers", "Old livers")]):
        x = 10.0 + 200 * col
        for top, text, size, font in ((10, f"Oral Session O{col}", 12, "Regular"), (30, session, 12, "Bold"), (50, title, 10, "Bold"), (70, "Ann Lee", 10, "Regular")):
            rows += words(1, x, top, text, size, font)
    for i, title in enumerate(["Small hearts", "Big lungs", "Old livers", "Only shown"]):
        top = 100 * i + 10
        rows += words(2, 10.0, top, f"{i + 1} 1 M-AM-00{i} {title}", 11, "Bold") + words(2, 10.0, top + 20, "Authors: Ann Lee", 11) + words(2, 10.0, top + 40, "Presenter: Ann Lee, Lab, Chile", 11)
    spark.createDataFrame(rows, WORDS).write.parquet(str(tmp_path / "words"))
    run = ["program", str(tmp_path / "words"), str(tmp_path / "out"), "--year=2026", "--posters=2", "--venue", "conf"]
    assert jobs.main([*run, "--orals=3"]) == 0
    got = {r.title: (r.paper_id, r.presentation_type, r.oral_session, r.authors) for r in spark.read.json(str(tmp_path / "out/papers")).collect()}
    assert got["Big lungs"] == ("conf-2026-Paper0002", "oral", "Lungs", ["Lee, Ann"]) and got["Only shown"][1:3] == ("poster", "")
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out/talks").glob("part-*"))))
    assert [(s["session_title"], [p["title_raw"] for p in s["presentations"]]) for s in doc["sessions"]] == [("Hearts", ["Small hearts"]), ("Lungs", ["Big lungs"]), ("Livers", ["Old livers"])]
    assert jobs.main([*run, "--orals=4"]) == 1 and "expected 4" in capsys.readouterr().err
