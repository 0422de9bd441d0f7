"""Language identification: held-out accuracy, profiles by brute force, edge rows."""

import re
import unicodedata
import zlib
from collections import Counter

from quire.llm import language
from quire.llm.language import Profiles, grams, identify, learn, ranked


def plain_grams(text):
    s = f" {re.sub(r'[^a-z]+', ' ', text.lower()).strip()} "
    c = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    del c[" "]
    return c


def decode(code):
    out = ""
    while code:
        out = chr(code & (1 << 21) - 1) + out
        code >>= 21
    return out


def test_grams_against_a_counter():
    for t in ("The theatre, the 3 thieves!", "a", "ab ab ab", "x" * 9000, "the quick brown fox " * 500):
        code, count = grams(t)
        assert {decode(int(c)): int(n) for c, n in zip(code, count, strict=True)} == dict(plain_grams(t))


def test_ranks_are_by_count_then_code():
    code, count = grams("banana bandana cabana")
    want = sorted(zip(code.tolist(), count.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    assert ranked(code, count, 7).tolist() == [c for c, _ in want[:7]]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()}
    got = language.op7_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) / len(held) >= 0.98


def test_distances_and_winners_against_brute_force(spark, sf):
    """Lists, distances out of place and winners of the whole table, plainly."""
    size = 120
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    plain = {r.doc_id: Counter(x for x in plain_words(r.text)) for r in rows}
    trained = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            trained.setdefault(r.lang, Counter()).update(plain[r.doc_id])
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code_of(x[0])))[:size]]
    places = {lang: {g: i for i, g in enumerate(order(c))} for lang, c in trained.items()}
    lists = learn(docs.where(~language.held_out(docs.doc_id)), profile=size)
    assert {lang: [decode(c) for c in codes] for lang, codes in lists.items()} == {lang: list(p) for lang, p in places.items()}
    got = {r.doc_id: r for r in identify(docs, lists, profile=size).collect()}
    for r in rows:
        own = order(plain[r.doc_id])
        if not own:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        away = {lang: sum(abs(i - p[g]) if g in p else size for i, g in enumerate(own)) for lang, p in places.items()}
        best = min(sorted(away), key=away.get)
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - (1 - away[best] / len(own) / size)) < 1e-9


def code_of(gram):
    """Last character in the lowest 21 bits."""
    return sum(ord(c) << (21 * j) for j, c in enumerate(reversed(gram)))


def plain_words(text):
    """All n-grams of the runs of letters of a text, each run between blanks."""
    s = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    s = f" {' '.join(s.split())} "
    if not s.strip():
        return
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            if s[i : i + n] != " ":
                yield s[i : i + n]


def test_letters_are_of_the_letter_categories(spark):
    lists = {"en": [ord(c) for c in "etaoin"], "fr": [ord(c) for c in "esaitn"]}
    texts = ["\u00b2", "\u00bd", "\u2167", "\u2460", "\u0663", "\u0301", "_", "1st\u00bd", "\u00aa", "\u4e2d", "\u00b2\u00b2 e \u2167"]
    got = [r.lang_pred for r in identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lists).collect()]
    assert [g == "und" for g in got] == [not any(unicodedata.category(c)[0] == "L" for c in t) for t in texts]
    assert language.letters_of("A\u00bd \u2167b_3\u00c9") == "a b \u00e9"


def test_edge_rows(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the dog", "en"), ("la maison et le chien", "fr"), (None, "en"), ("", "fr"), ("no label", None)])]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    lists = learn(df)
    assert set(lists) == {"en", "fr"}
    asked = spark.createDataFrame([(1, None, 0), (2, "12 34 !", 0), (3, "the dog " * 50_000, 0), (3, "the dog", 0), (None, "le chien", 0), (4, "ΩΩ", 0)], "doc_id long, text string, score int")
    got = [(r.doc_id, r.lang_pred, r.score) for r in identify(asked, lists).collect()]
    assert got[0] == (1, "und", 0.0) and got[1] == (2, "und", 0.0)
    assert [g[1] for g in got[2:5]] == ["en", "en", "fr"] and got[5][1] in ("en", "fr")
    assert identify(asked.limit(0), lists).collect() == []
    assert learn(df.limit(0)) == {} and Profiles({}, 10).predict("x") == ("und", 0.0)
