"""Text functions on hand-written values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_titles(spark):
    got = apply(spark, T.normalize_title, ["Ｄeep—Learning: “Über” ﬁne", "", None, "A  B"])
    assert got == ["deep learning uber fine", "", None, "a b"]
    assert apply(spark, T.normalize_title_casefold, ["Straße"]) == ["strasse"]
    assert apply(spark, T.searchable, ["Ångström É", None]) == ["angstrom e", ""]


def test_verdicts(spark):
    assert apply(spark, T.verdict, ["Weak Accept — could", "Reject", " Accept-x", None, ""]) == ["Weak Accept", "Reject", "Accept", None, None]
    assert apply(spark, T.verdict_lower, ["Weak Accept; could be"]) == ["weak accept; could be"]
    assert apply(spark, T.verdict_rank, ["Strong Accept", "reject", None]) == [5, None, None]
    assert apply(spark, T.confidence_level, ["  Very   CONFIDENT", "unknown", None]) == [4, None, None]
    assert apply(spark, T.int_in_parens, ["(4) x", "4", None]) == [4, None, None]
    assert apply(spark, T.bare_int, [" 7 ", "7a", None]) == [7, None, None]
    assert apply(spark, T.label_without_score, ["(4) Weak Accept, ", "(1)"]) == ["Weak Accept", None]


def test_subjects(spark):
    labels = ["Modalities -> CT", "A - Heart", "Other", " Deep learning ", "Skin", "X -> Y -> Z"]
    assert apply(spark, T.canonical_subject, labels) == ["CT / X-Ray", "Cardiac", None, None, "Skin", "Y -> Z"]
    assert apply(spark, T.area_leaf, ["A -> B -> C", "D"]) == ["C", "D"]


@pytest.mark.parametrize(("name", "want"), [
    ("Yi Yu", ("Yu, Yi", "particle")), ("Won Hwa Kim", ("Kim, Won Hwa", "particle")), ("Bram van Ginneken", ("van Ginneken, Bram", "particle")),
    ("Ana  de la Cruz", ("de la Cruz, Ana", "particle")), ("Madonna", ("Madonna", "single")), ("", ("", "empty")), ("  ", ("", "empty")), ("Van Gogh", ("Gogh, Van", "particle")),
])
def test_names(spark, name, want):
    r = apply(spark, T.last_first, [name])[0]
    assert (r["name"], r["rule"]) == want


def test_people(spark):
    assert apply(spark, T.speaker_surname, ["Lei Ma, Tongji University", "Jürgen  Müller", None]) == ["ma", "muller", None]
    assert apply(spark, T.author_surnames, [["Müller, J", "O'Neil, A", " , x"], None], "array<string>") == [["muller", "o neil"], []]
    p = apply(spark, T.presenter, ["A B, Lab, Inst, France", "A B, Lab", "A B", None])
    assert [tuple(x) for x in p] == [("A B", "Lab, Inst", "France"), ("A B", "Lab", None), ("A B", None, None), (None, None, None)]


def test_lines(spark):
    assert apply(spark, T.join_lines, [["semi-", "supervised  x", " y"], [], ["a"]], "array<string>") == ["semi-supervised x y", "", "a"]
    assert apply(spark, T.is_bold, ["Times-Bold", "ArialBlack", "Fbd", "Roman"]) == [True, True, True, False]


def test_words(spark):
    assert apply(spark, T.word_count, [" a  b ", "", "x"]) == [2, 0, 1]
    assert apply(spark, T.first_word, ["SAM: segment", "the x"]) == ["sam", "the"]
    assert apply(spark, lambda c: T.any_pattern(c, T.BUZZWORDS["Transformers / ViT"]), ["A Swin net", "vital"]) == [True, False]
    assert apply(spark, lambda c: T.chars_without_space(c, c), ["a b\n", None]) == [4, 0]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=25), st.text("abcd", max_size=25))
def test_similarity_is_the_common_subsequence(a, b):
    want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
    assert T.indel_ratio(a, b) == pytest.approx(want)
