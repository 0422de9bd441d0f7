"""Language identification by rank-order profiles (operator 7).

A text's profile is the list of its most frequent character n-grams (one to
three letters, words set apart by one blank) in order of count; so is a
language's, over all its training texts.  The distance of a text to a language
is the sum, over the text's n-grams, of how far each is out of place in the
language's list, or the list's length where it is absent.

Training counts n-grams where the texts are read and sums them by (language,
n-gram); a language's list is cut from those sums.  The lists, ``profile`` rows
for each learned language, are all that is sent to the executors.

Defined cases: null text or one without a letter is ``und`` with score 0; so is
every text if there is nothing to learn from; equal distances go to the language
first by code point; equal counts rank by code; documents of a null language
train nothing but are predicted; whole texts count, however long; repeated rows
count and are predicted as often as they occur; a null id is held out; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm._common import read
from quire.runtime import ship

PROFILE = 400
FOLDS = 5
FLUSH = 1_000_000
NO_LETTER = re.compile(r"[\W\d_]+")
#: Numbers beyond decimal digits (fractions, superscripts, Roman numerals), which the class above takes for letters.
NUMBERS = regex.compile(r" ?(?:\p{N} ?)+")


def letters_of(text: str | None) -> str:
    """Lower-case runs of letters (categories L*), set apart by one blank."""
    letters = NO_LETTER.sub(" ", (text or "").lower())
    return (letters if letters.isascii() else NUMBERS.sub(" ", letters)).strip()


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all n-grams; a code has 21 bits for each character."""
    letters = letters_of(text)
    if not letters:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), "<u4")
    alphabet = np.unique(points)
    a, n = len(alphabet), len(points)
    at = np.searchsorted(alphabet, points)
    alphabet = alphabet.astype(np.int64)
    codes, counts = [], []
    for order in (1, 2, 3):
        local = at[: n - order + 1].astype(np.int64)
        for j in range(1, order):
            local = local * a + at[j : n - order + 1 + j]
        if not len(local):
            continue
        if a**order <= max(4096, 4 * n):
            c = np.bincount(local, minlength=1)
            u = np.flatnonzero(c)
            c = c[u]
        else:
            u, c = np.unique(local, return_counts=True)
        code, rest = np.zeros(len(u), np.int64), u
        for j in range(order):
            code |= alphabet[rest % a] << (21 * j)
            rest = rest // a
        codes.append(code)
        counts.append(c)
    code, count = np.concatenate(codes), np.concatenate(counts)
    word = code != ord(" ")
    return code[word], count[word]


def ranked(code: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes in order; of equal counts the smaller code first."""
    if len(count) > size:
        least = np.partition(count, len(count) - size)[len(count) - size]
        code, count = code[count >= least], count[count >= least]
    return code[np.lexsort((code, -count))][:size]


class Profiles:
    """The learned lists, ready for look-up."""

    def __init__(self, lists: dict[str, list[int]], size: int) -> None:
        self.langs, self.size = sorted(lists), size
        self.sorted = []
        for lang in self.langs:
            codes = np.array(lists[lang], np.int64)
            order = np.argsort(codes)
            self.sorted.append((codes[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        code, count = grams(text)
        if not len(code) or not self.langs:
            return "und", 0.0
        own = ranked(code, count, self.size)
        ranks = np.arange(len(own))
        best, lang = 2.0, "und"
        for name, (codes, order) in zip(self.langs, self.sorted, strict=True):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            off = np.where(codes[at] == own, np.abs(order[at] - ranks), self.size)
            d = float(off.mean()) / self.size
            if d < best:
                best, lang = d, name
        return lang, min(1.0, max(0.0, 1.0 - best))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, ``profile`` codes each at most."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(sums)], ["lang", "code", "n"])

        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                pair = grams(body.as_py())
                held.setdefault(name, []).append(pair)
                size += len(pair[0])
                if size > FLUSH:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    ship(docs.sparkSession)
    counted = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, code long, n long")
    sums = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    lists: dict[str, list[int]] = {}
    for r in sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile).orderBy("lang", "rank").toLocalIterator():
        lists.setdefault(r.lang, []).append(r.code)
    return lists


def identify(docs: DataFrame, lists: dict[str, list[int]], *, doc_id: str = "doc_id", text: str = "text", profile: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score (1 less the mean distance out of place, 0 to 1)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(lists)
    kind = docs.schema[doc_id].dataType.simpleString()

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(sent.value, profile)
        for b in batches:
            found = [profiles.predict(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lists = learn(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), lists)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
