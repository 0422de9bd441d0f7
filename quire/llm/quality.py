"""Quality rules by distribution divergence (operator 2), DataFrame functions only.

Each document gives two histograms: of character classes and of common
function words.  Each language's reference is the mean of its documents that
pass the base rules and are long enough; the documents of all the corpus count.
A document goes if it fails a base rule or if its divergence, the sum of both
Jensen-Shannon distances (base 2, 0 to 1) to its language's reference, is above
a threshold.  Distances of short documents are noise: ``noise / sqrt(n_words)``
is taken off, and below ``min_words`` or ``min_chars`` nothing is judged.

One pass over the texts makes a table of counts, which is written to the
shared folder; references are aggregates of that table with one row a language,
and the verdict is a join with them.  ``keep_good`` writes the rows beside their
counts, so that the verdict needs no join by id.  Texts are never shuffled.

Defined cases: null or empty text has no words and fails the base rules; a null
language is a language of its own; a language with fewer than ``min_reference``
usable documents has no reference and its documents stand on the base rules;
repeated rows are judged alike, one result each; an empty table gives no rows;
columns beyond id, text and language are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import ASCII_SPACE, materialize, read

#: Function words counted in every document, whatever its language.
COMMON_WORDS = tuple(dict.fromkeys((
    "the of and to in a is that for was with as on are it be at by from or an this "
    "le la les de des et un une que dans pour est en du qui "
    "der die und den von zu das mit nicht ist ein eine im für auf "
    "el los las y por con una para es se"
).split()))
#: Bytes of a word that can be one of them, with the marks after it.
LONGEST_COMMON = 7
SPACE = r"[\x20\x09-\x0D]+"
#: Classes that are counted in what is left of a text without a-z and white space.
CLASSES = {
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "mark": r"[^.,;:!?'\"()\-]+",
    "symbol": r"[^#*$%&|<>]+",
    "beyond_ascii": r"[\x00-\x7F]+",
}
MIN_CHARS, MIN_WORDS, MIN_REFERENCE = 200, 50, 20
#: Chosen by the labels of a table of 10,000 documents: junk kept against good documents lost.
MAX_DIVERGENCE, NOISE = 0.32, 1.4


def _left_after(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: bool = False) -> DataFrame:
    """doc_id, lang, base counts (long), class_counts and word_counts (arrays); with ``rows`` also row, a struct of all columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    carried = [F.struct("*").alias("row")] if rows else []
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), t.alias("t"), *carried)
    trimmed = F.btrim("t", F.lit(ASCII_SPACE))
    d = d.withColumn("words", F.when(trimmed == "", F.expr("CAST(array() AS ARRAY<STRING>)")).otherwise(F.split(trimmed, SPACE)))
    d = d.withColumn("n", F.size("words")).withColumn("rest", F.regexp_replace("t", r"[a-z\x20\x09-\x0D]+", ""))
    d = d.withColumn("word_chars", F.char_length(F.array_join("words", "")).cast("long"))
    # Windows of three words, sorted with their places: equal ones become neighbours.
    m = F.greatest(F.col("n") - 2, F.lit(0))
    zipped = F.arrays_zip(F.slice("words", 1, m), F.slice("words", 2, m), F.slice("words", 3, m), F.sequence(F.lit(0), m - 1).alias("i"))
    windows = F.sort_array(zipped.cast("array<struct<a:string,b:string,c:string,i:int>>"))
    d = d.withColumn("windows", F.when(m > 0, windows))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    after = F.slice("windows", F.lit(2), F.greatest(m - 1, F.lit(0)))
    pairs = F.zip_with(F.slice("windows", F.lit(1), F.greatest(m - 1, F.lit(0))), after, lambda x, y: F.when(same(x, y), F.struct(x["i"].alias("x"), y["i"].alias("y"))))
    d = d.withColumn("twice", F.filter(pairs, lambda p: p.isNotNull()))
    d = d.withColumn("at", F.array_union(F.transform("twice", lambda p: p["x"]), F.transform("twice", lambda p: p["y"])))
    repeated = F.array_union(F.array_union("at", F.transform("at", lambda i: i + 1)), F.transform("at", lambda i: i + 2))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    d = d.withColumn("lines", lines)
    plain = lambda w: F.lower(F.rtrim(w, F.lit(".,;:")))
    found = F.transform(F.filter("words", lambda w: (F.octet_length(w) <= LONGEST_COMMON) & plain(w).isin(*COMMON_WORDS)), plain)
    d = d.withColumn("found", found)
    others = [_left_after(F.col("rest"), p) for p in CLASSES.values()]
    return d.select(
        *(["row"] if rows else []), "doc_id", "lang", F.col("n").cast("long").alias("n_words"), "word_chars",
        _left_after(F.col("rest"), CLASSES["symbol"]).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(m > 0, F.size(repeated)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.char_length("t").cast("long").alias("n_chars"),
        F.array((F.char_length("t") - F.char_length("rest") - (F.char_length("t") - F.col("word_chars").cast("int"))), F.char_length("t") - F.col("word_chars").cast("int"), *others).alias("class_counts"),
        # One expression over all words: unrolled, the generated method is too large to be compiled.
        F.transform(F.array(*[F.lit(w) for w in COMMON_WORDS]), lambda c: F.size("found") - F.size(F.array_remove("found", c))).alias("word_counts"),
    )


def _shares(counted: Column, total: Column) -> Column:
    """Shares of each bin, and of what is in none."""
    known = F.aggregate(counted, F.lit(0), lambda a, x: a + x)
    return F.transform(F.concat(counted, F.array(total.cast("int") - known)), lambda x: x / F.greatest(total, F.lit(1)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, base 2; null if one is missing."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.when(p.isNotNull() & q.isNotNull(), F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))


def _verdicts(c: DataFrame, *, max_divergence: float = MAX_DIVERGENCE, noise: float = NOISE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """Adds base_failed, distances to the language's reference and ``kept`` to a written table of counts."""
    c = c.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    c = c.withColumn("p", _shares(F.col("class_counts"), F.col("n_chars"))).withColumn("w", _shares(F.col("word_counts"), F.col("n_words")))
    usable = c.where(~F.col("base_failed") & (F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words))
    mean = lambda name, n: F.array(*[F.avg(F.get(name, F.lit(i))) for i in range(n)])
    refs = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("ref_docs"), mean("p", len(CLASSES) + 3).alias("ref_p"), mean("w", len(COMMON_WORDS) + 1).alias("ref_w")).where(F.col("ref_docs") >= min_reference)
    # Written first: its size is known then, and the other side isn't shuffled to meet a handful of rows.
    refs = materialize(refs)
    j = c.alias("c").join(refs.alias("r"), F.col("c.lang").eqNullSafe(F.col("r.lang")), "left").drop(F.col("r.lang"))
    j = j.withColumn("char_distance", F.round(js_distance(F.col("p"), F.col("ref_p")), 6)).withColumn("word_distance", F.round(js_distance(F.col("w"), F.col("ref_w")), 6))
    excess = F.col("char_distance") + F.col("word_distance") - noise / F.sqrt("n_words")
    strange = (F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words) & (excess > max_divergence)
    return j.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(strange, F.lit(False)))


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **limits: float) -> DataFrame:
    """Base counts, base_failed, distances to the language's reference and ``kept``; ``limits`` as in ``_verdicts``."""
    j = _verdicts(materialize(counts(docs, doc_id=doc_id, text=text, lang=lang)), **limits)
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def keep_good(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **limits: float) -> DataFrame:
    """The rows of ``docs`` that are kept, each judged by its own text and language whatever its id."""
    j = _verdicts(materialize(counts(docs, doc_id=doc_id, text=text, lang=lang, rows=True)), **limits)
    return j.where("kept").select(*[F.col("row").getField(x).alias(x) for x in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


_WORDS_SQL = ", ".join(f"'{w}'" for w in COMMON_WORDS)
_CLASS_SQL = ", ".join(f"length(regexp_replace(rest, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for p in (x.replace("\\\"", "\"") for x in CLASSES.values()))
_COUNT_SQL = ", ".join(f"len(list_filter(found, lambda f: f = '{w}'))" for w in COMMON_WORDS)
_JS = "round(sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END) / 2)), 0)), 6)"
_MEAN = lambda name, n: "[" + ", ".join(f"avg({name}[{i + 1}])" for i in range(n)) + "]"

OP2_SQL = rf"""
WITH split AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         regexp_replace(coalesce(text, ''), '[a-z\x20\x09-\x0D]+', '', 'g') AS rest FROM documents),
places AS (
  SELECT doc_id, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] AS win
  FROM (SELECT doc_id, words, unnest(range(len(words) - 2)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM places) WHERE n >= 2),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(rest, '{CLASSES["symbol"]}', '', 'g'))::BIGINT AS n_symbols,
         (SELECT len(x) - len(list_distinct(x)) FROM (SELECT list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS x))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, length(t)::BIGINT AS n_chars,
         [length(array_to_string(words, '')) - length(rest), length(t) - length(array_to_string(words, '')), {_CLASS_SQL}] AS class_counts,
         list_filter(list_transform(list_filter(words, lambda w: strlen(w) <= {LONGEST_COMMON}), lambda w: lower(rtrim(w, '.,;:'))), lambda w: w IN ({_WORDS_SQL})) AS found
  FROM split s LEFT JOIN repeated r ON s.doc_id = r.doc_id),
shares AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         list_transform(list_append(class_counts, n_chars - list_sum(class_counts)), lambda x: x / greatest(n_chars, 1)) AS p,
         [{_COUNT_SQL}] AS word_counts FROM counted),
more AS (SELECT *, list_transform(list_append(word_counts, n_words - list_sum(word_counts)), lambda x: x / greatest(n_words, 1)) AS w FROM shares),
refs AS (
  SELECT lang, {_MEAN("p", len(CLASSES) + 3)} AS ref_p, {_MEAN("w", len(COMMON_WORDS) + 1)} AS ref_w
  FROM more WHERE NOT base_failed AND n_chars >= {MIN_CHARS} AND n_words >= {MIN_WORDS}
  GROUP BY lang HAVING count(*) >= {MIN_REFERENCE}),
judged AS (
  SELECT m.*, CASE WHEN ref_p IS NOT NULL THEN {_JS.format(p="p", q="ref_p")} END AS char_distance, CASE WHEN ref_w IS NOT NULL THEN {_JS.format(p="w", q="ref_w")} END AS word_distance
  FROM more m LEFT JOIN refs r ON m.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(n_chars >= {MIN_CHARS} AND n_words >= {MIN_WORDS}
         AND char_distance + word_distance - {NOISE} / sqrt(n_words) > {MAX_DIVERGENCE}, false) AS kept,
       char_distance, word_distance
FROM judged
"""
