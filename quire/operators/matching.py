"""Joins: types with defaults, exact-one joins, name lookup, and the staged title match."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import author_surnames, casefold, cut_places, last_first, lcs_of_pairs, most_alike, normalize_title, normalize_title_casefold, speaker_surname
from quire.runtime import materialize, ship

ACCEPT, MARGIN, CONSIDER, RANKED = 92.0, 3.0, 82.0, 3
#: Talks and titles, about, that one task compares at a time.
TILE = 1000
#: Characters by which titles differ that an index finds, one after the other, and pairs of a talk and a title from which it is asked.
EDITS, INDEXED = (4, 8, 9), 500_000_000
#: Titles that the places of cuts are chosen on, and the share of pairs up to which an index is quicker than tiles.
SAMPLE, SELECTIVE = 3000, 0.05
#: Pieces of titles, about, that one task holds at a time.
PIECES = 40_000


def attach_types(papers: DataFrame, talks: DataFrame, default: str = "poster") -> DataFrame:
    """Left join of presentation types; without any talk the types stay null."""
    t = talks.select("paper_id", F.col("type").alias("_type"), F.col("session_title").alias("_session"), F.col("session_id").alias("_session_id"))
    known = not talks.isEmpty()
    old = [c for c in ("presentation_type", "oral_session", "oral_session_id") if c in papers.columns]
    out = papers.drop(*old).join(t, "paper_id", "left")
    kind = F.coalesce("_type", F.lit(default)) if known else F.lit(None).cast("string")
    return out.withColumn("presentation_type", kind).withColumn("oral_session", F.col("_session")).withColumn("oral_session_id", F.col("_session_id")).drop("_type", "_session", "_session_id")


def join_default(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left equi-join whose missing values take defaults."""
    out = left.join(right, key, "left")
    return out.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in out.columns])


def worklist(index: DataFrame, categories: DataFrame, key: str = "filename") -> DataFrame:
    """Index rows, then the categories' rows that the index lacks."""
    return index.unionByName(categories.join(index.select(key), key, "left_anti"), allowMissingColumns=True)


def join_exactly_one(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Inner join on a key that must have exactly one row on the right; else an error at run time."""
    counts = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in right.columns if c != key])).alias("_r"))
    out = left.join(counts, key, "left")
    ok = F.coalesce(F.col("_n"), F.lit(0)) == 1
    checked = F.when(ok, F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("not exactly one candidate: "), F.col(name))))
    return out.withColumn("_r", checked).select(*left.columns, "_r.*")


def join_talks(records: DataFrame, talks: DataFrame, n_orals: int | None = None, n_spotlights: int | None = None) -> DataFrame:
    """Poster records with the type and session of the talk of the same title.

    A talk must have one record, and the numbers of talks, if given, must hold.
    """
    key = lambda df: df.withColumn("_key", normalize_title_casefold(F.col("title")))
    found = join_exactly_one(key(talks.select("title", "presentation_type", "oral_session")), key(records.select("title", "paper_id")).select("_key", "paper_id"), "_key", "title")
    for kind, n in (("oral", n_orals), ("spotlight", n_spotlights)):
        if n is not None and (got := talks.where(F.col("presentation_type") == kind).count()) != n:
            raise ValueError(f"{got} talks of type {kind}, expected {n}")
    t = found.select("paper_id", F.col("presentation_type").alias("_t"), F.col("oral_session").alias("_s"))
    old = [c for c in ("presentation_type", "oral_session") if c in records.columns]
    return records.drop(*old).join(t, "paper_id", "left").withColumn("presentation_type", F.coalesce("_t", F.lit("poster"))).withColumnRenamed("_s", "oral_session").drop("_t")


def name_lookup(papers: DataFrame) -> DataFrame:
    """folded ``first last``, canonical ``Last, First`` of names with one comma and both parts; names that fold alike are dropped."""
    a = papers.select(F.explode("authors").alias("canonical")).distinct()
    parts = F.transform(F.split("canonical", ","), lambda x: F.trim(x))
    a = a.withColumn("p", parts).where((F.size("p") == 2) & ~F.array_contains("p", ""))
    folded = casefold(F.concat_ws(" ", F.get("p", F.lit(1)), F.get("p", F.lit(0))))
    return a.groupBy(folded.alias("folded")).agg(F.count(F.lit(1)).alias("_n"), F.min("canonical").alias("canonical")).where("_n = 1").drop("_n")


def canonical_names(names: DataFrame, lookup: DataFrame, name: str = "name") -> DataFrame:
    """names plus canonical and rule: the lookup's name, else the rule of inversion."""
    folded = casefold(F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"\s+", " ")))
    out = names.withColumn("_folded", folded).join(lookup.select(F.col("folded").alias("_folded"), F.col("canonical").alias("_c")), "_folded", "left").withColumn("_p", last_first(F.col(name)))
    hit = F.col("_c").isNotNull() & (F.col("_folded") != "")
    return out.select(*names.columns, F.when(hit, F.col("_c")).otherwise(F.col("_p.name")).alias("canonical"), F.when(hit, "lookup").otherwise(F.col("_p.rule")).alias("rule"))


def alike(talks: DataFrame, titles: DataFrame, least: float, top: int) -> DataFrame:
    """(_b, ord, title, score): the ``top`` titles of a talk's block most alike at ``least`` or more, or somewhat more rows.

    ``talks``: (_b, ord, norm), ``titles``: (_b, norm), both without repeated
    rows.  Lengths in a ratio of more than (200 - least) / least can't reach
    ``least``: titles are banded by length so that a talk meets three bands.
    What is left of a block is cut on both sides, by hash, into parts of about
    TILE rows; a task compares one part with one, by bounds first, and no pair is
    a row.  Each part gives its ``top``, so the caller ranks what comes back.
    Nulls are alike to nothing; an empty string only to an empty one.
    """
    if least > 0:
        step = math.log(1.001 * (200 - least) / least)
        band = F.floor(F.log(F.greatest(F.char_length("norm"), F.lit(1))) / step).cast("int")
        bands = F.sequence(band - 1, band + 1)
    else:
        band, bands = F.lit(0), F.array(F.lit(0))
    a = talks.where("norm IS NOT NULL").select("_b", "ord", "norm", F.explode(bands).alias("_band"))
    b = titles.where("norm IS NOT NULL").select("_b", F.col("norm").alias("title"), band.alias("_band"))
    parts = lambda df, n: df.groupBy("_b", "_band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(n))
    sizes = parts(a, "_ps").join(parts(b, "_qs"), ["_b", "_band"])
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["_b", "_band", "_p", "_q"]
    a = a.join(sizes, ["_b", "_band"]).select("_b", "_band", own("ord", "_ps").alias("_p"), other("_qs").alias("_q"), "ord", "norm")
    b = b.join(sizes, ["_b", "_band"]).select("_b", "_band", other("_ps").alias("_p"), own("title", "_qs").alias("_q"), "title")

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        found = most_alike(x["norm"].to_pylist(), y["title"].to_pylist(), least, top) if x.num_rows and y.num_rows else []
        rows = x.select(["_b", "ord"]).take(pa.array([i for i, _, _ in found], pa.int64()))
        return rows.append_column("title", pa.array([t for _, t, _ in found], pa.string())).append_column("score", pa.array([r for _, _, r in found], pa.float64()))

    kinds = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    return a.groupBy(key).cogroup(b.groupBy(key)).applyInArrow(best, f"_b {kinds['_b']}, ord {kinds['ord']}, title string, score double")


def within_edits(talks: DataFrame, titles: DataFrame, edits: int, places: list[int], least: float) -> DataFrame:
    """(_b, ord, title, score): all titles of a talk's block at ``least`` or more that ``edits`` lost or added characters lead to.

    Columns as in ``alike``; titles no longer than the last of ``places`` are left
    out.  Titles are cut in ``edits`` + 1 pieces at ``places`` from their end.
    Counted from there, some piece stands whole in the talk behind exactly as many
    edits as there are pieces behind it: so it is looked for at that many places,
    every second one, and what lies before it may differ by the remaining edits.
    Pieces meet by hash, and ratios are counted for what meets.  A piece that more
    than TILE rows have is cut, on both sides, into parts of about TILE rows.
    """
    length, last = F.char_length("norm"), places[-1]
    spans = list(zip(places, places[1:], strict=False))
    own = [(k, 0, lo, hi) for k, (lo, hi) in enumerate(spans)] + [(edits, 0, last, -1)]
    asked = [(k, d, lo + d, hi + d) for k, (lo, hi) in enumerate(spans) for d in range(-k, k + 1, 2)] + [(edits, d, last + d, -1) for d in range(-edits, edits + 1, 2)]

    def pieces(df: DataFrame, cuts: list[tuple[int, int, int, int]]) -> DataFrame:
        every = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("k", "d", "lo", "hi"), x, strict=True)]) for x in cuts])).alias("x")
        df = df.select("*", every).select(*df.columns, "x.*").where((F.col("lo") >= 0) & F.when(F.col("hi") < 0, length > F.col("lo")).otherwise(length >= F.col("hi")))
        piece = F.when(F.col("hi") < 0, F.substring("norm", 1, length - F.col("lo"))).otherwise(F.substring("norm", length - F.col("hi") + 1, F.col("hi") - F.col("lo")))
        return df.withColumn("key", F.xxhash64("_b", "k", piece)).drop("lo", "hi")

    a = pieces(talks.where("_b IS NOT NULL AND norm IS NOT NULL").select("_b", "ord", "norm"), asked)
    b = pieces(titles.where("_b IS NOT NULL AND norm IS NOT NULL").select("_b", "norm").where(length > last), own)
    many = lambda df, n: df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(n)).where(F.col(n) > 1)
    often = materialize(many(a, "_ps").join(many(b, "_qs"), "key", "full"))
    n = math.ceil((talks.count() * len(asked) + titles.count() * len(own)) / PIECES) or 1
    part = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(F.col(n), F.lit(1))).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    key = F.xxhash64("key", "_p", "_q").alias("key")
    a = a.join(often, "key", "left").select("_b", "ord", "norm", "k", "d", "key", part("ord", "_ps").alias("_p"), other("_qs").alias("_q")).select("_b", "ord", "norm", "k", "d", key)
    b = b.join(often, "key", "left").select("norm", "key", other("_ps").alias("_p"), part("norm", "_qs").alias("_q")).select("norm", key)
    a, b = (df.withColumn("_g", F.pmod("key", F.lit(n)).cast("int")) for df in (a, b))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.combine_chunks().sort_by("norm"), y.combine_chunks().sort_by("key")
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        titles = y["norm"].to_pylist()
        if x.num_rows and titles:
            norm = x["norm"].combine_chunks().dictionary_encode()
            texts, text = norm.dictionary.to_pylist(), norm.indices.to_numpy()
            m, n = (np.array([len(s) for s in t], np.int64) for t in (texts, titles))
            k, d, keys, sought = (t.to_numpy() for t in (x["k"], x["d"], y["key"], x["key"]))
            start = np.searchsorted(keys, sought)
            met = np.searchsorted(keys, sought, "right") - start
            ends = np.cumsum(met)
            first = 0
            while first < len(ends):
                # Rows that meet a million titles, or one row.
                done = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 1_000_000, "right")))
                times = met[first:done]
                i = np.repeat(np.arange(first, done), times)
                j = np.arange(len(i)) + np.repeat(start[first:done] - (np.cumsum(times) - times), times)
                fits = np.abs(m[text[i]] - n[j] - d[i]) <= edits - k[i]
                i, j = i[fits], j[fits]
                if len(i):
                    both, common = m[text[i]] + n[j], lcs_of_pairs(texts, titles, text[i], j)
                    score = 200.0 * common / both
                    good = (both - 2 * common <= edits) & (score >= least)
                    kept.append((i[good], j[good], score[good]))
                first = done
        i, j, score = (np.concatenate(t) for t in zip(*kept, strict=True))
        return x.select(["_b", "ord"]).take(pa.array(i)).append_column("title", y["norm"].take(pa.array(j)).cast(pa.string())).append_column("score", pa.array(score))

    kinds = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    found = a.groupBy("_g").cogroup(b.groupBy("_g")).applyInArrow(meet, f"_b {kinds['_b']}, ord {kinds['ord']}, title string, score double")
    return found.distinct()


def out_of_reach(talks: DataFrame, titles: DataFrame, edits: int, last: int) -> DataFrame:
    """(_b, ord, beyond): no title that ``within_edits`` doesn't find has a ratio above ``beyond``.

    From the lengths that titles of the block have: a title of length n differs
    from a talk of length m by m - n characters at least, and by an odd number if
    that is odd.
    """
    n = titles.where("norm IS NOT NULL").groupBy("_b").agg(F.collect_set(F.char_length("norm")).alias("_n"))
    m = F.char_length("norm")

    def ratio(n: Column) -> Column:
        gap = F.abs(m - n)
        least = F.when((n <= last) | (gap > edits), gap).otherwise(edits + 1 + F.pmod(edits + 1 - gap, F.lit(2)))
        return F.when(m + n == 0, 100.0).otherwise(100.0 * (1 - least / (m + n)))

    return talks.join(n, "_b").groupBy("_b", "ord").agg(F.max(F.array_max(F.transform("_n", ratio))).alias("beyond"))


def match_talks(talks: DataFrame, papers: DataFrame, overrides: DataFrame, *, block: str = "year") -> DataFrame:
    """talks plus paper_id, match (override, skipped, exact, fuzzy, speaker, unmatched), best_title, best_score.

    ``talks``: (block, ord, title_raw, speaker); ``papers``: (block, paper_id,
    title, authors); ``overrides``: (block, norm_title, paper_id, is_skip).
    Stages: an override; a title equal to that of one paper; of the three titles
    most alike the best at 92 or more with a margin of 3, if one paper has it;
    of those at 82 or more, in order, the first paper with an author of the
    speaker's surname.  Only talks that no earlier stage settles reach the
    similarity function, and only with titles of their own block.  Where these make
    many pairs, a talk is first held against the titles within a few edits, and
    against all of its block only if titles further away could change its match.
    A paper that several talks reach keeps the last one; the others keep their match.  The
    best title is given where it is at 82 or more; ``best_guesses`` has it for the
    talks that stay unmatched.
    """
    ship(talks.sparkSession)
    p = papers.select(F.col(block).alias("_b"), "paper_id", normalize_title(F.col("title")).alias("norm"), "authors")
    titles = p.groupBy("_b", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("paper_id").alias("one"))
    t = talks.withColumn("norm", normalize_title(F.col("title_raw")))
    o = overrides.select(F.col(block).alias("_b"), "norm_title", F.col("paper_id").alias("_to"), "is_skip")
    t = t.join(o, (F.col(block) == F.col("_b")) & (F.col("norm") == F.col("norm_title")), "left").drop("_b", "norm_title")
    e = titles.where("n = 1").select(F.col("_b"), F.col("norm").alias("_norm"), F.col("one").alias("_exact"))
    t = t.join(e, (F.col(block) == F.col("_b")) & (F.col("norm") == F.col("_norm")), "left").drop("_b", "_norm")
    settled = F.col("is_skip").isNotNull() | F.col("_exact").isNotNull()
    open_ = materialize(t.where(~settled & F.col("ord").isNotNull()).select(F.col(block).alias("_b"), "ord", "norm", "speaker").distinct())
    titles = materialize(titles)
    near = p.withColumn("names", author_surnames("authors"))

    def verdicts(scored: DataFrame) -> DataFrame:
        by_talk = Window.partitionBy("_b", "ord").orderBy(F.desc("score"), "title")
        ranked = scored.join(titles.withColumnRenamed("norm", "title"), ["_b", "title"]).withColumn("rank", F.row_number().over(by_talk)).where(F.col("rank") <= RANKED)
        best = ranked.groupBy("_b", "ord").agg(
            F.max(F.when(F.col("rank") == 1, F.struct("title", "score", "n", "one"))).alias("b"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"), F.count(F.lit(1)).alias("held"),
        )
        speaking = ranked.join(open_.where("speaker IS NOT NULL").select("_b", "ord", "speaker"), ["_b", "ord"]).withColumn("surname", speaker_surname(F.col("speaker")))
        by_name = speaking.join(near.select(F.col("_b"), F.col("norm").alias("title"), "paper_id", "names"), ["_b", "title"]).where(F.array_contains("names", F.col("surname")))
        return best.join(by_name.groupBy("_b", "ord").agg(F.min(F.struct("rank", "paper_id")).alias("s")), ["_b", "ord"], "left")

    rest, done = open_, []
    by_block = titles.groupBy("_b").agg(F.count(F.lit(1)).alias("y"))
    sample: list[str] = []
    for edits in EDITS:
        pairs = rest.groupBy("_b").agg(F.count(F.lit(1)).alias("x")).join(by_block, "_b").agg(F.sum(F.col("x") * F.col("y").cast("double"))).first()[0] or 0
        if pairs < INDEXED:
            break
        sample = sample or [r.norm for r in titles.where("norm IS NOT NULL").select("norm").orderBy(F.xxhash64("norm"), "norm").limit(SAMPLE).collect()]
        places, share = cut_places(sample, edits)
        if not places or share > SELECTIVE:
            break
        asked = rest.select("_b", "ord", "norm").distinct()
        beyond = out_of_reach(asked, titles, edits, places[-1]).withColumn("beyond", F.col("beyond") + 1e-9)
        found = materialize(within_edits(asked, titles, edits, places, CONSIDER).join(beyond, ["_b", "ord"]).where("score > beyond"))
        # What is found above the ratio that others can have is what all pairs would give.
        v = verdicts(found.drop("beyond")).join(found.groupBy("_b", "ord").agg(F.max("beyond").alias("beyond")), ["_b", "ord"]).join(rest.groupBy("_b", "ord").agg(F.max("speaker").alias("speaker")), ["_b", "ord"])
        able, apart = (F.col("b.score") >= ACCEPT) & (F.col("b.n") == 1), lambda c: F.col("b.score") - F.col(c) >= MARGIN
        known = F.col("held") > 1
        fuzzy = able & F.when(known, apart("second")).otherwise(apart("beyond"))
        never = ~able | (known & ~apart("second"))
        v = materialize(v.where((F.col("held") == RANKED) | fuzzy | (never & (F.col("s").isNotNull() | F.col("speaker").isNull()))).drop("beyond", "speaker"))
        done.append(v)
        rest = materialize(rest.join(v.select("_b", "ord"), ["_b", "ord"], "left_anti"))
    # Titles below CONSIDER settle nothing.
    f = verdicts(alike(rest.select("_b", "ord", "norm").distinct(), titles, CONSIDER, RANKED))
    for v in done:
        f = f.unionByName(v)
    f = f.select(F.col("_b").alias("_bf"), F.col("ord").alias("_of"), "b", "second", F.col("s.paper_id").alias("_speaker"))
    t = t.join(f, (F.col(block) == F.col("_bf")) & (F.col("ord") == F.col("_of")), "left").drop("_bf", "_of")
    fuzzy = (F.col("b.score") >= ACCEPT) & (F.col("b.score") - F.col("second") >= MARGIN) & (F.col("b.n") == 1)
    method = (
        F.when(F.coalesce("is_skip", F.lit(False)), "skipped").when(F.col("is_skip").isNotNull(), "override").when(F.col("_exact").isNotNull(), "exact")
        .when(fuzzy, "fuzzy").when(F.col("_speaker").isNotNull(), "speaker").otherwise("unmatched")
    )
    t = t.withColumn("match", method)
    target = F.when(F.col("match") == "override", F.col("_to")).when(F.col("match") == "exact", F.col("_exact")).when(F.col("match") == "fuzzy", F.col("b.one")).when(F.col("match") == "speaker", F.col("_speaker"))
    return t.select(*talks.columns, target.alias("paper_id"), "match", F.col("b.title").alias("best_title"), F.col("b.score").alias("best_score"))


def talk_of_paper(matched: DataFrame, block: str = "year") -> DataFrame:
    """One talk a paper: the last of those that reach it."""
    held = matched.where("paper_id IS NOT NULL")
    return held.groupBy(block, "paper_id").agg(F.max_by(F.struct(*[c for c in held.columns if c not in (block, "paper_id")]), "ord").alias("t")).select(block, "paper_id", "t.*")


def best_guesses(matched: DataFrame, papers: DataFrame, block: str = "year") -> DataFrame:
    """block, title_raw, best_title, best_score of the unmatched talks, however far the best title is; of equal ones the first."""
    ship(matched.sparkSession)
    titles = materialize(papers.select(F.col(block).alias("_b"), normalize_title(F.col("title")).alias("norm")).distinct())
    left = matched.where(F.col("match") == "unmatched").select(F.col(block).alias("_b"), "ord", "title_raw", normalize_title(F.col("title_raw")).alias("norm"))
    left = materialize(left)
    found = alike(left.where("ord IS NOT NULL").select("_b", "ord", "norm").distinct(), titles, 0.0, 1)
    best = found.groupBy("_b", "ord").agg(F.min_by("title", F.struct(-F.col("score"), F.col("title"))).alias("best_title"), F.max("score").alias("best_score"))
    return left.join(best, ["_b", "ord"], "left").select(F.col("_b").alias(block), "title_raw", "best_title", "best_score")


def contained_in(needles: DataFrame, hay: DataFrame, *, needle_id: str, needle: str, hay_id: str, text: str, words: int = 5) -> DataFrame:
    """(needle_id, hay_id) where the needle stands whole in the text.

    A needle may begin and end inside words of the text, but the words between
    its first and last one stand there as they are: candidates share the first
    ``words`` of those as a window, and the full text then decides.  A needle of
    one or two words has none between; it is found where it begins and ends with
    words.  Null and blank needles are found nowhere.
    """
    split = lambda c: F.split(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), " ")
    n = F.size("parts")
    a = needles.select(F.col(needle_id).alias("needle_id"), F.col(needle).alias("needle"), split(needle).alias("parts")).where(F.trim("needle") != "")
    a = a.withColumn("m", F.when(n > 2, F.least(F.lit(words), n - 2)).otherwise(n))
    a = a.withColumn("w", F.array_join(F.slice("parts", F.when(n > 2, 2).otherwise(1), F.col("m")), " "))
    lengths = sorted(r.m for r in a.select("m").distinct().collect())  # ``words`` numbers at most
    keys = a.select("w").distinct()
    b = hay.select(F.col(hay_id).alias("hay_id"), F.col(text).alias("text"))
    # The words are a column of their own: inside the lambda they would be split for each window.
    parts = b.select("hay_id", split("text").alias("parts"))

    def windows(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("parts", i, F.lit(k)), " "))

    every = F.flatten(F.array(*[windows(k) for k in lengths or [words]]))
    hits = parts.select("hay_id", F.explode(F.array_distinct(every)).alias("w")).join(keys, "w", "left_semi")
    pairs = hits.join(a.select("needle_id", "needle", "w"), "w").select("hay_id", "needle_id", "needle").distinct()
    return pairs.join(b, "hay_id").where(F.contains("text", F.col("needle"))).select("needle_id", "hay_id")
