"""N-gram Jaccard join by MinHash banding (operator 3).

1. Each text becomes its set of five-word shingles (64-bit hashes), a MinHash
   signature and band hashes; bands and rows are chosen for a target recall at
   the similarity threshold.  Texts of one shingle set are one representative
   with a weight.
2. Band hashes are shuffled; representatives that share one are linked to the
   bucket's smallest id, and linked ones form candidate components.
3. Components are small as a rule: the texts of one meet in one task, and all
   pairs inside are verified on their full shingle sets through an inverted
   index.  Only counts of links and one edge a document come out, never pairs.
4. A component with more than ``GROUP_DOCS`` documents or ``GROUP_SHINGLES``
   shingles is taken apart: members of its buckets of more than ``SMALL_BUCKET``
   are joined again among themselves and verified block by block, block pairs
   of a bounded size in tasks of their own; what else collides in small buckets
   is verified around its smaller id.
5. Edges give the classes by connected components.

No two texts that collide in a band go unverified, whatever the size of their
bucket.  A pair at the threshold collides with probability ``recall`` at least.

Representatives are told apart by numbers of their own, rows by their place in
the table (see ``keyed``), so neither needs an id.  Texts are joined to members
by row, with the same plan at every size.

Defined cases: words are runs of anything but ASCII white space, as they are;
a text of one to four words is one shingle; null or wordless text is its own
class without links; rows of null ids are judged like others, but name a class
only (as null) that has no other id; rows that repeat an id, with another text
or the same, are rows of their own; an empty table gives no rows; other columns
are ignored by ``near_duplicates`` and carried along by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm._common import SMALL_BATCHES, content, discard, keyed, materialize, read, slices

WORDS, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.999, 256
GROUP_DOCS, GROUP_SHINGLES, SMALL_BUCKET = 1_000, 1_000_000, 32
CACHED_BYTES = 24_000_000
ENTRY_BYTES = 150  # of a dictionary entry, beside the word's own
_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands, enough for the recall, fit."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


class WordHashes(dict):
    """64-bit hashes of words, as bytes; emptied when it takes some CACHED_BYTES."""

    room = CACHED_BYTES

    def __missing__(self, word: bytes) -> bytes:
        self.room -= ENTRY_BYTES + len(word)
        if self.room < 0:
            self.empty()
        h = self[word] = xxhash.xxh64_digest(word)
        return h

    def empty(self) -> None:
        self.clear()
        self.room = CACHED_BYTES


_HASHES = WordHashes()


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text."""
    found = (text or b"").split()  # at ASCII white space
    if not found:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(_HASHES.__getitem__, found)), ">u8").astype(np.uint64)
    n = max(1, len(h) - words + 1)
    s = np.zeros(n, np.uint64)
    for j in range(min(words, len(h))):
        s = s * _MIX + h[j : j + n]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)[:, None]

    def sign(self, s: np.ndarray) -> np.ndarray:
        """Band hashes of a set."""
        low = np.full(len(self.a), 2**32 - 1, np.uint32)
        h = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        for i in range(0, len(h), 2048):
            part = self.a * h[i : i + 2048][None, :]
            part ^= self.b
            np.minimum(low, part.min(axis=1), out=low)
        keys = np.zeros(self.bands, np.uint64)
        grid = low.reshape(self.bands, self.rows).astype(np.uint64)
        for j in range(self.rows):
            keys = (keys ^ grid[:, j]) * _MIX
            keys ^= keys >> np.uint64(31)
        return ((keys + np.arange(self.bands, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def signatures(rows: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bands: int, bands_rows: int) -> DataFrame:
    """doc_id, r1, r2, c1 (hash of all columns), d1, d2 (digest of the shingle set), n (its size), bands of rows (see ``keyed``)."""
    names = ["doc_id", "r1", "r2", "c1", "d1", "d2", "n", "bands"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, bands_rows)
        for b in batches:
            d, n, keys = [], [], []
            for x in b.column(4):
                s = shingles(x.as_py(), words)
                d.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8"))
                n.append(len(s))
                keys.append(signer.sign(s) if len(s) else [])
            digests = [pa.array([int(x[i]) for x in d], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), *digests, pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names)
        _HASHES.empty()  # the worker lives on

    row = F.col("row")
    ids = rows.select(row.getField(doc_id).cast("long").alias("doc_id"), "r1", "r2", content(rows).alias("c1"), row.getField(text).cast("binary").alias("text"))
    return ids.mapInArrow(run, "doc_id long, r1 long, r2 long, c1 long, d1 long, d2 long, n long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b), written; nodes have one root, a node, if and only if edges connect them.

    Each round moves every node to the least of itself and its neighbours and
    keeps the edges between what is left, so that all but the first work on
    less; some log n rounds.  The least is by number, by which the buckets' stars
    fold at once; from the first round that leaves more than half of the edges,
    by a hash of its own each, as a path in order of numbers loses one node a round.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    left, hashed, moves = e.count(), False, []
    while left or not moves:
        rank = (lambda c, seed=len(moves): F.xxhash64(F.lit(seed), c)) if hashed else F.col
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.select("a", F.when(rank("a") <= rank("b"), F.col("a")).otherwise(F.col("b")).alias("to"))
        to = materialize(near.groupBy("a").agg(F.min_by("to", rank("to")).alias("to")))
        ends = e.join(to, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(to, "a").where("x <> to")
        rest = materialize(ends.select(F.greatest("x", "to").alias("a"), F.least("x", "to").alias("b")).distinct())
        discard(e)
        e, before, left = rest, left, rest.count()
        hashed = hashed or left > before / 2
        moves.append(to)
    roots = moves[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for to in moves[1:]:
        then = to.select(F.col("a").alias("root"), F.col("to").alias("next"))
        roots = roots.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    roots = materialize(roots)
    discard(e, *moves)
    return roots


def links_of(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each document, the later ones (of the other side, if there are two) at the threshold."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    ranks = np.empty(len(flat), np.int64)
    sorted_flat = flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = sorted_flat[1:] != sorted_flat[:-1]
    ranks[order] = np.cumsum(new) - 1
    starts = np.append(np.flatnonzero(new), len(flat))
    posting = owner[order]
    ends = np.cumsum(size)
    cross = side.any()
    for x in range(len(sets)):
        if cross and side[x]:
            continue
        rows = ranks[ends[x] - size[x] : ends[x]]
        lens = starts[rows + 1] - starts[rows]
        total = int(lens.sum())
        at = np.repeat(starts[rows] - (np.cumsum(lens) - lens), lens) + np.arange(total)
        shared = np.bincount(posting[at], minlength=len(sets))
        alike = shared >= threshold * (size[x] + size - shared) - 1e-9
        if cross:
            alike &= side == 1
        else:
            alike[: x + 1] = False
        yield x, np.flatnonzero(alike)


def verify(rows: DataFrame, members: DataFrame, *, text: str, words: int, threshold: float) -> DataFrame:
    """(key, rep, links, root) of members (key, rep, r1, r2, weight, side) that have links.

    The members of one key meet in one task; the pairs compared are all of
    them or, where ``side`` has both values, those across.  ``root`` is the
    smallest rep that the key's links reach.
    """
    out_schema = pa.schema([("key", pa.string()), ("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in slices(batches, "key"):
            key = group.column("key")[0].as_py()
            reps, weights, sides = (group.column(c).to_pylist() for c in ("rep", "weight", "side"))
            if len(reps) < 2 or (key[0] == "x" and len(set(sides)) < 2):
                continue
            sets = [shingles(x.as_py(), words) for x in group.column("text")]
            weight, links, parent = np.array(weights), np.zeros(len(reps), np.int64), list(range(len(reps)))

            def find(i: int, parent=parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for x, ys in links_of(sets, np.array(sides), threshold):
                links[x] += weight[ys].sum()
                links[ys] += weight[x]
                for y in ys:
                    i, j = find(x), find(int(y))
                    if i != j:
                        if reps[i] > reps[j]:
                            i, j = j, i
                        parent[j] = i
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(has), pa.string()), pa.array([reps[i] for i in has], pa.int64()), pa.array(links[has], pa.int64()), pa.array([reps[find(int(i))] for i in has], pa.int64())], schema=out_schema)
        _HASHES.empty()

    texts = rows.select("r1", "r2", F.col("row").getField(text).cast("binary").alias("text"))
    joined = texts.join(members.hint("merge"), ["r1", "r2"]).select("key", "rep", "weight", "side", "text")
    return joined.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, "key string, rep long, links long, root long")


MEMBER = ("rep", "r1", "r2", "weight")


def _classes(rows: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> DataFrame:
    """One row per row: doc_id, r1, r2, class_id, n_links, first (whether it stands for its class)."""
    bands, per_band = choose_bands(threshold, recall, max_hashes)
    sig = materialize(signatures(rows, doc_id=doc_id, text=text, words=words, bands=bands, bands_rows=per_band), **SMALL_BATCHES)
    # The row of the smallest id stands for a shingle set; null ids come last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "c1", "r1", "r2")).alias("first")
    reps = sig.where("n > 0").groupBy("d1", "d2").agg(first, F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = materialize(reps.select("*", "first.r1", "first.r2", F.monotonically_increasing_id().alias("rep")))
    banded = reps.select("rep", F.explode("bands").alias("band"))
    buckets = materialize(banded.groupBy("band").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    colliding = materialize(banded.join(buckets, "band"))
    comps = components(colliding.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    placed = materialize(comps.select(F.col("node").alias("rep"), F.col("root").alias("comp")).join(reps.select(*MEMBER, "n"), "rep"))
    sizes = placed.groupBy("comp").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
    large = materialize(sizes.where((F.col("docs") > GROUP_DOCS) | (F.col("total") > GROUP_SHINGLES)))
    inside = materialize(placed.join(large.select("comp"), "comp", "left_anti").select(F.concat(F.lit("w:"), F.col("comp").cast("string")).alias("key"), *MEMBER, F.lit(0).alias("side")))
    args = {"text": text, "words": words, "threshold": threshold}
    found = materialize(verify(rows, inside, **args), **SMALL_BATCHES)
    linked = found.select("rep", "root", "links")
    if large.count():
        linked = linked.unionByName(_large(rows, placed.join(large.select("comp"), "comp"), colliding, args))
    linked = materialize(linked.join(reps.select("rep", "d1", "d2", "first", "weight"), "rep"))
    # The first of each class of several shingle sets; classes of one set have their own.
    best = materialize(linked.groupBy("root").agg(F.min("first").alias("best")))
    linked = linked.join(best, "root").select("d1", "d2", F.col("best").alias("of_class"), F.col("links").alias("more"))
    named = reps.select("d1", "d2", "first", "weight").join(linked, ["d1", "d2"], "left")
    named = materialize(named.select("d1", "d2", F.coalesce("of_class", "first").alias("class"), (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("links")))
    discard(reps, buckets, colliding, comps, placed, large, inside, found, best)
    out = sig.select("doc_id", "r1", "r2", "d1", "d2", "n").join(named, ["d1", "d2"], "left")
    worded = F.col("n") > 0
    return out.select(
        "doc_id", "r1", "r2", F.when(worded, F.col("class.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(worded, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        (~worded | ((F.col("class.r1") == F.col("r1")) & (F.col("class.r2") == F.col("r2")))).alias("first"),
    )


def near_duplicates(docs: DataFrame, **how: object) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id reached by links), n_links
    (other documents at the threshold, exact copies included).

    ``how``: names of the columns doc_id and text; words, threshold, recall, max_hashes.
    """
    return _classes(keyed(docs), **how).select("doc_id", "class_id", "n_links")


def _large(rows: DataFrame, placed: DataFrame, colliding: DataFrame, args: dict) -> DataFrame:
    """(rep, root, links) of the members of large components."""
    placed = materialize(placed)
    within = materialize(colliding.join(placed.select("rep"), "rep"))
    hot = components(within.where((F.col("members") > SMALL_BUCKET) & (F.col("rep") != F.col("least"))).select(F.col("rep").alias("a"), F.col("least").alias("b")))
    subs = hot.select(F.col("node").alias("rep"), F.col("root").alias("sub"))
    # Blocks of a bounded number of documents and shingles; each meets each other once.
    sub = placed.join(subs, "rep")
    parts = sub.groupBy("sub").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_DOCS * 2), F.ceil(F.sum("n") / GROUP_SHINGLES * 2)).cast("int").alias("q"))
    dealt = sub.join(parts, "sub").withColumn("block", F.pmod(F.xxhash64(F.lit(7), "rep"), "q").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    blocks = dealt.select(F.concat_ws(":", F.when(i == j, "w").otherwise("x"), F.col("sub").cast("string"), i.cast("string"), j.cast("string")).alias("key"), *MEMBER, (F.col("block") > i).cast("int").alias("side"))
    # Pairs of small buckets, unless both are in one of the groups above.
    few = within.where(F.col("members") <= SMALL_BUCKET).select("band", "rep").join(subs, "rep", "left")
    pairs = few.alias("a").join(few.alias("b"), "band").where("a.rep < b.rep AND (a.sub IS NULL OR b.sub IS NULL OR a.sub <> b.sub)")
    pairs = pairs.select(F.col("a.rep").alias("centre"), F.col("b.rep").alias("rep")).distinct().join(placed.select("rep", "n"), "rep")
    # A centre's partners, at most SMALL_BUCKET a band, are dealt to tasks of a bounded number of shingles.
    upto = Window.partitionBy("centre").orderBy("rep").rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / GROUP_SHINGLES).cast("string")
    pairs = materialize(pairs.select(F.concat_ws(":", F.lit("x:p"), F.col("centre").cast("string"), chunk).alias("key"), "centre", "rep"))
    star = pairs.select("key", "rep", F.lit(1).alias("side")).unionByName(pairs.select("key", F.col("centre").alias("rep"), F.lit(0).alias("side")).distinct())
    star = star.join(placed.select(*MEMBER), "rep").select("key", *MEMBER, "side")
    members = materialize(blocks.unionByName(star))
    found = materialize(verify(rows, members, **args), **SMALL_BATCHES)
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    out = materialize(found.groupBy("rep").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"), "links"))
    discard(placed, within, hot, pairs, members, found, roots)
    return out


def keep_one(docs: DataFrame, **how: object) -> DataFrame:
    """One row of each class of near copies, the one of the smallest id (null last;
    of equal ids the row of the smallest hash of all columns, the same in every run); ``how`` as in ``near_duplicates``."""
    rows = keyed(docs)
    gone = materialize(_classes(rows, **how).where("NOT first").select("r1", "r2"))
    kept = rows.join(gone.hint("merge"), ["r1", "r2"], "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
