"""Ranked lexical search (operator 11).

The index holds documents in blocks of consecutive rows, each cut by one task.
Per term it has a tree of maxima: the highest impact that the term has in a leaf
(``LEAF`` documents of a block), in a block, in ``FANOUT`` blocks, in ``FANOUT``
of those, and so on.  A node's bound for an item is the sum of its terms' weights
times their maxima there, so no document below the node scores higher.

The search is best first, in two waves.  The first goes down from the root, at
each level into the ``BEAM`` nodes of the highest bounds of each item, and scores
their blocks; the k-th score found is the item's floor.  The second goes down
into every node whose bound reaches the floor; a node of exactly that bound is
opened too, since a tie is decided by the smaller id.  Within a block leaves are
opened from the highest bound down while the floor rises, until a bound stays
below it.  All nodes that could hold a result are opened, so the result is exact.

Only terms that some item asks for are written to the index.  Levels are tables,
descents are joins on term and parent node; a block's postings meet the items
that open it in one group, whose size is bounded (``BLOCK_DOCS``,
``BLOCK_POSTINGS``, about ``ITEMS`` items at a time).  The driver holds three
numbers: documents, terms and blocks.

Defined cases: null texts and texts without a term are in no index and count for
nothing; rows are documents, so a repeated id may be ranked more than once; null
ids come after all others among equal scores; items of one id and one text are
one item, of one id and different texts are ranked apart, a null item id is an id;
items without a term, or an empty table on either side, give no rows.  One very
long text is a block of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._common import SMALL_BATCHES, UPPER, discard, materialize, read

#: Everything in ASCII but digits and letters parts terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same by UTF-8 byte: blanks between terms, A-Z lower-cased, bytes of other characters kept.
FOLD = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
LEAF = 64
FANOUT = 8
#: A block ends with the document that reaches one of these.
BLOCK_DOCS = 1024
BLOCK_POSTINGS = 400_000
BEAM = 2
ITEMS = 500

POSTINGS = pa.schema([
    ("task", pa.int32()), ("seq", pa.int32()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())),
    ("ns", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())),
])
POSTINGS_DDL = "task int, seq int, term string, docs array<int>, tfs array<int>, ns array<int>, ids array<long>"


class Block:
    """Documents of one block: distinct terms and their counts, one document after another."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.sizes: list[int] = []
        self.terms: list[bytes] = []
        self.tfs: list[int] = []

    def add(self, doc: int | None, terms: list[bytes]) -> None:
        counts = Counter(terms)
        self.ids.append(doc)
        self.lengths.append(len(terms))
        self.sizes.append(len(counts))
        self.terms.extend(counts)
        self.tfs.extend(counts.values())

    def full(self, docs: int) -> bool:
        return len(self.ids) >= docs or len(self.terms) >= BLOCK_POSTINGS

    def rows(self, task: int, seq: int) -> pa.RecordBatch:
        """One row a term, with documents in order of their ids, and first a row without a term that has all ids and lengths."""
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        lengths = np.asarray(self.lengths, np.int32)
        coded = pa.array(self.terms, pa.binary()).dictionary_encode()
        codes = coded.indices.to_numpy()
        docs = np.repeat(place, self.sizes)
        sort = np.lexsort((docs, codes))
        ends = np.concatenate([[0, 0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))]).astype(np.int32)
        by_place = lengths[order]

        def lists(values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

        rows = len(coded.dictionary) + 1
        head = np.concatenate([[0], np.full(rows, n)]).astype(np.int32)
        ns = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[1:] + n]).astype(np.int32)), pa.array(np.concatenate([by_place, by_place[docs[sort]]])))
        columns = [
            pa.array(np.full(rows, task, np.int32)), pa.array(np.full(rows, seq, np.int32)),
            pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary.cast(pa.string())]),
            lists(docs[sort]), lists(np.asarray(self.tfs, np.int32)[sort]), ns,
            pa.ListArray.from_arrays(pa.array(head), pa.array([self.ids[i] for i in order], pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=POSTINGS)


def postings(docs: DataFrame, doc_id: str, text: str, block_docs: int) -> DataFrame:
    """Rows of all blocks, see Block.rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, block = TaskContext.get().partitionId(), 0, Block()
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = body.as_buffer().to_pybytes().translate(FOLD).split() if body.is_valid else []
                if terms:
                    block.add(doc, terms)
                if block.full(block_docs):
                    yield block.rows(task, seq)
                    seq, block = seq + 1, Block()
        if block.ids:
            yield block.rows(task, seq)

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, POSTINGS_DDL)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """q1, q2 (an item's key), item_id, term, times (in the item)."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("t")).distinct()
    parts = F.filter(F.split(F.translate("t", UPPER, UPPER.lower()), BETWEEN), lambda x: x != "")
    keys = [F.xxhash64(F.lit(seed), "item_id", "t").alias(f"q{seed}") for seed in (1, 2)]
    return rows.select(*keys, "item_id", F.explode(parts).alias("term")).groupBy("q1", "q2", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def impact(tf: Column, n: Column, n_docs: int, n_terms: int) -> Column:
    """What one document's count of a term is worth, without the term's weight."""
    return F.call_function("div", F.lit(1_000_000_000) * tf.cast("long"), 1000 * tf.cast("long") + 8 * (25 + F.call_function("div", F.lit(75 * n_docs) * n.cast("long"), F.lit(n_terms))))


class Postings:
    """One term's postings in a block: places, impacts, and the leaves that they are in."""

    def __init__(self, docs: np.ndarray, tfs: np.ndarray, ns: np.ndarray, n_docs: int, n_terms: int, leaf: int) -> None:
        self.docs, tf = docs, tfs.astype(np.int64)
        self.impacts = 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n_docs * ns.astype(np.int64) // n_terms))
        leaves = docs // leaf
        self.starts = np.flatnonzero(np.diff(leaves, prepend=-1))
        self.leaves = leaves[self.starts]
        self.maxima = np.maximum.reduceat(self.impacts, self.starts)
        self.slices = dict(zip(self.leaves.tolist(), zip(self.starts.tolist(), [*self.starts[1:].tolist(), len(docs)], strict=True), strict=True))


def best_in_block(terms: list[tuple[Postings, int]], n_docs: int, floor: int, k: int, leaf: int) -> list[tuple[int, int]]:
    """The k best (score, place) of a block that reach ``floor``, leaves opened from the highest bound down."""
    bounds = np.zeros(-(-n_docs // leaf), np.int64)
    for p, weight in terms:
        bounds[p.leaves] += weight * p.maxima
    best: list[tuple[int, int]] = []
    for at in np.argsort(-bounds, kind="stable").tolist():
        if bounds[at] < floor:
            break
        scores = np.zeros(leaf, np.int64)
        for p, weight in terms:
            if at in p.slices:
                a, b = p.slices[at]
                scores[p.docs[a:b] - at * leaf] += weight * p.impacts[a:b]
        reach = np.flatnonzero(scores >= floor)
        best = sorted([*best, *((-int(scores[i]), int(i) + at * leaf) for i in reach)])[:k]
        if len(best) == k:
            floor = -best[-1][0]
    return [(-s, place) for s, place in best]


def open_blocks(index: DataFrame, pairs: DataFrame, asked: DataFrame, groups: int, k: int, n_docs: int, n_terms: int, leaf: int) -> DataFrame:
    """q1, q2, doc_id, score: each pair's (q1, q2, task, seq, floor) best documents that reach the floor."""
    lists = asked.groupBy("q1", "q2").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    right = pairs.join(lists, ["q1", "q2"]).withColumn("part", F.pmod("q1", F.lit(groups)).cast("int"))
    left = index.join(pairs.select("task", "seq", F.pmod("q1", F.lit(groups)).cast("int").alias("part")).distinct(), ["task", "seq"])

    def run(rows: pa.Table, items: pa.Table) -> pa.Table:
        out: list[tuple] = []
        rows, held, ids = rows.combine_chunks(), {}, []
        wanted = {t["term"] for terms in items.column("terms").to_pylist() for t in terms}
        columns = [rows.column(c) for c in ("docs", "tfs", "ns")]
        for i, term in enumerate(rows.column("term").to_pylist()):
            if term is None:
                ids = rows.column("ids")[i].as_py()
            elif term in wanted:
                held[term] = Postings(*[c[i].values.to_numpy(zero_copy_only=False) for c in columns], n_docs, n_terms, leaf)
        for item in items.select(["q1", "q2", "floor", "terms"]).to_pylist():
            terms = [(held[t["term"]], t["weight"]) for t in item["terms"] if t["term"] in held]
            out += [(item["q1"], item["q2"], ids[place], score) for score, place in best_in_block(terms, len(ids), item["floor"], k, leaf)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("q1", "q2", "doc_id", "score"), columns, strict=True)})

    key = ("task", "seq", "part")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "q1 long, q2 long, doc_id long, score long")


def bounds(asked: DataFrame, level: DataFrame, alive: DataFrame | None) -> DataFrame:
    """q1, q2, node, bound (and task, seq on the lowest level) of a level's nodes, below ``alive`` nodes only."""
    place = [F.first(c).alias(c) for c in ("task", "seq") if c in level.columns]
    if alive is None:
        rows = asked.join(level, "term")
    else:
        parents = alive.select("q1", "q2", F.col("node").alias("parent")).join(asked, ["q1", "q2"])
        rows = parents.join(level.withColumn("parent", F.shiftright("node", 3)), ["term", "parent"])
    return rows.groupBy("q1", "q2", "node").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"), *place)


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10, leaf: int = LEAF, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): each item's k best documents."""
    times = materialize(item_terms(items, item_id, item_text))
    # A table with a row without a term, so that the blocks' head rows stay.
    vocabulary = materialize(times.select("term").distinct().union(docs.sparkSession.createDataFrame([(None,)], "term string")))
    rows = postings(docs, doc_id, text, block_docs)
    index = materialize(rows.join(vocabulary.withColumnRenamed("term", "v"), F.col("term").eqNullSafe(F.col("v")), "left_semi"), **SMALL_BATCHES)
    heads = index.where("term IS NULL")
    total = heads.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l"), F.count(F.lit(1)).alias("blocks"))
    n_docs, n_terms, blocks = (int(x or 0) for x in total.first())
    terms = index.where("term IS NOT NULL")
    found = terms.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1)))
    asked = materialize(times.join(found, "term").select("q1", "q2", "item_id", "term", (weight * F.col("times")).alias("weight")).where("weight > 0"))
    groups = asked.select("q1", "q2").distinct().count() // ITEMS + 1

    # Blocks numbered without gaps: a row a task in the window.
    by_task = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    numbers = materialize(heads.groupBy("task").agg(F.count(F.lit(1)).alias("n")).select("task", F.coalesce(F.sum("n").over(by_task), F.lit(0)).alias("first")))
    top = F.array_max(F.zip_with("tfs", "ns", lambda tf, n: impact(tf, n, n_docs, max(n_terms, 1))))
    levels = [materialize(terms.select("task", "seq", "term", top.alias("top")).join(numbers, "task").select("task", "seq", (F.col("first") + F.col("seq")).alias("node"), "term", "top"))]
    while blocks > FANOUT:
        blocks = -(-blocks // FANOUT)
        levels.append(materialize(levels[-1].groupBy("term", F.shiftright("node", 3).alias("node")).agg(F.max("top").alias("top"))))

    per_item = Window.partitionBy("q1", "q2")
    alive = None
    for level in reversed(levels):
        alive = bounds(asked, level, alive).withColumn("place", F.row_number().over(per_item.orderBy(F.col("bound").desc(), "node"))).where(F.col("place") <= BEAM).drop("place")
    dived = materialize(alive.withColumn("floor", F.lit(1).cast("long")))
    first = materialize(open_blocks(index, dived, asked, groups, k, n_docs, n_terms, leaf))
    ranked = first.withColumn("rank", F.row_number().over(per_item.orderBy(F.col("score").desc())))
    floors = materialize(ranked.where(F.col("rank") == k).select("q1", "q2", F.col("score").alias("floor")))

    alive = None
    for level in reversed(levels):
        reached = bounds(asked, level, alive).join(floors, ["q1", "q2"], "left").withColumn("floor", F.coalesce("floor", F.lit(1)))
        alive = reached.where(F.col("bound") >= F.col("floor"))
    rest = materialize(alive.join(dived.select("q1", "q2", "node"), ["q1", "q2", "node"], "left_anti"))
    both = first.unionByName(open_blocks(index, rest, asked, groups, k, n_docs, n_terms, leaf))
    order = per_item.orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = materialize(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    names = asked.select("q1", "q2", "item_id").distinct()
    out = best.join(names, ["q1", "q2"]).select("item_id", "rank", "doc_id", "score")
    discard(times, vocabulary, index, numbers, *levels, dived, first, floors, rest)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH doc_terms AS (
  SELECT row_id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents)),
item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM item_terms GROUP BY ALL),
lengths AS (SELECT row_id, count(*) AS n FROM doc_terms GROUP BY row_id),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
counts AS (SELECT row_id, doc_id, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, total GROUP BY term, big_n),
scores AS (
  SELECT a.item_id, c.row_id, c.doc_id,
         sum(a.times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked a JOIN counts c USING (term) JOIN weights USING (term) JOIN lengths USING (row_id), total
  GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
           FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
