"""Hierarchical multi-length packing (operator 4).

Documents are tokenised and packed where they are read, so tokens never cross
the network; only narrow rows about pieces do, for numbering.

In each task, windows of the longest tier are cut off a document first.  What is
left is routed to the smallest tier that holds it.  Each tier opens windows of
its size with its own pieces, fills their gaps from the shorter tiers (the
longest piece that fits first) and cuts one piece to close the last gap, so that
all windows are full.  All tiers are powers of two; only the tail of a task, of
fewer tokens than the shortest tier, is padded.

Windows are then numbered from counts by (task, tier), and step groups are
balanced: each gets the same share of every tier, hence about the same tokens.

Defined cases: null text is empty and has the end token alone; a very long
document is many full windows; equal lengths are taken in input order; repeated
rows are packed as often as they occur; a null id is kept as such; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm._common import SMALL_BATCHES, materialize, read

TIERS = (2048, 1024, 512, 256)
END_ID = 1
STEP_TOKENS = 2048 * 256
CACHED_BYTES = 160_000_000
ENTRY_BYTES = 200  # of a dictionary entry, beside the word's and its ids' own
HELD_TOKENS = 2_000_000
CHUNK = 1_000_000

#: Pre-tokens of a word without an apostrophe (contractions) or angle brackets (added tokens).
PARTS = re.compile(r"[^\W\d_]+|[0-9]|[!-&(-/:;=?@\[-`{-~]+")

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("task", pa.int64()), ("tier", pa.int64()), ("window", pa.int64()), ("offset", pa.int64()),
])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, tier long, window long, offset long"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder(dict):
    """Ids of texts by a tokenizer that never joins words across a blank or line end.

    Texts are cut there, and each distinct word is encoded once: the dictionary
    has words with their ids as little-endian unsigned 32-bit numbers.  It is
    emptied when it takes some ``CACHED_BYTES``.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.empty()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.marks = {m: self._whole(m) for m in ".,"}

    def empty(self) -> None:
        self.clear()
        self[""] = b""
        self.room = CACHED_BYTES

    def _put(self, word: str, ids: bytes) -> None:
        self.room -= ENTRY_BYTES + len(word) + len(ids)
        self[word] = ids

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, low: str) -> bytes:
        """Ids of one pre-token of lower-case letters."""
        shown = low if low.isascii() else "".join(map(self.letters.__getitem__, low.encode()))
        return struct.pack(f"<{len(ids)}I", *ids) if (ids := [x.id for x in self.model.tokenize(shown)]) else b""

    def __missing__(self, word: str) -> bytes:
        if self.room < 0:
            self.empty()
        stem, mark = (word[:-1], self.marks[word[-1]]) if word[-1] in self.marks else (word, b"")
        # Letters below U+0250 are composed, and all but one have one lower-case letter each.
        if stem.isalpha() and (stem.isascii() or (max(stem) < "\u0250" and "\u0130" not in stem)):
            low = stem.lower()
            ids = self.get(low)
            if ids is None:
                ids = self._stem(low)
                if low != word:
                    self._put(low, ids)
            ids += mark
        else:
            ids = self._parts(word)
        self._put(word, ids)
        return ids

    def _parts(self, word: str) -> bytes:
        """Ids of a word by its pre-tokens: runs of letters, digits one by one, runs of ASCII marks.

        What could be an added token or a contraction, or has other characters, goes to the tokenizer.
        """
        parts = PARTS.findall(word)
        if sum(map(len, parts)) != len(word) or max(word) >= "\u0250" or "\u0130" in word:
            return self._whole(word)
        found = []
        for part in parts:
            low = part.lower()
            if not low.isascii() and not low.isalpha():  # a number beyond 0 to 9
                return self._whole(word)
            ids = self.get(low)
            if ids is None:
                ids = self._stem(low)
                self._put(low, ids)
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        text = text.replace("\n", " ")
        if len(text) <= CHUNK:
            return b"".join(map(self.__getitem__, text.split(" ")))
        found, at = [], 0
        while at < len(text):  # in parts that end at blanks, so that never all words are in a list
            end = text.find(" ", at + CHUNK) + 1 or len(text)
            found.append(b"".join(map(self.__getitem__, text[at:end].split(" "))))
            at = end
        return b"".join(found)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of this file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Packer:
    """Packs one task's documents; ``rows`` collects finished pieces."""

    def __init__(self, task: int, tiers: tuple[int, ...]) -> None:
        self.task, self.tiers = task, tiers
        self.rows: list[tuple] = []
        self.windows = dict.fromkeys(tiers, 0)
        # pending pieces: (length, -order), with their tokens, sorted by length
        self.pending: list[tuple[int, int]] = []
        self.held: dict[int, tuple] = {}
        self.order = 0
        self.tokens = 0

    def _emit(self, tier: int, parts: list[tuple]) -> None:
        offset, window = 0, self.windows[tier]
        for doc, start, ids, total in parts:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.task, tier, window, offset))
            offset += len(ids)
        self.windows[tier] = window + 1

    def _hold(self, part: tuple) -> None:
        self.order += 1
        insort(self.pending, (len(part[2]), -self.order))
        self.held[-self.order] = part
        self.tokens += len(part[2])

    def _take(self, at: int) -> tuple:
        _, key = self.pending.pop(at)
        part = self.held.pop(key)
        self.tokens -= len(part[2])
        return part

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        longest, at = self.tiers[0], 0
        while len(ids) - at >= longest:
            self._emit(longest, [(doc, at, ids[at : at + longest], len(ids))])
            at += longest
        if at < len(ids):
            self._hold((doc, at, ids[at:].copy(), len(ids)))  # a view would keep the whole document
        if self.tokens >= HELD_TOKENS:
            self.pack()

    def pack(self, last: bool = False) -> None:
        """Closes all windows that what is held can fill."""
        for k, tier in enumerate(self.tiers):
            floor = self.tiers[k + 1] if k + 1 < len(self.tiers) else 0
            # Pieces of this tier open windows; the last tier goes on with whatever is left.
            while self.pending and self.tokens >= tier and (self.pending[-1][0] > floor or not floor):
                doc, start, ids, total = self._take(len(self.pending) - 1)
                if len(ids) > tier:  # of a longer tier whose windows can't be filled any more
                    self._hold((doc, start + tier, ids[tier:], total))
                parts = [(doc, start, ids[:tier], total)]
                gap = tier - len(parts[0][2])
                while gap:
                    at = bisect_right(self.pending, (gap, 1)) - 1
                    if at >= 0:
                        parts.append(self._take(at))
                    else:  # all are longer than the gap: cut the shortest
                        doc, start, ids, total = self._take(0)
                        parts.append((doc, start, ids[:gap], total))
                        self._hold((doc, start + gap, ids[gap:], total))
                    gap -= len(parts[-1][2])
                self._emit(tier, parts)
        if last and self.pending:
            # Fewer tokens than the next tier needs: split into full shorter windows and one tail.
            parts = [self._take(len(self.pending) - 1) for _ in range(len(self.pending))]
            for tier in self.tiers:
                while sum(len(p[2]) for p in parts) >= tier:
                    window, gap = [], tier
                    while gap:
                        doc, start, ids, total = parts.pop(0)
                        window.append((doc, start, ids[:gap], total))
                        if len(ids) > gap:
                            parts.insert(0, (doc, start + gap, ids[gap:], total))
                        gap -= len(window[-1][2])
                    self._emit(tier, window)
            if parts:
                self._emit(self.tiers[-1], parts)

    def flush(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in PIECES]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, PIECES, strict=True)], schema=PIECES)
        self.rows = []
        return batch


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, tier (window size) and step_group.

    ``tokenizer`` is the path of a tokenizers file that drops white space and
    splits words there; it must be found at the same path on all executors.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = encoder(path), Packer(TaskContext.get().partitionId(), tiers)
        end = struct.pack("<I", end_id)
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.frombuffer(words.encode(body.as_py() or "") + end, "<u4"))
                if len(packer.rows) >= 20_000:
                    yield packer.flush()
        packer.pack()
        packer.pack(last=True)
        yield packer.flush()
        words.empty()  # the worker lives on

    pieces = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES_DDL), **SMALL_BATCHES)
    # One row per (task, tier): numbers of windows, and the first number of each.
    counts = pieces.groupBy("task", "tier").agg((F.max("window") + 1).alias("n"), F.sum("length").alias("tokens"))
    by_task = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("in_tier", F.coalesce(F.sum("n").over(by_task), F.lit(0)))
    tier_totals = counts.groupBy("tier").agg(F.sum("n").alias("tier_n"), F.sum("tokens").alias("tier_tokens"))
    by_tier = Window.partitionBy(F.lit(0)).orderBy(F.col("tier").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tier_totals = tier_totals.withColumn("first", F.coalesce(F.sum("tier_n").over(by_tier), F.lit(0))).withColumn("steps", F.ceil(F.sum("tier_tokens").over(Window.partitionBy(F.lit(0))) / step_tokens))
    numbers = counts.drop("tokens").join(tier_totals, "tier")
    out = pieces.join(numbers, ["task", "tier"])
    at = F.col("in_tier") + F.col("window")
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + at).cast("long").alias("sequence_id"), F.col("offset"),
        "tier", F.floor(at * F.col("steps") / F.col("tier_n")).cast("long").alias("step_group"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
