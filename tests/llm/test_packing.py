"""Packing: exact round trip of ids, full windows, balanced steps."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm.packing import Packer, WordEncoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs):
    """Each id lies in exactly one piece; sequences are gapless and at most 2048 long."""
    t = Tokenizer.from_file(PATH)
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[d]) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(ids[d][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[d])
    total, padded = 0, 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and len({(p["tier"], p["step_group"]) for p in pieces}) == 1
        total += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    return total, padded, by_seq


def test_documents_round_trip(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r.asDict() for r in pack(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    total, padded, seqs = check(rows, docs)
    assert padded <= 2048 * 8 and padded < 0.05 * total


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (4, "Don't stop, it's fine.\n<|endoftext|> x\ty " * 900), (5, "é́ ÄÖ 12ab 中文  z ſ İ")]
    rows = [r.asDict() for r in pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    check(rows, docs)
    empty = spark.createDataFrame([], "doc_id long, text string, task string")
    assert pack(empty).collect() == []


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(7, "same words"), (7, "same words"), (None, "no id")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.length) for r in pack(df).collect())
    assert [g[0] for g in got] == [-1, 7, 7]


def test_steps_are_balanced(spark, sf):
    rows = pack(spark.read.parquet(f"{sf}/documents.parquet"), step_tokens=2048 * 32).groupBy("step_group").sum("length").collect()
    sums = sorted(r[1] for r in rows)
    assert sums[-1] <= 1.2 * sums[0]


def test_windows_are_full():
    rng = np.random.default_rng(4)
    p = Packer(0, (64, 32, 16, 8))
    n = rng.integers(1, 200, 500)
    for d, k in enumerate(n):
        p.add(d, np.arange(k, dtype="<u4"))
    p.pack(last=True)
    sizes = defaultdict(int)
    for r in p.rows:
        sizes[r[6], r[7]] += r[2]
    assert sum(sizes.values()) == n.sum()
    assert sum(v != k[0] for k, v in sizes.items()) <= 1


@pytest.mark.parametrize("text", ["The,the. THE", "x" * 3000, "naïve café.", "a.b,c", ".", ",,", "don't 's it's,", "Öffnung. ŒUVRE ß, ǅungla İx ſtern ﬁn. Ŀl ŉ", "中文, ру́сский Σίσυφος ΣΑΣ."])
def test_encoder_equals_tokenizer(text):
    assert np.frombuffer(WordEncoder(PATH).encode(text), "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_words_of_marks_and_digits_need_no_tokenizer_call(monkeypatch):
    words = ["abc$$$", "Éa12b!!", "|", "2024-05", "x_y,", "ABC***.", "ſoft#1"]
    encoder, plain = WordEncoder(PATH), WordEncoder(PATH)
    want = [plain._whole(w) for w in words]
    others = ["it's", "<|endoftext|>", "a<b", "x²", "İa1", "中1", "é1", "ǅ1"]
    assert [encoder[w] for w in others] == [plain._whole(w) for w in others]
    monkeypatch.setattr(WordEncoder, "_whole", lambda self, word: pytest.fail(word))
    assert [encoder[w] for w in words] == want
