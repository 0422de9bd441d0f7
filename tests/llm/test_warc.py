"""WARC archives: oracle, bytes of the format, round trip, revisits, edge rows, failed attempts."""

import hashlib
import os
import struct

import zstandard
from helpers import same_rows

from quire.llm import warc
from quire.llm.warc import MAGIC, op12_warc_archives, read_archives, read_record, write_archives

SCHEMA = "page_id long, url string, html string"


def round_trip(spark, tmp_path, rows, schema=SCHEMA, **more):
    folder = str(tmp_path / "out")
    manifest = write_archives(spark.createDataFrame(rows, schema), folder, **more)
    return manifest, folder, read_archives(manifest, folder, with_payload=True)


def test_oracle(spark, sf):
    same_rows(spark, op12_warc_archives, warc.OP12_SQL, sf)


def test_payloads_come_back(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = str(tmp_path / "out")
    manifest = write_archives(pages, folder)
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in read_archives(manifest, folder, with_payload=True).collect()}
    assert got == {r.page_id: (r.url, r.html) for r in pages.collect()}


def test_format(spark, sf, tmp_path):
    """A skippable frame with the dictionary, then one frame a record, as any Zstandard reader sees it."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").coalesce(1)
    folder = str(tmp_path / "out")
    places = write_archives(pages, folder).orderBy("archive", "offset").collect()
    size = 0
    for archive in {p.archive for p in places}:
        data = open(f"{folder}/{archive}", "rb").read()
        magic, n = struct.unpack("<II", data[:8])
        assert magic == MAGIC
        kind = zstandard.DICT_TYPE_FULLDICT if data[8:12] == warc.DICTIONARY_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
        words = zstandard.ZstdCompressionDict(data[8 : 8 + n], dict_type=kind)
        end = 8 + n
        for p in (p for p in places if p.archive == archive):
            assert p.offset == end
            end += p.length
            record = zstandard.ZstdDecompressor(dict_data=words).decompress(data[p.offset : end])
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + p.record_type.encode()) and record.endswith(b"\r\n\r\n")
            assert f"<urn:uuid:{p.record_id}>".encode() in record
            size += len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(record)) - p.length
        assert end == len(data)
    assert size > 0, "records are smaller with the dictionary"
    fields, block = read_record(folder, places[3].archive, places[3].offset, places[3].length)
    assert fields["warc-record-id"] == f"<urn:uuid:{places[3].record_id}>" and len(block) == int(fields["content-length"])


def test_a_dictionary_is_trained(spark, tmp_path):
    rows = [(i, f"http://example.org/{i}", f"<html><head><title>Page number {i}</title></head><body>" + f"<p>paragraph {i * 7919 % 1000}</p>" * 9) for i in range(400)]
    manifest, folder, got = round_trip(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).coalesce(1).collect())
    heads = [open(f"{folder}/{a}", "rb").read(12)[8:] for a in os.listdir(folder) if a.endswith(".zst")]
    assert warc.DICTIONARY_MAGIC in heads
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got.collect()) == [(a, c) for a, _, c in rows]


def test_revisits_and_edge_rows(spark, tmp_path):
    long, short = "é" * 500, "é" * 499 + "x"
    rows = [
        (1, "http://a/", long), (3, "http://b/", long), (2, None, long), (3, "http://c/", long), (None, "http://d/", long), (4, "http://e/", short), (5, "http://e/", short),
        (6, "http://f/ x\r\nWARC-Type: revisit\té", None), (7, "", ""), (8, "http://g/", "y" * 3_000_000), (None, None, None), (9, "u", "WARC/1.1\r\n\r\n" * 100), (9, "u", "WARC/1.1\r\n\r\n" * 100),
    ]
    manifest, folder, got = round_trip(spark, tmp_path, rows)
    got = got.collect()
    assert len(got) == manifest.count() == len(rows) and len({r.record_id for r in got}) == len(rows)
    by_id = {r.record_id: r for r in got}
    copies = [r for r in got if r.payload_digest == hashlib.sha1(long.encode()).hexdigest()]
    assert sorted((r.record_type, r.page_id or 0) for r in copies) == [("response", 3), ("revisit", 0), ("revisit", 1), ("revisit", 2), ("revisit", 3)]
    for r in got:
        if r.record_type == "revisit":
            first = by_id[r.refers_to_record]
            assert (first.record_type, first.page_id, first.payload_digest, r.payload) == ("response", r.refers_to, r.payload_digest, None)
        else:
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes and r.refers_to is None
    assert [r.record_type for r in got if r.page_id in (4, 5)] == ["response"] * 2
    assert sorted(r.record_type for r in got if r.page_id == 9) == ["response", "revisit"]
    assert {r.page_id: r.url for r in got if r.page_id in (2, 6, 7)} == {2: None, 6: "http://f/%20x%0D%0AWARC-Type:%20revisit%09%C3%A9", 7: ""}
    assert {r.page_id: r.payload_bytes for r in got if r.page_id in (6, 7, 8)} == {6: 0, 7: 0, 8: 3_000_000}


def test_empty_table_and_other_columns(spark, tmp_path):
    manifest, folder, got = round_trip(spark, tmp_path, [], SCHEMA)
    assert got.collect() == [] and os.listdir(folder) == []
    rows = spark.createDataFrame([(1, "u", "body", 7, "x", "best")], "id int, u string, html string, r1 int, row string, best string")
    manifest = write_archives(rows, folder, page_id="id", url="u")
    assert [(r.page_id, r.url, r.payload_bytes) for r in read_archives(manifest, folder).collect()] == [(1, "u", 4)]


def test_rollover_and_stray_files(spark, tmp_path):
    """Archives are closed at their size; files of attempts that failed are neither read nor kept."""
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "part-000000-0.warc.zst").write_bytes(b"half an arch")
    rows = spark.createDataFrame([(i, "u", f"{i} " * 500) for i in range(100)], SCHEMA).coalesce(1)
    manifest = write_archives(rows, str(folder), archive_bytes=20_000, sample_bytes=5_000)
    assert manifest.select("archive").distinct().count() > 4
    assert {r.archive for r in manifest.collect()} == {f for f in os.listdir(folder) if f.endswith(".zst")}
    assert sorted(r.page_id for r in read_archives(manifest, str(folder)).collect()) == list(range(100))
