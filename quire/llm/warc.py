"""WARC archives with dictionary compression (operator 12).

A writer task turns pages into WARC/1.1 records and archives of about
``ARCHIVE_BYTES`` of them.  An archive starts with a skippable frame (magic
0x184D2A5D) that holds a Zstandard dictionary, trained on the archive's own first
records (``SAMPLE_BYTES`` of them, a bounded sample); then every record is one
frame of its own, compressed with that dictionary, so that a record can be read by
its place alone.  Rows come in order of a hash, so the first records are a random
sample of a task's.

Pages of equal payload and ``min_bytes`` or more are one response record and
revisit records of it (identical-payload-digest), which have no body.  Which is
which is decided on digests, lengths and ids; payloads cross one shuffle, by a key
that every row has for itself, so that no group of copies meets in one task.

A task gives its archives names of its own and returns the place of each record;
Spark commits these rows, the manifest, once per task.  A file that the manifest
doesn't name comes from an attempt that failed; it is never read, and removed when
the write ends.  Readers take a task an archive and hold one record at a time.

Defined cases: a null payload is empty; a null or repeated id is a page of its
own (of equal payloads the response is the largest id, nulls last, among equal ids
the largest hash of the row's place); a null url leaves the target out, white
space and control characters in it are percent-encoded; equal rows are two records;
an empty table makes no archive and gives no rows; other columns are left out.  An
archive of fewer than ``MIN_SAMPLES`` records, or one that no dictionary can be
trained on, gets a dictionary of its first records' bytes as they are, without
entropy tables; one whose records are shorter than eight bytes can't be, as
headers alone are longer.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import SMALL_BATCHES, discard, keyed, materialize, read
from quire.runtime import work_dir

MAGIC = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Uncompressed bytes of records that a dictionary is trained on, and its size.
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
MIN_SAMPLES = 16
#: Most reading tasks; beyond it a task reads several archives, one after another.
READERS = 20_000
LEVEL = 3

MANIFEST = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])
MANIFEST_DDL = "archive string, offset long, length long, record_id string, record_type string"
RECORDS = pa.schema([
    ("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()), ("payload", pa.binary()),
])
RECORDS_DDL = "archive string, record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, payload binary"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


@dataclass
class Record:
    """One WARC record; payload None is a revisit record, which has no body."""

    record_id: str
    url: str | None
    page_id: int | None
    payload: bytes | None
    payload_bytes: int
    sha1: bytes
    refers_to: int | None = None
    refers_to_record: str | None = None

    @property
    def kind(self) -> str:
        return "response" if self.payload is not None else "revisit"

    def encode(self, date: str) -> bytes:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % self.payload_bytes + (self.payload or b"")
        fields = [
            ("WARC-Type", self.kind), ("WARC-Record-ID", f"<urn:uuid:{self.record_id}>"), ("WARC-Date", date),
            ("WARC-Target-URI", None if self.url is None else quote(self.url, safe="".join(map(chr, range(33, 127))))),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(self.sha1).decode()), ("X-Page-ID", self.page_id), ("X-Payload-Length", self.payload_bytes),
        ]
        if self.payload is None:
            fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{self.refers_to_record}>"), ("X-Refers-To-Page-ID", self.refers_to)]
        fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
        return head.encode() + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    if len(samples) >= MIN_SAMPLES:
        try:
            size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
            return zstandard.train_dictionary(size, samples, k=512, d=8)
        except zstandard.ZstdError:  # the samples have too little in common
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes one task's records; ``places`` collects the manifest's rows."""

    def __init__(self, folder: str, date: str, archive_bytes: int, sample_bytes: int) -> None:
        self.folder, self.date, self.archive_bytes, self.sample_bytes = folder, date, archive_bytes, sample_bytes
        self.fs, self.root = filesystem(folder)
        self.places: list[tuple] = []
        self.out = None
        self._begin()

    def _begin(self) -> None:
        self.name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        self.held: list[tuple[Record, bytes]] = []
        self.held_bytes = self.bytes = self.at = 0

    def _open(self) -> None:
        """The dictionary is known: writes it and the records held for it."""
        held, self.held = self.held, []
        words = dictionary_of([body for _, body in held])
        words.precompute_compress(level=LEVEL)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
        self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)  # by its name it would be compressed again
        data = words.as_bytes()
        self.out.write(struct.pack("<II", MAGIC, len(data)) + data)
        self.at = 8 + len(data)
        for record, body in held:
            self._write(record, body)

    def _write(self, record: Record, body: bytes) -> None:
        frame = self.press.compress(body)
        self.out.write(frame)
        self.places.append((self.name, self.at, len(frame), record.record_id, record.kind))
        self.at += len(frame)

    def add(self, record: Record) -> None:
        body = record.encode(self.date)
        self.bytes += len(body)
        if self.out is None:
            self.held.append((record, body))
            self.held_bytes += len(body)
            if self.held_bytes >= self.sample_bytes:
                self._open()
        else:
            self._write(record, body)
        if self.bytes >= self.archive_bytes:
            self.close()
            self._begin()

    def close(self) -> None:
        if self.held:
            self._open()
        if self.out is not None:
            self.out.close()
            self.out = None

    def flush(self) -> pa.RecordBatch:
        columns = zip(*self.places, strict=True) if self.places else [[]] * len(MANIFEST)
        self.places = []
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, MANIFEST, strict=True)], schema=MANIFEST)


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """r1, r2 of the pages whose payload another page's response has, with its id and key."""
    payload = F.coalesce(F.col("row")["payload"], F.lit("")).cast("binary")
    long = pages.select("r1", "r2", F.col("row")["page_id"].alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= min_bytes)
    long = long.drop("n")
    best = F.max(F.struct("page_id", "r1", "r2")).alias("best")  # a null id is the smallest
    # Written first, so that Spark may split a hot digest in the join.
    groups = materialize(long.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "best"))
    other = (F.col("r1") != F.col("best.r1")) | (F.col("r2") != F.col("best.r2"))
    return long.join(groups, "digest").where(other).select("r1", "r2", "best")


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z",
                   archive_bytes: int = ARCHIVE_BYTES, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` to archives in ``folder``, which all
    executors share; the manifest has archive, offset, length, record_id and record_type.
    """
    spark = pages.sparkSession
    rows = keyed(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("payload")))
    again = materialize(revisits(rows, min_bytes))
    body = F.coalesce(F.col("row")["payload"], F.lit("")).cast("binary")
    marked = rows.join(again.hint("merge"), ["r1", "r2"], "left").select(
        "r1", "r2", F.col("row")["page_id"], F.col("row")["url"], body, F.octet_length(body).cast("long"), F.unhex(F.sha1(body)), F.col("best")["page_id"], F.col("best")["r1"], F.col("best")["r2"],
    )
    there, root = filesystem(folder)
    there.create_dir(root)

    def key(r1: int, r2: int) -> str:
        return str(uuid.UUID(bytes=struct.pack(">qq", r1, r2)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, date, archive_bytes, sample_bytes)
        for batch in batches:
            for r1, r2, page, target, data, n, sha1, first, f1, f2 in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if f1 is None:
                    writer.add(Record(key(r1, r2), target, page, data, n, sha1))
                else:
                    writer.add(Record(key(r1, r2), target, page, None, n, sha1, first, key(f1, f2)))
            yield writer.flush()
        writer.close()
        yield writer.flush()

    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(marked.columns)]
    manifest = materialize(marked.toDF(*[f"c{i}" for i in range(len(columns))]).mapInArrow(run, MANIFEST_DDL), **SMALL_BATCHES)
    discard(again)
    _sweep(spark, manifest, folder)
    return manifest


def _sweep(spark: SparkSession, manifest: DataFrame, folder: str) -> None:
    """Removes archives that no committed task wrote; the driver sees their names, one an archive."""
    there, root = filesystem(folder)
    named = {r.archive for r in manifest.select("archive").distinct().toLocalIterator()}
    for f in there.get_file_info(fs.FileSelector(root)):
        if f.base_name.endswith(".warc.zst") and f.base_name not in named:
            there.delete_file(f.path)


def open_archive(stream: io.RawIOBase) -> tuple[zstandard.ZstdCompressionDict, int]:
    """The dictionary at the head of an archive, and where its first record starts."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    data = stream.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if data.startswith(DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind), 8 + size


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and blocks of uncompressed records, one after another."""
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield fields, block


def record_row(archive: str, fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A row of RECORDS; a response's digest and length are those of the payload that was read."""

    def urn(name: str) -> str | None:
        return fields[name][len("<urn:uuid:") : -1] if name in fields else None

    def number(name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    stored = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    size, payload = number("x-payload-length"), None
    if fields["warc-type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != stored:
            raise ValueError(f"payload of record {fields['warc-record-id']} doesn't have its digest")
    return (
        archive, urn("warc-record-id"), fields["warc-type"], number("x-page-id"), fields.get("warc-target-uri"), size, stored,
        number("x-refers-to-page-id"), urn("warc-refers-to"), payload if with_payload else None,
    )


def read_archives(manifest: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """Records of all archives that the manifest names, read from the files, see RECORDS."""
    archives = materialize(manifest.select("archive").distinct())
    # A task an archive: left to Spark, rows so small would all come into one task.
    archives = archives.repartition(min(max(archives.count(), 1), READERS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, root = filesystem(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), RECORDS, strict=True)], schema=RECORDS)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with there.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                    words, _ = open_archive(stream)
                    plain = zstandard.ZstdDecompressor(dict_data=words).stream_reader(stream, read_across_frames=True)
                    rows, held = [], 0
                    for fields, block in parse_records(io.BufferedReader(plain, 1 << 16)):
                        rows.append(record_row(archive, fields, block, with_payload))
                        held += len(block) if with_payload else 0
                        if len(rows) >= 1000 or held >= 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return archives.mapInArrow(run, RECORDS_DDL)


def read_record(folder: str, archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the manifest, without the others."""
    there, root = filesystem(folder)
    with there.open_input_file(f"{root}/{archive}") as f:
        words, _ = open_archive(f)
        f.seek(offset)
        frame = f.read(length)
    return next(parse_records(io.BytesIO(zstandard.ZstdDecompressor(dict_data=words).decompress(frame))))


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(read(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = r"""
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
sized AS (SELECT page_id, body, octet_length(body) AS n FROM bodies),
firsts AS (SELECT body, max(page_id) AS first_id FROM sized WHERE n >= 1000 GROUP BY body)
SELECT s.page_id, s.n::BIGINT AS payload_bytes, sha1(s.body) AS payload_digest,
       CASE WHEN f.first_id <> s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> s.page_id THEN f.first_id END AS refers_to
FROM sized s LEFT JOIN firsts f ON s.n >= 1000 AND s.body = f.body
"""
