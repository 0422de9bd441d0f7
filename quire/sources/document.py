"""One JSON file from a table of any size: tasks write their rows, the commit joins head, parts and tail.

The file's folder must be one that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quire.runtime import ship

#: Bytes that the commit holds while it copies a part.
CHUNK = 4 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    pieces: list[tuple[int, str]]


class _DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.pretty, self.overwrite = options["path"], options.get("pretty") == "true", overwrite
        self.sections = json.loads(options["sections"])
        # Made here, on the driver: a task that outlives an aborted write must not make it again.
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        there, root = filesystem(self.parts)
        there.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[Row]) -> _Part:
        # Names are a try's own: what a lost or repeated task wrote is in no message.
        there, root = filesystem(self.parts)
        if there.get_file_info(root).type == fs.FileType.NotFound:
            raise ValueError(f"the write of {self.path} has ended")
        name, pieces, out = uuid.uuid4().hex, [], None
        try:
            for section, value in iterator:
                if not pieces or section != pieces[-1][0]:
                    if any(section == s for s, _ in pieces):
                        raise ValueError("rows must be sorted by section")
                    if out:
                        out.close()
                    pieces.append((section, f"{root}/{name}-{section}"))
                    out = there.open_output_stream(pieces[-1][1], compression=None)
                else:
                    out.write(self.sections[section][1].encode())
                out.write(self._text(value).encode())
        finally:
            if out:
                out.close()
        return _Part(TaskContext.get().partitionId(), pieces)

    def _text(self, value: str | None) -> str:
        if value is None or not self.pretty:
            return "null" if value is None else value
        # No line end can stand inside a string of JSON.
        return json.dumps(json.loads(value), indent=2, ensure_ascii=False).replace("\n", "\n  ")

    def commit(self, messages: list[_Part | None]) -> None:
        # Spark aborts after a failed task, not after a failed commit.
        try:
            self._join(messages)
        finally:
            self.abort(messages)

    def _join(self, messages: list[_Part | None]) -> None:
        there, root = filesystem(self.parts)
        path = filesystem(self.path)[1]
        if not self.overwrite and there.get_file_info(path).type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} exists")
        pieces = [p for m in sorted((m for m in messages if m), key=lambda m: m.partition) for p in m.pieces]
        with there.open_output_stream(f"{root}/whole", compression=None) as out:
            for section, (head, between, tail, empty) in enumerate(self.sections):
                held = [p for s, p in pieces if s == section]
                if not held:
                    out.write(empty.encode())
                    continue
                for i, piece in enumerate(held):
                    out.write((between if i else head).encode())
                    with there.open_input_stream(piece, compression=None) as part:
                        while chunk := part.read(CHUNK):
                            out.write(chunk)
                out.write(tail.encode())
        there.move(f"{root}/whole", path)

    def abort(self, messages: list[_Part | None]) -> None:
        there, root = filesystem(self.parts)
        if there.get_file_info(root).type != fs.FileType.NotFound:
            there.delete_dir(root)


class DocumentSink(DataSource):
    """``df.write.format("quire-document")`` of (section int, value string), sorted by section, to one file.

    ``sections`` is a JSON list of [head, between, tail, empty]: the texts around
    a section's values, and the text that stands for a section without any.
    ``pretty`` writes values, which must be JSON then, over several lines.
    """

    @classmethod
    def name(cls) -> str:
        return "quire-document"

    def schema(self) -> str:
        return "section int, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _DocumentWriter(self.options, overwrite)


def section(head: str, between: str, tail: str, empty: str | None = None) -> list[str]:
    return [head, between, tail, head + tail if empty is None else empty]


def write_document(rows: DataFrame, path: str, sections: Sequence[list[str]], *, pretty: bool = False, replace: bool = True) -> None:
    """``rows`` (section, value), in their order, as one file.

    The file appears whole, by a move at the end; a write that fails leaves
    nothing, and without ``replace`` it fails where the file is there.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(DocumentSink)
    d = rows.select(F.col("section").cast("int").alias("section"), F.col("value").cast("string").alias("value"))
    d.write.format("quire-document").mode("overwrite" if replace else "append").option("sections", json.dumps(list(sections))).option("pretty", str(pretty).lower()).save(path)


def write_json_array(df: DataFrame, path: str, *order: str | Column, pretty: bool = True, nulls: bool = True) -> None:
    """A JSON array of the rows, in the order of ``order``; non-ASCII characters stay as they are."""
    value = F.to_json(F.struct("*"), {"ignoreNullFields": str(not nulls).lower()})
    # Sorted before the JSON is made, so that any column may be a key.
    d = (df.orderBy(*order) if order else df).select(F.lit(0).alias("section"), value.alias("value"))
    write_document(d, path, [section("[\n  ", ",\n  ", "\n]\n", "[]\n") if pretty else section("[", ",\n", "]\n")], pretty=pretty)
