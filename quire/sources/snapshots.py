"""Versions of the master table: an update by id rewrites the partitions it changes, readers see one version whole.

``root/parts`` holds the Parquet folders of all writes, ``root/versions`` a
manifest a version, ``root/CURRENT`` the number of the version that readers
take.  It is moved into place last, so a reader, or a writer that fails, is
left with the version before.  One writer at a time; old parts stay.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.runtime import discard, materialize
from quire.sources.document import filesystem


def _get(root: str, name: str) -> str | None:
    there, path = filesystem(f"{root}/{name}")
    if there.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with there.open_input_stream(path) as f:
        return f.read().decode()


def _put(root: str, name: str, text: str) -> None:
    there, path = filesystem(f"{root}/{name}")
    there.create_dir(path.rpartition("/")[0], recursive=True)
    made = f"{path}.{uuid.uuid4().hex}"
    with there.open_output_stream(made) as f:
        f.write(text.encode())
    there.move(made, path)


def manifest(root: str, version: int | None = None) -> dict:
    """The manifest of a version, by default the current one."""
    if version is None:
        now = _get(root, "CURRENT")
        if now is None:
            raise FileNotFoundError(f"no version in {root}")
        version = int(now)
    found = _get(root, f"versions/{version}.json")
    if found is None:
        raise FileNotFoundError(f"no version {version} in {root}")
    return json.loads(found)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of the table; it stays the same while others are published."""
    return _read(spark, root, manifest(root, version))


def _read(spark: SparkSession, root: str, m: dict) -> DataFrame:
    schema = StructType.fromJson(m["schema"])
    if not m["parts"]:
        return spark.createDataFrame([], schema)
    folders = [f"{root}/parts/{write}/{part}" for part, write in sorted(m["parts"].items())]
    return spark.read.schema(StructType(schema.fields[:]).add("write", "string")).option("basePath", f"{root}/parts").parquet(*folders).select(*schema.names)


def _write(df: DataFrame, root: str, by: str) -> dict[str, str]:
    """Folder by partition of a new write; a large partition is written by several tasks."""
    write = f"write={uuid.uuid4().hex}"
    df.hint("rebalance", F.col(by)).write.partitionBy(by).parquet(f"{root}/parts/{write}")
    there, path = filesystem(f"{root}/parts/{write}")
    return {i.base_name: write for i in there.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.Directory}


def _publish(root: str, m: dict) -> int:
    _put(root, f"versions/{m['version']}.json", json.dumps(m))
    _put(root, "CURRENT", str(m["version"]))
    return m["version"]


def create(df: DataFrame, root: str, by: str = "year", **notes: str) -> int:
    """``df`` as the next version, whole; its number."""
    now = _get(root, "CURRENT")
    version = 1 if now is None else int(now) + 1
    return _publish(root, {"version": version, "by": by, "schema": df.schema.jsonValue(), "parts": _write(df, root, by), "notes": notes})


def update(spark: SparkSession, root: str, patch: DataFrame, key: str = "paper_id", **notes: str) -> tuple[int, int]:
    """(version, rows changed): the patch's columns take the place of the table's own, for the keys that the patch has.

    Other rows keep theirs; columns that the table lacks are added, null there.
    Keys of the patch that the table lacks are ignored, null keys meet nothing;
    a key must not be repeated in the patch.  Only partitions with a row that
    changes are rewritten; without a change and with equal notes no version is made.
    """
    m = manifest(root)
    by, master = m["by"], _read(spark, root, m)
    names = [c for c in patch.columns if c != key]
    if not names:
        return m["version"], 0
    if by in names:
        raise ValueError(f"{by} is the partition and can't be changed")
    if not patch.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > 1)).isEmpty():
        raise ValueError(f"the patch repeats a {key}")
    added = [c for c in names if c not in master.columns]
    wide = master.select("*", *[F.lit(None).cast(patch.schema[c].dataType).alias(c) for c in added])
    new = patch.select(F.col(key).alias("_key"), F.struct(*[F.col(c).cast(wide.schema[c].dataType).alias(c) for c in names]).alias("_new"))
    old = F.struct(*names)
    # Keys and the patch's columns only: what else the table holds isn't read here.
    changed = materialize(wide.select(key, by, old.alias("_old")).join(new, F.col(key) == F.col("_key")).where(~F.col("_old").eqNullSafe(F.col("_new"))).select("_key", "_new", by))
    try:
        n = changed.count()
        if not n and not added and (m["notes"] | notes) == m["notes"]:
            return m["version"], 0
        parts = dict(m["parts"])
        # A row a partition.
        touched = [r[0] for r in (wide if added else changed).select(by).distinct().collect()]
        if touched:
            held = wide.where(F.col(by).isin([x for x in touched if x is not None]) | (F.col(by).isNull() if None in touched else F.lit(False)))
            both = held.join(changed.drop(by), F.col(key) == F.col("_key"), "left")
            value = lambda c: F.when(F.col("_key").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
            parts |= _write(both.select(*[value(c) for c in wide.columns]), root, by)
        return _publish(root, {"version": m["version"] + 1, "by": by, "schema": wide.schema.jsonValue(), "parts": parts, "notes": m["notes"] | notes}), n
    finally:
        discard(changed)
