"""What operators with Python code need from the running session."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once an application.

    The archive goes through Spark's own file distribution, so that workers on
    other machines find it however the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quire-code-")) / "quire.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def vectorised(kind: str, once: bool = False) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas UDF that is made when it is called, as its type needs a session.

    ``once`` is for costly ones: Spark then doesn't copy the call into filters that
    it derives from the result (as for an array that is exploded), which would run it twice.
    """

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*cols: Column | str) -> Column:
            made = F.pandas_udf(f, kind)
            return (made.asNondeterministic() if once else made)(*cols)

        return call

    return wrap


_ROOTS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A folder of this application below the cluster's ``spark.checkpoint.dir``.

    Where the setting is absent on one machine (tests) a temporary folder is
    made and registered as the checkpoint folder; on a cluster that is an error,
    since each executor would write to its own disk.
    """
    ship(spark)
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="quire-")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(base)
        _ROOTS[app] = f"{base.rstrip('/')}/quire-{app}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Delete the work folder when the driver ends, if the JVM still answers."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM has gone: nothing left to clean with
        pass


#: Removes an action's shuffle files when it ends, instead of at some later garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For plans that send texts to Python workers: batches of a few MB, whatever the texts' lengths.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, **values: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Cuts the lineage: later stages reread files that every executor can see,
    so a lost executor costs its own tasks only.  The write's shuffle files go
    with it.  ``values`` are settings for the write, as ``SMALL_BATCHES``.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true"} | values):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._quire_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(t._quire_path)
        p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
