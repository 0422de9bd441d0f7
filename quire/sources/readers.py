"""Sources: every scan has an explicit schema, and optional ones degrade to empty relations."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.text import normalize_title
from quire.schemas import OVERRIDES, PAPERS, PROGRAM, TALKS, YEARS

DEFAULT_SCALE, DEFAULT_MIN_PAPERS, DEFAULT_TOP = 6, 2, 20


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any file of a glob, is there; on any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def papers_json(spark: SparkSession, *paths: str) -> DataFrame:
    """One or more files (globs) that hold an array of papers each; ``file`` is where a row is from."""
    return spark.read.schema(PAPERS).json(list(paths), multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def papers_table(spark: SparkSession, path: str) -> DataFrame:
    """Papers as Parquet, partitioned by year."""
    return spark.read.parquet(path)


def without_errors(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers, error rows)."""
    return papers.where("error IS NULL"), papers.where("error IS NOT NULL")


def union_years(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def programs_json(spark: SparkSession, *paths: str) -> DataFrame:
    """year, session fields and ord of the presentations of program documents; the year is the document's."""
    d = spark.read.schema(PROGRAM).json(list(paths), multiLine=True).select("year", F.posexplode("sessions").alias("s_ord", "s"))
    p = d.select("year", "s_ord", F.col("s.session_id").alias("session_id"), F.col("s.session_title").alias("session_title"), F.col("s.day").alias("day"), F.posexplode("s.presentations").alias("p_ord", "p"))
    return p.select("year", "session_id", "session_title", "day", (F.col("s_ord").cast("long") * 100_000 + F.col("p_ord")).alias("ord"), "p.*")


def optional(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """A source that may be missing: no rows then, with its schema."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.json(path, multiLine=True) if fmt == "json" else reader.format(fmt).load(path)


def talks_json(spark: SparkSession, path: str) -> DataFrame:
    """Match results: a JSON object keyed by paper id, flattened; empty if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], TALKS)
    kind = "papers map<string,struct<type:string,session_id:string,session_title:string,day:string,match:string>>"
    return spark.read.schema(kind).json(path, multiLine=True).select(F.explode("papers").alias("paper_id", "t")).select("paper_id", "t.*")


def yaml_rows(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def year_config(spark: SparkSession, base: dict, submissions: dict[int, int] | None = None) -> DataFrame:
    """Configuration as a table, one row a year: the year's block over the base's, with defaults."""
    names = StructType.fromDDL(YEARS).fieldNames()
    defaults = {"review_scale_max": DEFAULT_SCALE, "coauthorship_network_min_papers": DEFAULT_MIN_PAPERS, "num_top_papers": DEFAULT_TOP, "score_parse_mode": "parens", "post_rebuttal_has_score": False}
    rows = []
    for year, block in sorted((base.get("years") or {}).items()):
        row = defaults | {k: v for k, v in base.items() if k in names} | (block or {}) | {"year": int(year), "n_submitted": (submissions or {}).get(int(year))}
        row["extra_review_fields"] = [(x["label_substring"], x["store_as"]) for x in row.get("extra_review_fields") or []]
        rows.append(tuple(row.get(n) for n in names))
    return spark.createDataFrame(rows, YEARS)


def chart_settings(settings: dict, allowed: dict[str, tuple]) -> dict:
    """Settings whose unknown values fall back to the first allowed one."""
    return {k: settings.get(k) if settings.get(k) in v else v[0] for k, v in allowed.items()}


def overrides(spark: SparkSession, blocks: dict) -> DataFrame:
    """Hand-written matches: titles are normalised; a null id is a deliberate skip."""
    rows = [(int(y), t, p) for y, b in blocks.items() if str(y).isdigit() for t, p in (b or {}).items()]
    if not rows:
        return spark.createDataFrame([], OVERRIDES)
    d = spark.createDataFrame(rows, "year int, title string, paper_id string")
    return d.select("year", normalize_title(F.col("title")).alias("norm_title"), "paper_id", F.col("paper_id").isNull().alias("is_skip"))


def labels_json(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, label, clustering (stamp) of a label file of either shape.

    The older shape is a bare map of labels; it has no stamp.
    """
    raw = spark.read.text(path, wholetext=True)
    new = F.from_json("value", "labels map<string,string>, clustering string")
    old = F.from_json("value", "map<string,string>")
    d = raw.select(F.coalesce(new["labels"], old).alias("labels"), new["clustering"].alias("clustering"))
    return d.select(F.explode("labels").alias("k", "label"), "clustering").where(F.col("k").rlike(r"^-?\d+$")).select(F.col("k").cast("int").alias("cluster_id"), "label", "clustering")


def index_json(spark: SparkSession, path: str) -> DataFrame:
    """The papers of a compact browse index, areas decoded to names and omitted links null."""
    paper = (
        "struct<id:string,year:int,title:string,authors:array<string>,areas:array<int>,url:string,score:double,score_norm:double,reviews:array<int>,"
        "early:int,type:int,session:string,code_url:string,pdf_url:string,doi:string,sharedit_url:string,supp_url:string,lncs:string,dataset_urls:array<string>>"
    )
    raw = spark.read.schema(f"built string, areas array<string>, scales map<string,int>, papers array<{paper}>").json(path, multiLine=True)
    d = raw.select("areas", "scales", F.explode("papers").alias("p")).select(F.col("areas").alias("names"), "scales", "p.*")
    scale = F.coalesce(F.try_element_at("scales", F.col("year").cast("string")), F.lit(DEFAULT_SCALE))
    return d.withColumn("areas", F.transform("areas", lambda i: F.get("names", i))).withColumn("scale", scale).drop("names", "scales")


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Vectors: Parquet, or NPZ files with parallel arrays (driver-side, for files of one machine)."""
    if not path.endswith(".npz"):
        return spark.read.parquet(path)
    import numpy as np

    z = np.load(path, allow_pickle=False)
    ids, vectors, clusters = z["paper_ids"], z["embeddings"], z["cluster_ids"]
    rows = [(str(i), [float(x) for x in v], int(c), k) for k, (i, v, c) in enumerate(zip(ids, vectors, clusters, strict=True))]
    return spark.createDataFrame(rows, "paper_id string, embedding array<float>, cluster_id int, ord long")
