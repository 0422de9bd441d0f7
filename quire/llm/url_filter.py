"""URL filtering by a Bloom filter cascade (operator 6).

Every question that is asked of a url is a membership question: is this host
suffix with this path prefix an allow rule, a block rule, is this host on the
block list?  The complete universe of such keys in the corpus is known, so a
cascade answers exactly: level 0 encodes the listed keys, level 1 the keys of
the universe that pass level 0 wrongly, level 2 the listed keys that pass level
1 wrongly, and so on until a level lets nothing through wrongly.

Keys are dealt by hash to shards of a bounded number of keys, and each shard
builds its own cascade in one task.  The filters take some bits a listed key.
As many shards as fit into ``max_bytes`` are sent to the executors at a time;
if there are more, urls are asked in as many passes, each written before the
next.  No url is joined or shuffled.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; a rule fits its host and all subdomains if the path
starts with the rule's path; the longest rule wins, and of equally long ones the
first by code point; repeated rows are judged alike; without listed keys nothing
is blocked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import UPPER, materialize, read

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TRACKED = r"[?&](utm_[a-z]+|ref)="
SHARD_KEYS = 200_000
MAX_BYTES = 64 << 20
MAX_LEVELS = 200


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, PARTS, 1), UPPER, UPPER.lower()), F.regexp_extract(u, PARTS, 2)


def _hashes(keys: Sequence[str], level: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.fromiter((xxhash.xxh64_intdigest(k, 2 * level) for k in keys), "<u8", len(keys))
    two = np.fromiter((xxhash.xxh64_intdigest(k, 2 * level + 1) for k in keys), "<u8", len(keys))
    return one, two | np.uint64(1)


def _places(keys: Sequence[str], level: int, m: int, k: int) -> np.ndarray:
    one, two = _hashes(keys, level)
    return ((one[:, None] + np.arange(k, dtype="<u8")[None, :] * two[:, None]) % np.uint64(m)).astype(np.int64)


def _passes(keys: Sequence[str], level: int, m: int, k: int, bits: np.ndarray) -> np.ndarray:
    at = _places(keys, level, m, k)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def build_cascade(listed: Sequence[str], others: Sequence[str]) -> list[tuple[int, int, int, bytes]]:
    """(level, m, k, bits); exact for all keys of ``listed`` and ``others``."""
    levels: list[tuple[int, int, int, bytes]] = []
    inside, outside = list(listed), list(others)
    while inside and len(levels) < MAX_LEVELS:
        level = len(levels)
        rate = 0.5 if level else min(0.5, max(1e-6, 0.7 * len(inside) / max(1, len(outside))))
        k = max(1, round(-math.log2(rate)))
        m = max(64, 8 * math.ceil(1.45 * len(inside) * k / 8))
        bits = np.zeros(m // 8, np.uint8)
        at = _places(inside, level, m, k).ravel()
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        levels.append((level, m, k, bits.tobytes()))
        through = [x for x, p in zip(outside, _passes(outside, level, m, k, bits), strict=True) if p] if outside else []
        inside, outside = through, inside
    if inside:
        raise RuntimeError("the cascade doesn't end: two keys hash alike at every level")
    return levels


def ask(keys: Sequence[str], levels: Sequence[tuple[int, int, int, np.ndarray]]) -> np.ndarray:
    """Which keys of the universe are listed."""
    out = np.zeros(len(keys), bool)
    going = np.arange(len(keys))
    for level, m, k, bits in levels:
        if not len(going):
            break
        going = going[_passes([keys[i] for i in going], level, m, k, bits)]
        # What passes an even level is listed unless the next level holds it, and so on in turn.
        out[going] = level % 2 == 0
    return out


def shard_of(key: str, shards: int) -> int:
    return xxhash.xxh64_intdigest(key, 2**32 - 1) % shards


def rule_keys(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """All rules that could fit: suffixes of the host at dots with prefixes of the path."""
    labels = host.split(".")
    tails = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    return [t + path[:n] for t in tails for n in lengths if len(path) >= n]


def judge_urls(pages: DataFrame, listed_hosts: DataFrame, *, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, shard_keys: int = SHARD_KEYS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict, host_listed for every row of ``pages``.

    ``listed_hosts`` has the block list in its first column; a url that no rule
    fits is blocked if its host is listed.
    """
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, p, _ in rules})
    host, path = host_and_path(F.col(url))
    asked = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))

    def questions(h: str, p: str) -> list[str]:
        fits = rule_keys(h, p, lengths)
        return [f"a:{x}" for x in fits] + [f"b:{x}" for x in fits] + [f"h:{h}"]

    def keys_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {q for h, p in set(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) for q in questions(h, p)}
            yield pa.RecordBatch.from_pydict({"key": pa.array(sorted(found), pa.string()), "listed": pa.array([0] * len(found), pa.int32())})

    # The complete universe: each key once, whether listed or not.
    seen = asked.select("host", "path").mapInArrow(keys_of, "key string, listed int")
    on_list = listed_hosts.select(F.concat(F.lit("h:"), F.col(listed_hosts.columns[0])).alias("key"), F.lit(1).alias("listed"))
    of_rules = spark.createDataFrame([(f"{v[0]}:{h}{p}", 1) for h, p, v in rules] or [("a:", 1)], "key string, listed int")
    universe = materialize(seen.unionByName(on_list).unionByName(of_rules).where("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed")))
    shards = max(1, math.ceil(universe.count() / shard_keys))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"key": b.column(0), "listed": b.column(1), "shard": pa.array([shard_of(k, shards) for k in b.column(0).to_pylist()], pa.int64())})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, inside = pdf["key"].tolist(), pdf["listed"].to_numpy() > 0
        levels = build_cascade([k for k, x in zip(keys, inside, strict=True) if x], [k for k, x in zip(keys, inside, strict=True) if not x])
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), *x) for x in levels], columns=["shard", "level", "m", "k", "bits"])

    cascade = materialize(universe.mapInArrow(deal, "key string, listed int, shard long").groupBy("shard").applyInPandas(build, "shard long, level int, m long, k int, bits binary"))
    sizes = cascade.groupBy("shard").agg(F.sum(F.octet_length("bits") + 64).alias("bytes")).orderBy("shard").toLocalIterator()
    groups: list[list[int]] = [[]]
    room = max_bytes
    for r in sizes:
        if groups[-1] and r.bytes > room:
            groups.append([])
            room = max_bytes
        groups[-1].append(r.shard)
        room -= r.bytes

    def pass_over(shard_ids: list[int]):
        rows = cascade.where(F.col("shard").between(shard_ids[0], shard_ids[-1])).orderBy("shard", "level").collect() if shard_ids else []
        filters: dict[int, list] = {}
        for r in rows:  # at most max_bytes, or one shard
            filters.setdefault(r.shard, []).append((r.level, r.m, r.k, bytes(r.bits)))
        sent = spark.sparkContext.broadcast(filters)

        def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {s: [(lv, m, k, np.frombuffer(b, np.uint8)) for lv, m, k, b in x] for s, x in sent.value.items()}
            for b in batches:
                hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
                pairs = set(zip(hosts, paths, strict=True))
                by_shard: dict[int, list[str]] = {}
                for q in {q for h, p in pairs for q in questions(h, p)}:
                    by_shard.setdefault(shard_of(q, shards), []).append(q)
                yes = {q for s, qs in by_shard.items() if s in held for q, y in zip(qs, ask(qs, held[s]), strict=True) if y}
                hits = {hp: [q for q in questions(*hp) if q in yes] for hp in pairs}
                before = b.column("hits").to_pylist()
                now = [[*old, *hits[hp]] for old, hp in zip(before, zip(hosts, paths, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(now, pa.list_(pa.string()))], ["page_id", "host", "path", "hits"])

        return look_up

    out = asked.withColumn("hits", F.expr("CAST(array() AS ARRAY<STRING>)"))
    kind = out.schema["page_id"].dataType.simpleString()
    for i, ids in enumerate(groups):
        out = out.mapInArrow(pass_over(ids), f"page_id {kind}, host string, path string, hits array<string>")
        if i + 1 < len(groups):
            out = materialize(out)
    fits = F.filter("hits", lambda x: ~F.startswith(x, F.lit("h:")))
    best = F.get(F.sort_array(F.transform(fits, lambda x: F.struct((-F.char_length(x)).alias("n"), F.substring(x, 3, 1 << 30).alias("rule"), F.substring(x, 1, 1).alias("kind")))), F.lit(0))
    listed = F.exists("hits", lambda x: F.startswith(x, F.lit("h:")))
    out = out.withColumn("best", best).withColumn("host_listed", listed)
    verdict = F.when(F.col("best.kind") == "a", "allow").when((F.col("best.kind") == "b") | F.col("host_listed"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "host_listed")


def tracking_hosts(pages: DataFrame, url: str = "url", share: float = 0.5, min_urls: int = 3) -> DataFrame:
    """The block list of the query: hosts with tracking parameters in most of their urls."""
    host, _ = host_and_path(F.col(url))
    by_host = pages.select(host.alias("host"), F.coalesce(F.col(url).rlike(TRACKED), F.lit(False)).cast("int").alias("tracked")).where("host <> ''")
    return by_host.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("tracked").alias("t")).where((F.col("n") >= min_urls) & (F.col("t") > share * F.col("n"))).select("host")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, tracking_hosts(pages))


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

OP6_SQL = rf"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES_SQL}),
parts AS (
  SELECT row_number() OVER () AS row_id, page_id, url,
         translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
listed AS (
  SELECT host FROM parts WHERE host <> '' GROUP BY host
  HAVING count(*) >= 3 AND count(*) FILTER (regexp_matches(url, '{TRACKED}')) > 0.5 * count(*)),
fits AS (
  SELECT row_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY row_id ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path, verdict) AS rank
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN l.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.host IS NOT NULL AS host_listed
FROM parts p LEFT JOIN fits f ON p.row_id = f.row_id AND f.rank = 1 LEFT JOIN listed l ON p.host = l.host
"""
