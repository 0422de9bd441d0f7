"""Centroid clustering (operator 13): Lloyd's rounds with Elkan's bounds.

Vectors are integers (floor of ``scale`` times each component), so distances,
sums and centroids are exact.  Between rounds a table keeps, per vector, its
cluster, an upper bound of the distance to that centroid and k lower bounds, one
for each centroid.  When centroids move, the upper bound grows and the lower
bounds shrink by how far.  A distance is calculated only where neither the lower
bound nor half the distance between the two centroids exceeds the upper bound.

Bounds are single-precision numbers, upper ones rounded up, lower ones, half
distances and what is taken off rounded down, and only a bound that is strictly
greater skips a centroid; so a centroid at the same distance is always looked at,
and the smaller number wins a tie by exact integers.

A round is one pass over the table: tasks read vectors with their bounds, write
them anew and add one row a cluster with the sums of their own vectors.  The
driver gets k centroids (k and the number of components are parameters), never
vectors.  A lost executor costs its tasks; a round's table is on the shared disk.

Defined cases: vectors that are null, of another number of components, with a null
or non-finite component, or one of 2^27 or more after scaling (its squared
distances might not fit a long) are left out; a vector's hash decides whether it
starts as a centroid, rows of one id then by their components, null ids last; rows
of one id are vectors of their own; fewer vectors than k make fewer clusters, none
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import discard, materialize, read

#: Scaled components stay below this, so that 64 squared differences add up to less than 2^63.
LARGEST = 2**27
STATE = "vec_id long, v array<int>, cluster int, upper float, lower array<float>, n_distances long, distance long, members long, sums array<long>"


def whole_vectors(table: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = 64, scale: float = 256.0) -> DataFrame:
    """vec_id, v (array of int): vectors of ``dims`` finite components, scaled and rounded down."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).where(F.size("e") == dims)
    scaled = F.transform("e", lambda x: F.lit(scale) * x.cast("double"))
    fits = F.forall(scaled, lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)))  # NaN is greater than all numbers
    return rows.where(fits).select("vec_id", F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of ``seed:vec_id``."""
    rows = vectors.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"))
    return np.array([r.v for r in rows.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()], np.int64)


def _up(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are at least ``x``."""
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers of at most ``x``, never negative."""
    return np.maximum(np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a to a row of b, or row by row."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Round:
    """What a round's tasks know: centroids, their distances to each other, how far each has moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        self.c = centroids
        k = len(centroids)
        gaps = np.array([squares(centroids, row) for row in centroids]).reshape(k, k)
        self.half = _down(np.sqrt(gaps) / 2)
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(axis=1) if k > 1 else np.full(k, np.inf, np.float32)
        self.moved = _up(np.sqrt(squares(centroids, before))) if before is not None else None
        if before is not None:
            self.moved[(centroids == before).all(axis=1)] = 0

    def start(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cluster, upper, lower, number of distances, squared distance: all distances are calculated once."""
        exact = np.stack([squares(v, c) for c in self.c], axis=1)
        cluster = exact.argmin(axis=1)  # the first, so the smaller number
        distance = exact[np.arange(len(v)), cluster]
        return cluster, _up(np.sqrt(distance)), _down(np.sqrt(exact)), np.full(len(v), len(self.c)), distance

    def step(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same by bounds of the round before."""
        rows = np.arange(len(v))
        upper = _up(upper.astype(np.float64) + self.moved[cluster])
        lower = np.where(self.moved == 0, lower, _down(lower.astype(np.float64) - self.moved))
        counts = np.zeros(len(v), np.int64)
        distance = np.full(len(v), -1, np.int64)
        cluster = cluster.copy()

        def open_to(at: np.ndarray) -> np.ndarray:
            """Which centroids aren't ruled out for these vectors."""
            own = cluster[at]
            need = (upper[at, None] >= lower[at]) & (upper[at, None] >= self.half[own])
            need[np.arange(len(at)), own] = False
            return need

        at = rows[upper >= self.nearest[cluster]]
        at = at[open_to(at).any(axis=1)]
        distance[at] = squares(v[at], self.c[cluster[at]])
        upper[at] = _up(np.sqrt(distance[at]))
        lower[at, cluster[at]] = _down(np.sqrt(distance[at]))
        counts[at] += 1
        at = at[open_to(at).any(axis=1)]
        for j in range(len(self.c)):
            mine = at[(upper[at] >= lower[at, j]) & (upper[at] >= self.half[cluster[at], j]) & (cluster[at] != j)]
            if not len(mine):
                continue
            exact = squares(v[mine], self.c[j])
            counts[mine] += 1
            lower[mine, j] = _down(np.sqrt(exact))
            better = (exact < distance[mine]) | ((exact == distance[mine]) & (j < cluster[mine]))
            won = mine[better]
            cluster[won], distance[won] = j, exact[better]
            upper[won] = _up(np.sqrt(exact[better]))
        return cluster, upper, lower, counts, distance


def assign(table: DataFrame, now: Round, last: bool) -> DataFrame:
    """One pass: vectors with their cluster and bounds, and a row a task and cluster with the sums of its vectors."""
    dims = now.c.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(now.c)
        members, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dims)
            if now.moved is None:
                cluster, upper, lower, counts, distance = now.start(v)
            else:
                held = batch.column("lower").flatten().to_numpy().reshape(-1, k)
                cluster, upper, lower, counts, distance = now.step(v, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), held)
                counts += batch.column("n_distances").to_numpy()
            if last:
                open_ = distance < 0
                distance[open_] = squares(v[open_], now.c[cluster[open_]])
            np.add.at(members, cluster, 1)
            np.add.at(sums, cluster, v)
            if last:
                lower = lower[:, :0]
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * lower.shape[1]), pa.array(lower.ravel()))
            none = pa.nulls(len(v), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(upper), bounds, pa.array(counts), pa.array(distance if last else np.zeros_like(distance)), none, pa.nulls(len(v), pa.list_(pa.int64()))],
                names=FIELDS,
            )
        used = np.flatnonzero(members)
        empty = [pa.nulls(len(used), t) for t in (pa.int64(), pa.list_(pa.int32()))]
        rest = [pa.nulls(len(used), t) for t in (pa.float32(), pa.list_(pa.float32()), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(used.astype(np.int32)), *rest, pa.array(members[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=FIELDS)

    return table.mapInArrow(run, STATE)


FIELDS = [f.split()[0] for f in STATE.split(", ")]


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Means of the clusters' vectors, rounded down; a cluster without any keeps its centroid."""
    parts = state.where("members IS NOT NULL").select("cluster", "members", F.posexplode("sums").alias("at", "x"))
    found = parts.groupBy("cluster", "at").agg(F.sum("x").alias("x"), F.sum("members").alias("n")).collect()  # k times the number of components
    new = centroids.copy()
    for r in found:
        new[r.cluster, r["at"]] = r.x // r.n
    return new


def cluster_vectors(vectors: DataFrame, *, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256
    and n_distances (calculated for the vector in all passes; a plain search takes
    k a pass) of vectors as ``whole_vectors`` gives them.
    """
    spark = vectors.sparkSession
    table = materialize(vectors)
    centroids, before = first_centroids(table, k, seed), None
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_distances long"
    if not len(centroids):
        discard(table)
        return spark.createDataFrame([], out)
    state = table
    for turn in range(rounds + 1):
        now = Round(centroids, before)
        new = materialize(assign(state, now, last=turn == rounds))
        if turn < rounds:
            centroids, before = moved_centroids(new, centroids), centroids
            discard(state)
            state = new.where("members IS NULL")
            state._quire_path = new._quire_path
    discard(state)
    final = new.where("members IS NULL").select("vec_id", "cluster", "distance", "n_distances")
    hashes = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    inertia = final.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    totals = materialize(inertia.join(names, "cluster"))
    total = totals.agg(F.sum("cluster_inertia")).first()[0]
    rows = final.join(totals, "cluster").withColumn("inertia", F.lit(total).cast("long"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_distances")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster_vectors(whole_vectors(read(spark, sf_dir, "embeddings")))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int = 5) -> str:
    """The same by plain search: a table of distances, an assignment and new centroids for each round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT vec_id, v, unnest([arg_min({{'c': c, 'd': d}}, {{'d': d, 'c': c}})], recursive := true) FROM (
    SELECT x.vec_id, x.v, m.c, list_sum(list_transform(list_zip(x.v, m.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM kept x, cent{i} m) GROUP BY vec_id, v)""")
        if i < rounds:
            steps.append(f"""mean{i} AS MATERIALIZED (
  SELECT c, list(x ORDER BY i) AS m FROM (
    SELECT c, i, floor_div(sum(x), count(*)) AS x FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM near{i}) GROUP BY c, i) GROUP BY c),
cent{i + 1} AS MATERIALIZED (SELECT p.c, coalesce(n.m, p.m) AS m FROM cent{i} p LEFT JOIN mean{i} n USING (c))""")
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
cent0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INTEGER AS c, v AS m FROM kept
  ORDER BY sha256('2:' || vec_id) LIMIT 40),
{','.join(steps)}
SELECT n.vec_id, n.c AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia, (sum(n.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.m, ',')) AS centroid_sha256
FROM near{rounds} n JOIN cent{rounds} m USING (c)
"""
    return sql.replace("floor_div(sum(x), count(*))", "((sum(x)::BIGINT - (((sum(x)::BIGINT % count(*)) + count(*)) % count(*))) // count(*))")


OP13_SQL = _rounds_sql()
