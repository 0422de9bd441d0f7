"""Nearest neighbours in high dimensions, and a map of their graph.

``nearest_neighbours`` grows random projection trees (each level is one exact
rank of narrow rows, so leaves are of equal size whatever the data), compares
all vectors of a leaf, and then lets neighbours of a vector meet each other
(bounded lists on both sides).  No pair outside a leaf or a list is looked at.

``neighbour_map`` moves points along the graph's edges and away from a few
random others, a table a round.  Forces are summed as whole numbers, so that
every run gives the same coordinates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.order import ranked, ranked_in
from quire.runtime import discard, materialize, ship

#: Parts that a node of a tree is split into.
SPLIT = 3
#: Shape of the attraction and repulsion curves for points at least a tenth apart.
CURVE_A, CURVE_B = 1.577, 0.8951
#: Forces are summed in units of this size.
UNIT = 1e-9


def _pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, squared distance) of each row's k nearest other rows, equal distances by row."""
    n, k = len(v), min(k, len(v) - 1)
    if k < 1:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0)
    rows, near, far = [], [], []
    for i in range(0, n, 64):
        d = v[i : i + 64, None, :] - v[None]
        d2 = np.einsum("ijk,ijk->ij", d, d)
        mine = np.arange(i, min(i + 64, n))
        d2[np.arange(len(mine)), mine] = np.inf
        best = np.argsort(d2, axis=1, kind="stable")[:, :k]
        rows.append(np.repeat(mine, k))
        near.append(best.ravel())
        far.append(np.take_along_axis(d2, best, axis=1).ravel())
    return np.concatenate(rows), np.concatenate(near), np.concatenate(far)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _leaves(points: DataFrame, n: int, dims: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """tree, node, id: a leaf of at most ``leaf`` points for each tree and point."""
    levels = max(0, math.ceil(math.log(max(n / leaf, 1), SPLIT)))
    axes = np.random.default_rng(seed).standard_normal((dims, trees * max(levels, 1)))

    def project(batches):
        for b in batches:
            p = _matrix(pa.chunked_array([b.column("v")]), dims) @ axes
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), flat], names=["id", "p"])

    kind = points.schema["id"].dataType.simpleString()
    rows = points.select("id", "v").mapInArrow(project, f"id {kind}, p array<double>")
    every = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.slice("p", t * max(levels, 1) + 1, F.lit(max(levels, 1))).alias("p")))
    d = rows.select("id", F.inline(every)).withColumn("node", F.lit(0).cast("long"))
    for level in range(levels):
        d = ranked_in(d.withColumn("_x", F.get("p", F.lit(level))), ["tree", "node"], "_x", "id", name="_r", size="_n")
        d = d.withColumn("node", F.col("node") * SPLIT + F.floor(F.col("_r") * SPLIT / F.col("_n"))).drop("_x", "_r", "_n")
    return d.select("tree", "node", "id")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """id, neighbour, d2: the k nearest, equal distances by neighbour."""
    first = Window.partitionBy("id").orderBy("d2", "neighbour")
    return pairs.dropDuplicates(["id", "neighbour"]).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")


def nearest_neighbours(vectors: DataFrame, k: int = 15, *, key: str = "paper_id", embedding: str = "embedding", trees: int = 12, leaf: int = 400, rounds: int = 2, seed: int = 42) -> DataFrame:
    """id, rank (from 1), neighbour, distance of each vector's k nearest others, approximately.

    Vectors that are null, have a component that is null or no number, or are of
    another length than most are left out.  Equal vectors are one point in the
    search, so that many copies are no work; afterwards each copy's neighbours are
    the copies of the smallest keys, then those of the points around.
    """
    ship(vectors.sparkSession)
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    d = vectors.select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & whole)
    common = d.groupBy(F.size("v").alias("m")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("m")).first()
    kind = vectors.schema[key].dataType.simpleString()
    if common is None or not common.m:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, rank int, neighbour {kind}, distance double")
    dims = common.m
    d = materialize(d.where(F.size("v") == dims).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v")))
    points = materialize(d.groupBy("h1", "h2").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id")).select("id", "v", "h1", "h2"))
    n = points.count()
    leaves = materialize(_leaves(points, n, dims, trees, leaf, seed))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        a, b, d2 = _pairs(_matrix(t["v"], dims), k)
        ids = t["id"].combine_chunks()
        return pa.table({"id": ids.take(pa.array(a)), "neighbour": ids.take(pa.array(b)), "d2": pa.array(d2)})

    pair = f"id {kind}, neighbour {kind}, d2 double"
    graph = materialize(_best(leaves.join(points.select("id", "v"), "id").groupBy("tree", "node").applyInArrow(compare, pair), k))
    for _ in range(rounds):
        worst = graph.groupBy("id").agg(F.max("d2").alias("worst"), F.count(F.lit(1)).alias("n")).select("id", F.when(F.col("n") == k, F.col("worst")).alias("worst"))
        back = Window.partitionBy("neighbour").orderBy("d2", "id")
        reverse = graph.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= k).select(F.col("neighbour").alias("at"), "id")
        lists = graph.select(F.col("id").alias("at"), F.col("neighbour").alias("id")).unionByName(reverse).unionByName(points.select(F.col("id").alias("at"), "id")).distinct()
        members = lists.join(points.select("id", "v"), "id").join(worst, "id", "left")

        def meet(t: pa.Table) -> pa.Table:
            t = t.sort_by("id")
            a, b, d2 = _pairs(_matrix(t["v"], dims), k)
            limit = t["worst"].to_pandas().fillna(np.inf).to_numpy()
            better = d2 < limit[a]
            ids = t["id"].combine_chunks()
            return pa.table({"id": ids.take(pa.array(a[better])), "neighbour": ids.take(pa.array(b[better])), "d2": pa.array(d2[better])})

        new = materialize(_best(graph.unionByName(members.groupBy("at").applyInArrow(meet, pair)), k))
        discard(graph)
        graph = new
    # From points to rows: the copies of smallest keys of a point stand for it.
    copy = Window.partitionBy("h1", "h2").orderBy("id")
    firsts = d.select("id", "h1", "h2").withColumn("_r", F.row_number().over(copy)).where(F.col("_r") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    named = points.select(F.col("id").alias("point"), "h1", "h2").join(firsts, ["h1", "h2"]).select("point", "h1", "h2", "ids")
    around = graph.join(named.select(F.col("point").alias("neighbour"), "ids"), "neighbour").select(F.col("id").alias("point"), "d2", F.explode("ids").alias("other"))
    around = around.groupBy("point").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "other"))), 1, k).alias("near"))
    lists = materialize(named.join(around, "point", "left").select("h1", "h2", F.concat(F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d2"), i.alias("other"))), F.coalesce("near", F.expr(f"CAST(array() AS array<struct<d2:double,other:{kind}>>)"))).alias("near")))
    mine = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    out = d.join(lists, ["h1", "h2"]).select("id", F.posexplode(mine).alias("p", "x"))
    return out.select("id", (F.col("p") + 1).alias("rank"), F.col("x.other").alias("neighbour"), F.sqrt("x.d2").alias("distance"))


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true (id, neighbour) pairs that were found."""
    both = true.select("id", "neighbour").join(found.select("id", "neighbour").withColumn("hit", F.lit(1)), ["id", "neighbour"], "left")
    return float(both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0)


def _whole(x: Column) -> Column:
    return F.round(x / UNIT).cast("long")


def neighbour_map(graph: DataFrame, start: DataFrame, *, rounds: int = 12, away: int = 5, step: float = 1.0, seed: int = 42) -> DataFrame:
    """id, x, y: a map in which near neighbours are near.

    ``graph`` is that of ``nearest_neighbours``, ``start`` (id, x, y) the first
    positions, as principal components give them.  An edge weighs exp(-(d - d1) / s), d1 the
    distance to the nearest and s the mean excess of a vector's distances; both
    directions count as one (a + b - ab).  A round adds the pulls of a point's edges and
    the pushes of ``away`` points drawn by hash, each bounded, and cools.
    """
    by = Window.partitionBy("id")
    w = graph.withColumn("d1", F.min("distance").over(by)).withColumn("s", F.avg(F.col("distance")).over(by) - F.min("distance").over(by))
    w = w.select("id", "neighbour", F.when(F.col("s") > 0, F.exp(-(F.col("distance") - F.col("d1")) / F.col("s"))).otherwise(1.0).alias("w"))
    both = w.unionByName(w.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), "w"))
    edges = materialize(both.groupBy("id", "neighbour").agg(F.when(F.count(F.lit(1)) == 2, F.sum("w") - F.max("w") * F.min("w")).otherwise(F.max("w")).alias("w")))
    at = start.select("id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    size = at.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m"), F.count(F.lit(1)).alias("n")).first()
    n, scale = size.n, 10.0 / (size.m or 1.0)
    now = materialize(ranked(at.withColumn("x", F.col("x") * scale).withColumn("y", F.col("y") * scale), "id", name="no"))
    bounded = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
    for turn in range(rounds):
        a, b = now.select(F.col("id").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1")), now.select(F.col("id").alias("j"), F.col("no").alias("j_no"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
        d2 = dx * dx + dy * dy
        curve = 1 + CURVE_A * F.pow(d2, F.lit(CURVE_B))
        pull = F.when(d2 > 0, F.col("w") * -2 * CURVE_A * CURVE_B * F.pow(d2, F.lit(CURVE_B - 1)) / curve).otherwise(0.0)
        push = 2 * CURVE_B / ((0.001 + d2) * curve)
        pulled = edges.join(a, F.col("id") == F.col("i")).join(b.drop("j_no"), F.col("neighbour") == F.col("j")).select("id", _whole(bounded(pull * dx)).alias("fx"), _whole(bounded(pull * dy)).alias("fy"))
        drawn = a.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(away - 1)), lambda e: F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), e, "i"), F.lit(n)))).alias("other"))
        pushed = drawn.join(b, F.col("other") == F.col("j_no")).where("i <> j").select(F.col("i").alias("id"), _whole(bounded(push * dx)).alias("fx"), _whole(bounded(push * dy)).alias("fy"))
        force = pulled.unionByName(pushed).groupBy("id").agg((F.sum("fx") * UNIT).alias("fx"), (F.sum("fy") * UNIT).alias("fy"))
        heat = step * (1 - turn / rounds)
        moved = materialize(now.join(force, "id", "left").select("id", *[(F.col(c) + heat * bounded(F.coalesce(f"f{c}", F.lit(0.0)))).alias(c) for c in ("x", "y")], "no"))
        discard(now)
        now = moved
    return now.select("id", "x", "y")
