"""Layout of graphs of any size: each component apart, then boxes packed on shelves.

A component of at most ``SMALL`` vertices is laid out whole in a task.  A larger
one is a table: in each round a vertex is pulled along its edges and pushed by the
sums of grid cells, those around it and the coarse ones further off, so that no
task sees all vertices and no pair of vertices is a row.  Forces are summed as
whole numbers; every run gives the same coordinates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import connected_components
from quire.operators.order import ranked_in
from quire.runtime import discard, materialize, ship

#: Vertices of a component that one task lays out (its forces are arrays of vertices by vertices).
SMALL = 500
#: Ideal distance in units of 1 / sqrt(vertices), rounds, and the seed of first positions.
SPREAD, ROUNDS, SEED = 2.5, 50, 42
#: Cells that push one by one are this wide, in ideal distances; a component has at most COARSE x COARSE coarse ones.
CELL, COARSE = 2.0, 8
UNIT = 1e-9
#: Space between boxes, and the width of the shelves in square roots of all widths.
GAP, WIDTH = 0.35, 1.6


def spring(n: int, links: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Positions of n vertices by springs along the links and repulsion between all."""
    pos = np.random.default_rng(seed).random((n, 2))
    pull = np.zeros((n, n))
    pull[links[:, 0], links[:, 1]] = pull[links[:, 1], links[:, 0]] = weights
    k, heat = SPREAD / math.sqrt(n), 0.1
    for turn in range(rounds):
        delta = pos[:, None] - pos[None]
        dist = np.maximum(np.sqrt((delta**2).sum(-1)), 0.01)
        force = (delta * (k * k / dist**2 - pull * dist / k)[..., None]).sum(1)
        size = np.maximum(np.sqrt((force**2).sum(-1)), 0.01)
        pos += force / size[:, None] * heat * (1 - turn / rounds)
    return pos


def _large(edges: DataFrame, members: DataFrame, rounds: int, seed: int) -> DataFrame:
    """component, id, x, y of large components; lengths are in ideal distances."""
    side = F.sqrt(F.col("n").cast("double")) / SPREAD
    at = lambda s: F.pmod(F.xxhash64(F.lit(seed + s), "id"), F.lit(1 << 30)) / float(1 << 30) * side
    now = materialize(members.select("component", "id", "n", at(0).alias("x"), at(1).alias("y")))
    whole = lambda c: F.round(c / UNIT).cast("long")
    for turn in range(rounds):
        box = now.groupBy("component").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / COARSE + 1e-9).alias("wide"))
        cells = now.withColumn("cx", F.floor(F.col("x") / CELL)).withColumn("cy", F.floor(F.col("y") / CELL))
        coarse = now.join(box, "component").withColumn("bx", F.floor((F.col("x") - F.col("x0")) / F.col("wide"))).withColumn("by", F.floor((F.col("y") - F.col("y0")) / F.col("wide")))
        sums = [F.count(F.lit(1)).alias("m"), (F.sum(whole(F.col("x"))) * UNIT).alias("sx"), (F.sum(whole(F.col("y"))) * UNIT).alias("sy")]
        near = cells.groupBy("component", F.col("cx").alias("ox"), F.col("cy").alias("oy")).agg(*sums)
        far = coarse.groupBy("component", F.col("bx").alias("ox"), F.col("by").alias("oy")).agg(*sums)

        def pushed(own: Column, others: Column) -> list[Column]:
            """The push of m others whose mean is at sx / m, sy / m; a vertex's own cell is without itself."""
            m = others - own.cast("long")
            gap = [F.col(c) - (F.col(f"s{c}") - F.when(own, F.col(c)).otherwise(0.0)) / m for c in ("x", "y")]
            d2 = F.greatest(gap[0] * gap[0] + gap[1] * gap[1], F.lit(0.01))
            return [F.when(m > 0, whole(m * g / d2)).otherwise(0).alias(n) for g, n in zip(gap, ("fx", "fy"), strict=True)]

        around = F.array(*[F.struct((F.col("cx") + i).alias("ox"), (F.col("cy") + j).alias("oy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        a = cells.withColumn("o", F.explode(around)).select("component", "id", "x", "y", "cx", "cy", "o.*").join(near, ["component", "ox", "oy"])
        a = a.select("component", "id", *pushed((F.col("cx") == F.col("ox")) & (F.col("cy") == F.col("oy")), F.col("m")))
        every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(COARSE - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(COARSE - 1)), lambda j: F.struct(i.cast("long").alias("ox"), j.cast("long").alias("oy")))))
        b = coarse.withColumn("o", F.explode(every)).where("o.ox <> bx OR o.oy <> by").select("component", "id", "x", "y", "o.*").join(far, ["component", "ox", "oy"])
        b = b.select("component", "id", *pushed(F.lit(False), F.col("m")))
        ends = [now.select(F.col("id").alias(e), F.col("x").alias(f"x{e}"), F.col("y").alias(f"y{e}")) for e in ("u", "v")]
        c = edges.join(ends[0], "u").join(ends[1], "v")
        d = [F.col(f"{n}u") - F.col(f"{n}v") for n in ("x", "y")]
        reach = F.sqrt(d[0] * d[0] + d[1] * d[1])
        pull = [(-F.col("weight") * g * reach) for g in d]
        c1 = c.select("component", F.col("u").alias("id"), *[whole(g).alias(n) for g, n in zip(pull, ("fx", "fy"), strict=True)])
        c2 = c.select("component", F.col("v").alias("id"), *[whole(-g).alias(n) for g, n in zip(pull, ("fx", "fy"), strict=True)])
        force = a.unionByName(b).unionByName(c1).unionByName(c2).groupBy("component", "id").agg((F.sum("fx") * UNIT).alias("fx"), (F.sum("fy") * UNIT).alias("fy"))
        size = F.greatest(F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")), F.lit(0.01))
        step = 0.1 * side * (1 - turn / rounds)
        moved = now.join(force, ["component", "id"], "left").select("component", "id", "n", *[(F.col(g) + F.coalesce(F.col(f"f{g}") / size * step, F.lit(0.0))).alias(g) for g in ("x", "y")])
        new = materialize(moved)
        discard(now)
        now = new
    return now.select("component", "id", "x", "y")


def shelves(sizes: list[tuple[int, int]], gap: float = GAP) -> list[tuple[int, int, float, float, int, float]]:
    """(n, first, left, top, per_row, next_top) for each (n, count), largest n first.

    Square boxes of side sqrt(n) go on shelves from left to right, each on the
    current one while it fits.  Of a size's boxes the first ``first`` begin at left
    on the shelf at top; the others fill shelves of ``per_row`` from next_top down.
    """
    if not sizes:
        return []
    limit = max(math.sqrt(sum(max(math.sqrt(n), 1.0) * m for n, m in sizes)) * WIDTH, max(math.sqrt(sizes[0][0]), 1.0))
    out, x, y, high = [], 0.0, 0.0, 0.0
    for n, count in sizes:
        side = max(math.sqrt(n), 1.0)
        room = lambda at, side=side: max(1, math.floor((limit - at - side) / (side + gap) + 1e-9) + 1)
        if x > 0 and x + side > limit:
            x, y, high = 0.0, y - high - gap, 0.0
        first, per_row = min(count, room(x)), room(0.0)
        high = max(high, side)
        below = y - high - gap
        out.append((n, first, x, y, per_row, below))
        if rest := count - first:
            rows = -(-rest // per_row)
            x, y, high = (rest - (rows - 1) * per_row) * (side + gap), below - (rows - 1) * (side + gap), side
        else:
            x += first * (side + gap)
    return out


def pack_shelves(boxes: DataFrame, gap: float = GAP) -> DataFrame:
    """id, n, left, top of square boxes (id, n) of side sqrt(n), largest first, equal ones by id.

    Boxes of a size are told apart by their rank alone.  The driver gets a row a
    size, of which there are few: 45,000 for 1,000,000,000 vertices.
    """
    place = materialize(ranked_in(boxes.select("id", F.col("n").cast("long").alias("n")), ["n"], "id"))
    sizes = sorted(((r.n, r["count"]) for r in place.groupBy("n").count().collect()), reverse=True)
    table = boxes.sparkSession.createDataFrame(shelves(sizes, gap), "n long, first long, x double, y double, per_row long, below double")
    d = place.join(table, "n").withColumn("side", F.greatest(F.sqrt("n"), F.lit(1.0)) + gap)
    here, later = F.col("rank") < F.col("first"), F.col("rank") - F.col("first")
    left = F.when(here, F.col("x") + F.col("rank") * F.col("side")).otherwise(F.pmod(later, F.col("per_row")) * F.col("side"))
    top = F.when(here, F.col("y")).otherwise(F.col("below") - F.floor(later / F.col("per_row")) * F.col("side"))
    return d.select("id", "n", left.alias("left"), top.alias("top"))


def component_layout(edges: DataFrame, vertices: DataFrame, rounds: int = ROUNDS, seed: int = SEED, small: int = SMALL) -> DataFrame:
    """id, component, x, y: components laid out apart, scaled to boxes of side sqrt(vertices) and packed.

    ``edges`` (u, v, weight) join different vertices; ``vertices`` (column id) adds
    lone ones.  A component is named by its smallest id; order, boxes and positions
    depend on nothing else.
    """
    ship(edges.sparkSession)
    links = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("weight").cast("double").alias("weight")).groupBy("u", "v").agg(F.sum("weight").alias("weight")))
    parts = materialize(connected_components(links, vertices))
    sizes = materialize(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    members = parts.join(sizes, "component")
    linked = links.join(members.select(F.col("id").alias("u"), "component", "n"), "u")
    kind = parts.schema["id"].dataType.simpleString()
    whole = f"component {kind}, id {kind}, x double, y double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v"])
        ids = sorted({*pdf["u"], *pdf["v"]})
        at = {x: i for i, x in enumerate(ids)}
        pos = spring(len(ids), np.array([(at[u], at[v]) for u, v in zip(pdf["u"], pdf["v"], strict=True)]), pdf["weight"].to_numpy(), rounds, seed)
        return pd.DataFrame({"component": pdf["component"].iloc[0], "id": ids, "x": pos[:, 0], "y": pos[:, 1]})

    drawn = linked.where(F.col("n") <= small).select("component", "u", "v", "weight").groupBy("component").applyInPandas(one, whole)
    drawn = drawn.unionByName(members.where("n = 1").select("component", "id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    large = members.where(F.col("n") > small)
    if not large.isEmpty():
        drawn = drawn.unionByName(_large(linked.where(F.col("n") > small).select("component", "u", "v", "weight"), large, rounds, seed))
    drawn = materialize(drawn)
    ends = drawn.groupBy("component").agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for f, n in ((F.min, "low_"), (F.max, "high_"))])
    boxes = pack_shelves(sizes.select(F.col("component").alias("id"), "n")).withColumnRenamed("id", "component")
    d = drawn.join(ends.join(boxes, "component"), "component")
    scale = F.greatest(F.sqrt("n"), F.lit(1.0))
    norm = lambda c: (F.col(c) - F.col(f"low_{c}")) / F.greatest(F.col(f"high_{c}") - F.col(f"low_{c}"), F.lit(1e-6)) * scale
    return d.select("id", "component", (F.col("left") + norm("x")).alias("x"), (F.col("top") + norm("y")).alias("y"))
