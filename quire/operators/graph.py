"""Co-occurrence graphs: pairs, degrees, connected components, communities, layout."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.order import ranked
from quire.runtime import discard, materialize, ship

#: Edges of a component that one task merges into communities (some 500 bytes each); larger ones move in parallel first.
MAX_COMPONENT_EDGES = 2_000_000
#: Graphs whose pairs of vertices are at most so many times their edges are merged as a matrix (some 20 bytes a pair).
DENSE = 8
#: Rounds of moves on a level and in a refinement, and the least gain of modularity for another refinement.
SWEEPS, REFINE, LEAST_GAIN = 8, 4, 1e-4


def cooccurrence(items: DataFrame, group: str, item: str, keep: DataFrame | None = None) -> DataFrame:
    """u, v, weight (u < v): in how many groups two items occur together.

    ``keep`` (one column) restricts the items before the self-join.
    """
    d = items.select(F.col(group).alias("g"), F.col(item).alias("x")).where("g IS NOT NULL AND x IS NOT NULL").distinct()
    if keep is not None:
        d = d.join(keep.select(F.col(keep.columns[0]).alias("x")), "x", "left_semi")
    a, b = d.alias("a"), d.alias("b")
    pairs = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.x") < F.col("b.x")))
    return pairs.groupBy(F.col("a.x").alias("u"), F.col("b.x").alias("v")).agg(F.count(F.lit(1)).alias("weight"))


def active_items(items: DataFrame, item: str, group: str, least: int) -> DataFrame:
    """Items of at least so many groups, with their count."""
    return items.groupBy(item).agg(F.countDistinct(group).alias("n")).where(F.col("n") >= least)


def coauthors(papers: DataFrame, min_papers: int = 2) -> tuple[DataFrame, DataFrame]:
    """(vertices id, n; edges u, v, weight) of authors with enough papers."""
    a = papers.select("paper_id", F.explode("authors").alias("author"))
    v = active_items(a, "author", "paper_id", min_papers)
    return v.withColumnRenamed("author", "id"), cooccurrence(a, "paper_id", "author", v.select("author"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree, strength (sum of weights)."""
    ends = edges.select(F.col("u").alias("id"), "weight").unionByName(edges.select(F.col("v").alias("id"), "weight"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def label_threshold(vertices: DataFrame, nth: int = 25) -> DataFrame:
    """Vertices with at least the nth largest count, ties included."""
    top = vertices.orderBy(F.desc("n")).limit(nth).agg(F.min("n").alias("least"))
    return vertices.crossJoin(F.broadcast(top)).where("n >= least").drop("least")


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, u: str = "u", v: str = "v") -> DataFrame:
    """id, component (its smallest id); ``vertices`` (column id) adds lone ones.

    Alternates minimum over larger and over smaller neighbours; each round is
    written to the shared folder, and the number of rounds grows with the
    logarithm of the size.
    """
    e = materialize(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        larger = materialize(both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        discard(least, e)
        least = materialize(larger.groupBy("a").agg(F.min("b").alias("m")))
        moved = larger.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(larger, least)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    out = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = out.unionByName(out.select(F.col("component").alias("id"), "component").distinct())
    if vertices is not None:
        lone = vertices.select("id").distinct().join(out.select("id"), "id", "left_anti")
        out = out.unionByName(lone.select("id", F.col("id").alias("component")))
    return out


def greedy_modularity(edges: list[tuple[str, str, float]], nodes: list[str], total: float | None = None) -> list[list[str]]:
    """Communities by merging the pair that raises modularity most; ties (to 12 places) by smallest members.

    ``total`` is the weight of the whole graph where ``edges`` are one component
    of it.  Pairs wait in a heap; an entry counts while neither side has merged
    since.  The groups come largest first, equal sizes by smallest member.
    Where most vertices are neighbours, a matrix takes the heap's place; the
    merges are the same.
    """
    total = total or sum(w for _, _, w in edges)
    if not total:
        return sorted(([n] for n in nodes))
    if len(nodes) ** 2 <= DENSE * len(edges):
        return _greedy_dense(edges, sorted(nodes), total)
    member = {n: [n] for n in nodes}
    strength: dict[str, float] = defaultdict(float)
    between: dict[str, dict[str, float]] = {n: {} for n in nodes}
    for a, b, w in edges:
        strength[a] += w / (2 * total)
        strength[b] += w / (2 * total)
        if a == b:  # what a contracted vertex holds inside
            continue
        between[a][b] = between[a].get(b, 0) + w / (2 * total)
        between[b][a] = between[b].get(a, 0) + w / (2 * total)
    merges = dict.fromkeys(nodes, 0)

    def entry(a: str, b: str) -> tuple[float, str, str, int, int]:
        a, b = min(a, b), max(a, b)
        return -round(2 * (between[a][b] - strength[a] * strength[b]), 12), a, b, merges[a], merges[b]

    heap = [entry(a, b) for a in between for b in between[a] if a < b]
    heapq.heapify(heap)
    while heap:
        loss, a, b, at_a, at_b = heapq.heappop(heap)
        if loss >= 0:
            break
        if merges.get(a) != at_a or merges.get(b) != at_b:
            continue
        member[a] += member.pop(b)
        for c, w in between.pop(b).items():
            between[c].pop(b, None)
            if c != a:
                between[a][c] = between[a].get(c, 0) + w
                between[c][a] = between[a][c]
        strength[a] += strength.pop(b)
        merges[a] += 1
        del merges[b]
        for c in between[a]:
            heapq.heappush(heap, entry(a, c))
    return sorted((sorted(m) for m in member.values()), key=lambda m: (-len(m), m[0]))


def _greedy_dense(edges: list[tuple[str, str, float]], nodes: list[str], total: float) -> list[list[str]]:
    """The same merges from a matrix of gains, above the diagonal, with each row's best.

    Vertices are numbered in order of their names, so the first best row and
    column are the smallest members.
    """
    n, place = len(nodes), {x: i for i, x in enumerate(nodes)}
    ends = np.array([(place[a], place[b]) for a, b, _ in edges])
    share = np.array([w for _, _, w in edges], float) / (2 * total)
    strength = np.bincount(ends.ravel(), np.repeat(share, 2), n)
    u, v = ends[apart := ends[:, 0] != ends[:, 1]].T
    between, linked = np.zeros((n, n)), np.zeros((n, n), bool)
    np.add.at(between, (np.minimum(u, v), np.maximum(u, v)), share[apart])
    between += between.T
    linked[u, v] = linked[v, u] = True

    def gains(rows: slice | int) -> np.ndarray:
        return np.where(linked[rows], np.rint(2e12 * (between[rows] - np.multiply.outer(strength[rows], strength))), 0.0)

    gain = np.concatenate([np.triu(gains(slice(i, i + 256)), i + 1) for i in range(0, n, 256)])
    column = gain.argmax(1)
    best = gain[np.arange(n), column]
    group = {i: [x] for i, x in enumerate(nodes)}
    while best[a := int(best.argmax())] > 0:
        b = int(column[a])
        group[a] += group.pop(b)
        between[a] += between[b]
        between[:, a] = between[a]
        linked[a] |= linked[b]
        linked[a, a] = False
        linked[:, a] = linked[a]
        linked[b] = linked[:, b] = False
        strength[a] += strength[b]
        new = gains(a)
        new[b] = 0
        linked[a, b] = linked[b, a] = False
        gain[b], gain[:, b] = 0, 0
        gain[:a, a], gain[a, a + 1 :] = new[:a], new[a + 1 :]
        # Rows above that pointed to either are searched again; others may now point to the merged one.
        again = np.flatnonzero((column == a) | (column == b))
        again = np.union1d(again[again < b], [a])
        column[again] = gain[again].argmax(1)
        best[again] = gain[again, column[again]]
        best[b] = 0
        up = np.flatnonzero((new[:a] > best[:a]) | ((new[:a] == best[:a]) & (column[:a] > a)))
        column[up], best[up] = a, new[up]
    return sorted((sorted(m) for m in group.values()), key=lambda m: (-len(m), m[0]))


def modularity(edges: DataFrame, groups: DataFrame) -> float:
    """Modularity of (id, community) on u, v, weight; an edge from a vertex to itself is inside."""
    c = groups.select(F.col("id"), F.col("community").alias("c"))
    e = edges.select("u", "v", F.col("weight").cast("double").alias("w")).join(c.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(c.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v")
    total = e.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    inside = e.where("cu = cv").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    ends = e.select(F.col("cu").alias("c"), "w").unionByName(e.select(F.col("cv").alias("c"), "w"))
    squares = ends.groupBy("c").agg(F.sum("w").alias("s")).agg(F.sum(F.pow(F.col("s") / (2 * total), F.lit(2.0)))).first()[0]
    return inside / total - squares


def _move(edges: DataFrame, state: DataFrame, total: float, turn: int) -> DataFrame:
    """One round of moves: id, k (strength), c (community).

    Half of the vertices, drawn by hash, may go to the neighbouring community of
    the largest gain, ties by its name; so that two vertices don't swap places for ever.
    """
    sums = state.groupBy("c").agg(F.sum("k").alias("in_c"))
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("other"), "w").unionByName(edges.select(F.col("v").alias("id"), F.col("u").alias("other"), "w")).where("id <> other")
    near = out.join(state.select(F.col("id").alias("other"), F.col("c").alias("to")), "other").groupBy("id", "to").agg(F.sum("w").alias("links"))
    movers = state.where(F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(2)) == 0)
    # The own community is a candidate too, with or without links into it.
    here = movers.select("id", F.col("c").alias("to"), F.lit(0.0).alias("links"))
    choices = near.unionByName(here).groupBy("id", "to").agg(F.sum("links").alias("links")).join(movers, "id").join(sums.withColumnRenamed("c", "to"), "to")
    stays = F.col("to") == F.col("c")
    gain = F.col("links") - F.col("k") * (F.col("in_c") - F.when(stays, F.col("k")).otherwise(0.0)) / (2 * total)
    best = choices.withColumn("g", gain).groupBy("id").agg(F.max_by("to", F.struct("g", stays.alias("s"), (-F.xxhash64("to")).alias("h"))).alias("best"))
    return state.join(best, "id", "left").select("id", "k", F.coalesce("best", "c").alias("c"))


def parallel_communities(edges: DataFrame, vertices: DataFrame, merge_edges: int = MAX_COMPONENT_EDGES) -> DataFrame:
    """id, community (a member's name) of a graph of any size, by moves in parallel and contraction.

    While the graph has more than ``merge_edges`` edges, its vertices move to neighbouring
    communities for ``SWEEPS`` rounds, and communities become the vertices of the next
    level.  What is left is merged greedily, which is exact for that graph.  Then the
    vertices themselves move again, as long as modularity rises.  All tables are keyed
    by vertex or by vertex and community; an aggregate sums a hot vertex's edges
    before they move.
    """
    kind = vertices.schema["id"].dataType.simpleString()
    first = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("weight").cast("double").alias("w")).groupBy("u", "v").agg(F.sum("w").alias("w")))
    total = first.agg(F.sum("w")).first()[0]
    names = materialize(vertices.select("id", F.col("id").alias("community")))
    if not total:
        return names
    e, n, turn = first, first.count(), 0

    def moved(e: DataFrame, start: DataFrame | None, rounds: int) -> DataFrame:
        """id, c after some rounds from (id, c), or from a community a vertex."""
        nonlocal turn
        ends = e.select(F.col("u").alias("id"), "w").unionByName(e.select(F.col("v").alias("id"), "w"))
        strength = ends.groupBy("id").agg(F.sum("w").alias("k"))
        state = materialize(strength.withColumn("c", F.col("id")) if start is None else strength.join(start, "id").select("id", "k", "c"))
        for _ in range(rounds):
            new = materialize(_move(e, state, total, turn))
            discard(state)
            state, turn = new, turn + 1
        return state.select("id", "c")

    while n > merge_edges:
        state = moved(e, None, SWEEPS)
        names = materialize(names.join(state.select(F.col("id").alias("community"), "c"), "community", "left").select("id", F.coalesce("c", "community").alias("community")))
        cu, cv = (state.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in ("u", "v"))
        e = materialize(e.join(cu, "u").join(cv, "v").groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w")))
        before, n = n, e.count()
        if n > 0.9 * before:  # no community left to find by moves of vertices
            break
    if n <= merge_edges:

        def merged(pdf: pd.DataFrame) -> pd.DataFrame:
            links = sorted(zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["w"].tolist(), strict=True))
            groups = greedy_modularity(links, sorted({x for a, b, _ in links for x in (a, b)}), total)
            return pd.DataFrame([(x, g[0]) for g in groups for x in g], columns=["community", "to"])

        last = e.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(merged, f"community {kind}, to {kind}")
        names = materialize(names.join(last, "community", "left").select("id", F.coalesce("to", "community").alias("community")))
    named, value = first.withColumnRenamed("w", "weight"), None
    while True:
        value = modularity(named, names) if value is None else value
        state = moved(first, names.select("id", F.col("community").alias("c")), REFINE)
        better = materialize(names.join(state, "id", "left").select("id", F.coalesce("c", "community").alias("community")))
        now = modularity(named, better)
        if now < value + LEAST_GAIN:
            discard(better)
            return names
        discard(names)
        names, value = better, now


def communities(edges: DataFrame, vertices: DataFrame, component_edges: int = MAX_COMPONENT_EDGES) -> DataFrame:
    """id, community (0 is the largest, equal sizes by smallest member).

    Greedy modularity merges neighbours only, and beside the graph's total
    weight a gain depends on nothing outside its component; so components are
    merged apart, each in a task, and the result is that of the whole graph.
    Within a component the method is sequential: components of more than
    ``component_edges`` edges go through ``parallel_communities`` first.
    """
    ship(edges.sparkSession)
    kind = vertices.schema["id"].dataType.simpleString()
    held = materialize(edges.select("u", "v", F.col("weight").cast("double").alias("weight")))
    parts = materialize(connected_components(held, vertices))
    total = held.agg(F.sum("weight")).first()[0] or 0.0
    linked = held.join(parts.withColumnRenamed("id", "u"), "u")
    sizes = materialize(linked.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    small, large = sizes.where(F.col("n") <= component_edges).select("component"), sizes.where(F.col("n") > component_edges).select("component")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        links = list(zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["weight"].tolist(), strict=True))
        groups = greedy_modularity(sorted(links), sorted({x for a, b, _ in links for x in (a, b)}), total)
        return pd.DataFrame([(x, g[0]) for g in groups for x in g], columns=["id", "community"])

    # Dealt out by a fixed number: small rows would be put together to few tasks, but a component's merges take seconds.
    dealt = linked.join(small, "component", "left_semi").repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component")
    found = dealt.groupBy("component").applyInPandas(merged, f"id {kind}, community {kind}")
    if not large.isEmpty():
        rest = parts.join(large, "component", "left_semi").select("id")
        found = found.unionByName(parallel_communities(linked.join(large, "component", "left_semi").select("u", "v", "weight"), rest, component_edges))
    found = materialize(found)
    lone = vertices.select("id").distinct().join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("community"))
    every = found.unionByName(lone)
    # One row a community is numbered, not one a vertex.
    named = every.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    order = materialize(ranked(named.withColumn("_s", -F.col("size")), "_s", "first"))
    return every.join(order.select("community", F.col("rank").cast("int").alias("n")), "community").select("id", F.col("n").alias("community"))
