"""Graphs as edge tables (``src``, ``dst``, optional ``weight``): traversals and algorithms as joins and aggregations.

Iterations write their state as a table in the shared folder every few rounds, so that plans stay short and a lost
executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways, once; loops are left out."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def _either(edges: DataFrame, direction: str) -> DataFrame:
    back = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return {"out": edges, "in": back, "both": edges.unionByName(back)}[direction]


# --- traversals ------------------------------------------------------------------------------------------------------


def neighbours(edges: DataFrame, sources: DataFrame, depth: int = 2, direction: str = "both", limit: int | None = None) -> DataFrame:
    """``id``, ``depth``: what can be reached from the sources (column ``id``) in at most ``depth`` steps (5 at most), at its least depth."""
    links = _either(edges.select("src", "dst"), direction)
    found = sources.select("id").distinct().withColumn("depth", F.lit(0))
    front = found
    for k in range(1, min(depth, 5) + 1):
        reached = front.join(links, front["id"] == links["src"]).select(F.col("dst").alias("id")).distinct()
        front = materialize(reached.join(found, "id", "left_anti").withColumn("depth", F.lit(k)), "front")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.orderBy("depth", "id").limit(limit) if limit else found


def simple_paths(edges: DataFrame, source: object, depth: int = 5, target: object = None, direction: str = "out", weight: str | None = None) -> DataFrame:
    """``path``, ``depth``, ``cost`` of every path without a repeated vertex from a source (to a target), 10 steps at most."""
    cost = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    links = _either(edges.select("src", "dst", cost.alias("w")), direction)
    kind = edges.schema["src"].dataType
    front = edges.sparkSession.range(1).select(F.array(F.lit(source).cast(kind)).alias("path"), F.lit(0).alias("depth"), F.lit(0.0).alias("cost"))
    found = front
    for k in range(1, min(depth, 10) + 1):
        grown = front.withColumn("end", F.element_at("path", -1)).join(links, F.col("end") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        if target is not None and k > 1:
            grown = grown.where(~F.array_contains("path", F.lit(target).cast(kind)))
        front = grown.select(F.array_append("path", F.col("dst")).alias("path"), F.lit(k).alias("depth"), (F.col("cost") + F.col("w")).alias("cost"))
        found = found.unionByName(front)
    return found.where(F.element_at("path", -1) == F.lit(target).cast(kind)) if target is not None else found


def rays(edges: DataFrame, source: object, depth: int = 5, direction: str = "out") -> DataFrame:
    """The simple paths that go no further: at a vertex without a new neighbour, or at the depth."""
    paths = simple_paths(edges, source, depth, direction=direction)
    longer = paths.where("depth > 0").select(F.slice("path", 1, F.size("path") - 1).alias("path")).distinct()
    return paths.where("depth > 0").join(longer, "path", "left_anti")


def rings(edges: DataFrame, source: object, depth: int = 5, direction: str = "out") -> DataFrame:
    """Cycles through the source of at least two steps: ``path`` without the source at its end, ``depth`` in steps."""
    links = _either(edges.select("src", "dst"), direction).distinct()
    paths = simple_paths(edges, source, depth - 1, direction=direction).where("depth > 0")
    closing = links.where(F.col("dst") == F.lit(source)).select(F.col("src").alias("end"))
    return paths.withColumn("end", F.element_at("path", -1)).join(closing, "end").select("path", (F.col("depth") + 1).alias("depth")).where("depth > 1").distinct()


def crosspoints(edges: DataFrame, one: object, other: object, depth: int = 3, direction: str = "out") -> DataFrame:
    """``id`` of vertices that paths from both sources reach."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    a, b = (neighbours(edges, spark.range(1).select(F.lit(x).cast(kind).alias("id")), depth, direction).select("id") for x in (one, other))
    return a.join(b, "id", "left_semi").where((F.col("id") != F.lit(one)) & (F.col("id") != F.lit(other)))


def step_paths(edges: DataFrame, sources: DataFrame, steps: Sequence[tuple[str, Sequence[str] | None]], label: str = "label") -> DataFrame:
    """``path``: one join per step, each with its direction and the labels it may follow."""
    found = sources.select(F.array("id").alias("path"))
    for direction, labels in steps:
        own = edges.where(F.col(label).isin(list(labels))) if labels else edges
        links = _either(own.select("src", "dst"), direction).distinct()
        found = found.withColumn("end", F.element_at("path", -1)).join(links, F.col("end") == F.col("src")).select(F.array_append("path", F.col("dst")).alias("path"))
    return found


def shortest_distances(edges: DataFrame, sources: DataFrame, weight: str | None = None, direction: str = "out", rounds: int | None = None) -> DataFrame:
    """``source``, ``id``, ``distance``, ``previous``: from each source to all it reaches, by rounds of relaxation.

    Each round only extends what the round before improved, and it ends when nothing did; if that takes more than
    ``rounds``, where given, it's an error. Weights aren't negative.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    links = materialize(_either(edges.select("src", "dst", w.alias("w")), direction).groupBy("src", "dst").agg(F.min("w").alias("w")), "links")
    best = materialize(sources.select(F.col("id").alias("source"), "id").distinct().select("source", "id", F.lit(0.0).alias("distance"), F.lit(None).cast(edges.schema["src"].dataType).alias("previous")), "best")
    front = best
    for k in count():
        if k == rounds:
            raise ValueError(f"distances still change after {rounds} rounds")
        offered = front.join(links, front["id"] == links["src"]).select("source", F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("offered"), F.col("src").alias("via"))
        offered = offered.groupBy("source", "id").agg(F.min(F.struct("offered", "via")).alias("o"))
        better = offered.join(best.select("source", "id", "distance"), ["source", "id"], "left").where("distance is null or o.offered < distance")
        front = materialize(better.select("source", "id", F.col("o.offered").alias("distance"), F.col("o.via").alias("previous")), "front")
        if front.isEmpty():
            break
        best = materialize(best.join(front.select("source", "id"), ["source", "id"], "left_anti").unionByName(front), "best")
    return best


def all_shortest_paths(edges: DataFrame, source: object, target: object, direction: str = "out", depth: int = 10) -> DataFrame:
    """``path``, ``depth`` of each of the shortest paths between two vertices, none where the target is farther than ``depth``.

    Levels are walked until one holds the target; then only what lies on a shortest path is followed back.
    """
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    links = materialize(_either(edges.select("src", "dst"), direction).distinct(), "links")
    only = lambda x: spark.range(1).select(F.lit(x).cast(kind).alias("id"))
    levels = [only(source)]
    seen, front = levels[0], levels[0]
    paths = only(target).select(F.array("id").alias("path"))
    if source != target:
        for _ in range(depth):
            reached = front.join(links, front["id"] == links["src"]).select(F.col("dst").alias("id")).distinct()
            front = materialize(reached.join(seen, "id", "left_anti"), "level")
            if not front.where(F.col("id") == F.lit(target)).isEmpty():
                break
            if front.isEmpty() or len(levels) == depth:
                return paths.limit(0).withColumn("depth", F.lit(0))
            levels.append(front)
            seen = seen.unionByName(front)
        for level in reversed(levels):
            ends = paths.withColumn("dst", F.element_at("path", 1)).join(links, "dst").join(level.withColumnRenamed("id", "src"), "src", "left_semi")
            paths = ends.select(F.array_prepend("path", F.col("src")).alias("path"))
    return paths.withColumn("depth", F.size("path") - 1)


# --- algorithms ----------------------------------------------------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """``id``, ``in_degree``, ``out_degree``, ``degree``."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, keep: int = 5) -> DataFrame:
    """``id``, ``rank`` (the ranks sum to 1); what dangling vertices hold is spread over all."""
    links = edges.select("src", "dst").distinct()
    out = links.groupBy("src").agg(F.count("*").alias("out"))
    links = materialize(links.join(out, "src"), "links")
    nodes = materialize(vertices(edges), "nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        flow = ranks.join(links, ranks["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("flow"))
        held = ranks.join(links.select(F.col("src").alias("id")).distinct(), "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("held"))  # one row
        fresh = (1 - damping) / max(n, 1) + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("held") / max(n, 1))
        ranks = nodes.join(flow, "id", "left").join(held).select("id", fresh.alias("rank"))
        if k % keep == keep - 1:
            ranks = materialize(ranks, "ranks")
    return ranks


def _mark(links: DataFrame) -> tuple:
    """A row that changes when the set of links does."""
    h = F.xxhash64("src", "dst")
    return tuple(links.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)")), F.sum((F.col("src") != F.col("dst")).cast("int"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (its least id): weakly connected, by alternating large and small stars.

    Each round links every vertex to the least one it knows, until nothing changes; the number of rounds grows with the
    logarithm of the longest chain. No vertex gathers its neighbours: both stars are aggregations by minimum.
    """
    links = materialize(undirected(edges).where("src > dst"), "links")
    before = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        large = materialize(large, "large")
        down = large.where("src > dst").unionByName(large.where("src < dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        small_least = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(small_least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(small_least.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()
        small = materialize(small, "small")
        links, after = small, _mark(small)
        if after == before:
            break
        before = after
    return vertices(edges).join(links.select(F.col("src").alias("id"), F.col("dst").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``id``, ``label``: each round a vertex takes its neighbours' most frequent label, the least of those; all at once."""
    links = materialize(undirected(edges), "links")
    labels = vertices(edges).select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = links.join(labels, links["dst"] == labels["id"]).groupBy(F.col("src").alias("id"), "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("id", F.col("b.label").alias("label"))
        labels = materialize(vertices(edges).join(best, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "labels")
    return labels


def triangles(edges: DataFrame) -> DataFrame:
    """``id``, ``triangles`` it is part of. Edges point to the vertex of higher degree, so that no hub's pairs are made."""
    links = undirected(edges)
    degree = links.groupBy("src").agg(F.count("*").alias("d"))
    ranked = links.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    up = materialize(ranked.where("d < e or (d = e and src < dst)").select("src", "dst"), "up")
    wedges = up.alias("a").join(up.alias("b"), F.expr("a.src = b.src and a.dst < b.dst")).select(F.col("a.src").alias("x"), F.col("a.dst").alias("y"), F.col("b.dst").alias("z"))
    closed = wedges.join(up.select(F.least("src", "dst").alias("y"), F.greatest("src", "dst").alias("z")), ["y", "z"])
    return closed.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def k_core(edges: DataFrame, k: int = 3, rounds: int | None = None) -> DataFrame:
    """``id``, ``degree`` within the core: what is left when vertices with fewer than ``k`` neighbours are peeled away; an error if that takes more than ``rounds``, where given."""
    links = materialize(undirected(edges), "links")
    for n in count():
        if n == rounds:
            raise ValueError(f"vertices are still peeled away after {rounds} rounds")
        kept = links.groupBy("src").agg(F.count("*").alias("degree")).where(F.col("degree") >= k).select("src")
        fewer = materialize(links.join(kept, "src", "left_semi").join(kept.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"), "core")
        if fewer.count() == links.count():
            break
        links = fewer
    return links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def closeness(edges: DataFrame) -> DataFrame:
    """``id``, ``closeness``: vertices reached over the sum of their distances, undirected. For graphs whose distance table fits the cluster."""
    far = shortest_distances(undirected(edges), vertices(edges)).where("distance > 0")
    return far.groupBy(F.col("source").alias("id")).agg(F.round(F.count("*") / F.sum("distance"), 6).alias("closeness"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``id``, ``betweenness``, undirected, each pair once; from the given sources only (an estimate) or from all.

    All sources are walked at once, level by level: a level has a row for each source and vertex with the number of
    shortest ways to it. Then, from the last level back, each vertex hands its dependency on to those before it, in
    proportion to their ways. Every step is a join and an aggregation; no task holds the graph.
    """
    links = materialize(undirected(edges), "links")
    every = vertices(edges)
    start = (sources.select("id").distinct() if sources is not None else every).select(F.col("id").alias("source"), "id", F.lit(1.0).alias("ways"))
    levels = [materialize(start, "level")]
    seen = levels[0].select("source", "id")
    while True:
        front = levels[-1]
        ways = front.join(links, front["id"] == links["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("ways").alias("ways"))
        level = materialize(ways.join(seen, ["source", "id"], "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("source", "id"))
    below: DataFrame | None = None
    parts = []
    for level in reversed(levels[1:]):
        own = level.withColumn("share", F.lit(0.0)) if below is None else level.join(below, ["source", "id"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        own = materialize(own, "shares")
        parts.append(own.select("id", "share"))
        before = levels[len(levels) - 1 - len(parts)].select("source", F.col("id").alias("up"), F.col("ways").alias("up_ways"))
        handed = own.join(links, own["id"] == links["src"]).select("source", F.col("dst").alias("up"), ((1 + F.col("share")) / F.col("ways")).alias("each")).join(before, ["source", "up"])
        below = handed.groupBy("source", F.col("up").alias("id")).agg(F.sum(F.col("each") * F.col("up_ways")).alias("share"))
    total = every.select("id", F.lit(0.0).alias("share"))
    for part in parts:
        total = total.unionByName(part)
    return total.groupBy("id").agg(F.round(F.sum("share") / 2, 6).alias("betweenness"))


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 10, weight: str | None = None) -> DataFrame:
    """``id``, ``community``: greedy modularity in rounds. In a round every second vertex (by a hash that changes with the
    round, so that neighbours don't swap) moves to the neighbouring community with the greatest gain."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    once = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    both = materialize(once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "links")
    degree = materialize(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "degree")
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    own = degree.select("id", F.col("id").alias("community"))
    for r in range(rounds):
        sums = own.join(degree, "id").groupBy("community").agg(F.sum("k").alias("all_k"))
        toward = both.join(own.select(F.col("id").alias("dst"), F.col("community").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("inward"))
        scored = toward.join(own, "id").join(degree, "id").join(sums.select(F.col("community").alias("to"), "all_k"), "to")
        others = F.col("all_k") - F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0.0)
        scored = scored.withColumn("gain", F.round(F.col("inward") - resolution * F.col("k") * others / total, 9))
        stay = scored.where("to = community").select("id", F.col("gain").alias("stay"))
        best = scored.groupBy("id").agg(F.max(F.struct("gain", (-F.xxhash64("to")).alias("t"), "to")).alias("b")).join(stay, "id", "left")
        turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
        moved = own.join(best, "id", "left").select("id", F.when(turn & (F.col("b.gain") > F.coalesce("stay", F.lit(0.0))), F.col("b.to")).otherwise(F.col("community")).alias("community"), F.col("community").alias("old"))
        moved = materialize(moved, "communities")
        own = moved.select("id", "community")
        if r and moved.where("community <> old").isEmpty():
            break
    return own


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> float:
    once = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    m = once.count()
    c = communities
    inside = once.join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst").where("a = b").count()
    degree = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")).join(c, "id").groupBy("community").agg(F.sum("k").alias("k"))
    spread = degree.agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0
    return inside / m - resolution * spread / (4.0 * m * m)


def snapshot(vertex: DataFrame, edges: DataFrame, most: int, order: Column) -> tuple[DataFrame, DataFrame]:
    """The first vertices in an order, and the edges between them."""
    kept = vertex.orderBy(order, "id").limit(most)
    ids = kept.select("id")
    inner = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, inner
