"""The registered graph algorithms run over whole tables: against brute force over the same edges."""

import os
from collections import Counter, defaultdict

import pytest

from millrace.operators import graph
from millrace.plans import catalog, catalog_graph
from millrace.plans.registry import Tables

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def run(spark, name):
    return catalog.queries()[name](spark, DATA)


def links(df):
    found = defaultdict(set)
    for r in df.collect():
        found[r.src].add(r.dst)
        found[r.dst].add(r.src)
    return found


@pytest.fixture(scope="module")
def trade(spark):
    return links(catalog_graph._trade(Tables(spark, DATA)))


@pytest.fixture(scope="module")
def together(spark):
    return links(catalog_graph._together(Tables(spark, DATA)))


def walk(near, source):
    """Distances, numbers of shortest paths."""
    depth, ways, queue = {source: 0}, Counter({source: 1}), [source]
    for v in queue:
        for w in near[v]:
            if w not in depth:
                depth[w] = depth[v] + 1
                queue.append(w)
            if depth[w] == depth[v] + 1:
                ways[w] += ways[v]
    return depth, ways


def test_every_key_is_a_vertex(spark, trade):
    for name in ("graph_pagerank", "graph_label_propagation"):
        assert {r.id for r in run(spark, name).collect()} == set(trade)


def test_label_propagation_over_trade(spark, trade):
    labels = {v: v for v in trade}
    for _ in range(5):
        votes = {v: Counter(labels[w] for w in near) for v, near in trade.items()}
        labels = {v: min(c, key=lambda x: (-c[x], x)) for v, c in votes.items()}  # noqa: B023
    assert {r.id: r.label for r in run(spark, "graph_label_propagation").collect()} == labels


def test_k_core_over_trade(spark, trade):
    core = {v: set(near) for v, near in trade.items()}
    while low := [v for v, near in core.items() if len(near) < 12]:
        for v in low:
            for w in core.pop(v):
                if w in core:
                    core[w].discard(v)
    assert {r.id: r.degree for r in run(spark, "graph_k_core").collect()} == {v: len(near) for v, near in core.items()}


def test_closeness_and_betweenness_over_entities(spark, together):
    walks = {v: walk(together, v) for v in together}
    near = {v: round((len(d) - 1) / sum(d.values()), 6) for v, (d, _) in walks.items()}
    assert {r.id: r.closeness for r in run(spark, "graph_closeness").collect()} == pytest.approx(near)
    between = Counter()
    for s, (depth, ways) in walks.items():
        for t in depth:
            for v in depth:
                if len({s, t, v}) == 3 and depth[v] + walks[v][0][t] == depth[t]:
                    between[v] += ways[v] * walks[v][1][t] / ways[t] / 2
    got = {r.id: r.betweenness for r in run(spark, "graph_betweenness").collect()}
    assert {v: x for v, x in got.items() if x} == pytest.approx({v: round(x, 6) for v, x in between.items()})
    assert set(got) == set(together)


def test_louvain_over_entities(spark, together):
    found = run(spark, "graph_louvain")
    assert {r.id for r in found.collect()} == set(together)
    assert graph.modularity(catalog_graph._together(Tables(spark, DATA)), found) > 0.5


def test_traversals_from_a_hub(spark, together):
    hub = min(together, key=lambda v: (-len(together[v]), v))
    depth = walk(together, hub)[0]
    far = min(depth, key=lambda v: (-depth[v], v)) if max(depth.values()) <= 5 else None
    paths, front = [(hub,)], [(hub,)]
    for _ in range(5):
        front = [(*p, w) for p in front for w in together[p[-1]] if w not in p]
        paths += front
    text = lambda p: ">".join(map(str, p))
    got = lambda name: sorted(r.path for r in run(spark, name).collect())
    assert got("graph_simple_paths") == sorted(map(text, paths))
    assert got("graph_sql_paths") == sorted(text(p) for p in paths if len(p) <= 4)
    assert got("graph_rings") == sorted(text(p) for p in paths if 2 <= len(p) <= 5 and hub in together[p[-1]])
    assert got("graph_rays") == sorted(text(p) for p in paths if len(p) > 1 and (len(p) == 6 or not together[p[-1]] - set(p)))
    assert got("graph_all_shortest") == sorted(text(p) for p in paths if p[-1] == far and len(p) == depth[far] + 1)
    assert {r.id for r in run(spark, "graph_weighted_shortest").collect()} == set(depth)
    back = walk(together, far)[0]
    assert {r.id for r in run(spark, "graph_crosspoints").collect()} == {v for v in depth if v not in (hub, far) and depth[v] <= 3 and back[v] <= 3}


def test_long_chains_are_walked_to_their_end(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(32)], "src bigint, dst bigint")
    assert graph.shortest_distances(chain, spark.createDataFrame([(0,)], "id bigint")).count() == 33
    with pytest.raises(ValueError, match="rounds"):
        graph.k_core(chain, 2, rounds=2)
