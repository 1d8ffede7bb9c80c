import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from arborlake.operators import graph
from arborlake.session import CLEAN_UP, PARTITION_BYTES, Scratch, sized


def make(spark, edges, nodes=None):
    nodes = sorted({x for e in edges for x in e} | set(nodes or ()))
    return spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "id long")


CHAIN = [(0, 1), (1, 2), (2, 3)]
DIAMOND = [(0, 1), (0, 2), (1, 3), (2, 3)]
CYCLE = [(0, 1), (1, 2), (2, 0)]
MIXED = [*CYCLE, (2, 3), (3, 4), (4, 3), (5, 5), (6, 0)]


def as_dict(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


@pytest.mark.parametrize("small", [0, graph.SMALL_EDGES])
def test_strong_components(spark, small):
    for edges, want in ((CHAIN, {0: 0, 1: 1, 2: 2, 3: 3}), (CYCLE, {0: 0, 1: 0, 2: 0}), ([*DIAMOND, (3, 0)], dict.fromkeys(range(4), 0)), (MIXED, {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6})):
        e, v = make(spark, edges)
        assert as_dict(graph.strong_components(e, v, small), "id", "scc_id") == want


@pytest.mark.parametrize("small", [0, graph.SMALL_EDGES])
def test_layers(spark, small):
    for edges, want in ((CHAIN, {0: 0, 1: 1, 2: 2, 3: 3}), (DIAMOND, {0: 0, 1: 1, 2: 1, 3: 2}), (CYCLE, {0: 0, 1: 0, 2: 0}), (MIXED, {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 0, 6: 0})):
        e, v = make(spark, edges)
        assert as_dict(graph.layers(e, graph.strong_components(e, v, small), small), "id", "layer") == want


def test_ids_of_64_bits_stay_exact(spark):
    big = 2**62
    e, v = make(spark, [(big + a, big + b) for a, b in MIXED])
    assert as_dict(graph.strong_components(e, v), "id", "scc_id") == {big + k: big + c for k, c in {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}.items()}
    assert set(as_dict(graph.louvain(e, v), "id", "cluster_id")) == {big + k for k in range(7)}


def test_cycles_and_propagation(spark):
    e, v = make(spark, CYCLE)
    scc = graph.strong_components(e, v)
    assert graph.cycles(scc).first().size == 3 and graph.propagation_cost(e, v).first().propagation_cost == 1.0
    e, v = make(spark, [(k, k + 1) for k in range(4)])
    assert graph.cycles(graph.strong_components(e, v)).isEmpty() and graph.propagation_cost(e, v).first().propagation_cost == 0.5
    e, v = make(spark, [(0, 1), (2, 3)])
    assert graph.propagation_cost(e, v).first().propagation_cost == 0.1667
    assert as_dict(graph.connected_components(e, v), "id", "component") == {0: 0, 1: 0, 2: 2, 3: 2}


def test_search(spark):
    e, _ = make(spark, MIXED)
    start = spark.createDataFrame([(6,)], "id long")
    assert as_dict(graph.reachable(e, start, 2), "id", "depth") == {0: 1, 1: 2}
    assert as_dict(graph.reachable(e, start, 50), "id", "depth") == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5}
    assert {(r.a, r.b) for r in graph.closure(e).collect()} >= {(6, 4), (0, 0), (5, 5)}


def test_paths(spark):
    e, _ = make(spark, CHAIN)
    assert [r.path for r in graph.k_paths(e, 0, 3).collect()] == ["0>1>2>3"]
    e, _ = make(spark, DIAMOND)
    assert [r.path for r in graph.k_paths(e, 0, 3).collect()] == ["0>1>3", "0>2>3"]
    e, _ = make(spark, [(0, k) for k in (1, 2, 3)] + [(k, 9) for k in (1, 2, 3)])
    assert graph.k_paths(e, 0, 9, 2).count() == 2 and graph.k_paths(e, 9, 0).count() == 0


def test_paths_of_any_length(spark):
    e, _ = make(spark, [(k, k + 1) for k in range(12)])
    assert [(r.hops, r.path) for r in graph.k_paths(e, 0, 12).collect()] == [(12, ">".join(map(str, range(13))))]
    assert as_dict(graph.distances(e, 0), "id", "depth") == {k: k for k in range(13)}
    r = random.Random(3)
    for _ in range(3):
        edges = sorted({(a, b) for a, b in ((r.randrange(7), r.randrange(7)) for _ in range(18)) if a != b})
        e, _ = make(spark, edges, range(7))
        adj = {a: [y for x, y in edges if x == a] for a in range(7)}
        found, open_ = [], [(0,)]
        while open_:
            p = open_.pop()
            if p[-1] == 6:
                found.append((len(p) - 1, ">".join(map(str, p))))
            else:
                open_ += [(*p, w) for w in adj[p[-1]] if w not in p]
        assert [(x.hops, x.path) for x in graph.k_paths(e, 0, 6, 5).collect()] == sorted(found)[:5]


def test_closure_is_that_of_every_walk(spark):
    e, _ = make(spark, MIXED)
    reach = set(MIXED)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            break
        reach = more
    got = [(r.a, r.b) for r in graph.closure(e).collect()]
    assert set(got) == reach and len(got) == len(reach)


def test_pagerank_stops_when_it_stays_or_falls_back_to_degrees(spark):
    e, v = make(spark, [*CYCLE, (3, 0)])
    ranks = as_dict(graph.pagerank(e, v, tolerance=0.02), "id", "rank")
    assert sum(ranks.values()) == pytest.approx(1) and ranks[0] > ranks[1] > ranks[3]
    assert as_dict(graph.pagerank(e, v, rounds=1, tolerance=1e-12), "id", "rank") == {0: 1.0, 1: pytest.approx(2 / 3), 2: pytest.approx(2 / 3), 3: pytest.approx(1 / 3)}


def test_betweenness_from_some_sources(spark):
    e, v = make(spark, [(0, 1), (1, 2), (2, 3)])
    assert as_dict(graph.betweenness(e, v, 99), "id", "betweenness") == {0: 0, 1: 2, 2: 2, 3: 0}
    assert set(as_dict(graph.betweenness(e, v, 2), "id", "betweenness")) == set(range(4))


def test_centrality(spark):
    e, v = make(spark, [(0, k) for k in range(1, 6)])
    d = {r.id: (r.in_degree, r.out_degree) for r in graph.degrees(e, v).collect()}
    assert d[0] == (0, 5) and d[3] == (1, 0)
    ranks = as_dict(graph.pagerank(e, v), "id", "rank")
    assert sum(ranks.values()) == pytest.approx(1) and ranks[1] > ranks[0]
    e, v = make(spark, MIXED)
    adj = {}
    for a, b in MIXED:
        adj.setdefault(a, set()).add(b)

    def paths(s, t):
        best, frontier = [], [[s]]
        while frontier and not best:
            frontier = [p + [w] for p in frontier for w in adj.get(p[-1], ()) if w not in p]
            best = [p for p in frontier if p[-1] == t]
        return best

    want = dict.fromkeys(range(7), 0.0)
    for s, t in itertools.permutations(range(7), 2):
        ps = paths(s, t)
        for p in ps:
            for x in p[1:-1]:
                want[x] += 1 / len(ps)
    assert as_dict(graph.betweenness(e, v), "id", "betweenness") == pytest.approx(want)


def test_communities(spark):
    two = [(a, b) for g in (range(4), range(4, 8)) for a in g for b in g if a < b] + [(0, 4)]
    e, v = make(spark, two)
    assert as_dict(graph.louvain(e, v), "id", "cluster_id") == {k: 0 if k < 4 else 4 for k in range(8)}
    assert graph.cohesion(e, graph.louvain(e, v)).filter("cluster_id = 0").first().inside == 6
    assert graph.label_propagation(e, v, 5).count() == 8


def test_layer_violations_take_any_layers(spark):
    e, _ = make(spark, DIAMOND)
    at = spark.createDataFrame([(0, 2), (1, 1), (2, 3), (3, 0)], "id long, layer long")
    assert {(r.src, r.dst, r.distance) for r in graph.layer_violations(e, at).collect()} == {(0, 1, 1), (1, 3, 1), (2, 3, 3)}


def test_topological_order_and_weakest_edge(spark):
    e, v = make(spark, DIAMOND)
    assert as_dict(graph.topological_order(e, v.select(F.col("id").alias("node"))), "node", "round") == {0: 0, 1: 1, 2: 1, 3: 2}
    e, v = make(spark, [*CYCLE, (0, 2)])
    w = graph.weakest_edges(e, graph.strong_components(e, v)).first()
    assert (w.src, w.dst) == (0, 2)


def louvain_at_once(edges, nodes):
    """The whole graph in dictionaries."""
    graph = {v: {} for v in nodes}
    for a, b in edges:
        if a != b:
            graph[a][b] = graph[b][a] = 1.0
    member = {v: v for v in nodes}
    while True:
        m2, changed, moved = sum(sum(x.values()) for x in graph.values()), False, True
        comm, deg = {v: v for v in graph}, {v: sum(x.values()) for v, x in graph.items()}
        tot = dict(deg)
        while moved:
            moved = False
            for v in sorted(graph):
                near = {}
                for u, w in graph[v].items():
                    if u != v:
                        near[comm[u]] = near.get(comm[u], 0.0) + w
                tot[comm[v]] -= deg[v]
                best = max(sorted({*near, comm[v]}), key=lambda c: (near.get(c, 0.0) - tot[c] * deg[v] / m2, c == comm[v], -c))
                tot[best] += deg[v]
                if best != comm[v]:
                    comm[v], moved, changed = best, True, True
        if not changed:
            break
        member, merged = {v: comm[c] for v, c in member.items()}, {}
        for v, x in graph.items():
            row = merged.setdefault(comm[v], {})
            for u, w in x.items():
                row[comm[u]] = row.get(comm[u], 0.0) + w
        graph = merged
    return {v: min(u for u in nodes if member[u] == member[v]) for v in nodes}


def random_graph(seed):
    """Three components of different density, and nodes of their own."""
    r = random.Random(seed)
    return sorted({(lo + r.randrange(n), lo + r.randrange(n)) for lo, n, m in ((0, 40, 90), (50, 25, 200), (90, 12, 14)) for _ in range(m)}), range(110)


def test_louvain_by_component_is_that_of_the_whole_graph(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", 100)
    monkeypatch.setattr(graph, "AT_ONCE", 16)
    for seed in (1, 2):
        edges, nodes = random_graph(seed)
        e, v = make(spark, edges, nodes)
        assert as_dict(graph.louvain(e, v), "id", "cluster_id") == louvain_at_once(edges, nodes)


def test_betweenness_gathers_nothing_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", 100)
    monkeypatch.setattr(graph, "AT_ONCE", 16)
    edges, nodes = random_graph(3)
    adj, want = {}, dict.fromkeys(nodes, 0.0)
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    for s in nodes:
        dist, sigma, pred, order = {s: 0}, {s: 1}, {}, [s]
        for x in order:
            for w in adj.get(x, ()):
                if w not in dist:
                    dist[w] = dist[x] + 1
                    order.append(w)
                if dist[w] == dist[x] + 1:
                    sigma[w] = sigma.get(w, 0) + sigma[x]
                    pred.setdefault(w, []).append(x)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            for x in pred[w]:
                delta[x] += sigma[x] / sigma[w] * (1 + delta[w])
            want[w] += delta[w]
    e, v = make(spark, edges, nodes)
    assert as_dict(graph.betweenness(e, v), "id", "betweenness") == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("apart", [graph.COMPONENT_EDGES, 60, 0])
def test_strong_components_of_connected_components(spark, monkeypatch, apart):
    """Components as tasks' work each, some of them by joins, or all; against reachability in dictionaries."""
    monkeypatch.setattr(graph, "STAR_EDGES", 20)
    rng = random.Random(5)
    pairs = [(1000 * c + rng.randrange(n), 1000 * c + rng.randrange(n)) for c, n, m in ((0, 30, 45), (1, 40, 90), (2, 8, 30), (3, 5, 4)) for _ in range(m)]
    e, v = make(spark, pairs, [9999, 3])
    nodes = {r.id for r in v.collect()}
    reach = {a: {a} for a in nodes}
    while True:
        more = {a: r.union(*(reach[y] for x, y in pairs if x in r)) for a, r in reach.items()}
        if more == reach:
            break
        reach = more
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in nodes}
    assert as_dict(graph.strong_components(e, v, 1, apart), "id", "scc_id") == want


def test_a_small_graphs_task_gets_only_nodes_with_an_edge(spark, monkeypatch):
    """Of 20,000 vertices 5 have an edge."""

    def at_most(solve):
        def run(ids, marks, ptr, to):
            if len(ids) > 7:
                raise ValueError("all vertices gathered")
            return solve(ids, marks, ptr, to)

        return run

    monkeypatch.setattr(graph, "_strong", at_most(graph._strong))
    monkeypatch.setattr(graph, "_longest", at_most(graph._longest))
    e, _ = make(spark, MIXED)
    scc = graph.strong_components(e, spark.range(20_000))
    assert scc.count() == 20_000 and scc.filter("id <> scc_id").count() == 3
    got = as_dict(graph.layers(e, scc), "id", "layer")
    assert len(got) == 20_000 and {k: got[k] for k in range(8)} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 0, 6: 0, 7: 0}


def test_the_shuffles_of_a_scratch_table_go_with_its_writing(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles() -> set[str]:
        all_ = files.getAllFiles()
        return {f for k in range(all_.size()) if (f := all_.apply(k).getName()).startswith("shuffle_")}

    before, scratch = shuffles(), Scratch(spark, "shuffles")
    saved = scratch.save(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "t")
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.conf.get(CLEAN_UP) == "false"
    assert saved.agg(F.sum("n")).first()[0] == 1000


def test_partitions_of_a_sized_session_grow_with_its_tables(spark):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    n = [int(sized(spark, k * PARTITION_BYTES).conf.get("spark.sql.shuffle.partitions")) for k in (100, 600)]
    assert n == [100, 600] and spark.conf.get("spark.sql.shuffle.partitions") == had
