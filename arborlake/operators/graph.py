"""Graph operators on edge tables: edges have src and dst, vertices an id.

Loops are level-synchronous joins. Each round is cut by a table in the shared folder, so lineage
stays short and a lost executor costs one round at most; rounds stop at a count or a fixpoint.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions.strings import round_half_up
from arborlake.operators.ranking import first_per_key
from arborlake.session import Scratch

EDGE_COST = {"call": 1.0, "uses": 1.0, "inherits": 1.0, "implements": 1.0, "uses_trait": 1.0, "template": 1.0, "import": 1.1, "reference": 1.2}


def simple(edges: DataFrame) -> DataFrame:
    """Parallel edges merged, the last kind (by edge id) kept."""
    return edges.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.max_by("kind", "id").alias("kind"))


def from_symbols(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose ends are both symbols."""
    ids = symbols.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    both = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    d = both.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return vertices.join(d, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def reachable(edges: DataFrame, starts: DataFrame, most: int = 10) -> DataFrame:
    """id, depth of what a breadth-first search reaches from starts (id) within most steps, without the starts."""
    scratch = Scratch(edges.sparkSession, "bfs")
    seen = scratch.save(starts.select("id").distinct().withColumn("depth", F.lit(0)), "seen-0")
    e = scratch.save(edges.select("src", "dst").distinct(), "edges")
    frontier, parts = seen.select("id"), [seen]
    for d in range(1, most + 1):
        if len(parts) > 16:  # a long search would read ever more small tables
            parts = [scratch.save(_union(parts), f"so-far-{d}")]
        found = e.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(_union(parts), "id", "left_anti").withColumn("depth", F.lit(d))
        found = scratch.save(found, f"seen-{d}")
        if found.isEmpty():
            break
        parts.append(found)
        frontier = found.select("id")
    return _union(parts).filter("depth > 0")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _doubled(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: b is reached from a by one step or more. Path doubling."""
    now = scratch.save(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "0")
    n, k = now.count(), 0
    while True:
        k += 1
        longer = now.alias("x").join(now.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        after = scratch.save(now.unionByName(longer).distinct(), str(k))
        scratch.drop(str(k - 1))
        m = after.count()
        if m == n:
            return after
        now, n = after, m


def closure(edges: DataFrame, scc: DataFrame | None = None) -> DataFrame:
    """a, b: b is reached from a by one step or more. Between components by path doubling over the condensation, within one by its members; the pairs are the result, so its size is their number."""
    scratch = Scratch(edges.sparkSession, "closure")
    edges = scratch.save(edges.select("src", "dst").distinct(), "edges")
    if scc is None:
        ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        scc = scratch.save(strong_components(edges, ends), "scc")
    far = _doubled(condensation(edges, scc), scratch)
    a, b = scc.select(F.col("id").alias("a"), F.col("scc_id").alias("sa")), scc.select(F.col("id").alias("b"), F.col("scc_id").alias("sb"))
    across = far.select(F.col("a").alias("sa"), F.col("b").alias("sb")).join(a, "sa").join(b, "sb").select("a", "b")
    several = scc.groupBy("scc_id").count().filter("count > 1").select("scc_id")
    loops = edges.filter("src = dst").select(F.col("src").alias("id")).join(scc, "id").join(several, "scc_id", "left_anti").select(F.col("id").alias("a"), F.col("id").alias("b")).distinct()
    inside = a.join(several, F.col("sa") == F.col("scc_id"), "left_semi").join(b, F.col("sa") == F.col("sb")).select("a", "b")
    return across.unionByName(inside).unionByName(loops)


def _fixpoint(scratch: Scratch, now: DataFrame, step, name: str) -> DataFrame:
    """Repeats step until the table's checksum stays, however many rounds that takes. Of the rounds only the last is left."""
    mark = [F.count("*"), F.sum(F.xxhash64(*now.columns).cast("decimal(38,0)"))]
    seen, k = None, 0
    while True:
        k += 1
        after = scratch.save(step(now), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
        sign = after.agg(*mark).first()
        if sign == seen:
            return after
        now, seen = after, sign


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its connected component, and that one."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = np.split(at, 2)
    root = np.arange(len(ids))
    while len(u):
        u, v = root[u], root[v]
        apart = u != v
        u, v = np.minimum(u[apart], v[apart]), np.maximum(u[apart], v[apart])
        np.minimum.at(root, v, u)
        while not np.array_equal(up := root[root], root):
            root = up
    below = root != np.arange(len(ids))
    return ids[below], ids[root[below]]


#: Edges that a task joins to stars at a time, and the most that it keeps of these.
STAR_EDGES = 1_000_000


def _forest(edges: DataFrame) -> DataFrame:
    """src, dst: fewer edges with the same connected components. Of edges whose ids are near each other, a task leaves a star for each component."""
    types = dict(edges.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, n = [], [], 0
        for pdf in batches:
            a.append(pdf.src.values)
            b.append(pdf.dst.values)
            n += len(pdf)
            if n >= STAR_EDGES:
                one, other = _stars(np.concatenate(a), np.concatenate(b))
                a, b, n = [one], [other], 0
                if len(one) >= STAR_EDGES:
                    yield pd.DataFrame({"src": one, "dst": other})
                    a, b = [], []
        if a:
            yield pd.DataFrame(dict(zip(("src", "dst"), _stars(np.concatenate(a), np.concatenate(b)))))

    near = edges.select("src", "dst").filter("src <> dst").repartitionByRange("src")
    return near.mapInPandas(run, f"src {types['src']}, dst {types['dst']}")


def connected_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, component: the least id of the undirected component, of vertices and the edges' ends. Rounds go over forests of the edges, and labels jump to their label's label, so rounds are small and few."""
    scratch = Scratch(edges.sparkSession, "cc")
    forest = scratch.save(_forest(edges), "forest")
    both = scratch.save(forest.unionByName(reverse(forest)).distinct(), "edges")

    def step(now: DataFrame) -> DataFrame:
        near = both.join(now.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        low = now.join(near, "id", "left").select("id", F.least("component", F.coalesce("c", F.col("component"))).alias("component"))
        up = low.select(F.col("id").alias("component"), F.col("component").alias("up"))
        return low.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component"))

    nodes = vertices.select("id").unionByName(both.select(F.col("src").alias("id"))).distinct()
    found = _fixpoint(scratch, scratch.save(nodes.select("id", F.col("id").alias("component")), "0"), step, "round")
    return found.join(vertices.select("id"), "id", "left_semi")


#: Graphs of up to so many edges are one task's work: a loop of joins costs seconds a round, whatever its size.
SMALL_EDGES = 1_000_000


def _in_one_task(edges: DataFrame, vertices: DataFrame, solve, alone: Column, schema: str) -> DataFrame:
    """solve(ids, marks, ptr, to), as of a component's, on a graph that the caller has found small and saved. Vertices without an edge,
    of which there may be any number, stay where they are: each is a row of its id and alone."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf.a.values == pdf.b.values
        ids = np.unique(pdf.a.values[node])
        a, b = pdf.a.values[~node], pdf.b.values[~node]
        at, to = np.searchsorted(ids, a), np.searchsorted(ids, b)
        known = (ids.take(at, mode="clip") == a) & (ids.take(to, mode="clip") == b) if len(ids) else np.zeros(len(a), bool)
        at, to = at[known], to[known]
        order = np.argsort(at, kind="stable")
        ptr = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(ids)))))
        return pd.DataFrame(dict(zip(names, solve(ids, None, ptr, to[order].astype("int32")))))

    e = edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ends = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()
    nodes = vertices.join(ends, "id", "left_semi").select(F.col("id").alias("a"), F.col("id").alias("b"))
    found = e.unionByName(nodes).withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda pdf: run(pdf), schema)
    return found.unionByName(vertices.join(ends, "id", "left_anti").select(F.col("id").cast("long").alias(names[0]), alone.cast("long").alias(names[1])))


def _strong(ids: np.ndarray, marks: np.ndarray, ptr: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node and the least of its strongly connected component: Tarjan's method in packed arrays."""
    n, k = len(ids), 0
    end, at, into = array("q", ptr[1:].astype("int64").tobytes()), array("q", ptr[:-1].astype("int64").tobytes()), array("i", to.astype("int32").tobytes())
    index, low, comp = array("i", bytes(4 * n)), array("i", bytes(4 * n)), array("i", [-1]) * n
    stack, work = array("i"), array("i")
    for root in range(n):
        if index[root]:
            continue
        k += 1
        index[root] = low[root] = k
        stack.append(root)
        work.append(root)
        while work:
            v = work[-1]
            p = at[v]
            if p < end[v]:
                at[v] = p + 1
                w = into[p]
                if not index[w]:
                    k += 1
                    index[w] = low[w] = k
                    stack.append(w)
                    work.append(w)
                elif comp[w] < 0 and index[w] < low[v]:
                    low[v] = index[w]
                continue
            work.pop()
            if work and low[v] < low[work[-1]]:
                low[work[-1]] = low[v]
            if low[v] == index[v]:
                first = len(stack) - 1
                while stack[first] != v:
                    first -= 1
                least = min(stack[first:])
                for w in stack[first:]:
                    comp[w] = least
                del stack[first:]
    return ids, ids[np.frombuffer(comp, "int32")]


#: Connected components of up to so many edges are a task's work each, larger ones are solved by joins.
COMPONENT_EDGES = 8_000_000


def strong_components(edges: DataFrame, vertices: DataFrame, small: int = SMALL_EDGES, apart: int = COMPONENT_EDGES) -> DataFrame:
    """id, scc_id: the least id of the strongly connected component. Graphs of up to small edges are solved in one task. In others, each
    connected component of up to apart edges is one task's work, and what is left goes by joins; with small 0, all does."""
    scratch = Scratch(edges.sparkSession, "strong")
    e = scratch.save(edges.filter("src <> dst").select("src", "dst").distinct(), "edges")
    if e.count() <= small:
        return _in_one_task(e, vertices, _strong, F.col("id"), "id long, scc_id long")
    if not small:
        return _strong_by_joins(e, vertices)
    ids = vertices.select(F.col("id").alias("src"))
    e = e.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")
    at = scratch.save(connected_components(e, vertices).select(F.col("component").alias("c"), F.lit(0).alias("part"), "id", F.lit(0).cast("long").alias("mark")), "nodes")
    ends = scratch.save(e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(at.select(F.col("id").alias("a"), "c", "part"), "a"), "ends")
    large = scratch.save(ends.groupBy("c").agg(F.count("*").alias("n")).filter(F.col("n") > apart).select("c"), "large")
    done = _solved_by_component(at.join(large, "c", "left_anti"), ends.join(large, "c", "left_anti"), _strong, "id long, scc_id long")
    if large.isEmpty():
        return scratch.save(done, "found")
    rest = ends.join(large, "c", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return scratch.save(done.unionByName(_strong_by_joins(rest, at.join(large, "c", "left_semi").select("id"))), "found")


def _strong_by_joins(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Trim and colour: nodes without an edge in or out among those left are components of their own; of the rest, each takes
    the least id that reaches it as colour, and what reaches the colour's own node within the colour is its component."""
    scratch = Scratch(edges.sparkSession, "scc")
    left = scratch.save(vertices.select("id"), "left-0")
    e = scratch.save(edges.filter("src <> dst").select("src", "dst").distinct(), "edges-0")
    done: list[DataFrame] = []
    k = 0
    while not left.isEmpty():
        k += 1

        def trim(now: DataFrame) -> DataFrame:
            return now.join(now.select(F.col("dst").alias("src")), "src", "left_semi").join(now.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")

        core = _fixpoint(scratch, e, trim, f"core-{k}")
        nodes = core.select(F.col("src").alias("id")).distinct()
        done.append(scratch.save(left.join(nodes, "id", "left_anti").select("id", F.col("id").alias("scc_id")), f"single-{k}"))
        if core.isEmpty():
            break

        def spread(now: DataFrame, along: DataFrame) -> DataFrame:
            into = along.join(now.select(F.col("id").alias("src"), F.col("colour").alias("c")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("c"))
            return now.join(into, "id", "left").select("id", F.least("colour", F.coalesce("c", F.col("colour"))).alias("colour"))

        colour = _fixpoint(scratch, scratch.save(nodes.select("id", F.col("id").alias("colour")), f"colour-{k}-0"), lambda t, c=core: spread(t, c), f"colour-{k}")
        a, b = colour.select(F.col("id").alias("src"), F.col("colour").alias("ca")), colour.select(F.col("id").alias("dst"), F.col("colour").alias("cb"))
        inside = scratch.save(core.join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst"), f"inside-{k}")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.filter("id = colour").select("id", F.lit(True).alias("hit"), "colour")
        flags = colour.select("id", "colour", (F.col("id") == F.col("colour")).alias("hit"))

        def grow(now: DataFrame, along: DataFrame = back) -> DataFrame:
            into = along.join(now.filter("hit").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("new", F.lit(True))
            return now.join(into, "id", "left").select("id", "colour", (F.col("hit") | F.coalesce("new", F.lit(False))).alias("hit"))

        found = _fixpoint(scratch, scratch.save(flags, f"flags-{k}-0"), grow, f"flags-{k}")
        done.append(found.filter("hit").select("id", F.col("colour").alias("scc_id")))
        left = scratch.save(found.filter("NOT hit").select("id"), f"left-{k}")
        ids = left
        e = scratch.save(core.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), f"edges-{k}")
    out = done[0] if done else vertices.select("id", F.col("id").alias("scc_id"))
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def cycles(scc: DataFrame, least: int = 2) -> DataFrame:
    g = scc.groupBy("scc_id").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("members"))
    return g.filter(F.col("size") >= least)


def annotate_cycles(scc: DataFrame, files: DataFrame) -> DataFrame:
    """Cycles with how many folders they span, and their severity."""
    from arborlake.functions.strings import dirname

    j = scc.join(files.select("id", "path"), "id")
    g = j.groupBy("scc_id").agg(F.count("*").alias("size"), F.count_distinct("path").alias("n_files"), F.count_distinct(dirname("path")).alias("dirs"))
    return g.filter("size >= 2").withColumn("severity", F.when(F.col("dirs") == 1, "INFO").when(F.col("n_files") > 3, "CRITICAL").otherwise("WARNING"))


def tangle(scc: DataFrame) -> DataFrame:
    """n, nodes in cycles, their share in percent (1 decimal), and PageRank's damping for it."""
    g = scc.groupBy("scc_id").agg(F.count("*").alias("k"))
    x = g.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("in_cycles"))
    share = F.col("in_cycles") / F.col("n")
    return x.select("n", "in_cycles", round_half_up(share * 100, 1).alias("tangle_ratio"), round_half_up(F.lit(0.92) - share * 0.10, 3).alias("alpha"))


def condensation(edges: DataFrame, scc: DataFrame) -> DataFrame:
    a, b = scc.select(F.col("id").alias("src"), F.col("scc_id").alias("sa")), scc.select(F.col("id").alias("dst"), F.col("scc_id").alias("sb"))
    return edges.join(a, "src").join(b, "dst").filter("sa <> sb").select(F.col("sa").alias("src"), F.col("sb").alias("dst")).distinct()


def _longest(ids: np.ndarray, marks: np.ndarray, ptr: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node and the length of the longest path that ends in it, of an acyclic graph."""
    into = np.bincount(to, minlength=len(ids))
    left, layer, free = array("i", into.astype("int32").tobytes()), array("i", bytes(4 * len(ids))), array("i", np.flatnonzero(into == 0).astype("int32").tobytes())
    for v in free:
        for w in to[ptr[v] : ptr[v + 1]].tolist():
            layer[w] = max(layer[w], layer[v] + 1)
            left[w] -= 1
            if not left[w]:
                free.append(w)
    return ids, np.frombuffer(layer, "int32").astype("int64")


def layers(edges: DataFrame, scc: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """id, layer: the longest path from a source over the condensation. A condensation of up to small edges is one task's work."""
    scratch = Scratch(edges.sparkSession, "layers")
    dag = scratch.save(condensation(edges, scc), "dag")
    if dag.count() <= small:
        found = _in_one_task(dag, scc.select(F.col("scc_id").alias("id")).distinct(), _longest, F.lit(0), "node long, layer long")
        return scc.join(found, F.col("scc_id") == F.col("node")).select("id", "layer")

    def step(now: DataFrame) -> DataFrame:
        up = dag.join(now.select(F.col("node").alias("src"), F.col("layer").alias("l")), "src").groupBy(F.col("dst").alias("node")).agg((F.max("l") + 1).alias("l"))
        return now.join(up, "node", "left").select("node", F.greatest("layer", F.coalesce("l", F.lit(0).cast("long"))).alias("layer"))

    start = scratch.save(scc.select(F.col("scc_id").alias("node")).distinct().withColumn("layer", F.lit(0).cast("long")), "0")
    found = _fixpoint(scratch, start, step, "round")
    return scc.join(found, F.col("scc_id") == F.col("node")).select("id", "layer")


def topological_order(dag: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, round: the round in which Kahn's peeling of nodes without a predecessor left takes it; a cycle's nodes never come."""
    scratch = Scratch(dag.sparkSession, "topo")
    left, e, out, k = scratch.save(nodes.select("node"), "n-0"), scratch.save(dag.select("src", "dst"), "e-0"), nodes.select("node", F.lit(0).alias("round")).limit(0), 0
    while True:
        free = scratch.save(left.join(e.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.lit(k).alias("round")), f"free-{k}")
        if free.isEmpty():
            return out
        out = out.unionByName(free)
        k += 1
        left = scratch.save(left.join(free, "node", "left_anti"), f"n-{k}")
        e = scratch.save(e.join(free.select(F.col("node").alias("src")), "src", "left_anti"), f"e-{k}")


def layer_violations(edges: DataFrame, layers_: DataFrame) -> DataFrame:
    """Edges that go from a higher to a lower layer of any assignment, with severity by distance."""
    a, b = layers_.select(F.col("id").alias("src"), F.col("layer").alias("from_layer")), layers_.select(F.col("id").alias("dst"), F.col("layer").alias("to_layer"))
    top = layers_.agg(F.max("layer").alias("top"))
    j = edges.select("src", "dst").join(a, "src").join(b, "dst").filter("from_layer > to_layer").join(F.broadcast(top))
    d = F.col("from_layer") - F.col("to_layer")
    return j.select("src", "dst", "from_layer", "to_layer", d.alias("distance"), round_half_up(d / F.greatest("top", F.lit(1)), 3).alias("severity"))


def layer_sizes(layers_: DataFrame) -> DataFrame:
    return layers_.groupBy("layer").agg(F.count("*").alias("n"))


def architecture(layers_: DataFrame) -> DataFrame:
    x = layers_.agg((F.max("layer") + 1).alias("layers"))
    return x.withColumn("arch_type", F.when(F.col("layers") >= 6, "well-layered").when(F.col("layers") >= 3, "moderate").otherwise("flat"))


def propagation_cost(edges: DataFrame, vertices: DataFrame, scc: DataFrame | None = None) -> DataFrame:
    """Reachable ordered pairs over all pairs (4 decimals). Counted over the condensation by the sizes of components, so no pair of nodes is made."""
    scratch = Scratch(edges.sparkSession, "cost")
    scc = scratch.save(strong_components(edges, vertices), "scc") if scc is None else scc
    size = scratch.save(scc.groupBy("scc_id").agg(F.count("*").alias("k")), "sizes")
    far = _doubled(condensation(edges, scc), scratch)
    across = far.join(size.select(F.col("scc_id").alias("a"), F.col("k").alias("ka")), "a").join(size.select(F.col("scc_id").alias("b"), F.col("k").alias("kb")), "b")
    pairs = across.select((F.col("ka") * F.col("kb")).alias("p")).unionByName(size.select((F.col("k") * (F.col("k") - 1)).alias("p"))).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pairs"))
    return pairs.join(F.broadcast(vertices.agg(F.count("*").alias("n")))).select("pairs", "n", round_half_up(F.when(F.col("n") > 1, F.col("pairs") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0), 4).alias("propagation_cost"))


def algebraic_connectivity(vertices: DataFrame) -> DataFrame:
    """A constant, as no query has ever used more."""
    return vertices.agg(F.lit(0.0).alias("connectivity"))


def weakest_edges(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Per cycle, the edge to cut: the most outgoing source, then the most incoming target, within the cycle."""
    a, b = scc.select(F.col("id").alias("src"), "scc_id"), scc.select(F.col("id").alias("dst"), F.col("scc_id").alias("s2"))
    inside = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").filter("scc_id = s2 AND src <> dst").select("scc_id", "src", "dst")
    out = inside.groupBy("scc_id", "src").agg(F.count("*").alias("out_n"))
    into = inside.groupBy("scc_id", "dst").agg(F.count("*").alias("in_n"))
    return first_per_key(inside.join(out, ["scc_id", "src"]).join(into, ["scc_id", "dst"]), ["scc_id"], [F.desc("out_n"), F.desc("in_n"), F.asc("src"), F.asc("dst")])


def pagerank(edges: DataFrame, vertices: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Power iteration until the ranks change by less than tolerance a node on average; the mass of nodes without an edge out is spread evenly.

    If so many rounds don't do, ranks are degrees over the highest degree."""
    scratch = Scratch(edges.sparkSession, "pagerank")
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("k"))
    links = scratch.save(e.join(out, "src"), "links")
    n = vertices.count()
    now = scratch.save(vertices.select("id", F.lit(1.0 / max(1, n)).alias("rank")).join(out.select(F.col("src").alias("id"), "k"), "id", "left").withColumn("moved", F.lit(1.0)), "0")
    for r in range(rounds + 1):
        lost, moved = now.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("rank"))), F.lit(0.0)), F.coalesce(F.sum("moved"), F.lit(0.0))).first()
        if moved < n * tolerance or not n:
            return now.select("id", "rank")
        if r == rounds:
            break
        into = links.join(now.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
        fresh = F.lit((1 - alpha) / n + alpha * lost / n) + alpha * F.coalesce("got", F.lit(0.0))
        now = scratch.save(now.select("id", "k", F.col("rank").alias("before")).join(into, "id", "left").select("id", fresh.alias("rank"), "k", F.abs(fresh - F.col("before")).alias("moved")), str(r + 1))
        scratch.drop(str(r))
    d = degrees(e, vertices).withColumn("d", F.col("in_degree") + F.col("out_degree"))
    return d.join(F.broadcast(d.agg(F.greatest(F.max("d"), F.lit(1)).alias("top")))).select("id", (F.col("d") / F.col("top")).alias("rank"))


#: The last step of k paths needs the adjacency in one place: it takes graphs up to so many edges.
LOCAL_EDGES = 5_000_000
#: Edges that a solver of one component gathers at a time.
AT_ONCE = 4_000_000


def _solved_by_component(nodes: DataFrame, edges: DataFrame, solve, schema: str) -> DataFrame:
    """solve(ids, marks, ptr, to) for each key: nodes have key, id, mark; edges key, a, b, each between nodes of the key.

    A key's nodes come in id order as ids; the node at k has edges to those at to[ptr[k]:ptr[k + 1]]. A task reads its keys one
    after the other and holds 4 bytes for an edge of one key; keys are spread over tasks without regard to their size in rows, as they are work."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, marks, to, counts = None, [], [], [], None

        def solved() -> pd.DataFrame:
            ptr = np.concatenate(([0], np.cumsum(counts))) if counts is not None else np.zeros(sum(map(len, ids)) + 1, "int64")
            return pd.DataFrame(dict(zip(names, solve(np.concatenate(ids), np.concatenate(marks), ptr, np.concatenate([np.empty(0, "int32"), *to])))))

        for pdf in batches:
            cut = np.flatnonzero((pdf.c.values[1:] != pdf.c.values[:-1]) | (pdf.part.values[1:] != pdf.part.values[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(pdf)]):
                if lo == hi:
                    continue
                if now != (key := (pdf.c.values[lo], pdf.part.values[lo])):
                    if now is not None:
                        yield solved()
                    now, ids, marks, to, counts = key, [], [], [], None
                edge, a, b = (pdf[c].values[lo:hi] for c in ("edge", "a", "b"))
                first = int(np.searchsorted(edge, 1))
                ids.append(a[:first])
                marks.append(b[:first])
                if first < hi - lo:
                    if counts is None:
                        ids, marks = [np.concatenate(ids)], [np.concatenate(marks)]
                        counts = np.zeros(len(ids[0]), "int64")
                    at = np.searchsorted(ids[0], np.concatenate((a[first:], b[first:])))
                    if not np.array_equal(ids[0].take(at, mode="clip"), np.concatenate((a[first:], b[first:]))):
                        raise ValueError("an edge ends in what is no vertex")
                    from_, into = np.split(at, 2)
                    to.append(into.astype("int32"))
                    where, n = np.unique(from_, return_counts=True)
                    counts[where] += n
        if now is not None:
            yield solved()

    rows = nodes.select("c", "part", F.lit(0).alias("edge"), F.col("id").alias("a"), F.col("mark").alias("b")).unionByName(edges.select("c", "part", F.lit(1).alias("edge"), "a", "b"))
    session = edges.sparkSession
    spread = rows.repartition(max(session.sparkContext.defaultParallelism * 4, int(session.conf.get("spark.sql.shuffle.partitions"))), "c", "part").sortWithinPartitions("c", "part", "edge", "a", "b")
    return spread.mapInPandas(run, schema)


def _slices(ptr: np.ndarray, some: np.ndarray) -> Iterator[np.ndarray]:
    """some nodes, in runs of about AT_ONCE edges."""
    n = np.cumsum(ptr[some + 1] - ptr[some])
    if len(n):
        yield from (x for x in np.split(some, np.unique(np.searchsorted(n, np.arange(AT_ONCE, n[-1], AT_ONCE)))) if len(x))


def _edges_of(ptr: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The source of each edge of some nodes, and its place."""
    n = ptr[some + 1] - ptr[some]
    return np.repeat(some, n), np.arange(n.sum()) + np.repeat(ptr[some] - np.cumsum(n) + n, n)


def _brandes(ids: np.ndarray, marks: np.ndarray, ptr: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node and the dependencies on it of the marked sources."""
    n = len(ids)
    total, seen = np.zeros(n), np.empty(n, "int64")
    for s in np.flatnonzero(marks):
        dist, sigma, delta, steps, front, d = np.full(n, -1, "int32"), np.zeros(n), np.zeros(n), [], np.array([s]), 0
        dist[s], sigma[s] = 0, 1.0
        while len(front):
            d, found = d + 1, []
            for some in _slices(ptr, front):
                v, at = _edges_of(ptr, some)
                w = to[at]
                new = (dist[w] < 0) | (dist[w] == d)
                v, w = v[new], w[new]
                np.add.at(sigma, w, sigma[v])
                fresh = w[dist[w] < 0]
                seen[fresh] = np.arange(len(fresh))
                found.append(fresh[seen[fresh] == np.arange(len(fresh))])
                dist[w] = d
                steps.append((v.astype("int32"), w))
            front = np.concatenate([np.empty(0, "int64"), *found]).astype("int64")
        for v, w in reversed(steps):
            np.add.at(delta, v, sigma[v] / sigma[w] * (1 + delta[w]))
        delta[s] = 0.0
        total += delta
    return ids, total


def betweenness(edges: DataFrame, vertices: DataFrame, sources: int | None = None) -> DataFrame:
    """Unnormalised, directed, unweighted (Brandes). A source reaches its connected component at most, so a component goes to one task, or to
    several with a share of its sources each, as it has of the work; neither the driver nor a task holds more than a component's edges.

    Exact, or estimated from so many sources, drawn by hash and scaled up, if the caller says so."""
    spark, scratch, scale = edges.sparkSession, Scratch(edges.sparkSession, "betweenness"), 1.0
    e = scratch.save(edges.filter("src <> dst").select("src", "dst").distinct(), "edges")
    some = vertices.select("id").distinct()
    if sources is not None:
        n = some.count()
        some = some.orderBy(F.xxhash64("id"), "id").limit(sources)
        scale = max(1.0, n / max(1, sources))
    everything = vertices.select("id").unionByName(e.select(F.col("src").alias("id"))).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    at = scratch.save(connected_components(e, everything).join(some.withColumn("mark", F.lit(1).cast("long")), "id", "left").select(F.col("component").alias("c"), "id", F.coalesce("mark", F.lit(0).cast("long")).alias("mark")), "nodes")
    e = scratch.save(e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(at.select(F.col("id").alias("a"), "c"), "a"), "by-component")
    size = at.groupBy("c").agg(F.sum("mark").alias("marked"), F.count("*").alias("n")).join(e.groupBy("c").agg(F.count("*").alias("m")), "c")
    work = F.col("marked").cast("double") * (F.col("n") + F.col("m"))
    all_ = size.agg(F.sum(work)).first()[0] or 1.0
    parts = scratch.save(size.filter("marked > 0").select("c", F.greatest(F.lit(1), F.ceil(work * spark.sparkContext.defaultParallelism / all_)).cast("int").alias("parts")), "parts")
    shared = lambda df: df.join(parts, "c").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = F.when(F.pmod(F.xxhash64("id"), F.col("parts")) == F.col("part"), F.col("mark")).otherwise(0).alias("mark")
    found = _solved_by_component(shared(at).select("c", "part", "id", own), shared(e), _brandes, "id long, b double")
    total = found.groupBy("id").agg((F.sum("b") * scale).alias("b"))
    return vertices.select("id").join(total, "id", "left").select("id", F.round(F.coalesce("b", F.lit(0.0)), 6).alias("betweenness"))


def _communities(ids: np.ndarray, ptr: np.ndarray, to: np.ndarray, m2: float) -> tuple[np.ndarray, np.ndarray]:
    """Each node and the least node of its community, by Louvain on one component of a graph of whose edges there are m2 / 2."""
    member, weight = np.arange(len(ids)), None
    while True:
        n = len(ptr) - 1
        comm = np.arange(n)
        deg = np.diff(ptr).astype("float64") if weight is None else np.bincount(np.repeat(comm, np.diff(ptr)), weight, n)
        tot, moved, changed = deg.copy(), True, False
        while moved:
            moved = False
            for v in range(n):
                lo, hi = ptr[v], ptr[v + 1]
                other = to[lo:hi] != v
                near = comm[to[lo:hi][other]]
                if not len(near):
                    continue
                cs, at = np.unique(near, return_inverse=True)
                gain = np.bincount(at, None if weight is None else weight[lo:hi][other]).astype("float64")
                here, dv = comm[v], deg[v]
                tot[here] -= dv
                value = gain - tot[cs] * dv / m2
                k = int(np.argmax(value))  # the first of equals is the least community
                p = int(np.searchsorted(cs, here))
                stay = value[p] if p < len(cs) and cs[p] == here else 0.0 - tot[here] * dv / m2
                best = here if stay >= value[k] else cs[k]
                tot[best] += dv
                if best != here:
                    comm[v], moved, changed = best, True, True
        if not changed:
            break
        names, comm = np.unique(comm, return_inverse=True)
        member = comm[member]
        n, codes, sums = len(names), np.empty(0, "int64"), np.empty(0)
        for some in _slices(ptr, np.arange(len(ptr) - 1)):
            v, at = _edges_of(ptr, some)
            code, k = np.unique(np.concatenate((codes, comm[v] * n + comm[to[at]])), return_inverse=True)
            sums, codes = np.bincount(k, np.concatenate((sums, np.ones(len(at)) if weight is None else weight[at])), len(code)), code
        ptr, to, weight = np.concatenate(([0], np.cumsum(np.bincount(codes // n, minlength=n)))), (codes % n).astype("int32"), sums
    least = np.full(len(ptr) - 1, ids.max())
    np.minimum.at(least, member, ids)
    return ids, least[member]


def louvain(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, cluster_id by Louvain on the undirected projection: nodes in id order, ties to the least community, communities named by their least member.

    A node's gains depend on its connected component, and on the number of all edges; so components are solved apart, with what
    all at once would give. A task holds one component at 4 bytes an edge's end, and what its communities' graph takes."""
    scratch = Scratch(edges.sparkSession, "louvain")
    pairs = scratch.save(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs")
    m2 = 2.0 * pairs.count()
    at = scratch.save(connected_components(pairs, vertices).select(F.col("component").alias("c"), F.lit(0).alias("part"), "id", F.lit(1).cast("long").alias("mark")), "nodes")
    ends = pairs.unionByName(reverse(pairs)).select(F.col("src").alias("a"), F.col("dst").alias("b")).join(at.select(F.col("id").alias("a"), "c", "part"), "a")
    return _solved_by_component(at, ends, lambda ids, marks, ptr, to: _communities(ids, ptr, to, m2), "id long, cluster_id long")


def label_propagation(edges: DataFrame, vertices: DataFrame, rounds: int = 10) -> DataFrame:
    """A distributed approximation of communities for graphs of any size: each takes its neighbours' most frequent label, ties to the least."""
    scratch = Scratch(edges.sparkSession, "labels")
    both = scratch.save(edges.select("src", "dst").unionByName(reverse(edges)).distinct(), "edges")
    now = scratch.save(vertices.select("id", F.col("id").alias("cluster_id")), "0")
    for r in range(rounds):
        n = both.join(now.select(F.col("id").alias("dst"), "cluster_id"), "dst").groupBy("src", "cluster_id").agg(F.count("*").alias("n"))
        best = n.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("n", (-F.col("cluster_id")).alias("c"))).alias("x")).select("id", (-F.col("x.c")).alias("c"))
        now = scratch.save(now.join(best, "id", "left").select("id", F.least("cluster_id", F.coalesce("c", "cluster_id")).alias("cluster_id")), str(r + 1))
        scratch.drop(str(r))
    return now


def _ends(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    a, b = clusters.select(F.col("id").alias("src"), F.col("cluster_id").alias("ca")), clusters.select(F.col("id").alias("dst"), F.col("cluster_id").alias("cb"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst")


def edge_modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Sum over edges of [same] - out * in / m, over m (4 decimals). Not Newman's: only pairs with an edge count."""
    out = edges.groupBy("src").agg(F.count("*").alias("ko"))
    into = edges.groupBy("dst").agg(F.count("*").alias("ki"))
    m = edges.agg(F.count("*").alias("m"))
    j = _ends(edges, clusters).join(out, "src").join(into, "dst").join(F.broadcast(m))
    q = F.sum((F.col("ca") == F.col("cb")).cast("double") - F.col("ko") * F.col("ki") / F.col("m")) / F.max("m")
    return j.agg(round_half_up(q, 4).alias("modularity"))


def cohesion(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Percent of a cluster's outgoing edges that stay inside."""
    g = _ends(edges, clusters).groupBy(F.col("ca").alias("cluster_id")).agg(F.sum((F.col("ca") == F.col("cb")).cast("long")).alias("inside"), F.count("*").alias("total"))
    return g.select("cluster_id", "inside", "total", round_half_up(F.col("inside") * 100 / F.col("total")).cast("long").alias("cohesion"))


def directory_mismatch(clusters: DataFrame, files: DataFrame) -> DataFrame:
    """Clusters over several folders: how many members are outside of the largest's."""
    from arborlake.functions.strings import dirname

    n = clusters.join(files.select("id", dirname("path").alias("dir")), "id").groupBy("cluster_id", "dir").agg(F.count("*").alias("k"))
    g = n.groupBy("cluster_id").agg(F.sum("k").alias("size"), F.max("k").alias("majority"), F.count("*").alias("dirs"))
    return g.filter("dirs > 1").select("cluster_id", "size", "dirs", (F.col("size") - F.col("majority")).alias("mismatch"))


def cluster_labels(clusters: DataFrame, symbols: DataFrame, files: DataFrame, metrics: DataFrame, large: int = 100, large_share: float = 0.4) -> DataFrame:
    """A large cluster is named by the shares of its top three folders; another by its folder and its best-ranked anchor symbol."""
    from arborlake.functions.strings import dirname

    s = clusters.join(symbols.select("id", "name", "kind", "file_id"), "id").join(files.select(F.col("id").alias("file_id"), dirname("path").alias("dir")), "file_id").join(metrics.select(F.col("symbol_id").alias("id"), "pagerank"), "id", "left")
    size = s.groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_distinct("dir").alias("dirs"))
    total = s.agg(F.count("*").alias("total"))
    n = s.groupBy("cluster_id", "dir").agg(F.count("*").alias("k")).join(size, "cluster_id")
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("k"), "dir"))
    share = F.format_string("%s %d%%", "dir", round_half_up(F.col("k") * 100 / F.col("size")).cast("long"))
    tops = n.withColumn("r", rank).filter("r <= 3").groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", share.alias("t")))), lambda x: x["t"]), " + ").alias("many"), F.max_by("dir", -F.col("r")).alias("dir"))
    anchor = F.when(F.col("kind").isin("class", "interface", "struct", "module", "trait"), 0).when(F.col("kind").isin("function", "method"), 1).otherwise(2)
    best = first_per_key(s.select("cluster_id", "name", "kind", "pagerank", "id"), ["cluster_id"], [anchor, F.desc_nulls_last("pagerank"), F.asc("id")]).select("cluster_id", "name")
    j = size.join(tops, "cluster_id").join(best, "cluster_id").join(F.broadcast(total))
    label = F.when(((F.col("size") > large) | (F.col("size") > F.col("total") * large_share)) & (F.col("dirs") > 1), F.col("many")).otherwise(F.concat_ws("/", F.substring_index("dir", "/", -1), F.col("name")))
    return j.select("cluster_id", "size", label.alias("label"))


def distances(edges: DataFrame, start: int, name: str = "depth") -> DataFrame:
    """id and the fewest steps from start, however many; start itself is 0."""
    one = edges.sparkSession.createDataFrame([(start,)], "id long")
    return reachable(edges, one, 1 << 62).unionByName(one.withColumn("depth", F.lit(0))).withColumnRenamed("depth", name)


def _shortest(adj: dict, path: tuple, target: int, without_edges: set, without_nodes: set, cost: float) -> tuple | None:
    """The least (hops, cost, text, path) to target that begins with path, whose cost is given."""
    heap, done = [(len(path) - 1, cost, ">".join(map(str, path)), path)], set()
    while heap:
        h, c, t, path = heapq.heappop(heap)
        v = path[-1]
        if v in done:
            continue
        done.add(v)
        if v == target:
            return h, c, t, path
        for w, x in adj.get(v, ()):
            if w not in done and w not in without_nodes and (v, w) not in without_edges:
                heapq.heappush(heap, (h + 1, c + x, f"{t}>{w}", (*path, w)))
    return None


def _yen(adj: dict, source: int, target: int, k: int) -> list[tuple]:
    """Up to k simple paths in order of hops, cost and text: Yen's spur paths."""
    first = _shortest(adj, (source,), target, set(), set(), 0.0)
    found, open_ = [first] if first else [], []
    while found and len(found) < k:
        path, cost = found[-1][3], 0.0
        for j in range(len(path) - 1):
            root = path[: j + 1]
            gone = {(p[j], p[j + 1]) for *_, p in found if p[: j + 1] == root and len(p) > j + 1}
            spur = _shortest(adj, root, target, gone, set(root[:-1]), cost)
            if spur and spur not in open_ and spur not in found:
                heapq.heappush(open_, spur)
            cost += dict(adj[path[j]])[path[j + 1]]
        if not open_:
            break
        found.append(heapq.heappop(open_))
    return found


def k_paths(edges: DataFrame, source: int, target: int, k: int = 3) -> DataFrame:
    """Up to k simple paths of the fewest hops, then of the least cost, then in order of their ids, of any length. edges may have kind.

    Searches from both ends give each edge the length of the shortest walk over it. Paths of up to so many hops lie in the edges of
    that length or less; among these, few to begin with, Yen's method finds them, until k of that length are found or all edges count."""
    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession, "paths")
    cost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_COST.items() for x in kv]), F.col("kind")), F.lit(1.0)) if "kind" in edges.columns else F.lit(1.0)
    e = edges.filter("src <> dst").groupBy("src", "dst").agg(F.min(cost).alias("cost"))
    there = distances(e, source, "gone").withColumnRenamed("id", "src")
    back = distances(reverse(e), target, "to_go").withColumnRenamed("id", "dst")
    e = scratch.save(e.join(there, "src").join(back, "dst").select("src", "dst", "cost", (F.col("gone") + 1 + F.col("to_go")).alias("walk")), "edges")
    shortest, longest = e.agg(F.min("walk"), F.max("walk")).first()
    found, reach = [], shortest
    while shortest is not None and source != target:
        some = e.filter(F.col("walk") <= reach).limit(LOCAL_EDGES + 1).collect()
        if len(some) > LOCAL_EDGES:
            raise ValueError(f"more than {LOCAL_EDGES} edges lie on paths of up to {reach} hops: ask for fewer paths")
        adj: dict = {}
        for r in some:
            adj.setdefault(r.src, []).append((r.dst, r.cost))
        found = _yen(adj, source, target, k)
        if reach >= longest or len(found) == k and found[-1][0] <= reach:
            break
        reach = shortest + 2 * max(1, reach - shortest)
    return spark.createDataFrame([(h, round(c, 6), t) for h, c, t, _ in found], "hops long, cost double, path string").orderBy("hops", "cost", "path")


def trace(paths: DataFrame, degree: DataFrame, hub: int = 50) -> DataFrame:
    """Paths with the coupling class that the shortest gives, their hubs, and a quality."""
    steps = paths.select("hops", "cost", "path", F.explode(F.split("path", ">")).alias("s")).withColumn("id", F.col("s").cast("long"))
    n = steps.join(degree.select("id", (F.col("in_degree") + F.col("out_degree")).alias("deg")), "id", "left").groupBy("hops", "cost", "path").agg(F.sum(F.when(F.col("deg") > hub, 1).otherwise(0)).alias("hubs"))
    n = n.join(F.broadcast(paths.agg(F.min("hops").alias("shortest"))))
    step = F.col("shortest")
    coupling = F.when(step == 1, "strong").when(step == 2, "moderate").when(step <= 4, "structural").otherwise("weak")
    weight = F.when(step == 1, 1.0).when(step == 2, 0.7).when(step <= 4, 0.4).otherwise(0.2)
    quality = F.greatest(F.lit(0.0), 0.7 * weight + 0.3 / F.greatest(F.col("hops"), F.lit(1)) - 0.1 * F.col("hubs"))
    return n.withColumn("coupling", coupling).withColumn("quality", round_half_up(quality, 3)).drop("shortest")


def annotate_paths(paths: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """paths: path, ids joined by >. path, step, id, name, kind, file_path, line; what is no symbol is named by its number."""
    steps = paths.select("path", F.posexplode(F.split("path", ">")).alias("step", "s")).withColumn("id", F.col("s").cast("long"))
    s = symbols.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id").select("id", "name", "kind", "file_path", F.col("line_start").alias("line"))
    unknown = F.lit("?")
    return steps.join(s, "id", "left").select("path", "step", "id", F.coalesce("name", F.concat(F.lit("#"), "s")).alias("name"), F.coalesce("kind", unknown).alias("kind"), F.coalesce("file_path", unknown).alias("file_path"), "line")


def file_graph(file_edges: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, kind, weight: edges between known files, by how many symbol edges they stand for."""
    ids = files.select("id")
    e = file_edges.join(ids.withColumnRenamed("id", "source_file_id"), "source_file_id", "left_semi").join(ids.withColumnRenamed("id", "target_file_id"), "target_file_id", "left_semi")
    return e.groupBy(F.col("source_file_id").alias("src"), F.col("target_file_id").alias("dst")).agg(F.min("kind").alias("kind"), F.sum("symbol_count").alias("weight"))


def blast_radius(edges: DataFrame, starts: DataFrame, symbols: DataFrame, most: int = 10) -> DataFrame:
    """How many symbols and files reach starts."""
    r = reachable(reverse(edges), starts, most)
    return r.join(symbols.select("id", "file_id"), "id").agg(F.count("*").alias("symbols"), F.count_distinct("file_id").alias("files"))
