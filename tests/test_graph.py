"""Graph operators on hand-computed graphs, and against plain versions on random ones."""

import random

import pytest
from graphs import G, calls, catalog
from pyspark.sql import functions as F

from codeloom.catalog import Catalog
from codeloom.operators import calltree, graph
from codeloom.plans import modes
from codeloom.storage import Store


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(df):
    return {r.node for r in df.collect()}


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_reach_and_depth(spark):
    got = {r.node: r.depth for r in graph.reach(frame(spark, G), seeds(spark, "d")).collect()}
    assert got == {"d": 0, "c": 1, "e": 1, "a": 2, "b": 3}
    assert nodes(graph.reach(frame(spark, G), seeds(spark, "d"), depth=1)) == {"c", "d", "e"}
    assert nodes(graph.reach(frame(spark, [(b, a) for a, b in G]), seeds(spark, "c"))) == {"a", "b", "c", "d"}


def test_pagerank(spark):
    got = {r.node: round(r.rank, 9) for r in graph.pagerank(frame(spark, G)).collect()}
    assert got == {"a": 0.265347603, "b": 0.142772771, "c": 0.276879626, "d": 0.03, "e": 0.04275}
    assert graph.pagerank(frame(spark, []).limit(0)).count() == 0


def test_components_partition(spark):
    assert {(r.scc, r.node) for r in graph.cyclic_components(frame(spark, G)).collect()} == {("a", "a"), ("a", "b"), ("a", "c")}
    rng = random.Random(6)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)]
    ahead = {a: {y for x, y in pairs if x == a} for a, _ in pairs}

    def closure(x):
        seen, todo = set(), [x]
        while todo:
            for y in ahead.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    far = {x: closure(x) for p in pairs for x in p}
    want = {x: min(y for y in far if y in far[x] and x in far[y]) for x in far if any(y != x and y in far[x] and x in far[y] for y in far)}
    assert {r.node: r.scc for r in graph.cyclic_components(frame(spark, pairs)).collect()} == want


def test_layers(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("x", "c")]
    got = {r.node: r.layer for r in graph.layers(frame(spark, pairs), seeds(spark, *"abcxyz")).collect()}
    assert got == {"a": 2, "b": 1, "c": 0, "x": 1, "y": 1, "z": 0}


def test_tree_walk_marks(spark):
    c = calls(spark, G)
    assert modes.trace_tree(c, "d", "out", 3) == [(0, "d", ""), (1, "c", ""), (2, "a", ""), (3, "b", ""), (3, "c", "cycle"), (1, "e", "")]
    assert [x[1] for x in modes.trace_tree(c, "c", "in", 1)] == ["c", "a", "b", "d"]


def test_inbound_tree_groups_callers_by_member(spark):
    named = [{"id": x, "name": x, "line": n} for n, x in enumerate("Kxyz")] + [{"id": m, "name": m, "line": 10 + n, "parent_id": "K"} for n, m in enumerate(("m", "n"))]
    c = calls(spark, [("x", "K"), ("y", "m"), ("x", "m"), ("y", "n"), ("z", "x"), ("K", "z")], named)
    assert modes.trace_tree(c, "K", "in", 3) == [
        (0, "K", ""), (1, "x", ""), (2, "z", ""), (3, "K", "cycle"),
        (1, "m", "member"), (2, "x", "revisit"), (2, "y", ""), (1, "n", "member"), (2, "y", "revisit"),
    ]
    assert modes.trace_tree(c, "K", "in", 0) == [(0, "K", "")] and modes.trace_tree(c, "none", "in", 2) == [(0, "none", "")]


def test_containment(spark):
    c = catalog(spark, symbols=[{"id": "m", "name": "<module>", "kind": "module"}, {"id": "k", "name": "K", "kind": "class", "parent_id": "m"}, {"id": "f", "name": "f", "kind": "method", "parent_id": "k"}, {"id": "g", "name": "g", "parent_id": "f"}])
    assert [(r.id, r.depth) for r in graph.subtree(c, "k").orderBy("depth").collect()] == [("k", 0), ("f", 1), ("g", 2)]
    assert {r.id: r.class_id for r in graph.parent_class(c).collect()} == {"k": "k", "f": "k", "g": "k"}
    assert [r.id for r in graph.ancestors(c, "g").collect()] == ["f", "k", "m"]


def test_blast_radius_counts_children(spark):
    symbols = [{"id": x, "name": x} for x in "abcde"] + [{"id": "k", "name": "K", "kind": "class"}, {"id": "f", "name": "f", "kind": "method", "parent_id": "k"}]
    c = calls(spark, [*G, ("e", "f")], symbols)
    assert {r.id for r in modes.blast_radius(c, "K").collect()} == {"e", "d"}
    assert {r.id for r in modes.blast_radius(c, "k", by_name=True).collect()} == {"e", "d"}
    assert {r.id for r in graph.reachable_symbols(c, "d").collect()} == {"d", "c", "e", "a", "b", "f"}


@pytest.mark.parametrize("direction", ["in", "out"])
def test_trace_is_bounded(spark, direction):
    assert modes.trace(calls(spark, G), ["a"], direction, 1).count() == (1 if direction == "in" else 2)


def test_trees_of_any_depth(spark):
    symbols = [{"id": "s0", "kind": "class"}] + [{"id": f"s{i}", "parent_id": f"s{i - 1}"} for i in range(1, 67)]
    symbols += [{"id": "x", "parent_id": "y"}, {"id": "y", "parent_id": "x"}]
    c = catalog(spark, symbols=[{"name": s["id"], **s} for s in symbols])
    assert [r.id for r in graph.ancestors(c, "s66").collect()] == [f"s{i}" for i in range(65, -1, -1)]
    assert [r.id for r in graph.ancestors(c, "x").collect()] == ["y"]
    deep = c.with_(symbols=c.symbols.filter("id in ('x', 'y') or cast(substring(id, 2) as int) <= 33"))
    assert {r.id: r.class_id for r in graph.parent_class(deep).collect()} == {f"s{i}": "s0" for i in range(34)}


def _walked(edges, root, depth):
    """Lines (level, id, mark) of a walk over (src, dst, key) edges."""
    out, met = [], set()

    def walk(node, level, path):
        mark = "cycle" if node in path else "revisit" if node in met else ""
        out.append((level, node, mark))
        if not mark:
            met.add(node)
            for _, b in sorted((k, b) for a, b, k in edges if a == node) if level < depth else ():
                walk(b, level + 1, (*path, node))

    walk(root, 0, ())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lines_are_those_of_a_walk(spark, seed):
    """Random graphs with rings, where limits of depth hide what another order would show."""
    rng = random.Random(seed)
    n = 14
    edges = {(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}"): rng.randrange(5) for _ in range(40)}
    edges = [(a, b, k) for (a, b), k in edges.items()]
    frame = spark.createDataFrame(edges, "src string, dst string, k int")
    keyed = frame.select("src", "dst", calltree._key(grp=F.lit(0), child_line=F.col("k"), id=F.col("dst")).alias("key"))
    for depth in (1, 3, 5):
        got = calltree.lines(Catalog.empty(spark), "n00", keyed, depth, Store(spark, "t")).orderBy("path").collect()
        assert [(r.level, r.id, r.mark) for r in got] == _walked([(a, b, (k, b)) for a, b, k in edges], "n00", depth)


def test_a_hub_is_paged(spark):
    """100 000 callers: a page of them reaches the driver."""
    edges = spark.range(100_000).select(F.lit("hub").alias("src"), F.format_string("c%06d", "id").alias("dst")).withColumn("key", calltree._key(grp=F.lit(0), id=F.col("dst")))
    found = calltree.lines(Catalog.empty(spark), "hub", edges, 2, Store(spark, "t"))
    assert found.count() == 100_001
    assert [r.id for r in found.orderBy("path").offset(2).limit(2).collect()] == ["c000001", "c000002"]
