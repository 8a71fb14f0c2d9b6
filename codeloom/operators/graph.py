"""Recursive and iterative operators over edge tables (src, dst).

A loop keeps its frontier and what it has found in the shared folder, so that
plans stay short and a lost executor costs its own tasks. Each round is a join
on the node and an aggregate that combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..storage import Store

DAMPING, ITERATIONS, KEEP_EVERY = 0.85, 30, 6

def _side(df: DataFrame) -> DataFrame:
    """A side of a round's join, by a shuffle. Files are small for their rows, so that their size would have Spark send large tables through the driver, in every round."""
    return df.hint("shuffle_hash")


def call_graph(c: Catalog) -> DataFrame:
    """Resolved calls, with repeats."""
    return c.call_edges.filter("callee_id is not null").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth) of all nodes that the seeds (node) lead to, themselves at 0."""
    store = Store(edges.sparkSession, "reach")
    edges = store.keep(edges.select("src", "dst").distinct(), "edges")
    found = frontier = store.keep(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "0")
    step = 0
    while depth is None or step < depth:
        step += 1
        after = edges.join(_side(frontier.select(F.col("node").alias("src"))), "src", "left_semi").select(F.col("dst").alias("node"))
        met = after.withColumn("depth", F.lit(step)).unionByName(found).groupBy("node").agg(F.min("depth").alias("depth"))
        frontier = store.keep(met.filter(F.col("depth") == step), str(step))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if step % KEEP_EVERY == 0:
            found = store.keep(found, f"found{step}")
    return found


def containment(c: Catalog) -> DataFrame:
    """Edges from each symbol to those it holds."""
    return c.symbols.filter("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))


def subtree(c: Catalog, root: str) -> DataFrame:
    """A symbol and all below it in the containment tree, with their depth.

    A loop, not a recursive query: those stop at a million rows, and at any cycle.
    """
    found = reach(containment(c), c.symbols.filter(F.col("id") == root).select(F.col("id").alias("node")))
    return c.symbols.join(found.withColumnRenamed("node", "id"), "id").orderBy("line", "id")


def parent_class(c: Catalog) -> DataFrame:
    """(id, class_id): the nearest enclosing class of each symbol, itself if it is one; symbols outside of classes are left out."""
    store, step = Store(c.spark, "parent-class"), 0
    parents = c.symbols.select(F.col("id").alias("at"), "kind", "parent_id")
    found, seen, open_ = None, None, store.keep(c.symbols.select("id", F.col("id").alias("at")), "0")
    while True:
        step += 1
        here = open_.join(parents, "at")
        done = here.filter("kind = 'class'").select("id", F.col("at").alias("class_id"))
        found = done if found is None else found.unionByName(done)
        seen = open_ if seen is None else seen.unionByName(open_)
        after = here.filter("kind <> 'class' and parent_id is not null").select("id", F.col("parent_id").alias("at"))
        open_ = store.keep(after.join(seen, ["id", "at"], "left_anti"), str(step))  # a cycle leads to what was seen
        if open_.isEmpty():
            return found
        if step % KEEP_EVERY == 0:
            found, seen = store.keep(found, f"found{step}"), store.keep(seen, f"seen{step}")


def reachable_symbols(c: Catalog, name: str) -> DataFrame:
    """(id) of what the symbols of a name, and their parents, call directly or not; and, unexpanded, of what lies below these symbols."""
    start = c.symbols.filter(F.col("name") == name)
    seeds = start.select(F.explode(F.array("id", "parent_id")).alias("node")).filter("node is not null")
    below = reach(containment(c), start.select(F.col("id").alias("node"))).select(F.col("node").alias("id"))
    return reach(call_graph(c), seeds).select(F.col("node").alias("id")).unionByName(below).distinct()


def blast_radius(c: Catalog, seeds: DataFrame) -> DataFrame:
    """(node, depth) of all direct and indirect callers of the seed symbols (node); a call of a child counts as one of its parent."""
    edges = c.call_edges.filter("callee_id is not null").select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst"))
    up = edges.join(c.symbols.select(F.col("id").alias("src"), "parent_id"), "src").filter("parent_id is not null").select(F.col("parent_id").alias("src"), "dst")
    return reach(edges.unionByName(up), seeds)


def pagerank(edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(node, rank) after a fixed number of steps. Repeated edges weigh more; what dangling nodes hold is not passed on."""
    store = Store(edges.sparkSession, "pagerank")
    counted = store.keep(edges.groupBy("src", "dst").agg(F.count("*").alias("n")), "counted")
    degree = counted.groupBy("src").agg(F.sum("n").alias("d"))
    shares = store.keep(counted.join(degree, "src").select("src", "dst", (F.col("n") / F.col("d")).alias("share")), "shares")
    nodes = store.keep(counted.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    base, start = (1 - damping) / n, 1.0 / n
    ranks = nodes.withColumn("rank", F.lit(start))
    for step in range(1, iterations + 1):
        if step == 1:
            passed = shares.select(F.col("dst").alias("node"), (F.lit(start) * F.col("share")).alias("v"))
        else:
            # Nodes that nothing is passed to have no row between the steps: their rank stays the same. The filter is the same in all steps, so that shares are shuffled once for several.
            sent = shares if step == iterations else shares.filter("dst is not null")
            met = sent.join(_side(ranks), sent["src"] == ranks["node"], "left")
            passed = met.select(F.col("dst").alias("node"), (F.coalesce("rank", F.lit(base)) * F.col("share")).alias("v"))
        if step == iterations:
            passed = passed.unionByName(nodes.withColumn("v", F.lit(0.0)))
        ranks = passed.groupBy("node").agg((F.lit(base) + damping * F.sum("v")).alias("rank"))
        if step % KEEP_EVERY == 0 or step == iterations:
            ranks = store.keep(ranks, f"r{step}")
    return ranks


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(scc, node) of the strongly connected components of more than one node; a component is named after its smallest node.

    Nodes without a way in or out are trimmed. Each node then takes the smallest
    node that leads to it as colour; what a colour's own node is reached from
    within the colour is its component, which leaves the graph; and so on.
    """
    store = Store(edges.sparkSession, "scc")
    edges = store.keep(edges.filter("src <> dst").select("src", "dst").distinct(), "e")
    out, turn = None, 0
    while True:
        turn += 1
        edges, left = _trim(store, edges, f"t{turn}")
        if not left:
            break
        colour = _colour(store, edges, f"c{turn}")
        same = edges.join(_side(colour.select(F.col("node").alias("src"), F.col("colour").alias("a"))), "src").join(_side(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b"))), "dst").filter("a = b")
        back = reach(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.filter("node = colour").select("node")).select("node")
        found = store.keep(colour.join(_side(back), "node", "left_semi").select(F.col("colour").alias("scc"), "node"), f"f{turn}")
        out = found if out is None else out.unionByName(found)
        gone = found.select("node")
        rest = edges.join(_side(gone.withColumnRenamed("node", "src")), "src", "left_anti").join(_side(gone.withColumnRenamed("node", "dst")), "dst", "left_anti")
        edges = store.keep(rest.select("src", "dst"), f"e{turn}")
    if out is None:
        return edges.select(F.col("src").alias("scc"), F.col("dst").alias("node")).limit(0)
    return out.withColumn("_n", F.count("*").over(Window.partitionBy("scc"))).filter("_n > 1").select("scc", "node")


def _trim(store: Store, edges: DataFrame, name: str) -> tuple[DataFrame, int]:
    before, step = edges.count(), 0
    while before:
        kept = edges.join(_side(edges.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(_side(edges.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi")
        edges = store.keep(kept.select("src", "dst"), f"{name}-{step}")
        after, step = edges.count(), step + 1
        if after == before:
            break
        before = after
    return edges, before


def _colour(store: Store, edges: DataFrame, name: str) -> DataFrame:
    colour = store.keep(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")), f"{name}-0")
    step = 0
    while True:
        step += 1
        sent = edges.join(_side(colour.withColumnRenamed("node", "src")), "src").select(F.col("dst").alias("node"), F.col("colour").alias("sent"))
        best = sent.groupBy("node").agg(F.min("sent").alias("sent"))
        moved = colour.join(_side(best), "node", "left").select("node", F.least("colour", F.coalesce("sent", "colour")).alias("colour"), (F.col("sent") < F.col("colour")).alias("moved"))
        moved = store.keep(moved, f"{name}-{step}")
        colour = moved.select("node", "colour")
        if moved.filter("moved").isEmpty():
            return colour


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, layer): 0 for nodes without targets, else one more than the largest layer they lead to.

    Nodes of a cycle share the layer of the whole cycle.
    """
    store = Store(nodes.sparkSession, "layers")
    members = store.keep(cyclic_components(edges), "members")
    name = store.keep(nodes.select("node").distinct().join(_side(members), "node", "left").select("node", F.coalesce("scc", "node").alias("group")), "groups")
    ends = edges.join(_side(name.select(F.col("node").alias("src"), F.col("group").alias("a"))), "src").join(_side(name.select(F.col("node").alias("dst"), F.col("group").alias("b"))), "dst")
    dag = store.keep(ends.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "dag")
    layer = store.keep(name.select("group").distinct().withColumn("layer", F.lit(0)), "l0")
    step = 0
    while True:
        step += 1
        raised = dag.join(_side(layer.select(F.col("group").alias("dst"), "layer")), "dst").groupBy("src").agg((F.max("layer") + 1).alias("up"))
        after = layer.join(_side(raised), layer["group"] == raised["src"], "left").select("group", F.greatest("layer", F.coalesce("up", "layer")).alias("layer"), (F.col("up") > F.col("layer")).alias("moved"))
        after = store.keep(after, f"l{step}")
        layer = after.select("group", "layer")
        if after.filter("moved").isEmpty():
            return name.join(_side(layer), "group").select("node", "layer")


def ancestors(c: Catalog, id_: str) -> DataFrame:
    """A symbol's chain of parents, nearest first."""
    up = c.symbols.filter("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    found = reach(up, c.symbols.filter(F.col("id") == id_).select(F.col("id").alias("node"))).filter("depth > 0")
    return c.symbols.join(found.withColumnRenamed("node", "id"), "id").select("id", "name", "kind", "file_path", "line", "depth").orderBy("depth")
