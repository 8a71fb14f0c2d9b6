"""Call trees as a depth-first walk prints them, without a walk.

A line of the tree is a path of keys, and lines are in the order of their
paths. A symbol is expanded where the walk first meets it: at its smallest
path. Which paths there are depends on where the symbols on them are expanded,
so rounds work out, from the expansions of the round before, every symbol's
smallest path, until none changes; there is one such state, and the walk's.
A round has a row for each call of the symbols met, however many paths lead
to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..storage import Store
from . import joins, lookup

#: What lines below one symbol are ordered by: calls, then calls by member, then members with calls of their own; the member's place; the other symbol's.
KEY = "struct<grp:int,member_line:int,member_name:string,member:string,child_line:int,child:string,file:string,line:int,id:string>"
CALL, BY_MEMBER, HOLDS = range(3)


def _key(**parts: Column) -> Column:
    types = dict(x.split(":") for x in KEY.removeprefix("struct<").removesuffix(">").split(","))
    return F.struct(*[parts.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def outbound_edges(c: Catalog) -> DataFrame:
    """(src, dst, key): resolved calls by their first line, then the symbol's members that call anything."""
    calls = joins._edges_with_sites(c).filter("callee_id is not null").groupBy(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).agg(F.min("call_line").alias("line"))
    calls = calls.select("src", "dst", _key(grp=F.lit(CALL), child_line=F.col("line"), id=F.col("dst")).alias("key"))
    busy = c.call_edges.select(F.col("caller_id").alias("id")).distinct()
    held = c.symbols.filter("parent_id is not null").join(busy, "id").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), "line")
    return calls.unionByName(held.select("src", "dst", _key(grp=F.lit(HOLDS), child_line=F.col("line"), id=F.col("dst")).alias("key")))


def inbound_edges(c: Catalog, id_: str, depth: int, store: Store) -> DataFrame:
    """(src, dst, key): from symbols to those who call them or a member of theirs, for all within `depth` steps of one; each step takes from the calls those that lead to it."""
    known = ahead = store.keep(c.spark.createDataFrame([(id_,)], "id string"), "in0")
    c, out = c.with_(call_sites=store.keep(c.call_sites.select("id", "callee_name"), "sites")), None  # all that a step asks of a site
    for step in range(1, depth + 1):
        found = store.keep(joins.nested_callers(c, lookup.symbols_by_ids(c, ahead), with_ids=True), f"callers{step}")
        out = found if out is None else out.unionByName(found)
        ahead = store.keep(found.select(F.col("caller_id").alias("id")).distinct().join(known, "id", "left_anti"), f"in{step}")
        if ahead.isEmpty():
            break
        known = known.unionByName(ahead)
    if out is None:
        return c.spark.createDataFrame([], f"src string, dst string, key {KEY}")
    # Members of one name form a group, which stands where the first of them does.
    place = out.filter("child is not null").groupBy("t", "child_name").agg(F.min(F.struct("child_line", "child")).alias("_m"))
    grouped = out.join(place, ["t", "child_name"], "left")
    key = _key(grp=F.when(F.col("child").isNull(), CALL).otherwise(BY_MEMBER), member_line=F.col("_m.child_line"), member_name=F.col("child_name"), member=F.col("_m.child"), child_line=F.col("child_line"), child=F.col("child"), file=F.col("caller_file"), line=F.col("caller_line"), id=F.col("caller_id"))
    return grouped.select(F.col("t").alias("src"), F.col("caller_id").alias("dst"), key.alias("key"), F.col("child_name").alias("_n")).groupBy("src", "dst", "_n").agg(F.min("key").alias("key")).drop("_n")


def lines(c: Catalog, id_: str, edges: DataFrame, depth: int, store: Store) -> DataFrame:
    """(path, level, id, parent, mark): the lines of the walk from a symbol, in the order of `path`.

    `mark` is `cycle` for a symbol that is being expanded, `revisit` for one met
    before, `member` for the heading of calls to a member, which takes no
    step but indents what is under it; else it is empty. A symbol that is first
    met at the last step counts as met.
    """
    spark = c.spark
    edges = store.keep(edges, "edges")
    root = spark.createDataFrame([(id_, [], [])], f"node string, path array<{KEY}>, above array<string>")

    def expanded(first: DataFrame) -> DataFrame:
        open_ = first.filter(F.size("path") < depth)
        return open_.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("key")).alias("path"), F.concat("above", F.array("node")).alias("above"))

    first, n, before = store.keep(root, "first0"), 0, None
    while True:
        n += 1
        smallest = expanded(first).filter(F.col("node") != id_).groupBy("node").agg(F.min(F.struct("path", "above")).alias("s")).select("node", "s.path", "s.above")
        first = store.keep(smallest.unionByName(root), f"first{n}")
        row = F.xxhash64("node", F.to_json("path"))
        state = tuple(first.agg(F.count("*"), F.bit_xor(row), F.sum(F.shiftright(row, 24))).first())
        store.drop(f"first{n - 1}")
        if state == before:
            break
        before = state
    here = first.select("node", F.col("path").alias("_first"))
    indent = F.size("path") + F.size(F.filter("path", lambda k: k["grp"] == BY_MEMBER))
    mark = F.when(F.col("path") == F.col("_first"), "").when(F.array_contains("above", F.col("node")), "cycle").otherwise("revisit")
    parent = F.element_at("above", -1)
    walked = expanded(first).join(here, "node").select("path", indent.alias("level"), F.col("node").alias("id"), parent.alias("parent"), mark.alias("mark"))
    heading = F.transform("path", lambda k, i: F.when(i == F.size("path") - 1, _key(grp=F.lit(BY_MEMBER), member_line=k["member_line"], member_name=k["member_name"], member=k["member"])).otherwise(k))
    members = expanded(first).filter(F.element_at("path", -1)["grp"] == BY_MEMBER).select(heading.alias("path"), (indent - 1).alias("level"), F.element_at("path", -1)["member"].alias("id"), parent.alias("parent"), F.lit("member").alias("mark")).distinct()
    top = root.select("path", F.lit(0).alias("level"), F.col("node").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("mark"))
    return top.unionByName(walked).unionByName(members)


def call_lines(c: Catalog, id_: str, direction: str = "out", depth: int = 3) -> DataFrame:
    """The lines of the tree of calls that a symbol makes, or with `in`, of those who call it."""
    store = Store(c.spark, "calltree")
    edges = outbound_edges(c) if direction == "out" else inbound_edges(c, id_, depth, store)
    return lines(c, id_, edges, depth, store)
