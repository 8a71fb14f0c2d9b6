"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: With more edges than this, what a step joins is written first.
FEW = 2000


def components(scratch: Scratch, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component) for every node of the undirected `edges` (a, b); a component is named after its smallest node.

    Nodes hang on ever smaller neighbours until each component is a star, in
    a number of steps that grows as the log of its size. A step is two
    minimum aggregates, which combine before the shuffle, and joins with them.
    With more than FEW edges the aggregates are written first: then the joins
    are of plain exchanges, of which adaptive execution can split the partition
    of a node with very many edges. Tables stay in the shared folder.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, step = scratch.keep(e, f"{name}0"), 0
    many = e.count() > FEW
    written = lambda df, what: scratch.keep(df, f"{name}-{what}") if many else df
    while True:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = written(both.groupBy("x").agg(F.min("y").alias("m")).filter("m < x"), "least")  # other nodes leave their edges as they are
        large = e.select(F.col("v").alias("x"), F.col("u")).join(least, "x", "left").select("u", F.coalesce("m", "x").alias("v"))
        large = written(large.distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}{step + 1}")
        scratch.drop(f"{name}{step}", *([f"{name}-{what}" for what in ("least", "large", "low")] if many else []))
        e, step = after, step + 1
        inner = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        if inner.unionByName(e.groupBy("u").agg(F.count("*").alias("c")).filter("c > 1").select("u")).isEmpty():
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
