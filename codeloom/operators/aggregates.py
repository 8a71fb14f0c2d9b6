"""Counts, sums and metrics over the catalog's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..catalog import Catalog
from ..functions.paths import top_dir
from .lookup import among

_SUMS = ("tokens_saved", "source_tokens", "response_tokens")


def usage_totals(c: Catalog) -> DataFrame:
    return c.tool_usage.agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in _SUMS])


def usage_by_tool(c: Catalog) -> DataFrame:
    return c.tool_usage.groupBy("tool_name").agg(F.count("*").alias("calls"), *[F.sum(x).alias(x) for x in _SUMS]).orderBy(F.desc("tokens_saved"), "tool_name")


def estimated_tokens(c: Catalog, paths=None, all_when_empty: bool = False) -> DataFrame:
    """Sum of estimated tokens of the paths; of all files for None, or for no paths if so asked."""
    files = c.files
    if paths is not None and not (all_when_empty and not isinstance(paths, DataFrame) and not list(paths)):
        files = among(files, "path", paths)
    return files.agg(F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("tokens"))


def churn_by_path(history: DataFrame) -> DataFrame:
    return history.groupBy("path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum("commits").alias("commits"))


def symbols_per_file(c: Catalog) -> DataFrame:
    """(file_path, total, abstract, exported) counts."""
    return c.symbols.groupBy("file_path").agg(
        F.count("*").alias("total"), F.count_if(F.col("kind").isin(*schema.ABSTRACT_KINDS)).alias("abstract"), F.count_if("exported").alias("exported")
    )


def import_edges(c: Catalog, compat: bool = False) -> DataFrame:
    """Distinct (src, dst) files of imports without self loops; `compat` takes the module text for the target."""
    dst = F.col("sourceModule") if compat else F.col("resolvedPath")
    return c.imports.select(F.col("file_path").alias("src"), dst.alias("dst")).filter("dst is not null and src <> dst").distinct()


def fan_out_in(edges: DataFrame) -> DataFrame:
    """(node, ce, ca): distinct files that a file imports, and that import it."""
    out = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return out.groupBy("node").agg(F.sum("o").alias("ce"), F.sum("i").alias("ca"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends of (src, dst)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def coupling(c: Catalog, min_symbols: int = 1, file_pattern: str | None = None, compat: bool = False) -> DataFrame:
    """Ce, Ca, instability, abstractness and distance from the main sequence of each file with symbols."""
    files = symbols_per_file(c).filter(F.col("total") >= min_symbols)
    if file_pattern:
        files = files.filter(F.contains("file_path", F.lit(file_pattern)))
    known = import_edges(c, compat)
    fans = fan_out_in(known).withColumnRenamed("node", "file_path")
    out = files.join(fans, "file_path", "left").na.fill(0, ["ce", "ca"])
    both = F.col("ce") + F.col("ca")
    out = out.withColumn("instability", F.when(both > 0, F.col("ce") / both).otherwise(0.0)).withColumn("abstractness", F.when(F.col("total") > 0, F.col("abstract") / F.col("total")).otherwise(0.0))
    return out.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1)).select("file_path", "ce", "ca", "instability", "abstractness", "distance", "total")


def by_file(df: DataFrame, order: Column) -> DataFrame:
    """(file_path, n, rows): the rows of each file together, by `order`; files without rows have none."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("_o"), F.struct(*df.columns).alias("row")))), lambda x: x["row"])
    return df.groupBy("file_path").agg(F.count("*").alias("n"), listed.alias("rows"))


def files_by_dir(c: Catalog, depth: int = 1) -> DataFrame:
    return c.files.groupBy(top_dir("path", depth).alias("dir")).agg(F.count("*").alias("files"), F.sum("estimated_tokens").alias("tokens"))


def symbols_by_kind(c: Catalog, path: str) -> DataFrame:
    """(kind, names) of a file, names in source order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line", "id", "name"))), lambda x: x["name"])
    return c.symbols.filter(F.col("file_path") == path).groupBy("kind").agg(listed.alias("names"))


def last_indexed(c: Catalog, now_millis: int) -> DataFrame:
    return c.files.agg(F.max("indexed_at").alias("last_indexed"), F.floor((F.lit(now_millis) - F.max("indexed_at")) / 60000).alias("minutes_ago"))


def health_counts(c: Catalog) -> DataFrame:
    """(check, n): rows of the main tables, and of rows whose references are missing."""
    no_symbol = lambda t, col: t.join(c.symbols.select(F.col("id").alias(col)), col, "left_anti")
    counted = {
        "files": c.files, "symbols": c.symbols, "imports": c.imports, "call_sites": c.call_sites, "call_edges": c.call_edges,
        "orphan_call_sites": no_symbol(c.call_sites, "caller_id"),
        "orphan_call_edges": c.call_edges.join(c.call_sites.select(F.col("id").alias("call_site_id")), "call_site_id", "left_anti"),
        "unresolved_edges": c.call_edges.filter("resolution_source = 'unresolved'"),
        "symbols_without_file": c.symbols.join(c.files.select(F.col("path").alias("file_path")), "file_path", "left_anti"),
    }
    parts = [t.agg(F.lit(k).alias("check"), F.count("*").alias("n")).select("check", "n") for k, t in counted.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hotspot_scores(c: Catalog, history: DataFrame) -> DataFrame:
    """(path, added, removed, symbols, score): changed lines, weighed up by a file's symbols."""
    symbols = c.symbols.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("symbols"))
    out = churn_by_path(history).join(symbols, "path", "left").na.fill(0, ["symbols"])
    return out.select("path", "added", "removed", "symbols", ((F.col("added") + F.col("removed")) * (1 + F.col("symbols") / 10)).alias("score"))
