"""Changes of a catalog: upserts, deletes with their cascades, and point updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from .lookup import among


def replace_by(old: DataFrame, new: DataFrame, *keys: str, keys_of: DataFrame | None = None) -> DataFrame:
    """`old` without the rows whose keys are in `new` (or in `keys_of`), and `new`."""
    gone = (keys_of if keys_of is not None else new).select(*keys).distinct()
    return old.join(gone, list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_files(c: Catalog, new: DataFrame, now_millis: int) -> Catalog:
    return c.with_(files=replace_by(c.files, new.withColumn("indexed_at", F.lit(now_millis).cast("long")), "path"))


def diff_symbols(old: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, change): what an upsert of the paths' symbols adds and removes; symbols that stay are never updated."""
    inside = among(old, "file_path", paths)
    added = new.join(old.select("id"), "id", "left_anti").select("id", F.lit("insert").alias("change"))
    return added.unionByName(inside.join(new.select("id"), "id", "left_anti").select("id", F.lit("delete").alias("change")))


def upsert_symbols(c: Catalog, new: DataFrame, paths: DataFrame) -> Catalog:
    """Replaces the symbols of `paths` (path) by id: missing ones go, with their vectors and what hangs on them; known ones stay as they are."""
    change = diff_symbols(c.symbols, new, paths)
    gone, added = (change.filter(F.col("change") == x).select("id") for x in ("delete", "insert"))
    kept = _without_symbols(c, gone)
    return kept.with_(symbols=kept.symbols.unionByName(new.join(added, "id", "left_semi").select(*c.symbols.columns)))


def _without_symbols(c: Catalog, gone: DataFrame) -> Catalog:
    """Without the symbols (id): their sites, edges, exceptions, reads and vectors go; edges that lead to them stay, without a callee."""
    out = lambda t, col: t.join(gone.select(F.col("id").alias(col)), col, "left_anti").select(*t.columns)
    edges = out(c.call_edges, "caller_id").join(gone.select(F.col("id").alias("callee_id"), F.lit(True).alias("lost")), "callee_id", "left")
    edges = edges.withColumn("callee_id", F.when(F.col("lost").isNull(), F.col("callee_id"))).select(*c.call_edges.columns)
    return c.with_(
        symbols=out(c.symbols, "id"), call_sites=out(c.call_sites, "caller_id"), call_edges=edges, exceptions=out(c.exceptions, "symbol_id"),
        env_vars=out(c.env_vars, "symbol_id"), vec_symbols=out(c.vec_symbols, "symbol_id"),
    )


def delete_files(c: Catalog, paths: DataFrame) -> Catalog:
    """Without the files (path) and all that refers to them; edges that used their imports stay, without one."""
    gone = among(c.symbols, "file_path", paths).select("id")
    lost = among(c.imports, "file_path", paths).select(F.col("id").alias("imports_id"), F.lit(True).alias("lost"))
    c = _without_symbols(c, gone)
    out = lambda t, col: t.join(paths.select(F.col("path").alias(col)), col, "left_anti").select(*t.columns)
    sites = out(c.call_sites, "caller_file_path")
    edges = c.call_edges.join(sites.select(F.col("id").alias("call_site_id")), "call_site_id", "left_semi").join(lost, "imports_id", "left")
    edges = edges.withColumn("imports_id", F.when(F.col("lost").isNull(), F.col("imports_id"))).select(*c.call_edges.columns)
    return c.with_(
        files=out(c.files, "path"), imports=out(c.imports, "file_path"), call_sites=sites, call_edges=edges, exceptions=out(c.exceptions, "file_path"), env_vars=out(c.env_vars, "file_path"),
    )


def replace_for_files(old: DataFrame, new: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    """Rows of `paths` (path) replaced by those of `new`, also where it has none."""
    return replace_by(old, new, column, keys_of=paths.select(F.col("path").alias(column)))


def last_edges(edges: DataFrame, order: str) -> DataFrame:
    """The last edge of each call site and caller, by `order`."""
    latest = Window.partitionBy("call_site_id", "caller_id").orderBy(F.desc(order), F.desc("id"))
    return edges.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def upsert_edges(c: Catalog, new: DataFrame) -> Catalog:
    return c.with_(call_edges=replace_by(c.call_edges, new, "call_site_id", "caller_id"))


def upsert_vectors(c: Catalog, new: DataFrame) -> Catalog:
    return c.with_(vec_symbols=replace_by(c.vec_symbols, new, "symbol_id"))


def delete_vectors(c: Catalog, ids: DataFrame) -> Catalog:
    return c.with_(vec_symbols=c.vec_symbols.join(ids.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti").select(*c.vec_symbols.columns))


def delete_vectors_of_files(c: Catalog, paths: DataFrame) -> Catalog:
    return delete_vectors(c, among(c.symbols, "file_path", paths).select("id"))


def update_symbols(c: Catalog, changes: DataFrame) -> Catalog:
    """Sets the columns that `changes` (id, columns) has, also to null."""
    columns = [x for x in changes.columns if x != "id"]
    marked = changes.select("id", F.lit(True).alias("_set"), *[F.col(x).alias(f"_{x}") for x in columns])
    joined = c.symbols.join(marked, "id", "left")
    picked = [F.when(F.col("_set"), F.col(f"_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in c.symbols.columns]
    return c.with_(symbols=joined.select(*picked))


def without_docstrings(c: Catalog, kinds) -> Catalog:
    return c.with_(symbols=c.symbols.withColumn("docstring", F.when(~F.col("kind").isin(list(kinds)), F.col("docstring"))))


def merged_inheritance(old, new):
    """The lists of bases joined, one for each name: where it first stood, as it was last given."""
    both = F.concat(F.coalesce(old, new), F.when(old.isNotNull(), new).otherwise(F.slice(new, 1, 0)))
    names = F.array_distinct(F.transform(both, lambda x: x["inherits_from_name"]))
    return F.transform(names, lambda n: F.element_at(F.filter(both, lambda x: x["inherits_from_name"] == n), -1))


def update_inheritance(c: Catalog, added: DataFrame) -> Catalog:
    """Adds bases (id, bases) to symbols."""
    joined = c.symbols.join(added.select("id", "bases"), "id", "left")
    merged = F.when(F.col("bases").isNull(), F.col("inheritence")).otherwise(merged_inheritance(F.col("inheritence"), F.col("bases")))
    return c.with_(symbols=joined.withColumn("inheritence", merged).select(*c.symbols.columns))


def usage_row(c: Catalog, tool: str, paths: list[str], response_chars: int, now_millis: int) -> DataFrame:
    """The usage row of an answer: tokens of its source files (their paths, if none is known), of the answer, and the difference saved."""
    source = among(c.files, "path", paths).agg(F.coalesce(F.sum("estimated_tokens"), F.lit(sum(map(len, paths)))).alias("source_tokens"))
    response = -(-response_chars // 4)
    return source.select(
        F.sha2(F.concat_ws("|", F.lit(tool), F.lit(now_millis)), 256).alias("id"), F.lit(tool).alias("tool_name"), F.lit(now_millis).cast("long").alias("called_at"),
        F.greatest(F.lit(0).cast("long"), F.col("source_tokens") - response).alias("tokens_saved"), "source_tokens", F.lit(response).cast("long").alias("response_tokens"),
    )


def record_usage(c: Catalog, row: DataFrame) -> Catalog:
    return c.with_(tool_usage=c.tool_usage.unionByName(row))
