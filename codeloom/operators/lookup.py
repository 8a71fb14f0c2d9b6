"""Filters and point lookups over the catalog's tables.

Lists of keys become semi joins with a one-column frame, so that their length
does not matter to the plan; limits always come with a total order. Text
patterns are case-insensitive, with `*` for any run of characters.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..catalog import Catalog

#: Keys given as a Python list that are written into the plan; more become a joined frame.
INLINE_KEYS = 64


def like_pattern(text: str) -> str:
    """`*` as `%`, runs of `%` as one."""
    out = text.replace("*", "%")
    while "%%" in out:
        out = out.replace("%%", "%")
    return out


def contains(column: str, text: str) -> Column:
    return F.col(column).ilike(like_pattern(f"%{text}%"))


def among(df: DataFrame, column: str, keys: Iterable | DataFrame) -> DataFrame:
    """Rows of `df` whose column is one of the keys (a list, or a frame whose first column has them)."""
    if isinstance(keys, DataFrame):
        name = keys.columns[0]
        return df.join(keys.select(F.col(name).alias("_key")), F.col(column) == F.col("_key"), "left_semi")
    keys = list(keys)
    if len(keys) <= INLINE_KEYS:
        return df.filter(F.col(column).isin(keys)) if keys else df.limit(0)
    return among(df, column, df.sparkSession.createDataFrame([(k,) for k in keys], df.select(column).schema))


# Files ---------------------------------------------------------------------


def search_files(c: Catalog, query: str = "", language: str | None = None, limit: int = 20, pattern: str | None = None) -> DataFrame:
    out = c.files.filter(contains("path", query))
    if language:
        out = out.filter(F.col("language") == language)
    if pattern:
        out = out.filter(contains("path", pattern))
    return out.orderBy("path").limit(limit)


def file_by_path(c: Catalog, path: str) -> DataFrame:
    return c.files.filter(F.col("path") == path)


def files_like(c: Catalog, part: str) -> DataFrame:
    return c.files.filter(contains("path", part)).orderBy("path")


def file_hash(c: Catalog, path: str) -> DataFrame:
    return file_by_path(c, path).select("hash")


def resolve_file(c: Catalog, part: str) -> str:
    """The one file whose path holds `part`; an error tells of none, or lists several."""
    found = [r.path for r in files_like(c, part).select("path").limit(11).collect()]
    if not found:
        raise LookupError(f"no file matches {part!r}")
    exact = [p for p in found if p == part]
    if len(found) > 1 and not exact:
        raise LookupError(f"{part!r} matches several files: {', '.join(found[:10])}")
    return exact[0] if exact else found[0]


# Symbols -------------------------------------------------------------------


def search_symbols(c: Catalog, query: str, kinds: Iterable[str] | None = None, file_pattern: str | None = None, language: str | None = None, limit: int = 20) -> DataFrame:
    """Symbols by name: anchored unless the query has `*`."""
    out = c.symbols.filter(F.col("name").ilike(like_pattern(query)))
    if kinds:
        out = among(out, "kind", kinds)
    if file_pattern:
        out = out.filter(contains("file_path", file_pattern))
    if language:
        out = out.filter(F.col("language") == language)
    return out.orderBy("file_path", "line", "id").limit(limit)


def all_symbols(c: Catalog) -> DataFrame:
    return c.symbols.orderBy("file_path", "line", "id")


def symbols_by_ids(c: Catalog, ids) -> DataFrame:
    return among(c.symbols, "id", ids)


def symbols_by_names(c: Catalog, names) -> DataFrame:
    return among(c.symbols, "name", names)


def definition(c: Catalog, id_: str) -> DataFrame:
    return c.symbols.filter(F.col("id") == id_)


def definition_by_name(c: Catalog, name: str, path: str) -> DataFrame:
    return c.symbols.filter((F.col("name") == name) & (F.col("file_path") == path)).orderBy("line", "column", "id").limit(1)


def symbols_of_files(c: Catalog, paths) -> DataFrame:
    return among(c.symbols, "file_path", paths).orderBy("file_path", "line", "id")


def at_location(c: Catalog, path: str, line: int, column: int, kinds: Iterable[str] | None = None) -> DataFrame:
    out = c.symbols.filter((F.col("file_path") == path) & (F.col("line") == line) & (F.col("column") == column))
    return among(out, "kind", kinds) if kinds else out


def without_docstring(c: Catalog, kinds: Iterable[str], path: str | None = None) -> DataFrame:
    blank = F.col("docstring").isNull() | (F.col("docstring") == "")
    out = among(c.symbols, "kind", kinds).filter((F.col("name") != schema.MODULE) & blank)
    return out.filter(F.col("file_path") == path) if path else out


def with_docstring(c: Catalog, kinds: Iterable[str]) -> DataFrame:
    return among(c.symbols, "kind", kinds).filter(F.col("docstring").isNotNull() & (F.col("docstring") != ""))


def children(c: Catalog, parent_id: str) -> DataFrame:
    return c.symbols.filter(F.col("parent_id") == parent_id).orderBy("line", "id")


def callables_without_types(c: Catalog, language: str, paths=None) -> DataFrame:
    out = among(c.symbols, "kind", schema.CALLABLE_KINDS).filter((F.col("language") == language) & F.col("parameters_json").isNull())
    return among(out, "file_path", paths) if paths is not None else out


def classes_without_bases(c: Catalog, language: str, paths=None) -> DataFrame:
    out = c.symbols.filter((F.col("language") == language) & (F.col("kind") == "class") & F.col("inheritence").isNull())
    return among(out, "file_path", paths) if paths is not None else out


def resolve_symbol(c: Catalog, symbol_id: str | None = None, name: str | None = None, file: str | None = None):
    """The one symbol with an id, or with a name in a file; else an error."""
    if symbol_id:
        row = definition(c, symbol_id).first()
    elif name and file:
        row = definition_by_name(c, name, resolve_file(c, file)).first()
    else:
        raise ValueError("give a symbol id, or a name and a file")
    if row is None:
        raise LookupError(f"no symbol {symbol_id or name}")
    return row


# Imports -------------------------------------------------------------------


def importers(c: Catalog, module: str) -> DataFrame:
    """Imports of a module, given with or without its last extension."""
    last = module.rsplit("/", 1)[-1]
    bare = module[: len(module) - len(last)] + last.rsplit(".", 1)[0] if "." in last.lstrip(".") else module
    return c.imports.filter(contains("sourceModule", module) | contains("sourceModule", bare))


def import_by_id(c: Catalog, id_: str) -> DataFrame:
    return c.imports.filter(F.col("id") == id_)


def imports_by_name(c: Catalog, name: str, path: str | None = None, compat: bool = False) -> DataFrame:
    """Imports of a name; `compat` matches it as a part of the list's JSON text, so `add` finds `address` too."""
    match = F.to_json("importedNames").ilike(f"%{name}%") if compat else F.array_contains("importedNames", name)
    out = c.imports.filter(match)
    return out.filter(F.col("file_path") == path).orderBy("resolvedPath", "id") if path else out


def imports_of_files(c: Catalog, paths) -> DataFrame:
    return among(c.imports, "file_path", paths).orderBy("file_path", "resolvedPath", "id")


def imports_like(c: Catalog, part: str, limit: int = 100) -> DataFrame:
    return c.imports.filter(F.col("file_path").ilike(f"%{part}%")).orderBy("file_path", "resolvedPath", "id").limit(limit)


def import_between(c: Catalog, path: str, resolved: str) -> DataFrame:
    return c.imports.filter((F.col("file_path") == path) & (F.col("resolvedPath") == resolved))


# Calls ---------------------------------------------------------------------


def sites_of_callers(c: Catalog, ids) -> DataFrame:
    return among(c.call_sites, "caller_id", ids)


def edges_of_callers(c: Catalog, ids) -> DataFrame:
    return among(c.call_edges, "caller_id", ids)


def edges_of_callees(c: Catalog, ids) -> DataFrame:
    return among(c.call_edges, "callee_id", ids)


def callee_pairs(c: Catalog) -> DataFrame:
    """(callee, caller) of every resolved call, with repeats."""
    return c.call_edges.filter(F.col("callee_id").isNotNull()).select(F.col("callee_id").alias("callee"), F.col("caller_id").alias("caller"))
