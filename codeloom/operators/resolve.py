"""Resolution of imports to files, and of call sites to symbols, imports and builtins.

Candidates of every kind are found at once by equi joins, each with its
priority; the best one of a call site wins. A stage is a function from the
sites and the catalog to candidates, so stages can be added or left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..catalog import Catalog
from ..functions.scalars import confidence, local_names
from ..storage import Store, counted
from . import prefixes

# Names that a language brings along, by kind of call.
TYPESCRIPT_CALLS = (
    "parseInt", "parseFloat", "isNaN", "isFinite",
    "setTimeout", "clearTimeout", "setInterval", "clearInterval", "queueMicrotask", "requestAnimationFrame", "cancelAnimationFrame",
    "fetch", "alert", "confirm", "prompt",
    "encodeURI", "decodeURI", "encodeURIComponent", "decodeURIComponent",
    "Date", "Error", "TypeError", "ReferenceError", "SyntaxError", "RangeError", "URIError", "EvalError",
    "require",
)
TYPESCRIPT_OBJECTS = (
    "Array", "Object", "String", "Number", "Boolean", "BigInt", "Symbol", "Math", "JSON", "Date", "RegExp", "Promise", "Reflect", "Proxy", "Intl",
    "Map", "Set", "WeakMap", "WeakSet",
    "Error", "TypeError", "ReferenceError", "SyntaxError", "RangeError", "URIError", "AggregateError",
    "console", "process", "Buffer", "URL", "URLSearchParams", "TextEncoder", "TextDecoder", "AbortController", "AbortSignal", "Blob", "File", "FormData",
    "Headers", "Request", "Response",
    "Bun",
)
PYTHON_CALLS = (
    "print", "input", "open", "breakpoint",
    "type", "isinstance", "issubclass", "callable", "hasattr", "getattr", "setattr", "delattr", "id", "hash", "dir", "vars", "globals", "locals",
    "str", "int", "float", "bool", "bytes", "bytearray", "memoryview", "complex", "object",
    "list", "dict", "set", "frozenset", "tuple", "range", "slice", "iter", "next", "enumerate", "zip", "map", "filter", "reversed", "sorted",
    "len", "sum", "min", "max", "abs", "round", "pow", "divmod", "all", "any",
    "repr", "ascii", "format", "chr", "ord", "bin", "hex", "oct",
    "eval", "exec", "compile", "__import__",
    "property", "staticmethod", "classmethod", "super",
    "Exception", "BaseException", "ValueError", "TypeError", "RuntimeError", "KeyError", "IndexError", "AttributeError", "ImportError",
    "ModuleNotFoundError", "NotImplementedError", "StopIteration",
)
BUILTINS = {
    ("typescript", "function_call"): TYPESCRIPT_CALLS,
    ("typescript", "method_call"): TYPESCRIPT_OBJECTS,
    ("typescript", "constructor_call"): TYPESCRIPT_OBJECTS,
    ("python", "function_call"): PYTHON_CALLS,
}
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts", "/index.ts", "/index.tsx", "/index.js", ".py", "/__init__.py", "")
CANDIDATE = "call_site_id string, caller_id string, target_kind string, callee_id string, imports_id string, resolution_source string, priority int"


def builtins(c: Catalog) -> DataFrame:
    """(language_name, call_kind, word): a fixed, small table."""
    rows = [(language, kind, name) for (language, kind), names in BUILTINS.items() for name in names]
    return c.spark.createDataFrame(rows, "language_name string, call_kind string, word string")


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(id, resolvedPath) of imports (id, target) whose extensionless target names a file, by the order of EXTENSIONS."""
    tries = imports.select("id", F.posexplode(F.array(*[F.concat("target", F.lit(x)) for x in EXTENSIONS])).alias("at", "path"))
    return tries.join(files.select("path"), "path").groupBy("id").agg(F.min_by("path", "at").alias("resolvedPath"))


def resolved_kind(path, under_root):
    """The kind of what an import resolves to."""
    asset = path.rlike(r"\.(json|css|scss|svg|png|jpe?g|gif|md|txt|ya?ml|toml|html?|wasm)$")
    return F.when(path.isNull(), "unresolved").when(path.endswith(".d.ts"), "declaration").when(asset, "asset").when(path.rlike(r"(^|/)(node_modules|site-packages)/"), "package").when(under_root, "source").otherwise("package")


def resolve_imports(c: Catalog, targets: DataFrame) -> DataFrame:
    """Imports with the paths that `targets` (id, target) lead to; ones without keep no confidence."""
    found = import_targets(targets, c.files).withColumnRenamed("resolvedPath", "found")
    joined = c.imports.join(found, "id", "left")
    path = F.coalesce("found", "resolvedPath")
    new = {"resolvedPath": path, "resolvedKind": F.when(F.col("found").isNotNull(), resolved_kind(path, F.lit(True))).otherwise(F.col("resolvedKind")), "confidence": F.when(path.isNull() & (F.col("resolvedKind") == "unresolved"), 0).otherwise(F.col("confidence"))}
    return joined.withColumns(new).select(*c.imports.columns)


def _candidate(df: DataFrame, kind: str, source, priority: int, callee=None, imports=None, kind_=None) -> DataFrame:
    none = F.lit(None).cast("string")
    source = F.lit(source) if isinstance(source, str) else source
    return df.select(
        F.col("site").alias("call_site_id"), "caller_id", (F.col(kind_) if kind_ else F.lit(kind)).alias("target_kind"), (none if callee is None else F.col(callee)).alias("callee_id"),
        (none if imports is None else F.col(imports)).alias("imports_id"), source.alias("resolution_source"), F.lit(priority).alias("priority"),
    )


def _first(df: DataFrame, *order) -> DataFrame:
    w = Window.partitionBy("site").orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dynamic(sites: DataFrame, c: Catalog) -> DataFrame:
    return _candidate(sites.filter("call_kind = 'dynamic_call'"), "dynamic", "dynamic_pattern", 0)


def _least(df: DataFrame, by: list[str], *order, **more) -> DataFrame:
    """The first row of each key by `order`, before a join: what many rows share is met once by every site."""
    cols = [F.col(x) if isinstance(x, str) else x for x in order]
    best = F.min(F.struct(*cols, *[F.col(v).alias(k) for k, v in more.items()])).alias("_best")
    return df.groupBy(*by).agg(best)


def _asked_for(store: Store, name: str, side: DataFrame, sites: DataFrame, key: str, *words, least: tuple = (), **more) -> DataFrame:
    """What `_least` finds in a side by `least`, keys before the order, for names `key` that a site has as one of `words`.

    It is written and counted, so that sites are not shuffled to meet the few names they share, nor a long list of names sent to the driver.
    """
    asked = sites.select(F.explode(F.array(*words)).alias(key)).filter(F.col(key).isNotNull()).distinct()
    known = side.join(counted(store.keep(asked, f"{name}-asked")), key, "left_semi")
    return counted(store.keep(_least(known, *least, **more), name))


def same_class(sites: DataFrame, c: Catalog) -> DataFrame:
    """Methods called on `this` or `self`, by the caller's class; else its properties that begin the expression."""
    own = F.when(F.col("language_name") == "python", "self").otherwise("this")
    mine = sites.filter((F.col("call_kind") == "method_call") & (F.get(F.split("callee_base", r"\."), F.lit(0)) == own))
    placed = mine.join(c.symbols.select(F.col("id").alias("caller_id"), F.col("parent_id").alias("cls")), "caller_id").filter("cls is not null")
    member = c.symbols.select(F.col("id").alias("member"), F.col("parent_id").alias("cls"), F.col("name").alias("callee_name"), "kind", "line").filter("cls is not null")
    methods = _least(member.filter(F.col("kind").isin(*schema.CALLABLE_KINDS)), ["cls", "callee_name"], "line", "member")
    method = _first(placed.join(methods, ["cls", "callee_name"]).select("site", "caller_id", "_best.*"), "line", "member")
    field = F.get(F.split("callee_base", r"\."), F.lit(1))
    fields = _least(member.filter("kind = 'property'").withColumnRenamed("callee_name", "field"), ["cls", "field"], "line", "member")
    held = placed.filter(field.isNotNull()).withColumn("field", field).join(fields, ["cls", "field"]).select("site", "caller_id", "_best.*")
    return _candidate(method, "project_symbol", "same_class", 1, callee="member").unionByName(_candidate(_first(held, "line", "member"), "project_symbol", "same_class_property", 2, callee="member"))


def same_file(sites: DataFrame, c: Catalog) -> DataFrame:
    """Callables and classes of the file with the callee's name, or variables of the caller that begin the expression; first by line."""
    there = c.symbols.select(F.col("id").alias("member"), F.col("file_path").alias("caller_file_path"), F.col("name").alias("callee_name"), "kind", "line", F.col("parent_id").alias("caller_id"))
    head, store = F.coalesce(F.get(F.split("callee_base", r"\."), F.lit(0)), F.col("callee_name")), Store(c.spark, "same-file")
    callables = there.filter(F.col("kind").isin(*schema.CALLABLE_KINDS, "class"))
    callables = _asked_for(store, "callables", callables, sites, "callee_name", F.col("callee_name"), least=(["caller_file_path", "callee_name"], "line", "member")).withColumnRenamed("_best", "_named")
    var = there.filter(F.col("kind").isin("var", "let", "const")).withColumnRenamed("callee_name", "head")
    var = _asked_for(store, "var", var, sites, "head", head, least=(["caller_file_path", "head", "caller_id"], "line", "member")).withColumnRenamed("_best", "_held")
    asked = sites.select("site", "caller_id", "caller_file_path", "callee_name", head.alias("head"))
    met = asked.join(callables, ["caller_file_path", "callee_name"], "left").join(var, ["caller_file_path", "head", "caller_id"], "left")
    found = met.withColumn("member", F.least("_named", "_held")["member"]).filter("member is not null")
    return _candidate(found, "project_symbol", "same_file", 3, callee="member")


def by_import(sites: DataFrame, c: Catalog) -> DataFrame:
    """Imports whose local names have the callee or the head of its receiver; with the symbol in the resolved file, or one re-export further, if found."""
    usable = c.imports.filter("importKind not in ('side-effect', 'type-only') and resolvedKind <> 'unresolved'")
    names = usable.select(F.col("id").alias("imp"), F.col("file_path").alias("caller_file_path"), "resolvedPath", "resolvedKind", F.explode(local_names(F.col("importedNames"))).alias("word"))
    head, store = F.get(F.split("callee_base", r"\."), F.lit(0)), Store(c.spark, "by-import")
    names = _asked_for(store, "names", names, sites, "word", F.col("callee_name"), head, least=(["caller_file_path", "word"], (F.col("resolvedKind") != "source").alias("away"), "imp"), resolvedPath="resolvedPath", resolvedKind="resolvedKind")
    asked = sites.select("site", "caller_id", "caller_file_path", "callee_name", head.alias("head"))
    met = asked.join(names.select("caller_file_path", F.col("word").alias("callee_name"), F.col("_best").alias("_a")), ["caller_file_path", "callee_name"], "left")
    met = met.join(names.select("caller_file_path", F.col("word").alias("head"), F.col("_best").alias("_b")), ["caller_file_path", "head"], "left")
    hit = met.withColumn("_hit", F.least("_a", "_b")).filter("_hit is not null").select("site", "caller_id", "callee_name", "_hit.imp", "_hit.resolvedPath", "_hit.resolvedKind")
    goal = c.symbols.select(F.col("id").alias("member"), F.col("file_path").alias("resolvedPath"), F.col("name").alias("callee_name"), "line")
    goal = _asked_for(store, "goal", goal, sites, "callee_name", F.col("callee_name"), least=(["resolvedPath", "callee_name"], "line", "member"))
    again = c.imports.filter("edgeKind <> 'import' and resolvedPath is not null").select(F.col("file_path").alias("_at"), "resolvedPath").distinct()
    far = counted(store.keep(again.join(goal, "resolvedPath").groupBy(F.col("_at").alias("resolvedPath"), "callee_name").agg(F.min("_best")["member"].alias("far")), "far"))
    out = hit.join(goal, ["resolvedPath", "callee_name"], "left").join(far, ["resolvedPath", "callee_name"], "left").withColumn("member", F.coalesce("_best.member", "far"))
    source = F.when(F.col("resolvedKind") == "source", "source_import").otherwise("external_import")
    found = _candidate(out, "import", source, 4, callee="member", imports="imp")
    return found.withColumn("target_kind", F.when(F.col("callee_id").isNotNull(), "project_symbol").otherwise("import"))


def builtin(sites: DataFrame, c: Catalog) -> DataFrame:
    words = F.array_distinct(F.array_compact(F.array("callee_name", F.get(F.split("callee_base", r"\."), F.lit(0)))))
    table = F.broadcast(builtins(c))  # some 200 rows
    return _candidate(sites.withColumn("word", F.explode(words)).join(table, ["language_name", "call_kind", "word"]).dropDuplicates(["site"]), "builtin", "builtin_list", 5)


def unresolved(sites: DataFrame, c: Catalog) -> DataFrame:
    return _candidate(sites, "unresolved", "unresolved", 9)


STAGES: tuple[Callable[[DataFrame, Catalog], DataFrame], ...] = (dynamic, same_class, same_file, by_import, builtin, unresolved)


def by_definition(sites: DataFrame, c: Catalog, locations: DataFrame, builtin_paths: tuple[str, ...] = ()) -> DataFrame:
    """Where a language server says that callees are defined: locations (call_site_id, path, line, column), with `n` if it gave several.

    A callable or class that begins there is called; else a path below one of
    `builtin_paths` is a part of the language; else the file's import of that
    folder, or of a name in the expression, is. Of several locations the last
    one that leads to anything counts.
    """
    n = F.col("n") if "n" in locations.columns else F.lit(0)
    there = c.symbols.filter(F.col("kind").isin(*schema.CALLABLE_KINDS, "class")).groupBy(F.col("file_path").alias("path"), F.col("line").alias("at_line"), F.col("column").alias("at_column")).agg(F.min("id").alias("member"))
    # Symbols are looked up for the short rows of locations, so that those of sites are shuffled only once.
    placed = locations.select(F.col("call_site_id").alias("site"), n.alias("n"), "path", F.col("line").alias("at_line"), F.col("column").alias("at_column"))
    placed = placed.join(there, ["path", "at_line", "at_column"], "left").select("site", "n", "path", "member")
    language = F.lit(False)
    for start in builtin_paths:
        language = language | F.col("path").startswith(start)
    asked = sites.select("site", "caller_id", "caller_file_path", "callee_expression", "language_name").join(placed, "site")
    known = Store(c.spark, "definitions").keep(asked.withColumn("language", language), "known")
    open_ = known.filter("member is null and not language").select("site", "n", "caller_id", F.col("caller_file_path").alias("file_path"), F.col("path").alias("definition_path"), "callee_expression", "language_name")
    led = prefixes.imports_of_definitions(c, open_, None, by=("site", "n")).withColumnRenamed("imports_id", "imp")
    full = known.filter("member is not null or language").select("site", "n", "caller_id", "member", "language").unionByName(led.withColumn("language", F.lit(False)), allowMissingColumns=True)
    last = _first(full, F.desc("n"), "member", "imp")
    kind = F.when(F.col("member").isNotNull(), "project_symbol").when(F.col("language"), "builtin").otherwise("import")
    out = last.withColumn("imp", F.when(kind == "import", F.col("imp"))).withColumn("kind_", kind)
    return _candidate(out, "", "lsp_definition", 6, callee="member", imports="imp", kind_="kind_")


def by_hover(sites: DataFrame, c: Catalog, hovers: DataFrame) -> DataFrame:
    """What hovers over the receivers of a call say: (call_site_id, n, text), the nearest receiver first. The first import of a name or type that one of them shows is called."""
    from .enhance import hover_parts, type_names

    store = Store(c.spark, "hovers")
    hovers = store.keep(hovers.select(F.col("call_site_id").alias("site"), "n", "text"), "given")
    # Many sites show the same text, so each is read once: from a written table, or Spark reads texts before it drops repeats.
    shown = store.keep(hovers.select("text").distinct(), "texts").select("text", hover_parts(F.col("text")).alias("h")).filter("h.name <> '' and h.type <> ''")
    words = F.array_distinct(F.array(F.col("h.name"), F.array_join(type_names(F.col("h.type")), " ")))
    names = c.imports.select(F.col("file_path").alias("caller_file_path"), F.explode(local_names(F.col("importedNames"), types=True)).alias("word"), "resolvedPath", F.col("id").alias("imp"))
    names = _least(names, ["caller_file_path", "word"], "resolvedPath", "imp")
    # Texts without a word that an import has are dropped before the hovers meet their sites.
    known = shown.select("text", F.explode(words).alias("word")).filter("word <> ''").join(names.select("word").distinct(), "word", "left_semi")
    said = hovers.join(store.keep(known, "known"), "text").select("site", "n", "word")
    asked = sites.select("site", "caller_id", "caller_file_path").join(said, "site").join(names, ["caller_file_path", "word"])
    first = asked.groupBy("site", "caller_id").agg(F.min(F.struct("n", "_best")).alias("_best")).withColumn("imp", F.col("_best._best.imp"))
    return _candidate(first, "import", "lsp_hover", 7, imports="imp")


def resolve_calls(c: Catalog, sites: DataFrame | None = None, stages=STAGES, definitions: DataFrame | None = None, hovers: DataFrame | None = None, builtin_paths: tuple[str, ...] = ()) -> DataFrame:
    """One edge for each call site.

    What a language server gave ranks below builtins: `definitions`, as
    (call_site_id, callee_id) or as the locations of `by_definition`, then
    `hovers` as `by_hover` takes them.
    """
    store = Store(c.spark, "resolve")
    sites = store.keep((c.call_sites if sites is None else sites).withColumnRenamed("id", "site"), "sites")
    c = c.with_(imports=store.keep(c.imports, "imports"))
    found = [stage(sites, c) for stage in stages]
    if definitions is not None and "callee_id" in definitions.columns:
        found.append(_candidate(sites.join(definitions.select(F.col("call_site_id").alias("site"), "callee_id"), "site"), "project_symbol", "lsp_definition", 6, callee="callee_id"))
    elif definitions is not None:
        found.append(by_definition(sites, c, definitions, builtin_paths))
    if hovers is not None:
        found.append(by_hover(sites, c, hovers))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    best = Window.partitionBy("call_site_id").orderBy("priority", F.col("callee_id").asc_nulls_last(), "imports_id")
    out = out.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "priority")
    return out.select(
        F.sha2(F.concat_ws("|", "call_site_id", "caller_id"), 256).alias("id"), "call_site_id", "caller_id", "target_kind", "callee_id", "imports_id", "resolution_source",
        confidence(F.col("resolution_source")).cast("int").alias("confidence"), F.lit(None).cast("string").alias("reason"),
    )
