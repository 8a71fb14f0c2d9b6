"""Extraction as a DataFrame operation, and the index that it gives."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..catalog import Catalog
from ..config import Config
from ..functions.parsers import resolve_module
from ..operators import changes, nearest, resolve
from ..sources import files as source_files
from ..sources import walk
from ..storage import Store

#: Candidates that an import's aliases come before.
ALIASES = 1_000_000
TABLES = ("symbols", "imports", "call_sites", "exceptions", "env_vars")


def extract_file(text: str, path: str, language: str):
    """Rows of one file; languages without an extractor have none."""
    from . import python, typescript

    if language == "python":
        return python.extract(text, path)
    if language in ("typescript", "tsx", "javascript"):
        return typescript.extract(text, path, "typescript" if language == "tsx" else language)
    from .rows import Extracted

    return Extracted(path, language)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content, language in zip(batch["path"], batch["content"], batch["language"]):
            out = extract_file(content or "", path, language)
            rows += [(t, json.dumps(r)) for t in TABLES for r in getattr(out, t)]
        yield pd.DataFrame(rows, columns=["tab", "row"])


def extract(sources: DataFrame, store: Store, name: str = "extracted") -> dict[str, DataFrame]:
    """Tables of the code graph from (path, content, language)."""
    found = store.keep(sources.select("path", "content", "language").mapInPandas(_extract, "tab string, row string"), name)
    return {t: found.filter(F.col("tab") == t).select(F.from_json("row", schema.TABLES[t]).alias("r")).select("r.*") for t in TABLES}


def import_candidates(imports: DataFrame, config: Config) -> DataFrame:
    """(id, target, at): the extensionless paths that an import may name, in the project, likeliest first. Aliases are (folder, prefix, target prefix)."""
    roots, aliases = list(config.source_roots), [tuple(x) for x in config.path_aliases]

    def targets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for id_, path, module in zip(batch["id"], batch["file_path"], batch["sourceModule"]):
                python = path.endswith(".py")
                if module.startswith("."):
                    names = [resolve_module(path, module)]
                else:
                    hits = [] if python else [new + module[len(old) :] for scope, old, new in aliases if path.startswith(scope) and module.startswith(old)]
                    flat = module.replace(".", "/") if python else module
                    here = path.rsplit("/", 1)[0] + "/" + flat if "/" in path else flat
                    names = [*hits, *([here] if python else []), *(flat if r == "." else f"{r}/{flat}" for r in roots)]
                rows += [(id_, n, k) for k, n in enumerate(names) if n]
            yield pd.DataFrame(rows, columns=["id", "target", "at"])

    return imports.select("id", "file_path", "sourceModule").mapInPandas(targets, "id string, target string, at int")


def resolve_imports(imports: DataFrame, files: DataFrame, config: Config, settings: DataFrame | None = None) -> DataFrame:
    """Imports with the project files that they name; others are packages or parts of the language. Path aliases are those of `config`, else of the nearest `settings` (see `nearest.alias_targets`)."""
    tries = import_candidates(imports, config)
    if settings is not None:
        aliased = nearest.alias_targets(imports.filter(~F.col("file_path").endswith(".py")).select("id", "file_path", "sourceModule"), settings)
        tries = tries.unionByName(aliased.select("id", "target", (F.col("at") - ALIASES).cast("int").alias("at")))
    hits = tries.select("id", "at", F.posexplode(F.array(*[F.concat("target", F.lit(x)) for x in resolve.EXTENSIONS])).alias("e", "path")).join(files.select("path"), "path")
    best = hits.groupBy("id").agg(F.min_by("path", F.struct("at", "e")).alias("found"))
    relative = F.col("sourceModule").startswith(".")
    builtin = F.col("sourceModule").rlike(r"^(node|bun):|^(fs|path|os|url|util|http|https|crypto|child_process|stream|events|assert|zlib)$") & ~F.col("file_path").endswith(".py")
    stdlib = F.col("file_path").endswith(".py") & F.split("sourceModule", r"\.")[0].isin(*sorted(_stdlib()))
    asset = F.col("sourceModule").rlike(r"\.(css|scss|sass|less|svg|png|jpe?g|webp|json|ya?ml|toml)$")
    kind = F.when(F.col("found").isNotNull(), F.when(F.col("found").endswith(".d.ts"), "declaration").otherwise("source")).when(builtin, "builtin").when(stdlib, "stdlib").when(asset & relative, "asset").when(relative, "unresolved").otherwise("package")
    python = F.col("file_path").endswith(".py")
    out = imports.join(best, "id", "left").withColumn("resolvedKind", kind).withColumn("resolvedPath", F.col("found"))
    out = out.withColumn("resolutionSource", F.when(F.col("resolvedKind") == "unresolved", "unresolved").when(python, F.when(F.col("found").isNotNull(), "python-static").otherwise("python-importlib")).otherwise("typescript"))
    out = out.withColumn("confidence", F.when(F.col("resolvedKind") == "unresolved", 0).when(F.col("found").isNotNull(), 100).otherwise(80)).withColumn("isExternal", F.col("resolvedKind").isin("package", "builtin", "stdlib"))
    return out.select(*schema.IMPORTS.names)


def _stdlib() -> set[str]:
    import sys

    return set(sys.stdlib_module_names)


def inherited(c: Catalog) -> DataFrame:
    """Symbols whose bases have the id of the symbol or import that they name, where there is one: the file's own symbol, or its import of the name."""
    bases = c.symbols.filter("inheritence is not null").select("id", "file_path", F.posexplode("inheritence").alias("at", "b")).withColumn("name", F.col("b.inherits_from_name"))
    own = c.symbols.filter(F.col("kind").isin("class", "interface", "type")).select("file_path", "name", F.col("id").alias("own")).groupBy("file_path", "name").agg(F.min("own").alias("own"))
    from ..functions.scalars import local_names

    names = c.imports.select("file_path", F.explode(local_names(F.col("importedNames"), types=True)).alias("name"), F.col("id").alias("imp"), "resolvedPath").groupBy("file_path", "name").agg(F.min(F.struct("imp", "resolvedPath")).alias("i"))
    far = own.select(F.col("file_path").alias("resolvedPath"), "name", F.col("own").alias("far"))
    full = bases.join(own, ["file_path", "name"], "left").join(names, ["file_path", "name"], "left").withColumn("resolvedPath", F.col("i.resolvedPath")).join(far, ["resolvedPath", "name"], "left")
    one = F.struct("at", F.col("name").alias("inherits_from_name"), F.coalesce("own", "far").alias("inherits_from_id"), F.col("i.imp").alias("inherits_from_imports_id"), F.col("b.inheritence_type").alias("inheritence_type"))
    lists = full.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("l"))
    plain = F.transform("l", lambda x: F.struct(x["inherits_from_name"].alias("inherits_from_name"), x["inherits_from_id"].alias("inherits_from_id"), x["inherits_from_imports_id"].alias("inherits_from_imports_id"), x["inheritence_type"].alias("inheritence_type")))
    return c.symbols.drop("inheritence").join(lists.select("id", plain.alias("inheritence")), "id", "left").select(*schema.SYMBOLS.names)


def index(spark: SparkSession, root: str, config: Config | None = None, before: Catalog | None = None, now_millis: int = 0, only: DataFrame | None = None, definitions: DataFrame | None = None, hovers: DataFrame | None = None) -> Catalog:
    """The index of a source tree. With one from before, only new and changed files are read, and those gone are dropped (of `only` (path), if given). `definitions` and `hovers` are what a language server gave (see `resolve.resolve_calls`)."""
    config = config or Config()
    store = Store(spark, "index")
    found, settings = scanned(spark, root, config, store)
    return apply(spark, found, config, before, now_millis, only, store, settings, definitions, hovers)


def scanned(spark: SparkSession, root: str, config: Config, store: Store) -> tuple[DataFrame, DataFrame | None]:
    """The tree's files with their contents, and its compiler settings where `config` names no aliases itself; both from one walk."""
    listing = store.keep(walk.walk(spark, root, config, store), "listing")
    found = store.keep(walk.read(spark, root, listing, config), "scan")
    return found, None if config.path_aliases else store.keep(source_files.settings(spark, root, listing), "settings")


def apply(spark: SparkSession, found: DataFrame, config: Config, before: Catalog | None, now_millis: int, only: DataFrame | None, store: Store, settings: DataFrame | None = None, definitions: DataFrame | None = None, hovers: DataFrame | None = None) -> Catalog:
    """As `index`, for files (path, content, language, hash, estimated_tokens)."""
    old = before or Catalog.empty(spark)
    if only is not None:
        found = found.join(only.select("path").distinct(), "path", "left_semi")
    changed = store.keep(found.join(old.files.select("path", "hash"), ["path", "hash"], "left_anti"), "changed")
    scope = old.files if only is None else old.files.join(only.select("path").distinct(), "path", "left_semi")
    gone = store.keep(scope.select("path").join(found.select("path"), "path", "left_anti").unionByName(changed.select("path")), "gone")
    new = extract(changed, store)
    kept = changes.delete_files(old, gone)
    stamped = changed.withColumn("indexed_at", F.lit(now_millis).cast("long")).select(*schema.FILES.names)
    files = store.keep(kept.files.unionByName(stamped), "files")
    imports = resolve_imports(kept.imports.unionByName(new["imports"]), files, config, settings)
    c = kept.with_(
        files=files, symbols=kept.symbols.unionByName(new["symbols"]), imports=store.keep(imports, "imports"), call_sites=store.keep(kept.call_sites.unionByName(new["call_sites"]), "sites"),
        exceptions=kept.exceptions.unionByName(new["exceptions"]), env_vars=kept.env_vars.unionByName(new["env_vars"]),
    )
    c = c.with_(symbols=store.keep(inherited(c), "symbols"))
    return c.with_(call_edges=store.keep(resolve.resolve_calls(c, definitions=definitions, hovers=hovers), "edges"))
