"""Source trees as (path, content, hash, language, estimated_tokens)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.globs import IgnoreRules, LinkedGlobs
from ..functions.paths import extension
from ..functions.scalars import content_hash, token_estimate
from ..functions.workspace import loose_json


def ignore_rules(root: str, config: Config, compat: bool = False) -> IgnoreRules | LinkedGlobs:
    """Configured patterns, then those of each ignore file outside of ignored folders, within its own folder.

    The last pattern that matches decides; with `compat`, the first one less the negated ones that belong to it.
    """
    rules = (LinkedGlobs() if compat else IgnoreRules()).plus(config.ignore)
    if not config.use_gitignore or not os.path.isdir(root):
        return rules
    for at, folders, files in os.walk(root):
        scope = os.path.relpath(at, root).replace(os.sep, "/")
        scope = "" if scope == "." else scope
        if ".gitignore" in files:
            with open(os.path.join(at, ".gitignore"), errors="replace") as f:
                rules = rules.plus(f.read().splitlines(), scope)
        folders[:] = [d for d in sorted(folders) if not rules.ignored(f"{scope}/{d}".lstrip("/"))]
    return rules


def language_of(path, config: Config):
    out = F.lit(None).cast("string")
    for e, lang in config.extensions.items():
        out = F.when(extension(path) == e, lang).otherwise(out)
    return out


def _relative(spark: SparkSession, root: str, path):
    """A file's full path as one below `root`."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    at = F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?(?=/)", ""), "^/+", "/")
    return F.substring(at, F.lit(len(prefix) + 2), F.length(at))


def settings(spark: SparkSession, root: str, listing: DataFrame) -> DataFrame:
    """(dir, base_url, paths) of the compiler settings among the files (path) of a tree, read by tasks; those of packages, and ones that are no JSON, are left out."""
    from .walk import opened

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, raw in opened(root, batch["path"]):
                try:
                    options = (loose_json(raw.decode(errors="replace")) or {}).get("compilerOptions") or {}
                    paths = [{"pattern": k, "targets": [str(t) for t in v]} for k, v in (options.get("paths") or {}).items()]
                    rows.append((path.rpartition("/")[0], options.get("baseUrl"), paths))
                except (ValueError, AttributeError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["dir", "base_url", "paths"])

    found = listing.select("path").filter(F.col("path").rlike("(^|/)tsconfig[.]json$") & ~F.col("path").rlike("(^|/)node_modules/"))
    return found.mapInPandas(parsed, "dir string, base_url string, paths array<struct<pattern:string,targets:array<string>>>")


def scan(spark: SparkSession, root: str, config: Config | None = None, compat: bool = False) -> DataFrame:
    """Files of enabled languages under `root` that no pattern ignores, listed and read by tasks (see `walk`). With `compat` patterns are linked as `ignore_rules` says, and Spark lists the tree."""
    config = config or Config()
    if not compat:
        from . import walk

        return walk.read(spark, root, walk.walk(spark, root, config), config)
    rules = ignore_rules(root, config, compat)
    # Files of other extensions are left out of the listing, so that no task opens them.
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(config.extensions) + "}").load(root)
    found = raw.withColumn("path", _relative(spark, root, F.col("path")))
    found = found.withColumn("language", language_of("path", config)).filter(F.col("language").isNotNull() & ~rules.column(F.col("path")))
    text = found.withColumn("content", F.make_valid_utf8(F.col("content").cast("string"))).select("path", "content", "language")
    return text.withColumn("hash", content_hash(F.col("content"))).withColumn("estimated_tokens", token_estimate(F.col("content")))


def all_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the indexed languages, for reading definitions and snippets."""
    return scan(spark, root).select("path", "content")
