"""A walk over a source tree by tasks: a level of folders at a time, ignored ones never opened.

A folder is a row with the ignore patterns that hold in it: those of the
folders above, and its own ignore file's. Tasks list folders and give their
files and folders; the next round lists those. So a tree takes as many rounds as it is deep,
ignored subtrees cost nothing, and rules are as near to their files as they are
written. Any file system that Arrow opens can be walked; contents are read
only for files that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.globs import IgnoreRules
from ..functions.scalars import content_hash, token_estimate
from ..storage import Store
from .files import language_of

FOUND = "path string, folder boolean, size long, modified long, rules array<struct<regex:string,negated:boolean>>"


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def entries(system, base: str, folder: str, rules: IgnoreRules, gitignore: bool) -> tuple[IgnoreRules, list[tuple[str, bool, int, int]]]:
    """The rules that hold in a folder, and its (path, is a folder, size, modified) entries that none of them ignores; a folder that is gone is empty."""
    from pyarrow import fs

    here = f"{base}/{folder}".rstrip("/")
    found = system.get_file_info(fs.FileSelector(here, allow_not_found=True))
    if gitignore and any(e.base_name == ".gitignore" for e in found):
        with system.open_input_stream(f"{here}/.gitignore") as f:
            rules = rules.plus(f.read().decode(errors="replace").splitlines(), folder)
    out = []
    for e in found:
        path = f"{folder}/{e.base_name}".lstrip("/")
        if e.type in (fs.FileType.Directory, fs.FileType.File) and not rules.ignored(path):
            out.append((path, e.type == fs.FileType.Directory, e.size or 0, e.mtime_ns or 0))
    return rules, out


def _listed(root: str, gitignore: bool):
    """Lists the folders (path, rules) of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(root)
        for batch in batches:
            rows = []
            for folder, held in zip(batch["path"], batch["rules"]):
                rules, found = entries(system, base, folder, IgnoreRules(tuple((r["regex"], r["negated"]) for r in held)), gitignore)
                kept = [{"regex": r, "negated": n} for r, n in rules.rules]
                rows += [(*e, kept if e[1] else []) for e in found]
            yield pd.DataFrame(rows, columns=["path", "folder", "size", "modified", "rules"])

    return run


def walk(spark: SparkSession, root: str, config: Config | None = None, store: Store | None = None) -> DataFrame:
    """(path, size, modified) of the files below `root` that no pattern ignores; a missing root has none."""
    config, store = config or Config(), store or Store(spark, "walk")
    first = [{"regex": r, "negated": n} for r, n in IgnoreRules().plus(config.ignore).rules]
    level = spark.createDataFrame([("", first)], "path string, rules array<struct<regex:string,negated:boolean>>")
    files, n = None, 0
    while True:
        found = store.keep(level.mapInPandas(_listed(root, config.use_gitignore), FOUND), f"level{n}")
        own = found.filter("not folder").select("path", "size", "modified")
        files = own if files is None else files.unionByName(own)
        level, n = found.filter("folder").select("path", "rules"), n + 1
        if level.isEmpty():
            return files
        level = level.repartition(spark.sparkContext.defaultParallelism)


def opened(root: str, paths) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of files below `root`, one at a time; a file that is gone is left out."""
    system, base = _open(root)
    for path in paths:
        try:
            with system.open_input_stream(f"{base}/{path}") as f:
                yield path, f.read()
        except FileNotFoundError:
            continue


def read(spark: SparkSession, root: str, files: DataFrame, config: Config | None = None) -> DataFrame:
    """(path, content, language, hash, estimated_tokens) of files (path), those of enabled languages."""
    config = config or Config()

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            language = dict(zip(batch["path"], batch["language"]))
            for path, raw in opened(root, batch["path"]):
                yield pd.DataFrame([(path, raw, language[path])], columns=["path", "raw", "language"])

    wanted = files.select("path", language_of("path", config).alias("language")).filter("language is not null")
    raw = wanted.mapInPandas(contents, "path string, raw binary, language string")
    text = raw.select("path", F.make_valid_utf8(F.col("raw").cast("string")).alias("content"), "language")
    return text.withColumn("hash", content_hash(F.col("content"))).withColumn("estimated_tokens", token_estimate(F.col("content")))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind): what differs between two walks."""
    new = after.join(before, ["path", "size", "modified"], "left_anti").select("path", F.lit("upsert").alias("kind"))
    return new.unionByName(before.join(after, "path", "left_anti").select("path", F.lit("unlink").alias("kind")))
