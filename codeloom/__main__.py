"""Command line: init, index, index-file, query, run, watch, remove-docstrings."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from . import config as settings
from .engine import Engine, embed_missing, hash_embedding, render
from .operators import changes


def session() -> SparkSession:
    spark = SparkSession.builder.appName("codeloom").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    p.add_argument("--root", default=".", help="the source tree")
    p.add_argument("--store", help="the folder of index snapshots (default: .codeloom below the root)")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="write a settings file where there is none")
    sub.add_parser("index", help="index new and changed files")
    one = sub.add_parser("index-file", help="index some files only")
    one.add_argument("paths", nargs="+")
    q = sub.add_parser("query", help="search symbols by name")
    q.add_argument("text")
    q.add_argument("--limit", type=int, default=50)
    r = sub.add_parser("run", help="answer with a mode, with parameters as JSON")
    r.add_argument("tool")
    r.add_argument("mode")
    r.add_argument("params", nargs="?", default="{}")
    sub.add_parser("modes", help="list the modes")
    sub.add_parser("watch", help="keep the index up to date until interrupted")
    sub.add_parser("remove-docstrings", help="forget all docstrings")
    a = p.parse_args(argv)
    if a.command == "init":
        print("written" if settings.save(a.root) else "there is one already")
        return 0
    if a.command == "modes":
        print("\n".join(Engine.modes()))
        return 0
    from .extract.run import index
    from .streaming.watch import Snapshots, watch

    spark, config = session(), settings.load(a.root)
    store = os.path.abspath(a.store or os.path.join(a.root, ".codeloom"))
    snapshots, root, now = Snapshots(spark, store), os.path.abspath(a.root), int(time.time() * 1000)
    number = max(snapshots.numbers(), default=0) + 1
    c = snapshots.current()
    if a.command in ("index", "index-file"):
        only = spark.createDataFrame([(x,) for x in a.paths], "path string") if a.command == "index-file" else None
        c = index(spark, root, config, c, now, only)
        c = embed_missing(c, hash_embedding(config.embedding_width)) if config.embeddings else c
        c = snapshots.put(c, number)
        print(f"{c.files.count()} files, {c.symbols.count()} symbols, {c.call_edges.count()} calls")
    elif a.command == "watch":
        watch(spark, root, snapshots, os.path.join(store, "checkpoint"), config).awaitTermination()
    elif a.command == "remove-docstrings":
        snapshots.put(changes.without_docstrings(c, ("function", "method", "arrowFunction", "class", "interface", "type", "const")), number)
    else:
        engine = Engine(c, root, hash_embedding(config.embedding_width) if config.embeddings else None)
        try:
            found = engine.run("search_codebase", "symbol", query=f"*{a.text}*", limit=a.limit) if a.command == "query" else engine.run(a.tool, a.mode, **json.loads(a.params))
        except (LookupError, ValueError, TypeError) as x:
            print(x, file=sys.stderr)
            return 1
        print(render(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
