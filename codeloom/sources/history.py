"""Histories of a repository, from its version control's log."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_lines(root: str) -> list[str]:
    out = subprocess.run(["git", "-C", root, "log", "--numstat", "--format=%H"], capture_output=True, text=True, check=False)
    return out.stdout.splitlines() if out.returncode == 0 else []


def numstat(lines: DataFrame) -> DataFrame:
    """(path, added, removed, commits) from lines (value) of `added<TAB>removed<TAB>path`; `-` counts 0, and other lines nothing."""
    parts = F.split("value", "\t")
    rows = lines.filter(F.size(parts) >= 3).select(parts[2].alias("path"), F.coalesce(parts[0].try_cast("long"), F.lit(0)).alias("added"), F.coalesce(parts[1].try_cast("long"), F.lit(0)).alias("removed"))
    return rows.groupBy("path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("commits"))


def churn(spark: SparkSession, root: str) -> DataFrame:
    return numstat(spark.createDataFrame([(x,) for x in log_lines(root)], "value string"))


def symbol_history(root: str, path: str, start: int, end: int, diff: bool = False) -> str:
    """The log of lines start to end of a file; empty where there is none."""
    command = ["git", "-C", root, "log", "-L", f"{start},{end}:{path}", *([] if diff else ["--no-patch"])]
    out = subprocess.run(command, capture_output=True, text=True, check=False)
    return out.stdout if out.returncode == 0 else ""
