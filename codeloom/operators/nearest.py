"""The nearest settings above a path, by equal joins over the folders that lead to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folders(path: Column) -> Column:
    """The folders above a path, the root ('') first, each with its depth."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir"), k.alias("depth")))


def nearest(paths: DataFrame, marked: DataFrame) -> DataFrame:
    """(path, dir): the deepest of the folders `marked` (dir) that holds each path (path); paths below none are left out."""
    above = paths.select("path").distinct().select("path", F.inline(folders(F.col("path"))))
    return above.join(marked.select("dir").distinct(), "dir").groupBy("path").agg(F.max_by("dir", "depth").alias("dir"))


def joined(base: Column, path: Column) -> Column:
    """A relative path from a folder, without `.` and `..`; parts that would leave the root are dropped."""
    parts = F.filter(F.split(F.concat_ws("/", base, path), "/"), lambda x: ~x.isin("", "."))
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def alias_targets(imports: DataFrame, settings: DataFrame) -> DataFrame:
    """(id, target, at): what path aliases make of imports (id, file_path, sourceModule), likeliest first.

    settings: (dir, base_url, paths array<struct<pattern, targets array<string>>>),
    of which the nearest above a file holds for it. A pattern without `*` has
    to be the module, one with it to begin and end it; the one with the
    longest beginning counts, an exact one before all. A base folder is
    tried last. Relative imports have no alias.
    """
    away = imports.filter(~F.col("sourceModule").startswith("."))
    holds = nearest(away.select(F.col("file_path").alias("path")), settings).withColumnRenamed("path", "file_path")
    known = away.join(holds, "file_path").join(settings.withColumnRenamed("dir", "_dir"), F.col("dir") == F.col("_dir"))
    module = F.col("sourceModule")
    base = joined(F.col("dir"), F.coalesce("base_url", F.lit(".")))

    def fit(p: Column) -> Column:
        star = F.instr(p["pattern"], "*")
        head, tail = F.substring(p["pattern"], F.lit(1), star - 1), F.substring(p["pattern"], star + 1, F.length(p["pattern"]))
        fits = F.when(star == 0, p["pattern"] == module).otherwise(module.startswith(head) & module.endswith(tail) & (F.length(module) >= F.length(head) + F.length(tail)))
        held = F.when(star == 0, F.lit("")).otherwise(F.substring(module, F.length(head) + 1, F.length(module) - F.length(head) - F.length(tail)))
        return F.struct(fits.alias("fits"), F.when(star == 0, F.lit(1 << 30)).otherwise(F.length(head)).alias("n"), held.alias("held"), p["targets"].alias("targets"))

    tried = F.filter(F.transform(F.coalesce("paths", F.array().cast("array<struct<pattern:string,targets:array<string>>>")), fit), lambda x: x["fits"])
    best = known.withColumn("_base", base).withColumn("_best", F.array_max(tried))
    none = F.array().cast("array<string>")
    named = F.coalesce(F.transform("_best.targets", lambda t: joined(F.col("_base"), F.replace(t, F.lit("*"), F.col("_best.held")))), none)
    plain = F.when(F.col("base_url").isNotNull(), F.array(joined(F.col("_base"), module))).otherwise(none)
    return best.select("id", F.posexplode(F.concat(named, plain)).alias("at", "target"))
