"""Joins of names of which one begins with the other, without a comparison of all pairs.

Words are cut to the lengths that occur on the other side in the same group, so
both directions are equal joins: a row for each word and length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.paths import dirname
from ..functions.scalars import callee_parts, local_names


def _cut(words: DataFrame, others: DataFrame) -> DataFrame:
    """`words` (grp, word) with `prefix`, the word cut to each length that a word of `others` has."""
    lengths = others.select("grp", F.length("word").alias("_n")).distinct()
    return words.join(lengths, "grp").filter(F.length("word") >= F.col("_n")).withColumn("prefix", F.substring(F.col("word"), F.lit(1), F.col("_n"))).drop("_n")


def prefix_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, rank) of names left (id, grp, word) and right (id, grp, word, rank) in one group of which one begins with the other.

    Case does not matter. Empty and null words match nothing. A pair is given once.
    """
    word = F.lower("word")
    a = left.select(F.col("id").alias("left_id"), "grp", word.alias("word")).filter("word <> ''")
    b = right.select(F.col("id").alias("right_id"), "grp", word.alias("word"), "rank").filter("word <> ''")
    longer = _cut(b, a).select("grp", "prefix", "right_id", "rank").join(a.withColumnRenamed("word", "prefix"), ["grp", "prefix"])
    shorter = _cut(a, b).select("grp", "prefix", "left_id").join(b.withColumnRenamed("word", "prefix"), ["grp", "prefix"])
    shown = ["left_id", "right_id", "rank"]
    return longer.select(*shown).unionByName(shorter.select(*shown)).distinct()


def imports_of_types(c: Catalog, types: DataFrame) -> DataFrame:
    """(id, imports_id): for types (id, file_path, names), the first import of the file, by resolved path and id, of a name that one of the type's names begins with or that begins with it."""
    names = types.select("id", F.col("file_path").alias("grp"), F.explode("names").alias("word"))
    known = c.imports.select("id", F.col("file_path").alias("grp"), F.explode("importedNames").alias("word"), F.struct("resolvedPath", "id").alias("rank"))
    return prefix_pairs(names, known).groupBy(F.col("left_id").alias("id")).agg(F.min("rank")["id"].alias("imports_id"))


def imports_of_definitions(c: Catalog, sites: DataFrame, language: str | None = "typescript", by: tuple[str, ...] = ()) -> DataFrame:
    """(site, imports_id): for call sites (site, file_path, definition_path, callee_expression), the file's import that leads to the folder of the definition; else one whose local name is a part of the expression.

    Of several imports the first by resolved path and id counts. Sites without either are left out.
    Without a `language`, each site has one in `language_name`. With `by`, sites are gone through in one pass: those that agree in these columns
    give one row, with the least import of theirs and of what further columns they have.
    """
    rank = F.struct("resolvedPath", "id").alias("rank")
    near = c.imports.filter("edgeKind = 'import' and resolvedPath is not null").select("file_path", dirname("resolvedPath").alias("_dir"), rank)
    near = near.groupBy("file_path", "_dir").agg(F.min("rank")["id"].alias("near"))
    local = c.imports.select("file_path", F.explode(local_names(F.col("importedNames"))).alias("_word"), rank)
    local = local.groupBy("file_path", "_word").agg(F.min("rank").alias("rank"))
    known = {"file_path", "definition_path", "callee_expression", "language_name"}
    kept = [x for x in sites.columns if x not in known] if by else ["site"]
    parts = F.array_distinct(callee_parts(F.col("callee_expression"), F.col("language_name") if language is None else language)).alias("_parts")
    asked = sites.select(*kept, "file_path", dirname("definition_path").alias("_dir"), "callee_expression", *(["language_name"] if language is None else []))
    met = asked.join(near, ["file_path", "_dir"], "left")
    if by:
        words = met.select(*kept, "file_path", "near", F.explode_outer(F.when(F.col("near").isNull(), parts)).alias("_word"))
        led = words.join(local, ["file_path", "_word"], "left").filter("near is not null or rank is not null")
        return led.groupBy(*by).agg(*[F.min(x).alias(x) for x in kept if x not in by], F.least(F.min("near"), F.min("rank")["id"]).alias("imports_id"))
    chained = met.filter("near is null").select("site", "file_path", F.explode(parts).alias("_word")).join(local, ["file_path", "_word"]).groupBy("site").agg(F.min("rank")["id"].alias("imports_id"))
    return met.filter("near is not null").select("site", F.col("near").alias("imports_id")).unionByName(chained)
