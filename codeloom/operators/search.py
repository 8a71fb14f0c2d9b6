"""Vector search and its fusion with text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from .lookup import among, search_symbols

RRF = 60


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v))


def nearest(c: Catalog, vector: list[float], limit: int = 20) -> DataFrame:
    """(symbol_id, distance) of the nearest vectors."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    same = c.vec_symbols.filter(F.size("embedding") == len(vector))
    return same.select("symbol_id", l2(F.col("embedding"), query).alias("distance")).orderBy("distance", "symbol_id").limit(limit)


def ranked(df: DataFrame, *order) -> DataFrame:
    """`df`, a bounded result list, with its positions from 1."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def fuse(text: DataFrame, vector: DataFrame, limit: int = 20, k: int = RRF) -> DataFrame:
    """(id, score) of two lists of (id, position) by reciprocal ranks; an absent one counts nothing."""
    both = text.select("id", F.col("position").alias("t")).join(vector.select("id", F.col("position").alias("v")), "id", "full_outer")
    part = lambda x: F.coalesce(1 / (F.lit(k) + F.col(x)), F.lit(0.0))
    return both.select("id", (part("t") + part("v")).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def hybrid(c: Catalog, query: str, vector: list[float], kinds=None, file_pattern: str | None = None, language: str | None = None, limit: int = 20) -> DataFrame:
    """Text and vector search fused, each to twice the limit. Kinds and the file pattern hold for both, the language for text alone."""
    text = ranked(search_symbols(c, query, kinds, file_pattern, language, 2 * limit), "file_path", "line", "id").select("id", "position")
    near = nearest(c, vector, 2 * limit)
    found = near.join(c.symbols.select(F.col("id").alias("symbol_id"), "kind", "file_path"), "symbol_id")
    if kinds:
        found = among(found, "kind", kinds)
    if file_pattern:
        found = found.filter(F.contains("file_path", F.lit(file_pattern)))
    found = ranked(found, "distance", "symbol_id").select(F.col("symbol_id").alias("id"), "position")
    return fuse(text, found, limit)


def embedding_text(c: Catalog) -> DataFrame:
    """(id, text) that an embedding is made of."""
    blank = lambda x: F.when(F.col(x) != "", F.col(x))
    return c.symbols.select("id", F.concat_ws("\n", "name", "kind", "file_path", blank("signature"), blank("docstring")).alias("text"))
