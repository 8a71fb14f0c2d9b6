"""Which span holds a position: an interval join by buckets of dyadic sizes.

A span of lines goes to the size class of its length, the smallest power of two
that is not shorter, and there to the one or two buckets that it touches. A
position looks in one bucket of each class that occurs in its file. So both
sides are joined by equality, a long span is not cut into many pieces, and
a position meets only spans of a class that reach into its bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from .lookup import among

#: Lines that a span may have at most, as a power of two.
CLASSES = 31


def _power(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def _class(first: Column, last: Column) -> Column:
    lines = last - first + 1
    up = F.ceil(F.log2(lines.cast("double"))).cast("int")
    # log2 of whole numbers below 2^31 is off by less than a unit at most.
    return F.when(_power(up) < lines, up + 1).otherwise(up)


def spans(symbols: DataFrame) -> DataFrame:
    """(file_path, id, first, first_column, last, last_column) of symbols; one without an end is its own line, one that ends before it begins has none."""
    last = F.coalesce("end_line", "line")
    end = F.when(F.col("end_line").isNull() | F.col("end_column").isNull(), F.lit(2_147_483_647)).otherwise(F.col("end_column"))
    out = symbols.filter("file_path is not null and line is not null").select("file_path", "id", F.col("line").alias("first"), F.coalesce("column", F.lit(0)).alias("first_column"), last.alias("last"), end.alias("last_column"))
    return out.filter("last > first or last = first and last_column >= first_column")


def containing(positions: DataFrame, held: DataFrame) -> DataFrame:
    """Every pair of a position (file_path, line, column and others) and a span of `held` (as `spans` gives them) that contains it, ends included."""
    size = _power(F.col("_class"))
    cut = held.withColumn("_class", _class(F.col("first"), F.col("last")))
    cut = cut.withColumn("_bucket", F.explode(F.array_distinct(F.array(F.floor(F.col("first") / size), F.floor(F.col("last") / size)))))
    classes = cut.select("file_path", "_class").distinct()  # CLASSES rows for a file at most
    asked = positions.filter("file_path is not null and line is not null").join(classes, "file_path").withColumn("_bucket", F.floor(F.col("line") / size))
    met = asked.join(cut, ["file_path", "_class", "_bucket"])
    at, a, b = (F.struct(F.col(x).alias("l"), F.coalesce(F.col(y), F.lit(0)).alias("c")) for x, y in (("line", "column"), ("first", "first_column"), ("last", "last_column")))
    return met.filter((a <= at) & (at <= b)).drop("_class", "_bucket")


def innermost(positions: DataFrame, held: DataFrame) -> DataFrame:
    """(position, id): the span around each position (position, file_path, line, column) that begins last; of those, the one that ends first, then by id."""
    best = F.struct((-F.col("first")).alias("a"), (-F.col("first_column")).alias("ac"), F.col("last").alias("b"), F.col("last_column").alias("bc"), "id")
    asked = positions.select("position", "file_path", "line", F.coalesce("column", F.lit(0)).alias("column"))
    # Many positions share a place, so each place is looked for once, and meets the spans around it.
    places = asked.select("file_path", "line", "column").distinct()
    met = containing(places, held).groupBy("file_path", "line", "column").agg(F.min(best).alias("best"))
    found = asked.join(met, ["file_path", "line", "column"])
    return found.groupBy("position").agg(F.min("best").alias("best")).select("position", "best.id")


def symbols_at(c: Catalog, positions: DataFrame, kinds=None) -> DataFrame:
    """(position, id) of the innermost symbol, of `kinds` if given, for positions (position, file_path, line, column)."""
    return innermost(positions, spans(among(c.symbols, "kind", kinds) if kinds else c.symbols))


def types_at(c: Catalog, positions: DataFrame, hovers: DataFrame | None = None) -> DataFrame:
    """(position, id, type) at positions: what `hovers` (position, type) says, else the signature of the innermost symbol, or its name and type.

    A position in no symbol has neither id nor type, unless a hover gives one.
    """
    text = F.coalesce("signature", F.when(F.col("return_type").isNotNull(), F.concat_ws(": ", "name", "return_type")), F.concat_ws(" ", "kind", "name"))
    own = symbols_at(c, positions).join(c.symbols.select("id", text.alias("type")), "id")
    out = positions.select("position").join(own, "position", "left")
    if hovers is not None:
        out = out.join(hovers.select("position", F.col("type").alias("_hover")), "position", "left").withColumn("type", F.coalesce("_hover", "type"))
    return out.select("position", "id", "type")
