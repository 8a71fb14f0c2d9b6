"""Total orders over a cluster: ranks, running sums and the row before, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Store

_LOW = (1 << 33) - 1


def sorted_rows(df: DataFrame, store: Store, name: str, *order: Column) -> DataFrame:
    """`df` sorted by range and written, with `_m`, which grows along the order, and `_p`, its partition."""
    made = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    return store.keep(made, name).withColumn("_p", F.shiftright("_m", 33))


def with_previous(rows: DataFrame, column: str) -> DataFrame:
    """`_previous`: `column` of the row before in the order of `sorted_rows`; null in the first."""
    own = Window.partitionBy("_p").orderBy("_m")
    last = rows.groupBy("_p").agg(F.max_by(column, "_m").alias("_v"))
    earlier = last.select("_p", F.lag("_v").over(Window.orderBy("_p")).alias("_v"))  # a row for each partition
    first = F.col("_m").bitwiseAND(F.lit(_LOW)) == 0
    return rows.join(F.broadcast(earlier), "_p", "left").withColumn("_previous", F.when(first, F.col("_v")).otherwise(F.lag(column).over(own))).drop("_v")


def with_running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """`name`: the sum of `value` up to and with each row, in the order of `sorted_rows`."""
    own = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_p").agg(F.sum(value).alias("_v"))
    earlier = totals.select("_p", F.coalesce(F.sum("_v").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_v"))  # a row for each partition
    return rows.join(F.broadcast(earlier), "_p", "left").withColumn(name, F.col("_v") + F.sum(value).over(own)).drop("_v")
