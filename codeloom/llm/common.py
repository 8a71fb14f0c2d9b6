"""Tables, shared scratch space and text conventions of the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that removes a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names, or in a single process (tests) a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no more than its own tasks.

    `keep` writes a DataFrame and reads it back, which also cuts its lineage;
    the shuffle files of that write are removed with its end. `drop` deletes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/{owner}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*columns: str) -> Column:
    """A hash of columns, nulls told apart, by which rows that share an id, or have none, are matched."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; null is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def unit(hashed: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return F.pmod(hashed, F.lit(1 << 40)) / F.lit(float(1 << 40))
