"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is sent to every executor by way of the driver; files are small for their rows, so Spark's own limit on bytes lets through many more.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it names none, a local folder, but only in a single process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def counted(side: DataFrame) -> DataFrame:
    """A side of a join whose rows are cheap to count: broadcast if they are few, else the join shuffles whatever the size of its files."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side.hint("merge")


class Store:
    """Intermediate tables of one computation; writing one cuts the lineage of what follows."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/{owner}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
