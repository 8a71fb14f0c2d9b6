"""An index whose tables lie in buckets of files, so that a batch rewrites the buckets that it changes.

Every row belongs to a file, and a file to the bucket of its path's hash. A
manifest has the number of rows and a checksum of each table's buckets; `put`
compares a new catalog with it, overwrites the partitions that differ, removes
those that are empty now, and then writes its own manifest. The table of files
comes last: until then its hashes say that the changed files have not been
taken in, so a batch that was cut off is simply run again, and gives the same.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .catalog import Catalog
from .storage import Store

BUCKETS = 64
#: The partition column; the table's own columns have no such name.
BUCKET = "file_bucket"
#: Tables in the order in which they are written.
ORDER = (*[f.name for f in fields(Catalog) if f.name != "files"], "files")
MANIFEST = "tab string, file_bucket int, n long, checksum long, more long"


def _owner(c: Catalog, name: str) -> DataFrame:
    """The table with `_path`, the file that a row belongs to; where none is known, its id stands in."""
    df = getattr(c, name)
    if name == "files":
        return df.withColumn("_path", F.col("path"))
    if name == "call_sites":
        return df.withColumn("_path", F.col("caller_file_path"))
    if name == "call_edges":
        sites = c.call_sites.groupBy(F.col("id").alias("call_site_id")).agg(F.min("caller_file_path").alias("_file"))
        return df.join(sites, "call_site_id", "left").withColumn("_path", F.coalesce("_file", "id")).select(*df.columns, "_path")
    if name == "vec_symbols":
        symbols = c.symbols.groupBy(F.col("id").alias("symbol_id")).agg(F.min("file_path").alias("_file"))
        return df.join(symbols, "symbol_id", "left").withColumn("_path", F.coalesce("_file", "symbol_id")).select(*df.columns, "_path")
    return df.withColumn("_path", F.col("id" if name == "tool_usage" else "file_path"))


class BucketedIndex:
    """Tables and manifests under a folder. There is one version of a table; a reader that loads during `put` may see some tables before and some after."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, at: str) -> bool:
        fs, path = self._fs(at)
        return fs.exists(path)

    def numbers(self) -> list[int]:
        """Batches taken in, in order."""
        fs, path = self._fs(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit() and self._exists(f"{self.path}/manifest/{n}/_SUCCESS"))

    def current(self, below: int | None = None) -> Catalog:
        """The tables as they are; `below` is for callers that number batches, and changes nothing."""
        tables = {}
        for name, s in schema.TABLES.items():
            at = f"{self.path}/{name}"
            tables[name] = self.spark.read.schema(s).parquet(at).select(*s.names) if self._exists(at) else self.spark.createDataFrame([], s)
        return Catalog(**tables)

    def manifest(self, below: int | None = None) -> DataFrame:
        known = [n for n in self.numbers() if below is None or n < below]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{known[-1]}") if known else self.spark.createDataFrame([], MANIFEST)

    def put(self, c: Catalog, number: int) -> Catalog:
        """Takes in `c` as batch `number`; doing so again changes nothing. Tables of `c` may read the index itself."""
        store = Store(self.spark, "buckets")
        stamped, sums = {}, None
        for name in ORDER:
            bucket = F.pmod(F.xxhash64("_path"), F.lit(self.buckets)).cast("int")
            stamped[name] = store.keep(_owner(c, name).withColumn(BUCKET, bucket).drop("_path"), name)
            row = F.xxhash64(*schema.TABLES[name].names)
            own = stamped[name].groupBy(F.lit(name).alias("tab"), BUCKET).agg(F.count("*").alias("n"), F.bit_xor(row).alias("checksum"), F.sum(F.shiftright(row, 24)).alias("more"))
            sums = own if sums is None else sums.unionByName(own)
        sums = store.keep(sums, "manifest")  # a row for each table and bucket
        before = self.manifest(number + 1)
        key = ["tab", BUCKET]
        changed = sums.join(before, sums.columns, "left_anti").select(*key).collect()
        gone = before.join(sums, key, "left_anti").select(*key).collect()
        for name in ORDER:
            these = [r[BUCKET] for r in changed if r.tab == name]
            if these:
                part = stamped[name].filter(F.col(BUCKET).isin(these)).repartition(BUCKET)
                part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/{name}")
            for r in gone:
                if r.tab == name:
                    fs, path = self._fs(f"{self.path}/{name}/{BUCKET}={r[BUCKET]}")
                    fs.delete(path, True)
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        return self.current()
