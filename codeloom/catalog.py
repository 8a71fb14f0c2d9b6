"""The tables of one index as DataFrames, with the ways to change them.

A catalog is immutable: a change returns a new catalog whose tables are plans
over the old ones. `save` writes a snapshot, `load` reads one.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from . import schema


@dataclass(frozen=True)
class Catalog:
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    call_sites: DataFrame
    call_edges: DataFrame
    exceptions: DataFrame
    env_vars: DataFrame
    tool_usage: DataFrame
    vec_symbols: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        return cls(**{name: spark.createDataFrame([], s) for name, s in schema.TABLES.items()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        return cls(**{name: spark.read.schema(s).parquet(f"{path}/{name}") for name, s in schema.TABLES.items()})

    def save(self, path: str) -> Catalog:
        """Writes all tables under `path`, which must not be the folder that they are read from."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")
        return Catalog.load(self.spark, path)

    def with_(self, **tables: DataFrame) -> Catalog:
        return replace(self, **tables)

    def views(self, prefix: str = "") -> None:
        """Makes the tables queryable by name in SQL."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(prefix + f.name)
