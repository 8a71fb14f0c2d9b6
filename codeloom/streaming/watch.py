"""Incremental indexing: changes of files as a stream, batches of them as updates of a saved index.

Events are rows (path, kind, seq), kind `upsert` or `unlink`. They are debounced
(see `debounce`): a batch is a burst of changes that nothing has followed for
half a second, with the last event of each path. An index lives in buckets of
files (`buckets.BucketedIndex`), of which a batch rewrites those that it changes,
or in numbered snapshots; a batch that is run again gives the same.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..buckets import BucketedIndex
from ..catalog import Catalog
from ..config import Config
from ..extract.run import apply, scanned
from ..functions.globs import IgnoreRules
from ..sources import walk
from ..storage import Store
from .debounce import debounced, debounced_stream  # noqa: F401

EVENTS = "path string, kind string, seq long"
#: Parts that the paths of a listing are cut into.
BUCKETS = 8


class Changed(InputPartition):
    """A bucket of the paths of two versions."""

    def __init__(self, start: int, end: int, bucket: int):
        self.start, self.end, self.bucket = start, end, bucket


class TreeReader(DataSourceStreamReader):
    """Versions of a tree's listing, kept as tables; an offset is the number of one.

    A version is written when the tree differs from the one before. What two
    versions differ in is found by tasks, a bucket of paths each. Versions before a
    batch that has been committed are removed. Ignored folders are not opened.
    """

    def __init__(self, options):
        self.root, self.versions = options["path"], options["versions"].rstrip("/")
        self.rules = IgnoreRules().plus(json.loads(options.get("ignore", "[]")))
        self.gitignore = options.get("gitignore", "true") == "true"
        self.last: tuple[int, pa.Table] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"last": None}  # tasks load what they need

    def _listing(self) -> pa.Table:
        system, base = walk._open(self.root)
        todo, rows = [("", self.rules)], []
        while todo:
            folder, rules = todo.pop()
            rules, found = walk.entries(system, base, folder, rules, self.gitignore)
            todo += [(path, rules) for path, inside, _, _ in found if inside]
            rows += [(zlib.crc32(path.encode()) % BUCKETS, path, f"{modified}:{size}") for path, inside, size, modified in found if not inside]
        rows.sort()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "path": pa.array([r[1] for r in rows], pa.string()), "mark": pa.array([r[2] for r in rows], pa.string())})

    def _numbers(self) -> list[int]:
        system, base = walk._open(self.versions)
        from pyarrow import fs

        names = [e.base_name for e in system.get_file_info(fs.FileSelector(base, allow_not_found=True))]
        return sorted(int(n.removesuffix(".parquet")) for n in names if n.endswith(".parquet"))

    def _load(self, number: int, bucket: int | None = None) -> pa.Table:
        system, base = walk._open(self.versions)
        return pq.read_table(f"{base}/{number}.parquet", filesystem=system, filters=None if bucket is None else [("bucket", "=", bucket)])

    def _version(self) -> int:
        """The number of the tree as it is now."""
        if self.last is None and (known := self._numbers()):
            self.last = known[-1], self._load(known[-1])
        now = self._listing()
        if self.last is None or not now.equals(self.last[1]):
            number = (self.last[0] if self.last else 0) + 1
            system, base = walk._open(self.versions)
            system.create_dir(base)
            pq.write_table(now, f"{base}/{number}.part", filesystem=system)
            system.move(f"{base}/{number}.part", f"{base}/{number}.parquet")
            self.last = number, now
        return self.last[0]

    def initialOffset(self) -> dict:
        return {"version": self._version()}

    def latestOffset(self) -> dict:
        return {"version": self._version()}

    def partitions(self, start: dict, end: dict) -> list[Changed]:
        return [Changed(start["version"], end["version"], k) for k in range(BUCKETS)]

    def read(self, partition: Changed) -> Iterator[tuple[str, str, int]]:
        marks = lambda n: dict(zip(*(self._load(n, partition.bucket).column(c).to_pylist() for c in ("path", "mark"))))
        before, after = marks(partition.start), marks(partition.end)
        for path in sorted(before.keys() | after.keys()):
            if before.get(path) != after.get(path):
                yield path, "upsert" if path in after else "unlink", partition.end

    def commit(self, end: dict) -> None:
        system, base = walk._open(self.versions)
        for n in self._numbers():
            if n < end["version"]:
                system.delete_file(f"{base}/{n}.parquet")


class TreeSource(DataSource):
    """`spark.readStream.format("codeloom_tree").option("versions", shared_folder).load(folder)`; the tree as it is at the start is no event."""

    @classmethod
    def name(cls) -> str:
        return "codeloom_tree"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each path."""
    w = Window.partitionBy("path").orderBy(F.desc("seq"), F.desc("kind"))
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def process_batch(spark: SparkSession, c: Catalog, events: DataFrame, root: str, config: Config, now_millis: int) -> Catalog:
    """The catalog after a batch of events: only their paths are read, and unchanged contents are not parsed."""
    latest = last_events(events)
    store = Store(spark, "batch")
    only = store.keep(latest.select("path"), "paths")
    found, settings = scanned(spark, root, config, store)
    return apply(spark, found, config, c, now_millis, only, store, settings)


class Snapshots:
    """Numbered snapshots of an index under a folder; the largest number is the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = [n for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_DONE"))]
        return sorted(map(int, done))

    def current(self, below: int | None = None) -> Catalog:
        known = [n for n in self.numbers() if below is None or n < below]
        return Catalog.load(self.spark, f"{self.path}/{known[-1]}") if known else Catalog.empty(self.spark)

    def put(self, c: Catalog, number: int) -> Catalog:
        saved = c.save(f"{self.path}/{number}")
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{number}/_DONE")
        mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark, True).close()
        return saved


class Watch:
    """A running watch. What is pending when it stops is part of the checkpoint, and processed by the next watch over it."""

    def __init__(self, query: StreamingQuery):
        self.query = query

    def pending(self) -> bool:
        progress = self.query.lastProgress
        return progress is None or any(s.numRowsTotal > 0 for s in progress.stateOperators)

    def stop(self, drain: bool = False, timeout: float = 60) -> None:
        """Ends the watch after the batch that runs; with `drain`, after what is pending has been processed as well."""
        ends = time.time() + timeout
        while drain and self.query.isActive and self.pending() and time.time() < ends:
            time.sleep(0.2)
        self.query.stop()


def watch(spark: SparkSession, root: str, snapshots: Snapshots | BucketedIndex, checkpoint: str, config: Config | None = None, trigger: str = "100 milliseconds", now=None, after: Sequence[Callable[[Catalog, DataFrame], Catalog]] = ()) -> Watch:
    """Keeps an index up to date with a tree until it is stopped; batches run one at a time.

    `after` are further steps over the catalog and the changed paths (path):
    enhancement, docstrings, vectors. They run in order once for a batch.
    """
    config = config or Config()
    spark.dataSource.register(TreeSource)
    first = max(snapshots.numbers(), default=0) + 1

    def batch(events: DataFrame, number: int) -> None:
        events = events.persist()
        try:
            if events.isEmpty():
                return
            at = (now or (lambda: int(time.time() * 1000)))()
            latest = events.groupBy("path").agg(F.max_by("kind", "end").alias("kind"), F.max(F.unix_micros("end")).alias("seq"))
            made = process_batch(spark, snapshots.current(first + number), latest, root, config, at)
            paths = latest.filter("kind = 'upsert'").select("path")
            for step in after:
                made = step(made, paths)
            snapshots.put(made, first + number)
        finally:
            events.unpersist()

    stream = spark.readStream.format("codeloom_tree").option("versions", f"{checkpoint}-versions").option("ignore", json.dumps(config.ignore)).option("gitignore", str(config.use_gitignore).lower()).load(root).withColumn("ts", F.current_timestamp()).withColumn("root", F.lit(root))
    bursts = debounced_stream(stream, None)
    return Watch(bursts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start())
