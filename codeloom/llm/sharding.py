"""Two-pass external shuffle of a corpus into shards.

Pass one scatters records by a seeded hash into buckets that fit in memory;
pass two gathers a bucket, permutes it with Fisher-Yates and gives its records
the next positions of one global order. A shard is a range of positions, so
shard sizes differ by one row at most, and a bucket is written to one or two
shard files.

A record's place follows from the records, the seed and the size of a bucket
alone, not from how the input is partitioned or in which order rows arrive:
a bucket is a partition of its own, its records are put in order of a second
hash, and the permutation draws from a generator seeded with the seed plus the
bucket's number. Equal records, of which one could have very many, are counted
first (which combines before the shuffle) and numbered, and the number is
part of their hash, so they scatter like all others.

Texts cross the network once, those of equal records in small part twice. Only
bucket counts are gathered to find where a bucket's positions begin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHARDS = 16
SEED = 20_240_601
#: Bytes of text that one bucket holds on average: BUCKET_BYTES, or more where there would be over MANY buckets, up to LARGE_BYTES.
#: A task has its bucket in memory twice.
BUCKET_BYTES, LARGE_BYTES, MANY = 16 << 20, 128 << 20, 1 << 16
#: Largest number of buckets whose start positions are broadcast (16 bytes each).
BROADCAST_BUCKETS = 1_000_000
#: Keys of records that occur more than once (16 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Equal records that one task numbers at a time.
CHUNK = 4096


def size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def keyed(docs: DataFrame, scratch: common.Scratch, seed: int) -> DataFrame:
    """(key, record): the rows of `docs` as structs, each with a 64-bit key of its own even if it equals another."""
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    names = [F.col(f"`{c}`") for c in plain]
    rows = docs.select(F.xxhash64(F.lit(seed), *names, *[n.isNull() for n in names]).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    again = scratch.keep(rows.groupBy("key").count().filter("count > 1").select("key"), "again")
    number = again.count()
    if not number:
        return rows
    few = F.broadcast(again) if number <= BROADCAST_KEYS else again
    counted = rows.join(few, "key", "left_semi").groupBy("key", "record").agg(F.count("*").alias("n"))
    chunks = counted.select("key", "record", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK).cast("int"))).alias("chunk")).repartition("key", "chunk")
    first = F.col("chunk").cast("long") * CHUNK
    numbered = chunks.select("key", "record", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("n")) - 1)).alias("i"))
    return rows.join(few, "key", "left_anti").unionByName(numbered.select(F.xxhash64("key", "i").alias("key"), "record"))


def shard(docs: DataFrame, scratch: common.Scratch, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Columns of `docs` as struct `record`, with `shard` (int) and `slot` (long, gapless from 0 in each shard).

    Null ids and texts, equal rows, ties of ids and an empty table are allowed:
    each row gets a slot of its own. A very long text makes its bucket as much
    larger. Other columns are carried along whatever their names.
    """
    total, rows = docs.agg(F.sum(size(F.col("text"))), F.count("*")).first()
    total = total or 0
    buckets = max(1, math.ceil(total / min(max(bucket_bytes, total // MANY), max(bucket_bytes, LARGE_BYTES))))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(buckets)).cast("int")
    dealt = keyed(docs, scratch, seed).select(bucket.alias("bucket"), F.struct(F.xxhash64(F.lit(seed + 1), "key").alias("h"), "record").alias("row"))

    counts = dealt.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if buckets <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)

    def by_hash(a, b):
        return F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)

    # The generator of a partition starts from the seed plus the partition's number, which is the bucket's.
    gathered = (
        dealt.repartitionById(buckets, "bucket")
        .groupBy("bucket")
        .agg(F.collect_list("row").alias("rows"))
        .select("bucket", F.shuffle(F.array_sort("rows", by_hash), F.lit(seed)).alias("rows"))
    )
    position, short, long = F.col("start") + F.col("at"), rows // n_shards, rows % n_shards
    bound = long * (short + 1)  # the first `long` shards have a row more
    after = position - bound
    return (
        gathered.join(starts, "bucket")
        .select("start", F.posexplode("rows").alias("at", "row"))
        .select(
            F.when(position < bound, F.floor(position / (short + 1))).otherwise(long + F.floor(after / max(short, 1))).cast("int").alias("shard"),
            F.when(position < bound, position % (short + 1)).otherwise(after % max(short, 1)).cast("long").alias("slot"),
            F.col("row.record").alias("record"),
        )
    )


def write_shards(docs: DataFrame, scratch: common.Scratch, path: str, **how) -> None:
    """Writes `docs` under `path`, a folder per shard, with `slot` as the order of records."""
    shard(docs, scratch, **how).write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by the law `rows`, from the shard files as written."""
    scratch = common.Scratch(spark, "op2")
    path = f"{scratch.at}/shards"
    docs = common.read(spark, sf_dir, "documents")
    write_shards(docs, scratch, path)
    schema = docs.select(F.lit(0).cast("long").alias("slot"), F.struct(*docs.columns).alias("record"), F.lit(0).alias("shard")).schema
    written = spark.read.schema(schema).parquet(path)
    text = F.col("record.text")
    return written.select(
        F.col("record.doc_id").alias("doc_id"),
        size(text).alias("size"),
        F.crc32(common.utf8(text)).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
