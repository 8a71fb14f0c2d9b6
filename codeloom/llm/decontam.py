"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles. An item's sketch is
the smallest hashes of its shingles, as many as its partition says (all of
them in the partition of the smallest items), so the share of a sketch that a
document holds estimates how much of the item the document contains, however
long the document is. Each partition has its own least number of sketch hashes:
the largest that an item with the wanted containment misses with a probability
below MISSED (never, where the sketch is the whole item). Larger sketches ask
for a larger share, so large items bring few false candidates. Documents that
reach it are verified by exact containment of shingles.

Only the sketches are broadcast, and only if they take less than
BROADCAST_BYTES. Beyond that their hashes are joined by a shuffle, of those
shingles of documents whose first PREFIX bits some sketch hash has; that set of
prefixes is broadcast, and has 2^PREFIX members at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
PERCENT = 80
#: Partitions of items: (largest number of shingles, hashes in a sketch).
SIZES = ((16, 16), (64, 16), (256, 24), (1024, 32), (1 << 31, 48))
MISSED = 1e-6
BROADCAST_BYTES = 32 << 20
PREFIX = 22
TOKENS = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(0)), F.array().cast("array<string>"))


def _every(n: Column, length: int, make) -> Column:
    """make(i) for each i at which `length` of n words begin."""
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), F.greatest(n - length, F.lit(0))), make)).otherwise(F.array().cast("array<long>"))


def hashes(coded: str, lengths: list[int]) -> Column:
    """Hashes of all shingles of the given lengths of a column of word hashes."""
    code, n = F.col(coded), F.size(coded)

    def of(k: int) -> Column:
        return _every(n, k, lambda i: F.xxhash64(F.lit(k), *[F.get(code, i + j) for j in range(k)]))

    parts = [of(k) for k in lengths]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def shingles(w: Column, length: Column) -> Column:
    """Distinct shingles of `length` words, as texts."""
    n = F.size(w)
    return F.when((n >= length) & (length > 0), F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - length, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, F.greatest(length, F.lit(1))), " ")))).otherwise(F.array().cast("array<string>"))


def least_hits(sketch: int, percent: int) -> int:
    """The most hashes of a sketch that an item contained by `percent` reaches but for a chance of MISSED, and one at least.

    Hashes of a sketch are drawn without replacement, which varies less than
    the binomial draws that are counted here.
    """
    p, below = percent / 100, 0.0
    for k in range(sketch + 1):
        below += math.comb(sketch, k) * p**k * (1 - p) ** (sketch - k)
        if below >= MISSED:
            return max(k, 1)
    return sketch


def _items(items: DataFrame) -> DataFrame:
    known = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    sized = known.withColumn("length", F.least(F.size("w"), F.lit(SHINGLE)))
    return sized.withColumn("shingles", shingles(F.col("w"), F.col("length"))).withColumn("n", F.size("shingles"))


def search(docs: DataFrame, items: DataFrame, percent: int = PERCENT, keys: tuple[str, ...] = ("doc_id",), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of each document that holds at least `percent` of an item's shingles.

    Items shorter than a shingle count as one shingle of their words; items
    without words, and null texts, match nothing; very long texts are searched
    whole. Rows that repeat a doc_id, and those without one, are searched each
    by its text and reported once for each id, with the largest containment.
    Empty tables give an empty result. Other columns are ignored. With other
    `keys` than doc_id these stand for it, here and in the result.
    """
    known = _items(items)
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # at most SHINGLE values
    if not lengths:
        return docs.limit(0).select(*keys, F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("n_item"), F.lit(0).alias("n_shared"), F.lit(0.0).alias("containment"))
    coded = known.withColumn("code", F.transform("w", lambda x: F.xxhash64(x)))
    own = F.array_distinct(F.coalesce(*[F.when(F.col("length") == k, hashes("code", [k])) for k in lengths]))
    by_size = lambda values: F.coalesce(*[F.when(F.col("n") <= most, v) for (most, _), v in zip(SIZES, values)])
    whole = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    least = by_size([whole if k == 0 else F.lit(least_hits(s, percent)) for k, (_, s) in enumerate(SIZES)])
    sketched = coded.select("item_id", "n", own.alias("all")).select("item_id", least.alias("least"), F.explode(F.slice(F.array_sort("all"), F.lit(1), by_size([F.lit(s) for _, s in SIZES]))).alias("hash"))
    size = sketched.agg((F.count("*") * 64).alias("b")).first()[0]

    # Rows are told apart by a hash of their text too, so that rows without an id, or with the same one, do not meet all their candidates.
    row = "__row" if "__row" not in keys else "__row_"
    rows = [*keys, row]
    texts = docs.select(*keys, "text", common.row_key("text").alias(row))
    each = (
        texts.select(*rows, words(F.col("text")).alias("w"))
        .select(*rows, F.transform("w", lambda x: F.xxhash64(x)).alias("code"))
        .select(*rows, F.explode(hashes("code", lengths)).alias("hash"))
    )
    if size <= broadcast_bytes:
        met = each.join(F.broadcast(sketched), "hash")
    else:
        prefix = F.shiftrightunsigned(F.col("hash"), 64 - PREFIX).alias("prefix")
        some = sketched.select(prefix).distinct()  # at most 2^PREFIX rows of 8 bytes
        met = each.withColumn("prefix", prefix).join(F.broadcast(some), "prefix", "left_semi").drop("prefix").join(sketched, "hash")
    found = (
        met.groupBy(*rows, "item_id", "hash").agg(F.first("least").alias("least"))
        .groupBy(*rows, "item_id").agg(F.count("*").alias("hits"), F.first("least").alias("least"))
        .filter(F.col("hits") >= F.col("least"))
        .select(*[F.col(k).alias(f"found_{k}") for k in rows], "item_id")
    )
    verified = (
        texts.join(found, [F.col(k).eqNullSafe(F.col(f"found_{k}")) for k in rows])
        .select(*keys, "item_id", words(F.col("text")).alias("w"))
        .join(known.select("item_id", "length", "shingles", F.col("n").alias("n_item")), "item_id")
        .select(*keys, "item_id", "n_item", F.size(F.array_intersect(shingles(F.col("w"), F.col("length")), "shingles")).alias("n_shared"))
        .filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    )
    return verified.groupBy(*keys, "item_id", "n_item").agg(F.max("n_shared").alias("n_shared")).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def held(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(__held, __held_row): ids, null ones too, and row keys of the texts that hold an item."""
    texts = docs.select("doc_id", "text").withColumn("__row", common.row_key("text"))
    return search(texts, items, percent, ("doc_id", "__row")).select(F.col("doc_id").alias("__held"), F.col("__row").alias("__held_row")).distinct()


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` without the rows of `held`."""
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__held")) & (common.row_key("text") == F.col("__held_row")), "left_anti")


def clean(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`docs` without those that hold an item."""
    return without(docs, held(docs, items, percent))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a test item that it contains."""
    return search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
with i as (
  select item_id, w, least(len(w), 5) as k
  from (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark) where len(w) > 0),
s as (
  select distinct item_id, k, array_to_string(w[p : p + k - 1], ' ') as g
  from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as p from i)),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
t as (
  select distinct doc_id, k, array_to_string(w[p : p + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from i) where len(w) >= k)),
n as (select item_id, count(*) as n_item from s group by 1)
select doc_id, item_id, cast(n_item as integer) as n_item, cast(count(*) as integer) as n_shared, count(*) / n_item as containment
from s join t using (k, g) join n using (item_id)
group by doc_id, item_id, n_item
having count(*) * 100 >= n_item * 80
"""
