"""Near-duplicate texts by SetSketch registers.

A text's set of word shingles is sketched by REGISTERS registers: register j
is the minimum of an exponential hash of the set, on a scale with ratio BASE
(a truncated logarithm), so that equal registers are as likely as the sets are
alike, and sketches of parts merge by maxima. Texts meet where all ROWS
registers of a band agree. A pair that meets goes on if its sizes allow the
wanted similarity and the joint maximum-likelihood estimate from how often one
register is above, below or equal to the other is at least MARGIN below it
(almost five standard errors); then the full sets decide.

Texts with equal sets are one node from the start. Within a bucket the others
are first held against the bucket's smallest node. Once these links have
merged the nodes, only pairs of a bucket that are still in different
components are left. All of them are tried, in tasks that hold a block or two
of nodes and give back no more than the links that join components. Nodes are
dealt to these tasks by the clusters that mixed buckets form, or where a
cluster is very large by the buckets themselves. In a cluster, nodes of its
largest component only meet those outside of it, so a large group of copies is
sent once for each block of nodes that the links did not reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
PERCENT = 80
ROWS, BANDS = 4, 24
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.05, 20.0, 0x7FFE
MARGIN = 20
REMEMBERED = 200_000
#: Nodes in a block of a tile, and bytes of their sets; nodes of a cluster that is not taken apart into its buckets; bytes of sets for each task of small clusters.
TILE, TILE_BYTES, LARGE, TOGETHER = 2048, 16 << 20, 1 << 15, 16 << 20
#: Ids that are broadcast at most, where texts are picked by id; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rows of a few numbers (up to 40 bytes) that are broadcast at most, and rows with registers (some 230 bytes).
BROADCAST_ROWS, BROADCAST_SKETCHES = 1_000_000, 200_000
_RNG = np.random.Generator(np.random.PCG64(20240607))
FACTORS = _RNG.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, k: int, known: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of k words, A-Z lower-cased; fewer words count as one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > REMEMBERED:
        known.clear()
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    acc = np.full(len(codes) - k + 1, k, np.uint64)
    for j in range(k):
        acc = (acc ^ codes[j : len(codes) - k + 1 + j]) * MIX[0]
        acc ^= acc >> np.uint64(32)
    acc *= MIX[1]
    acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def registers(hashed: np.ndarray) -> np.ndarray:
    """The sketch of a set, as BANDS integers that each pack ROWS registers of 16 bits."""
    low = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashed), 1024):
        np.minimum(low, (hashed[at : at + 1024, None] * FACTORS[None, :] + SHIFTS).min(axis=0), out=low)
    least = -np.log1p(-((low >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
    values = np.clip(np.floor(1 - np.log(least / RATE) / math.log(BASE)), 0, TOP).astype(np.uint64).reshape(BANDS, ROWS)
    return np.bitwise_or.reduce(values << (np.arange(ROWS, dtype=np.uint64) * np.uint64(16)), axis=1).view(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, mark, bands) of (doc_id, text): set size, 128-bit hash of the set, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            sizes, marks, bands = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k, known)
                sizes.append(len(s))
                marks.append(xxhash.xxh3_128_digest(s))
                bands.append(registers(s) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, "int64"), pa.array(marks, "binary"), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "mark", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, mark binary, bands array<long>")


def alike(percent: int) -> Column:
    """Whether the likelihood estimate of the similarity of bands_a (n_a) and bands_b (n_b) is `percent` or more.

    The likelihood is concave, so its slope at that similarity tells.
    """
    t, c, log_b = percent / 100, (BASE - 1) / BASE, math.log(BASE)

    def above(x: str, y: str) -> Column:
        def four(p, q):
            part = lambda v, j: F.shiftrightunsigned(v, 16 * j).bitwiseAND(F.lit(0xFFFF).cast("long"))
            total = (part(p, 0) > part(q, 0)).cast("int")
            for j in range(1, ROWS):
                total = total + (part(p, j) > part(q, j)).cast("int")
            return total

        return F.aggregate(F.zip_with(x, y, four), F.lit(0), lambda s, v: s + v).cast("double")

    more, less = above("bands_a", "bands_b"), above("bands_b", "bands_a")
    u, v = F.col("n_a") / (F.col("n_a") + F.col("n_b")), F.col("n_b") / (F.col("n_a") + F.col("n_b"))
    x1, x2 = u - v * t, v - u * t
    p = lambda x: -F.log(1 - c * x) / log_b
    d = lambda x: F.lit(c / log_b) / (1 - c * x)
    slope = -more * v * d(x1) / p(x1) - less * u * d(x2) / p(x2) + (REGISTERS - more - less) * (v * d(x1) + u * d(x2)) / (1 - p(x1) - p(x2))
    return slope >= 0


def small(df: DataFrame, most: int) -> DataFrame:
    """`df`, which is already written, as a broadcast side if it has no more than `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def near_sizes(percent: int) -> Column:
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def likely(more: np.ndarray, less: np.ndarray, n_a: int, n_b: np.ndarray, percent: int) -> np.ndarray:
    """As `alike`, from how often registers of a are above (more) or below (less) those of b."""
    t, c, log_b = percent / 100, (BASE - 1) / BASE, math.log(BASE)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    x1, x2 = u - v * t, v - u * t
    p1, p2, d1, d2 = -np.log(1 - c * x1) / log_b, -np.log(1 - c * x2) / log_b, c / log_b / (1 - c * x1), c / log_b / (1 - c * x2)
    return -more * v * d1 / p1 - less * u * d2 / p2 + (REGISTERS - more - less) * (v * d1 + u * d2) / (1 - p1 - p2) >= 0


def sets_of(scratch: common.Scratch, docs: DataFrame, ids: DataFrame, k: int, name: str) -> DataFrame:
    """(id, set) of the documents in `ids` (doc_id), with its other columns, written."""
    more = [f"{c} {t}" for c, t in ids.dtypes if c != "doc_id"]
    wide = any(t.startswith("array") for _, t in ids.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py(), k, known).tobytes() for t in batch.column(1)], "binary")
            yield pa.RecordBatch.from_arrays([batch.column(0), sets, *batch.columns[2:]], ["id", "set", *batch.schema.names[2:]])

    picked = docs.select("doc_id", "text").join(small(ids, BROADCAST_SKETCHES if wide else BROADCAST_IDS), "doc_id")
    return scratch.keep(picked.mapInArrow(run, ", ".join(["id long", "set binary", *more])), name)


def linked(scratch: common.Scratch, docs: DataFrame, pairs: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    ends = pairs.select(F.col("a").alias("doc_id"), F.lit(1).alias("role")).unionByName(pairs.select(F.col("b").alias("doc_id"), F.lit(2).alias("role")))
    ids = scratch.keep(ends.groupBy("doc_id").agg(F.bit_or("role").cast("int").alias("role")), f"{name}-ids")
    found = sets_of(scratch, docs, ids, k, f"{name}-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(p) + len(q) - len(np.unique(np.concatenate((p, q))))
                keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, "bool"))

    side = lambda x, role: found.filter(F.col("role").bitwiseAND(role) > 0).select(F.col("id").alias(x), F.col("set").alias(f"set_{x}"))
    full = side("b", 2).join(small(pairs.select("a", "b"), BROADCAST_ROWS), "b").join(side("a", 1), "a")
    out = scratch.keep(full.select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-ids", f"{name}-sets")
    return out


def joining_links(comp: np.ndarray, side: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], band: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of components that links join, of the nodes of a tile; side 2 marks nodes that are held against all, 0 and 1 against each other.

    Pairs count if they meet in some band; or, with band >= 0, first in that one.
    """
    _, label = np.unique(comp, return_inverse=True)
    n = np.array([len(s) for s in sets])
    registers_ = bands.view(np.uint16).reshape(len(comp), REGISTERS)
    out, common_ = [], int(np.bincount(label).argmax())
    todo = np.flatnonzero(label != common_)
    done = np.zeros(len(comp), bool)
    for x in todo.tolist():
        done[x] = True
        same = bands == bands[x]
        ok = same.any(axis=1) & (label != label[x]) & ~done & (np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * percent)
        ok &= (side == 2) | (side != side[x])
        if band >= 0:
            ok &= same.argmax(axis=1) == band
        ys = np.flatnonzero(ok)
        if not len(ys):
            continue
        mine, theirs = registers_[x], registers_[ys]
        ys = ys[likely((mine > theirs).sum(axis=1), (mine < theirs).sum(axis=1), int(n[x]), n[ys], percent - MARGIN)]
        if not len(ys):
            continue
        values = np.concatenate([sets[y] for y in ys])
        at = np.minimum(np.searchsorted(sets[x], values), n[x] - 1)
        both = np.add.reduceat((sets[x][at] == values).astype(np.int64), np.cumsum(n[ys]) - n[ys])
        for y in ys[100 * both >= percent * (n[x] + n[ys] - both)].tolist():
            if label[x] != label[y]:
                out.append((int(comp[x]), int(comp[y])))
                label[label == label[y]] = label[x]
    return out


def settle(scratch: common.Scratch, docs: DataFrame, mixed: DataFrame, size: DataFrame, k: int, percent: int, large: int = LARGE, tile: int = TILE) -> DataFrame:
    """(a, b): links between the components of buckets with more than one. mixed: (band, key, id, n, comp), size: (id, n, bands)."""
    mixed = scratch.keep(mixed, "mixed")
    heads = scratch.keep(mixed.groupBy("band", "key").agg(F.min("id").alias("b")), "heads")
    cluster = scratch.keep(components(scratch, mixed.join(small(heads, BROADCAST_ROWS), ["band", "key"]).select(F.col("id").alias("a"), "b").distinct(), "cc-cluster-"), "cluster")
    sizes = scratch.keep(cluster.groupBy("component").agg(F.count("*").alias("c")), "cluster-sizes")
    sized = cluster.join(small(sizes, BROADCAST_ROWS), "component")
    of = mixed.select("id", "n", "comp").distinct()
    whole = sized.filter(F.col("c") <= large).select("id", F.col("component").alias("grp"), F.lit(-1).alias("band")).join(of, "id")
    apart = mixed.join(sized.filter(F.col("c") > large).select("id"), "id").select("id", F.xxhash64("band", "key").alias("grp"), "band", "n", "comp")
    members = scratch.keep(whole.unionByName(apart), "members")

    # Blocks of the nodes in a group's largest component (core) come after those of the others; a group that fits in one block has no core.
    bytes_ = (F.sum("n") * 8 + F.count("*") * 200).alias("bytes")
    parts = scratch.keep(members.groupBy("grp", "band", "comp").agg(F.count("*").alias("c"), bytes_), "parts")
    blocks = lambda c, b: F.ceil(F.greatest(c / tile, b / TILE_BYTES)).cast("int")
    most = F.max(F.struct("c", "comp", "bytes"))
    groups = parts.groupBy("grp", "band").agg(most.alias("core"), F.sum("c").alias("c"), F.sum("bytes").alias("bytes"))
    one = blocks(F.col("c"), F.col("bytes")) == 1
    groups = groups.select(
        "grp", "band", F.when(~one, F.col("core.comp")).alias("core"),
        F.when(one, 1).otherwise(F.greatest(blocks(F.col("c") - F.col("core.c"), F.col("bytes") - F.col("core.bytes")), F.lit(1))).alias("rest"),
        F.when(one, 0).otherwise(blocks(F.col("core.c"), F.col("core.bytes"))).alias("cores"),
    )
    groups = scratch.keep(groups, "groups")
    placed = members.join(small(groups, BROADCAST_ROWS), ["grp", "band"]).withColumn("in_core", F.coalesce(F.col("comp") == F.col("core"), F.lit(False)))
    dealt = F.pmod(F.xxhash64("id", F.lit(5)), F.when(F.col("in_core"), F.col("cores")).otherwise(F.col("rest")).cast("long")).cast("int")
    placed = placed.withColumn("blk", dealt + F.when(F.col("in_core"), F.col("rest")).otherwise(0))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") + F.when(F.col("in_core"), 0).otherwise(F.col("cores")) - 1)))
    bins = max(1, -(-(parts.agg(F.sum("bytes")).first()[0] or 0) // TOGETHER))
    low, high = F.least("blk", "other"), F.greatest("blk", "other")
    dealt = dealt.select(
        "id", "grp", "band", low.alias("lo"), high.alias("hi"),
        F.when(F.col("blk") == F.col("other"), 2).when(F.col("blk") == low, 0).otherwise(1).alias("side"),
        F.when(F.col("rest") + F.col("cores") == 1, F.pmod(F.xxhash64("grp"), F.lit(bins))).otherwise(F.xxhash64("grp", "band", low, high)).alias("tile"),
    )
    comp = scratch.keep(mixed.select("id", "comp").distinct(), "comp")
    ids = scratch.keep(size.join(small(comp, BROADCAST_ROWS), "id").select(F.col("id").alias("doc_id"), "comp", "bands"), "rest-ids")
    sets = sets_of(scratch, docs, ids, k, "rest-sets")
    full = sets.join(small(scratch.keep(dealt, "dealt"), BROADCAST_ROWS), "id")

    def run(table: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        group = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("grp", "band", "lo", "hi")], axis=1)
        order = np.lexsort((table.column("id").to_numpy(), *group.T[::-1]))
        group = group[order]
        cut = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        comp, side = (table.column(c).to_numpy() for c in ("comp", "side"))
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(comp), BANDS)
        raw = table.column("set")
        for part in np.split(order, cut):
            sets = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in part.tolist()]
            found += joining_links(comp[part], side[part], np.ascontiguousarray(bands[part]), sets, table.column("band")[int(part[0])].as_py(), percent)
        return pa.table({"a": pa.array([x for x, _ in found], "int64"), "b": pa.array([y for _, y in found], "int64")})

    links = full.select("tile", "grp", "band", "lo", "hi", "side", "id", "comp", "bands", "set").groupBy("tile").applyInArrow(run, "a long, b long")
    out = scratch.keep(links, "rest-links")
    scratch.drop("mixed", "heads", "cluster", "cluster-sizes", "members", "parts", "groups", "comp", "rest-ids", "rest-sets", "dealt")
    return out


def near_duplicates(docs: DataFrame, scratch: common.Scratch, k: int = WORDS, percent: int = PERCENT, large: int = LARGE, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`.

    Texts without words, and null ids, are alone. Of rows that repeat a doc_id,
    each gets the component of its own text; ties go to the smallest id. Very
    long texts are compared whole. Extra columns are ignored; an empty table
    gives an empty result.
    """
    known = scratch.keep(sketches(docs, k), "sketches")
    usable = known.filter("n > 0 and doc_id is not null")
    nodes = scratch.keep(usable.groupBy("mark").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")

    met = nodes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    crowded = scratch.keep(met.groupBy("band", "key").agg(F.min("id").alias("head"), F.count("*").alias("c")).filter("c > 1").drop("c"), "crowded")
    crowd = scratch.keep(met.join(small(crowded, BROADCAST_ROWS), ["band", "key"]), "crowd")  # only nodes that meet another

    size = nodes.select("id", "n", "bands")
    side = lambda x: size.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}"))
    stars = scratch.keep(crowd.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "met")
    stars = side("a").join(small(stars, BROADCAST_ROWS), "a").join(side("b"), "b").filter(near_sizes(percent) & alike(percent - MARGIN)).select("a", "b")
    stars = scratch.keep(stars, "stars")
    links = linked(scratch, docs, stars, k, percent, "star")
    whole = scratch.keep(components(scratch, links, "cc-star-"), "whole")

    placed = crowd.join(small(whole, BROADCAST_ROWS).withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    placed = scratch.keep(placed.select("band", "key", "id", "n", "comp"), "placed")
    split = scratch.keep(placed.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band", "key"), "split")
    more = settle(scratch, docs, placed.join(small(split, BROADCAST_ROWS), ["band", "key"]), size, k, percent, large, tile)
    scratch.drop("crowded", "crowd", "met", "stars", "placed", "split")
    heads = nodes.select("mark", "id").join(small(whole, BROADCAST_ROWS), "id", "left").select("mark", F.coalesce("component", "id").alias("component_id"))
    if not more.isEmpty():  # links between components
        joined = scratch.keep(components(scratch, more, "cc-rest-"), "joined")
        heads = heads.join(small(joined, BROADCAST_ROWS).withColumnRenamed("id", "component_id"), "component_id", "left").select("mark", F.coalesce("component", "component_id").alias("component_id"))

    solo = F.col("n").eqNullSafe(0) | F.col("doc_id").isNull()
    joined = known.filter(~solo).select("doc_id", "n", "mark").join(heads, "mark").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(known.filter(solo).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents on sets of two-word shingles."""
    found = near_duplicates(common.read(spark, sf_dir, "documents"), common.Scratch(spark, "op9"), k=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
