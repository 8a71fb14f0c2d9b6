"""Removal of long repeats, and search for repeated passages, by suffix arrays over shards.

A window is LENGTH bytes of a text; bytes of windows whose content also begins
anywhere else are removed. Of words, a window is PASSAGE of them (with the
white space between them left out), and those that also begin in another
document are passages; nothing is removed for these. Both are found alike, as
windows over units: bytes in view 0, hashes of words in view 1.

Windows that could be equal have to meet in one shard, so each goes by its key:
the smallest hash of the strings of GRAM units in it, whose last bit is the
view. Consecutive windows with one key form a run, whose units are a segment of
(in random text) some 540 bytes. A key whose string occurs once in the whole
corpus can't hold a repeat, which leaves out most of the text at the cost of a
few bytes a run. Equal segments are kept once, with their number.

The segments of a shard are joined, and sorted by `suffixes.suffix_array`;
permuted common prefixes of a window or more within a segment mark its windows.
Keys with more than HOT_BYTES of different segments (a string that very many
texts have in different surroundings) would not fit a shard: the windows of
those are counted by 128-bit hashes instead, in a plain aggregate that
combines before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .suffixes import common_prefixes, suffix_array

LENGTH = 400
GRAM = 128
#: Words of a passage, and of the strings that give its keys.
PASSAGE = 51
PASSAGE_GRAM = 8
#: The six white-space characters of ASCII.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SHARD_BYTES = 3 << 20
HOT_BYTES = 8 << 20
#: Documents that are picked by a broadcast of their 16-byte marks at most; more are joined by a shuffle.
BROADCAST_MARKS = 1_000_000
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class Powers:
    """Powers of ODD and of its inverse modulo 2^64, as many as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            steps = [np.full(size, x, np.uint64) for x in (ODD, INVERSE)]
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up[:n], self.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def _sums(units: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.of(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def gram_hashes(units: np.ndarray, gram: int, powers: Powers) -> np.ndarray:
    """A hash of each `gram` units; equal strings have equal hashes wherever they are."""
    sums, down = _sums(units, powers)
    return _mixed((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])


def word_hashes(raw: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    edges = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[raw], [True]))))
    starts, ends = edges[::2], edges[1::2]
    sums, down = _sums(raw, powers)
    return _mixed((sums[ends] - sums[starts]) * down[starts])


def units_of(view: int, raw: bytes, powers: Powers) -> np.ndarray:
    """The bytes of a text, or the hashes of its words."""
    units = np.frombuffer(raw, np.uint8)
    return word_hashes(units, powers) if view else units


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, from minima to either side within blocks."""
    n = len(h) - width + 1
    blocks = -(-len(h) // width)
    full = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(h)] = h
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(units: np.ndarray, powers: Powers, length: int, gram: int, view: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """(key, hash of the segment, start, windows, times that the key's string occurs) of each run of windows."""
    if len(units) < length:
        return
    h = gram_hashes(units, gram, powers)
    h = (h & np.uint64(0xFFFFFFFFFFFFFFFE)) | np.uint64(view)
    wide = length - gram + 1
    low = sliding_minimum(h, wide)
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    firsts, lasts = [0, *cut.tolist()], [*cut.tolist(), len(low)]
    for key, a, b in zip(low[firsts].view(np.int64).tolist(), firsts, lasts):
        times = int(np.count_nonzero(h[a : b - 1 + wide] == low[a]))
        yield key, xxhash.xxh3_64_intdigest(units[a : b - 1 + length]) - (1 << 63), a, b - a, times


def segments(docs: DataFrame, views: list[tuple[int, int]]) -> DataFrame:
    """(key, h, m1, m2, start, n, times): the runs of each text, which (m1, m2) names. docs: (m1, m2, raw); views: length and gram of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, names = Powers(), ["key", "h", "m1", "m2", "start", "n", "times"]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 3

        def batch_of(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for m1, m2, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for view, (length, gram) in enumerate(views):
                    for key, h, start, n, times in runs(units_of(view, raw.as_buffer(), powers), powers, length, gram, view):
                        for c, v in zip(columns, (key, h, m1, m2, start, n, times)):
                            c.append(v)
                if len(columns[0]) > 200_000:
                    yield batch_of(columns)
                    columns = [[] for _ in names]
            yield batch_of(columns)

    return docs.select("m1", "m2", "raw").mapInArrow(run, "key long, h long, m1 long, m2 long, start int, n int, times int")


def cut_out(docs: DataFrame, wanted: DataFrame, views: list[tuple[int, int]]) -> DataFrame:
    """(shard, key, h, owner, bytes) of the wanted segments (m1, m2, list of shard, key, h, owner, start, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for raw, parts in zip(batch.column(0), batch.column(1)):
                raw, parts = raw.as_buffer(), parts.as_py()
                units = {view: units_of(view, raw, powers) for view in {p["key"] & 1 for p in parts}}
                pieces = [units[p["key"] & 1][p["start"] : p["start"] + p["n"] - 1 + views[p["key"] & 1][0]].tobytes() for p in parts]
                names = ["shard", "key", "h", "owner"]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in parts], "int64") for k in names] + [pa.array(pieces, "binary")], [*names, "bytes"])

    return docs.join(wanted, ["m1", "m2"]).select("raw", "parts").mapInArrow(run, "shard long, key long, h long, owner long, bytes binary")


def mark(pieces: list[np.ndarray], length: int = LENGTH, owners: np.ndarray | None = None) -> list[np.ndarray]:
    """For each of the pieces, which of its windows also begin elsewhere in the pieces.

    The character between pieces occurs in none of them, so a suffix that ends
    within a window shares no window with another, and those that share one
    stand next to each other. With `owners`, one for each piece (-1: a piece of
    several documents), only windows that several documents have are marked.
    """
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    inner = np.ones(int(sizes.sum()) + len(sizes), bool)
    inner[starts + sizes] = False
    units = np.concatenate(pieces)
    if units.dtype != np.uint8:
        units = np.unique(units, return_inverse=True)[1]
    t = np.zeros(len(inner), np.uint8 if units.dtype == np.uint8 and units.all() else np.uint16 if units.dtype == np.uint8 else np.int64)
    t[inner] = units if t.dtype == np.uint8 else units.astype(t.dtype) + 1
    rest = np.repeat(starts + sizes, sizes + 1) - np.arange(len(t))
    order = suffix_array(t)
    phi, plcp = common_prefixes(t, order, starts, 2 * int(sizes.max()) + 16)
    room = rest >= length
    twice = (plcp >= length) & room & (phi >= 0)
    twice &= room[np.maximum(phi, 0)]
    if owners is None:
        found = twice.copy()
        found[phi[twice]] = True
    else:
        whose = np.repeat(owners, sizes + 1)[order]
        heads = np.flatnonzero(~twice[order])  # equal windows stand next to each other
        low, high = np.minimum.reduceat(whose, heads), np.maximum.reduceat(whose, heads)
        found = np.zeros(len(t), bool)
        found[order] = np.repeat((low != high) | (low < 0), np.diff(np.append(heads, len(t))))
    return [found[a : a + max(s - length + 1, 0)] for a, s in zip(starts.tolist(), sizes.tolist())]


def intervals(marked: np.ndarray, length: int) -> list[int]:
    """Runs of marked windows as flat (first byte, end byte) pairs, merged where they touch."""
    at = np.flatnonzero(marked)
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(at) > length) + 1
    firsts, lasts = at[np.concatenate(([0], new))], at[np.concatenate((new - 1, [len(at) - 1]))]
    return np.stack((firsts, lasts + length), axis=1).ravel().tolist()


def repeats(docs: DataFrame, scratch: common.Scratch, views: list[tuple[int, int]], shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(m1, m2, view, at): for each different text with repeated windows, (start, end) pairs of units, perhaps overlapping. docs: (m1, m2, raw)."""
    all_runs = scratch.keep(segments(docs, views), "runs")
    keys = scratch.keep(all_runs.groupBy("key").agg(F.sum("times").alias("w")).filter("w > 1").select("key"), "keys")  # written, so that a key with very many runs can be split
    found = all_runs.join(keys, "key").groupBy("key", "h", "m1", "m2", "start", "n", "times").agg(F.count("*").alias("c"))
    found = scratch.keep(found, "repeated")
    scratch.drop("runs", "keys")

    # A row for each different segment: how often it occurs, one place where its bytes are, and the text that owns it, or -1 for several documents.
    kinds = found.groupBy("key", "h").agg(F.sum("c").alias("c"), F.min(F.struct("m1", "m2", "start", "n")).alias("place"), F.max(F.struct("m1", "m2")).alias("last"), F.max("c").alias("rows"), F.max("times").alias("times"))
    several = (F.col("last") != F.struct("place.m1", "place.m2")) | (F.col("rows") > 1)
    kinds = kinds.select("key", "h", "c", "place.*", "times", F.when(several, F.lit(-1).cast("long")).otherwise(F.col("place.m1")).alias("owner"))
    view = F.col("key").bitwiseAND(F.lit(1).cast("long"))
    sized = lambda by: F.when(view == 1, by(*views[-1])).otherwise(by(*views[0]))
    units = (F.col("n") + sized(lambda length, _: F.lit(length - 1))).cast("long")
    size = units * F.when(view == 1, 8).otherwise(1)
    kinds = scratch.keep(kinds, "kinds")
    by_key = scratch.keep(kinds.groupBy("key").agg(F.sum(size).alias("key_bytes"), F.count("*").alias("kinds")), "by-key")
    alone = (F.col("kinds") == 1) & (F.col("times") == 1)  # settled without a look at the bytes: a whole repeat, or none
    whole = kinds.filter(F.when(view == 1, F.col("owner") < 0).otherwise(F.col("c") > 1)).select("key", "h", F.array(F.lit(0), units.cast("int")).alias("at"))
    sortable = kinds.join(by_key, "key").filter(~alone)
    total = sortable.agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    sortable = sortable.withColumn("shard", F.when(F.col("key_bytes") > hot_bytes, F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))).cast("long"))
    parts = sortable.groupBy("m1", "m2").agg(F.collect_list(F.struct("shard", "key", "h", "owner", "start", "n")).alias("parts"))  # a document's own runs at most
    sources = pick(docs, scratch.keep(parts.select("m1", "m2").distinct(), "sources"))
    cut = scratch.keep(cut_out(sources.dropDuplicates(["m1", "m2"]), parts, views), "cut")

    def sort(table: pa.Table) -> pa.Table:
        key, raw, owner = table.column("key").to_numpy(), table.column("bytes"), table.column("owner").to_numpy()
        out: list = [[] for _ in key]
        for view, (length, _) in enumerate(views):
            some = np.flatnonzero((key & 1) == view).tolist()
            if some:
                pieces = [np.frombuffer(raw[i].as_buffer(), np.uint64 if view else np.uint8) for i in some]
                for i, marked in zip(some, mark(pieces, length, owner[some] if view else None)):
                    out[i] = intervals(marked, length)
        return pa.table({"key": table.column("key"), "h": table.column("h"), "at": pa.array(out, pa.list_(pa.int32()))})

    marked = cut.filter("shard >= 0").groupBy("shard").applyInArrow(sort, "key long, h long, at array<int>")
    marked = scratch.keep(marked.filter(F.size("at") > 0).unionByName(whole).unionByName(hot(cut.filter("shard < 0"), views)), "marked")
    scratch.drop("cut", "by-key", "sources")
    placed = found.select("key", "h", "m1", "m2", "start").join(marked, ["key", "h"])
    return placed.select("m1", "m2", view.cast("int").alias("view"), F.transform("at", lambda x: x + F.col("start")).alias("at"))


def hot(cut: DataFrame, views: list[tuple[int, int]]) -> DataFrame:
    """(key, h, at) of segments with windows that begin twice, by counting hashes of all windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, h, owner, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "h", "owner")), batch.column("bytes")):
                view, raw = key & 1, memoryview(raw.as_buffer())
                wide = 8 if view else 1
                n = len(raw) // wide - views[view][0] + 1
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i * wide : (i + views[view][0]) * wide]) for i in range(n)), "<i8").reshape(n, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, "int64"), pa.array([h] * n, "int64"), pa.array([owner if view else -1] * n, "int64"), pa.array(np.arange(n), "int32"), pa.array(both[:, 0].copy()), pa.array((both[:, 1] & ~1) | view)],
                    ["key", "h", "owner", "i", "w1", "w2"],
                )

    each = cut.select("key", "h", "owner", "bytes").mapInArrow(windows, "key long, h long, owner long, i int, w1 long, w2 long")
    counted = each.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min("owner").alias("low"), F.max("owner").alias("high"))
    words = F.col("w2").bitwiseAND(F.lit(1).cast("long")) == 1
    twice = counted.filter(F.when(words, (F.col("low") != F.col("high")) | (F.col("low") < 0)).otherwise(F.col("c") > 1)).select("w1", "w2")
    again = each.join(twice, ["w1", "w2"]).groupBy("key", "h").agg(F.collect_list("i").alias("i"))  # one segment's windows
    length = F.when(F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1, views[-1][0]).otherwise(views[0][0])
    return again.select("key", "h", F.flatten(F.transform("i", lambda x: F.array(x, x + length))).alias("at"))


def pick(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of `docs` whose (m1, m2) are in `marks`."""
    few = marks.count() <= BROADCAST_MARKS
    return docs.join(F.broadcast(marks) if few else marks, ["m1", "m2"], "left_semi")


def addressed(docs: DataFrame) -> DataFrame:
    """`docs` with `raw`, the UTF-8 bytes of the text (null: empty), and (m1, m2), 128 bits of its SHA-256."""
    digest = F.sha2("raw", 256)
    half = lambda a: F.conv(F.substring(F.col("digest"), a, 15), 16, 10).cast("long")  # noqa: E731  60 bits each
    return docs.withColumn("raw", common.utf8(F.col("text"))).withColumn("digest", digest).withColumns({"m1": half(1), "m2": half(16)})


def _merged(at: np.ndarray) -> tuple[list[int], list[int]]:
    """First and end places of the runs that (start, end) pairs cover."""
    at = at.reshape(-1, 2)
    if not len(at):
        return [], []
    at = at[np.argsort(at[:, 0], kind="stable")]
    ends = np.maximum.accumulate(at[:, 1])
    cut = np.flatnonzero(at[1:, 0] > ends[:-1]) + 1
    return at[np.concatenate(([0], cut)), 0].tolist(), ends[np.concatenate((cut - 1, [len(at) - 1]))].tolist()


def dedup(docs: DataFrame, scratch: common.Scratch, length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM, **how) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, passages) for each row of `docs`: removed (start, end) pairs of bytes, the bytes left, and
    (start, end) pairs of words in runs of `passage` words or more that another document has too.

    Null texts are empty; texts shorter than `length`, and rows that stand
    alone, keep all; very long texts are taken whole. Rows that repeat are
    documents of their own, so all their windows are repeats, whether their ids
    are equal, null or not. An empty table gives an empty result. Other columns
    are ignored.
    """
    texts = addressed(docs.select("doc_id", "text")).drop("text")
    long = texts.filter(F.length("raw") >= min(length, 2 * passage - 1)).select("m1", "m2", "raw")
    at = repeats(long, scratch, [(length, gram), (passage, passage_gram)], **how)
    of = lambda view: F.flatten(F.collect_list(F.when(F.col("view") == view, F.col("at"))))  # noqa: E731  a text's own runs
    found = scratch.keep(at.groupBy("m1", "m2").agg(of(0).alias("at"), of(1).alias("words")), "found")
    few = scratch.keep(found.select("m1", "m2"), "touched")
    touched = pick(texts, few).join(found, ["m1", "m2"])
    marks = F.broadcast(few) if few.count() <= BROADCAST_MARKS else few
    clean = texts.join(marks, ["m1", "m2"], "left_anti")
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, passages = [], [], []
            for raw, at, words in zip(batch.column(1), batch.column(2), batch.column(3)):
                raw = raw.as_py()
                firsts, lasts = _merged(np.asarray(at.values))
                spans.append([{"start": a, "end": b} for a, b in zip(firsts, lasts)])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *lasts], [*firsts, len(raw)])))
                passages.append([{"start": a, "end": b} for a, b in zip(*_merged(np.asarray(words.values)))])
            sizes = pa.array([x.as_buffer().size for x in batch.column(1)], "int64")
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(spans, pairs), pa.array(kept, "binary"), pa.array(passages, pairs)], ["doc_id", "n_bytes", "spans", "kept", "passages"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType()), T.StructField("passages", span)])
    stripped = touched.select("doc_id", "raw", "at", "words").mapInArrow(strip, schema)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return stripped.unionByName(clean.select("doc_id", F.length("raw").cast("long").alias("n_bytes"), none.alias("spans"), F.col("raw").alias("kept"), none.alias("passages")))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of 400-byte strings that begin more than once.

    `passage_words` counts the document's words in passages of over 50 words
    that another document has too; these may be shorter than 400 bytes.
    """
    left = dedup(common.read(spark, sf_dir, "documents"), common.Scratch(spark, "op4"))
    covered = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return left.select("doc_id", "n_bytes", covered("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), covered("passages").alias("passage_words"))
