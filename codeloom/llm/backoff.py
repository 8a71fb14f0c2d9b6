"""Stupid-backoff language-model scores, computed as joins with hash-partitioned count tables.

The model is the corpus itself, less the document that is scored: all counts
are over all other documents. With order 3, a word w after u v scores

    c(u v w) / c(u v)    where the three occur elsewhere,
    ALPHA * S(w | v)     else, with S(w | v) = c(v w) / c(v) where the pair occurs,
                         and ALPHA * S(w) else, with S(w) = c(w) / N, or ALPHA / N for an unseen word,

and so on for other orders. The start mark stands before a first word; words
have no more history than that.

Texts are first written as blocks of about BLOCK words: a dictionary of word
hashes and the words as places in it. Blocks are exploded into rows (gram,
block, n), one for each distinct n-gram of a block, so a frequent n-gram is a
row a block, and rows grow as the corpus. These rows, partitioned by the
n-gram's hash, are summed to the count table of n-grams that several blocks
have, and joined with it; a block gets its counts back, subtracts what each
document has itself, and sums by document. This is done for RANGES ranges of
the hashes one after the other, which bounds what is on disk at a time.
N-grams of order 3 and more are exploded only where both n-grams in them, one
word shorter, occur in other documents: all others occur in none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .repeats import Powers, word_hashes
from .tokens import pack, unpack

ALPHA = 0.4
#: Orders of the registered query; any can be asked for.
ORDER = 2
BLOCK = 1 << 20
#: Bytes of text for each partition of the count tables, or more where there would be over MANY.
PART_BYTES, MANY = 8 << 20, 1 << 16
#: Ranges of hashes, for orders 1 and 2 and for each higher order.
RANGES, MORE_RANGES = 4, 2
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
START = np.uint64(xxhash.xxh3_64_intdigest(b" start of text "))
BLOCKS = "block long, n_words long, n_docs long, words binary, data binary"
#: What is counted of a block: totals of its distinct n-grams by order and range, in order of their hashes; or, with range -1, a
#: bit for each token, whether the n-gram that ends there occurs in other documents.
TOTALS = "block long, order int, range int, totals binary"


def blocks(docs: DataFrame, size: int) -> DataFrame:
    """The texts of (doc_id, text) as rows of BLOCKS: distinct word hashes, frequent ones first, and the documents' words as places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        powers, first, made = Powers(), TaskContext.get().partitionId() << 32, 0
        docs, lengths, held, total = [], [], [], 0

        def row():
            words, places, number = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_inverse=True, return_counts=True)
            by = np.argsort(-number, kind="stable")
            rank = np.empty(len(by), "<u4")
            rank[by] = np.arange(len(by))
            data = pack(rank[places], docs, lengths)
            return pa.RecordBatch.from_pydict({"block": [first + made], "n_words": [total], "n_docs": [len(docs)], "words": pa.array([words[by].tobytes()], "binary"), "data": pa.array([data], "binary")})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
                words = word_hashes(np.frombuffer(raw, np.uint8), powers)
                held.append(words)
                docs.append(doc)
                lengths.append(len(words))
                total += len(words)
                if total >= size:
                    yield row()
                    docs, lengths, held, total, made = [], [], [], 0, made + 1
        if docs:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


class Block:
    """The tokens of a block, and what is known of their n-grams."""

    def __init__(self, words: pa.Scalar, data: pa.Scalar, known: pa.Scalar | None):
        self.words = np.frombuffer(words.as_buffer(), "<u8")
        places, self.ids, lengths = unpack(data.as_py())
        self.places, self.lengths = places.astype(np.int64), lengths.astype(np.int64)
        self.starts = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        self.hashes: list[np.ndarray] = []
        self.known = {} if known is None or not known.is_valid else {(x["order"], x["range"]): x["totals"] for x in known.as_py()}

    @cached_property
    def doc(self) -> np.ndarray:
        """Each token's document."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    @cached_property
    def at(self) -> np.ndarray:
        """Each token's place in its document."""
        return np.arange(len(self.places)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def hash(self, order: int) -> np.ndarray:
        """A hash of the n-gram that ends at each token; START stands before a first word."""
        while len(self.hashes) < order:
            current = self.words[self.places]
            if self.hashes:
                before = np.empty_like(current)
                before[1:] = self.hashes[-1][:-1]
                before[self.starts] = START
                h = (before * MIX[0]) ^ current
                h ^= h >> np.uint64(32)
                h *= MIX[1]
                current = h ^ (h >> np.uint64(29))
            self.hashes.append(current)
        return self.hashes[order - 1]

    def tokens(self, order: int) -> np.ndarray:
        """Where n-grams end that could occur in other documents."""
        if order < 3:
            return np.arange(len(self.places))
        shorter = np.unpackbits(np.frombuffer(self.known[order - 1, -1], np.uint8), count=len(self.places)).astype(bool)
        some = (self.at >= order - 2) & shorter
        some[1:] &= shorter[:-1]
        return np.flatnonzero(some)

    def grams(self, order: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct hashes of such n-grams, of one of `parts` ranges, and their numbers."""
        h = self.words if order == 1 else self.hash(order) if order == 2 else self.hash(order)[self.tokens(order)]
        low, high = (-(-(k << 64) // parts) for k in (part, part + 1))
        some = h >= np.uint64(low)
        if high < 1 << 64:
            some &= h < np.uint64(high)
        if order > 1:
            return np.unique(h[some], return_counts=True)
        here = np.flatnonzero(some)
        here = here[np.argsort(h[here])]
        return h[here], np.bincount(self.places, minlength=len(h))[here]

    def others(self, order: int) -> np.ndarray:
        """For each token: how often the n-gram that ends there occurs in other documents."""
        tokens = self.tokens(order)
        expand = zstandard.ZstdDecompressor().decompress
        totals = np.frombuffer(b"".join(expand(self.known[k]) for k in sorted(self.known) if k[0] == order and k[1] >= 0), "<i8")
        if order == 1:
            by = np.argsort(self.words)
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            index = rank[self.places]
        else:
            index = np.unique(self.hash(order)[tokens], return_inverse=True)[1]
        _, place, own = np.unique(self.doc[tokens] * max(len(totals), 1) + index, return_inverse=True, return_counts=True)
        other = np.zeros(len(self.places), np.int64)
        other[tokens] = totals[index] - own[place]
        return other

    def scores(self, orders: int, n_words: int, n_docs: int) -> np.ndarray:
        """The sum of log scores of each document."""
        rest = np.maximum(n_words - self.lengths[self.doc], 1).astype(float)
        shorter = self.others(1)
        score = np.where(shorter > 0, shorter, ALPHA) / rest
        for order in range(2, orders + 1):
            other = self.others(order)
            context = np.ones(len(other), np.int64)
            context[1:] = shorter[:-1]
            if order == 2:
                context[self.at == 0] = n_docs - 1
            score = np.where(other > 0, other / np.maximum(context, 1), np.where(self.at >= order - 2, ALPHA, 1.0) * score)
            shorter = other
        return np.bincount(self.doc, np.log(score), len(self.lengths))


def each_block(table: DataFrame, make, schema: str) -> DataFrame:
    """Batches of make(block, its name) for the rows (block, words, data, known) of `table`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, words, data, known in zip(*(batch.column(k) for k in range(4))):
                yield from make(Block(words, data, known), name.as_py())

    return table.select("block", "words", "data", "known").mapInArrow(run, schema)


def grams_of(table: DataFrame, orders: tuple[int, ...], part: int, parts: int) -> DataFrame:
    """(block, grams, numbers): the distinct n-grams of each block in a range of hashes, a row for each order."""

    def make(block: Block, name: int) -> Iterator[pa.RecordBatch]:
        for order in orders:
            grams, number = block.grams(order, part, parts)
            yield pa.RecordBatch.from_pydict({"block": [name], "grams": pa.array([grams.view(np.int64)], pa.list_(pa.int64())), "numbers": pa.array([number], pa.list_(pa.int32()))})

    return each_block(table, make, "block long, grams array<long>, numbers array<int>")


def counted(grams: DataFrame, parts: int) -> DataFrame:
    """(block, gram, more): n-grams of each block that another block has too, with their numbers in all others.

    The n-grams are exploded and dealt by hash once, and both summed to a count
    table and joined with it, partition by partition. Both sides read the same
    columns, so that they share one exchange.
    """
    each = grams.select("block", "numbers", F.posexplode("grams").alias("at", "gram")).select("gram", "block", F.get("numbers", F.col("at")).alias("n"))
    dealt = each.repartition(parts, "gram")
    table = dealt.groupBy("gram").agg(F.sum("n").alias("total"), F.min("block").alias("first"), F.max("block").alias("last")).filter("first < last").select("gram", "total")
    return dealt.join(table.hint("shuffle_hash"), "gram").select("block", "gram", (F.col("total") - F.col("n")).alias("more"))


def totals(found: DataFrame, table: DataFrame, orders: tuple[int, ...], part: int, parts: int) -> DataFrame:
    """TOTALS of a range: the block's own numbers, with those of (block, gram, more) added."""

    def take(found: pa.Table, own: pa.Table) -> pa.Table:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        block = Block(*(own.column(k)[0] for k in ("words", "data", "known")))
        hashed, more, out = found.column("gram").to_numpy().view(np.uint64), found.column("more").to_numpy(), []
        for k in orders:
            grams, number = block.grams(k, part, parts)
            number = number.astype("<i8")
            if len(grams):
                at = np.minimum(np.searchsorted(grams, hashed), len(grams) - 1)
                here = grams[at] == hashed
                number[at[here]] += more[here]
            out.append(squeeze(number.tobytes()))
        n = len(orders)
        return pa.table({"block": pa.array([own.column("block")[0].as_py()] * n, "int64"), "order": pa.array(orders, "int32"), "range": pa.array([part] * n, "int32"), "totals": pa.array(out, "binary")})

    own = table.select("block", "words", "data", "known")
    return found.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(take, TOTALS)  # a block's own n-grams


def scores(docs: DataFrame, scratch: common.Scratch, order: int = ORDER, block: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, log_score, per_word) for each row of (doc_id, text).

    Words are as in the near-duplicate operator: split at ASCII white space,
    A-Z lower-cased. Texts without words, null ones too, score 0 with a null
    `per_word`. Rows that repeat, or have no id, are documents of their own,
    and a very long text is a block of its own. An empty table gives an empty
    result. Other columns are ignored.
    """
    bare = scratch.keep(blocks(docs, block), "blocks")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(-(-size // part_bytes), MANY))
    n_words, n_docs = bare.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()

    def known(rows: DataFrame | None) -> DataFrame:
        """Blocks with what is counted of them, a few rows each."""
        if rows is None:
            return bare.withColumn("known", F.lit(None).cast("array<struct<order:int,range:int,totals:binary>>"))
        return bare.join(rows.groupBy("block").agg(F.collect_list(F.struct("order", "range", "totals")).alias("known")), "block", "left")

    rows, table = None, known(None)
    for orders in [tuple(range(1, min(order, 2) + 1)), *((k,) for k in range(3, order + 1))]:
        ranges = RANGES if orders[0] == 1 else MORE_RANGES
        masks = rows.filter("range < 0") if rows is not None else None
        table = known(masks)
        for part in range(ranges):
            name = f"{orders[-1]}-{part}"
            grams = scratch.keep(grams_of(table, orders, part, ranges), f"grams-{name}")
            got = scratch.keep(totals(counted(grams, parts), table, orders, part, ranges), f"totals-{name}")
            scratch.drop(f"grams-{name}")
            rows = got if rows is None else rows.unionByName(got)
        if orders[-1] >= 2 and orders[-1] < order:

            def mask(block: Block, name: int, last=orders[-1]) -> Iterator[pa.RecordBatch]:
                bits = np.packbits(block.others(last) > 0).tobytes()
                yield pa.RecordBatch.from_pydict({"block": [name], "order": pa.array([last], "int32"), "range": pa.array([-1], "int32"), "totals": pa.array([bits], "binary")})

            rows = rows.unionByName(scratch.keep(each_block(known(rows), mask, TOTALS), f"mask-{orders[-1]}"))

    def score(block: Block, name: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(block.ids, "int64"), "n_words": pa.array(block.lengths), "log_score": pa.array(block.scores(order, n_words, n_docs))})

    scored = each_block(known(rows), score, "doc_id long, n_words long, log_score double")
    return scored.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the counts of all others, by words and pairs."""
    found = scores(common.read(spark, sf_dir, "documents"), common.Scratch(spark, "op5"))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("per_word", 6).alias("per_word"))
