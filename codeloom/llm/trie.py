"""Prefix trie of conversations: sorted turn arrays, adjacent LCPs, a stack sweep.

A conversation becomes the array of its turns' hashes (128 bits of a SHA-256
over role and text). Arrays are sorted over the whole cluster by range; then
each trie node is an interval of rows, and a task finds its nodes in one pass:
the longest common prefix (LCP) of a row with the one before says how many open
nodes end there and how many begin. All counts of a subtree are sums over its
interval: leaves are rows that the next row does not extend, and the bytes that
sharing saves are sums over adjacent rows of the bytes of their common prefix.
So what a task knows of nodes that reach over its ends are plain sums, which
are added up by node afterwards ("stitched"), once the driver has compared the
first and the last row of each partition.

Nothing depends on how large a group is. Turns are numbered by a global sort,
not by conversation. Arrays are cut into segments of SEGMENT turns: below a
segment, a conversation goes on in the sub-trie that is named after the hash of
all its turns so far. Sub-tries of one conversation need no sweep, those of
several are swept level by level from the deepest. Ids of the members of a
node are hashed as a stream; those of a group that spans partitions are sent
as joined pieces, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Turns of a segment, and bytes of a turn's hash.
SEGMENT, HASH = 512, 16
#: Conversations of one group take their first turns from its first one; a hash modulo HEADS says how many.
FAMILY, HEADS = 5, 9
#: Member ids in a piece of a group that spans partitions, and rows that leave a task together.
PIECE, ROWS = 4096, 8192
#: Names of nodes at the ends of partitions that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
EMPTY = hashlib.sha256(b"").hexdigest()

#: Kinds of rows that a sweep gives: nodes with their parent, nodes whose parent reaches over the partition's end, parts of such nodes, pieces of member ids, and one row about the partition.
NODE, CHILD, PART, IDS, ENDS = range(5)
SWEPT = [
    ("kind", "int", pa.int32()), ("p", "int", pa.int32()), ("left", "boolean", pa.bool_()), ("right", "boolean", pa.bool_()), ("depth", "int", pa.int32()),
    ("conv_id", "long", pa.int64()), ("parent", "long", pa.int64()), ("parent_left", "boolean", pa.bool_()), ("n", "long", pa.int64()), ("children", "long", pa.int64()),
    ("leaves", "long", pa.int64()), ("saved", "long", pa.int64()), ("shared", "long", pa.int64()), ("above", "long", pa.int64()), ("sha", "string", pa.string()), ("root", "binary", pa.binary()),
    ("seq", "long", pa.int64()), ("ids", "string", pa.string()), ("key", "binary", pa.binary()), ("last_root", "binary", pa.binary()), ("last_key", "binary", pa.binary()), ("sizes", "array<long>", pa.list_(pa.int64())),
]
SWEPT_DDL = ", ".join(f"{n} {t}" for n, t, _ in SWEPT)
NAMES = [n for n, _, _ in SWEPT]


def numbered(conversations: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(conv_id, place, key, bytes): the turns of each conversation, numbered from 0 in order of `turn`, null first, then of their hash."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * HASH)
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, last, ahead = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(0).to_numpy()
            new = np.r_[last is None or c[0] != last, c[1:] != c[:-1]]
            at = np.arange(len(c))
            start = np.maximum.accumulate(np.where(new, at, -ahead))
            place = at - start
            last, ahead = c[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(c), p, np.int32)), pa.array(place), batch.column(2), batch.column(3)], names=["conv_id", "p", "place", "key", "bytes"])

    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "key", "bytes")
    turns = scratch.keep(turns.mapInArrow(count, "conv_id long, p int, place long, key string, bytes long"), "numbered")
    ahead = Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    earlier = turns.groupBy("conv_id", "p").agg(F.count("*").alias("n")).select("conv_id", "p", F.sum("n").over(ahead).alias("earlier")).filter("earlier > 0")
    moved = turns.join(F.broadcast(earlier), ["conv_id", "p"], "left")  # only the first conversation of a partition can have earlier turns
    return moved.select("conv_id", (F.col("place") + F.coalesce("earlier", F.lit(0))).alias("place"), "key", "bytes")


def pieces(turns: DataFrame, segment: int) -> DataFrame:
    """(conv_id, piece, turns): up to `segment` turns of a conversation at a time."""
    listed = F.array_sort(F.collect_list(F.struct("place", "key", "bytes")))
    by = turns.groupBy("conv_id", F.floor(F.col("place") / segment).alias("piece")).agg(listed.alias("turns"))
    return by.withColumn("turns", F.transform("turns", lambda x: F.struct(x["key"].alias("key"), x["bytes"].alias("bytes"))))


def rebuilt(parts: DataFrame, segment: int) -> DataFrame:
    """(conv_id, seg, at, turns): pieces of the rebuilt conversations by the segment that they belong to; one of segment 0 for each conversation."""
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    heads = parts.filter((F.col("piece") == 0) & (base == F.col("conv_id"))).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    none = F.lit(None).cast(parts.schema["turns"].dataType)
    own = parts.withColumn("base", base).join(heads, "base", "left").withColumn("h", h).withColumn("head", F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h")))
    shift = F.col("h") - F.size("head")  # a short head draws later turns nearer
    part = lambda seg, at, turns: F.struct(seg.cast("long").alias("seg"), at.cast("int").alias("at"), turns.alias("turns"))
    first = part(F.lit(0), F.lit(0), F.concat("head", F.slice("turns", F.col("h") + 1, F.lit(segment))))
    rest = F.slice("turns", F.col("shift") + 1, F.lit(segment))
    later = F.array(part(F.col("piece") - 1, segment - F.col("shift"), F.when(F.col("shift") > 0, F.slice("turns", F.lit(1), F.col("shift"))).otherwise(none)), part(F.col("piece"), F.lit(0), rest))
    cut = own.withColumn("shift", shift).select("conv_id", F.when(F.col("piece") == 0, F.array(first)).otherwise(later).alias("cut"))
    return cut.select("conv_id", F.inline("cut")).filter("seg = 0 and at = 0 or size(turns) > 0")


def _joined(turns: str):
    return F.unhex(F.array_join(F.transform(turns, lambda x: x["key"]), "")).alias("keys"), F.transform(turns, lambda x: x["bytes"]).alias("sizes")


def _chain(segment: int):
    """From (conv_id, seg, size, digest) in order: the hash of what a segment follows, and whether the conversation ends in it; an empty segment after a last full one."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, root = None, b""

        def out(rows):
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.bool_()))]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "seg", "root", "ends"])

        def settled(following: bool):
            c, seg, size, digest, root = held
            yield c, seg, root, not following
            if size == segment and not following:
                yield c, seg + 1, hashlib.sha256(root + digest).digest(), True

        for batch in batches:
            rows = []
            for c, seg, size, digest in zip(*(col.to_pylist() for col in batch.columns)):
                more = held is not None and held[0] == c
                if held is not None:
                    rows += settled(more)
                root = hashlib.sha256(held[4] + held[3]).digest() if more else b""
                held = (c, seg, size, digest, root)
            yield out(rows)
        if held is not None:
            yield out(list(settled(False)))

    return chain


def segments(parts: DataFrame, scratch: common.Scratch, segment: int) -> tuple[DataFrame, DataFrame | None]:
    """(conv_id, seg, root, keys, sizes, ends) of segment 0 and, where any conversation fills it, of later segments."""
    cut = scratch.keep(rebuilt(parts, segment), "cut")
    full = cut.filter(f"seg = 0 and at = 0 and size(turns) >= {segment - HEADS}").select("conv_id")
    if full.isEmpty():
        return cut.select("conv_id", F.lit(0).cast("long").alias("seg"), F.lit(b"").alias("root"), *_joined("turns"), F.lit(True).alias("ends")), None
    short = cut.join(full.distinct(), "conv_id", "left_anti")
    whole = cut.join(full.distinct(), "conv_id").groupBy("conv_id", "seg").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "turns"))), lambda x: x["turns"])).alias("turns"))
    whole = scratch.keep(whole.select("conv_id", "seg", *_joined("turns")), "whole")
    light = whole.select("conv_id", "seg", F.size("sizes").alias("size"), F.unhex(F.sha2("keys", 256)).alias("digest")).repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    chain = light.mapInArrow(_chain(segment), "conv_id long, seg long, root binary, ends boolean")
    named = scratch.keep(chain.join(whole, ["conv_id", "seg"], "left").select("conv_id", "seg", "root", F.coalesce("keys", F.lit(b"")).alias("keys"), F.coalesce("sizes", F.array().cast("array<long>")).alias("sizes"), "ends"), "named")
    first = short.select("conv_id", F.lit(0).cast("long").alias("seg"), F.lit(b"").alias("root"), *_joined("turns"), F.lit(True).alias("ends")).unionByName(named.filter("seg = 0"))
    return first, named.filter("seg > 0")


class _Node:
    """What is known of an open node: members, the smallest, children, leaves, bytes of common prefixes and of deeper segments, and bytes above it."""

    __slots__ = ("n", "least", "children", "leaves", "shared", "deeper", "above", "sha", "kids", "left")

    def __init__(self, above: int, left: bool):
        self.n, self.least, self.children, self.leaves, self.shared, self.deeper, self.above, self.sha, self.kids, self.left = 0, None, 0, 0, 0, 0, above, None, [], left

    def take(self, other: _Node) -> None:
        self.n += other.n
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.leaves += other.leaves
        self.shared += other.shared
        self.deeper += other.deeper


def common_turns(a: bytes, b: bytes) -> int:
    """Equal leading hashes of two arrays."""
    n = min(len(a), len(b)) // HASH
    if a[: n * HASH] == b[: n * HASH]:
        return n
    d = 0
    while a[d * HASH : (d + 1) * HASH] == b[d * HASH : (d + 1) * HASH]:
        d += 1
    return d


class _Sweep:
    """One pass over sorted rows of a partition."""

    def __init__(self, p: int, piece: int):
        self.piece = piece
        self.p, self.stack, self.rows, self.seq, self.run = p, [], [], 0, 0
        self.first = self.last = None
        self.through = 0

    def put(self, kind: int, **values) -> None:
        self.rows.append((kind, self.p, values))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())]
        columns += [pa.array([r[2].get(n) for r in rows], t) for n, _, t in SWEPT[2:]]
        return pa.RecordBatch.from_arrays(columns, names=NAMES)

    def row(self, root: bytes, key: bytes, sizes: list[int], c: int, ends: bool, below: tuple[int, int, int] | None) -> None:
        upto = [0]
        for size in sizes:
            upto.append(upto[-1] + size)
        same, lcp = False, -1
        if self.first is None:
            self.first, self.through = (root, key, upto), len(sizes)
        else:
            if root == self.last[0]:
                same = key == self.last[1]
                lcp = common_turns(key, self.last[1])
            self.through = min(self.through, lcp)
            if not same:
                self.end_run(lcp)
        if not same:
            self.close(lcp)
            self.begin_run()
        if lcp >= 0:
            self.stack[lcp].shared += upto[lcp]
        left = self.last is None
        for d in range(lcp + 1, len(sizes) + 1):
            if d and not left:
                self.stack[-1].children += 1  # those at the left end are counted when it is known whether they begin here
            self.stack.append(_Node(upto[d - 1] if d else 0, left))
        top = self.stack[-1]
        top.n += 1
        top.least = c if top.least is None else min(top.least, c)
        if ends:
            self.member(str(c))
        self.last = (root, key, below or (1, 0, 0), len(sizes))

    def begin_run(self) -> None:
        self.run, self.pending, self.hash, self.first_run = self.run + 1, [], None, self.last is None

    def member(self, c: str) -> None:
        self.pending.append(c)
        if len(self.pending) == self.piece:
            self.send()

    def send(self) -> None:
        """Sends what is pending as a piece, and hashes it here as well. Pieces count where the run turns out to be a partition's first or last, the hash elsewhere."""
        if self.pending:
            ids = ",".join(self.pending)
            self.put(IDS, left=self.stack[-1].left, depth=len(self.stack) - 1, n=self.run, seq=self.seq, ids=ids)
            self.seq, self.pending = self.seq + 1, []
            if self.hash is None:
                self.hash = hashlib.sha256(ids.encode())
            else:
                self.hash.update(b"," + ids.encode())

    def end_run(self, lcp: int) -> None:
        """The run of equal rows before this one is over: its member ids, and whether it is a leaf."""
        depth, top = self.last[3], self.stack[-1]
        if self.first_run or self.hash is not None:
            self.send()
            top.sha = None if self.first_run else self.hash.hexdigest()
        elif self.pending:
            top.sha = hashlib.sha256(",".join(self.pending).encode()).hexdigest()
        if lcp < depth:
            leaves, deeper, children = self.last[2]
            top.leaves, top.deeper, top.children = top.leaves + leaves, top.deeper + deeper, top.children + children

    def part(self, node: _Node, depth: int, right: bool) -> None:
        above = self.stack[-1].left if self.stack else None
        root = (self.last[0] if right else self.first[0]) if depth == 0 else None
        self.put(PART, left=node.left, right=right, depth=depth, conv_id=node.least, parent_left=above, n=node.n, children=node.children, leaves=node.leaves, saved=node.deeper, shared=node.shared, above=node.above, sha=node.sha, root=root)

    def close(self, lcp: int) -> None:
        while len(self.stack) - 1 > lcp:
            node = self.stack.pop()
            depth, parent = len(self.stack), self.stack[-1] if self.stack else None
            if parent is not None:
                parent.take(node)
            if node.left:
                self.part(node, depth, False)
                continue
            for kid in node.kids:
                self.put(NODE, parent=node.least, **kid)
            found = dict(depth=depth, conv_id=node.least, n=node.n, children=node.children, leaves=node.leaves, saved=node.shared - (node.n - 1) * node.above + node.deeper, sha=node.sha)
            if parent is None:
                self.put(NODE, root=self.last[0], **found)
            elif parent.left:
                self.put(CHILD, parent_left=True, **found)
            else:
                parent.kids.append(found)

    def finish(self) -> None:
        if self.last is None:
            return
        self.send()
        depth = self.last[3]
        while self.stack:
            node = self.stack.pop()
            if self.stack:
                self.stack[-1].take(node)
            self.part(node, len(self.stack), True)
            for kid in node.kids:
                self.put(CHILD, parent_left=False, **kid)
        leaves, deeper, children = self.last[2]
        self.put(ENDS, root=self.first[0], key=self.first[1], sizes=self.first[2], last_root=self.last[0], last_key=self.last[1], depth=depth, n=self.through, seq=self.run, leaves=leaves, saved=deeper, children=children)


def _swept(piece: int):
    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep(TaskContext.get().partitionId(), piece)
        for batch in batches:
            for root, key, sizes, c, ends, leaves, deeper, children in zip(*(col.to_pylist() for col in batch.columns)):
                sweep.row(root, key, sizes, c, ends, None if leaves is None else (leaves, deeper, children))
                if len(sweep.rows) >= ROWS:
                    yield sweep.batch()
        sweep.finish()
        yield sweep.batch()

    return swept


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each (op, oleft, depth), which come in order."""
    at, digest = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.bool_()), pa.array([at[2]], pa.int32()), pa.array([digest.hexdigest()])], names=["op", "oleft", "depth", "hashed"])
    for batch in batches:
        for op, oleft, depth, ids in zip(*(col.to_pylist() for col in batch.columns)):
            if (op, oleft, depth) != at:
                if at is not None:
                    yield out()
                at, digest = (op, oleft, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if at is not None:
        yield out()


def ends(rows) -> tuple[list, list]:
    """From the ENDS rows: what each partition's end nodes lack, and which node in which earlier partition those at its left end belong to."""
    rows = sorted(rows, key=lambda r: r.p)
    cuts = [-1] + [common_turns(bytes(a.last_key), bytes(b.key)) if bytes(a.last_root) == bytes(b.root) else -1 for a, b in zip(rows, rows[1:])] + [-1]
    lacks, owner, before = [], [], {}
    for k, r in enumerate(rows):
        cut, first = cuts[k], len(r.key) // HASH
        own = {d: before[d] if d <= cut else (r.p, True) for d in range(first + 1)}
        owner += [(r.p, True, d, *o) for d, o in own.items()]
        before = {d: own[d] if d <= r.n else (r.p, False) for d in range(r.depth + 1)}
        leaf = cuts[k + 1] < r.depth
        lacks.append((r.p, cut, r.sizes[cut] if cut > 0 else 0, first, r.depth, r.seq, r.leaves if leaf else 0, r.saved if leaf else 0, r.children if leaf else 0))
    return lacks, owner


def sweep(rows: DataFrame, scratch: common.Scratch, name: str, piece: int = PIECE) -> DataFrame:
    """Nodes (depth, conv_id, parent, n, children, leaves, saved, sha, root) of the sub-tries of (root, keys, sizes, conv_id, ends, leaves, deeper, children)."""
    spark, order = scratch.spark, ["root", "keys", "conv_id"]
    ordered = rows.select("root", "keys", "sizes", "conv_id", "ends", "leaves", "deeper", "children").repartitionByRange(*order).sortWithinPartitions(*order)
    swept = scratch.keep(ordered.mapInArrow(_swept(piece), SWEPT_DDL), f"{name}-swept")
    lacks, owner = ends(swept.filter(f"kind = {ENDS}").select("p", "root", "key", "sizes", "last_root", "last_key", "depth", "n", "seq", "leaves", "saved", "children").collect())  # a row for each partition
    lack = spark.createDataFrame(lacks, "p int, cut int, bytes long, first int, last int, run long, leaves_ long, deeper_ long, children_ long")
    owners = spark.createDataFrame(owner, "p int, left boolean, depth int, op int, oleft boolean")  # at most SEGMENT + 1 for each partition
    owned = lambda df: df.join(F.broadcast(owners), ["p", "left", "depth"], "left").withColumn("op", F.coalesce("op", "p")).withColumn("oleft", F.coalesce("oleft", "left"))

    parts = owned(swept.filter(f"kind = {PART}").drop("ids", "seq", "key", "last_root", "last_key", "sizes")).join(F.broadcast(lack), "p")
    zero = lambda cond, value: F.when(cond, value).otherwise(F.lit(0))
    new = zero(F.col("left") & (F.col("depth") >= F.col("cut")) & (F.col("depth") < F.col("first")), F.lit(1))
    stitched = (
        parts.groupBy("op", "oleft", "depth")
        .agg(
            F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.max("above").alias("above"), F.min_by("parent_left", "p").alias("parent_left"), F.max("root").alias("root"), F.max("sha").alias("sha"),
            F.sum(F.col("children") + new + zero(F.col("right") & (F.col("depth") == F.col("last")), F.col("children_"))).alias("children"),
            F.sum(F.col("leaves") + zero(F.col("right"), F.col("leaves_"))).alias("leaves"),
            F.sum(F.col("saved") + zero(F.col("right"), F.col("deeper_"))).alias("deeper"),
            F.sum(F.col("shared") + zero(F.col("left") & (F.col("depth") <= F.col("cut")), F.col("bytes"))).alias("shared"),
        )
        .withColumn("saved", F.col("shared") - (F.col("n") - 1) * F.col("above") + F.col("deeper"))
    )
    stitched = scratch.keep(stitched, f"{name}-stitched")
    return _named(swept, stitched, lack, owned, scratch, name)


def _named(swept: DataFrame, stitched: DataFrame, lack: DataFrame, owned, scratch: common.Scratch, name: str) -> DataFrame:
    small = lambda df: F.broadcast(df) if stitched.count() <= BROADCAST_ROWS else df
    shown = ["depth", "conv_id", "parent", "n", "children", "leaves", "saved", "sha", "root"]
    outer = swept.filter(f"kind = {IDS}").select("p", "left", "depth", "n", "seq", "ids").join(F.broadcast(lack.select("p", "run")), "p").filter("n = 1 or n = run")
    by = ["op", "oleft", "depth"]
    hashed = owned(outer).repartition(*by).sortWithinPartitions(*by, "p", "seq").select(*by, "ids").mapInArrow(_hashed, "op int, oleft boolean, depth int, hashed string")
    names = swept.filter(f"kind = {PART}").select("p", "left", "depth").distinct()
    names = owned(names).join(small(stitched.select(*by, F.col("conv_id").alias("named"))), by).select("p", F.col("left").alias("parent_left"), (F.col("depth") + 1).alias("depth"), "named")
    names = scratch.keep(names, f"{name}-names")
    upward = lambda df: df.join(small(names), ["p", "parent_left", "depth"], "left").withColumn("parent", F.col("named"))
    edge = stitched.join(hashed, by, "left").withColumn("sha", F.coalesce("hashed", "sha")).withColumn("p", F.col("op"))
    return (
        swept.filter(f"kind = {NODE}").select(*shown)
        .unionByName(upward(swept.filter(f"kind = {CHILD}").drop("parent")).select(*shown))
        .unionByName(upward(edge).select(*shown))
        .withColumn("sha", F.coalesce("sha", F.lit(EMPTY)))
    )


def trie(conversations: DataFrame, scratch: common.Scratch, segment: int = SEGMENT, piece: int = PIECE) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id belong to no conversation. Null roles and texts are
    empty. Turns of equal number are in the order of their hash, repeated rows
    are turns of their own. Negative ids belong to the family of the next lower
    multiple of five. An empty table has no conversation, and so not even a
    root. Other columns are ignored, whatever their names.
    """
    parts = scratch.keep(pieces(numbered(conversations.select("conv_id", "turn", "role", "text"), scratch), segment), "pieces")
    first, later = segments(parts, scratch, segment)
    none = [F.lit(None).cast("long").alias(c) for c in ("leaves", "deeper", "children")]

    def shown(df: DataFrame, seg: int) -> DataFrame:
        named = (("parent", "parent_conv_id"), ("n", "n_convs"), ("children", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens"))
        return df.select("conv_id", (F.col("depth") + seg * segment).cast("long").alias("depth"), *[F.col(c).cast("long").alias(n) for c, n in named], F.col("sha").alias("ends_sha256"))

    if later is None:
        return shown(sweep(first.select("*", *none), scratch, "s0", piece), 0)

    groups = scratch.keep(later.groupBy("seg", "root").agg(F.count("*").alias("n")), "groups")
    alone = later.join(groups.filter("n = 1").drop("n"), ["seg", "root"])
    size = F.size("sizes")
    last = F.col("i") == size
    chains = alone.filter(size > 0).select("conv_id", "seg", "sizes", "ends", F.explode(F.sequence(F.lit(1), size)).alias("i")).select(
        "conv_id", (F.col("seg") * segment + F.col("i")).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last & F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last & F.col("ends"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    below = alone.select("seg", "root", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("deeper"), (size > 0).cast("long").alias("children"))
    shared = scratch.keep(later.join(groups.filter("n > 1").drop("n"), ["seg", "root"]), "shared")
    following = later.select("conv_id", (F.col("seg") - 1).alias("seg"), F.col("root").alias("next_root"))
    found, roots = [chains], None
    deepest = shared.agg(F.max("seg")).first()[0] or 0
    for seg in range(deepest, -1, -1):  # as many rounds as segments that several conversations share
        rows = (first if seg == 0 else shared.filter(F.col("seg") == seg)).join(following.filter(F.col("seg") == seg).drop("seg"), "conv_id", "left")
        weights = below.filter(F.col("seg") == seg + 1).select(F.col("root").alias("next_root"), "leaves", "deeper", "children")
        weights = weights if roots is None else weights.unionByName(roots)
        nodes = scratch.keep(sweep(rows.join(weights, "next_root", "left"), scratch, f"s{seg}", piece), f"nodes{seg}")
        found.append(shown(nodes.filter("depth > 0") if seg else nodes, seg))
        roots = nodes.filter("depth = 0").select(F.col("root").alias("next_root"), "leaves", F.col("saved").alias("deeper"), "children")
    result = found[0]
    for df in found[1:]:
        result = result.unionByName(df)
    return result


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of all conversations."""
    return trie(common.read(spark, sf_dir, "conversations"), common.Scratch(spark, "op11"))
