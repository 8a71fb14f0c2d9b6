"""Token ids of a corpus in a bit-plane file format.

Documents are sorted by id across partitions; each partition encodes its
texts and packs the ids of about SEGMENT ids into one segment, which is one
binary record of a Parquet file (so Spark's committer handles lost and
repeated tasks, on any file system). Layout of a segment, little-endian:

    magic "BPS1" | mode u8 (1 byte planes, 2 bit planes) | width u8 (planes a block)
    | block u32 (ids a block) | n_ids u64 | n_docs u32 | blocks u32
    | size of packed document table u32 | document table (zstd): id i64, null u8, ids u32 of each
    | chunk index: size u32 of each plane of each block | planes, each compressed with zstd

A plane holds byte k (or bit k) of all ids of a block. Segments start
anywhere, so a reader can seek to a segment, then by the index to a block.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

END = 0
BLOCK = 1 << 16
SEGMENT = 1 << 20
#: Bytes of text that one task encodes: PART_BYTES, or more where there would be over MANY tasks, up to LARGE_BYTES.
PART_BYTES, LARGE_BYTES, MANY = 16 << 20, 512 << 20, 1 << 15
#: Pieces whose ids a worker remembers, of late and from before; others are encoded anew.
REMEMBERED = 300_000
#: Rows that a task sends to its worker at once, and Spark's setting for it: a worker and its executor hold one such batch.
BATCH, BATCHES = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The letters, digits and marks for which the splitting below equals the tokenizer's own.
LETTERS = "a-zA-Z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
MARKS = "\\x21-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e\\xa1\\xab\\xbb\\xbf\\u2013\\u2014\\u2018-\\u201e\\u2026"
PIECE = re.compile(rf" ?[{LETTERS}]+|'(?:[sdmt]|ll|ve|re)| ?[0-9]+| ?[{MARKS}]+|\s+(?!\S)|\s+")
OTHER = re.compile(rf"[^\t\n\r {LETTERS}0-9{MARKS}]")
#: The Latin-1 characters that OTHER does not find.
PLAIN = bytes(b for b in range(256) if not OTHER.search(chr(b)))
HEAD = struct.Struct("<4sBBIQIII")


class Encoder(dict):
    """Ids of whole texts as the tokenizer gives them.

    Byte-pair merges never cross the pieces that the tokenizer first splits a
    text into, so the ids of a piece are worked out by the tokenizer once and
    remembered. A text with a character for which the splitting here could
    differ goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece) or array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        try:
            other = text.encode("latin-1").translate(None, PLAIN)
        except UnicodeEncodeError:
            other = OTHER.search(text)
        if other or "<|" in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, PIECE.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, which later tasks of the worker use again."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Frees the pieces of the worker's encoders, which would otherwise be held as long as it lives; tokenizers, slow to load, stay."""
    for encoder in _ENCODERS.values():
        encoder.clear()
        encoder.before.clear()


def pack(ids: np.ndarray, docs: list[int | None], lengths: list[int], block: int = BLOCK, bits: bool = False) -> bytes:
    """A segment of `ids` (u32), whose documents have `lengths` ids each."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    count = len(ids)
    high = int(ids.max()) if count else 0
    width = max(1, high.bit_length()) if bits else max(1, -(-high.bit_length() // 8))
    blocks, sizes, planes = -(-count // block), [], []
    for k in range(blocks):
        part = np.ascontiguousarray(ids[k * block : (k + 1) * block], "<u4")
        raw = part.view("u1").reshape(-1, 4)
        for w in range(width):
            plane = np.packbits((part >> np.uint32(w)) & np.uint32(1)) if bits else raw[:, w]
            planes.append(squeeze(np.ascontiguousarray(plane).tobytes()))
            sizes.append(len(planes[-1]))
    table = np.array([x or 0 for x in docs], "<i8").tobytes() + np.array([x is None for x in docs], "u1").tobytes() + np.array(lengths, "<u4").tobytes()
    table = squeeze(table)
    head = HEAD.pack(b"BPS1", 2 if bits else 1, width, block, count, len(docs), blocks, len(table))
    return b"".join((head, table, np.array(sizes, "<u4").tobytes(), *planes))


def unpack(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """(ids, documents, lengths) of a segment."""
    expand = zstandard.ZstdDecompressor().decompress
    magic, mode, width, block, count, n_docs, blocks, size = HEAD.unpack_from(data)
    if magic != b"BPS1":
        raise ValueError("not a segment")
    at = HEAD.size + size
    table = expand(data[HEAD.size : at])
    docs, null, lengths = np.frombuffer(table, "<i8", n_docs), np.frombuffer(table, "u1", n_docs, 8 * n_docs), np.frombuffer(table, "<u4", n_docs, 9 * n_docs)
    sizes = np.frombuffer(data, "<u4", blocks * width, at)
    at += sizes.nbytes
    ids = np.zeros(count, "<u4")
    for k in range(blocks):
        part = ids[k * block : (k + 1) * block]
        raw = part.view("u1").reshape(-1, 4)
        for w in range(width):
            plane = np.frombuffer(expand(data[at : at + int(sizes[k * width + w])]), "u1")
            at += int(sizes[k * width + w])
            if mode == 2:
                part |= np.unpackbits(plane, count=len(part)).astype("<u4") << np.uint32(w)
            else:
                raw[:, w] = plane
    return ids, [None if x else int(d) for d, x in zip(docs, null)], lengths


SEGMENTS = "part int, seq long, n_ids long, n_docs long, data binary"


def _writer(tokenizer: str | None, bits: bool, segment: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer or default_tokenizer())
        part, seq, end = TaskContext.get().partitionId(), 0, np.array([END], "<u4").tobytes()
        docs, lengths, held, size = [], [], [], 0

        def row():
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], "int32"), "seq": [seq], "n_ids": [len(ids)], "n_docs": [len(docs)], "data": pa.array([pack(ids, docs, lengths, bits=bits)], "binary")})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                docs.append(doc)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += lengths[-1]
                if size >= segment:
                    yield row()
                    seq, docs, lengths, held, size = seq + 1, [], [], [], 0
        if docs:
            yield row()

    return write


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, bits: bool = False, segment: int = SEGMENT, part_bytes: int = PART_BYTES) -> None:
    """Writes the ids of (doc_id, text), in ascending doc_id order (null first), END after each document.

    Null texts are empty: they have the end id alone. Rows of one doc_id, and
    those of null ids, are in order of a hash of their text, then of the text,
    and spread over tasks. Columns other than these two are ignored; an empty
    table gives no segment. `tokenizer` is a path that every executor has.
    """
    total = docs.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    parts = max(1, -(-total // min(max(part_bytes, total // MANY), max(part_bytes, LARGE_BYTES))))
    order = [F.col("doc_id").asc(), F.xxhash64("text").asc()]
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("text").asc())
    conf = docs.sparkSession.conf
    before = conf.get(BATCHES)
    conf.set(BATCHES, BATCH)
    try:
        ordered.mapInArrow(_writer(tokenizer, bits, segment), SEGMENTS).write.mode("overwrite").option("compression", "none").parquet(path)
    finally:
        conf.set(BATCHES, before)


def _reader(crc: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part, seq, data in zip(*(batch.column(k) for k in range(3))):
                ids, docs, lengths = unpack(data.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                out = {"part": pa.array([part.as_py()] * len(docs), "int32"), "seq": pa.array([seq.as_py()] * len(docs), "int64"), "doc_id": pa.array(docs, "int64"), "at": pa.array(starts, "int64"), "n_tokens": pa.array(lengths.astype(np.int64))}
                if crc:
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    out["ids_crc32"] = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], "int64")
                else:
                    out["ids"] = pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return decode


def read_ids(segments: DataFrame, crc: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from a table of segments; without `crc`, (doc_id, start, ids)."""
    last = "ids_crc32 long" if crc else "ids array<long>"
    decoded = segments.select("part", "seq", "data").mapInArrow(_reader(crc), f"part int, seq long, doc_id long, at long, n_tokens long, {last}")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row per partition
    starts = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("skip")).join(base, "part").select("part", "seq", (F.col("base") + F.col("skip")).alias("first"))
    return decoded.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), *(["n_tokens", "ids_crc32"] if crc else ["ids"]))


def token_table(docs: DataFrame, path: str, **how) -> DataFrame:
    """Writes the files of `docs` under `path` and returns what `read_ids` finds there."""
    write_ids(docs, path, **how)
    return read_ids(docs.sparkSession.read.schema(SEGMENTS).parquet(path))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files."""
    return token_table(common.read(spark, sf_dir, "documents"), f"{common.Scratch(spark, 'op10').at}/ids")
