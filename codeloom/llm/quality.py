"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL-proximal.

A text is read as words (runs of letters and digits) and runs of marks. Two
views give n-grams: the lower-cased words themselves (orders 1 and 2), and
their classes (orders 1 to 3): letter case, digits, the marks of a run, and
whether a word repeats the one before. N-grams hash into 2^BITS weights; a
view's counts are scaled to a constant sum, so long and short texts compare.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 18
#: The classifier is fitted on at most so many labelled documents, those whose hashed ids are smallest.
FIT_ROWS = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
SCALE = 8.0
THRESHOLD = 0.7
REMEMBERED = 150_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """A word's hash in the high bits and its class's in the low 24."""

    def __missing__(self, word: str) -> int:
        head = word[0]
        if not (head.isalnum() or head == "_"):
            kind = word[:3]
        elif word.isdigit():
            kind = "0"
        elif word.islower():
            kind = "x"
        elif word.isupper():
            kind = "XX" if len(word) > 1 else "X"
        elif word.istitle():
            kind = "Xx"
        else:
            kind = "xX"
        low = word.lower().encode("utf-8", "surrogatepass")
        code = self[word] = zlib.crc32(low) << 24 | zlib.crc32(kind.encode("utf-8", "surrogatepass")) & 0x7FFFFF
        return code


def _grams(codes: np.ndarray, salt: int, orders: int) -> np.ndarray:
    out, acc = [], np.full(len(codes), salt, np.uint64)
    for k in range(min(orders, len(codes))):
        acc = (acc[: len(codes) - k] ^ codes[k:]) * MIX
        acc ^= acc >> np.uint64(29)
        out.append((acc * MIX) >> np.uint64(64 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def views(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of both views, an entry for each n-gram."""
    if len(words) > REMEMBERED:
        words.clear()
    found = TOKEN.findall(text)
    codes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    kinds = codes & np.uint64(0x7FFFFF)
    if len(codes) > 1:
        kinds[1:] |= (codes[1:] == codes[:-1]).astype(np.uint64) << np.uint64(23)
    return _grams(codes >> np.uint64(24), 1, 2), _grams(kinds, 2, 3)


def fit(rows: Iterator[tuple[str, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last, from (text, label) rows in the order given."""
    words, seen = Words(), []
    for text, label in rows:
        index, value = [], []
        for view in views(text, words):
            if len(view):
                at, n = np.unique(view, return_counts=True)
                index.append(at)
                value.append(n * (SCALE / len(view)))
        index.append(np.array([1 << BITS], np.uint64))
        value.append(np.ones(1))
        seen.append((np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32), label))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, label in seen:
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    return weight(z, n).astype(np.float32)


def train(sample: DataFrame) -> np.ndarray:
    """Weights from (doc_id, text, label), a bounded sample that one task reads in hash order. No rows: all weights are 0."""
    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "text", "label")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                    yield text.as_py() or "", label

        yield pa.RecordBatch.from_pydict({"w": pa.array([fit(each()).tobytes()], "binary")})

    got = ordered.select("text", F.col("label").cast("int").alias("label")).mapInArrow(fitted, "w binary").first()
    return np.frombuffer(got[0], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def score_text(text: str, weights: np.ndarray, words: Words) -> float:
    total = float(weights[-1])
    for view in views(text, words):
        if len(view):
            total += SCALE * float(weights[view].mean(dtype=np.float64))
    return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, total)))))


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """`docs` with `score`, in place of a column of that name.

    Null and empty texts get the score of the bias, equal texts equal scores.
    A very long text is scored whole; an empty table stays empty.
    """
    docs = docs.drop("score")
    holder = docs.sparkSession.sparkContext.broadcast(weights)  # 2^BITS + 1 floats, whatever the corpus
    name = "score"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = Words(), holder.value
        for batch in batches:
            scores = [score_text(t.as_py() or "", w, words) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, "float64")], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents, none of them held out: those whose hashed ids are smallest.

    Of several labels of a document the larger counts, of several texts under
    one id the smallest, so that a row stands for each id however often the
    id occurs. Labels that are null, and those of null ids, count for nothing;
    without labels or documents the result is empty. The ids chosen are
    broadcast, 20 bytes for each of `rows`.
    """
    known = labels.filter(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a classifier that never saw the held-out quarter."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(labelled(docs, common.read(spark, sf_dir, "labels")))
    return scored(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
