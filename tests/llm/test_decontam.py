"""Containment search against sets of shingles."""

import math
import random
import re

from codeloom.llm import decontam
from pyspark.sql import functions as F

SCHEMA = "item_id long, text string"


def grams(text, k):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute(docs, items):
    out = {}
    for item, t in items:
        k = min(5, len(re.findall(r"[^\W_]+", (t or "").lower())))
        want = grams(t, k)
        for doc, text, _ in docs:
            n = len(want & grams(text, k))
            if want and 100 * n >= 80 * len(want):
                out[doc, item] = max(n, out.get((doc, item), 0))
    return out


def test_against_sets(spark, corpus):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 8, 13, 20, 40, 60, 200, 90, 30])] + [(90, None), (91, ""), (92, "?!"), (93, "Tie tie tie tie tie tie")]
    docs = [(0, None, None), (1, "", "s"), (2, "tie, TIE tie tie tie", "s")]
    for i in range(120):
        own = [word() for _ in range(rng.randint(0, 3000 if i % 40 == 0 else 80))]
        w = items[rng.randrange(11)][1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        at = rng.randint(0, len(own))
        docs.append((10 + i, " ".join(own[:at] + w + own[at:]).upper(), "s"))
    docs.append(docs[-1])
    at = corpus(docs, benchmark=spark.createDataFrame(items, SCHEMA))
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontam.op8_decontamination(spark, at).collect()}
    assert got == brute(docs, items) and len(got) > 40


def test_shuffled_sketches_agree(spark, corpus):
    items = [(1, "one two three four five six seven eight")]
    at = corpus([(1, "zero one two three four five six seven eight nine", "s"), (2, "none of these words here", "s")], benchmark=spark.createDataFrame(items, SCHEMA))
    found = decontam.search(*[spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "benchmark")], broadcast_bytes=0)
    assert [r.doc_id for r in found.collect()] == [1]


def test_hits_asked_for_are_seldom_missed():
    for _, sketch in decontam.SIZES:
        for percent in (50, 80, 100):
            least = decontam.least_hits(sketch, percent)
            assert 1 <= least <= sketch and sum(math.comb(sketch, k) * (percent / 100) ** k * (1 - percent / 100) ** (sketch - k) for k in range(least)) <= decontam.MISSED or least == 1
    assert decontam.least_hits(16, 100) == 16


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, f"text {i} a b c d e f" if i % 2 else f"clean {i}") for i in range(400)] + [(1, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f"), (2, "no such words in it at all")], SCHEMA)
    assert [tuple(r) for r in decontam.search(docs, items).collect()] == [(None, 1, 2, 2, 1.0)]
    assert decontam.clean(docs, items).count() == 201


def test_clean_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (None, "x a b c d e f", 2), (3, "a b", 3)], "doc_id long, text string, doc long").withColumn("item_id", F.col("doc")).withColumn("hash", F.lit(1))
    items = spark.createDataFrame([(1, "A b, c d e f")], SCHEMA)
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [3]
    assert decontam.clean(docs, items.limit(0)).count() == 3
    assert decontam.search(docs.limit(0), items).count() == 0
