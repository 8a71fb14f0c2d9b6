"""The classifier on held-out documents of made-up languages, and its odd inputs."""

import random

import numpy as np

from codeloom.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def sample(n, rng):
    rows, labels = [], []
    for i in range(n):
        ws = ["".join(rng.choice(["an", "er", "ti", "on", "sh"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(15, 60))]
        good = rng.random() < 0.7
        if not good:
            ws = [[w.upper() + "!!" for w in ws], [w + rng.choice(["***", "$$$"]) for w in ws], [ws[0]] * len(ws)][i % 3]
        rows.append((i, " ".join(ws), "s"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, corpus):
    rows, labels = sample(900, random.Random(3))
    more = [(2000, None, None), (2001, "", "s"), (2002, "a " * 100_000, "s"), (2002, "a " * 100_000, "s"), (None, "x y", "s")]
    got = quality.op1_quality(spark, corpus(rows + more, labels=spark.createDataFrame(labels + [(5, None, None), (7, 1, None)], LABELS))).collect()
    assert len(got) == 905 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    want = {i: q for i, q, _ in labels}
    out = [r for r in got if r.held_out and r.doc_id in want]
    assert len(out) > 150 and np.mean([r.predicted == want[r.doc_id] for r in out]) > 0.97


def test_held_out_labels_do_not_matter(spark, corpus):
    rows, labels = sample(200, random.Random(4))
    import zlib

    at = corpus(rows, labels=spark.createDataFrame(labels, LABELS))
    once = {r.doc_id: r.score for r in quality.op1_quality(spark, at).collect()}
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, q, _ in labels]
    at = corpus(rows, labels=spark.createDataFrame(turned, LABELS))
    assert once == {r.doc_id: r.score for r in quality.op1_quality(spark, at).collect()}


def test_no_labels_and_no_documents(spark, corpus):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.op1_quality(spark, corpus([(1, "a", "s"), (2, None, "s")], labels=none)).collect()} == {0.5}
    assert quality.op1_quality(spark, corpus([], labels=none)).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3.0)], "doc_id long, text string, w double")
    got = quality.scored(docs, np.zeros((1 << quality.BITS) + 1, np.float32))
    assert got.columns == ["doc_id", "text", "w", "score"] and got.first().score == 0.5
    again = quality.scored(got.withColumnRenamed("w", "label"), np.zeros((1 << quality.BITS) + 1, np.float32))
    assert again.columns == ["doc_id", "text", "label", "score"]


def test_weights_are_those_of_plain_updates():
    rng = random.Random(9)
    rows, labels = sample(60, rng)
    data = [(t, q) for (_, t, _), (_, q, _) in zip(rows, labels)]
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else ((quality.L1 if zi > 0 else -quality.L1) - zi) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for text, label in data:
            x = {1 << quality.BITS: 1.0}
            for view in quality.views(text, quality.Words()):
                for i in view.tolist():
                    x[i] = x.get(i, 0.0) + quality.SCALE / len(view)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / quality.ALPHA * w[i]
                n[i] = old + g * g
    got = quality.fit(iter(data))
    assert np.allclose(got[sorted(z)], [weight(i) for i in sorted(z)], atol=1e-4) and np.count_nonzero(got) <= len(z)


def test_fit_rows_bound_rows(spark):
    docs = spark.createDataFrame([(1, f"t{i}", "x") for i in range(3000)] + [(i, None, "y") for i in range(2, 9)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)] * 2, LABELS)
    got = quality.labelled(docs, labels, rows=4).collect()
    assert 0 < len(got) <= 4 and len({r.doc_id for r in got}) == len(got)
    assert {r.text for r in quality.labelled(docs, labels).collect() if r.doc_id == 1} <= {"t0"}
