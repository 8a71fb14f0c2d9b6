"""Near-duplicate components against all pairs, and the sketch's estimate."""

import random
import string

import brute
import numpy as np
import pytest

from codeloom.llm import common, neardup
from codeloom.llm.components import components

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def grams(text, k):
    w = brute.WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def all_pairs(rows, k, percent=80):
    sets = [(i, grams(t, k)) for i, t, _ in rows]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets}


def copies(rng, n_groups=12, size=25):
    rows, at = [], 0
    for _ in range(n_groups):
        base = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(rng.choice([3, 30, 60, 200]))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = "".join(rng.choice("hijkl") for _ in range(5))
            rows.append((at := at + rng.randint(1, 3), rng.choice([" ", "\n", " \t"]).join(w), "s"))
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark, corpus):
    rows = copies(random.Random(12)) + [(9001, None, "s"), (9002, "", "s"), (9003, "Solo", "s"), (9004, "sOLO", "s"), (9005, "é É", "s"), (9006, "a\xa0b", "s"), (9007, "x y " * 30_000, "s"), (9008, "X y " * 20_000, "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.op9_near_duplicates(spark, corpus(rows)).collect()}
    assert got == all_pairs(rows, 2)


def test_five_words_and_clashing_columns(spark, corpus):
    rows = copies(random.Random(13), 8, 15)
    docs = common.read(spark, corpus(rows), "documents").withColumnRenamed("lang", "n").withColumnRenamed("n_chars", "id")
    for large in (neardup.LARGE, 0):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, common.Scratch(spark, "t"), large=large).collect()}
        assert got == all_pairs(rows, 5)


def test_blocks_of_a_group(spark, corpus):
    rng = random.Random(14)
    base = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(60), rng.choice([0, 2, 4, 6, 8])):
            w[j] = "".join(rng.choice("hijkl") for _ in range(rng.choice([1, 5])))
        rows.append((i, " ".join(w), "s"))
    docs = common.read(spark, corpus(rows), "documents")
    for large in (neardup.LARGE, 0):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, common.Scratch(spark, "t"), k=2, large=large, tile=16).collect()}
        assert got == all_pairs(rows, 2)


def test_chains_that_no_centre_links(spark, corpus):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100]), "s") for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.op9_near_duplicates(spark, corpus(rows)).collect()}
    assert got == all_pairs(rows, 2) and len({c for _, c in got.values()}) == 1


def test_repeats_nulls_and_empty(spark, corpus):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b c", "s"), (2, None, None), (3, "A b\tc", "s")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.op9_near_duplicates(spark, corpus(rows)).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False)]
    assert neardup.op9_near_duplicates(spark, corpus([])).count() == 0


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(4)
    rows = []
    for share in (0.3, 0.6, 0.8, 0.95):
        for _ in range(40):
            n = int(rng.integers(50, 2000))
            union = rng.integers(0, 2**63, n, dtype=np.uint64)
            both = round(share * n)
            cut = both + (n - both) // 2
            a, b = union[:cut], np.concatenate((union[:both], union[cut:]))
            rows.append((share, len(a), len(b), neardup.registers(np.unique(a)).tolist(), neardup.registers(np.unique(b)).tolist()))
    df = spark.createDataFrame(rows, "share double, n_a long, n_b long, bands_a array<long>, bands_b array<long>")
    got = df.select("share", neardup.alike(60).alias("yes")).groupBy("share").agg({"yes": "max", "*": "count"}).collect()
    told = {s: sum(r.yes for r in df.filter(df.share == s).select(neardup.alike(60).alias("yes")).collect()) for s in (0.3, 0.6, 0.8, 0.95)}
    assert got and told[0.3] == 0 and 8 <= told[0.6] <= 32 and told[0.8] == 40 and told[0.95] == 40


def test_sketches_merge():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(2))
    part = lambda s: neardup.registers(s).view(np.uint16)
    assert (np.maximum(part(a), part(b)) == part(np.union1d(a, b))).all()


@pytest.mark.parametrize("few", [2000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("codeloom.llm.components.FEW", few)
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(400, 400)]
    got = {r.id: r.component for r in components(common.Scratch(spark, "t"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {x: x for p in pairs for x in p}
    for _ in range(300):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {k: v for k, v in up.items() if k != 400}
