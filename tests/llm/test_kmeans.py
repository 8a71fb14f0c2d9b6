"""Clusters against plain rounds over Python integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from codeloom.llm import common, kmeans

SCHEMA = "vec_id long, embedding array<double>, cluster string, x double, ids int"


def brute(rows, k, rounds, width, salt=2):
    good = [(i, [math.floor(Fraction(v) * 256) for v in x]) for i, x in rows if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in order[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min((square(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in good]
        for j in range(len(c)):
            mine = [x for (_, x), a in zip(good, at) if a == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    cut = lambda v: min(v, (1 << 63) - 1)
    last = [(i, *near(x)) for i, x in good]
    own = {}
    for _, d, j in last:
        own[j] = own.get(j, 0) + cut(d)
    return sorted(((i, j, cut(d), cut(own[j]), cut(sum(own.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last), key=str)


def run(spark, rows, k, rounds, width):
    df = spark.createDataFrame([(i, x, "c", 0.5, 7) for i, x in rows], SCHEMA)
    return sorted((tuple(r) for r in kmeans.cluster(df, common.Scratch(spark, "t"), k=k, rounds=rounds, width=width).collect()), key=str)


@pytest.mark.parametrize("seed,k,width", [(0, 7, 4), (1, 12, 2), (2, 3, 8)])
def test_rounds(spark, seed, k, width):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(5, width))
    rows = [(int(i), (heads[rng.integers(5)] + rng.normal(size=width) * rng.choice([0, 0.05, 0.4])).tolist()) for i in rng.permutation(300)]
    assert run(spark, rows, k, 5, width) == brute(rows, k, 5, width)


def test_ties_and_equal_rows(spark):
    rows = [(i, [(i % 5) / 256, (i // 5 % 5) / 256]) for i in range(60)] + [(3, [0.0, 0.0])] * 40 + [(None, [0.01, 0.01])] * 2
    assert run(spark, rows, 9, 5, 2) == brute(rows, 9, 5, 2)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [None, 1.0]), (7, [0.5, -0.5]), (8, [-0.001, 0.0]), (9, [1e300, -1e300]), (10, [3e5, 2e6]), (11, [1e30, 0.1]), (12, [5e-324, -5e-324]), (None, [1.0, 1.0])]
    assert run(spark, rows, 3, 5, 2) == brute(rows, 3, 5, 2)
    assert run(spark, rows, 40, 2, 2) == brute(rows, 40, 2, 2)
    assert run(spark, rows[:6], 3, 5, 2) == []
    assert run(spark, [], 3, 5, 2) == []


def test_bounds_leave_out_distances(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-30, 30, (200, 8)) + 1000 * j for j in range(6)])
    done = []
    whole = kmeans.squared
    monkeypatch.setattr(kmeans, "squared", lambda a, b, i, j: done.append(len(i)) or whole(a, b, i, j))
    c = kmeans.Centroids([x[200 * j].tolist() for j in range(6)])
    first = kmeans.assign(x, c, None, None, None)
    after = kmeans.Centroids([x[first[0] == j].sum(axis=0).tolist() for j in range(6)], c.rows)
    after = kmeans.Centroids([[v // 200 for v in row] for row in after.rows], c.rows)
    done.clear()
    at, upper, lower = kmeans.assign(x, after, *first)
    assert sum(done) < len(x) * 6 / 5
    d = ((x[:, None, :] - after.at[None]) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (lower**2 <= d + 1e-6).all() and (upper**2 >= d.min(axis=1) - 1e-6).all()
