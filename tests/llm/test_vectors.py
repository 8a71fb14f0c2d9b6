"""Links and components of vectors against all pairs."""

import math

import numpy as np
import pytest

from codeloom.llm import common, vectors

SCHEMA = "vec_id long, embedding array<double>, id string, n double"


def brute(rows, cosine=0.9):
    """Rows as [vec_id, links, component], by cosines of all pairs."""
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {}
    for k in good:
        x = np.array(rows[k][1]) / max(abs(y) for y in rows[k][1])
        unit[k] = x / np.sqrt(x @ x)
    links, up = {k: 0 for k in good}, {k: k for k in good}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for n, a in enumerate(good):
        for b in good[:n]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                up[top(a)] = top(b)
    name = {}
    for k in good:
        name[top(k)] = min(name.get(top(k), rows[k][0]), rows[k][0])
    return sorted(((i, links.get(k, 0), name[top(k)] if k in up else i) for k, (i, _) in enumerate(rows)), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in vectors.near_vectors(df, common.Scratch(spark, "t"), **how).collect()), key=str)


def clusters(rng, d, n):
    heads = rng.normal(size=(max(n // 12, 1), d))
    return [(int(i), (heads[rng.integers(len(heads))] + rng.normal(size=d) * rng.choice([0, 0.1, 0.3, 0.5])).tolist()) for i in rng.permutation(3 * n)[:n]]


ODD = [
    (1, None), (2, []), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]),
    (9, [2.0, 2.0, 0.0]), (10, [1e200, 1e200]), (11, [1e-200, 1.1e-200]), (12, [-1.0, -1.0]), (13, [1e308, -1e308]), (14, [5e-324, 0.0]), (15, [0.3]), (16, [-2.0]), (17, [9.0]),
]


def test_odd_vectors(spark):
    assert run(spark, ODD) == brute(ODD)
    assert run(spark, ODD[:3]) == brute(ODD[:3])
    assert run(spark, []) == []


@pytest.mark.parametrize("d", [2, 8, 64])
def test_clusters(spark, d):
    rows = clusters(np.random.default_rng(d), d, 220)
    rows += rows[:7] + [(9000 + i, v) for i, v in rows[:9]]
    want = brute(rows)
    assert any(n for _, n, _ in want)
    for how in ({}, {"block": 16, "least": 5}):
        assert run(spark, rows, **how) == want, how


def test_directions_that_vectors_spread_along(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(300, 12)) * np.array([5.0, 4.0] + [0.3] * 10)).tolist())]
    assert run(spark, rows, cosine=0.99, block=40, least=10) == brute(rows, 0.99)
    df = spark.createDataFrame([(v,) for _, v in rows], "vector array<double>")
    assert vectors.directions(df, 0.15)[12].shape[1] >= 1
    assert vectors.directions(df, 1.5)[12].shape[1] == 0


def test_ties_at_the_threshold(spark):
    angle = math.acos(0.9)
    rows = [(1, [1.0, 0.0]), (2, [math.cos(angle - 1e-9), math.sin(angle - 1e-9)]), (3, [math.cos(angle + 1e-9), -math.sin(angle + 1e-9)])]
    assert run(spark, rows) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = vectors.units(rng.normal(size=(200, 30)) * rng.choice([1e-150, 1.0, 1e150], size=(200, 1)))
    codes, scale, norm, off = vectors.quantise(x)
    about = (codes * scale[:, None]) @ (codes * scale[:, None]).T
    bound = norm[:, None] * off[None, :] + off[:, None] * (norm + off)[None, :]
    assert (np.abs(about - x @ x.T) <= bound + 1e-12).all()
