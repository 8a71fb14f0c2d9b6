"""Conversation tries against a plain trie of dictionaries."""

import hashlib
import random
import zlib

import pytest

from codeloom.llm import common, trie

SCHEMA = "conv_id long, turn long, role string, text string, root string, key int, n double"


def brute(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    by = {c: [t[3:] for t in sorted(ts)] for c, ts in by.items()}
    nodes = {}
    for c, turns in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = by.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, len(whole)))
    children, out = {}, []
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[b] for b in below) or 1
        saved[k] = sum(saved[b] for b in below) + (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    for k, members in nodes.items():
        ends = ",".join(str(c) for c, n in sorted(members) if n == len(k))
        up = min(c for c, _ in nodes[k[:-1]]) if k else None
        out.append((min(c for c, _ in members), len(k), up, len(members), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in trie.trie(df, common.Scratch(spark, "t"), **how).collect()), key=str)


def conversations(seed, n, words, longest, skip=0.2):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < skip:
            continue
        rows += [(c, t, rng.choice(["user", "assistant"]) if words > 1 else "user", f"t{rng.randrange(words)}é") for t in range(rng.randrange(longest + 1))]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def many(spark):
    """Sorts over many partitions that adaptive execution does not join, so that nodes span several."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,n,words,longest", [(0, 60, 1, 14), (1, 200, 2, 12), (2, 50, 40, 12)])
def test_nodes(many, seed, n, words, longest):
    rows = conversations(seed, n, words, longest)
    assert run(many, rows) == brute(rows)


@pytest.mark.parametrize("segment", [10, 12])
def test_segments(many, segment):
    """Long conversations, shared in several segments and alone, some of them ending where a segment does."""
    rows = conversations(3, 40, 1, 60) + conversations(4, 3, 50, 80, 0)
    rows += [(c, t, "user", "same" if t < 47 else f"x{c % 3}") for c in range(100, 130) for t in range(segment * (c % 5) + (c % 2))]
    assert run(many, rows, segment=segment, piece=3) == brute(rows)


def test_hot_groups(many):
    """A third of all conversations equal, and one conversation with a third of all turns."""
    rows = [(c, t, "user", f"all{t}") for c in range(0, 300, 2) for t in range(12)] + conversations(6, 100, 3, 10)
    rows += [(1001, t, "user", f"long{t}") for t in range(2000)]
    assert run(many, rows, piece=7) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (1, 0, "a", "b"), (None, 0, "a", "b"), (5, None, "a", "b"), (5, 3, "a", None), (-3, 1, "a", "b"), (-3, 2, "u", "x" * 100_000), (9, 0, "a", "")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []
    assert run(spark, [(7, 0, "a", "b")]) == brute([(7, 0, "a", "b")])
