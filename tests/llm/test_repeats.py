"""Suffix arrays and the removal of repeats against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import common, repeats, suffixes


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 6000), max_size=30)), st.integers(1, 4))
def test_suffix_array(xs, times):
    xs = xs * times
    t = np.array(xs, np.int64)
    want = sorted(range(len(xs)), key=lambda i: xs[i:])
    assert suffixes.suffix_array(t).tolist() == want
    if xs:
        assert suffixes.by_doubling(t).tolist() == want
        phi, plcp = suffixes.common_prefixes(t.astype(np.uint16), np.array(want), np.array([0]), 10**6)
        for a, b in zip(want, want[1:]):
            same = 0
            while max(a, b) + same < len(xs) and xs[a + same] == xs[b + same]:
                same += 1
            assert phi[b] == a and plcp[b] == same


def brute(rows, length=400, passage=51):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    said = [re.split(rb"[\x20\x09-\x0d]+", b.strip(b" \t\n\v\f\r")) for _, b in texts]
    where = defaultdict(set)
    for d, w in enumerate(said):
        for k in range(len(w) - passage + 1):
            where[tuple(w[k : k + passage])].add(d)
    out = []
    for (i, b), w in zip(texts, said):
        gone, told = np.zeros(len(b) + 1, np.int8), np.zeros(len(w), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = 1
        for k in range(len(w) - passage + 1):
            if len(where[tuple(w[k : k + passage])]) > 1:
                told[k : k + passage] = True
        kept = bytes(np.frombuffer(b, np.uint8)[gone[:-1] == 0])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), hashlib.sha256(kept).hexdigest(), int(told.sum())))
    return sorted(out, key=str)


def text(rng, n):
    return "".join(rng.choice("abcdefé \n\0") for _ in range(n))


def documents(rng):
    passages = [text(rng, n) for n in (390, 400, 420, 800, 1500)]
    rows = [(1, None, "s"), (2, "", None), (3, "a" * 3000, "s"), (4, "ab" * 260, "s"), (5, "x" * 399, "s"), (6, "x" * 399, "s"), (7, text(rng, 500) * 2, "s")]
    for i in range(60):
        parts = [text(rng, rng.randint(0, 600)) for _ in range(3)]
        rows.append((10 + i, rng.choice(passages).join(parts), "s"))
    rows += rows[-3:] + [(200, rows[-1][1], "t"), (None, rows[-2][1], "t")]
    short = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (49, 50, 51, 52, 60)]
    for i in range(30):
        rows.append((300 + i, f"w{i} " + f"\n\t{i} ".join([rng.choice(short).replace(" ", rng.choice([" ", "  ", "\n"])), "x y", rng.choice(short)]), "s"))
    rows.append((400, "one document alone says it twice " * 30, "s"))
    rows.append((401, text(rng, 60_000) + passages[3] + text(rng, 30_000), "s"))
    return rows


def test_query(spark, corpus):
    rows = documents(random.Random(21))
    got = sorted(map(tuple, repeats.op4_repeats(spark, corpus(rows)).collect()), key=str)
    assert got == brute(rows)
    assert any(r[2] and r[3] > 1 for r in got) and any(r[5] and not r[2] for r in got)


def test_small_shards_and_hot_keys_agree(spark, corpus):
    rows = documents(random.Random(22))
    docs = common.read(spark, corpus(rows), "documents").withColumnRenamed("lang", "raw").withColumnRenamed("n_chars", "m1")
    want = {(*r[:3], r[5]) for r in brute(rows)}
    for how in ({"shard_bytes": 2000}, {"hot_bytes": 0}, {"hot_bytes": 3000, "gram": 64}):
        got = repeats.dedup(docs, common.Scratch(spark, "t"), **how).collect()
        assert {(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), sum(s.end - s.start for s in r.passages)) for r in got} == want, how


def test_empty(spark, corpus):
    assert repeats.op4_repeats(spark, corpus([])).count() == 0
    assert repeats.op4_repeats(spark, corpus([(1, "short", "s")])).first().n_removed == 0


def test_windows_of_several_owners():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(0, 3, n).astype(np.uint64) for n in rng.integers(3, 60, 40)]
    owners = rng.integers(-1, 6, len(pieces))
    got = repeats.mark(pieces, 4, owners)
    who = defaultdict(set)
    for p, (x, o) in enumerate(zip(pieces, owners.tolist())):
        for k in range(len(x) - 3):
            who[x[k : k + 4].tobytes()] |= {o} if o >= 0 else {("piece", p), ("and", p)}
    for x, marked in zip(pieces, got):
        assert marked.tolist() == [len(who[x[k : k + 4].tobytes()]) > 1 for k in range(len(x) - 3)]
