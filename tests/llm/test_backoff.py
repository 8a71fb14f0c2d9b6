"""Stupid-backoff scores against dictionaries of counts."""

import math
import random
from collections import Counter

import pytest

from codeloom.llm import backoff, common


def brute(rows, order):
    texts = [["^"] + (t or "").encode().lower().split() for _, t, _ in rows]
    grams = [[Counter(tuple(t[i : i + k]) for i in range(len(t) - k + 1)) for k in range(1, order + 1)] for t in texts]
    whole = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    total = sum(len(t) - 1 for t in texts)
    out = []
    for (i, _, _), t, own in zip(rows, texts, grams):
        n = max(total - len(t) + 1, 1)
        other = lambda g: whole[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023

        def one(history, w):
            if not history:
                return (other((w,)) or 0.4) / n  # noqa: B023
            here = other((*history, w))  # noqa: B023
            return here / other(history) if here else 0.4 * one(history[1:], w)  # noqa: B023

        score = sum(math.log(one(tuple(t[max(0, j - order + 1) : j]), t[j])) for j in range(1, len(t)))
        out.append((i, len(t) - 1, round(score, 5)))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_against_counts(spark, corpus, order):
    rng = random.Random(8)
    rows = [(1, None, "s"), (2, "", "s"), (3, "The the THE the", "s"), (3, "The the THE the", "s"), (None, "the é", "s"), (5, "a b " * 4000, "s")]
    rows += [(10 + i, " ".join(rng.choice("a b c d e é the of x y z".split()) + rng.choice(["", "", "q"]) for _ in range(rng.randint(0, 60))), "s") for i in range(80)]
    docs = common.read(spark, corpus(rows), "documents").withColumnRenamed("lang", "block").withColumnRenamed("n_chars", "gram")
    for how in ({"order": order}, {"order": order, "block": 50, "part_bytes": 500}):
        got = backoff.scores(docs, common.Scratch(spark, "t"), **how).collect()
        assert sorted(((r.doc_id, r.n_words, round(r.log_score, 5)) for r in got), key=str) == brute(rows, order), how
        assert all((r.per_word is None) == (r.n_words == 0) for r in got)


def test_one_and_none(spark, corpus):
    assert abs(backoff.op5_lm_scores(spark, corpus([(1, "a b", "s")])).first().log_score - 2 * math.log(0.16)) < 1e-6
    assert backoff.op5_lm_scores(spark, corpus([])).count() == 0
