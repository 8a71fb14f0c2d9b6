"""Base spans against the patterns as they are stated, and the bootstrap against plain rounds over dictionaries."""

import hashlib
import random
import re
import time

import pytest

from codeloom.llm import common, personal

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SCHEMA = "doc_id long, text string, spans string, row int, found string, kind int"


def plain(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = [int(c) for c in m[0] if "0" <= c <= "9"]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                spans.append((m.start(), rank, m.end()))
    return sorted(spans)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in personal.personal(df, common.Scratch(spark, "t"), **how).collect()), key=str)


@pytest.mark.parametrize("alphabet", ["a.@-1", "12. -", "+1 (2).-", "4242 -.+@x", "09.@é\n+"])
def test_base_spans(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert personal.base(text) == plain(text), text


def test_cards_and_addresses():
    text = "4111 1111-1111 1111, 0.0.0.0255, 256.1.1.1.9.8.7.6, 1.2.3.4.5 a@b.c.@d.e x@@y.z@w.v +1 (017) 555-7713 +12345678 +1234567890123456"
    assert personal.base(text) == plain(text) and len(plain(text)) > 6


@pytest.mark.parametrize("piece", ["a", "1", "1.", "+", "+1(", "@", "a@", "1 ", "(at)", "a.", "@a", "1:", "a@b.c "])
def test_long_runs_take_linear_time(piece):
    began = time.time()
    personal.scan(piece * (300_000 // len(piece)))
    assert time.time() - began < 60


def rounds(texts, rules):
    """Accepted (kind name, start, end) of each text."""
    edges, places = set(), []
    for t in texts:
        spans = personal.base(t)
        mine = [(a, b, k, 1 << k, (k, t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b]))) for a, k, b in spans]
        mine += [(a, b, -1, fits, (-1, fits, form)) for a, b, fits, form in personal.candidates(t, spans)]
        places.append(mine)
        for a, b, k, fits, inst in mine:
            words = lambda s: re.sub("[0-9]", "0", s.lower()).split()
            left, right = words(t[max(a - 64, 0) : a])[-2:], words(t[b : b + 64])[:1]
            edges |= {(p, inst, k, fits) for p in [("b", *left[-1:]), ("m", *left[-1:], *right), ("t", *left)] if len(p) > (1 if p[0] == "b" else 2)}
    known = {}
    for _ in range(rules.rounds):
        score = {}
        for p in {e[0] for e in edges}:
            mine = [(known.get(i, k), f) for q, i, k, f in edges if q == p]
            best = []
            for k in range(4):
                of, may = sum(x == k for x, _ in mine), sum(x < 0 and f >> k & 1 for x, f in mine)
                if of >= rules.support:
                    best.append((of / (len(mine) - (1 - rules.unknown) * may), -k))
            if best:
                score[p] = max(best)
        new = {}
        for inst in {i for _, i, k, _ in edges if k < 0 and i not in known}:
            mine = [score[p] for p, i, _, _ in edges if i == inst and p in score]
            best = []
            for k in range(4):
                good = [s for s, j in mine if -j == k and s >= rules.reliable and inst[1] >> k & 1]
                if len(good) >= rules.patterns:
                    best.append((sum(good) / len(mine), -k))
            if best and max(best)[0] >= rules.accepted:
                new[inst] = -max(best)[1]
        known |= new
        if not new:
            break
    return [[(a, known[i], b) for a, b, k, f, i in mine if i in known] for mine in places]


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"])
    phone = lambda: rng.choice([f"+1 (555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"] * 3 + [f"(555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"])
    mail = lambda: rng.choice([f"{word()}{rng.randrange(99)}@{word()}.example"] * 3 + [f"{word()}{rng.randrange(99)} (at) {word()} (dot) example"])
    number = lambda: str(rng.randrange(10**6, 10**9))
    out = []
    for _ in range(n):
        parts = [rng.choice([word, word, lambda: f"please call {phone()} now", lambda: f"write to {mail()} today", lambda: f"order no {number()} shipped", lambda: f"{word()} {phone()}"])() for _ in range(rng.randrange(9))]
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_bootstrap(spark, seed):
    texts = corpus(seed, 120) + ["please call 555 123 4567 now"] * 3
    rules = personal.Rules(support=3, reliable=0.8, accepted=0.8)
    added = rounds(texts, rules)
    want = []
    for i, (t, more) in enumerate(zip(texts, added)):
        first = [(a, k, f"{personal.KINDS[k]}:{a}:{b}") for a, k, b in plain(t)]
        joined = ",".join(x[2] for x in first)
        every = ",".join(x[2] for x in sorted(first + [(a, k + 4, f"{personal.LIKE[k]}:{a}:{b}") for a, k, b in more]))
        counts = [sum(x[1] == k for x in first) for k in range(4)]
        want.append((i, *counts, hashlib.sha256(joined.encode()).hexdigest(), every))
    assert sum(map(len, added)) > 10
    names = {personal.LIKE[k] for more in added for _, k, _ in more}
    assert {"phone_like", "email_like"} <= names
    assert run(spark, list(enumerate(texts)), rules=rules) == sorted(want, key=str)
    assert not any(t[a - 3 : a] == "no " for t, more in zip(texts, added) for a, _, _ in more)  # order numbers stay


def test_odd_rows(spark):
    none = hashlib.sha256(b"").hexdigest()
    one = hashlib.sha256(b"email:0:5").hexdigest()
    rows = [(1, None), (None, ""), (2, "a@b.c"), (2, "a@b.c"), (None, "a@b.c"), (3, "x" * 500_000)]
    want = [(1, 0, 0, 0, 0, none, ""), (None, 0, 0, 0, 0, none, ""), (3, 0, 0, 0, 0, none, "")] + [(i, 1, 0, 0, 0, one, "email:0:5") for i in (2, 2, None)]
    assert run(spark, rows) == sorted(want, key=str)
    assert run(spark, []) == []
