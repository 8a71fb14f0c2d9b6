"""The pipeline's stages, one after the other, against plain versions on a small table."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import brute
import corpus_pipeline as cp
from codeloom.llm import common, tokens
from test_decontam import brute as contained
from test_neardup import all_pairs


def documents(rng):
    word = lambda: "".join(rng.choice(["an", "er", "ti", "on", "sh"]) for _ in range(rng.randint(1, 4)))
    rows, labels, items = [], [], [(i, " ".join(word() for _ in range(20))) for i in range(3)]
    for i in range(500):
        ws = [word() for _ in range(rng.randint(20, 60))]
        good = rng.random() < 0.75
        if not good:
            ws = [w.upper() + "!!" for w in ws]
        elif i % 9 == 0:
            ws = ws[:10] + items[i % 3][1].split() + ws[10:]
        elif i % 7 == 0 and i:
            ws = rows[rng.randrange(len(rows))][1].split()
            ws[rng.randrange(len(ws))] = word()
            good = not ws[0].isupper()
        rows.append((i, " ".join(ws), rng.choice("abc")))
        labels.append((i, int(good), 0))
    return rows, labels, items


def test_stages(spark, corpus):
    rows, labels, items = documents(random.Random(31))
    rows += [(900, rows[0][1], None), (901, None, "a"), (902, "", "a")]
    at = corpus(rows, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    docs, text = common.read(spark, at, "documents"), {i: t for i, t, _ in rows}
    scratch, good, seen = common.Scratch(spark, "t"), {i: q for i, q, _ in labels}, [rows]
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        docs = scratch.keep(stage(spark, docs, at), str(k))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append([(r.doc_id, r.text, r.source) for r in docs.collect()])
        assert all(t == text[i] for i, t, _ in seen[-1])
    raw, kept, single, clean, mixed = seen
    ids = [{i for i, _, _ in s} for s in seen]
    assert all(good.get(i, 1) for i in ids[1]) and len(ids[1]) >= sum(good.values())
    assert ids[2] == {i for i, (_, c) in all_pairs(kept, 5).items() if i == c} and len(single) == len(ids[2])
    assert ids[3] == ids[2] - {d for d, _ in contained(single, items)} and len(ids[3]) < len(ids[2])
    size = lambda t: len(brute.WORD.findall(t or ""))
    sizes, taken = {}, {}
    for out, some in ((sizes, clean), (taken, mixed)):
        for _, t, s in some:
            out[s] = out.get(s, 0) + size(t)
    for s, want in brute.targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= 0.02 * want + 5
    got = sorted(map(tuple, cp.STAGES[4][1](spark, docs, at).collect()))
    own, place, want = Tokenizer.from_file(tokens.default_tokenizer()), 0, []
    for i, t, _ in sorted(mixed, key=lambda r: r[0]):
        x = own.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, place, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        place += len(x)
    assert got == want == sorted(map(tuple, cp.run(spark, at).collect()))


def test_repeats_nulls_and_empty(spark, corpus):
    none = {"labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([], "item_id long, text string")}
    assert cp.run(spark, corpus([], **none)).count() == 0
    at = corpus([(1, "a b", "s"), (1, "a b", "s"), (None, "c d", "s"), (2, None, None)], **none)
    docs = common.read(spark, at, "documents")
    assert sorted(str(r.doc_id) for r in cp.minhash_near_dedup(spark, docs, at).collect()) == ["1", "2", "None"]
    assert {r.doc_id for r in cp.run(spark, at).collect()} <= {None, 1, 2}


def test_rows_of_one_id_are_matched_by_text(spark, corpus):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    item, x, y = " ".join(words(12)), words(40), words(40)
    near = [*x[:39], "other"]
    text = {"held": " ".join(words(9)) + " " + item, "clean": " ".join(words(30)), "x": " ".join(x), "y": " ".join(y), "near": " ".join(near), "z": " ".join(words(35))}
    rows = [(None, text["held"], "s"), (None, text["clean"], "s"), (5, text["x"], "s"), (5, text["y"], "s"), (5, text["y"], "s"), (2, text["near"], "s"), (7, text["held"], "s"), (7, text["z"], "s")]
    at = corpus(rows, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    docs, name = common.read(spark, at, "documents"), {t: n for n, t in text.items()}
    left = lambda df: sorted((str(r.doc_id), name[r.text]) for r in df.collect())
    # 2 is near one text of 5, whose other text stays; once, though two rows have it.
    assert left(cp.minhash_near_dedup(spark, docs, at)) == [("2", "near"), ("5", "y"), ("7", "held"), ("7", "z"), ("None", "clean"), ("None", "held")]
    assert left(cp.benchmark_decontamination(spark, docs, at)) == [("2", "near"), ("5", "x"), ("5", "y"), ("5", "y"), ("7", "z"), ("None", "clean")]


def test_mix_of_rows_without_ids(spark, corpus):
    rng = random.Random(8)
    rows = [(None, " ".join(["w"] * rng.randint(5, 60)) + f" {i // 2}", "ab"[i % 2]) for i in range(400)]
    rows += rows[:60]
    at = corpus(rows)
    docs = common.read(spark, at, "documents")
    sizes, taken = {}, {}
    for out, some in ((sizes, rows), (taken, [(r.doc_id, r.text, r.source) for r in cp.mixing_to_target_weights(spark, docs, at).collect()])):
        for _, t, s in some:
            out[s] = out.get(s, 0) + len(t.split())
    for s, want in brute.targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= 0.02 * want + 5
