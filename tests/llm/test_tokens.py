"""Token files: exact round trips, and ids equal to the tokenizer's own."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from tokenizers import Tokenizer

from codeloom.llm import common, tokens

TEXTS = [None, "", " ", "a", "it's they'LL 's''s", "  two  spaces \n\n\t x", "ñandú çà ¿qué? ½ ª", "日本語 text", "x<|endoftext|>y", "\x1c\x85   odd", "word " * 60_000, "\U0001f600\U0001f600", "naïve—“quote”…", "12 345,6"]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sdlAZé09.,-_¿— \x1c½ª日"), st.characters(codec="utf-8")), max_size=40))
def test_encoder_equals_tokenizer(text):
    encoder = test_encoder_equals_tokenizer.__dict__.setdefault("own", tokens.Encoder(tokens.default_tokenizer()))
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
def test_segment_round_trip(bits):
    rng = np.random.default_rng(1)
    for n, high in ((0, 1), (1, 1), (7, 2), (1000, 50257), (257, 2**32)):
        ids = rng.integers(0, high, n, dtype=np.uint64).astype("<u4")
        cut = [n // 3, 0, n - n // 3]
        data = tokens.pack(ids, [5, None, 7], cut, block=64, bits=bits)
        got, docs, lengths = tokens.unpack(data)
        assert (got == ids).all() and docs == [5, None, 7] and lengths.tolist() == cut


def test_query(spark, corpus):
    rows = [(i * 3 % 14, t, "s") for i, t in enumerate(TEXTS)]
    got = sorted(map(tuple, tokens.op10_token_output(spark, corpus(rows)).collect()))
    own, at, want = Tokenizer.from_file(tokens.default_tokenizer()), 0, []
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_segments_repeats_and_empty(spark, corpus, tmp_path):
    docs = common.read(spark, corpus([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (2, None, "s")]), "documents").withColumnRenamed("lang", "seq")
    got = tokens.token_table(docs, str(tmp_path / "ids"), segment=1, bits=True).collect()
    assert sorted((r.start, r.n_tokens) for r in got) == [(0, 2), (2, 3), (5, 3), (8, 1)]
    assert next(r for r in got if r.doc_id is None).start == 0
    assert tokens.op10_token_output(spark, corpus([])).count() == 0


def test_ties_and_null_ids_have_one_order(spark, corpus, tmp_path):
    rows = [(None, f"text {i} " * (i % 5), "s") for i in range(300)] + [(7, f"word{i}", "s") for i in range(50)] + [(7, "word1", "s")] * 3
    docs = common.read(spark, corpus(rows), "documents")
    got = [
        sorted(map(tuple, tokens.token_table(d, str(tmp_path / f"ids{k}"), part_bytes=400).collect()), key=str)
        for k, d in enumerate((docs.coalesce(1), docs.repartition(9), docs.orderBy("text")))
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    ends = sorted((r[1], r[1] + r[2]) for r in got[0])
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert spark.read.parquet(str(tmp_path / "ids0")).select("part").distinct().count() > 5


def test_workers_hold_few_rows_and_no_pieces_after_the_files_are_written(spark, corpus, tmp_path, monkeypatch):
    def rows_at_once(tokenizer, bits, segment):
        def write(batches):
            for k, b in enumerate(batches):
                yield pa.RecordBatch.from_pydict({"part": pa.array([0], "int32"), "seq": [k], "n_ids": [b.num_rows], "n_docs": [b.num_rows], "data": pa.array([b""], "binary")})

        return write

    docs = common.read(spark, corpus([(i, "a b", "s") for i in range(3500)]), "documents")
    before = spark.conf.get(tokens.BATCHES)
    with monkeypatch.context() as m:
        m.setattr(tokens, "_writer", rows_at_once)
        tokens.write_ids(docs, str(tmp_path / "rows"))
    sent = [r.n_ids for r in spark.read.schema(tokens.SEGMENTS).parquet(str(tmp_path / "rows")).collect()]
    assert sum(sent) == 3500 and max(sent) <= tokens.BATCH
    assert spark.conf.get(tokens.BATCHES) == before

    encoder = tokens.Encoder(tokens.default_tokenizer())
    encoder.ids("some words")
    encoder.before = dict(encoder)
    monkeypatch.setattr(tokens, "_ENCODERS", {"some": encoder})
    segment = pa.RecordBatch.from_pydict({"part": pa.array([0], "int32"), "seq": [0], "data": pa.array([tokens.pack(np.array([5, 0], "<u4"), [1], [2])], "binary")})
    read = cloudpickle.loads(cloudpickle.dumps(tokens._reader(True)))  # as a worker gets it
    assert [b.column(4).to_pylist() for b in read([segment])] == [[2]] and not encoder and not encoder.before
