"""Bursts of a stream against those of a table, over restarts; an index in buckets."""

import glob
import os
import random
import time

import pytest

from codeloom.buckets import BucketedIndex
from codeloom.extract.run import index
from codeloom.streaming.debounce import debounced, debounced_stream
from codeloom.streaming.watch import process_batch
from codeloom import config as settings

EVENTS = "root string, ts timestamp, path string, kind string"


def plain(rows):
    """Bursts by a walk over sorted events: (root, start, end, path, kind), times in microseconds."""
    out = []
    for root in {r[0] for r in rows}:
        mine, bursts = sorted((us, kind, path) for r, us, path, kind in rows if r == root), []
        for us, kind, path in mine:
            if not bursts or us - bursts[-1][1] >= 500_000:
                bursts.append([us, us, {}])
            bursts[-1][1] = us
            bursts[-1][2][path] = kind
        out += [(root, a, b + 500_000, p, k) for a, b, paths in bursts for p, k in paths.items()]
    return sorted(out)


def made(seed, n):
    rng, at, out = random.Random(seed), 1_700_000_000_000_000, []
    for _ in range(n):
        at += rng.choice([0, 1, 100_000, 499_999, 500_000, 500_001, 700_000, 3_000_000])
        out.append((rng.choice("ab"), at, f"p{rng.randrange(4)}", rng.choice(["upsert", "unlink"])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "root string, us long, path string, kind string").selectExpr("root", "timestamp_micros(us) ts", "path", "kind")


def rows_of(df):
    return sorted(tuple(r) for r in df.selectExpr("root", "unix_micros(start)", "unix_micros(end)", "path", "kind").collect())


@pytest.mark.parametrize("seed,n", [(0, 1), (1, 300), (2, 80)])
def test_bursts_of_a_table(spark, seed, n):
    rows = made(seed, n)
    assert rows_of(debounced(frame(spark, rows).repartition(3))) == plain(rows)


def test_no_events(spark):
    assert rows_of(debounced(frame(spark, []))) == []


def test_bursts_of_a_stream_over_restarts(spark, tmp_path):
    """Files of events come in one at a time, disordered within a second, and the query restarts in the middle of bursts."""
    rows = made(5, 60)
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    os.makedirs(source)
    rng = random.Random(1)
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(400_000))
    parts = [order[k : k + 12] for k in range(0, len(order), 12)]
    parts += [[("a", rows[-1][1] + 60_000_000, "end", "upsert"), ("b", rows[-1][1] + 60_000_000, "end", "upsert")]]
    for k, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        os.rename(glob.glob(str(tmp_path / f"w{k}" / "*.parquet"))[0], f"{source}/{k}.parquet")
        if k % 2 and k < len(parts) - 1:
            continue  # two files between restarts, and one at the end
        stream = debounced_stream(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source), "1 second")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None and not query.isActive
    want = plain(rows)
    assert [r for r in rows_of(spark.read.parquet(out)) if r[3] != "end"] == want


def test_buckets_keep_what_does_not_change(spark, tmp_path):
    root, store = tmp_path / "root", BucketedIndex(spark, str(tmp_path / "store"), buckets=16)
    os.makedirs(root)
    for k in range(12):
        (root / f"m{k}.py").write_text(f"def f{k}(x):\n    return x\n\n\ndef g{k}():\n    return f{k}(1)\n")
    config = settings.Config()
    store.put(index(spark, str(root), config, now_millis=1), 1)
    files = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(str(tmp_path / "store" / "*" / "file_bucket=*" / "*.parquet"))}
    folder = lambda p: (p.split("/")[-3], p.split("/")[-2])
    before = files()
    (root / "m3.py").write_text("def f3(x):\n    return x + 1\n")
    os.remove(root / "m5.py")
    events = spark.createDataFrame([("m3.py", "upsert", 1), ("m5.py", "unlink", 2)], "path string, kind string, seq long")
    made_ = process_batch(spark, store.current(), events, str(root), config, 2)
    store.put(made_, 2)
    after = files()
    kept = {folder(p) for p in before.keys() & after.keys()}
    assert len(kept) > 10 and all(before[p] == after[p] for p in before.keys() & after.keys())
    changed = {b for t, b in {folder(p) for p in before.keys() ^ after.keys()}}
    assert len(changed) <= 2
    fresh = index(spark, str(root), config, now_millis=2)
    key = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    now = store.current()
    assert key(now.symbols, "id", "name", "line") == key(fresh.symbols, "id", "name", "line") and key(now.call_edges, "id", "callee_id") == key(fresh.call_edges, "id", "callee_id")
    again = process_batch(spark, store.current(), events, str(root), config, 2)
    store.put(again, 2)
    assert files() == after and key(store.current().files, "path", "hash", "indexed_at") == key(now.files, "path", "hash", "indexed_at")
