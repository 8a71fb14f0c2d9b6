"""Bursts of events: those of one tree without a pause of half a second, with the last event of each path.

`debounced` finds them in a table of events, `debounced_stream` in a stream,
where a stateful processor keeps what is pending of each tree: sub-bursts, each
with its paths. A timer half a second after the last event of a sub-burst says
that nothing can join it any more. The state is part of the query's checkpoint,
so a burst that a restart interrupts goes on after it. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import order
from ..storage import Store

GAP_MICROS = 500_000
BATCHES = "root string, start timestamp, end timestamp, path string, kind string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _named(events: DataFrame) -> DataFrame:
    root = F.col("root").cast("string") if "root" in events.columns else F.lit("")
    return events.select(root.alias("root"), F.col("ts").cast("timestamp").alias("ts"), "path", "kind")


def debounced(events: DataFrame, store: Store | None = None) -> DataFrame:
    """(root, start, end, path, kind): the bursts that (root, ts, path, kind) fall into; `end` is half a second after the last event.

    Events are sorted by range, and each is compared with the one before, so
    neither a long burst nor many in one minute meet in one task. Events
    without a time are left out; of one path's events at the same time the
    greatest kind counts; a missing root column makes one tree.
    """
    store = store or Store(events.sparkSession, "debounce")
    rows = order.sorted_rows(_named(events).filter("ts is not null").withColumn("at", F.struct("root", F.unix_micros("ts").alias("us"))), store, "events", F.col("root"), F.col("ts"))
    seen = order.with_previous(rows, "at")
    fresh = F.coalesce((F.col("_previous.root").eqNullSafe(F.col("root"))) & (F.col("at.us") - F.col("_previous.us") < GAP_MICROS), F.lit(False))
    placed = store.keep(order.with_running(seen.withColumn("fresh", (~fresh).cast("long")), "fresh", "burst").select("burst", "root", "ts", "path", "kind"), "placed")
    times = placed.groupBy("burst").agg(F.min("ts").alias("start"), F.timestamp_micros(F.max(F.unix_micros("ts")) + GAP_MICROS).alias("end"))
    last = placed.groupBy("burst", "root", "path").agg(F.max(F.struct("ts", "kind"))["kind"].alias("kind"))
    return last.join(times, "burst").select("root", "start", "end", "path", "kind")


class Bursts(StatefulProcessor):
    """What is pending of one tree, as rows (start, last, path, ts, kind) by sub-burst.

    With event time, `final` is the watermark: a sub-burst ends when its last
    event is half a second before it, and events out of order join sub-bursts
    until then. With processing time, it is the clock.
    """

    def __init__(self, clock: bool):
        self.clock = clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "start long, last long, path string, ts long, kind string")

    def _read(self) -> list[tuple[int, int, dict]]:
        found: dict[tuple[int, int], dict] = {}
        if self.pending.exists():
            for start, last, path, ts, kind in self.pending.get():
                found.setdefault((start, last), {})[path] = (ts, kind or "")
        return [(a, b, paths) for (a, b), paths in found.items()]

    def _settle(self, key, bursts: list, final: int) -> Iterator[pd.DataFrame]:
        """Joins sub-bursts less than the gap apart, gives those that are over, and keeps the others."""
        joined: list = []
        for a, b, paths in sorted(bursts, key=lambda x: x[:2]):
            if joined and a - joined[-1][1] < GAP_MICROS:
                into = joined[-1]
                into[1] = max(into[1], b)
                for p, event in paths.items():
                    into[2][p] = max(into[2].get(p, event), event)
            else:
                joined.append([a, b, dict(paths)])
        over = [x for x in joined if x[1] + GAP_MICROS <= final]
        left = [(a, b, p, ts, kind) for a, b, paths in joined if b + GAP_MICROS > final for p, (ts, kind) in paths.items()]
        if left:
            self.pending.put(left)
        else:
            self.pending.clear()
        if over:
            rows = [(key[0], a, b + GAP_MICROS, p, kind) for a, b, paths in over for p, (_, kind) in sorted(paths.items(), key=lambda x: x[0] or "")]
            out = pd.DataFrame(rows, columns=["root", "start", "end", "path", "kind"])
            yield out.assign(start=pd.to_datetime(out["start"], unit="us"), end=pd.to_datetime(out["end"], unit="us"))

    def _final(self, timers) -> int:
        return (timers.getCurrentProcessingTimeInMs() if self.clock else timers.getCurrentWatermarkInMs()) * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bursts = self._read()
        for batch in rows:
            for us, path, kind in zip(batch["us"], batch["path"], batch["kind"]):
                bursts.append((us, us, {path: (us, kind or "")}))
        last = max((b for _, b, _ in bursts), default=None)
        if last is not None:
            for at in {b for _, b, _ in bursts}:
                self.handle.registerTimer(-(-(at + GAP_MICROS) // 1000))
        yield from self._settle(key, bursts, self._final(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, self._read(), max(self._final(timerValues), expiredTimerInfo.getExpiryTimeInMs() * 1000))

    def close(self) -> None:
        pass


def debounced_stream(events: DataFrame, delay: str | None = "1 second") -> DataFrame:
    """As `debounced`, of a stream; `delay` is how much later than others an event may come. None: times are arrivals, and bursts end by the clock.

    Sets the state store that stateful processors need, for the session. Rows
    of a burst come out together, in the batch in which it ends.
    """
    spark: SparkSession = events.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)
    named = _named(events).filter("ts is not null")
    named = (named if delay is None else named.withWatermark("ts", delay)).withColumn("us", F.unix_micros("ts"))
    return named.groupBy("root").transformWithStateInPandas(Bursts(delay is None), BATCHES, "Append", "ProcessingTime" if delay is None else "EventTime")
