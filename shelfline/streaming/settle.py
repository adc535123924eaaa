"""Settle times on a stream: a debounce with a cap, kept as state by key.

Events arrive in any order within the watermark's delay.  A key's state holds
the events that the watermark has not passed and those of triggers that are
still open; a timer closes a trigger once the watermark passes its cap, when
no event of its can come any more.  What is given for it then never changes.
A batch sets one timer a key, for the first of its triggers, and one that has
gone off sets the next: so a key is called a few times a batch, not once a
trigger.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

#: Timers need this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(span: str) -> int:
    """Microseconds of a span such as "12 HOURS"."""
    n, unit = span.split()
    return int(n) * {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000, "MILLISECOND": 1000}[unit.upper().rstrip("S")]


def closed_runs(events: list[tuple[int, bool]], quiet: int, cap: int, passed: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, bool]]]:
    """The settled runs (started, settled, grown) among the events (time,
    whether a trigger), and the events to keep.

    ``passed``: all events up to this time are known.  A trigger's run is its
    events up to the next trigger, the first late one and its cap.
    """
    events = sorted([*{e for e in events if e[1]}, *(e for e in events if not e[1])], key=lambda e: (e[0], not e[1]))
    done, first_open = [], None
    for k, (start, begins) in enumerate(events):
        if not begins:
            continue
        if start + cap >= passed:
            first_open = start
            break
        last, grown = None, 0
        for at, trigger in islice(events, k + 1, None):
            if trigger or at > start + cap or (last is not None and at > last + quiet):
                break
            last, grown = at, grown + 1
        done.append((start, min(start + cap, (last + quiet) if last is not None else start + cap), grown))
    return done, [e for e in events if e[0] > passed or (first_open is not None and e[0] >= first_open)]


def next_timer(events: list[tuple[int, bool]], cap: int) -> int:
    """When (in ms) some of the events can be let go: after the cap of the
    first trigger, or after them all if there is none."""
    starts = [at for at, trigger in events if trigger]
    return (min(starts) + cap if starts else max(at for at, _ in events)) // 1000 + 2


class _Settling(StatefulProcessor):
    def __init__(self, key: str, quiet: int, cap: int):
        self.key, self.quiet, self.cap = key, quiet, cap

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at bigint, trigger boolean")

    def _stored(self) -> list[tuple[int, bool]]:
        return [(int(at), bool(trigger)) for at, trigger in self.events.get()]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for frame in rows:
            fresh += zip(frame.iloc[:, 2].tolist(), frame.iloc[:, 3].tolist(), strict=True)
        if fresh:
            self.events.appendList(fresh)
            self.handle.registerTimer(next_timer(fresh, self.cap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._stored()
        # A watermark of w says that what comes is later than w ms.
        done, keep = closed_runs(known, self.quiet, self.cap, timerValues.getCurrentWatermarkInMs() * 1000)
        if not keep:
            self.events.clear()
        elif len(keep) < len(known):
            self.events.put(keep)
        if keep:
            self.handle.registerTimer(next_timer(keep, self.cap))
        if done:
            frame = pd.DataFrame(done, columns=["started", "settled", "grown"])
            frame.insert(0, self.key, [key[0]] * len(done))
            yield frame

    def close(self) -> None:
        pass


def settle_stream(events: DataFrame, key: str, at: str, is_trigger: Column, quiet: str, cap: str, delay: str) -> DataFrame:
    """The rows of ``settle_times`` over a stream: key, started, settled and
    grown, each once its trigger's cap lies behind the watermark.

    ``delay``: how far events may arrive out of order; what comes later than
    that is dropped by the watermark.  Events without a time are left out.
    Triggers of one key and time are one; other events of that time follow
    them.  The session's state store must be :data:`STORE`.
    """
    key_type, at_type = events.schema[key].dataType, events.schema[at].dataType
    time = F.col(at).cast("timestamp")
    read = events.where(F.col(at).isNotNull()).select(key, time.alias("__time"), F.unix_micros(time).alias("__at"), F.coalesce(is_trigger, F.lit(False)).alias("__trigger"))
    out = StructType([StructField(key, key_type), *[StructField(n, LongType()) for n in ("started", "settled", "grown")]])
    settled = read.withWatermark("__time", delay).groupBy(key).transformWithStateInPandas(_Settling(key, micros(quiet), micros(cap)), outputStructType=out, outputMode="Append", timeMode="EventTime")
    back = lambda c: F.timestamp_micros(c).cast(at_type).alias(c)
    return settled.select(key, back("started"), back("settled"), "grown")


def settle_batches(spark: SparkSession, batches: list[DataFrame], folder: str, key: str, at: str, is_trigger: Column, quiet: str, cap: str, delay: str) -> DataFrame:
    """Runs :func:`settle_stream` over batches that arrive one after another,
    then closes the stream: an event of no key, later than all caps, lets the
    watermark pass them.  Returns all rows that came out."""
    first, stop = f"{folder}/events", f"{folder}/settled"
    columns = batches[0].schema
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        batches[0].write.mode("append").parquet(first)
        stream = spark.readStream.schema(columns).parquet(first)
        settled = settle_stream(stream, key, at, is_trigger, quiet, cap, delay)
        query = settled.writeStream.format("parquet").option("path", stop).option("checkpointLocation", f"{folder}/progress").outputMode("append").start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    try:
        query.processAllAvailable()
        for batch in batches[1:]:
            batch.write.mode("append").parquet(first)
            query.processAllAvailable()
        latest = spark.read.schema(columns).parquet(first).agg(F.max(at).alias(at))
        for k in (1, 2):  # the second lets the first one's watermark take effect
            over = F.make_dt_interval(secs=F.lit(k * (micros(cap) + micros(delay)) / 1e6 + k))
            end = latest.select(*[(F.col(at) + over if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns.fields])
            end.where(F.col(at).isNotNull()).write.mode("append").parquet(first)
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(settled.schema).parquet(stop)
