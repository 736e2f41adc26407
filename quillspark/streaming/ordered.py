"""Keyed state over events in the order of their time, whatever the order and the batches they come in.

Events wait in state until the watermark has passed them, and are then taken in order. So the rows don't depend on how files fall into batches, as
long as no event is later than the delay. A key's state is what its rule needs and the events of one delay; of these a task holds a day at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..plans.named import named
from ..sources.files import scratch
from .live import events_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "at array<bigint>, event_id array<bigint>, given array<double>"
#: Microseconds of a day, and how many events of a batch a task holds before they go to state.
DAY, HELD = 86_400_000_000, 200_000


class InOrder(StatefulProcessor):
    """step(state, microseconds, given) gives the new state, a tuple, and a result, or None for no result. A timer stands at a key's earliest waiting event.
    Events wait in state in runs of a day each, so what a task holds is a day of a key, however many days a batch has or wait."""

    def __init__(self, state: str, first: tuple, step: Callable, key: str):
        self.kind, self.first, self.step, self.key = state, first, step, key

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", self.kind)
        self.runs = handle.getValueState("runs", "n bigint")
        self.waiting = handle.getMapState("waiting", "day bigint, run bigint", WAITING)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest, held, size = None, [], 0
        for pdf in rows:
            if not len(pdf):
                continue
            held.append(tuple(pdf[c].to_numpy() for c in ("at", "event_id", "given")))
            first, size = int(held[-1][0].min()), size + len(pdf)
            earliest = first if earliest is None else min(earliest, first)
            if size >= HELD:
                self._wait(held)
                held, size = [], 0
        self._wait(held)
        if earliest is not None:
            self._ring(earliest)
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        days: dict[int, list[int]] = {}
        for day, run in self.waiting.keys():
            days.setdefault(day, []).append(run)
        state = tuple(self.now.get()) if self.now.exists() else self.first
        for day in sorted(days):
            if day * DAY >= passed:
                self._ring(day * DAY)
                break
            parts = [self.waiting.getValue((day, run)) for run in days[day]]
            at, event, given = (np.concatenate([np.asarray(p[i]) for p in parts]) for i in range(3))
            order = np.lexsort((event, at))
            n, found = int(np.count_nonzero(at < passed)), []
            for i in order[:n].tolist():
                state, result = self.step(state, int(at[i]), float(given[i]))
                if result is not None:
                    found.append((key[0], int(event[i]), float(result)))
            for run in days[day]:
                self.waiting.removeKey((day, run))
            if found:
                yield self._rows(found)
            if n < len(order):
                rest = order[n:]
                self._wait([(at[rest], event[rest], given[rest])])
                self._ring(int(at[rest[0]]))
                break
        self.now.update(state)
        yield self._rows([])

    def _wait(self, held: list[tuple]) -> None:
        """Puts events into state, as runs of a day each."""
        if not held:
            return
        at, event, given = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(at // DAY, kind="stable")
        days, starts = np.unique((at // DAY)[order], return_index=True)
        run = self.runs.get()[0] if self.runs.exists() else 0
        for day, some in zip(days.tolist(), np.split(order, starts[1:]), strict=True):
            self.waiting.updateValue((day, run), (at[some].tolist(), event[some].tolist(), given[some].tolist()))
            run += 1
        self.runs.update((run,))

    def _rows(self, found: list[tuple]) -> pd.DataFrame:
        keys, events, results = zip(*found, strict=True) if found else ((), (), ())
        return pd.DataFrame({self.key: pd.Series(keys, dtype=object), "event_id": pd.Series(events, dtype="int64"), "result": pd.Series(results, dtype="float64")})

    def _ring(self, at: int) -> None:
        """A timer past the event, so that when it goes off the event is due."""
        self.handle.registerTimer(at // 1000 + 1)


def in_order(events: DataFrame, key: str, given: Column, state: str, first: tuple, step: Callable, delay: str, kind: str = "string") -> DataFrame:
    """(key, event_id, result) of the events (key, event_id, t) that have a result, once each."""
    sent = events.select(F.col(key), "event_id", F.unix_micros("t").alias("at"), given.cast("double").alias("given"), "t").withWatermark("t", delay)
    return sent.groupBy(key).transformWithStateInPandas(InOrder(state, first, step, key), f"{key} {kind}, event_id bigint, result double", "Append", "EventTime")


def closed(spark: SparkSession, events: DataFrame, build: Callable[[DataFrame], DataFrame], after: str = "2200-01-01") -> DataFrame:
    """build(events) run over all that is available, then closed: a mark, a row of event -1, no key and a far time in a folder of its own, moves the watermark
    past all that waits. The query goes on from its checkpoint for that, so a run that isn't closed yet can go on with more files."""
    at = scratch(spark)
    marks = spark.createDataFrame([], events.schema)
    marks.write.parquet(f"{at}/marks")
    held = spark.readStream.schema(events.schema).parquet(f"{at}/marks")
    df = build(events.unionByName(held))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for turn in (0, 1):
            if turn:
                row = [F.lit(-1 if f.name == "event_id" else None).cast(f.dataType).alias(f.name) for f in events.schema.fields if f.name != "t"]
                spark.range(1).select(*row, F.lit(after).cast("timestamp").alias("t")).select(*events.columns).write.mode("append").parquet(f"{at}/marks")
            df.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


def anomaly(window: int = 100, least: int = 10, above: float = 2.5, cooldown: timedelta = timedelta(seconds=300)) -> Callable:
    """A rule for in_order() with state (values, last alert): a value that is `above` standard deviations from the mean of the last `window`, itself
    included, once there are `least`; but none within the cooldown of the last alert that went out. The result is the distance in deviations."""
    quiet = cooldown // timedelta(microseconds=1)

    def step(state: tuple, at: int, value: float) -> tuple:
        values, last = [*state[0], value][-window:], state[1]
        if len(values) < least:
            return (values, last), None
        mean = sum(values) / len(values)
        spread = (sum((x - mean) ** 2 for x in values) / len(values)) ** 0.5 or 0.01
        z = (value - mean) / spread
        if abs(z) <= above or (last >= 0 and at - last < quiet):
            return (values, last), None
        return (values, at), z

    return step


@named("stream_anomalies", """with recursive w as (select event_type, event_id, epoch_us(ts) as us, value, count(*) over o as n, avg(value) over o as mean, stddev_pop(value) over o as sd from events where value is not null window o as (partition by event_type order by ts, event_id rows between 99 preceding and current row)),
    z as (select event_type, event_id, us, (value - mean) / case when sd > 0 then sd else 0.01 end as z from w where n >= 10), c as (select *, row_number() over (partition by event_type order by us, event_id) as i from z where abs(z) > 2.1),
    r as (select event_type, event_id, z, i, us as last, true as ok from c where i = 1 union all select c.event_type, c.event_id, c.z, c.i, case when c.us - r.last >= 43200000000 then c.us else r.last end, c.us - r.last >= 43200000000 from r join c on c.event_type = r.event_type and c.i = r.i + 1)
    select event_type, event_id, round(z, 4) as z from r where ok""")
def stream_anomalies(spark, folder):
    """Values 2.1 deviations from a kind's last hundred, but none within twelve hours of the last alert (STR4, WIN2); the given values are spread evenly, so 2.5 is never met."""
    events = events_stream(spark, folder).where("value is not null").select("event_type", "event_id", "value", "t")
    rule = anomaly(above=2.1, cooldown=timedelta(hours=12))
    found = closed(spark, events, lambda e: in_order(e, "event_type", F.col("value"), "values array<double>, last bigint", ([], -1), rule, "1 day"))
    return found.select("event_type", "event_id", F.round("result", 4).alias("z"))
