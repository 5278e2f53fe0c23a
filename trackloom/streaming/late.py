"""A step over keyed state whose late rows are kept, and whose idle keys leave the state.

``transformWithState`` holds three things per key: the step's own state, the rows that are
younger than the allowed delay, and the bound up to which rows were handed to the step. Time is
that of each key: a key's clock is the newest value it has shown, so one key that runs ahead
makes no other key's rows late. A row below the bound is not dropped but returned as late. A key
without rows for ``idle_ms`` is closed by a timer: what waits is handed over and the state is
cleared; only the bound outlives it, for ``remember_ms``, so that stragglers are still known as late.

The state store must be able to hold lists and timers: start such a stream within :func:`stream_settings`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    # timers of the processing clock ask for one more batch for ever; they are served with the next rows
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """What a stream with timers must find when it is started; it keeps a copy, so the session gets its own back."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class LateFold(StatefulProcessor):
    """Hands the rows of a key to a step in order of their clock; see the module's text."""

    def __init__(self, step, keys: list[str], order: list[str], row_schema: T.StructType, delay: float, idle_ms: int, remember_ms: int):
        self.step, self.keys, self.order, self.row_schema = step, keys, order, row_schema
        self.names = row_schema.fieldNames()
        self.result_names = T._parse_datatype_string(step.output).fieldNames()
        self.delay, self.idle_ms, self.remember_ms = delay, idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", "state string, newest double")
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.bound = handle.getValueState("bound", "released double", self.remember_ms)

    def _order(self, row: tuple) -> tuple:
        at = [self.names.index(c) for c in self.order]
        return tuple((row[i] is not None, row[i]) for i in at)

    def _row(self, key: tuple, result: dict | None = None, row: dict | None = None) -> Row:
        return Row(
            **dict(zip(self.keys, key)),
            late=row is not None,
            result=None if result is None else Row(**result),
            row=None if row is None else Row(**row),
        )

    def _fed(self, key: tuple, state, rows: list[tuple]) -> Iterator[Row]:
        """Results of the step, ticks as groups; ``rows`` are in order."""
        tick_at = [self.names.index(c) for c in self.step.tick]
        take = [self.names.index(c) for c in self.step.columns]
        group, last = [], None
        for row in [*rows, None]:
            tick = None if row is None else tuple(row[i] for i in tick_at)
            if group and tick != last:
                for out in self.step.feed(state, group):
                    yield self._row(key, result=dict(zip(self.result_names, out)))
                group = []
            if row is not None:
                last = tick
                group.append(tuple(row[i] for i in take))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock = self.names.index(self.order[0])
        closed = self.bound.get()
        released = closed[0] if closed else -math.inf
        fresh = []
        for row in rows:
            plain = tuple(row[n] for n in self.names)
            if plain[clock] is None or plain[clock] < released:
                yield self._row(key, row=dict(zip(self.names, plain)))
            else:
                fresh.append(plain)
        if not fresh:
            return
        saved = self.saved.get()
        text, newest = saved if saved else (None, -math.inf)
        state = self.step.load(text)
        pending = sorted([*(tuple(r) for r in self.waiting.get()), *fresh], key=self._order)
        newest = max(newest, float(pending[-1][clock]))
        released = max(released, newest - self.delay)
        ready = [r for r in pending if r[clock] < released]
        yield from self._fed(key, state, ready)
        self._keep(pending[len(ready) :])
        self.saved.update((self.step.save(state), newest))
        self.bound.update((released,))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def _keep(self, rows: list[tuple]) -> None:
        if rows:
            self.waiting.put(rows)
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        saved = self.saved.get()
        if not saved:
            return
        state = self.step.load(saved[0])
        yield from self._fed(key, state, sorted((tuple(r) for r in self.waiting.get()), key=self._order))
        self.waiting.clear()
        self.saved.clear()
        self.bound.update((math.nextafter(saved[1], math.inf),))

    def close(self) -> None:
        pass


def late_fold(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step,
    *,
    delay: float,
    idle_ms: int = 3_600_000,
    remember_ms: int = 86_400_000,
) -> DataFrame:
    """(keys, late, result, row): results of the step, and late rows as they came.

    ``delay`` is in ticks of the key's clock, ``order[0]``; rows of one tick must have one clock
    value. A row without a clock value is late too. Written with ``partitionBy("late")`` the stream is
    two tables, results and late rows (:func:`start_two_tables`).
    """
    keys, order = list(keys), list(order)
    names = list(dict.fromkeys([*order, *step.tick, *step.columns]))
    row_schema = T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names])
    output = T.StructType(
        [
            *(rows.schema[k] for k in keys),
            T.StructField("late", T.BooleanType()),
            T.StructField("result", T._parse_datatype_string(step.output)),
            T.StructField("row", row_schema),
        ]
    )
    processor = LateFold(step, keys, order, row_schema, delay, idle_ms, remember_ms)
    return rows.select(*dict.fromkeys([*keys, *names])).groupBy(*keys).transformWithState(processor, output, "append", "ProcessingTime")


def start_two_tables(folded: DataFrame, path: str, checkpoint: str):
    """Write results and late rows as the two parts of one table, everything that is there, then end."""
    writer = folded.writeStream.format("parquet").partitionBy("late").outputMode("append")
    with stream_settings(folded.sparkSession):
        return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def two_tables(spark: SparkSession, path: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Results and late rows that :func:`start_two_tables` wrote."""
    written = spark.read.parquet(path).withColumn("late", F.col("late").cast("boolean"))
    return (
        written.filter(~F.col("late")).select(*keys, "result.*"),
        written.filter("late").select(*keys, *[F.col("row")[c].alias(c) for c in written.schema["row"].dataType.names if c not in keys]),
    )
