"""Structured Streaming forms: the same step functions over keyed state.

Rows wait until the watermark has passed them and are then handed to the step
in order of their clock, so results do not depend on how the stream was cut
into batches. Rows that come later than the watermark are dropped; :mod:`trackloom.streaming.late`
keeps them and closes idle keys.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _event_time(df: DataFrame, clock: str, ticks_per_second: float) -> DataFrame:
    """An event time derived from the semantic clock, used for the watermark only."""
    return df.withColumn("_ts", F.timestamp_seconds(F.col(clock) / ticks_per_second))


def stream_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step,
    *,
    delay: str = "10 seconds",
    delay_ticks: float,
    ticks_per_second: float = 1.0,
) -> DataFrame:
    """Run a step over a stream, one state per key.

    State per key is the step's own state plus the rows younger than the
    watermark. ``delay_ticks`` is the same delay on the key's clock.
    """
    keys, order = list(keys), list(order)
    names = list(dict.fromkeys([*order, *step.tick, *step.columns]))
    rows = _event_time(df, order[0], ticks_per_second).withWatermark("_ts", delay)
    key_fields = [df.schema[k] for k in keys]
    output = T.StructType([*key_fields, *T._parse_datatype_string(step.output).fields])
    state_schema = T.StructType(
        [
            T.StructField("saved", T.StringType()),
            T.StructField("waiting", T.StringType()),
            T.StructField("newest", T.DoubleType()),
        ]
    )

    def plain(value):
        if value is None or isinstance(value, (str, bool)):
            return value
        if isinstance(value, float) and value != value:
            return None
        return value.item() if hasattr(value, "item") else value

    def advance(key, batches, state: GroupState):
        saved, waiting, newest = state.get if state.exists else (None, "[]", float("-inf"))
        pending = [tuple(r) for r in json.loads(waiting)]
        for batch in batches:
            pending.extend(
                tuple(plain(v) for v in row) for row in batch[names].itertuples(index=False)
            )
        at = [names.index(c) for c in order]
        pending.sort(key=lambda r: tuple((r[i] is not None, r[i]) for i in at))
        if pending:
            newest = max(newest, float(pending[-1][at[0]]))
        bound = float("inf") if state.hasTimedOut else newest - delay_ticks
        ready = [r for r in pending if r[at[0]] < bound]
        rest = pending[len(ready) :]
        current = step.load(saved)
        tick_at = [names.index(c) for c in step.tick]
        take = [names.index(c) for c in step.columns]
        out, group, last = [], [], None
        for row in ready:
            tick = tuple(row[i] for i in tick_at)
            if group and tick != last:
                out.extend(step.feed(current, group))
                group = []
            last = tick
            group.append(tuple(row[i] for i in take))
        if group:
            out.extend(step.feed(current, group))
        state.update((step.save(current), json.dumps(rest), newest))
        if rest:
            # waiting rows are released once the watermark has passed all of them
            due = int(newest / ticks_per_second * 1000) + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(
                [tuple(key) + tuple(o) for o in out], columns=[f.name for f in output]
            ).astype(object)

    return rows.groupBy(*keys).applyInPandasWithState(
        advance, output, state_schema, "append", GroupStateTimeout.EventTimeTimeout
    )


def distinct_stream(events: DataFrame, signature: Sequence[str], *, clock: str, delay: str) -> DataFrame:
    """One event per signature within the watermark."""
    return events.withWatermark(clock, delay).dropDuplicatesWithinWatermark(list(signature))


def activity_sessions(rows: DataFrame, *, keys: Sequence[str], clock: str, gap: str, delay: str) -> DataFrame:
    """Sessions of a stream: a new one after a gap (equality still joins)."""
    return (
        rows.withWatermark(clock, delay)
        .groupBy(*keys, F.session_window(clock, gap))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
