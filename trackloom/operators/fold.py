"""Exact sequential folds over keys of any size.

A fold walks the rows of one key in order and carries a small state. Keys are
cut into chunks of a fixed span of their clock and all chunks run in parallel:
first each from an empty state, then again from the state in which the chunk
before it ended, for as long as any chunk's start still differs. The first
chunk of a key is right from the beginning and a chunk is right once its
predecessor is, so the loop ends in exactly the result of one long walk. The
states forget quickly (misses, cooldowns, silence), so two or three rounds are
usual. Only chunks whose start changed run again.

Inside a task rows are streamed from a sorted shuffle partition; only the
rows of one tick are held.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trackloom.operators.keyed import CHUNK, DEFAULT_SPAN, chunk_of
from trackloom.session import cut, tasks


class Step(Protocol):
    """A per-key state machine used by batch folds, streams and tests alike."""

    #: input columns handed to ``feed`` as tuples, in this order
    columns: Sequence[str]
    #: rows that share these columns form one tick and are fed together
    tick: Sequence[str]
    #: output columns as a DDL string
    output: str

    def load(self, saved: str | None) -> Any: ...

    def save(self, state: Any) -> str: ...

    def feed(self, state: Any, rows: list[tuple]) -> list[tuple]: ...


def _run_chunks(step: Step, key_count: int, names: list[str], schema: pa.Schema, emit: bool):
    positions = [names.index(c) for c in step.columns]
    tick_positions = [names.index(c) for c in step.tick]
    kind_at, start_at = names.index("_kind"), names.index("_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        state = None
        tick = None
        pending: list[tuple] = []
        out: list[tuple] = []

        def flush_tick():
            nonlocal pending
            if pending:
                produced = step.feed(state, pending)
                if emit:
                    out.extend(current + item for item in produced)
                pending = []

        def close():
            flush_tick()
            if current is not None and not emit:
                note = step.note(state) if hasattr(step, "note") else None
                out.append(current + (step.save(state), note))

        def batch_of(rows):
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema
            )

        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                identity = row[: key_count + 1]
                if identity != current:
                    close()
                    current, tick = identity, None
                    state = step.load(None)
                if row[kind_at] == 0:
                    state = step.load(row[start_at])
                    continue
                now = tuple(row[p] for p in tick_positions)
                if now != tick:
                    flush_tick()
                    tick = now
                pending.append(tuple(row[p] for p in positions))
            if len(out) >= 4096:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)

    return run


def _walk(
    rows: DataFrame, starts: DataFrame, keys: list[str], order: list[str], step: Step, emit: bool
) -> DataFrame:
    needed = list(dict.fromkeys([*order, *step.tick, *step.columns]))
    needed = [c for c in needed if c not in keys]
    body = rows.select(
        *keys, CHUNK, F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_start"), *needed
    )
    heads = starts.select(*keys, CHUNK, F.lit(0).alias("_kind"), "_start").select(
        "*", *[F.lit(None).cast(body.schema[c].dataType).alias(c) for c in needed]
    )
    names = [*keys, CHUNK, "_kind", "_start", *needed]
    key_fields = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    key_fields.append(T.StructField(CHUNK, T.LongType()))
    extra = (
        T._parse_datatype_string(step.output).fields
        if emit
        else [T.StructField("_end", T.StringType()), T.StructField("_note", T.StringType())]
    )
    schema = T.StructType([*key_fields, *extra])
    lined_up = (
        body.unionByName(heads)
        .repartition(tasks(rows.sparkSession), *keys, CHUNK)
        .sortWithinPartitions(*keys, CHUNK, "_kind", *order)
    )
    return lined_up.mapInArrow(
        _run_chunks(step, len(keys), names, to_arrow_schema(schema), emit), schema
    )


def settle(
    rows: DataFrame, keys: list[str], order: list[str], step: Step
) -> tuple[DataFrame, DataFrame | None]:
    """Start states of all chunks, and their end states where more than one round ran."""
    chunks = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
    by_key = Window.partitionBy(*keys).orderBy(CHUNK)
    starts = chunks.select(
        *keys,
        CHUNK,
        F.lit(None).cast("string").alias("_start"),
        F.lag(CHUNK).over(by_key).isNotNull().alias("_follows"),
    )
    starts = cut(starts)
    if starts.filter("_follows").isEmpty():
        return starts, None
    ends = cut(_walk(rows, starts, keys, order, step, emit=False))
    while True:
        needed = starts.join(ends, [*keys, CHUNK]).select(
            *keys,
            CHUNK,
            "_start",
            "_follows",
            "_end",
            "_note",
            F.lag("_end").over(by_key).alias("_needed"),
        )
        needed = cut(needed)
        changed = needed.filter(~F.col("_needed").eqNullSafe(F.col("_start"))).select(
            *keys, CHUNK, F.col("_needed").alias("_start"), "_follows"
        )
        if changed.isEmpty():
            return starts, ends
        again = rows.join(changed.select(*keys, CHUNK), [*keys, CHUNK], "left_semi")
        redone = _walk(again, changed, keys, order, step, emit=False)
        kept = needed.filter(F.col("_needed").eqNullSafe(F.col("_start"))).select(
            *keys, CHUNK, "_end", "_note"
        )
        ends = cut(kept.unionByName(redone))
        starts = needed.select(*keys, CHUNK, F.col("_needed").alias("_start"), "_follows")


def fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Step,
    *,
    span: float = DEFAULT_SPAN,
    keep_chunk: bool = False,
) -> DataFrame:
    """Run ``step`` over every key in ``order``; ``order[0]`` is the numeric clock."""
    keys, order = list(keys), list(order)
    rows = df.withColumn(CHUNK, chunk_of(order[0], span))
    starts, _ = settle(rows, keys, order, step)
    result = _walk(rows, starts, keys, order, step, emit=True)
    return result if keep_chunk else result.drop(CHUNK)


def throttle(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    interval: float,
    *,
    span: float = DEFAULT_SPAN,
) -> DataFrame:
    """Rows that come at least ``interval`` after the last row that passed.

    Passing depends on the whole past, yet a chunk only maps the time of the
    last passed row before it to that of the last one within it. These maps
    are built in parallel, followed once per key, and give every chunk its
    exact start: two passes over the rows whatever their spacing.
    """
    from trackloom.operators.steps import Throttle, ThrottleChain, ThrottleMap

    keys, order = list(keys), list(order)
    keep = [c for c in df.columns if c not in keys]
    rows = df.withColumn(CHUNK, chunk_of(order[0], span))
    blank = cut(
        rows.groupBy(*keys, CHUNK).agg(F.lit(None).cast("string").alias("_start"))
    )
    several = blank.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    starts = blank
    if not several.isEmpty():
        maps = _walk(rows, blank, keys, order, ThrottleMap(order[0], interval, order), emit=False)
        steps = maps.select(*keys, F.col(CHUNK).alias("_chunk_no"), "_end")
        starts = cut(
            fold(steps, keys, ["_chunk_no"], ThrottleChain(interval), span=2**62).withColumnRenamed(
                "_chunk_no", CHUNK
            )
        )
    ddl = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    step = Throttle(order[0], interval, keep, ddl)
    step.tick = tuple(order)
    return _walk(rows, starts, keys, order, step, emit=True).select(*df.columns)
