"""Frame clocks that never run backwards.

What a row offers, how far it may push the clock on its own and what it must reach at least are
column expressions over the whole table. Only the recurrence itself is sequential, one number per key:

    told = offered                          if offered is later than the last time told
    told = max(least, last told + advance)  otherwise
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.fold import fold
from trackloom.operators.keyed import DEFAULT_SPAN, previous_row
from trackloom.operators.steps import _JsonStep


class CatchUp(_JsonStep):
    """The recurrence above; where ``strict`` a row must move the clock by the least step there is."""

    columns = ("_offered", "_advance", "_least", "_strict", "_repairs")

    def __init__(self, order: Sequence[str], order_ddl: Sequence[str]):
        self.columns = (*CatchUp.columns, *order)
        self.tick = tuple(order)
        self.output = ", ".join([*order_ddl, "timestamp_s double", "repaired boolean"])

    def initial(self):
        return None

    def load(self, saved):
        return [super().load(saved)]

    def save(self, state):
        return super().save(state[0])

    def feed(self, state, rows):
        out = []
        for offered, advance, least, strict, repairs, *order in rows:
            last = state[0]
            if last is None:
                told, repaired = least if offered is None else offered, False
            elif offered is not None and offered > last:
                told, repaired = offered, False
            else:
                told, repaired = max(least, last + advance), repairs
                if strict and told <= last:
                    told = math.nextafter(last, math.inf)
            state[0] = told
            out.append((*order, told, repaired))
        return out


def _run(df: DataFrame, keys: list[str], order: list[str], span: float) -> DataFrame:
    ddl = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order]
    return fold(df, keys, order, CatchUp(order, ddl), span=span)


def _usable(time: Column) -> Column:
    return time.isNotNull() & ~F.isnan(time) & (time >= 0) & (time < float("inf"))


def file_clock(df: DataFrame, keys: Sequence[str] = ("source_id",), *, span: float = DEFAULT_SPAN) -> DataFrame:
    """Time of every frame of a file from ``position_ms`` and ``fps``.

    A position that does not pass the last time told is replaced by the nominal time of its frame
    or by one frame more than was told, whichever is later; a missing one by the nominal time, but
    never by less than was told. A file starts at 0 or later.
    """
    fps = F.col("fps").cast("double")
    known = _usable(fps) & (fps > 0)
    frame, position = F.col("frame_index"), F.col("position_ms").cast("double") / 1000
    nominal = F.when(known, frame / fps).otherwise(0.0)
    usable = _usable(position) & ((frame == 0) | (position > 0))
    first = frame == 0
    rows = df.select(
        *keys,
        "frame_index",
        F.when(usable, position).alias("_offered"),
        F.when(usable & ~first & known, 1 / fps).otherwise(0.0).alias("_advance"),
        F.when(usable & first, position).otherwise(nominal).alias("_least"),
        F.lit(False).alias("_strict"),
        (usable & ~first).alias("_repairs"),
    )
    return _run(rows, list(keys), ["frame_index"], span)


def live_clock(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("seq",), *, repair_with_processing: bool = True, span: float = DEFAULT_SPAN
) -> DataFrame:
    """Time of every frame of a live session from ``captured_at_s``, else ``received_at_s``.

    A captured time that does not pass the last time told, or none at all, is repaired: the clock
    moves on by the time that processing took since the previous frame, and always moves.
    """
    keys, order = list(keys), list(order)
    captured, received = F.col("captured_at_s").cast("double"), F.col("received_at_s").cast("double")
    own = F.when(_usable(captured), captured)
    known = F.coalesce(own, F.when(_usable(received), received), F.lit(0.0))
    before = previous_row(df, keys, order, {"_processed": "processing_started_at_s"}, span=span)
    spent = F.coalesce(F.greatest(F.coalesce("processing_started_at_s", F.lit(0.0)) - F.col("_processed"), F.lit(0.0)), F.lit(0.0))
    rows = before.select(
        *keys,
        *order,
        own.alias("_offered"),
        (spent if repair_with_processing else F.lit(0.0)).alias("_advance"),
        # The first row of a session tells its own time; later rows need no floor when they are repaired.
        (F.when(F.col("_has_previous"), -1.0).otherwise(known) if repair_with_processing else known).alias("_least"),
        F.lit(repair_with_processing).alias("_strict"),
        F.lit(True).alias("_repairs"),
    )
    return _run(rows, keys, order, span)
