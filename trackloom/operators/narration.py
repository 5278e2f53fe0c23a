"""From scene events to the few messages a listener hears."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import messages as M
from trackloom.operators.fold import fold
from trackloom.operators.steps import MessageQueue, NarrateBatch

EVENT_ATTRIBUTES = {
    "route_number": "string",
    "text": "string",
    "description": "string",
    "visible_options": "array<string>",
    "screen_fingerprint": "string",
    "hazard_level": "string",
    "zone": "string",
    "emission_index": "bigint",
    "previous_state": "string",
    "current_state": "string",
}


def narratable(events: DataFrame, **policy) -> DataFrame:
    """Events with a message: adds message, priority and dedup_key, drops the rest."""
    missing = {
        name: F.lit(None).cast(kind)
        for name, kind in EVENT_ATTRIBUTES.items()
        if name not in events.columns
    }
    full = events.withColumns(missing) if missing else events
    told = full.withColumns(
        {
            "message": M.message(**policy),
            "priority": M.priority(F.col("event_type"), F.col("object_type")),
        }
    ).filter(F.col("message").isNotNull() & (F.col("priority") < 100))
    return told.withColumn("dedup_key", M.dedup_key(text=F.col("message"))).drop(*missing)


def select_best(
    candidates: DataFrame,
    *,
    batch: Sequence[str] = ("source_id", "timestamp_s"),
    per_batch: int = 1,
    order: str = "seq",
) -> DataFrame:
    """The most urgent messages of every batch of simultaneous events."""
    w = Window.partitionBy(*batch).orderBy("priority", order)
    ranked = candidates.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= per_batch)


def narration_queue(
    candidates: DataFrame,
    ticks: DataFrame,
    *,
    keys: Sequence[str] = ("source_id",),
    capacity: int = 32,
    cooldown_s: float = 5.0,
    default_ttl_s: float = 5.0,
    ttl_by_event_type: Mapping[str, float] | None = None,
    span: float = 3600.0,
) -> DataFrame:
    """At most one message per tick of a source, from a bounded waiting list.

    ``candidates`` come from :func:`narratable` with ``now_s`` and ``seq``;
    ``ticks`` holds every (source, now_s), also those without events.
    """
    keys = list(keys)
    ttl = F
    for kind, seconds in (ttl_by_event_type or {}).items():
        ttl = ttl.when(F.upper(F.trim("event_type")) == kind.strip().upper(), float(seconds))
    ttl = F.lit(float(default_ttl_s)) if ttl is F else ttl.otherwise(float(default_ttl_s))
    waiting = candidates.select(
        *keys, "now_s", "seq", "message", "priority", "dedup_key", ttl.alias("ttl_s")
    )
    clock = ticks.select(*keys, "now_s").distinct().withColumn("seq", F.lit(-1).cast("bigint"))
    rows = waiting.withColumn("seq", F.col("seq").cast("bigint")).unionByName(
        clock, allowMissingColumns=True
    )
    return fold(rows, keys, ["now_s", "seq"], MessageQueue(capacity, cooldown_s), span=span)


def narrate_batches(
    candidates: DataFrame,
    *,
    keys: Sequence[str] = ("source_id",),
    cooldown_s: float = 5.0,
    per_batch: int = 1,
    span: float = 3600.0,
) -> DataFrame:
    """Queue-less narration on event time: repeats within the cooldown are silent."""
    step = NarrateBatch(cooldown_s, per_batch)
    return fold(candidates, keys, ["timestamp_s", "seq"], step, span=span)
