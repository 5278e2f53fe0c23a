"""Scene events from analysis results, and the latest scene per session.

Results are rows per object and frame: source_id, stable_id, frame_index,
timestamp_s, object_type, state, is_uncertain, confidence and the nullable
detection_confidence, motion_confidence, signal_confidence,
minimum_detection_confidence, route_number, route_confidence, text,
description, screen_fingerprint, screen_is_confirmed, screen_confidence,
visible_options.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from trackloom.functions import fixed
from trackloom.functions.classes import (
    combined_evidence,
    importance,
    known_state,
    norm_token,
    presence_confidence,
    state_confidence,
    state_confidence_ok,
)
from trackloom.functions.geometry import (
    distance_label,
    is_own_body,
    position_label,
    settled_position,
)
from trackloom.functions.strings import strip
from trackloom.operators.keyed import DEFAULT_SPAN, carry_last, previous_row
from trackloom.operators.runs import OBJECT, changed_values, presence

RESULT_DEFAULTS = {
    "detection_confidence": "double",
    "motion_confidence": "double",
    "signal_confidence": "double",
    "minimum_detection_confidence": "double",
    "route_number": "string",
    "route_confidence": "double",
    "text": "string",
    "description": "string",
    "screen_fingerprint": "string",
    "screen_is_confirmed": "boolean",
    "screen_confidence": "double",
    "visible_options": "array<string>",
}
ATTRIBUTES = ("route_number", "text", "description", "screen_fingerprint", "visible_options")
EVENT_COLUMNS = (
    "source_id",
    "stable_id",
    "frame_index",
    "phase",
    "event_type",
    "object_type",
    "previous_state",
    "current_state",
    "confidence",
    "is_uncertain",
    *ATTRIBUTES,
)


def complete_results(results: DataFrame) -> DataFrame:
    """Add missing optional columns and the evidence derived from them."""
    missing = {
        name: F.lit(None).cast(kind)
        for name, kind in RESULT_DEFAULTS.items()
        if name not in results.columns
    }
    full = results.withColumns(missing) if missing else results
    return full.withColumns(
        {
            "object_type": norm_token(F.col("object_type")),
            "_known": F.when(~F.col("is_uncertain"), known_state(F.col("state"))),
            "_state_conf": state_confidence(
                F.col("object_type"),
                F.col("detection_confidence"),
                F.col("confidence"),
                F.col("motion_confidence"),
                F.col("signal_confidence"),
                F.col("minimum_detection_confidence"),
            ),
        }
    )


def confirm_transitions(
    results: DataFrame,
    transitions: DataFrame,
    *,
    keys: Sequence[str] = OBJECT,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Transitions an analysis result of the same object agrees with.

    A transition waits for the next certain result of its object; the newest
    one waiting wins, and a result with another state drops it.
    """
    keys = list(keys)
    certain = results.filter(
        F.col("_known").isNotNull() & state_confidence_ok(F.col("object_type"), F.col("_state_conf"))
    ).select(*keys, "frame_index", F.lit(1).alias("_kind"), F.col("_known").alias("_confirmed"))
    asked = transitions.select(
        *keys, "frame_index", F.lit(0).alias("_kind"), "previous_state", "current_state"
    )
    both = certain.unionByName(asked, allowMissingColumns=True)
    target = carry_last(
        both,
        keys,
        ["frame_index", "_kind"],
        {
            "_answer": F.when(
                F.col("_kind") == 1, F.struct(F.col("frame_index").alias("f"), "_confirmed")
            )
        },
        span=span,
        reverse=True,
    )
    waiting = target.filter((F.col("_kind") == 0) & F.col("_answer").isNotNull())
    newest = (
        waiting.withColumn("_held", F.col("_answer.f") > F.col("frame_index"))
        .groupBy(*keys, F.col("_answer.f").alias("target_frame"), "_held")
        .agg(
            F.max_by(
                F.struct("previous_state", "current_state", "_answer", "frame_index"), "frame_index"
            ).alias("t")
        )
    )
    return newest.filter("t.current_state = t._answer._confirmed").select(
        *keys,
        F.col("target_frame").alias("frame_index"),
        F.when(F.col("_held"), 0).otherwise(1).alias("phase"),
        "t.previous_state",
        "t.current_state",
        F.col("t.frame_index").alias("observed_frame"),
    )


def state_events(
    results: DataFrame,
    transitions: DataFrame,
    *,
    keys: Sequence[str] = OBJECT,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Changes from confirmed transitions and from the results themselves.

    Both set the known state of an object; whichever reaches a state first
    speaks, the other stays silent.
    """
    keys = list(keys)
    derived = results.filter(
        F.col("_known").isNotNull() & state_confidence_ok(F.col("object_type"), F.col("_state_conf"))
    ).select(
        *keys,
        "frame_index",
        F.lit(2).alias("phase"),
        F.lit(None).cast("string").alias("previous_state"),
        F.col("_known").alias("current_state"),
    )
    agreed = confirm_transitions(results, transitions, keys=keys, span=span).drop("observed_frame")
    steps = derived.unionByName(agreed)
    linked = previous_row(
        steps, keys, ["frame_index", "phase"], {"_before": "current_state"}, span=span
    )
    return linked.filter(
        (F.col("_has_previous") & (F.col("_before") != F.col("current_state")))
        | (~F.col("_has_previous") & (F.col("phase") < 2))
    ).select(
        *keys,
        "frame_index",
        "phase",
        F.lit("OBJECT_STATE_CHANGED").alias("event_type"),
        F.coalesce("previous_state", "_before").alias("previous_state"),
        "current_state",
    )


def presence_events(
    results: DataFrame,
    seen: DataFrame,
    *,
    minimum_confidence: float = 0.5,
    keys: Sequence[str] = OBJECT,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Appearances once the detector is sure enough, and their disappearances.

    ``seen`` is the output of :func:`trackloom.operators.runs.presence`. An
    object that never was sure disappears without a word.
    """
    keys = list(keys)
    lives = seen.groupBy(*keys, "lifetime_start").agg(
        F.max(F.when(F.col("event_type") == "appeared", F.col("frame_index"))).alias("_appeared"),
        F.max(F.when(F.col("event_type") == "disappeared", F.col("frame_index"))).alias("_gone"),
        F.max("last_seen").alias("_last"),
    )
    asked = lives.filter("_appeared is not null").select(
        *keys, F.col("_appeared").alias("frame_index"), F.lit(0).alias("_kind"), "_gone", "_last"
    )
    sure = results.filter(
        presence_confidence(F.col("detection_confidence")) >= minimum_confidence
    ).select(*keys, "frame_index", F.lit(1).alias("_kind"))
    answered = carry_last(
        sure.unionByName(asked, allowMissingColumns=True),
        keys,
        ["frame_index", "_kind"],
        {"_sure_at": F.when(F.col("_kind") == 1, F.col("frame_index"))},
        span=span,
        reverse=True,
    ).filter("_kind = 0 and _sure_at is not null and (_gone is null or _sure_at < _gone)")
    return answered.select(
        *keys,
        F.inline(
            F.array_compact(
                F.array(
                    F.struct(
                        F.lit("OBJECT_APPEARED").alias("event_type"),
                        F.col("_sure_at").alias("frame_index"),
                        F.when(F.col("_sure_at") == F.col("frame_index"), 1)
                        .otherwise(2)
                        .alias("phase"),
                        F.col("_sure_at").alias("result_frame"),
                    ),
                    F.when(
                        F.col("_gone").isNotNull(),
                        F.struct(
                            F.lit("OBJECT_DISAPPEARED").alias("event_type"),
                            F.col("_gone").alias("frame_index"),
                            F.lit(1).alias("phase"),
                            F.col("_last").alias("result_frame"),
                        ),
                    ),
                )
            )
        ),
    )


def standalone_presence(
    results: DataFrame,
    frames: DataFrame | None = None,
    *,
    minimum_confidence: float = 0.5,
    keys: Sequence[str] = OBJECT,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Presence without a stabiliser: first result in, first missing frame out."""
    seen = presence(
        results, frames, minimum_seen=1, maximum_missed=1, keys=keys, span=span
    )
    return presence_events(
        results, seen, minimum_confidence=minimum_confidence, keys=keys, span=span
    )


def domain_events(
    results: DataFrame,
    *,
    minimum_confidence: float = 0.5,
    keys: Sequence[str] = OBJECT,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Screen, approach, text and description events of completed results."""
    keys = list(keys)
    seen = F.col("detection_confidence")
    own = F.col("confidence")
    certain = ~F.col("is_uncertain")
    screen = F.coalesce(
        F.when(strip(F.col("screen_fingerprint")) != "", strip(F.col("screen_fingerprint"))),
        F.to_json(F.struct("_known", "visible_options", "text")),
    )
    shown = F.col("object_type").isin(*fixed.KIOSK_TYPES) & F.coalesce(
        "screen_is_confirmed", certain
    )
    motion = combined_evidence(seen, F.coalesce("motion_confidence", "confidence"))
    is_bus = F.col("object_type") == "bus"
    words = strip(F.when(is_bus, F.col("route_number")).otherwise(F.col("text")))
    readable = F.when(~F.upper(words).isin(*fixed.UNKNOWN_STATES), words)
    read_conf = combined_evidence(
        seen, F.when(is_bus, F.coalesce("route_confidence", "confidence")).otherwise(own)
    )
    told = F.when(strip(F.col("description")) != "", strip(F.col("description")))

    def channel(kind: str, phase: int, value: Column, confidence: Column, condition: Column):
        usable = condition & value.isNotNull() & (confidence >= minimum_confidence)
        return F.when(
            usable,
            F.struct(
                F.lit(kind).alias("event_type"),
                F.lit(phase).alias("phase"),
                value.alias("_value"),
                confidence.alias("_event_conf"),
            ),
        )

    # one long table of values per object and kind: a change of value is an event
    values = results.select(
        *keys,
        "frame_index",
        "object_type",
        F.inline(
            F.array_compact(
                F.array(
                    channel(
                        "SCREEN_CHANGED",
                        3,
                        screen,
                        combined_evidence(seen, F.coalesce("screen_confidence", "confidence")),
                        shown,
                    ),
                    channel("OBJECT_APPROACHING", 4, F.col("_known"), motion, certain),
                    channel("TEXT_CONFIRMED", 5, readable, read_conf, certain),
                    channel(
                        "DESCRIPTION_CONFIRMED", 6, told, combined_evidence(seen, own), certain
                    ),
                )
            )
        ),
    )
    changed = changed_values(
        values, "_value", keys=[*keys, "event_type"], order=["frame_index"], span=span
    )
    entering = (F.col("_value") == "APPROACHING") & F.col("object_type").isin(*fixed.VEHICLE_TYPES)
    return changed.filter((F.col("event_type") != "OBJECT_APPROACHING") | entering).select(
        *keys, "frame_index", "phase", "event_type", "_event_conf"
    )


def scene_events(
    results: DataFrame,
    seen: DataFrame,
    transitions: DataFrame,
    *,
    minimum_confidence: float = 0.5,
    keys: Sequence[str] = OBJECT,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """All scene events with the attributes of the result they rest on.

    ``phase`` orders events of one frame: waiting transitions, stabilised
    events, then what the results themselves tell.
    """
    keys = list(keys)
    full = complete_results(results)
    appeared = presence_events(
        full, seen, minimum_confidence=minimum_confidence, keys=keys, span=span
    )
    changed = state_events(full, transitions, keys=keys, span=span)
    domain = domain_events(full, minimum_confidence=minimum_confidence, keys=keys, span=span)
    events = (
        changed.unionByName(domain, allowMissingColumns=True)
        .unionByName(appeared, allowMissingColumns=True)
        .withColumn("result_frame", F.coalesce("result_frame", "frame_index"))
    )
    # an object that left is described by the last result it had
    payload = ["object_type", "detection_confidence", "_state_conf", "is_uncertain", *ATTRIBUTES]
    facts = full.select(
        *keys, F.col("frame_index").alias("result_frame"), F.struct(*payload).alias("_latest")
    )
    joined = events.join(facts, [*keys, "result_frame"], "left")
    kind = F.col("event_type")
    confidence = (
        F.when(kind == "OBJECT_APPEARED", presence_confidence(F.col("_latest.detection_confidence")))
        .when(kind == "OBJECT_DISAPPEARED", 1.0)
        .when(kind == "OBJECT_STATE_CHANGED", F.col("_latest._state_conf"))
        .otherwise(F.col("_event_conf"))
    )
    sure = kind.isin("OBJECT_APPEARED", "OBJECT_DISAPPEARED", "SCREEN_CHANGED")
    return joined.select(
        *keys,
        "frame_index",
        "phase",
        "event_type",
        F.col("_latest.object_type").alias("object_type"),
        "previous_state",
        "current_state",
        confidence.alias("confidence"),
        F.when(sure, False).otherwise(F.col("_latest.is_uncertain")).alias("is_uncertain"),
        *[F.col(f"_latest.{a}").alias(a) for a in ATTRIBUTES],
    )


def distinct_events(events: DataFrame, *, keys: Sequence[str] = OBJECT) -> DataFrame:
    """One event per full signature within the lifetime of its object."""
    # arrays count by their content
    return events.dropDuplicates(
        [*keys, "event_type", "previous_state", "current_state", "frame_index", *ATTRIBUTES]
    )


# --- the latest scene -------------------------------------------------------------


def latest_frame(det: DataFrame, *, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """All rows of the newest frame of every source."""
    newest = det.groupBy(*keys).agg(F.max("frame_index").alias("frame_index"))
    return det.join(newest, [*keys, "frame_index"], "left_semi")


def visible_text(text: Column, route: Column, lines: Column) -> Column:
    """Confirmed text, route, or the first five lines of a screen."""
    filled = F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x != "")
    return F.coalesce(
        F.when(strip(text) != "", strip(text)),
        F.when(strip(route) != "", strip(route)),
        F.when(F.size(filled) > 0, F.array_join(F.slice(filled, 1, 5), " / ")),
    )


def visible_objects(
    objects: DataFrame,
    *,
    keys: Sequence[str] = ("source_id", "frame_index"),
    frame_width: float,
    frame_height: float,
    limit: int = 12,
    minimum_confidence: float = 0.30,
    uncertain_below: float = 0.50,
) -> DataFrame:
    """What is visible per frame, most important first.

    ``objects`` are detections with the analysis columns state, is_uncertain
    and text (null without analysis). Weak detections go unless something was
    confirmed about them.
    """
    w, h = F.lit(frame_width), F.lit(frame_height)
    shown = F.when(
        ~F.upper(strip(F.col("state"))).isin("UNKNOWN", "DESCRIBED", ""), strip(F.col("state"))
    )
    words = F.when(strip(F.col("text")) != "", strip(F.col("text")))
    distance = distance_label("x1", "y1", "x2", "y2", w, h)
    rows = (
        objects.filter(strip(F.col("class_name")) != "")
        .filter(~is_own_body(F.col("class_name"), "y1", "y2", h))
        .withColumns(
            {
                "position": settled_position(position_label("x1", "x2", w), distance),
                "distance": distance,
                "shown_state": shown,
                "shown_text": words,
                "is_confirmed": shown.isNotNull() | words.isNotNull(),
                "importance": importance(F.col("class_name")),
            }
        )
        .filter(F.col("is_confirmed") | (F.col("confidence") >= minimum_confidence))
        .withColumn(
            "shown_uncertain",
            F.when(F.col("is_confirmed"), F.coalesce("is_uncertain", F.lit(False))).otherwise(
                F.col("confidence") < uncertain_below
            ),
        )
    )
    order = Window.partitionBy(*keys).orderBy(
        F.col("importance").desc(),
        F.col("is_confirmed").desc(),
        F.coalesce("confidence", F.lit(0.0)).desc(),
        "det_index",
    )
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def snapshot(updates: DataFrame, *, key: str = "session_id") -> DataFrame:
    """Latest view per session: null keeps the last view, an empty one clears it."""
    moment = F.struct("updated_at_ms", "seq")
    given = F.col("visible_objects").isNotNull()
    return updates.groupBy(key).agg(
        F.max("updated_at_ms").alias("updated_at_ms"),
        F.max_by("visible_objects", F.when(given, moment)).alias("visible_objects"),
        F.max_by("scene_confidence", F.when(given, moment)).alias("scene_confidence"),
        F.max_by("raw_detections", F.when(F.col("raw_detections").isNotNull(), moment)).alias(
            "raw_detections"
        )
        if "raw_detections" in updates.columns
        else F.lit(None).cast("string").alias("raw_detections"),
    )


def keep_latest_sessions(
    sessions: DataFrame, limit: int = 256, *, clock: str = "updated_at_ms", key: str = "session_id"
) -> DataFrame:
    """The most recently updated sessions (a top-k, never a full sort)."""
    return sessions.orderBy(F.col(clock).desc(), F.col(key).desc()).limit(limit)


def ring_buffer(
    frames: DataFrame,
    *,
    count: int = 5,
    key: str = "session_id",
    clock: str = "received_at_ms",
    tie: str = "sequence_id",
    now_ms: Column | None = None,
    maximum_age_ms: int | None = None,
) -> DataFrame:
    """Last frames per session, without those that are too old."""
    w = Window.partitionBy(key).orderBy(F.col(clock).desc(), F.col(tie).desc())
    kept = frames.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= count).drop("_n")
    if maximum_age_ms is None:
        return kept
    return kept.filter(now_ms - F.col(clock) <= maximum_age_ms)


def sharpest_recent(
    frames: DataFrame,
    *,
    key: str = "session_id",
    clock: str = "received_at_ms",
    window_ms: int = 1500,
    candidates: int = 3,
    tie: str = "sequence_id",
) -> DataFrame:
    """Sharpest of the newest frames, the newest of equally sharp ones."""
    newest = ring_buffer(frames, count=candidates, key=key, clock=clock, tie=tie)
    last = newest.groupBy(key).agg(F.max(clock).alias("_last"))
    fresh = newest.join(last, key).filter(F.col("_last") - F.col(clock) <= window_ms)
    rest = [c for c in frames.columns if c != key]
    return (
        fresh.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct("sharpness", clock, tie)).alias("_best"))
        .select(key, "_best.*")
    )


