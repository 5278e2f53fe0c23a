"""User-level questions about the latest scene of every source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.classes import is_signal_name, object_name, seconds_since
from trackloom.functions.strings import strip

SOURCE = ("source_id",)


def _name(column: str) -> Column:
    return F.translate(F.lower(strip(F.col(column))), " ", "_")


def current_scene(latest: DataFrame, *, keys: Sequence[str] = SOURCE, now_ms: Column) -> DataFrame:
    """Number of detections in the newest frame and its age."""
    return latest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("object_count"),
        F.max("updated_at_ms").alias("detected_at_ms"),
    ).withColumn("seconds_since_detection", seconds_since(now_ms, F.col("detected_at_ms")))


def find_object(
    latest: DataFrame, questions: DataFrame, *, keys: Sequence[str] = SOURCE
) -> DataFrame:
    """Detections of the newest frame whose class is, contains, or is part of the asked name.

    Questions meet the boxes of their own source's newest frame only.
    """
    asked = questions.withColumn("_query", object_name(F.col("query"))).filter("_query <> ''")
    shown = latest.withColumn("_class", _name("class_name"))
    return (
        asked.join(shown, list(keys))
        .filter(
            (F.col("_query") == F.col("_class"))
            | F.col("_class").contains(F.col("_query"))
            | F.col("_query").contains(F.col("_class"))
        )
        .drop("_query", "_class")
    )


def traffic_light_status(
    visible: DataFrame, latest: DataFrame, *, keys: Sequence[str] = SOURCE
) -> DataFrame:
    """Signal state per source: first visible one with a state, best detector confidence."""
    keys = list(keys)
    named = F.col("shown_state").isNotNull()
    states = (
        visible.filter(is_signal_name(F.col("class_name")))
        .groupBy(*keys)
        .agg(
            F.min_by(
                F.struct("shown_state", "shown_uncertain"), F.when(named, F.col("rank"))
            ).alias("_s")
        )
    )
    raw = (
        latest.filter(is_signal_name(F.col("class_name")))
        .groupBy(*keys)
        .agg(F.max("confidence").alias("detection_confidence"))
    )
    sources = latest.select(*keys).distinct()
    return (
        sources.join(states, keys, "left")
        .join(raw, keys, "left")
        .select(
            *keys,
            (F.col("detection_confidence").isNotNull() | F.col("_s").isNotNull()).alias(
                "traffic_light_visible"
            ),
            F.coalesce("_s.shown_state", F.lit("UNKNOWN")).alias("state"),
            F.coalesce("_s.shown_uncertain", F.lit(False)).alias("is_uncertain"),
            "detection_confidence",
        )
    )


def detected_text(visible: DataFrame, *, keys: Sequence[str] = SOURCE) -> DataFrame:
    """Confirmed texts in view with their direction."""
    return visible.filter(F.col("shown_text").isNotNull()).select(
        *keys, "class_name", F.col("shown_text").alias("text"), F.col("position").alias("direction")
    )


def camera_status(
    sessions: DataFrame, buffered: DataFrame, *, key: str = "session_id", now_ms: Column
) -> DataFrame:
    """Freshness of a session: last analysis, buffered frames, age of the newest one."""
    kept = buffered.groupBy(key).agg(
        F.count(F.lit(1)).alias("buffered_frame_count"), F.max("received_at_ms").alias("_newest")
    )
    return sessions.join(kept, key, "left").select(
        key,
        F.col("updated_at_ms").isNotNull().alias("has_any_analysis"),
        seconds_since(now_ms, F.col("updated_at_ms")).alias("seconds_since_last_analysis"),
        F.coalesce("buffered_frame_count", F.lit(0)).alias("buffered_frame_count"),
        seconds_since(now_ms, F.col("_newest")).alias("newest_frame_age_s"),
    )
