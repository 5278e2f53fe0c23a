"""Data-quality rules for stream messages and annotation documents."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import fixed
from trackloom.functions.geometry import is_finite
from trackloom.functions.strings import strip


def start_error(
    *, maximum_width: int = 3840, maximum_height: int = 2160, maximum_fps: float = 0.0, id_length: int = 128
) -> Column:
    """First rule a start message breaks, null when it is fine."""
    w, h, fps = F.col("source_width"), F.col("source_height"), F.col("source_fps")
    blank = F.coalesce(strip(F.col("session_id")), F.lit("")) == ""
    error = (
        F.when(F.coalesce(F.col("type") != "start", F.lit(True)), "NOT_A_START_MESSAGE")
        .when(blank, "MISSING_SESSION_ID")
        .when(F.char_length(strip(F.col("session_id"))) > id_length, "SESSION_ID_TOO_LONG")
        .when(F.coalesce(w < 1, F.lit(True)), "INVALID_SOURCE_WIDTH")
        .when(F.coalesce(h < 1, F.lit(True)), "INVALID_SOURCE_HEIGHT")
        .when((w > maximum_width) | (h > maximum_height), "SOURCE_TOO_LARGE")
        .when(~is_finite(fps) | (fps <= 0), "INVALID_SOURCE_FPS")
    )
    return error.when(fps > maximum_fps, "SOURCE_TOO_FAST") if maximum_fps > 0 else error


def frame_error(
    *, maximum_bytes: int = 2_000_000, maximum_width: int = 3840, maximum_height: int = 2160
) -> Column:
    """Error code of a frame message, null when it is fine."""
    sequence, captured = F.col("sequence_id"), F.col("captured_at_ms")
    w, h = F.col("width"), F.col("height")
    return (
        F.when(F.coalesce(sequence < 0, F.lit(True)), "INVALID_SEQUENCE_ID")
        .when(captured.isNotNull() & (~is_finite(captured) | (captured < 0)), "INVALID_CAPTURE_TIME")
        .when(F.col("byte_count") > maximum_bytes, "FRAME_TOO_LARGE")
        .when((w > maximum_width) | (h > maximum_height), "FRAME_TOO_LARGE")
        .when((w < 1) | (h < 1), "INVALID_JPEG")
    )


def _violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a rule that cannot be told counts as broken."""
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules.items()])
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


def _not_positive(value: Column) -> Column:
    return F.coalesce(~is_finite(value) | (value <= 0), F.lit(False)) & value.isNotNull()


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def _bad_range(x: Column) -> Column:
    start, end = x["start_frame"], x["end_frame"]
    return F.coalesce((start < 0) | (end < start), F.lit(True))


def _bad_interval(field: str, allowed: tuple[str, ...]):
    return lambda x: _bad_range(x) | ~F.coalesce(x[field].isin(*allowed), F.lit(False))


def annotation_violations(annotations: DataFrame) -> DataFrame:
    """Broken rules of annotation documents: (video_id, rule).

    Documents are rows of ``trackloom.sources.schemas.ANNOTATION``. Missing
    required parts show as null. Duplicate ids are found by one aggregation.
    """
    key = ["video_id"]
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    meta, limits = F.col("video_metadata"), F.col("narration_constraints")
    whole = {
        "schema_version": F.col("schema_version") != fixed.ANNOTATION_VERSION,
        "video_id": blank(F.col("video_id")),
        "review_status": ~F.col("review_status").isin(*fixed.REVIEW_STATUSES),
        "video_metadata": meta.isNull(),
        "video_metadata.fps": _not_positive(meta["fps"]),
        "video_metadata.size": _any(
            [_not_positive(meta[f].cast("double")) for f in ("frame_count", "width", "height")]
        ),
        "objects": F.col("objects").isNull(),
        "narration_constraints": limits.isNull(),
        "narration_constraints.lists": limits["forbidden_phrases"].isNull()
        | limits["forbidden_patterns"].isNull(),
        "narration_constraints.maximum_duplicate_events": F.coalesce(
            limits["maximum_duplicate_events"] < 0, F.lit(False)
        ),
    }
    items = annotations.select(*key, F.explode("objects").alias("o"))
    o = F.col("o")
    parts = {
        "ground_truth_id": blank(o["ground_truth_id"]),
        "object_type": blank(o["object_type"]),
        "visible_frame_ranges": F.exists(o["visible_frame_ranges"], _bad_range),
        "signal_state_intervals": F.exists(
            o["signal_state_intervals"], _bad_interval("state", fixed.ANNOTATED_SIGNAL_STATES)
        ),
        "motion_intervals": F.exists(
            o["motion_intervals"], _bad_interval("state", fixed.MOTION_STATES)
        ),
        "screen_stage_intervals": F.exists(
            o["screen_stage_intervals"], _bad_interval("stage", fixed.SCREEN_STAGES)
        ),
        "transitions": F.exists(
            o["transitions"],
            lambda t: F.coalesce(t["frame"] < 0, F.lit(True))
            | ~F.coalesce(t["from_state"].isin(*fixed.ANNOTATED_SIGNAL_STATES), F.lit(False))
            | ~F.coalesce(t["to_state"].isin(*fixed.ANNOTATED_SIGNAL_STATES), F.lit(False))
            | t["ambiguous"].isNull(),
        ),
        "text_annotations": F.exists(
            o["text_annotations"], lambda t: _bad_range(t) | t["ambiguous"].isNull()
        ),
    }
    twice = (
        items.groupBy(*key, o["ground_truth_id"].alias("_id"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(*key, F.lit("duplicate_ground_truth_id").alias("rule"))
    )
    return (
        _violations(annotations, key, whole)
        .unionByName(_violations(items, key, parts))
        .unionByName(twice)
        .distinct()
    )


def unexpected_fields(documents: DataFrame, allowed: tuple[str, ...], raw: str = "raw") -> DataFrame:
    """Keys of JSON documents that are not allowed: (video_id, field)."""
    names = F.json_object_keys(raw)
    extra = F.array_except(names, F.array(*[F.lit(a) for a in allowed]))
    return documents.select("video_id", F.explode(extra).alias("field"))
