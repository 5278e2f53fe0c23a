"""Summaries of runs, sessions and frames: one aggregation each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import fixed
from trackloom.functions.classes import analyzer_name, norm_state, object_family
from trackloom.functions.geometry import is_finite

SOURCE = ("source_id",)


def run_summary(rows: DataFrame, *, keys: Sequence[str] = SOURCE) -> DataFrame:
    """Totals of a run from one stacked table.

    ``rows`` holds frames, detections, analyses, events and narrations with a
    ``kind`` column; see :func:`stack_run`. One shuffle gives all totals,
    zeros included.
    """

    def n(condition: Column) -> Column:
        return F.count_if(condition)

    kind = F.col("kind")
    bus = (kind == "analysis") & (F.col("object_type") == "bus")
    target = kind == "signal_target"
    motion = F.upper(F.trim(F.coalesce("state", F.lit("UNKNOWN"))))
    motion = F.when(motion.isin(*fixed.MOTION_STATES), motion).otherwise("UNKNOWN")
    return rows.groupBy(*keys).agg(
        n(kind == "frame").alias("frames"),
        n(kind == "detection").alias("detections"),
        n(kind == "legacy_event").alias("events"),
        n(kind == "event").alias("analysis_events"),
        n(kind == "narration").alias("narrations"),
        n(target).alias("signal_targets"),
        n((kind == "legacy_event") & (F.col("event_type") == "signal_changed")).alias(
            "signal_changes"
        ),
        *[n(target & (F.col("state") == s)).alias(f"signal_{s}") for s in fixed.SIGNAL_STATES],
        n(bus).alias("bus_analysis_results"),
        F.count_distinct(F.when(bus, F.col("frame_index"))).alias("bus_detection_frames"),
        n(
            (kind == "event")
            & (F.col("event_type") == "OBJECT_APPROACHING")
            & (F.col("object_type") == "bus")
        ).alias("bus_approach_events"),
        *[n(bus & (motion == s)).alias(f"motion_{s}") for s in fixed.MOTION_STATES],
        F.array_sort(
            F.collect_set(
                F.when(bus & (F.trim("route_number") != ""), F.trim(F.col("route_number")))
            )
        ).alias("bus_route_numbers"),
    )


RUN_COLUMNS = {
    "frame_index": "bigint",
    "object_type": "string",
    "event_type": "string",
    "state": "string",
    "route_number": "string",
}


def stack_run(parts: dict[str, DataFrame], *, keys: Sequence[str] = SOURCE) -> DataFrame:
    """Put the tables of a run on top of each other under their kind."""
    stacked = None
    for kind, df in parts.items():
        columns = [
            (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
            for c, t in RUN_COLUMNS.items()
        ]
        part = df.select(*keys, F.lit(kind).alias("kind"), *columns)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def performance_summary(
    frames: DataFrame,
    runs: DataFrame,
    *,
    keys: Sequence[str] = SOURCE,
) -> DataFrame:
    """Duration, rates and mean inference time per run; divisions by zero give 0.

    ``frames`` has timestamp_s and inference_ms, ``runs`` source_fps and elapsed_s.
    """
    total = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.max("timestamp_s").alias("_last"),
        F.avg("inference_ms").alias("_ms"),
    )
    joined = runs.join(total, list(keys), "left").withColumn(
        "frames", F.coalesce("frames", F.lit(0))
    )

    def usable(c: str) -> Column:
        return is_finite(F.col(c)) & (F.col(c) > 0)

    duration = (
        F.when(usable("_last"), F.col("_last"))
        .when(usable("source_fps"), F.col("frames") / F.col("source_fps"))
        .otherwise(0.0)
    )
    elapsed = F.when(usable("elapsed_s"), F.col("elapsed_s")).otherwise(0.0)
    zero = F.lit(0.0)
    return joined.select(
        *keys,
        "frames",
        F.bround(duration, 3).alias("video_duration_s"),
        F.bround(elapsed, 3).alias("elapsed_s"),
        F.bround(F.coalesce(F.try_divide("frames", elapsed), zero), 3).alias("effective_fps"),
        F.bround(F.coalesce(F.try_divide(elapsed, duration), zero), 3).alias("realtime_factor"),
        F.bround(F.coalesce("_ms", zero), 3).alias("average_inference_ms"),
    )


def routing_counts(analyses: DataFrame, *, keys: Sequence[str] = SOURCE) -> DataFrame:
    """Counts by detector class, by object type and by analyzer in one pass.

    ``analyses``: class_name, object_type, analyzer_name (null where it was not
    recorded). Every analyzer is listed, with 0 where it had no work.
    """
    named = analyses.withColumns(
        {
            "class_name": _named("class_name"),
            "object_type": _named("object_type"),
            "analyzer": F.coalesce(
                F.when(F.trim("analyzer_name") != "", F.trim("analyzer_name")),
                analyzer_name(F.col("class_name")),
            ),
        }
    )
    sets = [[*keys, c] for c in ("class_name", "object_type", "analyzer")]
    counted = named.groupingSets(
        [[F.col(c) for c in s] for s in sets],
        *[F.col(c) for c in (*keys, "class_name", "object_type", "analyzer")],
    ).agg(F.count(F.lit(1)).alias("n"))
    item = F.coalesce("class_name", "object_type", "analyzer")
    kind = (
        F.when(F.col("class_name").isNotNull(), "class_name")
        .when(F.col("object_type").isNotNull(), "object_type")
        .otherwise("analyzer")
    )
    found = counted.select(*keys, kind.alias("kind"), item.alias("item"), "n")
    zeros = (
        named.select(*keys)
        .distinct()
        .select(
            *keys,
            F.lit("analyzer").alias("kind"),
            F.explode(F.array(*[F.lit(a) for a in fixed.ANALYZER_NAMES.values()])).alias("item"),
            F.lit(0).cast("bigint").alias("n"),
        )
    )
    return found.unionByName(zeros).groupBy(*keys, "kind", "item").agg(F.sum("n").alias("n"))


def _named(column: str) -> Column:
    return F.when(F.coalesce(F.trim(column), F.lit("")) == "", "unknown").otherwise(
        F.trim(F.col(column))
    )


def session_metrics(frames: DataFrame, *, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Received, processed, dropped and rejected frames by their outcome."""
    outcome = F.col("outcome")
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"),
        *[F.count_if(outcome == o).alias(o) for o in ("processed", "dropped", "rejected")],
    )


def colour_evidence(
    pixels: DataFrame, *, keys: Sequence[str] = ("crop_id",), minimum_pixels: int = 64
) -> DataFrame:
    """Share of red, green and yellow pixels per crop; hue of red wraps around.

    ``pixels``: h (0..179), s and v (0..255) of the region of interest.
    """
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    masks = {
        "red": ((h <= 12) | (h >= 168)) & (s >= 90) & (v >= 100),
        "green": h.between(35, 100) & (s >= 80) & (v >= 90),
        "yellow": h.between(18, 34) & (s >= 80) & (v >= 100),
    }
    total = F.count(F.lit(1))
    enough = total >= minimum_pixels
    return pixels.groupBy(*keys).agg(
        total.alias("pixels"),
        *[
            F.when(enough, F.count_if(m) / total).otherwise(0.0).alias(f"{name}_ratio")
            for name, m in masks.items()
        ],
    )


def ids_per_family(
    det: DataFrame, *, keys: Sequence[str] = SOURCE, approximate: bool = False
) -> DataFrame:
    """Distinct object ids per family; approximate for very large fleets."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return (
        det.withColumn("family", object_family(F.col("class_name")))
        .groupBy(*keys, "family")
        .agg(count("stable_id").alias("ids"))
    )


def observed_states(analyses: DataFrame, *, keys: Sequence[str] = SOURCE) -> DataFrame:
    """Histogram of the states of all results."""
    return (
        analyses.groupBy(*keys, norm_state(F.col("state")).alias("state"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def qualitative_summary(
    analyses: DataFrame, routes: DataFrame, *, keys: Sequence[str] = SOURCE
) -> DataFrame:
    """States, analyzers and confirmed routes of a run, as small sorted sets."""
    states = (
        observed_states(analyses, keys=keys)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("state", "n"))).alias("observed_states"))
    )
    used = analyses.groupBy(*keys).agg(
        F.array_sort(
            F.collect_set(
                F.when(
                    F.trim("object_type") != "",
                    F.coalesce(
                        F.when(F.trim("analyzer_name") != "", F.trim("analyzer_name")),
                        analyzer_name(F.col("object_type")),
                    ),
                )
            )
        ).alias("routed_analyzer_types")
    )
    known = routes.groupBy(*keys).agg(
        F.array_sort(F.collect_set("route_number")).alias("confirmed_route_numbers")
    )
    return states.join(used, list(keys), "left").join(known, list(keys), "left")


def evaluation_summary(videos: DataFrame) -> DataFrame:
    """How many sources were scored, only described, or failed."""
    quantitative = F.coalesce("quantitative", F.lit(False))
    return videos.agg(
        F.count(F.lit(1)).alias("video_count"),
        F.count_if(quantitative).alias("quantitatively_evaluated"),
        F.count_if(~quantitative).alias("qualitative_only"),
        F.count_if(F.col("status") != "ok").alias("failed"),
    )
