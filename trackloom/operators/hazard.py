"""Collision risk from the growth of a tracked box.

The apparent area of a box grows with the inverse square of its distance, so
the time to contact is 2 over the rate of change of its logarithm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import fixed
from trackloom.functions.classes import norm_class
from trackloom.functions.geometry import box_area, corridor_overlap, zone
from trackloom.operators.fold import fold
from trackloom.operators.keyed import (
    DEFAULT_SPAN,
    carry_last,
    carry_sum,
    chunk_window,
    drop_ghosts,
    previous_row,
    with_halo,
)
from trackloom.operators.runs import OBJECT
from trackloom.operators.steps import Warned
from trackloom.session import cut


def growth_features(
    df: DataFrame,
    *,
    history: int = 6,
    keys: Sequence[str] = OBJECT,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Growth rate, consistency and span over the last samples of an unbroken run.

    One valid box per frame with an advancing clock is expected; a missed
    frame starts a new run. Needs ``area_ratio`` and ``timestamp_s``.
    """
    w = chunk_window(keys, "frame_index")
    # an unbroken run looks like consecutive frames, so frames bound the window
    broken = F.coalesce(F.lag("frame_index").over(w) != F.col("frame_index") - 1, F.lit(True))
    marked = (
        with_halo(df, "frame_index", span=span, before=history)
        .withColumn("_run", F.when(broken, F.col("frame_index")))
        .withColumn("_run", F.last("_run", ignorenulls=True).over(w))
    )
    run = chunk_window([*keys, "_run"], "frame_index")
    recent = run.rowsBetween(-(history - 1), 0)
    steps = run.rowsBetween(-(history - 2), 0)
    marked = marked.withColumn(
        "_grew", (F.col("area_ratio") > F.lag("area_ratio").over(run)).cast("double")
    )
    first_time = F.first("timestamp_s").over(recent)
    span_s = F.col("timestamp_s") - first_time
    rate = F.try_divide(
        F.log("area_ratio") - F.log(F.first("area_ratio").over(recent)), span_s
    )
    return drop_ghosts(
        marked.withColumns(
            {
                "samples": F.count("area_ratio").over(recent),
                "span_s": span_s,
                "growth_rate": rate,
                "growth_consistency": F.avg("_grew").over(steps),
            }
        )
    ).drop("_run", "_grew")


def time_to_contact(
    features: DataFrame,
    *,
    minimum_samples: int = 3,
    minimum_span_s: float = 0.25,
    warning_s: float = 3.5,
    imminent_s: float = 1.5,
    minimum_area: float = 0.005,
    minimum_consistency: float = 0.75,
    minimum_confidence: float = 0.35,
    minimum_corridor_overlap: float = 0.2,
    frame_width: str = "width",
) -> DataFrame:
    """Rows at risk with level, zone and confidence, before any throttling."""
    contact = F.try_divide(F.lit(2.0), F.col("growth_rate"))
    level = F.when(contact <= imminent_s, "IMMINENT").otherwise("WARNING")
    in_path = corridor_overlap("x1", "x2", F.col(frame_width)) >= minimum_corridor_overlap
    moving = norm_class(F.col("class_name")).isin(*fixed.MOVING_HAZARD_TYPES)
    sure = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * F.col("growth_consistency"))
    )
    return (
        features.filter(
            (F.col("area_ratio") >= minimum_area)
            & (F.col("samples") >= minimum_samples)
            & (F.col("span_s") >= minimum_span_s)
            & (F.col("growth_rate") > 0)
            & (F.col("growth_consistency") >= minimum_consistency)
        )
        .withColumns(
            {
                "time_to_contact_s": contact,
                "level": level,
                "zone": zone("x1", "x2", F.col(frame_width)),
                "in_path": in_path,
                "hazard_confidence": sure,
            }
        )
        .filter(
            (F.col("time_to_contact_s") <= warning_s)
            & ((F.col("level") == "IMMINENT") | (F.col("in_path") & moving))
            & (F.col("hazard_confidence") >= minimum_confidence)
        )
    )


def recent_growth(
    df: DataFrame, *, history: int = 6, keys: Sequence[str] = OBJECT, span: int = DEFAULT_SPAN
) -> DataFrame:
    """:func:`growth_features` for any clock and any box, with ``_run``, the first frame of the presence.

    A box without area is no sample but does not end a presence; of rows at one time only the last
    stays a sample for the rows after them. Samples of one time are numbered along the key, so the
    ones before a row are a window over those numbers however many rows share a time.
    """
    keys = list(keys)
    w = chunk_window(keys, "frame_index")
    gap = F.coalesce(F.lag("frame_index").over(w) != F.col("frame_index") - 1, F.lit(True))
    rows = drop_ghosts(
        with_halo(df, "frame_index", span=span, before=1).withColumn("_gap", F.when(gap, F.col("frame_index"))), keep_chunk=True
    )
    rows = carry_last(rows, keys, ["frame_index"], {"_run": F.col("_gap")}, span=span).drop("_gap")
    sampled = rows.filter(F.col("area_ratio") > 0)
    sampled = previous_row(sampled, keys, ["frame_index"], {"_then": "timestamp_s", "_then_run": "_run"}, span=span)
    # the same time up to rounding
    near = F.abs(F.col("timestamp_s") - F.col("_then")) <= 1e-9 * F.greatest(F.abs("timestamp_s"), F.abs("_then"))
    same = F.col("_has_previous") & (F.col("_then_run") == F.col("_run")) & near
    sampled = carry_sum(
        sampled, keys, ["frame_index"], {"_group": F.when(same, 0).otherwise(1)}, span=span
    ).drop("_then", "_then_run", "_has_previous")
    last = sampled.groupBy(*keys, "_group").agg(
        F.max_by(F.struct("_run", F.col("timestamp_s").alias("t"), F.col("area_ratio").alias("a")), "frame_index").alias("_last")
    )
    before = chunk_window(keys, "_group").rowsBetween(-(history - 1), -1)
    earlier = drop_ghosts(
        with_halo(last, "_group", span=span, before=history).withColumn("_earlier", F.collect_list("_last").over(before))
    ).select(*keys, "_group", "_earlier")
    joined = sampled.join(earlier, [*keys, "_group"])
    joined = joined.withColumn("_earlier", F.filter("_earlier", lambda s: s["_run"] == F.col("_run")))
    areas = F.concat(F.transform("_earlier", lambda s: s["a"]), F.array("area_ratio"))
    grew = F.zip_with(
        F.slice(areas, 2, history), F.slice(areas, F.lit(1), F.size(areas) - 1), lambda later, earlier: (later > earlier).cast("int")
    )
    first = F.get("_earlier", F.lit(0))
    span_s = F.col("timestamp_s") - F.coalesce(first["t"], F.col("timestamp_s"))
    return joined.withColumns(
        {
            "samples": F.size("_earlier") + 1,
            "span_s": span_s,
            "growth_rate": F.try_divide(F.log("area_ratio") - F.log(first["a"]), span_s),
            "growth_consistency": F.try_divide(F.aggregate(grew, F.lit(0.0), lambda n, g: n + g), F.size("_earlier")),
        }
    ).drop("_group", "_earlier")


def hazard_events(
    det: DataFrame,
    *,
    keys: Sequence[str] = OBJECT,
    frame_width: int,
    frame_height: int,
    history: int = 6,
    repeat_s: float = 2.0,
    span: int = DEFAULT_SPAN,
    **thresholds,
) -> DataFrame:
    """Warnings per object: first, escalations, and repeats after the interval.

    Windows find the rows at risk; only those pass the emission fold, apart for every unbroken
    presence of an object. Jobs run while the plan is built, as in every fold.
    """
    keys = list(keys)
    rows = det.select(
        *keys,
        "frame_index",
        "timestamp_s",
        (box_area("x1", "y1", "x2", "y2") / F.lit(float(frame_width * frame_height))).alias("area_ratio"),
        "confidence",
        "class_name",
        "x1",
        "x2",
        F.lit(float(frame_width)).alias("width"),
    )
    risky = cut(time_to_contact(recent_growth(rows, history=history, keys=keys, span=span), **thresholds))
    within = [*keys, "_run"]
    passed = fold(
        risky.select(*within, "frame_index", "timestamp_s", "level"), within, ["frame_index"], Warned(repeat_s), span=span
    ).select(*within, "frame_index")
    numbered = carry_sum(passed, within, ["frame_index"], {"emission_index": F.lit(1)}, span=span)
    return risky.join(numbered, [*within, "frame_index"]).select(
        *keys,
        "frame_index",
        "timestamp_s",
        "level",
        "time_to_contact_s",
        "growth_rate",
        "area_ratio",
        "in_path",
        F.col("hazard_confidence").alias("confidence"),
        "emission_index",
        norm_class(F.col("class_name")).alias("object_type"),
        "zone",
        F.lit("HAZARD_DETECTED").alias("event_type"),
    )
