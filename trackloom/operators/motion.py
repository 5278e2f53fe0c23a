"""Vehicle motion from box geometry, and route numbers from reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.classes import bounded_confidence
from trackloom.functions.geometry import is_finite, valid_box
from trackloom.functions.text import route_tokens
from trackloom.operators.fold import throttle
from trackloom.operators.keyed import (
    DEFAULT_SPAN,
    carry_last,
    carry_sum,
    chunk_window,
    drop_ghosts,
    streaks,
    with_halo,
)
from trackloom.operators.runs import OBJECT

GEOMETRY = ("area", "cx", "cy", "w", "h", "conf")


def _reach(window: int, tolerance: int) -> int:
    """Frames a window of reliable boxes can stretch over within one segment."""
    return (window + 1) * (tolerance + 1) * (tolerance + 1) + tolerance + 1


def motion_segments(
    df: DataFrame,
    *,
    minimum_confidence: float = 0.3,
    frame_gap: int = 2,
    keys: Sequence[str] = OBJECT,
    frame: str = "frame_index",
) -> DataFrame:
    """Add ``usable`` and ``segment_break`` to rows that already are in chunks.

    A segment ends at a frame gap above the tolerance, at an invalid box, and
    once more rows in a row than tolerated are unreliable.
    """
    w = chunk_window(keys, frame)
    missed = F.col(frame) - F.lag(frame).over(w) - 1
    jumped = F.coalesce((missed > frame_gap) | (missed < 0), F.lit(True))
    valid = valid_box("x1", "y1", "x2", "y2")
    sure = is_finite(F.col("confidence")) & (F.col("confidence") >= minimum_confidence)
    flagged = df.withColumns(
        {
            "_jumped": jumped,
            "_valid": valid,
            "usable": valid & F.coalesce(sure, F.lit(False)),
        }
    )
    flagged = flagged.withColumn("_weak", F.col("_valid") & ~F.col("usable"))
    fresh = (F.col("_jumped") | ~F.col("_weak")).cast("int")
    flagged = flagged.withColumn("_stretch", F.sum(fresh).over(w))
    weak_run = F.sum(F.col("_weak").cast("int")).over(
        chunk_window([*keys, "_stretch"], frame)
    )
    return flagged.withColumn(
        "segment_break", F.col("_jumped") | ~F.col("_valid") | (F.col("_weak") & (weak_run > frame_gap))
    ).drop("_jumped", "_valid", "_weak", "_stretch")


def _median(items: Column, field: str) -> Column:
    ordered = F.array_sort(F.transform(items, lambda x: x[field]))
    n = F.size(ordered)
    middle = (n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(ordered, middle)).otherwise(
        (F.get(ordered, middle - 1) + F.get(ordered, middle)) / F.lit(2.0)
    )


def _mean(items: Column, field: str) -> Column:
    total = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x[field])
    return F.try_divide(total, F.size(items))


def motion_window(
    df: DataFrame,
    *,
    window: int = 9,
    minimum_confidence: float = 0.3,
    frame_gap: int = 2,
    jitter: float = 0.02,
    keys: Sequence[str] = OBJECT,
    frame: str = "frame_index",
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Trend of the last ``window`` reliable boxes of a segment; chunk copies are kept.

    Rows that are not usable have null features.
    """
    # four more boxes: the rows that confirm a state need their own windows
    reach = _reach(window + 4, frame_gap)
    chunked = with_halo(df, frame, span=max(span, 2 * reach), before=reach)
    parts = motion_segments(
        chunked, minimum_confidence=minimum_confidence, frame_gap=frame_gap, keys=keys, frame=frame
    )
    w = chunk_window(keys, frame)
    parts = parts.withColumn("_segment", F.sum(F.col("segment_break").cast("int")).over(w))
    shape = F.when(
        F.col("usable"),
        F.struct(
            ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"),
            ((F.col("x1") + F.col("x2")) / F.lit(2.0)).alias("cx"),
            ((F.col("y1") + F.col("y2")) / F.lit(2.0)).alias("cy"),
            (F.col("x2") - F.col("x1")).alias("w"),
            (F.col("y2") - F.col("y1")).alias("h"),
            F.col("confidence").alias("conf"),
        ),
    )
    recent = chunk_window([*keys, "_segment", "usable"], frame).rowsBetween(-(window - 1), 0)
    parts = parts.withColumn("_boxes", F.collect_list(shape).over(recent))
    boxes = F.col("_boxes")
    n = F.size(boxes)
    third = F.greatest(F.lit(1), F.floor(n / 3).cast("int"))
    parts = parts.withColumns(
        {
            "_first": F.slice(boxes, F.lit(1), third),
            "_last": F.slice(boxes, F.greatest(n - third + 1, F.lit(1)), third),
            "_mw": _mean(boxes, "w"),
            "_mh": _mean(boxes, "h"),
        }
    )
    first, last = F.col("_first"), F.col("_last")
    full = F.col("usable") & (n >= window)
    old_area = _median(first, "area")
    dx = F.try_divide(_median(last, "cx") - _median(first, "cx"), F.col("_mw"))
    dy = F.try_divide(_median(last, "cy") - _median(first, "cy"), F.col("_mh"))
    pairs = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.try_divide(
            F.get(boxes, i)["area"] - F.get(boxes, i - 1)["area"], F.get(boxes, i - 1)["area"]
        ),
    )
    areas = F.transform(boxes, lambda b: b["area"])
    start = F.get(boxes, F.lit(0))
    drift = F.array_max(
        F.transform(
            boxes,
            lambda b: F.hypot(
                F.try_divide(b["cx"] - start["cx"], F.col("_mw")),
                F.try_divide(b["cy"] - start["cy"], F.col("_mh")),
            ),
        )
    )
    features = {
        "area_change": F.try_divide(_median(last, "area") - old_area, old_area),
        "center_x_change": dx,
        "center_y_change": dy,
        "center_displacement": F.hypot(dx, dy),
        "increasing_consistency": F.try_divide(
            F.size(F.filter(pairs, lambda c: c >= -jitter)), n - 1
        ),
        "decreasing_consistency": F.try_divide(
            F.size(F.filter(pairs, lambda c: c <= jitter)), n - 1
        ),
        "mean_confidence": _mean(boxes, "conf"),
        "area_span": F.try_divide(
            F.array_max(areas) - F.array_min(areas), _mean(boxes, "area")
        ),
        "center_span": drift,
    }
    return parts.withColumns({k: F.when(full, v) for k, v in features.items()}).drop(
        "_boxes", "_first", "_last", "_mw", "_mh"
    )


def motion_state(
    features: DataFrame,
    *,
    area_change: float = 0.1,
    stopped_area: float = 0.03,
    stopped_center: float = 0.08,
    directional_shift: float = 1.25,
    direction_tolerance: float = 0.12,
    consistency: float = 0.65,
) -> DataFrame:
    """Add ``observed_motion`` and ``motion_evidence`` of every row."""
    change, dy = F.col("area_change"), F.col("center_y_change")
    plausible = F.col("center_displacement") <= directional_shift
    nearer = (
        (F.col("increasing_consistency") >= consistency)
        & (change >= area_change)
        & plausible
        & (dy >= -direction_tolerance)
    )
    farther = (
        (F.col("decreasing_consistency") >= consistency)
        & (change <= -area_change)
        & plausible
        & (dy <= direction_tolerance)
    )
    still = (F.col("area_span") <= stopped_area) & (F.col("center_span") <= stopped_center)
    calm = F.least(
        F.lit(1.0) - F.col("area_span") / max(stopped_area, 1e-9),
        F.lit(1.0) - F.col("center_span") / max(stopped_center, 1e-9),
    )
    strength = F.when(
        nearer | farther, F.least(F.lit(1.0), F.abs(change) / F.lit(2.0 * area_change))
    ).when(still, F.lit(0.5) + F.lit(0.5) * F.greatest(F.lit(0.0), calm))
    state = (
        F.when(nearer, "APPROACHING").when(farther, "RECEDING").when(still, "STOPPED").otherwise(
            "UNKNOWN"
        )
    )
    sure = F.col("mean_confidence") * (F.lit(0.5) + F.lit(0.5) * strength)
    return features.withColumns(
        {
            "observed_motion": state,
            "motion_evidence": F.coalesce(
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), F.lit(0.0)
            ),
        }
    )


def stabilize_motion(
    observed: DataFrame,
    *,
    minimum_frames: int = 2,
    keys: Sequence[str] = OBJECT,
    frame: str = "frame_index",
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Confirmed motion per row: unknown while pending, forgotten with its segment.

    Takes the output of :func:`motion_state`; chunk copies are dropped here.
    """
    n = minimum_frames
    w = chunk_window([*keys, "_segment", "usable"], frame)
    rows = w.rowsBetween(-(n - 1), 0)
    equal = (
        (F.min("observed_motion").over(rows) == F.max("observed_motion").over(rows))
        & (F.count(F.lit(1)).over(rows) == n)
        & (F.col("observed_motion") != "UNKNOWN")
    )
    longer = (
        (F.lag("observed_motion", n).over(w) == F.col("observed_motion"))
        if n
        else F.lit(False)
    )
    confirms = F.col("usable") & equal & ~F.coalesce(longer, F.lit(False))
    ready = drop_ghosts(
        observed.withColumns(
            {"_confirms": confirms, "_mean": F.avg("motion_evidence").over(rows), "_full": equal}
        )
    )
    # a break forgets, a confirmation sets; the newest of both decides
    mark = F.when(
        F.col("segment_break") & ~F.col("_confirms"), F.struct(F.lit(None).cast("string").alias("s"))
    ).when(F.col("_confirms"), F.struct(F.col("observed_motion").alias("s")))
    carried = carry_last(
        ready, keys, [frame], {"_mark": mark}, span=span, include_current=False
    )
    before = F.when(~F.col("segment_break"), F.col("_mark.s"))
    seen = F.col("observed_motion")
    known = F.col("usable") & (seen != "UNKNOWN")
    held = known & F.coalesce(before == seen, F.lit(False))
    confirmed_now = F.col("_confirms") & ~held
    settled = held | (known & F.col("_full"))
    return carried.withColumns(
        {
            "motion": F.when(settled, seen).otherwise("UNKNOWN"),
            "motion_confidence": F.when(confirmed_now, F.col("_mean"))
            .when(settled, F.col("motion_evidence"))
            .otherwise(0.0),
            "previous_motion": F.when(confirmed_now, before),
            "motion_changed": confirmed_now & before.isNotNull(),
        }
    ).drop("_confirms", "_mean", "_full", "_mark", "_segment")


def vehicle_motion(
    det: DataFrame,
    *,
    window: int = 9,
    minimum_confidence: float = 0.3,
    frame_gap: int = 2,
    minimum_frames: int = 2,
    minimum_motion_confidence: float = 0.5,
    keys: Sequence[str] = OBJECT,
    span: int = DEFAULT_SPAN,
    **limits,
) -> DataFrame:
    """Motion analysis of every row of a vehicle track."""
    features = motion_window(
        det,
        window=window,
        minimum_confidence=minimum_confidence,
        frame_gap=frame_gap,
        keys=keys,
        span=span,
    )
    stable = stabilize_motion(
        motion_state(features, **limits), minimum_frames=minimum_frames, keys=keys, span=span
    )
    confident = (F.col("motion") != "UNKNOWN") & (
        F.col("motion_confidence") >= minimum_motion_confidence
    )
    return stable.withColumns(
        {
            "state": F.when(confident, F.col("motion")).otherwise("UNKNOWN"),
            "motion_is_uncertain": ~confident,
            "reason": F.element_at(
                F.array_append(
                    F.array_compact(
                        F.array(
                            F.when(~valid_box("x1", "y1", "x2", "y2"), "invalid_bus_bbox").when(
                                ~F.col("usable"), "low_detection_confidence"
                            ),
                            F.when(
                                F.col("usable") & (F.col("motion") == "UNKNOWN"),
                                "insufficient_or_ambiguous_motion",
                            ),
                            F.when(
                                (F.col("motion") != "UNKNOWN") & ~confident,
                                "motion_confidence_below_threshold",
                            ),
                        )
                    ),
                    F.lit(None).cast("string"),
                ),
                1,
            ),
        }
    )


def route_vote(
    lines: DataFrame,
    group: Sequence[str],
    *,
    minimum_confidence: float = 0.75,
    minimum_margin: float = 0.05,
) -> DataFrame:
    """The route number a read agrees on: best token, clear of the runner-up.

    ``lines`` holds text and confidence per line. Groups without a clear
    winner give no row.
    """
    usable = lines.filter(is_finite(F.col("confidence")) & (F.col("confidence") >= minimum_confidence))
    tokens = usable.select(
        *group, "confidence", F.explode(route_tokens(F.col("text"))).alias("route")
    )
    return best_token(tokens, group, minimum_margin=minimum_margin)


def best_token(
    tokens: DataFrame, group: Sequence[str], *, minimum_margin: float = 0.05
) -> DataFrame:
    """Winner per group when it leads the runner-up by the margin.

    Two aggregations with partial sums; a group is never sorted.
    """
    best = tokens.groupBy(*group, "route").agg(F.max("confidence").alias("confidence"))
    packed = best.groupBy(*group).agg(
        # max of the struct gives the highest confidence; ties go to the first name
        F.min_by("route", F.struct(-F.col("confidence"), F.col("route"))).alias("winner"),
        F.max("confidence").alias("route_confidence"),
    )
    runner = (
        best.join(packed.select(*group, "winner"), list(group))
        .filter(F.col("route") != F.col("winner"))
        .groupBy(*group)
        .agg(F.max("confidence").alias("_second"))
    )
    return (
        packed.join(runner, list(group), "left")
        .filter(
            F.col("_second").isNull()
            | (F.col("route_confidence") - F.col("_second") >= minimum_margin)
        )
        .select(*group, F.col("winner").alias("route_number"), "route_confidence")
    )


def due_reads(
    rows: DataFrame,
    *,
    interval: int = 7,
    keys: Sequence[str] = OBJECT,
    segment: str | None = None,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Rows on which a read runs: the first of a segment, then by interval."""
    by = [*keys, segment] if segment else list(keys)
    return throttle(rows, by, ["frame_index"], interval, span=span)


def route_confirmation(
    executed: DataFrame,
    *,
    minimum_reads: int = 3,
    keys: Sequence[str] = OBJECT,
    order: str = "frame_index",
    reset: Column | None = None,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Route confirmed by n agreeing reads among those actually executed.

    ``executed`` holds one row per executed read with a nullable ``route`` and
    its confidence; an unreadable or failed read (null) and a ``reset`` row
    break the streak. Deferred frames are not rows here.
    """
    rows = executed.withColumns(
        {
            "_own": F.coalesce("confidence", F.lit(0.0)),
            # a reset row starts a run of its own
            "_reset": F.lit(False) if reset is None else F.coalesce(reset, F.lit(False)),
        }
    )
    if reset is not None:
        rows = carry_sum(rows, keys, [order], {"_run": F.col("_reset").cast("int")}, span=span)
    found = streaks(
        rows,
        keys,
        [order],
        {"_r": "route"},
        minimum=minimum_reads,
        run=None if reset is None else "_run",
        amount="_own",
        span=span,
    )
    streak = F.col("_r_streak")
    confirmed = streak >= minimum_reads
    return found.select(
        *executed.columns,
        streak.alias("confirmed_reads"),
        confirmed.alias("route_confirmed"),
        F.when(confirmed, F.col("_r_sum") / streak).alias("confirmed_confidence"),
        (confirmed & F.coalesce(F.col("_r_before") != F.col("route"), F.lit(False))).alias(
            "route_changed"
        ),
    )


def bus_analysis(
    motion: DataFrame,
    routes: DataFrame,
    *,
    keys: Sequence[str] = OBJECT,
) -> DataFrame:
    """Join motion with confirmed routes: certain when either is."""
    on = [*keys, "frame_index"]
    known = routes.filter("route_confirmed").select(
        *on,
        F.col("route").alias("route_number"),
        F.col("confirmed_confidence").alias("route_confidence"),
        F.col("confirmed_reads").alias("ocr_confirmed_frames"),
    )
    joined = motion.join(known, on, "left")
    moving = F.when(~F.col("motion_is_uncertain"), bounded_confidence(F.col("motion_confidence")))
    has_route = F.col("route_number").isNotNull()
    return joined.withColumns(
        {
            "result_confidence": F.greatest(
                F.coalesce(moving, F.lit(0.0)), F.coalesce("route_confidence", F.lit(0.0))
            ),
            "is_uncertain": F.col("motion_is_uncertain") & ~has_route,
        }
    )
