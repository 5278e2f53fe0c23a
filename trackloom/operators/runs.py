"""Streaks, confirmed states, presence, epochs and changes over keyed frames.

Inputs hold one row per key and frame. ``keys`` usually is
``["source_id", "stable_id"]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import fixed
from trackloom.functions.classes import known_state, norm_state
from trackloom.operators.keyed import (
    DEFAULT_SPAN,
    carry_last,
    carry_sum,
    chunk_window,
    drop_ghosts,
    previous_row,
    streaks,
    with_halo,
)

OBJECT = ("source_id", "stable_id")


def runs(
    df: DataFrame,
    value: str,
    *,
    keys: Sequence[str] = OBJECT,
    frame: str = "frame_index",
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Add ``run_start`` and ``run_rank`` of equal values on consecutive frames."""
    w = chunk_window(keys, frame)
    continues = (F.lag(frame).over(w) == F.col(frame) - 1) & F.lag(value).over(w).eqNullSafe(
        F.col(value)
    )
    marked = drop_ghosts(
        with_halo(df, frame, span=span, before=1).withColumn(
            "_head", ~F.coalesce(continues, F.lit(False))
        ),
        keep_chunk=True,
    )
    started = carry_last(
        marked, keys, [frame], {"run_start": F.when(F.col("_head"), F.col(frame))}, span=span
    )
    return started.withColumn("run_rank", F.col(frame) - F.col("run_start") + 1).drop("_head")


def _confirming_rows(
    df: DataFrame, state: str, n: int, keys: Sequence[str], frame: str, span: int
) -> DataFrame:
    """Rows that are exactly the n-th of a run of one known state."""
    w = chunk_window(keys, frame)

    def full(length: int) -> Column:
        """The last ``length`` rows are consecutive and equal."""
        if length == 1:
            return F.lit(True)
        rows = w.rowsBetween(-(length - 1), 0)
        return (
            (F.lag(frame, length - 1).over(w) == F.col(frame) - (length - 1))
            & (F.min(state).over(rows) == F.max(state).over(rows))
            & (F.count(state).over(rows) == length)
        )

    marked = with_halo(df, frame, span=span, before=n).withColumn(
        "_confirms", F.coalesce(full(n), F.lit(False)) & ~F.coalesce(full(n + 1), F.lit(False))
    )
    return drop_ghosts(marked, keep_chunk=True).filter(
        F.col("_confirms") & ~F.col(state).isin(*fixed.UNKNOWN_STATES)
    ).drop("_confirms")


def state_transitions(
    df: DataFrame,
    state: str = "state",
    *,
    minimum_frames: int = 3,
    keys: Sequence[str] = OBJECT,
    frame: str = "frame_index",
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """One row per change of the confirmed state, at its n-th equal frame.

    The first confirmation of a key is its baseline and gives no row. Only
    rows from the announcement of an object onward should be passed in.
    """
    confirmed = _confirming_rows(df, state, minimum_frames, keys, frame, span)
    linked = previous_row(confirmed, keys, [frame], {"previous_state": state}, span=span)
    return linked.filter(F.col("previous_state") != F.col(state)).select(
        *keys, frame, "previous_state", F.col(state).alias("current_state")
    )


def debounce(
    df: DataFrame,
    state: str = "state",
    *,
    minimum_frames: int = 3,
    keys: Sequence[str] = OBJECT,
    frame: str = "frame_index",
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Confirmed state of every row.

    A new state needs n equal known frames in a row. Until then the old state
    is reported as uncertain; an unknown observation reports ``UNKNOWN``.
    """
    seen = df.withColumn("_seen", known_state(F.col(state)))
    carried = streaks(
        seen, keys, [frame], {"_s": "_seen"}, minimum=minimum_frames, consecutive=True, span=span
    )
    known = F.col("_seen").isNotNull()
    streak, before = F.col("_s_streak"), F.col("_s_before")
    confirms = known & (streak == minimum_frames)
    settled = known & (
        (streak >= minimum_frames) | F.coalesce(before == F.col("_seen"), F.lit(False))
    )
    changed = confirms & before.isNotNull() & (before != F.col("_seen"))
    return carried.select(
        *df.columns,
        F.when(settled, F.col("_seen"))
        .when(known, F.coalesce(before, F.lit("UNKNOWN")))
        .otherwise("UNKNOWN")
        .alias("confirmed_state"),
        F.when(changed, before).alias("previous_state"),
        changed.alias("changed"),
        F.when(settled, streak).otherwise(0).alias("confirmed_frames"),
        F.when(known & ~settled, F.col("_seen")).alias("candidate_state"),
        F.when(known & ~settled, streak).otherwise(0).alias("candidate_frames"),
        (~settled).alias("is_uncertain"),
    )


def presence(
    df: DataFrame,
    frames: DataFrame | None = None,
    *,
    minimum_seen: int = 3,
    maximum_missed: int = 8,
    keys: Sequence[str] = OBJECT,
    source: str = "source_id",
    frame: str = "frame_index",
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Appeared, disappeared and silently retired objects on the source's frame clock.

    ``frames`` holds all processed frames of each source, empty ones included;
    without it a source ends with its last observation.
    """
    w = chunk_window(keys, frame)
    back = max(minimum_seen, maximum_missed + 1)
    streak = F.lit(True)
    if minimum_seen > 1:
        streak = F.lag(frame, minimum_seen - 1).over(w) == F.col(frame) - (minimum_seen - 1)
    gap = F.col(frame) - F.lag(frame).over(w)
    marked = drop_ghosts(
        with_halo(df.select(*keys, frame), frame, span=span, before=back).withColumns(
            {
                "_starts": F.coalesce(gap > maximum_missed, F.lit(True)),
                "_streak": F.coalesce(streak, F.lit(False)),
            }
        ),
        keep_chunk=True,
    )
    lives = carry_last(
        marked, keys, [frame], {"lifetime_start": F.when(F.col("_starts"), F.col(frame))}, span=span
    )
    ends = lives.groupBy(*keys, "lifetime_start").agg(
        F.min(F.when(F.col("_streak"), F.col(frame))).alias("appeared_at"),
        F.max(frame).alias("last_seen"),
        (F.max(frame) + maximum_missed).alias("gone_at"),
    )
    clock = (df if frames is None else frames).groupBy(source).agg(F.max(frame).alias("_last"))
    ended = F.col("gone_at") <= F.col("_last")
    announced = F.col("appeared_at").isNotNull()
    return (
        ends.join(clock, source)
        .select(
            *keys,
            "lifetime_start",
            "last_seen",
            F.inline(
                F.array_compact(
                    F.array(
                        F.when(
                            announced,
                            F.struct(
                                F.lit("appeared").alias("event_type"),
                                F.col("appeared_at").alias(frame),
                            ),
                        ),
                        F.when(
                            ended,
                            F.struct(
                                F.when(announced, "disappeared")
                                .otherwise("retired")
                                .alias("event_type"),
                                F.col("gone_at").alias(frame),
                            ),
                        ),
                    )
                )
            ),
        )
    )


def gap_epochs(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("source_id",),
    order: Sequence[str] = ("timestamp_s",),
    maximum_gap: float = 2.0,
    span: float = DEFAULT_SPAN,
) -> DataFrame:
    """Add ``epoch``: rows after a gap strictly longer than the maximum start a new one."""
    clock = order[0]
    w = chunk_window(keys, *order)
    far = F.col(clock) - F.lag(clock).over(w) > maximum_gap
    marked = drop_ghosts(
        with_halo(df, clock, span=span, before=maximum_gap).withColumn(
            "_break", F.coalesce(far, F.lit(True)).cast("int")
        ),
        keep_chunk=True,
    )
    return carry_sum(marked, keys, order, {"epoch": F.col("_break")}, span=span).drop("_break")


def changed_values(
    df: DataFrame,
    value: str,
    *,
    valid: Column | None = None,
    keys: Sequence[str] = OBJECT,
    order: Sequence[str] = ("frame_index",),
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Rows whose value differs from the last one emitted for the key.

    Null and invalid rows neither emit nor count as emitted.
    """
    usable = df.filter(F.col(value).isNotNull() & (F.lit(True) if valid is None else valid))
    linked = previous_row(usable, keys, order, {"previous_value": value}, span=span)
    return linked.filter(
        ~F.col("_has_previous") | (F.col("previous_value") != F.col(value))
    ).drop("_has_previous")


def enter_state(
    df: DataFrame,
    target: str = "APPROACHING",
    *,
    state: str = "state",
    valid: Column | None = None,
    keys: Sequence[str] = OBJECT,
    order: Sequence[str] = ("frame_index",),
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Rows that enter a state; another known confident state re-arms it."""
    usable = df.withColumn("_known", known_state(F.col(state))).filter(
        F.col("_known").isNotNull() & (F.lit(True) if valid is None else valid)
    )
    linked = previous_row(usable, keys, order, {"_before": "_known"}, span=span)
    return linked.filter(
        (F.col("_known") == target) & (~F.col("_has_previous") | (F.col("_before") != target))
    ).drop("_known", "_before", "_has_previous")


def state_changes(
    df: DataFrame,
    *,
    state: str = "state",
    valid: Column | None = None,
    keys: Sequence[str] = OBJECT,
    order: Sequence[str] = ("frame_index",),
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Changes against the last known confident state; the first one is the baseline."""
    usable = df.withColumn("current_state", known_state(F.col(state))).filter(
        F.col("current_state").isNotNull() & (F.lit(True) if valid is None else valid)
    )
    linked = previous_row(usable, keys, order, {"previous_state": "current_state"}, span=span)
    return linked.filter(F.col("previous_state") != F.col("current_state")).drop("_has_previous")


def false_episodes(
    df: DataFrame,
    predicted_state: str,
    *,
    keys: Sequence[str] = ("source_id",),
    frame: str = "frame_index",
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Heads of contiguous labelled frames wrongly predicted as one state.

    Expects the columns ``expected`` and ``predicted``.
    """
    wrong = (
        (F.coalesce("predicted", F.lit("UNKNOWN")) == predicted_state)
        & F.col("expected").isin(*fixed.LABELLED_SIGNAL_STATES)
        & (F.col("expected") != predicted_state)
    )
    w = chunk_window(keys, frame)
    follows = (F.lag(frame).over(w) == F.col(frame) - 1) & F.lag("_wrong").over(w)
    marked = with_halo(df.withColumn("_wrong", wrong), frame, span=span, before=1).withColumn(
        "_head", F.col("_wrong") & ~F.coalesce(follows, F.lit(False))
    )
    return drop_ghosts(marked).filter("_head").drop("_head", "_wrong")


def duplicate_transitions(
    df: DataFrame,
    *,
    keys: Sequence[str] = OBJECT,
    order: Sequence[str] = ("frame_index", "seq"),
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Transitions that repeat the current state of their object; blank ids are ignored."""
    named = df.filter(F.trim(keys[-1]) != "").withColumn("_now", norm_state(F.col("current_state")))
    linked = previous_row(named, keys, order, {"_before": "_now"}, span=span)
    return linked.filter(F.col("_before") == F.col("_now")).drop("_before", "_now", "_has_previous")


def derived_changes(
    intervals: DataFrame,
    value: str = "stage",
    *,
    keys: Sequence[str] = ("source_id", "ground_truth_id"),
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Starts of labelled intervals whose value differs from the interval before."""
    linked = previous_row(
        intervals, keys, ["start_frame", "end_frame", value], {"_before": value}, span=span
    )
    return linked.filter(F.col("_before") != F.col(value)).drop("_before", "_has_previous")


def labels_by_frame(
    intervals: DataFrame,
    value: str = "state",
    *,
    keys: Sequence[str] = ("source_id",),
    order: Sequence[str] = ("object_pos", "interval_pos"),
    frame: str = "frame_index",
) -> DataFrame:
    """Label of every labelled frame; a later interval overrides an earlier one."""
    usable = intervals.filter(
        (F.col("start_frame") >= 0) & (F.col("end_frame") >= F.col("start_frame"))
    )
    return (
        usable.select(
            *keys,
            F.explode(F.sequence("start_frame", "end_frame")).alias(frame),
            F.struct(*order).alias("_rank"),
            norm_state(F.col(value)).alias("_label"),
        )
        .groupBy(*keys, frame)
        .agg(F.max_by("_label", "_rank").alias(value))
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, span: int = DEFAULT_SPAN
) -> DataFrame:
    """Add ``row_index`` (from 1) within the key, in any distribution of rows."""
    return carry_sum(df, keys, order, {"row_index": F.lit(1)}, span=span)


def processing_fps(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("source_id",),
    order: Sequence[str] = ("completed_s",),
    rows: int = 30,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Rate over the last ``rows`` completions, 0 where it cannot be told."""
    numbered = row_numbers(df, keys, order, span=span)
    w = chunk_window(keys, "row_index").rowsBetween(-(rows - 1), 0)
    elapsed = F.col(order[0]) - F.first(order[0]).over(w)
    rate = F.coalesce(F.try_divide(F.count(F.lit(1)).over(w) - 1, elapsed), F.lit(0.0))
    return drop_ghosts(
        with_halo(numbered, "row_index", span=span, before=rows).withColumn("processing_fps", rate)
    )


def cadence_due(
    df: DataFrame,
    interval: int,
    *,
    keys: Sequence[str] = OBJECT,
    frame: str = "frame_index",
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Rows due every ``interval`` frames of an unbroken run; a gap starts over."""
    w = chunk_window(keys, frame)
    follows = F.lag(frame).over(w) == F.col(frame) - 1
    marked = drop_ghosts(
        with_halo(df, frame, span=span, before=1).withColumn(
            "_head", ~F.coalesce(follows, F.lit(False))
        ),
        keep_chunk=True,
    )
    started = carry_last(
        marked, keys, [frame], {"_start": F.when(F.col("_head"), F.col(frame))}, span=span
    )
    return started.filter(F.pmod(F.col(frame) - F.col("_start"), F.lit(interval)) == 0).drop(
        "_head", "_start"
    )


def recent(
    df: DataFrame,
    *,
    now: DataFrame,
    count: int,
    ttl_ms: int,
    keys: Sequence[str] = ("session_id",),
    clock: str = "added_at_ms",
    tie: Sequence[str] = ("seq",),
) -> DataFrame:
    """Newest ``count`` rows of a key that are no older than the TTL at ``now_ms``.

    The row_number limit is applied before the shuffle as well, so a busy key
    sends at most ``count`` rows per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(clock).desc(), *[F.col(t).desc() for t in tie])
    newest = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= count).drop("_n")
    return newest.join(now, list(keys)).filter(F.col("now_ms") - F.col(clock) <= ttl_ms)
