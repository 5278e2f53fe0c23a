"""Scoring of many sources at once: all metrics as one long table.

A run is given as flat tables keyed by source_id:

* ``frames``: frame_index, inference_ms
* ``detections``: frame_index, pos, class_name, stable_id, signal_state,
  signal_state_confidence
* ``analyses``: frame_index, pos, object_type, analyzer_name, stable_id, state,
  confidence, is_uncertain, route_number, route_is_current,
  ocr_confirmed_frames, route_confidence, signal_type,
  signal_type_is_uncertain, screen_is_confirmed, visible_text (array)
* ``events``: frame_index, pos, event_type, object_type, stable_id,
  previous_state, current_state, route_number, text, screen_fingerprint, ...
* ``narrations``: frame_index, pos, message

and the ground truth as ``objects``, ``visible``, ``states``, ``motions``,
``stages`` (intervals), ``transitions`` and ``texts``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import fixed
from trackloom.functions.classes import (
    analyzer_name,
    FAMILY,
    category_families,
    family_of,
    finite_number,
    first_positive,
    norm_state,
    norm_token,
    run_succeeded,
)
from trackloom.functions.vectorized import scoring_text
from trackloom.operators import runs as R
from trackloom.operators import scoring as K
from trackloom.session import written

SOURCE = ["source_id"]


@dataclass
class Run:
    frames: DataFrame
    detections: DataFrame
    analyses: DataFrame
    events: DataFrame
    narrations: DataFrame


@dataclass
class Truth:
    objects: DataFrame
    visible: DataFrame
    states: DataFrame
    motions: DataFrame
    stages: DataFrame
    transitions: DataFrame
    texts: DataFrame


def _single_id(first: str, second: str) -> Column:
    """Two positions, none below 0, as one value that sorts as they do."""
    return F.format_string("%019d-%019d", F.col(first).cast("bigint"), F.col(second).cast("bigint"))


# --- small set helpers ------------------------------------------------------------


def multiset_matches(expected: DataFrame, predicted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value is matched, counts respected on both sides."""
    left = expected.groupBy(*columns).agg(F.count(F.lit(1)).alias("_e"))
    right = predicted.groupBy(*columns).agg(F.count(F.lit(1)).alias("_p"))
    return left.join(right, list(columns)).select(*columns, F.least("_e", "_p").alias("matched"))


def sets_equal(
    left: DataFrame, right: DataFrame, column: str, keys: Sequence[str] = SOURCE
) -> DataFrame:
    """Whether both sides hold the same distinct values, per key.

    Counted per value, so that no set is gathered in one place.
    """
    sides = left.select(*keys, column, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, column, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    values = sides.groupBy(*keys, column).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return values.groupBy(*keys).agg((F.min(F.least("_l", "_r")) == 1).alias("equal"))


def prefer_primary(
    primary: DataFrame, fallback: DataFrame, keys: Sequence[str] = ("source_id", "frame_index")
) -> DataFrame:
    """Rows of the new form, and of the old form where a frame has no new one."""
    covered = primary.select(*keys).distinct()
    rest = fallback.join(covered, list(keys), "left_anti")
    return primary.unionByName(rest, allowMissingColumns=True)


def _delays(fps: float | str | None) -> tuple[Column, Column]:
    """Delay of a matched transition in frames, and in ms where fps is known."""
    delay = F.col("predicted_frame") - F.col("truth_frame")
    rate = F.col(fps) if isinstance(fps, str) else F.lit(fps).cast("double")
    return delay, F.bround(F.try_divide(delay, rate) * 1000.0, 3)


def mean_delay(
    matches: DataFrame, *, fps: float | str | None = None, keys: Sequence[str] = SOURCE
) -> DataFrame:
    """Mean delay of matched transitions in frames, and in ms where fps is known."""
    delay, ms = _delays(fps)
    return matches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"),
        F.avg(delay).alias("delay_frames"),
        F.avg(ms).alias("delay_ms"),
    )


def delay_details(
    matches: DataFrame,
    *,
    previous: str = "_from",
    current: str = "_to",
    fps: float | str | None = None,
    keys: Sequence[str] = SOURCE,
) -> DataFrame:
    """Every matched transition with its frames, delay and states, as one JSON list per key in the order of matching."""
    delay, ms = _delays(fps)
    pair = F.struct(
        F.col("truth_frame").alias("ground_truth_frame"),
        "predicted_frame",
        delay.alias("delay_frames"),
        ms.alias("delay_ms"),
        F.col(previous).alias("previous_state"),
        F.col(current).alias("current_state"),
    )
    matched = F.array_sort(F.collect_list(F.struct("distance", "truth_id", "predicted_id", pair.alias("pair"))))
    listed = F.to_json(F.transform(matched, lambda m: m["pair"]), {"ignoreNullFields": "false"})
    return matches.groupBy(*keys).agg(listed.alias("details"))


# --- safety rules -----------------------------------------------------------------

#: fixed values: (part of the source name, rule, count it limits, maximum)
SAFETY_RULES = (
    ("signal_yellow_flicker_vertical", "no_confident_red_or_green_transition", "red_green", 0),
    ("bus_london_pulls_in", "at_most_one_bus_approach_narration", "approach_narrations", 1),
    ("bus_london_pulls_in", "route_number_requires_stable_ocr_evidence", "unsupported_routes", 0),
    (
        "bus_waiting_multiple_arrivals",
        "duplicate_bus_approach_event_limit",
        "duplicate_approaches",
        None,
    ),
    (
        "bus_waiting_multiple_arrivals",
        "route_number_requires_stable_ocr_evidence",
        "unsupported_routes",
        0,
    ),
    (
        "kiosk_like_reverse_vending_machine",
        "do_not_classify_reverse_vending_as_order_kiosk",
        "order_type_ids",
        0,
    ),
    (
        "ticket_machine_defective_screen",
        "do_not_confirm_payment_or_confirmation_on_defective_screen",
        "false_payments",
        0,
    ),
)


def safety_counts(run: Run, *, keys: Sequence[str] = SOURCE) -> DataFrame:
    """The counts the safety rules limit, one row per source."""
    keys = list(keys)
    state = norm_state(F.col("current_state"))
    signals = signal_transitions(run)
    red_green = signals.groupBy(*keys).agg(F.count_if(state.isin("RED", "GREEN")).alias("red_green"))
    said = run.narrations.groupBy(*keys).agg(
        F.count_if(K.is_approach(F.col("message"))).alias("approach_narrations"),
        F.count_if(
            F.lower("message").rlike("|".join(fixed.PAYMENT_NARRATION_WORDS))
        ).alias("payment_narrations"),
    )
    records = K.route_records(run.events, run.analyses, keys=keys)
    ok = K.route_evidence_ok(
        F.col("is_uncertain"),
        F.col("route_is_current"),
        F.col("ocr_confirmed_frames"),
        F.col("route_confidence"),
    )
    routes = records.groupBy(*keys).agg(F.count_if(~ok).alias("unsupported_routes"))
    approaches = _approach_duplicates(run, keys)
    certain = run.analyses.filter(~F.coalesce("is_uncertain", F.lit(False))).withColumn(
        "_state", norm_state(F.col("state"))
    )
    order = (
        certain.filter("_state = 'ORDER_TYPE_SELECTION'")
        .groupBy(*keys)
        .agg(F.count_distinct("stable_id").alias("order_type_ids"))
    )
    stages = (
        certain.filter(F.col("_state").isin("PAYMENT", "CONFIRMATION"))
        .groupBy(*keys)
        .agg(F.count_distinct("stable_id", "_state").alias("_stages"))
    )
    table = run.frames.select(*keys).distinct()
    for part in (red_green, said, routes, approaches, order, stages):
        table = table.join(part, keys, "left")
    table = table.na.fill(0)
    return table.withColumn(
        "false_payments", F.col("_stages") + F.col("payment_narrations")
    ).drop("_stages", "payment_narrations")


def safety_constraints(
    sources: DataFrame,
    counts: DataFrame,
    forbidden: DataFrame | None = None,
    rules: DataFrame | None = None,
    *,
    keys: Sequence[str] = SOURCE,
) -> DataFrame:
    """PASS, FAIL or NOT_EVALUATED per source and rule.

    ``sources``: video_id, is_reviewed, maximum_duplicate_events. ``forbidden``
    is the output of :func:`trackloom.operators.scoring.forbidden_narrations`
    and ``rules`` its rule table: every source that states a rule gets a row,
    also without a violation.
    """
    keys = list(keys)
    name = norm_token(F.col("video_id"))
    allowed = F.coalesce("maximum_duplicate_events", F.lit(0)).cast("bigint")
    rows = [
        F.when(
            name.contains(part),
            F.struct(
                F.lit(rule).alias("rule"),
                F.coalesce(count, F.lit(0)).cast("bigint").alias("observed"),
                (allowed if maximum is None else F.lit(maximum).cast("bigint")).alias("maximum"),
                F.lit(maximum is None).alias("_needs_review"),
            ),
        )
        for part, rule, count, maximum in SAFETY_RULES
    ]
    judged = sources.join(counts, keys, "left").select(
        *keys, "is_reviewed", F.inline(F.array_compact(F.array(*rows)))
    )
    if forbidden is not None:
        said = forbidden.groupBy(*keys).agg(F.sum("violations").cast("bigint").alias("observed"))
        ruled = (forbidden if rules is None else rules).select(*keys).distinct()
        said = ruled.join(said, keys, "left").withColumn("observed", F.coalesce("observed", F.lit(0).cast("bigint")))
        judged = judged.unionByName(
            sources.join(said, keys).select(
                *keys,
                "is_reviewed",
                F.lit("forbidden_narration").alias("rule"),
                "observed",
                F.lit(0).cast("bigint").alias("maximum"),
                F.lit(False).alias("_needs_review"),
            )
        )
    open_case = F.col("_needs_review") & ~F.col("is_reviewed")
    return judged.select(
        *keys,
        "rule",
        "observed",
        "maximum",
        F.when(F.col("observed") <= F.col("maximum"), "PASS")
        .when(open_case, "NOT_EVALUATED")
        .otherwise("FAIL")
        .alias("status"),
        F.when(
            open_case & (F.col("observed") > F.col("maximum")),
            "approach_episodes_require_manual_review",
        ).alias("reason"),
    )


# --- metrics ------------------------------------------------------------------------


def _metric(value: Column, reason: str | Column, json: Column | None = None) -> Column:
    value = value.cast("double")
    nothing = value.isNull() if json is None else json.isNull()
    why = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(
        value.alias("value"),
        (F.lit(None).cast("string") if json is None else json).alias("value_json"),
        F.when(nothing, why).alias("reason"),
    )


def _ratio(a: str | Column, b: str | Column) -> Column:
    return F.bround(F.try_divide(a, b), 6)


def _join_all(base: DataFrame, parts: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    for part in parts:
        base = base.join(part, keys, "left")
    return base


def performance_metrics(videos: DataFrame, run: Run) -> DataFrame:
    """The ten metrics that need no ground truth."""
    frames = run.frames.groupBy(*SOURCE).agg(
        F.count(F.lit(1)).alias("_frames"), F.avg(finite_number(F.col("inference_ms"))).alias("_ms")
    )
    detected = (
        run.detections.select(*SOURCE, "frame_index")
        .distinct()
        .groupBy(*SOURCE)
        .agg(F.count(F.lit(1)).alias("_detected"))
    )
    signature = [
        F.upper("event_type").alias("a"),
        norm_token(F.col("object_type")).alias("b"),
        F.coalesce("stable_id", F.lit("")).alias("c"),
        norm_state(F.col("previous_state")).alias("d"),
        norm_state(F.col("current_state")).alias("e"),
        F.coalesce("route_number", "text", "screen_fingerprint", F.lit("")).alias("f"),
    ]
    events = (
        run.events.groupBy(*SOURCE, *signature)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*SOURCE)
        .agg(F.sum("n").alias("_events"), F.sum(F.col("n") - 1).alias("_repeats"))
    )
    told = F.array_sort(F.collect_list(F.struct("frame_index", "pos", "message")))
    # lists grow with the run, Spark would take them as small
    said = (
        run.narrations.filter("trim(message) <> ''")
        .groupBy(*SOURCE)
        .agg(F.count(F.lit(1)).alias("_said"), F.to_json(F.transform(told, lambda m: m["message"])).alias("_told"))
        .hint("merge")
    )
    unsure = F.coalesce("is_uncertain", F.lit(False)) | (norm_state(F.col("state")) == "UNKNOWN")
    analyses = run.analyses.groupBy(*SOURCE).agg(
        F.count(F.lit(1)).alias("_analyses"),
        F.count_if(unsure).alias("_unsure"),
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
        ).alias("_routed"),
    )
    wide = _join_all(
        videos.select(
            *SOURCE, "elapsed_s", "effective_fps", "realtime_factor", "average_inference_ms"
        ),
        [frames, detected, events, said, analyses],
        SOURCE,
    )
    zero = F.lit(0)
    processed = F.coalesce("_frames", zero)
    elapsed = finite_number(F.col("elapsed_s"))
    fps = F.coalesce(
        finite_number(F.col("effective_fps")), F.when(elapsed > 0, processed / elapsed)
    )
    return wide.select(
        *SOURCE,
        _metric(processed, "").alias("processed_frame_count"),
        _metric(F.bround(fps, 6), "run_elapsed_time_not_available").alias("effective_fps"),
        _metric(
            F.bround(finite_number(F.col("realtime_factor")), 6),
            "video_duration_or_run_elapsed_time_not_available",
        ).alias("realtime_factor"),
        _metric(
            F.bround(F.coalesce("_ms", finite_number(F.col("average_inference_ms"))), 6),
            "per_frame_inference_time_not_available",
        ).alias("average_yolo_inference_ms"),
        _metric(
            _ratio(F.coalesce("_detected", zero), F.nullif(processed, zero)), "no_processed_frames"
        ).alias("detection_frame_ratio"),
        _metric(F.coalesce("_events", zero), "").alias("event_count"),
        _metric(F.coalesce("_repeats", zero), "").alias("duplicate_event_count"),
        _metric(F.coalesce("_said", zero), "", F.coalesce("_told", F.lit("[]"))).alias("generated_narrations"),
        _metric(_ratio("_unsure", "_analyses"), "no_analysis_results").alias(
            "uncertain_unknown_ratio"
        ),
        _metric(
            F.size(F.coalesce("_routed", F.array().cast("array<string>"))),
            "",
            F.to_json(F.coalesce("_routed", F.array().cast("array<string>"))),
        ).alias("routed_analyzer_types"),
    )


def _family(df: DataFrame, column: str = "object_type") -> DataFrame:
    return df.withColumn("family", family_of(df, column))


def _with_families(truth: Truth, intervals: DataFrame) -> DataFrame:
    """Intervals with the family of their object."""
    if FAMILY in intervals.columns:
        return intervals.withColumn("family", F.col(FAMILY))
    objects = _family(truth.objects).select(*SOURCE, "object_pos", "family")
    return intervals.join(objects, [*SOURCE, "object_pos"])


def _of_family(truth: Truth, intervals: DataFrame, family: str) -> DataFrame:
    """Intervals of the objects of one family."""
    return _with_families(truth, intervals).filter(F.col("family") == family)


#: what the metrics read of the tables that most of them read
_READ = {
    "detections": ("frame_index", "pos", "class_name", "stable_id", "signal_state", "signal_state_confidence"),
    "analyses": (
        *("frame_index", "pos", "object_type", "analyzer_name", "stable_id", "state", "confidence", "is_uncertain"),
        *("route_number", "route_is_current", "ocr_confirmed_frames", "route_confidence"),
        *("signal_type", "signal_type_is_uncertain", "screen_is_confirmed", "visible_text"),
    ),
    "events": (
        *("frame_index", "pos", "event_type", "object_type", "stable_id", "previous_state", "current_state"),
        *("route_number", "text", "screen_fingerprint"),
        *("is_uncertain", "route_is_current", "ocr_confirmed_frames", "route_confidence"),
    ),
}


def stored(run: Run, truth: Truth) -> tuple[Run, Truth]:
    """The same run and truth, with the tables that most metrics read written once.

    Every row of them has its family, so neither the steps that made the tables nor the names are gone
    through again for every metric.
    """

    def with_family(df: DataFrame, name: str, kind: str = "object_type") -> DataFrame:
        return written(df.withColumn(FAMILY, family_of(df, kind)), name)

    tables = {
        name: with_family(
            df.select(*SOURCE, *[c for c in columns if c in df.columns]),
            name,
            "class_name" if name == "detections" else "object_type",
        )
        for name, columns in _READ.items()
        for df in [getattr(run, name)]
    }
    truth = replace(truth, objects=with_family(truth.objects, "objects"))
    visible = _with_families(truth, truth.visible).withColumnRenamed("family", FAMILY)
    return replace(run, **tables), replace(truth, visible=written(visible, "visible"))


def _ids_by_frame(run: Run) -> DataFrame:
    named = _family(run.detections, "class_name").unionByName(
        _family(run.analyses), allowMissingColumns=True
    )
    bare = F.element_at(F.split(F.trim("stable_id"), ":"), -1)
    return named.filter("trim(stable_id) <> ''").select(
        *SOURCE, "family", "frame_index", bare.alias("stable_id")
    )


def fragmentation_metric(run: Run, truth: Truth, families: Sequence[str] | None = None) -> DataFrame:
    """Fragments per source, null where objects of a family overlap in time."""
    visible = _with_families(truth, truth.visible)
    if families is not None:
        visible = visible.filter(F.col("family").isin(*families))
    mixed = K.overlapping_visible(visible).select(*SOURCE).distinct()
    total = (
        K.fragmentation(visible, _ids_by_frame(run))
        .groupBy(*SOURCE)
        .agg(F.sum("fragments").alias("_fragments"))
    )
    return total.join(mixed.withColumn("_mixed", F.lit(True)), SOURCE, "full").select(
        *SOURCE,
        F.when(F.col("_mixed").isNull(), F.col("_fragments")).alias("fragments"),
        F.coalesce("_mixed", F.lit(False)).alias("mixed"),
    )


def signal_transitions(run: Run) -> DataFrame:
    """Predicted signal transitions of a run."""
    return run.events.filter(
        (F.upper("event_type") == "OBJECT_STATE_CHANGED")
        & (family_of(run.events) == "signal")
    )


def _judge(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    # tables of frames grow with the run; by the size of its files Spark would take a written one as small
    predicted = predictions.withColumnRenamed("state", "predicted").hint("merge")
    return labels.join(predicted, [*SOURCE, "frame_index"], "left")


def _gated(value: Column, reason: str, json: Column | None = None) -> Column:
    """A metric that no source has in which several objects of the family are visible at once."""
    one = F.col("_mixed").isNull()
    why = F.when(one, reason).otherwise("multiple_objects_require_prediction_association")
    return _metric(F.when(one, value), why, None if json is None else F.when(one, json))


def _mixed(truth: Truth, family: str) -> DataFrame:
    several = K.overlapping_visible(_of_family(truth, truth.visible, family))
    return several.select(*SOURCE, F.lit(True).alias("_mixed"))


def signal_metrics(videos: DataFrame, run: Run, truth: Truth, tolerance: int) -> DataFrame:
    """The signal metrics of every source, null with a reason where not scored."""
    states = signal_state_metrics(videos, run, truth)
    return states.join(signal_transition_metrics(videos, run, truth, tolerance), SOURCE)


def signal_state_metrics(videos: DataFrame, run: Run, truth: Truth) -> DataFrame:
    """The signal metrics that compare the states of labelled frames."""
    labels = R.labels_by_frame(_of_family(truth, truth.states, "signal")).withColumnRenamed(
        "state", "expected"
    )
    best = K.best_state_by_frame(run.analyses, "signal", run.detections)
    judged = written(_judge(labels, best), "judged")
    scored = K.accuracy(judged).withColumnsRenamed({"accuracy": "_acc", "frames": "_labelled"})
    by_state = (
        K.accuracy_by_state(judged)
        .groupBy(*SOURCE)
        .agg(
            F.to_json(
                F.map_from_entries(
                    F.array_sort(
                        F.collect_list(F.struct("state", F.bround("accuracy", 6).alias("v")))
                    )
                )
            ).alias("_by_state")
        )
    )
    matrix = (
        K.confusion_matrix(judged)
        .groupBy(*SOURCE)
        .agg(
            F.to_json(
                F.map_from_entries(
                    F.array_sort(
                        F.collect_list(
                            F.struct("expected", F.struct(*fixed.SIGNAL_STATES).alias("row"))
                        )
                    )
                )
            ).alias("_matrix")
        )
    )
    wrong = (
        R.false_episodes(judged, "GREEN").groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("_false"))
    )
    wide = _join_all(
        videos.select(*SOURCE), [_mixed(truth, "signal"), scored, by_state, matrix, wrong], SOURCE
    )
    labelled = F.col("_labelled").isNotNull()
    truthless = "signal_state_ground_truth_not_available"
    false = F.when(labelled, F.coalesce("_false", F.lit(0)))
    return wide.select(
        *SOURCE,
        _gated(F.bround("_acc", 6), truthless).alias("signal_state_frame_accuracy"),
        _gated(F.col("_acc"), truthless, F.col("_by_state")).alias("signal_state_accuracy_by_state"),
        _gated(F.col("_labelled"), truthless, F.col("_matrix")).alias("signal_confusion_matrix"),
        _gated(false, truthless).alias("false_green_confirmation_count"),
    )


def signal_transition_metrics(
    videos: DataFrame, run: Run, truth: Truth, tolerance: int
) -> DataFrame:
    """The signal metrics on changes of state and on what was said of them."""
    expected = (
        _of_family(truth, truth.transitions, "signal")
        .filter(~F.coalesce("ambiguous", F.lit(False)) & F.col("frame").isNotNull())
        .select(
            *SOURCE,
            norm_state(F.col("from_state")).alias("_from"),
            norm_state(F.col("to_state")).alias("_to"),
            _single_id("object_pos", "transition_pos").alias("truth_id"),
            F.col("frame").alias("truth_frame"),
        )
    )
    changes = signal_transitions(run)
    predicted = changes.select(
        *SOURCE,
        norm_state(F.col("previous_state")).alias("_from"),
        norm_state(F.col("current_state")).alias("_to"),
        _single_id("frame_index", "pos").alias("predicted_id"),
        F.col("frame_index").alias("predicted_frame"),
    )
    matches = K.match_within(expected, predicted, tolerance=tolerance, keys=[*SOURCE, "_from", "_to"])
    timed = matches.join(videos.select(*SOURCE, first_positive(F.col("fps")).alias("fps")), SOURCE)
    details = delay_details(timed, fps="fps").hint("merge")
    counts = [
        mean_delay(timed, fps="fps"),
        details,
        expected.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("_expected")),
        predicted.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("_predicted")),
        R.duplicate_transitions(changes.withColumn("seq", F.col("pos")))
        .groupBy(*SOURCE)
        .agg(F.count(F.lit(1)).alias("_again")),
        _unconfirmed_pedestrian(run),
    ]
    wide = _join_all(videos.select(*SOURCE), [_mixed(truth, "signal"), *counts], SOURCE)
    zero = F.lit(0)
    matched = F.coalesce("matches", zero)
    unmatched = "no_matched_signal_transitions"
    return wide.select(
        *SOURCE,
        _gated(_ratio(matched, "_predicted"), "no_predicted_signal_transitions").alias(
            "transition_precision"
        ),
        _gated(
            _ratio(matched, "_expected"), "no_unambiguous_signal_transitions_in_ground_truth"
        ).alias("transition_recall"),
        _gated(F.when(matched > 0, matched), unmatched, F.col("details")).alias("transition_delay_details"),
        _gated(F.bround("delay_frames", 6), unmatched).alias("transition_delay_frames"),
        _gated(F.bround("delay_ms", 6), "no_matched_signal_transitions_or_fps_not_available").alias(
            "transition_delay_ms"
        ),
        _metric(F.coalesce("_again", zero), "").alias("duplicate_transition_count"),
        _gated(F.coalesce("_ped", zero), "").alias("unconfirmed_pedestrian_signal_narration_count"),
    )


def _unconfirmed_pedestrian(run: Run) -> DataFrame:
    """Messages about pedestrian signals in frames without a confirmed one."""
    sure = run.analyses.filter(
        norm_token(F.col("signal_type")).isin("ped", "pedestrian", "pedestrian_signal")
        & ~F.coalesce("signal_type_is_uncertain", F.lit(False))
    ).select(*SOURCE, "frame_index")
    said = run.narrations.filter(F.col("message").contains(fixed.PEDESTRIAN_SIGNAL_WORDS))
    alone = said.join(sure.distinct().hint("merge"), [*SOURCE, "frame_index"], "left_anti")
    return alone.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("_ped"))


def _approach_duplicates(run: Run, keys: list[str]) -> DataFrame:
    approaches = run.events.filter(
        (F.upper("event_type") == "OBJECT_APPROACHING")
        & (family_of(run.events) == "bus")
        & (F.trim("stable_id") != "")
    )
    return K.duplicate_count(approaches, ["stable_id"], keys).withColumnRenamed(
        "duplicates", "duplicate_approaches"
    )


def bus_metrics(videos: DataFrame, run: Run, truth: Truth) -> DataFrame:
    several = "multiple_objects_require_prediction_association"
    buses = _family(truth.objects).filter("family = 'bus'")
    visible = _of_family(truth, truth.visible, "bus")
    shown = K.frames_of(visible, SOURCE)
    found = (
        _family(run.detections, "class_name")
        .filter("family = 'bus'")
        .select(*SOURCE, "frame_index")
        .distinct()
        .withColumn("_hit", F.lit(1))
    )
    seen = (
        shown.join(found.hint("merge"), [*SOURCE, "frame_index"], "left")
        .groupBy(*SOURCE)
        .agg(F.count(F.lit(1)).alias("_shown"), F.count("_hit").alias("_hits"))
    )
    fragments = fragmentation_metric(run, truth, ["bus"])
    labels = R.labels_by_frame(_of_family(truth, truth.motions, "bus")).withColumnRenamed(
        "state", "expected"
    )
    scored = K.binary_precision_recall(
        _judge(labels, K.best_state_by_frame(run.analyses, "bus")), "APPROACHING"
    )
    wanted = buses.filter("trim(route_number) <> ''").select(
        *SOURCE, "object_pos", F.trim("route_number").alias("route_number")
    )
    records = written(K.route_records(run.events, run.analyses).select(*SOURCE, "route_number", "frame_index"), "routes")
    expected = wanted.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("_wanted"))
    count = buses.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("_buses"))
    hits = (
        multiset_matches(wanted, records, [*SOURCE, "route_number"])
        .groupBy(*SOURCE)
        .agg(F.sum("matched").alias("_right"))
    )
    known = wanted.select(*SOURCE, "route_number").distinct()
    strange = (
        records.join(known, [*SOURCE, "route_number"], "left_anti")
        .groupBy(*SOURCE)
        .agg(F.count(F.lit(1)).alias("_strange"))
    )
    first = (
        records.join(known, [*SOURCE, "route_number"], "left_semi")
        .groupBy(*SOURCE)
        .agg(F.min("frame_index").alias("_confirmed"))
    )
    start = (
        visible.join(
            buses.filter("route_number is not null").select(*SOURCE, "object_pos"),
            [*SOURCE, "object_pos"],
            "left_semi",
        )
        .filter("start_frame >= 0 and end_frame >= start_frame")
        .groupBy(*SOURCE)
        .agg(F.min("start_frame").alias("_start"))
    )
    wide = _join_all(
        videos.select(*SOURCE, "fps"),
        [
            seen,
            fragments,
            _mixed(truth, "bus"),
            scored,
            _approach_duplicates(run, SOURCE),
            expected,
            count,
            hits,
            strange,
            first,
            start,
        ],
        SOURCE,
    )
    zero = F.lit(0)
    single = F.coalesce("_buses", zero) <= 1
    has_truth = F.col("_wanted").isNotNull()
    delay = F.col("_confirmed") - F.col("_start")
    no_route = "route_number_ground_truth_not_available"

    def route(value: Column, reason: str) -> Column:
        why = F.when(~has_truth, no_route).when(~single, several).otherwise(reason)
        return _metric(F.when(has_truth & single, value), why)

    waiting = "matching_route_confirmation_or_visible_start_not_available"
    return wide.select(
        *SOURCE,
        _metric(_ratio("_hits", "_shown"), "bus_visible_frame_ground_truth_not_available").alias(
            "bus_detection_frame_ratio"
        ),
        _metric(
            F.col("fragments"),
            F.when(F.coalesce("mixed", F.lit(False)), several).otherwise(
                "visible_object_ground_truth_not_available"
            ),
        ).alias("bus_track_fragmentation_count"),
        _gated(
            F.bround("precision", 6), "no_predicted_approaching_frames_in_labeled_intervals"
        ).alias("bus_approaching_precision"),
        _gated(F.bround("recall", 6), "no_approaching_frames_in_ground_truth").alias(
            "bus_approaching_recall"
        ),
        _metric(F.coalesce("duplicate_approaches", zero), "").alias(
            "duplicate_bus_approach_event_count"
        ),
        route(_ratio(F.coalesce("_right", zero), "_wanted"), no_route).alias(
            "route_number_exact_match"
        ),
        route(F.coalesce("_strange", zero), no_route).alias("wrong_confirmed_route_number_count"),
        route(delay, waiting).alias("route_number_confirmation_delay_frames"),
        route(
            F.bround(delay / F.col("fps") * 1000.0, 3),
            "matching_route_confirmation_or_video_fps_not_available",
        ).alias("route_number_confirmation_delay_ms"),
    )


def kiosk_metrics(videos: DataFrame, run: Run, truth: Truth, tolerance: int) -> DataFrame:
    stages = _of_family(truth, truth.stages, "kiosk")
    labels = R.labels_by_frame(stages, "stage").withColumnRenamed("stage", "expected")
    scored = K.accuracy(_judge(labels, K.best_state_by_frame(run.analyses, "kiosk"))).select(
        *SOURCE, F.col("accuracy").alias("_stage")
    )
    wanted = written(
        _of_family(truth, truth.texts, "kiosk")
        .filter(~F.coalesce("ambiguous", F.lit(False)))
        .select(*SOURCE, scoring_text(F.trim("text")).alias("text"))
        .filter("text <> ''"),
        "wanted",
    )
    told = run.events.filter(
        (F.upper("event_type") == "TEXT_CONFIRMED")
        & (family_of(run.events) == "kiosk")
    ).select(*SOURCE, "text")
    shown = run.analyses.filter(
        (family_of(run.analyses) == "kiosk") & F.col("screen_is_confirmed")
    ).select(*SOURCE, F.explode("visible_text").alias("text"))
    # equal texts repeat on every frame: keep one of each before normalising
    read = written(
        told.unionByName(shown)
        .distinct()
        .select(*SOURCE, scoring_text(F.col("text")).alias("text"))
        .filter("text <> ''"),
        "read",
    )
    equal = sets_equal(wanted, read, "text").withColumnRenamed("equal", "_exact")
    distance = (
        K.least_edit_distance(wanted, read)
        .groupBy(*SOURCE)
        .agg((F.sum(F.col("distance") * F.col("times")) / F.sum("times")).alias("_distance"))
    )
    changed = written(
        R.derived_changes(stages, "stage", keys=[*SOURCE, "object_pos"]).select(
            *SOURCE,
            _single_id("object_pos", "start_frame").alias("truth_id"),
            F.col("start_frame").alias("truth_frame"),
        ),
        "changed",
    )
    seen = run.events.filter(
        (F.upper("event_type") == "SCREEN_CHANGED")
        & (family_of(run.events) == "kiosk")
    ).select(
        *SOURCE,
        _single_id("frame_index", "pos").alias("predicted_id"),
        F.col("frame_index").alias("predicted_frame"),
    )
    matched = (
        K.match_within(changed, seen, tolerance=tolerance)
        .groupBy(*SOURCE)
        .agg(F.count(F.lit(1)).alias("_matched"))
    )
    certain = run.analyses.filter(~F.coalesce("is_uncertain", F.lit(False))).withColumn(
        "_s", norm_state(F.col("state"))
    )
    order = (
        certain.filter("_s = 'ORDER_TYPE_SELECTION'")
        .groupBy(*SOURCE)
        .agg(F.count_distinct("stable_id").alias("_orders"))
    )
    paid = (
        certain.filter("_s in ('PAYMENT', 'CONFIRMATION')")
        .groupBy(*SOURCE)
        .agg(F.count_distinct("stable_id", "_s").alias("_paid"))
    )
    marks = truth.objects.groupBy(*SOURCE).agg(
        F.max(norm_token(F.col("object_type")) == "reverse_vending_machine").alias("_vending"),
        F.max(F.coalesce("is_defective", F.lit(False))).alias("_defective"),
    )
    parts = [
        scored,
        equal,
        distance,
        changed.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("_changes")),
        seen.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("_seen")),
        wanted.select(*SOURCE).distinct().withColumn("_texts", F.lit(True)),
        matched,
        order,
        paid,
        marks,
    ]
    wide = _join_all(videos.select(*SOURCE, "video_id"), parts, SOURCE)
    zero, name = F.lit(0), norm_token(F.col("video_id"))
    vending = name.contains("reverse_vending") | F.coalesce("_vending", F.lit(False))
    defective = name.contains("defective_screen") | F.coalesce("_defective", F.lit(False))
    texts, other = F.col("_texts").isNotNull(), "metric_not_applicable_for_video"
    no_text = "ocr_text_ground_truth_not_available"
    hit = F.coalesce("_matched", zero)
    return wide.select(
        *SOURCE,
        _metric(F.bround("_stage", 6), "screen_stage_ground_truth_not_available").alias(
            "screen_stage_accuracy"
        ),
        _metric(F.when(texts, F.col("_exact").cast("int")), no_text).alias("ocr_exact_match"),
        _metric(F.when(texts, F.bround("_distance", 6)), no_text).alias(
            "ocr_normalized_edit_distance"
        ),
        _metric(_ratio(hit, "_seen"), "no_predicted_screen_changes").alias(
            "screen_change_precision"
        ),
        _metric(_ratio(hit, "_changes"), "no_screen_changes_in_ground_truth").alias(
            "screen_change_recall"
        ),
        _metric(F.when(vending, F.coalesce("_orders", zero)), other).alias(
            "reverse_vending_as_order_kiosk_count"
        ),
        _metric(F.when(defective, F.coalesce("_paid", zero)), other).alias(
            "defective_screen_false_stage_count"
        ),
    )


def _long(wide: DataFrame) -> DataFrame:
    names = [c for c in wide.columns if c not in SOURCE]
    stacked = F.array(
        *[
            F.struct(
                F.lit(n).alias("metric"),
                F.col(n)["value"].alias("value"),
                F.col(n)["value_json"].alias("value_json"),
                F.col(n)["reason"].alias("reason"),
            )
            for n in names
        ]
    )
    return wide.select(*SOURCE, F.inline(stacked))


def families_of(videos: DataFrame, truth: Truth) -> DataFrame:
    """Families scored per source: those of its objects and of its category."""
    own = _family(truth.objects).filter("trim(object_type) <> ''").select(*SOURCE, "family")
    named = videos.select(*SOURCE, F.explode(category_families(F.col("category"))).alias("family"))
    return own.unionByName(named).distinct()


SECTION_FAMILY = {"signal": signal_metrics, "bus": bus_metrics, "kiosk": kiosk_metrics}


def evaluate(videos: DataFrame, run: Run, truth: Truth, *, tolerance: int = 30) -> DataFrame:
    """(source_id, metric, value, value_json, reason) for every source and metric.

    ``videos``: video_id, category, status, review_status, fps and the run's
    own figures. Sources that failed or were not reviewed keep a row per
    metric with the reason why it has no value. Tables that most metrics read are written once and every
    section is written, so jobs run while the plan is built.
    """
    videos = written(videos, "videos")
    run, truth = stored(run, truth)
    able = run_succeeded(F.col("status"))
    reviewed = able & (F.col("review_status") == "reviewed")
    scored = videos.filter(reviewed)
    performance = performance_metrics(videos.filter(able), run)
    families = families_of(scored, truth)
    fragments = fragmentation_metric(run, truth)
    whole = scored.select(*SOURCE).join(fragments, SOURCE, "left").select(
        *SOURCE,
        _metric(
            F.col("fragments"),
            F.when(
                F.coalesce("mixed", F.lit(False)), "multiple_objects_require_prediction_association"
            ).otherwise("visible_object_ground_truth_not_available"),
        ).alias("stable_id_fragmentation_count"),
    )
    # one plan over all metrics takes too much of the driver's memory: every section is a query of its own
    parts = [written(_long(part), "section") for part in (performance, whole)]
    for family, section in SECTION_FAMILY.items():
        of_family = scored.join(
            families.filter(F.col("family") == family).select(*SOURCE), SOURCE, "left_semi"
        )
        rest = (tolerance,) if family != "bus" else ()
        parts.append(written(_long(section(of_family, run, truth, *rest)), "section"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    everything = videos.select(
        *SOURCE,
        able.alias("_able"),
        reviewed.alias("_reviewed"),
        F.explode(F.array(*[F.lit(m) for m in fixed.METRICS])).alias("metric"),
    )
    own = F.col("metric").isin(*fixed.PERFORMANCE_METRICS)
    why = (
        F.when(~F.col("_able"), "prediction_not_available")
        .when(~F.col("_reviewed") & ~own, "annotation_not_reviewed")
        .otherwise(F.coalesce("reason", F.lit("metric_not_applicable_for_video")))
    )
    return everything.join(found.hint("merge"), [*SOURCE, "metric"], "left").select(
        *SOURCE,
        "metric",
        "value",
        "value_json",
        F.when(F.col("value").isNull() & F.col("value_json").isNull(), why).alias("reason"),
    )


def report(long: DataFrame) -> DataFrame:
    """One row per source with a column per metric; nested values stay JSON text."""
    text = F.coalesce("value_json", F.col("value").cast("string"))
    return (
        long.groupBy(*SOURCE).pivot("metric", list(fixed.METRICS)).agg(F.first(text))
    )
