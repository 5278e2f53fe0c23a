"""The whole way from detections to messages, as one declarative plan.

The only sequential steps are identity (per source) and the message queue;
everything between them is keyed by source and object.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import fixed
from trackloom.functions.classes import (
    analyzer_name,
    bounded_confidence,
    gated_state,
    norm_class,
)
from trackloom.operators import hazard as HZ
from trackloom.operators import motion as MO
from trackloom.operators import narration as NA
from trackloom.operators import runs as R
from trackloom.operators import scene as S
from trackloom.operators import tracks as T
from trackloom.operators.keyed import previous_row
from trackloom.operators.runs import OBJECT
from trackloom.session import cut

KEY = list(OBJECT)


@dataclass
class Settings:
    frame_width: int = 640
    frame_height: int = 480
    minimum_seen: int = 3
    maximum_missed: int = 8
    reconnect_iou: float = 0.3
    maximum_reconnect: int = 3
    minimum_state_frames: int = 3
    minimum_signal_confidence: float = 0.2
    narration_ttl_s: float = 5.0
    hazard_ttl_s: float = 1.5
    narration_cooldown_s: float = 5.0
    narration_capacity: int = 32
    presence_types: tuple[str, ...] = field(default=())
    #: a source silent for longer starts anew: identities, states and messages
    maximum_gap_s: float = 2.0


@dataclass
class Outcome:
    detections: DataFrame
    results: DataFrame
    hazards: DataFrame
    events: DataFrame
    narrations: DataFrame


def signal_analysis(
    det: DataFrame,
    *,
    minimum_frames: int = 3,
    minimum_confidence: float = 0.2,
    keys: Sequence[str] = OBJECT,
) -> DataFrame:
    """Confirmed signal state per row of signal tracks.

    Needs state and evidence (the classifier's), and the detector's confidence;
    a weak detection counts as an unknown observation.
    """
    seen = bounded_confidence(F.col("confidence"))
    gated = det.withColumns(
        {
            "_observed": gated_state(F.col("state"), F.col("confidence"), minimum_confidence),
            "detection_confidence": seen,
        }
    ).drop("state")
    judged = R.debounce(gated, "_observed", minimum_frames=minimum_frames, keys=keys)
    return judged.withColumns(
        {
            "state": F.col("confirmed_state"),
            "signal_confidence": bounded_confidence(F.col("evidence")),
            "confidence": F.when(
                ~F.col("is_uncertain"),
                F.least("detection_confidence", bounded_confidence(F.col("evidence"))),
            ).otherwise(0.0),
            "minimum_detection_confidence": F.lit(minimum_confidence),
        }
    ).drop("confirmed_state", "_observed")


def route(det: DataFrame, analyzers: dict[str, callable]) -> DataFrame:
    """Send the rows of every class to its analyzer and put the results together.

    ``analyzers`` maps an analyzer name to a function DataFrame -> DataFrame of
    results. Rows without an analyzer pass on as uncertain and unknown.
    """
    named = det.withColumn("analyzer_name", analyzer_name(F.col("class_name")))
    results = None
    for name, analyze in analyzers.items():
        part = analyze(named.filter(F.col("analyzer_name") == name))
        results = part if results is None else results.unionByName(part, allowMissingColumns=True)
    rest = named.filter(~F.col("analyzer_name").isin(*analyzers)).select(
        *KEY,
        "frame_index",
        "timestamp_s",
        norm_class(F.col("class_name")).alias("object_type"),
        F.lit("UNKNOWN").alias("state"),
        F.lit(True).alias("is_uncertain"),
        F.lit(0.0).alias("confidence"),
        F.col("confidence").alias("detection_confidence"),
        "analyzer_name",
    )
    return rest if results is None else results.unionByName(rest, allowMissingColumns=True)


def _signals(settings: Settings):
    def analyze(det: DataFrame) -> DataFrame:
        judged = signal_analysis(
            det,
            minimum_frames=settings.minimum_state_frames,
            minimum_confidence=settings.minimum_signal_confidence,
        )
        return judged.select(
            *KEY,
            "frame_index",
            "timestamp_s",
            norm_class(F.col("class_name")).alias("object_type"),
            "state",
            "is_uncertain",
            "confidence",
            "detection_confidence",
            "signal_confidence",
            "minimum_detection_confidence",
            "analyzer_name",
        )

    return analyze


def _vehicles(det: DataFrame) -> DataFrame:
    moved = MO.vehicle_motion(det.drop("state"))
    return moved.select(
        *KEY,
        "frame_index",
        "timestamp_s",
        norm_class(F.col("class_name")).alias("object_type"),
        "state",
        F.col("motion_is_uncertain").alias("is_uncertain"),
        F.when(~F.col("motion_is_uncertain"), F.col("motion_confidence"))
        .otherwise(0.0)
        .alias("confidence"),
        F.col("confidence").alias("detection_confidence"),
        "motion_confidence",
        "analyzer_name",
    )


def dense_frames(det: DataFrame) -> DataFrame:
    """Every frame between the first and last of a source; frames without detections lie evenly in time."""
    seen = det.groupBy("source_id", "frame_index").agg(F.min("timestamp_s").alias("timestamp_s"))
    following = previous_row(seen, ["source_id"], ["frame_index"], {"_frame": "frame_index", "_time": "timestamp_s"}, reverse=True)
    last = F.coalesce(F.col("_frame") - 1, F.col("frame_index"))
    step = F.coalesce(F.try_divide(F.col("_time") - F.col("timestamp_s"), F.col("_frame") - F.col("frame_index")), F.lit(0.0))
    spread = following.select(
        "source_id", F.col("frame_index").alias("_from"), "timestamp_s", step.alias("_step"), F.explode(F.sequence("frame_index", last)).alias("frame_index")
    )
    return spread.select("source_id", "frame_index", (F.col("timestamp_s") + F.col("_step") * (F.col("frame_index") - F.col("_from"))).alias("timestamp_s"))


def _in_sessions(det: DataFrame, frames: DataFrame, maximum_gap_s: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detections and frames keyed by session, a source between two long gaps, and the table of sessions."""
    epochs = R.gap_epochs(frames.select("source_id", "frame_index", "timestamp_s"), order=["timestamp_s", "frame_index"], maximum_gap=maximum_gap_s)
    epochs = cut(epochs.withColumn("_session", F.concat_ws("#", F.col("source_id").cast("string"), F.col("epoch").cast("string"))))
    named = det.join(epochs.select("source_id", "frame_index", "_session"), ["source_id", "frame_index"])
    sessions = epochs.select("_session", "source_id", "epoch").distinct()
    return (
        named.withColumn("source_id", F.col("_session")).drop("_session"),
        epochs.select(F.col("_session").alias("source_id"), "frame_index", "timestamp_s"),
        sessions,
    )


def _by_source(df: DataFrame, sessions: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "source_id"]
    return df.withColumnRenamed("source_id", "_session").join(sessions, "_session").select("source_id", "epoch", *rest)


def arrival_order(events: DataFrame, tracked: DataFrame) -> DataFrame:
    """Add ``seq``: events of a frame by phase, then by their detections, then by the age of their object.

    Objects without a detection in the frame, such as those that left, come last.
    """
    at = tracked.groupBy(*KEY, "frame_index").agg(F.min("det_index").alias("_det"))
    number = F.regexp_extract("stable_id", "([0-9]+)$", 1).try_cast("bigint")
    order = Window.partitionBy("source_id", "frame_index").orderBy("phase", F.col("_det").asc_nulls_last(), number, "event_type")
    return events.join(at, [*KEY, "frame_index"], "left").withColumn("seq", F.row_number().over(order).cast("bigint")).drop("_det")


def run_pipeline(det: DataFrame, settings: Settings | None = None, frames: DataFrame | None = None) -> Outcome:
    """Identity, analysis, events, risk and messages of any number of sources.

    ``det`` are raw detections with an observed signal ``state`` and its
    ``evidence`` where a classifier ran. ``frames`` lists every processed frame
    (source_id, frame_index, timestamp_s), empty ones included; without it every
    frame between a source's first and last counts as processed. All results
    have the ``epoch`` of their source; ids are unique within one. Jobs run
    while the plan is built.
    """
    settings = settings or Settings()
    det, frames, sessions = _in_sessions(det, dense_frames(det) if frames is None else frames, settings.maximum_gap_s)
    det = cut(det)
    others = det.filter(~norm_class(F.col("class_name")).isin(*fixed.SIGNAL_TYPES))
    chosen = T.select_targets(det).select("source_id", "frame_index", "det_index")
    signals = T.signal_detections(det).join(
        chosen, ["source_id", "frame_index", "det_index"], "left_semi"
    )
    # identities and results are read by several branches: written once each
    tracked = cut(
        T.assign_stable_ids(
            others.unionByName(signals),
            iou_threshold=settings.reconnect_iou,
            maximum_reconnect=settings.maximum_reconnect,
            maximum_missed=settings.maximum_missed,
        )
    )
    results = route(
        tracked,
        {
            fixed.ANALYZER_NAMES["traffic_light"]: _signals(settings),
            fixed.ANALYZER_NAMES["bus"]: _vehicles,
        },
    )
    results = cut(results)
    seen = R.presence(
        tracked,
        frames,
        minimum_seen=settings.minimum_seen,
        maximum_missed=settings.maximum_missed,
    )
    announced = seen.filter("event_type = 'appeared'").select(
        *KEY, F.col("frame_index").alias("_from")
    )
    observed = (
        T.signal_detections(tracked)
        .join(announced, KEY)
        .filter(F.col("frame_index") >= F.col("_from"))
        .select(*KEY, "frame_index", "state")
    )
    asked = R.state_transitions(observed, minimum_frames=settings.minimum_state_frames)
    scene = S.scene_events(results, seen, asked)
    hazards = HZ.hazard_events(
        tracked, frame_width=settings.frame_width, frame_height=settings.frame_height
    )
    risky = hazards.select(
        *KEY,
        "frame_index",
        F.lit(-1).alias("phase"),
        "event_type",
        "object_type",
        F.col("level").alias("current_state"),
        "confidence",
        F.lit(False).alias("is_uncertain"),
        F.col("level").alias("hazard_level"),
        "zone",
        "emission_index",
        "time_to_contact_s",
    )
    clock = frames.select("source_id", "frame_index", F.col("timestamp_s").alias("now_s"))
    events = risky.unionByName(scene, allowMissingColumns=True).join(
        clock, ["source_id", "frame_index"], "left"
    )
    events = cut(arrival_order(events, tracked))
    candidates = NA.narratable(events, presence_types=settings.presence_types)
    narrations = NA.narration_queue(
        candidates,
        clock,
        capacity=settings.narration_capacity,
        cooldown_s=settings.narration_cooldown_s,
        default_ttl_s=settings.narration_ttl_s,
        ttl_by_event_type={"HAZARD_DETECTED": settings.hazard_ttl_s},
    )
    return Outcome(*(_by_source(t, sessions) for t in (tracked, results, hazards, events, narrations)))
