"""Identity of detections: stable ids, signal targets, box pairs.

Inputs are detections with the columns source_id, frame_index, det_index,
class_id, class_name, confidence, x1, y1, x2, y2 and a nullable track_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.classes import is_signal_detection, norm_class
from trackloom.functions.geometry import box_area, iou, is_display_shape, same_display
from trackloom.operators.fold import _walk, fold, settle
from trackloom.operators.keyed import CHUNK, chunk_of
from trackloom.operators.steps import Identity, IdentityNames, SignalTargets

BOX = ("x1", "y1", "x2", "y2")
#: frames per chunk of a sequential fold; a frame holds a few dozen boxes at most
FOLD_SPAN = 20_000


def assign_stable_ids(
    det: DataFrame,
    *,
    keys: Sequence[str] = ("source_id",),
    iou_threshold: float = 0.3,
    maximum_reconnect: int = 3,
    maximum_missed: int = 8,
    span: int = FOLD_SPAN,
) -> DataFrame:
    """Add ``stable_no``, ``stable_id`` and ``object_key`` to every detection.

    A raw track keeps its id while that id is alive; other detections join the
    nearest recent box of their class by overlap; the rest get new ids. Ids are
    numbered per key (use ``(source_id, epoch)`` where sessions restart).
    """
    keys = list(keys)
    keep = [c for c in det.columns if c not in keys]
    ddl = [f"`{c}` {det.schema[c].dataType.simpleString()}" for c in keep]
    step = Identity(keep, ddl, iou_threshold, maximum_reconnect, maximum_missed)
    order = ["frame_index", "det_index"]
    rows = det.withColumn(CHUNK, chunk_of("frame_index", span))
    starts, ends = settle(rows, keys, order, step)
    slotted = _walk(rows, starts, keys, order, step, emit=True)
    number = F.col("slot") + 1
    if ends is not None:
        chunks = ends.select(*keys, F.col(CHUNK).alias("_chunk_no"), "_note")
        names = fold(chunks, keys, ["_chunk_no"], IdentityNames(), span=2**62)
        slotted = slotted.join(names.withColumnRenamed("_chunk_no", CHUNK), [*keys, CHUNK])
        number = F.when(
            F.col("slot") < F.col("start_count"),
            F.element_at("inherited", (F.col("slot") + 1).cast("int")),
        ).otherwise(F.col("first_new") + F.col("slot") - F.col("start_count"))
    named = slotted.select(*det.columns, number.alias("stable_no"))
    return named.withColumns(
        {
            "stable_id": F.concat(F.lit("stable-"), F.col("stable_no").cast("string")),
            "object_key": F.concat(
                "class_name", F.lit(":stable-"), F.col("stable_no").cast("string")
            ),
        }
    )


def signal_detections(det: DataFrame) -> DataFrame:
    return det.filter(is_signal_detection(F.col("class_name"), F.col("class_id")))


def select_targets(
    det: DataFrame, *, keys: Sequence[str] = ("source_id",), span: int = FOLD_SPAN
) -> DataFrame:
    """The one signal box per overlapping group and frame.

    A box whose raw track was chosen in the frame before is preferred, then
    boxes of display shape, then the most confident, largest, first one.
    """
    signals = signal_detections(det).withColumn("class_token", norm_class(F.col("class_name")))
    return fold(signals, keys, ["frame_index", "det_index"], SignalTargets(), span=span)


def iou_pairs(
    det: DataFrame, tracks: DataFrame, *, minimum: float = 0.3, keys: Sequence[str] = ("source_id",)
) -> DataFrame:
    """Detections and track boxes of one frame and class that overlap enough.

    ``tracks`` holds the last boxes of live tracks with ``track_no``; both
    sides join on the frame too, so no pair crosses frames.
    """
    on = [*keys, "frame_index", "class_name"]
    other = tracks.select(*on, "track_no", *[F.col(c).alias(f"t_{c}") for c in BOX])
    pairs = det.join(other, on).withColumn(
        "iou", iou([F.col(c) for c in BOX], [F.col(f"t_{c}") for c in BOX])
    )
    return pairs.filter(F.col("iou") >= minimum)


def same_object_pairs(det: DataFrame, *, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Pairs of boxes in one frame that show the same signal."""
    on = [*keys, "frame_index", "class_token"]
    boxes = det.withColumn("class_token", norm_class(F.col("class_name")))
    first = boxes.select(
        *on, F.col("det_index").alias("first_index"), *[F.col(c).alias(f"a_{c}") for c in BOX]
    )
    second = boxes.select(
        *on, F.col("det_index").alias("second_index"), *[F.col(c).alias(f"b_{c}") for c in BOX]
    )
    return (
        first.join(second, on)
        .filter("first_index < second_index")
        .filter(
            same_display([F.col(f"a_{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX])
        )
        .select(*keys, "frame_index", "class_token", "first_index", "second_index")
    )


def representative_per_group(
    det: DataFrame, group: Sequence[str], *, locked: str | None = None
) -> DataFrame:
    """Best box of every group: locked, then display-shaped, then any.

    An aggregation with one candidate per group, not a sort of the group.
    """
    tier = F.when(is_display_shape([F.col(c) for c in BOX]), 1).otherwise(0)
    if locked is not None:
        tier = F.when(F.col(locked), 2).otherwise(tier)
    rank = F.struct(tier, F.col("confidence"), box_area(*BOX), -F.col("det_index"))
    return (
        det.groupBy(*group)
        .agg(F.max_by(F.struct("det_index", "confidence"), rank).alias("_best"))
        .select(*group, "_best.det_index", "_best.confidence")
    )


def most_urgent_first(hazards: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Rank the hazards of a frame by time to contact; input order breaks ties."""
    w = Window.partitionBy(*keys, "frame_index").orderBy("time_to_contact_s", "stable_id")
    return hazards.withColumn("urgency_rank", F.row_number().over(w))
