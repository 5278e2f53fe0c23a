"""Screens, texts and descriptions confirmed over several reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import text as X
from trackloom.functions import vectorized as V
from trackloom.functions.classes import bounded_confidence
from trackloom.functions.geometry import is_finite
from trackloom.operators.fold import fold
from trackloom.operators.keyed import (
    DEFAULT_SPAN,
    carry_last,
    chunk_window,
    drop_ghosts,
    streaks,
    with_halo,
)
from trackloom.operators.runs import OBJECT, cadence_due
from trackloom.operators.steps import ConfirmText


def clean_lines(lines: Column) -> Column:
    """Read lines without blanks and with confidences clamped to 0..1.

    ``lines`` is an array of structs with text, confidence and box.
    """
    kept = F.filter(
        lines, lambda x: (X.strip(x["text"]) != "") & is_finite(F.coalesce(x["confidence"], F.lit(0.0)))
    )
    return F.transform(
        kept,
        lambda x: F.struct(
            X.strip(x["text"]).alias("text"),
            F.greatest(
                F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x["confidence"], F.lit(0.0)))
            ).alias("confidence"),
            x["box"].alias("box"),
        ),
    )


def accept_lines(
    lines: DataFrame,
    group: Sequence[str],
    *,
    minimum_confidence: float = 0.6,
    order: str = "pos",
    exact_unicode: bool = True,
) -> DataFrame:
    """Confident lines of a read, first of each normalised text, in order.

    The lines of one read are few, yet the first of each is found by an
    aggregation, not by sorting the read.
    """
    search = V.search_text if exact_unicode else X.search_text
    show = V.display_text if exact_unicode else X.collapse_spaces
    usable = (
        lines.filter(
            is_finite(F.col("confidence")) & F.col("confidence").between(minimum_confidence, 1.0)
        )
        .withColumn("text", show(F.col("text")))
        .withColumn("search_text", search(F.col("text")))
        .filter("search_text <> ''")
    )
    rest = [c for c in usable.columns if c not in {*group, "search_text"}]
    return (
        usable.groupBy(*group, "search_text")
        .agg(F.min_by(F.struct(*rest), order).alias("_first"))
        .select(*group, "search_text", "_first.*")
    )


def button_candidates(lines: DataFrame) -> DataFrame:
    """Accepted lines with a box and a short label."""
    return lines.filter(
        F.col("box").isNotNull()
        & (F.col("box.right") > F.col("box.left"))
        & (F.col("box.bottom") > F.col("box.top"))
        & F.char_length("search_text").between(1, 30)
    )


def line_confidence(lines: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean confidence of a read, weighted by characters that are not white space."""
    weight = F.char_length(F.regexp_replace("text", r"(?U)\s", ""))
    return (
        lines.withColumn("_w", weight)
        .filter("_w > 0")
        .groupBy(*group)
        .agg((F.sum(F.col("confidence") * F.col("_w")) / F.sum("_w")).alias("ocr_confidence"))
    )


def confirm_reads(
    reads: DataFrame,
    value: str,
    *,
    minimum_reads: int = 3,
    run: str | None = None,
    keys: Sequence[str] = OBJECT,
    order: str = "frame_index",
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Confirm a value over executed reads; null breaks, so does a new ``run``.

    Adds ``confirmed`` (null while pending), ``streak``, ``changed``,
    ``previous`` and ``is_first``.
    """
    found = streaks(
        reads, keys, [order], {"_v": value}, minimum=minimum_reads, run=run, span=span
    )
    return found.select(*reads.columns, *_judged("_v", value, minimum_reads).values())


def _judged(name: str, value: str, minimum: int, prefix: str = "") -> dict[str, Column]:
    """Confirmation columns of one value after :func:`streaks`."""
    streak, before = F.col(f"{name}_streak"), F.col(f"{name}_before")
    confirms = F.col(value).isNotNull() & (streak == minimum)
    settled = (streak >= minimum) | F.coalesce(before == F.col(value), F.lit(False))
    changed = confirms & F.coalesce(before != F.col(value), F.lit(False))
    columns = {
        "confirmed": F.when(settled, F.col(value)),
        "streak": streak,
        "changed": changed,
        "previous": F.when(changed, before),
        "is_first": confirms & before.isNull(),
    }
    return {k: c.alias(prefix + k) for k, c in columns.items()}


def kiosk_analysis(
    screens: DataFrame,
    *,
    minimum_reads: int = 3,
    minimum_detection_confidence: float = 0.5,
    keys: Sequence[str] = OBJECT,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Stage and screen of a kiosk, one row per read.

    ``screens`` holds per read: frame_index, run_start (of the unbroken frames),
    confidence of the detection, ocr_confidence, and the normalised lines as
    ``search_lines`` (null or empty when nothing was read).
    """
    sure = bounded_confidence(F.col("confidence")) >= minimum_detection_confidence
    lines = F.when(sure, F.col("search_lines"))
    canonical = F.array_sort(F.array_distinct(lines))
    seen = screens.withColumns(
        {
            "observed_stage": X.infer_stage(F.coalesce(F.array_join(lines, " "), F.lit(""))),
            "observed_fingerprint": F.when(
                F.size(canonical) > 0, F.sha2(F.array_join(canonical, X.SEPARATOR), 256)
            ),
        }
    ).withColumn("_stage", F.when(F.col("observed_stage") != "UNKNOWN", F.col("observed_stage")))
    found = streaks(
        seen,
        keys,
        ["frame_index"],
        {"_g": "_stage", "_f": "observed_fingerprint"},
        minimum=minimum_reads,
        run="run_start",
        span=span,
    )
    both = found.select(
        *seen.columns,
        *_judged("_g", "_stage", minimum_reads, "stage_").values(),
        *_judged("_f", "observed_fingerprint", minimum_reads, "screen_").values(),
    )
    combined = F.when(sure, F.least("confidence", "ocr_confidence")).otherwise(0.0)
    stage, screen = F.col("stage_confirmed"), F.col("screen_confirmed")
    return both.withColumns(
        {
            "state": F.coalesce(stage, F.lit("UNKNOWN")),
            "is_uncertain": stage.isNull(),
            "result_confidence": F.when(stage.isNotNull(), combined).otherwise(0.0),
            "screen_changed": F.col("screen_changed") | F.col("screen_is_first"),
            "screen_initial_confirmation": F.col("screen_is_first"),
            "screen_is_confirmed": screen.isNotNull(),
            "screen_fingerprint": screen,
            "screen_confidence": F.when(screen.isNotNull(), combined).otherwise(0.0),
        }
    ).drop("_stage", "stage_confirmed", "screen_confirmed", "screen_is_first", "stage_is_first")


def large_enough(
    lines: Column,
    crop_width: Column,
    crop_height: Column,
    *,
    minimum_confidence: float = 0.6,
    width: int = 8,
    height: int = 8,
    pixels: int = 64,
) -> Column:
    """Confident lines whose visible box is large enough to be trusted."""

    def wide(x):
        return F.greatest(
            F.lit(0), F.least(crop_width, x["box"]["right"]) - F.greatest(F.lit(0), x["box"]["left"])
        )

    def tall(x):
        return F.greatest(
            F.lit(0), F.least(crop_height, x["box"]["bottom"]) - F.greatest(F.lit(0), x["box"]["top"])
        )

    return F.filter(
        lines,
        lambda x: (X.strip(x["text"]) != "")
        & (x["confidence"] >= minimum_confidence)
        & F.coalesce((wide(x) >= width) & (tall(x) >= height) & (wide(x) * tall(x) >= pixels), F.lit(False)),
    )


def crop_large_enough(
    crop_width: Column, crop_height: Column, width: int = 32, height: int = 16, pixels: int = 512
) -> Column:
    return (
        (crop_width >= width) & (crop_height >= height) & (crop_width * crop_height >= pixels)
    )


def text_confirmation(
    reads: DataFrame,
    *,
    minimum_reads: int = 3,
    similarity: float = 1.0,
    keys: Sequence[str] = OBJECT,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Confirmed text per read.

    ``reads`` holds every frame of the object with ``due`` (a read ran), the
    joined ``text`` (null when nothing usable was read) and its confidence.
    """
    marked = reads.withColumn("fingerprint", V.fingerprint(F.col("text")))
    return fold(marked, keys, ["frame_index"], ConfirmText(minimum_reads, similarity), span=span)


def description_due(
    det: DataFrame,
    *,
    interval: int = 15,
    minimum_seen: int = 3,
    minimum_detection_confidence: float = 0.5,
    keys: Sequence[str] = OBJECT,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Frames on which an object is described: only these reach the model.

    A gap or a weak detection starts the waiting time over. ``run_start`` is
    the first frame of the unbroken run.
    """
    sure = bounded_confidence(F.col("confidence")) >= minimum_detection_confidence
    steady = det.filter(sure)
    w = chunk_window(keys, "frame_index")
    gap = F.coalesce(F.lag("frame_index").over(w) != F.col("frame_index") - 1, F.lit(True))
    marked = drop_ghosts(
        with_halo(steady, "frame_index", span=span, before=1).withColumn("_head", gap),
        keep_chunk=True,
    )
    started = carry_last(
        marked,
        keys,
        ["frame_index"],
        {"run_start": F.when(F.col("_head"), F.col("frame_index"))},
        span=span,
    )
    waited = F.col("frame_index") - F.col("run_start") - (minimum_seen - 1)
    return started.filter((waited >= 0) & (F.pmod(waited, F.lit(interval)) == 0)).drop("_head")


def description_confirmation(
    described: DataFrame,
    *,
    minimum_results: int = 2,
    minimum_confidence: float = 0.5,
    keys: Sequence[str] = OBJECT,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Descriptions confirmed by equal results in a row (case does not matter)."""
    clean = X.clean_description(F.col("description"))
    good = F.coalesce(F.col("vlm_confidence"), F.lit(0.0)) >= minimum_confidence
    rows = described.withColumn("_text", F.when(good, clean)).withColumn(
        "_folded", F.lower("_text")
    )
    judged = confirm_reads(
        rows, "_folded", minimum_reads=minimum_results, run="run_start", keys=keys, span=span
    )
    return judged.withColumn(
        "description", F.when(F.col("confirmed").isNotNull(), F.col("_text"))
    ).drop("_text", "_folded", "confirmed", "previous")


__all__ = [
    "accept_lines",
    "button_candidates",
    "cadence_due",
    "clean_lines",
    "confirm_reads",
    "crop_large_enough",
    "description_confirmation",
    "description_due",
    "kiosk_analysis",
    "large_enough",
    "line_confidence",
    "text_confirmation",
]
