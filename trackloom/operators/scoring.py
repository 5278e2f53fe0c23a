"""Building blocks for scoring results against reviewed ground truth."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import fixed
from trackloom.functions.classes import family_of, norm_state
from trackloom.functions.geometry import is_finite
from trackloom.functions.text import is_bus_approach_message
from trackloom.operators.matching import match_within  # noqa: F401 - part of scoring
from trackloom.operators.phrases import phrases_said
from trackloom.session import cut

SOURCE = ("source_id",)


def route_evidence_ok(
    uncertain: Column, is_current: Column, confirmations: Column, confidence: Column
) -> Column:
    """A route number rests on enough agreeing reads."""
    return (
        ~F.coalesce(uncertain, F.lit(False))
        & F.coalesce(is_current, F.lit(False))
        & F.coalesce(confirmations >= 3, F.lit(False))
        & is_finite(confidence)
        & F.coalesce(confidence >= 0.75, F.lit(False))
    )


def frames_of(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct frames covered by closed ranges; unusable ranges are skipped."""
    usable = ranges.filter((F.col("start_frame") >= 0) & (F.col("end_frame") >= F.col("start_frame")))
    return usable.select(
        *keys, F.explode(F.sequence("start_frame", "end_frame")).alias("frame_index")
    ).distinct()


def overlapping_visible(
    ranges: DataFrame, *, keys: Sequence[str] = ("source_id", "family"), item: str = "object_pos"
) -> DataFrame:
    """Keys in which two different objects are visible in one frame.

    Ranges are spread over their frames and a frame keeps only its smallest
    and largest object, so no pair of ranges is ever formed.
    """
    usable = ranges.filter((F.col("start_frame") >= 0) & (F.col("end_frame") >= F.col("start_frame")))
    per_frame = (
        usable.select(*keys, item, F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
        .groupBy(*keys, "frame")
        .agg((F.min(item) != F.max(item)).alias("_two"))
    )
    return per_frame.groupBy(*keys).agg(F.max("_two").alias("overlaps")).filter("overlaps").select(*keys)


def duplicate_count(rows: DataFrame, signature: Sequence[str], keys: Sequence[str] = SOURCE):
    """How many rows repeat an earlier one with the same signature, per key."""
    counted = rows.groupBy(*keys, *signature).agg((F.count(F.lit(1)) - 1).alias("_extra"))
    return counted.groupBy(*keys).agg(F.sum("_extra").alias("duplicates"))


def confusion_matrix(judged: DataFrame, keys: Sequence[str] = SOURCE) -> DataFrame:
    """Counts of expected against predicted signal states, zeros included.

    One row per key and expected state; states outside the domain are not
    scored, predictions outside it count as UNKNOWN.
    """
    predicted = F.coalesce("predicted", F.lit("UNKNOWN"))
    cell = F.when(predicted.isin(*fixed.SIGNAL_STATES), predicted).otherwise("UNKNOWN")
    counts = [
        F.count_if((F.col("expected") == e) & (cell == p)).alias(f"{e}_{p}")
        for e in fixed.SCORED_SIGNAL_STATES
        for p in fixed.SIGNAL_STATES
    ]
    wide = judged.groupBy(*keys).agg(*counts)
    rows = [
        F.struct(
            F.lit(e).alias("expected"), *[F.col(f"{e}_{p}").alias(p) for p in fixed.SIGNAL_STATES]
        )
        for e in fixed.SCORED_SIGNAL_STATES
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def accuracy(judged: DataFrame, keys: Sequence[str] = SOURCE) -> DataFrame:
    right = F.coalesce("predicted", F.lit("UNKNOWN")) == F.col("expected")
    return judged.groupBy(*keys).agg(
        (F.count_if(right) / F.count(F.lit(1))).alias("accuracy"), F.count(F.lit(1)).alias("frames")
    )


def accuracy_by_state(judged: DataFrame, keys: Sequence[str] = SOURCE) -> DataFrame:
    """Accuracy per labelled state, null for states without labels."""
    right = F.coalesce("predicted", F.lit("UNKNOWN")) == F.col("expected")
    aggregated = judged.groupBy(*keys).agg(
        *[
            F.try_divide(
                F.count_if(right & (F.col("expected") == s)), F.count_if(F.col("expected") == s)
            ).alias(s)
            for s in fixed.ANNOTATED_SIGNAL_STATES
        ]
    )
    states = [
        F.struct(F.lit(s).alias("state"), F.col(s).alias("accuracy"))
        for s in fixed.ANNOTATED_SIGNAL_STATES
    ]
    return aggregated.select(*keys, F.inline(F.array(*states)))


def binary_precision_recall(
    judged: DataFrame, positive: str, keys: Sequence[str] = SOURCE
) -> DataFrame:
    """Precision and recall over labelled frames; null without a denominator."""
    said = F.coalesce("predicted", F.lit("UNKNOWN")) == positive
    true = F.col("expected") == positive
    return judged.groupBy(*keys).agg(
        F.try_divide(F.count_if(said & true), F.count_if(said)).alias("precision"),
        F.try_divide(F.count_if(said & true), F.count_if(true)).alias("recall"),
    )


def best_state_by_frame(
    analyses: DataFrame,
    family: str,
    detections: DataFrame | None = None,
    *,
    keys: Sequence[str] = SOURCE,
) -> DataFrame:
    """State of the most confident result of a family per frame, first one on ties.

    Signals fall back to the states of the detections in frames without any
    result of the family.
    """
    keys = [*keys, "frame_index"]

    def ranked(df: DataFrame, kind: str, state: str, confidence: str, level: int) -> DataFrame:
        number = F.when(is_finite(F.col(confidence)), F.col(confidence)).otherwise(0.0)
        said = norm_state(F.col(state))
        if "is_uncertain" in df.columns:
            said = F.when(F.coalesce("is_uncertain", F.lit(False)), "UNKNOWN").otherwise(said)
        return df.filter(family_of(df, kind) == family).select(
            *keys, F.struct(F.lit(level), number, -F.col("pos")).alias("_rank"), said.alias("_state")
        )

    rows = ranked(analyses, "object_type", "state", "confidence", 1)
    if detections is not None and family == "signal":
        rows = rows.unionByName(
            ranked(detections, "class_name", "signal_state", "signal_state_confidence", 0)
        )
    return rows.groupBy(*keys).agg(F.max_by("_state", "_rank").alias("state"))


def route_records(
    events: DataFrame, analyses: DataFrame, *, keys: Sequence[str] = SOURCE
) -> DataFrame:
    """First confirmation of every (object, route); analyses only where no event exists."""
    keys = list(keys)
    number = F.trim("route_number")
    facts = ["frame_index", "is_uncertain", "route_is_current", "ocr_confirmed_frames", "route_confidence"]

    def firsts(df: DataFrame) -> DataFrame:
        named = df.filter((family_of(df) == "bus") & (number != ""))
        return (
            named.groupBy(*keys, "stable_id", number.alias("route_number"))
            .agg(F.min_by(F.struct(*facts), F.struct("frame_index", "pos")).alias("_f"))
            .select(*keys, "stable_id", "route_number", "_f.*")
        )

    told = firsts(events.filter(F.upper("event_type") == "TEXT_CONFIRMED"))
    silent = firsts(analyses).join(told.select(*keys).distinct(), keys, "left_anti")
    return told.unionByName(silent)


def fragmentation(
    visible: DataFrame,
    predicted: DataFrame,
    *,
    keys: Sequence[str] = SOURCE,
) -> DataFrame:
    """Ids beyond the first that follow one ground-truth object, per object.

    ``visible``: object_pos, family, start_frame, end_frame. ``predicted``:
    family, frame_index, stable_id.
    """
    keys = list(keys)
    frames = frames_of(visible, [*keys, "object_pos", "family"])
    ids = predicted.select(*keys, "family", "frame_index", "stable_id").distinct()
    met = (
        frames.join(ids.hint("merge"), [*keys, "family", "frame_index"])
        .select(*keys, "family", "object_pos", "stable_id")
        .distinct()
        .groupBy(*keys, "family", "object_pos")
        .agg(F.count(F.lit(1)).alias("_ids"))
    )
    objects = visible.select(*keys, "family", "object_pos").distinct()
    return objects.join(met, [*keys, "family", "object_pos"], "left").select(
        *keys,
        "family",
        "object_pos",
        F.greatest(F.lit(0), F.coalesce("_ids", F.lit(0)) - 1).alias("fragments"),
    )


#: shares of edits up to which a nearest text is looked for, round by round; the last round has no limit
RADII = (0.15, 0.4)


def least_edit_distance(
    expected: DataFrame, predicted: DataFrame, *, keys: Sequence[str] = SOURCE
) -> DataFrame:
    """Distance of every expected text to its nearest prediction; 1 without any.

    Both sides hold distinct texts per key before they meet, and equal texts are found by an
    equi-join. For the rest the search grows: within a share r of edits only texts of a length between
    (1 - r) and 1 / (1 - r) of the own one can lie, so these meet by key and length, and their distance is
    computed up to that bound only. A text that found one leaves; what is left after the last radius
    meets all texts of its key. Jobs run while the plan is built.
    """
    keys = list(keys)
    wanted = cut(expected.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("times")))
    offered = cut(predicted.select(*keys, F.col("text").alias("other")).distinct().withColumn("_size", F.char_length("other")))
    equal = offered.select(*keys, F.col("other").alias("text"))
    exact = wanted.join(equal, [*keys, "text"], "left_semi").withColumn("distance", F.lit(0.0))
    rest = wanted.join(equal, [*keys, "text"], "left_anti")
    longest = F.greatest(F.char_length("text"), F.char_length("other"), F.lit(1))
    found = [exact]
    for radius in (*RADII, None):
        if radius is None:
            near = rest.join(offered, keys).withColumn("_edits", F.levenshtein("text", "other"))
        else:
            size = F.char_length("text")
            sizes = F.sequence(F.ceil(size * (1 - radius)).cast("int"), F.floor(size / (1 - radius)).cast("int"))
            pairs = rest.select("*", F.explode(sizes).alias("_size")).join(offered, [*keys, "_size"])
            # the bound of a plan must be one number; a greater distance than that of the pair is dropped after it
            near = pairs.withColumn("_edits", _edits_within(radius)).filter((F.col("_edits") >= 0) & (F.col("_edits") <= longest * radius))
        near = near.groupBy(*keys, "text", "times").agg(F.min(F.col("_edits") / longest).alias("distance"))
        if radius is not None:
            near = cut(near)
        found.append(near)
        rest = rest.join(near.select(*keys, "text"), [*keys, "text"], "left_anti")
    found.append(rest.withColumn("distance", F.lit(1.0)))
    return functools.reduce(DataFrame.unionByName, found)


def _edits_within(radius: float) -> Column:
    """Edit distance of text and other, cut off at the share of their length in steps of doubling bounds; -1 beyond."""
    longest = F.greatest(F.char_length("text"), F.char_length("other"), F.lit(1))
    bound = longest * radius
    edits = F.levenshtein("text", "other")
    for step in (64, 16, 4, 1):
        edits = F.when(bound <= step, F.levenshtein("text", "other", step)).otherwise(edits)
    return edits


def forbidden_narrations(
    narrations: DataFrame, rules: DataFrame, *, keys: Sequence[str] = SOURCE, ascii_words: bool = False
) -> DataFrame:
    """Violations of forbidden phrases and patterns per key and rule.

    ``rules``: kind (phrase or pattern) and rule text. Phrases match anywhere
    whatever their case, all of them in one walk; patterns are regular expressions, which
    match whatever the case of a letter of any script. With ``ascii_words`` only ASCII letters, digits
    and the underscore make up the words that ``\\b`` and ``\\B`` look for, as in SQL engines with RE2.
    """
    keys = list(keys)
    phrases = phrases_said(narrations, rules.filter("kind = 'phrase'"), keys).select(*keys, F.lit("phrase").alias("kind"), "rule", "violations")
    # A faulty pattern is taken literally; each distinct one is looked at once.
    own = rules.filter("kind <> 'phrase'")
    patterns = own.select("rule").distinct().withColumn("_pattern", _valid_patterns(F.col("rule"), F.lit(ascii_words)))
    met = narrations.join(own.join(patterns, "rule"), keys).filter("message rlike concat('(?iu)', _pattern)")
    return phrases.unionByName(met.groupBy(*keys, "kind", "rule").agg(F.count(F.lit(1)).alias("violations")))


def valid_pattern(pattern: str) -> str:
    """A pattern as given, or escaped literally when it is no regular expression."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return re.escape(pattern)
    return pattern


_WORD = "[0-9A-Za-z_]"
_BOUNDARIES = {
    r"\b": f"(?-iu:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    r"\B": f"(?-iu:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
}


def ascii_boundaries(pattern: str) -> str:
    """A pattern whose word boundaries, outside of classes, are those of ASCII words."""
    out, depth, at = [], 0, 0
    while at < len(pattern):
        size = 2 if pattern[at] == "\\" else 1
        part = pattern[at : at + size]
        depth = depth + 1 if part == "[" else max(depth - 1, 0) if part == "]" else depth
        out.append(part if depth else _BOUNDARIES.get(part, part))
        at += size
    return "".join(out)


@F.pandas_udf(T.StringType())
def _valid_patterns(rules: pd.Series, ascii_words: pd.Series) -> pd.Series:
    patterns = rules.map(valid_pattern)
    return patterns.map(ascii_boundaries) if ascii_words.iloc[:1].any() else patterns


def is_approach(message: Column) -> Column:
    return is_bus_approach_message(message)


def interpolated_percentiles(
    df: DataFrame, value: str, *, keys: Sequence[str] = SOURCE, points=(0.5, 0.95)
) -> DataFrame:
    """Exact percentiles with linear interpolation.

    Equal values are counted first. Distinct values are dealt by ranges of about equal numbers of
    rows, whatever their spread, and the two values a percentile lies between are looked for only
    in the parts whose row counts say that they hold them. One job runs while the plan is built; no
    group has to fit into one task.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = cut(counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_rows"), F.min("_v").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys,
        "_part",
        "_rows",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("_all"),
    )
    places = [F.lit(float(p)) * (F.col("_all") - 1) for p in points]
    ranks = [rank for place in places for rank in (F.floor(place), F.ceil(place))]
    wanted = functools.reduce(operator.or_, [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_rows")) for r in ranks])
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.join(parts.filter(wanted), [*keys, "_part"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    picks = []
    for i, place in enumerate(places):
        for name, rank in (("a", F.floor(place)), ("b", F.ceil(place))):
            held = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
            picks.append(F.max(F.when(held, F.col("_v"))).alias(f"_{name}{i}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_w{i}"))
    low, high, share = (lambda i: F.col(f"_a{i}")), (lambda i: F.col(f"_b{i}")), (lambda i: F.col(f"_w{i}"))
    return ranked.groupBy(*keys).agg(*picks).select(
        *keys,
        *[
            # equal neighbours need no step, which also keeps infinite ones
            F.when((low(i) == high(i)) | (share(i) == 0), low(i)).otherwise(low(i) + (high(i) - low(i)) * share(i)).alias(f"p{round(p * 100)}")
            for i, p in enumerate(points)
        ],
    )


def ordered_texts(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Position of every message within its key, for ordered reports."""
    from trackloom.operators.runs import row_numbers

    return row_numbers(rows, list(keys), list(order))


