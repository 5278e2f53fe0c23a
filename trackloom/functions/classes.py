"""Names, states and confidences as columns."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.strings import strip

from trackloom.functions import fixed
from trackloom.functions.geometry import is_finite


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return functools.reduce(operator.or_, [text.contains(w) for w in words], F.lit(False))


def norm_class(name: Column) -> Column:
    """Canonical class name; the form used throughout the package."""
    clean = F.regexp_replace(F.lower(strip(name)), r"(?U)[\s-]+", "_")
    return F.when(F.coalesce(clean, F.lit("")) == "", "unknown").otherwise(clean)


def norm_token(name: Column) -> Column:
    """Words of a name joined by ``_``; blanks give an empty string."""
    spaced = F.translate(F.lower(strip(name)), "-", " ")
    return F.regexp_replace(strip(spaced), r"(?U)\s+", "_")


def object_family(name: Column) -> Column:
    """Family an object type is scored in; other types form their own."""

    def family(token: Column) -> Column:
        return (
            F.when(token.isin(*fixed.FAMILY_SIGNAL_TYPES) | token.contains("signal"), "signal")
            .when(token.isin(*fixed.FAMILY_BUS_TYPES) | token.endswith("_bus"), "bus")
            .when(
                token.isin(*fixed.FAMILY_KIOSK_TYPES) | contains_any(token, fixed.FAMILY_KIOSK_WORDS),
                "kiosk",
            )
            .otherwise(token)
        )

    # as an element the token is made once a row; a filter would make it again for every test
    return F.transform(F.array(norm_token(name)), family)[0]


#: column of a table whose families were made once, when it was written
FAMILY = "_family"


def family_of(df: DataFrame, name: str = "object_type") -> Column:
    """Family of every row, as written with the table or from the object type."""
    return F.col(FAMILY) if FAMILY in df.columns else object_family(F.col(name))


def category_families(category: Column) -> Column:
    """Families named by the words of a category."""
    token = norm_token(category)
    return F.array_compact(
        F.array(
            F.when(contains_any(token, fixed.CATEGORY_SIGNAL_WORDS), "signal"),
            F.when(contains_any(token, fixed.CATEGORY_BUS_WORDS), "bus"),
            F.when(contains_any(token, fixed.CATEGORY_KIOSK_WORDS), "kiosk"),
        )
    )


def norm_state(state: Column) -> Column:
    """Upper-case state, ``UNKNOWN`` for null and blank."""
    clean = F.upper(strip(state))
    return F.when(F.coalesce(clean, F.lit("")) == "", "UNKNOWN").otherwise(clean)


def known_state(state: Column) -> Column:
    """Upper-case state, null for everything that means 'not known'."""
    clean = F.upper(strip(state))
    return F.when(~clean.isin(*fixed.UNKNOWN_STATES), clean)


def bounded_confidence(value: Column, fallback: float | None = 0.0) -> Column:
    """A confidence within 0..1, else the fallback."""
    number = value.cast("double")
    return F.when(is_finite(number) & number.between(0.0, 1.0), number).otherwise(F.lit(fallback))


def gated_state(state: Column, confidence: Column, minimum: float) -> Column:
    """A weak observation stays as a row that breaks streaks."""
    strong = bounded_confidence(confidence) >= minimum
    return F.when(strong, norm_state(state)).otherwise("UNKNOWN")


def finite_number(value: Column) -> Column:
    """Number that is neither NaN nor infinite, else null."""
    number = value.try_cast("double")
    return F.when(is_finite(number), number)


def whole_number(value: Column) -> Column:
    """Text or number as an integer (fractions cut off), else null."""
    return finite_number(value).try_cast("bigint")


def canonical_stable_id(key: Column) -> Column:
    """Bare id after the last colon, null when blank."""
    clean = strip(key)
    return F.when(clean != "", F.element_at(F.split(clean, ":"), -1))


def resolve_stable_id(stable_id: Column, track_id: Column) -> Column:
    """Given id, else the raw track, else null (an error row for the caller)."""
    given = F.when(strip(stable_id) != "", strip(stable_id))
    return F.coalesce(given, F.concat(F.lit("track-"), track_id.cast("string")))


def is_signal_detection(class_name: Column, class_id: Column) -> Column:
    blank = F.coalesce(strip(class_name), F.lit("")) == ""
    return F.when(blank, class_id == fixed.LEGACY_SIGNAL_CLASS_ID).otherwise(
        norm_class(class_name).isin(*fixed.SIGNAL_TYPES)
    )


def is_signal_name(name: Column) -> Column:
    clean = F.translate(F.lower(strip(name)), " ", "_")
    return contains_any(clean, ("signal", "traffic_light"))


def class_specs(spark: SparkSession) -> DataFrame:
    """Analyzer kind and signal subtype per canonical class (19 fixed rows)."""
    return spark.createDataFrame(
        list(fixed.CLASS_SPECS), "spec_class string, analyzer string, signal_type string"
    )


def analyzer_name(name: Column) -> Column:
    """Analyzer that handles a class; unknown classes go to the generic one."""
    kinds: dict[str, list[str]] = {}
    for cls, kind, _ in fixed.CLASS_SPECS:
        kinds.setdefault(kind, []).append(cls)

    def analyzer(clean: Column) -> Column:
        chain = F
        for kind in ("traffic_light", "bus", "kiosk", "text"):
            chain = chain.when(clean.isin(*kinds[kind]), fixed.ANALYZER_NAMES[kind])
        return chain.otherwise(fixed.ANALYZER_NAMES["generic"])

    return F.transform(F.array(norm_class(name)), analyzer)[0]


def importance(object_type: Column) -> Column:
    """5 for signals down to 1: what matters most to somebody walking."""
    clean = F.translate(F.lower(strip(object_type)), " ", "_")
    return (
        F.when(contains_any(clean, ("signal", "traffic_light")), 5)
        .when(clean.isin(*fixed.IMPORTANT_VEHICLES), 4)
        .when(clean.isin(*fixed.IMPORTANT_LIVING), 3)
        .when(contains_any(clean, fixed.IMPORTANT_WORDS), 2)
        .otherwise(1)
    )


def object_name(query: Column) -> Column:
    """Search name: aliases first, else lower case with underscores."""
    clean = strip(query)
    pairs = [F.lit(x) for pair in fixed.OBJECT_NAME_ALIASES.items() for x in pair]
    alias = F.element_at(F.create_map(*pairs), clean)
    return F.coalesce(alias, F.translate(F.lower(clean), " ", "_"))


def legacy_event_type(event_type: Column) -> Column:
    pairs = [F.lit(x) for pair in fixed.LEGACY_EVENT_TYPES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.lower(event_type))


def presence_confidence(detection_confidence: Column) -> Column:
    """Detector evidence alone; objects without any keep full confidence."""
    return F.when(detection_confidence.isNull(), 1.0).otherwise(
        bounded_confidence(detection_confidence)
    )


def combined_evidence(detection_confidence: Column, evidence: Column) -> Column:
    """The weaker of detector and analysis evidence."""
    own = bounded_confidence(evidence)
    return F.when(detection_confidence.isNull(), own).otherwise(
        F.least(own, bounded_confidence(detection_confidence))
    )


def state_confidence(
    object_type: Column,
    detection_confidence: Column,
    confidence: Column,
    motion_confidence: Column,
    signal_confidence: Column,
    minimum_detection_confidence: Column,
) -> Column:
    """Evidence for the state of an object, by the kind of object."""
    token = norm_token(object_type)
    floor = bounded_confidence(minimum_detection_confidence, None)
    floor = F.coalesce(floor, F.lit(0.2))
    too_weak = detection_confidence.isNotNull() & (bounded_confidence(detection_confidence) < floor)
    signal = F.coalesce(signal_confidence, confidence)
    return (
        F.when(
            token.isin(*fixed.VEHICLE_TYPES),
            combined_evidence(detection_confidence, F.coalesce(motion_confidence, confidence)),
        )
        .when(
            token.isin(*fixed.SIGNAL_TYPES),
            F.when(too_weak, 0.0).otherwise(combined_evidence(detection_confidence, signal)),
        )
        .otherwise(combined_evidence(detection_confidence, confidence))
    )


def state_confidence_ok(object_type: Column, confidence: Column, minimum: float = 0.5) -> Column:
    """Signals keep every transition with some evidence; others need the minimum."""
    return F.when(norm_token(object_type).isin(*fixed.SIGNAL_TYPES), confidence > 0).otherwise(
        confidence >= minimum
    )


def dominant_signal(
    red: Column,
    green: Column,
    yellow: Column,
    *,
    minimum_ratio: float = 0.015,
    minimum_margin: float = 0.015,
    minimum_dominance: float = 2.0,
) -> Column:
    """Winning colour and its share of all colour, UNKNOWN when it does not stand out."""
    ranked = F.sort_array(F.array(red, green, yellow), asc=False)
    first, second = ranked[0], ranked[1]
    clear = (
        (first >= minimum_ratio)
        & (first - second >= minimum_margin)
        & (first >= F.lit(minimum_dominance) * second)
    )
    name = F.when(red == first, "RED").when(green == first, "GREEN").otherwise("YELLOW")
    return F.struct(
        F.when(clear, name).otherwise("UNKNOWN").alias("state"),
        F.when(clear, first / (red + green + yellow)).otherwise(0.0).alias("confidence"),
    )


def safe_id(value: Column) -> Column:
    return strip(value).rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$")


def category_token(category: Column) -> Column:
    clean = F.regexp_replace(F.lower(strip(category)), "[^a-z0-9]+", "_")
    return strip(F.regexp_replace(clean, "^_+|_+$", ""))


def run_succeeded(status: Column) -> Column:
    return status.isNull() | norm_token(status).isin(*fixed.SUCCESSFUL_RUNS)


def review_status(explicit: Column, reviewed: Column, needs_review: Column, flag: Column) -> Column:
    """Review status from its three historical shapes."""
    return (
        F.when(explicit.isNotNull(), norm_token(explicit))
        .when(F.coalesce(reviewed, F.lit(False)), "reviewed")
        .when(F.coalesce(needs_review, F.lit(False)), "needs_manual_review")
        .when(F.coalesce(flag, F.lit(False)), "reviewed")
        .otherwise("needs_manual_review")
    )


def first_positive(*values: Column) -> Column:
    numbers = [finite_number(v) for v in values]
    return F.coalesce(*[F.when(n > 0, n) for n in numbers])


def seconds_ago(now_ms: Column, then_ms: Column) -> Column:
    """Whole seconds between two epoch-millisecond times, never negative."""
    return F.greatest(F.lit(0), F.bround((now_ms - then_ms) / F.lit(1000.0)).cast("bigint"))


def seconds_since(now_ms: Column, then_ms: Column) -> Column:
    return F.greatest(F.lit(0.0), F.bround((now_ms - then_ms) / F.lit(1000.0), 1))


def frozen(attributes: Column) -> Column:
    """A map as text that is equal for equal content whatever the entry order."""
    return F.to_json(F.array_sort(F.map_entries(attributes)))


def parse_interval(text: Column) -> Column:
    """Closed frame interval from an object (two spellings) or a pair; null if unusable."""
    named = F.from_json(text, "start_frame bigint, end_frame bigint, start bigint, `end` bigint")
    pair = F.from_json(text, "array<bigint>")
    start = F.coalesce(named["start_frame"], named["start"], F.get(pair, F.lit(0)))
    end = F.coalesce(named["end_frame"], named["end"], F.get(pair, F.lit(1)))
    return F.when(
        (start >= 0) & (end >= start), F.struct(start.alias("start_frame"), end.alias("end_frame"))
    )


def messages_of(raw: Column) -> Column:
    """Messages given as a JSON list or as one plain string, blanks dropped."""
    listed = F.when(strip(raw).startswith("["), F.from_json(raw, "array<string>"))
    return F.filter(F.coalesce(listed, F.array(raw)), lambda m: strip(m) != "")


def reasons(*coded: tuple[str, Column]) -> Column:
    """Reason codes that apply, in the given order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, name) for name, c in coded])))


def headline(codes: Column) -> Column:
    return F.get(codes, F.lit(0))
