"""Text functions: normalisation, fingerprints, stages, questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.strings import strip

from trackloom.functions import fixed
from trackloom.functions.classes import contains_any

SEPARATOR = "\u001f"


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)[\s\u200b\ufeff]+", " "))


def search_text(text: Column) -> Column:
    """Lower case with everything but digits, a-z and Hangul syllables as one space.

    The built-in form for text that is already NFKC; ``vectorized.search_text``
    also folds compatibility characters.
    """
    kept = F.regexp_replace(F.lower(collapse_spaces(text)), "[^0-9a-z가-힣]+", " ")
    return strip(kept)


def _search_words(phrases: tuple[str, ...]) -> tuple[str, ...]:
    """Fixed phrases are stored in display form; they hold no character to fold."""
    return tuple(" ".join(p.lower().split()) for p in phrases)


def infer_stage(searchable: Column) -> Column:
    """Screen stage from the normalised text of all its lines."""
    dine_in = contains_any(searchable, _search_words(fixed.DINE_IN_PHRASES))
    takeout = contains_any(searchable, _search_words(fixed.TAKEOUT_PHRASES))
    action = contains_any(searchable, _search_words(fixed.PAYMENT_ACTION_PHRASES))
    method = contains_any(searchable, _search_words(fixed.PAYMENT_METHOD_PHRASES))
    strong = contains_any(searchable, _search_words(fixed.PAYMENT_STRONG_PHRASES))
    done = contains_any(searchable, _search_words(fixed.CONFIRMATION_PHRASES))
    return (
        F.when(F.coalesce(searchable, F.lit("")) == "", "UNKNOWN")
        .when(done, "CONFIRMATION")
        .when(dine_in & takeout, "ORDER_TYPE_SELECTION")
        .when(strong | (action & method), "PAYMENT")
        .otherwise("UNKNOWN")
    )


def is_option(searchable: Column) -> Column:
    return contains_any(searchable, _search_words(fixed.OPTION_PHRASES)) | searchable.isin(
        *_search_words(fixed.EXACT_OPTIONS)
    )


def first_of_each(lines: Column, key) -> Column:
    """Keep the first element for every key, in order (arrays of one screen only)."""
    keys = F.transform(lines, key)
    return F.filter(lines, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def visible_options(lines: Column, search=search_text) -> Column:
    """Allow-listed labels among the lines, first of each kind, in order."""
    options = F.filter(lines, lambda line: is_option(search(line)))
    return first_of_each(options, search)


def screen_text(lines: Column, search=search_text) -> Column:
    return strip(F.array_join(F.transform(lines, search), " "))


def screen_fingerprint(lines: Column, search=search_text) -> Column:
    """SHA-256 of the distinct normalised lines in order; null for an empty screen."""
    canonical = F.array_sort(
        F.array_distinct(F.filter(F.transform(lines, search), lambda s: s != ""))
    )
    return F.when(F.size(canonical) > 0, F.sha2(F.array_join(canonical, SEPARATOR), 256))


def route_tokens(line: Column) -> Column:
    """Route numbers readable in one line; none when any mark is unreadable."""
    text = F.upper(strip(line))
    unreadable = contains_any(text, fixed.UNREADABLE_MARKS)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.ROUTE_PATTERN), F.lit(0)))
    return F.when(unreadable, F.array().cast("array<string>")).otherwise(found)


def normalised_edit_distance(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    return F.levenshtein(a, b) / longest


def tokens(text: Column) -> Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    )


def clean_description(text: Column) -> Column:
    return F.substring(strip(F.regexp_replace(text, r"(?U)\s+", " ")), 1, 300)


def question_type(question: Column) -> Column:
    """First kind of question whose words occur, else ``general``."""
    chain = F
    for kind, words in fixed.QUESTION_WORDS:
        chain = chain.when(contains_any(question, words), kind)
    return chain.otherwise("general")


def image_reason(
    question: Column,
    visible_count: Column,
    scene_confidence: Column,
    has_informative: Column,
    *,
    confidence_threshold: float,
    enabled: bool = True,
) -> Column:
    """Why a question needs the image itself, null when the scene suffices."""
    if not enabled:
        return F.lit(None).cast("string")
    kind = question_type(question)
    return (
        F.when(visible_count == 0, "no_detections")
        .when(scene_confidence < confidence_threshold, "low_confidence")
        .when(contains_any(question, fixed.VISION_WORDS), "question_needs_vision")
        .when(contains_any(question, fixed.DETAIL_WORDS), "detail_requested")
        .when(kind.isin("can_i_go", "crossing"), "path_check")
        .when((kind == "describe") & ~has_informative, "sparse_scene")
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def scene_name(folder_parts: Column) -> Column:
    """Folder parts joined to a file-system-safe id."""
    return F.regexp_replace(F.array_join(folder_parts, "_"), r"[^\p{L}\p{N}_-]", "_")


def hash_split(key: Column, base_split: str = "train", val_fraction: float = 0.0) -> Column:
    """Deterministic split: a share of all keys goes to ``val``."""
    if val_fraction <= 0.0:
        return F.lit(base_split)
    bucket = F.pmod(F.crc32(F.encode(key, "utf-8")), F.lit(1000))
    return F.when(bucket < int(val_fraction * 1000), "val").otherwise(base_split)


def is_bus_approach_message(message: Column) -> Column:
    return (message == fixed.BUS_APPROACH_SENTENCE) | message.endswith(fixed.BUS_ARRIVAL_SUFFIX)


def subject_particle(label: Column) -> Column:
    """Label with the subject particle its last syllable calls for."""
    code = F.ascii(F.right(label, F.lit(1))) - 0xAC00
    closed = code.between(0, 0xD7A3 - 0xAC00) & (F.pmod(code, F.lit(28)) != 0)
    return F.concat(label, F.when(closed, "이").otherwise("가"))
