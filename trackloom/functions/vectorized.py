"""The few text functions without a built-in, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.strings import strip


#: rows whose texts are Python strings at one time
TEXTS_AT_ONCE = 256


def in_parts(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """Texts changed one by one, a few at a time: a batch is held twice in Arrow's form and never whole in Python's."""
    parts = []
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        some = texts.slice(at, TEXTS_AT_ONCE).to_pylist()
        parts.append(pa.array([None if t is None else change(t) for t in some], texts.type))
    return pa.concat_arrays(parts) if parts else texts


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    return in_parts(text, lambda t: unicodedata.normalize("NFKC", t))


@F.arrow_udf(T.StringType())
def nfkc_casefold(text: pa.Array) -> pa.Array:
    return in_parts(text, lambda t: unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(T.DoubleType())
def similarity(first: pd.Series, second: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts."""
    return pd.Series(
        [
            None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
            for a, b in zip(first, second)
        ],
        dtype="float64",
    )


def display_text(text):
    """NFKC text with zero-width characters and runs of space as one space."""
    clean = F.translate(nfkc(text), "\u200b\ufeff", "  ")
    return strip(F.regexp_replace(clean, r"(?U)\s+", " "))


def search_text(text):
    folded = strip(F.regexp_replace(nfkc_casefold(text), r"(?U)[\s\u200b\ufeff]+", " "))
    return strip(F.regexp_replace(folded, "[^0-9a-z가-힣]+", " "))


def fingerprint(text):
    """Case-folded text with single spaces."""
    return strip(F.regexp_replace(nfkc_casefold(text), r"(?U)\s+", " "))


def scoring_text(text):
    """Letters and digits only, as compared when scoring read text."""
    return F.regexp_replace(nfkc_casefold(text), r"[^\p{L}\p{N}]", "")


def shared_characters(first, second):
    """How many characters two texts have in common, each as often as both have it."""
    def times(text, c):
        return F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))

    distinct = F.array_distinct(F.split(first, ""))
    return F.aggregate(distinct, F.lit(0), lambda n, c: n + F.least(times(first, c), times(second, c)))


def texts_match(first, second, threshold: float = 1.0):
    """Equal, or without any digit and similar enough.

    The ratio is at most twice the shared characters by the length of both texts, and at most what
    their lengths allow; only pairs that pass both bounds and have no digit are handed to Python.
    """
    if threshold >= 1.0:
        return first == second
    digits = F.concat(first, second).rlike(r"\d")
    a, b = F.char_length(first), F.char_length(second)
    near = ~digits & (first != second) & (2 * F.least(a, b) >= threshold * (a + b))
    near = F.when(near, 2 * shared_characters(first, second) >= threshold * (a + b)).otherwise(F.lit(False))
    ratio = similarity(F.when(near, first), F.when(near, second))
    return F.when(first.isNull() | second.isNull(), F.lit(None).cast("boolean")).otherwise(
        (first == second) | (near & F.coalesce(ratio >= threshold, F.lit(False)))
    )
