import random

import pytest

from trackloom.operators import phrases
from trackloom.operators.scoring import ascii_boundaries, forbidden_narrations


@pytest.mark.parametrize("limit", [phrases.PHRASE_BYTES, 1])
def test_phrases_are_counted_per_key_and_message(spark, monkeypatch, limit):
    """One automaton over all keys, or the messages of each key where phrases are too many, as a plain search says."""
    monkeypatch.setattr(phrases, "PHRASE_BYTES", limit)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abAB .(") for _ in range(n))
    said = [(rng.randint(0, 3), text(rng.randint(0, 12))) for _ in range(200)] + [(1, None)]
    rules = sorted({(rng.randint(0, 4), text(rng.randint(0, 3))) for _ in range(60)})
    got = forbidden_narrations(
        spark.createDataFrame(said, "source_id int, message string"),
        spark.createDataFrame([(s, "phrase", r) for s, r in rules] + [(0, "pattern", "a+b"), (0, "pattern", "(")], "source_id int, kind string, rule string"),
    )
    want = {}
    for s, rule in rules:
        n = sum(rule.lower() in (m or "").lower() for k, m in said if k == s and m is not None)
        if rule and n:
            want[s, "phrase", rule] = n
    import re

    for pattern, rule in (("a+b", "a+b"), (re.escape("("), "(")):
        n = sum(bool(re.search(pattern, m, re.I)) for k, m in said if k == 0 and m is not None)
        if n:
            want[0, "pattern", rule] = n
    assert {(r.source_id, r.kind, r.rule): r.violations for r in got.collect()} == want


def test_no_rules_find_nothing(spark):
    said = spark.createDataFrame([(1, "a")], "source_id int, message string")
    none = spark.createDataFrame([], "source_id int, kind string, rule string")
    assert forbidden_narrations(said, none).collect() == []


def test_pattern_boundaries_of_ascii_words(spark):
    texts = ["que les\u00e8le", "\u00e9les a", "Les, a", "le\u017f a", "tables", "les"]
    said = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "source_id int, message string")
    rules = spark.createDataFrame([(i, "pattern", p) for i in range(len(texts)) for p in (r"\b(the|les)\b", r"\Bles\b", r"[\\b]les")], "source_id int, kind string, rule string")

    def found(**options):
        return {(r.source_id, r.rule) for r in forbidden_narrations(said, rules, **options).collect()}

    plain = {(2, r"\b(the|les)\b"), (5, r"\b(the|les)\b"), (4, r"\Bles\b"), (4, r"[\\b]les")}
    assert found(ascii_words=True) == plain | {(0, r"\b(the|les)\b"), (1, r"\b(the|les)\b")}
    assert ascii_boundaries(r"\\b[\]\b]\d") == r"\\b[\]\b]\d"
