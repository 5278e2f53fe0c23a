"""Many phrases searched in many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bytes of all distinct phrases up to which one automaton is built from them
PHRASE_BYTES = 32 << 20


def phrase_hits(texts: DataFrame, text: Column, phrases: list[str]) -> DataFrame:
    """Rows of ``texts`` with ``_hits``, the distinct phrases that occur anywhere in the text.

    All phrases are one automaton, built once per task, and a text is walked once whatever their number.
    Rows without a hit are left out.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    place = len(texts.columns)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase in phrases:
            automaton.add_word(phrase, phrase)
        automaton.make_automaton()
        for batch in batches:
            hits = [sorted({phrase for _, phrase in automaton.iter(x)}) if x else [] for x in batch.column(place).to_pylist()]
            columns = [*batch.columns[:place], pa.array(hits, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:place], "_hits"])
            yield out.filter(pa.array([bool(h) for h in hits]))

    return texts.select("*", text.alias("_text")).mapInArrow(walk, f"{kinds}, _hits array<string>")


def phrases_said(said: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, violations): in how many messages of its key each phrase of ``rules`` occurs, in any case.

    The distinct phrases of all keys are looked for together, and the rules of a key are compared with
    what was found, so the work grows with the messages, not with messages times rules. Phrases of
    more than ``PHRASE_BYTES`` in all stay where they are and meet the messages of their key. A job
    counts them while the plan is built.
    """
    wanted = rules.select(*keys, "rule", F.lower("rule").alias("_phrase")).filter("rule <> ''")
    distinct = wanted.select("_phrase").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("_phrase") + 64), F.lit(0)).alias("n")).first()["n"]
    messages = said.select(*keys, F.lower("message").alias("_said"))
    if not size:
        return wanted.select(*keys, "rule", F.lit(0).cast("long").alias("violations")).filter("false")
    if size > PHRASE_BYTES:
        met = messages.join(wanted, keys).filter(F.col("_said").contains(F.col("_phrase")))
        return met.groupBy(*keys, "rule").agg(F.count(F.lit(1)).alias("violations"))
    phrases = [r["_phrase"] for r in distinct.collect()]
    found = phrase_hits(messages, F.col("_said"), phrases)
    # counted per phrase before the rules come in; messages themselves are not shuffled
    counted = found.select(*keys, F.explode("_hits").alias("_phrase")).groupBy(*keys, "_phrase").agg(F.count(F.lit(1)).alias("_times"))
    return counted.join(wanted, [*keys, "_phrase"]).groupBy(*keys, "rule").agg(F.sum("_times").alias("violations"))
