"""Utterances from voice-activity flags, interruptions and echoes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.text import tokens
from trackloom.operators.fold import fold
from trackloom.operators.keyed import carry_last
from trackloom.operators.steps import Turns
from trackloom.session import cut

#: flags per chunk of the turn fold (20 ms each: about twenty minutes)
TURN_SPAN = 60_000


def endpoint_turns(
    flags: DataFrame,
    *,
    keys: Sequence[str] = ("session_id",),
    silence_ms: int = 700,
    prefix_ms: int = 300,
    min_speech_ms: int = 250,
    max_utterance_ms: int = 30_000,
    speculative_ms: int = 0,
    span: int = TURN_SPAN,
) -> DataFrame:
    """Onsets, speculation points and ends of turns.

    ``flags`` holds one row per 20 ms frame: seq and is_speech. A ``turn`` row
    that is ``discarded`` held too little speech; ``speculative_seq`` is the
    early point whose pause ran through to the end of the turn.
    """
    step = Turns(silence_ms, prefix_ms, min_speech_ms, max_utterance_ms, speculative_ms)
    # every round of the fold reads the runs, which are far fewer than the flags
    return fold(cut(runs_of_flags(flags, keys, span=span)), keys, ["seq"], step, span=span)


def runs_of_flags(flags: DataFrame, keys: Sequence[str], *, span: int = TURN_SPAN) -> DataFrame:
    """Runs of consecutive frames with one flag: seq of the first one, frames and is_speech.

    Runs end at chunk borders, so a key is spread over its chunks; a missing flag is silence.
    """
    keys = list(keys)
    rows = flags.select(*keys, "seq", F.coalesce("is_speech", F.lit(False)).alias("is_speech"), F.floor(F.col("seq") / span).alias("_chunk"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("seq")
    same = (F.lag("is_speech").over(inside) == F.col("is_speech")) & (F.lag("seq").over(inside) == F.col("seq") - 1)
    marked = rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("_run", F.sum("_new").over(inside))
    # the window's partitioning serves the grouping too
    return (
        numbered.groupBy(*keys, "_chunk", "_run")
        .agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("frames"), F.first("is_speech").alias("is_speech"))
        .drop("_chunk", "_run")
    )


def speculative_points(turn_rows: DataFrame) -> DataFrame:
    return turn_rows.filter("kind = 'speculation'")


def echo_overlap(transcript: Column, reply: Column, minimum_tokens: int = 3) -> Column:
    """Share of the distinct transcript words found in the reply; 0 when too short."""
    said, heard = tokens(transcript), tokens(reply)
    return F.when(
        (F.size(said) >= minimum_tokens) & (F.size(heard) > 0),
        F.size(F.array_intersect(said, heard)) / F.size(said),
    ).otherwise(0.0)


def barge_in(
    turns: DataFrame,
    replies: DataFrame,
    *,
    keys: Sequence[str] = ("session_id",),
    threshold: float = 0.6,
    span: int = TURN_SPAN,
) -> DataFrame:
    """Turns whose onset fell into a playing reply, and whether they are its echo.

    ``turns``: turn_no, onset_seq, discarded, transcript. ``replies``: start_seq,
    done_seq, text. The reply in play is the last one started at or before the
    onset; a discarded turn re-opens the microphone and is no echo.
    """
    keys = list(keys)
    spoken = replies.select(
        *keys,
        F.col("start_seq").alias("_at"),
        F.lit(0).alias("_kind"),
        F.struct("start_seq", "done_seq", "text").alias("_reply"),
    )
    asked = turns.select(
        *keys, F.col("onset_seq").alias("_at"), F.lit(1).alias("_kind"), F.struct(*[c for c in turns.columns if c not in keys]).alias("_turn")
    )
    both = spoken.unionByName(asked, allowMissingColumns=True)
    last = carry_last(both, keys, ["_at", "_kind"], {"reply": F.col("_reply")}, span=span)
    playing = F.coalesce(F.col("reply.done_seq") > F.col("_at"), F.lit(False))
    overlap = echo_overlap(F.col("_turn.transcript"), F.col("reply.text"))
    return last.filter("_kind = 1").select(
        *keys,
        "_turn.*",
        playing.alias("interrupts"),
        F.when(playing & ~F.col("_turn.discarded"), overlap).alias("overlap"),
        (playing & ~F.col("_turn.discarded") & (overlap >= threshold)).alias("is_echo"),
    )


def previous_reply(
    talk: DataFrame, *, keys: Sequence[str] = ("conv_id",), order: str = "turn"
) -> DataFrame:
    """Each user turn with the last assistant text before it."""
    replies = F.when(F.col("role") == "assistant", F.col("text"))
    carried = carry_last(talk, keys, [order], {"reply": replies}, include_current=False)
    return carried.filter("role = 'user'")


