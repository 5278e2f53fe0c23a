import random

import naive
from pyspark.sql import functions as F
from trackloom.operators.narration import narrate_batches, narration_queue
from trackloom.operators.screens import confirm_reads, text_confirmation
from trackloom.operators.turns import barge_in, endpoint_turns


def test_turns_match_one_long_walk(spark):
    for seed, span in ((1, 37), (2, 60_000)):
        rng = random.Random(seed)
        flags, mode = [], False
        for _ in range(1500):
            if rng.random() < 0.06:
                mode = not mode
            flags.append(mode if rng.random() < 0.9 else not mode)
        df = spark.createDataFrame(
            [(1, i, f) for i, f in enumerate(flags)], "session_id int, seq long, is_speech boolean"
        )
        got = endpoint_turns(
            df, silence_ms=100, prefix_ms=100, min_speech_ms=120, max_utterance_ms=1000, span=span
        )
        mine = sorted(
            (r.first_seq, r.seq, r.speech_ms, r.forced, r.discarded)
            for r in got.filter("kind = 'turn'").collect()
        )
        assert mine == sorted(naive.turns(flags, 100, 100, 120, 1000)) and mine


def test_speculation_is_reported_only_for_the_pause_that_ends_the_turn(spark):
    flags = [True] * 20 + [False] * 6 + [True] * 5 + [False] * 20
    df = spark.createDataFrame(
        [(1, i, f) for i, f in enumerate(flags)], "session_id int, seq long, is_speech boolean"
    )
    rows = endpoint_turns(df, silence_ms=200, speculative_ms=100).collect()
    points = [r.seq for r in rows if r.kind == "speculation"]
    turn = [r for r in rows if r.kind == "turn"][0]
    assert points == [24, 35] and turn.speculative_seq == 35 and not turn.discarded


def candidates(seed, ticks=120):
    rng = random.Random(seed)
    rows, seq, plan = [], 0, []
    for t in range(ticks):
        now, batch = t * 0.5, []
        for _ in range(rng.choice([0, 0, 1, 3])):
            key = f"k{rng.randint(0, 12)}"
            item = (seq, f"m{key}", rng.randint(0, 7), key, rng.choice([1.5, 5.0, 0.0]))
            batch.append(item)
            rows.append((1, now, *item))
            seq += 1
        plan.append((now, batch))
    return rows, plan


def test_queue_matches_one_long_walk(spark):
    for seed, span in ((1, 4.0), (2, 3600.0)):
        rows, plan = candidates(seed)
        df = spark.createDataFrame(
            rows,
            "source_id int, now_s double, seq long, message string, priority int, "
            "dedup_key string, ttl double",
        ).withColumn(
            "event_type",
            F.when(F.col("ttl") == 1.5, "short").when(F.col("ttl") == 0, "none").otherwise("long"),
        )
        ticks = spark.createDataFrame([(1, now) for now, _ in plan], "source_id int, now_s double")
        got = narration_queue(
            df,
            ticks,
            capacity=3,
            cooldown_s=5.0,
            ttl_by_event_type={"short": 1.5, "none": 0.0},
            span=span,
        )
        mine = sorted((r.now_s, r.seq) for r in got.collect())
        assert mine == naive.queue(plan, 3, 5.0) and mine


def test_batches_skip_recent_repeats(spark):
    rows = [(1, float(t), t, "a" if t % 3 else "b", 5 if t % 3 else 1, "a" if t % 3 else "b") for t in range(20)]
    df = spark.createDataFrame(
        rows,
        "source_id int, timestamp_s double, seq long, message string, priority int, dedup_key string",
    )
    for span in (4.0, 3600.0):
        got = sorted((r.timestamp_s, r.message) for r in narrate_batches(df, span=span).collect())
        assert got == [
            (0.0, "b"), (1.0, "a"), (6.0, "b"), (7.0, "a"), (12.0, "b"), (13.0, "a"), (18.0, "b"),
            (19.0, "a"),
        ]


def test_confirmed_reads_and_texts(spark):
    rng = random.Random(9)
    reads = [(i, rng.choice(["x", "x", "y", None])) for i in range(120)]
    df = spark.createDataFrame(
        [(1, "s", i, v) for i, v in reads],
        "source_id int, stable_id string, frame_index long, value string",
    )
    expected, moves = naive.debounce([(i, v or "UNKNOWN") for i, v in reads], 3)
    for span in (7, 65_536):
        got = confirm_reads(df, "value", span=span).collect()
        assert sorted((r.frame_index, r.previous, r.confirmed) for r in got if r.changed) == moves
        certain = sorted((r.frame_index, r.confirmed) for r in got if r.confirmed is not None)
        assert certain == [(f, s) for f, s, unsure in expected if not unsure]

    lines = [
        (0, True, "Exit  A", 0.7), (1, True, "exit a", 0.9), (2, False, None, None),
        (3, True, "EXIT A", 0.8), (4, True, "exit A", 0.8), (5, True, "Gate 1", 0.9),
        (6, True, "Gate 1", 0.9), (7, True, "Gate 1", 0.6), (9, True, "Gate 2", 0.9),
    ]
    df = spark.createDataFrame(
        [(1, "s", *x) for x in lines],
        "source_id int, stable_id string, frame_index long, due boolean, text string, confidence double",
    )
    for span in (2, 65_536):
        got = {r.frame_index: r for r in text_confirmation(df, span=span).collect()}
        assert 2 not in got and not got[1].confirmed and got[3].confirmed
        assert got[3].confirmed_text == "exit a" and got[4].candidate_frames == 4
        assert got[7].text_changed and got[7].previous_text == "exit a"
        assert abs(got[7].confirmed_confidence - 0.8) < 1e-9 and not got[9].confirmed


def test_barge_in_finds_echoes(spark):
    turns = spark.createDataFrame(
        [
            (1, 1, 50, False, "the bus is coming now"),
            (1, 2, 150, False, "where is the door please"),
            (1, 3, 300, False, "the bus is coming"),
            (1, 4, 420, True, ""),
        ],
        "session_id int, turn_no int, onset_seq long, discarded boolean, transcript string",
    )
    replies = spark.createDataFrame(
        [(1, 20, 100, "The bus is coming."), (1, 120, 200, "A bus is coming."), (1, 400, 500, "x")],
        "session_id int, start_seq long, done_seq long, text string",
    )
    got = {r.turn_no: (r.interrupts, r.is_echo) for r in barge_in(turns, replies).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (True, False)}
