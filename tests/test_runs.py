import random

import naive
from trackloom.operators import runs as R
from trackloom.operators.fold import throttle


def series(seed, keys=3, length=60, states=("RED", "GREEN", "UNKNOWN")):
    rng = random.Random(seed)
    rows = {}
    for key in range(keys):
        frame, state, out = 0, rng.choice(states), []
        while len(out) < length:
            frame += 1 if rng.random() < 0.85 else rng.randint(2, 12)
            if rng.random() < 0.35:
                state = rng.choice(states)
            out.append((frame, state))
        rows[key] = out
    return rows


def frame_of(spark, rows):
    flat = [(1, f"t{k}", f, s) for k, out in rows.items() for f, s in out]
    random.Random(1).shuffle(flat)
    return spark.createDataFrame(
        flat, "source_id long, stable_id string, frame_index long, state string"
    )


def test_debounce_and_transitions_match_a_state_machine(spark):
    for seed, n, span in ((1, 3, 8), (2, 2, 5), (3, 1, 7), (4, 3, 65_536)):
        rows = series(seed)
        df = frame_of(spark, rows)
        got = {}
        for r in R.debounce(df, minimum_frames=n, span=span).collect():
            got.setdefault(r.stable_id, []).append(
                (r.frame_index, r.confirmed_state, r.is_uncertain)
            )
        changes = {}
        for r in R.state_transitions(df, minimum_frames=n, span=span).collect():
            changes.setdefault(r.stable_id, []).append(
                (r.frame_index, r.previous_state, r.current_state)
            )
        for key, out in rows.items():
            expected, moved = naive.debounce(out, n)
            assert sorted(got[f"t{key}"]) == expected
            assert sorted(changes.get(f"t{key}", [])) == moved


def test_presence_matches_a_state_machine(spark):
    for seed, minimum, maximum, span in ((1, 3, 8, 10), (2, 2, 3, 4), (3, 1, 2, 65_536)):
        rows = series(seed, length=50)
        df = frame_of(spark, rows)
        last = max(f for out in rows.values() for f, _ in out)
        clock = spark.range(0, last + 1).selectExpr("1L as source_id", "id as frame_index")
        got = {}
        for r in R.presence(
            df, clock, minimum_seen=minimum, maximum_missed=maximum, span=span
        ).collect():
            got.setdefault(r.stable_id, []).append((r.event_type, r.frame_index))
        for key, out in rows.items():
            seen = {f for f, _ in out}
            expected = naive.presence(seen, 0, last, minimum, maximum)
            assert sorted(got.get(f"t{key}", []), key=lambda e: e[1]) == expected


def test_small_spans_do_not_change_results(spark):
    rows = series(7, length=80)
    df = frame_of(spark, rows)
    for fn in (
        lambda s: R.runs(df, "state", span=s),
        lambda s: R.changed_values(df, "state", span=s),
        lambda s: R.enter_state(df, "GREEN", span=s),
        lambda s: R.state_changes(df, span=s),
        lambda s: R.duplicate_transitions(
            df.selectExpr("*", "0 as seq", "state as current_state"), span=s
        ),
        lambda s: R.cadence_due(df, 3, span=s),
        lambda s: R.row_numbers(df, ["stable_id"], ["frame_index"], span=s),
        lambda s: R.processing_fps(
            df.selectExpr("*", "frame_index * 0.5D as completed_s"),
            keys=["stable_id"],
            order=["completed_s"],
            rows=4,
            span=s,
        ),
        lambda s: R.gap_epochs(
            df.selectExpr("*", "frame_index * 0.5D as timestamp_s"),
            keys=["stable_id"],
            maximum_gap=2.0,
            span=s,
        ),
    ):
        small = sorted(map(tuple, fn(6).collect()), key=repr)
        large = sorted(map(tuple, fn(65_536).collect()), key=repr)
        assert small == large and small


def test_throttle_on_regular_and_irregular_clocks(spark):
    rng = random.Random(3)
    regular = list(range(0, 400))
    irregular = sorted(rng.sample(range(2000), 300))
    bursts = [b * 50 + i for b in range(20) for i in range(5)]
    flat = [(k, t) for k, ts in enumerate((regular, irregular, bursts)) for t in ts]
    df = spark.createDataFrame(flat, "key int, t long")
    for interval, span in ((7, 16), (10, 33), (3, 8), (60, 16)):
        got = {}
        for r in throttle(df, ["key"], ["t"], interval, span=span).collect():
            got.setdefault(r.key, []).append(r.t)
        for k, ts in enumerate((regular, irregular, bursts)):
            assert sorted(got[k]) == naive.throttle(ts, interval), (k, interval, span)


def test_flags_of_turns_are_read_once(spark, tmp_path):
    from trackloom.operators.turns import endpoint_turns

    read = tmp_path / "read"

    def watched(batches):
        with open(read, "a") as log:
            log.write(".")
        yield from batches

    flags = spark.range(0, 4000, 1, 1).selectExpr("1 as session_id", "id as seq", "id % 200 < 100 as is_speech")
    turns = endpoint_turns(flags.mapInPandas(watched, flags.schema), span=500)
    assert turns.filter("kind = 'turn'").count() == 20
    assert len(read.read_text()) == 1
