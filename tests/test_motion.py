import random

import naive
import pytest
from trackloom.operators.motion import best_token, route_confirmation, route_vote, vehicle_motion


def boxes(seed, frames=150):
    rng = random.Random(seed)
    out, frame, size, mode = [], 0, 60.0, 1.0
    for i in range(frames):
        frame += 1 if rng.random() < 0.93 else rng.choice([2, 3, 4, 6])
        if i % 20 == 0:
            mode = rng.choice([1.0, 1.03, 0.97, 1.05])
        size = min(300.0, max(20.0, size * mode))
        roll = rng.random()
        box = (100.0, 50.0, 100.0 + size, 50.0 + size)
        if roll < 0.01:
            box = (100.0, 50.0, 100.0, 80.0)
        out.append((frame, box, 0.1 if 0.01 < roll < 0.08 else 0.9))
    return out


def test_motion_matches_one_long_walk(spark):
    for seed, span in ((1, 65_536), (2, 300), (3, 280)):
        rows = boxes(seed, 400)
        df = spark.createDataFrame(
            [(1, "b", f, *box, c) for f, box, c in rows],
            "source_id long, stable_id string, frame_index long, x1 double, y1 double, "
            "x2 double, y2 double, confidence double",
        )
        got = sorted(
            (r.frame_index, r.motion, r.motion_confidence, r.previous_motion)
            for r in vehicle_motion(df, span=span).collect()
        )
        expected = naive.motion(rows)
        assert [g[:2] + g[3:] for g in got] == [e[:2] + e[3:] for e in expected]
        assert [g[2] for g in got] == pytest.approx([e[2] for e in expected])
        assert len({g[1] for g in got}) == 4


def test_route_vote_needs_a_clear_winner(spark):
    lines = spark.createDataFrame(
        [
            (1, "310 downtown", 0.9),
            (1, "31?0", 0.99),
            (2, "A12", 0.80),
            (2, "B7", 0.78),
            (3, "A12", 0.9),
            (3, "B7", 0.8),
            (4, "310", 0.7),
        ],
        "read int, text string, confidence double",
    )
    got = {r.read: r.route_number for r in route_vote(lines, ["read"]).collect()}
    assert got == {1: "310", 3: "A12"}
    same = spark.createDataFrame([(1, "b", 0.9), (1, "a", 0.9)], "read int, route string, confidence double")
    assert best_token(same, ["read"]).collect() == []
    assert best_token(same, ["read"], minimum_margin=0.0).collect()[0].route_number == "a"


def test_route_confirmation_counts_executed_reads(spark):
    rng = random.Random(5)
    reads = [
        (i * 7, rng.choice(["310", "310", "310", None, "A12"]), rng.random()) for i in range(60)
    ]
    df = spark.createDataFrame(
        [(1, "b", f, r, c) for f, r, c in reads],
        "source_id long, stable_id string, frame_index long, route string, confidence double",
    )
    for span in (5, 65_536):
        got = sorted(
            (r.frame_index, r.route, r.confirmed_confidence)
            for r in route_confirmation(df, span=span).collect()
            if r.route_confirmed
        )
        expected = naive.routes(reads, 3)
        assert [g[:2] for g in got] == [e[:2] for e in expected]
        assert [g[2] for g in got] == pytest.approx([e[2] for e in expected])
