import random

import naive
from pyspark.sql import functions as F
from trackloom.operators.hazard import growth_features, hazard_events, time_to_contact
from trackloom.operators.tracks import assign_stable_ids, select_targets


def scene(seed, frames=60, objects=4):
    rng = random.Random(seed)
    rows = []
    places = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(objects)]
    for frame in range(frames):
        index = 0
        for o, (x, y) in enumerate(places):
            if rng.random() < 0.25 or (frame // 15) % 3 == o % 3:
                continue
            x, y = x + rng.randint(-6, 6), y + rng.randint(-6, 6)
            tag = rng.choice([None, None, o, o, o + 10, rng.randint(0, 3)])
            rows.append((frame, index, o % 2, "abc"[o % 2], (x, y, x + 20, y + 20), tag))
            index += 1
        if rng.random() < 0.05:
            places[rng.randrange(objects)] = (rng.randint(0, 60), rng.randint(0, 60))
    return rows


def test_identities_match_one_long_walk_for_every_span(spark):
    for seed, span in ((1, 7), (2, 13), (3, 5), (4, 20_000)):
        rows = scene(seed)
        frames = [[] for _ in range(60)]
        for frame, _, cid, cls, box, tag in rows:
            frames[frame].append(((cid, cls), tuple(map(float, box)), tag))
        expected = naive.identities(frames)
        df = spark.createDataFrame(
            [(s, f, i, c, n, 0.9, *map(float, b), t) for s in (1, 2) for f, i, c, n, b, t in rows],
            "source_id long, frame_index long, det_index long, class_id long, class_name string, "
            "confidence double, x1 double, y1 double, x2 double, y2 double, track_id long",
        )
        got = assign_stable_ids(df, span=span).collect()
        for source in (1, 2):
            mine = {(r.frame_index, r.det_index): r.stable_no for r in got if r.source_id == source}
            flat = {(f, i): n for f, ns in enumerate(expected) for i, n in enumerate(ns)}
            assert mine == flat, (seed, span)


def test_targets_keep_the_choice_of_the_last_frame_only(spark):
    def det(frame, index, confidence, box, track):
        return (1, frame, index, 9, "traffic light", confidence, *map(float, box), track)

    tall, part = (10, 10, 30, 50), (12, 12, 28, 28)
    rows = [
        det(0, 0, 0.9, tall, 1),
        det(0, 1, 0.8, (11, 10, 31, 50), 2),
        det(0, 2, 0.99, part, 3),
        det(0, 3, 0.5, (200, 10, 220, 50), 4),
        det(1, 0, 0.2, tall, 1),
        det(1, 1, 0.8, (11, 10, 31, 50), 2),
        det(3, 0, 0.2, tall, 1),
        det(3, 1, 0.8, (11, 10, 31, 50), 2),
    ]
    df = spark.createDataFrame(
        rows,
        "source_id long, frame_index long, det_index long, class_id long, class_name string, "
        "confidence double, x1 double, y1 double, x2 double, y2 double, track_id long",
    )
    for span in (1, 2, 100):
        got = sorted((r.frame_index, r.det_index) for r in select_targets(df, span=span).collect())
        assert got == [(0, 0), (0, 3), (1, 0), (3, 1)]


def approach_rows(seed, frames=140):
    rng = random.Random(seed)
    out, area, now = [], 0.01, 0.0
    for frame in range(frames):
        now += rng.choice([0.0, 0.1, 0.1, 0.2])
        if rng.random() < 0.03:
            area = 0.01
            continue
        area = min(0.6, area * rng.choice([1.0, 1.08, 1.2, 1.3])) if area < 0.6 else 0.01
        out.append((frame, now, 0.0 if rng.random() < 0.03 else area))
    return out


def test_hazards_match_one_long_walk(spark):
    for seed, span in ((1, 9), (2, 25), (3, 65_536)):
        rows = approach_rows(seed)
        step = naive.Thresholds()
        side = [(a * 640 * 480) ** 0.5 for _, _, a in rows]
        df = spark.createDataFrame(
            [
                (1, "t", f, t, "person", 0.9, 320 - s / 2, 10.0, 320 + s / 2, 10.0 + s)
                for (f, t, _), s in zip(rows, side)
            ],
            "source_id long, stable_id string, frame_index long, timestamp_s double, "
            "class_name string, confidence double, x1 double, y1 double, x2 double, y2 double",
        )
        got = sorted(
            (r.frame_index, r.level, r.emission_index)
            for r in hazard_events(df, frame_width=640, frame_height=480, span=span).collect()
        )
        areas = [((320 + s / 2) - (320 - s / 2)) * s / (640 * 480) for s in side]
        expected = naive.approach(
            [(f, t, a, 0.9, True, True) for (f, t, _), a in zip(rows, areas)], step
        )
        assert got == expected and got


def test_growth_windows_agree_with_the_walk_on_advancing_clocks(spark):
    rows = [(f, f * 0.1, 0.01 * 1.15 ** (f % 30)) for f in range(90) if f % 37]
    df = spark.createDataFrame(
        [(1, "t", f, t, a, 0.9, 300.0, 340.0, "person") for f, t, a in rows],
        "source_id long, stable_id string, frame_index long, timestamp_s double, "
        "area_ratio double, confidence double, x1 double, x2 double, class_name string",
    ).withColumn("width", F.lit(640.0))
    always = naive.Thresholds(repeat_s=0.0)
    expected = [f for f, _, _ in naive.approach([(f, t, a, 0.9, True, True) for f, t, a in rows], always)]
    for span in (8, 65_536):
        at_risk = time_to_contact(growth_features(df, span=span))
        assert sorted(r.frame_index for r in at_risk.collect()) == expected
