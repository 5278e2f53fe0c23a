"""The whole pipeline on hand-made rows: departures, ties, gaps."""

from trackloom.plans.pipeline import Settings, dense_frames, run_pipeline

SCHEMA = (
    "source_id long, frame_index long, timestamp_s double, det_index long, class_id long, class_name string, "
    "confidence double, x1 double, y1 double, x2 double, y2 double, track_id long, state string, evidence double"
)


def row(source, frame, det, name, x, track, seconds=0.1):
    return (source, frame, frame * seconds, det, 80, name, 0.9, x, 10.0, x + 30, 60.0, track, None, None)


def test_an_object_leaves_in_a_frame_without_detections(spark):
    rows = [row(1, f, 0, "person", 10.0, 1) for f in range(5)] + [row(1, f, 0, "car", 300.0, 2) for f in range(20, 26)]
    det = spark.createDataFrame(rows, SCHEMA)
    settings = Settings(minimum_seen=3, maximum_missed=8)
    listed = spark.createDataFrame([(1, f, f * 0.1) for f in range(26)], "source_id long, frame_index long, timestamp_s double")
    for frames in (None, listed):
        events = run_pipeline(det, settings, frames).events.collect()
        left = [(e.frame_index, e.object_type) for e in events if e.event_type == "OBJECT_DISAPPEARED"]
        assert left == [(12, "person")]
        assert all(e.now_s is not None and e.source_id == 1 and e.epoch == 1 for e in events)


def test_simultaneous_events_keep_the_order_of_their_detections(spark):
    names = ["person", "car", "dog", "chair"]
    rows = [row(1, f, i, n, 10.0 + 140 * i, i) for f in range(4) for i, n in enumerate(names)]
    events = run_pipeline(spark.createDataFrame(rows, SCHEMA), Settings(minimum_seen=3)).events.collect()
    came = sorted((e.seq, e.object_type) for e in events if e.event_type == "OBJECT_APPEARED")
    assert [n for _, n in came] == names


def test_a_long_gap_starts_a_new_epoch(spark):
    rows = [row(1, f, 0, "person", 10.0, 1) for f in (*range(5), *range(60, 65))]
    frames = [(1, r[1], r[2]) for r in rows]
    listed = spark.createDataFrame(frames, "source_id long, frame_index long, timestamp_s double")
    out = run_pipeline(spark.createDataFrame(rows, SCHEMA), Settings(minimum_seen=3), listed)
    came = sorted((e.epoch, e.frame_index) for e in out.events.collect() if e.event_type == "OBJECT_APPEARED")
    assert came == [(1, 2), (2, 62)]
    assert {d.stable_id for d in out.detections.collect()} == {"stable-1"}


def test_frames_between_detections_are_even_in_time(spark):
    det = spark.createDataFrame([row(1, 0, 0, "car", 1.0, 1), row(1, 4, 0, "car", 1.0, 1, 0.2), row(1, 5, 0, "car", 1.0, 1)], SCHEMA)
    got = sorted((r.frame_index, round(r.timestamp_s, 3)) for r in dense_frames(det).collect())
    assert got == [(0, 0.0), (1, 0.2), (2, 0.4), (3, 0.6), (4, 0.8), (5, 0.5)]
