import json
import tempfile

from trackloom.sources import live
from trackloom.streaming.late import stream_settings


def start(**changes):
    return json.dumps({"type": "start", "session_id": " s1 ", "source_width": 640, "source_height": 480, "source_fps": 30.0} | changes)


def frame(number, **changes):
    body = {"type": "frame", "sequence_id": number, "captured_at_ms": None, "byte_count": 10, "width": 640, "height": 480, "payload": f"p{number}"} | changes
    return json.dumps({k: v for k, v in body.items() if v != "absent"})


SEGMENTS = [
    [("a", start()), ("a", frame(0)), ("b", frame(0)), ("c", start(source_width=0)), ("d", "no json")],
    [("a", frame(1, captured_at_ms=5.5)), ("b", start()), ("c", frame(0)), ("e", start(session_id=7)), ("f", start(source_width=640.5))],
    [],
    [("a", frame(-1)), ("a", frame(2, captured_at_ms="absent")), ("a", frame(3, captured_at_ms="soon")), ("a", frame(4.5)), ("a", frame(5, byte_count=9_000_000)),
     ("a", start()), ("a", frame(6, captured_at_ms=True)), ("g", start(source_fps="fast")), ("a", frame(7)), (None, start()), (None, frame(1))],
]
WANT = [
    ("a", "s1", 0, None), ("a", "s1", 1, None), ("a", "s1", 7, None), (None, "s1", 1, None),
    ("b", None, None, "NOT_A_START_MESSAGE"), ("b", None, None, "CONNECTION_CLOSED"), ("c", None, None, "INVALID_SOURCE_WIDTH"),
    ("c", None, None, "CONNECTION_CLOSED"), ("d", None, None, "NOT_A_START_MESSAGE"), ("e", None, None, "MISSING_SESSION_ID"),
    ("f", None, None, "INVALID_SOURCE_WIDTH"), ("g", None, None, "INVALID_SOURCE_FPS"),
    ("a", "s1", None, "INVALID_SEQUENCE_ID"), ("a", "s1", None, "INVALID_SEQUENCE_ID"), ("a", "s1", None, "FRAME_TOO_LARGE"),
    *[("a", "s1", None, "INVALID_CAPTURE_TIME")] * 3, ("a", "s1", None, "NOT_A_FRAME"),
]


def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_restarts_give_each_message_once(spark):
    log, out, checkpoint = scratch(), scratch() + "/out", scratch()
    for number, rows in enumerate(SEGMENTS):
        live.append_segment(spark.createDataFrame(rows, "connection string, message string").coalesce(2), log, number)
        if number % 2:  # two segments at a time; each stream starts where the last one ended
            with stream_settings(spark):
                query = (
                    live.stream_frames(spark, log)
                    .writeStream.format("parquet")
                    .option("path", out)
                    .option("checkpointLocation", checkpoint)
                    .trigger(availableNow=True)
                    .start()
                )
            assert query.awaitTermination(200)
    got = spark.read.parquet(out)
    rows = [(r.connection, r.session_id and r.session_id.strip(), r.sequence_id, r.fault) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(WANT, key=repr)
    batch = live.read_frames_of_log(spark, log)
    assert batch.columns == got.columns
    assert sorted(map(tuple, batch.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)


def test_only_complete_segments_are_read(tmp_path):
    for n in (0, 1, 2, 3, 4, 6):
        (tmp_path / live._segment(n)).mkdir()
        (tmp_path / live._segment(n) / "part-0").write_text('{"connection": "a", "message": "x"}\n\n[1]\nbroken')
        assert live._complete_segments(str(tmp_path)) == min(n, 5)
        (tmp_path / live._segment(n) / "_SUCCESS").write_text("")
    assert live._complete_segments(str(tmp_path)) == 5
    parts = live._parts(str(tmp_path), 3, 5)
    assert [(p.segment, p.file) for p in parts] == [(3, "part-0"), (4, "part-0")]
    rows = [r for batch in live._lines(str(tmp_path), parts[0]) for r in batch.to_pylist()]
    assert [(r["line"], r["connection"], r["message"]) for r in rows] == [(0, "a", "x"), (2, None, "[1]"), (3, None, "broken")]


