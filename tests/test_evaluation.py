import json
from dataclasses import replace

from pyspark.sql import functions as F

from trackloom.functions.classes import object_family
from trackloom.operators.scoring import match_within
from trackloom.plans import evaluation as EV
from workload import QUERIES
from workload.scenes import scored_run

SF = "/root/testdata/sf0.001"


def test_tables_of_a_run_are_made_once(spark):
    """However many metrics read a table, the user's own steps go through its rows once."""
    videos, run, truth = scored_run(spark, SF)
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    def seen(df):
        return df.mapInArrow(counted, df.schema)

    expected = run.analyses.count() + run.events.count() + run.detections.count()
    run = replace(run, analyses=seen(run.analyses), events=seen(run.events), detections=seen(run.detections))
    out = EV.evaluate(videos, run, truth, tolerance=3)
    assert out.count() == 38 * videos.count()
    assert rows.value == expected


def test_a_family_is_asked_for_with_one_token(spark):
    names = spark.createDataFrame([("Traffic  Light",), ("city bus",), ("Kiosk 2",), (" Dog ",), ("",), (None,)], "name string")
    family = object_family(F.col("name"))
    plan = names.filter(family == "signal")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert [r[0] for r in names.select(family).collect()] == ["signal", "bus", "kiosk", "dog", "", None]


def test_many_keys_are_handed_over_together(spark):
    """Chunks of keys share a call, null and NaN keys too, and are settled apart."""
    keys = [float("nan"), None, 0.0, *map(float, range(1, 200))]
    t = spark.createDataFrame([(k, "a", i, 10) for k in keys for i in range(2)], "k double, s string, truth_id int, truth_frame long")
    p = spark.createDataFrame([(k, "a", 7, 11) for k in keys] + [(k, "b", 8, 10) for k in keys], "k double, s string, predicted_id int, predicted_frame long")
    out = match_within(t, p, tolerance=2, keys=["k", "s"])
    got = [(repr(r.k), r.s, r.truth_id, r.predicted_id, r.distance) for r in out.collect()]
    assert sorted(got) == sorted((repr(k), "a", 0, 7, 1) for k in keys)


def test_signal_accuracy_needs_no_matching(spark, monkeypatch):
    def refuse(*args, **named):
        raise AssertionError("transitions are matched for the accuracy of frames")

    monkeypatch.setattr(EV.K, "match_within", refuse)
    assert QUERIES["k_signal_accuracy"](spark, SF).count() > 0


def test_tables_of_frames_are_not_broadcast(spark):
    """Files of a written table are a small part of what its rows take in memory."""
    _, run, truth = scored_run(spark, SF)
    labels = EV.R.labels_by_frame(truth.states).withColumnRenamed("state", "expected")
    judged = EV._judge(labels, EV.K.best_state_by_frame(run.analyses, "bus"))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def _details(videos, run, truth, tolerance):
    rows = EV.signal_transition_metrics(videos, run, truth, tolerance).collect()
    return {r.source_id: (r.transition_delay_details, r) for r in rows}


def test_matched_transitions_are_listed(spark):
    """Each with its frames, delay and states, nearest pairs first; a reason where there is none."""
    videos = spark.createDataFrame([(1, 25.0), (2, None), (3, 25.0), (4, 25.0), (5, 0.0)], "source_id long, fps double")
    signals = [(s, 0, "traffic light") for s in range(1, 6)] + [(4, 1, "signal")]
    changes = [
        *[(1, 0, 0, 10, "red", "green", False), (1, 0, 1, 20, "GREEN", "RED", None), (1, 0, 2, 30, "RED", None, False)],
        *[(1, 0, 3, 50, "RED", "GREEN", True), (1, 0, 4, None, "RED", "GREEN", False)],
        *[(2, 0, 0, 10, "RED", "GREEN", False), (2, 0, 1, 10, "RED", "GREEN", False)],
        *[(3, 0, 0, 10, "RED", "GREEN", False), (4, 0, 0, 10, "RED", "GREEN", False), (5, 0, 0, 10, "RED", "GREEN", False)],
    ]
    told = [
        *[(1, 13, 0, "RED", " Green"), (1, 19, 0, "green", "red"), (1, 30, 0, "RED", ""), (1, 50, 0, "RED", "GREEN")],
        *[(2, 12, 1, "RED", "GREEN"), (2, 12, 0, "RED", "GREEN"), (3, 14, 0, "RED", "GREEN")],
        *[(4, 10, 0, "RED", "GREEN"), (5, 9, 0, "RED", "GREEN")],
    ]
    events = spark.createDataFrame(told, "source_id long, frame_index long, pos int, previous_state string, current_state string")
    run = EV.Run(
        frames=None,
        detections=None,
        analyses=spark.createDataFrame([], "source_id long, frame_index long, signal_type string, signal_type_is_uncertain boolean"),
        events=events.withColumns({"event_type": F.lit("object_state_changed"), "object_type": F.lit("Signal"), "stable_id": F.lit("a")}),
        narrations=spark.createDataFrame([], "source_id long, frame_index long, pos int, message string"),
    )
    truth = EV.Truth(
        objects=spark.createDataFrame(signals, "source_id long, object_pos int, object_type string"),
        visible=spark.createDataFrame([(s, o, 0, 99) for s, o, _ in signals], "source_id long, object_pos int, start_frame long, end_frame long"),
        transitions=spark.createDataFrame(
            changes, "source_id long, object_pos int, transition_pos int, frame long, from_state string, to_state string, ambiguous boolean"
        ),
        **dict.fromkeys(("states", "motions", "stages", "texts")),
    )

    def pair(expected, predicted, ms, previous="RED", current="GREEN"):
        frames = {"ground_truth_frame": expected, "predicted_frame": predicted, "delay_frames": predicted - expected}
        return {**frames, "delay_ms": ms, "previous_state": previous, "current_state": current}

    got = _details(videos, run, truth, 3)
    listed = {s: json.loads(d.value_json) for s, (d, _) in got.items() if d.value_json}
    assert listed == {
        1: [pair(30, 30, 0.0, "RED", "UNKNOWN"), pair(20, 19, -40.0, "GREEN", "RED"), pair(10, 13, 120.0)],
        2: [pair(10, 12, None), pair(10, 12, None)],
        5: [pair(10, 9, None)],
    }
    assert {s: d.reason for s, (d, _) in got.items() if d.reason} == {
        3: "no_matched_signal_transitions",
        4: "multiple_objects_require_prediction_association",
    }
    assert {s: (r.transition_delay_frames.value, r.transition_delay_ms.value) for s, (_, r) in got.items()} == {
        1: (0.666667, 26.666667),
        2: (2.0, None),
        3: (None, None),
        4: (None, None),
        5: (-1.0, None),
    }


def test_listed_transitions_are_those_taken_by_distance(spark):
    videos, run, truth = scored_run(spark, SF)
    signals = {(r.source_id, r.object_pos) for r in truth.objects.collect() if r.object_type in ("traffic light", "pedestrian signal")}
    expected, predicted = {}, {}
    for r in truth.transitions.orderBy("object_pos", "transition_pos").collect():
        if (r.source_id, r.object_pos) in signals and not r.ambiguous:
            expected.setdefault(r.source_id, []).append((r.frame, r.from_state, r.to_state))
    for r in run.events.orderBy("frame_index", "pos").collect():
        if r.event_type == "OBJECT_STATE_CHANGED" and r.object_type in ("traffic light", "pedestrian signal"):
            predicted.setdefault(r.source_id, []).append((r.frame_index, r.previous_state, r.current_state))
    want = {}
    for s, own in expected.items():
        near = [
            (abs(e[0] - p[0]), i, j) for i, e in enumerate(own) for j, p in enumerate(predicted.get(s, ())) if e[1:] == p[1:] and abs(e[0] - p[0]) <= 3
        ]
        used_e, used_p = set(), set()
        for _, i, j in sorted(near):
            if i not in used_e and j not in used_p:
                used_e.add(i)
                used_p.add(j)
                want.setdefault(s, []).append((own[i][0], predicted[s][j][0], *own[i][1:]))
    got = _details(videos, run, truth, 3)
    names = ("ground_truth_frame", "predicted_frame", "previous_state", "current_state")
    listed = {s: [tuple(d[n] for n in names) for d in json.loads(m.value_json)] for s, (m, _) in got.items() if m.value_json}
    assert listed and listed == {s: want[s] for s in want if "multiple" not in (got[s][0].reason or "")}
    assert all(got[s][0].value == len(own) for s, own in listed.items())


def test_messages_are_listed(spark):
    """All that are not blank, in their order; an empty list where nothing was said."""
    said = [(1, 10, 0, "c"), (1, 9, 1, 'b "q"'), (1, 9, 0, " a "), (1, 11, 0, " "), (1, 12, 0, "c"), (2, 0, 0, "")]
    run = EV.Run(
        frames=spark.createDataFrame([(1, 1.0)], "source_id long, inference_ms double"),
        detections=spark.createDataFrame([], "source_id long, frame_index long"),
        analyses=spark.createDataFrame([], "source_id long, is_uncertain boolean, state string, object_type string, analyzer_name string"),
        events=spark.createDataFrame(
            [],
            "source_id long, event_type string, object_type string, stable_id string, previous_state string,"
            " current_state string, route_number string, text string, screen_fingerprint string",
        ),
        narrations=spark.createDataFrame(said, "source_id long, frame_index long, pos int, message string"),
    )
    videos = spark.createDataFrame(
        [(s, None, None, None, None) for s in (1, 2, 3)],
        "source_id long, elapsed_s double, effective_fps double, realtime_factor double, average_inference_ms double",
    )
    got = {r.source_id: r.generated_narrations for r in EV.performance_metrics(videos, run).collect()}
    assert {s: (m.value, json.loads(m.value_json), m.reason) for s, m in got.items()} == {
        1: (4.0, [" a ", 'b "q"', "c", "c"], None),
        2: (0.0, [], None),
        3: (0.0, [], None),
    }
