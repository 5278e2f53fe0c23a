import tempfile
import time

from pyspark.sql import functions as F
from trackloom.operators.steps import Turns
from trackloom.streaming.late import late_fold, start_two_tables, two_tables

import naive

SCHEMA = "session_id int, seq long, is_speech boolean"


def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_late_rows_are_kept_and_idle_keys_leave_the_state(spark):
    source, table, checkpoint = scratch(), scratch() + "/t", scratch()
    step = Turns(silence_ms=100, prefix_ms=100, min_speech_ms=60, max_utterance_ms=1000)
    values = ([True] * 20 + [False] * 10) * 10

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source).withColumn("frames", F.lit(1))
        folded = late_fold(stream, ["session_id"], ["seq"], step, delay=50, idle_ms=4_000, remember_ms=3_600_000)
        query = start_two_tables(folded, table, checkpoint)
        assert query.awaitTermination(120)

    def state(name):
        store = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        return store.selectExpr("key.session_id as k").distinct()

    both = [(s, i, v) for s in (1, 2) for i, v in enumerate(values)]
    # out of order within the delay, and two rows of session 1 held back
    first = [r for r in both if r[1] < 200 and (r[0], r[1]) not in ((1, 7), (1, 190))]
    arrive(first[::-1])
    assert {r.k for r in state("saved").collect()} == {1, 2}
    # row 190 is within the delay, row 7 is far behind what session 1 was handed; session 3 is new
    arrive([(1, 7, True), (1, 190, values[190]), (3, 5, True)] + [r for r in both if r[0] == 1 and r[1] >= 200])
    results, late = two_tables(spark, table, ["session_id"])
    assert [tuple(r) for r in late.collect()] == [(1, 7, 1, True)]
    # a later batch finds session 1, 2 and 3 idle: what waits is handed over and their state is gone
    time.sleep(5)
    arrive([(4, 0, False)])
    assert {r.k for r in state("saved").collect()} == {4}
    assert {r.k for r in state("bound").collect()} == {1, 2, 3, 4}
    got = {}
    for r in two_tables(spark, table, ["session_id"])[0].filter("kind = 'turn'").collect():
        got.setdefault(r.session_id, []).append((r.first_seq, r.seq, r.speech_ms))
    whole = [v for i, v in enumerate(values) if i != 7]
    for session, flags, shift in ((1, whole, 1), (2, values[:200], 0)):
        want = [(a, b, ms) for a, b, ms, *_ in naive.turns(flags, 100, 100, 60, 1000)]
        # numbers after the row that came too late are one higher in the stream
        moved = [(a + shift if a >= 7 else a, b + shift if b >= 7 else b, ms) for a, b, ms in want]
        assert sorted(got[session]) == moved
    # the bound outlives the state: a straggler of a closed session is late, a newer row opens it again
    arrive([(2, 150, True), (2, 900, True)])
    late = sorted(tuple(r) for r in two_tables(spark, table, ["session_id"])[1].collect())
    assert late == [(1, 7, 1, True), (2, 150, 1, True)]
    assert {r.k for r in state("saved").collect()} >= {2}
