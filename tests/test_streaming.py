import tempfile

import naive
from pyspark.sql import functions as F
from trackloom.operators.steps import Turns
from trackloom.operators.turns import endpoint_turns
from trackloom.streaming.operators import distinct_stream, stream_fold


def flags(n=900):
    import random

    rng = random.Random(4)
    out, mode = [], False
    for _ in range(n):
        if rng.random() < 0.06:
            mode = not mode
        out.append(mode if rng.random() < 0.9 else not mode)
    return out


def test_a_stream_gives_the_batch_result(spark):
    values = flags()
    rows = [(s, i, v) for s in (1, 2) for i, v in enumerate(values)]
    schema = "session_id int, seq long, is_speech boolean"
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in range(3):
        # rows of a file are out of order within the allowed delay
        piece = [r for r in rows if part * 300 <= r[1] < (part + 1) * 300][::-1]
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(path)
    # a last row far ahead moves the clock past everything before it
    spark.createDataFrame([(1, 5000, False), (2, 5000, False)], schema).coalesce(1).write.mode(
        "append"
    ).parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("frames", F.lit(1))
    step = Turns(silence_ms=100, prefix_ms=100, min_speech_ms=120, max_utterance_ms=1000)
    folded = stream_fold(
        stream, ["session_id"], ["seq"], step, delay="400 seconds", delay_ticks=400
    )
    query = (
        folded.writeStream.format("memory")
        .queryName("turns")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .outputMode("append")
        .start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(
        (r.session_id, r.first_seq, r.seq, r.speech_ms)
        for r in spark.table("turns").filter("kind = 'turn'").collect()
    )
    expected = naive.turns(values, 100, 100, 120, 1000)
    assert got == sorted((s, a, b, ms) for s in (1, 2) for a, b, ms, _, _ in expected)
    batch = endpoint_turns(
        spark.createDataFrame(rows, schema),
        silence_ms=100,
        prefix_ms=100,
        min_speech_ms=120,
        max_utterance_ms=1000,
    )
    assert batch.filter("kind = 'turn'").count() == len(got)


def test_repeated_events_pass_once(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [("a", 1), ("a", 1), ("b", 2), ("a", 3)]
    spark.createDataFrame(rows, "kind string, s long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("kind string, s long").parquet(path)
    once = distinct_stream(
        stream.withColumn("at", F.timestamp_seconds("s")), ["kind"], clock="at", delay="1 hour"
    )
    query = once.writeStream.format("memory").queryName("once").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.kind for r in spark.table("once").collect()) == ["a", "b"]
