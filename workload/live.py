"""Queries: streams over messages and updates derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators.steps import Turns
from trackloom.session import scratch_path
from trackloom.sources import live as L
from trackloom.streaming import late as LA
from trackloom.streaming import snapshots as SN
from workload.analysis import view_updates
from workload.registry import ORACLES, query
from workload.views import events

#: Three arrivals: rows of one remainder come together.
ARRIVALS = 3


def finished(stream):
    stream.awaitTermination()
    return stream


@query(
    "a11_stream_frames",
    """
msg AS (SELECT u, event_id, k, event_id % 3 AS seg, k % 5 < 3 AS is_start, 600 * (k % 7) AS w,
   CASE WHEN k % 11 = 0 THEN 'absent' WHEN k % 4 = 0 THEN 'null' WHEN k % 13 = 0 THEN 'text' ELSE 'number' END AS tm FROM ev),
own AS (SELECT u, arg_min(struct_pack(s := is_start, w := w), seg * 1000000000000 + event_id) AS first, min(seg * 1000000000000 + event_id) AS first_at FROM msg GROUP BY u),
judged AS (
 SELECT m.u, m.event_id, m.k, m.tm, o.first, seg * 1000000000000 + event_id = first_at AS is_first,
   CASE WHEN NOT is_start THEN 'NOT_A_START_MESSAGE' WHEN w < 1 THEN 'INVALID_SOURCE_WIDTH' END AS start_fault,
   CASE WHEN is_start THEN 'NOT_A_FRAME' WHEN k < 10 THEN 'INVALID_SEQUENCE_ID' WHEN tm IN ('absent', 'text') THEN 'INVALID_CAPTURE_TIME' END AS frame_fault,
   NOT o.first.s OR o.first.w < 1 AS closed
 FROM msg m JOIN own o USING (u)),
fate AS (SELECT *, CASE WHEN is_first THEN start_fault WHEN closed THEN 'CONNECTION_CLOSED' ELSE frame_fault END AS fault FROM judged WHERE NOT is_first OR start_fault IS NOT NULL)
SELECT 'c' || u AS connection, fault, CASE WHEN NOT closed THEN 's' || u END AS session_id, CASE WHEN NOT closed THEN first.w END::BIGINT AS source_width,
  CASE WHEN fault IS NULL THEN k - 10 END::BIGINT AS sequence_id, CASE WHEN fault IS NULL AND tm = 'number' THEN k * 40.5::DOUBLE END AS captured_at_ms,
  CASE WHEN fault IS NULL THEN event_id::VARCHAR END AS payload
FROM fate""",
)
def a11(spark, sf):
    """Every event is a message of its user's connection; the log grows by a segment and the stream starts again."""
    k, u = F.col("k"), F.col("u")
    start = F.to_json(
        F.struct(
            F.lit("start").alias("type"),
            F.concat(F.lit("s"), u).alias("session_id"),
            (k % 7 * 600).alias("source_width"),
            F.lit(480).alias("source_height"),
            F.lit(30.0).alias("source_fps"),
        )
    )
    time = (
        F.when(k % 11 == 0, "")
        .when(k % 4 == 0, ',"captured_at_ms":null')
        .when(k % 13 == 0, ',"captured_at_ms":"soon"')
        .otherwise(F.concat(F.lit(',"captured_at_ms":'), k * 40.5))
    )
    frame = F.concat(
        F.lit('{"type":"frame","sequence_id":'), k - 10, time, F.lit(',"byte_count":900,"width":640,"height":480,"payload":"'), F.col("event_id"), F.lit('"}')
    )
    lines = events(spark, sf).select("event_id", F.concat(F.lit("c"), u).alias("connection"), F.when(k % 5 < 3, start).otherwise(frame).alias("message"))
    log, out, checkpoint = (scratch_path(spark, n) for n in ("log", "frames", "offsets"))
    for number in range(ARRIVALS):
        part = lines.filter(F.col("event_id") % ARRIVALS == number).repartitionByRange("event_id").sortWithinPartitions("event_id")
        L.append_segment(part, log, number)
        with LA.stream_settings(spark):
            writer = L.stream_frames(spark, log).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            finished(writer.trigger(availableNow=True).start())
    return spark.read.parquet(out).select("connection", "fault", "session_id", "source_width", "sequence_id", "captured_at_ms", "payload")


@query(
    "i19_late_rows",
    """
arrived AS (SELECT u AS session_id, us // 1000000 AS seq, k % 2 = 0 AS is_speech, event_id % 3 AS seg FROM ev),
shown AS (SELECT *, max(seq) OVER (PARTITION BY session_id ORDER BY seg RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM arrived)
SELECT session_id, seq, is_speech FROM shown WHERE seq < newest - 864000""",
)
def i19(spark, sf):
    """Rows that come more than ten days behind what their session has shown, beside the turns of all others."""
    rows = events(spark, sf).select(
        F.col("u").alias("session_id"), F.expr("us div 1000000").alias("seq"), (F.col("k") % 2 == 0).alias("is_speech"), "event_id"
    )
    source, out, checkpoint = (scratch_path(spark, n) for n in ("rows", "turns", "state"))
    for number in range(ARRIVALS):
        rows.filter(F.col("event_id") % ARRIVALS == number).drop("event_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.drop("event_id").schema).parquet(source).withColumn("frames", F.lit(1))
        finished(LA.start_two_tables(LA.late_fold(stream, ["session_id"], ["seq"], Turns(), delay=864_000), out, checkpoint))
    return LA.two_tables(spark, out, ["session_id"])[1].drop("frames")


@query("i15_kept_snapshot", None)
def i15_kept(spark, sf):
    """The snapshot of i15, kept by a stream whose updates come in several batches."""
    source, folder, checkpoint = (scratch_path(spark, n) for n in ("updates", "snapshot", "offsets"))
    updates = view_updates(spark, sf)
    updates.repartition(ARRIVALS, "seq").write.parquet(source)
    stream = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(source)
    finished(SN.start_snapshot(stream, folder, checkpoint))
    return SN.read_snapshot(spark, folder).select(
        "session_id", "updated_at_ms", F.array_join("visible_objects", ",").alias("shown"), "scene_confidence"
    )


ORACLES["i15_kept_snapshot"] = ORACLES["i15_scene_snapshot"]
