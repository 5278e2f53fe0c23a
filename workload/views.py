"""Detections, readings and texts derived from the given tables.

The tables hold no detections, so each user is read as a tracked object and
each of its events as an observation. A user's frames go on by one from event
to event and by one more for every half day that begins between them, so quiet
times are gaps. Eight neighbouring users form a source, so that sources grow
in number with the data. ``SQL_VIEWS`` states the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.keyed import carry_sum

EPOCH_US = 1704067200000000
FRAME_US = 43200000000
FRAME_WIDTH, FRAME_HEIGHT = 640, 480

CLASS_NAMES = (
    "traffic light",
    "bus",
    "person",
    "Kiosk",
    "stop-sign",
    "bicycle",
    "pedestrian signal",
    "unknown panel",
)
CLASS_IDS = (9, 5, 0, 80, 11, 1, 81, 82)
STATES = ("RED", "GREEN", "YELLOW")
LINES = (
    "매장 식사",
    "포장",
    "카드 결제",
    "결제 방법",
    "주문 완료",
    "Confirm",
    "310",
    "A12 Downtown",
    "3?2",
    "Pay now",
    "cash",
    "hello  World",
)

SQL_VIEWS = {
    "ev": f"""
        SELECT event_id, user_id AS u, event_type, value,
               (epoch_us(ts) - {EPOCH_US}) // {FRAME_US} AS f, epoch_us(ts) AS us,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
        FROM events""",
    "seen": """
        SELECT event_id, u, event_type, value, us, k,
               f + row_number() OVER (PARTITION BY u ORDER BY us, event_id) - 1 AS f
        FROM ev""",
    "det": f"""
        SELECT u // 8 AS source_id, 't' || u AS stable_id, u AS det_index, f AS frame_index,
               CAST(f AS DOUBLE) * 0.5::DOUBLE AS timestamp_s,
               ([{", ".join(map(str, CLASS_IDS))}])[u % 8 + 1]::BIGINT AS class_id,
               ([{", ".join(f"'{c}'" for c in CLASS_NAMES)}])[u % 8 + 1] AS class_name,
               CAST(k AS DOUBLE) / 100::DOUBLE AS confidence,
               CAST((u * 97) % 560 + k % 7 AS DOUBLE) AS x1,
               CAST((u * 53) % 300 + k % 5 AS DOUBLE) AS y1,
               CAST((u * 97) % 560 + k % 7 + 20 + 8 * (f % 12) + k % 3 AS DOUBLE) AS x2,
               CAST((u * 53) % 300 + k % 5
                    + (20 + 8 * (f % 12) + k % 3) * (CASE WHEN u % 3 = 0 THEN 1 ELSE 2 END)
                    AS DOUBLE) AS y2,
               CASE WHEN k % 5 <> 0 THEN u * 1000 + f // 30 END AS track_id,
               CASE WHEN event_type = 'error' THEN 'UNKNOWN'
                    WHEN event_type = 'signup' AND k < 30 THEN 'GREEN'
                    ELSE (['RED', 'GREEN', 'YELLOW'])[(f // 6 + u) % 3 + 1] END AS state,
               CAST((k * 7) % 101 AS DOUBLE) / 100::DOUBLE AS evidence,
               u, k, event_id, event_type, value
        FROM seen""",
    "frames": """
        SELECT source_id, unnest(generate_series(min(frame_index), max(frame_index))) AS frame_index
        FROM det GROUP BY source_id""",
    "reads": f"""
        SELECT source_id, stable_id, frame_index, u, k, event_id, event_type, confidence, evidence,
               ([{", ".join(f"'{t}'" for t in LINES)}])[line_no_text % 12 + 1] AS text, pos,
               CAST((k * 3 + pos * 11) % 101 AS DOUBLE) / 100::DOUBLE AS line_confidence
        FROM (SELECT det.*, p.pos, (frame_index // 4 + u * 5 + p.pos * (1 + u % 3)) AS line_no_text
              FROM det CROSS JOIN (VALUES (0), (1), (2)) p(pos)
              WHERE p.pos <= k % 3)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ts has no zone; an interval keeps the result independent of the session's zone
    us = F.expr("(ts - timestamp_ntz'1970-01-01') div interval '0.000001' second")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("u"),
        "event_type",
        "value",
        F.floor((us - EPOCH_US) / FRAME_US).cast("bigint").alias("f"),
        us.alias("us"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per object and frame, keyed by source and object; every event is one."""
    seen = carry_sum(events(spark, sf_dir), ["u"], ["us", "event_id"], {"n": F.lit(1)}, span=4 * FRAME_US)
    seen = seen.withColumn("f", F.col("f") + F.col("n") - 1)
    u, f, k = F.col("u"), F.col("f"), F.col("k")
    left = (u * 97) % 560 + k % 7
    top = (u * 53) % 300 + k % 5
    width = 20 + 8 * (f % 12) + k % 3
    return seen.select(
        F.floor(u / 8).cast("bigint").alias("source_id"),
        F.concat(F.lit("t"), u.cast("string")).alias("stable_id"),
        u.alias("det_index"),
        f.alias("frame_index"),
        (f * F.lit(0.5)).alias("timestamp_s"),
        _pick(CLASS_IDS, u % 8).cast("bigint").alias("class_id"),
        _pick(CLASS_NAMES, u % 8).alias("class_name"),
        (k / F.lit(100.0)).alias("confidence"),
        left.cast("double").alias("x1"),
        top.cast("double").alias("y1"),
        (left + width).cast("double").alias("x2"),
        (top + width * F.when(u % 3 == 0, 1).otherwise(2)).cast("double").alias("y2"),
        F.when(k % 5 != 0, u * 1000 + F.floor(f / 30).cast("bigint")).alias("track_id"),
        F.when(F.col("event_type") == "error", "UNKNOWN")
        .when((F.col("event_type") == "signup") & (k < 30), "GREEN")
        .otherwise(_pick(STATES, (F.floor(f / 6) + u) % 3))
        .alias("state"),
        (((k * 7) % 101) / F.lit(100.0)).alias("evidence"),
        "u",
        "k",
        "event_id",
        "event_type",
        "value",
    )


def frames(det: DataFrame) -> DataFrame:
    """Every frame of a source between its first and last, empty ones included."""
    return (
        det.groupBy("source_id")
        .agg(F.min("frame_index").alias("a"), F.max("frame_index").alias("b"))
        .select("source_id", F.explode(F.sequence("a", "b")).alias("frame_index"))
    )


def reads(det: DataFrame) -> DataFrame:
    """Text lines read on each observation, one row per line."""
    pos = F.col("pos")
    number = F.floor(F.col("frame_index") / 4) + F.col("u") * 5 + pos * (1 + F.col("u") % 3)
    return (
        det.select("*", F.explode(F.sequence(F.lit(0), (F.col("k") % 3).cast("int"))).alias("pos"))
        .select(
            "source_id",
            "stable_id",
            "frame_index",
            "u",
            "k",
            "event_id",
            "event_type",
            "confidence",
            "evidence",
            _pick(LINES, number % 12).alias("text"),
            "pos",
            (((F.col("k") * 3 + pos * 11) % 101) / F.lit(100.0)).alias("line_confidence"),
        )
    )
