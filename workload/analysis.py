"""Queries: motion, collision risk, analyzers, identity and scene events."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import fixed


from trackloom.functions.text import search_text
from trackloom.operators import hazard as HZ
from trackloom.operators import motion as MO
from trackloom.operators import narration as NA
from trackloom.operators import runs as R
from trackloom.operators import scene as S
from trackloom.operators import screens as SC
from trackloom.operators import tracks as T
from trackloom.operators import turns as TU
from trackloom.operators.keyed import carry_last, chunk_window, drop_ghosts, with_halo
from workload.joins import RESULTS_SQL, signal_results
from workload.registry import query
from workload.runs import KEY, PRESENCE_SQL, RUNS_SQL
from workload.scalars import norm_sql, sql_list, told_events, words_sql
from workload.views import _pick, detections, frames, reads, table

SEGMENT_SQL = """
stepped AS (
  SELECT source_id, stable_id, frame_index, x1, y1, CASE WHEN k % 23 = 0 THEN x1 ELSE x2 END AS x2, y2,
         confidence, coalesce(frame_index - lag(frame_index) OVER w - 1 > 2, true) AS jumped,
         k % 23 <> 0 AS valid, k % 23 <> 0 AND confidence >= 0.3 AS usable
  FROM det WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index)),
stretched AS (
  SELECT *, valid AND NOT usable AS weak, sum(CASE WHEN jumped OR NOT (valid AND NOT usable) THEN 1 ELSE 0 END)
              OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS stretch FROM stepped),
broken AS (
  SELECT *, jumped OR NOT valid OR (weak AND sum(weak::INT) OVER (
       PARTITION BY source_id, stable_id, stretch ORDER BY frame_index) > 2) AS segment_break FROM stretched),
segmented AS (
  SELECT *, sum(segment_break::INT) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS seg
  FROM broken),
boxed AS (
  SELECT *, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
         x2 - x1 AS bw, y2 - y1 AS bh FROM segmented WHERE usable),
listed AS (
  SELECT source_id, stable_id, seg, frame_index, list(area) OVER w AS a, list(cx) OVER w AS xs,
         list(cy) OVER w AS ys, avg(bw) OVER w AS mw, avg(bh) OVER w AS mh, avg(confidence) OVER w AS mc,
         avg(area) OVER w AS ma
  FROM boxed WINDOW w AS (PARTITION BY source_id, stable_id, seg ORDER BY frame_index
                          ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
trend AS (
  SELECT source_id, stable_id, seg, frame_index, len(a) = 9 AS is_full, mc,
    (list_aggregate(a[7:9], 'median') - list_aggregate(a[1:3], 'median')) / list_aggregate(a[1:3], 'median') AS change,
    (list_aggregate(xs[7:9], 'median') - list_aggregate(xs[1:3], 'median')) / mw AS dx,
    (list_aggregate(ys[7:9], 'median') - list_aggregate(ys[1:3], 'median')) / mh AS dy,
    len(list_filter(range(2, 10), lambda i: (a[i] - a[i - 1]) / a[i - 1] >= -0.02)) / 8.0::DOUBLE AS up,
    len(list_filter(range(2, 10), lambda i: (a[i] - a[i - 1]) / a[i - 1] <= 0.02)) / 8.0::DOUBLE AS down,
    (list_max(a) - list_min(a)) / ma AS spread,
    list_max(list_transform(range(1, 10), lambda i: sqrt(((xs[i] - xs[1]) / mw) ** 2 + ((ys[i] - ys[1]) / mh) ** 2))) AS far
  FROM listed),
felt AS (
  SELECT *, CASE WHEN NOT is_full THEN 'UNKNOWN'
      WHEN up >= 0.65 AND change >= 0.1 AND sqrt(dx * dx + dy * dy) <= 1.25 AND dy >= -0.12 THEN 'APPROACHING'
      WHEN down >= 0.65 AND change <= -0.1 AND sqrt(dx * dx + dy * dy) <= 1.25 AND dy <= 0.12 THEN 'RECEDING'
      WHEN spread <= 0.03 AND far <= 0.08 THEN 'STOPPED' ELSE 'UNKNOWN' END AS observed FROM trend),
backed AS (
  SELECT *, CASE WHEN observed IN ('APPROACHING', 'RECEDING')
                 THEN mc * (0.5 + 0.5 * least(1.0, abs(change) / 0.2)) WHEN observed = 'STOPPED'
                 THEN mc * (0.5 + 0.5 * (0.5 + 0.5 * greatest(0.0, least(1 - spread / 0.03, 1 - far / 0.08))))
                 ELSE 0.0 END AS evidence FROM felt),
paired AS (
  SELECT *, observed <> 'UNKNOWN' AND lag(observed) OVER w = observed AS held2,
         coalesce(lag(observed, 2) OVER w = observed, false) AS held3,
         (evidence + lag(evidence) OVER w) / 2 AS mean2
  FROM backed WINDOW w AS (PARTITION BY source_id, stable_id, seg ORDER BY frame_index)),
marked2 AS (
  SELECT *, coalesce(held2, false) AS h2, coalesce(held2, false) AND NOT held3 AS confirms FROM paired),
known2 AS (
  SELECT *, last_value(CASE WHEN confirms THEN observed END IGNORE NULLS) OVER (
       PARTITION BY source_id, stable_id, seg ORDER BY frame_index
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marked2),
motion AS (
  SELECT source_id, stable_id, frame_index,
    CASE WHEN observed <> 'UNKNOWN' AND (h2 OR coalesce(before = observed, false)) THEN observed
         ELSE 'UNKNOWN' END AS motion,
    CASE WHEN confirms AND NOT coalesce(before = observed, false) THEN mean2
         WHEN observed <> 'UNKNOWN' AND (h2 OR coalesce(before = observed, false)) THEN evidence ELSE 0 END AS sure,
    CASE WHEN confirms AND NOT coalesce(before = observed, false) THEN before END AS previous
  FROM known2)
"""


def moving(spark, sf):
    return detections(spark, sf).withColumn(
        "x2", F.when(F.col("k") % 23 == 0, F.col("x1")).otherwise(F.col("x2"))
    )


@query(
    "e6_motion_window",
    SEGMENT_SQL
    + """SELECT source_id, stable_id, frame_index, round(change, 6) AS area_change, round(dx, 6) AS dx,
           round(dy, 6) AS dy, round(up, 6) AS up, round(down, 6) AS down, round(spread, 6) AS spread,
           round(far, 6) AS far FROM trend WHERE is_full""",
)
def e6(spark, sf):
    features = drop_ghosts(MO.motion_window(moving(spark, sf))).filter("area_change is not null")
    names = {
        "area_change": "area_change",
        "center_x_change": "dx",
        "center_y_change": "dy",
        "increasing_consistency": "up",
        "decreasing_consistency": "down",
        "area_span": "spread",
        "center_span": "far",
    }
    return features.select(*KEY, "frame_index", *[F.round(c, 6).alias(n) for c, n in names.items()])


@query(
    "e7_motion_state",
    SEGMENT_SQL
    + """SELECT source_id, stable_id, frame_index, observed, round(evidence, 6) AS evidence
         FROM backed WHERE observed <> 'UNKNOWN'""",
)
def e7(spark, sf):
    felt = drop_ghosts(MO.motion_state(MO.motion_window(moving(spark, sf))))
    return felt.filter("observed_motion <> 'UNKNOWN'").select(
        *KEY,
        "frame_index",
        F.col("observed_motion").alias("observed"),
        F.round("motion_evidence", 6).alias("evidence"),
    )


@query(
    "e8_motion_segments",
    SEGMENT_SQL + "SELECT source_id, stable_id, frame_index, usable, segment_break FROM broken",
)
def e8(spark, sf):
    chunked = with_halo(moving(spark, sf), "frame_index", before=40)
    parts = drop_ghosts(MO.motion_segments(chunked))
    return parts.select(*KEY, "frame_index", "usable", "segment_break")


@query(
    "e9_stabilize_motion",
    SEGMENT_SQL
    + """SELECT source_id, stable_id, frame_index, motion, round(sure, 6) AS motion_confidence,
           previous AS previous_motion FROM motion WHERE motion <> 'UNKNOWN'""",
)
def e9(spark, sf):
    stable = MO.stabilize_motion(MO.motion_state(MO.motion_window(moving(spark, sf))))
    return stable.filter("motion <> 'UNKNOWN'").select(
        *KEY,
        "frame_index",
        "motion",
        F.round("motion_confidence", 6).alias("motion_confidence"),
        "previous_motion",
    )


@query(
    "i5_vehicle_motion",
    SEGMENT_SQL
    + """
SELECT b.source_id, b.stable_id, b.frame_index,
  CASE WHEN motion <> 'UNKNOWN' AND sure >= 0.5 THEN motion ELSE 'UNKNOWN' END AS state,
  NOT coalesce(motion <> 'UNKNOWN' AND sure >= 0.5, false) AS motion_is_uncertain,
  CASE WHEN NOT valid THEN 'invalid_bus_bbox' WHEN NOT usable THEN 'low_detection_confidence'
       WHEN coalesce(motion, 'UNKNOWN') = 'UNKNOWN' THEN 'insufficient_or_ambiguous_motion'
       WHEN sure < 0.5 THEN 'motion_confidence_below_threshold' END AS reason
FROM broken b LEFT JOIN motion USING (source_id, stable_id, frame_index)""",
)
def i5(spark, sf):
    return MO.vehicle_motion(moving(spark, sf)).select(
        *KEY, "frame_index", "state", "motion_is_uncertain", "reason"
    )


GROWTH_SQL = """
areas AS (SELECT *, (x2 - x1) * (y2 - y1) / 307200::DOUBLE AS area_ratio FROM det),
headed AS (
  SELECT *, CASE WHEN lag(frame_index) OVER w = frame_index - 1 THEN 0 ELSE 1 END AS head
  FROM areas WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index)),
runs AS (SELECT *, sum(head) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS run FROM headed),
grown AS (
  SELECT *, (area_ratio > lag(area_ratio) OVER (PARTITION BY source_id, stable_id, run ORDER BY frame_index))::INT AS grew
  FROM runs),
growth AS (
  SELECT *, count(*) OVER w6 AS samples, timestamp_s - first_value(timestamp_s) OVER w6 AS span_s,
    (ln(area_ratio) - ln(first_value(area_ratio) OVER w6))
      / nullif(timestamp_s - first_value(timestamp_s) OVER w6, 0) AS growth_rate,
    avg(grew) OVER w5 AS growth_consistency
  FROM grown WINDOW
    w6 AS (PARTITION BY source_id, stable_id, run ORDER BY frame_index ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
    w5 AS (PARTITION BY source_id, stable_id, run ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
"""


def sized(spark, sf):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / F.lit(307200.0)
    return detections(spark, sf).withColumns({"area_ratio": area, "width": F.lit(640.0)})


@query(
    "e10_growth_rate",
    GROWTH_SQL
    + """SELECT source_id, stable_id, frame_index, samples, span_s, round(growth_rate, 6) AS growth_rate
         FROM growth""",
)
def e10(spark, sf):
    grown = HZ.growth_features(sized(spark, sf))
    return grown.select(
        *KEY, "frame_index", "samples", "span_s", F.round("growth_rate", 6).alias("growth_rate")
    )


@query(
    "e11_growth_consistency",
    GROWTH_SQL
    + """SELECT source_id, stable_id, frame_index, round(growth_consistency, 6) AS growth_consistency
         FROM growth WHERE growth_consistency IS NOT NULL""",
)
def e11(spark, sf):
    grown = HZ.growth_features(sized(spark, sf)).filter("growth_consistency is not null")
    return grown.select(
        *KEY, "frame_index", F.round("growth_consistency", 6).alias("growth_consistency")
    )


MOVING = sql_list(fixed.MOVING_HAZARD_TYPES)


@query(
    "e12_time_to_contact",
    GROWTH_SQL
    + f""",
risk AS (
  SELECT *, 2 / growth_rate AS ttc,
    greatest(0, least(x2, 480) - greatest(x1, 160)) / (x2 - x1) >= 0.2 AS in_path FROM growth
  WHERE area_ratio >= 0.005 AND samples >= 3 AND span_s >= 0.25 AND growth_rate > 0
    AND growth_consistency >= 0.75)
SELECT source_id, stable_id, frame_index, round(ttc, 6) AS time_to_contact_s,
  CASE WHEN ttc <= 1.5 THEN 'IMMINENT' ELSE 'WARNING' END AS level, in_path,
  CASE WHEN (x1 + x2) / 2 < 640 / 3.0::DOUBLE THEN 'LEFT' WHEN (x1 + x2) / 2 > 2 * (640 / 3.0::DOUBLE) THEN 'RIGHT'
       ELSE 'CENTER' END AS zone
FROM risk WHERE ttc <= 3.5 AND (ttc <= 1.5 OR (in_path AND {norm_sql("class_name")} IN ({MOVING})))
  AND confidence * growth_consistency >= 0.35""",
)
def e12(spark, sf):
    risk = HZ.time_to_contact(HZ.growth_features(sized(spark, sf)))
    return risk.select(
        *KEY,
        "frame_index",
        F.round("time_to_contact_s", 6).alias("time_to_contact_s"),
        "level",
        "in_path",
        "zone",
    )


WARNED_SQL = (
    GROWTH_SQL
    + f""",
contact AS (
  SELECT *, 2 / growth_rate AS ttc, greatest(0, least(x2, 480) - greatest(x1, 160)) / (x2 - x1) >= 0.2 AS in_path,
         least(1, confidence * growth_consistency) AS sure
  FROM growth
  WHERE area_ratio >= 0.005 AND samples >= 3 AND span_s >= 0.25 AND growth_rate > 0 AND growth_consistency >= 0.75),
risky AS (
  SELECT *, CASE WHEN ttc <= 1.5 THEN 'IMMINENT' ELSE 'WARNING' END AS level,
         row_number() OVER (PARTITION BY source_id, stable_id, run ORDER BY frame_index) AS n
  FROM contact WHERE ttc <= 3.5 AND (ttc <= 1.5 OR (in_path AND {norm_sql("class_name")} IN ({MOVING}))) AND sure >= 0.35),
walk AS (
  WITH RECURSIVE w AS (
    SELECT source_id, stable_id, run, n, frame_index, timestamp_s AS said_at, level AS said, TRUE AS passed FROM risky WHERE n = 1
    UNION ALL
    SELECT r.source_id, r.stable_id, r.run, r.n, r.frame_index,
           CASE WHEN r.timestamp_s - w.said_at >= 2 OR (w.said = 'WARNING' AND r.level = 'IMMINENT') THEN r.timestamp_s ELSE w.said_at END,
           CASE WHEN r.timestamp_s - w.said_at >= 2 OR (w.said = 'WARNING' AND r.level = 'IMMINENT') THEN r.level ELSE w.said END,
           r.timestamp_s - w.said_at >= 2 OR (w.said = 'WARNING' AND r.level = 'IMMINENT')
    FROM w JOIN risky r USING (source_id, stable_id, run) WHERE r.n = w.n + 1)
  SELECT * FROM w),
warned AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.source_id, r.stable_id, r.run ORDER BY r.frame_index) AS emission_index
  FROM risky r JOIN walk w USING (source_id, stable_id, run, n) WHERE w.passed)
"""
)


@query(
    "e23_escalation_throttle",
    WARNED_SQL + "SELECT source_id, level, count(*) AS warnings, max(emission_index) AS most FROM warned GROUP BY ALL",
)
def e23(spark, sf):
    """Warnings that pass the repeat interval or escalate."""
    found = HZ.hazard_events(detections(spark, sf), frame_width=640, frame_height=480)
    return found.groupBy("source_id", "level").agg(
        F.count(F.lit(1)).alias("warnings"), F.max("emission_index").alias("most")
    )


@query(
    "i10_hazard_events",
    WARNED_SQL
    + f"""SELECT source_id, stable_id, frame_index, timestamp_s, level, round(ttc, 6) AS time_to_contact_s,
  round(growth_rate, 6) AS growth_rate, area_ratio, in_path, round(sure, 6) AS confidence, emission_index,
  {norm_sql("class_name")} AS object_type,
  CASE WHEN (x1 + x2) / 2 < 640 / 3.0::DOUBLE THEN 'LEFT' WHEN (x1 + x2) / 2 > 2 * (640 / 3.0::DOUBLE) THEN 'RIGHT'
       ELSE 'CENTER' END AS zone, 'HAZARD_DETECTED' AS event_type
FROM warned""",
)
def i10(spark, sf):
    found = HZ.hazard_events(detections(spark, sf), frame_width=640, frame_height=480)
    return found.withColumns({c: F.round(c, 6) for c in ("time_to_contact_s", "growth_rate", "confidence")})


@query("i1_stable_ids")
def i1(spark, sf):
    det = detections(spark, sf).drop("stable_id")
    return T.assign_stable_ids(det).select(
        "source_id", "frame_index", "det_index", "stable_no", "object_key"
    )


@query("i2_signal_targets")
def i2(spark, sf):
    det = detections(spark, sf).withColumn("class_name", F.lit("traffic light"))
    return T.select_targets(det)


@query(
    "i3_presence_events",
    PRESENCE_SQL
    + """,
lives2 AS (
  SELECT source_id, stable_id, lifetime_start, max(CASE WHEN event_type = 'appeared' THEN frame_index END) AS a,
         max(CASE WHEN event_type = 'disappeared' THEN frame_index END) AS g FROM presence GROUP BY 1, 2, 3),
sure AS (
  SELECT l.*, (SELECT min(d.frame_index) FROM det d WHERE d.source_id = l.source_id AND d.stable_id = l.stable_id
               AND d.frame_index >= l.a AND d.confidence >= 0.5) AS s FROM lives2 l WHERE a IS NOT NULL),
told2 AS (SELECT * FROM sure WHERE s IS NOT NULL AND (g IS NULL OR s < g))
SELECT source_id, stable_id, 'OBJECT_APPEARED' AS event_type, s AS frame_index FROM told2
UNION ALL SELECT source_id, stable_id, 'OBJECT_DISAPPEARED', g FROM told2 WHERE g IS NOT NULL""",
)
def i3(spark, sf):
    det = detections(spark, sf)
    seen = R.presence(det, frames(det), minimum_seen=2, maximum_missed=2)
    results = det.select(*KEY, "frame_index", F.col("confidence").alias("detection_confidence"))
    return S.presence_events(results, seen).drop("phase", "result_frame")


@query(
    "i4_signal_analysis",
    """
gated AS (SELECT source_id, stable_id, frame_index, k, CASE WHEN confidence >= 0.2 THEN state
            ELSE 'UNKNOWN' END AS s, confidence, evidence FROM det WHERE u % 8 IN (0, 6)),
m AS (SELECT *, CASE WHEN lag(frame_index) OVER w = frame_index - 1 AND lag(s) OVER w = s THEN 0 ELSE 1 END AS head
      FROM gated WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index)),
i AS (SELECT *, sum(head) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS isl FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, stable_id, isl ORDER BY frame_index) AS rk FROM i),
b AS (SELECT *, last_value(CASE WHEN rk = 3 AND s <> 'UNKNOWN' THEN s END IGNORE NULLS) OVER (
        PARTITION BY source_id, stable_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
j AS (SELECT *, s <> 'UNKNOWN' AND (rk >= 3 OR coalesce(before = s, false)) AS ok FROM b)
SELECT source_id, stable_id, frame_index, CASE WHEN ok THEN s WHEN s <> 'UNKNOWN' THEN coalesce(before, 'UNKNOWN')
       ELSE 'UNKNOWN' END AS state, NOT ok AS is_uncertain,
       CASE WHEN ok THEN least(confidence, evidence) ELSE 0 END AS confidence,
       s <> 'UNKNOWN' AND rk = 3 AND before IS NOT NULL AND before <> s AS changed FROM j""",
)
def i4(spark, sf):
    from trackloom.plans.pipeline import signal_analysis

    det = detections(spark, sf).filter("u % 8 in (0, 6)")
    return signal_analysis(det, minimum_frames=3).select(
        *KEY, "frame_index", "state", "is_uncertain", "confidence", "changed"
    )


READS_SQL = """
rd AS (SELECT source_id, stable_id, frame_index, CASE WHEN k % 8 <> 0 THEN 'R' || (frame_index // 5 + u) % 3 END AS route,
              evidence AS confidence FROM det),
h AS (SELECT *, row_number() OVER w AS n, CASE WHEN route IS NULL OR lag(route) OVER w IS DISTINCT FROM route THEN 1 ELSE 0 END AS head
      FROM rd WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index)),
g AS (SELECT *, sum(head) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS grp FROM h),
st AS (SELECT *, row_number() OVER w AS streak, avg(confidence) OVER w AS mean FROM g
       WINDOW w AS (PARTITION BY source_id, stable_id, grp ORDER BY frame_index ROWS UNBOUNDED PRECEDING))
"""


@query(
    "i6_route_confirmation",
    READS_SQL
    + """SELECT source_id, stable_id, frame_index, route, streak AS confirmed_reads, round(mean, 6) AS confidence,
  coalesce(last_value(CASE WHEN streak >= 3 AND route IS NOT NULL THEN route END IGNORE NULLS) OVER (
     PARTITION BY source_id, stable_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <> route, false) AS route_changed
FROM st QUALIFY streak >= 3 AND route IS NOT NULL""",
)
def i6(spark, sf):
    number = (F.floor(F.col("frame_index") / 5) + F.col("u")) % 3
    executed = detections(spark, sf).select(
        *KEY,
        "frame_index",
        F.when(F.col("k") % 8 != 0, F.concat(F.lit("R"), number.cast("string"))).alias("route"),
        F.col("evidence").alias("confidence"),
    )
    found = MO.route_confirmation(executed).filter("route_confirmed")
    return found.select(
        *KEY,
        "frame_index",
        "route",
        F.col("confirmed_reads").cast("bigint").alias("confirmed_reads"),
        F.round("confirmed_confidence", 6).alias("confidence"),
        "route_changed",
    )


@query(
    "i6_due_reads",
    """
o AS (SELECT source_id, stable_id, frame_index AS f FROM det),
due AS (
  WITH RECURSIVE hop AS (
    SELECT source_id, stable_id, min(f) AS f FROM o GROUP BY ALL
    UNION ALL
    SELECT h.source_id, h.stable_id, n.f
    FROM hop h, LATERAL (SELECT min(f) AS f FROM o WHERE o.source_id = h.source_id AND o.stable_id = h.stable_id AND o.f >= h.f + 7) n
    WHERE n.f IS NOT NULL)
  SELECT * FROM hop)
SELECT source_id, stable_id, f AS frame_index FROM due""",
)
def i6_due(spark, sf):
    """Frames on which a route is read: every seventh frame from the first one."""
    return MO.due_reads(detections(spark, sf).select(*KEY, "frame_index"), interval=7, span=20)


@query(
    "b22_accept_lines",
    r"""
n AS (SELECT event_id, pos, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, line_confidence AS confidence FROM reads
      WHERE line_confidence BETWEEN 0.4 AND 1),
s AS (SELECT *, trim(regexp_replace(lower(text), '[^0-9a-z가-힣]+', ' ', 'g')) AS search_text FROM n)
SELECT event_id, search_text, pos, text, confidence FROM s WHERE search_text <> ''
QUALIFY row_number() OVER (PARTITION BY event_id, search_text ORDER BY pos) = 1""",
)
def b22(spark, sf):
    lines = reads(detections(spark, sf)).select(
        "event_id", "pos", "text", F.col("line_confidence").alias("confidence")
    )
    kept = SC.accept_lines(lines, ["event_id"], minimum_confidence=0.4)
    return kept.select("event_id", "search_text", "pos", "text", "confidence")


@query(
    "b22_button_candidates",
    r"""
n AS (SELECT event_id, pos, trim(regexp_replace(lower(text), '[^0-9a-z가-힣]+', ' ', 'g')) AS search_text FROM reads)
SELECT event_id, search_text FROM n WHERE length(search_text) BETWEEN 1 AND 30 AND pos % 2 = 0 AND search_text <> ''
QUALIFY row_number() OVER (PARTITION BY event_id, search_text ORDER BY pos) = 1""",
)
def b22_buttons(spark, sf):
    box = F.when(
        F.col("pos") % 2 == 0,
        F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(9).alias("right"), F.lit(9).alias("bottom")),
    )
    lines = reads(detections(spark, sf)).select(
        "event_id", "pos", "text", F.lit(0.9).alias("confidence"), box.alias("box")
    )
    kept = SC.accept_lines(lines, ["event_id"], exact_unicode=False)
    return SC.button_candidates(kept).select("event_id", "search_text")


@query(
    "b23_clean_lines",
    """
raw AS (SELECT event_id, pos, text, CASE WHEN k % 6 = 0 THEN 2.5 WHEN k % 6 = 1 THEN -1 ELSE line_confidence END AS c FROM reads
        WHERE k % 6 <> 2)
SELECT event_id, string_agg(trim(text), '|' ORDER BY pos) AS texts, round(sum(greatest(0, least(1, c))), 6) AS total
FROM raw GROUP BY 1""",
)
def b23(spark, sf):
    k = F.col("k")
    raw = (
        F.when(k % 6 == 0, 2.5)
        .when(k % 6 == 1, -1.0)
        .when(k % 6 == 2, F.lit(float("nan")))
        .otherwise(F.col("line_confidence"))
    )
    lines = (
        reads(detections(spark, sf))
        .groupBy("event_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "pos",
                        F.concat(F.lit(" "), "text").alias("text"),
                        raw.alias("confidence"),
                        F.lit(None).cast("int").alias("box"),
                    )
                )
            ).alias("lines")
        )
    )
    clean = lines.select("event_id", SC.clean_lines(F.col("lines")).alias("l")).filter("size(l) > 0")
    total = F.aggregate("l", F.lit(0.0), lambda acc, x: acc + x["confidence"])
    return clean.select(
        "event_id",
        F.array_join(F.transform("l", lambda x: x["text"]), "|").alias("texts"),
        F.round(total, 6).alias("total"),
    )


def kiosk_screens(spark, sf):
    """One screen per observation with its normalised lines and unbroken run."""
    det = detections(spark, sf)
    lines = (
        reads(det)
        .groupBy(*KEY, "frame_index")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", search_text(F.col("text")).alias("s")))).alias("l"),
            F.max("confidence").alias("confidence"),
            F.avg("line_confidence").alias("ocr_confidence"),
        )
        .withColumn("search_lines", F.transform("l", lambda x: x["s"]))
        .drop("l")
    )
    w = chunk_window(KEY, "frame_index")
    head = F.coalesce(F.lag("frame_index").over(w) != F.col("frame_index") - 1, F.lit(True))
    marked = drop_ghosts(with_halo(lines, "frame_index", before=1).withColumn("_head", head))
    return carry_last(
        marked, KEY, ["frame_index"], {"run_start": F.when(F.col("_head"), F.col("frame_index"))}
    ).drop("_head")


SCREEN_SQL = rf"""
sl AS (SELECT source_id, stable_id, frame_index, pos, confidence, line_confidence,
  trim(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[^0-9a-z가-힣]+', ' ', 'g')) AS s FROM reads),
sc AS (SELECT source_id, stable_id, frame_index, max(confidence) AS confidence, avg(line_confidence) AS oc,
  string_agg(s, ' ' ORDER BY pos) AS t, sha256(string_agg(DISTINCT s, chr(31) ORDER BY s)) AS fp FROM sl GROUP BY 1, 2, 3),
ob AS (SELECT *, CASE WHEN confidence < 0.5 THEN NULL WHEN {words_sql("t", fixed.CONFIRMATION_PHRASES)} THEN 'CONFIRMATION'
  WHEN {words_sql("t", fixed.DINE_IN_PHRASES)} AND {words_sql("t", fixed.TAKEOUT_PHRASES)} THEN 'ORDER_TYPE_SELECTION'
  WHEN {words_sql("t", fixed.PAYMENT_STRONG_PHRASES)} OR ({words_sql("t", fixed.PAYMENT_ACTION_PHRASES)}
    AND {words_sql("t", fixed.PAYMENT_METHOD_PHRASES)}) THEN 'PAYMENT' END AS stage,
  CASE WHEN confidence >= 0.5 THEN fp END AS mark FROM sc)
"""


def confirmed_sql(value, n, name):
    """Islands of equal values on consecutive frames, confirmed from the n-th on."""
    return f"""
{name}_m AS (SELECT source_id, stable_id, frame_index, {value} AS v,
   CASE WHEN {value} IS NOT NULL AND lag(frame_index) OVER w = frame_index - 1 AND lag({value}) OVER w = {value} THEN 0 ELSE 1 END AS head
   FROM ob WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index)),
{name}_i AS (SELECT *, sum(head) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS isl FROM {name}_m),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY source_id, stable_id, isl ORDER BY frame_index) AS rk FROM {name}_i),
{name}_b AS (SELECT *, last_value(CASE WHEN rk = {n} AND v IS NOT NULL THEN v END IGNORE NULLS) OVER (
   PARTITION BY source_id, stable_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {name}_r),
{name} AS (SELECT source_id, stable_id, frame_index,
   CASE WHEN v IS NOT NULL AND (rk >= {n} OR coalesce(before = v, false)) THEN v END AS confirmed,
   v IS NOT NULL AND rk = {n} AND before IS NOT NULL AND before <> v AS changed,
   v IS NOT NULL AND rk = {n} AND before IS NULL AS is_first FROM {name}_b)"""


@query(
    "i7_kiosk_analysis",
    SCREEN_SQL
    + ","
    + confirmed_sql("stage", 2, "stg")
    + ","
    + confirmed_sql("mark", 2, "scr")
    + """
SELECT o.source_id, o.stable_id, o.frame_index, coalesce(stg.confirmed, 'UNKNOWN') AS state, stg.changed AS stage_changed,
  scr.confirmed AS screen_fingerprint, scr.changed OR scr.is_first AS screen_changed,
  round(CASE WHEN stg.confirmed IS NOT NULL THEN least(o.confidence, o.oc) ELSE 0 END, 6) AS confidence
FROM ob o JOIN stg USING (source_id, stable_id, frame_index) JOIN scr USING (source_id, stable_id, frame_index)""",
)
def i7(spark, sf):
    judged = SC.kiosk_analysis(kiosk_screens(spark, sf), minimum_reads=2)
    return judged.select(
        *KEY,
        "frame_index",
        "state",
        "stage_changed",
        "screen_fingerprint",
        "screen_changed",
        F.round("result_confidence", 6).alias("confidence"),
    )


@query(
    "i8_text_confirmation",
    """
ob AS (SELECT source_id, stable_id, frame_index, lower(t) AS mark, t AS stage, sure FROM (
  SELECT source_id, stable_id, frame_index, CASE WHEN k % 7 <> 0 THEN 'Gate ' || (frame_index // 4 + u) % 3 END AS t,
         evidence AS sure FROM det)),
m AS (SELECT *, CASE WHEN mark IS NOT NULL AND lag(frame_index) OVER w = frame_index - 1 AND lag(mark) OVER w = mark THEN 0 ELSE 1 END AS head
  FROM ob WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index)),
i AS (SELECT *, sum(head) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS isl FROM m),
r AS (SELECT *, row_number() OVER w AS rk, avg(sure) OVER w AS mean FROM i
  WINDOW w AS (PARTITION BY source_id, stable_id, isl ORDER BY frame_index ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, lag(stage) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS before FROM r
      WHERE rk >= 2 AND mark IS NOT NULL)
SELECT source_id, stable_id, frame_index, stage AS confirmed_text, round(mean, 6) AS confirmed_confidence,
  rk AS candidate_frames, coalesce(before <> stage, false) AS text_changed FROM c""",
)
def i8(spark, sf):
    number = (F.floor(F.col("frame_index") / 4) + F.col("u")) % 3
    rows = detections(spark, sf).select(
        *KEY,
        "frame_index",
        F.lit(True).alias("due"),
        F.when(F.col("k") % 7 != 0, F.concat(F.lit("Gate "), number.cast("string"))).alias("text"),
        F.col("evidence").alias("confidence"),
    )
    found = SC.text_confirmation(rows, minimum_reads=2).filter("confirmed")
    return found.select(
        *KEY,
        "frame_index",
        "confirmed_text",
        F.round("confirmed_confidence", 6).alias("confirmed_confidence"),
        "candidate_frames",
        "text_changed",
    )


@query(
    "i9_description_confirmation",
    """
ok AS (SELECT * FROM det WHERE confidence >= 0.2),
m AS (SELECT *, CASE WHEN lag(frame_index) OVER w = frame_index - 1 THEN 0 ELSE 1 END AS head FROM ok
      WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index)),
i AS (SELECT *, sum(head) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS run FROM m),
p AS (SELECT *, frame_index - min(frame_index) OVER (PARTITION BY source_id, stable_id, run) - 1 AS waited FROM i),
due AS (SELECT *, CASE WHEN evidence >= 0.3 THEN 'a ' || (frame_index // 12) % 2 END AS d FROM p WHERE waited >= 0 AND waited % 2 = 0),
h AS (SELECT *, CASE WHEN d IS NOT NULL AND lag(d) OVER w = d AND lag(run) OVER w = run THEN 0 ELSE 1 END AS hd FROM due
      WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index)),
g AS (SELECT *, sum(hd) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS isl FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, stable_id, isl ORDER BY frame_index) AS rk FROM g),
b AS (SELECT *, last_value(CASE WHEN rk = 2 AND d IS NOT NULL THEN d END IGNORE NULLS) OVER (
      PARTITION BY source_id, stable_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT source_id, stable_id, frame_index, CASE WHEN rk >= 2 OR coalesce(before = d, false) THEN d END AS description,
  coalesce(rk = 2 AND before <> d, false) AS changed FROM b""",
)
def i9(spark, sf):
    due = SC.description_due(
        detections(spark, sf), interval=2, minimum_seen=2, minimum_detection_confidence=0.2
    )
    described = due.select(
        *KEY,
        "frame_index",
        "run_start",
        F.concat(F.lit("a  "), (F.floor(F.col("frame_index") / 12) % 2).cast("string")).alias("description"),
        F.col("evidence").alias("vlm_confidence"),
    )
    found = SC.description_confirmation(described, minimum_confidence=0.3)
    return found.select(*KEY, "frame_index", "description", "changed")


SCENE_RESULTS_SQL = """
res AS (
  SELECT source_id, stable_id, frame_index, u % 4 AS kind, k,
    CASE u % 4 WHEN 0 THEN 'traffic_light' WHEN 1 THEN 'bus' WHEN 2 THEN 'kiosk' ELSE 'sign' END AS object_type,
    CASE WHEN u % 4 = 1 AND state = 'RED' THEN 'APPROACHING' ELSE state END AS state,
    k % 5 = 0 AS is_uncertain, confidence, evidence,
    CASE WHEN u % 4 = 1 AND k % 3 > 0 THEN 'R' || (frame_index // 6) % 2 END AS route_number,
    CASE WHEN u % 4 = 3 AND k % 4 > 0 THEN 'T' || (frame_index // 8) % 3 END AS text,
    CASE WHEN u % 4 = 2 AND k % 4 > 0 THEN 'f' || (frame_index // 5) % 3 END AS screen_fingerprint
  FROM det),
ev_conf AS (SELECT *, least(confidence, evidence) AS both_conf FROM res)
"""


def scene_results(det):
    u, k, f = F.col("u"), F.col("k"), F.col("frame_index")

    def numbered(prefix, frames_each, modulo):
        return F.concat(F.lit(prefix), (F.floor(f / frames_each) % modulo).cast("string"))

    return det.select(
        *KEY,
        "frame_index",
        "timestamp_s",
        _pick(("traffic_light", "bus", "kiosk", "sign"), u % 4).alias("object_type"),
        F.when((u % 4 == 1) & (F.col("state") == "RED"), "APPROACHING")
        .otherwise(F.col("state"))
        .alias("state"),
        (k % 5 == 0).alias("is_uncertain"),
        F.col("evidence").alias("confidence"),
        F.col("confidence").alias("detection_confidence"),
        F.when((u % 4 == 1) & (k % 3 > 0), numbered("R", 6, 2)).alias("route_number"),
        F.when((u % 4 == 3) & (k % 4 > 0), numbered("T", 8, 3)).alias("text"),
        F.when((u % 4 == 2) & (k % 4 > 0), numbered("f", 5, 3)).alias("screen_fingerprint"),
        F.when(u % 4 == 2, k % 4 > 0).alias("screen_is_confirmed"),
    )


def changed_sql(value, condition):
    return f"""SELECT source_id, stable_id, frame_index FROM (
       SELECT *, lag({value}) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS before
       FROM ev_conf WHERE {value} IS NOT NULL AND both_conf >= 0.5 AND {condition})
     WHERE before IS NULL OR before <> {value}"""


@query(
    "i11_domain_events",
    SCENE_RESULTS_SQL
    + f"""
SELECT *, 'SCREEN_CHANGED' AS event_type FROM ({changed_sql("screen_fingerprint", "object_type = 'kiosk'")})
UNION ALL SELECT *, 'TEXT_CONFIRMED' FROM ({changed_sql("coalesce(route_number, text)", "NOT is_uncertain")})
UNION ALL SELECT source_id, stable_id, frame_index, 'OBJECT_APPROACHING' FROM (
  SELECT *, lag(state) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS before FROM ev_conf
  WHERE NOT is_uncertain AND state <> 'UNKNOWN' AND both_conf >= 0.5)
  WHERE object_type = 'bus' AND state = 'APPROACHING' AND (before IS NULL OR before <> 'APPROACHING')""",
)
def i11_domain(spark, sf):
    full = S.complete_results(scene_results(detections(spark, sf)))
    return S.domain_events(full).select(*KEY, "frame_index", "event_type")


@query(
    "i11_state_events",
    RUNS_SQL
    + ","
    + RESULTS_SQL
    + """,
steps AS (SELECT source_id, stable_id, frame_index, 2 AS phase, NULL AS previous_state, state AS current_state FROM certain
          UNION ALL SELECT source_id, stable_id, frame_index, phase, previous_state, current_state FROM agreed),
linked AS (SELECT *, lag(current_state) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index, phase) AS before FROM steps)
SELECT source_id, stable_id, frame_index, phase, coalesce(previous_state, before) AS previous_state, current_state
FROM linked WHERE before <> current_state OR (before IS NULL AND phase < 2)""",
)
def i11_state(spark, sf):
    det = detections(spark, sf)
    asked = R.state_transitions(det.select(*KEY, "frame_index", "state"), minimum_frames=2)
    told = S.state_events(S.complete_results(signal_results(det)), asked)
    return told.drop("event_type")


@query("i11_scene_events")
def i11(spark, sf):
    """All event kinds together with the attributes of the result behind each."""
    det = detections(spark, sf)
    seen = R.presence(det, frames(det), minimum_seen=2, maximum_missed=2)
    signals = det.filter("u % 4 = 0").select(*KEY, "frame_index", "state")
    asked = R.state_transitions(signals, minimum_frames=2)
    return S.scene_events(scene_results(det), seen, asked).drop("visible_options")


@query(
    "i12_standalone_presence",
    """
runs1 AS (
  SELECT source_id, stable_id, frame_index, confidence,
         CASE WHEN lag(frame_index) OVER w = frame_index - 1 THEN 0 ELSE 1 END AS head
  FROM det WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index)),
runs2 AS (SELECT *, sum(head) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS run FROM runs1),
spans AS (SELECT source_id, stable_id, run, min(CASE WHEN confidence >= 0.5 THEN frame_index END) AS s,
                 max(frame_index) + 1 AS g FROM runs2 GROUP BY 1, 2, 3),
clock AS (SELECT source_id, max(frame_index) AS last_frame FROM frames GROUP BY 1)
SELECT source_id, stable_id, 'OBJECT_APPEARED' AS event_type, s AS frame_index FROM spans WHERE s IS NOT NULL
UNION ALL SELECT source_id, stable_id, 'OBJECT_DISAPPEARED', g FROM spans JOIN clock USING (source_id)
WHERE s IS NOT NULL AND g <= last_frame""",
)
def i12(spark, sf):
    det = detections(spark, sf)
    results = det.select(*KEY, "frame_index", F.col("confidence").alias("detection_confidence"))
    return S.standalone_presence(results, frames(det)).drop("phase", "result_frame")


def spoken(spark, sf):
    told = NA.narratable(told_events(spark, sf), presence_types=("person", "bicycle"))
    return told.select(
        "source_id",
        "timestamp_s",
        F.col("timestamp_s").alias("now_s"),
        F.col("event_id").alias("seq"),
        "event_type",
        "message",
        "priority",
        "dedup_key",
    )


@query("i13_narration_queue")
def i13(spark, sf):
    det = detections(spark, sf)
    ticks = frames(det).select("source_id", (F.col("frame_index") * 0.5).alias("now_s"))
    return NA.narration_queue(
        spoken(spark, sf), ticks, ttl_by_event_type={"HAZARD_DETECTED": 1.5}
    )


@query("i14_narrate_batches")
def i14(spark, sf):
    return NA.narrate_batches(spoken(spark, sf))


@query(
    "i15_scene_snapshot",
    """
upd AS (SELECT source_id, frame_index * 500 AS ms, event_id, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE class_name END AS v, confidence FROM det)
SELECT source_id AS session_id, max(ms) AS updated_at_ms,
  arg_max(v, ms * 1000000000 + event_id) FILTER (v IS NOT NULL) AS shown,
  arg_max(confidence, ms * 1000000000 + event_id) FILTER (v IS NOT NULL) AS scene_confidence
FROM upd GROUP BY 1""",
)
def i15(spark, sf):
    return S.snapshot(view_updates(spark, sf)).select(
        "session_id",
        "updated_at_ms",
        F.array_join("visible_objects", ",").alias("shown"),
        "scene_confidence",
    )


def view_updates(spark, sf):
    k = F.col("k")
    view = F.when(k % 4 == 1, F.array().cast("array<string>")).when(
        k % 4 > 1, F.array("class_name")
    )
    return detections(spark, sf).select(
        F.col("source_id").alias("session_id"),
        (F.col("frame_index") * 500).alias("updated_at_ms"),
        F.col("event_id").alias("seq"),
        view.alias("visible_objects"),
        F.col("confidence").alias("scene_confidence"),
    )


def speech_flags(spark, sf):
    """Every word of a document is one voice frame; long words are speech."""
    words = F.split("text", r"\s+")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("session_id"), F.posexplode(words).alias("seq", "word")
    ).select(
        "session_id", F.col("seq").cast("bigint").alias("seq"), (F.char_length("word") >= 5).alias("is_speech")
    )


def spoken_turns(spark, sf):
    return TU.endpoint_turns(
        speech_flags(spark, sf),
        silence_ms=100,
        prefix_ms=60,
        min_speech_ms=120,
        max_utterance_ms=4000,
        speculative_ms=60,
    )


@query("i16_endpoint_turns")
def i16(spark, sf):
    return spoken_turns(spark, sf).filter("kind = 'turn'")


@query("i17_speculative_points")
def i17(spark, sf):
    return TU.speculative_points(spoken_turns(spark, sf)).select("session_id", "seq", "speech_ms")


@query(
    "i18_barge_in",
    """
spoken3 AS (SELECT conv_id, turn * 100 AS start_seq, turn * 100 + (length(text) % 150) AS done_seq, text FROM conversations WHERE role = 'assistant'),
said3 AS (SELECT conv_id, turn, turn * 100 + 20 AS onset_seq, length(text) % 5 = 0 AS discarded FROM conversations WHERE role = 'user')
SELECT s.conv_id, s.turn, coalesce(r.done_seq > s.onset_seq, false) AS interrupts
FROM said3 s ASOF LEFT JOIN spoken3 r ON s.conv_id = r.conv_id AND s.onset_seq >= r.start_seq""",
)
def i18(spark, sf):
    talk = table(spark, sf, "conversations")
    at = F.col("turn") * 100
    replies = talk.filter("role = 'assistant'").select(
        "conv_id",
        at.alias("start_seq"),
        (at + F.char_length("text") % 150).alias("done_seq"),
        "text",
    )
    asked = talk.filter("role = 'user'").select(
        "conv_id",
        "turn",
        (at + 20).alias("onset_seq"),
        (F.char_length("text") % 5 == 0).alias("discarded"),
        F.col("text").alias("transcript"),
    )
    return TU.barge_in(asked, replies, keys=["conv_id"]).select("conv_id", "turn", "interrupts")


@query("i20_pipeline")
def i20(spark, sf):
    """From raw detections to what a listener hears, every step keyed by source."""
    from trackloom.plans.pipeline import Settings, run_pipeline

    det = detections(spark, sf).drop("stable_id")
    out = run_pipeline(det, Settings(minimum_seen=2, maximum_missed=3, minimum_state_frames=2))
    return out.narrations


