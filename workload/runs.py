"""Queries: streaks, confirmations, presence, epochs and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions.classes import known_state
from trackloom.operators import runs as R
from trackloom.operators.fold import fold, throttle
from trackloom.operators.keyed import carry_last
from trackloom.operators.clocks import file_clock, live_clock
from trackloom.operators.steps import RateLimit
from workload.registry import query
from workload.views import detections, events, frames

KEY = ["source_id", "stable_id"]

RUNS_SQL = """
marked AS (
  SELECT source_id, stable_id, frame_index, state,
         CASE WHEN lag(frame_index) OVER w = frame_index - 1
               AND lag(state) OVER w IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS head
  FROM det WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index)),
islands AS (
  SELECT *, sum(head) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS island
  FROM marked),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, stable_id, island ORDER BY frame_index)
            AS run_rank,
         min(frame_index) OVER (PARTITION BY source_id, stable_id, island) AS run_start
  FROM islands)
"""


@query(
    "e1_runs",
    RUNS_SQL + "SELECT source_id, stable_id, frame_index, state, run_start, run_rank FROM ranked",
)
def e1(spark, sf):
    return R.runs(detections(spark, sf).select(*KEY, "frame_index", "state"), "state")


@query(
    "e2_debounce",
    RUNS_SQL
    + """,
conf AS (
  SELECT *, state <> 'UNKNOWN' AS known, state <> 'UNKNOWN' AND run_rank = 2 AS confirms
  FROM ranked),
carried AS (
  SELECT *, last_value(CASE WHEN confirms THEN state END IGNORE NULLS) OVER (
            PARTITION BY source_id, stable_id ORDER BY frame_index
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM conf),
judged AS (
  SELECT *, known AND (run_rank >= 2 OR coalesce(before = state, false)) AS settled,
         confirms AND before IS NOT NULL AND before <> state AS changed
  FROM carried)
SELECT source_id, stable_id, frame_index, state,
       CASE WHEN settled THEN state WHEN known THEN coalesce(before, 'UNKNOWN')
            ELSE 'UNKNOWN' END AS confirmed_state,
       CASE WHEN changed THEN before END AS previous_state, changed,
       CASE WHEN settled THEN run_rank ELSE 0 END AS confirmed_frames,
       CASE WHEN known AND NOT settled THEN state END AS candidate_state,
       CASE WHEN known AND NOT settled THEN run_rank ELSE 0 END AS candidate_frames,
       NOT settled AS is_uncertain
FROM judged""",
)
def e2(spark, sf):
    det = detections(spark, sf).select(*KEY, "frame_index", "state")
    return R.debounce(det, minimum_frames=2)


E3_SQL = (
    RUNS_SQL
    + """,
conf AS (
  SELECT *, lag(state) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS before
  FROM ranked WHERE run_rank = 2 AND state <> 'UNKNOWN')
SELECT source_id, stable_id, frame_index, before AS previous_state, state AS current_state
FROM conf WHERE before <> state"""
)


@query("e3_state_transitions", E3_SQL)
def e3(spark, sf):
    det = detections(spark, sf).select(*KEY, "frame_index", "state")
    return R.state_transitions(det, minimum_frames=2)


PRESENCE_SQL = """
stepped AS (
  SELECT source_id, stable_id, frame_index,
         CASE WHEN frame_index - lag(frame_index) OVER w <= 2 THEN 0 ELSE 1 END AS starts,
         coalesce(lag(frame_index, 1) OVER w = frame_index - 1, false) AS streak
  FROM det WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index)),
lives AS (
  SELECT *, sum(starts) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS life
  FROM stepped),
ends AS (
  SELECT source_id, stable_id, min(frame_index) AS lifetime_start,
         min(CASE WHEN streak THEN frame_index END) AS appeared_at, max(frame_index) + 2 AS gone_at
  FROM lives GROUP BY source_id, stable_id, life),
clock AS (SELECT source_id, max(frame_index) AS last_frame FROM frames GROUP BY source_id),
presence AS (
  SELECT source_id, stable_id, lifetime_start, 'appeared' AS event_type, appeared_at AS frame_index
  FROM ends WHERE appeared_at IS NOT NULL
  UNION ALL
  SELECT source_id, stable_id, lifetime_start,
         CASE WHEN appeared_at IS NULL THEN 'retired' ELSE 'disappeared' END, gone_at
  FROM ends JOIN clock USING (source_id) WHERE gone_at <= last_frame)
"""


@query("e4_presence", PRESENCE_SQL + "SELECT * FROM presence")
def e4(spark, sf):
    det = detections(spark, sf)
    seen = R.presence(det, frames(det), minimum_seen=2, maximum_missed=2)
    return seen.drop("last_seen")


@query(
    "e5_gap_epochs",
    """
marked AS (
  SELECT source_id, stable_id, frame_index,
         CASE WHEN timestamp_s - lag(timestamp_s) OVER w > 1 THEN 1
              WHEN lag(timestamp_s) OVER w IS NULL THEN 1 ELSE 0 END AS brk
  FROM det WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY timestamp_s))
SELECT source_id, stable_id, frame_index,
       CAST(sum(brk) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS BIGINT)
       AS epoch
FROM marked""",
)
def e5(spark, sf):
    det = detections(spark, sf).select(*KEY, "frame_index", "timestamp_s")
    return R.gap_epochs(det, keys=KEY, maximum_gap=1.0).drop("timestamp_s")


@query(
    "e13_changed_values",
    """
usable AS (
  SELECT source_id, stable_id, frame_index, event_type,
         lag(event_type) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS before
  FROM det WHERE confidence >= 0.5)
SELECT source_id, stable_id, frame_index, event_type, before AS previous_value
FROM usable WHERE before IS NULL OR before <> event_type""",
)
def e13(spark, sf):
    det = detections(spark, sf).select(*KEY, "frame_index", "event_type", "confidence")
    return R.changed_values(det, "event_type", valid=F.col("confidence") >= 0.5).drop("confidence")


@query(
    "e14_enter_state",
    """
usable AS (
  SELECT source_id, stable_id, frame_index, state,
         lag(state) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS before
  FROM det WHERE confidence >= 0.5 AND state <> 'UNKNOWN')
SELECT source_id, stable_id, frame_index FROM usable
WHERE state = 'GREEN' AND (before IS NULL OR before <> 'GREEN')""",
)
def e14(spark, sf):
    det = detections(spark, sf).select(*KEY, "frame_index", "state", "confidence")
    entered = R.enter_state(det, "GREEN", valid=F.col("confidence") >= 0.5)
    return entered.select(*KEY, "frame_index")


@query(
    "e15_state_changes",
    """
usable AS (
  SELECT source_id, stable_id, frame_index, state,
         lag(state) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS before
  FROM det WHERE confidence >= 0.5 AND state <> 'UNKNOWN')
SELECT source_id, stable_id, frame_index, before AS previous_state, state AS current_state
FROM usable WHERE before <> state""",
)
def e15(spark, sf):
    det = detections(spark, sf).select(*KEY, "frame_index", "state", "confidence")
    changes = R.state_changes(det, valid=F.col("confidence") >= 0.5)
    return changes.select(*KEY, "frame_index", "previous_state", "current_state")


@query(
    "e16_false_episodes",
    """
judged AS (
  SELECT source_id, stable_id, frame_index,
         state = 'GREEN' AND (['RED', 'GREEN', 'YELLOW'])[k % 3 + 1] <> 'GREEN' AS wrong
  FROM det),
heads AS (
  SELECT *, wrong AND NOT coalesce(lag(frame_index) OVER w = frame_index - 1 AND lag(wrong) OVER w,
                                   false) AS head
  FROM judged WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index))
SELECT source_id, stable_id, count(*) AS episodes FROM heads WHERE head GROUP BY 1, 2""",
)
def e16(spark, sf):
    expected = F.element_at(F.array(*map(F.lit, ("RED", "GREEN", "YELLOW"))), (F.col("k") % 3 + 1).cast("int"))
    det = detections(spark, sf).select(
        *KEY, "frame_index", expected.alias("expected"), F.col("state").alias("predicted")
    )
    return R.false_episodes(det, "GREEN", keys=KEY).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("episodes")
    )


@query(
    "e17_duplicate_transitions",
    """
linked AS (
  SELECT source_id, stable_id, frame_index, state,
         lag(state) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index, event_id) AS before
  FROM det)
SELECT source_id, stable_id, frame_index, state AS current_state
FROM linked WHERE before = state""",
)
def e17(spark, sf):
    det = detections(spark, sf).select(
        *KEY, "frame_index", F.col("event_id").alias("seq"), F.col("state").alias("current_state")
    )
    return R.duplicate_transitions(det).drop("seq")


INTERVALS_SQL = """
intervals AS (
  SELECT source_id, stable_id, u AS object_pos, event_id AS interval_pos,
         frame_index AS start_frame, frame_index + k % 4 AS end_frame, state
  FROM det WHERE event_id % 2 = 0)
"""


def intervals(det):
    """Labelled intervals: the observations with even event ids."""
    return det.filter("event_id % 2 = 0").select(
        *KEY,
        F.col("u").alias("object_pos"),
        F.col("event_id").alias("interval_pos"),
        F.col("frame_index").alias("start_frame"),
        (F.col("frame_index") + F.col("k") % 4).alias("end_frame"),
        "state",
    )


@query(
    "e18_derived_changes",
    INTERVALS_SQL
    + """,
linked AS (
  SELECT *, lag(state) OVER (PARTITION BY source_id, stable_id
                             ORDER BY start_frame, end_frame, state) AS before
  FROM intervals)
SELECT source_id, stable_id, start_frame, state FROM linked WHERE before <> state""",
)
def e18(spark, sf):
    changes = R.derived_changes(intervals(detections(spark, sf)), "state", keys=KEY)
    return changes.select(*KEY, "start_frame", "state")


@query(
    "e19_labels_by_frame",
    INTERVALS_SQL
    + """,
labelled AS (
  SELECT source_id, state, object_pos, interval_pos,
         unnest(generate_series(start_frame, end_frame)) AS frame_index
  FROM intervals)
SELECT source_id, frame_index, state FROM labelled
QUALIFY row_number() OVER (PARTITION BY source_id, frame_index
                           ORDER BY object_pos DESC, interval_pos DESC) = 1""",
)
def e19(spark, sf):
    return R.labels_by_frame(intervals(detections(spark, sf)))


@query(
    "e20_recent_events",
    """
clock AS (SELECT source_id, max(frame_index) * 500 AS now_ms FROM det GROUP BY 1),
newest AS (
  SELECT source_id, event_id, event_type, frame_index * 500 AS added_at_ms FROM det
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY frame_index DESC, event_id DESC) <= 20)
SELECT source_id, event_id, event_type,
       CAST(greatest(0, round_even((now_ms - added_at_ms) / 1000.0, 0)) AS BIGINT) AS seconds_ago
FROM newest JOIN clock USING (source_id) WHERE now_ms - added_at_ms <= 5000""",
)
def e20(spark, sf):
    from trackloom.functions.classes import seconds_ago

    det = detections(spark, sf).select(
        "source_id", "event_id", "event_type", (F.col("frame_index") * 500).alias("added_at_ms")
    )
    now = det.groupBy("source_id").agg(F.max("added_at_ms").alias("now_ms"))
    kept = R.recent(det, now=now, count=20, ttl_ms=5000, keys=["source_id"], tie=["event_id"])
    return kept.select(
        "source_id",
        "event_id",
        "event_type",
        seconds_ago(F.col("now_ms"), F.col("added_at_ms")).alias("seconds_ago"),
    )


@query(
    "e21_processing_fps",
    """
done AS (SELECT u, event_id, CAST(us AS DOUBLE) / 1000000 AS completed_s FROM ev),
rated AS (
  SELECT u, event_id, completed_s, first_value(completed_s) OVER w AS opened, count(*) OVER w AS n
  FROM done WINDOW w AS (PARTITION BY u ORDER BY completed_s, event_id
                         ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT u, event_id,
       round(coalesce((n - 1) / nullif(completed_s - opened, 0), 0.0), 9) AS processing_fps
FROM rated""",
)
def e21(spark, sf):
    done = events(spark, sf).select("u", "event_id", (F.col("us") / 1e6).alias("completed_s"))
    rated = R.processing_fps(done, keys=["u"], order=["completed_s", "event_id"])
    return rated.select("u", "event_id", F.round("processing_fps", 9).alias("processing_fps"))


@query(
    "e22_cadence",
    """
marked AS (
  SELECT source_id, stable_id, frame_index,
         CASE WHEN lag(frame_index) OVER w = frame_index - 1 THEN 0 ELSE 1 END AS head
  FROM det WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY frame_index)),
islands AS (
  SELECT *, sum(head) OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS island
  FROM marked)
SELECT source_id, stable_id, frame_index FROM islands
QUALIFY (frame_index - min(frame_index) OVER (PARTITION BY source_id, stable_id, island)) % 3 = 0""",
)
def e22_cadence(spark, sf):
    return R.cadence_due(detections(spark, sf).select(*KEY, "frame_index"), 3)


@query(
    "e22_greedy_throttle",
    """
numbered AS (
  SELECT u, event_id, us, row_number() OVER (PARTITION BY u ORDER BY us, event_id) AS n FROM ev),
chain AS (
  WITH RECURSIVE hop AS (
    SELECT u, event_id, us FROM numbered WHERE n = 1
    UNION ALL
    SELECT h.u, nxt.event_id, nxt.us
    FROM hop h, LATERAL (
      SELECT event_id, us FROM ev WHERE ev.u = h.u AND ev.us - h.us >= 36000000000
      ORDER BY us, event_id LIMIT 1) nxt)
  SELECT * FROM hop)
SELECT u, event_id FROM chain""",
)
def e22(spark, sf):
    rows = events(spark, sf).select("u", "us", "event_id")
    passed = throttle(rows, ["u"], ["us", "event_id"], 36_000_000_000, span=500_000_000_000)
    return passed.select("u", "event_id")


@query(
    "e24_file_clock",
    """
best AS (SELECT source_id, frame_index, max(k) AS k FROM det GROUP BY ALL),
raw AS (
  SELECT source_id, frame_index, frame_index / 25::DOUBLE AS nominal,
         CASE WHEN k % 9 <> 0 AND ((frame_index - k % 4) > 0 OR (frame_index = 0 AND k % 4 = 0))
              THEN (frame_index - k % 4) * 40 / 1000::DOUBLE END AS p,
         row_number() OVER (PARTITION BY source_id ORDER BY frame_index) AS n FROM best),
walk AS (
  WITH RECURSIVE w AS (
    SELECT source_id, frame_index, n, greatest(0, coalesce(p, nominal)) AS told, FALSE AS repaired FROM raw WHERE n = 1
    UNION ALL
    SELECT r.source_id, r.frame_index, r.n,
           CASE WHEN r.p > w.told THEN r.p WHEN r.p IS NULL OR r.frame_index = 0 THEN greatest(w.told, r.nominal)
                ELSE greatest(r.nominal, w.told + 1 / 25::DOUBLE) END,
           r.p IS NOT NULL AND r.p <= w.told AND r.frame_index > 0
    FROM w JOIN raw r ON r.source_id = w.source_id AND r.n = w.n + 1)
  SELECT * FROM w)
SELECT source_id, frame_index, told AS timestamp_s, repaired FROM walk""",
)
def e24(spark, sf):
    """Positions that stall and step back are repaired to a clock that never does."""
    det = detections(spark, sf)
    per_frame = det.groupBy("source_id", "frame_index").agg(F.max("k").alias("k"))
    raw = per_frame.select(
        "source_id",
        "frame_index",
        F.when(F.col("k") % 9 != 0, (F.col("frame_index") - F.col("k") % 4) * 40.0).alias(
            "position_ms"
        ),
        F.lit(25.0).alias("fps"),
    )
    return file_clock(raw, span=1024)


@query(
    "e24_live_clock",
    """
raw AS (
  SELECT u, us AS seq, CASE WHEN k % 9 <> 0 AND us / 1e6 - k * 3600 >= 0 THEN us / 1e6 - k * 3600 END AS c, us / 1e6 AS received,
         greatest(0, us / 1e6 - lag(us / 1e6) OVER (PARTITION BY u ORDER BY us)) AS spent,
         row_number() OVER (PARTITION BY u ORDER BY us) AS n FROM ev),
walk AS (
  WITH RECURSIVE w AS (
    SELECT u, seq, n, coalesce(c, received) AS told, FALSE AS repaired FROM raw WHERE n = 1
    UNION ALL
    SELECT r.u, r.seq, r.n, CASE WHEN r.c > w.told THEN r.c ELSE w.told + r.spent END, NOT coalesce(r.c > w.told, FALSE)
    FROM w JOIN raw r ON r.u = w.u AND r.n = w.n + 1)
  SELECT * FROM w)
SELECT u, seq, told AS timestamp_s, repaired FROM walk""",
)
def e24_live(spark, sf):
    rows = events(spark, sf).select(
        "u",
        F.col("us").alias("seq"),
        F.when(F.col("k") % 9 != 0, F.col("us") / 1e6 - F.col("k") * 3600).alias("captured_at_s"),
        (F.col("us") / 1e6).alias("received_at_s"),
        (F.col("us") / 1e6 + 0.25).alias("processing_started_at_s"),
    )
    return live_clock(rows, ["u"], ["seq"], span=2**42)


@query(
    "e25_rate_limit",
    """
raw AS (
  SELECT u, us / 3.24e10 AS came, event_id, row_number() OVER (PARTITION BY u ORDER BY us / 3.24e10, event_id) AS n FROM ev),
walk AS (
  WITH RECURSIVE w AS (
    SELECT u, n, event_id, came, TRUE AS accepted, [came] AS held FROM raw WHERE n = 1
    UNION ALL
    SELECT u, n, event_id, came, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, came) ELSE live END
    FROM (SELECT r.u, r.n, r.event_id, r.came, list_filter(w.held, lambda h: r.came - h < 1) AS live
          FROM w JOIN raw r ON r.u = w.u AND r.n = w.n + 1))
  SELECT * FROM w)
SELECT u, event_id AS seq, came AS arrived_s, accepted FROM walk""",
)
def e25(spark, sf):
    """At most two events of a user within any nine hours."""
    rows = events(spark, sf).select(
        "u", (F.col("us") / 3.24e10).alias("arrived_s"), F.col("event_id").alias("seq")
    )
    return fold(rows, ["u"], ["arrived_s", "seq"], RateLimit(2), span=1024)


@query(
    "e26_carry_forward",
    """
SELECT source_id, stable_id, frame_index,
       last_value(CASE WHEN confidence >= 0.7 AND state <> 'UNKNOWN' THEN state END IGNORE NULLS)
         OVER (PARTITION BY source_id, stable_id ORDER BY frame_index) AS last_confirmed
FROM det""",
)
def e26(spark, sf):
    det = detections(spark, sf).select(*KEY, "frame_index", "state", "confidence")
    good = F.when(F.col("confidence") >= 0.7, known_state(F.col("state")))
    carried = carry_last(det, KEY, ["frame_index"], {"last_confirmed": good})
    return carried.select(*KEY, "frame_index", "last_confirmed")
