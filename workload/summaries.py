"""Queries: aggregations over runs, frames, sessions and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import classes as C
from trackloom.functions import fixed
from trackloom.operators import datasets as D
from trackloom.operators import motion as MO
from trackloom.operators import scene as S
from trackloom.operators import scoring as K
from trackloom.operators import screens as SC
from trackloom.operators import summary as SU
from trackloom.plans import evaluation as EV
from workload.joins import BOXES_SQL, labelled_boxes, matched_sql, truth_and_predictions
from workload.registry import query
from workload.scalars import COLOURS_SQL, NAMES_SQL, family_sql, names, norm_sql, sql_analyzer, sql_list
from workload.views import _pick, detections, events, frames, reads, table


@query(
    "d1_run_summary",
    f"""
f AS (SELECT source_id, count(*) AS frames FROM frames GROUP BY 1),
d AS (SELECT source_id, count(*) AS detections,
  count_if(event_type = 'view') AS events, count_if(event_type = 'click') AS analysis_events,
  count_if({norm_sql("class_name")} = 'traffic_light') AS signal_targets,
  count_if({norm_sql("class_name")} = 'traffic_light' AND state = 'RED') AS signal_red,
  count_if({norm_sql("class_name")} = 'traffic_light' AND state = 'UNKNOWN') AS signal_unknown,
  count_if(class_name = 'bus') AS bus_analysis_results,
  count(DISTINCT CASE WHEN class_name = 'bus' THEN frame_index END) AS bus_detection_frames,
  count_if(class_name = 'bus' AND k % 4 = 0) AS motion_approaching,
  string_agg(DISTINCT CASE WHEN class_name = 'bus' AND k % 9 = 0 THEN 'B' || k % 4 END, ','
             ORDER BY CASE WHEN class_name = 'bus' AND k % 9 = 0 THEN 'B' || k % 4 END) AS routes
  FROM det GROUP BY 1)
SELECT source_id, frames, detections, events, analysis_events, signal_targets, signal_red,
       signal_unknown, bus_analysis_results, bus_detection_frames, motion_approaching,
       coalesce(routes, '') AS routes
FROM d JOIN f USING (source_id)""",
)
def d1(spark, sf):
    det = detections(spark, sf)
    token = C.norm_class(F.col("class_name"))
    motion = _pick(("approaching", "STOPPED", " receding", "?"), F.col("k") % 4)
    parts = {
        "frame": frames(det),
        "detection": det,
        "legacy_event": det.filter("event_type = 'view'"),
        "event": det.filter("event_type = 'click'"),
        "signal_target": det.filter(token == "traffic_light"),
        "analysis": det.filter("class_name = 'bus'").select(
            "source_id",
            "frame_index",
            F.lit("bus").alias("object_type"),
            motion.alias("state"),
            F.when(
                F.col("k") % 9 == 0, F.concat(F.lit("B"), (F.col("k") % 4).cast("string"))
            ).alias("route_number"),
        ),
    }
    totals = SU.run_summary(SU.stack_run(parts))
    return totals.select(
        "source_id",
        "frames",
        "detections",
        "events",
        "analysis_events",
        "signal_targets",
        F.col("signal_RED").alias("signal_red"),
        F.col("signal_UNKNOWN").alias("signal_unknown"),
        "bus_analysis_results",
        "bus_detection_frames",
        F.col("motion_APPROACHING").alias("motion_approaching"),
        F.array_join("bus_route_numbers", ",").alias("routes"),
    )


@query(
    "d2_performance",
    """
f AS (SELECT source_id, count(*) AS frames, max(timestamp_s) AS last_s, avg(k) AS ms FROM det GROUP BY 1),
r AS (SELECT *, CASE WHEN last_s > 0 THEN last_s ELSE frames / 30.0::DOUBLE END AS dur,
             CASE WHEN source_id % 3 = 0 THEN 0 ELSE (source_id + 1) * 2.5::DOUBLE END AS elapsed FROM f)
SELECT source_id, frames, round_even(dur, 3) AS video_duration_s, round_even(elapsed, 3) AS elapsed_s,
       round_even(coalesce(frames / nullif(elapsed, 0), 0), 3) AS effective_fps,
       round_even(coalesce(elapsed / nullif(dur, 0), 0), 3) AS realtime_factor,
       round_even(ms, 3) AS average_inference_ms FROM r""",
)
def d2(spark, sf):
    det = detections(spark, sf)
    runs = det.select("source_id").distinct().select(
        "source_id",
        F.lit(30.0).alias("source_fps"),
        F.when(F.col("source_id") % 3 == 0, 0.0)
        .otherwise((F.col("source_id") + 1) * 2.5)
        .alias("elapsed_s"),
    )
    rows = det.select("source_id", "timestamp_s", F.col("k").cast("double").alias("inference_ms"))
    return SU.performance_summary(rows, runs)


@query(
    "d3_routing_counts",
    f"""
named AS (SELECT source_id, class_name, {norm_sql("class_name")} AS object_type,
  CASE WHEN k % 7 = 0 THEN 'CustomAnalyzer' ELSE {sql_analyzer(norm_sql("class_name"))} END AS analyzer
  FROM det),
zero AS (SELECT DISTINCT source_id, a AS item FROM det,
         (VALUES {", ".join(f"('{a}')" for a in fixed.ANALYZER_NAMES.values())}) v(a)),
c AS (SELECT source_id, 'class_name' AS kind, class_name AS item, count(*) AS n FROM named GROUP BY ALL
  UNION ALL SELECT source_id, 'object_type', object_type, count(*) FROM named GROUP BY ALL
  UNION ALL SELECT source_id, 'analyzer', analyzer, count(*) FROM named GROUP BY ALL
  UNION ALL SELECT source_id, 'analyzer', item, 0 FROM zero)
SELECT source_id, kind, item, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL""",
)
def d3(spark, sf):
    det = detections(spark, sf).select(
        "source_id",
        "class_name",
        C.norm_class(F.col("class_name")).alias("object_type"),
        F.when(F.col("k") % 7 == 0, "CustomAnalyzer").alias("analyzer_name"),
    )
    return SU.routing_counts(det)


@query(
    "d4_conversion_stats",
    BOXES_SQL
    + """,
b AS (SELECT boxes.*, class_id, c_custkey // 3 AS img, c_custkey % 50 <> 0 AS fine
      FROM boxes LEFT JOIN classes USING (label)),
kept AS (SELECT img, count_if(class_id IS NOT NULL AND fine) AS kept FROM b GROUP BY 1)
SELECT 'converted_images' AS measure, NULL AS item, count(*) AS n FROM kept
UNION ALL SELECT 'converted_boxes', NULL, CAST(sum(kept) AS BIGINT) FROM kept
UNION ALL SELECT 'empty_images', NULL, count_if(kept = 0) FROM kept
UNION ALL SELECT 'excluded_invalid_boxes', NULL, count_if(class_id IS NOT NULL AND NOT fine) FROM b
UNION ALL SELECT 'source_class', label, count(*) FROM b GROUP BY 2
UNION ALL SELECT 'unknown_label', label, count(*) FROM b WHERE class_id IS NULL GROUP BY 2""",
)
def d4(spark, sf):
    boxes, classes = labelled_boxes(spark, sf)
    key = F.col("c_custkey")
    placed = D.map_labels(boxes, classes).select(
        F.concat(F.lit("i"), F.floor(key / 3).cast("string"), F.lit(".jpg")).alias("name"),
        key.alias("pos"),
        "label",
        "class_id",
        F.lit(10.0).alias("x1"),
        F.lit(10.0).alias("y1"),
        F.when(key % 50 == 0, 10.0).otherwise(30.0).alias("x2"),
        F.lit(40.0).alias("y2"),
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
    )
    converted = D.convert_boxes(placed, val_fraction=0.1)
    images = converted.select("name", "split").distinct()
    return D.conversion_stats(images, converted).filter("measure <> 'split'")


@query(
    "d5_label_census",
    """SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, label LIMIT 24""",
)
def d5(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("label"))
    return D.label_census(parts, "label", limit=24)


@query(
    "d6_duplicate_count",
    """
g AS (SELECT source_id, stable_id, event_type, state, count(*) AS c FROM det GROUP BY ALL)
SELECT source_id, CAST(sum(c - 1) AS BIGINT) AS duplicates FROM g GROUP BY 1""",
)
def d6(spark, sf):
    return K.duplicate_count(detections(spark, sf), ["stable_id", "event_type", "state"])


JUDGED_SQL = """
judged AS (SELECT source_id, frame_index, (['RED', 'GREEN', 'YELLOW', 'OFF'])[k % 4 + 1] AS expected,
                  CASE WHEN k % 10 = 0 THEN 'BLINK' WHEN k % 10 <> 1 THEN state END AS predicted FROM det)
"""


def judged(spark, sf):
    k = F.col("k")
    return detections(spark, sf).select(
        "source_id",
        "frame_index",
        _pick(("RED", "GREEN", "YELLOW", "OFF"), k % 4).alias("expected"),
        F.when(k % 10 == 0, "BLINK").when(k % 10 != 1, F.col("state")).alias("predicted"),
    )


@query(
    "d7_confusion_matrix",
    JUDGED_SQL
    + """,
c AS (SELECT source_id, expected, CASE WHEN predicted IN ('RED', 'GREEN', 'YELLOW') THEN predicted
             ELSE 'UNKNOWN' END AS p FROM judged),
dom AS (SELECT DISTINCT source_id, e FROM det, (VALUES ('RED'), ('GREEN'), ('YELLOW')) v(e))
SELECT dom.source_id, dom.e AS expected, count_if(p = 'RED') AS "RED", count_if(p = 'GREEN') AS "GREEN",
       count_if(p = 'YELLOW') AS "YELLOW", count_if(p = 'UNKNOWN') AS "UNKNOWN"
FROM dom LEFT JOIN c ON c.source_id = dom.source_id AND c.expected = dom.e GROUP BY 1, 2""",
)
def d7(spark, sf):
    return K.confusion_matrix(judged(spark, sf))


@query(
    "d8_accuracy",
    JUDGED_SQL
    + """,
dom AS (SELECT DISTINCT source_id, e FROM det,
        (VALUES ('RED'), ('GREEN'), ('YELLOW'), ('OFF'), ('UNKNOWN')) v(e))
SELECT dom.source_id, dom.e AS state,
       round(count_if(coalesce(predicted, 'UNKNOWN') = expected) / nullif(count(expected), 0), 6) AS accuracy
FROM dom LEFT JOIN judged j ON j.source_id = dom.source_id AND j.expected = dom.e GROUP BY 1, 2
UNION ALL SELECT source_id, 'ALL', round(count_if(coalesce(predicted, 'UNKNOWN') = expected) / count(*), 6)
FROM judged GROUP BY 1""",
)
def d8(spark, sf):
    rows = judged(spark, sf)
    whole = K.accuracy(rows).select("source_id", F.lit("ALL").alias("state"), "accuracy")
    both = K.accuracy_by_state(rows).unionByName(whole)
    return both.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "d9_precision_recall",
    JUDGED_SQL
    + """SELECT source_id, round(count_if(predicted = 'GREEN' AND expected = 'GREEN')
           / nullif(count_if(predicted = 'GREEN'), 0), 6) AS precision,
         round(count_if(predicted = 'GREEN' AND expected = 'GREEN')
           / nullif(count_if(expected = 'GREEN'), 0), 6) AS recall FROM judged GROUP BY 1""",
)
def d9(spark, sf):
    scored = K.binary_precision_recall(judged(spark, sf), "GREEN")
    return scored.select(
        "source_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")
    )


@query(
    "d10_mean_delay",
    matched_sql(3, "source_id, state")
    + """SELECT source_id, count(*) AS matches, avg(predicted_frame - truth_frame) AS delay_frames,
  avg(round((predicted_frame - truth_frame) / 30::DOUBLE * 1000, 3)) AS delay_ms FROM taken GROUP BY 1""",
)
def d10(spark, sf):
    truth, predicted = truth_and_predictions(spark, sf)
    matches = K.match_within(truth, predicted, tolerance=3, keys=["source_id", "state"])
    return EV.mean_delay(matches, fps=30.0)


@query(
    "d11_best_state",
    f"""
r AS (SELECT *, {family_sql("class_name")} AS family FROM det)
SELECT source_id, frame_index, CASE WHEN k % 6 = 0 THEN 'UNKNOWN' ELSE state END AS state FROM r
WHERE family = 'signal'
QUALIFY row_number() OVER (PARTITION BY source_id, frame_index ORDER BY evidence DESC, det_index) = 1""",
)
def d11(spark, sf):
    results = detections(spark, sf).select(
        "source_id",
        "frame_index",
        F.col("class_name").alias("object_type"),
        "state",
        F.col("evidence").alias("confidence"),
        (F.col("k") % 6 == 0).alias("is_uncertain"),
        F.col("det_index").alias("pos"),
    )
    return K.best_state_by_frame(results, "signal")


@query(
    "d12_route_records",
    """
told AS (SELECT source_id, stable_id, frame_index, 'R' || k % 3 AS route_number FROM det
         WHERE class_name = 'bus' AND event_type = 'view' AND source_id % 2 = 0),
kept AS (SELECT source_id, stable_id, frame_index, 'R' || k % 5 AS route_number FROM det WHERE class_name = 'bus'),
both_kinds AS (SELECT * FROM told UNION ALL SELECT * FROM kept
               WHERE source_id NOT IN (SELECT source_id FROM told))
SELECT source_id, stable_id, route_number, min(frame_index) AS frame_index FROM both_kinds GROUP BY 1, 2, 3""",
)
def d12(spark, sf):
    det = detections(spark, sf).filter("class_name = 'bus'")
    facts = [
        F.lit(False).alias("is_uncertain"),
        F.lit(True).alias("route_is_current"),
        F.lit(3).alias("ocr_confirmed_frames"),
        F.lit(0.9).alias("route_confidence"),
        F.lit("bus").alias("object_type"),
        F.col("det_index").alias("pos"),
    ]

    def route(n):
        return F.concat(F.lit("R"), (F.col("k") % n).cast("string")).alias("route_number")

    base = ["source_id", "stable_id", "frame_index"]
    told = det.filter("event_type = 'view' and source_id % 2 = 0").select(
        *base, route(3), F.lit("TEXT_CONFIRMED").alias("event_type"), *facts
    )
    records = K.route_records(told, det.select(*base, route(5), *facts))
    return records.select(*base, "route_number")


PIXELS_SQL = """
px AS (SELECT l_suppkey AS crop_id, l_partkey % 180 AS h, CAST(l_quantity AS BIGINT) * 5 AS s,
              l_orderkey % 256 AS v FROM lineitem)
"""


@query(
    "d13_colour_evidence",
    PIXELS_SQL
    + """SELECT crop_id, count(*) AS pixels,
  round(CASE WHEN count(*) >= 64 THEN count_if((h <= 12 OR h >= 168) AND s >= 90 AND v >= 100) / count(*) ELSE 0 END, 6) AS red_ratio,
  round(CASE WHEN count(*) >= 64 THEN count_if(h BETWEEN 35 AND 100 AND s >= 80 AND v >= 90) / count(*) ELSE 0 END, 6) AS green_ratio,
  round(CASE WHEN count(*) >= 64 THEN count_if(h BETWEEN 18 AND 34 AND s >= 80 AND v >= 100) / count(*) ELSE 0 END, 6) AS yellow_ratio
FROM px GROUP BY 1""",
)
def d13(spark, sf):
    pixels = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("crop_id"),
        (F.col("l_partkey") % 180).alias("h"),
        (F.col("l_quantity").cast("bigint") * 5).alias("s"),
        (F.col("l_orderkey") % 256).alias("v"),
    )
    shares = SU.colour_evidence(pixels)
    return shares.select(
        "crop_id", "pixels", *[F.round(f"{c}_ratio", 6).alias(f"{c}_ratio") for c in ("red", "green", "yellow")]
    )


@query(
    "d14_line_confidence",
    r"""
w AS (SELECT event_id, line_confidence, length(regexp_replace(text, '\s', '', 'g')) AS n FROM reads)
SELECT event_id, round(sum(line_confidence * n) / sum(n), 6) AS ocr_confidence FROM w WHERE n > 0 GROUP BY 1""",
)
def d14(spark, sf):
    lines = reads(detections(spark, sf)).withColumnRenamed("confidence", "detector")
    lines = lines.withColumnRenamed("line_confidence", "confidence")
    scored = SC.line_confidence(lines, ["event_id"])
    return scored.withColumn("ocr_confidence", F.round("ocr_confidence", 6))


@query(
    "d15_route_vote",
    """
tok AS (SELECT event_id, 'N' || (k + pos) % 4 AS route, max(line_confidence) AS c FROM reads
        WHERE line_confidence >= 0.4 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w AS rn, lead(c) OVER w AS second FROM tok
           WINDOW w AS (PARTITION BY event_id ORDER BY c DESC, route))
SELECT event_id, route AS route_number, c AS route_confidence FROM ranked
WHERE rn = 1 AND (second IS NULL OR c - second >= 0.05)""",
)
def d15(spark, sf):
    lines = reads(detections(spark, sf)).filter("line_confidence >= 0.4")
    tokens = lines.select(
        "event_id",
        F.col("line_confidence").alias("confidence"),
        F.concat(F.lit("N"), ((F.col("k") + F.col("pos")) % 4).cast("string")).alias("route"),
    )
    return MO.best_token(tokens, ["event_id"])


@query(
    "d16_latency_percentiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
              round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1""",
)
def d16(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    found = K.interpolated_percentiles(lines, "l_extendedprice", keys=["l_returnflag"])
    return found.select("l_returnflag", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(
    "d17_session_metrics",
    """SELECT o_custkey AS session_id, count(*) AS received, count_if(o_orderstatus = 'F') AS processed,
              count_if(o_orderstatus = 'O') AS dropped, count_if(o_orderstatus = 'P') AS rejected
       FROM orders GROUP BY 1""",
)
def d17(spark, sf):
    status = F.col("o_orderstatus")
    outcome = F.when(status == "F", "processed").when(status == "O", "dropped").otherwise("rejected")
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), outcome.alias("outcome")
    )
    return SU.session_metrics(orders)


@query(
    "d18_scene_confidence",
    """SELECT source_id, frame_index, max(confidence) AS scene_confidence FROM det
       WHERE confidence >= 0.3 GROUP BY 1, 2""",
)
def d18(spark, sf):
    det = detections(spark, sf).filter("confidence >= 0.3")
    return det.groupBy("source_id", "frame_index").agg(F.max("confidence").alias("scene_confidence"))


@query(
    "d19_qualitative_summary",
    f"""
st AS (SELECT source_id, state, count(*) AS n FROM det GROUP BY ALL),
an AS (SELECT DISTINCT source_id, CASE WHEN k % 7 = 0 THEN 'CustomAnalyzer'
              ELSE {sql_analyzer(norm_sql("class_name"))} END AS a FROM det),
rt AS (SELECT DISTINCT source_id, 'R' || k % 3 AS r FROM det WHERE class_name = 'bus' AND k % 2 = 0)
SELECT s.source_id, string_agg(state || '=' || n, ',' ORDER BY state) AS states,
  (SELECT string_agg(a, ',' ORDER BY a) FROM an WHERE an.source_id = s.source_id) AS analyzers,
  (SELECT string_agg(r, ',' ORDER BY r) FROM rt WHERE rt.source_id = s.source_id) AS routes
FROM st s GROUP BY 1""",
)
def d19(spark, sf):
    det = detections(spark, sf)
    results = det.select(
        "source_id",
        "state",
        F.col("class_name").alias("object_type"),
        F.when(F.col("k") % 7 == 0, "CustomAnalyzer").alias("analyzer_name"),
    )
    routes = det.filter("class_name = 'bus' and k % 2 = 0").select(
        "source_id", F.concat(F.lit("R"), (F.col("k") % 3).cast("string")).alias("route_number")
    )
    told = SU.qualitative_summary(results, routes)
    pairs = F.transform("observed_states", lambda x: F.concat(x["state"], F.lit("="), x["n"].cast("string")))
    return told.select(
        "source_id",
        F.array_join(pairs, ",").alias("states"),
        F.array_join("routed_analyzer_types", ",").alias("analyzers"),
        F.array_join("confirmed_route_numbers", ",").alias("routes"),
    )


@query(
    "d20_safety_constraints",
    """
src AS (SELECT DISTINCT source_id, (['signal_yellow_flicker_vertical', 'bus-london pulls in', 'x bus_waiting_multiple_arrivals',
   'kiosk_like_reverse_vending_machine', 'plain'])[source_id % 5 + 1] AS name FROM det),
c AS (SELECT source_id, count_if(state IN ('RED', 'GREEN') AND event_type = 'view') AS red_green,
   count_if(event_type = 'click' AND class_name = 'bus') AS approaches,
   count_if(class_name = 'bus' AND event_type = 'purchase') AS unsupported,
   greatest(count_if(event_type = 'signup' AND class_name = 'bus') - 1, 0) AS dup,
   count_if(event_type = 'error' AND k < 3) AS vending FROM det GROUP BY 1),
r AS (
 SELECT source_id, 'no_confident_red_or_green_transition' AS rule, red_green AS observed, 0 AS maximum FROM src JOIN c USING (source_id) WHERE source_id % 5 = 0
 UNION ALL SELECT source_id, 'at_most_one_bus_approach_narration', approaches, 1 FROM src JOIN c USING (source_id) WHERE source_id % 5 = 1
 UNION ALL SELECT source_id, 'route_number_requires_stable_ocr_evidence', unsupported, 0 FROM src JOIN c USING (source_id) WHERE source_id % 5 IN (1, 2)
 UNION ALL SELECT source_id, 'duplicate_bus_approach_event_limit', dup, 2 FROM src JOIN c USING (source_id) WHERE source_id % 5 = 2
 UNION ALL SELECT source_id, 'do_not_classify_reverse_vending_as_order_kiosk', vending, 0 FROM src JOIN c USING (source_id) WHERE source_id % 5 = 3)
SELECT source_id, rule, observed, CAST(maximum AS BIGINT) AS maximum,
  CASE WHEN observed <= maximum THEN 'PASS' WHEN rule = 'duplicate_bus_approach_event_limit' AND source_id % 2 = 0
       THEN 'NOT_EVALUATED' ELSE 'FAIL' END AS status FROM r""",
)
def d20(spark, sf):
    det = detections(spark, sf)
    bus = F.col("class_name") == "bus"
    kind = F.col("event_type")
    counts = det.groupBy("source_id").agg(
        F.count_if(F.col("state").isin("RED", "GREEN") & (kind == "view")).alias("red_green"),
        F.count_if((kind == "click") & bus).alias("approach_narrations"),
        F.count_if(bus & (kind == "purchase")).alias("unsupported_routes"),
        F.greatest(F.count_if((kind == "signup") & bus) - 1, F.lit(0)).alias("duplicate_approaches"),
        F.count_if((kind == "error") & (F.col("k") < 3)).alias("order_type_ids"),
        F.lit(0).cast("bigint").alias("false_payments"),
    )
    names = (
        "signal_yellow_flicker_vertical",
        "bus-london pulls in",
        "x bus_waiting_multiple_arrivals",
        "kiosk_like_reverse_vending_machine",
        "plain",
    )
    sources = counts.select(
        "source_id",
        _pick(names, F.col("source_id") % 5).alias("video_id"),
        (F.col("source_id") % 2 == 1).alias("is_reviewed"),
        F.lit(2).alias("maximum_duplicate_events"),
    )
    return EV.safety_constraints(sources, counts).filter("status <> 'OBSERVED'").select(
        "source_id", "rule", "observed", "maximum", "status"
    )


@query(
    "d21_evaluation_summary",
    """SELECT count(*) AS video_count, count_if(coalesce(quality = 1, false)) AS quantitatively_evaluated,
              count_if(NOT coalesce(quality = 1, false)) AS qualitative_only,
              count_if(lang = 'fr') AS failed FROM documents LEFT JOIN labels USING (doc_id)""",
)
def d21(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return SU.evaluation_summary(
        docs.select(
            (F.col("quality") == 1).alias("quantitative"),
            F.when(F.col("lang") == "fr", "failed").otherwise("ok").alias("status"),
        )
    )


@query(
    "d22_ids_per_family",
    f"""
fam AS (SELECT source_id, stable_id, {family_sql(NAMES_SQL)} AS family FROM det)
SELECT source_id, family, count(DISTINCT stable_id) AS ids FROM fam GROUP BY 1, 2""",
)
def d22(spark, sf):
    return SU.ids_per_family(detections(spark, sf).withColumn("class_name", names()))


@query(
    "d23_visible_text",
    """
l AS (SELECT event_id, trim(text) AS t, row_number() OVER (PARTITION BY event_id ORDER BY pos) AS rn
      FROM reads WHERE trim(text) <> '')
SELECT event_id, string_agg(t, ' / ' ORDER BY rn) AS shown FROM l WHERE rn <= 5 GROUP BY 1""",
)
def d23(spark, sf):
    from workload.scalars import screens

    nothing = F.lit(None).cast("string")
    shown = S.visible_text(nothing, nothing, F.col("lines"))
    return screens(spark, sf).select("event_id", shown.alias("shown"))


# --- top-k and first-of-each ----------------------------------------------------------


@query(
    "f1_top_visible",
    f"""
n AS (SELECT *, lower(replace(trim(class_name), ' ', '_')) AS t FROM det),
imp AS (SELECT *, CASE WHEN contains(t, 'signal') OR contains(t, 'traffic_light') THEN 5
   WHEN t IN ({sql_list(fixed.IMPORTANT_VEHICLES)}) THEN 4 WHEN t IN ({sql_list(fixed.IMPORTANT_LIVING)}) THEN 3
   WHEN contains(t, 'kiosk') OR contains(t, 'sign') OR contains(t, 'panel') THEN 2 ELSE 1 END AS importance
   FROM n WHERE (state <> 'UNKNOWN' OR confidence >= 0.3)
     AND NOT (t = 'person' AND y1 >= 264 AND y2 >= 456))
SELECT event_id, row_number() OVER (PARTITION BY source_id, frame_index
   ORDER BY importance DESC, state <> 'UNKNOWN' DESC, confidence DESC, det_index) AS rank FROM imp
QUALIFY rank <= 3""",
)
def f1(spark, sf):
    det = detections(spark, sf).select(
        "*", (F.col("k") % 2 == 0).alias("is_uncertain"), F.lit(None).cast("string").alias("text")
    )
    top = S.visible_objects(det, frame_width=640.0, frame_height=480.0, limit=3)
    return top.select("event_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "f2_select_narration",
    """
spoken2 AS (SELECT source_id, frame_index, event_id, k % 8 AS priority FROM det WHERE evidence >= 0.5)
SELECT event_id FROM spoken2
QUALIFY row_number() OVER (PARTITION BY source_id, frame_index ORDER BY priority, event_id) = 1""",
)
def f2(spark, sf):
    from trackloom.operators.narration import select_best

    said = detections(spark, sf).filter("evidence >= 0.5").withColumn("priority", F.col("k") % 8)
    best = select_best(said, batch=["source_id", "frame_index"], order="event_id")
    return best.select("event_id")


@query(
    "f3_representative",
    """
tier AS (SELECT *, u % 2 AS grp, CASE WHEN (y2 - y1) / (x2 - x1) BETWEEN 1.5 AND 2.3 THEN 1 ELSE 0 END AS t,
         (x2 - x1) * (y2 - y1) AS area FROM det)
SELECT source_id, frame_index, grp, det_index, confidence FROM tier
QUALIFY row_number() OVER (PARTITION BY source_id, frame_index, grp
   ORDER BY t DESC, confidence DESC, area DESC, det_index) = 1""",
)
def f3(spark, sf):
    from trackloom.operators.tracks import representative_per_group

    det = detections(spark, sf).withColumn("grp", F.col("u") % 2)
    return representative_per_group(det, ["source_id", "frame_index", "grp"])


@query(
    "f4_most_urgent_first",
    """
risk AS (SELECT source_id, frame_index, stable_id, CAST(k AS DOUBLE) / 10 AS ttc FROM det)
SELECT source_id, frame_index, stable_id, row_number() OVER (PARTITION BY source_id, frame_index
  ORDER BY ttc, stable_id) AS urgency_rank FROM risk""",
)
def f4(spark, sf):
    from trackloom.operators.tracks import most_urgent_first

    risk = detections(spark, sf).select(
        "source_id", "frame_index", "stable_id", (F.col("k") / 10.0).alias("time_to_contact_s")
    )
    ranked = most_urgent_first(risk)
    return ranked.select(
        "source_id", "frame_index", "stable_id", F.col("urgency_rank").cast("bigint").alias("urgency_rank")
    )


@query(
    "f5_sharpest_recent",
    """
n AS (SELECT u, event_id, us // 1000 AS ms, value,
             row_number() OVER (PARTITION BY u ORDER BY us // 1000 DESC, event_id DESC) AS rn,
             max(us // 1000) OVER (PARTITION BY u) AS last_ms FROM ev)
SELECT u AS session_id, event_id AS sequence_id FROM n WHERE rn <= 3 AND last_ms - ms <= 50000000
QUALIFY row_number() OVER (PARTITION BY u ORDER BY value DESC, ms DESC, event_id DESC) = 1""",
)
def f5(spark, sf):
    buffered = events(spark, sf).select(
        F.col("u").alias("session_id"),
        F.col("event_id").alias("sequence_id"),
        F.floor(F.col("us") / 1000).cast("bigint").alias("received_at_ms"),
        F.col("value").alias("sharpness"),
    )
    best = S.sharpest_recent(buffered, window_ms=50_000_000)
    return best.select("session_id", "sequence_id")


@query(
    "f6_even_sample",
    """
src AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
pick AS (SELECT user_id, CAST(round_even(i * (n - 1) / 11.0::DOUBLE, 0) AS BIGINT) AS frame_index
         FROM src, (SELECT unnest(range(12)) AS i) WHERE n > 12
         UNION ALL SELECT user_id, unnest(range(n)) FROM src WHERE n <= 12)
SELECT DISTINCT user_id, frame_index FROM pick""",
)
def f6(spark, sf):
    sources = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("frame_count"))
    return D.even_sample(sources, 12).select("user_id", "frame_index")


@query(
    "f7_latest_sessions",
    """SELECT user_id AS session_id FROM events GROUP BY 1 ORDER BY max(epoch_us(ts)) DESC, 1 DESC LIMIT 64""",
)
def f7(spark, sf):
    sessions = (
        events(spark, sf)
        .groupBy(F.col("u").alias("session_id"))
        .agg(F.max("us").alias("updated_at_ms"))
    )
    return S.keep_latest_sessions(sessions, 64).select("session_id")


@query(
    "f8_ring_buffer",
    """
clock AS (SELECT max(us) AS now_us FROM ev),
n AS (SELECT u, event_id, us, row_number() OVER (PARTITION BY u ORDER BY us DESC, event_id DESC) AS rn FROM ev)
SELECT u AS session_id, event_id AS sequence_id FROM n, clock
WHERE rn <= 5 AND now_us - us <= 86400000000""",
)
def f8(spark, sf):
    frames_ = events(spark, sf).select(
        F.col("u").alias("session_id"), F.col("event_id").alias("sequence_id"), F.col("us").alias("received_at_ms")
    )
    newest = S.ring_buffer(frames_, count=5)
    # the clock is one value: the latest time of the whole stream
    now = frames_.agg(F.max("received_at_ms").alias("now_ms"))
    kept = newest.join(F.broadcast(now)).filter("now_ms - received_at_ms <= 86400000000")
    return kept.select("session_id", "sequence_id")


@query(
    "f9_first_occurrence",
    """SELECT source_id, text, min(event_id * 10 + pos) AS first_seen FROM reads GROUP BY 1, 2""",
)
def f9(spark, sf):
    lines = reads(detections(spark, sf)).select(
        "source_id", "text", (F.col("event_id") * 10 + F.col("pos")).alias("seq")
    )
    first = D.first_occurrence(
        lines.withColumn("first_seen", F.col("seq")), ["text"], "seq", within=["source_id"]
    )
    return first.select("source_id", "text", "first_seen")


# --- sets --------------------------------------------------------------------------------


@query(
    "g1_union_event_streams",
    """SELECT source_id, frame_index, 0 AS phase, 'HAZARD_DETECTED' AS event_type, k AS urgency FROM det
       UNION ALL SELECT source_id, frame_index, 1, upper(event_type), NULL FROM det WHERE event_type = 'click'""",
)
def g1(spark, sf):
    det = detections(spark, sf)
    hazards = det.select(
        "source_id", "frame_index", F.lit(0).alias("phase"), F.lit("HAZARD_DETECTED").alias("event_type"), F.col("k").alias("urgency")
    )
    others = det.filter("event_type = 'click'").select(
        "source_id", "frame_index", F.lit(1).alias("phase"), F.upper("event_type").alias("event_type")
    )
    return hazards.unionByName(others, allowMissingColumns=True)


@query(
    "g2_intersect_frames",
    """SELECT source_id, frame_index FROM det WHERE event_type = 'view'
       INTERSECT SELECT source_id, frame_index FROM det WHERE state = 'RED'""",
)
def g2(spark, sf):
    det = detections(spark, sf)
    seen = det.filter("event_type = 'view'").select("source_id", "frame_index")
    return seen.intersect(det.filter("state = 'RED'").select("source_id", "frame_index"))


@query(
    "g3_multiset_intersect",
    """
i AS (SELECT source_id, 'R' || k % 5 AS route FROM det WHERE event_type = 'view'
      INTERSECT ALL SELECT source_id, 'R' || k % 5 FROM det WHERE event_type = 'click')
SELECT source_id, count(*) AS matched FROM i GROUP BY 1""",
)
def g3(spark, sf):
    route = F.concat(F.lit("R"), (F.col("k") % 5).cast("string")).alias("route")
    det = detections(spark, sf)
    expected = det.filter("event_type = 'view'").select("source_id", route)
    predicted = det.filter("event_type = 'click'").select("source_id", route)
    return EV.multiset_matches(expected, predicted, ["source_id", "route"]).groupBy("source_id").agg(
        F.sum("matched").alias("matched")
    )


@query(
    "g4_except",
    """SELECT source_id, stable_id, frame_index + 1 AS frame_index FROM det
       EXCEPT ALL SELECT source_id, stable_id, frame_index FROM det""",
)
def g4(spark, sf):
    """Objects of a frame that are gone in the next one."""
    det = detections(spark, sf).select("source_id", "stable_id", "frame_index")
    return det.withColumn("frame_index", F.col("frame_index") + 1).exceptAll(det)


@query(
    "g5_set_equality",
    """
a AS (SELECT DISTINCT source_id, state FROM det WHERE event_id % 2 = 0),
b AS (SELECT DISTINCT source_id, state FROM det WHERE event_id % 2 = 1 AND k > 20)
SELECT s.source_id, NOT EXISTS (SELECT 1 FROM a ANTI JOIN b ON a.source_id = b.source_id AND a.state = b.state WHERE a.source_id = s.source_id)
   AND NOT EXISTS (SELECT 1 FROM b ANTI JOIN a ON a.source_id = b.source_id AND a.state = b.state WHERE b.source_id = s.source_id) AS equal
FROM (SELECT DISTINCT source_id FROM det) s""",
)
def g5(spark, sf):
    det = detections(spark, sf)
    return EV.sets_equal(
        det.filter("event_id % 2 = 0").select("source_id", "state"),
        det.filter("event_id % 2 = 1 and k > 20").select("source_id", "state"),
        "state",
    )


@query(
    "g6_distinct_events",
    """SELECT count(*) AS kept FROM (SELECT DISTINCT source_id, stable_id, event_type, state, frame_index // 4 FROM det)""",
)
def g6(spark, sf):
    told = detections(spark, sf).select(
        "source_id",
        "stable_id",
        "event_type",
        F.lit(None).cast("string").alias("previous_state"),
        F.col("state").alias("current_state"),
        F.floor(F.col("frame_index") / 4).alias("frame_index"),
        *[F.lit(None).cast("string").alias(a) for a in ("route_number", "text", "description", "screen_fingerprint")],
        F.array(F.lit("a"), F.lit("b")).alias("visible_options"),
    )
    return S.distinct_events(told).agg(F.count(F.lit(1)).alias("kept"))


@query(
    "g7_prefer_primary",
    """
new AS (SELECT source_id, frame_index, event_id FROM det WHERE event_type IN ('view', 'click')),
old AS (SELECT source_id, frame_index, event_id FROM det WHERE event_type = 'error')
SELECT * FROM new UNION ALL SELECT * FROM old
WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.source_id = old.source_id AND new.frame_index = old.frame_index)""",
)
def g7(spark, sf):
    det = detections(spark, sf).select("source_id", "frame_index", "event_id", "event_type")
    new = det.filter("event_type in ('view', 'click')").drop("event_type")
    old = det.filter("event_type = 'error'").drop("event_type")
    return EV.prefer_primary(new, old)
