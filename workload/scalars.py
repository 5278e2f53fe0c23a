"""Queries: column functions for names, states, boxes and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import classes as C
from trackloom.functions import geometry as G
from trackloom.functions import messages as M
from trackloom.functions import text as X
from trackloom.functions import vectorized as V
from trackloom.functions import fixed
from workload.registry import query
from workload.views import FRAME_HEIGHT, FRAME_WIDTH, _pick, detections, reads, table

W, H = FRAME_WIDTH, FRAME_HEIGHT
NAMES = (
    "City Bus",
    "vehicle-signal",
    "Ticket  machine",
    "traffic light",
    "my_bus",
    "Info screen",
    "dog",
    " BUS ",
)
NAMES_SQL = "([" + ", ".join(f"'{n}'" for n in NAMES) + "])[k % 8 + 1]"
RAW_STATES = ("red", " Green ", "", "unknown", "None", "APPROACHING", "uncertain", "Off")
RAW_STATES_SQL = "([" + ", ".join(f"'{n}'" for n in RAW_STATES) + "])[k % 8 + 1]"
SIGNALS = ", ".join(f"'{n}'" for n in fixed.SIGNAL_TYPES)


def names():
    return _pick(NAMES, F.col("k") % 8)


def sql_list(values):
    return ", ".join(f"'{v}'" for v in values)


def sql_any(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def token_sql(x):
    return rf"regexp_replace(trim(replace(lower(trim({x})), '-', ' ')), '\s+', '_', 'g')"


def family_sql(x):
    t = token_sql(x)
    return f"""CASE WHEN {t} IN ({sql_list(fixed.FAMILY_SIGNAL_TYPES)}) OR contains({t}, 'signal')
          THEN 'signal'
          WHEN {t} = 'bus' OR suffix({t}, '_bus') THEN 'bus'
          WHEN {t} IN ({sql_list(fixed.FAMILY_KIOSK_TYPES)})
            OR {sql_any(t, fixed.FAMILY_KIOSK_WORDS)} THEN 'kiosk'
          ELSE {t} END"""


def norm_sql(x):
    return rf"regexp_replace(lower(trim({x})), '[\s-]+', '_', 'g')"


def sql_analyzer(x):
    kinds = {}
    for cls, kind, _ in fixed.CLASS_SPECS:
        kinds.setdefault(kind, []).append(cls)
    whens = " ".join(
        f"WHEN {x} IN ({sql_list(kinds[k])}) THEN '{fixed.ANALYZER_NAMES[k]}'"
        for k in ("traffic_light", "bus", "kiosk", "text")
    )
    return f"CASE {whens} ELSE 'GenericVisionAnalyzer' END"


@query(
    "b1_norm_class",
    rf"""SELECT p_partkey, {norm_sql("'  ' || p_name || ' - ' || p_brand || ' '")} AS class_token
         FROM part""",
)
def b1(spark, sf):
    raw = F.concat(F.lit("  "), "p_name", F.lit(" - "), "p_brand", F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", C.norm_class(raw).alias("class_token"))


@query(
    "b2_object_family",
    f"SELECT event_id, {family_sql(NAMES_SQL)} AS family FROM det",
)
def b2(spark, sf):
    return detections(spark, sf).select("event_id", C.object_family(names()).alias("family"))


CATEGORIES = ("traffic light crossing", "Bus stop", "kiosk like machine", "park")
CATEGORIES_SQL = "([" + sql_list(CATEGORIES) + "])[source_id % 4 + 1]"


@query(
    "b3_annotation_families",
    f"""
parts AS (
  SELECT source_id, {family_sql(NAMES_SQL)} AS family FROM det
  UNION
  SELECT source_id, 'signal' FROM det
  WHERE {sql_any(token_sql(CATEGORIES_SQL), fixed.CATEGORY_SIGNAL_WORDS)}
  UNION
  SELECT source_id, 'bus' FROM det WHERE contains({token_sql(CATEGORIES_SQL)}, 'bus')
  UNION
  SELECT source_id, 'kiosk' FROM det
  WHERE {sql_any(token_sql(CATEGORIES_SQL), fixed.CATEGORY_KIOSK_WORDS)})
SELECT source_id, string_agg(family, ',' ORDER BY family) AS families FROM parts GROUP BY 1""",
)
def b3(spark, sf):
    det = detections(spark, sf)
    category = _pick(CATEGORIES, F.col("source_id") % 4)
    own = det.groupBy("source_id").agg(F.collect_set(C.object_family(names())).alias("own"))
    everything = F.array_union("own", C.category_families(category))
    return own.select("source_id", F.array_join(F.array_sort(everything), ",").alias("families"))


@query(
    "b4_norm_state",
    f"""
raw AS (SELECT event_id, upper(trim({RAW_STATES_SQL})) AS s FROM det)
SELECT event_id, CASE WHEN s = '' THEN 'UNKNOWN' ELSE s END AS scored_state,
       CASE WHEN s NOT IN ('', 'UNKNOWN', 'UNCERTAIN', 'NONE') THEN s END AS known_state
FROM raw""",
)
def b4(spark, sf):
    raw = _pick(RAW_STATES, F.col("k") % 8)
    return detections(spark, sf).select(
        "event_id", C.norm_state(raw).alias("scored_state"), C.known_state(raw).alias("known_state")
    )


CATEGORY_IDS = ("Traffic Light", "bus!", "kiosk-like machine", "elsewhere")
CATEGORY_IDS_SQL = "([" + sql_list(CATEGORY_IDS) + "])[source_id % 4 + 1]"


@query(
    "b5_class_filter_by_category",
    f"""
named AS (
  SELECT det.*, trim(regexp_replace(lower(trim({CATEGORY_IDS_SQL})), '[^a-z0-9]+', '_', 'g'), '_')
         AS category FROM det)
SELECT event_id, category, class_id FROM named
WHERE CASE category WHEN 'traffic_light' THEN class_id = 9 WHEN 'bus' THEN class_id = 5
      ELSE true END""",
)
def b5(spark, sf):
    from trackloom.operators.datasets import class_filter

    det = detections(spark, sf).withColumn(
        "category", C.category_token(_pick(CATEGORY_IDS, F.col("source_id") % 4))
    )
    return class_filter(det).select("event_id", "category", "class_id")


@query(
    "b6_confidence_gates",
    """SELECT event_id, CASE WHEN confidence >= 0.2 THEN state ELSE 'UNKNOWN' END AS signal_state,
              CASE WHEN confidence >= 0.3 THEN state ELSE 'UNKNOWN' END AS bus_state,
              CASE WHEN confidence >= 0.5 THEN state ELSE 'UNKNOWN' END AS kiosk_state FROM det""",
)
def b6(spark, sf):
    gate = [
        C.gated_state(F.col("state"), F.col("confidence"), t).alias(n)
        for n, t in (("signal_state", 0.2), ("bus_state", 0.3), ("kiosk_state", 0.5))
    ]
    return detections(spark, sf).select("event_id", *gate)


@query(
    "b7_box_checks",
    """
boxed AS (SELECT event_id, x1, y1, CASE WHEN k % 11 = 0 THEN 'nan'::DOUBLE
                 WHEN k % 13 = 0 THEN x1 ELSE x2 END AS x2, y2 FROM det)
SELECT event_id, NOT isnan(x2) AND x2 > x1 AND y2 > y1 AS is_valid,
       CASE WHEN NOT isnan(x2) AND x2 > x1 THEN round((y2 - y1) / (x2 - x1), 6) END AS aspect,
       CASE WHEN NOT isnan(x2) AND x2 > x1 AND y2 > y1 THEN (x2 - x1) * (y2 - y1) END AS area
FROM boxed""",
)
def b7(spark, sf):
    x2 = (
        F.when(F.col("k") % 11 == 0, F.lit(float("nan")))
        .when(F.col("k") % 13 == 0, F.col("x1"))
        .otherwise(F.col("x2"))
    )
    det = detections(spark, sf).withColumn("x2", x2)
    valid = G.valid_box("x1", "y1", "x2", "y2")
    box = ("x1", "y1", "x2", "y2")
    return det.select(
        "event_id",
        valid.alias("is_valid"),
        F.when(valid, F.round(G.aspect_ratio(*box), 6)).alias("aspect"),
        F.when(valid, G.box_area(*box)).alias("area"),
    )


@query(
    "b8_clamp_crop",
    """
moved AS (SELECT event_id, x1 - 250.5 AS a, y1 - 150.25 AS b, x2 - 250.5 AS c, y2 - 150.25 AS d
          FROM det),
edges AS (
  SELECT event_id, greatest(0, least(640, floor(a))) AS l, greatest(0, least(480, floor(b))) AS t,
         greatest(0, least(640, ceil(c))) AS r, greatest(0, least(480, ceil(d))) AS btm FROM moved)
SELECT event_id, CAST(l AS BIGINT) AS crop_left, CAST(t AS BIGINT) AS crop_top,
       CAST(r AS BIGINT) AS crop_right, CAST(btm AS BIGINT) AS crop_bottom
FROM edges WHERE r > l AND btm > t""",
)
def b8(spark, sf):
    shifted = [F.col("x1") - 250.5, F.col("y1") - 150.25, F.col("x2") - 250.5, F.col("y2") - 150.25]
    crop = G.clamp_crop(*shifted, F.lit(W), F.lit(H))
    return (
        detections(spark, sf)
        .select("event_id", crop.alias("crop"))
        .filter("crop is not null")
        .select(
            "event_id",
            *[F.col(f"crop.{e}").alias(f"crop_{e}") for e in ("left", "top", "right", "bottom")],
        )
    )


@query(
    "b9_roi_box",
    """
crop AS (SELECT event_id, CAST(x2 - x1 AS BIGINT) AS w, CAST(y2 - y1 AS BIGINT) AS h FROM det)
SELECT event_id, CAST(floor(w * 0.08::DOUBLE) AS BIGINT) AS roi_left, CAST(0 AS BIGINT) AS roi_top,
       CAST(ceil(w * 0.92::DOUBLE - 1e-9::DOUBLE) AS BIGINT) AS roi_right,
       CAST(ceil(h * 0.55::DOUBLE - 1e-9::DOUBLE) AS BIGINT) AS roi_bottom
FROM crop""",
)
def b9(spark, sf):
    w, h = (F.col("x2") - F.col("x1")).cast("bigint"), (F.col("y2") - F.col("y1")).cast("bigint")
    roi = G.roi_box(w, h)
    return (
        detections(spark, sf)
        .select("event_id", roi.alias("roi"))
        .select(
            "event_id",
            *[F.col(f"roi.{e}").alias(f"roi_{e}") for e in ("left", "top", "right", "bottom")],
        )
    )


@query(
    "b10_own_body",
    """SELECT event_id FROM det WHERE NOT (lower(trim(class_name)) = 'person'
         AND y1 + 100 >= 480 * 0.55::DOUBLE AND y2 + 100 >= 480 * 0.95::DOUBLE)""",
)
def b10(spark, sf):
    own = G.is_own_body(F.col("class_name"), F.col("y1") + 100, F.col("y2") + 100, F.lit(H))
    return detections(spark, sf).filter(~own).select("event_id")


@query(
    "b12_frame_messages",
    """
msg AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN -1 ELSE event_id END AS sequence_id,
               CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN -5.0 ELSE value END AS captured,
               k * 40 AS w, k * 30 AS h, k * 3000 AS bytes FROM ev)
SELECT event_id, CASE WHEN sequence_id < 0 THEN 'INVALID_SEQUENCE_ID'
                 WHEN captured < 0 THEN 'INVALID_CAPTURE_TIME'
                 WHEN bytes > 250000 THEN 'FRAME_TOO_LARGE'
                 WHEN w > 3840 OR h > 2160 THEN 'FRAME_TOO_LARGE'
                 WHEN w < 1 OR h < 1 THEN 'INVALID_JPEG' END AS error_code FROM msg""",
)
def b12(spark, sf):
    from trackloom.operators.validation import frame_error
    from workload.views import events

    k = F.col("k")
    msg = events(spark, sf).select(
        "event_id",
        F.when(k % 10 == 0, -1).otherwise(F.col("event_id")).alias("sequence_id"),
        F.when(k % 7 == 0, F.lit(None))
        .when(k % 7 == 1, -5.0)
        .otherwise(F.col("value"))
        .alias("captured_at_ms"),
        (k * 40).alias("width"),
        (k * 30).alias("height"),
        (k * 3000).alias("byte_count"),
    )
    return msg.select("event_id", frame_error(maximum_bytes=250_000).alias("error_code"))


@query(
    "b13_visible_filter",
    """SELECT event_id, CASE WHEN state <> 'UNKNOWN' THEN k % 2 = 0 ELSE confidence < 0.5 END
         AS is_uncertain FROM det WHERE state <> 'UNKNOWN' OR confidence >= 0.3""",
)
def b13(spark, sf):
    known = C.known_state(F.col("state")).isNotNull()
    det = detections(spark, sf).filter(known | (F.col("confidence") >= 0.3))
    unsure = F.when(known, F.col("k") % 2 == 0).otherwise(F.col("confidence") < 0.5)
    return det.select("event_id", unsure.alias("is_uncertain"))


@query(
    "b15_review_gate",
    """
raw AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN ' Needs-manual review' WHEN k % 4 = 1
               THEN 'Reviewed' END AS explicit, k % 3 = 0 AS nested, k % 5 = 0 AS needs,
               k % 2 = 0 AS flag FROM det)
SELECT event_id, CASE WHEN explicit = 'Reviewed' THEN 'reviewed'
            WHEN explicit IS NOT NULL THEN 'needs_manual_review'
            WHEN nested THEN 'reviewed' WHEN needs THEN 'needs_manual_review'
            WHEN flag THEN 'reviewed' ELSE 'needs_manual_review' END AS review_status FROM raw""",
)
def b15(spark, sf):
    k = F.col("k")
    explicit = F.when(k % 4 == 0, " Needs-manual review").when(k % 4 == 1, "Reviewed")
    status = C.review_status(explicit, k % 3 == 0, k % 5 == 0, k % 2 == 0)
    return detections(spark, sf).select("event_id", status.alias("review_status"))


@query(
    "b16_run_ok",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'""",
)
def b16(spark, sf):
    status = (
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "O", " OK ")
        .otherwise(F.lit(None))
    )
    return table(spark, sf, "orders").filter(C.run_succeeded(status)).select("o_orderkey")


@query(
    "b17_safe_id",
    r"""SELECT page_id FROM pages WHERE regexp_full_match(
          trim(regexp_replace(url, '^[a-z]+://', '')), '[A-Za-z0-9][A-Za-z0-9_.-]*')
        UNION ALL SELECT page_id FROM pages WHERE regexp_full_match(
          regexp_extract(url, '://([^/]*)', 1), '[A-Za-z0-9][A-Za-z0-9_.-]*')""",
)
def b17(spark, sf):
    pages = table(spark, sf, "pages")
    whole = pages.filter(C.safe_id(F.regexp_replace("url", "^[a-z]+://", "")))
    host = pages.filter(C.safe_id(F.regexp_extract("url", "://([^/]*)", 1)))
    return whole.select("page_id").unionAll(host.select("page_id"))


@query(
    "b18_evidence",
    f"""
raw AS (SELECT event_id, {norm_sql("class_name")} AS t, confidence, evidence,
               CASE WHEN k % 6 <> 0 THEN (k * 13 % 100) / 100::DOUBLE END AS seen FROM det)
SELECT event_id, CASE WHEN seen IS NULL THEN 1.0::DOUBLE ELSE seen END AS presence_conf,
       CASE WHEN t = 'bus' THEN least(evidence, coalesce(seen, 1))
            WHEN t IN ({SIGNALS}) THEN CASE WHEN seen < 0.2 THEN 0
                 ELSE least(evidence, coalesce(seen, 1)) END
            ELSE least(confidence, coalesce(seen, 1)) END AS state_conf FROM raw""",
)
def b18(spark, sf):
    seen = F.when(F.col("k") % 6 != 0, (F.col("k") * 13 % 100) / 100.0)
    state = C.state_confidence(
        F.col("class_name"),
        seen,
        F.col("confidence"),
        F.col("evidence"),
        F.col("evidence"),
        F.lit(None).cast("double"),
    )
    return detections(spark, sf).select(
        "event_id",
        C.presence_confidence(seen).alias("presence_conf"),
        state.alias("state_conf"),
    )


@query(
    "b19_route_evidence",
    """SELECT event_id FROM det WHERE k % 4 <> 0 AND k % 3 <> 0 AND k % 6 >= 3
         AND evidence >= 0.75""",
)
def b19(spark, sf):
    from trackloom.operators.scoring import route_evidence_ok

    k = F.col("k")
    ok = route_evidence_ok(k % 4 == 0, k % 3 != 0, k % 6, F.col("evidence"))
    return detections(spark, sf).filter(ok).select("event_id")


BUS_MESSAGES = (
    "버스가 접근하고 있습니다.",
    "310번 버스가 들어오고 있습니다.",
    "310번 버스입니다.",
    "버스가 접근하고 있습니다. 끝",
)


@query(
    "b20_bus_approach_message",
    f"""
said AS (SELECT event_id, ([{sql_list(BUS_MESSAGES)}])[k % 4 + 1] AS m FROM det)
SELECT event_id FROM said WHERE m = '버스가 접근하고 있습니다.'
   OR suffix(m, '버스가 들어오고 있습니다.')""",
)
def b20(spark, sf):
    said = _pick(BUS_MESSAGES, F.col("k") % 4)
    return detections(spark, sf).filter(X.is_bus_approach_message(said)).select("event_id")


@query(
    "b21_signal_detection",
    f"""
named AS (SELECT event_id, class_id, CASE WHEN k % 3 = 0 THEN ' ' ELSE class_name END AS n FROM det)
SELECT event_id FROM named WHERE CASE WHEN trim(n) = '' THEN class_id = 9
  ELSE {norm_sql("n")} IN ({SIGNALS}) END""",
)
def b21(spark, sf):
    name = F.when(F.col("k") % 3 == 0, " ").otherwise(F.col("class_name"))
    det = detections(spark, sf)
    return det.filter(C.is_signal_detection(name, F.col("class_id"))).select("event_id")


@query(
    "b24_detector_filters",
    "SELECT event_id FROM det WHERE class_id IN (5, 9) AND confidence >= 0.1",
)
def b24(spark, sf):
    from trackloom.operators.datasets import detector_filter

    return detector_filter(detections(spark, sf), class_ids=(5, 9)).select("event_id")


# --- geometry -----------------------------------------------------------------------

PAIR_SQL = """
pair AS (
  SELECT event_id, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2,
         x1 + (k % 20) AS c1, y1 + (k % 30) AS d1, x1 + (k % 20) + 40 AS c2, y1 + (k % 30) + 30 AS d2
  FROM det),
dims AS (
  SELECT *, greatest(0, least(a2, c2) - greatest(a1, c1)) AS ov,
         greatest(0, least(b2, d2) - greatest(b1, d1)) AS vo,
         least(a2 - a1, c2 - c1) AS narrower, (a2 - a1) * (b2 - b1) AS aa,
         (c2 - c1) * (d2 - d1) AS ca FROM pair)
"""


def pair_boxes():
    k = F.col("k")
    a = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    left, top = F.col("x1") + k % 20, F.col("y1") + k % 30
    return a, [left, top, left + 40, top + 30]


@query(
    "h1_iou",
    PAIR_SQL + "SELECT event_id, round(ov * vo / nullif(aa + ca - ov * vo, 0), 6) AS iou FROM dims",
)
def h1(spark, sf):
    a, b = pair_boxes()
    return detections(spark, sf).select("event_id", F.round(G.iou(a, b), 6).alias("iou"))


@query(
    "h2_overlap_ratios",
    PAIR_SQL
    + """SELECT event_id, round(ov / narrower, 6) AS horizontal,
         round(ov * vo / least(aa, ca), 6) AS box,
         greatest(0, greatest(b1, d1) - least(b2, d2)) AS gap FROM dims""",
)
def h2(spark, sf):
    a, b = pair_boxes()
    return detections(spark, sf).select(
        "event_id",
        F.round(G.horizontal_overlap_ratio(a, b), 6).alias("horizontal"),
        F.round(G.box_overlap_ratio(a, b), 6).alias("box"),
        G.vertical_gap(a, b).alias("gap"),
    )


@query(
    "h3_corridor_overlap",
    """SELECT event_id, round(greatest(0, least(x2, 480.0) - greatest(x1, 160.0)) / (x2 - x1), 6)
         AS overlap FROM det""",
)
def h3(spark, sf):
    return detections(spark, sf).select(
        "event_id", F.round(G.corridor_overlap("x1", "x2", F.lit(640.0)), 6).alias("overlap")
    )


@query(
    "h4_zone",
    """SELECT event_id, CASE WHEN (x1 + x2) / 2 < 640 / 3.0::DOUBLE THEN 'LEFT'
         WHEN (x1 + x2) / 2 > 2 * (640 / 3.0::DOUBLE) THEN 'RIGHT' ELSE 'CENTER' END AS zone FROM det""",
)
def h4(spark, sf):
    return detections(spark, sf).select("event_id", G.zone("x1", "x2", F.lit(640.0)).alias("zone"))


SCALED_SQL = """
big AS (SELECT event_id, x1 AS a, y1 AS b, x1 + (x2 - x1) * (1 + k % 7) AS c,
               y1 + (y2 - y1) * (1 + k % 3) AS d FROM det),
clipped AS (SELECT *, greatest(0, least(a, 640)) AS l, greatest(0, least(c, 640)) AS r FROM big),
thirds AS (
  SELECT *, 640 / 3.0::DOUBLE AS t FROM clipped),
covered AS (
  SELECT *, greatest(0, least(r, t) - l) AS o1, greatest(0, least(r, 2 * t) - greatest(l, t)) AS o2,
         greatest(0, r - greatest(l, 2 * t)) AS o3,
         (d - b) / 480 AS hr, (c - a) / 640 AS wr, least(d, 480) / 480 AS br FROM thirds),
placed AS (
  SELECT *, CASE WHEN r <= l THEN NULL WHEN r - l >= 480 THEN '전방 전체'
                 WHEN o1 = greatest(o1, o2, o3) THEN '왼쪽'
                 WHEN o2 = greatest(o1, o2, o3) THEN '중앙' ELSE '오른쪽' END AS p,
         CASE WHEN hr >= 0.8 OR hr * wr >= 0.4 OR (hr >= 0.55 AND br >= 0.85) THEN '가까움'
              WHEN hr >= 0.35 OR hr * wr >= 0.12 THEN '중간' ELSE '멀리' END AS dist FROM covered)
"""


def scaled():
    k = F.col("k")
    return (
        F.col("x1"),
        F.col("y1"),
        F.col("x1") + (F.col("x2") - F.col("x1")) * (1 + k % 7),
        F.col("y1") + (F.col("y2") - F.col("y1")) * (1 + k % 3),
    )


@query(
    "h5_position",
    SCALED_SQL
    + """SELECT event_id, CASE WHEN p = '전방 전체' AND dist <> '가까움' THEN '중앙' ELSE p END
         AS position FROM placed""",
)
def h5(spark, sf):
    a, b, c, d = scaled()
    place = G.settled_position(
        G.position_label(a, c, F.lit(640.0)),
        G.distance_label(a, b, c, d, F.lit(640.0), F.lit(480.0)),
    )
    return detections(spark, sf).select("event_id", place.alias("position"))


@query("h6_distance", SCALED_SQL + "SELECT event_id, dist AS distance FROM placed")
def h6(spark, sf):
    label = G.distance_label(*scaled(), F.lit(640.0), F.lit(480.0))
    return detections(spark, sf).select("event_id", label.alias("distance"))


@query(
    "h7_size_percent",
    """SELECT event_id, round_even((x2 - x1) * (y2 - y1) / 307200 * 100, 1) AS size_percent FROM det""",
)
def h7(spark, sf):
    size = G.size_percent("x1", "y1", "x2", "y2", F.lit(640.0), F.lit(480.0))
    return detections(spark, sf).select("event_id", F.bround(size, 1).alias("size_percent"))


@query(
    "h8_importance",
    f"""
named AS (SELECT event_id, replace(lower(trim({NAMES_SQL})), ' ', '_') AS t FROM det)
SELECT event_id, CASE WHEN contains(t, 'signal') OR contains(t, 'traffic_light') THEN 5
  WHEN t IN ({sql_list(fixed.IMPORTANT_VEHICLES)}) THEN 4
  WHEN t IN ({sql_list(fixed.IMPORTANT_LIVING)}) THEN 3
  WHEN {sql_any("t", fixed.IMPORTANT_WORDS)} THEN 2 ELSE 1 END AS importance FROM named""",
)
def h8(spark, sf):
    return detections(spark, sf).select("event_id", C.importance(names()).alias("importance"))


COLOURS_SQL = """
ratio AS (SELECT event_id, (k % 10) / 50.0::DOUBLE AS r, (k * 3 % 17) / 80.0::DOUBLE AS g,
                 (k * 7 % 13) / 90.0::DOUBLE AS y FROM det),
win AS (SELECT *, greatest(r, g, y) AS w1,
               CASE WHEN r = greatest(r, g, y) THEN greatest(g, y)
                    WHEN g = greatest(r, g, y) THEN greatest(r, y) ELSE greatest(r, g) END AS w2
        FROM ratio),
decided AS (SELECT *, w1 >= 0.015 AND w1 - w2 >= 0.015 AND w1 >= 2 * w2 AS clear FROM win)
"""


@query(
    "h9_dominant_signal",
    COLOURS_SQL
    + """SELECT event_id, CASE WHEN NOT clear THEN 'UNKNOWN' WHEN r = w1 THEN 'RED'
         WHEN g = w1 THEN 'GREEN' ELSE 'YELLOW' END AS state,
         CASE WHEN clear THEN round(w1 / (r + g + y), 6) ELSE 0 END AS confidence FROM decided""",
)
def h9(spark, sf):
    k = F.col("k")
    picked = C.dominant_signal((k % 10) / 50.0, (k * 3 % 17) / 80.0, (k * 7 % 13) / 90.0)
    return (
        detections(spark, sf)
        .select("event_id", picked.alias("p"))
        .select("event_id", "p.state", F.round("p.confidence", 6).alias("confidence"))
    )


@query(
    "h10_normalised_box",
    """
clip AS (SELECT event_id, greatest(0, least(x1 - 100, 200)) AS l, greatest(0, least(x2 - 100, 200)) AS r,
                greatest(0, least(y1 - 50, 150)) AS t, greatest(0, least(y2 - 50, 150)) AS b FROM det)
SELECT event_id, round((l + r) / 2 / 200, 6) AS x, round((t + b) / 2 / 150, 6) AS y,
       round((r - l) / 200, 6) AS w, round((b - t) / 150, 6) AS h
FROM clip WHERE r > l AND b > t""",
)
def h10(spark, sf):
    box = G.normalised_box(
        F.col("x1") - 100,
        F.col("y1") - 50,
        F.col("x2") - 100,
        F.col("y2") - 50,
        F.lit(200),
        F.lit(150),
    )
    return (
        detections(spark, sf)
        .select("event_id", box.alias("n"))
        .filter("n is not null")
        .select("event_id", *[F.round(f"n.{c}", 6).alias(c) for c in "xywh"])
    )


@query(
    "h11_polygon",
    """
pts AS (SELECT event_id, greatest(0, least(x1, 300)) AS a, greatest(0, least(y1, 300)) AS b,
               greatest(0, least(x2, 300)) AS c, greatest(0, least(y2, 300)) AS d,
               x1, y1, x2, y2 FROM det)
SELECT event_id, round(a / 300, 6) AS first_x, round(b / 300, 6) AS first_y,
       CAST(3 AS BIGINT) AS points, CAST(x1 AS BIGINT) AS box_left, CAST(y2 AS BIGINT) AS box_bottom
FROM pts WHERE c - a >= 2 AND d - b >= 2""",
)
def h11(spark, sf):
    text = F.concat(
        F.col("x1").cast("string"), F.lit(","), F.col("y1").cast("string"), F.lit("; ;"),
        F.col("x2").cast("string"), F.lit(", "), F.col("y1").cast("string"), F.lit(";"),
        F.col("x2").cast("string"), F.lit(","), F.col("y2").cast("string"), F.lit(";"),
    )
    return (
        detections(spark, sf)
        .select("event_id", G.parse_points(text).alias("p"))
        .select(
            "event_id",
            G.normalised_polygon(F.col("p"), F.lit(300), F.lit(300)).alias("n"),
            G.bounding_box(F.col("p")).alias("b"),
        )
        .filter("n is not null")
        .select(
            "event_id",
            F.round(F.get("n", F.lit(0))["x"], 6).alias("first_x"),
            F.round(F.get("n", F.lit(0))["y"], 6).alias("first_y"),
            F.size("n").cast("bigint").alias("points"),
            F.col("b.left").alias("box_left"),
            F.col("b.bottom").alias("box_bottom"),
        )
    )


@query(
    "h12_bounding_box",
    """SELECT event_id, CAST(floor(x1 - 0.5) AS BIGINT) AS box_left, CAST(floor(y1 + 0.25) AS BIGINT)
         AS box_top, CAST(ceil(x2) AS BIGINT) AS box_right, CAST(ceil(y2 + 0.25) AS BIGINT) AS box_bottom
       FROM det""",
)
def h12(spark, sf):
    def p(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    ring = F.array(p(x1 - 0.5, y2), p(x2, y1 + 0.25), p(x1, y2 + 0.25))
    return (
        detections(spark, sf)
        .select("event_id", G.bounding_box(ring).alias("b"))
        .select("event_id", *[F.col(f"b.{e}").alias(f"box_{e}") for e in ("left", "top", "right", "bottom")])
    )


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text by its table of 256 remainders; the common table ``crc_table`` is needed."""
    return (
        f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, strlen({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
    )


CRC_TABLE_SQL = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t)
"""


@query(
    "h13_hash_split",
    CRC_TABLE_SQL
    + f"SELECT page_id, CASE WHEN {crc32_sql('url')} % 1000 < 100 THEN 'val' ELSE 'train' END AS split FROM pages, crc_table",
)
def h13(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", X.hash_split(F.col("url"), "train", 0.1).alias("split")
    )


@query(
    "h14_scene_name",
    r"""SELECT page_id, regexp_replace(replace(regexp_replace(url, '^[a-z]+://', ''), '/', '_'),
          '[^\p{L}\p{N}_-]', '_', 'g') AS scene FROM pages""",
)
def h14(spark, sf):
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    return table(spark, sf, "pages").select("page_id", X.scene_name(parts).alias("scene"))


@query(
    "h15_stem",
    r"""
named AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', '') || '.' || (page_id % 3) || '.jpg',
                                         '([^/]*)$', 1) AS base FROM pages)
SELECT page_id, base, regexp_replace(base, '\.[^.]+$', '') AS stem FROM named""",
)
def h15(spark, sf):
    path = F.concat(
        F.regexp_replace("url", "[?#].*$", ""),
        F.lit("."),
        (F.col("page_id") % 3).cast("string"),
        F.lit(".jpg"),
    )
    return table(spark, sf, "pages").select(
        "page_id", X.basename(path).alias("base"), X.stem(path).alias("stem")
    )


# --- text ---------------------------------------------------------------------------------


@query("h16_display_text")
def h16(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(V.display_text(F.col("text"))).alias("digest"))


@query(
    "h17_search_text",
    r"""SELECT event_id, pos, trim(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))),
          '[^0-9a-z가-힣]+', ' ', 'g')) AS search_text FROM reads""",
)
def h17(spark, sf):
    return reads(detections(spark, sf)).select(
        "event_id", "pos", X.search_text(F.col("text")).alias("search_text")
    )


@query("h18_fingerprint")
def h18(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(V.fingerprint(F.col("text")), 256).alias("fingerprint"))


LINES_SQL = r"""
norm AS (
  SELECT event_id, pos, text, trim(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))),
          '[^0-9a-z가-힣]+', ' ', 'g')) AS s FROM reads)
"""


def screens(spark, sf):
    lines = reads(detections(spark, sf))
    return (
        lines.groupBy("event_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
        .select("event_id", F.transform("l", lambda x: x["text"]).alias("lines"))
    )


@query(
    "h19_screen_fingerprint",
    LINES_SQL
    + """,
d AS (SELECT DISTINCT event_id, s FROM norm WHERE s <> '')
SELECT event_id, sha256(string_agg(s, chr(31) ORDER BY s)) AS fingerprint FROM d GROUP BY 1""",
)
def h19(spark, sf):
    return screens(spark, sf).select(
        "event_id", X.screen_fingerprint(F.col("lines")).alias("fingerprint")
    )


def words_sql(column, phrases):
    return sql_any(column, [" ".join(p.lower().split()) for p in phrases])


@query(
    "h20_screen_stage",
    LINES_SQL
    + f""",
screen AS (SELECT event_id, trim(string_agg(s, ' ' ORDER BY pos)) AS t FROM norm GROUP BY 1)
SELECT event_id, CASE WHEN t = '' THEN 'UNKNOWN'
  WHEN {words_sql("t", fixed.CONFIRMATION_PHRASES)} THEN 'CONFIRMATION'
  WHEN {words_sql("t", fixed.DINE_IN_PHRASES)} AND {words_sql("t", fixed.TAKEOUT_PHRASES)}
    THEN 'ORDER_TYPE_SELECTION'
  WHEN {words_sql("t", fixed.PAYMENT_STRONG_PHRASES)} OR ({words_sql("t", fixed.PAYMENT_ACTION_PHRASES)}
    AND {words_sql("t", fixed.PAYMENT_METHOD_PHRASES)}) THEN 'PAYMENT'
  ELSE 'UNKNOWN' END AS stage FROM screen""",
)
def h20(spark, sf):
    text = X.screen_text(F.col("lines"))
    return screens(spark, sf).select("event_id", X.infer_stage(text).alias("stage"))


@query(
    "h21_visible_options",
    LINES_SQL
    + f""",
opt AS (SELECT *, row_number() OVER (PARTITION BY event_id, s ORDER BY pos) AS rn FROM norm
        WHERE {words_sql("s", fixed.OPTION_PHRASES)}
           OR s IN ({sql_list([" ".join(p.lower().split()) for p in fixed.EXACT_OPTIONS])}))
SELECT event_id, string_agg(text, '|' ORDER BY pos) AS options FROM opt WHERE rn = 1 GROUP BY 1""",
)
def h21(spark, sf):
    found = screens(spark, sf).select("event_id", X.visible_options(F.col("lines")).alias("o"))
    return found.filter(F.size("o") > 0).select("event_id", F.array_join("o", "|").alias("options"))


@query("h22_route_tokens")
def h22(spark, sf):
    docs = table(spark, sf, "documents")
    found = docs.select("doc_id", X.route_tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.array_join(F.array_sort("t"), " ").alias("routes"))


@query(
    "h23_texts_match",
    """
linked AS (SELECT event_id, pos, lower(text) AS a, lower(lag(text) OVER (
             PARTITION BY event_id ORDER BY pos)) AS b FROM reads)
SELECT event_id, pos, a = b AS matches FROM linked WHERE b IS NOT NULL""",
)
def h23(spark, sf):
    lines = screens(spark, sf)
    pairs = lines.select(
        "event_id", F.posexplode(F.arrays_zip(F.col("lines"), F.slice("lines", F.lit(2), F.size("lines")).alias("n")))
    ).filter("col.n is not null")
    return pairs.select(
        "event_id",
        (F.col("pos") + 1).alias("pos"),
        V.texts_match(F.lower("col.n"), F.lower("col.lines")).alias("matches"),
    )


@query("h23_similar_texts")
def h23_similar(spark, sf):
    """Pairs of questions and answers scored by similarity below 1."""
    talk = table(spark, sf, "conversations")
    first = talk.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    both = talk.filter("role = 'assistant'").join(first, ["conv_id", "turn"])
    return both.select(
        "conv_id",
        "turn",
        V.texts_match(F.lower("question"), F.lower("text"), 0.6).alias("matches"),
    )


@query(
    "h24_edit_distance",
    """
plain AS (SELECT item_id, regexp_replace(text, '[^ -~]', '#', 'g') AS text FROM benchmark),
near AS (SELECT b.item_id, c.item_id AS other, b.text AS a, c.text AS b
         FROM plain b JOIN plain c ON c.item_id = b.item_id + 1)
SELECT item_id, round(levenshtein(a, b) / greatest(length(a), length(b), 1)::DOUBLE, 6) AS distance
FROM near""",
)
def h24(spark, sf):
    # the checking engine counts bytes, so other characters become one byte here
    items = table(spark, sf, "benchmark").withColumn(
        "text", F.regexp_replace("text", "[^ -~]", "#")
    )
    following = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    both = items.join(following, "item_id")
    return both.select(
        "item_id",
        F.round(X.normalised_edit_distance(F.col("text"), F.col("other")), 6).alias("distance"),
    )


@query("h25_scoring_text")
def h25(spark, sf):
    docs = table(spark, sf, "documents")
    clean = V.scoring_text(F.col("text"))
    return docs.select("doc_id", F.char_length(clean).alias("length"), F.md5(clean).alias("digest"))


@query(
    "h26_tokens",
    r"""SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'))) AS tokens
        FROM benchmark""",
)
def h26(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", F.size(X.tokens(F.col("text"))).cast("bigint").alias("tokens")
    )


@query(
    "h27_description",
    r"""SELECT conv_id, turn, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 300) AS description
        FROM conversations""",
)
def h27(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.clean_description(F.col("text")).alias("description")
    )


@query(
    "h28_particle",
    """
named AS (SELECT event_id, pos, text, unicode(right(text, 1)) - 44032 AS c FROM reads)
SELECT event_id, pos, text || CASE WHEN c BETWEEN 0 AND 11171 AND c % 28 <> 0 THEN '이' ELSE '가' END
       AS subject FROM named""",
)
def h28(spark, sf):
    return reads(detections(spark, sf)).select(
        "event_id", "pos", X.subject_particle(F.col("text")).alias("subject")
    )


KINDS = (
    "OBJECT_APPEARED",
    "OBJECT_STATE_CHANGED",
    "OBJECT_APPROACHING",
    "TEXT_CONFIRMED",
    "SCREEN_CHANGED",
    "HAZARD_DETECTED",
    "DESCRIPTION_CONFIRMED",
    "OTHER",
)
KIND_SQL = "([" + sql_list(KINDS) + "])[k % 8 + 1]"
EVENTS_SQL = f"""
told AS (
  SELECT source_id, stable_id, frame_index, timestamp_s, event_id, {KIND_SQL} AS event_type,
         {norm_sql("class_name")} AS object_type, 'RED' AS previous_state, state AS current_state,
         evidence AS confidence, k % 11 = 0 AS is_uncertain,
         CASE WHEN k % 3 = 0 THEN 'A' || k END AS route_number,
         CASE WHEN k % 4 <> 0 THEN 'text ' || k END AS text,
         CASE WHEN k % 3 = 1 THEN 'seen ' || k END AS description,
         CASE k % 5 WHEN 0 THEN [] WHEN 1 THEN ['포장', '매장 식사'] WHEN 2 THEN ['확인']
              WHEN 3 THEN ['a', ' ', 'b', 'c'] ELSE NULL END AS options,
         'f' || (k % 6) AS screen_fingerprint,
         CASE WHEN k % 2 = 0 THEN 'IMMINENT' ELSE 'WARNING' END AS hazard_level,
         (['LEFT', 'CENTER', 'RIGHT', ''])[k % 4 + 1] AS zone, k % 7 AS emission_index
  FROM det),
labelled AS (
  SELECT *, CASE object_type {" ".join(f"WHEN '{c}' THEN '{v}'" for c, v in fixed.OBJECT_LABELS.items())}
            ELSE object_type || ' 객체' END AS label,
         CASE current_state WHEN 'GREEN' THEN '초록색' WHEN 'RED' THEN '빨간색'
              WHEN 'YELLOW' THEN '노란색' END AS colour,
         CASE zone WHEN 'LEFT' THEN '왼쪽에서 ' WHEN 'CENTER' THEN '정면에서 '
              WHEN 'RIGHT' THEN '오른쪽에서 ' ELSE '' END AS place,
         list_filter(list_transform(options, lambda o: trim(o)), lambda o: o <> '') AS opts FROM told),
named AS (
  SELECT *, label || CASE WHEN unicode(right(label, 1)) BETWEEN 44032 AND 55203
              AND (unicode(right(label, 1)) - 44032) % 28 <> 0 THEN '이' ELSE '가' END AS subject
  FROM labelled),
spoken AS (
  SELECT *, CASE
    WHEN event_type = 'HAZARD_DETECTED' THEN
      CASE hazard_level WHEN 'IMMINENT' THEN '위험, 멈추세요. ' || place || subject || ' 빠르게 다가옵니다.'
           ELSE subject || ' ' || place || '다가옵니다. 주의하세요.' END
    WHEN is_uncertain OR confidence < 0.5 THEN NULL
    WHEN event_type = 'OBJECT_STATE_CHANGED' THEN
      CASE WHEN current_state NOT IN ('UNKNOWN', 'RED') THEN
        CASE object_type WHEN 'pedestrian_signal' THEN '보행자 신호가 '
             WHEN 'vehicle_traffic_light' THEN '차량 신호가 ' WHEN 'traffic_light' THEN '신호등 표시가 '
             ELSE label || ' 상태가 ' END || colour || '으로 바뀌었습니다.' END
    WHEN event_type = 'OBJECT_APPROACHING' THEN
      CASE WHEN object_type = 'bus' THEN coalesce(route_number || '번 버스가 들어오고 있습니다.',
             '버스가 접근하고 있습니다.') WHEN object_type IN ('car', 'vehicle')
           THEN subject || ' 접근하고 있습니다.' END
    WHEN event_type = 'TEXT_CONFIRMED' THEN
      CASE WHEN object_type = 'bus' THEN route_number || '번 버스입니다.'
           ELSE label || '에 ' || text || '라고 표시되어 있습니다.' END
    WHEN event_type = 'SCREEN_CHANGED' THEN
      CASE WHEN object_type IN ({sql_list(fixed.KIOSK_TYPES)}) THEN
        CASE WHEN len(opts) = 2 THEN opts[1] || '와 ' || opts[2] || ' 중 하나를 선택하는 화면입니다.'
             WHEN len(opts) > 0 THEN label || ' 화면에 ' || array_to_string(opts, ', ') || ' 선택지가 있습니다.'
             ELSE label || ' 화면이 바뀌었습니다.' END END
    WHEN event_type = 'DESCRIPTION_CONFIRMED' THEN description
    WHEN event_type = 'OBJECT_APPEARED' AND object_type IN ('person', 'bicycle')
      THEN subject || ' 감지되었습니다.' END AS message,
    CASE WHEN event_type = 'HAZARD_DETECTED' THEN 0
         WHEN event_type = 'OBJECT_STATE_CHANGED' AND object_type IN ({SIGNALS}) THEN 1
         WHEN event_type = 'OBJECT_APPROACHING' AND object_type IN ('bus', 'car', 'vehicle') THEN 2
         WHEN event_type = 'TEXT_CONFIRMED' AND object_type = 'bus' THEN 3
         WHEN event_type = 'SCREEN_CHANGED' AND object_type IN ({sql_list(fixed.KIOSK_TYPES)}) THEN 4
         WHEN event_type = 'TEXT_CONFIRMED' THEN 5
         WHEN event_type = 'DESCRIPTION_CONFIRMED' THEN 6
         WHEN event_type IN ('OBJECT_APPEARED', 'OBJECT_DISAPPEARED', 'OBJECT_STATE_CHANGED') THEN 7
         ELSE 100 END AS priority
  FROM named)
"""


def told_events(spark, sf):
    """Scene events of every kind derived from the observations."""
    k = F.col("k")
    ks = k.cast("string")
    options = (
        F.when(k % 5 == 0, F.array().cast("array<string>"))
        .when(k % 5 == 1, F.array(F.lit("포장"), F.lit("매장 식사")))
        .when(k % 5 == 2, F.array(F.lit("확인")))
        .when(k % 5 == 3, F.array(F.lit("a"), F.lit(" "), F.lit("b"), F.lit("c")))
    )
    return detections(spark, sf).select(
        "source_id",
        "stable_id",
        "frame_index",
        "timestamp_s",
        "event_id",
        _pick(KINDS, k % 8).alias("event_type"),
        C.norm_class(F.col("class_name")).alias("object_type"),
        F.lit("RED").alias("previous_state"),
        F.col("state").alias("current_state"),
        F.col("evidence").alias("confidence"),
        (k % 11 == 0).alias("is_uncertain"),
        F.when(k % 3 == 0, F.concat(F.lit("A"), ks)).alias("route_number"),
        F.when(k % 4 != 0, F.concat(F.lit("text "), ks)).alias("text"),
        F.when(k % 3 == 1, F.concat(F.lit("seen "), ks)).alias("description"),
        options.alias("visible_options"),
        F.concat(F.lit("f"), (k % 6).cast("string")).alias("screen_fingerprint"),
        F.when(k % 2 == 0, "IMMINENT").otherwise("WARNING").alias("hazard_level"),
        _pick(("LEFT", "CENTER", "RIGHT", ""), k % 4).alias("zone"),
        (k % 7).alias("emission_index"),
    )


@query("h29_messages", EVENTS_SQL + "SELECT event_id, message FROM spoken WHERE message IS NOT NULL")
def h29(spark, sf):
    said = told_events(spark, sf).select(
        "event_id", M.message(presence_types=("person", "bicycle")).alias("message")
    )
    return said.filter("message is not null")


@query("h30_priority", EVENTS_SQL + "SELECT event_id, priority FROM spoken")
def h30(spark, sf):
    rank = M.priority(F.col("event_type"), F.col("object_type"))
    return told_events(spark, sf).select("event_id", rank.alias("priority"))


@query(
    "h31_dedup_keys",
    EVENTS_SQL
    + """
SELECT count(*) AS events, count(DISTINCT event_type || chr(31) || object_type || chr(31) ||
    CASE WHEN event_type = 'OBJECT_APPROACHING' AND object_type = 'bus' THEN '-' ELSE stable_id END
    || chr(31) || CASE WHEN current_state = 'UNKNOWN' THEN '-' ELSE current_state END || chr(31) ||
    CASE WHEN event_type = 'SCREEN_CHANGED' THEN screen_fingerprint
         WHEN event_type = 'HAZARD_DETECTED' THEN CAST(emission_index AS VARCHAR) ELSE '-' END
    || chr(31) || message) AS distinct_keys
FROM spoken WHERE message IS NOT NULL AND priority < 100""",
)
def h31(spark, sf):
    from trackloom.operators.narration import narratable

    told = narratable(told_events(spark, sf), presence_types=("person", "bicycle"))
    return told.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("dedup_key").alias("distinct_keys")
    )


@query(
    "b14_narratable",
    EVENTS_SQL
    + """SELECT event_id, message, priority FROM spoken
         WHERE message IS NOT NULL AND priority < 100""",
)
def b14(spark, sf):
    from trackloom.operators.narration import narratable

    told = narratable(told_events(spark, sf), presence_types=("person", "bicycle"))
    return told.select("event_id", "message", "priority")


QUESTIONS = (
    "지금 건너도 돼?",
    "앞으로 가도 돼?",
    "뭐라고 적혀 있어?",
    "버스 어디 있어?",
    "뭐가 보여?",
    "자세히 말해줘",
    "안녕",
    "무슨 색이야?",
)
QUESTIONS_SQL = "([" + sql_list(QUESTIONS) + "])[k % 8 + 1]"


def kind_sql(x):
    whens = " ".join(f"WHEN {sql_any(x, words)} THEN '{kind}'" for kind, words in fixed.QUESTION_WORDS)
    return f"CASE {whens} ELSE 'general' END"


@query("h32_question_type", f"SELECT event_id, {kind_sql(QUESTIONS_SQL)} AS kind FROM ev")
def h32(spark, sf):
    from workload.views import events

    question = _pick(QUESTIONS, F.col("k") % 8)
    return events(spark, sf).select("event_id", X.question_type(question).alias("kind"))


@query(
    "h33_image_reason",
    f"""
asked AS (SELECT event_id, {QUESTIONS_SQL} AS q, k % 9 AS visible, CAST(k AS DOUBLE) / 100 AS conf,
                 k % 2 = 0 AS informative FROM ev)
SELECT event_id, CASE WHEN visible = 0 THEN 'no_detections' WHEN conf < 0.3 THEN 'low_confidence'
  WHEN {sql_any("q", fixed.VISION_WORDS)} THEN 'question_needs_vision'
  WHEN {sql_any("q", fixed.DETAIL_WORDS)} THEN 'detail_requested'
  WHEN {kind_sql("q")} IN ('can_i_go', 'crossing') THEN 'path_check'
  WHEN {kind_sql("q")} = 'describe' AND NOT informative THEN 'sparse_scene' END AS reason
FROM asked""",
)
def h33(spark, sf):
    from workload.views import events

    k = F.col("k")
    reason = X.image_reason(
        _pick(QUESTIONS, k % 8), k % 9, k / 100.0, k % 2 == 0, confidence_threshold=0.3
    )
    return events(spark, sf).select("event_id", reason.alias("reason"))


@query(
    "h34_canonical_id",
    """SELECT event_id, CASE WHEN k % 6 <> 0 THEN 'stable-' || u END AS canonical FROM det""",
)
def h34(spark, sf):
    key = F.when(F.col("k") % 6 == 0, "  ").otherwise(
        F.concat(F.lit(" a:"), "class_name", F.lit(":stable-"), F.col("u").cast("string"))
    )
    return detections(spark, sf).select("event_id", C.canonical_stable_id(key).alias("canonical"))


@query(
    "h35_safe_numbers",
    """
raw AS (SELECT event_id, CASE k % 5 WHEN 0 THEN 'x1' WHEN 1 THEN 'nan' WHEN 2 THEN 'inf'
               ELSE CAST(value AS VARCHAR) END AS t, value, k FROM ev)
SELECT event_id, CASE WHEN k % 5 > 2 THEN value END AS number,
       CASE WHEN k % 5 > 2 THEN CAST(trunc(value) AS BIGINT) END AS whole FROM raw""",
)
def h35(spark, sf):
    from workload.views import events

    k = F.col("k")
    raw = (
        F.when(k % 5 == 0, "x1")
        .when(k % 5 == 1, "nan")
        .when(k % 5 == 2, "Infinity")
        .otherwise(F.col("value").cast("string"))
    )
    return events(spark, sf).select(
        "event_id", C.finite_number(raw).alias("number"), C.whole_number(raw).alias("whole")
    )


@query(
    "h36_bounded_confidence",
    """SELECT event_id, CASE WHEN value / 400 BETWEEN 0 AND 1 AND k % 7 <> 0 THEN value / 400
         ELSE 0 END AS confidence FROM ev""",
)
def h36(spark, sf):
    from workload.views import events

    raw = F.when(F.col("k") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 400)
    return events(spark, sf).select("event_id", C.bounded_confidence(raw).alias("confidence"))


@query(
    "h37_legacy_event_type",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'OBJECT_APPEARED' WHEN 'click'
         THEN 'OBJECT_DISAPPEARED' WHEN 'purchase' THEN 'OBJECT_STATE_CHANGED' END AS mapped FROM ev""",
)
def h37(spark, sf):
    from workload.views import events

    kind = F.col("event_type")
    legacy = (
        F.when(kind == "view", "Appeared")
        .when(kind == "click", "disappeared")
        .when(kind == "purchase", "SIGNAL_CHANGED")
        .otherwise(kind)
    )
    return events(spark, sf).select("event_id", C.legacy_event_type(legacy).alias("mapped"))


@query(
    "h39_frozen_attributes",
    """SELECT event_id, '[{"key":"a","value":"' || event_type || '"},{"key":"z","value":"' || k || '"}]'
         AS frozen FROM ev""",
)
def h39(spark, sf):
    """Attribute maps as comparable text: entries in the order of their keys."""
    from trackloom.functions.classes import frozen
    from workload.views import events

    k = F.col("k").cast("string")
    pairs = F.create_map(F.lit("z"), k, F.lit("a"), F.col("event_type"))
    return events(spark, sf).select("event_id", frozen(pairs).alias("frozen"))


@query(
    "h40_ages",
    """
clock AS (SELECT max(us) // 1000 AS now_ms FROM ev)
SELECT event_id, CAST(greatest(0, round_even((now_ms - us // 1000) / 1000.0::DOUBLE, 0)) AS BIGINT) AS seconds_ago
FROM ev, clock""",
)
def h40(spark, sf):
    from workload.views import events

    ev = events(spark, sf)
    now = ev.agg(F.floor(F.max("us") / 1000).cast("bigint").alias("now_ms"))
    then = F.floor(F.col("us") / 1000).cast("bigint")
    # one row against all: the clock is a single value
    aged = ev.join(F.broadcast(now))
    return aged.select("event_id", C.seconds_ago(F.col("now_ms"), then).alias("seconds_ago"))


@query(
    "h41_interval_shapes",
    """SELECT event_id, frame_index AS start_frame, frame_index + k % 5 - 1 AS end_frame FROM det
       WHERE frame_index >= 0 AND k % 5 >= 1""",
)
def h41(spark, sf):
    """Intervals written as objects, with short names, or as pairs."""
    from trackloom.functions.classes import parse_interval

    k, f = F.col("k"), F.col("frame_index").cast("string")
    end = (F.col("frame_index") + k % 5 - 1).cast("string")
    raw = (
        F.when(
            k % 3 == 0, F.concat(F.lit('{"start_frame": '), f, F.lit(', "end_frame": '), end, F.lit("}"))
        )
        .when(k % 3 == 1, F.concat(F.lit('{"start": '), f, F.lit(', "end": '), end, F.lit("}")))
        .otherwise(F.concat(F.lit("["), f, F.lit(", "), end, F.lit("]")))
    )
    return (
        detections(spark, sf)
        .select("event_id", parse_interval(raw).alias("i"))
        .filter("i is not null")
        .select("event_id", "i.start_frame", "i.end_frame")
    )


@query(
    "h42_resolve_stable_id",
    """
given AS (SELECT event_id, CASE WHEN k % 3 = 0 THEN ' ' WHEN k % 3 = 1 THEN ' ' || stable_id END AS g,
                 track_id FROM det)
SELECT event_id, coalesce(nullif(trim(g), ''), 'track-' || track_id) AS resolved FROM given""",
)
def h42(spark, sf):
    k = F.col("k")
    given = F.when(k % 3 == 0, " ").when(k % 3 == 1, F.concat(F.lit(" "), "stable_id"))
    return detections(spark, sf).select(
        "event_id", C.resolve_stable_id(given, F.col("track_id")).alias("resolved")
    )


@query(
    "h43_flat_messages",
    """SELECT event_id, text AS message FROM reads WHERE k % 2 = 0 AND trim(text) <> ''
       UNION ALL SELECT event_id, 'single ' || k FROM det WHERE k % 2 = 1""",
)
def h43(spark, sf):
    from trackloom.functions.classes import messages_of

    k = F.col("k")
    det = detections(spark, sf)
    alone = F.when(k % 2 == 1, F.concat(F.lit("single "), k.cast("string")))
    rows = det.join(screens(spark, sf), "event_id", "left").select(
        "event_id", F.coalesce(alone, F.to_json("lines")).alias("raw")
    )
    return rows.select("event_id", F.explode(messages_of(F.col("raw"))).alias("message"))


@query(
    "h44_first_positive",
    """SELECT event_id, CASE WHEN k % 4 > 1 THEN CAST(k % 4 AS DOUBLE) WHEN k % 3 > 0 THEN CAST(k % 3 AS DOUBLE)
         WHEN value > 0 THEN value END AS fps FROM ev""",
)
def h44(spark, sf):
    from workload.views import events

    k = F.col("k")
    fps = C.first_positive(
        F.when(k % 4 > 1, k % 4), F.when(k % 3 == 0, 0 - k).otherwise(k % 3), F.col("value")
    )
    return events(spark, sf).select("event_id", fps.alias("fps"))


@query(
    "h46_reason_codes",
    """
coded AS (SELECT event_id, list_filter([CASE WHEN confidence < 0.3 THEN 'low_detection_confidence' END,
   CASE WHEN state = 'UNKNOWN' THEN 'state_unknown' END, CASE WHEN k % 5 = 0 THEN 'no_track' END],
   lambda x: x IS NOT NULL) AS r FROM det)
SELECT event_id, r[1] AS headline, array_to_string(r, ',') AS reasons FROM coded""",
)
def h46(spark, sf):
    from trackloom.functions.classes import headline, reasons

    found = reasons(
        ("low_detection_confidence", F.col("confidence") < 0.3),
        ("state_unknown", F.col("state") == "UNKNOWN"),
        ("no_track", F.col("k") % 5 == 0),
    )
    return (
        detections(spark, sf)
        .select("event_id", found.alias("r"))
        .select("event_id", headline(F.col("r")).alias("headline"), F.array_join("r", ",").alias("reasons"))
    )
