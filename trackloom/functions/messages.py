"""Message templates, priorities and deduplication keys of scene events.

Events are rows with: event_type, object_type, stable_id, previous_state,
current_state, confidence, is_uncertain and the nullable attributes
route_number, text, description, visible_options, screen_fingerprint,
hazard_level, zone, emission_index.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.strings import strip

from trackloom.functions import fixed
from trackloom.functions.classes import known_state, norm_token
from trackloom.functions.text import subject_particle


def _lookup(values: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.element_at(F.create_map(*pairs), key)


def object_label(object_type: Column) -> Column:
    return F.coalesce(
        _lookup(fixed.OBJECT_LABELS, object_type), F.concat(object_type, F.lit(" 객체"))
    )


def _filled(text: Column) -> Column:
    return F.when(strip(text) != "", strip(text))


def priority(event_type: Column, object_type: Column) -> Column:
    """0 is most urgent; 100 is never said."""
    token = norm_token(object_type)
    return (
        F.when(event_type == "HAZARD_DETECTED", 0)
        .when((event_type == "OBJECT_STATE_CHANGED") & token.isin(*fixed.SIGNAL_TYPES), 1)
        .when((event_type == "OBJECT_APPROACHING") & token.isin(*fixed.VEHICLE_TYPES), 2)
        .when((event_type == "TEXT_CONFIRMED") & (token == "bus"), 3)
        .when((event_type == "SCREEN_CHANGED") & token.isin(*fixed.KIOSK_TYPES), 4)
        .when(event_type == "TEXT_CONFIRMED", 5)
        .when(event_type == "DESCRIPTION_CONFIRMED", 6)
        .when(
            event_type.isin("OBJECT_APPEARED", "OBJECT_DISAPPEARED", "OBJECT_STATE_CHANGED"), 7
        )
        .otherwise(100)
    )


def _hazard_message(e, subject: Column) -> Column:
    level = F.upper(strip(e("hazard_level")))
    where = _lookup(fixed.ZONE_LABELS, F.upper(strip(e("zone"))))
    spaced = F.coalesce(F.concat(where, F.lit(" ")), F.lit(""))
    return F.when(
        level == "IMMINENT",
        F.concat(F.lit("위험, 멈추세요. "), spaced, subject, F.lit(" 빠르게 다가옵니다.")),
    ).when(
        level == "WARNING",
        F.concat(subject, F.lit(" "), spaced, F.lit("다가옵니다. 주의하세요.")),
    )


def message(
    e=F.col,
    *,
    minimum_confidence: float = 0.5,
    presence_types: tuple[str, ...] = (),
    allow_bus_approach: bool = True,
) -> Column:
    """Sentence for one event, null when nothing should be said.

    ``e`` maps an attribute name to its column.
    """
    token = norm_token(e("object_type"))
    label = object_label(token)
    subject = subject_particle(label)
    kind = e("event_type")
    route, text = _filled(e("route_number")), _filled(e("text"))
    before, after = known_state(e("previous_state")), known_state(e("current_state"))
    colour = _lookup(fixed.STATE_LABELS, after)
    what = (
        F.when(token == "traffic_light", F.lit("신호등 표시가 "))
        .when(token == "pedestrian_signal", F.lit("보행자 신호가 "))
        .when(token == "vehicle_traffic_light", F.lit("차량 신호가 "))
        .otherwise(F.concat(label, F.lit(" 상태가 ")))
    )
    options = F.filter(
        F.transform(e("visible_options"), lambda o: strip(o)), lambda o: o != ""
    )
    count = F.coalesce(F.size(options), F.lit(0))
    presence = tuple(" ".join(p.lower().replace("-", " ").split()).replace(" ", "_") for p in presence_types)
    announced = token.isin(*presence) if presence else F.lit(False)
    bus_approach = (
        F.coalesce(
            F.concat(route, F.lit("번 " + fixed.BUS_ARRIVAL_SUFFIX)), F.lit(fixed.BUS_APPROACH_SENTENCE)
        )
        if allow_bus_approach
        else F.lit(None).cast("string")
    )
    ordinary = (
        F.when(
            kind == "OBJECT_STATE_CHANGED",
            F.when(before != after, F.concat(what, colour, F.lit("으로 바뀌었습니다."))),
        )
        .when(
            kind == "OBJECT_APPROACHING",
            F.when(token == "bus", bus_approach).when(
                token.isin("car", "vehicle"), F.concat(subject, F.lit(" 접근하고 있습니다."))
            ),
        )
        .when(
            kind == "TEXT_CONFIRMED",
            F.when(token == "bus", F.concat(route, F.lit("번 버스입니다."))).otherwise(
                F.concat(label, F.lit("에 "), text, F.lit("라고 표시되어 있습니다."))
            ),
        )
        .when(
            kind == "SCREEN_CHANGED",
            F.when(
                token.isin(*fixed.KIOSK_TYPES),
                F.when(
                    count == 2,
                    F.concat(
                        options[0], F.lit("와 "), options[1], F.lit(" 중 하나를 선택하는 화면입니다.")
                    ),
                )
                .when(
                    count > 0,
                    F.concat(
                        label,
                        F.lit(" 화면에 "),
                        F.array_join(options, ", "),
                        F.lit(" 선택지가 있습니다."),
                    ),
                )
                .otherwise(F.concat(label, F.lit(" 화면이 바뀌었습니다."))),
            ),
        )
        .when(kind == "DESCRIPTION_CONFIRMED", _filled(e("description")))
        .when(
            (kind == "OBJECT_APPEARED") & announced, F.concat(subject, F.lit(" 감지되었습니다."))
        )
        .when(
            (kind == "OBJECT_DISAPPEARED") & announced,
            F.concat(subject, F.lit(" 화면에서 사라졌습니다.")),
        )
    )
    sure = ~F.coalesce(e("is_uncertain"), F.lit(False)) & (e("confidence") >= minimum_confidence)
    return F.when(kind == "HAZARD_DETECTED", _hazard_message(e, subject)).when(sure, ordinary)


def dedup_key(e=F.col, text: Column | None = None) -> Column:
    """What makes two messages the same to a listener."""
    token = norm_token(e("object_type"))
    kind = e("event_type")
    who = F.when(~((kind == "OBJECT_APPROACHING") & (token == "bus")), e("stable_id"))
    what = F.when(kind == "SCREEN_CHANGED", e("screen_fingerprint")).when(
        kind == "HAZARD_DETECTED", e("emission_index").cast("string")
    )
    parts = (
        kind,
        token,
        who,
        known_state(e("previous_state")),
        known_state(e("current_state")),
        what,
        message(e) if text is None else text,
    )
    return F.concat_ws("\u001f", *[F.coalesce(p, F.lit("\u0000")) for p in parts])
