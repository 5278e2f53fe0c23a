"""Boxes as columns: overlap, position, size, clamping."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions import fixed

def _cols(*names: str | Column) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]

def _all(*conditions: Column) -> Column:
    return functools.reduce(operator.and_, conditions)

def positive(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)

def is_finite(value: Column) -> Column:
    """False for null, NaN and infinities."""
    value = value.cast("double")
    return F.coalesce(
        ~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), F.lit(False)
    )

def valid_box(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = _cols(x1, y1, x2, y2)
    return _all(*[is_finite(c) for c in (x1, y1, x2, y2)], x2 > x1, y2 > y1)

def box_area(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = _cols(x1, y1, x2, y2)
    return positive(x2 - x1) * positive(y2 - y1)

def aspect_ratio(x1, y1, x2, y2) -> Column:
    """Height over width; infinite for a box without width."""
    x1, y1, x2, y2 = _cols(x1, y1, x2, y2)
    width = positive(x2 - x1)
    return F.when(width > 0, positive(y2 - y1) / width).otherwise(F.lit(float("inf")))

def _span_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return positive(F.least(a2, b2) - F.greatest(a1, b1))

def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes, 0 when the union is empty."""
    shared = _span_overlap(a[0], a[2], b[0], b[2]) * _span_overlap(a[1], a[3], b[1], b[3])
    union = box_area(*a) + box_area(*b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))

def horizontal_overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """Shared width over the narrower width; null when either box has none."""
    narrower = F.least(positive(a[2] - a[0]), positive(b[2] - b[0]))
    return F.try_divide(_span_overlap(a[0], a[2], b[0], b[2]), narrower)

def box_overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """Shared area over the smaller area; null when either box is empty."""
    shared = _span_overlap(a[0], a[2], b[0], b[2]) * _span_overlap(a[1], a[3], b[1], b[3])
    return F.try_divide(shared, F.least(box_area(*a), box_area(*b)))

def vertical_gap(a: list[Column], b: list[Column]) -> Column:
    return positive(F.greatest(a[1], b[1]) - F.least(a[3], b[3]))

def is_display_shape(box: list[Column], low: float = 1.5, high: float = 2.3) -> Column:
    return aspect_ratio(*box).between(low, high)

def same_display(
    a: list[Column],
    b: list[Column],
    *,
    minimum_horizontal: float = 0.5,
    minimum_area: float = 0.5,
    component_aspect: float = 1.25,
    gap_to_width: float = 0.25,
) -> Column:
    """Two boxes show the same display, or a display and a part of it."""
    narrower = F.least(positive(a[2] - a[0]), positive(b[2] - b[0]))
    whole_and_part = (is_display_shape(a) & (aspect_ratio(*b) <= component_aspect)) | (
        is_display_shape(b) & (aspect_ratio(*a) <= component_aspect)
    )
    touching = whole_and_part & (vertical_gap(a, b) <= narrower * gap_to_width)
    not_empty = F.least(box_area(*a), box_area(*b)) > 0
    return F.coalesce(
        not_empty
        & (horizontal_overlap_ratio(a, b) >= minimum_horizontal)
        & ((box_overlap_ratio(a, b) >= minimum_area) | touching),
        F.lit(False),
    )

def clamp(value: Column, upper: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, upper.cast("double")))

def clamp_crop(x1, y1, x2, y2, width: Column, height: Column) -> Column:
    """Integer crop of a box inside the frame, null when empty."""
    x1, y1, x2, y2 = _cols(x1, y1, x2, y2)
    finite = _all(*[is_finite(c) for c in (x1, y1, x2, y2)])
    edges = [
        clamp(edge(c), limit).cast("bigint")
        for edge, c, limit in (
            (F.floor, F.greatest(F.lit(0.0), F.least(x1, width.cast("double"))), width),
            (F.floor, F.greatest(F.lit(0.0), F.least(y1, height.cast("double"))), height),
            (F.ceil, F.greatest(F.lit(0.0), F.least(x2, width.cast("double"))), width),
            (F.ceil, F.greatest(F.lit(0.0), F.least(y2, height.cast("double"))), height),
        )
    ]
    left, top, right, bottom = edges
    return F.when(
        finite & (right > left) & (bottom > top),
        F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")),
    )

def roi_box(width: Column, height: Column, roi=fixed.ROUTE_ROI) -> Column:
    """Pixel box of a fractional region of a crop; null when it has no area."""
    x_start, y_start, x_end, y_end = roi

    def inside(value: Column, limit: Column) -> Column:
        return F.greatest(F.lit(0), F.least(limit.cast("bigint"), value.cast("bigint")))

    left = inside(F.floor(width * F.lit(x_start)), width)
    top = inside(F.floor(height * F.lit(y_start)), height)
    right = inside(F.ceil(width * F.lit(x_end) - F.lit(1e-9)), width)
    bottom = inside(F.ceil(height * F.lit(y_end) - F.lit(1e-9)), height)
    return F.when(
        (width >= 2) & (height >= 2) & (right > left) & (bottom > top),
        F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")),
    )

def corridor_overlap(x1, x2, frame_width: Column, corridor: float = 0.5) -> Column:
    """Share of the box width inside the central corridor of the frame."""
    x1, x2 = _cols(x1, x2)
    half = frame_width * F.lit(corridor) / F.lit(2.0)
    middle = frame_width / F.lit(2.0)
    inside = positive(F.least(x2, middle + half) - F.greatest(x1, middle - half))
    return F.when(x2 - x1 > 0, inside / (x2 - x1)).otherwise(F.lit(0.0))

def zone(x1, x2, frame_width: Column) -> Column:
    """LEFT, CENTER or RIGHT by the thirds of the frame the box centre is in."""
    x1, x2 = _cols(x1, x2)
    centre = (x1 + x2) / F.lit(2.0)
    third = frame_width / F.lit(3.0)
    return (
        F.when(centre < third, "LEFT").when(centre > F.lit(2.0) * third, "RIGHT").otherwise("CENTER")
    )

def position_label(x1, x2, frame_width: Column) -> Column:
    """Third of the frame the box covers most, or the whole width."""
    x1, x2 = _cols(x1, x2)
    left, right = clamp(x1, frame_width), clamp(x2, frame_width)
    third = frame_width / F.lit(3.0)
    on_left = positive(F.least(right, third) - left)
    in_middle = positive(F.least(right, F.lit(2.0) * third) - F.greatest(left, third))
    on_right = positive(right - F.greatest(left, F.lit(2.0) * third))
    most = F.greatest(on_left, in_middle, on_right)
    return (
        F.when((frame_width <= 0) | (right <= left), F.lit(None))
        .when(right - left >= frame_width * F.lit(0.75), fixed.POSITION_FULL)
        .when(on_left == most, fixed.POSITION_LEFT)
        .when(in_middle == most, fixed.POSITION_CENTER)
        .otherwise(fixed.POSITION_RIGHT)
    )

def distance_label(x1, y1, x2, y2, frame_width: Column, frame_height: Column) -> Column:
    """Near, middle or far by how much of the frame the box fills."""
    x1, y1, x2, y2 = _cols(x1, y1, x2, y2)
    tall = positive(y2 - y1) / frame_height
    wide = positive(x2 - x1) / frame_width
    area = tall * wide
    reach = F.least(y2, frame_height.cast("double")) / frame_height
    return (
        F.when((tall <= 0) | (wide <= 0), F.lit(None))
        .when(
            (tall >= 0.8) | (area >= 0.4) | ((tall >= 0.55) & (reach >= 0.85)), fixed.DISTANCE_NEAR
        )
        .when((tall >= 0.35) | (area >= 0.12), fixed.DISTANCE_MID)
        .otherwise(fixed.DISTANCE_FAR)
    )

def settled_position(position: Column, distance: Column) -> Column:
    """A box over the full width only blocks the way when it is near."""
    far_and_wide = (position == fixed.POSITION_FULL) & (
        F.coalesce(distance, F.lit("")) != fixed.DISTANCE_NEAR
    )
    return F.when(far_and_wide, fixed.POSITION_CENTER).otherwise(position)

def size_percent(x1, y1, x2, y2, frame_width: Column, frame_height: Column) -> Column:
    return box_area(x1, y1, x2, y2) / (frame_width * frame_height) * F.lit(100.0)

def is_own_body(class_name: Column, y1, y2, frame_height: Column) -> Column:
    """A 'person' that starts low and leaves the frame below is the wearer."""
    y1, y2 = _cols(y1, y2)
    return F.coalesce(
        (F.lower(F.trim(class_name)) == "person")
        & (frame_height > 0)
        & (y1 >= frame_height * F.lit(0.55))
        & (y2 >= frame_height * F.lit(0.95)),
        F.lit(False),
    )

def normalised_box(x1, y1, x2, y2, width: Column, height: Column) -> Column:
    """Box clamped to its image as centre and size fractions; null if degenerate."""
    x1, y1, x2, y2 = _cols(x1, y1, x2, y2)
    left, right = clamp(x1, width), clamp(x2, width)
    top, bottom = clamp(y1, height), clamp(y2, height)
    given = _all(*[c.isNotNull() & ~F.isnan(c) for c in (x1, y1, x2, y2)])
    return F.when(
        given & (right > left) & (bottom > top),
        F.struct(
            ((left + right) / F.lit(2.0) / width).alias("x"),
            ((top + bottom) / F.lit(2.0) / height).alias("y"),
            ((right - left) / width).alias("w"),
            ((bottom - top) / height).alias("h"),
        ),
    )

def parse_points(text: Column) -> Column:
    """``x,y;x,y`` as an array of points; blank parts are skipped."""
    parts = F.filter(F.split(text, ";"), lambda p: F.trim(p) != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.trim(F.split_part(p, F.lit(","), F.lit(1))).cast("double").alias("x"),
            F.trim(F.split_part(p, F.lit(","), F.lit(2))).cast("double").alias("y"),
        ),
    )

def normalised_polygon(points: Column, width: Column, height: Column) -> Column:
    """Clamped, normalised points; null below three points or two pixels of extent."""
    scaled = F.transform(
        points,
        lambda p: F.struct(
            (clamp(p["x"], width) / width).alias("x"), (clamp(p["y"], height) / height).alias("y")
        ),
    )

    def extent(axis: str) -> Column:
        values = F.transform(scaled, lambda p: p[axis])
        return F.array_max(values) - F.array_min(values)

    return F.when(
        (F.size(points) >= 3) & (extent("x") * width >= 2.0) & (extent("y") * height >= 2.0), scaled
    )

def bounding_box(points: Column) -> Column:
    """Integer axis-aligned box of an array of points, null when empty or not finite."""
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    finite = F.forall(points, lambda p: is_finite(p["x"]) & is_finite(p["y"]))
    left, top = F.floor(F.array_min(xs)), F.floor(F.array_min(ys))
    right, bottom = F.ceil(F.array_max(xs)), F.ceil(F.array_max(ys))
    return F.when(
        (F.size(points) >= 2) & finite & (right > left) & (bottom > top),
        F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")),
    )
