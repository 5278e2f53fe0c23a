"""Annotation files to training labels, asset checks and run bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import fixed
from trackloom.functions.classes import category_token
from trackloom.functions.geometry import normalised_box, normalised_polygon, parse_points
from trackloom.functions.text import basename, hash_split, stem


def detector_filter(
    det: DataFrame, *, class_ids: Sequence[int] | None = None, minimum_confidence: float = 0.10
) -> DataFrame:
    """Class list and minimum confidence; both reach a Parquet scan."""
    kept = det.filter(F.col("confidence") >= minimum_confidence)
    return kept if class_ids is None else kept.filter(F.col("class_id").isin(*class_ids))


def class_filter(det: DataFrame, category: str = "category") -> DataFrame:
    """Keep the classes of each row's category; categories without a list keep all."""
    token = category_token(F.col(category))
    allowed = F
    for name, ids in fixed.CATEGORY_CLASS_IDS.items():
        if ids is not None:
            allowed = allowed.when(token == name, F.col("class_id").isin(*ids))
    return det.filter(allowed.otherwise(True))


def missing_required_classes(
    sources: DataFrame, observed: DataFrame, *, keys: Sequence[str] = ("source_id",)
) -> DataFrame:
    """Sources whose category needs a class that was never observed."""
    pairs = [
        F.struct(F.lit(name).alias("category_token"), F.lit(cls).alias("class_token"))
        for name, classes in fixed.REQUIRED_CLASSES.items()
        for cls in classes
    ]
    needed = (
        sources.withColumn("_token", category_token(F.col("category")))
        .select(*keys, "category", "_token", F.explode(F.array(*pairs)).alias("need"))
        .filter(F.col("_token") == F.col("need.category_token"))
    )
    seen = observed.select(*keys, category_token(F.col("class_name")).alias("_class"))
    met = needed.join(seen, list(keys)).filter(F.col("need.class_token") == F.col("_class"))
    return (
        needed.join(met.select(*keys), list(keys), "left_anti")
        .groupBy(*keys, "category")
        .agg(F.array_sort(F.collect_set("need.class_token")).alias("required_classes"))
    )


def label_classes(mapping: DataFrame) -> DataFrame:
    """Every label with its class: canonical names and aliases of one mapping file.

    ``mapping`` is the output of :func:`trackloom.sources.files.read_class_mapping`.
    """
    canonical = mapping.filter("target is null").select("label", "class_id")
    aliases = mapping.filter("target is not null").select(
        F.col("label").alias("alias"), F.col("target").alias("label")
    )
    named = aliases.join(canonical, "label").select(F.col("alias").alias("label"), "class_id")
    # an alias wins over a class of the same name
    plain = canonical.join(named.select("label"), "label", "left_anti")
    return named.unionByName(plain)


def map_labels(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """Add class_id to every labelled box, null for unknown labels."""
    return boxes.join(classes, "label", "left")


def unknown_labels(boxes: DataFrame, classes: DataFrame, source: str = "source_file") -> DataFrame:
    """Unknown labels with their count and number of files.

    Counted per label and file first, so that a frequent label is not
    gathered in one place.
    """
    rare = boxes.join(classes, "label", "left_anti")
    per_file = rare.groupBy("label", source).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("label").agg(
        F.sum("n").alias("boxes"), F.count(F.lit(1)).alias("files")
    )


def duplicates(df: DataFrame, key: Column, name: str = "name") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def match_images(images: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotated images joined to files by base name: matched, missing, ambiguous.

    ``images`` has name, ``files`` has path. Base names found twice among the
    files are ambiguous and belong to an error report.
    """
    named = files.select("path", basename(F.col("path")).alias("name"))
    ambiguous = duplicates(named, F.col("name"))
    matched = images.join(named, "name")
    missing = images.join(named.select("name"), "name", "left_anti")
    return matched, missing, ambiguous


def label_line(class_id: Column, values: Column) -> Column:
    """``class v v v v`` with six decimals."""
    numbers = F.transform(values, lambda v: F.format_string("%.6f", v))
    return F.concat_ws(" ", class_id.cast("string"), F.array_join(numbers, " "))


def convert_boxes(
    boxes: DataFrame, *, base_split: str = "train", val_fraction: float = 0.0
) -> DataFrame:
    """Boxes with class ids as label lines; ``line`` is null where the box is degenerate.

    Needs name, pos, class_id, x1, y1, x2, y2, width, height.
    """
    n = normalised_box("x1", "y1", "x2", "y2", F.col("width"), F.col("height"))
    return (
        boxes.withColumns({"_n": n, "stem": stem(F.col("name"))})
        .withColumns(
            {
                "line": F.when(
                    F.col("_n").isNotNull() & F.col("class_id").isNotNull(),
                    label_line(F.col("class_id"), F.array("_n.x", "_n.y", "_n.w", "_n.h")),
                ),
                "is_invalid": F.col("_n").isNull() & F.col("class_id").isNotNull(),
                "split": hash_split(F.col("stem"), base_split, val_fraction),
            }
        )
        .drop("_n")
    )


def convert_polygons(
    polygons: DataFrame, *, base_split: str = "train", val_fraction: float = 0.0
) -> DataFrame:
    """Polygons as label lines, split by whole scenes.

    Needs scene, name, pos, class_id, width, height and the corners, as ``points`` or, as
    :func:`trackloom.sources.files.read_cvat` gives them, as ``points_text``.
    """
    if "points" not in polygons.columns:
        polygons = polygons.withColumn("points", parse_points(F.col("points_text")))
    n = normalised_polygon(F.col("points"), F.col("width"), F.col("height"))
    flat = F.flatten(F.transform("_n", lambda p: F.array(p["x"], p["y"])))
    return (
        polygons.withColumn("_n", n)
        .withColumns(
            {
                "stem": F.concat_ws("_", "scene", stem(F.col("name"))),
                "line": F.when(
                    F.col("_n").isNotNull() & F.col("class_id").isNotNull(),
                    label_line(F.col("class_id"), flat),
                ),
                "is_invalid": F.col("_n").isNull() & F.col("class_id").isNotNull(),
                "split": hash_split(F.col("scene"), base_split, val_fraction),
            }
        )
        .drop("_n")
    )


def conversion_stats(images: DataFrame, converted: DataFrame) -> DataFrame:
    """Totals of a conversion as (measure, item, n) rows.

    ``images`` are the matched images (name, split), ``converted`` the boxes.
    """
    per_image = converted.groupBy("name").agg(F.count("line").alias("kept"))
    with_boxes = images.join(per_image, "name", "left").withColumn(
        "kept", F.coalesce("kept", F.lit(0))
    )
    one = F.lit(None).cast("string")
    totals = with_boxes.agg(
        F.count(F.lit(1)).alias("converted_images"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("converted_boxes"),
        F.count_if(F.col("kept") == 0).alias("empty_images"),
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("measure"), one.alias("item"), F.col(c).alias("n"))
                    for c in ("converted_images", "converted_boxes", "empty_images")
                ]
            )
        )
    )
    invalid = converted.agg(F.count_if("is_invalid").alias("n")).select(
        F.lit("excluded_invalid_boxes").alias("measure"), one.alias("item"), "n"
    )
    labels = (
        converted.groupBy(F.col("label").alias("item"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("source_class").alias("measure"), "item", "n")
    )
    unknown = (
        converted.filter("class_id is null")
        .groupBy(F.col("label").alias("item"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("unknown_label").alias("measure"), "item", "n")
    )
    splits = (
        images.groupBy(F.col("split").alias("item"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("split").alias("measure"), "item", "n")
    )
    return (
        totals.unionByName(invalid).unionByName(labels).unionByName(unknown).unionByName(splits)
    )


def label_census(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Counts of a label, most frequent first; ``limit`` is the top-k of the report."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.orderBy(F.col("n").desc(), column)
    return ordered if limit is None else ordered.limit(limit)


def even_sample(sources: DataFrame, count: int = 12, *, frames: str = "frame_count") -> DataFrame:
    """Evenly spaced frame numbers of every source, both ends included."""
    n = F.col(frames)
    if count == 1:
        spaced = F.array(F.lit(0).cast("bigint"))
    else:
        spaced = F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)),
            lambda i: F.bround(i * (n - 1) / F.lit(float(count - 1))).cast("bigint"),
        )
    every = F.when(n <= count, F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint")))
    return sources.filter(n > 0).select(
        "*", F.explode(F.array_distinct(F.coalesce(every, spaced))).alias("frame_index")
    )


def first_existing(candidates: DataFrame, files: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """First candidate path of every key that exists; needs path and pos."""
    return (
        candidates.join(files.select("path").distinct(), "path", "left_semi")
        .groupBy(*keys)
        .agg(F.min_by("path", "pos").alias("path"))
    )


def missing_annotations(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Sources of a manifest that have no annotation document yet."""
    return manifest.join(existing.select("video_id"), "video_id", "left_anti")


def draft_annotations(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Empty documents for sources without one; never any guessed labels."""
    wanted = missing_annotations(manifest, existing)
    metadata = [
        (F.col(c) if c in wanted.columns else F.lit(None)).cast(t).alias(c)
        for c, t in (("fps", "double"), ("frame_count", "int"), ("width", "int"), ("height", "int"))
    ]
    texts = F.array().cast("array<string>")
    return wanted.select(
        F.lit(fixed.ANNOTATION_VERSION).alias("schema_version"),
        "video_id",
        F.lit("needs_manual_review").alias("review_status"),
        F.struct(*metadata).alias("video_metadata"),
        F.array().cast("array<string>").alias("objects"),
        F.struct(
            texts.alias("forbidden_phrases"),
            texts.alias("forbidden_patterns"),
            F.lit(0).alias("maximum_duplicate_events"),
            F.lit("Human review required.").alias("notes"),
        ).alias("narration_constraints"),
    )


def asset_status(files: DataFrame, manifest: DataFrame, *, key: str = "name") -> DataFrame:
    """Size and checksum of every expected file against the manifest.

    ``files`` has name, length and sha1; ``manifest`` has name,
    expected_size_bytes and expected_sha1.
    """
    joined = manifest.join(files, key, "left")
    tolerance = F.greatest(
        F.lit(4096), F.floor(F.col("expected_size_bytes") * F.lit(0.02)).cast("bigint")
    )
    off = F.abs(F.col("length") - F.col("expected_size_bytes")) > tolerance
    wrong = (F.coalesce("expected_sha1", F.lit("")) != "") & (
        F.lower("sha1") != F.lower("expected_sha1")
    )
    return joined.withColumn(
        "status",
        F.when(F.coalesce(F.col("length"), F.lit(0)) == 0, "empty_or_missing")
        .when(off, "unexpected_size")
        .when(wrong, "sha1_mismatch")
        .otherwise("ok"),
    )


def last_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last row of every key by an aggregation, blank keys dropped."""
    named = rows.filter(" and ".join(f"trim({k}) <> ''" for k in keys))
    rest = [c for c in rows.columns if c not in keys]
    return (
        named.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_last"))
        .select(*keys, "_last.*")
    )


def first_occurrence(
    rows: DataFrame, keys: Sequence[str], order: str, *, within: Sequence[str] = ()
) -> DataFrame:
    """First row of every distinct key, found without sorting a group."""
    by = [*within, *keys]
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_f")).select(*by, "_f.*")


def top_by(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int
) -> DataFrame:
    """Top rows per key; Spark limits every partition before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= count)
