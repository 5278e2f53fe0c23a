"""Reading and writing frame logs, annotations, labels and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import fixed
from trackloom.functions.strings import strip
from trackloom.functions.text import basename
from trackloom.operators.datasets import last_per_key
from trackloom.sources import schemas, trees

#: frames of a source that one task writes
LOG_FRAMES = 100_000

# --- frame logs ------------------------------------------------------------------------


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines frame logs; a malformed line fails the read, blank lines are skipped.

    A log written by :func:`write_frames` carries its source in the folder
    name; ``file_path`` tells the file of every frame.
    """
    return (
        spark.read.schema(schemas.FRAME)
        .option("mode", "FAILFAST")
        .option("allowNonNumericNumbers", True)
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("file_path"))
    )


def frame_records(frames: DataFrame, detections: DataFrame, **parts: DataFrame) -> DataFrame:
    """Nested frame records from flat tables.

    ``detections`` has ``pos`` and one struct column ``item``; so have the
    optional parts events, analysis_results, analysis_events and narrations.
    Arrays hold what one frame holds, never more.
    """
    keys = ["source_id", "frame_index"]
    nested = frames
    for name, df in {"detections": detections, **parts}.items():
        listed = df.groupBy(*keys).agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]
            ).alias(name)
        )
        nested = nested.join(listed, keys, "left")
    return nested


def write_frames(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per frame, one folder per source; nulls are left out.

    A source is one file for every ``LOG_FRAMES`` frames, more only where a task ends, so no source has to fit in one task.
    """
    record = F.to_json(F.struct(*[c for c in records.columns if c != "source_id"]))
    rows = records.select("source_id", "frame_index", record.alias("line"))
    chunk = F.floor(F.col("frame_index") / LOG_FRAMES)
    trees.write_lines(rows, path, ["source_id"], "line", order=["frame_index"], spread=[chunk], mode=mode, suffix=".json")


def detections_of(frames: DataFrame) -> DataFrame:
    return frames.select(
        *[c for c in ("source_id", "file_path") if c in frames.columns],
        "frame_index",
        F.posexplode("detections").alias("pos", "d"),
    ).select("*", "d.*").drop("d")


def analyses_of(frames: DataFrame) -> DataFrame:
    return frames.select(
        "source_id", "frame_index", F.posexplode("analysis_results").alias("pos", "r")
    ).select("*", "r.*").drop("r")


def events_of(frames: DataFrame) -> DataFrame:
    """Events of the new form where a frame has that list, else of the old one."""
    return frames.select(
        "source_id",
        "frame_index",
        F.posexplode(F.coalesce("analysis_events", "events")).alias("pos", "e"),
    ).select("*", "e.*").drop("e")


def narrations_of(frames: DataFrame) -> DataFrame:
    return frames.select(
        "source_id", "frame_index", F.posexplode("narrations").alias("pos", "message")
    ).filter(strip(F.col("message")) != "")


# --- manifests, annotations, run summaries ---------------------------------------------------


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per video; ids that are blank or repeated and absolute paths are faults."""
    return manifest_rows(spark.read.schema(schemas.MANIFEST).json(path, multiLine=True))


def manifest_rows(raw: DataFrame) -> DataFrame:
    videos = raw.select("dataset_id", F.inline("videos")).withColumnRenamed("id", "video_id")
    absolute = F.exists(
        F.coalesce("video_paths", F.array().cast("array<string>")), lambda p: p.startswith("/")
    )
    return videos.withColumn(
        "fault",
        F.when(F.coalesce(strip(F.col("video_id")), F.lit("")) == "", "blank_id")
        .when(absolute | F.coalesce(F.startswith("annotation_path", F.lit("/")), F.lit(False)), "absolute_path"),
    )


def repeated_ids(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def read_annotations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schemas.ANNOTATION).json(path, multiLine=multi_line)


def join_annotations(manifest: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations by video id; a manifest row without one keeps nulls."""
    return manifest.select("video_id", "category").join(annotations, "video_id", "left")


def read_run_summary(spark: SparkSession, path: str) -> DataFrame:
    """Last row per video of a run summary; blank ids are dropped."""
    raw = spark.read.schema(schemas.RUN_SUMMARY).json(path, multiLine=True)
    rows = raw.select(F.posexplode("videos").alias("pos", "v")).select("pos", "v.*")
    return last_per_key(rows, ["video_id"], "pos").drop("pos")


# --- annotation exports ------------------------------------------------------------------------


def _coordinate(column: Column) -> Column:
    return F.coalesce(column, F.lit(float("nan")))


def read_cvat(spark: SparkSession, path: str, shape: str = "box") -> DataFrame:
    """Boxes or polygons of annotation XML, one row per shape; images without any keep a row.

    ``fault`` marks images and shapes without a required attribute.
    """
    schema = schemas.CVAT_BOX if shape == "box" else schemas.CVAT_POLYGON
    raw = spark.read.format("xml").option("rowTag", "image").schema(schema).load(path)
    images = raw.select(
        basename(F.col("_name")).alias("name"),
        F.col("_width").alias("width"),
        F.col("_height").alias("height"),
        F.posexplode_outer(shape).alias("pos", "s"),
    )
    label = F.col("s")["_label"]
    fault = F.when(
        F.col("name").isNull() | F.col("width").isNull() | F.col("height").isNull(),
        "incomplete_image",
    ).when(F.col("s").isNotNull() & label.isNull(), "shape_without_label")
    if shape == "box":
        values = {
            n: F.when(F.col("s").isNotNull(), _coordinate(F.col("s")[a]))
            for n, a in (("x1", "_xtl"), ("y1", "_ytl"), ("x2", "_xbr"), ("y2", "_ybr"))
        }
    else:
        values = {"points_text": F.col("s")["_points"]}
    return images.select(
        "name",
        "width",
        "height",
        "pos",
        label.alias("label"),
        *[v.alias(n) for n, v in values.items()],
        fault.alias("fault"),
    )


def read_class_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Rows (label, class_id, target): classes in order, then aliases with their target."""
    raw = spark.read.schema(schemas.CLASS_MAPPING).json(path, multiLine=True)
    classes = raw.select(F.posexplode("classes").alias("class_id", "label")).select(
        "label", "class_id", F.lit(None).cast("string").alias("target")
    )
    aliases = raw.select(F.explode("label_map").alias("label", "target")).select(
        "label", F.lit(None).cast("int").alias("class_id"), "target"
    )
    return classes.unionByName(aliases)


def mapping_faults(mapping: DataFrame) -> DataFrame:
    """Repeated classes and aliases without a class."""
    classes = mapping.filter("target is null")
    twice = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lost = mapping.filter("target is not null").join(
        classes.select(F.col("label").alias("target")), "target", "left_anti"
    )
    return twice.select("label", F.lit("repeated_class").alias("fault")).unionByName(
        lost.select("label", F.lit("unknown_target").alias("fault"))
    )


def list_assets(
    spark: SparkSession, root: str, suffixes=fixed.IMAGE_SUFFIXES, skip=fixed.MASK_DIR_NAMES
) -> DataFrame:
    """Files below a folder by suffix, without mask folders; contents are not read."""
    found = trees.files_below(spark, root)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    folders = F.split(F.lower("path"), "/")
    return found.filter(
        suffix.isin(*suffixes) & ~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skip]))
    )


def checksum_assets(spark: SparkSession, root: str) -> DataFrame:
    """Path, name, length and SHA-1 of every file below a folder."""
    found = trees.digests(trees.files_below(spark, root), root)
    return found.select("path", basename(F.col("path")).alias("name"), "length", "sha1")


def write_label_files(converted: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One file of label lines per image below ``split=.../stem=...``, in the order of the shapes.

    Refuses to overwrite unless told to by ``mode``.
    """
    trees.write_lines(converted.filter("line is not null"), path, ["split", "stem"], "line", order=["pos"], mode=mode)


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    """(split, stem, pos, line) of label files written by :func:`write_label_files`."""
    lines = trees.lines_of(trees.files_below(spark, path), path)
    value = {k: F.regexp_extract("path", f"/{k}=([^/]*)/", 1) for k in ("split", "stem")}
    # names are escaped by hundredths; a plus sign is one
    plain = {k: F.when(v != trees.NULL_NAME, F.url_decode(F.replace(v, F.lit("+"), F.lit("%2B")))) for k, v in value.items()}
    return lines.select(*[v.alias(k) for k, v in plain.items()], "pos", "line")


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The same rows as JSON lines and as CSV with nested cells as JSON text."""
    df.write.mode(mode).json(f"{path}/json")
    nested = ("array", "struct", "map")
    flat = [
        F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes
    ]
    df.select(*flat).write.mode(mode).option("header", True).option("emptyValue", "").csv(
        f"{path}/csv"
    )
