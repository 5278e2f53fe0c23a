"""Queries: tables written as files in the shared folder and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from trackloom.operators import datasets as D
from trackloom.session import scratch_path
from trackloom.sources import files as FI
from workload.joins import BOXES_SQL, labelled_boxes
from workload.registry import query
from workload.scalars import CRC_TABLE_SQL, crc32_sql
from workload.scenes import annotation_documents
from workload.views import detections, table


def written_frames(spark, sf):
    det = detections(spark, sf)
    frames = det.groupBy("source_id", "frame_index").agg(
        F.max("timestamp_s").alias("timestamp_s"), F.max("k").cast("double").alias("inference_ms")
    )
    item = F.struct(
        "class_id",
        "class_name",
        "confidence",
        "track_id",
        F.array("x1", "y1", "x2", "y2").alias("xyxy"),
        F.concat("class_name", F.lit(":"), "stable_id").alias("stable_object_key"),
    )
    items = det.select("source_id", "frame_index", F.col("det_index").alias("pos"), item.alias("item"))
    said = det.filter("k % 2 = 0").select(
        "source_id",
        "frame_index",
        F.col("det_index").alias("pos"),
        F.concat(F.lit("말 "), F.col("k").cast("string")).alias("item"),
    )
    path = scratch_path(spark, "frames")
    FI.write_frames(FI.frame_records(frames, items, narrations=said), path)
    return path


@query(
    "a1_read_frames",
    """SELECT source_id, frame_index, class_name || ':' || stable_id AS object_key, track_id, x2
       FROM det""",
)
def a1(spark, sf):
    frames = FI.read_frames(spark, written_frames(spark, sf)).withColumn(
        "source_id", F.regexp_extract("file_path", "source_id=([0-9]+)", 1).cast("bigint")
    )
    return FI.detections_of(frames).select(
        "source_id",
        "frame_index",
        F.col("stable_object_key").alias("object_key"),
        "track_id",
        F.get("xyxy", F.lit(2)).alias("x2"),
    )


@query(
    "a2_write_frames",
    """SELECT source_id, frame_index, count_if(k % 2 = 0) AS said, max(timestamp_s) AS timestamp_s
       FROM det GROUP BY 1, 2""",
)
def a2(spark, sf):
    frames = FI.read_frames(spark, written_frames(spark, sf))
    return frames.select(
        F.regexp_extract("file_path", "source_id=([0-9]+)", 1).cast("bigint").alias("source_id"),
        "frame_index",
        F.coalesce(F.size("narrations"), F.lit(0)).cast("bigint").alias("said"),
        "timestamp_s",
    )


@query(
    "a3_read_manifest",
    """SELECT 'p' || p_partkey AS video_id, CASE WHEN p_partkey % 10 = 0 THEN 'absolute_path' END AS fault
       FROM part""",
)
def a3(spark, sf):
    """One manifest per brand, written and read back."""
    key = F.col("p_partkey").cast("string")
    root = F.when(F.col("p_partkey") % 10 == 0, "/").otherwise("")
    video = F.struct(
        F.concat(F.lit("p"), key).alias("id"),
        F.col("p_type").alias("category"),
        F.array(F.concat(root, F.lit("v/"), key)).alias("video_paths"),
    )
    path = scratch_path(spark, "manifest")
    manifests = table(spark, sf, "part").groupBy("p_brand", (F.col("p_partkey") % 64).alias("b")).agg(
        F.collect_list(video).alias("videos")
    )
    manifests.select(F.col("p_brand").alias("dataset_id"), "videos").write.json(path)
    # many documents, one per line; read_manifest reads one that spans lines
    raw = spark.read.schema(FI.schemas.MANIFEST).json(path)
    return FI.manifest_rows(raw).select("video_id", "fault")


@query(
    "a4_read_annotations",
    """SELECT stable_id AS video_id, count(*) * CASE WHEN any_value(u) % 4 = 0 THEN 2 ELSE 1 END AS intervals
       FROM det GROUP BY 1""",
)
def a4(spark, sf):
    path = scratch_path(spark, "annotations")
    annotation_documents(spark, sf).write.json(path)
    found = FI.read_annotations(spark, path, multi_line=False)
    return found.select("video_id", F.explode("objects").alias("o")).groupBy("video_id").agg(
        F.sum(F.size("o.signal_state_intervals")).alias("intervals")
    )


@query(
    "a5_run_summary",
    """SELECT 'c' || o_custkey AS video_id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1""",
)
def a5(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("video_id"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_orderstatus").alias("status"),
    )
    return D.last_per_key(rows, ["video_id"], "pos").select("video_id", "status")


def cvat_export(spark, sf):
    """Annotation XML with one image element per frame."""
    det = detections(spark, sf)
    box = F.struct(
        F.col("class_name").alias("_label"),
        *[F.col(c).alias(n) for c, n in (("x1", "_xtl"), ("y1", "_ytl"), ("x2", "_xbr"), ("y2", "_ybr"))],
    )
    name = F.concat(
        F.lit("a/"),
        F.col("source_id").cast("string"),
        F.lit("_"),
        F.col("frame_index").cast("string"),
        F.lit(".jpg"),
    )
    images = det.groupBy("source_id", "frame_index").agg(F.collect_list(box).alias("box"))
    path = scratch_path(spark, "cvat")
    images.select(
        name.alias("_name"), F.lit(640).alias("_width"), F.lit(480).alias("_height"), "box"
    ).write.format("xml").option("rootTag", "annotations").option("rowTag", "image").save(path)
    return path


@query(
    "a6_read_cvat",
    """SELECT source_id || '_' || frame_index || '.jpg' AS name, class_name AS label, x1, y1, x2, y2 FROM det""",
)
def a6(spark, sf):
    boxes = FI.read_cvat(spark, cvat_export(spark, sf))
    return boxes.select("name", "label", "x1", "y1", "x2", "y2")


@query(
    "a7_class_mapping",
    """SELECT n_name AS label, n_nationkey AS class_id FROM nation
       UNION ALL SELECT r_name, min(n_nationkey) FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1""",
)
def a7(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    classes = nation.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("c"))
    first = (
        nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
        .groupBy("r_name")
        .agg(F.min_by("n_name", "n_nationkey").alias("target"))
        .agg(F.map_from_entries(F.collect_list(F.struct("r_name", "target"))).alias("label_map"))
    )
    # 25 nations and 5 regions: fixed dimension tables, one mapping document
    path = scratch_path(spark, "classes")
    classes.select(F.transform("c", lambda x: x["n_name"]).alias("classes")).join(
        F.broadcast(first)
    ).write.json(path)
    return D.label_classes(FI.read_class_mapping(spark, path))


@query(
    "a9_label_files",
    BOXES_SQL + "SELECT 'i' || c_custkey // 3 AS stem, count(*) AS lines FROM boxes JOIN classes USING (label) GROUP BY 1",
)
def a9(spark, sf):
    path = scratch_path(spark, "labels")
    FI.write_label_files(converted_labels(spark, sf), path)
    return FI.read_label_files(spark, path).groupBy("stem").agg(F.count(F.lit(1)).alias("lines"))


def converted_labels(spark, sf):
    boxes, classes = labelled_boxes(spark, sf)
    key = F.col("c_custkey")
    placed = D.map_labels(boxes, classes).filter("class_id is not null").select(
        F.concat(F.lit("i"), F.floor(key / 3).cast("string"), F.lit(".jpg")).alias("name"),
        key.alias("pos"),
        "label",
        "class_id",
        (key % 50).cast("double").alias("x1"),
        F.lit(10.0).alias("y1"),
        (key % 50 + 30).cast("double").alias("x2"),
        F.lit(40.0).alias("y2"),
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
    )
    return D.convert_boxes(placed, val_fraction=0.1)


@query(
    "a8_list_assets",
    BOXES_SQL
    + f""", {CRC_TABLE_SQL}, stems AS (SELECT DISTINCT 'i' || c_custkey // 3 AS stem FROM boxes JOIN classes USING (label))
SELECT CASE WHEN {crc32_sql("stem")} % 1000 < 100 THEN 'val' ELSE 'train' END AS split, count(*) AS files
FROM stems, crc_table GROUP BY 1""",
)
def a8(spark, sf):
    path = scratch_path(spark, "labels")
    FI.write_label_files(converted_labels(spark, sf), path)
    found = FI.list_assets(spark, path, suffixes=(".txt",))
    split = F.regexp_extract("path", "split=([a-z]+)", 1)
    return found.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("files"))


@query(
    "a10_reports",
    """SELECT source_id, event_type, count(*) AS n FROM det GROUP BY 1, 2""",
)
def a10(spark, sf):
    report = detections(spark, sf).groupBy("source_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("state")).alias("states")
    )
    path = scratch_path(spark, "report")
    FI.write_report(report, path)
    return spark.read.schema("source_id bigint, event_type string, n bigint, states string").csv(
        f"{path}/csv", header=True
    ).drop("states")


@query(
    "a12_verify_assets",
    BOXES_SQL
    + """, stems AS (SELECT DISTINCT c_custkey // 3 AS n FROM boxes JOIN classes USING (label))
SELECT ['unexpected_size', 'sha1_mismatch', 'ok'][n % 3 + 1] AS status, count(*) AS files FROM stems GROUP BY 1""",
)
def a12(spark, sf):
    path = scratch_path(spark, "labels")
    FI.write_label_files(converted_labels(spark, sf), path)
    found = FI.checksum_assets(spark, path)
    turn = F.regexp_extract("path", "stem=i([0-9]+)", 1).cast("int") % 3
    manifest = found.select(
        "path",
        (F.col("length") + F.when(turn == 0, 10_000).otherwise(100)).alias("expected_size_bytes"),
        F.when(turn == 1, "0").otherwise(F.col("sha1")).alias("expected_sha1"),
    )
    status = D.asset_status(found, manifest, key="path")
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query(
    "a13_draft_annotations",
    """SELECT 'd' || doc_id AS video_id, 'needs_manual_review' AS review_status
       FROM documents ANTI JOIN labels USING (doc_id)""",
)
def a13(spark, sf):
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("video_id")
    manifest = table(spark, sf, "documents").select(key)
    drafts = D.draft_annotations(manifest, table(spark, sf, "labels").select(key))
    return drafts.select("video_id", "review_status")


@query(
    "l1_user_detector",
    """SELECT event_id, confidence >= 0.5 AS kept FROM det""",
)
def l1(spark, sf):
    """A user model over batches of frames, loaded once per partition."""
    from trackloom.plans.extensions import apply_model

    def load():
        return lambda batch: batch.assign(kept=batch["confidence"] >= 0.5)[["event_id", "kept"]]

    rows = detections(spark, sf).select("event_id", "confidence")
    return apply_model(rows, load, "event_id bigint, kept boolean")


@query(
    "l2_isolated_sources",
    """SELECT source_id, CASE WHEN source_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN source_id % 5 = 0 THEN 'ValueError: no frames' END AS error,
       CASE WHEN source_id % 5 > 0 THEN count(*) END AS results, CASE WHEN source_id % 5 > 0 THEN sum(k) END AS total FROM det GROUP BY 1""",
)
def l2(spark, sf):
    """A user step that fails for some sources leaves a status, not a failed job; the others keep their results."""
    from trackloom.plans.extensions import isolated

    def step(rows):
        if (rows["source_id"] % 5 == 0).any():
            raise ValueError("no frames")
        return rows.assign(score=rows["k"])

    rows = detections(spark, sf).select("source_id", "event_id", "k")
    results, status = isolated(rows, step, "source_id", "event_id bigint, score bigint")
    counted = results.groupBy("source_id").agg(F.count("event_id").alias("results"), F.sum("score").alias("total"))
    return status.join(counted, "source_id", "left")


@query(
    "l3_text_reader",
    """SELECT event_id, k % 9 > 0 AS has_result, CASE WHEN k % 9 = 0 THEN 'RuntimeError: blurred' END AS error,
       CASE WHEN k % 9 > 0 THEN upper(class_name) END AS text, CASE WHEN k % 9 > 0 THEN k / 100::DOUBLE END AS text_confidence FROM det""",
)
def l3(spark, sf):
    """A user's text reader: rows on which it fails carry its error and no result."""
    from trackloom.plans.extensions import read_by

    def load():
        def reader(batch):
            if (batch["k"] % 9 == 0).any():
                raise RuntimeError("blurred")
            return pd.DataFrame({"text": batch["class_name"].str.upper(), "confidence": batch["k"] / 100})

        return reader

    read = read_by(detections(spark, sf).select("event_id", "class_name", "k"), load, "text string, confidence double")
    return read.select(
        "event_id",
        F.col("reading.result").isNotNull().alias("has_result"),
        "reading.error",
        "reading.result.text",
        F.col("reading.result.confidence").alias("text_confidence"),
    )
