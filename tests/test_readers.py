import hashlib
import json

import pytest

from pyspark.sql import functions as F
from trackloom.operators.datasets import convert_polygons
from trackloom.sources import files as FI

XML = """<annotations>
  <image name="b/2.jpg" width="200" height="100">
    <polygon label="road" points="0,0;100,0;100,50"/>
    <polygon label="road" points="0,0;100,0"/>
    <polygon label="sky" points="-5,-5;300,0;300,300;0,300"/>
  </image>
  <image name="b/3.jpg" width="200" height="100"></image>
  <image name="b/4.jpg" width="200" height="100"><polygon points="1,1;2,2;3,1"/></image>
</annotations>"""


def test_polygons_are_read_and_become_label_lines(spark, tmp_path):
    path = tmp_path / "a.xml"
    path.write_text(XML)
    read = FI.read_cvat(spark, str(path), shape="polygon")
    rows = {(r["name"], r["pos"]): r for r in read.collect()}
    assert set(rows) == {("2.jpg", 0), ("2.jpg", 1), ("2.jpg", 2), ("3.jpg", None), ("4.jpg", 0)}
    assert rows["4.jpg", 0]["fault"] == "shape_without_label" and rows["3.jpg", None]["fault"] is None
    shapes = read.filter("label is not null").withColumn("scene", F.lit("s")).withColumn(
        "class_id", F.when(F.col("label") == "road", 0).otherwise(1)
    )
    out = {r["line"]: (r["is_invalid"], r["stem"], r["split"]) for r in convert_polygons(shapes).collect()}
    assert out["0 0.000000 0.000000 0.500000 0.000000 0.500000 0.500000"] == (False, "s_2", "train")
    # corners outside are drawn to the edge, two corners are no polygon
    assert out["1 0.000000 0.000000 1.000000 0.000000 1.000000 1.000000 0.000000 1.000000"][0] is False
    assert out[None] == (True, "s_2", "train")


def test_manifest_summary_and_annotations_as_files(spark, tmp_path):
    videos = [{"id": "v1", "category": "bus", "video_paths": ["a.mp4"]}, {"id": "v2", "category": "kiosk"}, {"id": "v1"}, {"id": " "}]
    (tmp_path / "manifest.json").write_text(json.dumps({"dataset_id": "d", "videos": videos}, indent=2))
    manifest = FI.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert sorted((r["video_id"], r["fault"]) for r in manifest.collect()) == [(" ", "blank_id"), ("v1", None), ("v1", None), ("v2", None)]
    assert [tuple(r) for r in FI.repeated_ids(manifest).collect()] == [("v1", 2)]
    runs = [{"video_id": "v1", "status": "failed"}, {"video_id": "", "status": "x"}, {"video_id": "v1", "status": "completed"}, {"video_id": "v2"}]
    (tmp_path / "summary.json").write_text(json.dumps({"videos": runs}, indent=1))
    summary = FI.read_run_summary(spark, str(tmp_path / "summary.json"))
    assert sorted((r["video_id"], r["status"]) for r in summary.collect()) == [("v1", "completed"), ("v2", None)]
    (tmp_path / "v1.json").write_text(json.dumps({"video_id": "v1", "review_status": "reviewed", "objects": []}, indent=1))
    told = FI.join_annotations(manifest.filter("fault is null").dropDuplicates(["video_id"]), FI.read_annotations(spark, str(tmp_path / "v1.json")))
    assert sorted((r["video_id"], r["review_status"]) for r in told.collect()) == [("v1", "reviewed"), ("v2", None)]


def test_mapping_faults(spark):
    rows = [("bus", None), ("bus", None), ("car", None), ("coach", "bus"), ("ship", "boat")]
    found = FI.mapping_faults(spark.createDataFrame(rows, "label string, target string"))
    assert sorted(map(tuple, found.collect())) == [("bus", "repeated_class"), ("ship", "unknown_target")]


def labels(spark, rows):
    return spark.createDataFrame(rows, "split string, stem string, pos int, line string")


def test_label_files_are_one_per_image(spark, tmp_path):
    stems = ["a", "b=1/2", "50% +x", "音", "", None]
    rows = [("train", s, p, f"{p} {s}") for s in stems for p in (2, 0, 1)] + [("val", "a", 0, "v"), ("val", "a", 1, None)]
    path = str(tmp_path / "labels")
    FI.write_label_files(labels(spark, rows).repartition(5), path)
    found = FI.list_assets(spark, path, suffixes=(".txt",)).collect()
    # an empty name and none are one folder, as Spark writes them
    assert len(found) == 6 and all(r.path.startswith("file:/") and r.length > 0 and r.modificationTime for r in found)
    read = [(r.split, r.stem, r.pos, r.line) for r in FI.read_label_files(spark, path).collect()]
    assert sorted(r for r in read if r[1]) == sorted(r for r in rows if r[1] and r[3])
    assert sorted(r[3] for r in read if r[1] is None) == sorted(r[3] for r in rows if r[1] in ("", None))
    plain = spark.read.schema("value string, split string, stem string").text(path)
    assert sorted(map(tuple, plain.select("split", "stem", "value").collect()), key=repr) == sorted(((a, b, d) for a, b, _, d in read), key=repr)
    sums = {r.path: (r.length, r.sha1) for r in FI.checksum_assets(spark, path).collect()}
    for r in found:
        with open(r.path.removeprefix("file:"), "rb") as stream:
            content = stream.read()
        assert sums[r.path] == (len(content), hashlib.sha1(content).hexdigest())


def test_modes_of_written_folders(spark, tmp_path):
    path = (tmp_path / "labels").as_uri()
    first = labels(spark, [("train", "a", 0, "1")])
    FI.write_label_files(first, path)
    with pytest.raises(FileExistsError):
        FI.write_label_files(first, path)
    FI.write_label_files(first, path, mode="append")
    assert FI.read_label_files(spark, path).count() == 2
    FI.write_label_files(first, path, mode="overwrite")
    assert FI.read_label_files(spark, path).count() == 1
    FI.write_label_files(first.filter("false"), path, mode="overwrite")
    assert FI.read_label_files(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        FI.list_assets(spark, str(tmp_path / "none"))


def test_a_source_is_one_log_however_its_rows_are_spread(spark, tmp_path, monkeypatch):
    records = spark.range(60).select((F.col("id") % 3).alias("source_id"), F.floor(F.col("id") / 3).alias("frame_index"), F.lit(0.5).alias("timestamp_s"), F.array(F.lit("말")).alias("narrations")).repartition(20)
    FI.write_frames(records, str(tmp_path / "whole"))
    logs = list((tmp_path / "whole").glob("source_id=*/*.json"))
    assert len(logs) == 3
    assert [json.loads(x)["frame_index"] for x in logs[0].read_text().splitlines()] == list(range(20))
    monkeypatch.setattr(FI, "LOG_FRAMES", 2)
    FI.write_frames(records, str(tmp_path / "parts"))
    for path in ("whole", "parts"):
        read = FI.read_frames(spark, str(tmp_path / path)).select(F.regexp_extract("file_path", "source_id=([0-9]+)", 1).cast("bigint"), "frame_index", "timestamp_s", "narrations")
        assert sorted(map(tuple, read.collect())) == sorted(tuple(r) for r in records.collect())
    assert len(list((tmp_path / "parts").glob("source_id=0/*.json"))) > 1
