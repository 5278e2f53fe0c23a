import random
import tempfile

from trackloom.operators.scene import snapshot
from trackloom.streaming import snapshots as SN

SCHEMA = "session_id string, updated_at_ms long, seq long, visible_objects array<string>, scene_confidence double, raw_detections string"


def test_a_kept_snapshot_equals_one_pass(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice("abc"), rng.randint(0, 9) * 100, i, rng.choice([None, [], ["bus"], ["bus", "person"]]), rng.random(), rng.choice([None, "{}", "{1}"]))
        for i in range(60)
    ]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for batch_id in range(6):
        part = spark.createDataFrame(rows[batch_id * 10 : batch_id * 10 + 10], SCHEMA)
        SN.keep_snapshot(part, batch_id, folder)
        SN.keep_snapshot(part, batch_id, folder)  # a batch that is run again changes nothing
        if batch_id > 2:
            SN.keep_snapshot(spark.createDataFrame([("z", 10**6, 0, ["x"], 1.0, None)], SCHEMA), batch_id - 2, folder)
        whole = snapshot(spark.createDataFrame(rows[: batch_id * 10 + 10], SCHEMA))
        kept = SN.read_snapshot(spark, folder)
        assert kept.columns == whole.columns
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, whole.collect()))
    assert SN.versions(folder) == [4, 5]
