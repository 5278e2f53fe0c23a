"""The latest view of every session, kept in a table by a stream.

Each micro-batch writes a new version of the table, one row per session: the version before it and
the batch, merged. A version is a folder that counts as soon as its ``_SUCCESS`` file is there, so
readers always see one whole version and scan nothing else. A batch that is run again finds its
version written and changes nothing. The version before the newest stays for readers that still use
it, older ones are removed.
"""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.live import store_of

RAW = "raw_detections"


def _states(updates: DataFrame, key: str) -> DataFrame:
    """Updates in the form of the table: what was given last, with the moment that decides."""
    moment = F.struct("updated_at_ms", "seq")
    raw = F.col(RAW) if RAW in updates.columns else F.lit(None).cast("string")
    view = F.struct(moment.alias("at"), "visible_objects", "scene_confidence")
    return updates.select(
        key,
        "updated_at_ms",
        F.when(F.col("visible_objects").isNotNull(), view).alias("view"),
        F.when(raw.isNotNull(), F.struct(moment.alias("at"), raw.alias(RAW))).alias("raw"),
    )


def _merged(states: DataFrame, key: str) -> DataFrame:
    """One row per session; of equal moments the greater view stays."""
    return states.groupBy(key).agg(*(F.max(c).alias(c) for c in ("updated_at_ms", "view", "raw")))


def versions(folder: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    store, base = store_of(folder)
    found = store.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    numbers = sorted(int(f.base_name.removeprefix("version-")) for f in found if f.base_name.startswith("version-"))
    done = store.get_file_info([f"{base}/version-{n:012d}/_SUCCESS" for n in numbers]) if numbers else []
    return [n for n, f in zip(numbers, done) if f.type == pafs.FileType.File]


def keep_snapshot(batch: DataFrame, batch_id: int, folder: str, *, key: str = "session_id") -> None:
    """Bring the table of ``folder`` up to a micro-batch of updates; for ``foreachBatch``."""
    known = versions(folder)
    if known and known[-1] >= batch_id:
        return
    states = _states(batch, key)
    if known:
        states = states.unionByName(batch.sparkSession.read.parquet(f"{folder}/version-{known[-1]:012d}"))
    _merged(states, key).write.mode("overwrite").parquet(f"{folder}/version-{batch_id:012d}")
    store, base = store_of(folder)
    for number in known[:-1]:
        store.delete_dir(f"{base}/version-{number:012d}")


def read_snapshot(spark: SparkSession, folder: str, *, key: str = "session_id") -> DataFrame:
    """The newest version, in the columns of :func:`trackloom.operators.scene.snapshot`."""
    newest = versions(folder)[-1]
    return spark.read.parquet(f"{folder}/version-{newest:012d}").select(
        key, "updated_at_ms", "view.visible_objects", "view.scene_confidence", f"raw.{RAW}"
    )


def start_snapshot(updates: DataFrame, folder: str, checkpoint: str, *, key: str = "session_id"):
    """Keep the table of ``folder`` from a stream of updates, everything that is there, then end."""
    writer = updates.writeStream.foreachBatch(lambda batch, batch_id: keep_snapshot(batch, batch_id, folder, key=key))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
