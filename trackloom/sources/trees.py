"""Folders of many files: written, listed and read by the tasks.

Spark's own writer moves every file of a job on the driver, and its reader keeps the state of every
file there. Here each task writes the files of its keys in place and a folder is listed level by level, the
folders of a level dealt to all tasks. Files and folders whose names are hidden to Spark are skipped, names of
partitions are escaped as Spark does, so such a tree is a partitioned table to Spark too.

File systems are pyarrow's; a location is a plain path or a URI that it can open.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.session import scratch_path, tasks

NULL_NAME = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = {*map(chr, range(32)), *"\"#%'*/:=?\\{[]^\x7f"}
_FOUND = "path string, is_folder boolean, length bigint, modificationTime timestamp"
CHUNK = 1 << 20


def located(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path in it, and what precedes such a path in the name that Spark gives."""
    if ":/" not in path:
        return pafs.LocalFileSystem(), path.rstrip("/"), "file:"
    store, base = pafs.FileSystem.from_uri(path)
    base = base.rstrip("/")
    if isinstance(store, pafs.LocalFileSystem):
        return store, base, "file:"
    return store, base, path[: path.rindex(base)]


def folder_name(key: str, value: str | None) -> str:
    if not value:
        return f"{key}={NULL_NAME}"
    return f"{key}=" + "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)


def write_lines(rows: DataFrame, path: str, keys: Sequence[str], line: str, order: Sequence[str] = (), spread: Sequence = (), mode: str = "errorifexists", suffix: str = ".txt") -> None:
    """Lines of text below ``key=value`` folders, one file for each key and task.

    All rows of equal ``keys`` and ``spread`` come to one task, which writes their lines by ``order`` as they pass.
    A file gets its name once it is whole, the same name in every attempt, so a repeated task leaves no line
    twice. ``mode`` is one of Spark's.
    """
    spark = rows.sparkSession
    store, base, _ = located(path)
    if mode not in ("errorifexists", "error", "append", "overwrite", "ignore"):
        raise ValueError(f"no such mode: {mode}")
    if store.get_file_info(base).type != pafs.FileType.NotFound:
        if mode == "ignore":
            return
        if mode in ("errorifexists", "error"):
            raise FileExistsError(path)
        if mode == "overwrite":
            store.delete_dir(base)
    store.create_dir(base, recursive=True)
    tag = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base, _ = located(path)
        name = f"part-{TaskContext.get().partitionId():05d}-{tag}{suffix}"
        now = out = folder = hidden = None
        files = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            texts = columns.pop()
            # the last row stands for the end of the batch, the file stays open for the next one
            first = 0
            values = list(zip(*columns, strict=True))
            for at in range(1, len(texts) + 1):
                if at < len(texts) and values[at] == values[first]:
                    continue
                if out is None or values[first] != now:
                    if out is not None:
                        out.close()
                        store.move(hidden, f"{folder}/{name}")
                    now = values[first]
                    folder = "/".join([base, *(folder_name(k, v) for k, v in zip(keys, now, strict=True))])
                    store.create_dir(folder, recursive=True)
                    hidden = f"{folder}/_{uuid.uuid4().hex}"
                    out = store.open_output_stream(hidden, compression=None)
                    files += 1
                out.write("".join([f"{t}\n" for t in texts[first:at]]).encode())
                first = at
        if out is not None:
            out.close()
            store.move(hidden, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    # an empty name and none are one folder, so they are one key
    named = rows.withColumns({k: F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys})
    dealt = named.repartition(tasks(spark), *keys, *spread).sortWithinPartitions(*keys, *order)
    lines = dealt.select(*keys, F.col(line).alias("_line"))
    lines.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()
    store.open_output_stream(f"{base}/_SUCCESS", compression=None).close()


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rows(found: list[pafs.FileInfo], prefix: str) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(found), 10_000):
        some = [x for x in found[a : a + 10_000] if not _hidden(x.base_name)]
        folder = [x.type == pafs.FileType.Directory for x in some]
        columns = [
            pa.array([prefix + x.path for x in some], pa.string()),
            pa.array(folder, pa.bool_()),
            pa.array([0 if d else x.size for x, d in zip(some, folder, strict=True)], pa.int64()),
            pa.array([None if x.mtime_ns is None else x.mtime_ns // 1000 for x in some], pa.timestamp("us", "UTC")),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "is_folder", "length", "modificationTime"])


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime) of every file below a folder; one job per level while the plan is built."""
    store, base, prefix = located(root)
    top = store.get_file_info(base)
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, prefix = located(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from _rows(store.get_file_info(pafs.FileSelector(name.removeprefix(prefix))), prefix)

    start = [(prefix + base, top.type == pafs.FileType.Directory, top.size or 0, top.mtime)]
    levels = [spark.createDataFrame(start, _FOUND)]
    while levels[-1].where("is_folder").limit(1).count():
        folders = levels[-1].where("is_folder").select("path").repartition(tasks(spark))
        levels.append(_written(folders.mapInArrow(look, _FOUND), "listed"))
    return functools.reduce(DataFrame.unionByName, levels).where("not is_folder").drop("is_folder")


def _opened(files: DataFrame, root: str, read, schema: str) -> DataFrame:
    """``read(stream, path)`` over the files named in column ``path``; it yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, prefix = located(root)
        for batch in batches:
            yield from read((store, name, name.removeprefix(prefix)) for name in batch.column(0).to_pylist())

    return files.select("path").repartition(tasks(files.sparkSession)).mapInArrow(run, schema)


def digests(files: DataFrame, root: str) -> DataFrame:
    """(path, length, sha1) of the bytes of files below ``root``, of any size."""

    def read(named) -> Iterator[pa.RecordBatch]:
        out = []
        for store, name, inner in named:
            total, length = hashlib.sha1(), 0
            with store.open_input_stream(inner, compression=None, buffer_size=0) as stream:
                while part := stream.read(CHUNK):
                    total.update(part)
                    length += len(part)
            out.append((name, length, total.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["path", "length", "sha1"])

    return _opened(files, root, read, "path string, length bigint, sha1 string")


def lines_of(files: DataFrame, root: str) -> DataFrame:
    """(path, pos, line) of text files below ``root``; a line ends with a line feed."""

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "pos", "line"])

    def read(named) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for store, name, inner in named:
            with store.open_input_stream(inner, compression=None) as stream:
                rest, pos = [], 0
                while True:
                    part = stream.read(CHUNK)
                    *whole, tail = part.split(b"\n")
                    for text in whole:
                        out.append((name, pos, b"".join([*rest, text]).decode("utf-8", "replace")))
                        rest, pos = [], pos + 1
                    held += len(part) + 200
                    if tail:
                        rest.append(tail)
                    if held > 8 * CHUNK and out:
                        yield rows(out)
                        out, held = [], 0
                    if not part:
                        break
                if rest:
                    out.append((name, pos, b"".join(rest).decode("utf-8", "replace")))
        if out:
            yield rows(out)

    return _opened(files, root, read, "path string, pos bigint, line string")
