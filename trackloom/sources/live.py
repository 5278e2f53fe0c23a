"""Live messages as a stream: a log of numbered segments, declarations and frames.

A transport (not built here) appends segments to a folder that all machines share; a segment is a
folder of text files, one message a line, complete as soon as its ``_SUCCESS`` file is there
(:func:`append_segment` writes one with Spark). ``MessageLog`` is a Python data source whose offset
is the number of segments read, so a stream that is restarted from its checkpoint gives each message
once, and every file of a segment is a task of its own.

A line holds ``connection`` and ``message``, the text that came over it. The first message of a
connection must declare its session, all others must be frames; :func:`messages` reads both with
Spark's JSON functions and names what is wrong with each one alone. :func:`accepted` keeps the
declaration of each connection in state and gives the frames of connections that are open;
:func:`accepted_batch` gives the same for a whole table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackloom.operators.validation import frame_error, start_error

LINES = "segment bigint, file string, line bigint, connection string, message string"
#: A value of another kind than its field is read as null.
MESSAGE = (
    "type string, session_id string, source_width bigint, source_height bigint, source_fps double, sequence_id bigint, "
    "captured_at_ms double, byte_count bigint, width bigint, height bigint, payload string"
)
_BATCH = 4096


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _segment(number: int) -> str:
    return f"segment-{number:012d}"


class FilePart(InputPartition):
    """One file of a segment."""

    def __init__(self, segment: int, file: str):
        super().__init__((segment, file))
        self.segment, self.file = segment, file


def _complete_segments(folder: str) -> int:
    """How many segments, counted from the first, are complete; looked for by halving steps, not listed."""
    store, base = store_of(folder)

    def there(number: int) -> bool:
        return store.get_file_info(f"{base}/{_segment(number)}/_SUCCESS").type == pafs.FileType.File

    step = 1
    while there(step - 1):
        step *= 2
    low, high = step // 2, step - 1  # segment low - 1 is complete, segment high is not
    while low < high:
        middle = (low + high) // 2
        if there(middle):
            low = middle + 1
        else:
            high = middle
    return low


def _parts(folder: str, start: int, end: int) -> list[FilePart]:
    store, base = store_of(folder)
    parts = []
    for number in range(start, end):
        files = store.get_file_info(pafs.FileSelector(f"{base}/{_segment(number)}"))
        names = sorted(f.base_name for f in files if f.type == pafs.FileType.File and f.base_name[0] not in "._" and f.size)
        parts += [FilePart(number, name) for name in names]
    return parts


def _lines(folder: str, part: FilePart) -> Iterator[pa.RecordBatch]:
    """Lines of one file in small batches."""
    store, base = store_of(folder)
    names = ["segment", "file", "line", "connection", "message"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    rows: list[tuple] = []
    with store.open_input_stream(f"{base}/{_segment(part.segment)}/{part.file}") as raw, pa.PythonFile(raw, "r") as file:
        held, number = b"", 0
        while True:
            piece = file.read(1 << 20)
            lines = (held + piece).split(b"\n")
            held = lines.pop() if piece else b""
            for line in lines:
                if line.strip():
                    try:
                        body = json.loads(line)
                        rows.append((part.segment, part.file, number, body.get("connection"), body.get("message")))
                    except (ValueError, AttributeError):
                        rows.append((part.segment, part.file, number, None, line.decode("utf-8", "replace")))
                number += 1
                if len(rows) >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if not piece:
                break
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class _LogReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return _parts(self.folder, 0, _complete_segments(self.folder))

    def read(self, partition):
        return _lines(self.folder, partition)


class _LogStream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self):
        return {"segments": 0}

    def latestOffset(self):
        return {"segments": _complete_segments(self.folder)}

    def partitions(self, start, end):
        return _parts(self.folder, start["segments"], end["segments"])

    def read(self, partition):
        return _lines(self.folder, partition)


class MessageLog(DataSource):
    """``format("message_log")`` with option ``path``: the lines of a log, as a table or as a stream."""

    @classmethod
    def name(cls):
        return "message_log"

    def schema(self):
        return LINES

    def reader(self, schema):
        return _LogReader(self.options["path"])

    def streamReader(self, schema):
        return _LogStream(self.options["path"])


def append_segment(lines: DataFrame, folder: str, number: int) -> None:
    """Write (connection, message) rows, in the order of their partitions, as segment ``number``."""
    lines.select(F.to_json(F.struct("connection", "message"))).write.text(f"{folder}/{_segment(number)}")


def _kind(field: str) -> Column:
    """JSON kind of a message's field: STRING, BIGINT, VOID for null, ..; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json("message"), f"$.{field}", "variant"))


def messages(lines: DataFrame) -> DataFrame:
    """Lines with the fields of their message, ``start_fault`` and ``frame_fault``.

    The faults say why the message cannot declare a session, and why it is no frame; null where it can.
    """
    fields = lines.select("*", F.from_json("message", MESSAGE).alias("_m"), _kind("captured_at_ms").alias("_captured"), _kind("session_id").alias("_id"))
    fields = fields.select(*lines.columns, "_m.*", "_captured", "_id")
    named = F.coalesce(F.col("_id") == "STRING", F.lit(False))
    # the time of capture must be there, as a number or as null
    timed = F.coalesce(F.col("_captured").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|VOID)"), F.lit(False))
    start = F.when(F.col("type") == "start", F.when(~named, "MISSING_SESSION_ID").otherwise(start_error())).otherwise("NOT_A_START_MESSAGE")
    frame = (
        F.when(F.coalesce(F.col("type") != "frame", F.lit(True)), "NOT_A_FRAME")
        .when(F.coalesce(F.col("sequence_id") < 0, F.lit(True)), "INVALID_SEQUENCE_ID")
        .when(~timed, "INVALID_CAPTURE_TIME")
        .otherwise(frame_error())
    )
    return fields.select("*", start.alias("start_fault"), frame.alias("frame_fault")).drop("_captured", "_id")


DECLARED = ("session_id", "source_width", "source_height", "source_fps")
FRAME = ("sequence_id", "captured_at_ms", "payload")
ACCEPTED = (
    "connection string, segment bigint, file string, line bigint, session_id string, source_width bigint, source_height bigint, "
    "source_fps double, sequence_id bigint, captured_at_ms double, payload string, fault string"
)


class _Declarations(StatefulProcessor):
    """Keeps what each connection declared; a connection whose first message is no start is closed."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a connection that sends nothing for so long is forgotten
        self.declared = handle.getValueState(
            "declared", "open boolean, session_id string, source_width bigint, source_height bigint, source_fps double", self.idle_ms
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.declared.get()
        # the rows of one connection in one batch are in memory; a batch holds what came since the last one
        for row in sorted(rows, key=lambda r: (r["segment"], r["file"], r["line"])):
            if known is None:
                fault = row["start_fault"]
                known = (True, *(row[n] for n in DECLARED)) if fault is None else (False, None, None, None, None)
                if fault is not None:
                    yield self._out(key, row, (None,) * 4, fault)
            else:
                fault = row["frame_fault"] if known[0] else "CONNECTION_CLOSED"
                yield self._out(key, row, tuple(known[1:]), fault)
        self.declared.update(tuple(known))

    def _out(self, key, row, own: tuple, fault: str | None) -> Row:
        place = {n: row[n] for n in ("segment", "file", "line")}
        frame = {n: None if fault else row[n] for n in FRAME}
        return Row(connection=key[0], **place, **dict(zip(DECLARED, own)), **frame, fault=fault)

    def close(self) -> None:
        pass


def accepted(read: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """Frames of a stream of :func:`messages` with their session's declaration, rejected messages with a fault.

    Start such a stream within :func:`trackloom.streaming.late.stream_settings`.
    """
    wanted = ["connection", "segment", "file", "line", *DECLARED, *FRAME, "start_fault", "frame_fault"]
    return read.select(*wanted).groupBy("connection").transformWithState(_Declarations(idle_ms), ACCEPTED, "append", "ProcessingTime")


def accepted_batch(read: DataFrame) -> DataFrame:
    """:func:`accepted` over a whole table of :func:`messages`: the first message of a connection declares it."""
    place = F.struct("segment", "file", "line")
    first = read.groupBy(F.col("connection").alias("_of")).agg(
        F.min(place).alias("_at"), F.min_by(F.struct(*DECLARED, "start_fault"), place).alias("_own")
    )
    rows = read.join(first, F.col("connection").eqNullSafe(F.col("_of")))
    is_first, closed = place == F.col("_at"), F.col("_own.start_fault").isNotNull()
    fault = F.when(is_first, F.col("start_fault")).when(closed, "CONNECTION_CLOSED").otherwise(F.col("frame_fault"))
    out = rows.filter(~is_first | F.col("start_fault").isNotNull()).select("*", fault.alias("fault"))
    own = [F.when(~closed, F.col(f"_own.{c}")).alias(c) for c in DECLARED]
    frame = [F.when(F.col("fault").isNull(), F.col(c)).alias(c) for c in FRAME]
    return out.select("connection", "segment", "file", "line", *own, *frame, "fault")


def stream_frames(spark: SparkSession, folder: str, idle_ms: int = 3_600_000) -> DataFrame:
    """The log of ``folder`` as a stream of accepted frames and faults."""
    spark.dataSource.register(MessageLog)
    return accepted(messages(spark.readStream.format("message_log").option("path", folder).load()), idle_ms)


def read_frames_of_log(spark: SparkSession, folder: str) -> DataFrame:
    """What :func:`stream_frames` gives, of all that is there."""
    spark.dataSource.register(MessageLog)
    return accepted_batch(messages(spark.read.format("message_log").option("path", folder).load()))
