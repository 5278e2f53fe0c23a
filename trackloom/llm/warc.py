"""WARC archives: one gzip member per record, written and read back sequentially.

``write_archives`` streams every task's records into one archive file of its own; ``read_archives``
opens archives by path and walks them record by record with bounded memory: members are inflated
in small pieces, the header is read up to its blank line, the block is framed by Content-Length,
and the block is checked against its digest. A record cut off at the end of a file, or one whose
framing or digest is wrong, is returned with ``valid`` false and a reason, and reading goes on with
the next member; after broken compressed data, with the next gzip header that opens a record.

Edge cases: null html is an empty payload; a payload of any length is one record; rows that repeat the
id of a response are responses too; an empty table gives no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import written
from trackloom.session import cut, scratch_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PIECE = 1 << 16
MAGIC, OPENING = b"\x1f\x8b\x08", b"WARC/"
RECORD = (
    "archive string, position bigint, record_type string, page_id string, refers_to string, url string, "
    "payload_digest string, payload_bytes bigint, payload binary, valid boolean, fault string"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, from the hex digest: 5 hex digits are 4 base32 digits."""
    digest = F.sha1(payload)
    out = []
    for i in range(8):
        word = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        out += [F.lit(ALPHABET).substr(F.shiftright(word, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_roles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Payload, digest and role of every row.

    Among rows with equal payloads of at least ``least`` bytes the one with the largest id is the
    response and the others revisit it; rows that repeat that id are responses too. Null html is
    an empty payload; a null id never becomes the response of rows that have ids.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("payload_digest", base32_sha1(F.col("payload")))
    # One row per repeated payload; it is cut so that the join below has plain exchanges on both
    # sides, which adaptive execution can split when a third of all pages is one payload.
    repeated = cut(
        rows.where(F.length("payload") >= least)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = rows.join(repeated, "payload_digest", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def record_bytes(kind: str, page: str | None, refers_to: str | None, url: str | None, digest: str, payload: bytes) -> bytes:
    """One record as a gzip member. A revisit has no block; its digest and length are the response's."""
    block = b"" if kind == "revisit" else payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", " ".join(url.split())))
    if kind == "revisit":
        fields.insert(2, ("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        fields.insert(3, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``with_roles`` rows below ``folder``; returns (archive, n_records), one row per file.

    Each attempt of a task writes a file of its own, and only the files of attempts that ended
    well are listed, so a lost executor leaves stray files but no record twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        n, out = 0, None
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                page, url, payload, digest, kind, refers = (x.as_py() for x in row)
                out.write(record_bytes(kind, page, refers, url, digest, payload))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

    rows = records.select(
        F.col("page_id").cast("string"), "url", "payload", "payload_digest", "record_type", F.col("refers_to").cast("string")
    )
    return written(rows.mapInArrow(write, "archive string, n_records bigint"), "archives")


def next_record(data: bytes, stream) -> bytes:
    """Raw bytes from the next gzip header on that opens a WARC record; empty where there is none."""
    while True:
        at = data.find(MAGIC)
        if at < 0:
            more = stream.read(PIECE)
            if not more:
                return b""
            data = data[-2:] + more
            continue
        data = data[at:]
        try:
            head = zlib.decompressobj(31).decompress(data, len(OPENING))
        except zlib.error:
            head = None
        if head is not None and len(head) < len(OPENING) and OPENING.startswith(head):
            more = stream.read(PIECE)
            if more:
                data += more
                continue
            if head:
                return data  # a record that is cut off
        if head == OPENING:
            return data
        data = data[1:]


def members(stream) -> Iterator[tuple[bytes, str | None]]:
    """Inflated content of each gzip member, piece by piece read, one record held at a time.

    After a damaged member, also one whose damage shows only later or at the end of the file, reading
    goes on with the next header behind its own that opens a record.
    """
    data = b""
    while True:
        if not data:
            data = stream.read(PIECE)
            if not data:
                return
        unzip, parts, raw, fault = zlib.decompressobj(31), [], [data], None
        while not unzip.eof:
            if not data:
                data = stream.read(PIECE)
                raw.append(data)
                if not data:
                    fault = "cut off"
                    break
            try:
                parts.append(unzip.decompress(data, PIECE))
            except zlib.error as error:
                fault = f"not gzip: {error}"
                break
            data = unzip.unconsumed_tail
        yield b"".join(parts), fault
        data = unzip.unused_data if not fault else next_record(b"".join(raw)[1:], stream)
        if fault and not data:
            return


def parse_record(content: bytes, fault: str | None) -> dict:
    """Header fields, framed block and what is wrong with the record, if anything."""
    head, blank, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = fields.get("content-length", "")
    if not fault and not (lines[0].startswith("WARC/") and blank and size.isdigit()):
        fault = "no record header"
    block = rest[: int(size)] if size.isdigit() else b""
    if not fault and (len(block) < int(size) or rest[int(size) :] != b"\r\n\r\n"):
        fault = "content length does not frame the block"
    told = fields.get("warc-block-digest", "")
    if not fault and told and told != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        fault = "digest differs"
    return {"fields": fields, "block": block, "fault": fault}


def _page(value: str | None) -> str | None:
    inner = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return inner or None


def read_archives(archives: DataFrame, path: str = "archive", payloads: bool = True) -> DataFrame:
    """All records of the archives named in column ``path``; without ``payloads`` blocks stay null."""
    schema = pa.schema(
        [
            ("archive", pa.string()),
            ("position", pa.int64()),
            *((n, pa.string()) for n in ("record_type", "page_id", "refers_to", "url", "payload_digest")),
            ("payload_bytes", pa.int64()),
            ("payload", pa.binary()),
            ("valid", pa.bool_()),
            ("fault", pa.string()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, inner = pafs.FileSystem.from_uri(name)
                rows, held = [], 0
                with store.open_input_stream(inner, compression=None) as stream:
                    for position, (content, fault) in enumerate(members(stream)):
                        record = parse_record(content, fault)
                        fields, block, fault = record["fields"], record["block"], record["fault"]
                        kind = fields.get("warc-type")
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        length = fields.get("x-payload-length", "")
                        if kind != "revisit" and not fault:
                            length = str(len(block))
                            if digest and digest != base64.b32encode(hashlib.sha1(block).digest()).decode():
                                fault = "payload digest differs"
                        rows.append(
                            (name, position, kind, _page(fields.get("warc-record-id")), _page(fields.get("warc-refers-to")),
                             fields.get("warc-target-uri"), digest, int(length) if length.isdigit() else None,
                             block if payloads and kind != "revisit" else None, not fault, fault)
                        )
                        held += len(block) if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    names = archives.select(F.col(path).cast("string").alias("archive")).where(F.col("archive").isNotNull())
    # An archive is the unit of work; a stated number of partitions is not merged by adaptive execution.
    return names.repartition(max(1, names.count())).mapInArrow(read, RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages as archives into the shared folder and read them back; payloads are left out."""
    kind = dict(pages.dtypes)["page_id"]
    folder = scratch_path(spark, "warc")
    records = read_archives(write_archives(with_roles(pages), folder if ":/" in folder else f"file://{folder}"), payloads=False)
    return records.select(
        F.col("page_id").cast(kind),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind),
        "valid",
    )
