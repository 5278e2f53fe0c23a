"""Helpers shared by the corpus operators."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_column: str, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    as_text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(as_text), F.lit(modulus))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def sliced(batches: Iterator[pa.RecordBatch], size: int = 512, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, of at most about ``most`` bytes, for results much larger than their inputs."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rows = min(size, batch.num_rows - at)
            while rows > 1 and batch.slice(at, rows).nbytes > most:
                rows = -(-rows // 2)
            yield batch.slice(at, rows)
            at += rows


def squeeze(value: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(value)


def expand(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value)


def pack(items: list[tuple[str, bytes]]) -> bytes:
    """(id as text, bytes) pairs as one compressed value."""
    parts = []
    for key, value in items:
        raw = key.encode()
        parts += [struct.pack("<II", len(raw), len(value)), raw, value]
    return squeeze(b"".join(parts))


def unpack(payload: bytes) -> list[tuple[str, bytes]]:
    data, at, out = expand(payload), 0, []
    while at < len(data):
        n_key, n_value = struct.unpack_from("<II", data, at)
        at += 8
        key = data[at : at + n_key].decode()
        out.append((key, data[at + n_key : at + n_key + n_value]))
        at += n_key + n_value
    return out


def pieces(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], size: int) -> Iterator[list[tuple]]:
    """Cut a task's rows into runs of about ``size`` characters of the last column; a row is never cut."""
    rows, total = [], 0
    for batch in sliced(batches):
        for row in rows_of(batch, *names):
            rows.append(row)
            total += len(row[-1] or "")
            if total >= size:
                yield rows
                rows, total = [], 0
    if rows:
        yield rows


def in_blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], size: int) -> Iterator[tuple[int, list[tuple]]]:
    """``pieces`` with numbers that no other task gives."""
    first = TaskContext.get().partitionId() << 24
    for i, rows in enumerate(pieces(batches, names, size)):
        yield first + i, rows
