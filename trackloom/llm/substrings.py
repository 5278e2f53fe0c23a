"""Repeated passages by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text, over its last ``REACH`` bytes; a chunk ends where
the hash is below a threshold, one position in ``EVERY``, but not before ``SHORTEST`` bytes and at
``LONGEST`` at the latest. Boundaries depend on the bytes around them only, so an insertion moves
the chunks next to it and no others. Chunks are deduplicated by a 64-bit digest; a run of adjacent
chunks, each of which another document has too, is a repeated passage if it has ``LEAST_WORDS``
words, where two characters of a script without spaces stand for a word. One wrong digest match can
therefore not make a passage.

A passage loses the bytes before its first and behind its last chunk boundary, about 60 bytes; the
least number of words is that much below the 50 words for which it is meant.

How it runs: texts are packed into blocks with the distinct digests of each; digests are dealt out
once, with one row per block that has them, so a chunk in a third of all documents is spread over as
many rows as there are blocks and no more. Blocks get their own repeated digests back.

Edge cases: a document is an id with a text, so rows that repeat both count once, and texts under one
id or under none are documents of their own; the one that keeps a passage has the least id (null
ids come last), then the least hash of its text. Results do not depend on how rows lie in blocks. Null
and empty texts have no chunk; a text of any length is in one block as a whole; a passage that repeats
within one document only is left alone; an empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import in_blocks, pack, unpack, written

REACH = 16
EVERY = 20
SHORTEST = 12
LONGEST = 256
LEAST_WORDS = 30
BLOCK_BYTES = 12 << 20
PART_BYTES = 1 << 21
#: Thai to Lao, Burmese, Khmer, kana and Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def gear_table() -> np.ndarray:
    """256 numbers from SplitMix64, started at 1."""
    x = np.uint64(1) + np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """hash[i] = sum of GEAR[data[i - k]] << k over the last REACH bytes, by doubling."""
    h = GEAR[data]
    k = 1
    while k < REACH:
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h, k = longer, 2 * k
    return h


def chunk_ends(texts: list[bytes]) -> Iterator[list[int]]:
    """End offsets of the chunks of each text."""
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (total < PART_BYTES or last == first):
            total += len(texts[last]) + REACH
            last += 1
        pad = bytes(REACH)
        data = np.frombuffer(b"".join([pad + t for t in texts[first:last]]), np.uint8)
        # The top 16 bits depend on all bytes in reach.
        cuts = np.flatnonzero((gear_hash(data) >> np.uint32(16)) < np.uint32(65536 // EVERY)) + 1
        start = REACH
        bounds = np.searchsorted(cuts, np.cumsum([0] + [len(t) + REACH for t in texts[first:last]]))
        for i, text in enumerate(texts[first:last]):
            own = (cuts[bounds[i] : bounds[i + 1]] - start).tolist()
            ends, at, n = [], 0, len(text)
            for c in own:
                while c - at > LONGEST:
                    at += LONGEST
                    ends.append(at)
                if c - at >= SHORTEST and c < n:
                    ends.append(c)
                    at = c
            while n - at > LONGEST:
                at += LONGEST
                ends.append(at)
            if n > at:
                ends.append(n)
            yield ends
            start += n + REACH
        first = last


def digests(text: bytes, ends: list[int]) -> list[bytes]:
    out, at = [], 0
    for e in ends:
        out.append(blake2b(text[at:e], digest_size=8).digest())
        at = e
    return out


def distinct_rows(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, mark, body): each id with each of its texts once; ``mark`` is the hash of the text.

    Texts are shuffled only where rows repeat; those are found by their ids and hashes. Runs a job.
    """
    body = F.col(text).cast("string")
    rows = documents.select(F.col(doc_id).alias("doc"), F.xxhash64(body).alias("mark"), body.alias("body"))
    again = rows.groupBy("doc", "mark").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("a_doc"), F.col("mark").alias("a_mark"))
    again = written(again, "repeated-rows")
    if again.isEmpty():
        return rows
    same = F.col("doc").eqNullSafe(F.col("a_doc")) & (F.col("mark") == F.col("a_mark"))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc", "mark"]))


def packed_blocks(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(block, payload, ids, marks, digests, documents, firsts): texts with their distinct digests.

    Of each digest: in how many documents of the block it occurs, and which of them is the first. Ids are
    written as texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in in_blocks(batches, ("doc", "mark", "body"), BLOCK_BYTES):
            # Least id first, so the first document seen with a digest is its keeper here; null ids come last.
            rows.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
            texts = [(r[2] or "").encode("utf-8", "replace") for r in rows]
            seen: dict[bytes, list[int]] = {}
            for i, ends in enumerate(chunk_ends(texts)):
                for d in set(digests(texts[i], ends)):
                    at = seen.get(d)
                    if at is None:
                        seen[d] = [i, 1]
                    else:
                        at[1] += 1
            table = np.array(list(seen.values()), np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([pack([(str(i), t) for i, t in enumerate(texts)])], pa.binary()),
                    pa.array([[None if r[0] is None else str(r[0]) for r in rows]], pa.list_(pa.string())),
                    pa.array([[r[1] for r in rows]], pa.list_(pa.int64())),
                    pa.array([b"".join(seen)], pa.binary()),
                    pa.array([table[:, 1].tobytes()], pa.binary()),
                    pa.array([table[:, 0].tobytes()], pa.binary()),
                ],
                names=["block", "payload", "ids", "marks", "digests", "documents", "firsts"],
            )

    rows = distinct_rows(documents, doc_id, text)
    schema = "block bigint, payload binary, ids array<string>, marks array<bigint>, digests binary, documents binary, firsts binary"
    return written(rows.mapInArrow(run, schema), "blocks")


def repeated_digests(blocks: DataFrame, kind: str) -> DataFrame:
    """(block, digest, n_docs, first, mark): digests of a block that several documents of the table have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, marks, found, counts, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, n, at = np.frombuffer(found, np.int64), np.frombuffer(counts, np.int32), np.frombuffer(firsts, np.int32)
                own, mark = pa.array(ids, pa.string()), pa.array(marks, pa.int64())
                for a in range(0, len(keys), 100_000):
                    part = slice(a, a + 100_000)
                    spots = pa.array(at[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys[part]), block)), pa.array(keys[part]), pa.array(n[part]), own.take(spots), mark.take(spots)],
                        names=["block", "digest", "n", "doc", "mark"],
                    )

    rows = blocks.select("block", "ids", "marks", "digests", "documents", "firsts")
    rows = rows.mapInArrow(run, "block bigint, digest bigint, n int, doc string, mark bigint")
    # Summed before the shuffle, then joined: a chunk that all blocks have is one row per block in a join that can be split.
    first = F.min(F.struct(F.isnull("doc").alias("nameless"), F.col("doc").cast(kind).alias("own"), "mark"))
    shared = rows.groupBy("digest").agg(F.sum("n").alias("n_docs"), first.alias("first")).where("n_docs > 1")
    shared = written(shared.select("digest", "n_docs", F.col("first.own").cast("string").alias("first"), "first.mark"), "shared")
    return rows.select("block", "digest").join(shared, "digest")


def size_in_words(text: str) -> int:
    """Words, or half the characters of scripts without spaces where those are more."""
    return max(len(text.split()), len(UNSPACED.findall(text)) // 2)


def passages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Repeated passages: doc_id, text_hash, start, end (code points), n_words, n_docs, first_doc_id, kept, passage.

    A passage comes in parts: a part is ``kept`` where this is the first document that has its chunks,
    ``first_doc_id`` is the id of that of its first chunk, and ``n_docs`` is how many documents share the
    chunk that most have.
    """
    kind = dict(documents.dtypes)[doc_id]
    if kind not in ("bigint", "int", "smallint", "tinyint", "string"):
        documents, kind = documents.withColumn(doc_id, F.col(doc_id).cast("string")), "string"
    blocks = packed_blocks(documents, doc_id, text)
    repeated = repeated_digests(blocks, kind)
    columns = ["doc", "mark", "start", "end", "n_words", "n_docs", "first", "kept", "passage"]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {k.to_bytes(8, "little", signed=True): row for k, *row in zip(*(right[c].tolist() for c in ("digest", "n_docs", "first", "mark")), strict=True)}
        out = []
        for payload, ids, marks in zip(left["payload"], left["ids"], left["marks"], strict=True) if known else ():
            texts = [t for _, t in unpack(bytes(payload))]
            for name, mark, body, ends in zip(ids, marks, texts, chunk_ends(texts), strict=True):
                at, told = 0, []
                for e, d in zip([*ends, None], [*digests(body, ends), None], strict=True):
                    hit = known.get(d)
                    if hit:
                        told.append((at, e, *hit))
                    elif told:
                        if size_in_words(body[told[0][0] : told[-1][1]].decode("utf-8", "ignore")) >= least_words:
                            for kept, part in groupby(told, key=lambda c: c[3] == name and c[4] == mark):
                                own = list(part)
                                begin, end = own[0][0], own[-1][1]
                                while begin < end and body[begin] & 0xC0 == 0x80:  # a character that began before is left out
                                    begin += 1
                                text_ = body[begin:end].decode("utf-8", "ignore")
                                first = len(body[:begin].decode("utf-8", "ignore"))
                                out.append((name, mark, first, first + len(text_), len(text_.split()), max(c[2] for c in own), own[0][3], kept, text_))
                        told = []
                    at = e
        return pd.DataFrame(out, columns=columns)

    schema = "doc string, mark bigint, start bigint, end bigint, n_words bigint, n_docs bigint, first string, kept boolean, passage string"
    found = blocks.select("block", "payload", "ids", "marks").groupBy("block").cogroup(repeated.groupBy("block")).applyInPandas(run, schema)
    return found.select(
        F.col("doc").cast(kind).alias(doc_id),
        F.col("mark").alias("text_hash"),
        "start",
        "end",
        "n_words",
        "n_docs",
        F.col("first").cast(kind).alias("first_doc_id"),
        "kept",
        "passage",
    )


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text) of every row: each text without the repeated passages that another document keeps."""
    cuts = passages(documents, doc_id, text, least_words).where(~F.col("kept"))
    cuts = cuts.groupBy(F.col(doc_id).alias("__doc"), F.col("text_hash").alias("__mark")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    rows = documents.select(doc_id, F.col(text).cast("string").alias("__text"))
    rows = rows.join(cuts, F.col(doc_id).eqNullSafe(F.col("__doc")) & (F.xxhash64("__text") == F.col("__mark")), "left")
    pieces = F.aggregate(
        "cuts",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("s")),
        lambda a, c: F.struct(c["end"].alias("at"), F.concat(a["s"], F.col("__text").substr((a["at"] + 1).cast("int"), (c["start"] - a["at"]).cast("int"))).alias("s")),
    )
    rows = rows.withColumn("__cut", pieces)
    kept = F.concat("__cut.s", F.expr("substring(__text, CAST(__cut.at + 1 AS INT))"))
    return rows.select(doc_id, F.when(F.col("cuts").isNull(), F.col("__text")).otherwise(kept).alias(text))
