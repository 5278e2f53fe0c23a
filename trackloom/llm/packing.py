"""Packing of token pieces into sequences of a fixed size by minimum bin slack.

A bin is opened with the longest piece left; a subset-sum dynamic programme over the lengths that
remain, with bits of one integer as reachable sums, finds the fullest combination that fits beside
it, and that combination is removed. Which combination is found depends on the lengths only, and
removing pieces makes no fuller one possible, so a combination is taken as often as its lengths
last. The plan is therefore made from the number of pieces of each length, ``size`` numbers whatever
the input holds, and has some thousand patterns at most.

Pieces are numbered within their length in parallel: rows are dealt into buckets of about
``BUCKET_ROWS`` rows, numbered inside them, and lifted by the rows of earlier buckets, so one
length may hold all rows. A number tells pattern, copy and place by a search in the plan.

Texts are encoded by parts: the vocabulary drops white space and keeps letters, single digits and other
signs apart, so the ids of a text are those of its parts in order. Texts with characters beyond
Latin letters are encoded by the words between white space, to which the same applies. A worker
remembers up to twice ``CACHE_WORDS`` parts.

Edge cases: null and empty texts are the end id alone; a text of any length is encoded whole and cut
after ``size`` ids; repeated rows and ids are packed each on its own; a null length or one outside
1..``size`` is an error of the caller and raises; an empty table gives no rows; columns of ``pack``'s
input are kept, but ``sequence_id`` and ``offset`` are replaced.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import rows_of, sliced, written

SIZE = 2048
BUCKET_ROWS = 20_000
#: A worker remembers one to two such counts of parts, none longer than LONGEST: about 100 MB.
CACHE_WORDS = 300_000
LONGEST = 64
END = 0
#: Texts of printable ASCII and the accented letters of Latin-1, which their normal form leaves as they are,
#: fall into the parts below before the vocabulary is asked; its own rule for parts says the same of them.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^ \t-\ra-zà-öø-ÿß0-9]+")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The fullest combination of lengths, each used at most as often as counted, with a sum of at most ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        before, left, part = reach, min(counts[length], room // length), 1
        steps.append((length, before))
        while left:  # 1, 2, 4, .. and a rest: every number of copies is a sum of some of them
            part = min(part, left)
            reach |= reach << (part * length)
            left -= part
            part *= 2
        reach &= mask
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        copies = 0
        while not before >> total & 1:
            total -= length
            copies += 1
        if copies:
            out[length] = copies
    return out


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) of all patterns, in the order in which bins are filled."""
    left = {length: n for length, n in counts.items() if n}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fullest(left, size - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[length] // copies for length, copies in pattern.items())
        for length, copies in pattern.items():
            left[length] -= times * copies
            if not left[length]:
                del left[length]
        out.append((times, pattern))
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first number, first sequence, copies, offset), by length and first number."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in patterns:
        at = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            rows.append((length, used.get(length, 0), sequence, copies, at))
            used[length] = used.get(length, 0) + times * copies
            at += copies * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, length: str = "length", size: int = SIZE) -> DataFrame:
    """``pieces`` with the sequence each one is put into and its offset there, without gaps from 0."""
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    wrong = F.col(length).isNull() | ~F.col(length).between(1, size)
    checked = F.when(wrong, F.raise_error(F.lit(f"a length is not in 1..{size}")).cast("long")).otherwise(F.col(length).cast("long"))
    rows = pieces.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), checked.alias("n"), F.monotonically_increasing_id().alias("id"))
    rows = written(rows, "pieces-to-pack")
    total = rows.count()
    counts = {r["n"]: r["times"] for r in rows.groupBy("n").agg(F.count("*").alias("times")).collect()}
    table = places(plan(counts, size))
    buckets = 1 + total // BUCKET_ROWS
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    numbered = rows.withColumn("number", F.row_number().over(Window.partitionBy("n", "bucket").orderBy("id")).cast("long") - 1)
    sizes = rows.groupBy("n", "bucket").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lifts = sizes.select("n", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("lift"))
    ready = numbered.join(lifts, ["n", "bucket"]).select("row", "n", (F.col("number") + F.col("lift")).alias("number"))

    # Numbers of one length are consecutive, so (length, number) is found in one sorted array.
    keys = table[:, 0] << 48 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, number = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            found = table[np.searchsorted(keys, n << 48 | number, side="right") - 1]
            nth = number - found[:, 1]
            sequence = found[:, 2] + nth // found[:, 3]
            offset = found[:, 4] + nth % found[:, 3] * n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(offset)], names=["row", "sequence_id", "offset"])

    kind = dict(ready.dtypes)["row"]
    return ready.mapInArrow(place, f"row {kind}, sequence_id bigint, offset bigint").select("row.*", "sequence_id", "offset")


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> tuple:
    """Tokenizer and the words it was asked for, kept by the worker from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary), {}, {}


def encode(texts: list[str | None], vocabulary: str) -> list[bytes]:
    """Ids of each whole text as little-endian 32-bit numbers, without special tokens."""
    tokenizer, known, earlier = encoder(vocabulary)
    split = []
    for text in texts:
        text = text or ""
        plain = PLAIN.fullmatch(text) and "<|" not in text
        split.append(PART.findall(text.lower()) if plain else text.encode().split())
    if len(known) > CACHE_WORDS:  # parts not met since the last time are forgotten
        earlier.clear()
        earlier.update(known)
        known.clear()
    asked = set().union(*split).difference(known)
    known.update((x, earlier[x]) for x in asked.intersection(earlier))
    asked.difference_update(known)
    rare, others = {}, []
    tokenize = tokenizer.model.tokenize
    for part in asked:
        if isinstance(part, str) and part.isascii():
            keep(part, [token.id for token in tokenize(part)], known, rare)
        else:
            others.append(part)
    for at in range(0, len(others), 4096):
        some = others[at : at + 4096]
        bodies = [x if isinstance(x, str) else x.decode() for x in some]
        for part, found in zip(some, tokenizer.encode_batch_fast(bodies, add_special_tokens=False), strict=True):
            keep(part, found.ids, known, rare)
    if rare:
        return [b"".join([rare[x] if len(x) > LONGEST else known[x] for x in parts]) for parts in split]
    return [b"".join(map(known.__getitem__, parts)) for parts in split]


def keep(part: str | bytes, ids: list[int], known: dict, rare: dict) -> None:
    (known if len(part) <= LONGEST else rare)[part] = struct.pack(f"<{len(ids)}I", *ids)


def vocabulary_of(path: str | None = None) -> str:
    """Content of a tokenizer file, read by the driver and sent with the job; the word vocabulary by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def tokenised(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece, with its ids where ``ids`` asks for them.

    A document is the ids of its text and then the end id; one of more than ``size`` ids is cut.
    """
    kind = dict(documents.dtypes)[doc_id]
    shared = spark.sparkContext.broadcast(vocabulary_of(path))  # one vocabulary, a few MB

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        for batch in sliced(batches):
            owner, rows, parts = [], [], []
            for at, data in enumerate(encode([body for (body,) in rows_of(batch, "body")], shared.value)):
                data += end
                for piece, first in enumerate(range(0, len(data), 4 * size)):
                    part = data[first : first + 4 * size]
                    owner.append(at)
                    rows.append((piece, first // 4, len(part) // 4, zlib.crc32(part)))
                    if ids:
                        parts.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(owner, pa.int32()))]
            columns += [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns, names = [*columns, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body")).mapInArrow(cut, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids themselves; a sequence has at most ``size`` of them."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))


def report(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(tokenised(spark, documents, doc_id, text)).withColumnRenamed("doc_id", doc_id)
