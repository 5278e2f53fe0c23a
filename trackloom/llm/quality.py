"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL-proximal updates.

Features are single tokens and pairs of neighbours, hashed into ``2 ** BITS`` slots; a token is a
word or a run of other visible characters, and a word in capitals is told from the same in small
letters. With N features a slot that occurs c times has the value c / sqrt(N), so a score is one
sparse dot product that needs no sorting.

The fit reads at most ``SAMPLE_ROWS`` labelled documents, the first by hash of their id, in that
order, ``EPOCHS`` times; scores cover every whole text.

Edge cases: null and empty texts have the bias feature only; a document labelled more than once has
its lowest label; without labels every score is 0.5; repeated rows give repeated results; only the
named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import remainder, rows_of

BITS = 18
SAMPLE_ROWS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
ACCEPT = 0.7
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE_LIMIT = 300_000


class TokenHashes(dict):
    """Hash of a token, remembered; the memory is emptied when it is full."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        shape = f"^{token.lower()}" if len(token) > 1 and token.isupper() else token.lower()
        value = self[token] = int.from_bytes(blake2b(shape.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return value


def slots(text: str, known: TokenHashes) -> np.ndarray:
    """Slot of every feature of a text; slot 0 is the bias."""
    h = np.array([known[t] for t in TOKEN.findall(text)], np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([np.zeros(1, np.int64), (np.concatenate([h, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)])


def train(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal passes over (slots, label)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(own: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[own]) * np.maximum(np.abs(z[own]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[own])) / ALPHA + L2)

    for _ in range(epochs):
        for features, label in examples:
            own, count = np.unique(features, return_counts=True)
            x = count / np.sqrt(len(features))
            w = weights(own)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            sigma = (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / ALPHA
            z[own] += g - sigma * w
            n[own] += g * g
    return weights(np.arange(1 << BITS)).astype(np.float32)


def fit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> np.ndarray:
    """Weights from at most ``sample_rows`` labelled documents outside the held-out fold."""
    told = labels.where((remainder(doc_id, 4) != 2) & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    told = told.groupBy(F.col(doc_id).alias("__id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    chosen = told.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    # At most sample_rows narrow rows, so the documents stay where they are.
    rows = documents.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("body"))
    rows = rows.join(F.broadcast(chosen), "__id").dropDuplicates(["__id"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenHashes()
        for batch in batches:
            ids, ys, found = [], [], []
            for key, y, body in rows_of(batch, "h", "y", "body"):
                ids.append(key)
                ys.append(y)
                found.append(slots(body or "", known).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_pydict({"h": pa.array(ids, pa.int64()), "y": pa.array(ys, pa.int32()), "slots": pa.array(found, pa.binary())})

    sampled = rows.select(F.xxhash64("__id").alias("h"), "y", "body").mapInArrow(features, "h bigint, y int, slots binary")
    got = sorted((r["h"], r["y"], bytes(r["slots"])) for r in sampled.collect())
    return train([(np.frombuffer(s, np.int32).astype(np.int64), y) for _, y, s in got])


def score(documents: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and the probability of label 1 for its whole text."""
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenHashes()
        for batch in batches:
            out = []
            for (body,) in rows_of(batch, "body"):
                own = slots(body or "", known)
                dot = float(weights[own].sum(dtype=np.float64)) / np.sqrt(len(own))
                out.append(1 / (1 + np.exp(-np.clip(dot, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def report(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    scored = score(documents, fit(documents, labels, doc_id, text, label), doc_id, text)
    return scored.select(
        F.col("doc_id").alias(doc_id),
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )
