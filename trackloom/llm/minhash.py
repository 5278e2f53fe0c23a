"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Texts are runs of ``SHINGLE`` words with their counts as weights, and two texts are linked when the
probability Jaccard similarity of these is at least ``LEAST``. A class is a connected component of
links.

1. One pass over the texts gives a digest of the words and one hash per band of the signature.
   Texts with equal words are one node from here on.
2. Nodes that share a band hash form a bucket. Buckets of the same members, as most bands of true
   copies give, are verified once.
3. Buckets are cut into blocks of at most ``BLOCK`` members, and every pair of blocks is a tile: the
   unit of work whatever the size of a bucket. Only tile rows are made, never pairs of members; in
   a tile shared shingles are counted by matrix products, and it returns a spanning forest of its
   links. No bucket is capped and no pair of a bucket is left out.
4. Components of the forest edges give the classes.

A pair of exactly the least similarity shares no band with a probability of 5e-5.

Edge cases: null, empty and wordless texts are alone in their class; shorter texts have one shingle
of all their words; equal ids are told apart by their text; an empty table gives an empty result;
only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import rows_of, written
from trackloom.llm.graph import components

WORD = re.compile(r"\w+")
SHINGLE = 5
REGISTERS = 125
BAND_ROWS = 5
BLOCK = 512
LEAST = 0.8
CACHE_LIMIT = 300_000
#: Words of the texts that are described together; a longer text is described alone.
BATCH_WORDS = 1 << 16
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of a word, remembered; the memory is emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles_of(texts: list[list[str]], known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of SHINGLE words of each text (all words where there are fewer), and how often each occurs.

    Returns the distinct hashes of all texts end to end, ascending within a text, their counts and the
    place where each text begins, with one more at the end. All texts are hashed at once.
    """
    sizes = np.array([len(words) for words in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    h = np.fromiter((known[w] for words in texts for w in words), np.uint64, int(starts[-1]))
    n = np.where(sizes > 0, np.maximum(1, sizes - SHINGLE + 1), 0)
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + starts[:-1][owner]
    out = np.zeros(len(owner), np.uint64)
    width = np.minimum(sizes, SHINGLE)[owner]
    for k in range(SHINGLE):
        if len(texts) and (width > k).all():
            out = mix((out + GOLDEN) ^ h[first + k])
        else:
            own = np.flatnonzero(width > k)
            out[own] = mix((out[own] + GOLDEN) ^ h[first[own] + k])
    order = np.argsort(out)
    order = order[np.argsort(owner[order], kind="stable")]
    out, owner = out[order], owner[order]
    edge = np.ones(len(out), bool)
    edge[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    spots = np.flatnonzero(edge)
    counts = np.diff(np.append(spots, len(out))).astype(float)
    return out[spots], counts, np.searchsorted(owner[spots], np.arange(len(texts) + 1))


def shingles(words: list[str], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """``shingles_of`` one text."""
    return shingles_of([words], known)[:2]


def signatures(keys: np.ndarray, weights: np.ndarray, ends: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers of each text: two texts share one with the probability of their weighted similarity.

    Every element is a Poisson process of arrivals with its weight as rate, seeded by the element;
    an arrival falls into a random register, which keeps the element that arrived first. All
    elements of all texts advance by one arrival per round, and one stops as soon as its next arrival
    would come after the first ones of all registers of its text: few need more than one round.
    """
    n = len(ends) - 1
    first = np.full((n, registers), np.inf)
    owner = np.zeros(n * registers, np.uint64)
    base = np.repeat(np.arange(n), np.diff(ends))
    state, at, rate = keys.copy(), np.zeros(len(keys)), weights
    while len(keys):
        state = state + GOLDEN
        draw = mix(state)
        at = at - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        live = at < first.max(1)[base]
        keys, state, rate, at, base = keys[live], state[live], rate[live], at[live], base[live]
        place = (mix(draw[live] ^ GOLDEN) % np.uint64(registers)).astype(np.intp) + base * registers
        np.minimum.at(first.reshape(-1), place, at)
        won = at == first.reshape(-1)[place]
        owner[place[won]] = keys[won]
    return owner.reshape(n, registers)


def signature(keys: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """``signatures`` of one text."""
    return signatures(keys, weights, np.array([0, len(keys)]), registers)[0]


def band_hashes(owner: np.ndarray) -> np.ndarray:
    """One hash per band of each signature."""
    owner = owner.reshape(len(owner), -1, BAND_ROWS)
    h = np.broadcast_to(np.arange(owner.shape[1], dtype=np.uint64), owner.shape[:2])
    for k in range(BAND_ROWS):
        h = mix((h + GOLDEN) ^ owner[:, :, k])
    return h.view(np.int64)


def word_batches(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[str]]]]:
    """Words of a batch's texts, about ``BATCH_WORDS`` at a time, with the row where they begin."""
    at, texts, total = 0, [], 0
    for i, (body,) in enumerate(rows_of(batch, "body")):
        texts.append(words_of(body))
        total += len(texts[-1])
        if total >= BATCH_WORDS:
            yield at, texts
            at, texts, total = i + 1, [], 0
    if texts:
        yield at, texts


def word_digest(words: list[str]) -> bytes:
    return blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()


def similarity(a_keys: np.ndarray, a_weights: np.ndarray, b_keys: np.ndarray, b_weights: np.ndarray) -> float:
    """Probability Jaccard similarity: sum over shared x of 1 / sum over y of max(a_y / a_x, b_y / b_x).

    With the shared elements sorted by a_x / b_x the inner sums are prefix sums.
    """
    shared, i, j = np.intersect1d(a_keys, b_keys, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    # All y sorted by a_y / b_y; for x with ratio t, the maximum is b_y / b_x where a_y / b_y <= t.
    every = np.union1d(a_keys, b_keys)
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, a_keys)] = a_weights
    b[np.searchsorted(every, b_keys)] = b_weights
    with np.errstate(divide="ignore"):
        ratio = np.where(b > 0, a / np.where(b > 0, b, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, a, b = ratio[order], a[order], b[order]
    b_upto = np.concatenate([[0], np.cumsum(b)])
    a_after = a.sum() - np.concatenate([[0], np.cumsum(a)])
    own_a, own_b = a_weights[i], b_weights[j]
    cut = np.searchsorted(ratio, own_a / own_b, side="right")
    return float((1 / (b_upto[cut] / own_b + a_after[cut] / own_a)).sum())


def numbered(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, mark, body): a row is found again by its id and the hash of its text."""
    rows = documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("body"))
    return rows.select("doc", F.xxhash64("body").alias("mark"), "body")


def described(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, mark, digest, bands) per row: hash of the text, digest of the words, null without words, and the band hashes."""
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at, texts in word_batches(batch):
                bands = band_hashes(signatures(*shingles_of(texts, known)))
                own = [i for i, words in enumerate(texts) if words]
                # Texts without words have no bands; the others' lie end to end.
                ends = np.cumsum([0, *(bands.shape[1] if words else 0 for words in texts)])
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32(), mask=np.array([not words for words in texts] + [False])), pa.array(bands[own].reshape(-1))
                )
                digests = pa.array([word_digest(words) if words else None for words in texts], pa.binary())
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), digests, lists], names=["doc", "mark", "digest", "bands"])

    return numbered(documents, doc_id, text).mapInArrow(run, f"doc {kind}, mark bigint, digest binary, bands array<bigint>")


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, n, digest): members of buckets with at least two nodes, each set of members once."""
    members = nodes.select("digest", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("f1"), F.bit_xor(F.xxhash64(F.lit(1), "digest")).alias("f2")
    )
    # Written, so that the join below has plain exchanges, which can be split where a bucket is large.
    once = written(sizes.where("n > 1").groupBy("n", "f1", "f2").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    return members.join(once, "bucket")


def linked(keys: list[np.ndarray], weights: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with at least the least similarity, as (root, member)."""
    n = len(keys)
    sizes = np.array([len(k) for k in keys])
    mass = np.array([w.sum() for w in weights])
    row = np.repeat(np.arange(n), sizes)
    every, column, seen = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    number = np.cumsum(seen > 1) - 1
    row, column = row[shared], number[column[shared]]
    value = (np.concatenate(weights) / np.repeat(mass, sizes))[shared]
    overlap, part = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    columns = int(number[-1]) + 1 if len(number) else 0
    width = max(1, min(columns, (1 << 24) // n))
    for a in range(0, columns, width):
        own = (column >= a) & (column < a + width)
        held = np.zeros((n, width), np.float32)
        held[row[own], column[own] - a] = 1
        share = np.zeros((n, width), np.float32)
        share[row[own], column[own] - a] = value[own]
        overlap += held @ held.T
        part += share @ held.T
    # Plain sets: similarity is overlap by union. Weighted ones: the common mass bounds it from above.
    plain = sizes == mass
    jaccard = overlap / (sizes[:, None] + sizes[None, :] - overlap)
    sure = (jaccard >= least - 1e-6) & plain[:, None] & plain[None, :]
    maybe = (np.minimum(part, part.T) >= least - 1e-4) & ~(plain[:, None] & plain[None, :])
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left = np.ones(n, bool)
    for i in range(n):  # components of the sure links, by breadth
        if left[i]:
            left[i] = False
            edge = np.array([i])
            while len(edge):
                edge = np.flatnonzero(sure[edge].any(0) & left)
                left[edge] = False
                root[edge] = i
    i, j = np.nonzero(np.triu(maybe, 1))
    for k in np.argsort(-part[i, j], kind="stable"):
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b and similarity(keys[i[k]], weights[i[k]], keys[j[k]], weights[j[k]]) >= least - 1e-9:
            root[max(a, b)] = min(a, b)
    return [(find(k), k) for k in range(n) if find(k) != k]


def links(rows: DataFrame, nodes: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """(a, b): forest edges between nodes, from all tiles of all buckets."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.select("digest", "bucket", blocks.alias("blocks"), F.pmod(F.xxhash64("digest", "bucket"), blocks).cast("int").alias("own"))
    tiles = placed.select(
        "digest",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda o: F.struct(F.col("bucket"), F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")),
            )
        ).alias("tile"),
    )
    tiles = written(tiles, "tiles")
    # One row of each member brings its text; the texts of all others stay where they are.
    chosen = nodes.join(tiles.select("digest").distinct(), "digest", "left_semi").select(F.col("doc").alias("w_doc"), F.col("mark").alias("w_mark"))
    texts = rows.join(chosen, rows["mark"].eqNullSafe(chosen["w_mark"]) & rows["doc"].eqNullSafe(chosen["w_doc"]), "left_semi")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for _, texts in word_batches(batch):
                k, w, ends = shingles_of(texts, known)
                cuts = list(zip(ends, ends[1:]))
                keys = [k[a:b].tobytes() for a, b in cuts]
                weights = [b"" if (w[a:b] == 1).all() else w[a:b].astype(np.float32).tobytes() for a, b in cuts]
                digests = [word_digest(words) for words in texts]
                yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "keys": pa.array(keys, pa.binary()), "weights": pa.array(weights, pa.binary())})

    vectors = texts.select("body").mapInArrow(describe, "digest binary, keys binary, weights binary")

    def verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("digest")
        keys = [np.frombuffer(k, np.uint64) for k in group["keys"]]
        weights = [np.frombuffer(w, np.float32).astype(float) if len(w) else np.ones(len(k)) for k, w in zip(keys, group["weights"], strict=True)]
        names = group["digest"].tolist()
        return pd.DataFrame([(names[a], names[b]) for a, b in linked(keys, weights, least)], columns=["a", "b"])

    return tiles.join(vectors, "digest").groupBy("tile").applyInPandas(verify, "a binary, b binary")


def _classed(documents: DataFrame, doc_id: str, text: str, least: float) -> DataFrame:
    """(doc, mark, class_id, keeper, class_size) per row; keeper, the hash of the text that stays, is null for rows alone.

    The row that stays has the least id of its class (null only where the class has no other) and of
    its texts under that id the one with the smallest hash.
    """
    rows = numbered(documents, doc_id, text)
    found = written(described(documents, doc_id, text), "signatures")
    first = F.min(F.struct(F.isnull("doc").alias("nameless"), "doc", "mark"))
    nodes = found.where("digest IS NOT NULL").groupBy("digest").agg(first.alias("at"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    nodes = nodes.select("digest", "at.doc", "at.mark", "n", "bands")
    roots = components(written(links(rows, nodes, buckets(nodes.select("digest", "bands")), least), "links"))
    roots = nodes.select("digest", "doc", "mark", "n").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    sizes = roots.groupBy("root").agg(first.alias("at"), F.sum("n").alias("class_size"))
    sizes = sizes.where("class_size > 1").select("root", F.col("at.doc").alias("class_id"), F.col("at.mark").alias("keeper"), "class_size")
    # Only classes of several rows; written, so that a text with very many copies can be split below.
    shared = written(roots.select("digest", "root").join(sizes, "root").drop("root"), "classes")
    return found.join(shared, "digest", "left").select(
        "doc",
        "mark",
        F.when(F.col("class_size").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        "keeper",
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"),
    )


def classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """Per row: doc_id, text_hash, class_id (the least id of the class) and class_size in rows."""
    found = _classed(documents, doc_id, text, least)
    return found.select(F.col("doc").alias(doc_id), F.col("mark").alias("text_hash"), "class_id", "class_size")


def one_per_class(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """Rows of ``documents``, all columns as they are: of each class the row with the least id.

    Of two texts of one class under that id the one with the smaller hash stays; ids of other classes
    do not matter. Rows that repeat an id with its text count once.
    """
    found = _classed(documents, doc_id, text, least).where("class_size > 1")
    gone = found.where(~(F.col("doc").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("keeper"))))
    gone = gone.select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).distinct()
    rows = documents.withColumn("__row", F.xxhash64(F.col(text).cast("string")))
    rows = rows.join(gone, rows["__row"].eqNullSafe(gone["__mark"]) & rows[doc_id].eqNullSafe(gone["__doc"]), "left_anti")
    return rows.dropDuplicates([doc_id, "__row"]).drop("__row")
