"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes with A-Z lower-cased and one end byte. Every byte is decomposed into eight binary
decisions along a tree of 255 nodes; every (context of d bytes, node) has a Krichevsky-Trofimov
estimate from its counts of zeros and ones, d = 0 .. ``DEPTH``, and the weighted probability of a
context mixes its own estimate with the product of its longer contexts, half and half. Counts come
from all training texts. A decision's probability is the mixture over all depths with the weights
those counts leave, so the code length per byte of a text is -log2 of the product, over its bytes.

How it runs: texts are packed into blocks, each with its distinct byte windows of DEPTH + 1 bytes and
its distinct tokens. Counts are summed over blocks; the tree is computed from the distinct windows
alone, apart for each pair of last context bytes, below a top of at most 256 x 255 nodes that is
gathered to finish the mixture; each block then gets back the log-probabilities of its own windows
and the counts of its own tokens. So nothing of the size of the corpus meets in one place, and a
window or token that fills a third of the corpus has at most one row per block. A block ends with its
text or its lists, whichever is full first, and tokens stay in Arrow arrays: what a task holds has a
bound, whatever the texts.

Edge cases: null text is empty text, which has the end token and the end byte only; repeated rows
give repeated results; with no training row at all every estimate is one half; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import expand, pack, pieces, remainder, squeeze, unpack, written

DEPTH = 5
END = 0xFF
BLOCK_BYTES = 64 << 20
BLOCK_ITEMS = 2_000_000
BATCH_ROWS = 1000
PIECE_BYTES = 4 << 20
SCALE = 1 << 24
PART_BYTES = 1 << 19
TOP = 2
NODE_BITS = 8


def lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def text_windows(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of depth + 1 bytes that end at each byte of each text, newest byte lowest; start of each text."""
    pad = bytes(depth)
    data = np.frombuffer(b"".join([pad + t + bytes([END]) for t in texts]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    window = data.astype(np.int64)
    for k in range(1, depth + 1):
        window[k:] |= data[:-k].astype(np.int64) << (8 * k)
    starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
    keep = np.ones(len(data), bool)
    for k in range(depth):
        keep[starts + k] = False
    return window[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def release() -> None:
    """Give freed memory back to the system, Arrow's and (by its pool of that name) that of malloc: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PART_BYTES bytes."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= PART_BYTES:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def added(keys: np.ndarray, counts: np.ndarray, new: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts; ``new`` has some more of them, in order as well."""
    at = np.searchsorted(keys, new)
    old = at < len(keys)
    old[old] = keys[at[old]] == new[old]
    sums = counts.copy()
    sums[at[old]] += n[old]
    return np.insert(keys, at[~old], new[~old]), np.insert(sums, at[~old], n[~old])


def window_counts(texts: list[bytes], train: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of some texts and how often each occurs in the training ones among them."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a, b in parts(texts):
        for kind in (True, False):
            own = [t for t, x in zip(texts[a:b], train[a:b], strict=True) if x == kind]
            if own:
                u, n = np.unique(text_windows(own, depth)[0], return_counts=True)
                keys, counts = added(keys, counts, u, n if kind else np.zeros_like(n))
    return keys, counts


def split_words(texts: list[bytes]) -> tuple[pa.ChunkedArray, list[int]]:
    """The tokens of some texts in order, and how many each text has."""
    chunks, sizes = [], []
    for a, b in parts(texts):
        words = [t.split() for t in texts[a:b]]
        sizes += map(len, words)
        chunks.append(pa.array(chain.from_iterable(words), pa.binary()))
    return pa.chunked_array(chunks, pa.binary()), sizes


def token_counts(texts: list[bytes], train: list[bool]) -> tuple[pa.Array, np.ndarray]:
    """Distinct tokens of some texts and how often each occurs in the training ones among them."""
    words, sizes = split_words(texts)
    found = words.combine_chunks().dictionary_encode()
    n = np.bincount(found.indices.to_numpy(), np.repeat(train, sizes), len(found.dictionary))
    return found.dictionary, n.astype(np.int64)


def added_tokens(tokens: pa.Array, counts: np.ndarray, new: pa.Array, n: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct tokens with the sums of their counts; ``new`` has some more of them."""
    at = pc.index_in(new, value_set=tokens).fill_null(-1).to_numpy()
    sums = counts.copy()
    sums[at[at >= 0]] += n[at >= 0]
    return pa.concat_arrays([tokens, new.filter(pa.array(at < 0))]), np.concatenate([sums, n[at < 0]])


def joined(tokens: pa.Array) -> bytes:
    """The tokens, none of which holds a line feed, as lines."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), tokens), b"\n")[0].as_py()


def split_lines(lines: bytes, n: int) -> pa.Array:
    """``n`` tokens that were ``joined``."""
    data = np.frombuffer(lines, np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))[:n]
    offsets = np.concatenate([[0], ends - np.arange(n)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 10])])


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of keys, all of them among the sorted ``keys``; each distinct one is searched for once, in order."""
    order = np.argsort(wanted)
    ordered = wanted[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.empty(len(wanted), values.dtype)
    out[order] = np.repeat(values[np.searchsorted(keys, ordered[first])], np.diff(first, append=len(wanted)))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8; exact to 1e-11 for x >= 1/2."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, the place of each key among them, and sums of the values."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, place, [np.bincount(place, v, len(distinct)) for v in values]


def subtree(windows: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[dict]:
    """Levels depth .. top of the tree over these windows, the deepest first.

    A level has keys (context << 8 | node), zeros, ones, log of the weighted probability, the log
    weight of its own estimate, and for the deepest level the place of each (window, bit).
    """
    symbol, context = windows & 0xFF, windows >> 8
    bits = np.arange(8)
    nodes = (1 << bits)[None, :] | (symbol[:, None] >> (8 - bits)[None, :])
    bit = (symbol[:, None] >> (7 - bits)[None, :]) & 1
    key = ((context[:, None] << NODE_BITS) | nodes).ravel()
    weight = np.repeat(counts.astype(float), 8)
    keys, place, (zeros, ones) = grouped(key, weight * (1 - bit.ravel()), weight * bit.ravel())
    own = estimate(zeros, ones)
    levels = [{"keys": keys, "zeros": zeros, "ones": ones, "weighted": own, "share": np.ones(len(keys)), "place": place}]
    for d in range(depth - 1, top - 1, -1):
        last = levels[-1]
        mask = (1 << (8 * d)) - 1
        up = ((last["keys"] >> NODE_BITS & mask) << NODE_BITS) | (last["keys"] & 0xFF)
        keys, place, (zeros, ones, longer) = grouped(up, last["zeros"], last["ones"], last["weighted"])
        own = estimate(zeros, ones)
        weighted = np.logaddexp(own, longer) - math.log(2)
        last["up"] = place
        levels.append({"keys": keys, "zeros": zeros, "ones": ones, "weighted": weighted, "share": np.exp(own - math.log(2) - weighted)})
    return levels


def mixed(levels: list[dict], gathered: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Probability of a one at the deepest level, given what the levels above gathered and left over."""
    for i in range(len(levels) - 1, -1, -1):
        level = levels[i]
        p = (level["ones"] + 0.5) / (level["zeros"] + level["ones"] + 1)
        gathered = gathered + left * level["share"] * p
        left = left * (1 - level["share"])
        if i:
            gathered, left = gathered[levels[i - 1]["up"]], left[levels[i - 1]["up"]]
    return gathered


def top_of(rows: pd.DataFrame, top: int) -> dict[int, tuple[float, float]]:
    """What levels 0 .. top - 1 gather and leave for each (context of top - 1 bytes, node)."""
    if not len(rows):
        return {}
    levels = [{"keys": rows["key"].to_numpy(), "zeros": rows["zeros"].to_numpy(), "ones": rows["ones"].to_numpy(), "longer": rows["weighted"].to_numpy()}]
    out = []
    for d in range(top - 1, -1, -1):
        level = levels[-1]
        own = estimate(level["zeros"], level["ones"])
        level["weighted"] = np.logaddexp(own, level["longer"]) - math.log(2)
        level["share"] = np.exp(own - math.log(2) - level["weighted"])
        out.append(level)
        if d:
            mask = (1 << (8 * (d - 1))) - 1
            up = ((level["keys"] >> NODE_BITS & mask) << NODE_BITS) | (level["keys"] & 0xFF)
            keys, place, (zeros, ones, longer) = grouped(up, level["zeros"], level["ones"], level["weighted"])
            level["up"] = place
            levels.append({"keys": keys, "zeros": zeros, "ones": ones, "longer": longer})
    gathered, left = np.zeros(len(out[-1]["keys"])), np.ones(len(out[-1]["keys"]))
    for i in range(len(out) - 1, -1, -1):
        level = out[i]
        p = (level["ones"] + 0.5) / (level["zeros"] + level["ones"] + 1)
        gathered, left = gathered + left * level["share"] * p, left * (1 - level["share"])
        if i:
            gathered, left = gathered[out[i - 1]["up"]], left[out[i - 1]["up"]]
    return dict(zip(out[0]["keys"].tolist(), zip(gathered.tolist(), left.tolist(), strict=True), strict=True))


def packed_blocks(documents: DataFrame, doc_id: str, text: str, depth: int, block_bytes: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Blocks of texts, written to the shared folder: rows with a packed piece of texts (ids, flags,
    texts), and one row with the lists of the block's distinct windows and tokens and their counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from block_rows(batches, depth, block_bytes, block_items, TaskContext.get().partitionId() << 24)

    rows = documents.select(
        F.col(doc_id).cast("string").alias("id"), (remainder(doc_id, 7) == 2).alias("held"), F.col(text).cast("string").alias("body")
    )
    with small_batches(documents.sparkSession):
        return written(rows.mapInArrow(run, BLOCKS), "blocks")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to Python ``BATCH_ROWS`` at a time at most: a batch is held by Spark and by its worker, in buffers that double."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    # Not above zero means no limit.
    if before is None or not 0 < int(before) < BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def block_rows(batches: Iterator[pa.RecordBatch], depth: int, block_bytes: int, block_items: int, block: int) -> Iterator[pa.RecordBatch]:
    """The rows of one task's blocks, numbered from ``block``. A block is full with ``block_bytes`` of
    text or with lists of ``block_items``, to the next piece.
    """
    no_windows, no_tokens = (np.zeros(0, np.int64), np.zeros(0, np.int64)), (pa.array([], pa.binary()), np.zeros(0, np.int64))
    windows, tokens, total, n_texts = no_windows, no_tokens, 0, 0
    for rows in pieces(batches, ("id", "held", "body"), min(PIECE_BYTES, block_bytes)):
        texts, train = [lower(r[2]) for r in rows], [not r[1] for r in rows]
        names = [f"{'' if r[0] is None else '+' + str(r[0])}|{int(r[1])}" for r in rows]
        rows.clear()
        yield one_row(block, payload=pack(list(zip(names, texts, strict=True))))
        windows = added(*windows, *window_counts(texts, train, depth))
        release()
        tokens = added_tokens(*tokens, *token_counts(texts, train))
        n_texts += sum(train)
        total += sum(map(len, texts))
        if total >= block_bytes or len(windows[0]) + len(tokens[0]) >= block_items:
            yield lists(block, *windows, *tokens, n_texts)
            windows, tokens, total, n_texts, block = no_windows, no_tokens, 0, 0, block + 1
        del texts
        release()
    if len(windows[0]):
        yield lists(block, *windows, *tokens, n_texts)
    del windows, tokens
    release()


BLOCKS = "block bigint, payload binary, windows binary, n_train binary, tokens binary, token_train binary, n_texts bigint"


def one_row(block: int, n_texts: int | None = None, **values: bytes) -> pa.RecordBatch:
    names = ("payload", "windows", "n_train", "tokens", "token_train")
    columns = [pa.array([block], pa.int64()), *(pa.array([values.get(c)], pa.binary()) for c in names), pa.array([n_texts], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["block", *names, "n_texts"])


def lists(block: int, windows: np.ndarray, counts: np.ndarray, tokens: pa.Array, token_counts: np.ndarray, n_texts: int) -> pa.RecordBatch:
    return one_row(
        block,
        n_texts,
        windows=squeeze(np.diff(windows, prepend=0).tobytes()),
        n_train=squeeze(counts.tobytes()),
        tokens=squeeze(joined(tokens)),
        token_train=squeeze(token_counts.tobytes()),
    )


def window_rows(blocks: DataFrame) -> DataFrame:
    """(block, place, win, n): the distinct windows of every block and where in its list they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, windows, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                win, n = np.cumsum(np.frombuffer(expand(windows), np.int64)), np.frombuffer(expand(counts), np.int64)
                yield from _listed(block, "win", pa.array(win), n)

    return blocks.where("windows IS NOT NULL").select("block", "windows", "n_train").mapInArrow(run, "block bigint, place int, win bigint, n bigint")


def token_rows(blocks: DataFrame) -> DataFrame:
    """(block, place, token, n): the distinct tokens of every block and where in its list they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, tokens, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(expand(counts), np.int64)
                yield from _listed(block, "token", split_lines(expand(tokens), len(n)), n)

    return blocks.where("tokens IS NOT NULL").select("block", "tokens", "token_train").mapInArrow(run, "block bigint, place int, token binary, n bigint")


def _listed(block: int, name: str, items: pa.Array, counts: np.ndarray, step: int = 100_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(counts), step):
        n = counts[a : a + step]
        places = np.arange(a, a + len(n), dtype=np.int32)
        columns = [pa.array(np.full(len(n), block)), pa.array(places), items.slice(a, step), pa.array(n)]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "place", name, "n"])


def log_probabilities(windows: DataFrame, depth: int) -> DataFrame:
    """(win, value): log10 of the probability of each window's last byte after the others.

    Windows are grouped by the two bytes before the last: a group has at most 256 ** (depth - 1)
    of them, whatever the corpus.
    """
    by_pair = F.shiftright("win", 8).bitwiseAND(0xFFFF)

    def level_top(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        level = subtree(group["win"].to_numpy(), group["n"].to_numpy(), depth, TOP)[-1]
        up = ((level["keys"] >> NODE_BITS & 0xFF) << NODE_BITS) | (level["keys"] & 0xFF)
        return pd.DataFrame({"key": up, "zeros": level["zeros"], "ones": level["ones"], "weighted": level["weighted"]})

    rows = windows.withColumn("pair", by_pair)
    above = rows.groupBy("pair").applyInPandas(level_top, "key bigint, zeros double, ones double, weighted double")
    above = above.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")])
    # At most 256 contexts of one byte with 255 nodes each.
    top = top_of(above.toPandas().sort_values("key"), TOP)

    def values(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        win = group["win"].to_numpy()
        levels = subtree(win, group["n"].to_numpy(), depth, TOP)
        first = levels[-1]["keys"]
        up = ((first >> NODE_BITS & 0xFF) << NODE_BITS) | (first & 0xFF)
        start = np.array([top[k] for k in up.tolist()])
        one = mixed(levels, start[:, 0], start[:, 1])[levels[0]["place"]].reshape(-1, 8)
        bit = ((win & 0xFF)[:, None] >> (7 - np.arange(8))[None, :]) & 1
        return pd.DataFrame({"win": win, "value": np.log10(np.where(bit == 1, one, 1 - one)).sum(1)})

    return rows.groupBy("pair").applyInPandas(values, "win bigint, value double")


def block_scores(left: pa.Table, right: pa.Table, depth: int, ends: int) -> pa.Table:
    """Results of a block's texts from its rows and what came back for its windows and tokens."""
    place, value = right.column("place").to_numpy(), right.column("value").to_numpy()
    n_tokens = np.count_nonzero(place < 0)
    back = np.empty(len(place), np.int64)
    back[place + n_tokens] = value
    gain, told = back[n_tokens:] / SCALE, back[:n_tokens][::-1]
    new, count = int((told & 1).sum()), told >> 1
    part_of, learned = np.log10(count + 1), count > 0
    del place, value, back, told, count
    rows = {c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "bits_per_byte")}
    held_lists = left.filter(pc.is_valid(left.column("windows")))
    win = np.cumsum(np.frombuffer(expand(held_lists.column("windows")[0].as_py()), np.int64))
    tokens = split_lines(expand(held_lists.column("tokens")[0].as_py()), n_tokens)
    for payload in left.column("payload"):
        if not payload.is_valid:
            continue
        items = unpack(payload.as_py())
        texts = [t for _, t in items]
        totals = []
        for a, b in parts(texts):
            found, starts = text_windows(texts[a:b], depth)
            totals += np.add.reduceat(looked_up(win, gain, found), starts).tolist()
        del found, starts
        release()
        words, sizes = split_words(texts)
        own = pc.index_in(words, value_set=tokens).to_numpy()
        edges = np.cumsum([0, *sizes])
        met, logs = np.concatenate([[0], np.cumsum(learned[own])])[edges].tolist(), part_of[own]
        edges = edges.tolist()
        for i, ((name, t), total) in enumerate(zip(items, totals, strict=True)):
            named, held = name.rsplit("|", 1)
            rows["doc_id"].append(named[1:] if named else None)
            rows["held_out"].append(held == "1")
            rows["n_tokens"].append(edges[i + 1] - edges[i] + 1)
            rows["n_known"].append(met[i + 1] - met[i] + (ends > 0))
            rows["logs"].append(math.fsum(logs[edges[i] : edges[i + 1]].tolist()) + math.log10(ends + 1))
            rows["score"].append(total)
            rows["bits_per_byte"].append(-total / math.log10(2) / (len(t) + 1))
        del items, texts, words, own, logs, met
        release()
    del gain, part_of, learned, win, tokens
    release()
    n = len(rows["doc_id"])
    # What the block adds to the number of learned tokens and types, on its first row.
    rows["types"] = [new] * min(n, 1) + [0] * max(n - 1, 0)
    return pa.table(
        {k: pa.array(v, {"doc_id": pa.string(), "held_out": pa.bool_()}.get(k, pa.float64() if k in ("logs", "score", "bits_per_byte") else pa.int64())) for k, v in rows.items()}
    )


def score(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, token counts, base_score, score and bits_per_byte."""
    kind = dict(documents.dtypes)[doc_id]
    blocks = packed_blocks(documents, doc_id, text, depth, block_bytes)

    wins = window_rows(blocks)
    totals = written(wins.groupBy("win").agg(F.sum("n").alias("n")), "windows")
    known = written(log_probabilities(totals, depth), "values")
    # Values go back as whole numbers, which shuffle small: windows as multiples of 1 / SCALE.
    scaled = known.select("win", F.round(F.col("value") * SCALE).cast("bigint").alias("value"))
    back = wins.select("win", "block", "place").join(scaled.hint("shuffle_hash"), "win").select("block", "place", "value")

    # Tokens are dealt out once: each row gets twice the count over all blocks, and one row of each
    # token that was learned one more, so that they can be counted. Their places are below zero.
    same = Window.partitionBy("token")
    counted = token_rows(blocks).select(
        "block", "place", F.sum("n").over(same).alias("c"), F.row_number().over(same.orderBy("block")).alias("r")
    )
    new = F.when((F.col("r") == 1) & (F.col("c") > 0), 1).otherwise(0)
    back = back.unionByName(counted.select("block", (-1 - F.col("place")).alias("place"), (2 * F.col("c") + new).alias("value")))
    ends = blocks.agg(F.sum("n_texts")).first()[0] or 0

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return block_scores(left, right, depth, ends)

    scored = written(
        blocks.select("block", "payload", "windows", "tokens")
        .groupBy("block")
        .cogroup(back.groupBy("block"))
        .applyInArrow(run, "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, bits_per_byte double, types bigint"),
        "scored",
    )
    learned = scored.agg(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))).alias("n"), F.sum("types").alias("v")).first()
    n_tokens, n_types = learned["n"] or 0, (learned["v"] or 0) + (ends > 0)
    return scored.select(
        F.col("doc_id").cast(kind).alias(doc_id),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(n_tokens + n_types + 1)).alias("base_score"),
        "score",
        "bits_per_byte",
    )
