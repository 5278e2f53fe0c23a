"""Runs of periodic words inside a text, by Baier grouping and Lyndon roots.

A run is a stretch of words with smallest period q and a length of at least max(``LEAST``, 2 q) that
neither neighbour extends. Every run has a Lyndon root that is the longest Lyndon word at its place
under the order of the words or under the reversed order. ``lyndon`` gets all longest Lyndon words of
a sequence from the first phase of Baier's suffix sorter alone: positions are grouped by their first
word; groups are taken from the highest down, and each one moves the positions right before its
members (the nearest to the left in a lower group) into higher groups of their own, whose context
grows by that of the group. The context with which a group is taken is the longest Lyndon word of
its members, so no suffix array is needed. ``repetitions`` extends each root of both orders to both
sides by longest common extensions, which are read from ranks of substrings of 1, 2, 4, .. words.

Before that, words that can be in no run are set aside: every word of a run of ``LEAST`` words or
more lies in ``GRAM`` consecutive words of that run that occur again inside it, ``GRAM`` being at
most half of ``LEAST``. What is left of a text are stretches of words of such repeated grams, and a
run lies in one of them as a whole. Equal hashes of different grams only leave more words in.

Edge cases: a null text has no words and no runs, its rest is empty; texts of any length are read
whole, one after the other; repeated rows give repeated results; ids are only passed on, so null and
equal ids do not matter; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import rows_of

LEAST = 12
GRAM = 6
#: Words of the texts that are looked at together; a longer text is looked at alone.
BLOCK_WORDS = 1 << 18
SLICE = 128


def lyndon(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every position, from the first phase of Baier's sorter."""
    n = len(word)
    group = list(word)  # number of each position's group; symbols are 0, 1, ..
    n_symbols = max(word, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(n_symbols)]
    for i, c in enumerate(word):
        members[c].append(i)
    context = [1] * n_symbols
    below = list(range(-1, n_symbols - 1))
    above = list(range(1, n_symbols + 1))
    left = list(range(n))  # nearest position at or left of i whose group was not taken yet, by links
    out = [0] * n
    g = n_symbols - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        size = context[g]
        for i in own:
            out[i] = size
            left[i] = i - 1
        before: dict[int, int] = {}
        for i in own:
            at = i - 1
            while at >= 0 and left[at] != at:
                at = left[at]
            step = i
            while step != at and step >= 0:  # later walks skip what this one passed
                step, left[step] = left[step], at
            if at >= 0:
                before[at] = before.get(at, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for at, times in before.items():
            moved.setdefault((group[at], -times), []).append(at)
        # Of one group, positions followed by more copies of this context are higher.
        for host, times in sorted(moved):
            new = len(context)
            positions = moved[host, times]
            for at in positions:
                group[at] = new
            members.append(positions)
            context.append(context[host] - times * size)
            upper = above[host]
            below.append(host)
            above.append(upper)
            above[host] = new
            if upper < new and upper < len(below):
                below[upper] = new
        members[g] = []
        g = below[g]
    return out


class Extensions:
    """Longest common extensions of two positions, to the right and to the left, for many pairs at once."""

    def __init__(self, word: np.ndarray):
        self.n = len(word)
        self.levels = [word.astype(np.int64)]
        width = 1
        while width * 2 <= self.n:
            rank = self.levels[-1]
            pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
            distinct, own = np.unique(pair, return_inverse=True)
            if len(distinct) == len(pair):
                break  # longer substrings all differ
            self.levels.append(own)
            width *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` (a < b) on are equal."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            rank, width = self.levels[k], 1 << k
            while True:  # the top level may fit several times
                fits = np.flatnonzero(b + width <= self.n)
                fits = fits[rank[a[fits]] == rank[b[fits]]]
                if not len(fits):
                    break
                a[fits] += width
                b[fits] += width
                out[fits] += width
                if k + 1 < len(self.levels):
                    break
        return out

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and before ``b`` (a < b) are equal."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            rank, width = self.levels[k], 1 << k
            while True:
                fits = np.flatnonzero(a >= width)
                fits = fits[rank[a[fits] - width] == rank[b[fits] - width]]
                if not len(fits):
                    break
                a[fits] -= width
                b[fits] -= width
                out[fits] += width
                if k + 1 < len(self.levels):
                    break
        return out


def repetitions(word: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run of ``word``, by start and period."""
    _, symbols = np.unique(word, return_inverse=True)
    symbols = symbols.astype(np.int64)
    n, top = len(symbols), int(symbols.max(initial=0))
    if n < least:
        return np.zeros((0, 3), np.int64)
    at = np.arange(n)
    roots = np.concatenate([np.array(lyndon(order.tolist()), np.int64) for order in (symbols, top - symbols)])
    starts = np.concatenate([at, at])
    within = starts + roots < n
    a, period = starts[within], roots[within]
    extend = Extensions(symbols)
    before, after = extend.left(a, a + period), extend.right(a, a + period)
    length = before + period + after
    good = length >= np.maximum(least, 2 * period)
    found = np.stack([a - before, length, period], 1)[good]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def stretches(ids: np.ndarray, owner: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of texts, laid end to end, that lie in grams repeated in their text."""
    n = len(ids) - gram + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = owner[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(gram):
        key = (key ^ mixed[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    valid = np.flatnonzero(owner[:n] == owner[gram - 1 :])
    key = key[valid]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    spots = valid[twice]
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, spots, 1)
    np.add.at(mark, spots + gram, -1)
    inside = np.cumsum(mark[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    # Repeated grams of two texts may touch; a stretch ends where its text does.
    cuts = np.flatnonzero(np.diff(owner)) + 1
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    long = ends - starts >= least
    return starts[long], ends[long]


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """(start, length, period) of all runs of each text, given as words, by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for start, end in zip(*stretches(ids, owner, least, min(GRAM, least // 2)), strict=True):
        found = repetitions(ids[start:end], least)
        if len(found):
            found[:, 0] += start - first[owner[start]]
            out[owner[start]].append(found)
    return [np.concatenate(x) if x else np.zeros((0, 3), np.int64) for x in out]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in no run after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def periodic_runs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row.

    Words are separated by ASCII white space. ``runs`` holds (start, length, period) in words, by start
    and then period; ``collapsed`` is the text without the words that a run repeats, joined by spaces.
    """
    kind = dict(documents.dtypes)[doc_id]
    row = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, least)
        rest = []
        for words, runs in zip(texts, found, strict=True):
            if len(runs):
                words = [words[i] for i in np.flatnonzero(kept(len(words), runs))]
            rest.append(b" ".join(words))
        ends = np.cumsum([0] + [len(x) for x in found])
        flat = np.concatenate(found)
        runs = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(row))
        )
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array([len(t) for t in texts], pa.int64()), runs, pa.array(rest, pa.binary()).cast(pa.string())],
            names=["id", "n_words", "runs", "collapsed"],
        )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, total = [], [], 0
        for batch in batches:
            for at, (body,) in enumerate(rows_of(batch, "body")):
                words = (body or "").encode().split()
                ids.append(batch.column(0).slice(at, 1))
                texts.append(words)
                total += len(words)
                if total >= BLOCK_WORDS:
                    yield flush(ids, texts)
                    ids, texts, total = [], [], 0
        if texts:
            yield flush(ids, texts)

    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(find, f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_repeated_tail(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of a tenth of the ids, picked by their CRC-32, end in copies of a part of themselves.

    With h = crc32(id as text), g = h div 10, n words and a = g mod n, p = 1 + (n - a) div (3 + g mod 8),
    every word i >= a becomes word a + (i - a) mod p where 10 divides h. A null id counts as empty text.
    """
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text).cast("string"), r"[ \t-\r]+"), lambda w: w != "")

    def tail(w):
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int")
        index = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.when(n > 0, F.array_join(F.transform(index, lambda i: F.get(w, i)), " "))

    # A one-element transform binds the words to a name, so that they are split once a row.
    repeated = F.get(F.transform(F.array(words), tail), F.lit(0))
    return documents.withColumn(text, F.when(F.pmod(h, F.lit(10)) == 0, repeated).otherwise(F.col(text)))


def report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of runs, the longest one (ties: smallest start, then period) and digests of runs and rest."""
    found = periodic_runs(with_repeated_tail(documents.select(doc_id, text), doc_id, text), doc_id, text)
    # Runs come by start and period; the longest is the least by (-length, start, period).
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    length = -best["less"]
    return found.select(
        F.col("id").alias(doc_id),
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        length.alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * length / best["period"]).alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
