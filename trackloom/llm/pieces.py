"""Unigram encoding of texts into pieces: Viterbi over a double-array trie, byte fallback, decoding.

The vocabulary is a public model file (pieces with scores, a flag for byte fallback and the space
rule); nothing is trained. A file of unigram kind gives log scores; one of merge kind gives ranks,
which Zipf's law turns into log-probabilities: the piece of rank r, from 1, has -ln(r H), where H
makes the probabilities sum to one. Spaces become the marker U+2581, one of them is put in front, and the
best path is the one with the largest sum of scores, later starts winning no tie. A character that
no piece covers costs the lowest score less 10 and is written as its UTF-8 bytes.

No piece of the vocabulary has a marker behind another character, so the best path of a text is the
best paths of its marker-led words, one after the other; each worker remembers the words it has
seen in a table of bounded size. A vocabulary for which that does not hold is walked text by text.

Edge cases: null and empty texts have no pieces and decode to the empty text; a text that itself
contains U+2581 decodes to a space there, all others decode to themselves.
"""

from __future__ import annotations

import math
import re
import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import rows_of, sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: A worker remembers the words of one to two such counts.
CACHE_LIMIT = 400_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces, scores and kinds of a model file, and the double-array trie over the usable pieces."""

    def __init__(self, path: str = MODEL):
        store, inner = pafs.FileSystem.from_uri(path)
        with store.open_input_stream(inner) as stream:
            data = stream.read()
        self.pieces, self.scores, self.kinds = [], [], []
        self.dummy_prefix, self.byte_fallback, merges = True, False, False
        for number, value in _fields(data):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append(part.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", part.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(part.get(3, NORMAL))
            elif number == 2:
                told = dict(_fields(value))
                self.byte_fallback = bool(told.get(35, 0))
                merges = told.get(3, 1) == 2
            elif number == 3:
                rule = dict(_fields(value))
                self.dummy_prefix = bool(rule.get(3, 1))
                if rule.get(2) or rule.get(4, 1) or not rule.get(5, 1):
                    raise ValueError("only vocabularies without a character map and with all spaces kept are supported")
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER) and self.pieces[i]]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        if merges:
            order = {s: k for k, s in enumerate(sorted({self.scores[i] for i in usable}, reverse=True))}
            total = math.fsum(1 / (order[self.scores[i]] + 1) for i in usable)
            for i in usable:
                self.scores[i] = -math.log((order[self.scores[i]] + 1) * total)
        lowest = min((self.scores[i] for i in usable), default=0.0)
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.base, self.check = double_array({self.pieces[i].encode(): i for i in usable})
        # The piece that ends in a state, read off its end child once.
        self.piece_of = [-1] * len(self.check)
        for state, child in enumerate(self.base):
            if self.check[state] >= 0 and child >= 0 and self.check[child] == state and self.base[child] < 0:
                self.piece_of[state] = -1 - self.base[child]
        texts = [self.pieces[i] for i in usable]
        self.by_word = not any(MARK in p.lstrip(MARK) for p in texts)
        alone = "" if any("\n" in p for p in texts) else "\n"
        self.words = re.compile(f"{alone}|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.plain = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]


def double_array(keys: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """base and check: from state s byte b leads to t = base[s] + b + 1 where check[t] == s.

    A piece ends in a state whose child 0 exists; base of that child is -1 - id.
    """
    trie: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for key, value in keys.items():
        at = 0
        for b in key:
            at = trie[at].setdefault(b, len(trie)) if b in trie[at] else _grow(trie, ends, at, b)
        ends[at] = value
    size = max(4096, len(trie) * 2 + 512)
    base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    check[0] = 0
    place, first = {0: 0}, 1
    todo = deque([0])
    while todo:
        node = todo.popleft()
        codes = [b + 1 for b in trie[node]] + ([0] if ends[node] >= 0 else [])
        if not codes:
            continue
        state, lowest = place[node], min(codes)
        while first < size and check[first] >= 0:
            first += 1
        slot = first
        while True:
            if slot + 300 >= len(check):
                base = np.concatenate([base, np.zeros(size, np.int64)])
                check = np.concatenate([check, np.full(size, -1, np.int64)])
            start = slot - lowest
            if start >= 0 and check[slot] < 0 and all(check[start + c] < 0 for c in codes):
                break
            slot += 1
        base[state] = start
        for c in codes:
            check[start + c] = state
            if c == 0:
                base[start] = -1 - ends[node]
            else:
                child = trie[node][c - 1]
                place[child] = start + c
                todo.append(child)
    # A full row of children fits behind every state, so a lookup needs no test of bounds.
    room = np.full(512, -1, np.int64)
    return [*base.tolist(), *(room * 0).tolist()], [*check.tolist(), *room.tolist()]


def _grow(trie: list[dict[int, int]], ends: list[int], at: int, b: int) -> int:
    trie.append({})
    ends.append(-1)
    trie[at][b] = len(trie) - 1
    return len(trie) - 1


def best_path(word: str, vocabulary: Vocabulary) -> list[int]:
    """Ids of the best path through one word; unknown characters come out as bytes."""
    data = word.encode("utf-8", "replace")
    n = len(data)
    base, check, piece_of, scores = vocabulary.base, vocabulary.check, vocabulary.piece_of, vocabulary.scores
    best = [-math.inf] * (n + 1)
    back, ids = [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    start = 0
    while start < n:
        lead = data[start]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        here, state, end, single = best[start], 0, start, False
        for byte in data[start:] if start else data:
            below = base[state] + byte + 1
            if check[below] != state:
                break
            state, end = below, end + 1
            piece = piece_of[below]
            if piece >= 0:
                score = here + scores[piece]
                if score > best[end]:
                    best[end], back[end], ids[end] = score, start, piece
                if end == start + width:
                    single = True
        if not single:
            end = min(start + width, n)
            score = here + vocabulary.unknown_score
            if score > best[end]:
                best[end], back[end], ids[end] = score, start, -1
        start += width
    out = []
    at = n
    while at > 0:
        if ids[at] >= 0:
            out.append(ids[at])
        elif vocabulary.byte_fallback:
            out += [vocabulary.byte_ids[b] for b in reversed(data[back[at] : at])]
        else:
            out.append(vocabulary.unknown)
        at = back[at]
    return out[::-1]


class Words(dict):
    """Packed ids of a word, remembered; when the memory is full, words not met since the last time are forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.earlier: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_LIMIT:
            self.earlier = dict(self)
            self.clear()
        value = self.earlier.get(word)
        if value is None:
            value = np.array(best_path(word, self.vocabulary), np.int32).tobytes()
        if len(word) <= 40:
            self[word] = value
        return value


def encode(text: str, known: Words) -> bytes:
    """Ids of a text as packed 32-bit numbers."""
    if not text:
        return b""
    vocabulary = known.vocabulary
    marked = text.replace(" ", MARK)
    if vocabulary.dummy_prefix:
        marked = MARK + marked
    if not vocabulary.by_word:
        return known.__missing__(marked)
    return b"".join(map(known.__getitem__, vocabulary.words.findall(marked)))


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    plain = vocabulary.plain
    text = b"".join([plain[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if vocabulary.dummy_prefix and text.startswith(" ") else text


_LOADED: dict[str, Words] = {}


def loaded(path: str) -> Words:
    """The vocabulary of a path and the words seen so far, kept by the worker from task to task."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Words(Vocabulary(path))
    return _LOADED[path]


def encoded(documents: DataFrame, text: str = "text", path: str = MODEL, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns of ``documents`` with the array ``ids`` and, if named, the decoded text added.

    A column that has such a name already is replaced.
    """
    added = [ids] + ([decoded] if decoded else [])
    rows = documents.select(*[f"`{c}`" for c in documents.columns if c not in added or c == text])
    place = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Imported by name: the words seen so far live in this module, not in the function's copy.
        from trackloom.llm import pieces

        known = pieces.loaded(path)
        for batch in sliced(batches):
            packed = [pieces.encode(body or "", known) for body in batch.column(place).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            flat = np.frombuffer(b"".join(packed), np.int32)
            columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if decoded:
                columns.append(pa.array([pieces.decode(np.frombuffer(p, np.int32).tolist(), known.vocabulary) for p in packed], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{ids}` array<int>" + (f", `{decoded}` string" if decoded else "")
    return rows.mapInArrow(run, schema)


def decoded_texts(tokens: DataFrame, ids: str = "ids", path: str = MODEL, text: str = "text") -> DataFrame:
    """The other columns of ``tokens`` with the text that its ids stand for; null ids give null."""
    rows = tokens.select(*[f"`{c}`" for c in tokens.columns if c != text])
    place = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trackloom.llm import pieces

        vocabulary = pieces.loaded(path).vocabulary
        for batch in sliced(batches):
            out = [None if x is None else pieces.decode(x, vocabulary) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{text}` string"
    return rows.mapInArrow(run, schema)


def report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes_fallback and whether decoding gives the text back."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trackloom.llm import pieces

        known = pieces.loaded(path)
        fallback = np.array([k == BYTE for k in known.vocabulary.kinds])
        for batch in sliced(batches):
            bodies = [body for (body,) in rows_of(batch, "body")]
            packed = [pieces.encode(body, known) for body in bodies]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            flat = np.frombuffer(b"".join(packed), np.int32)
            same = [pieces.decode(np.frombuffer(p, np.int32).tolist(), known.vocabulary) == body for p, body in zip(packed, bodies, strict=True)]
            byte_sums = np.concatenate([[0], np.cumsum(fallback[flat])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends).astype(np.int64)), pa.array((byte_sums[ends[1:]] - byte_sums[ends[:-1]]).astype(np.int64)), pa.array(same, pa.bool_())],
                names=["doc_id", "ids", "n_pieces", "n_byte_pieces", "decodes_to_text"],
            )

    out = rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces bigint, n_byte_pieces bigint, decodes_to_text boolean")
    return out.withColumnRenamed("doc_id", doc_id)
