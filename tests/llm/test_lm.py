import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import lm
from trackloom.llm.common import expand, unpack


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


class Tree:
    """Context-tree weighting as stated, node by node."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.memo = depth, {}, {}
        for t in texts:
            data = bytes(depth) + t + b"\xff"
            for i in range(depth, len(data)):
                node = 1
                for k in range(7, -1, -1):
                    bit = data[i] >> k & 1
                    for d in range(depth + 1):
                        c = self.counts.setdefault((data[i - d : i], node), [0, 0])
                        c[bit] += 1
                    node = node * 2 + bit
        self.longer = {}
        for context, node in self.counts:
            if context:
                self.longer.setdefault((context[1:], node), []).append((context, node))

    def own(self, key):
        a, b = self.counts.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, key):
        if key not in self.memo:
            if len(key[0]) == self.depth:
                self.memo[key] = self.own(key)
            else:
                self.memo[key] = np.logaddexp(self.own(key), sum(self.weighted(k) for k in self.longer.get(key, []))) - math.log(2)
        return self.memo[key]

    def one(self, context, node):
        p, left = 0.0, 1.0
        for d in range(self.depth + 1):
            key = (context[self.depth - d :], node)
            a, b = self.counts.get(key, (0, 0))
            share = 1.0 if d == self.depth else math.exp(self.own(key) - math.log(2) - self.weighted(key))
            p += left * share * (b + 0.5) / (a + b + 1)
            left *= 1 - share
        return p

    def score(self, t):
        data, total = bytes(self.depth) + t + b"\xff", 0.0
        for i in range(self.depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                one = self.one(data[i - self.depth : i], node)
                total += math.log10(one if bit else 1 - one)
                node = node * 2 + bit
        return total


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_like_a_plain_tree(spark, block_bytes):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab Cé\n") for _ in range(rng.randint(0, 40)))) for i in range(30)] + [(3, "ab ab"), (90, None), (None, "x y")]
    texts = [(d, lm.lower(t)) for d, t in rows]
    train = [t for d, t in texts if not held_out(d)]
    tree = Tree(train, 3)
    words = [w for t in train for w in t.split()]
    n, v = len(words) + len(train), len(set(words)) + 1
    want = []
    for d, t in texts:
        own = t.split()
        base = sum(math.log10((words.count(w) + 1) / (n + v + 1)) for w in own) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((d, held_out(d), len(own) + 1, sum(w in words for w in own) + 1, n, base, tree.score(t)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r)[:7] for r in lm.score(df, depth=3, block_bytes=block_bytes).collect()]
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)


def test_next_byte_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"abc "), 50)) for _ in range(5)]
    tree = Tree(texts, 2)
    total = sum(
        math.prod((p if s >> (7 - k) & 1 else 1 - p) for k in range(8) for p in [tree.one(b"ab", (1 << k) | (s >> (8 - k)))]) for s in range(256)
    )
    assert total == pytest.approx(1)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 1000.5, 1e7])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_odd_rows(spark, odd, nothing):
    got = lm.score(odd).collect()
    assert len(got) == odd.count()
    assert all(r["score"] < 0 and r["base_score"] < 0 and r["n_known"] <= r["n_tokens"] for r in got)
    assert lm.score(nothing).collect() == []
    unlearned = lm.score(odd.where("doc_id = 5 AND false").union(odd.where("doc_id IS NULL"))).collect()
    assert len(unlearned) == 2


def test_looked_up_finds_what_a_search_of_each_key_finds():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 500))
    values, wanted = rng.random(len(keys)), rng.choice(keys, 4000)
    assert (lm.looked_up(keys, values, wanted) == values[np.searchsorted(keys, wanted)]).all()
    assert lm.looked_up(keys, values, keys[:1]).tolist() == values[:1].tolist()


def random_words(n, seed=4):
    """Texts of about 1,000 bytes whose words and windows hardly ever repeat, a seventh of them held out."""
    rng = np.random.default_rng(seed)
    for a in range(0, n, 50):
        ids = [str(i) for i in range(a, min(a + 50, n))]
        texts = [" ".join(rng.integers(0, 1 << 62, 50).astype(str)) + " the end" for _ in ids]
        yield pa.record_batch({"id": ids, "held": [held_out(i) for i in ids], "body": texts})


def test_lists_of_blocks_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(lm, "PIECE_BYTES", 20_000)
    rows = [r for b in lm.block_rows(random_words(300), 5, 1 << 30, 30_000, 7) for r in b.to_pylist()]
    found = [r for r in rows if r["windows"] is not None]
    windows, tokens, texts = Counter(), Counter(), []
    for r in found:
        win, n = np.cumsum(np.frombuffer(expand(r["windows"]), np.int64)), np.frombuffer(expand(r["n_train"]), np.int64)
        of = np.frombuffer(expand(r["token_train"]), np.int64)
        names = lm.split_lines(expand(r["tokens"]), len(of)).to_pylist()
        assert (np.diff(win) > 0).all() and len({*names}) == len(names) and len(win) + len(of) < 60_000
        windows.update(dict(zip(win.tolist(), n.tolist(), strict=True)))
        tokens.update(dict(zip(names, of.tolist(), strict=True)))
    for r in rows:
        if r["payload"] is not None:
            texts += unpack(r["payload"])
    given = [(i, h, lm.lower(t)) for b in random_words(300) for i, h, t in zip(*b.to_pydict().values(), strict=True)]
    assert len(found) > 5 and {r["block"] for r in rows} == {*range(7, 7 + len(found))}
    assert texts == [(f"+{i}|{int(h)}", t) for i, h, t in given]
    train = [t for _, h, t in given if not h]
    words, want = Counter(w for t in train for w in t.split()), Counter(lm.text_windows(train, 5)[0].tolist())
    assert +tokens == words and +windows == want and sum(r["n_texts"] for r in found) == len(train)
    assert {*tokens} == {w for _, _, t in given for w in t.split()} and {*windows} == {*lm.text_windows([t for *_, t in given], 5)[0].tolist()}


def test_memory_of_a_task_does_not_grow_with_its_texts(monkeypatch):
    monkeypatch.setattr(lm, "PIECE_BYTES", 50_000)

    def most(n):
        tracemalloc.start()
        for _ in lm.block_rows(random_words(n), 5, 1 << 30, 200_000, 0):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    most(100)
    assert most(2400) < 1.3 * most(600)


def test_added_tokens_and_lines():
    have, new = pa.array([b"a", b"bb"], pa.binary()), pa.array([b"bb", b"c"], pa.binary())
    tokens, n = lm.added_tokens(have, np.array([1, 2]), new, np.array([5, 7]))
    assert dict(zip(tokens.to_pylist(), n.tolist(), strict=True)) == {b"a": 1, b"bb": 7, b"c": 7}
    assert lm.split_lines(lm.joined(tokens), 3).equals(tokens)
    nothing = pa.array([], pa.binary())
    assert lm.split_lines(lm.joined(nothing), 0).equals(nothing)


@pytest.mark.parametrize("set_to", [None, "300", "5000"])
def test_texts_go_to_python_in_small_batches(spark, set_to):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    if set_to:
        spark.conf.set(name, set_to)
    else:
        spark.conf.unset(name)
    sizes = spark.range(0, 4000, 1, 1).mapInArrow(lambda batches: (pa.record_batch({"n": [b.num_rows]}) for b in batches), "n long")
    try:
        with lm.small_batches(spark):
            assert max(r["n"] for r in sizes.collect()) == min(int(set_to or 1000), 1000)
        assert spark.conf.get(name, None) == set_to
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
