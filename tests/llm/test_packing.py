import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trackloom.llm import packing
from trackloom.llm.common import table


def test_fullest_is_the_best_of_all_combinations():
    rng = random.Random(4)
    for _ in range(300):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
        room = rng.randint(0, 40)
        sums = (sum(n * x for n, x in zip(pick, counts, strict=True)) for pick in itertools.product(*(range(n + 1) for n in counts.values())))
        got = packing.fullest(counts, room)
        assert all(0 < n <= counts[x] for x, n in got.items())
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def test_plan_equals_bins_filled_one_by_one():
    """A pattern taken several times is as full as the bins that are filled one after the other."""
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 40) for _ in range(rng.randint(1, 8))}
        patterns = packing.plan(counts, 30)
        used = Counter()
        left = dict(counts)
        for times, pattern in patterns:
            for _ in range(times):
                longest = max(x for x, n in left.items() if n)
                left[longest] -= 1
                best = packing.fullest(left, 30 - longest)
                left[longest] += 1
                assert pattern[longest] and sum(x * n for x, n in pattern.items()) == longest + sum(x * n for x, n in best.items())
                for x, n in pattern.items():
                    left[x] -= n
                    used[x] += n
        assert used == Counter(counts) and not any(left.values())


def whole(rows, size):
    """Every sequence is filled without gaps from 0."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return bins


def test_query_matches_the_tokenizer_and_wastes_little(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = packing.report(spark, docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for doc in docs.collect():
        ids = [*tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc["doc_id"], piece] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert len(rows) == len(want)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = whole(rows, 2048)
    assert len(bins) <= 1 + -(-sum(n for _, n, _ in want.values()) // 2048)


@pytest.mark.parametrize("text", ["ÀÉ é ΣΑΣ Σ\tσς\x0bİstanbul", "a<|endoftext|>b <|startoftext|> < |endoftext| >", "x y z　w ", "don't I'LL 12 345 ...!! ́ ́a", "語" * 900 + " 中文 " + "z" * 3000, "\x1c\x1d \x85​", "A1b22.c,,D e-mail@x.org:80 it's IT'S 'tis rock'n'roll <|x|> <|ENDOFTEXT|> ... a_b \x7f~!\x01b", "Q" * 99 + " " + "9" * 99])
def test_words_have_the_ids_of_the_text(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):
        got = np.frombuffer(packing.encode([text], packing.vocabulary_of())[0], "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    texts = [" ".join(f"word{i}x{j}" for j in range(40)) for i in range(20)]
    vocabulary = packing.vocabulary_of()
    one = [packing.encode([t], vocabulary)[0] for t in texts]
    assert one == packing.encode(texts, vocabulary)
    for t, ids in zip(texts, one, strict=True):
        assert packing.encode([t], vocabulary) == [ids]
        assert len(packing.encoder(vocabulary)[1]) <= 200 and len(packing.encoder(vocabulary)[2]) <= 20 * 40 + 50  # words and their parts


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)  # one length holds nearly all rows, over many buckets
    schema = "k bigint, body string, length string, row string, sequence_id string"
    texts = [(1, None), (2, ""), (2, ""), (None, "hello"), (None, "hello"), (3, "one two " * 4000)] + [(i, "same text") for i in range(100)]
    frame = spark.createDataFrame([(*t, "?", "?", "?") for t in texts], schema)
    rows = packing.report(spark, frame, "k", "body").collect()
    assert Counter(r["k"] for r in rows if r["k"] == 3) == {3: 5} and sum(r["length"] for r in rows if r["k"] == 3) == 8001 + 3
    assert len(rows) == len(texts) + 3 and Counter(r["k"] for r in rows)[None] == 2
    whole(rows, 2048)
    assert packing.report(spark, spark.createDataFrame([], schema), "k", "body").collect() == []
    pieces = packing.tokenised(spark, frame, "k", "body", ids=True)
    got = packing.sequences(packing.pack(pieces)).collect()
    assert sum(len(r["ids"]) for r in got) == sum(r["length"] for r in rows) and max(len(r["ids"]) for r in got) <= 2048
    with pytest.raises(Exception, match="a length is not in"):
        packing.pack(spark.createDataFrame([(0,), (5,)], "length int")).collect()
