import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq

from trackloom.llm import periods
from trackloom.llm.common import table


def plain_lyndon(word):
    out = []
    for i in range(len(word)):
        sizes = [n for n in range(1, len(word) - i + 1) if all(word[i : i + n] < word[i + k : i + n] for k in range(1, n))]
        out.append(max(sizes))
    return out


def plain_runs(word, least=12):
    """All runs by comparing the words at every distance."""
    out, seen = [], set()
    for q in range(1, len(word) // 2 + 1):
        i = 0
        while i + q < len(word):
            j = i
            while j + q < len(word) and word[j] == word[j + q]:
                j += 1
            start, end = i, j + q
            if j > i and end - start >= 2 * q and (start, end) not in seen:
                seen.add((start, end))  # a multiple of the period gives the same stretch
                if end - start >= max(least, 2 * q):
                    out.append((start, end - start, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), rest)]
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], *sha)


def test_lyndon_words_of_both_orders():
    rng = random.Random(3)
    for _ in range(500):
        word = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 24))]
        names = sorted(set(word))
        for order in (names, names[::-1]):
            ranks = [order.index(x) for x in word]
            assert periods.lyndon(ranks) == plain_lyndon(ranks)
    assert periods.lyndon([]) == []


def test_runs_match_comparison_at_every_distance():
    rng = random.Random(5)
    for _ in range(600):
        texts = []
        for _ in range(3):
            word = [rng.randrange(rng.randint(1, 6)) for _ in range(rng.randint(0, 70))]
            for _ in range(rng.randint(0, 2)):
                a, p = rng.randint(0, len(word)), rng.randint(1, 9)
                for i in range(a, min(len(word), a + rng.randint(1, 40))):
                    word[i] = word[a + (i - a) % p]
            texts.append(word)
        found = periods.runs_of([[b"%d" % x for x in t] for t in texts])
        assert [[tuple(r) for r in f.tolist()] for f in found] == [plain_runs(t) for t in texts]


def test_long_periodic_texts():
    for word in ([0] * 30000, list(range(99)) * 300, list(range(30000))):
        got = periods.repetitions(np.array(word)).tolist()
        q = len(set(word))
        assert got == ([[0, len(word), q]] if 2 * q <= len(word) else [])


def test_query_matches_plain_form(spark):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in rows if len(r["text"] or "") < 6000]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    ids = {i for i, _ in rows}
    got = sorted(tuple(r) for r in periods.report(docs).collect() if r["doc_id"] in ids)
    assert got == sorted(plain_report(*r) for r in rows)


def test_edges(spark):
    tail = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 11), (5, "a\x0b" * 12), (6, "é b\u00a0c " * 6), (None, "x y " * 9), (None, "x y " * 9), (7, "w" * 50000)]
    rows += [(i, "one two three four five six seven eight nine ten eleven twelve thirteen") for i in tail] + [(tail[0], None), (tail[1], " ")]
    schema = "k bigint, body string, id string, runs int, collapsed string"
    frame = spark.createDataFrame([(*r, "?", 0, "?") for r in rows], schema)
    got = sorted(map(tuple, periods.report(frame, "k", "body").collect()), key=repr)
    assert got == sorted((plain_report(*r) for r in rows), key=repr)
    assert periods.report(spark.createDataFrame([], schema), "k", "body").collect() == []
    full = periods.periodic_runs(frame, "k", "body").where("id = 5").first()
    assert [tuple(r) for r in full["runs"]] == [(0, 12, 1)] and full["collapsed"] == "a" and full["n_words"] == 12
