import random

import numpy as np

from trackloom.llm import minhash as mh
from trackloom.llm.graph import components


def brute_similarity(a, b):
    total = 0.0
    for x in a.keys() & b.keys():
        total += 1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in a.keys() | b.keys())
    return total


def arrays(weights):
    keys = sorted(weights)
    return np.array(keys, np.uint64), np.array([float(weights[k]) for k in keys])


def test_similarity_and_estimate():
    rng = random.Random(3)
    for _ in range(30):
        a = {rng.randint(1, 40) * 7919: rng.randint(1, 4) for _ in range(25)}
        b = {rng.randint(1, 40) * 7919: rng.randint(1, 4) for _ in range(25)}
        exact = mh.similarity(*arrays(a), *arrays(b))
        assert abs(exact - brute_similarity(a, b)) < 1e-12
    sa, sb = mh.signature(*arrays(a), registers=6000), mh.signature(*arrays(b), registers=6000)
    assert abs(np.mean(sa == sb) - exact) < 0.03


def test_forest_of_links_like_brute_force():
    rng = random.Random(8)
    base = [rng.randint(0, 2**60) for _ in range(120)]
    sets = []
    for _ in range(60):
        own = {x: 1 for x in rng.sample(base, rng.randint(95, 120))}
        if rng.random() < 0.5:
            own = {x: rng.choice([1, 1, 1, 2]) for x in own}
        sets.append(own)
    keys, weights = zip(*map(arrays, sets), strict=True)
    for least in (0.75, 0.8, 0.85):
        root = list(range(60))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(60):
            for j in range(i):
                if brute_similarity(sets[i], sets[j]) >= least:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        got = list(range(60))
        for a, b in mh.linked(list(keys), list(weights), least):
            got[b] = a
        assert [find(i) for i in range(60)] == got


def brute_classes(rows, least=mh.LEAST):
    known, root = mh.WordHashes(), {}
    vectors = [mh.shingles(mh.words_of(t), known) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(vectors[i][0]) and len(vectors[j][0]) and mh.similarity(*vectors[i], *vectors[j]) >= least - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    out = {}
    for own in members.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        for i in own:
            out.setdefault(rows[i][0], set()).add((min(ids) if ids else None, len(own)))
    return out


def test_classes_like_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows, n = [], 0
    for _ in range(12):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 1, 3, 20])):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 5000)}"
            rows.append((n, " ".join(copy)))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_classes(rows)
    for block in (mh.BLOCK, 4):  # a large bucket is cut into many tiles
        monkeypatch.setattr(mh, "BLOCK", block)
        got = {r["doc_id"]: {(r["class_id"], r["class_size"])} for r in mh.classes(docs).collect()}
        assert got == want
    kept = mh.one_per_class(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for v in want.values() for c, _ in v})


def test_classes_that_share_their_least_id_and_classes_without_ids(spark):
    rng = random.Random(11)
    a, b, c = ([f"{name}{rng.randint(0, 10**6)}" for _ in range(60)] for name in "abc")
    near = [" ".join([*c[:-1], f"z{i}"]) for i in range(4)]
    rows = [(1, " ".join(a)), (8, " ".join([*a[:-1], "x"])), (1, " ".join(b)), (9, " ".join([*b[:-1], "y"]))]
    rows += [(None, text) for text in near] + [(None, near[0])]
    kept = mh.one_per_class(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["text"] for r in kept if r["doc_id"] is not None) == sorted([rows[0][1], rows[2][1]])
    assert {r["doc_id"] for r in kept} == {1, None}
    assert len(kept) == 3 and [r["text"] for r in kept if r["doc_id"] is None][0] in near
    # A row without an id stays only where its class has no other.
    mixed = [(None, near[0]), (7, near[1]), (7, near[2])]
    kept = mh.one_per_class(spark.createDataFrame(mixed, "doc_id bigint, text string")).collect()
    assert [r["doc_id"] for r in kept] == [7]


def test_odd_rows(spark, odd, nothing):
    got = mh.classes(odd).collect()
    assert len(got) == odd.count()
    size = {r["doc_id"]: r["class_size"] for r in got}
    assert size[1] == size[8] == 3 and size[2] == size[3] == size[4] == 1
    kept = mh.one_per_class(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 8").count() == 0
    assert kept.where("doc_id IS NULL").count() == 2
    assert mh.classes(nothing).collect() == []


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 200)] + [(300 + rng.randint(0, 80), 300 + rng.randint(0, 80)) for _ in range(60)] + [(500, 500), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in root}
