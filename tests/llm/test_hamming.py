import random

import pytest

from trackloom.llm import hamming


def brute(rows, k, every):
    out = []
    for q, code in rows:
        if q is not None and q % every == 0 and code is not None:
            near = sorted({(bin((code ^ c) & (2**64 - 1)).count("1"), i) for i, c in rows if c is not None}, key=lambda x: (x[0], (0, x[1]) if x[1] is None else (1, x[1])))[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(set(out), key=repr)


@pytest.mark.parametrize("n,k", [(300, 10), (4, 10), (60, 3)])
def test_like_brute_force(spark, n, k):
    rng = random.Random(n)
    far = [rng.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(n):
        code = rng.choice(far) if rng.random() < 0.5 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 6)):
            code ^= 1 << rng.randrange(64)
        rows.append((i, code - 2**64 if code >= 2**63 else code))
    rows += [(n + i, rows[0][1]) for i in range(n // 3)] + [(rows[1])]
    df = spark.createDataFrame(rows, "id bigint, code bigint")
    got = hamming.search(df, df.where("id % 20 = 0").selectExpr("id AS query_id", "code"), k)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, k, 20)


def test_odd_rows(spark):
    schema = "vec_id bigint, embedding array<float>, code string, query string, distance string"
    nan = float("nan")
    rows = [(0, [1.0, -1.0, None, nan], "?", "?", "?"), (1, None, "?", "?", "?"), (20, [], "?", "?", "?"), (None, [1.0], "?", "?", "?"), (0, [1.0, -1.0, None, nan], "?", "?", "?"), (40, [1.0] * 100, None, None, None)]
    got = hamming.nearest(spark.createDataFrame(rows, schema), k=2).collect()
    assert {(r["query_id"], r["rank"], r["id"], r["distance"]) for r in got} >= {(20, 1, 20, 0), (40, 1, 40, 0), (20, 2, None, 1)}
    assert len(got) == 6
    assert hamming.nearest(spark.createDataFrame([], schema)).collect() == []
