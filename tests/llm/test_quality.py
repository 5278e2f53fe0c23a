import numpy as np
import pytest

from trackloom.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.95
    good = [r["score"] for r in got if r["quality"] == 1]
    bad = [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.9


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    rows = quality.report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.report(nothing, labels).collect() == []
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.report(odd, none).collect()} == {0.5}


def test_updates_follow_the_formula():
    """One coordinate by hand: two examples that hold the bias only."""
    w = quality.train([(np.zeros(1, np.int64), 1), (np.zeros(1, np.int64), 0)], epochs=1)
    z = n = 0.0
    for y in (1, 0):
        own = 0.0 if abs(z) <= quality.L1 else -(z - np.sign(z) * quality.L1) / ((quality.BETA + n**0.5) / quality.ALPHA + quality.L2)
        g = 1 / (1 + np.exp(-own)) - y
        sigma = ((n + g * g) ** 0.5 - n**0.5) / quality.ALPHA
        z, n = z + g - sigma * own, n + g * g
    own = 0.0 if abs(z) <= quality.L1 else -(z - np.sign(z) * quality.L1) / ((quality.BETA + n**0.5) / quality.ALPHA + quality.L2)
    assert w[0] == pytest.approx(own, abs=1e-6) and not w[1:].any()
