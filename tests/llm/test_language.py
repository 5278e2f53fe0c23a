import numpy as np

from trackloom.llm import language


def test_held_out_accuracy_and_odd_rows(spark, small_docs, odd, nothing):
    model = language.fit(small_docs, per_language=60)
    got = language.predict(small_docs, model).join(small_docs.select("doc_id", "lang"), "doc_id")
    got = got.withColumn("held", language.remainder("doc_id", 4) == 2).where("held").collect()
    assert len(got) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["lang_pred"] == by_id[3]["lang_pred"] == by_id[4]["lang_pred"] == by_id[7]["lang_pred"] == language.UNKNOWN
    kept = language.identified(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} & {2, 3, 4, 7} == set()
    assert language.report(nothing).collect() == []
    alone = language.report(odd.drop("lang").withColumn("lang", language.F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in alone} == {language.UNKNOWN}


def test_tables_give_the_convolution():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (6, language.WINDOW)).astype(np.uint8)
    par = language.train(x, np.array([0, 1, 2] * 2), 3, steps=3)
    net = language.fold(par)
    n = language.WINDOW - max(language.WIDTHS) + 1
    h = []
    for w in language.WIDTHS:
        conv = sum(par["e"][x[:, k : k + n]] @ par[f"w{w}"][k] for k in range(w))
        h.append(np.maximum(conv.max(1) + par[f"b{w}"], 0))
    z = np.concatenate(h, 1) @ par["v"] + par["c"]
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(language.probabilities(net, x), p / p.sum(1, keepdims=True), atol=1e-4)


def test_windows_hold_every_byte():
    for n in (0, 1, 3, 255, 256, 257, 900):
        text = "".join(chr(97 + i % 26) for i in range(n))
        x, weight = language.windows(text)
        step = language.WINDOW - max(language.WIDTHS) + 1
        joined = b"".join(row[:step].tobytes() for row in x[:-1]) + x[-1].tobytes()
        assert joined.rstrip(b"\0").decode() == text and len(weight) == len(x)
