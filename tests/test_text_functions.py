import unicodedata

import pyarrow as pa

from trackloom.functions import vectorized as V


def test_texts_are_folded_a_few_at_a_time(spark, monkeypatch):
    texts = ["Ａ  Ｂ", None, "", "Straße　ﬁ", "x" * 5] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r.id: (r.n, r.f) for r in rows.select("id", V.nfkc("text").alias("n"), V.fingerprint("text").alias("f")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None, None) if t is None else got[i] == (unicodedata.normalize("NFKC", t), " ".join(unicodedata.normalize("NFKC", t).casefold().split()))
    held = []
    monkeypatch.setattr(V, "TEXTS_AT_ONCE", 2)
    changed = V.in_parts(pa.array(texts), lambda t: held.append(t) or t.upper())
    assert changed.to_pylist() == [t and t.upper() for t in texts] and len(held) == 12
    assert V.in_parts(pa.array([], pa.string()), str.upper).to_pylist() == []
