"""The stages against plain versions of their decisions."""

import numpy as np

import corpus_pipeline as cp
from trackloom.llm import language, minhash, pieces, pii
from trackloom.llm.common import table

from .conftest import SMALL
from .test_decontamination import brute
from .test_minhash import brute_classes


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    out = cp.run(spark, SMALL)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    got = {r["doc_id"]: r for r in out.collect()}

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = language.fit(docs)
    rows = [(d, t) for (d, t), (name, p) in zip(rows, language.classify([t for _, t in rows], model), strict=True) if name != language.UNKNOWN and p >= language.LEAST]
    keepers = {c for v in brute_classes(rows).values() for c, _ in v}
    rows = [r for r in rows if r[0] in keepers]
    dirty = {r[0] for r in brute(rows, items) if r[-1]}
    rows = [r for r in rows if r[0] not in dirty]
    assert set(got) == {d for d, _ in rows} and len(got) > 100
    known = pieces.Words(pieces.Vocabulary())
    for doc, text in rows:
        for _, a, b in pii.base_spans(text):
            assert text[a:b] not in got[doc]["text"]
        if not pii.candidates(text):
            assert got[doc]["text"] == text
        assert got[doc]["decoded"] == got[doc]["text"] and got[doc]["n_chars"] == len(got[doc]["text"])
        assert got[doc]["ids"] == np.frombuffer(pieces.encode(got[doc]["text"], known), np.int32).tolist()


def test_stages_keep_columns_and_take_odd_rows(spark, odd, nothing, tmp_path):
    for source in (odd, nothing):
        docs = source
        for name, stage in cp.STAGES:
            path = str(tmp_path / f"{name}-{source is odd}")
            stage(spark, docs, SMALL).write.parquet(path)
            after = spark.read.parquet(path)
            assert name == cp.STAGES[-1][0] or after.columns == docs.columns
            docs = after


def test_names_are_the_five_in_order():
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "pieces"]
    assert minhash.LEAST == 0.8 and minhash.SHINGLE == 5
