import random

from trackloom.llm import substrings as sub


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows, holders = [], set()
    for i in range(300):
        if i % 10 == 3:
            rows.append((i, prose(rng, rng.randint(0, 200)) + " " + passage + " " + prose(rng, rng.randint(0, 200))))
            holders.add(i)
        else:
            line = prose(rng, 12)
            rows.append((i, prose(rng, 100) + (f"\n{line}" * 6 if i % 10 == 5 else "")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sub.passages(docs).collect()
    assert {r["doc_id"] for r in got} == holders
    texts = dict(rows)
    for r in got:
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["passage"] and r["passage"] in passage
        assert r["kept"] == (r["doc_id"] == r["first_doc_id"]) and (r["kept"] or r["doc_id"] != 3)
    assert all(max(r["n_docs"] for r in got if r["doc_id"] == i) == len(holders) for i in holders)
    cut = {r["doc_id"]: r["text"] for r in sub.without_repeats(docs).collect()}
    assert cut[3] == texts[3] and all(len(cut[i]) < len(texts[i]) - 150 for i in holders - {3})
    assert all(cut[i] == texts[i] for i in set(texts) - holders)


def test_chunks_resist_shifts():
    rng = random.Random(1)
    body = prose(rng, 3000).encode()
    (ends,) = sub.chunk_ends([body])
    assert ends[-1] == len(body) and all(a < b for a, b in zip(ends, ends[1:], strict=False))
    assert max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= sub.LONGEST
    (moved,) = sub.chunk_ends([b"an insertion " + body])
    same = set(sub.digests(body, ends)) & set(sub.digests(b"an insertion " + body, moved))
    assert len(same) >= len(ends) - 4


def test_rolling_hash_like_the_sum():
    import numpy as np

    data = np.frombuffer(b"some bytes to hash with a window", np.uint8)
    h = sub.gear_hash(data)
    for i in range(len(data)):
        want = sum(int(sub.GEAR[data[i - k]]) << k for k in range(min(sub.REACH, i + 1))) % 2**32
        assert int(h[i]) == want


def test_characters_stay_whole_and_odd_rows(spark, odd, nothing):
    rng = random.Random(9)
    shared = " ".join("日本éß"[rng.randint(0, 3)] * rng.randint(1, 5) for _ in range(90))
    docs = spark.createDataFrame([(f"k{i}", prose(rng, i) + "é" + shared) for i in range(5)], "doc_id string, text string")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = sub.passages(docs).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["passage"] for r in got)
    assert {r["doc_id"] for r in sub.passages(odd, least_words=5).collect()} <= {1, 8, None}
    assert sub.passages(nothing).collect() == []
    assert sub.without_repeats(odd).count() == odd.count()


def plain_report(rows):
    """Documents (id, text) in order of their keeper, and for each chunk which ones have it."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    bodies = [(t or "").encode() for _, t in distinct]
    have = {}
    for i, (body, ends) in enumerate(zip(bodies, sub.chunk_ends(bodies), strict=True)):
        for d in set(sub.digests(body, ends)):
            have.setdefault(d, set()).add(i)
    return distinct, bodies, have


def test_results_do_not_depend_on_blocks(spark, monkeypatch):
    """Repeated rows, texts under one id and under none: as a plain search says, however rows are dealt."""
    rng = random.Random(11)
    shared, other = prose(rng, 70), prose(rng, 80)
    own = [prose(rng, 60) for _ in range(8)]
    rows = [(1, own[0] + " " + shared), (1, own[0] + " " + shared), (2, own[1] + " " + other), (2, own[1] + " " + other)]
    rows += [(None, own[2] + " " + shared), (None, own[3] + " " + shared), (3, own[4]), (3, own[4]), (3, prose(rng, 30) + " " + shared + " " + own[5]), (4, None), (4, "")]
    distinct, bodies, have = plain_report(rows)
    want = []
    for i, (body, ends) in enumerate(zip(bodies, sub.chunk_ends(bodies), strict=True)):
        hits = [len(have[d]) for d in sub.digests(body, ends)]
        if max(hits, default=0) > 1:
            want.append((distinct[i][0], distinct[i][1], max(hits), i == min(j for s in have.values() if len(s) > 1 for j in s)))
    seen = []
    for parts, size in ((1, sub.BLOCK_BYTES), (2, sub.BLOCK_BYTES), (8, sub.BLOCK_BYTES), (1, 500)):
        monkeypatch.setattr(sub, "BLOCK_BYTES", size)
        docs = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "n int, doc_id bigint, text string").repartitionByRange(parts, "n").drop("n")
        found = sub.passages(docs)
        assert sorted({(r["doc_id"], r["text_hash"]) for r in found.collect()}, key=repr) == sorted({(r["doc_id"], r["text_hash"]) for r in docs.select("doc_id", sub.F.xxhash64("text").alias("text_hash"), "text").where("contains(text, '" + shared[200:300] + "')").collect()}, key=repr)
        seen.append(sorted(map(tuple, found.collect()), key=repr))
        got = {(r["doc_id"], r["kept"], r["n_docs"]) for r in found.collect()}
        assert got == {(k, first, n) for k, _, n, first in want}
        cut = sorted(map(tuple, sub.without_repeats(docs).collect()), key=repr)
        assert len(cut) == len(rows)
        assert sum(shared[200:300] in (t or "") for _, t in cut) == 2  # both rows of the document that keeps it
        assert sum(other[200:300] in (t or "") for _, t in cut) == 2 and sum(own[4] == t for _, t in cut) == 2
    assert all(s == seen[0] for s in seen)


def test_scripts_without_spaces_have_passages(spark):
    rng = random.Random(2)
    han = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(600))
    docs = spark.createDataFrame([(1, "a " + han), (2, prose(rng, 9) + han + " b"), (3, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(600)))], "doc_id bigint, text string")
    found = sub.passages(docs).collect()
    assert {r["doc_id"] for r in found} == {1, 2} and all(len(r["passage"]) > 500 for r in found)
