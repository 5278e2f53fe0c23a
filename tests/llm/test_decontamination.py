import hashlib
import random
import re

from trackloom.llm import decontamination as dec

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, span=13):
    out = []
    for doc, text in docs:
        w, covered, ids = plain_words(text), set(), set()
        for item, passage in items:
            p = plain_words(passage)
            n = min(span, len(p))
            for k in range(len(p) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == p[k : k + n]:
                        covered |= set(range(i, i + n))
                        ids.add(str(item))
        joined = ",".join(sorted(ids))
        out.append((doc, len(w), len(covered), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(covered) and 20 * len(covered) >= len(w)))
    return sorted(out, key=repr)


def test_like_brute_force_both_ways(spark):
    rng = random.Random(3)
    letters = ["a", "B", "c", "É", "9", "d"]
    docs = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    items = [(i, "-".join(rng.choice(letters) for _ in range(n))) for i, n in enumerate([0, 1, 2, 4, 5, 13, 14, 20])]
    docs += [(50, "x " + items[7][1].upper() + " y"), (50, "x " + items[7][1].upper() + " y"), (None, items[6][1]), (51, None), (52, "")]
    items += [(99, items[6][1]), (100, None)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (dec.SET_LIMIT, 0):
        got = sorted((tuple(r) for r in dec.report(d, b, set_limit=limit).collect()), key=repr)
        assert got == brute(docs, items)


def test_odd_rows_and_removal(spark, odd, nothing):
    items = spark.createDataFrame([("q", "quick brown fox jumps over the lazy dog")], "item_id string, text string")
    got = dec.report(odd, items).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"] for r in got if r["contaminated"]} == {1, 8}
    left = dec.without_contaminated(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 3
    cut = {r["doc_id"]: r["text"] for r in dec.without_spans(odd, items).collect()}
    assert cut[8] == "the again and again until night" and cut[3] is None
    assert dec.report(nothing, items).collect() == []
    none = spark.createDataFrame([], "item_id string, text string")
    assert not any(r["contaminated"] for r in dec.report(odd, none).collect())


def test_clean_rows_under_the_id_of_a_contaminated_one_stay(spark):
    items = spark.createDataFrame([("q", "quick brown fox jumps over the lazy dog")], "item_id string, text string")
    hit, other = "see the quick brown fox jumps over the lazy dog", "quick brown fox jumps over the lazy dog too"
    clean = [(1, "a clean text under one id"), (1, None), (None, "a clean text without an id"), (None, None), (2, "another clean text")]
    docs = spark.createDataFrame([*clean, (1, hit), (None, hit), (1, other)], "doc_id bigint, text string")
    for limit in (dec.SET_LIMIT, 0):
        left = dec.without_contaminated(docs, items, set_limit=limit)
        assert sorted(map(tuple, left.collect()), key=repr) == sorted(clean, key=repr)
    cut = sorted(map(tuple, dec.without_spans(docs, items).collect()), key=repr)
    assert cut == sorted([*clean, (1, "see the"), (None, "see the"), (1, "too")], key=repr)
