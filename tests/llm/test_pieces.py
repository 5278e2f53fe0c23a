import random
from functools import lru_cache

import numpy as np

from trackloom.llm import pieces


@lru_cache
def vocabulary():
    return pieces.Vocabulary()


def ids_of(text, known):
    return np.frombuffer(pieces.encode(text, known), np.int32).tolist()


def brute(text, v):
    """Best sum of scores over all ways to cut a short marked text."""
    usable = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds, strict=True) if k in (pieces.NORMAL, pieces.USER)}

    @lru_cache(None)
    def best(i):
        if i == len(text):
            return 0.0
        found = [usable[text[i:j]] + best(j) for j in range(i + 1, min(len(text), i + 24) + 1) if text[i:j] in usable]
        if text[i] not in usable:
            found.append(v.unknown_score + best(i + 1))
        return max(found)

    return best(0)


def score(ids, v):
    total, run = 0.0, b""
    for i in [*ids, None]:
        if i is not None and v.kinds[i] == pieces.BYTE:
            run += v.plain[i]
            continue
        total += v.unknown_score * len(run.decode("utf-8", "replace")) if run else 0
        run = b""
        total += v.scores[i] if i is not None else 0
    return total


def test_best_path_like_brute_force():
    v = vocabulary()
    known = pieces.Words(v)
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choice("the onen. oféß日🤗ab,\n") for _ in range(rng.randint(1, 30)))
        ids = ids_of(text, known)
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        assert abs(score(ids, v) - brute(marked, v)) < 1e-6
        assert pieces.decode(ids, v) == text


def test_trie_holds_exactly_the_pieces():
    v = vocabulary()
    rng = random.Random(1)
    usable = {p.encode(): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k in (pieces.NORMAL, pieces.USER)}

    def look(key):
        state = 0
        for b in key:
            below = v.base[state] + b + 1
            if v.check[below] != state:
                return -1
            state = below
        return v.piece_of[state]

    assert all(look(k) == i for k, i in usable.items())
    for key in rng.sample(sorted(usable), 500):
        for other in (key + b"q", key[:-1], key[1:]):
            assert look(other) == usable.get(other, -1)


def test_decoding_like_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    v = vocabulary()
    known = pieces.Words(v)
    for text in ("Hello  world", "été 日本 🤗\n x", "a\u0000b"):
        ids = ids_of(text, known)
        assert library.decode(ids) == pieces.decode(ids, v) == text
        assert [library.id_to_piece(i) for i in ids] == [v.pieces[i] for i in ids]


def test_words_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_LIMIT", 10)
    known = pieces.Words(vocabulary())
    plain = pieces.Words(vocabulary())
    text = " ".join(f"w{i}" for i in range(100))
    assert pieces.encode(text, known) == pieces.encode(text, plain) and len(known) <= 10


def test_tables(spark, small_docs, odd, nothing):
    got = pieces.report(small_docs).collect()
    assert len(got) == small_docs.count() and all(r["decodes_to_text"] and len(r["ids"]) == r["n_pieces"] for r in got)
    rows = pieces.report(odd).collect()
    assert len(rows) == odd.count() and all(r["decodes_to_text"] for r in rows)
    both = pieces.encoded(odd, ids="score", decoded="back")
    assert both.columns == [c for c in odd.columns if c != "score"] + ["score", "back"]
    assert all((r["text"] or "") == r["back"] for r in both.collect())
    again = pieces.decoded_texts(both.drop("text"), ids="score", text="text")
    assert all(r["text"] == r["back"] for r in again.collect())
    assert pieces.report(nothing).collect() == []
