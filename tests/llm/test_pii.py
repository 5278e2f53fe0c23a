import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import pii


def plain_spans(text):
    """The patterns as they are stated."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+%_ 0129()\né", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs_take_linear_time():
    for text in ("1" * 200000, "a" * 200000 + "@", "+1" + "(" * 100000, "a@" * 50000, "1." * 100000):
        pii.base_spans(text)
        pii.candidates(text)


SAMPLE = [
    f"call +1 (5{i:02d}) 555-{1000 + i} or write a{i}@mail{i % 9}.example.com from 10.0.{i}.7, see {2000 + i} and item-{i} v1.{i}" for i in range(90)
] + ["on 4111 1111 1111 1111 paid", "on 4111111111111111 paid 77"] * 20


def test_field_adds_what_repeats_without_pattern():
    model = pii.train(SAMPLE)
    text = "Phone +1 (512) 555-1234 today. " + "word " * 300 + "Again 5125551234 today, in 2019 for 12345 coins."
    base, more = pii.found_spans(text, model)
    assert base == plain_spans(text)
    for kind, a, b in more:
        assert text[a:b] != "2019"
    clean = "In 2019 there were 12345 coins, version 1.2.3 and 30 percent of 7."
    assert pii.found_spans(clean, model) == ([], [])


def test_field_finds_repeats_of_matches_of_several_tokens():
    model = pii.train(SAMPLE)
    filler = "word " * 300
    for plain in ("5125551234", "15125551234", "512.555.1234", "555-1234"):
        text = "Phone +1 (512) 555-1234 today. " + filler + f"Again {plain} today, in 2019 for 12345 coins."
        base, more = pii.found_spans(text, model)
        assert base == plain_spans(text)
        assert [(k, text[a:b]) for k, a, b in more] == [("phone", plain)]
    # However many mentions follow, and however far apart.
    text = "Phone +1 (512) 555-1234 today. " + (filler + "again 5125551234 today. ") * 40
    assert len(pii.found_spans(text, model)[1]) == 40
    other = "Phone +1 (512) 555-1234 today. " + filler + "again 7185550000 today."
    assert pii.found_spans(other, model)[1] == []


def test_messages_reach_the_end_of_a_long_chain():
    import numpy as np

    node = np.zeros((40, 5))
    node[0] = [-20, -20, -20, -20, 0]
    same = np.full((5, 5), -8.0)
    np.fill_diagonal(same, 0)
    p = pii.beliefs(node, [(i, i + 1, same) for i in range(39)])
    assert p[39].argmax() == 4 and p[39, 4] > 0.9


def test_beliefs_are_exact_on_a_tree():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    node = rng.normal(size=(4, 5))
    links = [(0, 1, rng.normal(size=(5, 5))), (1, 2, rng.normal(size=(5, 5))), (1, 3, rng.normal(size=(5, 5)))]
    p = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        w = np.exp(sum(node[i, y[i]] for i in range(4)) + sum(t[y[i], y[j]] for i, j, t in links))
        for i in range(4):
            p[i, y[i]] += w
    assert np.allclose(pii.beliefs(node, links, rounds=60), p / p.sum(1, keepdims=True), atol=1e-5)


def test_report_and_redaction(spark, odd, nothing):
    rows = [(1, "mail bob@example.com, bob@example.com or 10.0.0.1"), (2, None), (2, None), (3, "+1 (743) 555-3824 é")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in pii.report(docs).collect())
    for doc, n_email, n_ip, n_card, n_phone, digest, spans in got:
        base = plain_spans(dict(rows)[doc] or "")
        assert [n_email, n_ip, n_card, n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert digest == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(spans.split(",")) | {""}
    assert len(got) == 4
    cut = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert cut == {1: "mail <EMAIL>, <EMAIL> or <IP>", 2: None, 3: "<PHONE> é"}
    assert pii.report(odd).count() == odd.count() and pii.redact(odd).columns == odd.columns
    assert pii.report(nothing).collect() == []
