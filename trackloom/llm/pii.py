"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans. The random field has a node for every base span, of however many
tokens, and for every other *candidate token* of a document (runs of non-space with a digit or an
``@``), labelled O, EMAIL, IP, CARD or PHONE: each has a node potential from its shape, neighbours
in the text share a chain potential, and nodes that repeat, or whose digits or local parts are
alike, share a skip potential however far apart they stand. A base span has its label by a hard
constraint, and every mention of one of its keys is linked to it directly. Loopy belief propagation
then makes one entity carry one label across the document; a token without a pattern match whose
belief in a label is at least ``threshold`` becomes a further span. All other tokens are O by a
hard constraint, which also cuts the chain there, so they need no messages.

Weights are trained piecewise: the pattern matches label the candidate tokens of at most
``SAMPLE_ROWS`` documents (a bounded, documented sample), softmax regression fits the nodes, and
smoothed counts of label pairs give the chain potentials, and how often linked nodes agree (at first, nine
in ten) gives the skip potential. A link between a match and a token
without one is not counted: the patterns say nothing about the latter.

Edge cases: null text is empty text; repeated rows give repeated results; an empty table trains
nothing and yields nothing; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import rows_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("o", *KINDS)
SAMPLE_ROWS = 4000
THRESHOLD = 0.9
#: Messages stop when they settle, on a tree after as many rounds as it is deep; from DAMPED on they are
#: averaged with the former ones, and a graph that never settles ends after ROUNDS.
ROUNDS, DAMPED = 1000, 50
#: Potential of the labels that a match rules out.
RULED_OUT = -1e4

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits starts, so the look-behind changes nothing but the time.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]\S*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from the @ outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches of every kind in the order of KINDS, then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of non-space with a digit or @, without the punctuation around them."""
    out, end = [], 0
    for m in MARKED.finditer(text):
        a, b = m.span()
        while a > end and not text[a - 1].isspace():
            a -= 1
        end = b
        while a < b and not (text[a].isalnum() or text[a] == "+"):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def node_features(token: str) -> list[int]:
    """Indices of the shape features that hold for a token."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    dots = token.count(".")
    held = [
        0,
        1 + min(digits, 20),
        22 + min(dots, 5),
        28 + min(token.count("-"), 5),
        34 + min(letters, 5),
        40 + ("@" in token),
        42 + token.startswith("+"),
        44 + (digits == len(token)),
        46 + (digits + dots == len(token) and dots == 3),
        48 + (16 <= digits <= 19 and not letters and luhn("".join(c for c in token if c in "0123456789"))),
        50 + ("@" in token and "." in token.rpartition("@")[2]),
    ]
    return held


N_FEATURES = 52


def likeness_keys(token: str, proven: int = 0) -> list[str]:
    """What two nodes must share to be joined by a skip edge: the text, the digits or the last 10 of them, the local part.

    A phone or card that a pattern proved is also known by its last 7 digits.
    """
    keys = ["t" + token.lower()]
    digits = "".join(c for c in token if c.isdigit())
    if len(digits) >= 7:
        keys += ["d" + digits, "d" + digits[-10:]]
        if proven and LABELS[proven] in ("card", "phone"):
            keys.append("d" + digits[-7:])
    if "@" in token:
        keys.append("l" + token.partition("@")[0].lower())
    return list(dict.fromkeys(keys))


def nodes_of(tokens: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Nodes in the order of the text and their proven labels: all base spans, and the tokens that none overlaps (0)."""
    rest = [(a, b, 0) for (a, b), k in zip(tokens, labels_of(tokens, spans), strict=True) if not k]
    nodes = sorted([*rest, *((a, b, LABELS.index(k)) for k, a, b in spans)])
    return [(a, b) for a, b, _ in nodes], [k for _, _, k in nodes]


def chain_edges(text: str, nodes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges between neighbours with only space or punctuation between."""
    return [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= 64 and not any(c.isalnum() for c in text[nodes[i][1] : nodes[i + 1][0]])]


def skip_edges(text: str, nodes: list[tuple[int, int]], proven: list[int]) -> list[tuple[int, int]]:
    """Every mention of a likeness key is linked to the first proven mention of it, or to the first of all where none is proven."""
    mentions: dict[str, list[int]] = {}
    for i, ((a, b), k) in enumerate(zip(nodes, proven, strict=True)):
        for key in likeness_keys(text[a:b], k):
            mentions.setdefault(key, []).append(i)
    out = set()
    for own in mentions.values():
        hub = next((i for i in own if proven[i]), own[0])
        out.update((min(hub, i), max(hub, i)) for i in own if i != hub)
    return sorted(out)


def labels_of(tokens: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """Label of each token: the kind of the first base span that overlaps it."""
    out, at = [], 0
    spans = sorted((a, b, LABELS.index(k)) for k, a, b in spans)
    reach = np.maximum.accumulate([b for _, b, _ in spans]) if spans else []
    for a, b in tokens:
        while at < len(spans) and reach[at] <= a:
            at += 1
        label, k = 0, at
        while not label and k < len(spans) and spans[k][0] < b:
            label = spans[k][2] if a < spans[k][1] else 0
            k += 1
        out.append(label)
    return out


def train(texts: list[str], epochs: int = 60) -> dict[str, np.ndarray]:
    """Piecewise fit of node, chain and skip weights on pattern-labelled candidates."""
    feats, gold = [], []
    chain = np.ones((5, 5))
    alike, unlike = 9.0, 1.0
    for text in texts:
        tokens, base = candidates(text), base_spans(text)
        y = labels_of(tokens, base)
        for i, j in chain_edges(text, tokens):
            chain[y[i], y[j]] += 1
        nodes, proven = nodes_of(tokens, base)
        for i, j in skip_edges(text, nodes, proven):
            if bool(proven[i]) == bool(proven[j]):
                alike, unlike = alike + (proven[i] == proven[j]), unlike + (proven[i] != proven[j])
        # The parts of a match teach as well as the whole: either may stand alone elsewhere.
        known = set(tokens)
        whole = [(a, b, LABELS.index(k)) for k, a, b in base if (a, b) not in known]
        feats += [node_features(text[a:b]) for a, b in [*tokens, *((a, b) for a, b, _ in whole)]]
        gold += [*y, *(k for _, _, k in whole)]
    x = np.zeros((len(feats), N_FEATURES))
    for i, f in enumerate(feats):
        x[i, f] = 1
    w = np.zeros((N_FEATURES, 5))
    if len(feats):
        target = np.eye(5)[gold]
        for step in range(epochs * 5):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w += 2.0 / (1 + step / 50) * (x.T @ (target - p) / len(x) - 1e-5 * w)
    # Pair potentials relative to what the labels' own frequencies explain.
    prior = np.bincount(np.array(gold, int), minlength=5) + 1.0
    prior /= prior.sum()

    def potential(counts: np.ndarray) -> np.ndarray:
        joint = counts / counts.sum()
        return np.clip(np.log(joint) - np.log(np.outer(prior, prior)), -3, 3)

    # Nodes that are alike agree: every change of label costs the same, and no label is rewarded for repeating.
    cost = min(np.log(4 * alike / unlike), 6)
    return {"node": w, "chain": potential(chain), "skip": -cost * (1 - np.eye(5))}


def beliefs(node: np.ndarray, links: list[tuple[int, int, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Sum-product loopy belief propagation in the log domain; exact where the graph has no loop."""
    if not links:
        z = np.exp(node - node.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)
    src = np.array([x for i, j, _ in links for x in (i, j)])
    dst = np.array([x for i, j, _ in links for x in (j, i)])
    pot = np.array([x for _, _, t in links for x in (t, t.T)])
    back = np.arange(len(src)) ^ 1
    msg = np.zeros((len(src), 5))
    for step in range(rounds):
        total = node.copy()
        np.add.at(total, dst, msg)
        out = (total[src] - msg[back])[:, :, None] + pot
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        if np.abs(new - msg).max() < 1e-6:
            msg = new
            break
        msg = new if step < DAMPED else 0.5 * msg + 0.5 * new
    total = node.copy()
    np.add.at(total, dst, msg)
    z = np.exp(total - total.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def found_spans(text: str, model: dict[str, np.ndarray], threshold: float = THRESHOLD) -> tuple[list, list]:
    """(base spans, further spans of the random field) of one text."""
    base = base_spans(text)
    tokens = candidates(text)
    if not tokens:
        return base, []
    nodes, proven = nodes_of(tokens, base)
    chain = chain_edges(text, nodes)
    skip = sorted(set(skip_edges(text, nodes, proven)) - {(i, j) for i, j in chain if not proven[i] and not proven[j]})
    node = np.array([model["node"][node_features(text[a:b])].sum(0) for a, b in nodes])
    for i, k in enumerate(proven):
        if k:  # what a pattern proved is a fact, not a guess
            node[i] = RULED_OUT
            node[i, k] = 0
    p = beliefs(node, [(i, j, model["chain"]) for i, j in chain] + [(i, j, model["skip"]) for i, j in skip])
    more = []
    for (a, b), q, k in zip(nodes, p, proven, strict=True):
        label = int(q[1:].argmax()) + 1
        if not k and q[label] >= threshold and telling(text[a:b]):
            more.append((LABELS[label], a, b))
    return base, more


def telling(token: str) -> bool:
    """A short number by itself names nobody, whatever stands around it."""
    return "@" in token or sum(c.isdigit() for c in token) >= 7


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def fit(documents: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Model from a bounded sample: at most ``sample_rows`` different texts, of them as many pieces of text.

    Texts and pieces are taken in the order of their hashes. Only hashes are sorted; the texts are then
    picked where they lie, by the last hash that is in. A piece holds up to ten candidates and what
    stands between them, at most 2,000 characters.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (body,) in rows_of(batch, "body"):
                tokens = candidates(body)
                for i in range(0, len(tokens), 10):
                    own = tokens[i : i + 10]
                    out.append("\n".join(body[max(a - 20, 0) : b + 20][:200] for a, b in own) if own[-1][1] - own[0][0] > 1900 else body[max(own[0][0] - 20, 0) : own[-1][1] + 20])
            yield pa.RecordBatch.from_pydict({"piece": pa.array(out, pa.string())})

    rows = documents.select(F.col(text).cast("string").alias("body")).where(F.col("body").rlike("[0-9@]"))
    hashes = rows.select(F.xxhash64("body").alias("h")).distinct().orderBy("h").limit(sample_rows)
    last = hashes.agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return train([])
    chosen = rows.select("body", F.xxhash64("body").alias("h")).where(F.col("h") <= last).dropDuplicates(["h"])
    sample = chosen.select("body").mapInArrow(pieces, "piece string")
    sample = sample.orderBy(F.xxhash64("piece"), "piece").limit(sample_rows)
    return train([r[0] for r in sample.collect()])


def detect(documents: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, base and all spans as kind:start:end lists."""
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, every = [], [], []
            for (body,) in rows_of(batch, "body"):
                own, more = found_spans(body or "", model, threshold)
                counts.append([sum(s[0] == k for s in own) for k in KINDS])
                base.append(joined(own))
                every.append(joined(own + more))
            numbers = np.array(counts, np.int64).reshape(-1, len(KINDS))
            columns = [batch.column(0), *(pa.array(numbers[:, i]) for i in range(len(KINDS))), pa.array(base, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base string, spans string")


def report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Counts and digest of the base spans, and all spans."""
    found = detect(documents, fit(documents, text), doc_id, text, **options)
    counts = [f"n_{k}" for k in KINDS]
    return found.select(F.col("doc_id").alias(doc_id), *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind; of overlapping spans the leftmost longest wins."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{kind.upper()}>" if a >= at else ""]
        at = b
    return "".join(out) + text[at:]


def redact(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """All columns of ``documents`` as they are, with personal data in ``text`` replaced by its kind."""
    model, place = fit(documents, text), documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in batch.column(place).to_pylist():
                if body is not None:
                    base, more = found_spans(body, model, options.get("threshold", THRESHOLD))
                    body = redacted(body, base + more)
                out.append(body)
            columns = [pa.array(out, batch.column(i).type) if i == place else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(run, documents.schema)

