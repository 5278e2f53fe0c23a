"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's bytes (ASCII letters lower-cased) are cut into windows of ``WINDOW`` bytes that overlap by
the widest filter less one, so every byte of a text is read. Each window passes an embedding, filters
of several widths, max pooling over the window and a softmax; a text's probabilities are the mean
over its windows, weighted by their bytes.

Training takes a bounded sample: at most ``PER_LANGUAGE`` different texts of each language, the
first by hash, and of each at most ``PIECES`` windows. At scoring time embedding and filters are
folded into one table per byte pair, so a position costs two table rows.

Edge cases: a null text and one without a letter are ``und`` with score 0, as is every text where
nothing was learned; repeated rows give repeated results; null labels are not learned from; only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import remainder, rows_of, written

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
PER_LANGUAGE = 600
PIECES = 4
BATCH = 64
STEPS = 700
UNKNOWN = "und"
BROADCAST_ROWS = 200_000
#: A filter keeps a text whose best language has at least this mean probability.
LEAST = 0.5


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW) bytes of all of ``text``, zero-padded, and how many bytes each window adds."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(raw) - max(WIDTHS) + 1) // step))
    padded = np.zeros(n * step + max(WIDTHS) - 1, np.uint8)
    padded[: len(raw)] = raw
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]
    weight = np.clip(len(raw) - np.arange(n) * step, 1, step)
    return out, weight.astype(np.float64)


def train(pieces: np.ndarray, labels: np.ndarray, n_labels: int, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit the network with Adam on (n, WINDOW) bytes; the gradient of a maximum reaches one position."""
    rng = np.random.default_rng(seed)
    par = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "v": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, n_labels)), "c": np.zeros(n_labels)}
    for w in WIDTHS:
        par[f"w{w}"] = rng.normal(0, 0.3, (w, EMBEDDING, FILTERS))
        par[f"b{w}"] = np.zeros(FILTERS)
    par = {k: x.astype(np.float32) for k, x in par.items()}
    first = {k: np.zeros_like(x) for k, x in par.items()}
    second = {k: np.zeros_like(x) for k, x in par.items()}
    # Every language is drawn alike, however many windows it has.
    groups = [np.flatnonzero(labels == k) for k in range(n_labels)]
    filters = np.arange(FILTERS)
    for step in range(1, steps + 1):
        own = np.array([rng.choice(groups[k]) for k in rng.integers(0, n_labels, BATCH)])
        x, y = pieces[own], labels[own]
        pooled, where = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            table = np.einsum("be,wef->wbf", par["e"], par[f"w{w}"])
            conv = table[0][x[:, :n]]
            for k in range(1, w):
                conv += table[k][x[:, k : k + n]]
            top = conv.argmax(1)
            where.append(top)
            pooled.append(np.take_along_axis(conv, top[:, None], 1)[:, 0] + par[f"b{w}"])
        z = np.concatenate(pooled, 1)
        h = np.maximum(z, 0)
        out = h @ par["v"] + par["c"]
        p = np.exp(out - out.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(BATCH), y] -= 1
        p /= BATCH
        grad = {k: np.zeros_like(v) for k, v in par.items()}
        grad["v"], grad["c"] = h.T @ p, p.sum(0)
        dz = (p @ par["v"].T) * (z > 0)
        for i, w in enumerate(WIDTHS):
            d = dz[:, i * FILTERS : (i + 1) * FILTERS]
            grad[f"b{w}"] = d.sum(0)
            for k in range(w):
                seen = x[np.arange(BATCH)[:, None], where[i] + k]
                grad[f"w{w}"][k] = np.einsum("nf,nfe->ef", d, par["e"][seen])
                np.add.at(grad["e"], seen, d[:, :, None] * par[f"w{w}"][k].T[filters][None])
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in par:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            par[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return par


def fold(par: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Tables by byte pair: at (i, i+1) what all filters get from it, at (i+2, i+3) the wider ones' rest."""
    near = np.zeros((256, 256, len(WIDTHS) * FILTERS), np.float32)
    far = np.zeros_like(near)
    for i, w in enumerate(WIDTHS):
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        table = np.einsum("be,wef->wbf", par["e"], par[f"w{w}"])
        near[:, :, own] = table[0][None, :, :] + table[1][:, None, :]
        if w > 2:
            far[:, :, own] = table[2][None, :, :]
        if w > 3:
            far[:, :, own] += table[3][:, None, :]
    bias = np.concatenate([par[f"b{w}"] for w in WIDTHS])
    # Pair code: first byte low, second byte high; width-2 filters get nothing from the far pair.
    return {"near": near.reshape(65536, -1), "far": far.reshape(65536, -1)[:, FILTERS:].copy(), "bias": bias, "v": par["v"], "c": par["c"]}


def probabilities(net: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Softmax of each window of ``x``; only positions where the widest filter fits are pooled."""
    code = x[:, :-1].astype(np.intp) | x[:, 1:].astype(np.intp) << 8
    n = WINDOW - max(WIDTHS) + 1
    out = np.empty((len(x), len(net["c"])), np.float32)
    for a in range(0, len(x), 64):
        part = code[a : a + 64]
        conv = net["near"].take(part[:, :n], axis=0)
        conv[:, :, FILTERS:] += net["far"].take(part[:, 2 : 2 + n], axis=0)
        h = np.maximum(conv.max(1) + net["bias"], 0)
        z = h @ net["v"] + net["c"]
        p = np.exp(z - z.max(1, keepdims=True))
        out[a : a + 64] = p / p.sum(1, keepdims=True)
    return out


def sample(documents: DataFrame, doc_id: str, text: str, lang: str, per_language: int) -> DataFrame:
    """(lang, piece): windows of at most ``per_language`` different texts of each language."""
    rows = documents.where((remainder(doc_id, 4) != 2) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("body")).withColumn("h", F.xxhash64("body"))
    ranked = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    wanted = written(ranked.where(F.col("k") <= per_language).select("lang", "h"), "sample")
    # per_language narrow rows of each language: sent to every task if their number, just counted, allows.
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    chosen = rows.join(small, ["lang", "h"]).dropDuplicates(["lang", "h"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, pieces = [], []
            for name, body in rows_of(batch, "lang", "body"):
                if any(map(str.isalpha, body)):
                    x, _ = windows(body)
                    for i in np.unique(np.linspace(0, len(x) - 1, PIECES).round().astype(int)):
                        langs.append(name)
                        pieces.append(x[i].tobytes())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "piece": pa.array(pieces, pa.binary())})

    return chosen.select("lang", "body").mapInArrow(cut, "lang string, piece binary")


def fit(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], dict | None]:
    """Learned languages and folded network from the bounded sample; None where there is nothing to learn."""
    rows = sorted((r[0], bytes(r[1])) for r in sample(documents, doc_id, text, lang, per_language).collect())
    names = sorted({r[0] for r in rows})
    if not names:
        return [], None
    pieces = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    return names, fold(train(pieces, np.array([names.index(r[0]) for r in rows]), len(names)))


def classify(bodies: list[str | None], model: tuple[list[str], dict | None]) -> list[tuple[str, float]]:
    """(language, score) of each whole text."""
    names, net = model
    out = []
    for body in bodies:
        if net is None or not body or not any(map(str.isalpha, body)):
            out.append((UNKNOWN, 0.0))
            continue
        x, weight = windows(body)
        p = weight @ probabilities(net, x) / weight.sum()
        out.append((names[int(p.argmax())], float(min(p.max(), 1.0))))
    return out


def predict(documents: DataFrame, model: tuple[list[str], dict | None], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred and score of its whole text."""
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = classify(batch.column(1).to_pylist(), model)
            columns = [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identified(documents: DataFrame, model: tuple[list[str], dict | None], text: str = "text", least: float = LEAST) -> DataFrame:
    """Rows of ``documents``, all columns as they are, whose text has a language with at least ``least``."""
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = classify(batch.column(place).to_pylist(), model)
            yield batch.filter(pa.array([name != UNKNOWN and p >= least for name, p in found], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    found = predict(documents, fit(documents, doc_id, text, lang), doc_id, text)
    return found.select(F.col("doc_id").alias(doc_id), (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
