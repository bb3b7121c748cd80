"""Language of texts by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text is its UTF-8 bytes in windows of ``window`` bytes. Two networks of gated units read each window, one from the left and one from the
right; every position is labelled from both states with probabilities of the learned languages. The probability of a document is the mean
over all its positions, so every byte of a text counts, whatever its length, and nothing depends on other texts.

Training reads at most ``sample`` documents a language, chosen by a hash of the id, and of each at most ``spots`` windows spread evenly over
its text; that bounds what reaches the driver (a language's share doesn't matter: all are trained alike). Languages are the values of lang
of the rows that learning may use.

Defined results: a text that is null or has no letter is ``und`` with a score of 0; without any learned language every text is. Rows with a null
id are held out. Of an id with many rows learning takes the least text. Repeated rows are all labelled; an empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.session import in_worker, ship

UNKNOWN = "und"


def held_out(id_: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 4, is 2. A null id is kept from it."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def windows_of(text: bytes, window: int) -> np.ndarray:
    """All bytes of a text, a window a row; the last is filled up with zeros."""
    n = -(-len(text) // window)
    out = np.zeros(n * window, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, window)


@dataclass
class Network:
    """Two directions of gated units; index 0 reads from the left, 1 from the right.

    inputs (2, 256, 3h): what a byte adds to reset gate, update gate and candidate; states (2, h, 3h) and bias (2, 1, h): what the state
    adds to them; out (2, h, languages) and base (languages): logits of a position.
    """

    inputs: np.ndarray
    states: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: np.ndarray

    @staticmethod
    def new(units: int, languages: int, rng: np.random.Generator, kind: type = np.float32) -> Network:
        def drawn(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(kind)

        return Network(drawn(2, 256, 3 * units, scale=0.3), drawn(2, units, 3 * units, scale=units**-0.5), np.zeros((2, 1, units), kind), drawn(2, units, languages, scale=units**-0.5), np.zeros(languages, kind))

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.bias, self.out, self.base]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _steps(windows: np.ndarray) -> np.ndarray:
    """(window, 2, batch): row of the flat input table that either direction reads at each step."""
    at = windows.T.astype(np.intp)
    return np.stack([at, at[::-1] + 256], axis=1)


def _run(net: Network, windows: np.ndarray, keep: bool) -> tuple[np.ndarray, list[tuple]]:
    """States (window + 1, 2, batch, units) after every step, and what backpropagation needs, if ``keep``."""
    units = net.states.shape[1]
    flat = net.inputs.reshape(512, -1)
    steps = _steps(windows)
    h = np.zeros((len(steps) + 1, 2, len(windows), units), flat.dtype)
    kept = []
    for t, at in enumerate(steps):
        x, g = flat[at], h[t] @ net.states
        gates = _sigmoid(x[..., : 2 * units] + g[..., : 2 * units])
        reset, update = gates[..., :units], gates[..., units:]
        own = g[..., 2 * units :] + net.bias
        candidate = np.tanh(x[..., 2 * units :] + reset * own)
        h[t + 1] = candidate + update * (h[t] - candidate)
        if keep:
            kept.append((reset, update, own, candidate))
    return h, kept


def label(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Probabilities (window, batch, languages) of every position, with the states and what was kept of them."""
    h, kept = _run(net, windows, True)
    logits = h[1:, 0] @ net.out[0] + h[:0:-1, 1] @ net.out[1] + net.base
    logits -= logits.max(axis=-1, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(axis=-1, keepdims=True), h, kept


def loss_and_gradients(net: Network, windows: np.ndarray, used: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the used positions (batch, window) of windows whose language is target, and its gradients in the order of ``parts``."""
    p, h, kept = label(net, windows)
    weight = (used.T / used.sum()).astype(p.dtype)
    each = np.arange(len(windows))
    loss = -float((np.log(p[:, each, target] + 1e-30) * weight).sum())
    d = p * weight[..., None]
    d[:, each, target] -= weight
    units = net.states.shape[1]
    ways = (h[1:, 0], h[:0:-1, 1])
    d_out = np.stack([np.tensordot(way, d, ([0, 1], [0, 1])) for way in ways])
    d_h = np.stack([d @ net.out[0].T, (d @ net.out[1].T)[::-1]], axis=1)
    d_states, d_bias = np.zeros_like(net.states), np.zeros_like(net.bias)
    d_x = np.empty((*d_h.shape[:3], 3 * units), p.dtype)
    back = np.zeros_like(d_h[0])
    for t in range(len(kept) - 1, -1, -1):
        reset, update, own, candidate = kept[t]
        back = back + d_h[t]
        d_c = back * (1 - update) * (1 - candidate * candidate)
        d_u = back * (h[t] - candidate) * update * (1 - update)
        d_own = d_c * reset
        d_r = d_own * own * (1 - reset)
        d_x[t] = np.concatenate([d_r, d_u, d_c], axis=-1)
        d_g = np.concatenate([d_r, d_u, d_own], axis=-1)
        d_states += h[t].transpose(0, 2, 1) @ d_g
        d_bias += d_own.sum(axis=1, keepdims=True)
        back = back * update + d_g @ net.states.transpose(0, 2, 1)
    at, d_x = _steps(windows).ravel(), d_x.reshape(-1, 3 * units)
    d_inputs = np.stack([np.bincount(at, d_x[:, c], 512) for c in range(3 * units)], axis=1).reshape(net.inputs.shape)
    return loss, [d_inputs.astype(p.dtype), d_states, d_bias, d_out, d.sum(axis=(0, 1))]


def train(windows: np.ndarray, used: np.ndarray, target: np.ndarray, languages: int, units: int = 8, rounds: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam over random batches with as many windows of each language; the rate falls to zero."""
    rng = np.random.default_rng(seed)
    net = Network.new(units, languages, rng)
    first, second = ([np.zeros_like(p) for p in net.parts] for _ in range(2))
    rows = [np.flatnonzero(target == k) for k in range(languages)]
    for n in range(1, rounds + 1):
        own = np.concatenate([rng.choice(r, max(1, batch // languages)) for r in rows])
        _, gradients = loss_and_gradients(net, windows[own], used[own], target[own])
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in gradients)))
        for p, g, m, v in zip(net.parts, gradients, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (1 - n / (rounds + 1)) * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)).astype(p.dtype)
    return net


@dataclass
class Model:
    languages: list[str]
    network: Network | None
    window: int


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 300, spots: int = 4, window: int = 64, **training: int) -> Model:
    """Learns from at most ``sample`` documents a language and ``spots`` windows of each."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held")).where("lang is not null and not held and text rlike '\\\\p{L}'")
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()}  # one row a language
    if not counts:
        return Model([], None, window)
    # rows of the least hashes of each language, about twice as many as needed; an id of many rows counts once before rows meet
    share = docs.sparkSession.createDataFrame([(k, min(1 << 62, int(2 * sample / max(1, n) * (1 << 62)))) for k, n in counts.items()], "lang string, upto bigint")
    hashed = own.withColumn("h", F.expr("shiftrightunsigned(xxhash64(id, 29), 2)"))
    texts = hashed.join(F.broadcast(share), "lang").where("h <= upto").groupBy("lang", "h").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for text in b.column(2).to_pylist():
                text = text.encode("utf-8", "surrogatepass")
                starts = np.unique(np.linspace(0, max(0, len(text) - window), spots).astype(int))
                data.append([text[s : s + window] for s in starts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.list_(pa.binary()))], names=["lang", "h", "data"])

    rows = sorted((r.lang, r.h, [bytes(x) for x in r.data]) for r in texts.mapInArrow(cut, "lang string, h bigint, data array<binary>").toLocalIterator())
    languages = sorted({lang for lang, _, _ in rows})
    chosen = [(k, x) for k, lang in enumerate(languages) for _, _, data in [r for r in rows if r[0] == lang][:sample] for x in data]
    if not chosen:
        return Model([], None, window)
    inputs = np.concatenate([windows_of(x, window) for _, x in chosen])
    used = np.array([[i < len(x) for i in range(window)] for _, x in chosen])
    return Model(languages, train(inputs, used, np.array([k for k, _ in chosen]), len(languages), **training), window)


def pooled(net: Network, texts: list[bytes], window: int, at_once: int = 2048) -> np.ndarray:
    """(texts, languages): the mean of the probabilities of all positions of each text."""
    out = np.zeros((len(texts), len(net.base)))
    held: list[tuple[int, np.ndarray, int]] = []  # text, its windows, its bytes in them
    size = 0

    def flush() -> None:
        windows = np.concatenate([w for _, w, _ in held])
        owner = np.repeat([i for i, _, _ in held], [len(w) for _, w, _ in held])
        used = np.concatenate([np.minimum(window, n - np.arange(len(w)) * window) for _, w, n in held])
        h, _ = _run(net, windows, False)
        total = np.zeros((len(windows), len(net.base)))
        for t in range(window):
            logits = h[t + 1, 0] @ net.out[0] + h[window - t, 1] @ net.out[1] + net.base
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p *= ((used > t) / p.sum(axis=1))[:, None]
            total += p
        for k in range(total.shape[1]):
            out[:, k] += np.bincount(owner, total[:, k], len(texts))
        held.clear()

    for i, text in enumerate(texts):
        windows = windows_of(text, window)
        for start in range(0, len(windows), at_once):
            some = windows[start : start + at_once]
            if size + len(some) > at_once and held:
                flush()
                size = 0
            held.append((i, some, min(len(text) - start * window, len(some) * window)))
            size += len(some)
    if held:
        flush()
    return out / np.array([max(1, len(t)) for t in texts])[:, None]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, held_out, lang_pred, score (the probability of lang_pred)."""
    ship(docs.sparkSession)
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    base = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.when(has_letter, F.col(text_col)).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = [(i, t.encode("utf-8", "surrogatepass")) for i, t in enumerate(b.column(2).to_pylist()) if t is not None and model.network]
            names, scores = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows
            if texts:
                p = pooled(model.network, [t for _, t in texts], model.window)
                for (i, _), row in zip(texts, p, strict=True):
                    names[i], scores[i] = model.languages[int(row.argmax())], float(min(1.0, row.max()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return base.mapInArrow(in_worker("language", run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
