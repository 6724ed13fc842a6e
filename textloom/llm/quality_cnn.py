"""Quality scores from a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of ``WIDTH`` bytes slide over the whole text in steps
of ``STRIDE`` (so a filter starts at every other byte), each chunk of ``CHUNK`` bytes (with its
neighbour: chunks overlap by half) keeps every filter's maximum, and the document's largest and
mean chunk maxima go through a small hidden layer to one probability.

A score depends on the text and the weights alone: no window reaches beyond its text's last
chunk, and scoring adds numbers in an order that the text decides, whatever rows stand
beside it (filters are applied by tables of byte pairs, not by matrix products of a whole batch).

It learns from a bounded sample of labelled rows (``SAMPLE`` rows of at most ``LONGEST``
characters) on the driver; scoring runs over every whole text in Arrow batches.  A text
is processed ``BLOCK`` bytes at a time, so memory doesn't grow with its length.

Defined results: null and empty texts are one chunk of padding; long texts are scored
whole; equal texts get equal scores; an empty table gives an empty table; without labelled
rows of both classes (among those trained on) the score is the share of label 1, or 0.5 with no rows; only the
id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.llm._text import free_name, held_out, utf8
from textloom.llm._training import FOLDS, labelled_sample

SAMPLE, LONGEST = 3_000, 20_000
#: Steps of training.
TRAINED = 500
WIDTH, STRIDE, CHUNK = 8, 2, 128
EMBED, FILTERS, HIDDEN = 8, 16, 16
BLOCK = 1 << 18
PER = CHUNK // STRIDE
STEPS = WIDTH // STRIDE

Weights = dict[str, np.ndarray]


def start(seed: int = 11) -> Weights:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.normal(0, scale, shape)).astype(np.float32)
    return {
        "embed": normal(256, EMBED, scale=0.5),
        "filters": normal(WIDTH * EMBED, FILTERS, scale=0.15),
        "filter_bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(2 * FILTERS, HIDDEN, scale=0.2),
        "hidden_bias": np.full(HIDDEN, 0.1, np.float32),
        "out": normal(HIDDEN, scale=0.3),
        "out_bias": np.zeros(1, np.float32),
    }


def padded(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each filled up with zero bytes to whole chunks; chunks of each."""
    chunks = np.array([max(1, -(-len(r) // CHUNK)) for r in raws])
    joined = b"".join(r.ljust(n * CHUNK, b"\0") for r, n in zip(raws, chunks.tolist(), strict=True))
    return np.frombuffer(joined, np.uint8), chunks


def responses(w: Weights, b: np.ndarray) -> np.ndarray:
    """Filter responses (before the bias) at each step of STRIDE bytes, by matrix products; the last ones of a text aren't whole."""
    rows = w["embed"][b].reshape(-1, STRIDE * EMBED)
    parts = w["filters"].reshape(STEPS, STRIDE * EMBED, FILTERS)
    out = rows @ parts[0]
    for k in range(1, STEPS):
        out[:-k] += rows[k:] @ parts[k]
    return out


def pair_tables(w: Weights) -> np.ndarray:
    """For each step of a window, what a pair of bytes adds to each filter: ``responses`` as four look-ups."""
    first, second = (np.einsum("be,kef->kbf", w["embed"], w["filters"].reshape(STEPS, STRIDE, EMBED, FILTERS)[:, k]) for k in range(STRIDE))
    return (first[:, None] + second[:, :, None]).reshape(STEPS, 1 << 16, FILTERS)


def whole_windows(r: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Responses by chunk, where windows that would reach beyond their text never are the largest."""
    r = r.reshape(-1, PER, FILTERS)
    r[np.cumsum(chunks) - 1, PER - STEPS + 1 :] = -np.inf
    return r


def chunk_maxima(w: Weights, b: np.ndarray, chunks: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
    tables = pair_tables(w) if tables is None else tables
    pairs = b.view("<u2")
    r = tables[0].take(pairs, 0)
    for k in range(1, STEPS):
        r[:-k] += tables[k].take(pairs[k:], 0)
    return np.maximum(whole_windows(r, chunks).max(1) + w["filter_bias"], 0)


def features(maxima: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Largest and mean maximum of each document's overlapping chunks."""
    at = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    pairs = maxima.copy()
    inner = np.ones(len(maxima) - 1, bool)
    inner[at[1:] - 1] = False
    pairs[:-1][inner] = np.maximum(maxima[:-1][inner], maxima[1:][inner])
    return np.concatenate([np.maximum.reduceat(pairs, at), np.add.reduceat(pairs, at) / chunks[:, None]], 1)


def log_odds(w: Weights, x: np.ndarray) -> np.ndarray:
    h = np.maximum((x[:, :, None] * w["hidden"]).sum(1) + w["hidden_bias"], 0)
    return ((h * w["out"]).sum(1) + w["out_bias"]).astype(np.float64)


def probability(w: Weights, x: np.ndarray) -> np.ndarray:
    return _shares(log_odds(w, x))


def _shares(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def predict(w: Weights, raws: list[bytes], tables: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of texts."""
    return _shares(read(w, raws, tables))


def read(w: Weights, raws: list[bytes], tables: np.ndarray | None = None) -> np.ndarray:
    """Log-odds of texts.  Up to BLOCK bytes are in work at once; a longer text goes block by block."""
    tables = pair_tables(w) if tables is None else tables
    out, batch, size = [], [], 0

    def flush() -> None:
        nonlocal size
        if batch:
            b, chunks = padded(batch)
            out.append(log_odds(w, features(chunk_maxima(w, b, chunks, tables), chunks)))
        batch.clear()
        size = 0

    for r in raws:
        if len(r) > BLOCK:
            flush()
            out.append(log_odds(w, features(_long(w, r, tables), np.array([-(-len(r) // CHUNK)]))))
            continue
        if size + len(r) > BLOCK:
            flush()
        batch.append(r)
        size += len(r) + CHUNK
    flush()
    return np.concatenate(out) if out else np.zeros(0)


def _long(w: Weights, raw: bytes, tables: np.ndarray) -> np.ndarray:
    """Chunk maxima of one long text: each block is read with the chunk after it, whose own maxima come with the next block."""
    parts = []
    for at in range(0, len(raw), BLOCK):
        b, chunks = padded([raw[at : at + BLOCK + CHUNK]])
        parts.append(chunk_maxima(w, b, chunks, tables)[: -(-min(BLOCK, len(raw) - at) // CHUNK)])
    return np.concatenate(parts)


def _gradients(w: Weights, b: np.ndarray, chunks: np.ndarray, y: np.ndarray) -> Weights:
    n = len(y)
    r = whole_windows(responses(w, b), chunks)
    arg = r.argmax(1)
    maxima = np.maximum(np.take_along_axis(r, arg[:, None], 1)[:, 0] + w["filter_bias"], 0)
    at = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    last = np.zeros(len(maxima), bool)
    last[at + chunks - 1] = True
    after = np.minimum(np.arange(len(maxima)) + 1, len(maxima) - 1)
    take_next = ~last[:, None] & (maxima[after] > maxima)
    pairs = np.where(take_next, maxima[after], maxima)
    top, mean = np.maximum.reduceat(pairs, at), np.add.reduceat(pairs, at) / chunks[:, None]
    x = np.concatenate([top, mean], 1)
    h = x @ w["hidden"] + w["hidden_bias"]
    a = np.maximum(h, 0)
    p = 1 / (1 + np.exp(-np.clip(a @ w["out"] + w["out_bias"], -30, 30)))
    e = ((p - y) / n).astype(np.float32)
    g: Weights = {"out": a.T @ e, "out_bias": e.sum(keepdims=True)}
    dh = e[:, None] * w["out"] * (h > 0)
    g["hidden"], g["hidden_bias"] = x.T @ dh, dh.sum(0)
    dx = dh @ w["hidden"].T
    doc = np.repeat(np.arange(n), chunks)
    dpairs = dx[doc, FILTERS:] / chunks[doc, None]
    # the largest chunk of each document and filter, the first among equals
    is_top = pairs == top[doc]
    where = np.where(is_top, np.arange(len(pairs))[:, None], len(pairs))
    first = np.minimum.reduceat(where, at)
    dpairs[first, np.arange(FILTERS)] += dx[:, :FILTERS]
    dmax = np.where(take_next, 0, dpairs)
    np.add.at(dmax, after, np.where(take_next, dpairs, 0))
    dmax = dmax * (maxima > 0)
    g["filter_bias"] = dmax.sum(0)
    c, f = np.nonzero(dmax)
    d = dmax[c, f].astype(np.float32)
    where_bytes = ((c * PER + arg[c, f]) * STRIDE)[:, None] + np.arange(WIDTH)
    seen = b[where_bytes]
    window = w["embed"][seen]
    df = np.zeros((FILTERS, WIDTH * EMBED), np.float32)
    order = np.argsort(f, kind="stable")
    flat = (window.reshape(len(f), -1) * d[:, None])[order]
    starts = np.searchsorted(f[order], np.arange(FILTERS))
    for k in range(FILTERS):
        df[k] = flat[starts[k] : starts[k + 1] if k + 1 < FILTERS else len(flat)].sum(0)
    g["filters"] = df.T
    back = w["filters"].T[f].reshape(len(f), WIDTH, EMBED) * d[:, None, None]
    g["embed"] = np.stack([np.bincount(seen.ravel(), back[..., k].ravel(), 256) for k in range(EMBED)], 1).astype(np.float32)
    return g


def train(rows: list[tuple[str, int]], steps: int = TRAINED, batch: int = 48, rate: float = 0.006, seed: int = 11) -> Weights:
    """Adam on the logistic loss over mini-batches of whole texts, in as many steps whatever the number of rows."""
    w = start(seed)
    y = np.array([label for _, label in rows], np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        w["out"][:] = 0
        w["out_bias"][:] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return w
    raws = [utf8(t) for t, _ in rows]
    w["out_bias"][:] = np.log(y.mean() / (1 - y.mean()))
    m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    rng, order = np.random.default_rng(seed), np.zeros(0, np.int64)
    for t in range(1, steps + 1):
        # each pass over the rows has an order of its own; a step may end one pass and begin the next
        while len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(raws))])
        take, order = order[:batch], order[batch:]
        b, chunks = padded([raws[i] for i in take])
        step = rate * (1 - t / (steps + 1))
        for k, g in _gradients(w, b, chunks, y[take]).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            w[k] = (w[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def calibrated(w: Weights, rows: list[tuple[str, int]], ridge: float = 1.0, rounds: int = 25) -> Weights:
    """The network with its last layer scaled and shifted to the rows it wasn't trained on, both classes of equal weight.

    A logistic fit of the labels to the network's log-odds, counted from midway between the classes' means and drawn to leaving their differences as
    they are; so a score of a half is where a text is as likely of one class as of the other, whatever the classes' shares and however far all
    log-odds lie to one side.
    """
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        return w
    # not of the probabilities, which are one and the same for all rows of a network that is too sure of itself
    z = read(w, [utf8(t) for t, _ in rows])
    # nor from nought: a shift that has to be large would cost more than giving up the scale
    middle = (z[y == 1].mean() + z[y == 0].mean()) / 2
    x = np.stack([z - middle, np.ones(len(z))], 1)
    times = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    v = still = np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((times * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * ((v - still) ** 2).sum())

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        hessian = (x * (times * q * (1 - q))[:, None]).T @ x + ridge * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (times * (y - q)) - ridge * (v - still))
        # a step that goes too far is halved
        while loss(v + move) > loss(v) and np.abs(move).max() > 1e-9:
            move = move / 2
        v = v + move
    scale = max(float(v[0]), 1e-3)
    return w | {"out": (w["out"] * scale).astype(np.float32), "out_bias": ((w["out_bias"] - middle) * scale + v[1]).astype(np.float32)}


def learned(rows: list[tuple[str, int]]) -> Weights:
    """Trained on four fifths of the rows, calibrated on the fifth that was left out."""
    return calibrated(train([r for k, r in enumerate(rows) if k % 5]), rows[::5])


def score_column(text: Column, weights: Weights) -> Column:
    @F.arrow_udf(T.DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = pair_tables(weights)
        for texts in batches:
            yield pa.array(predict(weights, [utf8(t.as_py()) for t in texts], tables), pa.float64())

    return scored(text)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", **options) -> Weights:
    return learned(labelled_sample(docs, labels, label, SAMPLE, LONGEST, **options))


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted of each document."""
    weights = fit(docs, labels, label, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(id_col), held_out(F.col(id_col), FOLDS, 0).alias("held_out"), score_column(F.col(text_col), weights).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def apply(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their own columns."""
    weights, name = fit(docs, labels, label, id_col=id_col, text_col=text_col), free_name(docs, "__score")
    return docs.withColumn(name, score_column(F.col(text_col), weights)).where(F.col(name) >= threshold).drop(name)
