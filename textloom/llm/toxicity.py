"""Toxicity scores from a factorization machine over hashed terms.

Terms are the words of a text and their beginnings of 3 to 6 bytes, hashed.  Slots become
features if they tell the classes apart alone, or if they do so in a pair with another one: all
pairs of slots that stand in ``PAIR_LEAST`` rows have a score test against what the machine
leaves unexplained, over all rows of the rarer class (up to ``PAIR_ROWS``) and as many of the other.  The machine learns a weight and a short factor vector for each feature, so
that pairs of terms can say what neither says alone.

It learns from a bounded sample of labelled rows (``SAMPLE`` rows of at most ``LONGEST``
characters) on the driver; scoring runs over every whole text in Arrow batches, with a
model of at most (``FEATURES`` + ``PAIR_FEATURES``) x (``RANK`` + 1) numbers sent along.

Defined results: null and empty texts have no terms and get the score of the bias; long
texts are scored whole; equal texts get equal scores; an empty table gives an empty table;
without labelled rows of both classes the score is the share of label 1, or 0.5 with no rows;
only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.llm._text import alnum_words, held_out
from textloom.llm._training import FOLDS, labelled_sample

SAMPLE, LONGEST = 8_000, 20_000
SLOTS = 1 << 20
FEATURES, LEAST, RANK = 1_024, 4, 4
#: Least difference of a term's shares in the classes, in standard errors.
CLEAR = 3.5
#: Rows of each class over which pairs are tested, the most slots that this may add, a pair's least score in standard errors and in rows, and in how many rows it stands at least.
PAIR_ROWS, PAIR_FEATURES, PAIR_CLEAR, PAIR_WEIGHT, PAIR_LEAST = 2_000, 1_024, 6.0, 3.0, 20
PREFIXES = (3, 4, 5, 6)


def slots(word: bytes) -> tuple[int, ...]:
    """Hashed slots of a word and of its beginnings."""
    terms = [word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k)]
    return tuple(xxhash.xxh64_intdigest(t) % SLOTS for t in terms)


@dataclass
class Machine:
    features: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, active: list[int]) -> float:
        z = self.bias
        if active:
            v = self.factors[active]
            z += float(self.weights[active].sum()) + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


def train(rows: list[tuple[str, int]], steps: int = 250, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Fit by full-batch Adam on the logistic loss."""
    y = np.array([label for _, label in rows], np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Machine({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(0), np.zeros((0, RANK)))
    seen: dict[bytes, tuple[int, ...]] = {}

    def terms(text: str) -> np.ndarray:
        found: set[int] = set()
        for w in set(alnum_words(text)):
            got = seen.get(w)
            if got is None:
                got = seen[w] = slots(w)
            found.update(got)
        return np.fromiter(found, np.int64, len(found))

    docs = [terms(t) for t, _ in rows]
    of = [np.bincount(np.concatenate([d for d, v in zip(docs, y, strict=True) if v == k]), minlength=SLOTS).astype(float) for k in (0, 1)]
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    p = (of[0] + of[1] + 1) / (n0 + n1 + 2)
    z = (of[1] / n1 - of[0] / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    z[(of[0] + of[1] < LEAST) | (np.abs(z) < CLEAR)] = 0
    best = np.lexsort((np.arange(SLOTS), -np.abs(z)))[:FEATURES]
    best = best[z[best] != 0]
    x = _active_matrix(docs, best)
    state, explained = _adam(x, y, steps, rate, decay, seed)
    ours = paired_rows(y)
    some = [docs[i] for i in ours]
    common = np.flatnonzero(np.bincount(np.concatenate(some), minlength=SLOTS) >= PAIR_LEAST)
    # the rows' shares of the classes are not the sample's, and the log-odds move with them
    p = np.clip(explained[ours], 1e-9, 1 - 1e-9)
    odds = np.log(p / (1 - p)) - np.log(n1 / n0) + np.log((y[ours] == 1).sum() / (y[ours] == 0).sum())
    paired = telling_pairs(_active_matrix(some, common, np.uint8), y[ours], 1 / (1 + np.exp(-odds)))
    more = np.setdiff1d(common[paired], best)
    if len(more):
        best = np.concatenate([best, more])
        state, _ = _adam(_active_matrix(docs, best), y, steps, rate, decay, seed)
    return Machine({int(f): k for k, f in enumerate(best)}, float(state[0]), state[1].astype(float), state[2].astype(float))


def paired_rows(y: np.ndarray) -> np.ndarray:
    """As many rows of each class as the rarer one has, at most PAIR_ROWS, in order."""
    n = min(int((y == 1).sum()), int((y == 0).sum()), PAIR_ROWS)
    return np.sort(np.concatenate([np.flatnonzero(y == k)[:n] for k in (0, 1)]))


def _active_matrix(docs: list[np.ndarray], chosen: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """Which of the chosen slots each document has."""
    place = np.full(SLOTS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(docs), max(len(chosen), 1)), kind)
    for i, d in enumerate(docs):
        at = place[d]
        x[i, at[at >= 0]] = 1
    return x


def telling_pairs(x: np.ndarray, y: np.ndarray, explained: np.ndarray, block: int = 1_024) -> np.ndarray:
    """Columns of a 0/1 matrix in some pair whose score test is clear, those of the clearest pairs first, at most PAIR_FEATURES.

    All pairs are scored, two blocks of columns at a time; variances and rows are counted only for blocks in which some pair leaves enough
    unexplained.  The commonest columns come first, so that most blocks are of rare ones and have none.
    """
    left, spread = (y - explained).astype(np.float32), (explained * (1 - explained)).astype(np.float32)
    order = np.argsort(-x.sum(0, dtype=np.int64), kind="stable")
    strength = np.zeros(x.shape[1])
    for a in range(0, len(order), block):
        ours = order[a : a + block]
        part = x[:, ours].astype(np.float32)
        by_left, by_spread = (part * left[:, None]).T, (part * spread[:, None]).T
        for b in range(a, len(order), block):
            theirs = order[b : b + block]
            other = part if a == b else x[:, theirs].astype(np.float32)
            score = np.abs(by_left @ other)
            if a == b:
                np.fill_diagonal(score, 0)
            if score.max() < PAIR_WEIGHT:
                continue
            clear = np.where((score >= PAIR_WEIGHT) & (part.T @ other >= PAIR_LEAST), score / np.sqrt(by_spread @ other + 1e-6), 0)
            strength[ours] = np.maximum(strength[ours], clear.max(1))
            strength[theirs] = np.maximum(strength[theirs], clear.max(0))
    best = np.argsort(-strength, kind="stable")[:PAIR_FEATURES]
    return best[strength[best] >= PAIR_CLEAR]


def _adam(x: np.ndarray, y: np.ndarray, steps: int, rate: float, decay: float, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Bias, weights and factors of least logistic loss, and the probabilities that they give."""
    rng = np.random.default_rng(seed)
    state = [np.array(np.log(y.mean() / (1 - y.mean())), np.float32), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.02, (x.shape[1], RANK)).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in state], [np.zeros_like(a) for a in state]
    for t in range(1, steps + 2):
        b, w, v = state
        xv = x @ v
        out = b + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
        p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
        if t > steps:
            return state, p
        e = (p - y) / len(y)
        grads = [e.sum(), x.T @ e + decay * w, x.T @ (e[:, None] * xv) - (x.T @ e)[:, None] * v + decay * v]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g**2
            state[k] = state[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)


class _Active(dict):
    """Features of each word met, mostly none.  What beginnings give is remembered apart: there are fewer of them."""

    def __init__(self, machine: Machine, most: int = 200_000):
        super().__init__()
        self.features, self.most = machine.features, most
        self.beginnings: dict[bytes, tuple[int, ...]] = {}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most or len(self.beginnings) >= self.most:
            self.clear()
            self.beginnings.clear()
        head = word[: PREFIXES[-1] + 1]
        got = self.beginnings.get(head)
        if got is None:
            got = self.beginnings[head] = tuple(self.features[s] for s in slots(head)[1:] if s in self.features)
        whole = self.features.get(xxhash.xxh64_intdigest(word) % SLOTS)
        self[word] = got = got if whole is None else (whole, *got)
        return got

    def of(self, text: str | None) -> list[int]:
        """The text's features, each once, in order."""
        return sorted(set(chain.from_iterable(map(self.__getitem__, alnum_words(text)))))


def score_column(text: Column, machine: Machine) -> Column:
    @F.arrow_udf(T.DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        active = _Active(machine)
        for texts in batches:
            yield pa.array([machine.score(active.of(t.as_py())) for t in texts], pa.float64())

    return scored(text)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", **options) -> Machine:
    return train(labelled_sample(docs, labels, label, SAMPLE, LONGEST, **options))


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, held_out, score, predicted of each document."""
    machine = fit(docs, labels, label, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(id_col), held_out(F.col(id_col), FOLDS, 0).alias("held_out"), score_column(F.col(text_col), machine).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
