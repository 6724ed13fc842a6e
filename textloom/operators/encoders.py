"""Encoders behind one interface, and the deterministic stand-in.

An encoder adds columns to a table of texts; the engine never looks inside.  ``HashEncoder``
needs no model: it is written in built-in functions, so all that surrounds the forward
pass can be checked exactly.  It is no model of language.  ``OnnxEncoder`` runs given ONNX graphs and a tokenizer file
in Arrow batches, one session of each in each Python worker.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textloom.functions.numeric import l2_normalised
from textloom.functions.text import let, token_ids, with_specials
from textloom.operators.sparse import row_terms, row_top_terms


class Encoder(Protocol):
    def dense(self, text: Column) -> Column: ...

    def pair(self, query: Column, document: Column) -> Column: ...

    def sparse(self, text: Column, k: int, least: float) -> Column: ...


class HashEncoder:
    """Token vectors from digests of their ids."""

    def __init__(self, dims: int = 8, longest: int = 64):
        self.dims, self.longest = dims, longest

    def tokens(self, text: Column) -> Column:
        return with_specials(token_ids(text), self.longest)

    def component(self, token: Column, k: int) -> Column:
        """Number in [-1, 1) of a token's k-th place."""
        return F.conv(F.substring(F.md5(F.concat(token.cast("string"), F.lit(f":{k}"))), 1, 6), 16, 10).cast("double") / F.lit(float(1 << 23)) - F.lit(1.0)

    def pooled(self, text: Column) -> Column:
        """Mean of the token vectors."""
        zero = F.array(*[F.lit(0.0)] * self.dims)

        def mean(ids: Column) -> Column:
            def add(s: Column, t: Column) -> Column:
                return F.array(*[F.get(s, F.lit(k)) + self.component(t, k) for k in range(self.dims)])

            return F.aggregate(ids, zero, add, lambda s: F.transform(s, lambda x: x / F.size(ids)))

        return let(self.tokens(text), mean)

    def dense(self, text: Column) -> Column:
        return l2_normalised(self.pooled(text))

    def pair(self, query: Column, document: Column) -> Column:
        """Logit from the share of the query's words that the document has."""
        q, d = F.array_distinct(token_ids(query)), F.array_distinct(token_ids(document))
        share = F.size(F.array_intersect(q, d)) / F.greatest(F.size(q), F.lit(1))
        return share * F.lit(8.0) - F.lit(4.0)

    def sparse(self, text: Column, k: int = 256, least: float = 0.0) -> Column:
        """Array of (term, weight): ln(1 + count) of the text's words."""
        return row_top_terms(row_terms(token_ids(text)), k, least)


#: Inputs that a graph may have.
INPUTS = frozenset(("input_ids", "attention_mask", "token_type_ids"))
SPARSE = T.ArrayType(T.StructType([T.StructField("term", T.IntegerType()), T.StructField("weight", T.FloatType())]))


class Model:
    """A tokenizer and a graph in one Python worker.

    encode(texts or pairs, longest) gives lists of ids; run(feed) the first output; ``inputs`` are the graph's.
    """

    def __init__(self, encode: Callable[[list, int], list[list[int]]], run: Callable[[dict], np.ndarray], inputs: Iterable[str]):
        self.encode, self.run, self.inputs = encode, run, frozenset(inputs)
        if self.inputs - INPUTS:
            warnings.warn(f"inputs that stay unset: {sorted(self.inputs - INPUTS)}", stacklevel=2)

    def outputs(self, ids: list[list[int]], width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
        """The first output of one batch, and its mask."""
        x = np.full((len(ids), width), pad, np.int64)
        mask = np.zeros_like(x)
        for r, row in enumerate(ids):
            x[r, : len(row)] = row
            mask[r, : len(row)] = 1
        feed = {"input_ids": x, "attention_mask": mask, "token_type_ids": np.zeros_like(x)}
        return self.run({k: v for k, v in feed.items() if k in self.inputs}), mask


def ship(spark: SparkSession, *paths: str) -> None:
    """Send files (of any file system, under different names) to every executor, once; ``located`` finds them there, also in tasks that start later."""
    for path in paths:
        spark.sparkContext.addFile(path)


def located(path: str) -> str:
    """A file at its place, or as it was shipped; one that is neither is named."""
    if os.path.exists(path):
        return path
    shipped = SparkFiles.get(os.path.basename(path))
    if not os.path.exists(shipped):
        raise FileNotFoundError(path)
    return shipped


def mapped(path: str) -> np.ndarray:
    """An array file, mapped into memory: the workers of one executor share its pages."""
    return np.load(located(path), mmap_mode="r")


def open_onnx(graph: str, tokenizer: str, threads: int = 1) -> Model:
    """Files that every executor has at that place, or that were shipped; one that is missing is named."""
    graph, tokenizer = located(graph), located(tokenizer)
    import onnxruntime
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(tokenizer)
    words.no_padding()
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    session = onnxruntime.InferenceSession(graph, options)

    def encode(texts: list, longest: int) -> list[list[int]]:
        # the longer one of a pair is cut first, on the right
        words.enable_truncation(longest, strategy="longest_first", direction="right", stride=0)
        return [e.ids[:longest] for e in words.encode_batch(texts)]

    return Model(encode, lambda feed: session.run(None, feed)[0], [i.name for i in session.get_inputs()])


#: Models that this worker opened.
_opened: dict[tuple, Model] = {}


class OnnxEncoder:
    """Dense vectors, pair scores and sparse weights of ONNX graphs, in Arrow batches; a worker opens a graph once.

    graph, tokenizer: files that every executor has at that place, or that were shipped.  ratio: where vectors are
    computed, a batch's longest is at most so many times each of its texts, as sub-batches are planned; at most 1 puts all lengths together.  static: graphs by the batch size that they are made for; a
    batch of exactly that many goes there, padded to ``longest``.  opener: gives a ``Model`` of (graph, tokenizer).
    """

    def __init__(self, graph: str, tokenizer: str, longest: int = 512, batch: int = 32, pad: int = 0, static: dict[int, str] | None = None, opener: Callable[[str, str], Model] = open_onnx, ratio: float = 2.0):
        self.ratio = ratio
        self.graph, self.tokenizer, self.longest, self.batch, self.pad = graph, tokenizer, longest, batch, pad
        self.static, self.opener = dict(static or {}), opener

    def model(self, graph: str) -> Model:
        key = (graph, self.tokenizer, self.opener)
        if key not in _opened:
            _opened[key] = self.opener(graph, self.tokenizer)
        return _opened[key]

    def batches(self, texts: list, ratio: float = 1.0) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(rows, output, mask) of batches of like length, longest first."""
        ids = self.model(self.graph).encode(texts, self.longest)
        if len(ids) != len(texts):
            raise ValueError(f"{len(ids)} encodings for {len(texts)} texts")
        order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
        for rows in self._groups(order, [max(1, len(x)) for x in ids], ratio):
            fixed = self.static.get(len(rows))
            width = self.longest if fixed else max(1, max(len(ids[i]) for i in rows))
            out, mask = self.model(fixed or self.graph).outputs([ids[i] for i in rows], width, self.pad)
            yield rows, out, mask

    def _groups(self, order: list[int], lengths: list[int], ratio: float) -> Iterator[list[int]]:
        """Runs of an order by length that are no longer than a batch, and no wider than the ratio allows."""
        rows: list[int] = []
        for i in order:
            wide = ratio > 1 and rows and np.float32(lengths[rows[0]]) / np.float32(lengths[i]) > np.float32(ratio)
            if rows and (wide or len(rows) == self.batch):
                yield rows
                rows = []
            rows.append(i)
        if rows:
            yield rows

    def vectors(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        for rows, hidden, mask in self.batches(texts, self.ratio):
            if hidden.ndim != 3 or hidden.shape[:2] != mask.shape:
                raise ValueError(f"expected [batch, width, dims], got {hidden.shape}")
            for i, v in zip(rows, pool(hidden, mask), strict=True):
                out[i] = v
        return out

    def scores(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        out = np.zeros(len(pairs), np.float32)
        for rows, logits, _ in self.batches(pairs):
            if logits.shape != (len(rows), 1):
                raise ValueError(f"expected [{len(rows)}, 1], got {logits.shape}")
            out[rows] = logits[:, 0]
        return out

    def weights(self, texts: list[str], k: int, least: float) -> list[list[dict]]:
        """The ``k`` terms of each text whose largest ln(1 + logit) over its places is over ``least``, heaviest first, ties by term."""
        if k <= 0:
            return [[] for _ in texts]
        out: list = [None] * len(texts)
        for rows, logits, mask in self.batches(texts):
            if logits.ndim != 3 or logits.shape[:2] != mask.shape:
                raise ValueError(f"expected [batch, width, vocabulary], got {logits.shape}")
            for i, row, real in zip(rows, logits, mask, strict=True):
                w = np.log1p(np.maximum(row[real > 0], 0)).max(0) if real.any() else np.zeros(logits.shape[2])
                terms = np.flatnonzero(w > least)
                best = terms[np.lexsort((terms, -w[terms]))][:k]
                out[i] = [{"term": int(t), "weight": float(w[t])} for t in best]
        return out

    def dense(self, text: Column) -> Column:
        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([v.tolist() for v in self.vectors([t or "" for t in texts])], dtype=object)

        return encoded(text)

    def pair(self, query: Column, document: Column) -> Column:
        @F.pandas_udf(T.FloatType())
        def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for queries, documents in batches:
                yield pd.Series(self.scores([(q or "", d or "") for q, d in zip(queries, documents, strict=True)]))

        return scored(query, document)

    def sparse(self, text: Column, k: int = 256, least: float = 0.0) -> Column:
        """Array of (term, weight)."""

        @F.pandas_udf(SPARSE)
        def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(self.weights([t or "" for t in texts], k, least), dtype=object)

        return weighed(text)


def pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean over places and unit length, in 32-bit floats; rows without real places are zero."""
    real = mask[..., None].astype(np.float32)
    mean = (hidden.astype(np.float32) * real).sum(1) / np.maximum(real.sum(1), 1)
    size = np.sqrt((mean.astype(np.float64) ** 2).sum(1, keepdims=True))
    return (mean / np.where(size > 0, size, 1)).astype(np.float32)
