"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is read as its lower-cased words, each followed by a space, and one more space at
its end.  Bytes are written in a binary code (Huffman, from the training words), and every
bit is predicted from several hashed contexts: the word so far, and its last three, two and
one bytes.  A context's prediction is the log-odds of the bits counted in its slot; a gate
(the place in the word, and whether the word so far was met in training) selects the
weights that combine the predictions, and within each document all weights, of each gate and predictor, are refined
online by the gradient of that document's own code length: after its first word, and at growing
intervals up to every ``BLOCK`` words.  Words of over ``PIECE`` bits count as several.
The total of the bits' code lengths is the document's cost, and its log10 probability.

Learning is additive and distributed: word counts are gathered from all training documents;
bit counts of the slots follow from the words' counts, so each word is visited once however
often it stands in the corpus; gate weights are fitted by Newton steps on a fold of the
training documents that the slots are not counted from, and then that fold's words are
counted into the slots as well.  Counts are exact 64-bit numbers.  Tables have a fixed size
(``PREDICTORS`` x 2**``TABLE_BITS`` bytes), the only data sent to executors with a list of at most
``KNOWN`` frequent words' counts; counts of all other words are joined by shuffle.

Defined results: null and empty texts are the end token alone; long texts are scored
whole; repeated rows are counted and scored each; a null id counts as the empty text in the
choice of folds; with no training documents every word is unknown and the code is uniform;
an empty table gives an empty table; only the id and the text are read, so other
columns can't clash.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from textloom.llm._text import held_out, space_words, stored

FOLDS, HELD_OUT, CALIBRATION = 7, 2, 5
TABLE_BITS = 22
PREDICTORS = 4
GATES = 8
#: Document classes; class 0 has no characters beyond ASCII.
CLASSES = 16
#: Most pieces between two refinements of a document's weights, a piece's most bits, the step, and the bits that damp it.
BLOCK, PIECE, RATE, DAMPING = 8, 256, 3.0, 300
#: Bits of one gate that are worked on as one, strips at once, and the cost of an even chance.
STRIP, STRIPS, LOG_2 = 4, 1 << 13, float(np.log(np.float32(2)))
#: Words whose bits are looked up at once.
SOME_WORDS = 4_000
#: Words in work at once in a task.
GROUP_WORDS = 120_000
#: Counts of at most so many frequent words are sent to executors (12 bytes each).
KNOWN = 1 << 19
#: Distinct words of one task that counts bits, of which there are as many as the words ask for; their tables are added block by block.
TRAINER_WORDS = 500_000
COUNTER_BLOCK = 1 << 17
NEWTON_STEPS = 3
#: Log-odds are kept in sixteenths.
UNIT = 16.0
SPACE = 32

# ---------------------------------------------------------------- the binary code


@dataclass
class Code:
    """Bits of each byte, most significant branch first, and the inner node that each bit is decided at, one byte's after another."""

    length: np.ndarray
    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    heap = [(int(c) + 1, s, (s,)) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in counts]
    node = 0
    while len(heap) > 1:
        (ca, sa, a), (cb, sb, b) = heapq.heappop(heap), heapq.heappop(heap)
        for side, symbols in ((0, a), (1, b)):
            for s in symbols:
                paths[s].append((node, side))
        node += 1
        heapq.heappush(heap, (ca + cb, min(sa, sb), a + b))
    length = np.array(list(map(len, paths)))
    flat = [step for path in paths for step in reversed(path)]
    return Code(length, np.cumsum(length) - length, np.array([n for n, _ in flat], np.uint32) * np.uint32(0x85EBCA6B), np.array([side for _, side in flat], np.uint8))


def document_class(words: list[bytes]) -> int:
    """Hash of the text's most frequent character that isn't ASCII, 0 without any: tells scripts and languages apart.

    The class is written ahead of the text, at the cost of its share of the training documents.
    """
    raw = b" ".join(words)
    if raw.isascii():
        return 0
    b = np.frombuffer(raw + b"  ", np.uint8)
    lead = np.flatnonzero(b >= 0xC2)
    if not len(lead):
        return 0
    times = np.bincount(b[lead].astype(np.int64) * 256 + b[lead + 1])
    return 1 + int(times.argmax()) * 0x9E3779B1 % (1 << 32) % (CLASSES - 1)


# ---------------------------------------------------------------- contexts of words' bits


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each length, one after another."""
    return np.repeat((starts - (np.cumsum(lengths) - lengths)).astype(np.int32), lengths) + np.arange(int(lengths.sum()), dtype=np.int32)


def word_bits(words: list[bytes], classes: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """Of all bits of the words, one after another: bits in each word, the bit, its gate (place only), slots by predictor."""
    raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.flatnonzero(raw == SPACE)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts + 1
    place = _spans(np.zeros(len(starts), np.int64), sizes).view(np.uint32)
    b = raw.astype(np.uint32) + np.uint32(1)
    last1, last2, last3 = (np.concatenate([np.zeros(k, np.uint32), b[:-k]])[: len(b)] * (place >= k) for k in (1, 2, 3))
    powers = np.cumprod(np.full(int(place.max()) + 1, 0x01000193, np.uint32), dtype=np.uint32)
    total = np.concatenate([np.zeros(1, np.uint32), np.cumsum(b * powers[place], dtype=np.uint32)[:-1]])
    so_far = total - np.repeat(total[starts], sizes)
    of = np.repeat((classes.astype(np.uint32) + np.uint32(1)) * np.uint32(0x68E31DA5), sizes)
    early = np.minimum(place, np.uint32(3))
    contexts = (
        so_far * np.uint32(0x9E3779B1) + place * np.uint32(0x7FEB352D) + of,
        (last1 + last2 * np.uint32(0x1F35) + last3 * np.uint32(0x2C1B3C6D)) * np.uint32(0x297A2D39) + early + of,
        (last1 + last2 * np.uint32(0x3C6EF)) * np.uint32(0xC2B2AE35) + np.minimum(early, np.uint32(2)) * np.uint32(77),
        last1 * np.uint32(0x165667B1) + np.minimum(place, np.uint32(7)) * np.uint32(0x27D4EB2F) + of,
    )
    n = code.length[raw]
    steps = _spans(code.start[raw], n)
    node, bit = code.node[steps], code.bit[steps]

    def slots() -> Iterator[np.ndarray]:
        for c in contexts:
            x = np.repeat(c, n)
            x += node
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            x >>= np.uint32(32 - TABLE_BITS)
            yield x

    return np.add.reduceat(n, starts), bit, np.repeat(early.astype(np.uint8), n), slots()


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Of (zeros, ones) in each slot, in units of 1/UNIT; -128 marks a slot never met."""
    zeros, ones = counts[0::2].astype(np.float64), counts[1::2].astype(np.float64)
    out = np.clip(np.round(np.log((ones + 0.2) / (zeros + 0.2)) * UNIT), -127, 127).astype(np.int8)
    out[(zeros + ones) == 0] = -128
    return out


@dataclass
class Model:
    code: Code
    #: log-odds by predictor and slot; -128 in the first one's slots never met
    tables: list[np.ndarray]
    #: weights by gate and predictor
    weights: np.ndarray
    #: share of training documents by class
    shares: np.ndarray

    def inputs(self, words: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Bits in each word, each bit as -1 or 1 (int8), its gate, and each predictor's log-odds in units (int8)."""
        n, bit, gate, slots = word_bits(words, classes, self.code)
        x = [table[s] for table, s in zip(self.tables, slots, strict=True)]
        new = x[0] == -128
        gate += new.view(np.uint8) << np.uint8(2)
        x[0] *= ~new
        return n, bit.view(np.int8) * np.int8(2) - np.int8(1), gate, x


# ---------------------------------------------------------------- scoring a group of documents


def in_groups(texts: pa.Array) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Places and words of about GROUP_WORDS words at once, of texts of about one length: few steps of refinement have few documents left."""
    order = np.argsort(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), kind="stable").tolist()
    taken, group, size = [], [], 0
    for k in order:
        taken.append(k)
        group.append(space_words(texts[k].as_py()))
        size += len(group[-1]) + 1
        if size >= GROUP_WORDS:
            yield taken, group
            taken, group, size = [], [], 0
    if taken:
        yield taken, group


@dataclass
class Numbered:
    """A group of documents with its words numbered: distinct words of a class, one class after another; numbers of all documents' words, each one's end last."""

    kinds: np.ndarray
    sizes: np.ndarray
    numbers: np.ndarray
    array: pa.Array
    words: list[bytes]
    classes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def numbered(docs: list[list[bytes]]) -> Numbered:
    kinds = np.array([document_class(words) for words in docs])
    sizes = np.array([len(words) + 1 for words in docs])
    there, of = np.unique(kinds, return_inverse=True)
    coded = pa.array([w for words in docs for w in (*words, b"")], pa.binary()).dictionary_encode()
    distinct = len(coded.dictionary)
    key = np.repeat(of * distinct, sizes) + coded.indices.to_numpy()
    met = np.zeros(len(there) * distinct, bool)
    met[key] = True
    pairs = np.flatnonzero(met)
    array = coded.dictionary.take(pa.array(pairs % distinct))
    # words hold no space
    words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array), b" ")[0].as_py().split(b" ")
    return Numbered(kinds, sizes, np.cumsum(met, dtype=np.int32)[key] - 1, array, words, there[pairs // distinct])


@dataclass
class Strips:
    """Words' bits in strips: bits of one gate that stand together, STRIP at most, the last one of them filled up with zeros.

    A strip has one set of weights, and the bits of many strips are summed by adding whole arrays.
    """

    #: by strip, place in it and predictor: log-odds of the bit that isn't there
    odds: np.ndarray
    gate: np.ndarray
    bits: np.ndarray
    #: pieces of each word, and each piece's bits and strips
    pieces: np.ndarray
    piece_bits: np.ndarray
    piece_strips: np.ndarray


def in_strips(model: Model, words: list[bytes], classes: np.ndarray) -> Strips:
    n, sign, gate, x = model.inputs(words, classes)
    # words are cut into pieces, those into runs of bits with one gate, and those into strips
    pieces = -(-n // PIECE)
    piece_at = np.repeat(np.cumsum(n) - n, pieces) + _spans(np.zeros(len(n), np.int64), pieces).astype(np.int64) * PIECE
    starts = np.ones(len(gate), bool)
    starts[1:] = gate[1:] != gate[:-1]
    starts[piece_at] = True
    run_at = np.flatnonzero(starts)
    run_bits = np.diff(np.append(run_at, len(sign)))
    strips = -(-run_bits // STRIP)
    end = np.cumsum(strips)
    bits = np.full(end[-1], STRIP, np.int8)
    bits[end - 1] = run_bits - (strips - 1) * STRIP
    first = (end - strips)[np.searchsorted(run_at, piece_at)]
    odds = np.zeros((end[-1] * STRIP, PREDICTORS), np.int8)
    sign = -sign
    odds.view(np.int32)[_spans((end - strips) * STRIP, run_bits), 0] = np.stack([v * sign for v in x], 1).view(np.int32).ravel()
    return Strips(odds.reshape(-1, STRIP * PREDICTORS), np.repeat(gate[run_at], strips), bits, pieces, np.diff(np.append(piece_at, len(sign))), np.diff(np.append(first, end[-1])))


def code_lengths(model: Model, docs: list[list[bytes]] | Numbered) -> np.ndarray:
    """Natural-log cost of each document, given its words; weights adapt within each document."""
    group = docs if isinstance(docs, Numbered) else numbered(docs)
    parts = [in_strips(model, group.words[k : k + SOME_WORDS], group.classes[k : k + SOME_WORDS]) for k in range(0, len(group.words), SOME_WORDS)]
    odds = np.concatenate([p.odds for p in parts]).view(np.complex128).ravel()
    strip_gate, strip_bits, per_word, piece_bits, strips = (np.concatenate([getattr(p, name) for p in parts]) for name in ("gate", "bits", "pieces", "piece_bits", "piece_strips"))
    first_strip, first_piece = np.cumsum(strips) - strips, np.cumsum(per_word) - per_word
    # pieces in order of step and document (longest first)
    per_token = per_word[group.numbers]
    pieces = _spans(first_piece[group.numbers], per_token)
    lengths = np.add.reduceat(per_token, group.starts)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    doc, place = np.repeat(rank, lengths), _spans(np.zeros(len(lengths), np.int64), lengths)
    lengths = lengths[order]
    borders = [0]
    while borders[-1] < lengths[0]:
        borders.append(borders[-1] + min(max(borders[-1], 1), BLOCK))
    step = np.repeat(np.arange(len(borders) - 1), np.diff(borders))[place]
    in_order = np.lexsort((doc, step))
    begin = np.searchsorted(step[in_order], np.arange(len(borders)))
    pieces, doc = pieces[in_order], doc[in_order]
    # weights by predictor, and by document and gate
    weights = np.tile(model.weights.T / UNIT, len(lengths))
    # a zero that fills a strip up costs log 2
    cost = -LOG_2 * np.bincount(doc, strips[pieces] * STRIP - piece_bits[pieces], len(lengths))
    for t, a, b in zip(borders, begin, begin[1:]):
        active = int(np.searchsorted(-lengths, -t))
        count = strips[pieces[a:b]]
        at = _spans(first_strip[pieces[a:b]], count)
        of = np.repeat(doc[a:b], count)
        cell = of.astype(np.int64) * GATES + strip_gate[at]
        now = weights[:, : active * GATES].astype(np.float32)
        logs, slope = np.empty(len(at), np.float32), np.empty((PREDICTORS, len(at)), np.float32)
        for k in range(0, len(at), STRIPS):
            y = odds[at[k : k + STRIPS]].view(np.int8).reshape(-1, STRIP * PREDICTORS).T.astype(np.float32, order="C").reshape(STRIP, PREDICTORS, -1)
            w = now.take(cell[k : k + STRIPS], 1)
            e = y[:, 0] * w[0]
            for p in range(1, PREDICTORS):
                e += y[:, p] * w[p]
            np.exp(np.clip(e, -30, 30, out=e), out=e)
            e += 1
            np.log(e).sum(0, out=logs[k : k + STRIPS])
            y *= (1 - 1 / e)[:, None]
            y.sum(0, out=slope[:, k : k + STRIPS])
        cost[:active] += np.bincount(of, logs, active)
        met = np.bincount(cell, strip_bits[at], active * GATES) + DAMPING
        for p in range(PREDICTORS):
            weights[p, : active * GATES] -= RATE / UNIT**2 * np.bincount(cell, slope[p], active * GATES) / met
    out = -np.log(model.shares[group.kinds])
    out[order] += cost
    return out


# ---------------------------------------------------------------- learning


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, n, m): its count in training documents of the class, and in those that slots are counted from while weights are fitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, bool], Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (kind, apart), c in counts.items():
                n = pa.array(c.values(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array([kind] * len(c), pa.int32()), n, n if not apart else pa.array([0] * len(c), pa.int64())], names=["word", "class", "n", "m"])
            counts.clear()

        for batch in batches:
            for text, apart in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = space_words(text.as_py())
                counts.setdefault((document_class(words), apart), Counter()).update([*words, b""])
            if sum(map(len, counts.values())) > 300_000:
                yield from rows()
        yield from rows()

    fold = docs.where(~held_out(F.col("id"), FOLDS, HELD_OUT)).select("text", held_out(F.col("id"), FOLDS, CALIBRATION).alias("apart"))
    counted = fold.mapInArrow(run, "word binary, class int, n long, m long")
    return counted.groupBy("word", "class").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _some(batch: pa.RecordBatch, most: int = 20_000) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Words, classes and weights of a batch, up to ``most`` at once, those of no weight left out."""
    weights = batch.column(2).to_numpy(zero_copy_only=False)
    there = weights > 0
    words, classes, weights = batch.column(0).filter(pa.array(there)).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)[there], weights[there]
    for at in range(0, len(words), most):
        yield words[at : at + most], classes[at : at + most], weights[at : at + most]


def _code(words: DataFrame) -> Code:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for batch in batches:
            for w, _, times in _some(batch):
                raw = np.frombuffer(b" ".join(w) + b" ", np.uint8)
                ends = np.flatnonzero(raw == SPACE)
                total += np.bincount(raw, np.repeat(times, np.diff(np.concatenate([[-1], ends]))), 256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    rows = words.select("word", "class", "n").mapInArrow(run, "byte long, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(256)
    for r in rows:
        counts[r["byte"]] = r["n"]
    return huffman(counts)


def _shares(words: DataFrame) -> np.ndarray:
    """Each document has one end token, so that the end's counts by class are the documents'."""
    shares = np.ones(CLASSES)
    for r in words.where(F.octet_length("word") == 0).select("class", "n").collect():
        shares[r["class"]] += r["n"]
    return shares / shares.sum()


def _counters(words: DataFrame, code: Code) -> DataFrame:
    """(at, counts): parts of the slots' counters of zeros and ones, each word (word, class, times) counted as often as it stands."""
    size = 1 << (TABLE_BITS + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(size, np.uint64) for _ in range(PREDICTORS)]
        for batch in batches:
            for w, c, m in _some(batch):
                n, bit, _, slots = word_bits(w, c, code)
                times = np.repeat(m.astype(np.uint64), n)
                for table, s in zip(tables, slots, strict=True):
                    np.add.at(table, s.astype(np.int64) * 2 + bit, times)
        for k, table in enumerate(tables):
            for at in range(0, size, COUNTER_BLOCK):
                if table[at : at + COUNTER_BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([k * size + at], pa.int64()), pa.array([zlib.compress(table[at : at + COUNTER_BLOCK].tobytes(), 1)], pa.binary())], names=["at", "counts"])

    rows = words.where("times > 0").select("word", "class", "times")
    trainers = max(1, -(-rows.count() // TRAINER_WORDS))
    # tasks of many rows each, as every one of them gives a table
    return rows.coalesce(trainers).mapInArrow(count, "at long, counts binary")


def _added(parts: DataFrame) -> DataFrame:
    """The counters' sums, a row for each part of the tables, stored: a fixed size, whatever the corpus."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTER_BLOCK, np.uint64)
        for batch in batches:
            for c in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(c.as_py()), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["at", "counts"])

    return stored(parts.groupBy("at").applyInArrow(add, "at long, counts binary"))


def _tables(counters: DataFrame) -> list[np.ndarray]:
    """Log-odds by predictor and slot."""
    size = 1 << (TABLE_BITS + 1)

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [log_odds(np.frombuffer(zlib.decompress(c.as_py()), np.uint64)).tobytes() for c in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(out, pa.binary())], names=["at", "odds"])

    out = [np.full(size // 2, -128, np.int8) for _ in range(PREDICTORS)]
    # fixed size: PREDICTORS x 2**TABLE_BITS bytes in all
    for r in counters.mapInArrow(odds, "at long, odds binary").toLocalIterator():
        k, at = divmod(r["at"], size)
        out[k][at // 2 : at // 2 + COUNTER_BLOCK // 2] = np.frombuffer(r["odds"], np.int8)
    # slots never met are told apart for the first predictor, which opens the gate
    return [out[0], *(np.where(t == -128, 0, t).astype(np.int8) for t in out[1:])]


def newton_sums(model: Model, weights: np.ndarray, words: list[bytes], classes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """By gate: gradient and Hessian of the code length of words that stand ``times`` over."""
    n, sign, gate, x = model.inputs(words, classes)
    x = np.stack(x).astype(np.float64) / UNIT
    p = 1 / (1 + np.exp(-np.clip((x * weights.T[:, gate]).sum(0), -30, 30)))
    times = np.repeat(times, n).astype(float)
    error, curve = times * ((sign > 0) - p), times * p * (1 - p)
    out = [np.bincount(gate, x[k] * error, GATES) for k in range(PREDICTORS)]
    half = {(k, j): np.bincount(gate, x[k] * x[j] * curve, GATES) for k in range(PREDICTORS) for j in range(k + 1)}
    out += [half[max(k, j), min(k, j)] for k in range(PREDICTORS) for j in range(PREDICTORS)]
    return np.stack(out, 1)


def newton_step(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    out = weights.copy()
    for g in range(GATES):
        hessian = sums[g, PREDICTORS:].reshape(PREDICTORS, PREDICTORS) + np.eye(PREDICTORS) * 10.0
        out[g] += np.clip(np.linalg.solve(hessian, sums[g, :PREDICTORS] - 10.0 * (out[g] - 0.3)), -0.5, 0.5)
    return np.clip(out, -0.5, 1.5)


def _fit_weights(words: DataFrame, shared) -> np.ndarray:
    """Newton steps for each gate's weights on the calibration fold's words."""
    weights = np.full((GATES, PREDICTORS), 0.3)
    cells = PREDICTORS + PREDICTORS * PREDICTORS
    for _ in range(NEWTON_STEPS):
        now = weights.copy()

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((GATES, cells))
            for batch in batches:
                for w, c, times in _some(batch, 5_000):
                    total += newton_sums(shared.value, now, w, c, times)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES * cells)), pa.array(total.ravel())], names=["cell", "v"])

        rows = words.select("word", "class", (F.col("n") - F.col("m")).alias("c")).where("c > 0").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        sums = np.zeros(GATES * cells)
        for r in rows:
            sums[r["cell"]] = r["v"]
        weights = newton_step(weights, sums.reshape(GATES, cells))
    return weights


def learned(words: DataFrame) -> Model:
    """The model of ``_word_counts``: weights from the calibration fold, then slots of all training documents."""
    code = _code(words)
    once = _added(_counters(words.select("word", "class", F.col("m").alias("times")), code))
    apart = Model(code, _tables(once), np.full((GATES, PREDICTORS), 0.3), _shares(words))
    shared = words.sparkSession.sparkContext.broadcast(apart)
    weights = _fit_weights(words, shared)
    shared.unpersist()
    # the calibration fold's words alone are left to count
    rest = _counters(words.select("word", "class", (F.col("n") - F.col("m")).alias("times")), code)
    return Model(code, _tables(_added(once.union(rest))), weights, apart.shares)


def word_hash(word: bytes) -> int:
    """Signed 64-bit hash, as Spark's and Arrow's longs are."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _frequent(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (sorted) and counts of the words with at least so many counts, the least number that leaves at most ``most`` words."""
    by_count = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n"))
    least, total = None, 0
    for r in by_count.toLocalIterator():
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in b.column(0).to_pylist()], pa.int64()), b.column(1)], names=["h", "n"])

    got = words.where(F.col("n") >= least).select("word", "n").mapInArrow(hashed, "h long, n long").toArrow()
    h, n = got["h"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order], least


# ---------------------------------------------------------------- the operator


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, total_bits, n_bytes, bits_per_byte.

    base_score and score are log10; total_bits is the code length of the n_bytes bytes of words and spaces.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    by_class = stored(_word_counts(docs))
    words = stored(by_class.groupBy("word").agg(F.sum("n").alias("n")))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, vocabulary = int(totals[0]), int(totals[1])
    shared = spark.sparkContext.broadcast((learned(by_class), _frequent(words, KNOWN)[:2]))
    unit = float(np.log10(tokens + vocabulary + 1)) if tokens else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        model, (hashes, counts) = shared.value
        for batch in batches:
            for taken, group in in_groups(batch.column(1)):
                yield _scored(model, hashes, counts, batch.column(0).take(pa.array(taken)), group, row)
                row += len(group)

    kind = docs.schema["id"].dataType.simpleString()
    scored = stored(docs.mapInArrow(run, f"id {kind}, row long, n_tokens long, n_bytes long, known long, logs double, cost double, rare array<binary>"))
    rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    met = rare.join(words.select("word", "n"), "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"))
    out = scored.drop("rare").join(met, "row", "left")
    bits = F.col("cost") / float(np.log(2))
    return out.select(
        F.col("id").alias(id_col),
        held_out(F.col("id"), FOLDS, HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * unit).alias("base_score"),
        (-F.col("cost") / float(np.log(10))).alias("score"),
        bits.alias("total_bits"), "n_bytes", (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _scored(model: Model, hashes: np.ndarray, counts: np.ndarray, ids: pa.Array, group: list[list[bytes]], row: int) -> pa.RecordBatch:
    numbers = numbered(group)
    h = np.fromiter(map(xxhash.xxh64_intdigest, numbers.words), np.uint64, len(numbers.words)).view(np.int64)
    at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
    found = (hashes[at] == h) if len(hashes) else np.zeros(len(h), bool)
    logs = np.where(found, np.log10(counts[at] + 1.0) if len(counts) else 0.0, 0.0)
    met = found[numbers.numbers]
    known = np.add.reduceat(met, numbers.starts, dtype=np.int64)
    rare = numbers.array.take(pa.array(numbers.numbers[~met]))
    ends = np.concatenate([[0], np.cumsum(numbers.sizes - known)]).astype(np.int32)
    names = ["id", "row", "n_tokens", "n_bytes", "known", "logs", "cost", "rare"]
    return pa.RecordBatch.from_arrays([
        ids, pa.array(range(row, row + len(group)), pa.int64()), pa.array(numbers.sizes),
        pa.array([sum(map(len, w)) + len(w) + 1 for w in group], pa.int64()), pa.array(known), pa.array(np.add.reduceat(logs[numbers.numbers], numbers.starts)),
        pa.array(code_lengths(model, numbers)), pa.ListArray.from_arrays(pa.array(ends), rare),
    ], names=names)
