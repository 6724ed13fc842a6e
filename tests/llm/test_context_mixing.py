import collections
import math
import zlib

import numpy as np
import pytest

from textloom.llm import context_mixing as c
from textloom.llm._text import space_words


def test_code_is_prefix_free():
    code = c.huffman(np.arange(256) % 7 * 100)
    words = ["".join(map(str, code.bit[s : s + n])) for s, n in zip(code.start, code.length, strict=True)]
    assert sum(2.0 ** -len(w) for w in words) == 1 and len(set(words)) == 256


def model(words=(), seed=0):
    code = c.huffman(np.bincount(np.frombuffer(b" ".join(words) + b" ", np.uint8), minlength=256))
    rng = np.random.default_rng(seed)
    tables = [rng.integers(-127, 127, 1 << c.TABLE_BITS).astype(np.int8) for _ in range(c.PREDICTORS)]
    return c.Model(code, tables, rng.normal(0.3, 0.2, (c.GATES, c.PREDICTORS)), np.full(c.CLASSES, 1 / c.CLASSES))


def test_probabilities_of_all_continuations_sum_to_one():
    m = model([b"hello"])
    total = 0.0
    for b in range(256):
        n, sign, gate, x = m.inputs([b"ab" + bytes([b])] if b != c.SPACE else [b"ab"], np.zeros(1, int))
        z = (np.stack(x, 1) / c.UNIT * m.weights[gate]).sum(1) * sign
        at = int(m.code.length[97] + m.code.length[98])
        total += math.exp(-np.log1p(np.exp(-z[at : at + m.code.length[b]])).sum())
    assert total == pytest.approx(1, abs=1e-6)


def test_groups_do_not_change_a_document(monkeypatch):
    m = model([b"a"])
    docs = [[b"w%d" % (i * k % 37) for i in range(k * 40)] for k in range(6)] + [[], [b"\xc3\xa9"] * 90]
    together = c.code_lengths(m, docs)
    assert np.allclose(together, [c.code_lengths(m, [d])[0] for d in docs], rtol=1e-4)


@pytest.fixture(scope="module")
def scored(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (None, "the the"), (7, "repeated id"), (9003, "x" * 30_000), (9004, "ab " * 30_000)], "doc_id long, text string")
    both = docs.union(extra).selectExpr("*", "'clash' AS score")
    return both.toPandas(), c.scores(both).toPandas()


def test_base_equals_brute_force(scored):
    docs, out = scored
    fold = lambda i: zlib.crc32((str(int(i)) if i == i else "").encode()) % 7
    counts = collections.Counter()
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        if fold(i) != 2:
            counts.update([*space_words(t), b""])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        w = [*space_words(t), b""]
        want[(int(i) if i == i else None, fold(i) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4))] += 1
    got = collections.Counter((int(r.doc_id) if r.doc_id == r.doc_id else None, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out.itertuples())
    assert got == want


def test_rare_words_by_join_give_the_same(scored, monkeypatch, spark):
    docs, out = scored
    monkeypatch.setattr(c, "KNOWN", 50)
    again = c.scores(spark.createDataFrame(docs[["doc_id", "text"]].astype({"doc_id": "Int64"}).astype(object).where(docs[["doc_id", "text"]].notna(), None), "doc_id long, text string")).toPandas()
    assert np.allclose(sorted(again["base_score"]), sorted(out["base_score"]))


def test_scores_are_finite_and_better_than_a_uniform_code(scored):
    _, out = scored
    assert np.isfinite(out["score"]).all() and (out["score"] < 0).all()
    held = out[out["held_out"]]
    assert held["total_bits"].sum() < 4 * held["n_bytes"].sum()
    assert np.allclose(out["score"], -out["total_bits"] * math.log10(2))


def test_empty_table(spark):
    assert c.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_counts_are_whole(spark):
    """No count is cut or wraps, and in the end the calibration fold's words are counted too."""
    rows = [(b"a", 0, 5 << 32, 5 << 32), (b"b", 0, 5 << 30, 5 << 30), (b"calibration", 0, 9, 0), (b"", 0, 100, 90)]
    words = spark.createDataFrame(rows, "word binary, class int, n long, m long")
    m = c.learned(words)
    n, bit, _, slots = c.word_bits([b"a", b"b", b"calibration"], np.zeros(3, int), m.code)
    x = [t[s] for t, s in zip(m.tables, slots, strict=True)]
    apart = next(k for k in range(n[1]) if bit[k] != bit[n[0] + k])
    assert abs(int(x[0][apart])) == round(math.log(4) * c.UNIT)
    assert (x[0][n[0] + n[1] :] != -128).all()


@pytest.mark.parametrize("doc", [[b"short"], [b"w%d" % (i * i % 7) for i in range(20)], [b"y" * 300, b"the", b"the", b"z" * 90], [b"w%d" % (i % 23) for i in range(150)]])
def test_all_weights_are_refined_from_the_start(doc):
    """Bit by bit: every predictor's weight of every gate, after the first piece, then at intervals of at most eight."""
    m = model([b"the"])
    n, sign, gate, x = m.inputs([*doc, b""], np.zeros(len(doc) + 1, int))
    x = np.stack(x, 1).astype(float) / c.UNIT
    pieces, at = [], 0
    for size in n:
        pieces += [(at + k, at + min(k + c.PIECE, size)) for k in range(0, size, c.PIECE)]
        at += size
    weights, total, t = m.weights.copy(), math.log(c.CLASSES), 0
    while t < len(pieces):
        until = t + min(max(t, 1), c.BLOCK)
        gradient, met = np.zeros_like(weights), np.zeros(c.GATES)
        for a, b in pieces[t:until]:
            for i in range(a, b):
                z = min(30, max(-30, sign[i] * (weights[gate[i]] @ x[i])))
                total += math.log1p(math.exp(-z))
                gradient[gate[i]] += sign[i] * x[i] * (1 - 1 / (1 + math.exp(-z)))
                met[gate[i]] += 1
        weights += c.RATE * gradient / (met + c.DAMPING)[:, None]
        t = until
    assert c.BLOCK <= 8 and c.code_lengths(m, [doc])[0] == pytest.approx(total, rel=1e-4)


def test_texts_of_one_length_are_scored_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(c, "GROUP_WORDS", 60)
    texts = [None if k == 7 else " ".join(["wörd"] * (k * 37 % 50)) for k in range(50)]
    groups = list(c.in_groups(pa.array(texts)))
    assert sorted(k for taken, _ in groups for k in taken) == list(range(50))
    assert all(words == space_words(texts[k]) for taken, group in groups for k, words in zip(taken, group, strict=True))
    lengths = [sorted(map(len, group)) for _, group in groups]
    assert all(a[-1] <= b[0] for a, b in zip(lengths, lengths[1:])) and all(sum(x) - x[-1] < 60 for x in lengths)
    assert not list(c.in_groups(pa.array([], pa.string())))


def test_strips_hold_each_bit_once():
    """Strips are at most STRIP bits of one gate and one piece, filled up with zeros; read in order, they are the words' bits."""
    m = model([b"the"])
    m.tables[0][::3] = -128
    words = [b"the", b"", b"w\xc3\xb6rd", b"y" * 300, b"a", b"zz" * 70]
    classes = np.arange(len(words)) % 3
    s = c.in_strips(m, words, classes)
    n, sign, gate, x = m.inputs(words, classes)
    want = np.stack(x, 1) * -sign[:, None]
    assert s.pieces.tolist() == [-(-k // c.PIECE) for k in n] and len(s.odds) == len(s.gate) == len(s.bits) == s.piece_strips.sum()
    assert s.piece_bits.sum() == s.bits.sum() == len(sign) and s.bits.min() >= 1 and s.bits.max() <= c.STRIP and s.piece_bits.max() <= c.PIECE
    odds = s.odds.reshape(-1, c.STRIP, c.PREDICTORS)
    there = np.arange(c.STRIP) < s.bits[:, None]
    assert (odds[there] == want).all() and not odds[~there].any()
    assert (np.repeat(s.gate, s.bits) == gate).all()
    at = np.cumsum(s.piece_strips) - s.piece_strips
    assert (np.add.reduceat(s.bits.astype(int), at) == s.piece_bits).all()


def test_words_are_numbered_by_class():
    docs = [[b"b", b"a", b"b"], [], ["é".encode(), b"a"], [b"a"]]
    g = c.numbered(docs)
    kinds = [c.document_class(d) for d in docs]
    assert g.kinds.tolist() == kinds and kinds[2] > 0 and g.sizes.tolist() == [4, 1, 3, 2]
    assert [(g.words[i], g.classes[i]) for i in g.numbers] == [(w, k) for d, k in zip(docs, kinds) for w in (*d, b"")]
    assert len(g.words) == len(set(zip(g.words, g.classes))) == 6 and g.array.to_pylist() == g.words and (np.diff(g.classes) >= 0).all()


def test_class_is_the_commonest_character():
    for text in ("", "plain", "añb ñ é", "日本日 本日", "é ñ", "😀 é 😀"):
        pairs = collections.Counter(ch.encode()[:2] for ch in text if ord(ch) > 127)
        best = min(pairs, key=lambda p: (-pairs[p], p)) if pairs else None
        assert c.document_class(space_words(text)) == (1 + int.from_bytes(best, "big") * 0x9E3779B1 % (1 << 32) % (c.CLASSES - 1) if best else 0)


def test_newton_sums_are_those_of_each_bit():
    """Gradient and Hessian bit by bit; gates without any bit sum to zero."""
    m = model([b"the"])
    words, classes, times = [b"the", b"", b"w%d" % 7, b"zz" * 9], np.array([0, 1, 0, 2]), np.array([5, 1, 3, 2])
    n, sign, gate, x = m.inputs(words, classes)
    x = np.stack(x, 1).astype(float) / c.UNIT
    want = np.zeros((c.GATES, c.PREDICTORS + c.PREDICTORS**2))
    for i, often in enumerate(np.repeat(times, n)):
        p = 1 / (1 + math.exp(-min(30, max(-30, float(m.weights[gate[i]] @ x[i])))))
        want[gate[i], : c.PREDICTORS] += often * ((sign[i] > 0) - p) * x[i]
        want[gate[i], c.PREDICTORS :] += (often * p * (1 - p) * np.outer(x[i], x[i])).ravel()
    got = c.newton_sums(m, m.weights, words, classes, times)
    assert np.allclose(got, want) and not got[4:].any()
