from bisect import bisect_left
from collections import Counter
from hashlib import sha256
from itertools import accumulate

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from textloom.llm import token_alignment as t
from textloom.llm.byte_bpe import byte_characters

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a  b\n\nc", "x\ny", "x \ny", "\nx", "x\n", "naïve 😀😀 日本語 it's", "a\tb\x0bc d", "<|endoftext|> <s> </s> <unk> <0x0A> ▁", "▁▁a", "a▁b", "ﬁ Å é́", "e\x00f",
    "word " * 300, "x" * 3000, "a b　c  d", "\x1c a \x1c b", "Étion dans, çouelle\nun éonierç | le", "the the the", "the the the", "12 345,67", "\r\nq\r\n", " \n \n", "tab\t tab", "a \n\tb",
]


def whole(texts):
    """The contract by definition: whole texts encoded, groups by common ends, counts over all documents."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    of = {c: k for k, c in byte_characters().items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for text in texts:
        if not text:
            docs.append([])
            continue
        raw, x, y = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False), b.encode(text)
        xs, ys = [bytes(of[c] for c in s) for s in x.tokens], list(map(piece, y))
        if b"".join(xs) != raw or b"".join(ys) != raw:
            docs.append([])
            continue
        ends = [list(accumulate(map(len, side))) for side in (xs, ys)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, sides = [([], []) for _ in cuts], (x.ids, y)
        for side in (0, 1):
            for i, e in zip(sides[side], ends[side], strict=True):
                groups[bisect_left(cuts, e)][side].append(i)
        docs.append(groups)
    held = Counter(p for d in docs for p in {(i, j) for x, y in d for i in x for j in y})
    best = Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for d in docs:
        every = [(i, j) for x, y in d for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d)
        out.append((sum(len(x) for x, _ in d), sum(len(y) for _, y in d), len(d), len(every), sum(held[p] == best[p[0]] for p in every), sum(held[p] for p in every), sha256(text.encode()).hexdigest() if d else ""))
    return out, held, best


@pytest.fixture(scope="module")
def texts(spark, small):
    return ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]


def check(spark, texts, docs):
    found = {r[0]: tuple(r[1:]) for r in t.align(docs, BYTE, PIECE).collect()}
    expected = whole(texts)[0]
    assert found == dict(enumerate(expected))


def test_equal_to_the_definition(spark, texts):
    docs = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(texts)], "doc_id long, text string, batch string, n int").repartition(3)
    check(spark, texts, docs)


def test_small_batches_stripes_and_tasks(spark, texts, monkeypatch):
    for name, value in (("BATCH_SEGMENTS", 500), ("REMEMBERED", 50), ("STRIPE_CELLS", 1 << 20), ("FAN_IN", 2), ("SLICE", 300), ("CALL_CHARACTERS", 40)):
        monkeypatch.setattr(t, name, value)
    some = texts[: len(ODD) + 60]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").coalesce(2)
    v = t.load(BYTE, PIECE)
    for text in some:
        if text:
            a = t.Aligner(v)
            numbers = a.numbers(text)
            a.learn()
            whole_keys = list(a.of_segment)
            assert "".join(k if k[0] in " \n" else " " + k for k in map(whole_keys.__getitem__, numbers)) == " " + text
    check(spark, some, docs)


def test_pairs_of_the_corpus(spark):
    texts = ["the cat", "the dog", "the the", None, "naïve"]
    held, best = whole(texts)[1:]
    rows = t.links(spark.createDataFrame([(x,) for x in texts], "text string"), BYTE, PIECE).collect()
    assert {(r.a_id, r.b_id): (r.documents, r.best) for r in rows} == {p: (n, n == best[p[0]]) for p, n in held.items()}


def test_empty_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id int, text string")
    rows = sorted(map(tuple, t.align(docs, BYTE, PIECE).collect()), key=str)
    expected = whole(["a b", "a b", "a b", None])[0]
    assert rows == sorted([(i, *e) for i, e in zip((None, 1, 1, 2), expected, strict=True)], key=str)
    none = t.align(docs.limit(0), BYTE, PIECE)
    assert none.count() == 0 and none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_a_long_text_without_a_cut(spark):
    texts = ["ab" * 60_000, "word " * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in t.align(docs, BYTE, PIECE).collect()}
    a = Tokenizer.from_file(BYTE)
    assert [rows[i].n_a for i in (0, 1)] == [len(a.encode(" " + x, add_special_tokens=False).ids) for x in texts]


def test_cells_are_added_from_many_batches(spark):
    rows = [(s, k, 2, t._packed(np.array([5, 40_000]), "<u4"), t._packed(np.array([k, 1]), "<u4")) for s in (0, 3) for k in range(700)]
    got = t.pair_counts(spark.createDataFrame(rows, "stripe int, batch long, n long, x binary, y binary"), BYTE, PIECE).collect()
    assert sorted((r.stripe, r.row, r.best) for r in got) == sorted((s, row, n) for s in (0, 3) for row, n in ((0, sum(range(700))), (1, 700)))
