import base64

import public_tokenizers as P
import pytest
import tiktoken

from textloom.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "a", "  a  b\n\n c", "naïve 😀😀  日本語 ''s 'S  x\x00y", "it's we'LL  \t\n end  ", "a b　c  d", "٣٤x½²", "<|endoftext|> here", "x" * 3000, "é‍👨‍👩‍👧", "﻿\u0085 z",
]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})



def test_ids_equal_the_rank_encoder(reference):
    bpe = byte_bpe.load(PATH, P.PATTERN)
    for text, ids in zip(TEXTS, bpe.encode(TEXTS), strict=True):
        assert ids == reference.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_a_pattern_that_is_not_built_in_gives_its_own_matches():
    bpe = byte_bpe.ByteBpe(PATH, r"[a-z]+")
    assert bpe.decode(bpe.encode(["ab 12 cd"])[0]) == b"abcd"


def test_offsets_and_split_characters():
    bpe = byte_bpe.load(PATH, P.PATTERN)
    text = "é😀 日x"
    ids = bpe.encode([text])[0]
    starts, chars = bpe.offsets(text, ids)
    raw = text.encode()
    for i, (b, c) in enumerate(zip(starts, chars, strict=True)):
        assert raw[b : b + len(bpe.tokens[ids[i]])] == bpe.tokens[ids[i]]
        assert len(raw[: b + 1].decode("utf-8", "ignore")) in (c, c + 1)


def test_tables(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(99, None, "clash"), (None, "a", "clash"), (1, " ", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    encoded = byte_bpe.encode(docs, PATH, P.PATTERN, offsets=True)
    assert encoded.where("doc_id = 99").first()["ids"] == []
    back = {r["doc_id"]: r for r in byte_bpe.decode(encoded, PATH, P.PATTERN).collect()}
    assert all(back[i]["text"] == t and bytes(back[i]["bytes"]) == t.encode() for i, t in enumerate(TEXTS))
    digests = byte_bpe.round_trip(docs, PATH, P.PATTERN)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert digests.count() == len(rows)
    assert byte_bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_ids_that_are_not_there(spark):
    odd = spark.createDataFrame([(1, [10**6, -1, 64]), (2, None)], "doc_id long, ids array<int>")
    assert [r["text"] for r in byte_bpe.decode(odd, PATH, P.PATTERN).orderBy("doc_id").collect()] == ["a", ""]


def test_slices_hold_a_few_texts_at_once():
    import tracemalloc

    import pyarrow as pa

    from textloom.llm import byte_bpe

    texts = pa.array(["", None, *(f"{k} " * 500 for k in range(10_000, 14_000))])
    tracemalloc.start()
    seen = [(a, len(part), part[0]) for a, part in byte_bpe._slices(texts, 30_000)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen[0][::2] == (0, "") and sum(n for _, n, _ in seen) == 4_002
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(seen, seen[1:]))
    # all texts are 12 MB
    assert peak < 4_000_000


def test_runs_are_encoded_once_and_as_inside_their_texts(reference, monkeypatch):
    import random

    monkeypatch.setattr(byte_bpe, "CACHE", 40)
    r = random.Random(4)
    signs = ["a", "Ab", "é", "日本", "7", "²", "'s", "'", "!?", "😀", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u200b", "\u180e", "\u3000", "\ufeff", "\x00"]
    texts = [*TEXTS, *("".join(r.choices(signs, k=r.randrange(12))) for _ in range(3_000)), *(" ".join(r.choices(signs[:10], k=9)) for _ in range(300))]
    bpe, asked = byte_bpe.ByteBpe(PATH, P.PATTERN), []
    encode = bpe.encode
    monkeypatch.setattr(bpe, "encode", lambda texts: asked.extend(texts) or encode(texts))
    for k in range(0, len(texts), 60):
        ids, at = bpe.joined(texts[k : k + 60])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [reference.encode_ordinary(t) for t in texts[k : k + 60]]
        assert [bytes(x) for x in bpe.decoded(ids, at)] == [t.encode() for t in texts[k : k + 60]]
    assert len(bpe.met) == 40
    asked.clear()
    bpe.met.clear()
    bpe.joined([" one two two one" * 1_000, " two one"])
    assert sum(map(len, asked)) == len(" one two")
