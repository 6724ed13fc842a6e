import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from textloom.llm import simhash_join as s


def printed(text):
    """The fingerprint by definition."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    n = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(numbers):
    """(component of each id, links of distinct numbers) by comparing all pairs; numbers: [(id, fingerprint)]."""
    distinct = sorted({f for _, f in numbers})
    up = {("f", f): ("f", f) for f in distinct} | {("d", i): ("d", i) for i, _ in numbers}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = {(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 3}
    for a, b in [(("f", a), ("f", b)) for a, b in linked] + [(("d", i), ("f", f)) for i, f in numbers]:
        up[find(a)] = find(b)
    groups = defaultdict(list)
    for i, _ in numbers:
        groups[find(("d", i))].append(i)
    return {i: min(groups[find(("d", i))]) for i, _ in numbers}, linked


def around(rng, center, n, most):
    return [center ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, most + 1)), replace=False)) for _ in range(n)]


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(7)
    centers = [int(x) for x in rng.integers(0, 1 << 63, 8)] + [0, (1 << 64) - 1]
    return [int(x) for x in rng.integers(0, 1 << 63, 300)] + [f for c in centers for f in around(rng, c, 60, 5)]


def as_table(spark, numbers):
    return spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in sorted(set(numbers))], "bits long")


def back(rows):
    return {tuple(sorted((r.src % (1 << 64), r.dst % (1 << 64)))) for r in rows}


def test_fingerprints(spark):
    texts = [None, "", "  ", "A", "a B", "x y z", "x y z x y z x y z", "Ünï CÖDE\x0bword\x1cword2  z", "w " * 200_001, " ".join(map(str, range(3_000)))]
    rows = s.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r.doc_id: r.bits % (1 << 64) for r in rows} == {i: printed(t) for i, t in enumerate(texts)}


def test_all_links_of_fingerprints(spark, numbers):
    for blocks in (4, 5, 6):
        found = s.links(as_table(spark, numbers), every=True, blocks=blocks).collect()
        assert len(found) == len(back(found))
        assert back(found) == brute([(0, f) for f in numbers])[1]


def test_large_keys_are_cut(spark, numbers, monkeypatch):
    for chunk, rows in ((7, 10), (40, 200), (1, 1)):
        monkeypatch.setattr(s, "CHUNK", chunk)
        monkeypatch.setattr(s, "ROWS", rows)
        assert back(s.links(as_table(spark, numbers), every=True).collect()) == brute([(0, f) for f in numbers])[1]


def test_few_links_connect_all(numbers, monkeypatch):
    monkeypatch.setattr(s, "PAIRS", 500)
    bits = np.array(sorted(set(numbers)), np.uint64)
    pairs = list(s.near_pairs(np.zeros(len(bits), np.int64), bits, np.full(len(bits), -1)))
    assert {tuple(sorted((int(bits[a]), int(bits[b])))) for i, j in pairs for a, b in zip(i, j, strict=True)} == brute([(0, f) for f in numbers])[1]
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    a, b = s.connecting(i, j)
    assert len(a) < len(np.unique(np.concatenate([i, j])))
    up = list(range(len(bits)))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        up[find(p)] = find(q)
    assert all(find(p) == find(q) for p, q in zip(i.tolist(), j.tolist(), strict=True))


def test_ranges_and_sizes():
    assert [s.blocks_for(n) for n in (0, 1, 1 << 25, 1 << 27, 1 << 33, 1 << 40)] == [4, 4, 4, 5, 6, 7]
    for blocks in range(4, 9):
        r = s.ranges(blocks)
        assert r[0][0] == 0 and sum(w for _, w in r) == 64 and all(a + w == b for (a, w), (b, _) in zip(r, r[1:], strict=False))


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, printed(r.text)) for r in docs.collect()]
    expected = brute(rows)[0]
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in s.classes(docs).collect()} == {(i, f"{f:016x}", expected[i]) for i, f in rows}


def test_edge_cases(spark):
    near = "one two three four five six seven eight nine ten " * 20
    rows = [(1, None), (2, ""), (3, near), (4, near + "x"), (4, "q"), (5, "q"), (None, "q"), (9, near), (9, near), (8, " \t"), (7, "unlike anything else here at all")]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id int, text string, bits string, component_id int")
    got = s.classes(docs).collect()
    expected = brute([(i, printed(t)) for i, t in rows if i is not None])[0] | {None: None}
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(((i, f"{printed(t):016x}", expected[i]) for i, t in rows), key=str)
    pairs, members = s.all_links(docs)
    # document 4 has two fingerprints, and is in the class of each
    assert {(r.doc_id, r.rep) for r in members.collect()} >= {(5, 4), (9, 3), (2, 1), (8, 1)}
    assert all(r.src < r.dst for r in pairs.collect())
    none = s.classes(docs.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "fingerprint", "component_id"]


def test_one_large_group(spark):
    """Thousands of different texts near one: all in one component, by few links."""
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 1 << 63))
    bits = sorted({center ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a + 1, 64)} | {center})
    table = as_table(spark, bits)
    found = s.links(table).collect()
    assert len(found) < 8 * 4 * len(bits)
    up = {}
    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in back(found):
        up[find(a)] = find(b)
    assert len({find(b) for b in bits}) == 1
