import random

import numpy as np
import pytest

from textloom.llm import jaccard_join as j
from textloom.llm._text import WordHashes, shingles, space_words
from textloom.llm.components import components


def sets_of(texts, width):
    with np.errstate(over="ignore"):
        return [set(shingles(WordHashes().of(space_words(t)), width).tolist()) for t in texts]


def brute(rows, width, percent):
    """Component of each id by comparing all pairs of rows; rows with the same id are one."""
    sets = sets_of([t for _, t in rows], width)
    groups = j.Groups(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            both = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or (sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b])):
                groups.join(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[groups.find(i)] = min(least.get(groups.find(i), doc), doc)
    return [None if doc is None else least[groups.find(i)] for i, (doc, _) in enumerate(rows)], sets


def corpus(seed, n=120):
    r = random.Random(seed)
    texts = []
    for _ in range(n // 6):
        base = [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 2) for _ in range(r.choice([0, 1, 2, 3, 12, 40, 150]))]
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, 1 + len(w) // 40)):
                if w:
                    w[r.randrange(len(w))] = r.choice("xyz")
            texts.append(" ".join(w))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [(None, texts[0]), (3, texts[5]), (500, None), (501, ""), (0, texts[0])]


@pytest.mark.parametrize(("width", "percent", "blocks"), [(3, 90, None), (5, 80, (7, 400))])
def test_classes_equal_brute_force(spark, monkeypatch, width, percent, blocks):
    if blocks:
        monkeypatch.setattr(j, "BLOCK_DOCS", blocks[0])
        monkeypatch.setattr(j, "BLOCK_SHINGLES", blocks[1])
    rows = corpus(width)
    want, sets = brute(rows, width, percent)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.classes(docs, width=width, percent=percent).collect() if r["doc_id"] is not None)
    assert got == sorted((i, len(s), c) for (i, _), s, c in zip(rows, sets, want, strict=True) if i is not None)
    first = j.keep_one(docs, width=width, percent=percent)
    assert first.columns == docs.columns
    assert sorted(r["doc_id"] for r in first.collect() if r["doc_id"] is not None) == sorted({c for c in want if c is not None})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert j.classes(docs).count() == 0 and j.keep_one(docs).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_that_link_share_a_routing_key(percent):
    rng = np.random.default_rng(7)
    with np.errstate(over="ignore"):
        for _ in range(1500):
            a = rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)
            b = np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 2**63, rng.integers(0, 1 + len(a) // 8)).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                assert np.intersect1d(j.routing_keys(a, percent), j.routing_keys(b, percent)).size


@pytest.mark.parametrize("sides", [1, 2])
def test_signature_trees_find_what_all_pairs_connect(sides):
    rng = np.random.default_rng(sides)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 500, rng.integers(5, 120)).astype(np.uint64)
        sets += [np.unique(np.where(rng.random(len(base)) < 0.03, rng.integers(0, 500, len(base)), base).astype(np.uint64)) for _ in range(6)]
    rows = rng.permutation(len(sets))
    left, right = (rows, None) if sides == 1 else (rows[:70], rows[70:])
    got, want = j.Groups(len(sets)), j.Groups(len(sets))
    for a, b in j.links(sets, left, right, 90):
        assert len(np.intersect1d(sets[a], sets[b])) * 100 >= 90 * len(np.union1d(sets[a], sets[b]))
        got.join(a, b)
    for a in left.tolist():
        for b in (left if right is None else right).tolist():
            if a != b and len(np.intersect1d(sets[a], sets[b])) * 100 >= 90 * len(np.union1d(sets[a], sets[b])):
                want.join(a, b)
    assert [got.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 3)]
    groups = j.Groups(500)
    for a, b in edges:
        if a is not None:
            groups.join(a, b)
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: groups.find(x) for x in nodes}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_shingle_sets_are_those_of_the_words():
    """Against sets of word tuples: as many shingles, and as many in common, for every pair of texts."""
    texts = ["", "one", "one two", "One TWO three", "a b c d e f", "a b  c\td x f", "a a a a a a", "b a a a a", "é É x", "a b c d e f a b c"]
    for width in (3, 5):
        hashed = sets_of(texts, width)
        plain = []
        for t in texts:
            w = "".join(c.lower() if c.isascii() else c for c in t).split()
            plain.append({tuple(w[i : i + min(width, len(w))]) for i in range(max(len(w) - width + 1, 1))} if w else set())
        for a in range(len(texts)):
            for b in range(len(texts)):
                assert len(hashed[a] & hashed[b]) == len(plain[a] & plain[b])


def test_all_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_DOCS", 5)
    rows = [(i, t) for i, t in corpus(11, 90) if i is not None and i < 90 and t][:90]
    rows = list({i: (i, t) for i, t in rows}.values())
    sets = dict(zip([i for i, _ in rows], sets_of([t for _, t in rows], 3), strict=True))
    pairs, members = j.all_links(spark.createDataFrame(rows, "doc_id long, text string"))
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    least = {}
    for i in sorted(sets):
        least.setdefault(frozenset(sets[i]), i)
    assert rep == {i: least[frozenset(s)] for i, s in sets.items() if s}
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    assert {(r["src"], r["dst"]) for r in pairs.collect()} == want and want


def test_a_large_group_of_near_copies_costs_its_number(spark, monkeypatch):
    """One group of 5,000 near copies: what is shuffled for it is a small multiple of that, as the group connects through its centre."""
    monkeypatch.setattr(j, "BLOCK_DOCS", 500)
    sent, joined = [], j._joined

    def counting(docs, rows, *rest):
        sent.append(rows.count())
        return joined(docs, rows, *rest)

    monkeypatch.setattr(j, "_joined", counting)
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]

    def near(k):
        w = list(base)
        w[r.randrange(200)] = f"x{k}"
        return " ".join(w)

    rows = [(k, near(k)) for k in range(5_000)] + [(9_000 + k, " ".join(f"y{r.randrange(10**6)}" for _ in range(50))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x["doc_id"]: x["component_id"] for x in j.classes(docs, width=5, percent=80).collect()}
    assert out == {i: 0 if i < 5_000 else i for i in out} and len(out) == 5_050
    # all pairs of its ten blocks would be 55,000 rows
    assert sum(sent) < 3 * 5_000


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_parts_of_sets_lose_no_link_and_tell_others_apart(percent):
    rng = np.random.default_rng(percent)
    base = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (1, 2, 9, 60, 500, 501, 3_000)]
    sets = list(base)
    for b in base:
        for share in (1.0, 0.99, 0.97, 0.95, 0.9, 0.8):
            keep = b[rng.random(len(b)) < share]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 64, int(len(b) * (1 - share)), np.uint64)])))
    sets = [s for s in sets if len(s)]
    parts = [j.part(s, percent) for s in sets]
    n, c = np.array(list(map(len, sets))), np.array(list(map(len, parts)))
    maps = [j.signature(p, j.LEAST_PART) for p in parts]
    alive = j.may_link(n, maps, percent, c)
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b])):
                assert alive[a] and alive[b]
                assert j.may_link(n[[a, b]], [maps[a], maps[b]], percent, c[[a, b]]).all()
    if percent >= 80:
        # sets of chance: small parts are enough to leave them out
        others = [np.unique(rng.integers(0, 1 << 64, 500, np.uint64)) for _ in range(40)]
        parts = [j.part(s, percent) for s in others]
        assert sum(map(len, parts)) < 0.3 * sum(map(len, others))
        assert j.may_link(np.array(list(map(len, others))), [j.signature(p, j.LEAST_PART) for p in parts], percent, np.array(list(map(len, parts)))).mean() < 0.1


def test_keys_are_shuffled_once(spark):
    rows = [(k, f"a b c d e f{k % 7} g{k % 5} h i j") for k in range(60)]
    _, _, reps = j._prepared(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 90)
    plans, kept = [], j.stored

    def keeping(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    j.stored = keeping
    try:
        j._members(reps).collect()
    finally:
        j.stored = kept
    exchanges = [line for line in plans[0].splitlines() if "Exchange hashpartitioning(key" in line]
    # one for the centres and one for the members, equal, so that the second reads the first's rows
    assert exchanges and all("REPARTITION_BY_COL" in line for line in exchanges)
