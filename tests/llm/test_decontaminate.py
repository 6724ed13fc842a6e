import random
import re

import pytest

from textloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        size = min(window, len(x))
        for k in range(len(x) - size + 1) if size else ():
            for at in range(len(w) - size + 1):
                if w[at : at + size] == x[k : k + size]:
                    hit |= set(range(at, at + size))
                    found.add(item)
    return len(w), hit, found


@pytest.mark.parametrize("seed", range(60))
def test_automaton_equals_brute_force(seed):
    r = random.Random(seed)
    letters = "ab" if seed % 3 else "abcd"
    text = lambda n: " ".join(r.choice(letters) for _ in range(n))
    items = [(f"i{k}", text(r.choice([0, 1, 2, 3, 4, 6, 9]))) for k in range(r.randint(0, 6))]
    items += items[:1]
    automaton = d.SuffixAutomaton([(i, d.alnum_words(t)) for i, t in items], 4)
    for _ in range(8):
        t = text(r.randint(0, 25))
        spans, found = automaton.hits(d.alnum_words(t))
        n, hit, want = brute(t, items, 4)
        assert {p for a, b in spans for p in range(a, b)} == hit
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert {items[k][0] for k in found} == want


def test_words_are_those_of_the_pattern():
    t = "Abc-D9 é xİ ÀB_c\x7f y 日本"
    assert [w.decode() for w in d.alnum_words(t)] == words(t)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (10, "short item"), (2, None), (3, ""), (4, "short item")]
DOCS = [
    (1, "x ONE, two three four five six seven eight nine ten. y"), (2, "a short-item b"), (3, None), (4, ""), (5, "two three four five six seven eight nine ten eleven"), (5, "nothing"), (None, "short item"),
]


def frames(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in DOCS], "doc_id long, text string, n_words int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_scan(spark, block):
    docs, items = frames(spark)
    got = d.scan(docs, items, block_words=block).collect()
    assert len(got) == len(DOCS)
    for r in got:
        if r["doc_id"] in (1, 2, 3, 4):
            n, hit, found = brute(dict(DOCS)[r["doc_id"]], ITEMS, 10)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), sorted(map(str, found)))
    assert d.scan(docs.limit(0), items).count() == 0
    assert all(r["n_hit"] == 0 for r in d.scan(docs, items.limit(0)).collect())


def test_clean_cuts_spans_and_drops_covered_documents(spark):
    docs, items = frames(spark)
    out = [(r["doc_id"], r["text"]) for r in d.clean(docs, items).collect()]
    assert (2, "a b") in out and (5, "nothing") in out and (3, None) in out and (4, "") in out
    assert not [t for i, t in out if i is None or (i == 5 and t != "nothing")]
    assert d.clean(docs, items).columns == docs.columns
    assert d.without("x  One two. y", [{"start": 1, "end": 3}]) == "x  y"
    assert d.without("one two", [{"start": 0, "end": 2}]) == ""


def test_query_over_small_tables(spark, small):
    from textloom.llm.queries import op5_decontaminate

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    grams = {}
    for i, t in items:
        w = words(t)
        size = min(10, len(w))
        for k in range(len(w) - size + 1) if size else ():
            grams.setdefault(size, {}).setdefault(tuple(w[k : k + size]), set()).add(i)
    for r in op5_decontaminate(spark, small).collect():
        w, hit, found = words(docs[r["doc_id"]]), set(), set()
        for size, known in grams.items():
            for at in range(len(w) - size + 1):
                if (g := tuple(w[at : at + size])) in known:
                    hit |= set(range(at, at + size))
                    found |= known[g]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == d.items_sha256(list(found))


def test_blocks_give_the_same_and_plans_do_not_grow(spark):
    r = random.Random(8)
    text = lambda n: " ".join(r.choice("abcdefg") for _ in range(n))
    items = spark.createDataFrame([(k, text(r.choice([2, 5, 9, 12, 30]))) for k in range(60)], "item_id long, text string")
    rows = [text(r.randint(0, 60)) for _ in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*rows, *rows[:5], None, ""])], "doc_id long, text string")
    size = sum(len(i["text"]) // 4 + 1 for i in items.collect())
    one, some, many = ([d.scan(docs, items, window=6, block_words=n), None] for n in (10**6, -(-size // 3), -(-size // 20)))
    want = sorted(map(str, one[0].collect()))
    for got in (some[0], many[0]):
        assert sorted(map(str, got.collect())) == want
    shape = lambda df: re.findall(r"(?m)^[ :+-]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString())
    assert shape(some[0]) == shape(many[0])


def test_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000 + "one two three", 5)], "doc_id long, text string, __hits int")
    items = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, "three")], "item_id long, text string")
    assert d.scan(docs, items).select("n_words", "n_hit", "items").first() == (200_003, 3, ["1", "2", "3"])
    out = d.clean(docs, items)
    assert out.columns == docs.columns and out.first()["text"] == ("word " * 200_000).rstrip()
