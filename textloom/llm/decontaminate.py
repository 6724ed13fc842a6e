"""Benchmark decontamination with a generalised suffix automaton over words.

The items' words go into one automaton; each document streams through it, and at
every word the automaton knows the longest run of words ending there that also
stands in some item.  Runs of ``window`` words, or all of a shorter item, are hits;
``clean`` removes the hit spans, and documents that are mostly hits.

A benchmark of any size is dealt by hash to blocks of about ``BLOCK_WORDS`` words, in a stored table.  One
block at a time is sent to the executors, where each worker builds its automaton once, and
scans all documents; further blocks' hits are appended to a table by the text's hash
and joined to the documents.  So what the driver and a worker hold, and the plan, are those of one
block however large the benchmark is.

Defined results: null and empty texts have no words and no hits; null items match
nothing; equal items are all reported; documents are whatever rows come in, repeated or
not; an empty table on either side gives no hits; other columns are not read by ``scan``
and are passed through by ``clean``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.llm._text import alnum_words, free_name, stored, stored_parts

WINDOW = 10
#: Words of items in one automaton (about 100 bytes of memory each in a worker).
BLOCK_WORDS = 1_000_000

_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences; state 0 is the start."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        ends: list[tuple[int, int]] = []
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w)
                ends.append((last, k))
        self._mark(items, ends)

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state for the longest string of ``p`` then ``w``: ``q`` itself, or a copy cut off from it."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.next[last].get(w)) is not None:
            return self._split(last, w, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def _mark(self, items, ends) -> None:
        """For each state: the items whose windows the state's suffix of that length is, and the short items that end there."""
        n = len(self.length)
        #: state -> items with the window, kept on the state that holds the suffix of ``window`` words
        self.windows: dict[int, set[int]] = {}
        #: state -> that state, or -1
        self.at_window = [-1] * n
        for s in sorted(range(n), key=self.length.__getitem__):
            if s and self.length[s] >= self.window:
                up = self.link[s]
                self.at_window[s] = s if self.length[up] < self.window else self.at_window[up]
        place = [0] * len(items)
        for s, k in ends:
            place[k] += 1
            if place[k] >= self.window:
                self.windows.setdefault(self.at_window[s], set()).add(k)
        #: state -> short items whose whole text ends with it; equal items are together
        self.short: dict[int, list[int]] = {}
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < self.window:
                s = 0
                for w in words:
                    s = self.next[s][w]
                self.short.setdefault(s, []).append(k)
        #: state -> the nearest state with short items among it and its suffixes, 0 without any; a chain has fewer than ``window``
        self.near_short = [0] * n
        if self.short:
            for s in sorted(range(1, n), key=self.length.__getitem__):
                self.near_short[s] = s if s in self.short else self.near_short[self.link[s]]
        self.short_length = {s: len(items[ks[0]][1]) for s, ks in self.short.items()}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [from, to) of words that are hit, apart and in order, and the items hit."""
        edges, link, length, window = self.next, self.link, self.length, self.window
        spans: list[tuple[int, int]] = []
        windows, ends = set(), set()
        state = run = 0
        root, near_short, short_length = edges[0], self.near_short, self.short_length
        for i, w in enumerate(words):
            if not state:
                state = root.get(w, 0)
                run = 1 if state else 0
            else:
                while (to := edges[state].get(w)) is None:
                    state = link[state]
                    if state <= 0:
                        state, to, run = 0, root.get(w, 0), 0
                        break
                    run = length[state]
                state, run = to, run + 1 if to else 0
            if not state:
                continue
            start = i + 1
            if run >= window:
                windows.add(self.at_window[state])
                start = i + 1 - window
            s = near_short[state]
            while s:
                if short_length[s] <= run:
                    ends.add(s)
                    start = min(start, i + 1 - short_length[s])
                s = near_short[link[s]]
            if start <= i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, {k for of, states in ((self.windows, windows), (self.short, ends)) for s in states for k in of[s]}


Block = list[tuple[str, str]]
#: The automaton that a worker built last, by its block's name.
_built: dict[str, SuffixAutomaton] = {}


def _automaton(name: str, block: Block, window: int) -> SuffixAutomaton:
    if name not in _built:
        _built.clear()
        _built[name] = SuffixAutomaton([(i, alnum_words(t)) for i, t in block], window)
    return _built[name]


def _scan_udf(shared: Broadcast, window: int):
    kind = T.StructType([
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])

    @F.arrow_udf(kind)
    def scan_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        name, block = shared.value
        automaton = _automaton(name, block, window)
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for texts in batches:
            counts, spans, items = [], [], []
            for text in texts:
                words = alnum_words(text.as_py())
                got, found = automaton.hits(words)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in got])
                items.append(sorted({block[k][0] for k in found if block[k][0] is not None}))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))], names=["n_words", "spans", "items"])

    return scan_batches


def _merged(spans: Column) -> Column:
    """Sorted spans with those that meet joined."""
    return F.aggregate(
        F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )


def with_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, hits_col: str = "__hits", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct column of n_words, spans (of word places, apart and in order) and items (sorted)."""
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.floor(F.octet_length("text") / 4) + 1)).first()[0] or 0
    n = max(1, -(-int(size) // block_words))
    dealt = stored(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int")), ("block",)) if n > 1 else items

    def block(k: int) -> Broadcast:
        rows = (dealt.where(F.col("block") == k) if n > 1 else dealt).select("item", "text").toArrow()
        return spark.sparkContext.broadcast((uuid.uuid4().hex, list(zip(rows["item"].to_pylist(), rows["text"].to_pylist(), strict=True))))

    out = docs.withColumn(hits_col, _scan_udf(block(0), window)(F.col(text_col)))
    if n == 1:
        return out
    # equal texts have equal hits, so that these are kept once for a text
    key, more = (free_name(out, f"{hits_col}_{c}") for c in ("key", "more"))
    texts = docs.select(F.md5(text_col).alias("key"), F.col(text_col).alias("text")).where("text is not null")

    def hits_of_blocks() -> Iterator[DataFrame]:
        for k in range(1, n):
            shared = block(k)
            found = texts.select("key", _scan_udf(shared, window)("text").alias("h")).where(F.size("h.spans") > 0)
            yield found.groupBy("key").agg(F.any_value("h").alias("h"))
            shared.unpersist()

    rest = stored_parts(spark, hits_of_blocks()).groupBy("key").agg(F.flatten(F.collect_list("h.spans")).alias("spans"), F.flatten(F.collect_list("h.items")).alias("items"))
    side = rest.select(F.col("key").alias(key), F.struct("spans", "items").alias(more))
    h, m = F.col(hits_col), F.col(more)
    joined = out.join(side, F.md5(text_col) == F.col(key), "left")
    both = F.struct(h["n_words"].alias("n_words"), _merged(F.concat(h["spans"], m["spans"])).alias("spans"), F.array_sort(F.array_distinct(F.concat(h["items"], m["items"]))).alias("items"))
    return joined.withColumn(hits_col, F.when(m.isNotNull(), both).otherwise(h)).drop(key, more)


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_words, n_hit, n_items, items (sorted), spans of each document."""
    out = with_hits(docs.select(F.col(id_col), F.col(text_col)), items, text_col, **options)
    h = F.col(options.get("hits_col", "__hits"))
    return out.select(id_col, h["n_words"].alias("n_words"), _n_hit(h).alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), h["items"].alias("items"), h["spans"].alias("spans"))


def _n_hit(h: Column) -> Column:
    return F.aggregate(h["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = 0.8, window: int = WINDOW, **options) -> DataFrame:
    """``docs`` without hit spans; a document of which more than ``max_coverage`` of the words are hit goes."""

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([without(t, s) if s else t for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    name = free_name(docs, "__hits")
    marked = with_hits(docs, items, text_col, window=window, hits_col=name, **options)
    h = F.col(name)
    return marked.where(_n_hit(h) <= max_coverage * h["n_words"]).withColumn(text_col, F.when(F.size(h["spans"]) > 0, cut(F.col(text_col), h["spans"])).otherwise(F.col(text_col))).drop(name)


def without(text: str, spans: list[dict]) -> str:
    """The text with the spans of words cut out, each from its first word's start to the next kept word's."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : words[s["start"]][0]])
        at = words[s["end"]][0] if s["end"] < len(words) else len(text)
    return "".join([*out, text[at:]]).rstrip() if spans and spans[-1]["end"] >= len(words) else "".join([*out, text[at:]])


def digest(items: Column) -> Column:
    """Lowercase SHA-256 of the item ids joined by commas."""
    return F.sha2(F.concat_ws(",", items), 256)


def items_sha256(ids: list[str]) -> str:
    return sha256(",".join(sorted(ids)).encode()).hexdigest()


def oracle_sql(window: int = WINDOW) -> str:
    """DuckDB SQL for the query over ``documents`` and ``benchmark``: windows of words joined as text."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
             i AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS said FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT *, least(len(w), {window}) AS n FROM b WHERE len(w) > 0))),
             l AS (SELECT DISTINCT n FROM i),
             o AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS said FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, l WHERE len(w) >= n)),
             h AS (SELECT doc_id, k, n, item_id FROM o JOIN i USING (n, said)),
             c AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS at_word FROM h) GROUP BY doc_id),
             m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
    """
