"""SimHash near-duplicates with pivot distance tables.

Fingerprints.  A text's words (A-Z lower-cased) give 3-word shingles, repeats included; a bit of the
fingerprint is 1 if it is set in over half of their 64-bit hashes.  Documents of one fingerprint are one class, and
only distinct fingerprints go on.

Routing.  Two fingerprints that differ in at most 3 bits agree in all but 3 of any ``blocks``
ranges of bits, so that each one goes to a task for every choice of ``blocks`` - 3 ranges, keyed by
their bits.  There are 4 ranges up to 2**26 distinct fingerprints, and one more for each 2**6 times as
many, so that a key's fingerprints stay few; the links found are the same for any number.

Pivots.  The Hamming distances to ``PIVOTS`` reference fingerprints are a table beside a key's fingerprints.  By
the triangle inequality two fingerprints that link differ by at most 3 in every coordinate: rows are
sorted by the first one, which gives each row a range of partners, further coordinates thin these
out, and the survivors are verified bit by bit.

Large keys.  A key of more than ``CHUNK`` fingerprints is cut into chunks by the distance to the first
pivot (and by a hash, where one distance has more); two chunks meet if their distances allow links.  No
task has more than two chunks, and no pair is left out.  A task gives as links no more than connect what all its
links would.

Defined results: null and empty texts have fingerprint zero and link like any other; a text of
fewer words than a shingle has its whole sequence as one; rows without an id have a null component and
link with nothing; rows that share an id are one document, linked by any of their texts; long texts are used whole;
an empty table gives an empty table; only the id and the text are read, so other columns can't
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm._text import mix64, space_words, stored
from textloom.llm.components import components

WIDTH, SEED, BITS = 3, 42, 3
PIVOTS = 48
#: Fingerprints of one chunk of a large key.
CHUNK = 4_096
#: Pairs, and rows of small keys, that a task has in memory at once.
PAIRS, ROWS = 2_000_000, 200_000
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 16

# ---------------------------------------------------------------- fingerprints


def shingle_hashes(words: list[bytes], width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 of each space-joined window of ``width`` words, or of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    width, of = min(width, len(words)), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[width - 1 :].tolist()
    return np.fromiter((of(joined[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)), np.uint64, len(ends))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), SHINGLES):
        part = np.unpackbits(hashes[a : a + SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, ``bits``: the fingerprint as a long of the same 64 bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(space_words(t.as_py()), width)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "bits"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, bits long")


# ---------------------------------------------------------------- pivots


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distances(bits: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot table: a row for each reference fingerprint."""
    return np.stack([np.bitwise_count(bits ^ p) for p in references]).astype(np.int8)


def near_pairs(keys: np.ndarray, bits: np.ndarray, side: np.ndarray, most: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of one key whose bits differ in 1 to ``most`` places; rows of a key with two sides only across them.

    keys are numbers from 0; a side is 0 or 1, or -1 for rows of a key that all meet.
    """
    table = distances(bits, pivots())
    place = keys * 256 + table[0]
    order = np.argsort(place, kind="stable")
    place, bits, side, table = place[order], bits[order], side[order], table[:, order]
    # partners of a row stand after it, with its key and a first distance of at most ``most`` more
    end = np.searchsorted(place, place + most, side="right")
    partners = end - np.arange(len(place)) - 1
    to = np.cumsum(partners)
    at = 0
    while at < len(place):
        last = max(at + 1, int(np.searchsorted(to, (to[at - 1] if at else 0) + PAIRS, side="right")))
        counts = partners[at:last]
        i = np.repeat(np.arange(at, last), counts)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
        across = (side[i] != side[j]) | (side[i] < 0)
        i, j = i[across], j[across]
        for row in table[1:]:
            if not len(i):
                break
            keep = np.abs(row[i] - row[j]) <= most
            i, j = i[keep], j[keep]
        true = np.bitwise_count(bits[i] ^ bits[j]) <= most
        if true.any():
            yield order[i[true]], order[j[true]]
        at = last


def connecting(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star in each component of the links: so many pairs as connect what the links do."""
    nodes, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = flat[: len(i)], flat[len(i) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


# ---------------------------------------------------------------- routing


def ranges(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of so many ranges of the 64 bits, as equal as can be."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def blocks_for(distinct: int) -> int:
    """Ranges with which a key has few fingerprints: 4 up to 2**26 of them, then one more for each 2**6 times as many."""
    return 4 + max(0, -(-(max(distinct, 1).bit_length() - 26) // 6))


def _keys(blocks: int, most: int) -> list[Column]:
    """For each choice of ranges its number and their bits."""

    def part(first: int, width: int) -> Column:
        return F.shiftrightunsigned("bits", first).bitwiseAND(F.lit((1 << width) - 1))

    of = [part(*r) for r in ranges(blocks)]
    return [F.struct(F.lit(k).alias("choice"), F.xxhash64(*[of[c] for c in choice]).alias("value")) for k, choice in enumerate(combinations(range(blocks), blocks - most))]


def _tasks(distinct: DataFrame, blocks: int) -> DataFrame:
    """(choice, value, a, b, bits, side): fingerprints by key; those of a large key by pair of chunks."""
    keyed = distinct.select("bits", F.explode(F.array(*_keys(blocks, BITS))).alias("k")).select("bits", "k.choice", "k.value")
    first = np.int64(pivots(1).view(np.int64)[0])
    keyed = keyed.withColumn("d", F.bit_count(F.col("bits").bitwiseXOR(F.lit(int(first)))))
    key = ["choice", "value"]
    counts = stored(keyed.groupBy(*key, "d").agg(F.count(F.lit(1)).alias("c")).groupBy(*key).agg(F.sum("c").alias("n"), F.collect_list(F.struct("d", "c")).alias("of")).where(F.col("n") > 1))
    one = F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(-1).alias("side")
    small = keyed.join(counts.where(F.col("n") <= CHUNK).select(*key), key).select(*key, *one[:2], "bits", one[2])
    if counts.where(F.col("n") > CHUNK).isEmpty():
        return small
    # a chunk is a distance, or a part of one: at most 65 distances a key
    of_distance = counts.where(F.col("n") > CHUNK).select(*key, F.explode("of").alias("x")).select(*key, "x.d", F.ceil(F.col("x.c") / CHUNK).cast("int").alias("parts"))
    chunks = of_distance.select(*key, "d", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")).withColumn("chunk", F.col("d") * (1 << 20) + F.col("p"))
    pairs = chunks.alias("x").join(chunks.alias("y"), key).where("x.chunk <= y.chunk and y.d - x.d <= " + str(BITS)).select(*key, F.col("x.chunk").alias("a"), F.col("y.chunk").alias("b"))
    placed = keyed.join(of_distance, [*key, "d"]).select(*key, "bits", (F.col("d") * (1 << 20) + F.pmod(F.xxhash64("bits"), F.col("parts"))).cast("int").alias("chunk"))
    left = placed.withColumnRenamed("chunk", "a").join(pairs, [*key, "a"]).select(*key, "a", "b", "bits", F.when(F.col("a") == F.col("b"), -1).otherwise(0).alias("side"))
    right = placed.withColumnRenamed("chunk", "b").join(pairs.where("a < b"), [*key, "b"]).select(*key, "a", "b", "bits", F.lit(1).alias("side"))
    return small.union(left).union(right)


def links(distinct: DataFrame, every: bool = False, blocks: int | None = None) -> DataFrame:
    """(src, dst) of distinct fingerprints ``bits`` that link: so many as connect what all would, or every one, once."""
    blocks = blocks or blocks_for(distinct.count())
    names = ["choice", "value", "a", "b"]

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        columns = [table[c].to_numpy() for c in names]
        change = np.zeros(len(table), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        bits = table["bits"].to_numpy()
        for i, j in near_pairs(np.cumsum(change), bits.view(np.uint64), table["side"].to_numpy()):
            if not every:
                i, j = connecting(i, j)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(bits[i], bits[j])), pa.array(np.maximum(bits[i], bits[j]))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < ROWS:
                continue
            # the last key may go on: its rows wait, and it has at most two chunks
            table = pa.Table.from_batches(held).combine_chunks()
            ends = [table[c].to_numpy() for c in names]
            same = np.logical_and.reduce([c == c[-1] for c in ends])
            start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if start:
                yield from found(table.slice(0, start).to_batches())
            held = table.slice(start).to_batches()
            rows = len(table) - start
        if rows:
            yield from found(held)

    tasks = _tasks(distinct.select("bits"), blocks).repartition(*names).sortWithinPartitions(*names)
    out = tasks.mapInArrow(run, "src long, dst long")
    return out.distinct() if every else out


# ---------------------------------------------------------------- the operator


def _text(bits: str) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id (whole numbers), fingerprint (16 hexadecimal digits), component_id (long): the least id that links reach, the document's own included."""
    printed = stored(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", width))
    there = printed.where("id is not null")
    distinct = stored(there.groupBy("bits").agg(F.min("id").alias("least")))
    found = links(distinct)
    # an id with several fingerprints links them
    several = there.groupBy("id").agg(F.min("bits").alias("src"), F.max("bits").alias("last")).where("src < last").select("id", "src")
    found = found.union(there.join(several, "id").select("src", F.col("bits").alias("dst")).distinct())
    whole = components(found)
    of_bits = distinct.join(whole.withColumnRenamed("id", "bits"), "bits", "left").select("bits", "least", F.coalesce("component", "bits").alias("component"))
    of_bits = stored(of_bits)
    least = of_bits.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_bits.join(least, "component").select("bits", "component_id")
    ours = there.join(named, "bits").select("id", "bits", "component_id")
    out = ours.union(printed.where("id is null").select("id", "bits", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), _text("bits").alias("fingerprint"), "component_id")


def all_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """All pairs (src < dst) of class representatives that link, and the membership (id, rep) of documents.

    A class is the documents of one fingerprint, and its representative the least id.
    """
    there = stored(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", width).where("id is not null"))
    reps = stored(there.groupBy("bits").agg(F.min("id").alias("rep")))
    found = links(reps, every=True)
    pairs = found.join(reps.select(F.col("bits").alias("src"), F.col("rep").alias("a")), "src").join(reps.select(F.col("bits").alias("dst"), F.col("rep").alias("b")), "dst")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).where("src < dst").distinct(), there.join(reps, "bits").select(F.col("id").alias(id_col), "rep").distinct()
