"""N-gram Jaccard join with signature trees, and the components that its links form.

Two documents link when 100 x intersection >= percent x union of their shingle sets.

Classes.  Equal sets are one class, and only its least document goes on.

Routing.  All shingles have one order: by how often they stand in the corpus, as a count
sketch of fixed size estimates it, then by hash.  Sets that link have one of the first
n - ceil(percent n / 100) + 1 shingles of each in common, whatever the order; rarest first, that
says much, and a passage that many documents share says nothing.  These shingles are the
routing keys.  The least document of a key is the centre of the others, and the
documents of one centre are one group: every pair that shares a key is in a group, and
groups aren't chained.

Joining.  Groups are joined by signature trees: leaves hold documents with token
bitmaps, nodes the OR of their children's bitmaps and the range of their set sizes, and a
traversal of two trees at once drops pairs of nodes that can't reach the overlap needed.
It runs over the bitmaps alone first (of documents with a size near another's in the group; those of a part of each set, then
those of the sets), and only documents that may still link have their texts shuffled; then over the sets, and the pairs left are compared exactly.  Documents
already connected aren't compared again.

Large groups.  A group of more than a block is cut into blocks by size.  Each block is joined
with the group's centre among it, and then only the documents that aren't in the
group's largest component yet are compared with all of its blocks.  So near copies of one text cost
their number, no task takes more than two blocks, and no pair is left out.

Defined results: null and empty texts have no shingles and link with nothing; a text
of fewer words than a shingle has its whole sequence as one; rows without an id get a
null component and link with nothing; rows that share an id are one document, linked by
any of their texts; long texts are used whole; an empty table gives an empty table; only
the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.llm._text import WordHashes, mix64, shingles, space_words, stored
from textloom.llm.components import components

WIDTH, PERCENT = 3, 90
#: Documents and shingles of a group in one block.
BLOCK_DOCS, BLOCK_SHINGLES = 1_000, 1_000_000
#: Cells of the count sketch, of which every executor gets 2 bytes each, and cells in one row of it.
CELL_BITS, CELL_ROW = 22, 1 << 16
#: Buckets of ids of which a set is sent to every executor, to leave out texts before they're shuffled.
BUCKETS = 1 << 20
#: Ids that are sent to every executor where one document of each component is kept.
SENT_IDS = 1 << 20
LEAF = 8
#: Least and most bits of a bitmap; between them it has four to eight for each shingle.
LEAST_BITS, MOST_BITS = 256, 1 << 17
#: Least bits of the bitmap of a part.
LEAST_PART = 64

# ---------------------------------------------------------------- order and routing


def cells(s: np.ndarray) -> np.ndarray:
    return (mix64(s) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Counts as 16-bit numbers in the same order: exact below 1024, and by logarithm above."""
    c = np.maximum(counts.astype(np.float64), 1)
    return np.where(c < 1024, counts, np.minimum(1024 * (np.log2(c) - 9), 65_535)).astype(np.uint16)


def routing_keys(s: np.ndarray, percent: int, order: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a sorted set, rarest first, of which two sets that link have one in common.

    Those that stand once in the corpus are left out; without ranks the order is by hash alone.
    """
    n = len(s)
    if not n:
        return s
    rank = np.zeros(n, np.uint16) if order is None else order[cells(s)]
    first = np.argsort(rank, kind="stable")[: n - -(-percent * n // 100) + 1]
    return s[first[rank[first] != 1]]


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Least intersection with which sets of these sizes link."""
    return -(-(a + b) * percent // (100 + percent))


# ---------------------------------------------------------------- signature trees


def signature(s: np.ndarray, least: int = LEAST_BITS) -> np.ndarray:
    """Bitmap of a set as 64-bit words; one of half the length is the OR of its halves."""
    bits = min(MOST_BITS, max(least, 1 << (4 * len(s) - 1).bit_length()))
    flags = np.zeros(bits, bool)
    flags[(s % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def part(s: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a sorted set whose hashes are below a limit that all sets share: a share of them, about twice what two sets that link may lack.

    Such a set lacks at most n - needed shingles of the other, wherever they are, and so at most that many of its part.
    """
    share = 2.2 * (100 - percent) / (100 + percent)
    halvings = next((k for k in range(5, 0, -1) if share <= 0.5**k), 0)
    return s if not halvings else s[: np.searchsorted(s, np.uint64(1 << (64 - halvings)))]


class Tree:
    """Signature tree over members (in order of size) of given set sizes and bitmaps of equal length.

    The bitmaps may be of parts of the sets, of ``counts`` shingles.
    """

    def __init__(self, members: np.ndarray, sizes: np.ndarray, maps: np.ndarray, counts: np.ndarray | None = None):
        self.members, starts = members, np.arange(0, len(members), LEAF)
        #: shingles beyond one for each bit that is set
        counts = sizes if counts is None else counts
        extra = counts - np.bitwise_count(maps).sum(1)
        #: from the members up: bitmap, least and largest size, most extra, and by how much the part is smaller than the set at most (negative)
        self.levels = [(maps, sizes, sizes, extra, counts - sizes)]
        while len(starts) and (len(self.levels) == 1 or len(self.levels[-1][0]) > 1):
            maps, low, high, extra, short = self.levels[-1]
            starts = np.arange(0, len(maps), LEAF)
            self.levels.append((np.bitwise_or.reduceat(maps, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(extra, starts), np.minimum.reduceat(short, starts)))

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * LEAF, min((node + 1) * LEAF, len(self.levels[level - 1][0])))


def _possible(x: Tree, la: int, a: np.ndarray, y: Tree, lb: int, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold a pair that links: sizes near enough, and enough bits in common."""
    maps_a, low_a, high_a, extra_a, short_a = (t[a] for t in x.levels[la])
    maps_b, low_b, high_b, extra_b, short_b = (t[b] for t in y.levels[lb])
    near = (high_a[:, None] * 100 >= low_b * percent) & (high_b * 100 >= low_a[:, None] * percent)
    if near.any():
        common = np.bitwise_count(maps_a[:, None] & maps_b[None]).sum(2) + np.minimum(extra_a[:, None], extra_b)
        near &= common >= needed(low_a[:, None], low_b, percent) + np.maximum(short_a[:, None], short_b)
    return near


Visit = Callable[[np.ndarray, np.ndarray, np.ndarray], None]


def walk(x: Tree, y: Tree, percent: int, visit: Visit) -> None:
    """Traverse two trees (or one with itself) at once; ``visit`` gets members of two leaves and which pairs of them may link."""
    same = x is y
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        down_a, down_b = la >= lb, lb >= la
        i, j = x.children(la, a) if down_a else np.array([a]), y.children(lb, b) if down_b else np.array([b])
        pairs = _possible(x, la - down_a, i, y, lb - down_b, j, percent)
        if same and a == b:
            pairs = np.triu(pairs, 1 if la == 1 else 0)
        if la <= 1 and lb <= 1:
            if pairs.any():
                visit(x.members[i], y.members[j], pairs)
        else:
            stack += [(la - down_a, int(i[p]), lb - down_b, int(j[q])) for p, q in np.argwhere(pairs)]


def traverse(sizes: np.ndarray, maps: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, percent: int, visit: Visit, counts: np.ndarray | None = None) -> None:
    """Walk the trees of ``left`` with themselves, or with those of ``right``; members of one bitmap length are a tree."""

    def trees(rows: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        length = np.array([len(maps[r]) for r in rows])
        return {int(k): (rows[length == k], np.stack([maps[r] for r in rows[length == k]])) for k in np.unique(length)}

    def tree(members: np.ndarray, bitmaps: np.ndarray, words: int) -> Tree:
        return Tree(members, sizes[members], np.bitwise_or.reduce(bitmaps.reshape(len(members), -1, words), 1), None if counts is None else counts[members])

    ours = trees(left)
    theirs = ours if right is None else trees(right)
    for k, (u, of_u) in ours.items():
        for m, (v, of_v) in theirs.items():
            # sizes are in order, so the last one is the largest
            if (right is None and k > m) or sizes[u[-1]] * 100 < sizes[v[0]] * percent or sizes[v[-1]] * 100 < sizes[u[0]] * percent:
                continue
            x = tree(u, of_u, min(k, m))
            walk(x, x if u is v else tree(v, of_v, min(k, m)), percent, visit)


class Groups:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def may_link(sizes: np.ndarray, maps: list[np.ndarray], percent: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Which members have another one that the bitmaps (of parts of ``counts`` shingles, or of the sets) let them link with."""
    of, out = sizes if counts is None else counts, np.zeros(len(sizes), bool)
    if len(sizes) == 2:
        # most groups are pairs, which need no tree
        (x, y), words = maps, min(map(len, maps))
        x, y = (np.bitwise_or.reduce(m.reshape(-1, words), 0) for m in (x, y))
        extra = min(int(n) - int(np.bitwise_count(m).sum()) for n, m in zip(of, (x, y), strict=True))
        out[:] = int(np.bitwise_count(x & y).sum()) + extra >= needed(int(sizes[0]), int(sizes[1]), percent) + int((of - sizes).max())
        return out

    def visit(u: np.ndarray, v: np.ndarray, pairs: np.ndarray) -> None:
        out[u] |= pairs.any(1)
        out[v] |= pairs.any(0)

    traverse(sizes, maps, np.arange(len(sizes)), None, percent, visit, counts)
    return out


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, percent: int, every: bool = False) -> list[tuple[int, int]]:
    """Links among ``left``, or between ``left`` and ``right``: all, or so many that they connect what all would."""
    groups, out = Groups(len(sets)), []
    sizes = np.array(list(map(len, sets)), np.int64)

    def visit(u: np.ndarray, v: np.ndarray, pairs: np.ndarray) -> None:
        for p, q in np.argwhere(pairs):
            a, b = int(u[p]), int(v[q])
            if not every and groups.find(a) == groups.find(b):
                continue
            if len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= needed(len(sets[a]), len(sets[b]), percent):
                groups.join(a, b)
                out.append((a, b))

    traverse(sizes, [signature(s) for s in sets], left, right, percent, visit)
    return out


# ---------------------------------------------------------------- sets of documents


def _shingle_sets(texts: pa.Array, words: WordHashes, width: int) -> Iterator[np.ndarray]:
    for t in texts:
        with np.errstate(over="ignore"):
            yield shingles(words.of(space_words(t.as_py())), width)


def fingerprint(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    with np.errstate(over="ignore"):
        return mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)


def _measured(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, f1, f2): set size and 128-bit fingerprint of the set; and rows (at, counts) of each task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sketch = WordHashes(), np.zeros(1 << CELL_BITS, np.uint32)
        names = ["id", "n", "f1", "f2", "at", "counts"]
        for batch in batches:
            n, prints = [], []
            for s in _shingle_sets(batch.column(1), words, width):
                n.append(len(s))
                prints.append(fingerprint(s))
                np.add.at(sketch, cells(s), np.uint32(1))
            p = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())], names=names)
        for at in range(0, len(sketch), CELL_ROW):
            row = sketch[at : at + CELL_ROW]
            if row.any():
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([at], pa.int64()), pa.array([zlib.compress(row.tobytes(), 1)], pa.binary())], names=names)

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, at long, counts binary")


def _order(parts: DataFrame) -> np.ndarray:
    """The sketch of all tasks as ranks: 2 bytes a cell, whatever the corpus."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELL_ROW, np.uint64)
        for batch in batches:
            for c in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([ranks(total).tobytes()], pa.binary())], names=["at", "ranks"])

    out = np.zeros(1 << CELL_BITS, np.uint16)
    for r in parts.groupBy("at").applyInArrow(add, "at long, ranks binary").toLocalIterator():
        out[r["at"] : r["at"] + CELL_ROW] = np.frombuffer(r["ranks"], np.uint16)
    return out


def _routed(docs: DataFrame, order: np.ndarray, width: int, percent: int) -> DataFrame:
    """(id, n, f1, f2, map, c, part, keys) of documents that have an id and a set; part is the bitmap of its ``part``, of c shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            n, prints, maps, c, parts, keys, offsets = [], [], [], [], [], [], [0]
            for s in _shingle_sets(batch.column(1), words, width):
                n.append(len(s))
                prints.append(fingerprint(s))
                maps.append(signature(s).tobytes() if len(s) else None)
                some = part(s, percent)
                c.append(len(some))
                parts.append(signature(some, LEAST_PART).tobytes() if len(s) else None)
                keys.append(routing_keys(s, percent, shared.value))
                offsets.append(offsets[-1] + len(keys[-1]))
            p = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(maps, pa.binary()), pa.array(c, pa.int64()), pa.array(parts, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))], names=["id", "n", "f1", "f2", "map", "c", "part", "keys"])

    return docs.where(F.col("id").isNotNull()).mapInArrow(run, "id long, n long, f1 long, f2 long, map binary, c long, part binary, keys array<long>").where("n > 0")


# ---------------------------------------------------------------- groups of candidates


def _members(reps: DataFrame) -> DataFrame:
    """(centre, id): the documents of each group, the centre included.

    Keys are by far the most rows here, so they are shuffled once: the centres are found, and met, where their key's rows already are.
    """
    # filters that the join would add on one side only are given to both, as the shuffle is shared by equal plans alone
    keyed = reps.select("id", F.explode("keys").alias("key")).where("id is not null and key is not null").repartition("key")
    centres = keyed.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").select("key", "centre")
    others = stored(keyed.join(centres, "key").where("id > centre").select("centre", "id").distinct())
    return others.union(others.select("centre", "centre").distinct())


def _rows_of(docs: DataFrame, chosen: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Texts or bitmaps of the chosen ids, joined by shuffle.

    Before it, those are dropped whose id's hash falls in no chosen id's bucket: at most BUCKETS numbers go to
    every executor, and few rows that aren't wanted are shuffled until the choice is about as large as that.
    """
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    near = docs.withColumn("bucket", bucket).join(F.broadcast(chosen.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    return near.join(chosen, list(by))


def _alive(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        maps = [np.frombuffer(m.as_py(), np.uint64) for m in table["map"]]
        return table.select(["centre", "id", "n"]).filter(pa.array(may_link(table["n"].to_numpy(), maps, percent, table["c"].to_numpy())))

    return run


def _block_links(width: int, percent: int, every: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        sets = list(_shingle_sets(table["text"], WordHashes(), width))
        ids, side = table["id"].to_pylist(), table["side"].to_numpy()
        # an id may have rows without shingles besides the one that is a candidate
        rows = np.flatnonzero(np.fromiter(map(len, sets), np.int64, len(sets)))
        side = side[rows]
        # among one block, or between documents of one (side 0) and all of one (side 1)
        one = not (side == 0).any()
        found = [] if not (side == 1).any() else links(sets, rows if one else rows[side == 0], None if one else rows[side == 1], percent, every)
        return pa.table({"src": pa.array([ids[a] for a, _ in found], pa.int64()), "dst": pa.array([ids[b] for _, b in found], pa.int64())})

    return run


def _joined(docs: DataFrame, rows: DataFrame, width: int, percent: int, every: bool) -> DataFrame:
    """Links of tasks: rows are (id, centre, block, other, side)."""
    texts = _rows_of(docs, rows)
    found = texts.groupBy("centre", "block", "other").applyInArrow(_block_links(width, percent, every), "src long, dst long")
    return stored(found.where("src != dst"))


def _blocks(large: DataFrame, totals: DataFrame) -> DataFrame:
    """(centre, id, n, block) of large groups: blocks are ranges of size, found from counts of sizes, not by a sort of documents."""
    counts = large.groupBy("centre", "n").agg(F.count(F.lit(1)).alias("c")).join(totals, "centre")
    w = Window.partitionBy("centre").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("c").over(w) - F.col("c")
    span = F.col("docs") / F.col("blocks")
    last = F.least(F.floor((before + F.col("c") - 1) / span), F.col("blocks") - 1)
    ranges = counts.select("centre", "n", F.floor(before / span).cast("int").alias("b0"), last.cast("int").alias("b1"))
    block = F.col("b0") + F.pmod(F.xxhash64("id"), F.col("b1") - F.col("b0") + 1).cast("int")
    return stored(large.join(ranges, ["centre", "n"]).select("centre", "id", "n", block.alias("block")))


def _tree_links(docs: DataFrame, reps: DataFrame, width: int, percent: int, every: bool) -> DataFrame:
    members = stored(_members(reps).join(reps.select("id", "n"), "id"))
    totals = members.groupBy("centre").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    n_blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    totals = stored(totals.withColumn("blocks", n_blocks))
    of_large = totals.where("blocks > 1").select("centre")
    # in order of size, a document's neighbours are those nearest to it: without one that is near enough it links with none
    w = Window.partitionBy("centre").orderBy("n")
    sizes = members.join(of_large, "centre", "left_anti").select("centre", "id", "n", F.lag("n").over(w).alias("less"), F.lead("n").over(w).alias("more"))
    small = sizes.where((F.col("less") * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.col("more") * percent)).select("centre", "id", "n")
    # most groups share a shingle by chance: bitmaps of small parts of the sets tell, and the whole bitmaps are shuffled for the others
    alive = small
    for c, bits in (("c", "part"), ("n", "map")):
        side = reps.select("id", "n", F.col(c).alias("c"), F.col(bits).alias("map"))
        # the choice is cheap to read again once it is stored
        maps = alive.join(side, ["id", "n"]) if c == "c" else _rows_of(side, alive, ("id", "n"))
        alive = stored(maps.groupBy("centre").applyInArrow(_alive(percent), "centre long, id long, n long"))
    one = F.lit(0).alias("block"), F.lit(0).alias("other"), F.lit(1).alias("side")
    rows = alive.select("id", "centre", *one).distinct()
    large = members.join(of_large, "centre", "left_semi").select("centre", "id", "n")
    if totals.where("blocks > 1").isEmpty():
        return _joined(docs, rows, width, percent, every)
    placed = _blocks(large, totals.where("blocks > 1"))
    ranges = stored(placed.groupBy("centre", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")))
    if every:
        return _joined(docs, rows, width, percent, every).union(_across(docs, placed, placed, ranges, width, percent, every))
    # the centre goes to every block, and is the first to connect what is near it
    in_block = placed.select("id", "centre", "block", one[1], one[2]).union(ranges.select(F.col("centre").alias("id"), "centre", "block", one[1], one[2])).distinct()
    first = _joined(docs, rows.union(in_block), width, percent, every)
    whole = components(first)
    labelled = stored(placed.join(whole, "id", "left").select("centre", "id", "block", F.coalesce("component", "id").alias("component")))
    main = labelled.groupBy("centre", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("centre").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    apart = labelled.join(main, "centre").where("component != main").select("centre", "id", "block")
    return first.union(_across(docs, apart, placed, ranges, width, percent, every))


def _across(docs: DataFrame, some: DataFrame, placed: DataFrame, sizes: DataFrame, width: int, percent: int, every: bool) -> DataFrame:
    """Links between some documents of large groups and all of them, a pair of blocks at a time."""
    some = stored(some.select("centre", "id", "block"))
    ours = some.select("centre", "block").distinct().join(sizes, ["centre", "block"])
    theirs = sizes.select("centre", *[F.col(c).alias(f"o{c}") for c in ("block", "low", "high")])
    near = (F.col("high") * 100 >= F.col("olow") * percent) & (F.col("ohigh") * 100 >= F.col("low") * percent)
    tasks = stored(ours.join(theirs, "centre").where(near).select("centre", "block", F.col("oblock").alias("other")))
    if every:
        tasks = tasks.where("block <= other")
    left = some.join(tasks, ["centre", "block"]).select("id", "centre", "block", "other", F.lit(0).alias("side"))
    right = placed.select("id", "centre", F.col("block").alias("other")).join(tasks, ["centre", "other"]).select("id", "centre", "block", "other", F.lit(1).alias("side"))
    return _joined(docs, left.union(right), width, percent, every)


# ---------------------------------------------------------------- the operator


def _prepared(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, their (id, n, rep), and the representatives with bitmaps and keys."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    measured = stored(_measured(docs, width))
    order = _order(measured.where("at is not null").select("at", "counts"))
    sized = measured.where("at is null").select("id", "n", "f1", "f2")
    there = sized.where("n > 0 and id is not null")
    # one document for each set; rows with the same id and different sets are joined later
    sets = stored(there.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep")))
    reps = stored(_routed(docs, order, width, percent).join(sets.withColumnRenamed("rep", "id"), ["n", "f1", "f2", "id"], "left_semi").select("id", "n", "map", "c", "part", "keys"))
    classed = sized.join(sets, ["n", "f1", "f2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"))
    return docs, classed, reps


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles (long), component_id (long): the least id that links reach, the document's own included.

    Ids are whole numbers.
    """
    docs, classed, reps = _prepared(docs, id_col, text_col, width, percent)
    found = _tree_links(docs, reps, width, percent, False)
    # an id with several sets links their representatives
    several = classed.where("rep is not null").groupBy("id").agg(F.min("rep").alias("src"), F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    whole = components(found.union(several.select("src", F.explode("reps").alias("dst"))))
    labelled = classed.join(whole.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", "n", F.coalesce("component", "rep", "id").alias("label"))
    # rows of one id may have no shingles, or several sets
    labelled = stored(labelled)
    out = labelled.join(labelled.groupBy("id").agg(F.min("label").alias("least")), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def all_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All pairs (src < dst) of class representatives that link, and the membership (id, rep) of documents with shingles.

    A class is the documents of one set, and its representative the least id.  Unlike ``classes``, no pair is
    skipped for being connected by others, so a group of near copies gives as many rows as it has links.
    """
    docs, classed, reps = _prepared(docs, id_col, text_col, width, percent)
    found = _tree_links(docs, reps, width, percent, True)
    pairs = found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs, classed.where("rep is not null").select(F.col("id").alias(id_col), "rep").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is its component's least, once each, and all rows without an id.

    Only ids decide.  The ids that go, and those with several rows, are the smaller side: up to SENT_IDS of them are
    sent to every executor and texts stay where they are; beyond, texts are shuffled once to meet them.
    """
    found = stored(classes(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    first = F.col(id_col) == F.col("least")
    apart, several = (stored(found.where(c).select(id_col)) for c in (~first | (F.col("rows") > 1), first & (F.col("rows") > 1)))
    apart, several = (F.broadcast(x) if x.count() <= SENT_IDS else x for x in (apart, several))
    once = docs.join(apart, id_col, "left_anti")
    again = docs.join(several, id_col, "left_semi").dropDuplicates([id_col])
    return once.union(again).select(docs.columns)


def oracle_sql(width: int = WIDTH, percent: int = PERCENT) -> str:
    """DuckDB SQL for the query over ``documents``: shared shingles counted by pairs of classes, and links followed by recursion."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x20\x09-\x0D]+')"
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
             s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - least(len(w), {width}) + 2), lambda k: array_to_string(w[k : k + least(len(w), {width}) - 1], ' ')))) AS s FROM d WHERE len(w) > 0),
             r AS MATERIALIZED (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s GROUP BY s),
             x AS MATERIALIZED (SELECT rep, n, md5_number(unnest(s)) AS sh FROM r),
             p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.sh = b.sh AND a.rep < b.rep AND a.n * 100 >= b.n * {percent} AND b.n * 100 >= a.n * {percent}
                   GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
             e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
             c AS (SELECT rep AS start, rep AS node FROM r UNION SELECT c.start, e.b FROM c JOIN e ON c.node = e.a),
             l AS (SELECT start, min(node) AS least FROM c GROUP BY start)
        SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, coalesce(least, d.doc_id) AS component_id
        FROM d LEFT JOIN s USING (doc_id) LEFT JOIN r ON s.s = r.s LEFT JOIN l ON r.rep = l.start
    """
