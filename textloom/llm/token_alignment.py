"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over the corpus.

A document is encoded twice, as space+text by a byte-level vocabulary (side A) and as text by a
piece vocabulary that adds the space itself (side B).  Byte offsets where a token of A and a
token of B both end cut the tokens into groups; all pairs of a group's tokens are links.

Reading.  A task splits texts into segments at places where neither tokenizer joins anything
(checked against both vocabularies when they are loaded), and encodes and aligns each distinct
segment once.  Segments are made of few distinct groups, so a document is kept as the counts of
its groups, and a batch of documents as a list of its groups.

Counting.  Cells of the count matrix (A id x B id) are dealt to stripes of A ids by id.  A
batch sends each stripe one row: how many of its documents hold each pair.  A task adds the
rows of a stripe with ``np.add.at`` to a dense block; blocks of one stripe from several tasks
are added row by row, and a row's maximum is the best count of its A id.

Scoring.  Links of the batches' groups are dealt to the stripes as well: they meet the stripe's
block in one task and come back to their batch as sums by group, from which each document's sums follow.

Blocks and vocabularies have fixed sizes; a stripe with many batches is counted and scored by
several tasks.  Nothing is approximate.

Defined results: a null or empty text, and one whose tokens' bytes differ from space+text on
either side, has no tokens: its numbers are 0 and its digest is ''; repeated rows give
repeated results, and each counts as a document; a null id stays null; long texts are used whole; an empty table gives an
empty table; only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm._text import stored
from textloom.llm.byte_bpe import byte_characters

#: Cells of a stripe's dense block, 8 bytes each.
STRIPE_CELLS = 1 << 23
#: Segments of documents that one batch holds, and distinct segments that a worker remembers.
BATCH_SEGMENTS, REMEMBERED = 4_000_000, 600_000
#: Characters of segments that are encoded by one call.
CALL_CHARACTERS = 1 << 16
#: Batches whose rows one task adds to a stripe's block.
FAN_IN = 256
#: Group occurrences that are counted by document at once.
SLICE = 2_000_000

#: Where a space before a word, or a line end before a word, follows a character that is no white space.
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)")
#: Texts without a match are cut at each space and before each line end.
_ODD = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z")

_loaded: dict[tuple[str, str], "Vocabularies"] = {}


class Vocabularies:
    """Both tokenizers and the bytes of their tokens, in one Python worker."""

    def __init__(self, byte_path: str, piece_path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        of = {c: b for b, c in byte_characters().items()}
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(of[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        # no piece may reach over a cut: spaces only at a piece's start, line ends only as bytes
        self.cuts = bool(plain) and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def segments(self, text: str) -> list[str]:
        """Keys of the segments of space+text: a segment's own text, without its space where a word follows it."""
        if not self.cuts:
            return [" " + text]
        if not _ODD.search(text):
            return text.replace("\n", " \n").split(" ")
        return [s[1:] if s[0] == " " and len(s) > 1 and s[1] not in " \n" else s for s in _CUT.split(" " + text)]

    def encode(self, whole: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides for a run of segments; None where the bytes of either side differ from it."""
        a = self.a.encode(whole, add_special_tokens=False).ids
        # the piece encoder adds a space, which is a token of its own before a line end
        b = self.b.encode(whole[1:] if whole[0] == " " else whole, num_threads=1)
        if whole[0] != " " and b and self.b_bytes[b[0]] == b" ":
            b = b[1:]
        raw = whole.encode("utf-8", "surrogatepass")
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
        return (a, b) if same else None


def load(byte_path: str, piece_path: str) -> Vocabularies:
    """Both vocabularies, read once in each Python worker."""
    if (byte_path, piece_path) not in _loaded:
        _loaded[byte_path, piece_path] = Vocabularies(byte_path, piece_path)
    return _loaded[byte_path, piece_path]


def cut_groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets where tokens of both sides end, and how many tokens of each side end up to there."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return common, np.searchsorted(a_ends, common) + 1, np.searchsorted(b_ends, common) + 1


class _Numbers(dict):
    """Numbers keys as they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _flat(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + counts[i] - 1 of all i, one after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


@dataclass
class Ragged:
    """Lists of numbers one after another."""

    flat: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat.append(flat)
        self.counts.append(counts)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, counts), joined once and kept so."""
        flat, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.flat, self.counts))
        self.flat, self.counts = [flat], [counts]
        return flat, np.cumsum(counts) - counts, counts


class Aligner:
    """Segments and groups that a worker has met."""

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self.reset()

    def reset(self) -> None:
        self.of_segment, self.of_group, self.of_pair = _Numbers(), _Numbers(), _Numbers()
        #: groups of each segment (none where bytes differ), pairs of each group
        self.groups, self.pairs = Ragged(), Ragged()
        self.segment_text: list[bytes | None] = []
        self.group_text: list[bytes] = []
        self.group_a: list[int] = []
        self.group_b: list[int] = []

    def numbers(self, text: str) -> np.ndarray:
        keys = self.v.segments(text)
        return np.fromiter(map(self.of_segment.__getitem__, keys), np.int64, len(keys))

    def learn(self) -> None:
        """Encode and align the segments met since the last call."""
        known = len(self.segment_text)
        keys = list(self.of_segment)[known:] if len(self.of_segment) > known else []
        whole = [k if k[0] in " \n" else " " + k for k in keys]
        run, size = [], 0
        for w in whole:
            # segments that begin and end as a cut asks for keep their tokens in a run of segments
            regular = self.v.cuts and len(w) > 1 and not w[1].isspace() and not w[-1].isspace()
            if run and (not regular or size + len(w) > CALL_CHARACTERS):
                self._align(run)
                run, size = [], 0
            run.append(w)
            size += len(w)
            if not regular:
                self._align(run)
                run, size = [], 0
        if run:
            self._align(run)

    def _align(self, run: list[str]) -> None:
        v = self.v
        found = v.encode("".join(run))
        if found is None and len(run) > 1:
            for w in run:
                self._align([w])
            return
        if found is None:
            self.segment_text.append(None)
            self.groups.add(np.zeros(0, np.int64), np.zeros(1, np.int64))
            return
        a, b = np.array(found[0], np.int64), np.array(found[1], np.int64)
        common, a_to, b_to = cut_groups(np.cumsum(v.a_len[a]), np.cumsum(v.b_len[b]))
        ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in run])
        last = np.searchsorted(common, ends)
        if len(run) > 1 and not np.array_equal(common[np.minimum(last, len(common) - 1)], ends):
            raise AssertionError("a token reaches over a cut between segments")
        a_from, b_from = np.append(0, a_to[:-1]), np.append(0, b_to[:-1])
        numbers = np.zeros(len(common), np.int64)
        single = (a_to - a_from == 1) & (b_to - b_from == 1)
        codes, back = np.unique(a[a_from[single]] * len(v.b_bytes) + b[b_from[single]], return_inverse=True)
        numbers[single] = np.array([self._group((c // len(v.b_bytes),), (c % len(v.b_bytes),)) for c in codes.tolist()], np.int64)[back]
        for k in np.flatnonzero(~single).tolist():
            numbers[k] = self._group(tuple(found[0][a_from[k] : a_to[k]]), tuple(found[1][b_from[k] : b_to[k]]))
        counts = np.diff(last + 1, prepend=0)
        self.groups.add(numbers, counts)
        texts, at = list(map(self.group_text.__getitem__, numbers.tolist())), 0
        for n in counts.tolist():
            self.segment_text.append(b";".join(texts[at : at + n]))
            at += n

    def _group(self, a: tuple, b: tuple) -> int:
        n = self.of_group[a, b]
        if n == len(self.group_text):
            self.group_text.append(b"%s|%s" % (",".join(map(str, a)).encode(), ",".join(map(str, b)).encode()))
            self.group_a.append(len(a))
            self.group_b.append(len(b))
            self.pairs.add(np.array([self.of_pair[p * len(self.v.b_bytes) + q] for p in a for q in b], np.int64), np.array([len(a) * len(b)], np.int64))
        return n


def _packed(x: np.ndarray, kind: str) -> bytes:
    return pa.compress(x.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind).astype(np.int64)


def stripe_rows(vocabularies: Vocabularies) -> int:
    """A ids of one stripe."""
    return max(1, STRIPE_CELLS // len(vocabularies.b_bytes))


#: A document has ``n`` of its groups (numbers within the batch, as differences) and their counts; a
#: batch has for each stripe ``n`` cells with counts of documents, and ``m`` links (groups, as differences, and cells).
_READ = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, batch long, stripe int, n long, m long, x binary, y binary, link_groups binary, link_cells binary"


def _read(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Rows of documents (stripe null) and of the batches' stripes, as in _READ after the id."""
    id_type = docs.schema[0].dataType
    names = ["id", *[c.split()[0] for c in _READ.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        aligner = Aligner(load(byte_path, piece_path))
        b_ids, rows = len(aligner.v.b_bytes), stripe_rows(aligner.v)
        arrow_id = to_arrow_type(id_type)
        kinds = [arrow_id, *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        ids, segments, total, number = [], [], 0, TaskContext.get().partitionId() << 24

        def finish() -> Iterator[pa.RecordBatch]:
            aligner.learn()
            groups, starts, counts = aligner.groups.arrays()
            pairs, pair_starts, pair_counts = aligner.pairs.arrays()
            of_a, of_b = np.array(aligner.group_a, np.int64), np.array(aligner.group_b, np.int64)
            wrong = np.array([t is None for t in aligner.segment_text], bool)
            segments[:] = [s[:0] if wrong[s].any() else s for s in segments]
            columns: list[list] = [[] for _ in kinds[1:]]
            seen, held, at = np.zeros(len(of_a), bool), np.zeros(len(aligner.of_pair), np.int64), 0
            by_doc: list[tuple[np.ndarray, np.ndarray]] = []
            sizes = np.array([int(counts[s].sum()) for s in segments], np.int64)
            while at < len(segments):
                # so many documents that their group occurrences fit a slice, at least one
                to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE, side="right")) + at)
                some = np.concatenate(segments[at:to]) if to > at else np.zeros(0, np.int64)
                g = groups[_flat(starts[some], counts[some])]
                doc = np.repeat(np.arange(to - at), sizes[at:to])
                keys, times = np.unique(doc * len(of_a) + g, return_counts=True)
                doc, g = keys // max(len(of_a), 1), keys % max(len(of_a), 1)
                seen[g] = True
                # each pair counts once for a document, in whichever of its groups it stands
                p = np.unique(np.repeat(doc, pair_counts[g]) * max(len(held), 1) + pairs[_flat(pair_starts[g], pair_counts[g])]) % max(len(held), 1)
                held += np.bincount(p, minlength=len(held))
                cuts = np.searchsorted(doc, np.arange(to - at + 1))
                for k in range(to - at):
                    x, t = g[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]]
                    by_doc.append((x, t))
                    n = len(x)
                    text = b";".join(map(aligner.segment_text.__getitem__, segments[at + k].tolist())) if n else b""
                    for c, value in zip(columns, (int((of_a[x] * t).sum()), int((of_b[x] * t).sum()), int(t.sum()), int((of_a[x] * of_b[x] * t).sum()), sha256(text).hexdigest() if n else ""), strict=False):
                        c.append(value)
                at = to
            local = np.cumsum(seen) - 1
            for x, t in by_doc:
                for c, value in zip(columns[5:], (number, None, len(x), None, _packed(np.diff(local[x], prepend=0), "<u4"), _packed(t, "<u4"), None, None), strict=True):
                    c.append(value)
            for a in range(0, len(ids), 2_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 2_000], arrow_id), *[pa.array(c[a : a + 2_000], k) for c, k in zip(columns, kinds[1:], strict=True)]], names=names)
            used = np.flatnonzero(seen)
            code_of = np.fromiter(aligner.of_pair, np.int64, len(aligner.of_pair))
            cells, link_group = code_of[pairs[_flat(pair_starts[used], pair_counts[used])]], np.repeat(np.arange(len(used)), pair_counts[used])
            there = np.flatnonzero(held)
            there = there[np.argsort(code_of[there])]
            out = []
            for s in np.unique(cells // (b_ids * rows)).tolist():
                base = s * b_ids * rows
                mine = there[(code_of[there] >= base) & (code_of[there] < base + b_ids * rows)]
                links = (cells >= base) & (cells < base + b_ids * rows)
                out.append([None] * 6 + [number, s, len(mine), int(links.sum()), _packed(code_of[mine] - base, "<u4"), _packed(held[mine], "<u4"), _packed(np.diff(link_group[links], prepend=0), "<u4"), _packed(cells[links] - base, "<u4")])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                ids.append(i)
                segments.append(aligner.numbers(t) if t else np.zeros(0, np.int64))
                total += len(segments[-1])
                if total >= BATCH_SEGMENTS:
                    yield from finish()
                    ids, segments, total, number = [], [], 0, number + 1
                    if len(aligner.of_segment) > REMEMBERED:
                        aligner.reset()
        if ids:
            yield from finish()

    return docs.mapInArrow(run, f"id {id_type.simpleString()}, {_READ}")


def pair_counts(stripes: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(stripe, row, n, x, y, best): of each A id (stripe, row) the B ids it is linked to, in how many documents, and the highest count.

    stripes: stripe, batch, n, x, y as in _READ.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(byte_path, piece_path)
        b_ids, now = len(v.b_bytes), None
        block = np.zeros((stripe_rows(v), b_ids), np.int64)

        def finish() -> Iterator[pa.RecordBatch]:
            rows = np.flatnonzero(block.any(1))
            found = [np.flatnonzero(block[r]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(rows), pa.int32()), pa.array(rows, pa.int32()), pa.array(map(len, found), pa.int64()), pa.array([_packed(c, "<u4") for c in found], pa.binary()), pa.array([_packed(block[r, c], "<i8") for r, c in zip(rows, found, strict=True)], pa.binary())],
                names=["stripe", "row", "n", "x", "y"],
            )
            block[rows] = 0

        for batch in batches:
            for stripe, part, n, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now not in (None, (stripe, part)):
                    yield from finish()
                now = (stripe, part)
                np.add.at(block.reshape(-1), _unpacked(x, n, "<u4"), _unpacked(y, n, "<u4"))
        if now is not None:
            yield from finish()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, now = np.zeros(len(load(byte_path, piece_path).b_bytes), np.int64), None
        names = ["stripe", "row", "n", "x", "y", "best"]

        def finish() -> list:
            c = np.flatnonzero(line)
            row = [*now, len(c), _packed(c, "<u4"), _packed(line[c], "<i8"), int(line.max())]
            line[c] = 0
            return row

        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        for batch in batches:
            out = []
            for stripe, row, n, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now not in (None, (stripe, row)):
                    out.append(finish())
                now = (stripe, row)
                np.add.at(line, _unpacked(x, n, "<u4"), _unpacked(y, n, "<i8"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(finish(), kinds, strict=True)], names=names)

    dealt = _dealt(stripes).select("stripe", "part", "n", "x", "y").repartition("stripe", "part").sortWithinPartitions("stripe", "part")
    blocks = dealt.mapInArrow(add, "stripe int, row int, n long, x binary, y binary")
    return blocks.repartition("stripe", "row").sortWithinPartitions("stripe", "row").mapInArrow(join, "stripe int, row int, n long, x binary, y binary, best long")


def _dealt(stripes: DataFrame) -> DataFrame:
    """With ``part``: a stripe's batches dealt to tasks of about FAN_IN batches."""
    parts = stripes.groupBy("stripe").agg(F.ceil(F.count(F.lit(1)) / FAN_IN).alias("parts"))
    return stripes.join(parts, "stripe").withColumn("part", F.pmod(F.xxhash64("batch"), F.col("parts")).cast("int"))


def _scored(stripes: DataFrame, counts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(batch, n, groups, best, sums): of the batches' groups, how many links are the best of their A id, and the sum of their counts, a row a stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(byte_path, piece_path)
        block, best, now = np.zeros((stripe_rows(v), len(v.b_bytes)), np.int64), np.zeros(stripe_rows(v), np.int64), None
        filled: set[int] = set()
        for batch in batches:
            out = []
            for stripe, part, which, n, x, y, top in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != (stripe, part):
                    block[list(filled)] = 0
                    filled.clear()
                    now = (stripe, part)
                if top is not None:
                    # the block's rows come before the links
                    row = -1 - which
                    block[row, _unpacked(x, n, "<u4")] = _unpacked(y, n, "<i8")
                    best[row] = top
                    filled.add(row)
                    continue
                group, cells = np.cumsum(_unpacked(x, n, "<u4")), _unpacked(y, n, "<u4")
                count = block.reshape(-1)[cells]
                first = np.flatnonzero(np.diff(group, prepend=-1))
                out.append((which, len(first), _packed(group[first], "<u4"), _packed(np.add.reduceat((count == best[cells // block.shape[1]]).astype(np.int64), first), "<i8"), _packed(np.add.reduceat(count, first), "<i8")))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["batch", "n", "x", "y", "z"])

    dealt = _dealt(stripes)
    parts = dealt.select("stripe", "part").distinct()
    # rows of the block have negative numbers, so that they come first
    rows = counts.join(parts, "stripe").select("stripe", "part", (F.lit(-1) - F.col("row")).cast("long").alias("which"), "n", "x", "y", "best")
    links = dealt.where("m > 0").select("stripe", "part", F.col("batch").alias("which"), F.col("m").alias("n"), F.col("link_groups").alias("x"), F.col("link_cells").alias("y"), F.lit(None).cast("long").alias("best"))
    both = rows.union(links).repartition("stripe", "part").sortWithinPartitions("stripe", "part", "which")
    return both.mapInArrow(run, "batch long, n long, x binary, y binary, z binary")


def _sums(docs: DataFrame, scores: DataFrame, id_col: str) -> DataFrame:
    """The documents' results: the scores of a batch's groups come before its documents."""
    id_type = docs.schema["id"].dataType
    plain = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, sums = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            here, n_best, count_sum = [], [], []
            columns = {c: batch.column(c).to_pylist() for c in ("batch", "kind", "n", "x", "y", "z")}
            for k, (number, kind, n, x, y, z) in enumerate(zip(*columns.values(), strict=True)):
                if number != now:
                    now, best, sums = number, best[:0], sums[:0]
                if kind == 0:
                    groups = _unpacked(x, n, "<u4")
                    if len(groups) and groups[-1] >= len(best):
                        best, sums = (np.concatenate([old, np.zeros(int(groups[-1]) + 1 - len(old), np.int64)]) for old in (best, sums))
                    best[groups] += _unpacked(y, n, "<i8")
                    sums[groups] += _unpacked(z, n, "<i8")
                    continue
                groups, times = np.cumsum(_unpacked(x, n, "<u4")), _unpacked(y, n, "<u4")
                here.append(k)
                n_best.append(int((best[groups] * times).sum()))
                count_sum.append(int((sums[groups] * times).sum()))
            if here:
                rows = batch.take(pa.array(here, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column("id"), *[rows.column(c) for c in plain], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), rows.column("groups_sha256")], names=[id_col, *plain, "n_best", "count_sum", "groups_sha256"])

    ours = docs.select("batch", F.lit(1).alias("kind"), "id", *plain, "groups_sha256", "n", "x", "y", F.lit(None).cast("binary").alias("z"))
    theirs = scores.select("batch", F.lit(0).alias("kind"), "n", "x", "y", "z")
    both = ours.unionByName(theirs, allowMissingColumns=True).repartition("batch").sortWithinPartitions("batch", "kind")
    longs = ", ".join(f"{c} long" for c in (*plain, "n_best", "count_sum"))
    return both.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, {longs}, groups_sha256 string")


def _stages(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    read = stored(_read(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), byte_path, piece_path))
    stripes = read.where("stripe is not null").select("stripe", "batch", "n", "m", "x", "y", "link_groups", "link_cells")
    return read.where("stripe is null"), stripes, stored(pair_counts(stripes.select("stripe", "batch", "n", "x", "y"), byte_path, piece_path))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256, one row a document.

    byte_path, piece_path: the vocabularies; every executor must have them at that place.
    """
    read, stripes, counts = _stages(docs, byte_path, piece_path, id_col, text_col)
    scores = _scored(stripes, counts, byte_path, piece_path)
    return _sums(read, scores, id_col)


def links(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text") -> DataFrame:
    """(a_id, b_id, documents, best): all pairs of ids that any document links, in how many, and whether that is the A id's highest."""
    counts = _stages(docs.select(F.lit(0).alias("id"), text_col), byte_path, piece_path, "id", text_col)[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = stripe_rows(load(byte_path, piece_path))
        for batch in batches:
            for stripe, row, n, x, y, top in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                documents = _unpacked(y, n, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, stripe * rows + row)), pa.array(_unpacked(x, n, "<u4")), pa.array(documents), pa.array(documents == top)], names=["a_id", "b_id", "documents", "best"])

    return counts.mapInArrow(run, "a_id long, b_id long, documents long, best boolean")
