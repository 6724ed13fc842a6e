"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

``encode`` turns texts into token ids with byte and character offsets, ``decode``
turns ids back into bytes and text.  The vocabulary is a rank file (one base64
token and its rank a line); merges are derived from the ranks, so the ids are those
that a rank-ordered byte-pair encoder gives.  With the built-in pattern a match never goes
on into white space, so a text is cut before it and the library encodes each distinct run once in a
worker (of the first ``CACHE`` met, any other as often as it stands).

Defined results: a null text counts as empty and has no tokens; long texts are
encoded whole; repeated rows give repeated results; an empty table gives an empty
table; columns other than the id and the text are not read, so their names can't clash.
An id outside the vocabulary decodes to nothing; bytes that are not UTF-8 (a character
split between tokens that are not all there) become U+FFFD in ``text`` and stay as they are in ``bytes``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the pattern that the library's byte-level pre-tokenizer has built in, several times faster than one given to it.
BUILT_IN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose tokens a worker remembers, some 250 bytes each: the first ones met, among them all frequent ones.
CACHE = 100_000

#: Characters of a batch's texts that are encoded at once.
SLICE = 150_000

#: White space with what follows it up to the next.  A match of BUILT_IN has white space at its beginning only, and looks no farther than the run of it.
RUN = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
SPACE = "\t\n\x0b\x0c\r "
#: Other characters that are white space, or were: a text with one of them isn't cut.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Runs of more characters aren't remembered.
LONGEST_RUN = 40

_loaded: dict[tuple[str, str], "ByteBpe"] = {}


def byte_characters() -> dict[int, str]:
    """The usual byte-to-character table: printable Latin-1 bytes stand for themselves, the others for U+0100 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe:
    """One vocabulary in one Python worker."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.characters = byte_characters()
        shown = {t: "".join(map(self.characters.__getitem__, t)) for t in self.ranks}
        merges = [tuple(map(shown.__getitem__, self._parts(t))) for t in self.tokens if len(t) > 1]
        model = models.BPE({shown[t]: r for t, r in self.ranks.items()}, merges, cache_capacity=CACHE)
        self.tokenizer = Tokenizer(model)
        if pattern == BUILT_IN:
            self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        else:
            self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ])
        self.cuts = pattern == BUILT_IN
        #: ids of runs, as little-endian 32-bit integers
        self.met: dict[str, bytes] = {}
        self.sizes = np.array(list(map(len, self.tokens)))
        self.token_bytes = pa.array(self.tokens, pa.binary())

    def _parts(self, token: bytes) -> list[bytes]:
        """The two tokens that the last merge joins: pairs of lower rank than the token's own are merged first."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], 1 << 60))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def runs(self, text: str) -> list[str]:
        """Parts of the text that have the ids they have inside it."""
        return RUN.findall(text) if self.cuts and (text.isascii() and text.isprintable() or not OTHER_SPACE.search(text)) else [text] if text else []

    def _encoded(self, runs: list[str]) -> Iterator[tuple[str, bytes]]:
        """Runs with their ids.  Those that begin with white space and don't end with it are encoded as one text, whose matches are theirs."""
        together = [run for run in runs if self.cuts and run[0] in SPACE and run[-1] not in SPACE and not OTHER_SPACE.match(run[-1])]
        ids = np.array(self.encode(["".join(together)])[0], "<i4")
        at, ends = np.cumsum(self.sizes[ids]), np.cumsum([len(run.encode()) for run in together])
        upto = np.searchsorted(at, ends) + 1
        if len(together) and np.array_equal(at[upto - 1], ends):
            raw, upto = ids.tobytes(), (4 * upto).tolist()
            yield from zip(together, (raw[a:b] for a, b in zip([0, *upto], upto)))
            done = set(together)
            runs = [run for run in runs if run not in done]
        yield from zip(runs, (np.array(x, "<i4").tobytes() for x in self.encode(runs)), strict=True)

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one text after another, and where each text's begin (and the last one's end)."""
        parts = list(map(self.runs, texts))
        known = self.met
        fresh = list(set().union(*parts) - known.keys())
        room = CACHE - len(known)
        known.update(self._encoded(fresh))
        raw = [b"".join(map(known.__getitem__, own)) for own in parts]
        for run in fresh:
            if len(run) > LONGEST_RUN or not room:
                del known[run]
            else:
                room -= 1
        return np.frombuffer(b"".join(raw), "<i4"), np.cumsum([0, *map(len, raw)]) // 4

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> list[memoryview]:
        """Bytes of the runs of ids, all of the vocabulary, that begin (and the last one ends) at the given places."""
        if not len(ids):
            return [memoryview(b"")] * (len(at) - 1)
        out = self.token_bytes.take(pa.array(ids))
        ends = np.frombuffer(out.buffers()[1], np.int32)[at]
        raw = memoryview(out.buffers()[2] or b"")
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """Byte and character offset of each token's start; a token that starts inside a character has that character's offset."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        starts = np.cumsum([0, *(len(self.tokens[i]) for i in ids)])[:-1]
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return starts.tolist(), character[starts].tolist() if len(ids) else []

    def decode(self, ids) -> bytes:
        known = len(self.tokens)
        return b"".join([self.tokens[i] for i in ids if i is not None and 0 <= i < known])


def load(path: str, pattern: str) -> ByteBpe:
    """The vocabulary, read once in each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """Where runs of about ``most`` characters begin, and their texts (null: empty), so that a few of a batch's texts are in memory at once besides it."""
    start = total = 0
    part: list[str] = []
    for k, text in enumerate(texts):
        part.append(text.as_py() or "")
        total += len(part[-1]) + 100
        if total >= most:
            yield start, part
            start, total, part = k + 1, 0, []
    if part:
        yield start, part


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))


def _returned() -> None:
    """Memory that a finished task's batches took goes back to the system, as the worker waits beside tasks that need none of it."""
    pa.default_memory_pool().release_unused()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """One row a document: id, ``ids`` array<int>, with ``offsets`` also ``byte_starts`` and ``char_starts``.

    path: the rank file; every executor must have it at that place.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + (", byte_starts array<int>, char_starts array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for a, texts in _slices(batch.column(1), SLICE):
                ids, at = bpe.joined(texts)
                columns = [batch.column(0).slice(a, len(texts)), _lists(ids, at)]
                if offsets:
                    both = [bpe.offsets(t, ids[b:c].tolist()) for t, b, c in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    columns += [pa.array([x[k] for x in both], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "byte_starts", "char_starts"][: len(columns)])
        batch = columns = ids = None
        _returned()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row a list of ids: id, ``bytes`` binary, ``text`` string."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            raw = [bpe.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())], names=[id_col, "bytes", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``encode`` and ``decode`` in one pass, with digests of the lists and, if asked for, ``ids`` array<int>.

    id, ``n_tokens`` long, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit
    integers) and ``decoded_sha256`` (of the decoded bytes), lowercase hex.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        bpe = load(path, pattern)
        for batch in batches:
            for a, texts in _slices(batch.column(1), SLICE):
                ids, at = bpe.joined(texts)
                # no id is negative, so that signed and unsigned are the same bytes
                digests = [sha256(ids[b:c]).hexdigest() for b, c in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                decoded = [sha256(x).hexdigest() for x in bpe.decoded(ids, at)]
                columns = [batch.column(0).slice(a, len(texts)), pa.array(np.diff(at), pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                columns += [_lists(ids, at)] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
        batch = columns = ids = None
        _returned()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
