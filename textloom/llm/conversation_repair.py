"""Conversation structure repair by Dial's bucket-queue shortest paths.

A conversation's turns must read ``(system? (user assistant)+)?`` by the initials of their roles.
Keep, Rerole, Delete and Insert change it into one that does, at small whole costs: 0 for Keep, 3
for Rerole (to user or assistant), 4 for Delete, 3 for Insert (an empty user or assistant turn), and 3 more for a
truncated turn that stays.  Blank and duplicate turns must go.

Paths.  A node is (turns read, state of the pattern); an edit is an arc.  Distances to the end are
found backwards with Dial's queue: a ring of buckets, one for each distance that may be pending.  A walk from the start
then takes the arc of the least initial among the tight ones (Delete, Insert, Keep, Rerole), which
gives the ASCII-least of the cheapest audits; as the state says what a turn must become, the audit fixes the repair.

Spark.  Conversations of up to ``LONG_ROWS`` rows and ``LONG_CHARACTERS`` characters are dealt by id and streamed, one in memory
at a time.  Longer ones are cut into segments of ``SEGMENT`` rows in order: each segment's distances between its
states are a 4 x 4 matrix, matrices are chained to the distances at each segment's end, walks from all
four states are chained to the state at each segment's start, and segments are then repaired by themselves.  Duplicates
in them are found by grouping.  Only a SHA-256, which can't be computed in parts, streams a
long conversation's repaired pieces through one task, a piece in memory at a time.

Defined results: a null role or text is one space, and so is a null id or turn where a row's damage is chosen; rows go by turn,
nulls first, and within a turn by role and then by the text's SHA-256; rows with a null id are one conversation; an empty
table gives an empty table; only the four columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm._text import stored

#: Rows and characters up to which a conversation is repaired as a whole, and rows of a longer one's segments.
LONG_ROWS, LONG_CHARACTERS, SEGMENT = 2_000, 8_000_000, 2_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Long conversations whose ids are sent to every executor; beyond, rows are shuffled to meet them.
SENT_IDS = 1 << 20

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What a turn becomes that is inserted or gets another role, by the state before it.
BECOMES = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
FINE, CUT_OFF, MUST_GO = range(3)
#: Buckets of the ring: more than the highest cost of an arc and than the ends' distances differ.
RING = 32
FAR = 1 << 60
#: Distances at the end of a conversation: it may end before any turn or after an assistant's.
ENDS = (0, FAR, FAR, 0)

Turn = tuple[str, int]


def _arcs(initial: str, kind: int) -> list[list[tuple[int, int]]]:
    """For each state after a turn the (state before, cost) of the arcs that lead there."""
    out: list[list[tuple[int, int]]] = [[(q, DELETE)] for q in range(4)]
    if kind != MUST_GO:
        more = TRUNCATED if kind == CUT_OFF else 0
        for p in range(4):
            if (p, initial) in FOLLOWS:
                out[FOLLOWS[p, initial]].append((p, KEEP + more))
            out[BECOMES[p]].append((p, REROLE + more))
    return out


_ARCS = {(i, k): _arcs(i, k) for i in ("s", "u", "a", "") for k in (FINE, CUT_OFF, MUST_GO)}
_INSERTED = [[p for p in range(4) if BECOMES[p] == q] for q in range(4)]


def distances(turns: list[Turn], ends: Iterable[int] = ENDS) -> list[int]:
    """The least cost from node 4 * turns read + state to the end, where the states' own distances are ``ends``.

    turns: initial of the role ('' for any other than s, u, a) and kind.
    """
    last = 4 * len(turns)
    found, ring, pending = [FAR] * (last + 4), [[] for _ in range(RING)], 0
    for q, d in enumerate(ends):
        if d < FAR:
            found[last + q] = d
            ring[d % RING].append(last + q)
            pending += 1
    now = min(found[last:])
    into = [_ARCS[t] for t in turns]
    while pending:
        bucket = ring[now % RING]
        while bucket:
            node = bucket.pop()
            pending -= 1
            if found[node] != now:
                continue
            layer, q = node >> 2, node & 3
            for p in _INSERTED[q]:
                before, d = (layer << 2) + p, now + INSERT
                if d < found[before]:
                    found[before] = d
                    ring[d % RING].append(before)
                    pending += 1
            if layer:
                for p, cost in into[layer - 1][q]:
                    before, d = node - q - 4 + p, now + cost
                    if d < found[before]:
                        found[before] = d
                        ring[d % RING].append(before)
                        pending += 1
        now += 1
    return found


def walk(turns: list[Turn], found: list[int], state: int = START, to_end: bool = True) -> tuple[str, list[int], int]:
    """The ASCII-least audit along tight arcs, the state after each edit, and the last state.

    A walk that isn't to the end stops as soon as all turns are read.
    """
    at, n, audit, states = 0, len(turns), [], []
    while at < n or (to_end and found[4 * at + state]):
        d = found[4 * at + state]
        if at < n and found[4 * at + 4 + state] + DELETE == d:
            audit.append("D")
            at += 1
        elif found[4 * at + BECOMES[state]] + INSERT == d:
            audit.append("I")
            state = BECOMES[state]
        else:
            initial, kind = turns[at]
            more = TRUNCATED if kind == CUT_OFF else 0
            kept = FOLLOWS.get((state, initial))
            if kept is not None and found[4 * at + 4 + kept] + KEEP + more == d:
                audit.append("K")
                state = kept
            else:
                audit.append("R")
                state = BECOMES[state]
            at += 1
        states.append(state)
    return "".join(audit), states, state


def repaired(audit: str, states: list[int], said: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that the edits leave."""
    turns = iter(said)
    for edit, state in zip(audit, states, strict=True):
        role, text = (ROLE[state], "") if edit == "I" else next(turns)
        if edit != "D":
            yield (ROLE[state] if edit == "R" else role), text


def initial_of(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


# ---------------------------------------------------------------- rows


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with faults chosen by the CRC-32 of ``id:turn``, and ``copies`` (0: dropped, 2: repeated adjacently)."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, turn_col)])
    fault = F.crc32(F.encode(place, "UTF-8")) % 20
    role, text = F.coalesce(role_col, F.lit(" ")), F.coalesce(text_col, F.lit(" "))
    return rows.select(
        F.col(id_col),
        F.col(turn_col),
        F.when(fault == 4, F.lit("user")).otherwise(role).alias(role_col),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _plain(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, copies: Column) -> DataFrame:
    """(id, turn, role, text, copies, blank, cut, sha)."""
    role, text = F.coalesce(role_col, F.lit(" ")), F.coalesce(text_col, F.lit(" "))
    named = rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return named.select("*", blank.alias("blank"), (~blank & cut).alias("cut"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))


def _fold(rows: list[tuple]) -> tuple[list[tuple[str, str]], list[Turn], tuple[int, int, int, int, int]]:
    """Turns of one conversation in order, what they are, and gaps, blank, duplicate, truncated, illegal.

    rows: (turn, role, text, copies, blank, cut).
    """
    said, turns, seen, numbers, counts, illegal, before = [], [], set(), set(), [0, 0, 0], 0, None
    for turn, role, text, copies, blank, cut in rows:
        if copies and turn is not None:
            numbers.add(turn)
        for _ in range(copies):
            again = (role, text) in seen
            seen.add((role, text))
            kind = MUST_GO if blank or again else CUT_OFF if cut else FINE
            for k, yes in enumerate((blank, again and not blank, kind == CUT_OFF)):
                counts[k] += yes
            illegal += before is not None and before + role[:1] not in LEGAL
            before = role[:1]
            said.append((role, text))
            turns.append((initial_of(role), kind))
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return said, turns, (gaps, *counts, illegal)


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = ", ".join(f"{c} long" for c in _NUMBERS) + ", audit string"
Mended = Callable[[object, list[tuple[str, str]], str, list[int], tuple[int, ...]], list[tuple]]


def _short(rows: DataFrame, schema: str, kinds: list[pa.DataType], emit: Mended) -> DataFrame:
    """Whole conversations, one at a time: ``emit`` gets id, turns, audit, states and numbers, and gives result rows (after the id)."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = rows.schema["id"].dataType
    arrow, names = [to_arrow_type(id_type), *kinds], ["id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def finish() -> list[tuple]:
            said, turns, numbers = _fold(held)
            found = distances(turns)
            audit, states, _ = walk(turns, found)
            return [(now[0], *r) for r in emit(now[0], said, audit, states, (*numbers, found[START]))]

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), arrow, strict=True)], names=names)

        for batch in batches:
            out = []
            for i, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is not None and i != now[0]:
                    out += finish()
                    held = []
                now = (i,)
                held.append(tuple(row))
            if out:
                yield table(out)
        if now is not None and (out := finish()):
            yield table(out)

    sort = [F.col("id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]
    sent = rows.repartition("id").sortWithinPartitions(*sort).select("id", "turn", "role", "text", "copies", "blank", "cut")
    return sent.mapInArrow(run, f"id {id_type.simpleString()}, {schema}")


# ---------------------------------------------------------------- long conversations


def _ordered(rows: DataFrame) -> DataFrame:
    """(key, part, seg, turn, role, text, blank, again, kind, initial) of long conversations: segments by range, in order of (part, seg), stored."""
    same = ["key", "turn", "role", "sha"]
    one = rows.groupBy(*same).agg(F.sum("copies").alias("copies"), F.first("text").alias("text"), F.first("blank").alias("blank"), F.first("cut").alias("cut")).where("copies > 0")
    first = one.groupBy("key", "role", "sha").agg(F.min(F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))).alias("first"))
    told = one.join(first, ["key", "role", "sha"])
    # a turn's first copy is a duplicate only if its role and text were said at an earlier turn
    told = told.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("again", ~F.col("first.turn").eqNullSafe(F.col("turn")) | (F.col("k") > 1))
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha"), F.col("k")]
    ranged = told.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = F.when(F.col("blank") | F.col("again"), MUST_GO).when(F.col("cut"), CUT_OFF).otherwise(FINE)
    wanted = ranged.select("key", "turn", "role", "text", "blank", "again", kind.alias("kind"))
    size = SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, key, seg, at = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            segs, places = [], []
            for k in batch.column("key").to_pylist():
                if k != key or at == size:
                    key, seg, at = k, seg + 1, 0
                segs.append(seg)
                places.append(at)
                at += 1
            n = len(segs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int64()), pa.array(segs, pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "seg", "at"])

    return stored(wanted.mapInArrow(run, "key string, turn long, role string, text string, blank boolean, again boolean, kind int, part long, seg long, at long"))


def _turns(table: pa.Table) -> list[Turn]:
    return [(initial_of(r), k) for r, k in zip(table["role"].to_pylist(), table["kind"].to_pylist(), strict=True)]


def _matrix(key: tuple, table: pa.Table) -> pa.Table:
    """A segment's distances from each state at its start to each at its end, and its illegal neighbours."""
    table = table.sort_by("at")
    turns = _turns(table)
    costs = [distances(turns, [0 if q == e else FAR for q in range(4)])[:4] for e in range(4)]
    initials = [r[:1] for r in table["role"].to_pylist()]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return pa.table({c: [v] for c, v in zip(("key", "part", "seg", "first", "last", "illegal", "costs"), (*[k.as_py() for k in key], initials[0], initials[-1], illegal, [costs[e][q] for q in range(4) for e in range(4)]), strict=True)})


def _ends(key: tuple, table: pa.Table) -> pa.Table:
    """Distances at each segment's end, from the last one back; the first row has the conversation's cost and illegal neighbours."""
    rows = table.sort_by([("part", "ascending"), ("seg", "ascending")]).to_pylist()
    # at the end itself, turns may still be inserted
    ends, out = distances([], ENDS), []
    for r in reversed(rows):
        out.append({"key": r["key"], "part": r["part"], "seg": r["seg"], "ends": ends, "is_last": not out, "cost": 0, "illegal": 0})
        ends = [min(r["costs"][4 * q + e] + ends[e] for e in range(4)) for q in range(4)]
    out[-1]["cost"] = ends[START]
    out[-1]["illegal"] = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    return pa.Table.from_pylist(out, schema=_ENDS_SCHEMA)


_ENDS_SCHEMA = pa.schema([("key", pa.string()), ("part", pa.int64()), ("seg", pa.int64()), ("ends", pa.list_(pa.int64())), ("is_last", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64())])


def _exits(key: tuple, table: pa.Table) -> pa.Table:
    """The state at a segment's end for each at its start."""
    table = table.sort_by("at")
    turns, last = _turns(table), table["is_last"][0].as_py()
    found = distances(turns, table["ends"][0].as_py())
    part, seg = key[1].as_py(), key[2].as_py()
    return pa.table({"key": [key[0].as_py()], "part": [part], "seg": [seg], "exits": [[walk(turns, found, q, last)[2] for q in range(4)]]})


def _entries(key: tuple, table: pa.Table) -> pa.Table:
    """The state at each segment's start, from the first one on."""
    state, out = START, []
    for r in table.sort_by([("part", "ascending"), ("seg", "ascending")]).to_pylist():
        out.append({"key": r["key"], "part": r["part"], "seg": r["seg"], "entry": state})
        state = r["exits"][state]
    return pa.Table.from_pylist(out, schema=pa.schema([("key", pa.string()), ("part", pa.int64()), ("seg", pa.int64()), ("entry", pa.int64())]))


def _pieces(key: tuple, table: pa.Table) -> pa.Table:
    """A segment's audit, and the roles and texts it leaves."""
    table = table.sort_by("at")
    turns = _turns(table)
    found = distances(turns, table["ends"][0].as_py())
    audit, states, _ = walk(turns, found, table["entry"][0].as_py(), table["is_last"][0].as_py())
    left = list(repaired(audit, states, zip(table["role"].to_pylist(), table["text"].to_pylist(), strict=True)))
    part, seg = key[1].as_py(), key[2].as_py()
    return pa.table({"key": [key[0].as_py()], "part": [part], "seg": [seg], "audit": [audit], "roles": pa.array([[r for r, _ in left]], pa.list_(pa.string())), "texts": pa.array([[t for _, t in left]], pa.list_(pa.string()))})


def _long_pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, part, seg, audit, roles, texts) of the segments of long conversations, and (key, the numbers) of these."""
    where = ["key", "part", "seg"]
    placed = _ordered(rows)
    bare = placed.select(*where, "at", "role", "kind")
    matrices = bare.groupBy(*where).applyInArrow(_matrix, "key string, part long, seg long, first string, last string, illegal long, costs array<long>")
    ends = stored(matrices.groupBy("key").applyInArrow(_ends, "key string, part long, seg long, ends array<long>, is_last boolean, cost long, illegal long"))
    bound = ends.select(*where, "ends", "is_last")
    exits = bare.join(bound, where).groupBy(*where).applyInArrow(_exits, "key string, part long, seg long, exits array<long>")
    entries = stored(exits.groupBy("key").applyInArrow(_entries, "key string, part long, seg long, entry long"))
    pieces = placed.select(*where, "at", "role", "text", "kind").join(bound.join(entries, where), where)
    pieces = pieces.groupBy(*where).applyInArrow(_pieces, "key string, part long, seg long, audit string, roles array<string>, texts array<string>")
    count = lambda c: F.count_if(c).alias
    turns = placed.groupBy("key", "turn").agg(count(F.col("blank"))("blank"), count(F.col("again") & ~F.col("blank"))("duplicate"), count(F.col("kind") == CUT_OFF)("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    numbers = turns.groupBy("key").agg(gaps, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    totals = ends.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    return pieces, numbers.join(totals, "key").select("key", *_NUMBERS)


def _digested(pieces: DataFrame) -> DataFrame:
    """(key, audit, repaired_sha256): pieces of a long conversation stream by in order, one in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audits, digest, some = None, [], sha256(), False
        names = ["key", "audit", "repaired_sha256"]
        for batch in batches:
            for key, audit, roles, texts in zip(*[batch.column(c) for c in ("key", "audit", "roles", "texts")], strict=True):
                if now is not None and key.as_py() != now:
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (now, "".join(audits), digest.hexdigest())], names=names)
                    audits, digest, some = [], sha256(), False
                now = key.as_py()
                audits.append(audit.as_py())
                for role, text in zip(roles.as_py(), texts.as_py(), strict=True):
                    digest.update((b"\n" if some else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    some = True
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (now, "".join(audits), digest.hexdigest())], names=names)

    return pieces.repartition("key").sortWithinPartitions("key", "part", "seg").mapInArrow(run, "key string, audit string, repaired_sha256 string")


# ---------------------------------------------------------------- the operator


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of short conversations, those of long ones with ``key``, and the (id, key) of these; None where there is none."""
    # a null id is a conversation as well
    key = F.when(F.col("id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("key")
    sizes = rows.groupBy("id").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"), F.sum(F.char_length("text") * F.greatest("copies", F.lit(1))).alias("chars"))
    long = stored(sizes.where((F.col("n") > LONG_ROWS) | (F.col("chars") > LONG_CHARACTERS)).select("id", key))
    n = long.count()
    if not n:
        return rows, None, None
    small = F.broadcast(long.select("key")) if n <= SENT_IDS else long.select("key")
    keyed = rows.select("*", key)
    return keyed.join(small, "key", "left_anti").drop("key"), keyed.join(small, "key", "left_semi"), long


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """A row a conversation: id, gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256.

    copies: how often a row stands in its conversation; a conversation without any turn has zeros and an empty audit.
    """
    plain = _plain(rows, id_col, turn_col, role_col, text_col, F.lit(1) if copies is None else copies)
    short, long, ids = _split(plain)

    def emit(_, said, audit, states, numbers) -> list[tuple]:
        text = "\n".join(f"{r}:{t}" for r, t in repaired(audit, states, said))
        return [(*numbers, audit, sha256(text.encode("utf-8", "surrogatepass")).hexdigest())]

    out = _short(short, f"{_RESULT}, repaired_sha256 string", [*[pa.int64()] * 6, pa.string(), pa.string()], emit)
    if long is not None:
        pieces, numbers = _long_pieces(long)
        # long conversations all of whose rows were dropped have no segments
        told = ids.join(numbers, "key", "left").join(_digested(pieces), "key", "left")
        empty = sha256(b"").hexdigest()
        out = out.union(told.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in _NUMBERS], F.coalesce("audit", F.lit("")), F.coalesce("repaired_sha256", F.lit(empty))))
    return out.withColumnRenamed("id", id_col)


def repaired_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """The repaired conversations: id, position (long, from 0, in order but with gaps in long conversations), role, text."""
    plain = _plain(rows, id_col, turn_col, role_col, text_col, F.lit(1) if copies is None else copies)
    short, long, ids = _split(plain)

    def emit(_, said, audit, states, numbers) -> list[tuple]:
        return [(k, r, t) for k, (r, t) in enumerate(repaired(audit, states, said))]

    out = _short(short, "position long, role string, text string", [pa.int64(), pa.string(), pa.string()], emit)
    if long is not None:
        pieces, _ = _long_pieces(long)
        lines = pieces.select("key", "part", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "line"))
        # an insert may follow each turn, and one a segment; part and seg are far below 2**20 and 2**31
        position = F.shiftleft(F.col("part"), 43) + F.shiftleft(F.col("seg"), 13) + F.col("at")
        out = out.union(lines.join(ids, "key").select("id", position, "line.roles", "line.texts"))
    return out.select(F.col("id").alias(id_col), F.col("position"), F.col("role").alias(role_col), F.col("text").alias(text_col))


def oracle_sql() -> str:
    """DuckDB SQL for the query over ``conversations``: the cheapest and least audits from the last turn back, by recursion over turns."""
    crc = "xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295)"
    plus = lambda cost, edit, rest: f"struct_pack(c := {rest}.c + {cost}, a := '{edit}' || {rest}.a)"
    far = f"struct_pack(c := {FAR}::BIGINT, a := '')"

    def after(q: int) -> str:
        """What a turn's own edits cost in a state, before inserts."""
        more = f"CASE n.kind WHEN 1 THEN {TRUNCATED} ELSE 0 END"
        keeps = [f"CASE WHEN n.kind < 2 AND n.i = '{i}' THEN {plus(f'{KEEP} + {more}', 'K', f'r.v{to}')} ELSE {far} END" for (p, i), to in FOLLOWS.items() if p == q]
        rerole = f"CASE WHEN n.kind < 2 THEN {plus(f'{REROLE} + {more}', 'R', f'r.v{BECOMES[q]}')} ELSE {far} END"
        return f"list_min([{', '.join([plus(DELETE, 'D', f'r.v{q}'), rerole, *keeps])}])"

    def inserted(of: str) -> str:
        u, a = f"list_min([{of}{USER}, {plus(INSERT, 'I', f'{of}{ASSISTANT}')}])", f"list_min([{of}{ASSISTANT}, {plus(INSERT, 'I', f'{of}{USER}')}])"
        return f"{of}{START} AS w0, {of}{SYSTEM} AS w1, {u} AS v2, {a} AS v3"

    starts = lambda s: f"SELECT conv_id, left_, list_min([w0, {plus(INSERT, 'I', 'v2')}]) AS v0, list_min([w1, {plus(INSERT, 'I', 'v2')}]) AS v1, v2, v3 FROM ({s})"
    ends = ", ".join(f"struct_pack(c := {0 if q in (START, ASSISTANT) else FAR}::BIGINT, a := '') AS e{q}" for q in range(4))
    return rf"""
        WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS fault
                  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
             d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                          unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
             o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS nth, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
             k AS (SELECT *, left(role, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 AS again FROM o),
             t AS MATERIALIZED (SELECT *, CASE WHEN blank OR again THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 1 ELSE 0 END AS kind,
                          coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY nth) || i NOT IN ('su', 'ua', 'au'), false) AS illegal FROM k),
             b AS (SELECT DISTINCT c.conv_id, coalesce(n, 0) AS left_ FROM conversations c LEFT JOIN (SELECT DISTINCT conv_id, n FROM o) s ON s.conv_id IS NOT DISTINCT FROM c.conv_id),
             r AS ({starts(f"SELECT conv_id, left_, {inserted('e')} FROM (SELECT *, {ends} FROM b)")}
                   UNION ALL
                   {starts(f"SELECT conv_id, left_, {inserted('x')} FROM (SELECT r.conv_id, r.left_ - 1 AS left_, " + ", ".join(f"{after(q)} AS x{q}" for q in range(4)) + " FROM r JOIN t n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.nth = r.left_)")}),
             w AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM r WHERE left_ = 0),
             e AS (SELECT conv_id, edit, p, sum((edit <> 'I')::INT) OVER s AS nth, sum((edit <> 'D')::INT) OVER s AS kept FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(len(audit))) AS p FROM w WHERE audit <> '') WINDOW s AS (PARTITION BY conv_id ORDER BY p)),
             l AS (SELECT e.*, t.role, t.text, max((kept = 1 AND edit = 'K' AND t.i = 's')::INT) OVER (PARTITION BY e.conv_id) AS system FROM e LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.nth = e.nth AND edit <> 'I' WHERE edit <> 'D'),
             g AS (SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN (kept - system) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS said FROM l GROUP BY conv_id),
             s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum((again AND NOT blank)::INT) AS duplicate, sum((kind = 1)::INT) AS truncated, sum(illegal::INT) AS illegal FROM t GROUP BY conv_id)
        SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               cost::BIGINT AS cost, audit, sha256(coalesce(said, '')) AS repaired_sha256
        FROM w LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id
    """
