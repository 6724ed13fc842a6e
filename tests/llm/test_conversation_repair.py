import re
from collections import defaultdict
from functools import cache
from hashlib import sha256
from itertools import product
from random import Random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from textloom.llm import conversation_repair as c

SPACE = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def by_definition(rows):
    """Result of one conversation: rows (turn, role, text) in order."""
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        blank, again = not text.strip(SPACE), (role, text) in seen
        seen.add((role, text))
        cut = not blank and not again and text.rstrip(SPACE)[-1] not in ".!?"
        for k, yes in enumerate((blank, again and not blank, cut)):
            counts[k] += yes
        kinds.append(2 if blank or again else int(cut))
    n, steps = len(rows), {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(at, after, inserts):
        """(cost, audit, new role initials) to the end; ``after`` is the initial of the turn before."""
        out = [(0, "", "")] if at == n and after in ("", "a") else []
        new = "a" if after == "u" else "u"
        if inserts < 4:
            out.append(plus(3, "I", new, best(at, new, inserts + 1)))
        if at < n:
            out.append(plus(4, "D", "", best(at + 1, after, 0)))
            if kinds[at] < 2:
                more, own = 3 * kinds[at], rows[at][1][:1]
                out.append(plus(3 + more, "R", new, best(at + 1, new, 0)))
                if own and own in steps[after]:
                    out.append(plus(more, "K", own, best(at + 1, own, 0)))
        return min(out, default=(1 << 40, "", ""))

    def plus(cost, edit, role, rest):
        return cost + rest[0], edit + rest[1], role + rest[2]

    cost, audit, roles = best(0, "", 0)
    assert GOOD.match(roles)
    lines, turns, left = [], iter(rows), iter(roles)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(turns)[1:]
        if edit != "D":
            name = {"u": "user", "a": "assistant", "s": None}[next(left)]
            lines.append(f"{role if edit == 'K' else name}:{text}")
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *counts, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))


def damaged(rows):
    """Conversations after damage, from rows (conv, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv] += [(turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)] * {0: 0, 3: 2}.get(fault, 1)
    return {k: in_order(v) for k, v in out.items()}


def told(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_cheapest_and_least_of_all_edits():
    """Against every sequence of edits of short conversations."""
    random = Random(5)
    for _ in range(150):
        turns = [(random.choice(["s", "u", "a", ""]), random.randrange(3)) for _ in range(random.randrange(4))]
        found = []
        for inserts in product(*[["", "u", "a", "ua", "au"]] * (len(turns) + 1)):
            for edits in product("DKR", repeat=len(turns)):
                for roles in product("ua", repeat=edits.count("R")):
                    new, audit, cost, left = inserts[0], "I" * len(inserts[0]), 3 * len("".join(inserts)), iter(roles)
                    for (own, kind), edit, more in zip(turns, edits, inserts[1:], strict=True):
                        if edit != "D" and kind == 2:
                            break
                        new += {"D": "", "K": own or "x"}.get(edit) if edit != "R" else next(left)
                        cost += {"D": 4, "K": 0, "R": 3}[edit] + (3 if edit != "D" and kind == 1 else 0)
                        audit += edit + "I" * len(more)
                        new += more
                    else:
                        if GOOD.match(new):
                            found.append((cost, audit))
        d = c.distances(turns)
        assert (d[0], c.walk(turns, d)[0]) == min(found)


@pytest.fixture(scope="module")
def odd():
    random = Random(11)
    rows = [(None, 0, "user", "null id."), (None, None, "assistant", None), (-1, None, None, "q."), (-1, None, "user", "a"), (-1, None, "user", "a"), (-2, 3, "tool", "x."), (-2, 9, "", "y."), (-3, 5, "user", ""), (-4, 1, "unknown", "z!\n\t "), (-4, 2, "assistant", "z!.\x1c")]
    for conv in range(60):
        for turn in range(random.randrange(1, 60)):
            for _ in range(random.choice([1, 1, 1, 1, 2])):
                rows.append((conv, None if random.random() < 0.03 else turn + (turn > 20) * 3, random.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), random.choice(["Yes.", "No", "", " \n", "é?", None, "." * 30, f"Number {random.randrange(99)}!", "word " * random.randrange(9)])))
    return rows


SCHEMA = "conv_id long, turn int, role string, text string"


def test_odd_rows(spark, odd):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in odd], SCHEMA + ", copies string, audit string")
    got = told(c.repair(c.damage(df), copies=F.col("copies")))
    expected = damaged(odd)
    assert got.keys() == expected.keys() and {-3} <= got.keys()
    for k, rows in expected.items():
        assert got[k] == by_definition(rows), k


@pytest.mark.parametrize("segment", [1, 3, 50])
def test_long_conversations_are_cut(spark, odd, monkeypatch, segment):
    monkeypatch.setattr(c, "LONG_ROWS", 4)
    monkeypatch.setattr(c, "SEGMENT", segment)
    df = spark.createDataFrame(odd, SCHEMA)
    assert told(c.repair(c.damage(df), copies=F.col("copies"))) == {k: by_definition(v) for k, v in damaged(odd).items()}


def test_repaired_turns(spark, odd, monkeypatch):
    df = spark.createDataFrame(odd, SCHEMA)
    digests = told(c.repair(df).select("conv_id", "repaired_sha256"))
    for limit in (c.LONG_ROWS, 4):
        monkeypatch.setattr(c, "LONG_ROWS", limit)
        monkeypatch.setattr(c, "SEGMENT", 7 if limit == 4 else c.SEGMENT)
        lines = defaultdict(list)
        for r in sorted(c.repaired_turns(df).collect(), key=lambda r: r.position):
            lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert all(sha256("\n".join(lines[k]).encode()).hexdigest() == digests[k][0] for k in digests)


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert told(c.repair(c.damage(df), copies=F.col("copies"))) == {k: by_definition(v) for k, v in damaged(rows).items()}


def test_empty_and_dropped(spark):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    none = c.repair(spark.createDataFrame([], SCHEMA))
    assert none.columns == names and none.count() == 0
    conv = next(k for k in range(999) if crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "a.")], SCHEMA)
    assert told(c.repair(c.damage(df), copies=F.col("copies"))) == {conv: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}


def test_one_huge_conversation(spark):
    df = spark.range(9_000).select(F.lit("x").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 7 == 3, "system").when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Number "), (F.col("id") % 5_000).cast("string"), F.when(F.col("id") % 11 != 0, ".").otherwise("")).alias("text"))
    [row] = c.repair(df).collect()
    rows = [(r.turn, r.role, r.text) for r in df.orderBy("turn").collect()]
    said, turns, numbers = c._fold([(t, r, x, 1, False, x[-1] != ".") for t, r, x in rows])
    d = c.distances(turns)
    audit, states, _ = c.walk(turns, d)
    assert tuple(row)[1:8] == (*numbers, d[0], audit)
    assert row.repaired_sha256 == sha256("\n".join(f"{r}:{t}" for r, t in c.repaired(audit, states, said)).encode()).hexdigest()


def test_sql_gives_the_same(spark, odd, small):
    import duckdb
    import pandas as pd

    db = duckdb.connect()
    conv = next(k for k in range(100, 999) if crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [*odd, (conv, 0, "user", "a.")]
    for source in (rows, [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]):
        frame = pd.DataFrame(source, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
        db.execute("CREATE OR REPLACE TABLE conversations AS SELECT * FROM frame")
        got = {r[0]: r[1:] for r in db.execute(c.oracle_sql()).fetchall()}
        want = damaged(source)
        assert got == {k: by_definition(want.get(k, [])) for k in {r[0] for r in source}}
