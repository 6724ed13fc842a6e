import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import chat_format as c

NASTY = ["", "␛", "<|", "<␛|", "␛␛<|end|>␛", "<|end|>\n<|user|>\nhi", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>", "<|>", "|>\n", "<||>", "a\\b\"c\n\n$1 \\1", "😀<", "<", "|", "[INST", "<s", None]


def record(turns):
    return json.dumps({"turns": [{"turn": i, "role": r, "text": t} for i, (r, t) in enumerate(turns)]})


def written(spark, records):
    rows = spark.createDataFrame(list(enumerate(records)), "id long, record string")
    return c.format_turns(c.canonical(rows, "record"))


def test_reading_back_gives_what_was_written(spark):
    r = random.Random(2)
    pieces = [x for x in NASTY if x]
    texts = [x or "" for x in NASTY] + ["".join(r.choice(pieces) for _ in range(r.randint(1, 6))) for _ in range(150)]
    conversations = [[("user", a), ("assistant", b), (a, b)] for a, b in zip(texts, reversed(texts), strict=True)]
    out = written(spark, [record(t) for t in conversations]).withColumn("back", c.read_back(F.col("formatted"))).collect()
    for row in out:
        want = conversations[row["id"]]
        assert [tuple(t) for t in row["back"]] == want
        assert sum(m["length"] for m in row["loss_mask"]) == len(row["formatted"])
        at, said = 0, []
        for m in row["loss_mask"]:
            said += [row["formatted"][at : at + m["length"]]] if m["loss"] else []
            at += m["length"]
        assert len(said) == sum(role == "assistant" for role, _ in want)
        body = row["formatted"]
        for s in c.CONTROL[2:]:
            assert s not in body


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"messages": [{"content": None, "role": "user"}]}, "messages", [("user", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "from_value", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": "a"}, "prompt_response", [("user", "q"), ("assistant", "a")]),
    ({"completion": "a", "prompt": "q"}, "prompt_completion", [("user", "q"), ("assistant", "a")]),
    ({"system": "", "prompt": "q", "response": "a"}, "system_prompt_response", [("user", "q"), ("assistant", "a")]),
    ({"system": "s", "prompt": "q", "response": None}, "system_prompt_response", [("system", "s"), ("user", "q"), ("assistant", "")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction_input_output", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction_input_output", [("user", "i"), ("assistant", "o")]),
    ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"what": 1}, None, []),
    ([1, 2], None, []),
]


def test_fingerprints_select_mappings(spark):
    records = [json.dumps(x) for x, _, _ in LAYOUTS] + ["not json", None]
    rows = spark.createDataFrame(list(enumerate(records)), "id long, record string").withColumn("clash", F.lit(1))
    got = {r["id"]: r for r in c.canonical(rows, "record").collect()}
    for i, (_, name, turns) in enumerate(LAYOUTS):
        assert got[i]["layout"] == name and [tuple(t) for t in got[i]["turns"]] == turns, LAYOUTS[i]
    assert got[len(LAYOUTS)]["turns"] == [] and got[len(LAYOUTS) + 1]["layout"] is None
    assert c.canonical(rows.limit(0), "record").count() == 0


def test_digests(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, 0, None, "x"), (2, None, "assistant", "late")]
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r["conv_id"]: r for r in c.digests(c.format_turns(c.canonical(c.from_rows(table), "record"))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0 and got[2]["loss_chars"] == 4
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nuser\nhi\nassistant\n\n").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\nx\n").hexdigest()


def test_query_equals_its_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    from textloom.llm.queries import op10_chat_format

    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{small}/conversations.parquet')")
    want = db.execute(c.oracle_sql()).df().sort_values("conv_id").reset_index(drop=True)
    got = op10_chat_format(spark, small).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()
    plan = op10_chat_format(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_very_long_conversations_are_whole(spark):
    """A text over the JSON parser's limit, and a conversation over the variant's."""
    rows = spark.range(141).select((F.col("id") == 0).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.expr("repeat('x', IF(id = 0, 21000000, 1000000))").alias("text"))
    got = {r["conv_id"]: r for r in c.digests(c.format_turns(c.canonical(c.from_rows(rows), "record"))).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (1, 21_000_000)
    assert (got[0]["n_turns"], got[0]["loss_chars"]) == (140, 140_000_000)
    assert got[1]["turns_sha256"] == hashlib.sha256(b"assistant\n" + b"x" * 21_000_000 + b"\n").hexdigest()


def test_json_too_large_to_parse_fails(spark):
    rows = spark.range(1).select(F.concat(F.lit('{"response": "a", "prompt": "'), F.expr("repeat('x', 21000000)"), F.lit('"}')).alias("record"))
    with pytest.raises(Exception, match="MALFORMED_RECORD|VARIANT"):
        c.canonical(rows, "record").select(F.size("turns")).collect()


def test_structs_are_mapped_as_json_is(spark):
    for x, name, turns in LAYOUTS[:-1]:
        kind = "struct<messages:array<struct<content:string,role:string>>>" if name == "messages" else None
        row = spark.createDataFrame([(json.dumps(x),)], "record string")
        kind = kind or spark.range(1).select(F.schema_of_json(F.lit(json.dumps(x)))).first()[0]
        got = c.canonical(row.select(F.from_json("record", kind).alias("record")), "record").first()
        assert got["layout"] == name and [tuple(t) for t in got["turns"]] == turns
        assert got["fingerprint"] == c.canonical(row, "record").first()["fingerprint"]


def test_loss_is_read_by_the_mask(spark):
    turns = [("user", "ask </s> this"), ("assistant", "␛ <|end|> [INST]"), ("tool", ""), ("assistant", "more")]
    row = written(spark, [record(turns)]).withColumns({"__written": F.lit(1), "__record": F.lit(2)})
    assert c.digests(row, "id").first()["loss_sha256"] == hashlib.sha256("␛ <|end|> [INST]more".encode()).hexdigest()
    other = row.withColumn("loss_mask", F.transform("loss_mask", lambda m, i: m.withField("loss", i.isin(1, 7, 9))))
    got = other.select(c.loss_text(F.col("formatted"), F.col("loss_mask"))).first()[0]
    assert got == "ask </s> this" + "<|tool|>\n"[:0] + "" + "<|assistant|>\n"
    assert c.digests(other, "id").first()["loss_chars"] == len(got)
    for broken in (F.slice("loss_mask", 1, 9), F.transform("loss_mask", lambda m, i: m.withField("length", m["length"] + (i == 1).cast("int")))):
        with pytest.raises(Exception, match="mask"):
            c.digests(row.withColumn("loss_mask", broken), "id").collect()
    named = c.format_turns(c.canonical(row.select("record", "__written", "__record"), "record"))
    assert {"__written", "__record"} <= set(named.columns)
