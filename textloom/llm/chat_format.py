"""Chat formatting by schema fingerprint, in DataFrame functions only.

A record is a JSON object, or a struct column.  The nested field paths of a record (types aside) are hashed
to a fingerprint, the fingerprint selects a declarative mapping, and the mapping turns
the record into canonical turns ``array<struct<role, text>>``.  A struct's fingerprint is that of
its schema, and its fields are read as they are, whatever their size.  ``format_turns`` writes
turns in one template and gives the loss mask as run lengths, three for each turn (its
head, its text, its end); ``read_back`` recovers the turns from the written string, and
``loss_text`` what the mask's runs cut out of it.

Template: each turn is ``<|role|>``, a new line, the text, ``<|end|>``, a new line.  Control
strings of this and other common templates are broken inside texts and roles by an
escape character after their first character, and escape characters are doubled, so
reading back gives exactly the text that was written.

Defined results: null texts and roles count as empty; a record that is no JSON object, or whose
fingerprint no mapping has, gets ``layout`` null and no turns; a record without turns is
written as the empty string; rows with equal turn numbers are ordered by role and text, and
repeated rows are all kept; a JSON text too large to be parsed (a string of over 20 M characters,
or a variant over its limit) fails, and so does a text of over ``SURE`` bytes that is no JSON; an empty table gives an empty table; other columns are
passed through by ``canonical`` and ``format_turns``, whose own columns are named by the caller or have free names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.llm._text import free_name

TURNS = "array<struct<role:string,text:string>>"

#: Control strings that never stand inside a written text.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "␛"
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LOSS_ROLE = "assistant"
#: No JSON text of at most so many bytes is over the parser's limits of size.
SURE = 20_000_000

_AT_CONTROL = "(?=" + "|".join("".join(f"\\{c}" if c in "|[]<>/" else c for c in s) for s in CONTROL) + ")(.)"
_SCALAR = "(: |<)(?:VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|STRING|BINARY|DATE|TIMESTAMP_NTZ|TIMESTAMP|DECIMAL\\(\\d+,\\d+\\))(?=[,>])"


@dataclass(frozen=True)
class Layout:
    """How records of one shape become turns.

    shape: the record's nested fields, sorted, scalars written as ``_``.
    array: path of the list of turns with its role and text fields; or
    parts: (role, fields) in order, the fields' non-empty values joined by a blank line.
    roles: names of roles that are written otherwise.
    """

    name: str
    shape: str
    array: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def fingerprint(self) -> str:
        return sha256(self.shape.encode()).hexdigest()[:16]

    def turns(self, record: Column, parsed: bool = True) -> Column:
        """Turns of a variant, or of a struct if not ``parsed``."""
        if self.array:
            path, role, text = self.array
            listed = F.try_variant_get(record, f"$.{path}", f"array<struct<`{role}`:string,`{text}`:string>>") if parsed else record[path]
            return F.transform(listed, lambda t: F.struct(self._role(F.coalesce(t[role].cast("string"), F.lit(""))).alias("role"), F.coalesce(t[text].cast("string"), F.lit("")).alias("text")))
        get = lambda name: F.coalesce(F.try_variant_get(record, f"$.{name}", "string") if parsed else record[name].cast("string"), F.lit(""))
        turns = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*map(get, names)), lambda x: x != ""), "\n\n").alias("text")) for role, names in self.parts]
        # a system turn is there only if it says something
        return F.filter(F.array(*turns), lambda t: (t["role"] != "system") | (t["text"] != ""))

    def _role(self, role: Column) -> Column:
        for old, new in self.roles.items():
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return role


def _fields(*names: str) -> str:
    return "OBJECT<" + ", ".join(f"{n}: _" for n in sorted(names)) + ">"


def _list(name: str, *names: str) -> str:
    return f"OBJECT<{name}: ARRAY<{_fields(*names)}>>"


#: The layouts known from the start; callers may pass others.
LAYOUTS = (
    Layout("messages", _list("messages", "role", "content"), array=("messages", "role", "content")),
    Layout("from_value", _list("conversations", "from", "value"), array=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("turn_rows", _list("turns", "turn", "role", "text"), array=("turns", "role", "text")),
    Layout("prompt_response", _fields("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", _fields("prompt", "completion"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system_prompt_response", _fields("system", "prompt", "response"), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction_output", _fields("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input_output", _fields("instruction", "input", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question_answer", _fields("question", "answer"), parts=(("user", ("question",)), ("assistant", ("answer",)))),
)


def shape(record: Column) -> Column:
    """The nested fields of a variant, sorted, scalars written as ``_``."""
    return F.regexp_replace(F.schema_of_variant(record), _SCALAR, "$1_")


def fingerprint(record: Column) -> Column:
    return F.substring(F.sha2(shape(record), 256), 1, 16)


def schema_shape(kind: T.DataType) -> str:
    """``shape`` of all records of a struct type."""
    if isinstance(kind, T.StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {schema_shape(f.dataType)}" for f in sorted(kind, key=lambda f: f.name)) + ">"
    return f"ARRAY<{schema_shape(kind.elementType)}>" if isinstance(kind, T.ArrayType) else "_"


def canonical(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS, turns_col: str = "turns", layout_col: str = "layout", fingerprint_col: str = "fingerprint") -> DataFrame:
    """``records`` with the fingerprint, the layout's name and the turns of each record."""
    kind = records.schema[record_col].dataType
    if isinstance(kind, T.StructType):
        key = sha256(schema_shape(kind).encode()).hexdigest()[:16]
        turns = [(x.name, x.turns(F.col(record_col), parsed=False)) for x in layouts if x.fingerprint == key][-1:]
        there = F.col(record_col).isNotNull()
        return records.withColumns({
            fingerprint_col: F.when(there, F.lit(key)),
            layout_col: F.when(there, F.lit(turns[0][0])) if turns else F.lit(None).cast("string"),
            turns_col: F.coalesce(turns[0][1].cast(TURNS), F.array().cast(TURNS)) if turns else F.array().cast(TURNS),
        })
    text = F.col(record_col)
    own = free_name(records, "__record")
    parsed = records.withColumn(own, F.when(F.octet_length(text) > SURE, F.parse_json(text)).otherwise(F.try_parse_json(text)))
    print_ = parsed.withColumn(fingerprint_col, fingerprint(F.col(own)))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        hit = F.col(fingerprint_col) == x.fingerprint
        name, turns = F.when(hit, F.lit(x.name)).otherwise(name), F.when(hit, x.turns(F.col(own))).otherwise(turns)
    return print_.withColumns({layout_col: name, turns_col: F.coalesce(turns, F.array().cast(TURNS))}).drop(own)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit("(?s)" + _AT_CONTROL), F.lit("$1" + ESCAPE))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(f"{ESCAPE}({ESCAPE}?)"), F.lit("$1"))


def format_turns(rows: DataFrame, turns_col: str = "turns", text_col: str = "formatted", mask_col: str = "loss_mask") -> DataFrame:
    """``rows`` with the written string and its loss mask: runs of characters (length, loss), in order."""

    def written(turn: Column) -> Column:
        return F.struct((turn["role"] == LOSS_ROLE).alias("loss"), F.concat(F.lit(OPEN), escape(turn["role"]), F.lit(CLOSE)).alias("head"), escape(turn["text"]).alias("body"))

    def run(length: Column, loss: Column) -> Column:
        return F.struct(length.cast("int").alias("length"), loss.alias("loss"))

    own = free_name(rows, "__written")
    out = rows.withColumn(own, F.transform(F.col(turns_col), written))
    return out.withColumns({
        text_col: F.array_join(F.transform(own, lambda w: F.concat(w["head"], w["body"], F.lit(END))), ""),
        mask_col: F.flatten(F.transform(own, lambda w: F.array(run(F.char_length(w["head"]), F.lit(False)), run(F.char_length(w["body"]), w["loss"]), run(F.lit(len(END)), F.lit(False))))),
    }).drop(own)


def _parts(formatted: Column) -> Column:
    """Head and text of each turn of a written string, which control strings inside texts can't split."""
    return F.filter(F.split(formatted, END.replace("|", "\\|")), lambda p: p != "")


def read_back(formatted: Column) -> Column:
    """The turns that a written string holds."""

    def turn(part: Column) -> Column:
        head = F.substring_index(part, CLOSE, 1)
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(part, F.char_length(head) + len(CLOSE) + 1)).alias("text"))

    return F.transform(_parts(formatted), turn)


def loss_text(formatted: Column, mask: Column) -> Column:
    """What the mask's runs mark in a written string, one after another and unescaped; whatever the roles.

    The three runs of a turn are cut out of the turn's own part of the string.  A mask whose
    runs aren't of the string's turns fails.
    """

    def marked(part: Column, i: Column) -> Column:
        head, body, end = (F.get(mask, i * 3 + k) for k in range(3))
        fits = (head["length"] + body["length"] == F.char_length(part)) & (end["length"] == len(END))
        text = F.concat(
            F.when(head["loss"], F.substr(part, F.lit(1), head["length"])).otherwise(""),
            F.when(body["loss"], F.substr(part, head["length"] + 1, body["length"])).otherwise(""),
            F.when(end["loss"], F.lit(END)).otherwise(""),
        )
        return F.when(fits, text).otherwise(F.raise_error(F.lit("a loss mask doesn't fit its text")).cast("string"))

    said = F.array_join(F.transform(_parts(formatted), marked), "")
    return unescape(F.when(F.size(_parts(formatted)) * 3 == F.size(mask), said).otherwise(F.raise_error(F.lit("a loss mask doesn't fit its text")).cast("string")))


def from_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", record_col: str = "record") -> DataFrame:
    """One record, a struct, of the ``turn_rows`` layout for each conversation of a table with a row for each turn.

    A conversation is one row from here on, as its written form is one string.
    """
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(id_col, F.struct("turns").alias(record_col))


def digests(rows: DataFrame, id_col: str = "conv_id", text_col: str = "formatted", mask_col: str = "loss_mask") -> DataFrame:
    """id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the written string and its loss mask."""
    said = loss_text(F.col(text_col), F.col(mask_col))
    read = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("written"), read_back(F.col(text_col)).alias("turns"), said.alias("said"))
    return read.select(
        F.col("id").alias(id_col),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.char_length("written").cast("long").alias("formatted_chars"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for the query over ``conversations``."""
    quoted = [s.replace("'", "''") for s in CONTROL]
    grown = lambda x: f"(length({x}) + length({x}) - length(replace({x}, '{ESCAPE}', ''))" + "".join(f" + (length({x}) - length(replace({x}, '{s}', ''))) // {len(s)}" for s in quoted) + ")"
    fixed = len(OPEN) + len(CLOSE) + len(END)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
               sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text ELSE '' END, '' {order})) AS loss_sha256,
               sum({grown('role')} + {grown('text')} + {fixed})::BIGINT AS formatted_chars
        FROM r GROUP BY conv_id
    """
