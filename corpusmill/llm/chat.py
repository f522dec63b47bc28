"""Chat formatting, with DataFrame functions only.

A record is JSON of any layout. Its schema fingerprint is a hash of its sorted
nested field paths, read from the typed values to any depth; the fingerprint selects a
declarative mapping to canonical turns. The template frames each turn with
control strings; in texts and roles every control string is broken by an escape
code, which is reversible since an escape character is always written as a code
itself. The loss mask is a list of segments that cover the formatted string, each
marked as counted or not: only assistant texts are counted.

Defined cases: a null text or role is empty; turns are ordered by turn, then role
and text (a null turn first), repeated rows stay; a record with an unknown
fingerprint, invalid JSON, a repeated key or null keeps its row with null outputs and a
null layout (so does a list of turns whose texts are of mixed types, or with one more field a
turn: its paths are unknown); very long texts are formatted whole (a conversation is one row, so
a task needs memory of some 40 times its characters; too little is an error, not a null); an empty table gives no rows; other
columns of ``records`` are kept unless they bear the name of an output (fingerprint,
layout, turns, loss_segments, formatted), which replaces them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>\n"
#: Control strings of this and of other common templates; none survives in a text.
CONTROLS = ("<|start|>", "<|sep|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Escape codes: the escape character first, then the first characters of the control strings.
CODES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
JSON = {"maxStringLen": str(2**31 - 1), "mode": "PERMISSIVE"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping: either named fields with fixed roles, or a list field with role and text fields."""

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, fields joined by an empty line)
    list_field: str = ""
    role_field: str = ""
    text_field: str = ""
    roles: dict = field(default_factory=dict, hash=False)

    def paths(self) -> str:
        """What :func:`nested_paths` says of a record of this layout."""
        names = (self.role_field, self.text_field) if self.list_field else [x for _, names in self.fields for x in names]
        single = "OBJECT<" + ", ".join(f"{x}: _" for x in sorted(names)) + ">"
        return f"OBJECT<{self.list_field}: ARRAY<{single}>>" if self.list_field else single


LAYOUTS = (
    Layout("prompt", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system_prompt", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", (("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("messages", list_field="messages", role_field="role", text_field="content"),
    Layout("conversations", list_field="conversations", role_field="from", text_field="value", roles={"human": "user", "gpt": "assistant"}),
)


#: Kinds of single values in the schema of a variant; which one it is makes no difference to a layout.
SINGLE = r"(?<=: |ARRAY<|^)(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))(?=[,>]|$)"


#: Characters beyond which a record is read for its paths without its texts: a variant holds 128 MB.
WHOLE_CHARS = 16_000_000
#: A name with a text behind it, a name with another value, or a text in a list; the loops never go back, so their depth is bounded.
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
NAMED_TEXTS = rf'(?s)("{_INSIDE}"\s*+:\s*+)(?:("){_INSIDE}("))?+|("){_INSIDE}(")'


def without_texts(record: Column) -> Column:
    """A JSON record with every text emptied, which has the same paths; null if it is not valid."""
    valid = F.json_object_keys(record).isNotNull() | F.json_array_length(record).isNotNull()
    return F.when(valid, F.regexp_replace(record, NAMED_TEXTS, "$1$2$3$4$5"))


def nested_paths(record: Column) -> Column:
    """The sorted nested field paths of a JSON record, to any depth, as the schema of its variant writes them.

    They come from the types of the values, so a text that looks like JSON is a text.
    Of a long record only the texts are left out, so its length is not limited by the variant.
    """
    short = F.when(F.length(record) > WHOLE_CHARS, without_texts(record)).otherwise(record)
    return F.regexp_replace(F.schema_of_variant(F.from_json(short, "variant", JSON)), SINGLE, "_")


def fingerprint(record: Column) -> Column:
    """Hash of the sorted nested field paths of a JSON record; null if it is none."""
    return F.sha2(nested_paths(record), 256)


def _turns(record: Column, layout: Layout) -> Column:
    if layout.list_field:
        item = f"array<struct<`{layout.role_field}`:string,`{layout.text_field}`:string>>"
        rows = F.from_json(record, f"`{layout.list_field}` {item}", JSON)[layout.list_field]
        names = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]) if layout.roles else None

        def turn(x: Column) -> Column:
            role = F.coalesce(x[layout.role_field], F.lit(""))
            if names is not None:
                role = F.coalesce(F.try_element_at(names, role), role)
            return F.struct(role.alias("role"), F.coalesce(x[layout.text_field], F.lit("")).alias("text"))

        return F.transform(rows, turn)
    schema = ", ".join(f"`{x}` string" for _, names in layout.fields for x in names)
    row = F.from_json(record, schema, JSON)
    return F.array(*[F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[F.coalesce(row[x], F.lit("")) for x in names]), lambda t, i: (t != "") | (i == 0)), "\n\n").alias("text")) for role, names in layout.fields])


def canonical_turns(records: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with layout (null if unknown) and turns."""
    known = {layout: F.sha2(F.lit(layout.paths()), 256) for layout in layouts}
    marked = records.withColumn("fingerprint", fingerprint(F.col(column)))
    name = F.coalesce(*[F.when(F.col("fingerprint") == h, F.lit(x.name)) for x, h in known.items()])
    turns = F.coalesce(*[F.when(F.col("layout") == x.name, _turns(F.col(column), x)) for x in layouts])
    return marked.withColumn("layout", name).withColumn("turns", turns)


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    out = F.replace(text, F.lit(CODES[0][0]), F.lit(CODES[0][1]))
    for first, code in CODES[1:]:
        tails = "|".join(re.escape(c[1:]) for c in controls if c[0] == first)
        # a code instead of the first character, wherever a control string begins
        out = F.regexp_replace(out, re.escape(first) + f"(?={tails})", code.replace("\\", "\\\\"))
    return out


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(records: DataFrame, turns: str = "turns", counted: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``records`` with formatted and loss_segments (text, counted), which join to formatted."""
    ready = F.transform(turns, lambda t: F.struct(F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*counted).alias("loss")))
    segments = F.flatten(F.transform(ready, lambda t: F.array(*[F.struct(x.alias("text"), loss.alias("counted")) for x, loss in ((t["head"], F.lit(False)), (t["body"], t["loss"]), (F.lit(END), F.lit(False)))])))
    return records.withColumn("loss_segments", segments).withColumn("formatted", F.array_join(F.transform("loss_segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    pieces = F.split(formatted, re.escape(END), -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: _turn_of(F.split(p, re.escape(SEP), 2)))


def _turn_of(parts: Column) -> Column:
    role = F.substring(F.get(parts, F.lit(0)), len(START) + 1, 2**31 - 1)
    return F.struct(unescape(role).alias("role"), unescape(F.get(parts, F.lit(1))).alias("text"))


def loss_text(segments: Column) -> Column:
    """All counted text, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["counted"]), lambda s: unescape(s["text"])), "")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """One JSON record per conversation, in the layout that its roles suit."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), "\n")

    def text(i: int) -> Column:
        return F.get(F.col("t"), F.lit(i))["text"]

    prompt = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion")))
    system = F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("completion")))
    shared = ~F.exists("t", lambda x: x["role"].isin("human", "gpt"))  # else the mapping would rename the role
    talk = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))).alias("conversations")))
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    record = F.when(roles == "user\nassistant", prompt).when(roles == "system\nuser\nassistant", system).when(shared & (F.crc32(F.col("conv_id").cast("string")) % 2 == 1), talk).otherwise(messages)
    return grouped.select("conv_id", record.alias("record"))
