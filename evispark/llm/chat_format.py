"""Chat formatting with schema fingerprints, written with DataFrame functions only.

A record's fingerprint is the hash of the nested field paths that it fills. Each declarative mapping names the
paths of one layout (prompt and completion, instruction and output, message lists, ...) and how they become
canonical turns; the fingerprint selects the mapping, so tables that mix layouts are converted row by row.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for every turn. Control strings inside roles and texts
are escaped: a backslash is put between ``<`` (with any backslashes behind it) and ``|``, and then a line feed in a
role is written ``<|lf|>``; both can be taken back exactly. The loss mask is a list of spans of the formatted text
that cover the assistants' texts.

Defined results: a null text or role is empty; roles of the layout ``turn`` stay as they are, those of message lists
are given their canonical names (``user`` where there is none); a record that fits no mapping keeps its row with
layout null and no turns, and a row of a turn table that fits none is an empty turn; turns with equal order are
ordered by role and text; a null conversation id is a conversation of its own; an empty table gives an empty table;
other columns of turn tables are not carried. A conversation is one text, so its turns meet in one row; conversations are not split.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END, LINE_FEED = "<|im_start|>", "<|im_end|>", "<|lf|>"
TURNS = "array<struct<role:string,text:string>>"

# Names that data sets give to the three roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant", "developer": "system"}


@dataclass(frozen=True)
class Mapping:
    """layout: its name; required and optional: the paths of its fields; turns: the canonical turns from a getter of columns."""

    layout: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column]

    def path_sets(self) -> list[tuple[str, ...]]:
        return [tuple(sorted((*self.required, *extra))) for n in range(len(self.optional) + 1) for extra in combinations(self.optional, n)]


def turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def listed(field: str, role: str, text: str) -> Callable:
    """Turns from a list of messages."""
    return lambda col: F.transform(col(field), lambda m: F.struct(canonical_role(m[role].cast("string")).alias("role"), m[text].cast("string").alias("text")))


def single(role: str, text: str, named: Callable[[Column], Column]) -> Callable:
    """The turn of a record that is one."""
    return lambda col: F.array(F.struct(named(col(role).cast("string")).alias("role"), col(text).cast("string").alias("text")))


def spoken(*parts: tuple[str, str]) -> Callable:
    """Turns from (role, field) pairs; absent fields give no turn."""
    return lambda col: F.filter(F.array(*[turn(role, col(field)) for role, field in parts]), lambda t: t["text"].isNotNull())


def instructed(col: Callable[[str], Column]) -> Column:
    """Instruction with an optional input below it, then the output."""
    asked = F.concat_ws("\n\n", col("instruction"), F.when(col("input") != "", col("input")))
    return F.filter(F.array(turn("system", col("system")), turn("user", asked), turn("assistant", col("output"))), lambda t: t["text"].isNotNull())


# The layouts that are known, by the paths of their fields.
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), (), listed("messages", "role", "content")),
    Mapping("turns", ("turns[].role", "turns[].text"), (), listed("turns", "role", "text")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), (), listed("conversations", "from", "value")),
    Mapping("prompt", ("completion", "prompt"), ("system",), spoken(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("response", ("prompt", "response"), ("system",), spoken(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question", ("answer", "question"), ("system",), spoken(("system", "system"), ("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), instructed),
)

# The layouts of tables with a row for each turn; a null leaves its path unfilled, and a row of nulls is a ``turn``.
TURN_MAPPINGS = (
    Mapping("message", (), ("content", "role"), single("role", "content", lambda r: canonical_role(r))),
    Mapping("share", (), ("from", "value"), single("from", "value", lambda r: canonical_role(r))),
    Mapping("turn", (), ("role", "text"), single("role", "text", lambda r: r)),
)


def filled_paths(kind: T.DataType, at: Column, path: str) -> list[tuple[str, Column]]:
    """(path, whether the row fills it) for every leaf below a column."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in filled_paths(f.dataType, at[f.name], f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return [x for f in kind.elementType.fields for x in paths_of_list(f, at, path)]
    return [(path, at.isNotNull())]


def paths_of_list(field: T.StructField, at: Column, path: str) -> list[tuple[str, Column]]:
    """The leaves of one field of a list's elements; filled if any element has the field."""
    there = F.coalesce(F.exists(at, lambda x: x[field.name].isNotNull()), F.lit(False))
    return [(leaf, there) for leaf, _ in filled_paths(field.dataType, F.lit(None).cast(field.dataType), f"{path}[].{field.name}")]


def fingerprint(records: DataFrame, fields: list[str]) -> Column:
    """Hash of the paths that a record fills, in order of name."""
    leaves = sorted((x for f in fields for x in filled_paths(records.schema[f].dataType, F.col(f"`{f}`"), f)), key=lambda x: x[0])
    return F.xxhash64(F.concat_ws("|", *[F.when(there, F.lit(p)) for p, there in leaves]))


def canonical_turns(records: DataFrame, fields: list[str] | None = None, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds ``layout`` and ``turns_`` (canonical turns) to every record.

    ``fields``: the columns that make up a record's schema; all columns that some mapping mentions by default.
    """
    known = {p.split("[")[0].split(".")[0] for m in mappings for p in (*m.required, *m.optional)}
    fields = fields or [c for c in records.columns if c in known]
    have = {c: records.schema[c].dataType for c in fields}

    def col(name: str) -> Column:
        return F.col(f"`{name}`") if name in have else F.lit(None).cast("string")

    def served(m: Mapping) -> bool:
        return all(p.split("[")[0].split(".")[0] in have for p in m.required)

    mark, layout, turns = F.col("__fingerprint"), F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in filter(served, mappings):
        hit = mark.isin(*[F.xxhash64(F.lit("|".join(paths))) for paths in m.path_sets()])
        layout, turns = F.when(hit, F.lit(m.layout)).otherwise(layout), F.when(hit, m.turns(col).cast(TURNS)).otherwise(turns)
    marked = records.withColumn("__fingerprint", fingerprint(records, fields) if fields else F.lit(0).cast("long"))
    return marked.withColumns({"layout": layout, "turns_": F.coalesce(turns, F.array().cast(TURNS))}).drop("__fingerprint")


def canonical_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(role)), role, F.lit("user"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """Roles are one line; no escaped text holds the string that stands for their line feeds."""
    return F.replace(escaped(role), F.lit("\n"), F.lit(LINE_FEED))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(LINE_FEED), F.lit("\n")))


def rendered(turns: DataFrame, key: str) -> DataFrame:
    """(key, formatted, loss_spans) from rows (key, at, role, text); rows of a key are ordered by at, role and text."""
    role, body = escaped_role(F.col("role")), escaped(F.col("text"))
    rows = turns.select(F.col(key).alias("key"), "at", role.alias("role"), body.alias("body"))
    rows = rows.withColumn("piece", F.concat(F.lit(START), "role", F.lit("\n"), "body", F.lit(END + "\n")))
    order = Window.partitionBy("key").orderBy("at", "role", "body")
    upto = F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")
    rows = rows.withColumns({"nth": F.row_number().over(order), "stop": upto - len(END) - 1})
    span = F.struct((F.col("stop") - F.char_length("body")).alias("start"), F.col("stop").alias("end"))
    pieces = F.sort_array(F.collect_list(F.struct("nth", "piece", F.when(F.col("role") == "assistant", span).alias("span"))))
    grouped = rows.groupBy("key").agg(pieces.alias("p"))
    return grouped.select(
        F.col("key").alias(key),
        F.array_join("p.piece", "").alias("formatted"),
        F.filter("p.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def format_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Formats a table with a row for each turn (key, order, and the fields of the layouts of ``TURN_MAPPINGS``)."""
    fields = [c for c in turns.columns if any(c in m.optional for m in TURN_MAPPINGS)]
    records = turns.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{order}`").alias("at"), *fields)
    rows = canonical_turns(records, fields, TURN_MAPPINGS).select("__key", "at", F.explode_outer("turns_").alias("t"))
    return rendered(rows.select(F.col("__key").alias(key), "at", "t.role", "t.text"), key)


def format_records(records: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """Formats records of mixed layouts; each row needs a key of its own. Records without turns give an empty text."""
    turns = canonical_turns(records, fields)
    rows = turns.select(key, F.posexplode("turns_").alias("at", "t")).select(key, "at", "t.role", "t.text")
    return turns.select(key, "layout").join(rendered(rows, key), key, "left").withColumn("formatted", F.coalesce("formatted", F.lit("")))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    body = lambda p: F.substring(p, F.instr(p, "\n") + 1, F.char_length(p))
    return F.transform(parts, lambda p: F.struct(unescaped_role(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.regexp_replace(body(p), r"<\|im_end\|>\n\z", "")).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The texts that the loss mask covers, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
