"""Chat formatting by schema fingerprints.

A record may hold a conversation as messages, as a prompt with a response, or as an instruction with
an input and an output. The fingerprint of a record is the hash of the nested field paths that it
fills, in order. A declarative mapping lists the paths it needs and those it may have, and so knows
all its fingerprints; the one that matches turns the record into canonical turns
``array<struct<role, text>>``. The template then writes ``<|turn|>role<|text|>text<|end|>`` and a
line break for each turn. Everything is column expressions.

Control strings inside roles and texts are escaped: a backslash goes between the first and the
second character of one, also where backslashes already are, so that taking one away restores any
text and a formatted conversation has no control string but the template's own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketscore.llm.rows import need

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
# What follows the first character of a control string of the template or of
# common chat models.
_CONTROL = r"(<(?=\\*(?:\||s>|/s>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>))|\[(?=\\*/?INST\]))"
_ESCAPED = r"(<(?=\\+(?:\||s>|/s>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>))|\[(?=\\+/?INST\]))\\"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _turn(role: str | Column, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.cast("string").alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _optional(condition: Column, turn: Column) -> Column:
    return F.when(condition, F.array(turn)).otherwise(F.array().cast(TURNS))


@dataclass(frozen=True)
class Mapping:
    """Paths that a record must and may fill, and the turns made of ``get(path)`` columns."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column]

    def fingerprints(self) -> list[str]:
        chosen = [self.needs + extra for n in range(len(self.may) + 1) for extra in combinations(self.may, n)]
        return ["\n".join(sorted(paths)) for paths in chosen]


def _messages(list_path: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda get: F.transform(get(list_path), lambda m: _turn(F.coalesce(m[role], F.lit("")), m[text]))


def _system_and(turns: Callable[[Callable[[str], Column]], Column]) -> Callable[[Callable[[str], Column]], Column]:
    return lambda get: F.concat(_optional(get("system").isNotNull(), _turn("system", get("system"))), turns(get))


def _exchange(asked: str, answered: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda get: F.array(_turn("user", get(asked)), _turn("assistant", get(answered)))


def _instruction(get: Callable[[str], Column]) -> Column:
    asked = F.concat_ws("\n\n", get("instruction"), get("input"))
    return F.array(_turn("user", asked), _turn("assistant", get("output")))


MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), (), _messages("messages", "role", "content")),
    Mapping("turns", ("turns[].role", "turns[].text"), (), _messages("turns", "role", "text")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), (), _messages("conversations", "from", "value")),
    Mapping("prompt and response", ("prompt", "response"), ("system",), _system_and(_exchange("prompt", "response"))),
    Mapping("prompt and completion", ("prompt", "completion"), ("system",), _system_and(_exchange("prompt", "completion"))),
    Mapping("question and answer", ("question", "answer"), ("system",), _system_and(_exchange("question", "answer"))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), _system_and(_instruction)),
)


def _any_filled(items: Column, name: str) -> Column:
    return F.exists(items, lambda item: item[name].isNotNull())


def _leaves(schema: T.StructType, prefix: str = "", inside: Column | None = None) -> list[tuple[str, Column]]:
    """Every leaf path and whether a record fills it. An array fills a path if any element does."""
    found: list[tuple[str, Column]] = []
    for field in schema.fields:
        column = F.col(f"`{field.name}`") if inside is None else inside.getField(field.name)
        path, kind = prefix + field.name, field.dataType
        if isinstance(kind, T.StructType):
            found += _leaves(kind, f"{path}.", column)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for name in kind.elementType.fieldNames():
                found.append((f"{path}[].{name}", _any_filled(column, name)))
        else:
            found.append((path, column.isNotNull()))
    return found


def fingerprint(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The hash of the paths that a record fills, of those that any mapping names, in order."""
    known = {path for m in mappings for path in m.needs + m.may}
    paths = sorted((path, filled) for path, filled in dict(_leaves(records.schema)).items() if path in known)
    filled = [F.when(F.coalesce(has, F.lit(False)), F.lit(path)) for path, has in paths]
    return F.xxhash64(F.concat_ws("\n", *filled))


def canonical(records: DataFrame, *keep: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``keep`` columns, ``layout`` (the mapping's name) and ``turns`` for each record.

    A record whose fingerprint no mapping has gets null for both; so does one without any of the
    paths. Columns that no mapping names are ignored. A null text is empty, a null role is empty.
    """
    need(records, *keep)
    if len(set(records.columns)) != len(records.columns):
        raise ValueError(f"columns must have different names: {records.columns}")
    names = set(records.columns)

    def get(path: str) -> Column:
        return F.col(f"`{path}`") if path in names else F.lit(None).cast("string")

    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    leaves = dict(_leaves(records.schema))
    for mapping in reversed(mappings):
        if not set(mapping.needs) <= set(leaves):
            continue
        matches = F.col("_mark").isin([F.xxhash64(F.lit(paths)) for paths in mapping.fingerprints()])
        layout = F.when(matches, F.lit(mapping.name)).otherwise(layout)
        turns = F.when(matches, mapping.turns(get).cast(TURNS)).otherwise(turns)
    marked = records.withColumn("_mark", fingerprint(records, mappings))
    return marked.select(*keep, layout.alias("layout"), turns.alias("turns"))


def gather(rows: DataFrame, id_column: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one record ``(id, messages)`` per conversation, in the order of the turns.

    Turns with the same number are ordered by role and text, repeated rows are all kept, a null
    number comes first. Rows with a null id are one conversation with a null id. A conversation is
    one row of the result, so its texts together must fit a row.
    """
    need(rows, id_column, order, role, text)
    turn = F.struct(F.col(order).alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(id_column).alias(id_column)).agg(F.sort_array(F.collect_list(turn)).alias("found"))
    return grouped.select(id_column, F.transform("found", lambda t: F.struct(t["role"], t["content"])).alias("messages"))


def format_turns(turns: Column) -> Column:
    """The formatted conversation."""
    parts = F.transform(
        turns, lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))
    )
    return F.concat_ws("", parts)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as they were."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")
    halves = F.transform(parts, lambda p: F.split(F.substring(p, len(TURN) + 1, 1 << 30), r"<\|text\|>", 2))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def loss_spans(turns: Column) -> Column:
    """``array<struct<start, length>>``: where the assistant's escaped texts lie in the formatted
    conversation, in code points from 0."""
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")
    initial = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        length = F.length(escape(turn["text"])).cast("bigint")
        start = (state["at"] + len(TURN) + len(TEXT) + F.length(escape(turn["role"]))).cast("bigint")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((start + length + len(END)).cast("bigint").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, initial, step, lambda state: state["spans"])


def format_chat(records: DataFrame, *keep: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``keep`` columns, ``layout``, ``formatted`` and ``loss_spans``; null where no mapping fits."""
    turns = canonical(records, *keep, mappings=mappings)
    written = F.when(F.col("turns").isNotNull(), format_turns(F.col("turns")))
    return turns.select(*keep, "layout", written.alias("formatted"), loss_spans(F.col("turns")).alias("loss_spans"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.concat_ws(
        "", F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    )


def digests(chats: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations, as counts and SHA-256 digests."""
    turns = read_turns(F.col("formatted"))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    read = chats.select(
        id_column, "formatted", turns.alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("learned")
    )
    return read.select(
        id_column,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
