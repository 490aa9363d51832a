"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come in nested layouts: a list of messages, a prompt and a response, an instruction with an optional input.
The paths of the fields a record really holds are hashed; the hash selects a declarative mapping to canonical turns
``array<struct<role, text>>``. A template then writes the turns as one string:

    <s>[TURN] role [/TURN] text </s>     for each turn, without the blanks shown here

Inside roles and texts every character that starts a control string is escaped (``\\`` as ``\\\\``, ``<`` as ``\\l``,
``[`` as ``\\b``), so no text can hold a control string and reading back is exact.

Defined results: null texts and roles count as empty; a record with no fields, or of an unknown layout, gives null
turns and the fingerprint says which; rows of one conversation are ordered by turn, then role, then text, and equal
rows are all kept; an empty table gives an empty table. A conversation is one row, as its output is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

OPEN, CLOSE_ROLE, CLOSE = "<s>[TURN]", "[/TURN]", "</s>"
_ESCAPES = [("\\", "\\\\"), ("<", "\\l"), ("[", "\\b")]


def _paths(column: Column, kind: DataType, path: str) -> list[Column]:
    """An array of path names for each leaf below a column: the leaf's path where it holds a value."""
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in _paths(column[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        here = F.when(column.isNotNull(), F.array(F.lit(f"{path}[]")))

        def held(name: str) -> Column:
            return F.when(F.exists(column, lambda x: x[name].isNotNull()), F.array(F.lit(f"{path}[].{name}")))

        return [here, *[held(f.name) for f in kind.elementType.fields]]
    return [F.when(column.isNotNull(), F.array(F.lit(path)))]


def present_paths(record: str, kind: StructType) -> Column:
    """Sorted paths of the fields that a record holds; the names come from the schema, the choice from the row."""
    found = _paths(F.col(record), kind, "")
    empty = F.array().cast("array<string>")
    return F.array_sort(F.concat(*[F.coalesce(x, empty) for x in found])) if found else empty


def fingerprint(paths: Column) -> Column:
    return F.sha2(F.concat_ws("\n", paths), 256)


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else F.coalesce(role, F.lit(""))).alias("role"),
                    F.coalesce(text, F.lit("")).alias("text"))


@dataclass(frozen=True)
class Mapping:
    """Paths that a layout needs, paths it may also have, and how its record becomes turns."""

    name: str
    needs: frozenset[str]
    may: frozenset[str]
    turns: Callable[[Column], Column]

    def layouts(self) -> list[tuple[str, ...]]:
        """Every set of paths this mapping takes; ``may`` is short, so these are few."""
        out = [self.needs]
        for path in sorted(self.may):
            out += [x | {path} for x in out]
        return [tuple(sorted(x)) for x in out]


# Role names of the list layouts that are not canonical already: fixed values of public chat formats.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _role(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.coalesce(name, F.lit(""))), name)


def _field(record: Column, kind: StructType, name: str) -> Column:
    """A field of a record; null where the schema has no such field."""
    return record[name] if name in kind.fieldNames() else F.lit(None).cast("string")


def mappings(kind: StructType) -> list[Mapping]:
    """The mappings that a schema of records can need."""

    def listed(field: str, role: str, text: str) -> list[Mapping]:
        """A list of turns; an empty list, and a list in which nobody states a role or says a word, has its own paths."""
        if field not in kind.fieldNames() or not isinstance(kind[field].dataType, ArrayType):
            return []
        turn = kind[field].dataType.elementType
        return [Mapping(field, frozenset({f"{field}[]"}), frozenset({f"{field}[].{role}", f"{field}[].{text}"}),
                        lambda r: F.transform(r[field], lambda m: _turn(_role(_field(m, turn, role)), _field(m, turn, text))))]

    def prompted(r: Column) -> Column:
        system = _field(r, kind, "system")
        first = F.when(system.isNotNull(), F.array(_turn("system", system))).otherwise(F.array())
        return F.concat(first, F.array(_turn("user", r["prompt"]), _turn("assistant", r["response"])))

    def instructed(r: Column) -> Column:
        more = _field(r, kind, "input")
        asked = F.when(more.isNull(), r["instruction"]).otherwise(F.concat_ws("\n\n", r["instruction"], more))
        return F.array(_turn("user", asked), _turn("assistant", r["output"]))

    found = [
        *listed("messages", "role", "content"), *listed("conversations", "from", "value"),
        Mapping("prompt", frozenset({"prompt", "response"}), frozenset({"system"}), prompted),
        Mapping("instruction", frozenset({"instruction", "output"}), frozenset({"input"}), instructed),
    ]
    return [m for m in found if {p.split("[]")[0] for p in m.needs} <= set(kind.fieldNames())]


def canonical(df: DataFrame, record: str = "record") -> DataFrame:
    """Add ``fingerprint``, ``layout`` (null if unknown) and ``turns`` for the nested column ``record``."""
    kind = df.schema[record].dataType
    named = df.drop("fingerprint", "layout", "turns").withColumn("fingerprint", fingerprint(present_paths(record, kind)))
    layout = turns = None
    for m in mappings(kind):
        same = F.col("fingerprint").isin(*[F.sha2(F.lit("\n".join(x)), 256) for x in m.layouts()])
        made = m.turns(F.col(record))
        layout = F.when(same, m.name) if layout is None else layout.when(same, m.name)
        turns = F.when(same, made) if turns is None else turns.when(same, made)
    if layout is None:
        layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    return named.withColumn("layout", layout).withColumn("turns", turns)


def _escaped(text: Column) -> Column:
    for plain, safe in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """Undo the escapes one piece at a time, split at doubled backslashes, so that pieces never interact."""
    pieces = F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(
        F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")))
    return F.array_join(pieces, "\\")


def formatted(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), _escaped(F.coalesce(t["role"], F.lit(""))), F.lit(CLOSE_ROLE), _escaped(F.coalesce(t["text"], F.lit(""))), F.lit(CLOSE))), "")


def read_back(text: Column) -> Column:
    """Turns of a formatted string."""
    pieces = F.filter(F.split(text, CLOSE, -1), lambda x: x != "")

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, CLOSE_ROLE)
        return F.struct(
            unescape(F.substring(piece, F.lit(len(OPEN) + 1), cut - F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substring(piece, cut + F.lit(len(CLOSE_ROLE)), F.char_length(piece))).alias("text"))

    return F.transform(pieces, turn)


def loss_spans(text: Column, trained: str = "assistant") -> Column:
    """``array<struct<start, length>>`` of the code points of a formatted string that count for the loss."""
    head = f"{OPEN}{trained}{CLOSE_ROLE}"
    parts = F.split(text, CLOSE, -1)
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p) + len(CLOSE)).cast("long").alias("at"),
            F.when(p.startswith(F.lit(head)), F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + len(head)).cast("long").alias("start"),
                (F.char_length(p) - len(head)).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans")))
    return walked["spans"]


def format_chat(df: DataFrame, record: str = "record") -> DataFrame:
    """Canonical turns, the formatted string and the spans of it that count for the loss."""
    return canonical(df, record).withColumn("formatted", formatted(F.col("turns"))).withColumn(
        "loss_spans", loss_spans(F.col("formatted")))


def records_from_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """One nested record per conversation from rows ``key, turn, role, text``, in the layout that fits its turns.

    A user's and an assistant's turn make a prompt and a response, with a system turn before them if there is one;
    everything else is a list of messages.
    """
    said = rows.select(F.col(key).alias("conv_id"), F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"))
    grouped = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    order = F.array_join(F.transform("said", lambda t: F.replace(t["role"], F.lit(","), F.lit(";"))), ",")
    short = order.isin("user,assistant", "system,user,assistant")
    last = F.size("said") - 1

    def text(at: Column) -> Column:
        return F.get(F.col("said"), at)["text"]

    return grouped.select("conv_id", F.struct(
        F.when(~short, F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
        F.when(short, text(last - 1)).alias("prompt"), F.when(short, text(last)).alias("response"),
        F.when(order == "system,user,assistant", text(F.lit(0))).alias("system"),
    ).alias("record"))
