"""Chat formatting: schema fingerprints choose declarative mappings; ChatML with reversible escapes. JVM only.

A record's layout is known by its fingerprint: the hash of its sorted nested field paths (``messages[].role``).
For typed columns the paths come from the schema; for JSON text or VARIANT columns each row's own schema is read
with ``schema_of_variant`` and the types are removed, so rows of different layouts may share a column. A mapping
names the list of turns, the role and text fields and the names of roles, or lists (role, path) pairs for flat
layouts. A list may be empty and its turns may lack a field; such layouts have fingerprints of their own, which lead to the same mapping.
An unknown fingerprint gives null turns in a VARIANT column and raises for a typed one.

The output is the formatted text and its loss mask: for every turn the span, in characters behind the turn's start mark, that is
trained on, or null. Spans count from each turn's mark, so reading a long conversation takes time in proportion to it.

Escapes: inside texts ``<``, any number of backslashes, ``|`` gains one backslash, so no control string remains
and removing one backslash restores the text. In roles backslash and newline are written as two characters.

Defined results: a null or lacking text or role is empty; turns order by turn (nulls first), then role, then text;
repeated rows are repeated turns; a record without turns formats to the empty string; extra columns are ignored.
One conversation is one record: like one text it must fit in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURN = "array<struct<role:string,text:string>>"

#: Names of roles in known layouts (fixed values).
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. ``paths`` are its field paths; either ``turns`` (the list's path, then the names
    of the role and text fields) or ``flat`` ((role, path) pairs in order) is given."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    flat: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def layouts(self) -> list[tuple[str, ...]]:
        """The field paths of the layouts that this mapping reads: its own, and for a list also those in which all turns lack a field, or
        all are null, or there are none."""
        if not self.turns:
            return [self.paths]
        at, role, text = self.turns
        return [tuple(f"{at}[].{f}" for f in fields) for fields in ((text, role), (role,), (text,))] + [(f"{at}[]",), (at,)]


def fingerprint(paths) -> str:
    """Hash of the sorted field paths of a layout."""
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), turns=("messages", "role", "content")),
    Mapping("turns", ("turns[].role", "turns[].text"), turns=("turns", "role", "text")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), turns=("conversations", "from", "value"), roles=ROLE_NAMES),
    Mapping("prompt", ("prompt", "response"), flat=(("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("completion", "prompt"), flat=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), flat=(("user", "instruction"), ("assistant", "output"))),
    Mapping(
        "instruction_input", ("input", "instruction", "output"),
        flat=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Mapping(
        "system_prompt", ("prompt", "response", "system"),
        flat=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
)


def paths_of(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, at + "[]")
    return [at]


def typed_turns(payload: Column, kind: T.StructType, mappings=MAPPINGS) -> Column:
    """Canonical turns of a struct column; the schema's fingerprint chooses the mapping."""
    paths = paths_of(kind)
    own = fingerprint(paths)
    for m in mappings:
        if own in map(fingerprint, m.layouts()):
            have = {p.rpartition(".")[2] for p in paths}
            item = lambda item, name: item.getField(name) if name in have else F.lit(None).cast("string")
            if m.turns and not have & set(m.turns[1:]):
                return F.array().cast(TURN)
            return _turns(m, lambda path: payload.getField(path), item)
    raise ValueError(f"no mapping for the layout {sorted(paths)}")


def variant_turns(payload: Column, mappings=MAPPINGS) -> Column:
    """Canonical turns of a VARIANT column, row by row; null for layouts without a mapping."""
    own = row_layout(payload)
    out = F.lit(None).cast(TURN)
    for m in mappings:
        if m.turns:
            at, role, text = m.turns
            items = F.variant_get(payload, f"$.{at}", f"array<struct<`{role}`:string,`{text}`:string>>")
            turns = _turns(m, lambda _, items=items: items, lambda item, name: item.getField(name))
        else:
            turns = _turns(m, lambda path: F.variant_get(payload, f"$.{path}", "string"), None)
        out = F.when(own.isin(shapes(m)), turns).otherwise(out)
    return out


def shapes(mapping: Mapping) -> list[str]:
    """The fingerprints of a mapping's layouts as ``row_layout`` computes them."""
    if not mapping.turns:
        schemas = [",".join(f"{p}:" for p in sorted(mapping.paths))]
    else:
        at, role, text = mapping.turns
        schemas = [f"{at}:ARRAY<OBJECT<{','.join(f'{f}:' for f in sorted(fields))}>>" for fields in ((role, text), (role,), (text,), ())] + [f"{at}:ARRAY<>", f"{at}:"]
    return [hashlib.md5(f"OBJECT<{x}>".encode()).hexdigest() for x in schemas]


def row_layout(payload: Column) -> Column:
    """Fingerprint of a VARIANT's own nested field paths: its schema without scalar types and blanks, hashed."""
    schema = F.schema_of_variant(payload)
    bare = F.regexp_replace(schema, r"(: |<)(?!OBJECT<|ARRAY<)[A-Z]+(\([0-9,]+\))?(?=[,>])", "$1")
    return F.md5(F.regexp_replace(bare, r"(?<=[:,]) ", ""))


def _turns(m: Mapping, get, item_field) -> Column:
    if not m.turns:
        pairs = [F.struct(F.lit(role).alias("role"), get(path).alias("text")) for role, path in m.flat]
        return F.array(*pairs).cast(TURN)
    at, role, text = m.turns
    names = F.create_map(*[F.lit(x) for kv in m.roles.items() for x in kv]) if m.roles else None

    def one(item: Column) -> Column:
        r = item_field(item, role)
        return F.struct((F.coalesce(names[r], r) if names is not None else r).alias("role"), item_field(item, text).alias("text"))

    return F.coalesce(F.transform(get(at), one).cast(TURN), F.array().cast(TURN))


def escape_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape_text(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    marks = F.replace(F.replace(role, F.lit("\\\\"), F.lit("\n\\")), F.lit("\\n"), F.lit("\n\n"))
    return unescape_text(F.replace(F.replace(marks, F.lit("\n\\"), F.lit("\\")), F.lit("\n\n"), F.lit("\n")))


def collect_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Flat turn rows (key, turn, role, text) to one record per key with a ``payload`` of messages."""
    return rows.groupBy(key).agg(
        F.struct(
            F.transform(
                F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
                lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")),
            ).alias("messages")
        ).alias("payload")
    )


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """What ``make`` makes of a value that is computed once for each row and written to no row: a projection keeps twice the bytes of the
    largest text that it writes, which several such steps in a task cannot spare for a long conversation."""
    return F.transform(F.array(value), make)[0]


def formatted_turns(turns: Column) -> Column:
    """Struct of formatted (the whole text) and loss: for every turn the span behind its start mark that is trained on, null for all but
    assistant texts."""
    marked = F.transform(
        turns,
        lambda t: F.struct(
            escape_role(F.coalesce(t["role"], F.lit(""))).alias("role"), escape_text(t["text"]).alias("text"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("own")
        ),
    )

    def whole(t: Column) -> Column:
        return F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))

    def span(t: Column) -> Column:
        start = F.length(t["role"]) + 1
        return F.when(t["own"], F.struct(start.alias("start"), (start + F.length(t["text"])).alias("end")))

    return bound(marked, lambda m: F.struct(F.array_join(F.transform(m, whole), "").alias("formatted"), F.transform(m, span).alias("loss")))


def format_chats(records: DataFrame, turns: Column, key: str = "conv_id") -> DataFrame:
    """key, formatted and loss (``formatted_turns``)."""
    return records.select(key, formatted_turns(turns).alias("chat")).select(key, "chat.formatted", "chat.loss")


def pieces(formatted: Column) -> Column:
    """What stands behind each start mark."""
    return F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")


def _turn(p: Column) -> tuple[Column, Column]:
    """Role and text of a piece."""
    cut = F.length(F.lit(END + "\n"))
    role = F.substring_index(p, "\n", 1)
    rest = F.substr(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - cut)
    return unescape_role(role), unescape_text(rest)


def _loss(parts: Column, loss: Column) -> Column:
    own = F.zip_with(parts, loss, lambda p, s: F.when(s.isNotNull(), unescape_text(F.substr(p, s["start"] + 1, s["end"] - s["start"]))))
    return F.array_join(own, "")


def read_back(formatted: Column) -> Column:
    """Turns of a formatted text."""

    def turn(p: Column) -> Column:
        role, text = _turn(p)
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(pieces(formatted), turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, cut from the formatted text by the spans and unescaped."""
    return _loss(pieces(formatted), loss)


def digests(chat: Column) -> Column:
    """Struct of what is read back from a formatted text and its mask (``formatted_turns``): n_turns, turns_sha256 (of role, newline, text,
    newline per turn), loss_chars, loss_sha256, formatted_chars."""

    def said(p: Column) -> Column:
        role, text = _turn(p)
        return F.concat(role, F.lit("\n"), text, F.lit("\n"))

    def own(text: Column) -> Column:
        return F.struct(F.length(text).cast("long").alias("chars"), F.sha2(text, 256).alias("sha256"))

    def of(c: Column, parts: Column, loss: Column) -> Column:
        return F.struct(
            F.size(parts).cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform(parts, said), ""), 256).alias("turns_sha256"),
            loss["chars"].alias("loss_chars"),
            loss["sha256"].alias("loss_sha256"),
            F.length(c["formatted"]).cast("long").alias("formatted_chars"),
        )

    return bound(chat, lambda c: bound(pieces(c["formatted"]), lambda parts: bound(bound(_loss(parts, c["loss"]), own), lambda loss: of(c, parts, loss))))
