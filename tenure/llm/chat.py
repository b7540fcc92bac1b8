"""Conversations from differing layouts to one training format.

A record's layout is told by its fingerprint, the hash of those of its nested field paths
that any layout names; the fingerprint selects a declarative mapping that says where
turns, roles and texts lie: of the layouts whose paths the record has, the one that names
most. Other fields play no part. Tables are fingerprinted once, by their schema, JSON
records one by one.

Each turn becomes a segment: a mark with the role, the text, an end mark. A backslash
goes before every backslash and ``<`` of a text, so no text can look like a mark and
reading back is exact. The loss mask of a segment covers the text of an assistant turn.
Segments of a conversation follow each other; they are read back in one pass that holds
a single segment at a time, whatever the length of the conversation.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.llm.common import batches

TURNS = "conv_id long, turn long, role string, text string"


@dataclass(frozen=True)
class Layout:
    """Where the parts of a record are.

    ``each`` names a list of turns; ``role`` and ``text`` are then fields of its elements.
    Without it ``parts`` lists (role, field) pairs in order, and without those the record
    is one turn with its fields ``turn``, ``role`` and ``text``. A part whose field is in
    ``optional`` may be missing, and gives no turn then.
    """

    id: str
    each: str | None = None
    turn: str | None = None
    role: str | None = None
    text: str | None = None
    parts: tuple[tuple[str, str], ...] = ()
    optional: frozenset[str] = frozenset()

    def named(self) -> set[str]:
        """All paths that play a part."""
        if self.each:
            return {self.id, f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"}
        if self.parts:
            return {self.id, *(field for _, field in self.parts)}
        return {self.id, self.turn, self.role, self.text}

    def paths(self) -> set[str]:
        """Those that a record must have."""
        return self.named() - self.optional


LAYOUTS = (
    Layout("conv_id", turn="turn", role="role", text="text"),
    Layout("id", each="messages", role="role", text="content"),
    Layout("id", each="conversations", role="from", text="value"),
    Layout("id", parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout(
        "id",
        parts=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
        optional=frozenset({"system"}),
    ),
    Layout(
        "id",
        parts=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
        optional=frozenset({"input"}),
    ),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def paths_of_schema(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.ArrayType):
        return paths_of_schema(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        inner = (paths_of_schema(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind)
        return set().union(*inner)
    return {at}


def paths_of_record(value: object, at: str = "") -> set[str]:
    if isinstance(value, list):
        return set().union(*(paths_of_record(v, f"{at}[]") for v in value))
    if isinstance(value, dict):
        inner = (paths_of_record(v, f"{at}.{k}" if at else k) for k, v in value.items())
        return set().union(*inner)
    return {at}


class Layouts:
    """Layouts by the fingerprint of the paths that a record has of theirs."""

    def __init__(self, layouts: tuple[Layout, ...]) -> None:
        self.layouts = layouts
        self.named = set().union(*(layout.named() for layout in layouts))
        self.chosen: dict[str, Layout | None] = {}

    def of(self, paths: set[str]) -> Layout | None:
        own = paths & self.named
        key = fingerprint(own)
        if key not in self.chosen:
            fitting = [layout for layout in self.layouts if layout.paths() <= own]
            self.chosen[key] = max(fitting, key=lambda fit: len(fit.named() & own), default=None)
        return self.chosen[key]


def turns_of_table(table: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns of a table whose schema holds a known layout; else ``KeyError``.

    Further columns play no part. Ids and turn numbers that are no 64-bit numbers become
    null, roles and texts strings.
    """
    paths = paths_of_schema(table.schema)
    layout = Layouts(layouts).of(paths)
    if layout is None:
        raise KeyError(f"no layout for {sorted(paths)}")
    own = F.col(layout.id).try_cast("long").alias("conv_id")
    if layout.each:
        turn = table.select(own, F.posexplode(layout.each).alias("turn", "_"))
        role, text = F.col(f"_.{layout.role}"), F.col(f"_.{layout.text}")
    elif layout.parts:
        told = F.array(
            *(
                F.struct(F.lit(r).alias("role"), F.col(f).cast("string").alias("text"))
                for r, f in layout.parts
                if f in paths
            )
        )
        turn = table.select(own, F.posexplode(told).alias("turn", "_"))
        role, text = F.col("_.role"), F.col("_.text")
    else:
        turn = table.select(own, *(F.col(c).alias(n) for n, c in (
            ("turn", layout.turn), ("_role", layout.role), ("_text", layout.text))))
        role, text = F.col("_role"), F.col("_text")
    return turn.select(
        "conv_id",
        F.col("turn").try_cast("long").alias("turn"),
        _role(role.cast("string")),
        text.cast("string").alias("text"),
    )


def _role(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(known[role], role).alias("role")


def turns_of_records(
    records: DataFrame, column: str, layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """Canonical turns of JSON records, each of its own layout.

    Fields that the layout does not name play no part; a missing role or text of a listed
    turn is null. Records that are null, no JSON, of an unknown layout, with an empty list
    of turns, with an id or turn that is no 64-bit number (digits in a string are one), or
    with a role or text that is neither a string nor null give none; ``unmatched`` finds them.
    """
    roles = dict(ROLES)
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    )

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Layouts(layouts)

        def rows():
            for batch in given:
                for value in batch[0]:
                    for number, turn, role, text in _told(value.as_py(), known):
                        yield len(text or ""), (number, turn, roles.get(role, role), text)

        return batches(rows(), schema)

    return records.select(column).mapInArrow(run, TURNS)


def unmatched(
    records: DataFrame, column: str, layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """The records that ``turns_of_records`` has no turns for."""

    @F.arrow_udf("boolean")
    def unknown(values: pa.Array) -> pa.Array:
        known = Layouts(layouts)
        return pa.array([not _told(value.as_py(), known) for value in values], pa.bool_())

    return records.where(unknown(F.col(column)))


def _number(value: object) -> int | None:
    """A whole number of 64 bits, also one in digits; None for anything else."""
    if isinstance(value, str) and re.fullmatch(r"-?[0-9]{1,19}", value):
        value = int(value)
    whole = isinstance(value, int) and not isinstance(value, bool)
    return value if whole and -(1 << 63) <= value < 1 << 63 else None


def _is_text(value: object) -> bool:
    """Null, or a string that UTF-8 can hold: half of a surrogate pair is none."""
    if isinstance(value, str):
        return not re.search("[\ud800-\udfff]", value)
    return value is None


def _told(value: str | None, known: Layouts) -> list[tuple[int, int | None, str | None, str | None]]:
    """The turns of a record (id, number, role, text), or none if it has no fitting layout."""
    try:
        record = json.loads(value) if value else None
        layout = known.of(paths_of_record(record)) if isinstance(record, dict) else None
    except (ValueError, RecursionError):
        return []
    if layout is None:
        return []
    if layout.each:
        listed = record.get(layout.each)
        if not isinstance(listed, list) or not all(isinstance(turn, dict) for turn in listed):
            return []
        told = [(k, turn.get(layout.role), turn.get(layout.text)) for k, turn in enumerate(listed)]
    elif layout.parts:
        parts = [(role, record[field]) for role, field in layout.parts if field in record]
        told = [(k, role, text) for k, (role, text) in enumerate(parts)]
    else:
        turn = _number(record.get(layout.turn))
        if turn is None and record.get(layout.turn) is not None:
            return []
        told = [(turn, record.get(layout.role), record.get(layout.text))]
    number = _number(record.get(layout.id))
    texts = all(_is_text(x) for _, *both in told for x in both)
    return [(number, *turn) for turn in told] if number is not None and texts else []


def _escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<>])", r"\\$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """The turns with ``segment`` and the loss mask in it: code points ``loss_from`` up to
    ``loss_to`` (equal, if the turn is not the assistant's). Null roles and texts count as
    empty."""
    head = F.concat(F.lit("<turn "), _escaped(F.col("role")), F.lit(">"))
    body = _escaped(F.col("text"))
    begin = F.length(head)
    is_loss = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(head, body, F.lit("</turn>\n")).alias("segment"),
        begin.alias("loss_from"),
        F.when(is_loss, begin + F.length(body)).otherwise(begin).alias("loss_to"),
    )


SEGMENT = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.DOTALL)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its segments say: ``n_turns``, ``turns_sha256`` (of role, newline,
    text, newline per turn), ``loss_chars``, ``loss_sha256`` (of the unescaped text under
    the mask) and ``formatted_chars``.

    Turns follow their number, nulls last, then role and text, so equal numbers have an
    order too. Rows without a conversation id form one conversation. Conversations are
    dealt out whole, and read row by row.
    """
    order = ["conv_id", F.asc_nulls_last("turn"), "role", "text"]
    rows = (
        formatted.repartition("conv_id")
        .sortWithinPartitions(*order)
        .select("conv_id", "segment", "loss_from", "loss_to")
    )
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )
    pattern = SEGMENT.pattern

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment_of = re.compile(pattern, re.DOTALL)

        def conversations():
            held = None
            for batch in given:
                for row in zip(*batch.columns, strict=True):
                    conv_id, segment, begin, end = (v.as_py() for v in row)
                    if held is None or held[0] != conv_id:
                        if held is not None:
                            yield 200, _closed(held)
                        held = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    match = segment_of.fullmatch(segment)
                    role, text = unescape(match[1]), unescape(match[2])
                    loss = unescape(segment[begin:end])
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                    held[3] += len(loss)
                    held[4].update(loss.encode())
                    held[5] += len(segment)
            if held is not None:
                yield 200, _closed(held)

        return batches(conversations(), schema)

    ddl = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long"
    )
    return rows.mapInArrow(run, ddl)


def _closed(held: list) -> tuple:
    return tuple(v.hexdigest() if hasattr(v, "hexdigest") else v for v in held)
