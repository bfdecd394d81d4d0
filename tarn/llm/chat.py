"""Chat formatting from a declarative template, with turn-order validation and loss segments.

A finite-state machine over roles checks the order of turns. Every turn becomes three text
segments with a loss flag each: header, text, close. Only assistant texts carry loss. Control strings
inside texts (and inside role names that the template doesn't know) get a backslash before them and
backslashes are doubled, so that ``read_turn`` gets back exactly what went in.

Turns are dealt by conversation and sorted by turn, then streamed: a conversation of any length
needs the memory of one batch only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table


@dataclass(frozen=True)
class ChatTemplate:
    """Headers by role, the header of any other role, the close, and the turn order as state -> role -> state."""

    headers: dict[str, str] = field(
        default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ", "tool": "### Tool: "}
    )
    other: tuple[str, str] = ("### Role (", "): ")
    close: str = "</turn>\n"
    control: tuple[str, ...] = ("###", "</turn>", "): ")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "asked", "user": "user"},
            "asked": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"assistant": "assistant"},
        }
    )
    accept: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        for c in self.control:
            for end in (self.close, self.other[1]):
                if any(end.startswith(c[k:]) for k in range(1, len(c))):
                    raise ValueError(f"a text that ends in part of {c!r} could run into {end!r}")
        if not all(h.startswith(self.control) for h in [*self.headers.values(), self.other[0]]) or not self.close.startswith(self.control):
            raise ValueError("headers and the close must start with a control string")

    def escape(self, text: str) -> str:
        return re.sub("(?=" + "|".join(map(re.escape, ("\\", *self.control))) + ")", r"\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        head = self.headers.get(role) or self.other[0] + self.escape(role) + self.other[1]
        return [(head, False), (self.escape(text), role in self.loss_roles), (self.close, False)]

    def _until(self, text: str, stop: str, at: int) -> int:
        """Where an unescaped ``stop`` begins."""
        found = re.compile(r"(?:[^\\]|\\.)*?(?=" + re.escape(stop) + ")", re.DOTALL).match(text, at)
        if found is None:
            raise ValueError(f"{stop!r} is missing")
        return found.end()

    def read_turn(self, text: str, at: int = 0) -> tuple[str, str, int]:
        """Role and text of the turn that begins at ``at`` of a formatted text, and where it ends."""
        for role, head in self.headers.items():
            if text.startswith(head, at):
                at += len(head)
                break
        else:
            if not text.startswith(self.other[0], at):
                raise ValueError(f"no header at {at}")
            at += len(self.other[0])
            end = self._until(text, self.other[1], at)
            role, at = self.unescape(text[at:end]), end + len(self.other[1])
        end = self._until(text, self.close, at)
        return role, self.unescape(text[at:end]), end + len(self.close)

    def step(self, state: str, role: str) -> tuple[str, str | None]:
        """The state after a turn, and what is wrong with it. After a mistake the machine goes on from that role."""
        to = self.order.get(state, {}).get(role)
        if to is not None:
            return to, None
        known = next((x[role] for x in self.order.values() if role in x), state)
        return known, f"{role or 'no role'} after {state}"


_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
_FORMATTED = "seq long, role string, segments array<struct<text:string,loss:boolean>>, state string, error string"


def format_turns(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """conv_id, seq (0 is the first), role, segments, state and error of every turn.

    Turns are taken by turn number, then role, then text, nulls first; a null text or role is empty, a null conv_id
    is a conversation of its own. A turn out of order is formatted like any other and has ``error`` set. Repeated
    rows are turns of their own; extra columns are ignored; an empty table gives an empty one. In the result a
    conversation's turns stand together in one partition, in order.
    """
    t = template or ChatTemplate()
    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = turns.select("conv_id").schema
    schema = f"conv_id {schema[0].dataType.simpleString()}, {_FORMATTED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, state = object(), 0, t.start
        for batch in batches:
            out = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if conv != now:
                    now, seq, state = conv, 0, t.start
                state, error = t.step(state, role or "")
                out.append((seq, role or "", [{"text": a, "loss": b} for a, b in t.segments(role or "", text or "")], state, error))
                seq += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), _SEGMENTS, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))],
                ["conv_id", "seq", "role", "segments", "state", "error"],
            )

    return map_arrow(dealt, run, schema)


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, n_errors long"


def read_back(formatted: DataFrame, template: ChatTemplate | None = None, in_order: bool = False) -> DataFrame:
    """Digests of every conversation in a result of ``format_turns``, from its segments' texts and loss flags alone.

    ``in_order`` says that conversations stand together and their turns in order, as in a result of ``format_turns`` itself; one that was
    written and read again is dealt and sorted first. A turn out of place is an error.
    """
    t = template or ChatTemplate()
    formatted = formatted.select("conv_id", "seq", "segments", "state", "error")
    formatted = formatted if in_order else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nobody = object()
        now, done = nobody, []

        def close():
            if now is not nobody:
                done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, state in t.accept and not errors, errors))

        def flush(key_type):
            cols = list(zip(*done, strict=True)) if done else [[]] * 8
            kinds = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64())
            names = ["conv_id", *(x.split()[0] for x in _DIGEST.split(", "))]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)
            done.clear()
            return made

        for batch in batches:
            key_type = batch.schema.field(0).type
            for conv, seq, segments, at, error in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if now is nobody or conv != now:
                    close()
                    now, n, chars, loss_chars, errors, state = conv, 0, 0, 0, 0, t.start
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                if seq != n:
                    raise ValueError(f"turn {seq} of conversation {conv} stands where turn {n} is due")
                text = "".join(s["text"] for s in segments)
                role, said, end = t.read_turn(text)
                if end != len(text):
                    raise ValueError("a turn's text goes on after its close")
                turns.update(f"{role}\n{said}\n".encode())
                under = t.unescape("".join(s["text"] for s in segments if s["loss"]))
                loss.update(under.encode())
                n, chars, loss_chars, errors, state = n + 1, chars + len(text), loss_chars + len(under), errors + (error is not None), at
            yield flush(key_type)
        if now is not nobody:
            close()
            yield flush(key_type)

    return map_arrow(formatted, run, f"conv_id {kind}, {_DIGEST}")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    fixed = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return read_back(format_turns(turns), in_order=True).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _escaped_length(x: str) -> str:
    """SQL for the code points of an escaped text: a backslash before each backslash and control string, which may overlap itself."""
    gone = lambda c: f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}"
    marks = f"coalesce(list_sum(list_transform(regexp_extract_all({x}, '#{{3,}}'), lambda r: length(r) - 2)), 0)"
    return f"(length({x}) + {' + '.join(gone(c) for c in (chr(92), '</turn>', '): '))} + {marks})"


OP2_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, role, text FROM conversations
  UNION ALL SELECT -7, k, v, '{chr(92)}### Assistant: </turn> ok', v, '' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(k, v)
), sized AS (
  SELECT *, CASE r WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 WHEN 'tool' THEN 10 ELSE 13 + {_escaped_length('r')} END + {_escaped_length('x')} + 8 AS n FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
