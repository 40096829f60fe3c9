"""Formatting conversations by a compiled template, with spans for the loss mask.

Control strings inside texts and roles are made harmless reversibly: one backslash
goes after the first character of each, before any that are there already; a text
without control strings stays as it is.  Reading back takes one away again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.templates import Template

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
TEMPLATE = """
{%- for m in messages -%}
{%- if m.role == 'user' -%} {{ '[INST] ' + (m.text | escape) + ' [/INST]' }}
{%- elif m.role == 'assistant' -%} {{ '<s>' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
{%- elif m.role == 'system' -%} {{ '<<SYS>>' + (m.text | escape) + '<</SYS>>' }}
{%- else -%} {{ '<<ROLE>>' + (m.role | escape) + '<</ROLE>>' + (m.text | escape) + '</s>' }}
{%- endif -%}
{%- endfor -%}
"""
#: how each turn starts and ends
MARKS = {"[INST] ": ("user", " [/INST]"), "<s>": ("assistant", "</s>"), "<<SYS>>": ("system", "<</SYS>>"), "<<ROLE>>": (None, "</s>")}

_ANY = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS)
_HARMFUL = re.compile(_ANY)


def escape(text: str | None) -> str:
    return _HARMFUL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text or "")


def unescape(text: str) -> str:
    return _HARMFUL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


@lru_cache(maxsize=16)
def compiled(source: str) -> Template:
    return Template(source, {"escape": escape})


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of what the default template wrote; anything else is an error."""
    out, at = [], 0
    while at < len(formatted):
        start = next((s for s in MARKS if formatted.startswith(s, at)), None)
        if start is None:
            raise ValueError(f"no turn starts at {at}")
        role, end = MARKS[start]
        at += len(start)
        if role is None:
            stop = formatted.index("<</ROLE>>", at)
            role, at = unescape(formatted[at:stop]), stop + len("<</ROLE>>")
        stop = formatted.index(end, at)
        out.append((role, unescape(formatted[at:stop])))
        at = stop + len(end)
    return out


FORMATTED = "conv_id long, n_turns long, formatted string, spans array<struct<start: long, end: long>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, text)``: text and loss spans in code points.

    Turns follow ``turn``, null first, equal ones by role and text; a null text or
    role is empty, repeated rows are turns of their own, and rows without conv_id
    are one conversation.  Rows are sorted on the executors, on disk if need be, and
    a task holds one conversation at a time.  Other columns are not read; an empty
    table gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template).render
        rows: list = []
        size = 0
        key: object = run  # no conversation's id
        held: list[dict] = []

        def close() -> int:
            text, spans = render(messages=held)
            rows.append((key, len(held), text, [{"start": a, "end": b} for a, b in spans]))
            return len(text)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        for batch in batches:
            for k, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if held:
                        size += close()
                    key, held = k, []
                    if size > 1 << 22:
                        yield flush()
                        rows, size = [], 0
                held.append({"role": role or "", "text": text or ""})
        if held:
            close()
        if rows:
            yield flush()

    # the turn decides the order; the hash of the conversation only deals the rows out
    dealt = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, FORMATTED)
