"""Chat formatting with a grammar round trip.

A conversation is rendered by a template; the rendering is read again by a deterministic parser of
the template's grammar, and the turns found are compared with the source. Turns that do not
come back as they were are escaped, until the whole comes back identical:

    conversation = turn*        turn = "<|im_start|>" role "\\n" text "<|im_end|>\\n"

A role has no line break and neither part has "<|". Escaping puts one backslash more between
every "<" and "|" that has none or only backslashes between them (and writes a line break in a role
as "<\\\\n|", a written one with one backslash more); the parser takes one away. What was escaped has no
"<|" left, so it is read back whole, and every conversation converges.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, TRAINED = "<|im_start|>", "<|im_end|>\n", "assistant"
_TURN = re.compile(re.escape(START) + r"((?:(?!<\|)[^\n])*)\n((?:(?!<\|)[\s\S])*)" + re.escape(END))
Turn = tuple[str, str]


def escape(part: str) -> str:
    """The part without ``<|`` and line-break-safe marks; inverse of :func:`unescape`."""
    return re.sub(r"<(\\*)(n?)\|", r"<\\\1\2|", part)


def unescape(part: str) -> str:
    """What :func:`escape` was given; a part without marks is itself."""
    return re.sub(r"<\\(\\*)(n?)\|", r"<\1\2|", part)


def escape_role(role: str) -> str:
    """As :func:`escape`, with line breaks written as a mark."""
    return escape(role).replace("\n", "<n|")


def unescape_role(role: str) -> str:
    return unescape(role.replace("<n|", "\n"))


def render(turns: Sequence[Turn]) -> str:
    return "".join(f"{START}{role}\n{text}{END}" for role, text in turns)


def parse(formatted: str) -> list[tuple[Turn, tuple[int, int]]] | None:
    """Turns, unescaped, with the place of each text; None if the grammar does not fit."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            return None
        out.append(((unescape_role(m[1]), unescape(m[2])), m.span(2)))
        at = m.end()
    return out


def turns_of(formatted: str) -> list[Turn] | None:
    found = parse(formatted)
    return None if found is None else [turn for turn, _ in found]


def format_chat(turns: Sequence[Turn]) -> str:
    """The rendering whose parse is the source, with as few turns escaped as that takes."""
    written = list(turns)
    if turns_of(render(written)) == written:
        return render(written)
    for k, (role, text) in enumerate(turns):
        if turns_of(render([(role, text)])) != [(role, text)]:
            written[k] = (escape_role(role), escape(text))
    if turns_of(render(written)) != list(turns):  # a conflict between turns
        written = [(escape_role(role), escape(text)) for role, text in turns]
    formatted = render(written)
    if turns_of(formatted) != list(turns):
        raise ValueError("the template's grammar is not reversible")
    return formatted


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_col``, formatted, loss_spans (start and end in formatted of
    every text to train on, in order), and what is read back from these: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.

    Turns stand by ``turn_col``, ties by role, then text; repeated rows are turns of their own. A null
    role or text is empty; rows without a conversation id form one conversation. Other columns are
    not read. A conversation becomes one value, so one task holds it: its length is bounded by
    what a value can hold, not by the number of conversations.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column(1).to_pylist():
                formatted = format_chat([(t["role"], t["text"]) for t in turns])
                read = parse(formatted)
                spans = [span for (role, _), span in read if role == TRAINED]
                loss = "".join(unescape(formatted[a:b]) for a, b in spans)
                said = "".join(f"{role}\n{text}\n" for (role, text), _ in read)
                spans = [{"start": a, "end": b} for a, b in spans]
                out.append((formatted, spans, len(read), _sha(said), len(loss), _sha(loss), len(formatted)))
            columns = list(zip(*out)) if out else [()] * len(schema)
            arrays = [pa.array(c, t) for c, t in zip(columns, schema.types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *schema.names])

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([
        ("formatted", pa.string()), ("loss_spans", pa.list_(span)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])
    empty = F.lit("")
    turns = rows.groupBy(F.col(conv_col).alias("id")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(turn_col).alias("turn"),
                    F.coalesce(F.col(role_col), empty).alias("role"),
                    F.coalesce(F.col(text_col), empty).alias("text"),
                )
            )
        ).alias("turns")
    )
    kind = rows.schema[conv_col].dataType.simpleString()
    out = turns.mapInArrow(
        run,
        f"id {kind}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, n_turns bigint, turns_sha256 string, "
        "loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
    return out.withColumnRenamed("id", conv_col)
