"""Chat formatting that is proven reversible, turn by turn.

A turn is rendered as ``<|im_start|>role``, a line break, the text, ``<|im_end|>``
and a line break.  A deterministic parser reads the rendered turn again; where
what it recovers differs from the source, the conflicting content is escaped by
one more backslash and parsed again, until both are identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: What the parser unescapes: it takes one backslash out of ``<\\|`` and, in roles, reads ``\\n`` and ``\\\\``.
_ESCAPED = re.compile(r"<(\\*)\\\|")
_OPENING = re.compile(r"<(\\*)\|")
_ROLE_ESCAPED = re.compile(r"\\([\\n])")


def escape(text: str) -> str:
    return _OPENING.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, first and end position of the rendered text) of each turn; None where the grammar does not hold."""
    turns, at = [], 0
    while at < len(rendered):
        line = rendered.find("\n", at)
        if not rendered.startswith(START, at) or line < 0:
            return None
        head = rendered[at + len(START) : line]
        end = rendered.find(END, line + 1)
        if end < 0 or START in head or END in head or rendered.find(START, line + 1, end) >= 0 or not rendered.startswith("\n", end + len(END)):
            return None
        turns.append((unescape_role(head), unescape(rendered[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn that parses back to exactly (role, text), and the place of its text."""
    shown_role, shown = role, text
    while True:
        rendered = f"{START}{shown_role}\n{shown}{END}\n"
        found = parse(rendered)
        if found is not None and len(found) == 1 and found[0][:2] == (role, text):
            return rendered, found[0][2], found[0][3]
        # Escape what does not come back by itself; a role's or a text's own backslashes are then escaped as well.
        role_back = unescape_role(shown_role) == role and not ("\n" in shown_role or START in shown_role or END in shown_role)
        text_back = unescape(shown) == text and START not in shown and END not in shown
        if (role_back and text_back) or (not role_back and shown_role != role) or (not text_back and shown != text):
            raise ValueError("the template's escapes do not bring a turn back")
        shown_role = shown_role if role_back else escape_role(role)
        shown = shown if text_back else escape(text)


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, rendered, loss_start, loss_end) of every row, each turn by itself.

    The rendered turns of a conversation in order are its formatted text.  The
    loss mask covers the rendered text of assistant turns, by code points from
    the turn's first; other turns have an empty one.  NULL roles and texts are
    empty strings.  Rows with equal turns are turns of their own.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = ([x or "" for x in batch.column(c).to_pylist()] for c in (2, 3))
            found = [render(*x) for x in zip(roles, texts)]
            spans = [(a, b) if r == LOSS_ROLE else (a, a) for r, (_, a, b) in zip(roles, found)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), *(pa.array([s[k] for s in spans], pa.int64()) for k in (0, 1))],
                [conv_id, turn, "rendered", "loss_start", "loss_end"],
            )

    kinds = [f"`{c}` {turns.schema[c].dataType.simpleString()}" for c in (conv_id, turn)]
    source = turns.select(conv_id, turn, F.col(role).cast("string").alias("_role"), F.col(text).alias("_text"))
    return source.mapInArrow(scan, f"{', '.join(kinds)}, rendered string, loss_start long, loss_end long")


def _digest(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rendered turns; one row per conversation.  Only running digests are held, however long it is."""
    key, begun, state = None, False, None

    def result() -> pa.RecordBatch:
        n, turns, chars, loss, formatted = state
        return pa.record_batch([key, *([x] for x in (n, turns.hexdigest(), chars, loss.hexdigest(), formatted))], names)

    for batch in batches:
        ids = batch.column(0)
        for k in range(batch.num_rows):
            if not begun or ids[k].as_py() != key[0].as_py():
                if begun:
                    yield result()
                key, begun, state = ids.slice(k, 1), True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            rendered, a, b = (batch.column(c)[k].as_py() for c in (1, 2, 3))
            ((role, text, _, _),) = parse(rendered)
            learned = unescape(rendered[a:b])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(rendered)
    if begun:
        yield result()


def read_back(formatted: DataFrame, order: list[str | Column], conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) parsed from rendered turns.

    A conversation's digest runs over its turns in order, so they pass through
    one task; it streams them in sorted runs that spill, and holds one at a time.
    """
    names = [conv_id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema[conv_id].dataType.simpleString()
    ordered = formatted.repartition(conv_id).sortWithinPartitions(conv_id, *order).select(conv_id, "rendered", "loss_start", "loss_end")
    schema = f"`{conv_id}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(lambda batches: _digest(batches, names), schema)
