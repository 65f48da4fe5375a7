"""Chat formatting with a grammar that is read back.

Grammar of a rendered conversation (turns follow each other with nothing between):

    conversation := turn*
    turn         := "[SYS] " text " [/SYS]" | "[INST] " text " [/INST]" | "<s> " text "</s>"
                  | "[ROLE] " text " [/ROLE]" " " text "</s>"

for system, user and assistant turns, and turns of any other role.  The control
strings mark turns, so they may not stand in a text.  A text that has one gets
a backslash after the control string's first character; strings that already
look like that get one more, so removing one backslash each restores the text.

Rendering proves itself.  A turn is rendered with its text as it is, read back
by the parser and compared with the source; only if they differ, its text is
escaped, and again until what comes back is the source.  A control string has
its opening character at its start only and texts end before such a character,
so turns that can be read back alone can be read back in a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings.  None is part of another one.
CONTROL = ("[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<s>", "</s>")

#: Opening and closing string of a text by role; other roles use the last pair.
FRAMES = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", "</s>")}
NAMED = ("[ROLE] ", " [/ROLE]")
OTHER = (" ", "</s>")
ROLE_OF = {frame[0].strip(): role for role, frame in FRAMES.items()}

_NAMES = "|".join(re.escape(c[1:]) for c in CONTROL)
_ANY = re.compile("|".join(map(re.escape, CONTROL)))
_TO_ESCAPE = re.compile(rf"([\[<])(?=\\*(?:{_NAMES}))")
_ESCAPED = re.compile(rf"([\[<])\\(?=\\*(?:{_NAMES}))")

_TURNS = "conv_id long, turn long, role string, text string, rendered string, loss_start int, loss_chars int"


class Unreadable(ValueError):
    """The text does not follow the grammar."""


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and where the escaped text starts and ends, for each turn."""
    at = 0

    def expect(prefix: str, start: int) -> int:
        if not rendered.startswith(prefix, start):
            raise Unreadable(f"no {prefix!r} at {start}")
        return start + len(prefix)

    def text_until(closing: str, start: int) -> tuple[int, int]:
        found = _ANY.search(rendered, start)
        if found is None or found.group() != closing.strip():
            raise Unreadable(f"no {closing!r} after {start}")
        end = found.end() - len(closing)
        if end < start or not rendered.startswith(closing, end):
            raise Unreadable(f"no {closing!r} after {start}")
        return end, found.end()

    while at < len(rendered):
        first = _ANY.match(rendered, at)
        if first is None:
            raise Unreadable(f"no turn at {at}")
        role = ROLE_OF.get(first.group())
        if role is not None:
            opening, closing = FRAMES[role]
            start = expect(opening, at)
        elif first.group() == NAMED[0].strip():
            start = expect(NAMED[0], at)
            end, after = text_until(NAMED[1], start)
            role = unescape(rendered[start:end])
            opening, closing = OTHER
            start = expect(opening, after)
        else:
            raise Unreadable(f"no turn at {at}")
        end, at = text_until(closing, start)
        yield role, unescape(rendered[start:end]), start, end


def _framed(role: str, text: str, named: str) -> str:
    opening, closing = FRAMES.get(role, OTHER)
    return ("" if role in FRAMES else f"{NAMED[0]}{named}{NAMED[1]}") + opening + text + closing


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and start and length of its escaped text."""
    named, inside = role, text
    while True:
        rendered = _framed(role, inside, named)
        try:
            turns = list(read_turns(rendered))
        except Unreadable:
            turns = []
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered, turns[0][2], turns[0][3] - turns[0][2]
        again = escape(text), escape(role)
        if (inside, named) == again:
            raise Unreadable(f"escaping does not help: {rendered[:200]!r}")
        inside, named = again


def _render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        made = [render_turn(role, text) for role, text in zip(frame.role, frame.text)]
        frame["rendered"] = [m[0] for m in made]
        frame["loss_start"] = pd.array([m[1] if role == "assistant" else 0 for m, role in zip(made, frame.role)], dtype="int32")
        frame["loss_chars"] = pd.array([m[2] if role == "assistant" else 0 for m, role in zip(made, frame.role)], dtype="int32")
        yield frame


def render(turns: DataFrame) -> DataFrame:
    """Adds ``rendered, loss_start, loss_chars`` to every turn (``conv_id, turn, role, text``).

    The loss mask of a turn is ``rendered[loss_start : loss_start + loss_chars]``:
    the escaped text of assistant turns, nothing of others.  Null texts and
    null roles are empty.  Turns need nothing of each other, so no
    conversation is gathered here.  Other columns are not carried.
    """
    read = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return read.mapInPandas(_render, _TURNS)


def _in_order(rendered: DataFrame) -> DataFrame:
    """Turns of a conversation in one partition, by turn; ties by role and text."""
    return rendered.select("conv_id", "turn", "role", "rendered", "loss_start", "loss_chars").repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "rendered")


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reader:
    """Reads one conversation back, turn by turn as its rendered text comes in."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def feed(self, rendered: str, loss_start: int, loss_chars: int) -> None:
        self.chars += len(rendered)
        for role, text, _, _ in read_turns(rendered):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        masked = unescape(rendered[loss_start:loss_start + loss_chars])
        self.loss_chars += len(masked)
        self.loss.update(masked.encode("utf-8", "surrogatepass"))

    def row(self, conv_id) -> tuple:
        return conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _DIGESTS.split(", ")]).astype({"conv_id": "Int64"})

    now, reader = None, None
    for frame in frames:
        done = []
        ids = [None if v is pd.NA else int(v) for v in frame.conv_id.astype("Int64")]
        for conv_id, rendered, start, chars in zip(ids, frame.rendered, frame.loss_start, frame.loss_chars):
            if reader is None or conv_id != now:
                if reader is not None:
                    done.append(reader.row(now))
                now, reader = conv_id, _Reader()
            reader.feed(rendered, int(start), int(chars))
        if done:
            yield table(done)
    if reader is not None:
        yield table([reader.row(now)])


def digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered text and its loss mask alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    Turns stream through a running digest, so a conversation of any length
    takes the memory of a turn.  A digest over a conversation is one chain, so
    its turns pass one task; rendering them did not.  A null ``conv_id`` is one
    conversation, and so are equal ids of repeated rows.
    """
    return _in_order(rendered).mapInPandas(_read_back, _DIGESTS)


def conversations(rendered: DataFrame, at_most: int = 10_000) -> DataFrame:
    """Whole rendered conversations: ``conv_id, part, formatted, loss_spans``.

    A conversation has a row per ``at_most`` turns, so that no row grows
    without bound; spans are start and length within the row's text.
    """
    schema = "conv_id long, part int, formatted string, loss_spans array<struct<start:int,chars:int>>"

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, texts, spans, size = object(), 0, [], [], 0

        def row() -> pd.DataFrame:
            out = pd.DataFrame({"conv_id": pd.array([now], dtype="Int64"), "part": [part], "formatted": ["".join(texts)]})
            out["loss_spans"] = [[{"start": s, "chars": n} for s, n in spans]]
            return out

        for frame in frames:
            for conv_id, text, start, chars in zip(frame.conv_id.astype("Int64"), frame.rendered, frame.loss_start, frame.loss_chars):
                conv_id = None if conv_id is pd.NA else int(conv_id)
                if texts and (conv_id != now or len(texts) >= at_most):
                    yield row()
                    part, texts, spans, size = part + 1, [], [], 0
                if conv_id != now:
                    now, part = conv_id, 0
                if chars:
                    spans.append((size + int(start), int(chars)))
                texts.append(text)
                size += len(text)
        if texts:
            yield row()

    return _in_order(rendered).mapInPandas(join, schema)


def planted(turns: DataFrame, conv_id: int, roles: tuple[str, ...], text: str) -> DataFrame:
    """``turns`` and one more conversation that says ``text`` in every role."""
    rows = [F.struct(F.lit(conv_id).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(text).alias("text"))
            for i, r in enumerate(roles)]
    extra = turns.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)

