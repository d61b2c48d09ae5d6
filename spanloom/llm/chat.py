"""Chat formatting: a finite-state machine over roles and a declarative template with per-segment loss flags.

A template gives each role an opening mark, a closing mark and whether its text carries loss. Turns become segments
``(conv_id, pos, part, text, loss)``: mark, escaped text, mark. Inside texts (and role names) every control string of the
template is broken by an escape that :func:`unescape` takes out again, so a reader that looks for marks finds only real
ones. Conversations are hash-partitioned and sorted, and read as a stream: a task holds one turn at a time, however long
the conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, pos long, part int, text string, loss boolean, valid boolean"


@dataclass(frozen=True)
class Mark:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``other`` serves roles without a mark of their own; its opening holds ``{role}``. ``moves`` maps (state, role) to the
    next state; a pair that is absent is an error of turn order, and so is a conversation that ends in a state that is not
    ``final``. Control strings must not hold the escape character."""

    marks: dict[str, Mark]
    other: Mark
    controls: tuple[str, ...]
    start: str
    moves: dict[tuple[str, str], str]
    final: frozenset[str]
    escape: str = "\\"
    pattern: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if any(self.escape in c for c in self.controls):
            raise ValueError("a control string holds the escape character")
        object.__setattr__(self, "pattern", re.compile("|".join([re.escape(self.escape), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)])))

    def escaped(self, text: str) -> str:
        """Doubles escapes and puts escape + "-" after the first character of every control string."""
        e = self.escape
        return self.pattern.sub(lambda m: e + e if m.group() == e else m.group() + e + "-", text)

    def unescape(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(f"{e}({e}|-)", lambda m: self.escape if m.group(1) == self.escape else "", text)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        mark = self.marks.get(role, self.other)
        stop = self.other.opening.partition("{role}")[2][:1]  # what ends a name in the opening is broken inside the name, too
        name = self.escaped(role).replace(stop, f"{stop}{self.escape}-")
        return [(mark.opening.replace("{role}", name), False), (self.escaped(text), mark.loss), (mark.closing, False)]


INSTRUCT = Template(
    marks={"system": Mark("<s>[SYS] ", " [/SYS]</s>"), "user": Mark("<s>[INST] ", " [/INST]</s>"), "assistant": Mark("<s>[ANS] ", " [/ANS]</s>", loss=True)},
    other=Mark("<s>[ROLE:{role}] ", " [/ROLE]</s>"),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "[/ANS]", "[SYS]", "[/SYS]", "[ROLE:", "[/ROLE]"),
    start="begin",
    moves={("begin", "system"): "told", ("begin", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    final=frozenset({"asked", "answered"}),
)


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def formatted(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments of all conversations: three rows a turn, in order of ``conv_id, pos, part``.

    Turns of a conversation are ordered by turn (null first), role and text; repeated rows are turns of their own. A null
    text or role is empty; a role without a mark uses the template's ``other``. ``valid`` is false from the first turn that
    breaks the role order on, in that conversation; such turns are formatted all the same. Rows without ``conv_id`` form
    one conversation. A very long text is formatted whole: memory is one turn. Other columns are ignored, and an empty table
    gives no segments.
    """

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, pos, state = object(), 0, template.start
        for frame in frames:
            out = []
            for conv, role, text in zip(frame["conv_id"], frame["role"], frame["text"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if conv != current:
                    current, pos, state = conv, 0, template.start
                state = template.moves.get((state, role), "wrong")
                out += [(conv, pos, part, piece, loss, state != "wrong") for part, (piece, loss) in enumerate(template.turn(role, text))]
                pos += 1
            frame = pd.DataFrame(out, columns=["conv_id", "pos", "part", "text", "loss", "valid"])
            yield frame.astype({"conv_id": "Int64"})

    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return _sorted(rows, "turn", "role", "text").mapInPandas(apply, SEGMENTS)


class Reader:
    """Reads formatted text back, fed in pieces; :meth:`feed` returns the turns that are complete."""

    def __init__(self, template: Template):
        self.template, self.buffer = template, ""
        literal = re.escape(template.other.opening).replace(re.escape("{role}"), "(?P<role>.*?)")
        self.openings = [(re.compile(re.escape(m.opening)), role, m) for role, m in template.marks.items()] + [(re.compile(literal, re.S), None, template.other)]

    def feed(self, text: str) -> Iterator[tuple[str, str, bool]]:
        self.buffer += text
        for pattern, role, mark in self.openings:
            if found := pattern.match(self.buffer):
                end = self.buffer.find(mark.closing, found.end())
                if end >= 0:
                    name = role if role is not None else self.template.unescape(found["role"])
                    content = self.template.unescape(self.buffer[found.end() : end])
                    self.buffer = self.buffer[end + len(mark.closing) :]
                    yield name, content, mark.loss
                return


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = INSTRUCT, *, in_order: bool = False) -> DataFrame:
    """One row per conversation, from the formatted text and the loss flags alone: digests of the turns and of the loss text.

    The turns come from parsing the text; the loss text is what the segments flagged with loss hold, unescaped. ``valid`` tells
    whether the roles that were read follow the template's order and end in a final state. ``in_order`` is for the frame that
    :func:`formatted` returned, as it is: its conversations lie whole and sorted in their partitions, so nothing is shuffled.
    """

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = object()
        reader = turns = loss = None
        n = chars = total = 0
        valid, state = True, template.start

        def row():
            if reader.buffer:
                raise ValueError(f"conversation {current}: unread text at the end")
            return current, n, turns.hexdigest(), chars, loss.hexdigest(), total, valid and state in template.final

        def table(out):
            return pd.DataFrame(out, columns=[c.split()[0] for c in DIGESTS.split(", ")]).astype({"conv_id": "Int64"})

        for frame in frames:
            out = []
            for conv, text, flag, ok in zip(frame["conv_id"], frame["text"], frame["loss"], frame["valid"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if conv != current:
                    if reader:
                        out.append(row())
                    current, reader, turns, loss, n, chars, total, valid, state = conv, Reader(template), hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True, template.start
                total += len(text)
                valid &= bool(ok)
                if flag:
                    plain = template.unescape(text)
                    chars += len(plain)
                    loss.update(plain.encode())
                for role, content, _ in reader.feed(text):
                    turns.update(f"{role}\n{content}\n".encode())
                    state = template.moves.get((state, role), "wrong")
                    n += 1
            if out:
                yield table(out)
        if reader:
            yield table([row()])

    return (segments if in_order else _sorted(segments, "pos", "part")).mapInPandas(apply, DIGESTS)
