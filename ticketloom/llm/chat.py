"""Chat formatting: a finite-state machine over roles, and segments with a loss flag from a template.

Turns are read in order, conversation by conversation. The machine says for every turn whether its
role may follow the one before. The template, which is data, gives each role the text that stands
before and after its turn and whether its text counts for the loss. Every turn becomes three segments:
before, text, after. Strings of the template that occur inside a text are escaped with a backslash
after their first character, and backslashes are doubled, so that the output can be read back exactly.

Rows are dealt by conversation and sorted; tasks stream over them and hold one turn at a time, however
long a conversation is. Null texts are empty, a null role is an empty role, a null conversation is one
of its own, null turns come first; equal turn numbers follow by role and text. Turns out of order keep
their segments and are marked. An empty table gives no segments. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of every role; ``other`` serves roles that are not named and shows them in its mark."""

    roles: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    loss: frozenset[str]
    follows: dict[str, frozenset[str]]  # state (role before, "" at the start): roles that may come
    pattern: re.Pattern = field(init=False)

    def __post_init__(self):
        marks = [m.strip() for pair in [*self.roles.values(), self.other] for m in pair]
        ordered = sorted({m for m in marks if m}, key=lambda m: (-len(m), m))
        if any("\\" in m or len(m) < 2 for m in ordered):
            raise ValueError("marks need two characters or more and no backslash")
        object.__setattr__(self, "pattern", re.compile("|".join(map(re.escape, ordered))))

    def escape(self, text: str) -> str:
        return self.pattern.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    def marks(self, role: str) -> tuple[str, str]:
        if role in self.roles:
            return self.roles[role]
        before, between, after = self.other
        return before + self.escape(role) + between, after


_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


INSTRUCT = Template(
    roles={"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>\n")},
    other=("<<ROLE>> ", " <</NAME>> ", " <</ROLE>>\n"),
    loss=frozenset({"assistant"}),
    follows={
        "": frozenset({"system", "user"}),
        "system": frozenset({"user"}),
        "user": frozenset({"assistant"}),
        "assistant": frozenset({"user", "tool"}),
        "tool": frozenset({"assistant", "tool"}),
    },
)


def segments(df: DataFrame, conversation: str, turn: str, role: str, text: str, template: Template = INSTRUCT) -> DataFrame:
    """``conversation``, ``segment`` (from 0), ``text``, ``loss`` and ``legal``, in order within partitions.

    A stored copy is brought back into order by sorting on conversation and segment.
    """
    ordered = (
        df.select(conversation, turn, F.coalesce(role, F.lit("")).alias("_role"), F.coalesce(text, F.lit("")).alias("_text"))
        .repartition(F.col(conversation))
        .sortWithinPartitions(conversation, turn, "_role", "_text")
    )
    kind = df.select(conversation).schema[conversation].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, number = object(), "", 0
        for batch in batches:
            keys, out = batch.column(0), ([], [], [], [], [])
            for i, (key, who, said) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
                if key != now:
                    now, state, number = key, "", 0
                legal = who in template.follows.get(state, ())
                before, after = template.marks(who)
                for piece, loss in ((before, False), (template.escape(said), who in template.loss), (after, False)):
                    for column, value in zip(out, (i, number, piece, loss, legal)):
                        column.append(value)
                    number += 1
                state = who
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                 pa.array(out[3], pa.bool_()), pa.array(out[4], pa.bool_())],
                names=[conversation, "segment", "text", "loss", "legal"],
            )

    return ordered.mapInArrow(run, f"`{conversation}` {kind}, segment long, text string, loss boolean, legal boolean")


class Reader:
    """Reads one formatted conversation back, fed with its segments in order."""

    def __init__(self, template: Template):
        self.template, self.waiting, self.chars, self.turns, self.loss_chars, self.illegal = template, "", 0, 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, loss: bool, legal: bool) -> None:
        self.chars += len(text)
        self.waiting += text
        if loss:
            said = unescape(text)
            self.loss_chars += len(said)
            self.loss_sha.update(said.encode())
        self.illegal += not legal
        while (found := self._turn()) is not None:
            who, said, self.waiting = found
            self.turns += 1
            self.turns_sha.update(f"{who}\n{said}\n".encode())

    def _turn(self) -> tuple[str, str, str] | None:
        """Role, text and what follows, if a whole turn is waiting."""
        for who, (before, after) in self.template.roles.items():
            if self.waiting.startswith(before):
                end = self.waiting.find(after, len(before))
                return None if end < 0 else (who, unescape(self.waiting[len(before):end]), self.waiting[end + len(after):])
        before, between, after = self.template.other
        if self.waiting.startswith(before):
            name = self.waiting.find(between, len(before))
            end = self.waiting.find(after, name + len(between)) if name >= 0 else -1
            if end >= 0:
                who, said = self.waiting[len(before):name], self.waiting[name + len(between):end]
                return unescape(who), unescape(said), self.waiting[end + len(after):]
        return None

    def digest(self) -> tuple:
        if self.waiting:
            raise ValueError("formatted text that is no turn: " + self.waiting[:80])
        shas = self.turns_sha.hexdigest(), self.loss_sha.hexdigest()
        return self.turns, shas[0], self.loss_chars, shas[1], self.chars, self.illegal // 3


def read_back(formatted: DataFrame, conversation: str, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, from segments that are in order within partitions: turns and digests."""
    kind = formatted.schema[conversation].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_illegal_turns"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, schema = None, None, None
        done: list[tuple] = []
        for batch in batches:
            schema = schema or pa.schema([(conversation, batch.schema.field(0).type), *zip(names, kinds)])
            for key, *segment in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4))):
                if reader is None or key != now:
                    if reader:
                        done.append((now, *reader.digest()))
                    now, reader = key, Reader(template)
                reader.feed(*segment)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in done], schema=schema)
                done = []
        if reader:
            done.append((now, *reader.digest()))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in done], schema=schema)

    return formatted.mapInArrow(
        run,
        f"`{conversation}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_illegal_turns long",
    )
