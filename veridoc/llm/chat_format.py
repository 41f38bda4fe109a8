"""Chat formatting by a finite-state machine over roles and a declarative template, and reading it back.

A template says in what order roles may stand, how a turn is marked, and which roles' texts are learnt. The machine's
state is the role last read; each turn is a step, and a step that the template's order doesn't have is counted as out of
order (the turn is written nevertheless: formatting never drops text). Control strings inside a text or role get the
escape sign, so that what is written can be read back exactly: the marks that are left are the template's.

A conversation comes out as one row, or as several pieces in order where it is longer than PIECE code points or spans
tasks: turns are dealt by range of (conversation, turn), and a task keeps only the piece that it is writing. Each piece
has its text and the segments of it with a loss flag each. The step over a border between pieces is taken when they are
read back, from the last and first roles of the two.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Code points after which a piece ends, so that a batch of pieces is bounded.
PIECE = 1 << 13
#: Code points that a task writes out at once.
HELD = 1 << 20
START = "start"
OTHER = "other"


@dataclass(frozen=True)
class Template:
    """next: the roles that may follow each state; ends: states a conversation may end in; learnt: roles whose text has loss."""

    open: str = "### "
    after_role: str = ": "
    close: str = " </turn>\n"
    controls: tuple[str, ...] = ("### ", "</turn>", ": ")
    escape: str = "\\"
    next: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",), OTHER: ()})
    ends: tuple[str, ...] = ("assistant",)
    learnt: tuple[str, ...] = ("assistant",)

    def state(self, role: str) -> str:
        return role if role in self.next and role not in (START, OTHER) else OTHER

    def fits(self, state: str, role: str) -> bool:
        return role in self.next[state]

    def escaper(self):
        """A function that puts the escape sign before itself and before the first sign of each control string, overlapping ones too."""
        parts = [re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in self.controls]
        find = re.compile("|".join([re.escape(self.escape), *parts]))
        return lambda text: find.sub(lambda m: self.escape + m[0], text)

    def unescaper(self):
        find = re.compile(re.escape(self.escape) + "(.)", re.DOTALL)
        return lambda text: find.sub(lambda m: m[1], text)

    def reader(self):
        """A function from formatted text to (role, start and end of the text inside it, unescaped text) of each turn."""
        plain = rf"(?:[^{re.escape(self.escape)}]|{re.escape(self.escape)}.)*?"
        find = re.compile(f"{re.escape(self.open)}({plain}){re.escape(self.after_role)}({plain}){re.escape(self.close)}", re.DOTALL)
        plainly = self.unescaper()

        def read(text: str) -> Iterator[tuple[str, int, int, str]]:
            at = 0
            while at < len(text):
                m = find.match(text, at)
                if m is None:
                    raise ValueError(f"no turn of this template at {at}")
                yield plainly(m[1]), m.start(2), m.end(2), plainly(m[2])
                at = m.end()

        return read


SEGMENT = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("loss", pa.bool_())])
PIECES = "conv_id long, part long, nth long, formatted string, segments array<struct<start: int, length: int, loss: boolean>>, n_turns long, n_out_of_order long, first_role string, last_role string"


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text in tasks by range of conversation and turn, null turns first, ties by role and a hash of text: keys of a range sort are sampled, and texts may be long."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("_id"))
    by = ["conv_id", F.asc_nulls_first("turn"), "role", F.xxhash64("text"), "_id"]
    return rows.repartitionByRange(partitions(conversations.sparkSession), *by).sortWithinPartitions(*by).select("conv_id", "role", "text")


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Pieces of formatted conversations: conv_id, part, nth (order of pieces: part, then nth), formatted, segments (start and length in code points, loss), n_turns, n_out_of_order inside the piece, first_role, last_role.

    Null role or text is empty; rows without a conv_id are in no conversation; repeated rows are turns of their own; an
    empty table has no pieces; other columns aren't looked at. Any text and role is written whole.
    """
    t = template or Template()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, escape = TaskContext.get().partitionId(), t.escaper()
        nth, conv = 0, None
        texts: list[str] = []
        segments: list[tuple[int, int, bool]] = []
        size, turns, bad, first, state = 0, 0, 0, "", START
        done: list[tuple] = []

        def end() -> None:
            nonlocal nth, size, turns, bad
            if texts:
                done.append((conv, part, nth, "".join(texts), list(segments), turns, bad, first, last))
                nth += 1
                texts.clear()
                segments.clear()
                size = turns = bad = 0

        def out() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in done], kind) for i, kind in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.string()])]
            found = pa.array([[dict(zip(("start", "length", "loss"), s, strict=True)) for s in r[4]] for r in done], pa.list_(SEGMENT))
            rest = [pa.array([r[i] for r in done], kind) for i, kind in ((5, pa.int64()), (6, pa.int64()), (7, pa.string()), (8, pa.string()))]
            done.clear()
            return pa.RecordBatch.from_arrays([*columns, found, *rest], ["conv_id", "part", "nth", "formatted", "segments", "n_turns", "n_out_of_order", "first_role", "last_role"])

        last, held = "", 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv or size >= PIECE:
                    held += size
                    end()
                    if held >= HELD:
                        yield out()
                        held = 0
                    conv, first = c, role
                elif not t.fits(state, role):
                    bad += 1
                marked = f"{t.open}{escape(role)}{t.after_role}"
                written = escape(text)
                segments += [(size, len(marked), False), (size + len(marked), len(written), role in t.learnt), (size + len(marked) + len(written), len(t.close), False)]
                texts += [marked, written, t.close]
                size += len(marked) + len(written) + len(t.close)
                turns += 1
                state, last = t.state(role), role
        end()
        if done:
            yield out()

    return ordered(conversations).mapInArrow(work, PIECES)


def read_back(pieces: DataFrame, template: Template | None = None) -> DataFrame:
    """Conversations read back from their formatted pieces: conv_id, n_turns, turns_sha256 (role, LF, text, LF of each turn), loss_chars and loss_sha256 of the text under the loss flags, formatted_chars, n_out_of_order, complete (ends in a state it may end in).

    The pieces of a conversation are read in order by one task, since SHA-256 is sequential; it keeps the digests' states
    and one batch of pieces.
    """
    t = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_out_of_order", "complete"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, plainly = t.reader(), t.unescaper()
        conv, state, done = None, START, []

        def end() -> None:
            if conv is not None:
                done.append((conv, turns, all_.hexdigest(), chars, loss.hexdigest(), size, bad, state in t.ends))

        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    end()
                    conv, state = row["conv_id"], START
                    turns = chars = size = bad = 0
                    all_, loss = hashlib.sha256(), hashlib.sha256()
                bad += row["n_out_of_order"] + (not t.fits(state, row["first_role"]))
                text = row["formatted"]
                size += len(text)
                for role, _, _, said in read(text):
                    turns += 1
                    all_.update(f"{role}\n{said}\n".encode())
                    state = t.state(role)
                for s in row["segments"]:
                    if s["loss"]:
                        said = plainly(text[s["start"] : s["start"] + s["length"]])
                        chars += len(said)
                        loss.update(said.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)
                done = []
        end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)

    by = ["conv_id", "part", "nth"]
    dealt = pieces.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions(*by)
    return dealt.select("conv_id", "formatted", "segments", "n_out_of_order", "first_role").mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_out_of_order long, complete boolean")


#: A conversation whose texts look like marks and escapes.
TRICKY = r"\### Assistant: </turn> ok"


def with_tricky(conversations: DataFrame) -> DataFrame:
    """The conversations (conv_id, turn, role, text) and conversation -7, a user's and an assistant's turn that say TRICKY."""
    rows = [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)]
    more = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)
