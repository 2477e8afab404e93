"""Chat formatting in budgeted windows.

A conversation is read turn by turn in order; prefix sums of the turns' tokens
cut it into windows of whole turns. Each window repeats the system turn and as
much of the turns before it as a history limit allows; repeated turns are
masked, so every assistant turn is a target once. Turns are escaped and their
tokens counted where the rows lie; then conversations are streamed: a task
holds one window and the history, however long a conversation is, and only puts
turns together.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.tokens import default_vocabulary, encode

# The template's marks, and the strings that a text may not hold as they are.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = re.compile(r"\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.S)
_MARKED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
TARGET, SYSTEM = "assistant", "system"


def escape(text: str) -> str:
    """Break control strings by a backslash after their first character and
    double every backslash; ``unescape`` gives the text back."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Turn:
    """A turn as it is shown; its text lies ``before`` code points in."""

    __slots__ = ("role", "shown", "before", "length", "cost")

    def __init__(self, role: str, shown: str, before: int, length: int, cost: int) -> None:
        self.role, self.shown, self.before, self.length, self.cost = role, shown, before, length, cost


def shown_turn(role: str, text: str, vocabulary: str) -> Turn:
    head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
    shown = f"{head}{body}{END}"
    return Turn(role, shown, len(head), len(body), len(encode(shown.encode(), vocabulary)))


def _turns(vocabulary: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shown_turn(role or "", text.as_py() or "", vocabulary) for role, text in zip(batch.column("role").to_pylist(), batch.column("text"), strict=True)]
            own = [pa.array([t.shown for t in made], pa.string()), *(pa.array([getattr(t, c) for t in made], pa.int32()) for c in ("before", "length", "cost"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), *own], names=["conv_id", "turn", "role", "shown", "before", "length", "cost"])

    return run


class Windows:
    """Cuts the turns of one conversation into windows."""

    def __init__(self, budget: int, history: int, emit: Callable[[int, list[Turn], int, int], None]) -> None:
        self.budget, self.history, self.emit = budget, history, emit
        self.system: Turn | None = None
        self.prefix = self.start = 0  # tokens before the next turn, and before the window's first new turn
        self.past: deque[tuple[int, Turn]] = deque()  # (prefix before it, turn) of turns that may be repeated
        self.lead: list[Turn] = []
        self.fresh: list[Turn] = []
        self.number = self.turns = 0

    def _lead_cost(self) -> int:
        return sum(t.cost for t in self.lead)

    def _open(self, cost: int) -> None:
        """System turn and history before a window whose first turn costs ``cost``."""
        self.start = self.prefix
        room = self.budget - cost - (self.system.cost if self.system else 0)
        self.lead = [self.system] if self.system else []
        self.lead += [t for at, t in self.past if self.prefix - at <= min(self.history, room)]

    def close(self) -> None:
        if self.fresh:
            self.emit(self.number, self.lead + self.fresh, len(self.lead), self._lead_cost() + self.prefix - self.start)
            self.number += 1
            self.fresh = []

    def add(self, turn: Turn) -> None:
        if self.fresh and self._lead_cost() + self.prefix - self.start + turn.cost > self.budget:
            self.close()
        if not self.fresh:
            self._open(turn.cost)
        self.fresh.append(turn)
        if self.turns == 0 and turn.role == SYSTEM:
            self.system = turn
        else:
            self.past.append((self.prefix, turn))
        self.turns += 1
        self.prefix += turn.cost
        while self.past and self.prefix - self.past[0][0] > self.history:
            self.past.popleft()


_TYPES = "conv_id long, window_no long, formatted string, n_repeated int, n_turns int, n_tokens int, loss_spans array<struct<start:int,stop:int>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("window_no", pa.int64()), ("formatted", pa.string()), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int32()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def _format(budget: int, history: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "role", "shown", "before", "length", "cost")
        out: list[tuple] = []
        conversation: list = []

        def emit(number: int, turns: list[Turn], repeated: int, tokens: int) -> None:
            spans, at = [], 0
            for i, t in enumerate(turns):
                if i >= repeated and t.role == TARGET:
                    spans.append({"start": at + t.before, "stop": at + t.before + t.length})
                at += len(t.shown)
            out.append((conversation[0], number, "".join(t.shown for t in turns), repeated, len(turns), tokens, spans))

        def taken() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

        windows: Windows | None = None
        for batch in batches:
            columns = [batch.column(c) for c in names]
            for conv, role, shown, *numbers in zip(*(c if name == "shown" else c.to_pylist() for name, c in zip(names, columns, strict=True)), strict=True):
                if windows is None or conv != conversation[0]:
                    if windows is not None:
                        windows.close()
                    conversation[:] = [conv]
                    windows = Windows(budget, history, emit)
                windows.add(Turn(role or "", shown.as_py(), *numbers))
                if len(out) >= 1000:
                    yield taken()
        if windows is not None:
            windows.close()
        if out:
            yield taken()

    return run


def format_chats(conversations: DataFrame, vocabulary: str | None = None, budget: int = 2048, history: int = 512) -> DataFrame:
    """Windows of all conversations (conv_id, turn, role, text): conv_id,
    window_no, formatted, n_repeated (leading turns repeated and masked),
    n_turns, n_tokens, loss_spans (code points of the targets' texts).

    Turns come by turn, then role and escaped text; nulls first. A null role or text is
    empty; rows without a conv_id are one conversation. A window holds
    ``budget`` tokens at most, unless one turn alone (after the system turn)
    has more. Repeated rows are turns of their own. No rows in, no rows out;
    other columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    kind = rows.schema["turn"].dataType.simpleString()
    rows = rows.mapInArrow(_turns(vocabulary or default_vocabulary()), f"conv_id long, turn {kind}, role string, shown string, before int, length int, cost int")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "shown")
    return rows.mapInArrow(_format(budget, history), _TYPES)


_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    state: list | None = None

    def done() -> None:
        if state is not None:
            out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    def taken() -> pa.RecordBatch:
        columns = [pa.array(c, pa.string() if "string" in t else pa.int64()) for c, t in zip(zip(*out, strict=True), _BACK.split(", "), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=[t.split()[0] for t in _BACK.split(", ")])

    for batch in batches:
        for conv, shown, repeated, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "n_repeated", "loss_spans")), strict=True):
            if state is None or conv != state[0]:
                done()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for i, turn in enumerate(_MARKED.finditer(shown)):
                if i >= repeated:
                    state[1] += 1
                    state[2].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
            for span in spans:
                text = unescape(shown[span["start"] : span["stop"]])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(shown)
        if len(out) >= 5000:
            yield taken()
    done()
    if out:
        yield taken()


def read_back(windows: DataFrame) -> DataFrame:
    """Digest per conversation of what its windows say: turns in order without
    the repeated ones, and the text under the loss mask. A conversation without
    an assistant has the digest of an empty text; windows without a conv_id are
    one conversation; no windows give no rows."""
    rows = windows.select("conv_id", "window_no", "formatted", "n_repeated", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "window_no")
    return rows.mapInArrow(_read, _BACK)
