"""Chat formatting in budgeted windows.

A conversation's turns are written in a template whose control strings are escaped, reversibly,
inside texts and roles. Prefix sums of the turns' tokens choose spans of whole turns: a window holds
the system turn, a limited run of the turns just before, and as many new turns as the token budget
allows. Loss falls on the assistant's texts, each in the window where it is new; repeated
turns are masked.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern that goes with this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The template's control strings.
BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"<(\\*)(/?s>)|\[(\\*)(/?INST\])")
_ESCAPED = re.compile(r"<\\(\\*)(/?s>)|\[\\(\\*)(/?INST\])")


def escape(text: str) -> str:
    """One more backslash after the first sign of whatever is a control string but for backslashes there."""
    return _CONTROL.sub(lambda m: f"<\\{m[1]}{m[2]}" if m[2] else f"[\\{m[3]}{m[4]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}{m[2]}" if m[2] else f"[{m[3]}{m[4]}", text)


@cache
def token_counter(path: str) -> Callable[[str], int]:
    """Counts tokens by a public vocabulary of byte-pair ranks; loaded once a worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


@dataclass(frozen=True)
class Template:
    """Tokens of a window, and at most how many of them repeat earlier turns (beside the system turn)."""

    budget: int = 1024
    history: int = 256
    target: str = "assistant"
    vocabulary: str = VOCABULARY

    def turn(self, role: str, text: str) -> str:
        return f"{ROLE}{escape(role)}{TEXT}{escape(text)}{END}"


@dataclass
class Window:
    text: str
    loss: list[int]  # begin, end, begin, end ... in code points
    repeated: int
    turns: int
    tokens: int


@dataclass
class Formatter:
    """Takes one conversation's turns in order and gives windows. It holds one window and the turns that the next may
    repeat, however long the conversation."""

    template: Template
    count: Callable[[str], int]
    system: tuple[str, int] | None = None
    held: list[tuple[str, str, int, bool]] = field(default_factory=list)  # formatted, escaped text, tokens, target
    prefix: list[int] = field(default_factory=lambda: [0])  # of tokens over `held`
    new: int = 0  # the first of `held` that no window has had
    seen: bool = False

    def add(self, role: str, text: str) -> Iterator[Window]:
        t = self.template
        turn = t.turn(role, text)
        tokens = self.count(turn)
        if not self.seen and role == "system":
            self.system = (turn, tokens)
        self.seen = True
        if len(self.held) > self.new and self.fixed() + self.prefix[-1] + tokens > t.budget:
            yield self.flush()
            # history: the longest run of whole turns at the end within its limit and what the new turn leaves
            room = min(t.history, t.budget - self.fixed() - tokens)
            low = bisect_right([-p for p in reversed(self.prefix)], room - self.prefix[-1])
            keep = min(max(low - 1, 0), len(self.held))
            if self.system and self.held and keep == len(self.held) and self.held[0][0] is self.system[0]:
                keep -= 1
            self.held = self.held[len(self.held) - keep :]
            self.new = keep
            self.prefix = [0]
            for h in self.held:
                self.prefix.append(self.prefix[-1] + h[2])
        self.held.append((turn, escape(text), tokens, role == t.target))
        self.prefix.append(self.prefix[-1] + tokens)

    def fixed(self) -> int:
        """Tokens of the system turn where it has to be repeated."""
        return self.system[1] if self.system and not (self.held and self.held[0][0] is self.system[0]) else 0

    def flush(self) -> Window:
        repeat = [self.system[0]] if self.fixed() else []
        parts, at, loss = [BEGIN, *repeat], len(BEGIN) + sum(map(len, repeat)), []
        for i, (turn, text, _, target) in enumerate(self.held):
            if target and i >= self.new:
                end = at + len(turn) - len(END)
                loss += [end - len(text), end]
            parts.append(turn)
            at += len(turn)
        return Window("".join(parts), loss, len(repeat) + self.new, len(repeat) + len(self.held), self.fixed() + self.prefix[-1])


_SCHEMA = "conv_id long, window long, formatted string, loss array<long>, repeated long, turns long, tokens long"


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Windows of each conversation of `rows` (conv_id, turn, role, text, any others), those of one conversation
    together and in order: `conv_id, window, formatted, loss, repeated, turns, tokens`.

    Turns go by `turn`, nulls first, equal ones by role and text; repeated rows are turns. A null text or role
    is empty; rows with a null conv_id are one conversation. A turn that alone exceeds the budget has a
    window of its own, with the system turn. An empty table gives none. A conversation streams through
    one task, which holds a window of it at a time.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(template.vocabulary)
        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.int64())), ("repeated", pa.int64()), ("turns", pa.int64()), ("tokens", pa.int64())])
        out: list[dict] = []
        conv, formatter, window = None, None, 0

        def put(w: Window) -> None:
            nonlocal window
            out.append({"conv_id": conv, "window": window, "formatted": w.text, "loss": w.loss, "repeated": w.repeated, "turns": w.turns, "tokens": w.tokens})
            window += 1

        for batch in batches:
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if formatter is None or c != conv:
                    if formatter:
                        put(formatter.flush())
                    conv, formatter, window = c, Formatter(template, count), 0
                for w in formatter.add(role or "", text or ""):
                    put(w)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
        if formatter:
            put(formatter.flush())
        yield pa.RecordBatch.from_pylist(out, schema)

    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, _SCHEMA)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn of a window; the bounds are of the escaped text."""
    at, out = len(BEGIN), []
    while at < len(formatted):
        text = formatted.index(TEXT, at)
        end = formatted.index(END, text)
        out.append((unescape(formatted[at + len(ROLE) : text]), unescape(formatted[text + len(TEXT) : end]), text + len(TEXT), end))
        at = end + len(END)
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """From windows as `format_conversations` orders them, a row per conversation: `conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_windows`, found in the formatted texts and loss masks alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = [[] for _ in names]
        state: list | None = None

        def close() -> None:
            if state:
                for column, value in zip(done, [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:]], strict=True):
                    column.append(value)

        for batch in batches:
            for conv, window, text, loss, repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "window", "formatted", "loss", "repeated")), strict=True):
                if window == 0:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said, _, _ in parse(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for begin, end in zip(loss[::2], loss[1::2], strict=True):
                    target = unescape(text[begin:end])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
                state[6] += 1
        close()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(done, kinds, strict=True)], names)

    return windows.mapInArrow(run, schema)


#: A conversation whose texts are the template's own control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def round_trip(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """`read_back` of the formatted conversations, and of conversation -1 in which both sides say control strings."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.union(probe), template))
