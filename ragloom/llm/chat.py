"""Operator 7: chat formatting in budgeted windows.

Prefix sums of turn tokens choose spans of whole turns. Each window starts with the
conversation's system turn, repeats a limited history, and has a loss mask over the
assistant texts of its own span only, so that every target is learned once.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.bpe import Chunks, codec
from ragloom.llm.shared import append_columns, load, public_path, small_batches

#: Tokens of a window's turns, and of the history that it repeats at most.
BUDGET, HISTORY = 1024, 256
#: The template's marks, and strings that other templates give a meaning to.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(map(re.escape, CONTROLS)))
_BACK = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(rf"{re.escape(OPEN)}((?:\\.|[^\\\n])*)\n(.*?){re.escape(CLOSE)}", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left; ``unescape`` gives the text back."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


class Turn(NamedTuple):
    role: str
    text: str
    tokens: int

    def formatted(self) -> tuple[str, int, int]:
        """The turn in the template, and where its text lies there."""
        head = OPEN + escape(self.role).replace("\n", "\\\n") + "\n"
        text = escape(self.text)
        return head + text + CLOSE, len(head), len(head) + len(text)


class Window(NamedTuple):
    window: int
    repeated: int
    formatted: str
    loss: list[dict]
    tokens: int


class Windows:
    """Windows of one conversation, turn by turn; holds one span and one history at most."""

    def __init__(self, budget: int = BUDGET, history: int = HISTORY):
        self.budget, self.history = budget, history
        self.system: Turn | None = None
        self.past: deque[Turn] = deque()
        self.span: list[Turn] = []
        self.sums = [0]  # prefix sums of the span's tokens
        self.seen = self.made = 0

    def repeated(self) -> list[Turn]:
        """What comes before the span: the system turn and the history that the budget allows."""
        return [*([self.system] if self.system and self.made else []), *self.past]

    def add(self, turn: Turn) -> Iterator[Window]:
        """Takes the next turn; gives a window when the turn doesn't fit into it any more."""
        room = self.budget - sum(t.tokens for t in self.repeated())
        if self.span and self.sums[-1] + turn.tokens > room:
            yield self.close()
        if not self.span:
            # A turn that is too long with the history drops history first; alone it stands in a window of its own.
            fixed = self.system.tokens if self.system and self.made else 0
            while self.past and fixed + sum(t.tokens for t in self.past) + turn.tokens > self.budget:
                self.past.popleft()
        if self.seen == 0 and turn.role == "system":
            self.system = turn
        self.seen += 1
        self.span.append(turn)
        self.sums.append(self.sums[-1] + turn.tokens)

    def close(self) -> Window:
        """The window of the present span, whose turns then become history."""
        before, text, loss = self.repeated(), [], []
        at = 0
        for i, turn in enumerate([*before, *self.span]):
            own, start, end = turn.formatted()
            if i >= len(before) and turn.role == "assistant":
                loss.append({"start": at + start, "end": at + end})
            text.append(own)
            at += len(own)
        out = Window(self.made, len(before), "".join(text), loss, sum(t.tokens for t in before) + self.sums[-1])
        self.made += 1
        left, past = self.history, deque()
        for turn in reversed([*self.past, *self.span]):
            if turn is self.system or turn.tokens > left:
                break
            left -= turn.tokens
            past.appendleft(turn)
        self.past, self.span, self.sums = past, [], [0]
        return out

    def end(self) -> Iterator[Window]:
        if self.span:
            yield self.close()


@lru_cache(maxsize=2)
def token_counter(path: str) -> Chunks:
    """Token counts of a text's chunks."""
    c = codec(path)
    return Chunks(c, lambda text: len(c.ids(text)))


WINDOW_SCHEMA = "window long, repeated int, formatted string, loss array<struct<start:long,end:long>>, tokens long"


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """``conv_id, window, repeated, formatted, loss, tokens``: a row a window, in order.

    Turns are ordered by turn, then role and text, nulls first. Null roles and texts
    count as empty; rows with a null conversation form one; repeated rows are turns of
    their own. A turn larger than the budget stands whole in a window of its own.
    ``repeated`` turns at a window's start come from earlier windows. A conversation's
    windows stay together, in order, in one partition; they are made turn by turn, so
    its length doesn't matter for memory. Tokens are counted before turns are dealt, by
    all tasks alike, so a long conversation's task formats but doesn't tokenise. An
    empty table gives no rows. Extra columns are left out.
    """
    small_batches(turns.sparkSession)
    own = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def make():
        count = token_counter(public_path(vocabulary))
        return lambda texts: [pa.array([sum(count(v.as_py())) for v in texts], pa.int64())]

    counted = append_columns(own, "text", make, "tokens long")
    dealt = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        now, windows, rows = None, None, []
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("window", pa.int64()), ("repeated", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("tokens", pa.int64())])
            for conv, role, text, tokens in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if windows is None or conv != now:
                    rows += [{"conv_id": now} | w._asdict() for w in (windows.end() if windows else ())]
                    now, windows = conv, Windows(budget, history)
                rows += [{"conv_id": now} | w._asdict() for w in windows.add(Turn(role, text, tokens))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
        if windows:
            yield pa.RecordBatch.from_pylist([{"conv_id": now} | w._asdict() for w in windows.end()], schema=schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, {WINDOW_SCHEMA}")


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its windows; see ``format_conversations``.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows``.
    Reads the windows where and in the order in which they were made. A conversation of
    empty turns has zero characters; no windows give no rows.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, state = None, None, None

        def row():
            n, turns, chars, loss, formatted, made = state
            return {"conv_id": now, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted, "n_windows": made}

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
            rows = []
            for w in batch.to_pylist():
                if state is None or w["window"] == 0:
                    if state is not None:
                        rows.append(row())
                    now, state = w["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for i, m in enumerate(_TURN.finditer(w["formatted"])):
                    if i >= w["repeated"]:
                        state[0] += 1
                        state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "replace"))
                for span in w["loss"]:
                    text = unescape(w["formatted"][span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "replace"))
                state[4] += len(w["formatted"])
                state[5] += 1
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    return windows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return read_back(format_conversations(turns.unionByName(more)))
