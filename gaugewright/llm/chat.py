"""Chat formatting in budgeted windows.

A conversation becomes one or more training texts of at most a token budget, cut between turns. Prefix sums of the turns'
tokens choose the spans: each window holds the system turn, a limited repeated history, and the next turns that fit.
Only assistant turns that are new in a window are targets; what is repeated is masked, so every answer is learned once.

A turn reads ``<|turn|>role<|body|>text<|end|>``. Inside roles and texts a backslash is put before the bar of every
``<``, backslashes, ``|`` run, so no control string can occur there, and taking one away restores the text.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, vocabulary_path
from .token_counts import count_tokens

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
WINDOW_TOKENS = 2048
HISTORY_TOKENS = 512
#: A conversation whose texts hold the marks of another template.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
_SHIELD, _UNSHIELD = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_PARSE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _SHIELD.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNSHIELD.sub(r"<\1|", text)


def render_turns(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Add ``head`` (marks and role) and ``body`` (text), both escaped; null roles and texts are empty."""
    shielded = {n: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"<(\\*)\|", r"<$1\\|") for n, c in (("head", role), ("body", text))}
    return df.withColumns({"head": F.concat(F.lit(TURN), shielded["head"], F.lit(BODY)), "body": shielded["body"]})


class _Windows:
    """Windows of one conversation, fed turn by turn; holds no more turns than one window and its history do."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple | None = None
        self.turns: list[tuple] = []  # (tokens before and with the turn, head, body, is target)
        self.past: deque[tuple] = deque()
        self.base, self.number = 0, 0

    def _cost(self, turn: tuple) -> int:
        return turn[1] - turn[0]

    def add(self, before: int, upto: int, head: str, body: str, role: str | None, first: bool) -> dict | None:
        """Take the next turn (with the prefix sums around it); a window that it closes."""
        turn = (before, upto, head, body, role == "assistant")
        if first and role == "system":
            self.system = turn
            self.base = upto
            return None
        done = None
        fixed = self._cost(self.system) if self.system else 0
        if self.turns and fixed + upto - self.base > self.budget:
            done = self.close()
            room = min(self.history, self.budget - fixed - self._cost(turn))
            while self.past and before - self.past[0][0] > room:
                self.past.popleft()
            self.base = before - sum(map(self._cost, self.past))
        self.turns.append(turn)
        return done

    def close(self) -> dict | None:
        """The open window as a row; its turns become history."""
        if not self.turns and not (self.system and not self.number):
            return None
        parts, at, loss, fresh = [], 0, [], None
        lead = [(self.system, self.number == 0)] if self.system else []
        for turn, new in [*lead, *((t, False) for t in self.past), *((t, True) for t in self.turns)]:
            if new and fresh is None:
                fresh = at
            begin = at + len(turn[2])
            at = begin + len(turn[3]) + len(END)
            parts += [turn[2], turn[3], END]
            if new and turn[4]:
                loss.append({"start": begin, "stop": begin + len(turn[3])})
        shown = [t for t, _ in lead] + [*self.past, *self.turns]
        row = {"window": self.number, "formatted": "".join(parts), "n_tokens": sum(map(self._cost, shown)), "fresh_from": fresh or 0, "loss": loss}
        self.past.extend(self.turns)
        while len(self.past) > 1 and self.past[-1][1] - self.past[1][0] > self.history:
            self.past.popleft()
        self.turns, self.number = [], self.number + 1
        return row


def format_windows(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = WINDOW_TOKENS, history: int = HISTORY_TOKENS, path: str | None = None) -> DataFrame:
    """One row per window: (conv_id, window, formatted, n_tokens, fresh_from, loss).

    ``fresh_from`` is the offset of the first turn that no earlier window showed; ``loss`` lists the (start, stop) offsets
    of the targets. Turns come in order of ``turn``, then role and text (nulls first), repeated rows included; rows
    without a conversation id are one conversation. The system turn is a first turn with role ``system``. A turn is never
    cut: one over the budget has a window of its own, with the system turn and without history. An empty table gives no rows.
    Tokens are counted wherever rows lie; then a conversation's rows pass through one task in order, one window at a time.
    """
    rows = render_turns(df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))
    rows = count_tokens(rows.withColumn("whole", F.concat("head", "body", F.lit(END))), "whole", path or vocabulary_path("byte_bpe_50k.json"), "tokens").drop("whole", "text")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.sum("tokens").over(order)).withColumn("nth", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "body")))
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "body").select("conv_id", "role", "head", "body", "tokens", "upto", "nth")
    id_type = rows.schema["conv_id"].dataType
    schema = f"conv_id {id_type.simpleString()}, window long, formatted string, n_tokens long, fresh_from long, loss array<struct<start:long,stop:long>>"
    loss_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = [None, pa.int64(), pa.string(), pa.int64(), pa.int64(), loss_type]
        names = ["conv_id", "window", "formatted", "n_tokens", "fresh_from", "loss"]
        current: _Windows | None = None
        key = None
        for batch in batches:
            arrow[0] = batch.schema.field(0).type
            out: list[dict] = []
            for id_, role_, head, body, tokens, upto, nth in zip(*(c.to_pylist() for c in batch.columns)):
                if nth == 1:
                    if current and (row := current.close()):
                        out.append(row | {"conv_id": key})
                    current, key = _Windows(budget, history), id_
                if row := current.add(upto - tokens, upto, head, body, role_, nth == 1):
                    out.append(row | {"conv_id": key})
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, arrow)], names=names)
        if current and (row := current.close()):
            yield pa.RecordBatch.from_arrays([pa.array([(row | {"conv_id": key})[n]], t) for n, t in zip(names, arrow)], names=names)

    return rows.mapInArrow(run, schema)


def read_windows(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say: turns, digests of turns and of targets, and the characters formatted.

    Reads the formatted texts, offsets and masks alone. Expects rows as `format_windows` gives them: a conversation's
    windows in order in one partition.
    """
    id_type = windows.schema["conv_id"].dataType
    schema = f"conv_id {id_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        state: list | None = None

        def row():
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]]

        for batch in batches:
            types[0] = batch.schema.field(0).type
            out = []
            for id_, window, formatted, fresh, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if window == 0:
                    if state:
                        out.append(row())
                    state = [id_, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for m in _PARSE.finditer(formatted, fresh):
                    state[1] += 1
                    state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for span in loss:
                    target = unescape(formatted[span["start"] : span["stop"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(formatted)
                state[6] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), types)], names=names)

    return windows.select("conv_id", "window", "formatted", "fresh_from", "loss").mapInArrow(run, schema)


def op9_chat_windows(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    got = read_windows(format_windows(rows.unionByName(extra)))
    return got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")

