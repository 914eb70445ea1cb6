"""Conversations as training texts: windows of whole turns within a budget of tokens.

A conversation's turns, in the order of turn, become one or more windows. Prefix sums of the turns' tokens choose the spans: a window holds
as many further turns as fit beside what it repeats, which is the conversation's leading system turn and, of the turns just before, as many
as fit into HISTORY tokens. Repeated turns are context: only an assistant turn that appears for the first time is a target, so every
assistant text is under the loss once. A turn that does not fit beside the system turn stands in a window with it alone, above the budget;
nothing is ever cut or left out.

A turn is written as its mark, role, line end, text, end mark, line end. Control strings within texts and roles are escaped reversibly: one
backslash goes between the bracket and the bar that begin a mark, also where some stand there already; line ends and backslashes of roles
are escaped as well. A window read back gives exactly the turns it was made of.

Turns of one conversation come to one task in order and stream through it (its digest needs all of them in turn); a window and its history
are what is held, never a conversation. Conversations are dealt out by conv_id.

Null texts and roles count as empty, rows of a null turn come first, rows that share a turn in the order of role and text; rows that repeat
are turns like any other. Rows of a null conv_id are one conversation. Very long texts stay whole. A conversation without assistant turns
has nothing under the loss. An empty table gives no windows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.shared import WORD, cut, only, table

BUDGET, HISTORY = 1024, 256
BEGIN, END, TARGET, LEAD = "<|im_start|>", "<|im_end|>", "assistant", "system"
#: Tokens that a turn's marks cost, whatever it says.
MARKS = 4
_OPENS, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
WINDOW = "conv_id long, window long, text string, tokens long, repeated int, loss array<struct<start:long,end:long>>"
READ = "conv_id long, window long, place int, said string, target string, formatted long"


def escaped(text: str) -> str:
    """text without any control string."""
    return _OPENS.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescaped(role))


def word_tokens(text: Column) -> Column:
    """Words and a turn's marks: a measure that needs no tokenizer."""
    return F.regexp_count(text, F.lit(WORD)) + MARKS


class _Conversation:
    """The turns of one conversation that its open window may still need."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.lead: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str]] = []  # those of the history, then those of the span
        self.sums = [0]  # prefix sums of their tokens
        self.start, self.fresh, self.windows, self.lead_new = 0, True, 0, False

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        """Takes a turn; a window, where the turn does not fit into the open one."""
        first, self.fresh = self.fresh, False
        if first and role == LEAD:
            self.lead, self.lead_new = (role, text, tokens), True
            return None
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + tokens)
        last = len(self.turns) - 1
        if last == self.start:
            self._shorten(last)
        return self._closed(last) if last > self.start and self.sums[-1] - self.sums[0] > self._room() else None

    def rest(self) -> tuple | None:
        return self._window(len(self.turns)) if len(self.turns) > self.start or self.lead_new else None

    def _room(self) -> int:
        return self.budget - (self.lead[2] if self.lead else 0)

    def _drop(self, n: int) -> None:
        """Forgets the first n turns."""
        self.turns, self.start = self.turns[n:], self.start - n
        self.sums = [s - self.sums[n] for s in self.sums[n:]]

    def _shorten(self, first: int) -> None:
        """Of the history, what fits beside the span's first turn."""
        self._drop(min(first, bisect_left(self.sums, self.sums[first + 1] - self._room())))

    def _closed(self, end: int) -> tuple:
        made = self._window(end)
        self.start = end
        self._drop(min(end, bisect_left(self.sums, self.sums[end] - self.history)))
        self._shorten(self.start)
        return made

    def _window(self, end: int) -> tuple:
        """The window of the turns up to end: (conv_id, window, text, tokens, repeated, loss)."""
        lead = [self.lead[:2]] if self.lead else []
        repeated = len(lead) - self.lead_new + self.start
        text, at, loss = [], 0, []
        for k, (role, said) in enumerate([*lead, *self.turns[:end]]):
            head, body = f"{BEGIN}{escaped_role(role)}\n", escaped(said)
            if role == TARGET and k >= repeated:
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            text += [head, body, END, "\n"]
            at += len(head) + len(body) + len(END) + 1
        tokens = (self.lead[2] if self.lead else 0) + self.sums[end]
        self.windows, self.lead_new = self.windows + 1, False
        return self.conv_id, self.windows - 1, "".join(text), tokens, repeated, loss


def _some(rows: Iterator[tuple], columns: str, size: int = 2**22) -> Iterator[pd.DataFrame]:
    """rows as tables of some megabytes of text."""
    names, held, n = [c.split()[0] for c in re.sub("<[^ ]*>", "", columns).split(", ")], [], 0
    for row in rows:
        held.append(row)
        n += 64 + sum(len(v) for v in row if isinstance(v, str))
        if n > size:
            yield pd.DataFrame(held, columns=names).astype({"conv_id": "Int64"})
            held, n = [], 0
    yield pd.DataFrame(held, columns=names).astype({"conv_id": "Int64"})


def _key(value) -> int | None:
    return None if pd.isna(value) else int(value)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """conversations (conv_id, turn, role, text) as windows: conv_id, window (from 0), text, tokens, repeated (leading turns that an
    earlier window has), loss (places of its targets, in code points, end exclusive). tokens measures a turn's text."""
    held = only(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = held.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", tokens(F.col("text")).alias("tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made() -> Iterator[tuple]:
            open_ = None
            for pdf in batches:
                for conv_id, role, text, n in zip(pdf["conv_id"], pdf["role"], pdf["text"], pdf["tokens"], strict=True):
                    conv_id = _key(conv_id)
                    if open_ is None or open_.conv_id != conv_id:
                        if open_ and (row := open_.rest()):
                            yield row
                        open_ = _Conversation(conv_id, budget, history)
                    if row := open_.add(role, text, int(n)):
                        yield row
            if open_ and (row := open_.rest()):
                yield row

        return _some(made(), WINDOW)

    return ordered.mapInPandas(run, WINDOW)


def parsed(text: str, repeated: int, loss: list) -> Iterator[tuple[int, str, str, str | None]]:
    """(place, role, text, what the loss covers) of a window's turns that it is the first to hold."""
    spans = [(s["start"], s["end"]) for s in loss]
    starts = [s for s, _ in spans]
    for k, m in enumerate(_TURN.finditer(text)):
        if k >= repeated:
            own = spans[bisect_left(starts, m.start(2)) : bisect_right(starts, m.end(2))]
            covered = "".join(unescaped(text[a:b]) for a, b in own) if own else None
            yield k, unescaped_role(m.group(1)), unescaped(m.group(2)), covered


def read_back(made: DataFrame) -> DataFrame:
    """The turns of windows, each once: conv_id, window, place, said (role, line end, text, line end), target (what the loss covers, null
    outside it), formatted (code points of the window, at its first new turn)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for pdf in batches:
                for conv_id, window, text, repeated, loss in zip(pdf["conv_id"], pdf["window"], pdf["text"], pdf["repeated"], pdf["loss"], strict=True):
                    for k, role, said, covered in parsed(text, repeated, loss):
                        yield _key(conv_id), window, k, f"{role}\n{said}\n", covered, len(text) if k == repeated else 0

        return _some(rows(), READ)

    return made.select("conv_id", "window", "text", "repeated", "loss").mapInPandas(run, READ)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of read_back(): turns, their digest, characters and digest of what the loss covers, formatted characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            now = None
            for pdf in batches:
                for conv_id, said, target, formatted in zip(pdf["conv_id"], pdf["said"], pdf["target"], pdf["formatted"], strict=True):
                    conv_id = _key(conv_id)
                    if now is None or now[0] != conv_id:
                        if now:
                            yield now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]
                        now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    now[1] += 1
                    now[2].update(said.encode())
                    if target is not None:
                        now[3] += len(target)
                        now[4].update(target.encode())
                    now[5] += int(formatted)
            if now:
                yield now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

        return _some(rows(), DIGEST)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "window", "place").select("conv_id", "said", "target", "formatted").mapInPandas(run, DIGEST)


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = f"{END}{BEGIN}{TARGET} ok"
    more = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, TARGET, told)], "conv_id long, turn long, role string, text string")
    rows = only(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return digests(read_back(cut(windows(rows.unionByName(more)))))
