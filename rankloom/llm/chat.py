r"""Chat formatting in budgeted windows.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. Inside texts and roles a
backslash becomes ``\\`` and ``<|`` becomes ``<\|``, inside roles a line feed becomes
``\n`` in letters, so no text can open or close a turn and every text is read back
unchanged. Prefix sums of the turns' tokens, counted on the turns as they are written
(marks and escapes included; turns end in white space, so the counts add up), choose turn-aligned windows within the
budget: each window repeats the system turn and up to ``history`` tokens of the turns
before it, then takes new turns while they fit. Only assistant texts among the new
turns are under the loss mask, so repeated targets are masked and each target counts
once. A turn over the budget gets a window of its own, whole, with the system turn.

Rows are dealt by conversation and sorted by turn (then role, then text); a task reads
them as a stream and holds one conversation's open window and history only.

Edge cases: a null text or role is empty; a null conversation id is a conversation of
its own; repeated (conversation, turn) rows all stay; a system turn later than the
first row is a normal turn; very long texts stay whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import sliced, prepare
from rankloom.llm.wordbpe import word_bpe

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out.append(text[at:k])
        mark = text[k + 1 : k + 2]
        out.append("\n" if mark == "n" else mark)
        at = k + 2
    return "".join([*out, text[at:]])


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text lies in it."""
    head = START + escaped(role).replace("\n", "\\n") + "\n"
    body = escaped(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def turns_of(window: str) -> list[tuple[str, str]]:
    """Reads a formatted window back: (role, text) of each turn."""
    found, at = [], 0
    while at < len(window):
        if not window.startswith(START, at):
            raise ValueError("not a formatted window")
        line = window.index("\n", at)
        end = window.index(END + "\n", line)
        found.append((unescaped(window[at + len(START) : line]), unescaped(window[line + 1 : end])))
        at = end + len(END) + 1
    return found


class _Conversation:
    """Windows of one conversation, fed turn by turn."""

    def __init__(self, conv_id, budget: int, history: int):
        self.id, self.budget, self.history = conv_id, budget, history
        self.system: tuple | None = None  # a turn: as written, where its text lies, tokens, whether it is a target
        self.recent: list[tuple] = []  # turns that a next window may repeat
        self.new: list[tuple] = []
        self.head: list[tuple] = []  # repeated turns of the open window
        self.used = 0
        self.windows = 0

    def add(self, role: str, text: str, count: Callable[[str], int]) -> list[tuple]:
        """Takes a turn; gives the windows that this closes. ``count`` gives the tokens of written text."""
        closed = []
        whole, start, end = rendered(role, text)
        tokens = count(whole)
        turn = (whole, start, end, tokens, role == "assistant")
        if self.new and self.used + tokens > self.budget:
            closed.append(self.close())
            self.head = [self.system] if self.system and self.system is not turn else []
            room = max(0, min(self.history, self.budget - tokens - sum(t[3] for t in self.head)))
            # Prefix sums from the newest turn back: the longest whole-turn history that fits.
            repeated, total = [], 0
            for t in reversed(self.recent):
                if t is self.system or total + t[3] > room:
                    break
                total += t[3]
                repeated.append(t)
            self.head += repeated[::-1]
            self.used = sum(t[3] for t in self.head)
        if role == "system" and not self.windows and not self.new:
            self.system = turn
        self.new.append(turn)
        self.used += tokens
        self.recent.append(turn)
        kept = 0
        for k in range(len(self.recent) - 1, -1, -1):
            kept += self.recent[k][3]
            if kept > self.history and k:
                del self.recent[:k]
                break
        return closed

    def close(self) -> tuple:
        parts, starts, ends, at = [], [], [], 0
        for k, (whole, a, b, _, target) in enumerate([*self.head, *self.new]):
            if k >= len(self.head) and target:
                starts.append(at + a)
                ends.append(at + b)
            parts.append(whole)
            at += len(whole)
        row = (self.id, self.windows, "".join(parts), len(self.head), len(self.new), self.used, starts, ends)
        self.windows += 1
        self.new, self.head, self.used = [], [], 0
        return row


def format_conversations(turns: DataFrame, tokenizer_path: str, budget: int = 1024, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: ``conv_id``, ``window``, ``text``, ``n_repeated``, ``n_new``,
    ``tokens``, ``loss_starts``, ``loss_ends`` (code points of ``text``). The windows
    of a conversation lie in one partition, in order."""
    prepare(turns.sparkSession)
    blank = F.lit("")
    rows = turns.select(turns[conv_col].alias("c"), turns[turn_col].alias("k"), F.coalesce(turns[role_col].cast("string"), blank).alias("r"), F.coalesce(turns[text_col].cast("string"), blank).alias("t"))
    dealt = rows.repartition("c").sortWithinPartitions("c", "k", "r", "t")
    id_kind = dealt.schema["c"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(tokenizer_path)
        open_: _Conversation | None = None
        kind = pa.int64()

        def out(found: list[tuple]) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["conv_id", "window", "text", "n_repeated", "n_new", "tokens", "loss_starts", "loss_ends"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=names)

        for batch in sliced(batches):
            kind = batch.schema.field(0).type
            found = []
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or open_.id != conv:
                    if open_ is not None:
                        found.append(open_.close())
                    open_ = _Conversation(conv, budget, history)
                found += open_.add(role, text, encode.count)
            yield out(found)
        if open_ is not None:
            yield out([open_.close()])

    return dealt.mapInArrow(task, f"conv_id {id_kind}, window bigint, text string, n_repeated bigint, n_new bigint, tokens bigint, loss_starts array<bigint>, loss_ends array<bigint>")


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted windows alone.

    Takes the rows of ``format_conversations`` in any order, deals them by conversation, sorts
    them by window and streams them: ``conv_id``, ``n_turns``,
    ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``, ``n_windows``.
    """
    id_kind = windows.schema["conv_id"].dataType.simpleString()
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    rows = dealt.select("conv_id", "text", "n_repeated", "loss_starts", "loss_ends")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, kind = None, None, pa.int64()

        def fresh() -> dict:
            return {"turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "windows": 0}

        def out(found: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array([c for c, _ in found], kind)]
            for k, t in (("turns", pa.int64()), ("sha", pa.string()), ("loss", pa.int64()), ("loss_sha", pa.string()), ("chars", pa.int64()), ("windows", pa.int64())):
                cols.append(pa.array([s[k].hexdigest() if "sha" in k else s[k] for _, s in found], t))
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])

        for batch in sliced(batches):
            kind = batch.schema.field(0).type
            found = []
            for c, text, repeated, starts, ends in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        found.append((conv, state))
                    conv, state = c, fresh()
                for role, said in turns_of(text)[repeated:]:
                    state["turns"] += 1
                    state["sha"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(starts, ends, strict=True):
                    target = unescaped(text[a:b])
                    state["loss"] += len(target)
                    state["loss_sha"].update(target.encode("utf-8", "surrogatepass"))
                state["chars"] += len(text)
                state["windows"] += 1
            yield out(found)
        if state is not None:
            yield out([(conv, state)])

    return rows.mapInArrow(task, f"conv_id {id_kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")
