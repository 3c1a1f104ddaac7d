"""Packing documents into training windows by online sum of squares.

A document's tokens are its ids and one end id. Each task packs its own rows, with
no shuffle: a document fills whole windows while it can, and its rest goes to the
partially filled window level that keeps the sum of squared level counts smallest
(N(h)^2 summed over fill levels h). The counts live in one level array, so a
placement costs one vector operation, whatever the number of windows. When a task
ends, or holds ``max_open`` open windows, the emptiest open windows are cut up to
fill the fullest, so at most one window of a task stays partially filled.

Edge cases: a null text is empty and gives one piece of the end id; null or
repeated ids are kept as they come, each row is a document; a text longer than a window fills
whole windows; of levels that raise the sum alike the fullest is taken; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rankloom.llm.common import sliced, prepare
from rankloom.llm.wordbpe import word_bpe

#: Task and counter share a sequence id: 2^32 sequences a task.
_TASK_BITS = 32


class LevelPacker:
    """Open windows by fill level; hands out pieces of the windows that are full.

    A piece is [doc index, start, ids]; ``closed`` collects (sequence, pieces).
    """

    def __init__(self, window: int, first: int, max_open: int = 4096):
        self.window, self.next, self.max_open = window, first, max_open
        self.count = np.zeros(window + 1, np.int64)  # the level array: N(h)
        self.at: list[list[tuple[int, list]]] = [[] for _ in range(window + 1)]
        self.open = 0
        self.closed: list[tuple[int, list]] = []

    def _fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def best_level(self, size: int) -> int:
        """The level (0: a new window) whose use raises the sum of squares least; of equals the fullest."""
        n, w = self.count, self.window
        # Moving a window from h to h + size changes the sum by 2 (N(h + size) - N(h)) + 2; a full window counts no more.
        change = 2 * (n[size : w + 1] - n[: w + 1 - size]) + 2
        change[-1] = 1 - 2 * n[w - size]
        change[1:][n[1 : w + 1 - size] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, doc: int, ids: np.ndarray) -> None:
        w, start = self.window, 0
        while len(ids) - start >= w:
            self.closed.append((self._fresh(), [[doc, start, ids[start : start + w]]]))
            start += w
        size = len(ids) - start
        if not size:
            return
        level = self.best_level(size)
        if level:
            sequence, pieces = self.at[level].pop()
            self.count[level] -= 1
            self.open -= 1
        else:
            sequence, pieces = self._fresh(), []
        pieces.append([doc, start, ids[start:].copy()])
        self._put(level + size, sequence, pieces)
        if self.open >= self.max_open:
            self.merge()

    def _put(self, level: int, sequence: int, pieces: list) -> None:
        if level == self.window:
            self.closed.append((sequence, pieces))
        else:
            self.at[level].append((sequence, pieces))
            self.count[level] += 1
            self.open += 1

    def merge(self) -> None:
        """Cuts pieces of the emptiest open windows to fill the fullest; one window stays open."""
        left = [(level, *x) for level in range(1, self.window) for x in self.at[level]]
        self.at = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        self.open = 0
        low, high = 0, len(left) - 1
        while low < high:
            level, sequence, pieces = left[high]
            while level < self.window and low < high:
                donor_level, donor, rest = left[low]
                doc, start, ids = rest.pop()
                room = self.window - level
                if len(ids) > room:
                    rest.append([doc, start, ids[: len(ids) - room]])
                    start, ids = start + len(ids) - room, ids[len(ids) - room :]
                pieces.append([doc, start, ids])
                level += len(ids)
                left[low] = (donor_level - len(ids), donor, rest)
                if not rest:
                    low += 1
            if level == self.window:
                self.closed.append((sequence, pieces))
                high -= 1
            else:
                left[high] = (level, sequence, pieces)
        if low == high:
            self._put(*left[low])

    def finish(self) -> None:
        self.merge()
        for level in range(1, self.window):
            self.closed += self.at[level]
            self.at[level] = []


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, ``start`` (ids of the document before it),
    ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset`` (ids of the sequence before it)."""
    prepare(docs.sparkSession)
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    kind = source.schema["_id"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(tokenizer_path)
        end = np.array([end_id], np.uint16)
        packer = LevelPacker(window, TaskContext.get().partitionId() << _TASK_BITS)
        names: dict[int, tuple] = {}  # documents with pieces in open windows: id, tokens, pieces still open
        id_type, serial = pa.int64(), 0

        def emit() -> pa.RecordBatch | None:
            cols: list[list] = [[] for _ in range(6)]
            for sequence, pieces in packer.closed:
                at = 0
                for doc, start, ids in pieces:
                    doc_id, tokens = names[doc]
                    for col, x in zip(cols, (doc_id, start, ids.astype("<u4").tobytes(), tokens, sequence, at), strict=True):
                        col.append(x)
                    at += len(ids)
            packer.closed = []
            if not cols[0]:
                return None
            kinds = (id_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[id_col, "start", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in sliced(batches):
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode.ids(text or ""), end])
                names[serial] = (doc_id, len(ids))
                packer.add(serial, ids)
                serial += 1
            if (out := emit()) is not None:
                yield out
            if len(names) > 20_000:
                live = {piece[0] for level in packer.at for _, pieces in level for piece in pieces}
                names = {k: names[k] for k in live}
        packer.finish()
        if (out := emit()) is not None:
            yield out

    schema = f"`{id_col}` {kind.simpleString()}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return source.mapInArrow(task, schema)
