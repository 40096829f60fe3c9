"""Packing documents into training sequences by best-fit decreasing.

Each task packs the documents of its own partition, a buffer of ``buffer_tokens``
at a time: no shuffle, memory bounded by a buffer and the longest document, and a
lost task is simply run again.  A document is cut into full windows first; what is
left of each is placed by best-fit decreasing, the tightest open window being found
by a segment tree over remaining capacity.  Then the least filled windows are
dissolved and their pieces cut to fill the gaps of the others, and the one that
remains is dealt out as sequences whose lengths are powers of two, which need no
padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release_memory
from tessera.llm.tokens import WORD_BPE, vocabulary, word_tokenizer

#: length is in ids; ids are little-endian unsigned 32-bit
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c.split()[0], pa.binary() if "binary" in c else pa.int64()) for c in SCHEMA.split(", ")])


class CapacityTree:
    """Open windows by remaining capacity 0..window; a node holds how many windows lie below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.bins[capacity].append(window)
        at = self.leaves + capacity
        while at:
            self.count[at] += 1
            at >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Removes an open window of the smallest capacity that is at least ``need``."""
        at = self.leaves + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at == 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Indices of ``lengths`` (each 1..window) by window; ties by index."""
    tree, windows = CapacityTree(window), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = tree.take_tightest(lengths[i])
        if got is None:
            capacity, at = window, len(windows)
            windows.append([])
        else:
            capacity, at = got
        windows[at].append(i)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], at)
    return windows


def plan(lengths: list[int], window: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` that cover each document once."""
    sequences: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for i, n in enumerate(lengths):
        full = n // window * window
        sequences += [[(i, s, window)] for s in range(0, full, window)]
        if n > full:
            rest.append((i, full, n - full))
    packed = [[rest[k] for k in w] for w in best_fit_decreasing([r[2] for r in rest], window)]
    packed.sort(key=lambda w: -sum(p[2] for p in w))  # stable
    room = [window - sum(p[2] for p in w) for w in packed]
    gap = sum(room)
    last: list[tuple[int, int, int]] = []
    while gap and packed:  # the least filled window goes into the gaps of the others
        last = packed.pop()
        gap -= room.pop()
        k = len(packed) - 1
        while last and gap:
            doc, start, length = last.pop()
            while not room[k]:
                k -= 1
            n = min(length, room[k])
            packed[k].append((doc, start, n))
            room[k] -= n
            gap -= n
            if n < length:
                last.append((doc, start + n, length - n))
    used = sum(p[2] for p in last)
    last.reverse()
    while used:  # what is left over: lengths that need no padding
        size = 1 << (used.bit_length() - 1)
        used -= size
        sequence = []
        while size:
            doc, start, length = last.pop()
            n = min(length, size)
            sequence.append((doc, start, n))
            size -= n
            if n < length:
                last.append((doc, start + n, length - n))
        packed.append(sequence)
    return sequences + packed


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    window: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 1,
    buffer_tokens: int = 1 << 21,
    keep_store: bool = True,
) -> DataFrame:
    """Pieces of all documents, one row each (``SCHEMA``).

    A document is its ids and then ``end_id``; a null or empty text is ``end_id``
    alone, repeated rows are packed each time, a null id is carried as null, other
    columns of ``docs`` are not read, and an empty table gives no piece.  Without
    ``keep_store`` a worker forgets its tokenizer's store at the end of a task: less
    memory beside what runs later, more time.  The
    sequence id is the number of the partition (high bits) and of the sequence in
    it; offsets within a sequence are gapless from 0."""
    path = tokenizer or vocabulary(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(path)
        sequence = TaskContext.get().partitionId() << 32
        keys: list = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, tokens, keys, held
            rows: list[tuple] = []
            size = 0
            for pieces in plan([len(x) for x in held], window):
                offset = 0
                for doc, start, length in pieces:
                    ids = held[doc][start : start + length].astype("<u4").tobytes()
                    rows.append((keys[doc], start, length, ids, len(held[doc]), sequence, offset))
                    offset += length
                    size += len(ids)
                sequence += 1
                if size >= 1 << 23:
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)
            keys, held, tokens = [], [], 0

        for batch in batches:
            ids_in, texts = (c.to_pylist() for c in batch.columns)
            some, chars = [], 0
            for i, t in enumerate(texts):
                some.append(i)
                chars += len(t or "")
                if chars >= 1 << 20 or i == len(texts) - 1:
                    for k, ids in zip(some, words.encode([texts[j] for j in some]), strict=True):
                        keys.append(ids_in[k])
                        held.append(np.append(ids, ids.dtype.type(end_id)))
                        tokens += len(held[-1])
                        if tokens >= buffer_tokens:
                            yield from flush()
                    some, chars = [], 0
        yield from flush()
        if not keep_store:
            words.known = {}
        release_memory()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def frame(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
