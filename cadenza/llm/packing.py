"""Operator 4, sequence packing by minimum bin slack.

A task reads its rows once.  Whole windows of a long document become
sequences at once; what is left of each document waits in a bounded pool.  A
window starts with the longest waiting piece, and a bitset subset-sum dynamic
program over the multiset of waiting lengths picks the pieces that fill it
closest to its capacity: bit ``s`` of an integer says that ``s`` ids can be
reached, a length with ``c`` copies is added by binary splitting, and the
counts used are found by backtracking through the stored bitsets.  Where the
best fill leaves slack, one waiting piece is cut to close it.  The ids left
at a task's end are cut at powers of two, which need no padding.  No row
moves between tasks and the pool is bounded, so the plan has no shuffle and
works alike at any size.

Edge cases: a null or empty text has the end id only; a null doc_id is
carried along; repeated rows are packed once each; an empty table gives no
rows; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import small_arrow, small_batches
from cadenza.llm.tokens import END_ID, MAX_PIECES, encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def best_fill(counts: np.ndarray | list[int], capacity: int) -> dict[int, int]:
    """How many pieces of each length fill ``capacity`` closest from below;
    ``counts[n]`` pieces of length ``n`` are there."""
    reach, mask, layers = 1, (1 << (capacity + 1)) - 1, []
    for n in range(min(capacity, len(counts) - 1), 0, -1):
        left = min(int(counts[n]), capacity // n)
        if not left:
            continue
        layers.append((n, reach))
        step = 1
        while left:
            take = min(step, left)
            reach |= (reach << (n * take)) & mask
            left -= take
            step *= 2
        if reach >> capacity:
            break
    total, used = reach.bit_length() - 1, {}
    for n, before in reversed(layers):
        k = 0
        while not (before >> total) & 1:
            total -= n
            k += 1
        if k:
            used[n] = k
    return used


class Packer:
    """Pieces in, filled sequences out.  A piece is (doc_id, start, doc_tokens,
    ids).  At least ``low`` pieces wait while more may come, at most ``high``,
    so that the program has lengths to choose from."""

    def __init__(self, capacity: int, first_sequence: int, low: int = 1024, high: int = 4096):
        self.capacity, self.sequence, self.low, self.high = capacity, first_sequence, low, high
        self.waiting: list[list] = [[] for _ in range(capacity + 1)]
        self.counts = [0] * (capacity + 1)
        self.n, self.longest = 0, 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            self.out.append((doc, start, len(ids), total, self.sequence, offset, ids.tobytes()))
            offset += len(ids)
        self.sequence += 1

    def _put(self, piece: tuple) -> None:
        n = len(piece[3])
        self.waiting[n].append(piece)
        self.counts[n] += 1
        self.n += 1
        self.longest = max(self.longest, n)

    def _take(self, n: int) -> tuple:
        self.counts[n] -= 1
        self.n -= 1
        return self.waiting[n].pop()

    def add(self, doc, ids: np.ndarray) -> None:
        total, cap = len(ids), self.capacity
        full = total // cap * cap
        for start in range(0, full, cap):
            self._emit([(doc, start, total, ids[start:start + cap])])
        if full < total:
            self._put((doc, full, total, ids[full:].copy()))
        if self.n >= self.high:
            self._drain(self.low)

    def _window(self) -> list[tuple]:
        while not self.counts[self.longest]:
            self.longest -= 1
        pieces = [self._take(self.longest)]
        room = self.capacity - len(pieces[0][3])
        for n, k in best_fill(self.counts, room).items():
            pieces += [self._take(n) for _ in range(k)]
            room -= n * k
        if room and self.n:
            # every waiting piece is longer than the room: cut the shortest
            n = next(n for n in range(room + 1, self.capacity + 1) if self.counts[n])
            doc, start, total, ids = self._take(n)
            pieces.append((doc, start, total, ids[:room]))
            self._put((doc, start + room, total, ids[room:]))
        return pieces

    def _drain(self, keep: int) -> None:
        while self.n > keep:
            pieces = self._window()
            if sum(len(p[3]) for p in pieces) == self.capacity or self.n:
                self._emit(pieces)
            else:
                self._close(pieces)

    def _close(self, pieces: list[tuple]) -> None:
        """The last pieces, cut at powers of two from the largest down."""
        left = sum(len(p[3]) for p in pieces)
        queue = list(reversed(pieces))
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            part = []
            while room:
                doc, start, total, ids = queue.pop()
                if len(ids) > room:
                    queue.append((doc, start + room, total, ids[room:]))
                    ids = ids[:room]
                part.append((doc, start, total, ids))
                room -= len(ids)
            self._emit(part)

    def finish(self) -> None:
        self._drain(0)

    def rows(self) -> pa.RecordBatch:
        cols = list(zip(*self.out)) if self.out else [[]] * 7
        self.out = []
        types = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, low: int = 1024,
         high: int = 4096, max_pieces: int = MAX_PIECES, slice_bytes: int = 3_000_000) -> DataFrame:
    """Pieces of packed sequences: doc_id, start (ids of the document before
    the piece), length, doc_tokens, sequence_id, offset in the sequence, and
    the ids as little-endian unsigned 32-bit integers.  ``capacity`` must be a
    power of two.  A task encodes about ``slice_bytes`` of text at a time and
    remembers about ``max_pieces`` words: less takes less memory and more time,
    the rows are the same."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches):
        words = encoder(tokenizer_path, max_pieces)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40, low, high)
        for batch in small_batches(batches, 1, slice_bytes, 1024):
            ids, at = words.encode(batch.column(1), END_ID)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                packer.add(doc, ids[at[i]:at[i + 1]])
            if packer.out:
                yield packer.rows()
        packer.finish()
        if packer.out:
            yield packer.rows()

    return small_arrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
               .mapInArrow(run, SCHEMA)


def unpack(pieces: DataFrame, spark_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number of ids per document over its pieces, for round-trip checks."""
    return pieces.groupBy(*spark_cols).agg(F.sum("length").alias("n_tokens"), F.max("doc_tokens").alias("doc_tokens"))
