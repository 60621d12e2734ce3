"""Operator 11, fill-in-middle rows by content-defined chunks.

A text's units are its words, each with the white space before it; white
space at the end is a unit of its own.  To cut a text after a given number of
units, its bytes are split into chunks where a rolling (gear) hash of the last
``WINDOW`` bytes has ``BITS`` leading zero bits, so equal passages give equal
chunks wherever they stand.  What a chunk adds is a summary that can be
combined: word ends inside, code points, and whether its first and last byte
belong to a word.  Summaries are remembered by content; a table lookup
compares the whole chunk, so a hash collision never lends a summary to other
bytes.  Running totals over a text's chunks tell which chunk holds the wanted
word end, and only that chunk is scanned.

Word ends within a text: a chunk's own, one at its start if it begins with
white space and the chunk before it ended in a word, one at the end of the
text unless white space ends it.  So a text that is not empty has one unit
more than word ends before its last byte.

Edge cases: a null or empty text has no units and stays plain; white space
alone is one unit; a null doc_id draws its numbers from the seed alone;
repeated rows give equal rows; an empty table gives no rows; other columns are
ignored.  Memory: a slice of text and a table of at most ``CACHE_BYTES`` of
chunks, emptied when full, per task."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import small_arrow, small_batches

# The marks of prefix, suffix and middle, and the seed of the draws
MARKS = (b"<P>", b"<S>", b"<M>")
SEED = 42

WINDOW = 16  # bytes that decide a chunk's end; a power of two
BITS = 8  # a chunk has 2 ** BITS bytes on average
LONGEST = 1 << 14  # a longer chunk is cut every so many bytes
CACHE_BYTES = 16 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
# one pseudo-random number per byte value
_GEAR = np.array([int.from_bytes(hashlib.blake2s(bytes([b]), digest_size=4).digest(), "little")
                  for b in range(256)], np.uint32)


def chunk_bounds(data: np.ndarray, docs: np.ndarray, window: int = WINDOW, bits: int = BITS,
                 longest: int = LONGEST) -> np.ndarray:
    """Ascending chunk bounds of the texts that stand one after the other in
    ``data``; ``docs`` holds their offsets.  All offsets are bounds."""
    h = _GEAR[data]
    step = 1
    while step < window:  # h[i] covers 2 * step bytes after each turn
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step)
        h, step = wider, 2 * step
    ends = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    # the window must lie within one text
    starts = docs[np.searchsorted(docs, ends - 1, "right") - 1]
    bounds = np.union1d(docs, ends[ends - starts >= window])
    gaps = np.diff(bounds)
    if len(gaps) and gaps.max() > longest:
        more = [np.arange(b + longest, b + g, longest) for b, g in zip(bounds[:-1], gaps) if g > longest]
        bounds = np.union1d(bounds, np.concatenate(more))
    return bounds


def _summaries(chunks: list[bytes]) -> list[tuple[int, int, bool, bool]]:
    """Word ends inside, code points, first and last byte in a word, per
    (non-empty) chunk."""
    data = np.frombuffer(b"".join(chunks), np.uint8)
    size = np.fromiter(map(len, chunks), np.int64, len(chunks))
    stop = np.cumsum(size)
    start = stop - size
    space = _SPACE[data]
    inside = np.zeros(len(data), np.int64)
    inside[1:] = space[1:] & ~space[:-1]
    inside[start] = 0
    ends = np.add.reduceat(inside, start)
    points = np.add.reduceat((data & 0xC0 != 0x80).astype(np.int64), start)
    return list(zip(ends.tolist(), points.tolist(), (~space[start]).tolist(), (~space[stop - 1]).tolist()))


class ChunkTable:
    """Summaries of chunks by content."""

    def __init__(self, max_bytes: int = CACHE_BYTES):
        self._known: dict[bytes, tuple[int, int, bool, bool]] = {}
        self._size, self._max = 0, max_bytes

    def lookup(self, chunks: list[bytes]) -> np.ndarray:
        known = self._known
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        if new:
            self._size += sum(map(len, new)) + 200 * len(new)
            known.update(zip(new, _summaries(new)))
        found = np.array([known[c] for c in chunks], np.int64).reshape(-1, 4)
        if self._size > self._max:
            known.clear()
            self._size = 0
        return found


class Cutter:
    """Units of every text of a slice, and the places of its cuts."""

    def __init__(self, data: np.ndarray, docs: np.ndarray, table: ChunkTable, **chunking):
        self.data, self.docs = data, docs
        self.bounds = b = chunk_bounds(data, docs, **chunking)
        raw = data.tobytes()
        s = table.lookup([raw[i:j] for i, j in zip(b[:-1].tolist(), b[1:].tolist())])
        ends, points, first, last = s[:, 0].copy(), s[:, 1], s[:, 2], s[:, 3]
        opens = np.isin(b[:-1], docs)  # a text's first chunk continues no word
        if len(ends) > 1:
            ends[1:] += (first[1:] == 0) & (last[:-1] == 1) & ~opens[1:]
        self._opens = opens
        self._ends = np.concatenate([[0], np.cumsum(ends)])
        self._points = np.concatenate([[0], np.cumsum(points)])
        at = np.searchsorted(b, docs)
        self._first = at[:-1]
        closed = self._ends[at[1:]] - self._ends[at[:-1]]
        self.units = np.where(docs[1:] > docs[:-1], closed + 1, 0)

    def cut(self, doc: int, units: int) -> tuple[int, int]:
        """Byte offset in ``data`` and code points of the text before the cut
        after so many units."""
        start, stop, k0 = self.docs[doc], self.docs[doc + 1], self._first[doc]
        base = self._points[k0]
        if units <= 0:
            return int(start), 0
        if units >= self.units[doc]:
            return int(stop), int(self._points[np.searchsorted(self.bounds, stop)] - base)
        wanted = self._ends[k0] + units
        k = int(np.searchsorted(self._ends, wanted)) - 1
        lo, hi = self.bounds[k], self.bounds[k + 1]
        from_ = lo if self._opens[k] else lo - 1  # the byte before tells whether a word ends at the chunk's start
        space = _SPACE[self.data[from_:hi]]
        here = np.flatnonzero(space[1:] & ~space[:-1])[wanted - self._ends[k] - 1] + from_ + 1
        points = self._points[k] + np.count_nonzero(self.data[lo:here] & 0xC0 != 0x80)
        return int(here), int(points - base)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers that a document's id decides."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row:
    ``rate`` percent of the texts are cut in three and reordered, ``spm_rate``
    percent of those with the suffix first."""

    def rows(batches):
        table = ChunkTable()
        for batch in small_batches(batches, 1):
            texts = pc.fill_null(batch.column(1).cast(pa.binary()), b"")
            docs_at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
            docs_at = docs_at.astype(np.int64)
            size = int(docs_at[-1] - docs_at[0])
            data = (np.frombuffer(texts.buffers()[2], np.uint8)[docs_at[0]:docs_at[-1]] if size
                    else np.zeros(0, np.uint8))
            docs_at = docs_at - docs_at[0]
            cutter = Cutter(data, docs_at, table)
            raw = data.tobytes()
            out, form, before, between = [], [], [], []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                lo, hi = int(docs_at[i]), int(docs_at[i + 1])
                text, n = raw[lo:hi], int(cutter.units[i])
                h = draws(doc_id, seed)
                if not text or h[2] % 100 >= rate or any(m in text for m in MARKS):
                    out.append(text)
                    form.append("plain")
                    before.append(None)
                    between.append(None)
                    continue
                (p, p_chars), (m, m_chars) = (cutter.cut(i, u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                prefix, middle, suffix = raw[lo:p], raw[p:m], raw[m:hi]
                spm = h[3] % 100 < spm_rate
                out.append(b"".join((MARKS[1], suffix, MARKS[0], prefix, MARKS[2], middle) if spm
                                    else (MARKS[0], prefix, MARKS[1], suffix, MARKS[2], middle)))
                form.append("spm" if spm else "psm")
                before.append(p_chars)
                between.append(m_chars - p_chars)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cutter.units, pa.int64()), pa.array(form, pa.string()),
                 pa.array(before, pa.int64()), pa.array(between, pa.int64()),
                 pa.array(out, pa.binary()).view(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    texts = small_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return texts.mapInArrow(
        rows, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, "|".join(m.decode() for m in MARKS), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k,
  ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3,
  ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(k)::BIGINT AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS a,
  greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(k[1:a], '') AS pre, array_to_string(k[a + 1:b], '') AS mid,
  array_to_string(k[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
