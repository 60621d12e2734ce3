"""Operator 5, token ids in Simple-8b segments.

Format.  A file is a Parquet file of segments; a segment holds consecutive
documents in doc_id order as one binary value:

    magic "S8b1", then little-endian uint32 n_docs, n_blocks, n_words,
    uint64 n_ids; then uint8 has_id[n_docs], int64 doc_id[n_docs],
    uint32 n_tokens[n_docs], uint32 first_word[n_blocks + 1],
    uint64 word[n_words]

Ids are cut into blocks of 1024; each block starts at a word of its own
(``first_word``), so any block decodes alone.  The top four bits of a word
select how the other 60 are used (see ``COUNT`` and ``WIDTH``); selector 1 is
the escape: the next word holds one whole 64-bit value.  A block's last word
may have room for more ids than are left; they are zero and ignored.

Encoding walks all blocks of a segment in lockstep (one numpy step per word
position), decoding expands all words of a selector at once.

Order.  Documents are range-partitioned and sorted by (doc_id, hash of the
text), so a repeated doc_id can split over tasks; segment totals (two longs
per segment) give each document's global start.

Edge cases: a null or empty text is the end id alone; a null doc_id sorts
first; repeated rows are written once each; an empty table gives no rows;
other columns are ignored."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import partitions, small_arrow, small_batches, work_path
from cadenza.llm.tokens import END_ID, encoder

# Fixed values of the format: ids in a word and bits of each, by selector.
COUNT = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

BLOCK = 1024
_HEAD = struct.Struct("<4sIIIQ")
SEGMENTS = "part int, segment int, n_ids long, n_docs long, payload binary"
DOCS = "part int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def encode_words(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of ``values`` (uint64) and each block's first word."""
    n = len(values)
    n_blocks = -(-n // block)
    padded = np.zeros(n_blocks * block, np.uint64)
    padded[:n] = values
    grid = padded.reshape(n_blocks, block)
    size = np.full(n_blocks, block)
    if n % block:
        size[-1] = n % block
    inside = np.arange(block)[None, :] < size[:, None]
    # selector at each position: the first whose next COUNT ids all fit
    selector = np.full(grid.shape, 1, np.int8)
    todo = np.ones(grid.shape, bool)
    usable = [0, *range(2, 16)]
    limits = np.array([1 << int(WIDTH[s]) for s in usable], np.uint64)
    if n and values.max() < 1 << 16:
        need = np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.int8)[padded.astype(np.int64)]
    else:
        need = np.searchsorted(limits, padded, side="right")
    need = np.where(inside, need.reshape(grid.shape), 0).astype(np.int8)
    wide_before = np.zeros((n_blocks, block + 1), np.int16)
    for k, s in enumerate(usable):
        small = need <= k
        n_small = np.count_nonzero(small)
        if n_small == need.size:
            selector[todo] = s
            break
        if 4 * n_small < need.size:
            fit = np.flatnonzero(small)
            # few ids fit the width: only their runs are looked at
            ends = np.flatnonzero(np.append((np.diff(fit) != 1) | (fit[1:] % block == 0), True)) if len(fit) else fit
            stop = np.repeat(fit[ends], np.diff(ends, prepend=-1))
            fit = fit[(stop - fit + 1 >= int(COUNT[s])) | (stop % block == block - 1)]
            fit = fit[todo.ravel()[fit]]
            selector.ravel()[fit] = s
            todo.ravel()[fit] = False
            continue
        np.cumsum(need > k, axis=1, dtype=np.int16, out=wide_before[:, 1:])
        n_ids = min(int(COUNT[s]), block)
        fits = np.empty(grid.shape, bool)
        whole = block - n_ids + 1
        np.equal(wide_before[:, n_ids:], wide_before[:, :whole], out=fits[:, :whole])
        np.equal(wide_before[:, -1:], wide_before[:, whole:-1], out=fits[:, whole:])
        fits &= todo
        selector[fits] = s
        todo ^= fits
        if not todo.any():
            break
    # follow the chain of words of every block in lockstep
    at, alive = np.zeros(n_blocks, np.int64), np.arange(n_blocks)
    where, which, chosen = [], [], []
    while len(alive):
        s = selector[alive, at[alive]]
        where.append(at[alive].copy())
        which.append(alive)
        chosen.append(s)
        at[alive] += COUNT[s]
        alive = alive[at[alive] < size[alive]]
    if not where:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    step = np.repeat(np.arange(len(where)), [len(w) for w in which])
    pos, blk, sel = np.concatenate(where), np.concatenate(which), np.concatenate(chosen)
    order = np.lexsort((step, blk))
    pos, blk, sel = pos[order], blk[order], sel[order]
    slots = 1 + (sel == 1)
    place = np.concatenate([[0], np.cumsum(slots)])
    words = np.zeros(place[-1], np.uint64)
    # zeros behind every block, for words with more room than ids
    behind = np.zeros((n_blocks, block + 240), np.uint64)
    behind[:, :block] = grid
    behind, spot = behind.ravel(), blk * (block + 240) + pos
    for s in range(16):
        rows = np.flatnonzero(sel == s)
        if not len(rows):
            continue
        word = np.full(len(rows), np.uint64(s) << np.uint64(60))
        if s == 1:
            words[place[rows] + 1] = grid[blk[rows], pos[rows]]
        elif s:
            for k in range(COUNT[s]):
                word |= behind[spot[rows] + k] << np.uint64(k * WIDTH[s])
        words[place[rows]] = word
    first = np.zeros(n_blocks + 1, np.uint32)
    first[1:] = np.cumsum(np.bincount(blk, weights=slots, minlength=n_blocks))
    return words, first


def decode_words(words: np.ndarray, first: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values of the words; the inverse of :func:`encode_words`."""
    n_blocks = len(first) - 1
    out = np.zeros(n_blocks * block, np.uint64)
    if not n_blocks:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == 1).any():
        # a word after an escape is a value, not a selector
        value, after = np.zeros(len(words), bool), False
        for i in np.flatnonzero(sel == 1):
            if not value[i]:
                value[i + 1] = True
    else:
        value = np.zeros(len(words), bool)
    held = np.where(value, 0, COUNT[sel])
    before = np.concatenate([[0], np.cumsum(held)])
    blk = np.repeat(np.arange(n_blocks), np.diff(first.astype(np.int64)))
    at = before[:-1] - before[first[:-1].astype(np.int64)][blk]
    for s in range(1, 16):
        rows = np.flatnonzero((sel == s) & ~value)
        if not len(rows):
            continue
        if s == 1:
            out[blk[rows] * block + at[rows]] = words[rows + 1]
            continue
        mask = (np.uint64(1) << np.uint64(WIDTH[s])) - np.uint64(1)
        for k in range(COUNT[s]):
            p = at[rows] + k
            ok = p < block
            out[(blk[rows] * block + p)[ok]] = ((words[rows] >> np.uint64(k * WIDTH[s])) & mask)[ok]
    return out[:n]


def write_segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, first = encode_words(ids.astype(np.uint64))
    has = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    head = _HEAD.pack(b"S8b1", len(doc_ids), len(first) - 1, len(words), len(ids))
    return b"".join([head, has.tobytes(), keys.astype("<i8").tobytes(), counts.astype("<u4").tobytes(),
                     first.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def read_segment(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids, ids per document, and all ids of a segment."""
    magic, n_docs, n_blocks, n_words, n_ids = _HEAD.unpack_from(payload)
    if magic != b"S8b1":
        raise ValueError("not a Simple-8b segment")
    at, parts = _HEAD.size, []
    for dtype, n in (("u1", n_docs), ("<i8", n_docs), ("<u4", n_docs), ("<u4", n_blocks + 1), ("<u8", n_words)):
        parts.append(np.frombuffer(payload, dtype, n, at))
        at += parts[-1].nbytes
    has, keys, counts, first, words = parts
    docs = [int(k) if h else None for h, k in zip(has, keys)]
    return docs, counts.astype(np.int64), decode_words(words, first, n_ids).astype(np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, segment_ids: int = 500_000) -> None:
    """Encode the whole texts and write them below ``path`` in doc_id order:
    part (range of doc_id), segment (number in it) and the payload."""

    def run(batches):
        words, part, segment = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        keys, counts, held, n = [], [], [], 0

        def flush():
            ids = np.concatenate(held)
            payload = write_segment(keys, np.array(counts), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([len(keys)], pa.int64()), pa.array([payload], pa.binary())],
                names=["part", "segment", "n_ids", "n_docs", "payload"])

        for batch in small_batches(batches, 1, 3_000_000, 1024):
            ids, at = words.encode(batch.column(1), END_ID)
            keys += batch.column(0).to_pylist()
            counts += np.diff(at).tolist()
            held.append(ids)
            n += len(ids)
            if n >= segment_ids:
                yield flush()
                segment += 1
                keys, counts, held, n = [], [], [], 0
        if keys:
            yield flush()

    rows = small_arrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(),
                                      F.xxhash64("text")) \
                  .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents
    before it), n_tokens and the crc32 of its ids."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    sizes = files.select("part", "segment", "n_ids")
    by_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    prior = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: the number of partitions is a setting, not the data's size
    parts = by_part.select("part", F.coalesce(F.sum("_n").over(prior.orderBy("part")), F.lit(0)).alias("_p"))
    inside = prior.partitionBy("part").orderBy("segment")
    starts = sizes.join(parts, "part").select(
        "part", "segment", (F.col("_p") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("_base"))

    def run(batches):
        for batch in batches:
            for part, segment, payload in zip(*(c.to_pylist() for c in batch.columns)):
                docs, counts, ids = read_segment(payload)
                ends = np.cumsum(counts)
                raw, at = memoryview(ids.astype("<u4").tobytes()), ends - counts
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), ends.tolist())]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(docs, pa.int64()),
                     pa.array(at, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "segment", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    rows = files.select("part", "segment", "payload").mapInArrow(run, DOCS)
    return rows.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the files below the shared checkpoint folder and read them back."""
    spark = docs.sparkSession
    path = work_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_path)
    return read_token_files(spark, path)
