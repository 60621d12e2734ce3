"""Operator 1, benchmark decontamination.

Seeds.  Every item of the benchmark is cut into word n-grams.  A first pass
over all documents counts in how many of them each of these n-grams is found
(each task adds up its own counts, so the shuffle is a few numbers per n-gram
and task).  Of every ``WINDOW`` consecutive n-grams of an item the rarest is
kept as a seed: no item loses all its seeds however often it was copied, and
any ``N + WINDOW - 1`` unchanged words in a row contain a seed.

Alignment.  A second pass looks the documents' n-grams up among the seeds and
aligns the passage around the hits with the item by Smith-Waterman over words
(vectorised over a slice's passages).  The score is the best local score
divided by that of a full exact copy, so 1 is a whole copy; edited or
paraphrased copies lose for each changed, added or missing word.  A document
is contaminated by the item if the score is ``MIN_SCORE`` or more, or if the
local alignment alone is worth ``LONG_RUN`` equal words, whatever share of a long
item that is.  Of an item under ``MIN_WORDS`` words only a whole exact copy counts.

The benchmark is the small side: it is cut into blocks of at most
``BLOCK_BYTES`` of text by hash, and each block is shipped to the tasks, so
what is shipped has a fixed bound and a large benchmark takes more passes.
Documents are never shuffled or paired with one another.

Words are lower-cased and freed of everything but letters and digits.  In
scripts that put no space between words every character is a word.

Edge cases: null or empty texts match nothing; items under ``N`` words
are not looked for (one or two words are found in any text); a null doc_id or
item_id is carried along; repeated rows or items each give their own rows;
with an empty table on either side nothing matches; other columns are kept
by ``decontaminate`` and ignored by ``matches``."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import small_arrow, small_batches, word_table

N, WINDOW, MIN_WORDS = 3, 3, 8
MIN_SCORE, LONG_RUN = 0.5, 30
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 16_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_DROP = re.compile(r"[\W_]+")
_BITS = 20
# Blocks of scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han)
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_KNOWN = 200_000  # words whose hashes a task remembers


def _parts(word: str) -> list[str]:
    """The words that a white-space-delimited word holds: itself, but each
    character of an unspaced script on its own."""
    if word.isascii() or not _UNSPACED.search(word):
        return [word]
    return [x for x in re.split(f"({_UNSPACED.pattern})", word) if x]


def _hash(word: str) -> int:
    plain = _DROP.sub("", word).lower()
    return xxhash.xxh3_64_intdigest(plain) if plain else 0


class Words:
    """Hashes of words, remembered within a task."""

    def __init__(self):
        self._one: dict[str, int] = {}
        self._many: dict[str, list[int]] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word of the texts, and each text's first word."""
        number, distinct, at = word_table(texts)
        one, many = self._one, self._many
        if len(one) > _KNOWN:
            one.clear()
            many.clear()
        for w in distinct:
            if w not in one:
                found = [_hash(x) for x in _parts(w)]
                one[w] = found[0] if len(found) == 1 else 0
                if len(found) > 1:
                    many[w] = found
        table = np.fromiter(map(one.__getitem__, distinct), np.uint64, len(distinct))
        words = table[number]
        if many and not many.keys().isdisjoint(distinct):
            apart = [many.get(w, ()) for w in distinct]
            size = np.fromiter((max(1, len(x)) for x in apart), np.int64, len(apart))
            starts = np.concatenate([[0], np.cumsum(size)])
            every = np.zeros(starts[-1], np.uint64)
            every[starts[:-1]] = table
            for i, x in enumerate(apart):
                if x:
                    every[starts[i]:starts[i + 1]] = x
            n = size[number]
            ends = np.concatenate([[0], np.cumsum(n)])
            words = every[np.repeat(starts[number] - ends[:-1], n) + np.arange(ends[-1])]
            at = ends[at]
        real = words != 0
        return words[real], np.concatenate([[0], np.cumsum(real)])[at]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and each text's first word."""
    return Words()(texts)


def grams(words: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that starts at each word (the last N - 1 have none)."""
    if len(words) < N:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - N + 1, np.uint64)
    for k in range(N):
        h = (h ^ words[k:len(words) - N + 1 + k]) * _P
        h ^= h >> np.uint64(29)
    return h


class Index:
    """Seed hashes to (item, position), and the items' words."""

    def __init__(self, items: list[np.ndarray], chosen: list[np.ndarray]):
        self.items = items
        hashes = np.concatenate([grams(w)[c] for w, c in zip(items, chosen)] or [np.zeros(0, np.uint64)])
        item = np.concatenate([np.full(len(c), i) for i, c in enumerate(chosen)] or [np.zeros(0, int)]).astype(np.int64)
        place = np.concatenate(chosen or [np.zeros(0, int)]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.seeds, self.first = np.unique(hashes[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are seeds, and which."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.seeds, h[at]), len(self.seeds) - 1)
        hit = self.seeds[k] == h[at]
        return at[hit], k[hit]


def smith_waterman(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score of each passage with its item, and where in the passage
    that alignment starts and ends.  One numpy step per item word, over all
    passages; gaps along the passage by a running maximum."""
    width, c = max(map(len, passages)), len(passages)
    text = np.zeros((c, width), np.uint64)
    for i, p in enumerate(passages):
        text[i, :len(p)] = p
    shown = np.arange(width)[None, :] < np.array([len(p) for p in passages])[:, None]
    column = np.arange(width)[None, :]
    score = np.zeros((c, width + 1), np.int64)
    origin = np.tile(np.arange(width + 1), (c, 1))
    best, start, end = np.zeros(c, np.int64), np.zeros(c, np.int64), np.zeros(c, np.int64)
    everyone = np.arange(c)
    for step in range(max(map(len, items))):
        has = np.array([step < len(t) for t in items])
        word = np.array([t[step] if step < len(t) else 0 for t in items], np.uint64)
        same = (text == word[:, None]) & shown
        diagonal = score[:, :-1] + np.where(same, MATCH, MISMATCH)
        above = score[:, 1:] + GAP
        x = np.maximum(np.maximum(diagonal, above), 0)
        o = np.where(x == diagonal, origin[:, :-1], np.where(x == above, origin[:, 1:], column + 1))
        o = np.where(x == 0, column + 1, o)
        # gaps along the passage: the best earlier value less the distance
        key = np.maximum.accumulate(((x - GAP * column) << 24) | ((1 << 24) - 1 - column), axis=1)
        source = (1 << 24) - 1 - (key & ((1 << 24) - 1))
        value = (key >> 24) + GAP * column
        o = np.where(value > 0, np.take_along_axis(o, source, axis=1), column + 1)
        value = np.where(shown, np.maximum(value, 0), 0)
        keep = has[:, None]
        score[:, 1:] = np.where(keep, value, score[:, 1:])
        origin[:, 1:] = np.where(keep, o, origin[:, 1:])
        top = np.where(has, value.argmax(axis=1), 0)
        higher = has & (value[everyone, top] > best)
        best = np.where(higher, value[everyone, top], best)
        start = np.where(higher, o[everyone, top], start)
        end = np.where(higher, top + 1, end)
    return best, start, end


def accepted(best: int, length: int, min_score: float) -> bool:
    """Whether a local score is a leak of an item of ``length`` words."""
    if length < MIN_WORDS:
        return best == MATCH * length
    return best >= min_score * MATCH * length or best >= MATCH * LONG_RUN


def find(texts: pa.Array, index: Index, min_score: float, hashes=word_hashes) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, word after the last) of every text and
    item with an accepted passage; the best passage of each."""
    words, at = hashes(texts)
    h = grams(words)
    place, seed = index.look_up(h)
    row = np.searchsorted(at, place, side="right") - 1
    inside = place + N <= at[row + 1]
    starts: dict[tuple[int, int], set[int]] = defaultdict(set)
    for p, s, r in zip(place[inside].tolist(), seed[inside].tolist(), row[inside].tolist()):
        for k in range(index.first[s], index.first[s + 1]):
            starts[r, int(index.item[k])].add(p - int(index.place[k]))
    todo, out = [], {}
    for (r, i), found in starts.items():
        n = len(index.items[i])
        lo, hi = int(at[r]), int(at[r + 1])
        begin = last = None
        for p in sorted(found):
            # passages that could hold one alignment are read as one
            if begin is not None and p - last > n:
                todo.append((r, i, max(lo, begin - n // 2), min(hi, last + n + n // 2)))
                begin = None
            begin, last = p if begin is None else begin, p
        todo.append((r, i, max(lo, begin - n // 2), min(hi, last + n + n // 2)))
    # similar sizes together, so that little is padded
    todo.sort(key=lambda t: (t[3] - t[2], len(index.items[t[1]])))
    while todo:
        part, cells = [], 0
        while todo and len(part) < 256 and (not part or cells < 200_000):
            part.append(todo.pop())
            cells += part[0][3] - part[0][2] + 1
        best, start, end = smith_waterman([words[a:b] for _, _, a, b in part], [index.items[i] for _, i, _, _ in part])
        for (r, i, a, _), s, x, y in zip(part, best, start, end):
            score = float(s) / (MATCH * len(index.items[i]))
            if accepted(int(s), len(index.items[i]), min_score) and score > out.get((r, i), (0,))[0]:
                first = a - int(at[r])
                out[r, i] = (score, first + int(x), first + int(y))
    return [(r, i, *v) for (r, i), v in sorted(out.items())]


def _blocks(benchmark: DataFrame) -> list[tuple[list, list[np.ndarray]]]:
    """The items in blocks of bounded size: ids and words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        words, at = word_hashes(pa.array([r.text for r in rows], pa.string()))
        cut = [words[at[i]:at[i + 1]] for i in range(len(rows))]
        keep = [i for i, w in enumerate(cut) if len(w) >= N]
        if keep:
            yield [rows[i].item_id for i in keep], [cut[i] for i in keep]


def rarest(items: list[np.ndarray], counts: dict[int, int]) -> list[np.ndarray]:
    """Positions of each item's seeds: the rarest of every WINDOW n-grams."""
    out = []
    for words in items:
        key = [(counts.get(int(g), 0), int(g)) for g in grams(words)]
        last = max(0, len(key) - WINDOW)
        out.append(np.array(sorted({min(range(a, min(a + WINDOW, len(key))), key=lambda k: key[k])
                                    for a in range(last + 1)}), np.int64))
    return out


def build(docs: DataFrame, benchmark: DataFrame) -> list[tuple[list, Index]]:
    """Per block of the benchmark the item ids and the index of rare seeds."""
    texts = small_arrow(docs).select(F.col("text").cast("string").alias("text"))
    out = []
    for ids, items in _blocks(benchmark):
        everything = Index(items, [np.arange(len(w) - N + 1) for w in items])

        def count(batches, index=everything):
            total, hashes = np.zeros(len(index.seeds), np.int64), Words()
            for batch in small_batches(batches, 0):
                words, at = hashes(batch.column(0))
                place, seed = index.look_up(grams(words))
                row = np.searchsorted(at, place, side="right") - 1
                inside = place + N <= at[row + 1]
                total += np.bincount(np.unique(row[inside] * len(total) + seed[inside]) % len(total),
                                     minlength=len(total))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())],
                                             names=["seed", "n"])

        found = texts.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()
        counts = dict(zip(everything.seeds[found.seed.to_numpy(int)].tolist(), found.n.tolist()))
        out.append((ids, Index(items, rarest(items, counts))))
    return out


MATCHES = "doc_id long, item_id long, score double, first_word long, end_word long, item_words long"


def matches(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document and item that it contains: the score and the words
    of the document (letters and digits only) that the passage spans."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], MATCHES)
    for ids, index in build(docs, benchmark):
        shipped = spark.sparkContext.broadcast((ids, index))

        def run(batches, shipped=shipped):
            (ids, index), hashes = shipped.value, Words()
            for batch in small_batches(batches, 1):
                doc = batch.column(0).to_pylist()
                got = [(doc[r], ids[i], s, a, b, len(index.items[i])) for r, i, s, a, b in
                       find(batch.column(1), index, min_score, hashes)]
                if got:
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*got), types)],
                        names=["doc_id", "item_id", "score", "first_word", "end_word", "item_words"])

        out = out.unionByName(rows.mapInArrow(run, MATCHES))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` without those that contain an item, all columns kept."""
    out, text_at = docs, docs.columns.index("text")
    for _, index in build(docs, benchmark):
        shipped = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shipped=shipped):
            hashes = Words()
            for batch in small_batches(batches, text_at):
                hit = {r for r, *_ in find(batch.column(text_at), shipped.value, min_score, hashes)}
                yield batch.filter(pa.array([r not in hit for r in range(len(batch))]))

        out = out.mapInArrow(run, docs.schema)
    return out
