"""Operator 12, audit of how filters interact.

One pass of a byte transducer measures each whole text.  Its two states are
"in a word" and "between words", its input the class of a UTF-8 byte; a table
gives the next state, a table what is emitted: word start, word end, capital,
code point, symbol.  The next state depends on the byte's class alone, so all
states of a slice are one table lookup moved by one byte, and the automaton
runs over millions of bytes at once.  The emitted word spans go to Arrow's
hash table, which compares the bytes of words with equal hashes; distinct
words of a text are its distinct entries there.

Copies are found by the SHA-256 of the text.  Rows are folded to one per
(digest, part, labels, filters failed) before the smallest doc_id of a digest
is known, so a text that a third of all documents share is a few rows.  What
is left per part is at most 2 ** 5 counts, from which all orders are told:
a document that fails the filters S is removed by f, in an order, when f is
the first of S; over all orders that is 1 / |S| of them.

Edge cases: a null text counts as empty; a null lang is the part ''; a null
doc_id is smaller than none and copies none; rows with equal doc_id are no
copies of each other; a document with several label rows has a label if one
of them says so; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import small_arrow, small_batches

# Filters over the measurements; a copy is an equal text under a smaller doc_id
FILTERS = [
    ("A", "n_words < 100"),
    ("B", "100 * n_distinct < 80 * n_words"),
    ("C", "100 * n_capitals > 10 * n_points"),
    ("D", "n_symbols > 0"),
]
COPIES = "E"
LETTERS = [name for name, _ in FILTERS] + [COPIES]
BIT = {name: 1 << i for i, name in enumerate(LETTERS)}

# byte classes: between words, capital, symbol, continuation byte, any other
_BETWEEN, _CAPITAL, _SYMBOL, _CONTINUES, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[32, *range(9, 14)]] = _BETWEEN
_CLASS[65:91] = _CAPITAL
_CLASS[[ord(c) for c in "#$%&*|"]] = _SYMBOL
_CLASS[0x80:0xC0] = _CONTINUES
# states: 0 between words, 1 in a word; the next state by class, whatever the state
_NEXT = np.array([0, 1, 1, 1, 1], np.uint8)
# what is emitted by state and class
START, END, CAPITAL, SYMBOL, CONTINUES = 1, 2, 4, 8, 16
_EMIT = np.array([[0, START | CAPITAL, START | SYMBOL, START | CONTINUES, START],
                  [END, CAPITAL, SYMBOL, CONTINUES, 0]], np.uint8)


def transduce(data: np.ndarray, docs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per text; the texts stand one after the other in ``data`` and
    ``docs`` holds their offsets."""
    n = len(docs) - 1
    kind = _CLASS[data]
    state = np.zeros(len(data) + 1, np.uint8)
    state[1:] = _NEXT[kind]
    closing = state[docs[1:]] & (docs[1:] > docs[:-1])  # a word goes on at the end of its text
    last = docs[1:][closing == 1]
    state[docs] = 0
    emitted = _EMIT[state[:-1], kind]

    def count(at: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(at, docs))

    def places(mark: int) -> np.ndarray:
        return np.flatnonzero(emitted & mark)

    starts = places(START)
    ends = np.sort(np.concatenate([places(END), last]))
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = data[kind != _BETWEEN]
    words = pa.Array.from_buffers(pa.binary(), len(starts),
                                  [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])
    entry = np.asarray(words.dictionary_encode().indices, np.int64) if len(starts) else np.zeros(0, np.int64)
    text = np.searchsorted(docs, starts, "right") - 1
    # the distinct (text, entry) pairs
    pairs = np.unique(text * (entry.max() + 1 if len(entry) else 1) + entry)
    distinct = np.bincount(pairs // (entry.max() + 1), minlength=n) if len(entry) else np.zeros(n, np.int64)
    return {"n_words": count(starts), "n_distinct": distinct, "n_capitals": count(places(CAPITAL)),
            "n_points": np.diff(docs) - count(places(CONTINUES)), "n_symbols": count(places(SYMBOL))}


MEASURES = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]


def measure(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, the SHA-256 of the text and its measurements, per row."""

    def rows(batches):
        for batch in small_batches(batches, 2, max_rows=1000):
            texts = pc.fill_null(batch.column(2).cast(pa.binary()), b"")
            at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
            at = at.astype(np.int64)
            data = (np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]] if at[-1] > at[0]
                    else np.zeros(0, np.uint8))
            at = at - at[0]
            raw = memoryview(data)
            digests = [hashlib.sha256(raw[i:j]).digest() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            counts = transduce(data, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()),
                 *(pa.array(counts[m], pa.int64()) for m in MEASURES)],
                names=["doc_id", "part", "digest", *MEASURES])

    texts = small_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                    F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                                    F.col("text").cast("string").alias("text")))
    return texts.mapInArrow(rows, "doc_id long, part string, digest binary, "
                            + ", ".join(f"{m} long" for m in MEASURES))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``good`` and ``toxic`` (0 or 1) of each row."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without doc_id find no label: spread over the tasks
    spread = rows.withColumn("_id", F.coalesce("doc_id", F.xxhash64(F.monotonically_increasing_id()))).withColumn(
        "_none", F.col("doc_id").isNull())
    joined = spread.join(marks.withColumn("_none", F.lit(False)), ["_id", "_none"], "left")
    return joined.select(*rows.columns, F.coalesce("good", F.lit(0)).alias("good"),
                         F.coalesce("toxic", F.lit(0)).alias("toxic"))


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, fail_bits (one per filter), and the n documents, good and toxic
    ones that fail just these."""
    bits = F.lit(0)
    for name, failing in FILTERS:
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(BIT[name])).otherwise(F.lit(0)))
    rows = measure(docs, part).select("doc_id", "part", "digest", bits.alias("bits"))
    key = ["digest", "part", "bits", "good", "toxic"]
    per_id = _labelled(rows, labels).groupBy(*key, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    folded = per_id.groupBy(*key).agg(
        F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    # the rows under a digest's smallest doc_id are no copies, nor are those without one
    first = F.min("least").over(Window.partitionBy("digest"))
    kept = F.col("unnamed") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0)
    counted = folded.withColumn("originals", kept)
    split = counted.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("bits").alias("fail_bits"), F.col("originals").alias("n")),
        F.struct(F.col("bits").bitwiseOR(F.lit(BIT[COPIES])).alias("fail_bits"),
                 (F.col("n") - F.col("originals")).alias("n")))).alias("x"))
    return split.groupBy("part", F.col("x.fail_bits").alias("fail_bits")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"),
        F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def audit(counts: DataFrame, letters: list[str] = LETTERS) -> DataFrame:
    """Per part, order of the filters and step: documents kept after it,
    removed by it, those its filter finds already removed, those only it
    finds, good and toxic ones that it removes, and its filter's removals over
    all orders."""
    orders = list(itertools.permutations(letters))
    bit = {name: 1 << i for i, name in enumerate(letters)}
    steps = [("".join(o), k + 1, sum(bit[x] for x in o[:k]), bit[o[k]]) for o in orders for k in range(len(o))]
    table = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"e":{e},"b":{b}}}' for o, s, e, b in steps) + "]"),
                        "array<struct<o:string,s:int,e:int,b:int>>")
    bits, earlier, own = F.col("fail_bits"), F.col("x.e"), F.col("x.b")
    alive = bits.bitwiseAND(earlier) == 0
    fails = bits.bitwiseAND(own) != 0

    def total(when: Column, what: str = "n", share: Column | None = None) -> Column:
        value = F.col(what) if share is None else F.col(what) * share
        return F.sum(F.when(when, value).otherwise(0)).cast("long")

    share = F.expr(f"{len(orders)} div bit_count(fail_bits)")
    return counts.select("*", F.explode(table).alias("x")).groupBy(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step")).agg(
        total(alive & ~fails).alias("kept"), total(alive & fails).alias("removed"),
        total(~alive & fails).alias("redundant"), total(bits == own).alias("unique_fails"),
        total(alive & fails, "good").alias("good_lost"), total(alive & fails, "toxic").alias("toxic_lost"),
        total(fails, "n", share).alias("shapley"))


ORACLE = r"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, substr(o, step, 1) AS own, CASE WHEN step = 1 THEN '-' ELSE '[' || substr(o, 1, step - 1) || ']'
  END AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, o AS filter_order, step, own, contains(f, own) AS fails, regexp_matches(f, earlier) AS gone, f, n,
  good, toxic FROM c, s),
g AS (SELECT part, filter_order, step::INT AS step, own,
  sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN f = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""
