"""Operator 13, document fingerprints as bottom-k sketches.

A text's shingles are its runs of ``WORDS`` words (a shorter text that has a
word is one shingle); each is hashed to 64 bits of its MD5, written as 16 hex
digits, and the K smallest distinct hashes are the sketch.  The K smallest of
two sketches' hashes are the sketch of both texts' shingles, so sketches of
parts merge into those of the whole.  Two sketches are compared below the
smaller of the two largest hashes of full sketches: there both are complete,
so the share of common hashes estimates resemblance and containment, and a
sketch that is not full gives its exact numbers.  A full sketch's largest
hash also tells the number of distinct shingles.

The edited text (``with_edits``) needs the document that follows by doc_id.
A range partitioning of the doc_ids alone finds the bounds of as many ranges
as there are shuffle partitions (these bounds are what reaches the driver);
each text is then shuffled once, by its range, and the first document of a
range is also dealt to the range before, as the follower of its last.

Only built-in column functions.

Edge cases: a null or empty text has no shingle and an empty sketch; two empty
sketches are alike (1), an empty and another are not (0); rows with equal
doc_id follow each other by the MD5 of their texts; a row without doc_id has no
follower: nothing is put in the place of its removed half and its
``near_next`` is null; a single document follows itself; an empty table gives
no rows; other columns are ignored."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import WS, partitions

WORDS = 5  # words in a shingle
K = 128  # hashes in a full sketch: a standard error of 0.044 at most


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The hash of each shingle of a text, in order of place."""

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(
            at, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i + 1, words), " ").cast("binary")), 1, 16)))

    # the words are bound once, by a one-element array, and not split anew at every use
    split = F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda x: x != "")
    return F.flatten(F.transform(F.array(split), hashes))


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<string>: the ``k`` smallest distinct shingle hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both sketches' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _shares(a: Column, b: Column, k: int, result) -> Column:
    """``result(a, b, common)`` of the hashes of both sketches up to the
    largest hash to which both are complete."""
    def limit(s: Column) -> Column:
        return F.when(F.size(s) >= k, F.element_at(s, -1)).otherwise(F.lit("g"))  # after every hex digit

    def compare(x: Column) -> Column:
        most = F.least(limit(x["a"]), limit(x["b"]))
        return F.transform(F.array(F.struct(
            F.filter(x["a"], lambda h: h <= most).alias("a"), F.filter(x["b"], lambda h: h <= most).alias("b"))),
            lambda y: result(F.size(y["a"]), F.size(y["b"]), F.size(F.array_intersect(y["a"], y["b"]))))[0]

    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), compare)[0]


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 if both are empty."""
    return _shares(a, b, k, lambda n, m, common: F.when(n + m == 0, F.lit(1.0)).otherwise(
        common.cast("double") / (n + m - common)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too; 1 if a is empty."""
    return _shares(a, b, k, lambda n, m, common: F.when(n == 0, F.lit(1.0)).otherwise(common.cast("double") / n))


def n_distinct(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    high = F.conv(F.substring(F.element_at(s, k), 1, 13), 16, 10).cast("double") / float(16 ** 13)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(k - 1.0) / high)


def digest(s: Column) -> Column:
    """The sketch as one string of 16 hex digits a hash."""
    return F.array_join(s, "")


def parts(digested: Column) -> Column:
    """The sketch of a string that ``digest`` wrote."""
    last = F.floor(F.length(digested) / 16).cast("int") - 1
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(digested, i * 16 + 1, F.lit(16))))


def group_sketches(docs: DataFrame, by: str, k: int = K) -> DataFrame:
    """``by``, sketch and estimated distinct shingles of all of a group's texts
    together.  Each task first keeps the k smallest of its own distinct hashes a
    group, so a group that holds most rows sends no more than k from a task."""
    hashes = docs.select(F.col(by), F.explode(sketch(F.col("text").cast("string"), k)).alias("_h")).distinct()
    least = Window.partitionBy(by).orderBy("_h")
    kept = hashes.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k)
    full = kept.groupBy(by).agg(F.sort_array(F.collect_list("_h")).alias("sketch"))  # at most k a group
    every = docs.select(by).distinct().join(full.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left")
    s = F.coalesce("sketch", F.array().cast("array<string>"))
    return every.select(by, s.alias("sketch"), n_distinct(s, k).alias("n_distinct"))


def _bounds(docs: DataFrame, ranges: int) -> list[int]:
    """The smallest doc_id of each of at most ``ranges`` ranges."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    least = ids.repartitionByRange(ranges, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("lo"))
    return sorted({r.lo for r in least.select("lo").collect()})


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of the range that holds a doc_id: bounds in blocks of about
    their square root, so a lookup compares two short lists."""
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    heads = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<long>")
    inner = F.from_json(F.lit(json.dumps(blocks)), "array<array<long>>")
    head = F.size(F.filter(heads, lambda x: x <= doc_id)) - 1
    return head * width + F.size(F.filter(F.get(inner, head), lambda x: x <= doc_id)) - 1


def with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text, its sketch, the edited text (its last half replaced by as
    much of the following document's start), the edited text's sketch and the
    follower's sketch (null where there is none), per row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions(spark)
    bounds = _bounds(rows, 4 * n)
    ids = F.col("doc_id")
    at = _range_of(ids, bounds) if bounds else F.lit(0)
    before = F.when(F.col("_at") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("_at") - 1)
    opens = ids.isin(bounds) if len(bounds) <= 10 else F.array_contains(
        F.get(F.from_json(F.lit(json.dumps([[b] for b in bounds])), "array<array<long>>"), F.col("_at")), ids)
    # turn 1 is the row itself, turn 2 a copy that stands behind the range before
    itself = F.struct(F.col("_at").alias("at"), F.lit(1).alias("turn"))
    copied = F.when(opens, F.array(itself, F.struct(before.alias("at"), F.lit(2).alias("turn")))).otherwise(F.array(itself))
    named = rows.where("doc_id IS NOT NULL").withColumn("_at", at).withColumn("_x", F.explode(copied))
    dealt = named.select("doc_id", "text", F.col("_x.at").alias("_at"), F.col("_x.turn").alias("_turn")) \
        .repartition(n, "_at").withColumn("_sketch", sketch(F.col("text"), k))
    order = Window.partitionBy("_at").orderBy("_turn", "doc_id", F.md5(F.col("text").cast("binary")))
    followed = dealt.withColumn("_next", F.lead("text").over(order)).withColumn(
        "_next_sketch", F.lead("_sketch").over(order)).where("_turn = 1")
    unnamed = rows.where("doc_id IS NULL").withColumn("_sketch", sketch(F.col("text"), k))
    whole = followed.select("doc_id", "text", "_sketch", "_next", "_next_sketch").unionByName(
        unnamed.select("doc_id", "text", "_sketch", F.lit("").alias("_next"),
                       F.lit(None).cast("array<string>").alias("_next_sketch")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("_next").substr(F.lit(1), half))
    return whole.withColumn("edited", edited).select(
        "doc_id", "text", F.col("_sketch").alias("sketch"), "edited", sketch(F.col("edited"), k).alias("edited_sketch"),
        F.col("_next_sketch").alias("next_sketch"))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """One digest row per document, its edited text and its follower."""
    a, e, b = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return with_edits(docs, k).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(a).alias("fingerprint"), digest(e).alias("edited_fingerprint"), resemblance(a, e, k).alias("near_edited"),
        resemblance(a, b, k).alias("near_next"), F.round(n_distinct(a, k), 6).alias("n_shingles"),
        containment(a, e, k).alias("held_by_edited"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, CASE WHEN doc_id IS NULL THEN '' ELSE coalesce(lead(t) OVER w, first(t) OVER w) END AS nt,
  coalesce(lead(doc_id) OVER w, first(doc_id) OVER w) AS next_id,
  length(t) AS c FROM d WINDOW w AS (ORDER BY doc_id, md5(t) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(t, 1, c - c // 2) || substr(nt, 1, c // 2) AS e FROM n),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS tw,
  list_filter(regexp_split_to_array(e, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ew FROM e),
s AS (SELECT *, list_sort(list_distinct(CASE WHEN len(tw) = 0 THEN []::VARCHAR[] ELSE list_transform(
    range(1, greatest(len(tw) - 3, 2)), lambda i: md5(array_to_string(tw[i:i + 4], ' '))[1:16]) END))[1:128] AS a,
  list_sort(list_distinct(CASE WHEN len(ew) = 0 THEN []::VARCHAR[] ELSE list_transform(
    range(1, greatest(len(ew) - 3, 2)), lambda i: md5(array_to_string(ew[i:i + 4], ' '))[1:16]) END))[1:128] AS b FROM w),
f AS (SELECT s.*, o.a AS o FROM s JOIN s o ON s.next_id = o.doc_id),
x AS (SELECT *, least(CASE WHEN len(a) < 128 THEN 'g' ELSE a[128] END, CASE WHEN len(b) < 128 THEN 'g' ELSE b[128] END)
    AS lb, least(CASE WHEN len(a) < 128 THEN 'g' ELSE a[128] END, CASE WHEN len(o) < 128 THEN 'g' ELSE o[128] END) AS lo
  FROM f),
y AS (SELECT *, list_filter(a, lambda h: h <= lb) AS ab, list_filter(b, lambda h: h <= lb) AS bb,
  list_filter(a, lambda h: h <= lo) AS ao, list_filter(o, lambda h: h <= lo) AS oo FROM x),
z AS (SELECT *, len(list_intersect(ab, bb)) AS cb, len(list_intersect(ao, oo)) AS co FROM y)
SELECT doc_id, c::BIGINT AS n_chars, sha256(e) AS edited_sha256, array_to_string(a, '') AS fingerprint,
  array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(ab) + len(bb) = 0 THEN 1.0::DOUBLE ELSE cb::DOUBLE / (len(ab) + len(bb) - cb) END AS near_edited,
  CASE WHEN len(ao) + len(oo) = 0 THEN 1.0::DOUBLE ELSE co::DOUBLE / (len(ao) + len(oo) - co) END AS near_next,
  round(CASE WHEN len(a) < 128 THEN len(a)::DOUBLE
    ELSE 127.0::DOUBLE / (('0x' || a[128][1:13])::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE) END, 6) AS n_shingles,
  CASE WHEN len(ab) = 0 THEN 1.0::DOUBLE ELSE cb::DOUBLE / len(ab) END AS held_by_edited FROM z
"""
