"""Operator 2, quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger row holds the
measurements and one bit per failed rule, so a policy (a named, versioned set
of rules) is a mask: a document passes when ``fail_bits & mask = 0``.  New
policies and ablations read the ledger, never the texts: documents are counted
by their bits, and bitwise tests on those few counts say what each rule alone
removes.

Only built-in column functions; one pass over the documents, no shuffle.

Repeated 3-word windows.  The windows of a text are sorted by a hash, then by
their words, then by place.  So equal windows are neighbours whatever their
hashes are, and the words are compared only where hashes are equal.

Edge cases: a null or empty text has no words and fails ``few_words``; a null
doc_id is carried along; repeated rows give repeated rows; an empty table
gives no rows; other columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import WS

# Rule names by bit, with the failing condition over the measurements.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 3"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("capitals", "2 * n_upper > n_letters"),
    ("exclamations", "10 * n_exclamations > 3 * n_words"),
    ("few_letters", "10 * n_letters < 6 * word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = [
    Policy("base", 1, ("few_words", "repeated_words")),
    Policy("prose", 1, ("few_words", "repeated_words", "symbols", "dup_lines", "capitals")),
    Policy("prose", 2, tuple(BIT)),
]

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters",
            "n_upper", "n_exclamations"]


def _left(text: Column, drop: str) -> Column:
    """Characters of ``text`` left after removing what ``drop`` matches."""
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select("doc_id", t.alias("_t")).select(
        "doc_id", "_t", F.filter(F.split("_t", WS), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    w, n = F.col("_w"), F.size("_w")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"),
        i.alias("at")))
    windows = F.when(n >= 3, F.sort_array(window)).otherwise(
        F.array().cast("array<struct<h:bigint,a:string,b:string,c:string,at:int>>"))
    counted = first.select(
        "doc_id", windows.alias("_s"),
        n.cast("long").alias("n_words"), _left(F.col("_t"), WS).alias("word_chars"),
        _left(F.col("_t"), r"[^#*$%&|<>]+").alias("n_symbols"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _left(F.col("_t"), r"[^\p{L}]+").alias("n_letters"), _left(F.col("_t"), r"[^\p{Lu}]+").alias("n_upper"),
        _left(F.col("_t"), "[^!]+").alias("n_exclamations"))
    s = F.col("_s")

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def repeated(x: Column, i: Column) -> Column:
        before = (i > 0) & same(x, F.get(s, i - 1))
        after = (i < F.size(s) - 1) & same(x, F.get(s, i + 1))
        return F.coalesce(before | after, F.lit(False))

    at = F.sort_array(F.transform(F.filter(s, repeated), lambda x: x["at"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(at, start, lambda a, p: F.struct(
        p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return counted.withColumn("n_repeat_words", covered).select("doc_id", *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``."""
    bits = F.lit(0).cast("long")
    for name, failing in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs).withColumn("fail_bits", bits)


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(rows: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """Per policy and rule: documents, those kept, those failing the rule,
    those kept if the rule were left out, and those only it removes.  One
    count per distinct ``fail_bits`` (at most 2 ** rules rows) is shuffled."""
    counts = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    spec = counts.sparkSession.createDataFrame(
        [(p.name, p.version, r, p.mask, BIT[r]) for p in policies for r in p.rules],
        "policy string, version int, rule string, mask long, bit long")
    b, mask, bit = F.col("fail_bits"), F.col("mask"), F.col("bit")
    kept = b.bitwiseAND(mask) == 0
    without = b.bitwiseAND(mask.bitwiseAND(F.bitwise_not(bit))) == 0

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0))

    return spec.join(counts, F.lit(True)).groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("documents"), total(kept).alias("kept"), total(b.bitwiseAND(bit) != 0).alias("failing"),
        total(without).alias("kept_without"), total(without & ~kept).alias("only_this_rule"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters,
  length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper,
  length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations FROM a LEFT JOIN r USING (rid)),
f AS (SELECT *, (""" + " + ".join(f"CASE WHEN {c} THEN {BIT[n]} ELSE 0 END" for n, c in RULES) + r""")::BIGINT
  AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & """ + str(BASE) + r""") <> 0 AS base_failed, fail_bits = 0 AS kept,
  fail_bits, (fail_bits & """ + str(POLICIES[1].mask) + r""") = 0 AS kept_prose_1 FROM f
"""
