"""Operator 10, secret scans through a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived:
the literals a match must contain, alternatives or-ed, the trigrams of one
literal and-ed.  The index holds a posting (trigram, document) for every
trigram of the queries that a lower-cased text contains.  Postings are
intersected per document, and only the documents that a query leaves are
verified with the regular expression; a rule without a mandatory trigram scans
every text.

Documents are keyed by two hashes of (doc_id, text), so equal rows share
postings and a null doc_id needs no care.  What is shuffled is narrow
(postings, span texts); of the texts only those with the rarest trigram of
some query literal are, and the posting counts say which is the rarest.
Everything is built-in column functions.

Positions.  ``split`` and ``regexp_extract_all`` see the same matches, so a
match starts after the pieces and matches before it; lengths are code points.
The running sum is over one document's matches of one rule.

Edge cases: a null or empty text has no span (and the hash of the empty
string); repeated rows give repeated rows; an empty table gives no rows; other
columns are ignored."""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import saved


@dataclass(frozen=True)
class Rule:
    """A match counts when its ``group`` has at least ``shortest`` characters."""
    kind: str
    regex: str
    group: int = 0
    shortest: int = 1


# The rules, the base ones first.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[0-9a-zA-Z]+", 0, 24),
    Rule("bearer", r"(?i:authorization:\x20*bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 16),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+:([^\s/@]+)@", 1, 3),
]
BASE = 3
_CLASS = 8  # a character class of at most so many is spelled out


# --- Boolean trigram queries -------------------------------------------------

def _literals(tree) -> tuple[list[list[str]], set[str] | None]:
    """Required literals of a parsed expression: clauses (one of whose strings
    a match must contain) and, if it is finite, the set of its matches."""
    clauses: list[list[str]] = []
    exact: set[str] | None = {""}
    run = {""}  # strings that end at the current place

    def close() -> None:
        nonlocal run
        if all(len(s) >= 3 for s in run):
            clauses.append(sorted(run))
        run = {""}

    for op, arg in tree:
        found, part = [], None
        if op is K.LITERAL:
            part = {chr(arg).lower()}
        elif op is K.IN and not any(o is K.NEGATE for o, _ in arg):
            chars = set()
            for o, v in arg:
                lo, hi = (v, v) if o is K.LITERAL else v if o is K.RANGE else (0, 0x110000)
                chars |= {chr(c).lower() for c in range(lo, min(hi, lo + 2 * _CLASS) + 1)}
            part = chars if len(chars) <= _CLASS else None
        elif op is K.SUBPATTERN:
            found, part = _literals(arg[3])
        elif op is K.BRANCH:
            each = [_literals(b) for b in arg[1]]
            if all(e is not None for _, e in each):
                part = set().union(*(e for _, e in each))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            sub, e = _literals(inner)
            if high == 1 and e is not None:
                part = e | {""} if low == 0 else e
            elif low >= 1:
                found = sub
                if e is not None:
                    close_with = {a + b for a in run for b in e}
                    run = close_with if len(close_with) <= 64 else run
        elif op is K.AT:
            part = {""}
        if part is not None and len(run) * len(part) <= 64:
            run = {a + b for a in run for b in part}
            if exact is not None:
                exact = {a + b for a in exact for b in part} if len(exact) * len(part) <= 64 else None
        else:
            close()
            exact = None
            clauses += found
    close()
    return clauses, exact


def trigram_query(regex: str) -> list[list[list[str]]]:
    """All of the clauses, any of a clause's literals, all of a literal's
    trigrams; empty where no trigram is mandatory."""
    clauses, _ = _literals(parser.parse(regex))
    grams = [[{s[i:i + 3] for i in range(len(s) - 2)} for s in clause] for clause in clauses]
    # a literal whose trigrams include another's asks nothing new
    return [[sorted(g) for g in clause if not any(h < g for h in clause)] for clause in grams]


# --- spans --------------------------------------------------------------------

def rule_spans(text: Column, k: int, rule: Rule) -> Column:
    """array of (start, k, end) of the rule's matches that are long enough."""
    empty = F.array().cast("array<struct<start:long,k:int,end:long>>")
    rx = F.lit(rule.regex)
    step = F.arrays_zip(F.split(text, rule.regex, -1).alias("piece"), F.regexp_extract_all(text, rx, F.lit(0)).alias("hit"),
                        F.regexp_extract_all(text, rx, F.lit(rule.group)).alias("value"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def move(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        found = F.array(F.struct(start.alias("start"), F.lit(k).alias("k"), end.alias("end")))
        good = F.coalesce(F.length(x["value"]) >= rule.shortest, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(a["out"], found)).otherwise(a["out"]).alias("out"))

    return F.when(text.rlike(_probe(rule)), F.aggregate(step, zero, move, lambda a: a["out"])).otherwise(empty)


def _probe(rule: Rule) -> str:
    """A cheaper expression that any text with a counting match satisfies."""
    if rule.group == 0 and rule.regex.endswith("]+") and rule.regex.count("[") == 1 and rule.shortest > 1:
        at = rule.regex.index("[")
        return f"{rule.regex[:-1]}{{{max(1, rule.shortest - at)},}}"
    return rule.regex


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(r.kind) for r in RULES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


# --- index and search -----------------------------------------------------------

def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("_k1", F.xxhash64("doc_id", "text")).withColumn("_k2", F.xxhash64("text", "doc_id"))


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """One row per trigram (its number) and document that contains it."""
    low = rows.select("_k1", "_k2", F.lower("text").alias("_low"))
    held = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    return low.select("_k1", "_k2", F.explode(held).alias("trigram"))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id and ``spans``, an array of (start, k, end) by start and rule
    number ``k``, for every row of ``docs``."""
    queries = [trigram_query(r.regex) for r in rules]
    trigrams = sorted({t for q in queries for clause in q for lit in clause for t in lit})
    number = {t: i for i, t in enumerate(trigrams)}
    rows = _keyed(docs)
    indexed = saved(postings(rows, trigrams), "trigram-postings")
    sizes = {r.trigram: r.n for r in indexed.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).collect()}

    # intersect: the trigrams of a document as bits, 63 to a long
    words = -(-len(trigrams) // 63)
    bits = indexed.groupBy("_k1", "_k2").agg(*(
        F.bit_or(F.when((F.col("trigram") >= 63 * j) & (F.col("trigram") < 63 * (j + 1)),
                        F.expr(f"shiftleft(1L, trigram - {63 * j})"))
                 .otherwise(F.lit(0).cast("long"))).alias(f"_b{j}") for j in range(words)))

    def has(literal: list[str]) -> Column:
        masks = [0] * words
        for t in literal:
            masks[number[t] // 63] |= 1 << (number[t] % 63)
        return reduce(Column.__and__, (F.col(f"_b{j}").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long")
                                       for j, m in enumerate(masks) if m))

    def matches(q: list[list[list[str]]]) -> Column:
        return reduce(Column.__and__, (reduce(Column.__or__, map(has, clause)) for clause in q))

    asked = [k for k, q in enumerate(queries) if q]
    rule_bits = reduce(Column.bitwiseOR, (F.when(matches(queries[k]), F.lit(1 << k)).otherwise(F.lit(0)) for k in asked))
    candidates = bits.select("_k1", "_k2", rule_bits.alias("_rules")).where("_rules != 0")

    # verify: of the texts only those with the rarest trigram of some literal are moved
    rarest = {min(lit, key=lambda t: (sizes.get(number[t], 0), t)) for k in asked for lit in queries[k][0]}
    maybe = rows.where(reduce(Column.__or__, (F.contains(F.lower("text"), F.lit(t)) for t in sorted(rarest))))
    once = maybe.groupBy("_k1", "_k2").agg(F.first("text").alias("text"))
    empty = F.array().cast("array<struct<start:long,k:int,end:long>>")
    verified = once.join(candidates, ["_k1", "_k2"]).select("_k1", "_k2", F.concat(*(
        F.when(F.col("_rules").bitwiseAND(F.lit(1 << k)) != 0, rule_spans(F.col("text"), k, rules[k])).otherwise(empty)
        for k in asked)).alias("_found")).where(F.size("_found") > 0)

    # the rules without a trigram, over every text
    scanned = rows.select("doc_id", "_k1", "_k2", F.concat(
        empty, *(rule_spans(F.col("text"), k, r) for k, r in enumerate(rules) if not queries[k])).alias("_all"))
    return scanned.join(verified, ["_k1", "_k2"], "left").select(
        "doc_id", F.array_sort(F.concat("_all", F.coalesce("_found", empty))).alias("spans"))


def _count(k: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["k"] < BASE)
    return found.select(
        "doc_id", *(_count(k).alias(f"n_{RULES[k].kind}") for k in range(BASE)),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        rx = r.regex.replace("'", "''")
        parts.append(f"""SELECT rid, {k} AS k, '{r.kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT rid, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s, unnest(m) AS m, unnest(v) AS v
  FROM (SELECT rid, regexp_extract_all(t, '{rx}', 0) AS m, regexp_extract_all(t, '{rx}', {r.group}) AS v,
    string_split_regex(t, '{rx}') AS p FROM d)) WHERE length(v) >= {r.shortest}""")
    union = "\nUNION ALL ".join(parts)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({union}),
y AS (SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM x GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN y USING (rid)"""


ORACLE = _sql()
