"""Operator 9, toxicity by a weighted finite-state pattern grammar.

Words are first read by a lexical transducer: a trie over characters that
turns a word into one of the symbols of ``SYMBOLS`` (insult, threat, target,
negation, reporting verb, other).  Insults are a seed list plus the words and
word beginnings that the labels give away, so invented or foreign insults are
learned.  Three clause transducers then rewrite the symbols: negation turns an
insult within three words of a negation into a denied one, reported speech
turns insults after a reporting verb into quoted ones, target turns an insult
in a clause that already named a target into an aimed one.  The three are
composed into one machine; each clause it accepts emits one weighted event per
match, and a document's score is a logistic function of its events.  Weights
are learned from the labels.

Training reads at most ``TOXIC_ROWS`` labelled toxic and ``CLEAN_ROWS``
labelled clean rows (documented bounds, chosen by hash, weighted back to the
labelled rates).  Only word counts and event counts of those rows reach the
driver.  Scoring is one pass over all rows, no shuffle.

Edge cases: a null or empty text, or one without a match, has no event and
gets the base score; with no labelled row at all every event keeps its default
weight; null labels and null doc_ids are not learned from; repeated rows score
alike; other columns are ignored."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import saved, small_arrow, small_batches

SYMBOLS = "oIHTNR"  # other, insult, threat (harm), target, negation, reporting verb

# Seed words of the lexical transducer.
SEEDS = {
    "I": "idiot idiots moron morons stupid loser losers scum trash clown clowns worthless pathetic disgusting "
         "imbecile imbeciles dumbass scumbag vermin".split(),
    "H": "kill kills murder strangle stab destroy".split(),
    "T": "you your yours you're he she they them him her his their u ya tu vous du ihr sie usted ustedes".split(),
    "N": "not never no isn't aren't wasn't don't doesn't without pas nicht kein keine".split(),
    "R": "said says say wrote writes claimed claims called quoted reported told".split(),
}

TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
# a learned unit needs this many toxic training rows, and this many that no better unit explains
MIN_ROWS, MIN_NEW = 6, 3
# ... and to be this many times as frequent in toxic rows as in clean ones
ODDS = 50
# a word is taken at once if chance makes so many toxic rows with less than this
# probability and it is in this share of the toxic rows
CHANCE, SHARE = 1e-5, 0.01
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE_END = re.compile(r"[.!?;:,\n]\W*$")


class Lexicon:
    """The lexical transducer: whole words and word beginnings to symbols."""

    def __init__(self, words: dict[str, str], stems: tuple[str, ...] = ()):
        self.words, self.stems = words, tuple(stems)

    def symbol(self, token: str) -> str:
        """Symbol of a white-space-delimited token; the most telling of its words."""
        best = "o"
        for w in _LETTERS.findall(token.lower()):
            s = self.words.get(w) or ("I" if self.stems and w.startswith(self.stems) else "o")
            if "oRNTHI".index(s) > "oRNTHI".index(best):
                best = s
        return best


class Transducer:
    """A deterministic transducer: ``step[state][symbol] = (state, symbol)``."""

    def __init__(self, step: list[dict[str, tuple[int, str]]]):
        self.step = step

    def read(self, state: int, symbol: str) -> tuple[int, str]:
        return self.step[state].get(symbol, self.step[state].get("*", (state, symbol)))

    def compose(self, other: "Transducer", alphabet: str) -> "Transducer":
        """What ``other`` makes of this one's output, as one machine over the
        reachable pairs of states."""
        pairs, step = {(0, 0): 0}, []
        queue = [(0, 0)]
        for a, b in queue:
            row = {}
            for s in alphabet:
                a2, mid = self.read(a, s)
                b2, out = other.read(b, mid)
                if (a2, b2) not in pairs:
                    pairs[a2, b2] = len(pairs)
                    queue.append((a2, b2))
                row[s] = (pairs[a2, b2], out)
            step.append(row)
        return Transducer(step)


def negation(reach: int = 3) -> Transducer:
    """I and H within ``reach`` words after N become i and h."""
    step = [{"N": (reach, "N")}]
    for left in range(1, reach + 1):
        step.append({"N": (reach, "N"), "I": (left - 1, "i"), "H": (left - 1, "h"),
                     **{s: (left - 1, s) for s in "oTR"}})
    return Transducer(step)


def reported() -> Transducer:
    """I and H after a reporting verb in the clause become q (quoted)."""
    return Transducer([{"R": (1, "R")}, {"I": (1, "q"), "H": (1, "q")}])


def targeted() -> Transducer:
    """I and H in a clause that has named a target become A (aimed)."""
    return Transducer([{"T": (1, "T")}, {"I": (1, "A"), "H": (1, "A")}])


GRAMMAR = negation().compose(reported(), SYMBOLS).compose(targeted(), SYMBOLS)
EVENTS = "IHAiqh"  # plain insult, plain threat, aimed, denied insult, quoted, denied threat


def clause_events(symbols: str, grammar: Transducer = GRAMMAR) -> str:
    """Events that the grammar emits over one clause."""
    state, out = 0, []
    for s in symbols:
        state, s = grammar.read(state, s)
        if s in EVENTS:
            out.append(s)
    return "".join(out)


def document_events(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Clauses with each event, per text (one column per event)."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = np.asarray(words.offsets, np.int64)
    bounds = bounds - bounds[0]
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    sym = np.fromiter((SYMBOLS.index(lexicon.symbol(w)) for w in distinct), np.int8, len(distinct))
    end = np.fromiter((bool(_CLAUSE_END.search(w)) for w in distinct), bool, len(distinct))
    index = np.asarray(coded.indices, np.int64)
    out = np.zeros((len(texts), len(EVENTS)))
    if not len(index):
        return out
    sym, end = sym[index], end[index]
    hit = np.concatenate([[0], np.cumsum((sym == 1) | (sym == 2))])
    for i in np.flatnonzero(hit[bounds[1:]] > hit[bounds[:-1]]):
        a, b = bounds[i], bounds[i + 1]
        line = "".join(SYMBOLS[s] + ("." if e else "") for s, e in zip(sym[a:b], end[a:b]))
        for clause in line.split("."):
            if "I" in clause or "H" in clause:
                for e in set(clause_events(clause)):
                    out[i, EVENTS.index(e)] += 1
    return out


class Model:
    """Lexicon, event weights and bias."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        z = np.log1p(document_events(texts, self.lexicon)) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z))


DEFAULT = Model(Lexicon({w: s for s, ws in SEEDS.items() for w in ws}),
                np.array([5.0, 4.0, 6.0, 1.0, 1.0, 1.0]), -3.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, float] | None:
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")) \
                  .where(F.col("_toxic").isin(0, 1) & ~held_out(F.col("_id")) & F.col("_id").isNotNull()) \
                  .groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("_toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    rate = {1: min(1.0, TOXIC_ROWS / sizes[1]), 0: min(1.0, CLEAN_ROWS / sizes[0])}
    key = F.pmod(F.xxhash64(F.col("_id"), F.lit("toxicity sample")), F.lit(1_000_003)) / 1_000_003.0
    # written, so that Spark knows its size when it plans the join with the texts
    taken = saved(known.where(key < F.when(F.col("_toxic") == 1, F.lit(rate[1])).otherwise(F.lit(rate[0]))), "sample-ids")
    # exact copies of one text tell no more than the text itself
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(taken, "_id") \
               .groupBy(F.xxhash64("text").alias("_h")).agg(F.max("_toxic").alias("toxic"), F.max("text").alias("text"))
    return saved(rows, "sample"), rate[1], rate[0]


def _units(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Words and word beginnings that labels give away beyond the seeds.

    Per unit (a whole word, or its first 3 to 7 letters) the toxic and clean
    training rows that have it are counted.  Units almost never seen in clean
    rows are candidates.  Words far beyond chance are taken; then units
    greedily by the toxic rows they explain that nothing taken before does,
    the longest of equals first, so rare words that only accompany insults
    are not taken."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), 1))
    per_row = rows.select("toxic", "_h", F.explode(words).alias("w"))
    cuts = F.concat(F.array(F.concat(F.col("w"), F.lit("$"))),
                    *(F.when(F.length("w") > n, F.array(F.substring("w", 1, n))).otherwise(
                        F.array().cast("array<string>")) for n in range(3, 8)))
    units = saved(per_row.select("toxic", "_h", F.explode(cuts).alias("unit")).distinct(), "units")
    counted = units.groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    telling = counted.where((F.col("t") >= MIN_ROWS) & (F.col("c") / n0 * ODDS <= F.col("t") / n1))
    pairs = units.where("toxic = 1").join(telling, "unit").select("unit", "_h").toPandas()
    seeds = {w + "$" for w in SEEDS["I"] + SEEDS["H"]}
    has = units.where((F.col("toxic") == 1) & F.col("unit").isin(*seeds)).select("_h").distinct().toPandas()
    rows_of = {u: set(g) for u, g in pairs.groupby("unit")["_h"]}
    # chance units: with a share p of toxic rows, t rows are all toxic with p ** t
    sure = max(np.log(CHANCE) / np.log(n1 / (n1 + n0)), SHARE * n1)
    taken = [u for u, g in rows_of.items() if u.endswith("$") and len(g) >= sure]
    explained = set(has["_h"]).union(*(rows_of.pop(u) for u in taken))
    while rows_of:
        unit = max(rows_of, key=lambda u: (len(rows_of[u] - explained), len(rows_of[u]), len(u), u))
        if len(rows_of[unit] - explained) < MIN_NEW:
            break
        taken.append(unit)
        explained |= rows_of.pop(unit)
    return [u[:-1] for u in taken if u.endswith("$")], [u for u in taken if not u.endswith("$")]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn the lexicon and the weights from the rows that are not held out."""
    found = _sample(docs, labels)
    if found is None:
        return DEFAULT
    rows, rate1, rate0 = found
    words, stems = _units(rows)
    lexicon = Lexicon({**DEFAULT.lexicon.words, **dict.fromkeys(words, "I")}, tuple(sorted(stems)))

    def run(batches):
        for batch in small_batches(batches, 1):
            x = document_events(batch.column(1), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))],
                                             names=["toxic", "x"])

    got = rows.select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").toPandas()
    x = np.log1p(np.array(got.x.tolist()).reshape(len(got), len(EVENTS)))
    y = got.toxic.to_numpy(float)
    w = np.where(y == 1, 1 / rate1, 1 / rate0)
    # logistic regression by Newton steps, with a little weight towards the defaults
    theta = np.concatenate([DEFAULT.weights, [DEFAULT.bias]])
    prior, design = theta.copy(), np.column_stack([x, np.ones(len(x))])
    pull = np.diag([0.05] * len(EVENTS) + [0.001])
    for _ in range(25):
        p = 1 / (1 + np.exp(-design @ theta))
        gradient = design.T @ (w * (y - p)) - pull @ (theta - prior)
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + pull
        move = np.linalg.solve(hessian, gradient)
        theta = theta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return Model(lexicon, theta[:-1], float(theta[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    def run(batches):
        for batch in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)), pa.float64())],
                                             names=["doc_id", "score"])

    return small_arrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
               .mapInArrow(run, "doc_id long, score double")
