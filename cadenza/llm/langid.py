"""Operator 6, language ID by nearest centroid.

A text is lower-cased, every run of non-letters becomes one space, and its
character bigrams and trigrams are counted in ``DIM`` hashed buckets.  Counts
are damped (log(1 + n)), weighted by inverse document frequency and
normalised.  Each language has several centroids (spherical k-means over its
training vectors); a text gets the language of the centroid with the highest
cosine, and is rejected when that cosine is far below what texts of that
language and of about its length reach.  The rule is the same for all lengths:
for every length class texts are made from the training rows of a language, by
thinning the n-gram counts of longer rows and adding up those of shorter ones.

Training.  Each language gives at most ``PER_LANG`` rows, all languages
together at most ``TOTAL`` (documented bounds; the rows are those with the
smallest hash shares, so the choice does not depend on the partitioning).
Only their hashed counts reach the driver; the model is languages x
centroids x DIM floats.  Prediction is one pass over the rows, no shuffle.

Edge cases: a null text or one without a letter gives ``und`` and score 0 and
counts as rejected, as does every text when no row can be learned from; null
languages and null doc_ids are not learned from; a null doc_id is not held
out; repeated rows are predicted alike; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import small_arrow, small_batches

DIM = 4096
PER_LANG, TOTAL, CENTROIDS, ROUNDS = 400, 4000, 4, 8
# a cosine below this share of a low quantile of its language's training texts of its length is rejected
REJECT, QUANTILE = 0.4, 0.05
# that many texts of each length class are made from a language's training rows, whatever lengths those have
MADE = 60
UNKNOWN = "und"
SLICE = (500_000, 128)  # text bytes and rows that are turned into vectors at once

_FOLD: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """The code of each letter, 32 for all else, by code point."""
    if not _FOLD:
        codes = np.arange(0x110000, dtype=np.uint32)
        alpha = np.fromiter((chr(c).isalpha() for c in range(0x30000)), bool, 0x30000)
        codes[:0x30000][~alpha] = 32
        codes[0x30000:] = 32
        _FOLD.append(codes)
    return _FOLD[0]


def features(texts: list[str | None]) -> np.ndarray:
    """Hashed n-gram counts, one row per text."""
    lowered = [(t or "").lower() for t in texts]
    lengths = np.fromiter((len(t) for t in lowered), np.int64, len(lowered))
    raw = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _letters()[raw]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    out = np.zeros(len(texts) * DIM)
    if len(code) > 1:
        same = row[1:] == row[:-1]
        pair = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)
        pair ^= pair >> np.uint32(15)
        slot = row[:-1] * DIM + (pair * np.uint32(0xC2B2AE3D) >> np.uint32(20))
        out += np.bincount(slot[same], minlength=len(out))
        if len(code) > 2:
            same = row[2:] == row[:-2]
            three = pair[:-1] * np.uint32(0x27D4EB2F) + code[2:] * np.uint32(0x165667B1)
            three ^= three >> np.uint32(15)
            slot = row[:-2] * DIM + (three * np.uint32(0x9E3779B1) >> np.uint32(20))
            out += np.bincount(slot[same], minlength=len(out))
    else:
        out += 0
    return out.reshape(len(texts), DIM)


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.fromiter((t is not None and any(map(str.isalpha, t)) for t in texts), bool, len(texts))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + counts.sum(axis=1)).astype(int), 31)


class Model:
    """Inverse document frequencies, centroids (unit rows) with the language
    of each, and the lowest accepted cosine by language and length class."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.names = sorted(set(langs))
        self.idf = np.log((1 + len(langs)) / (1 + (counts > 0).sum(axis=0))) + 1
        x, y = self.vectors(counts), np.array([self.names.index(v) for v in langs])
        centroids, self.lang = [], []
        for k in range(len(self.names)):
            found = self._cluster(x[y == k])
            centroids.append(found)
            self.lang += [k] * len(found)
        self.lang = np.array(self.lang)
        self.centroids = np.concatenate(centroids).T.astype(np.float32)
        self.floor = np.stack([self._floors(counts[y == k]) for k in range(len(self.names))])

    def _floors(self, rows: np.ndarray) -> np.ndarray:
        """The lowest accepted cosine of one language's texts by length class."""
        rng = np.random.default_rng(1)
        total = rows.sum(axis=1)
        floor = np.zeros(32)
        for b in range(1, 32):
            if b > 24:  # beyond that many n-grams the cosine no longer changes
                floor[b] = floor[24]
                continue
            made = []
            for k in rng.integers(len(rows), size=MADE):
                # the class starts at 2 ** b - 1 n-grams; a text too short for it goes on with others
                n, x, size = 1 << b, rows[k], total[k]
                if size < n:
                    more = rng.integers(len(rows), size=min(64, int(n // max(1, total.mean())) + 1))
                    x = x + rows[more].sum(axis=0)
                    size = x.sum()
                made.append(rng.binomial(x.astype(np.int64), min(1.0, n / max(1, size))))
            best = self.cosines(self.vectors(np.array(made, float))).max(axis=1)
            floor[b] = REJECT * np.quantile(best, QUANTILE)
        return floor

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    @staticmethod
    def _cluster(x: np.ndarray) -> np.ndarray:
        """Spherical k-means; seeds are the farthest points from one another."""
        seeds = [_unit(x.sum(axis=0, keepdims=True))[0]]
        near = x @ seeds[0]
        chosen = []
        for _ in range(min(CENTROIDS, len(x))):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        c = x[chosen]
        for _ in range(ROUNDS):
            own = (x @ c.T).argmax(axis=1)
            c = np.stack([x[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
            c = _unit(c)
        return c

    def cosines(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float32) @ self.centroids

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        counts = features(texts)
        cos = self.cosines(self.vectors(counts))
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(texts)), best].astype(float), 0, 1)
        lettered = has_letter(texts)
        rejected = ~lettered | (score < self.floor[self.lang[best], _bucket(counts)])
        lang = [self.names[self.lang[b]] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return lang, np.where(lettered, score, 0.0), rejected


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame) -> Model | None:
    """Learn from (doc_id, text, lang); null where there is nothing to learn."""
    rows = small_arrow(labelled).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    each = min(PER_LANG, max(1, TOTAL // len(sizes)))
    # a row is taken when its hash falls in the share its language needs; repeated ids count once
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, each / n))) for k, n in sorted(sizes.items())))
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.where(key < share).select("doc_id", "lang", "text").dropDuplicates(["doc_id"])

    def count(batches):
        for batch in small_batches(batches, 1, *SLICE):
            texts = batch.column(1).to_pylist()
            x, ok = features(texts), has_letter(texts)
            sparse = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i.tolist() for i in sparse], pa.list_(pa.int32())),
                 pa.array([r[i].tolist() for r, i in zip(x, sparse)], pa.list_(pa.float32())), pa.array(ok)],
                names=["lang", "slot", "n", "ok"])

    got = sample.select("lang", "text").mapInArrow(count, "lang string, slot array<int>, n array<float>, ok boolean") \
                .where("ok").drop("ok").toPandas()
    if got.empty:
        return None
    counts = np.zeros((len(got), DIM))
    for i, (slot, n) in enumerate(zip(got.slot, got.n)):
        counts[i, np.asarray(slot, int)] = n
    order = np.lexsort([counts.sum(axis=1), got.lang.to_numpy(str)])
    return Model(got.lang.to_numpy(str)[order].tolist(), counts[order])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every column of ``docs`` plus lang_pred, lang_score and lang_rejected
    (columns of these names are replaced)."""
    cols = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    rows = small_arrow(docs).select(*cols)
    schema = rows.schema
    text_at = cols.index("text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]

    def run(batches):
        for batch in small_batches(batches, text_at, *SLICE):
            texts = batch.column(text_at).to_pylist()
            if model is None:
                lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            else:
                lang, score, rejected = model.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                names=[*cols, "lang_pred", "lang_score", "lang_rejected"])

    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "lang_score double", "lang_rejected boolean"]))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model learned from it does not reject, as
    they are (any columns, whatever their names)."""
    model, text_at = fit(docs.where(~held_out(F.col("doc_id")))), docs.columns.index("text")

    def run(batches):
        for batch in small_batches(batches, text_at, *SLICE):
            texts = batch.column(text_at).to_pylist()
            rejected = model.predict(texts)[2] if model else np.ones(len(texts), bool)
            yield batch.filter(pa.array(~rejected))

    return small_arrow(docs).mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, predict all."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model)
