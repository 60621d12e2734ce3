"""Approximate nearest neighbours by sign random projections (M11's option for
very many users).

The sign of a vector's product with a random direction agrees for two vectors
with probability p = 1 - angle / pi.  ``bits`` signs make a band's code, and
rows are compared only inside a bucket (equal code in one of ``bands`` bands):
a pair meets with probability 1 - (1 - p^bits)^bands.  Every row is copied once
per band, whatever the number of rows; nothing is copied per block of the other
side.  Candidates are scored exactly, so what is found is exact and only what
is missed is not.

``tune`` chooses bits and bands for the data at hand: the true neighbours of a
bounded sample of rows (compared with all rows, in one pass) give the share of
neighbours that any setting would find, the sample's other pairs what it would
compare, and the cheapest setting that reaches the wanted recall is taken.

Equal vectors are folded first, so a vector that a third of all rows share is
one row with its k + 1 smallest ids.  A bucket above ``max_bucket`` rows is split
by further signs of its band, as many as bring it below; rows that no sign
parts (vectors all but equal) are dealt to parts of that size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import dot, normalize
from cadenza.operators.vectors import whole_groups
from cadenza.session import ensure_checkpoint_dir

CODE_BITS = 62  # signs taken per band; the first ``bits`` of them make its buckets
SAMPLE = 256  # rows whose true neighbours are found to choose a setting
MAX_BUCKET = 4096
_CELLS = 1_000_000  # similarities or signs held at once in a task
FEW = 200_000  # rows of numbers that may be broadcast
# candidates kept beyond k: rough similarities may put neighbours in another order
SPARE = 2
COPY_COST = 500.0  # the price of copying a row to a band, in scored pairs


@dataclass(frozen=True)
class Bands:
    bits: int
    bands: int
    recall: float = math.nan  # expected
    compared: float = math.nan  # expected share of all pairs


def _directions(size: int, bands: int, seed: int) -> np.ndarray:
    """A (bands x signs) by size matrix; the first bands of a seed stay the same."""
    return np.vstack([np.random.default_rng([seed, b]).standard_normal((CODE_BITS, size)) for b in range(bands)])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def tune(unit: DataFrame, k: int, target: float = 0.95, max_bands: int = 128, sample: int = SAMPLE,
         copy_cost: float = COPY_COST) -> Bands:
    """The setting for unit vectors ``(id, vec)``.  ``sample`` rows (those whose
    ids hash lowest) are broadcast and meet every row once."""
    spark = unit.sparkSession
    chosen = unit.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if chosen.num_rows < 2:
        return Bands(1, 1, 1.0, 1.0)
    q_ids = np.asarray(chosen.column("id"), np.int64)
    q = _matrix(chosen.column("vec").combine_chunks(), len(q_ids))
    shared = spark.sparkContext.broadcast((q_ids, q))
    powers = np.arange(1, 25)

    def meet(batches):
        ids, vecs = shared.value
        step = max(1, _CELLS // len(q_ids))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            n = batch.num_rows
            rid = np.asarray(batch.column(0), np.int64)
            s = np.clip(_matrix(batch.column(1), n) @ vecs.T, -1, 1)
            other = rid[:, None] != ids[None, :]
            p = 1 - np.arccos(s) / np.pi
            met = [float((p ** b)[other].sum()) for b in powers]
            s[~other] = -np.inf
            best = -np.sort(-s, axis=0)[:k]
            at, which = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[which]), pa.array(best[at, which]), pa.nulls(len(at), pa.list_(pa.float64())),
                 pa.array(np.zeros(len(at), np.int64))], names=["q", "s", "met", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([met], pa.list_(pa.float64())),
                 pa.array([int(other.sum())])], names=["q", "s", "met", "n"])

    seen = unit.select("id", "vec").mapInArrow(meet, "q long, s double, met array<double>, n long").checkpoint(eager=True)
    w = Window.partitionBy("q").orderBy(F.col("s").desc())
    # sample x k numbers, and one sum per power
    near = seen.where("q IS NOT NULL").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("s").toArrow()
    met = seen.where("q IS NULL").select(F.posexplode("met").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    pairs = seen.agg(F.sum("n")).first()[0]
    p = 1 - np.arccos(np.clip(np.asarray(near.column("s"), np.float64), -1, 1)) / np.pi
    share = {r["at"] + 1: r["x"] / pairs for r in met}
    rows = pairs / len(q_ids) + 1
    best = None
    for b in powers.tolist():
        for t in range(1, max_bands + 1):
            recall = float(np.mean(1 - (1 - p ** b) ** t))
            if recall >= target:
                cost = t * (rows * share[b] + copy_cost)
                if best is None or cost < best[0]:
                    best = cost, Bands(b, t, recall, min(1.0, t * share[b]))
                break
    return best[1] if best else Bands(1, max_bands)


def _codes(unit: DataFrame, setting: Bands, seed: int) -> DataFrame:
    """(id, rough, codes) of every row: the vector in single precision and its code
    in each band, in order; a code's first sign is its highest bit."""
    size, weights = None, 1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64)
    bands = setting.bands

    def run(batches):
        nonlocal size
        for batch in batches:
            step = max(1, _CELLS // (bands * CODE_BITS))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = _matrix(part.column(1), part.num_rows)
                if size is None:
                    size = _directions(x.shape[1], bands, seed)
                signs = (x @ size.T >= 0).reshape(-1, bands, CODE_BITS)
                code = pa.array((signs @ weights).ravel(), pa.int64())
                at, wide = (np.arange(part.num_rows + 1, dtype=np.int32) * n for n in (bands, x.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(wide, pa.array(x.astype(np.float32).ravel())),
                     pa.ListArray.from_arrays(at, code)], names=["id", "rough", "codes"])

    return unit.select("id", "vec").mapInArrow(run, "id long, rough array<float>, codes array<long>")


def _by_band(codes: DataFrame, *cols: str) -> DataFrame:
    return codes.select(*cols, F.posexplode("codes").alias("band", "code"))


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def _depths(codes: DataFrame, setting: Bands, max_bucket: int) -> DataFrame | None:
    """(band, depth, key, deeper) of the buckets that are split, level by level;
    None if there is none.  A bucket of a level is named by its first ``depth`` signs."""
    found, depth = None, setting.bits
    level = _by_band(codes)
    while depth < CODE_BITS:
        key = F.shiftrightunsigned("code", CODE_BITS - depth)
        large = level.groupBy("band", key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_bucket)
        large = large.checkpoint(eager=True)
        most = large.agg(F.max("n")).first()[0]
        if most is None:
            break
        found = large.select("band", F.lit(depth).alias("depth"), "key") if found is None else found.unionByName(
            large.select("band", F.lit(depth).alias("depth"), "key"))
        level = level.withColumn("key", key).join(large.select("band", "key"), ["band", "key"], "left_semi").drop("key")
        depth = min(CODE_BITS, depth + max(1, math.ceil(math.log2(most / max_bucket))))
    return found


def _bucket(ids: np.ndarray, x: np.ndarray, k: int):
    """Each row's best k others of a bucket: (left ids, right ids, similarities)."""
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    n, kk = len(ids), min(k, len(ids) - 1)
    step = max(1, _CELLS // n)
    for c0 in range(0, n, step):
        c1 = min(c0 + step, n)
        s = x[c0:c1] @ x.T
        s[np.arange(c1 - c0), np.arange(c0, c1)] = -np.inf
        kth = np.partition(s, n - kk, axis=1)[:, n - kk][:, None]
        above, tie = s > kth, s == kth
        # ties at the k-th score go to the smallest ids
        room = kk - above.sum(axis=1, dtype=np.int32)[:, None]
        r, c = np.nonzero(above | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= room)))
        yield ids[c0 + r], ids[c], s[r, c]


def _bucket_tops(k: int):
    """Over a partition's rows sorted by bucket: all buckets of a batch at a time."""
    def run(batches):
        for pdf in whole_groups(batches, "bucket"):
            ids, x = pdf["id"].to_numpy(np.int64), np.vstack(pdf["rough"].to_numpy())
            bucket = pdf["bucket"].to_numpy()
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            stops = np.r_[starts[1:], len(bucket)]
            out = [part for lo, hi in zip(starts.tolist(), stops.tolist()) if hi - lo > 1
                   for part in _bucket(ids[lo:hi], x[lo:hi], k)]
            if out:
                yield pd.DataFrame(dict(zip(("left_id", "right_id", "similarity"), map(np.concatenate, zip(*out)))))
    return run


def similar_lsh(vecs: DataFrame, k: int, *, id_col: str = "id", vec: str = "embedding", setting: Bands | None = None,
                target: float = 0.95, max_bucket: int = MAX_BUCKET, seed: int = 42,
                copy_cost: float = COPY_COST) -> DataFrame:
    """Up to ``k`` neighbours of each row by cosine, self excluded, best first, ties
    by id: ``left_id, right_id, similarity, rank``.  The similarities are exact;
    of the true neighbours about ``target`` are found.  Rows with a zero vector
    have similarity 0 to all others and no neighbours here."""
    if k <= 0:
        raise ValueError("k must be positive")
    if not 0 < target < 1:
        raise ValueError("target must be between 0 and 1")
    spark = vecs.sparkSession
    ensure_checkpoint_dir(spark)
    unit = vecs.select(F.col(id_col).cast("long").alias("id"), normalize(F.col(vec).cast("array<double>")).alias("vec")) \
        .where(F.exists("vec", lambda x: x != 0))
    # equal vectors are one row: smallest id, and the k + 1 smallest ids
    w = Window.partitionBy("vec").orderBy("id")
    ranked = unit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    classes = ranked.groupBy("vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = classes.checkpoint(eager=True)
    setting = setting or tune(classes, k, target, copy_cost=copy_cost)
    codes = _codes(classes, setting, seed).checkpoint(eager=True)

    split = _depths(codes, setting, max_bucket)
    depth = F.lit(setting.bits)
    placed = _by_band(codes, "id", "rough").withColumn("_depth", depth)
    if split is not None:
        levels = [r[0] for r in split.select("depth").distinct().orderBy("depth").collect()]
        for at, following in zip(levels, [*levels[1:], CODE_BITS]):
            here = split.where(F.col("depth") == at).select("band", "key", F.lit(following).alias("_next"))
            key = F.shiftrightunsigned("code", CODE_BITS - at)
            placed = placed.withColumn("key", key).join(_small(here), ["band", "key"], "left").withColumn(
                "_depth", F.coalesce("_next", "_depth")).drop("key", "_next")
    shift = F.lit(CODE_BITS) - F.col("_depth")
    named = placed.select("id", "rough", "band", "_depth", F.call_function("shiftrightunsigned", "code", shift).alias("key"))
    sizes = named.groupBy("band", "_depth", "key").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > max_bucket).checkpoint(eager=True) if split is not None else None
    if sizes is not None:
        named = named.join(_small(sizes), ["band", "_depth", "key"], "left").withColumn("part", F.when(
            F.col("_n").isNotNull(), F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / max_bucket))).otherwise(0)).drop("_n")
    else:
        named = named.withColumn("part", F.lit(0).cast("long"))
    # two buckets of one name would only be compared together
    bucket = F.xxhash64("band", "_depth", "key", "part")
    # single precision goes to the buckets: a copy of a vector in every band is most of what is shuffled
    pairs = (named.select(bucket.alias("bucket"), "id", "rough").repartition("bucket").sortWithinPartitions("bucket")
             .mapInPandas(_bucket_tops(k), "left_id long, right_id long, similarity float"))
    # one shuffle: the pairs that several bands found are folded where the lists are cut
    once = pairs.repartition("left_id").groupBy("left_id", "right_id").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("left_id").orderBy(F.col("similarity").desc(), "right_id")
    rough = once.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + SPARE).select("left_id", "right_id")
    # what is left gets its exact similarity
    a, b = (classes.select(F.col("id").alias(f"{side}_id"), F.col("vec").alias(side)) for side in ("left", "right"))
    exact = rough.join(b, "right_id").join(a, "left_id").select(
        "left_id", "right_id", dot("left", "right").alias("similarity")).groupBy("left_id", "right_id").agg(F.max("similarity").alias("similarity"))
    near = exact.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r").checkpoint(eager=True)

    # back from classes to rows: the k + 1 smallest ids of a class stand for it
    members = classes.select(F.col("id").alias("right_id"), "ids")
    others = near.join(members, "right_id").select("left_id", "similarity", F.explode("ids").alias("right_id"))
    single = others.join(classes.where(F.size("ids") == 1).select(F.col("id").alias("left_id")), "left_id", "left_semi")
    w2 = Window.partitionBy("left_id").orderBy(F.col("similarity").desc(), "right_id")
    lists = single.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
    repeated = classes.where(F.size("ids") > 1)
    # rows of a shared vector: first its other holders, then the class's neighbours
    shared = others.join(repeated.select(F.col("id").alias("left_id")), "left_id", "left_semi").unionByName(
        repeated.select(F.col("id").alias("left_id"), F.lit(1.0).alias("similarity"), F.explode("ids").alias("right_id")))
    top = Window.partitionBy("left_id").orderBy(F.col("similarity").desc(), "right_id")
    upto = shared.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1).groupBy("left_id").agg(
        F.sort_array(F.collect_list(F.struct("_r", "similarity", "right_id"))).alias("best"))
    holders = unit.join(repeated.select("vec", F.col("id").alias("left_id")), "vec").select("left_id", F.col("id").alias("_holder"))
    spread = holders.join(upto, "left_id").select(F.col("_holder").alias("left_id"), F.posexplode(
        F.slice(F.filter("best", lambda x: x["right_id"] != F.col("_holder")), 1, k)).alias("_at", "_x"))
    own = spread.select("left_id", F.col("_x.right_id").alias("right_id"), F.col("_x.similarity").alias("similarity"),
                        (F.col("_at") + 1).cast("int").alias("rank"))
    return lists.select("left_id", "right_id", "similarity", "rank").unionByName(own)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact links (``left_id, right_id``) that were
    found (``recall``), and how many there are (``links``)."""
    hit = exact.select("left_id", "right_id").join(
        found.select("left_id", "right_id").withColumn("_hit", F.lit(1)), ["left_id", "right_id"], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")), F.lit(1.0)).alias("recall"),
                   F.count(F.lit(1)).alias("links"))
