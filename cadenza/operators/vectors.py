"""Vector operators: pair scores, cosine, blocked top-k, 2-D projection.

M3 score_pairs, M5 cosine_pairs, blocked top-k (serves M4, M6, M7, M11),
M16 project_2d.

Blocked top-k
-------------
Spark has no vector-similarity join, and a row-level cross join of users
by items is quadratic in rows.  ``topk`` instead hashes each side into
blocks of about ``block_size`` rows and gives every (left block, right
block) pair to one ``applyInArrow`` group, which keeps per left row the k
best that are not excluded (``operators.ranking``: a single-precision product
sorts out, double precision decides).  A final ``row_number`` over
``(left id; score desc, right id asc)`` keeps k; Spark plans it as a
partial + final ``WindowGroupLimit``, so at most k rows per left id and
map task cross the last shuffle.

Exclusions (e.g. items a user has seen) travel as their own rows, one per left
id and block pair with the right ids they exclude there, so each pair is shipped
once in total instead of once per right block.  Groups are read as Arrow columns,
a row's vector never becomes a Python object.  No n x n matrix, nothing through
the driver; memory per task is bounded by two blocks of vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import cosine, dot, normalize
from cadenza.operators.ranking import Ranker

_PAIR_SCHEMA = "left_id long, right_id long, score double"


def whole_groups(batches, key: str):
    """Regroup a partition's Arrow batches (rows sorted by ``key``) into
    frames that never split a key: the rows of the last key of a batch are
    held back and put in front of the next batch.  Memory stays at about
    one batch plus one group."""
    carry = None
    for pdf in batches:
        if carry is not None:
            pdf = pd.concat([carry, pdf], ignore_index=True)
            carry = None
        if pdf.empty:
            continue
        last = pdf[key].iat[-1]
        cut = int(np.argmax((pdf[key] == last).to_numpy()))
        carry = pdf.iloc[cut:].reset_index(drop=True)
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
    if carry is not None and not carry.empty:
        yield carry


def padded(keys: np.ndarray, vecs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key -> (group starts, group sizes, vectors padded to a
    (groups x largest group x dim) grid, zeros where a group is shorter)."""
    m = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.r_[starts, m])
    g = np.repeat(np.arange(len(starts)), counts)
    pos = np.arange(m) - np.repeat(starts, counts)
    v = np.vstack(vecs).astype(np.float64, copy=False)
    grid = np.zeros((len(starts), int(counts.max()), v.shape[1]))
    grid[g, pos] = v
    return starts, counts, grid


def score_pairs(pairs: DataFrame, left_vec: str, right_vec: str, out: str = "score") -> DataFrame:
    """M3: dot product of two vector columns on given pairs (JVM-side)."""
    return pairs.withColumn(out, dot(left_vec, right_vec))


def cosine_pairs(pairs: DataFrame, left_vec: str, right_vec: str, out: str = "similarity") -> DataFrame:
    """M5: cosine of two vector columns on given pairs; zero vector gives 0."""
    return pairs.withColumn(out, cosine(left_vec, right_vec))


def unit_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Replace ``vec`` by its unit-length copy (zero stays zero)."""
    return df.withColumn(vec, normalize(vec))


# bounds of the adaptive block size (rows per side of a block pair), and the bytes
# of vectors up to which a side's block may have more rows than that
_MIN_BLOCK, _MAX_BLOCK = 512, 16384
_BLOCK_BYTES = 64 << 20
# score-matrix cells computed at once inside a group (4 bytes each: 8 MB, and
# about twice that with what is partitioned and the masks)
_CHUNK_CELLS = 2_000_000
# right rows of a group that its left rows meet at a time
_BLOCK_ROWS = 2048


def _block_size(n_left: int, n_right: int, parallelism: int, most: int = _MAX_BLOCK) -> int:
    """Rows per block so that there are about four block pairs per task
    slot: big enough to keep the replication of each side (one copy per
    block of the other side) low, small enough to keep every slot busy."""
    target_pairs = 4 * max(parallelism, 1)
    size = math.sqrt(max(n_left, 1) * max(n_right, 1) / target_pairs)
    return int(min(max(size, _MIN_BLOCK), most))


def _vectors(rows: pa.Table) -> np.ndarray:
    column = rows.column("vec").combine_chunks()
    if column.null_count or len(pc.unique(column.value_lengths())) > 1:
        raise ValueError("vectors must be given and of one size")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _block_topk(k: int, exclude_self: bool, chunk_cells: int = _CHUNK_CELLS):
    schema = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        left = rows.filter(pc.equal(rows["side"], "L"))
        right = rows.filter(pc.equal(rows["side"], "R"))
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        lid = np.asarray(left["id"], np.int64)
        a = _vectors(left)
        rid, b = np.asarray(right["id"], np.int64), _vectors(right)
        lengths = np.sqrt(np.einsum("ij,ij->i", b, b))
        order = np.lexsort((rid, -lengths))
        rid, b, lengths = rid[order], b[order], lengths[order]
        # excluded pairs as (left row, right position), sorted by left row
        place = np.argsort(rid, kind="stable")
        sorted_id = rid[place]
        li = np.empty(0, dtype=np.int64)
        ri = np.empty(0, dtype=np.int64)
        ex = rows.filter(pc.equal(rows["side"], "X"))
        if ex.num_rows:
            others = ex["others"].combine_chunks()
            who = pd.Index(lid).get_indexer(np.asarray(ex["id"], np.int64))
            li = np.repeat(who, np.asarray(others.value_lengths(), np.int64))
            ro = np.asarray(others.flatten(), np.int64)
            at = np.minimum(np.searchsorted(sorted_id, ro), len(rid) - 1)
            ok = (li >= 0) & (sorted_id[at] == ro)
            li, ri = li[ok], place[at[ok]]
        if exclude_self:
            first, last = np.searchsorted(sorted_id, lid, "left"), np.searchsorted(sorted_id, lid, "right")
            n = last - first
            own = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            li, ri = np.concatenate([li, np.repeat(np.arange(len(lid)), n)]), np.concatenate([ri, place[own]])
        srt = np.argsort(li, kind="stable")
        li, ri = li[srt], ri[srt]
        least = np.asarray(left["least"], np.float64)
        block = min(_BLOCK_ROWS, len(rid))
        ranker = Ranker(rid, b, lengths, -1.0, block, k)
        step = max(1, chunk_cells // block)
        outs = []
        # score the block in chunks of left rows: memory stays at chunk_cells
        for c0 in range(0, len(lid), step):
            c1 = min(c0 + step, len(lid))
            lo, hi = np.searchsorted(li, [c0, c1])
            by = np.argsort(ri[lo:hi], kind="stable")
            ids, scores, _, _ = ranker.rank(a[c0:c1], li[lo:hi][by] - c0, ri[lo:hi][by], least[c0:c1])
            at, which = np.nonzero(np.isfinite(scores))
            outs.append(pa.table([lid[c0 + at], ids[at, which], scores[at, which]], schema=schema))
        return pa.concat_tables(outs)
    return run


def topk(left: DataFrame, right: DataFrame, k: int, *, left_id: str = "id", right_id: str = "id",
         left_vec: str = "embedding", right_vec: str = "embedding", exclude: DataFrame | None = None,
         exclude_left: str = "left_id", exclude_right: str = "right_id", exclude_self: bool = False,
         block_size: int | None = None, rank_col: str = "rank",
         chunk_cells: int = _CHUNK_CELLS, least: str | None = None) -> DataFrame:
    """Top ``k`` right rows per left row by dot product.

    ``exclude`` holds (left id, right id) pairs that must not be returned
    (e.g. already-seen items); ``exclude_self`` drops equal ids (similar
    users/items).  Ids are integral.  Result: ``left_id, right_id, score,
    rank`` with rank 1..<=k and ties broken by right id ascending.
    Cosine = dot on ``unit_vectors`` inputs.

    ``block_size`` (rows per block) defaults to an adaptive size: about four
    block pairs per task slot, between 512 rows and 16384 or as many as hold
    64 MB of vectors.  Each side is shipped once per block of the other side,
    so larger blocks mean less shuffle; inside a group the scores are computed
    in chunks of left rows, so memory stays bounded whatever the block size.
    ``least`` names a column of ``left``: a score below which a row wants nothing.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = left.sparkSession
    n_left = left.count()
    n_right = n_left if right is left else right.count()   # self-similarity: one count
    bs = block_size
    if bs is None:
        bs = _block_size(n_left, n_right, spark.sparkContext.defaultParallelism)
        if bs >= _MAX_BLOCK:
            size = right.select(F.size(right_vec).alias("n")).where("n > 0").first()
            most = max(_MAX_BLOCK, _BLOCK_BYTES // (8 * size.n)) if size else _MAX_BLOCK
            bs = _block_size(n_left, n_right, spark.sparkContext.defaultParallelism, most)
    nl, nr = max(1, math.ceil(n_left / bs)), max(1, math.ceil(n_right / bs))

    def blk(c, n):
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(n)).cast("int")

    lrows = left.select(blk(F.col(left_id), nl).alias("lb"), F.col(left_id).cast("long").alias("id"),
                        F.col(left_vec).cast("array<double>").alias("vec"),
                        (F.lit(float("-inf")) if least is None else F.col(least).cast("double")).alias("least"))
    rrows = right.select(blk(F.col(right_id), nr).alias("rb"), F.col(right_id).cast("long").alias("id"),
                         F.col(right_vec).cast("array<double>").alias("vec"))
    rbs = spark.range(nr).select(F.col("id").cast("int").alias("rb"))
    lbs = spark.range(nl).select(F.col("id").cast("int").alias("lb"))
    none = F.lit(None).cast("array<long>").alias("others")
    bar = F.lit(None).cast("double").alias("least")
    parts = [
        lrows.crossJoin(F.broadcast(rbs)).select("lb", "rb", F.lit("L").alias("side"), "id", none, "vec", "least"),
        rrows.crossJoin(F.broadcast(lbs)).select("lb", "rb", F.lit("R").alias("side"), "id", none, "vec", bar),
    ]
    if exclude is not None:
        ex = exclude.select(F.col(exclude_left).cast("long").alias("id"),
                            F.col(exclude_right).cast("long").alias("other")).where("other IS NOT NULL")
        # at most as many as the right block has rows, where they are among them
        held = ex.groupBy(blk(F.col("id"), nl).alias("lb"), blk(F.col("other"), nr).alias("rb"), "id").agg(
            F.collect_set("other").alias("others"))
        parts.append(held.select("lb", "rb", F.lit("X").alias("side"), "id", "others",
                                 F.lit(None).cast("array<double>").alias("vec"), bar))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    cand = rows.groupBy("lb", "rb").applyInArrow(_block_topk(k, exclude_self, chunk_cells), _PAIR_SCHEMA)
    w = Window.partitionBy("left_id").orderBy(F.col("score").desc(), F.col("right_id").asc())
    return (cand.withColumn(rank_col, F.row_number().over(w))
                .where(F.col(rank_col) <= k))


def similar(vecs: DataFrame, k: int, *, id_col: str = "id", vec: str = "embedding",
            ids: DataFrame | None = None, block_size: int | None = None) -> DataFrame:
    """Top-k cosine neighbours of each id (self excluded); M6 / M11.

    ``ids`` optionally restricts the left side (the wanted ids).
    Result: ``left_id, right_id, similarity, rank``.
    """
    unit = unit_vectors(vecs.select(id_col, vec), vec)
    left = unit if ids is None else unit.join(ids.select(id_col).distinct(), id_col, "left_semi")
    out = topk(left, unit, k, left_id=id_col, right_id=id_col, left_vec=vec, right_vec=vec,
               exclude_self=True, block_size=block_size)
    return out.withColumnRenamed("score", "similarity")


def project_2d(vecs: DataFrame, id_col: str = "id", vec: str = "features") -> DataFrame:
    """Distributed 2-D linear layout of factors (PCA, k=2).

    Replaces the single-machine t-SNE/UMAP layouts; the sign of each axis
    is free.  Result: ``id, x, y``.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vecs.select(F.col(id_col), array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(data)
    arr = vector_to_array(F.col("p"))
    return model.transform(data).select(id_col, arr[0].alias("x"), arr[1].alias("y"))
