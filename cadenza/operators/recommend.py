"""Recommendation for all wanted users at once.

J5 exclude_seen, M4 top_n_unseen, M7 candidate_pool, M8 mmr_rerank, M9 mmr_recommend,
M10 compare_methods, M11 similar_users (see vectors.similar),
M12 user_based_recommend, M15 recommend_status.

Vectors come in as ``(id, embedding array)`` frames with integral ids
(ALS indices or fixture ids).  Lists come out in long form
``(user, rank, item, score)``, rank 1..n, ties by item id ascending.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.ordering import spread_join
from cadenza.operators.prepare import interaction_triples
from cadenza.session import ensure_checkpoint_dir
from cadenza.operators.pruned import topk_pruned
from cadenza.operators.vectors import padded, similar, topk, whole_groups


def _check(n: int, name: str = "n") -> None:
    if n <= 0:
        raise ValueError(f"{name} must be positive")


def exclude_seen(candidates: DataFrame, seen: DataFrame, user_col: str = "user_id",
                 item_col: str = "item_id") -> DataFrame:
    """Candidate (user, item) rows whose pair is not among the user's
    seen pairs (an anti join on both columns; no per-user sets)."""
    return candidates.join(seen.select(user_col, item_col).distinct(), [user_col, item_col], "left_anti")


def top_n_unseen(user_vecs: DataFrame, item_vecs: DataFrame, seen: DataFrame | None, n: int = 5,
                 users: DataFrame | None = None, user_col: str = "user_id", item_col: str = "item_id",
                 vec_col: str = "embedding", block_size: int | None = None, pruned: bool = False) -> DataFrame:
    """M4: the ``n`` highest dot-product items per user among items the user
    has not seen; fewer when the catalogue runs out.

    ``seen`` is ``(user, item)``; ``users`` optionally restricts who gets a
    list.  ``pruned`` takes the plan that stops at each user's bound
    (``operators.pruned``): the same lists, no copy of a user, little work where
    item vectors differ in length.  Result: ``user, rank, item, score``.
    """
    _check(n)
    left = user_vecs.select(user_col, vec_col)
    if users is not None:
        left = left.join(users.select(user_col).distinct(), user_col, "left_semi")
    ex = None
    if seen is not None:
        if users is not None:
            # only the wanted users' seen pairs travel to the block groups
            seen = seen.join(left.select(user_col), user_col, "left_semi")
        ex = seen.select(F.col(user_col).alias("left_id"), F.col(item_col).alias("right_id"))
    names = dict(left_id=user_col, right_id=item_col, left_vec=vec_col, right_vec=vec_col, exclude=ex)
    items = item_vecs.select(item_col, vec_col)
    out = topk_pruned(left, items, n, **names).lists if pruned else topk(left, items, n, block_size=block_size, **names)
    return out.select(F.col("left_id").alias(user_col), F.col("rank").cast("int").alias("rank"),
                      F.col("right_id").alias(item_col), "score")


def candidate_pool(user_vecs, item_vecs, seen, pool_size: int = 20, **kw) -> DataFrame:
    """M7: the ``pool_size`` best unseen items per user (M4 with n = pool)."""
    _check(pool_size, "candidate_pool_size")
    return top_n_unseen(user_vecs, item_vecs, seen, pool_size, **kw)


def _greedy_batch(user, item, rel, vecs, lam: float, n: int):
    """Greedy MMR for many users at once.  Rows are sorted by (user, rank);
    returns (row index, output rank) of the chosen rows.

    Pools are padded to a (users x pool) grid; each of the ``n`` steps is
    one vectorised argmax over all users.  ``argmax`` keeps the first
    maximum, i.e. the more relevant candidate on ties.  A pool of at most
    ``n`` items is returned in relevance order without reranking.
    """
    m = len(user)
    starts, counts, grid_v = padded(user, vecs)
    norms = np.linalg.norm(grid_v, axis=2, keepdims=True)
    grid_v = np.divide(grid_v, norms, out=np.zeros_like(grid_v), where=norms > 0)
    b, p = grid_v.shape[:2]
    g = np.repeat(np.arange(b), counts)
    pos = np.arange(m) - np.repeat(starts, counts)
    grid_r = np.zeros((b, p))
    grid_r[g, pos] = rel
    sim = np.matmul(grid_v, grid_v.transpose(0, 2, 1))
    free = np.zeros((b, p), dtype=bool)
    free[g, pos] = True
    maxsim = np.zeros((b, p))
    rows = np.arange(b)
    chosen = np.full((b, n), -1, dtype=np.int64)
    for step in range(min(n, p)):
        score = lam * grid_r - (1.0 - lam) * maxsim
        score[~free] = -np.inf
        best = np.argmax(score, axis=1)
        ok = free[rows, best]
        chosen[ok, step] = best[ok]
        free[rows[ok], best[ok]] = False
        maxsim[ok] = np.maximum(maxsim[ok], sim[rows[ok], :, best[ok]])
    small = counts <= n
    keep_pos = np.where(small[:, None], np.arange(n)[None, :], chosen)
    keep_pos[small[:, None] & (np.arange(n)[None, :] >= counts[:, None])] = -1
    users_i, ranks_i = np.nonzero(keep_pos >= 0)
    idx = starts[users_i] + keep_pos[users_i, ranks_i]
    return idx, ranks_i + 1


def _mmr_partitions(lam: float, n: int, user_col: str, item_col: str, vec: str):
    def run(batches):
        for pdf in whole_groups(batches, user_col):
            yield _mmr_frame(pdf, lam, n, user_col, item_col, vec)
    return run


def _mmr_frame(pdf, lam, n, user_col, item_col, vec):
    idx, ranks = _greedy_batch(pdf[user_col].to_numpy(), pdf[item_col].to_numpy(),
                               pdf["score"].to_numpy(dtype=np.float64), pdf[vec].to_numpy(), lam, n)
    return pd.DataFrame({user_col: pdf[user_col].to_numpy()[idx], "rank": ranks.astype(np.int32),
                         item_col: pdf[item_col].to_numpy()[idx],
                         "score": pdf["score"].to_numpy(dtype=np.float64)[idx]})


def mmr_rerank(pool: DataFrame, item_vecs: DataFrame | None = None, lambda_param: float = 0.5, n: int = 5,
               user_col: str = "user_id", item_col: str = "item_id", vec_col: str = "embedding",
               pool_vec_col: str | None = None, n_partitions: int | None = None) -> DataFrame:
    """M8: greedy MMR over each user's candidate pool.

    Step score ``λ·relevance − (1−λ)·max(0, max cosine to chosen items)``;
    ties go to the more relevant candidate; the output score is the raw
    relevance.  A pool of at most ``n`` items keeps its relevance order
    (M9).  Candidate vectors come from ``pool_vec_col`` when the pool
    carries them, else from ``item_vecs``; the item-item matrix is never
    built.

    Pools are hash-partitioned by user and sorted by (user, rank); one
    ``mapInPandas`` pass runs the greedy steps for all users of an Arrow
    batch at once, holding back only the last user of a batch.  Memory is
    bounded by the batch size, whatever the number of users.
    """
    if not 0.0 <= lambda_param <= 1.0:
        raise ValueError("lambda_param must be in [0, 1]")
    _check(n)
    if pool_vec_col is None:
        vecs = item_vecs.select(item_col, F.col(vec_col).cast("array<double>").alias("_vec"))
        rows = pool.select(user_col, "rank", item_col, "score").join(vecs, item_col)
    else:
        rows = pool.select(user_col, "rank", item_col, "score",
                           F.col(pool_vec_col).cast("array<double>").alias("_vec"))
    spark = pool.sparkSession
    parts = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    utype = pool.schema[user_col].dataType.simpleString()
    itype = pool.schema[item_col].dataType.simpleString()
    schema = f"{user_col} {utype}, rank int, {item_col} {itype}, score double"
    return (rows.repartition(parts, user_col).sortWithinPartitions(user_col, "rank")
                .mapInPandas(_mmr_partitions(float(lambda_param), n, user_col, item_col, "_vec"), schema))


def mmr_recommend(user_vecs, item_vecs, seen, n: int = 5, use_mmr: bool = True,
                  lambda_param: float = 0.5, candidate_pool_size: int = 20,
                  users: DataFrame | None = None, user_col: str = "user_id", item_col: str = "item_id",
                  vec_col: str = "embedding", block_size: int | None = None) -> DataFrame:
    """M9: pool (M7) then MMR (M8); a pool of at most ``n`` items is returned
    in relevance order without reranking; ``use_mmr=False`` is M4."""
    kw = dict(users=users, user_col=user_col, item_col=item_col, vec_col=vec_col,
              block_size=block_size)
    if not use_mmr:
        return top_n_unseen(user_vecs, item_vecs, seen, n, **kw)
    # vectors are joined to the <= pool survivors only, not carried through
    # every block product (k rows per right block would each carry one)
    pool = candidate_pool(user_vecs, item_vecs, seen, candidate_pool_size, **kw)
    return mmr_rerank(pool, item_vecs, lambda_param, n, user_col, item_col, vec_col)


def compare_methods(user_vecs, item_vecs, seen, n: int = 5, lambda_param: float = 0.5,
                    candidate_pool_size: int = 20, users: DataFrame | None = None,
                    user_col: str = "user_id", item_col: str = "item_id",
                    vec_col: str = "embedding") -> DataFrame:
    """Standard and MMR lists side by side (``method`` column), both
    from one scored pool.  The pool is at least ``n`` long, so its first
    ``n`` rows are exactly the standard list."""
    # both lists read the pool: write it once (users x pool rows) so the
    # blocked top-k behind it runs once
    ensure_checkpoint_dir(user_vecs.sparkSession)
    pool = candidate_pool(user_vecs, item_vecs, seen, max(candidate_pool_size, n), users=users,
                          user_col=user_col, item_col=item_col, vec_col=vec_col).checkpoint(eager=True)
    std = pool.where(F.col("rank") <= n).withColumn("method", F.lit("standard"))
    mmr = mmr_rerank(pool.where(F.col("rank") <= candidate_pool_size), item_vecs, lambda_param, n,
                     user_col, item_col, vec_col).withColumn("method", F.lit("mmr"))
    return std.unionByName(mmr)


def similar_users(user_vecs: DataFrame, k: int = 10, users: DataFrame | None = None,
                  user_col: str = "user_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` users with the highest cosine (may be negative), self
    excluded.  Result: ``user, similar_user, similarity, rank``."""
    _check(k, "n_similar_users")
    out = similar(user_vecs, k, id_col=user_col, vec=vec_col, ids=users)
    return out.select(F.col("left_id").alias(user_col), F.col("right_id").alias("similar_user"),
                      "similarity", F.col("rank").cast("int").alias("rank"))


def user_based_recommend(interactions: DataFrame, user_vecs: DataFrame, n: int = 5,
                         n_similar_users: int = 10, users: DataFrame | None = None,
                         user_col: str = "user_id", item_col: str = "item_id",
                         plays_col: str = "play_count", vec_col: str = "embedding",
                         aggregated: bool = False) -> DataFrame:
    """score = Σ over the user's nearest neighbours of
    ``similarity × plays`` for items the user has not seen (raw sum; a
    negative similarity subtracts); top ``n``.

    Histories are pre-aggregated to one cell per (user, item) before the
    neighbour join, so a long history joins once per neighbour pair; a user
    who is a neighbour of very many, or has very many cells, is dealt over
    tasks (``spread_join``).
    """
    _check(n)
    ensure_checkpoint_dir(user_vecs.sparkSession)
    nb = similar_users(user_vecs, n_similar_users, users, user_col, vec_col).checkpoint(eager=True)
    # ``aggregated``: the input already has one row per (user, item), e.g.
    # ALS ratings; skip the re-aggregation (and its shuffle)
    t = (interactions.select(user_col, item_col, F.col(plays_col).alias("strength")) if aggregated
         else interaction_triples(interactions, user_col, item_col, plays_col))
    cand = spread_join(nb.select(user_col, "similar_user", "similarity"),
                       t.select(F.col(user_col).alias("similar_user"), item_col, "strength"), "similar_user")
    # the user's own cells come along as marks: candidates are shuffled once, by user
    own = t.where(F.col(user_col).isNotNull() & F.col(item_col).isNotNull()).join(
        nb.select(user_col).distinct(), user_col, "left_semi")
    part = F.col("similarity") * F.col("strength")
    rows = cand.select(user_col, item_col, part.alias("part"), F.lit(False).alias("mark")).unionByName(
        own.select(user_col, item_col, F.lit(0.0).alias("part"), F.lit(True).alias("mark")))
    scores = rows.repartition(user_col).groupBy(user_col, item_col).agg(
        F.sum("part").alias("score"), F.max("mark").alias("mark")).where(~F.col("mark"))
    w = Window.partitionBy(user_col).orderBy(F.col("score").desc(), F.col(item_col).asc())
    return (scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                  .select(user_col, F.col("rank").cast("int").alias("rank"), item_col, "score"))


def recommend_status(wanted: DataFrame, known: DataFrame, recs: DataFrame,
                     neighbours: DataFrame | None = None, user_col: str = "user_id") -> DataFrame:
    """One status per wanted user instead of error strings:
    ``unknown_user`` (not in the model), ``no_neighbours`` (user-based, no
    similar user), ``no_candidates`` (empty list) or ``ok``; with the list
    length ``n_recs``."""
    w = wanted.select(user_col).distinct()
    k = known.select(user_col).distinct().withColumn("_known", F.lit(True))
    r = recs.groupBy(user_col).agg(F.count(F.lit(1)).alias("n_recs"))
    out = w.join(k, user_col, "left").join(r, user_col, "left")
    status = F.when(F.col("_known").isNull(), "unknown_user")
    if neighbours is not None:
        nbu = neighbours.select(user_col).distinct().withColumn("_nb", F.lit(True))
        out = out.join(nbu, user_col, "left")
        status = status.when(F.col("_nb").isNull(), "no_neighbours")
    status = status.when(F.col("n_recs").isNull(), "no_candidates").otherwise("ok")
    return out.select(user_col, status.alias("status"),
                      F.coalesce("n_recs", F.lit(0)).cast("long").alias("n_recs"))
