"""Why was an item recommended?

M13 item_reasons: the listened item most similar to each recommended one.
M14 user_reasons: the most similar user and the items both share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.explore import common_items
from cadenza.operators.recommend import similar_users
from cadenza.operators.vectors import unit_vectors
from cadenza.functions.columns import dot
from cadenza.session import ensure_checkpoint_dir


def item_reasons(recs: DataFrame, seen: DataFrame, item_vecs: DataFrame, user_col: str = "user_id",
                 item_col: str = "item_id", vec_col: str = "embedding") -> DataFrame:
    """For each recommended item, the user's listened item with the
    largest cosine, kept only when the cosine is > 0 (ties: smaller id);
    otherwise ``reason = 'popularity'``.

    The join is recs (n per user) × the user's *distinct* listened items,
    so it grows with n times the history, never history squared.  Both sides
    get their vectors before it: a vector is shuffled once per list row and
    once per listened item, never per pair, and pairs are not shuffled.
    Result: ``user, rank, item, reason_item, similarity, reason``.
    """
    uv = unit_vectors(item_vecs.select(item_col, vec_col), vec_col)
    listened = (seen.select(user_col, F.col(item_col).alias("reason_item")).distinct()
                    .join(uv.select(F.col(item_col).alias("reason_item"), F.col(vec_col).alias("_b")), "reason_item")
                    .select(user_col, "reason_item", "_b"))
    # the lists are read once (left joins keep rows without any reason), so
    # an upstream top-k is never evaluated twice
    pairs = (recs.select(user_col, "rank", item_col)
                 .join(uv.select(F.col(item_col), F.col(vec_col).alias("_a")), item_col, "left")
                 .join(listened, user_col, "left")
                 .select(user_col, "rank", item_col, "reason_item",
                         F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), dot("_a", "_b"))
                          .alias("similarity")))
    # best positive reason per list row as an aggregate: map-side combine, so
    # a long history never lands whole in one task (ties: smaller reason id)
    cand = F.when(F.col("similarity") > 0,
                  F.struct((-F.col("similarity")).alias("neg"), F.col("reason_item")))
    best = pairs.groupBy(user_col, "rank", item_col).agg(F.min(cand).alias("_b"))
    return best.select(user_col, "rank", item_col, F.col("_b.reason_item").alias("reason_item"),
                       (-F.col("_b.neg")).alias("similarity"),
                       F.when(F.col("_b").isNull(), "popularity").otherwise("similar_item").alias("reason"))


def user_reasons(interactions: DataFrame, user_vecs: DataFrame, users: DataFrame | None = None,
                 top_n: int = 3, user_col: str = "user_id", item_col: str = "item_id",
                 plays_col: str = "play_count", vec_col: str = "embedding") -> DataFrame:
    """Each user's single most similar user and their ``top_n`` shared
    items (J6).  A pair without shared items keeps one row with null item.
    Result: ``user, similar_user, similarity, rank, item, plays_user,
    plays_similar``."""
    # one row per user, read several times below: write it once so the
    # blocked top-k behind it runs once
    ensure_checkpoint_dir(user_vecs.sparkSession)
    nb = similar_users(user_vecs, 1, users, user_col, vec_col).where(F.col("rank") == 1).checkpoint(eager=True)
    pairs = nb.select(F.col(user_col).alias("user_id1"), F.col("similar_user").alias("user_id2"),
                      "similarity")
    shared = common_items(interactions.withColumnRenamed(user_col, "user_id")
                          if user_col != "user_id" else interactions,
                          pairs.select("user_id1", "user_id2"), top_n, "user_id", item_col, plays_col)
    out = pairs.join(shared, ["user_id1", "user_id2"], "left")
    return out.select(F.col("user_id1").alias(user_col), F.col("user_id2").alias("similar_user"),
                      "similarity", "rank", item_col, F.col("plays1").alias("plays_user"),
                      F.col("plays2").alias("plays_similar"))
