"""Ranking and beyond-accuracy metrics over long-form lists.

Inputs are long tables, never maps: ``recs(user, rank, item)`` with rank
1..n, ``relevant(user, item)``, ``catalog(item)``, ``genres(item, genre)``
(one row per item; a null genre counts as missing).

E1–E6 accuracy (per user, then means over users with relevant items),
E7/E8 intra-list diversity, E9 catalog coverage, E10 genre coverage,
E11 Shannon entropy, E12 Gini, E13 novelty, E14 unexpectedness,
E15 serendipity_metrics, E16 all_metrics, A13 user_profile, A14 rec_counts.

Pairwise definitions (E7, E8 cosine, E12) are computed in closed form
from per-group sums, so no query emits all pairs within a list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import cosine, dot, normalize, safe_div
from cadenza.operators.explore import item_popularity
from cadenza.operators.vectors import padded, whole_groups


def _log2(c):
    return F.log2(c)


def per_user_accuracy(recs: DataFrame, relevant: DataFrame, k: int, user_col: str = "user_id",
                      item_col: str = "artist") -> DataFrame:
    """E1–E4 per user with at least one relevant item.

    precision = hits in top k / k; recall = hits / #relevant; NDCG binary
    with ideal length min(k, #relevant); hit rate = any hit.  Users absent
    from ``recs`` score 0.
    """
    rel = relevant.select(user_col, item_col).distinct()
    n_rel = rel.groupBy(user_col).agg(F.count(F.lit(1)).alias("n_relevant"))
    top = recs.where(F.col("rank") <= k).select(user_col, item_col, "rank")
    hits = top.join(rel, [user_col, item_col], "left_semi")
    per = hits.groupBy(user_col).agg(F.count(F.lit(1)).alias("n_hits"),
                                     F.sum(1.0 / _log2(F.col("rank") + 1)).alias("dcg"))
    m = F.least(F.lit(k), F.col("n_relevant"))
    idcg = F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0),
                       lambda acc, i: acc + 1.0 / F.log2(i + 1))
    hits_c = F.coalesce(F.col("n_hits"), F.lit(0))
    out = n_rel.join(per, user_col, "left").select(
        user_col,
        (hits_c / F.lit(float(k)) if k > 0 else F.lit(0.0)).alias(f"precision_at_{k}"),
        safe_div(hits_c, F.col("n_relevant")).alias(f"recall_at_{k}"),
        (safe_div(F.coalesce(F.col("dcg"), F.lit(0.0)), idcg) if k > 0 else F.lit(0.0))
        .alias(f"ndcg_at_{k}"),
        F.when((hits_c > 0) & F.lit(k > 0), 1.0).otherwise(0.0).alias(f"hit_rate_at_{k}"))
    return out


def coverage(recs: DataFrame, catalog: DataFrame, k: int | None, item_col: str = "artist") -> DataFrame:
    """E5: distinct items in the top k of all lists / catalogue size (not
    intersected with the catalogue).  One row: ``coverage``."""
    r = recs if k is None else recs.where(F.col("rank") <= k)
    n_rec = r.agg(F.countDistinct(item_col).alias("n_rec"))
    n_cat = catalog.agg(F.countDistinct(item_col).alias("n_cat"))
    return n_rec.crossJoin(n_cat).select(safe_div(F.col("n_rec"), F.col("n_cat")).alias("coverage"))


def accuracy_metrics(recs: DataFrame, relevant: DataFrame, catalog: DataFrame, k: int = 5,
                     user_col: str = "user_id", item_col: str = "artist") -> DataFrame:
    """Means of E1–E4 over users with relevant items, and E5.  One row."""
    per = per_user_accuracy(recs, relevant, k, user_col, item_col)
    names = [f"precision_at_{k}", f"recall_at_{k}", f"ndcg_at_{k}", f"hit_rate_at_{k}"]
    means = per.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names])
    return means.crossJoin(coverage(recs, catalog, k, item_col))


def _genre_map(genres: DataFrame | None, item_col: str) -> DataFrame | None:
    if genres is None:
        return None
    return genres.select(item_col, "genre").where(F.col("genre").isNotNull())


def _users(recs: DataFrame, users: DataFrame | None, user_col: str) -> DataFrame:
    return (users if users is not None else recs).select(user_col).distinct()


def intra_list_diversity(recs: DataFrame, genres: DataFrame | None, user_col: str = "user_id",
                         item_col: str = "artist") -> DataFrame:
    """E7 per user: mean over item pairs of ``genre1 != genre2`` (missing
    genre = ``''``), 0 for lists under 2 items.

    Closed form ``1 - Σ_g n_g(n_g-1) / (n(n-1))`` from per-genre counts.
    """
    g = _genre_map(genres, item_col)
    r = recs.select(user_col, item_col)
    if g is not None:
        r = r.join(g, item_col, "left")
    else:
        r = r.withColumn("genre", F.lit(None).cast("string"))
    per_g = (r.withColumn("genre", F.coalesce("genre", F.lit("")))
              .groupBy(user_col, "genre").agg(F.count(F.lit(1)).alias("ng")))
    per_u = per_g.groupBy(user_col).agg(F.sum("ng").alias("n"),
                                        F.sum(F.col("ng") * (F.col("ng") - 1)).alias("same"))
    return per_u.select(user_col, F.when(F.col("n") < 2, 0.0).otherwise(
        1.0 - F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("intra_list_diversity"))


def intra_list_diversity_features(recs: DataFrame, features: DataFrame, metric: str = "cosine",
                                  user_col: str = "user_id", item_col: str = "artist",
                                  vec_col: str = "features") -> DataFrame:
    """E8 per user: mean pairwise ``1 - cosine`` or Euclidean distance over
    list items that have features; 0 when no pair has features.

    Cosine uses ``Σ_{i<j} u_i·u_j = (|Σu|² - Σ|u|²) / 2`` on unit vectors
    (one vector sum per user, no pair rows).  Euclidean has no such
    identity; lists are bounded by their length, so all lists of an Arrow
    batch are scored together as one padded tensor.
    """
    r = recs.select(user_col, item_col).join(features.select(item_col, vec_col), item_col)
    if metric == "cosine":
        u = r.select(user_col, normalize(vec_col).alias("u"))
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer
        agg = (u.select(user_col, array_to_vector("u").alias("v"), dot("u", "u").alias("sq"))
                .groupBy(user_col).agg(Summarizer.sum(F.col("v")).alias("s"),
                                       F.sum("sq").alias("sq"), F.count(F.lit(1)).alias("n")))
        s = vector_to_array("s")
        pair_sum = (dot(s, s) - F.col("sq")) / 2.0
        n_pairs = F.col("n") * (F.col("n") - 1) / 2.0
        return agg.select(user_col, F.when(F.col("n") < 2, 0.0)
                          .otherwise(1.0 - pair_sum / n_pairs).alias("intra_list_diversity"))
    if metric != "euclidean":
        raise ValueError(f"unsupported metric: {metric}")
    schema = f"{user_col} {recs.schema[user_col].dataType.simpleString()}, intra_list_diversity double"

    def per_batch(batches):
        for pdf in whole_groups(batches, user_col):
            keys = pdf[user_col].to_numpy()
            starts, counts, x = padded(keys, pdf[vec_col].to_numpy())
            sq = (x * x).sum(axis=2)
            d2 = np.maximum(sq[:, :, None] + sq[:, None, :] - 2.0 * np.matmul(x, x.transpose(0, 2, 1)), 0.0)
            p = x.shape[1]
            idx = np.arange(p)
            valid = idx[None, :] < counts[:, None]
            pair = np.triu(np.ones((p, p), dtype=bool), 1)[None] & valid[:, :, None] & valid[:, None, :]
            total = np.where(pair, np.sqrt(d2), 0.0).sum(axis=(1, 2))
            n_pairs = counts * (counts - 1) / 2.0
            val = np.divide(total, n_pairs, out=np.zeros_like(total), where=n_pairs > 0)
            yield pd.DataFrame({user_col: keys[starts], "intra_list_diversity": val})

    # lists are hash-partitioned by user and sorted, then scored many per
    # Arrow batch (lists are bounded by their length)
    parts = int(recs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (r.select(user_col, F.col(vec_col).cast("array<double>").alias(vec_col))
             .repartition(parts, user_col).sortWithinPartitions(user_col)
             .mapInPandas(per_batch, schema))


def catalog_coverage(recs: DataFrame, catalog: DataFrame, item_col: str = "artist") -> DataFrame:
    """Recommended ∩ catalogue / catalogue (0 if empty).  One row."""
    cat = catalog.select(item_col).distinct()
    hit = recs.select(item_col).distinct().join(cat, item_col, "left_semi")
    n_hit = hit.agg(F.count(F.lit(1)).alias("n_hit"))
    n_cat = cat.agg(F.count(F.lit(1)).alias("n_cat"))
    return n_hit.crossJoin(n_cat).select(safe_div(F.col("n_hit"), F.col("n_cat")).alias("catalog_coverage"))


def genre_coverage(recs: DataFrame, genres: DataFrame | None, user_col: str = "user_id",
                   item_col: str = "artist") -> DataFrame:
    """E10 per user: distinct genres in the list / distinct genres overall."""
    g = _genre_map(genres, item_col)
    if g is None:
        return recs.select(user_col).distinct().withColumn("genre_coverage", F.lit(0.0))
    n_all = F.broadcast(g.agg(F.countDistinct("genre").alias("_all")))   # one row
    per = (recs.select(user_col, item_col).join(g, item_col, "left")
               .groupBy(user_col).agg(F.countDistinct("genre").alias("ng")))
    return per.crossJoin(n_all).select(user_col, safe_div(F.col("ng"), F.col("_all")).alias("genre_coverage"))


def shannon_entropy(recs: DataFrame, genres: DataFrame | None, user_col: str = "user_id",
                    item_col: str = "artist") -> DataFrame:
    """E11 per user: ``-Σ p log2 p`` over genres, ``p = count / list length``
    (items without genre count in the length only)."""
    n = recs.groupBy(user_col).agg(F.count(F.lit(1)).alias("n"))
    g = _genre_map(genres, item_col)
    if g is None:
        return n.select(user_col, F.lit(0.0).alias("shannon_entropy"))
    per_g = (recs.select(user_col, item_col).join(g, item_col)
                 .groupBy(user_col, "genre").agg(F.count(F.lit(1)).alias("ng")))
    p = F.col("ng") / F.col("n")
    ent = (per_g.join(n, user_col).groupBy(user_col)
                .agg(F.sum(-p * F.log2(p)).alias("shannon_entropy")))
    return n.join(ent, user_col, "left").select(
        user_col, F.coalesce("shannon_entropy", F.lit(0.0)).alias("shannon_entropy"))


def rec_counts(recs: DataFrame, item_col: str = "artist") -> DataFrame:
    """How often each item was recommended."""
    return recs.groupBy(item_col).agg(F.count(F.lit(1)).alias("n_recommended"))


def gini(recs: DataFrame, item_col: str = "artist") -> DataFrame:
    """Gini of recommendation counts over items recommended at least
    once: ``2 Σ i·c_(i) / (n S) - (n+1)/n`` with counts ascending.

    Items are grouped by their count value c (frequency m); items with a
    smaller count (``before``) come first, so the ranks of one value sum
    to ``m·before + m(m+1)/2``.  Only the distinct count values (at most
    the number of users) are ordered, never all items.
    """
    counts = rec_counts(recs, item_col).groupBy("n_recommended").agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy("n_recommended").rowsBetween(Window.unboundedPreceding, -1)
    c, m = F.col("n_recommended").cast("double"), F.col("m").cast("double")
    steps = counts.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)).cast("double"))
    tot = steps.agg(F.sum(c * (m * F.col("before") + m * (m + 1) / 2)).alias("weighted"),
                    F.sum(m).alias("n"), F.sum(c * m).alias("s"))
    n, s = F.col("n"), F.col("s")
    return tot.select(F.when(n.isNull() | (s == 0) | (n == 0), 0.0)
                      .otherwise(2 * F.col("weighted") / (n * s) - (n + 1) / n)
                      .alias("gini_coefficient"))


def novelty(recs: DataFrame, popularity: DataFrame, user_col: str = "user_id",
            item_col: str = "artist") -> DataFrame:
    """E13 per user: mean ``-log2(max(pop, 1e-10))`` over list items with a
    popularity; 0 when none has one."""
    v = (recs.select(user_col, item_col).join(popularity.select(item_col, "popularity"), item_col)
             .groupBy(user_col)
             .agg(F.avg(-F.log2(F.greatest(F.col("popularity"), F.lit(1e-10)))).alias("novelty_score")))
    return recs.select(user_col).distinct().join(v, user_col, "left").select(
        user_col, F.coalesce("novelty_score", F.lit(0.0)).alias("novelty_score"))


def user_profile(interactions: DataFrame, features: DataFrame, user_col: str = "user_id",
                 item_col: str = "artist", plays_col: str = "play_count",
                 vec_col: str = "features") -> DataFrame:
    """``Σ plays/Σplays × feature`` over the user's rows; the
    denominator counts all the user's plays, also of items without
    features.  Users without any featured item get no profile.

    One weighted vector sum per user (``Summarizer``, partial aggregation)
    instead of exploding vectors into one row per dimension.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = interactions.select(user_col, item_col, F.col(plays_col).cast("double").alias("w"))
    total = rows.groupBy(user_col).agg(F.sum("w").alias("total"))
    feat = features.select(item_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    # zero-weight rows add nothing (and Summarizer rejects all-zero groups)
    num = (rows.where(F.col("w") != 0).join(feat, item_col).groupBy(user_col)
               .agg(Summarizer.sum(F.col("v"), F.col("w")).alias("s")))
    # a user whose plays sum to 0 has no weights, hence no profile
    return num.join(total.where(F.col("total") != 0), user_col).select(
        user_col, F.transform(vector_to_array("s"), lambda x: x / F.col("total")).alias("profile"))


def unexpectedness(recs: DataFrame, profiles: DataFrame, features: DataFrame,
                   threshold: float = 0.5, user_col: str = "user_id", item_col: str = "artist",
                   vec_col: str = "features") -> DataFrame:
    """E14 per user with a profile: mean ``max(0, t - cosine(profile, item))``
    over list items with features (vectors aligned by position); 0 when no
    listed item has features."""
    r = (recs.select(user_col, item_col).join(profiles.select(user_col, "profile"), user_col)
             .join(features.select(item_col, vec_col), item_col)
             .select(user_col, F.greatest(F.lit(0.0), F.lit(threshold) - cosine(
                 F.slice("profile", 1, F.least(F.size("profile"), F.size(vec_col))),
                 F.slice(F.col(vec_col).cast("array<double>"), 1,
                         F.least(F.size("profile"), F.size(vec_col))))).alias("u")))
    per = r.groupBy(user_col).agg(F.avg("u").alias("unexpectedness_score"))
    users = recs.select(user_col).distinct().join(profiles.select(user_col), user_col, "left_semi")
    return users.join(per, user_col, "left").select(
        user_col, F.coalesce("unexpectedness_score", F.lit(0.0)).alias("unexpectedness_score"))


def beyond_accuracy_per_user(recs: DataFrame, genres: DataFrame | None, popularity: DataFrame,
                             user_col: str = "user_id", item_col: str = "artist") -> DataFrame:
    """E7, E10, E11 and E13 per user in one pass: the list rows get their
    genre and popularity once, one ``(user, genre)`` aggregate and one
    per-user aggregate give all four numbers (same definitions as the
    single-metric functions above).  The per-user genre counts collected
    for the entropy are bounded by the list length."""
    g = _genre_map(genres, item_col)
    r = recs.select(user_col, item_col)
    if g is not None:
        r = r.join(g, item_col, "left")
        n_all = F.broadcast(g.agg(F.countDistinct("genre").alias("_all")))   # one row
    else:
        r = r.withColumn("genre", F.lit(None).cast("string"))
        n_all = recs.sparkSession.range(1).select(F.lit(0).alias("_all"))
    pop = popularity.select(item_col, F.col("popularity"))
    nov = F.when(F.col("popularity").isNotNull(), -F.log2(F.greatest(F.col("popularity"), F.lit(1e-10))))
    per_g = (r.join(pop, item_col, "left").withColumn("_nov", nov)
              .groupBy(user_col, F.coalesce("genre", F.lit("")).alias("_g"))
              .agg(F.count(F.lit(1)).alias("ng"), F.count("genre").alias("known"),
                   F.sum("_nov").alias("nov_sum"), F.count("_nov").alias("nov_n")))
    per_u = per_g.groupBy(user_col).agg(
        F.sum("ng").alias("n"), F.sum(F.col("ng") * (F.col("ng") - 1)).alias("same"),
        F.sum(F.when(F.col("known") > 0, 1).otherwise(0)).alias("n_genres"),
        F.collect_list(F.when(F.col("known") > 0, F.col("known"))).alias("known"),
        F.sum("nov_sum").alias("nov_sum"), F.sum("nov_n").alias("nov_n"))
    n = F.col("n")
    ent = F.aggregate("known", F.lit(0.0), lambda acc, c: acc - (c / n) * F.log2(c / n))
    return per_u.crossJoin(n_all).select(
        user_col,
        F.when(n < 2, 0.0).otherwise(1.0 - F.col("same") / (n * (n - 1))).alias("intra_list_diversity"),
        safe_div(F.col("n_genres"), F.col("_all")).alias("genre_coverage"),
        ent.alias("shannon_entropy"),
        F.when(F.col("nov_n") > 0, F.col("nov_sum") / F.col("nov_n")).otherwise(0.0).alias("novelty_score"))


def serendipity_metrics(recs: DataFrame, interactions: DataFrame, genres: DataFrame | None,
                        catalog: DataFrame, features: DataFrame | None = None,
                        users: DataFrame | None = None, user_col: str = "user_id",
                        item_col: str = "artist", plays_col: str = "play_count",
                        vec_col: str = "features") -> DataFrame:
    """The seven beyond-accuracy numbers as one row.

    Per-user numbers are means over ``users`` (default: users with a list;
    a user without list rows scores 0), on whole lists (not cut to k).
    Unexpectedness averages over users with a profile only, and is 0
    without ``features``.
    """
    users_all = _users(recs, users, user_col)
    per = beyond_accuracy_per_user(recs, genres, item_popularity(interactions, item_col, plays_col),
                                   user_col, item_col)
    pop = users_all.join(per, user_col, "left")
    names = ["intra_list_diversity", "genre_coverage", "shannon_entropy", "novelty_score"]
    means = pop.agg(*[F.coalesce(F.avg(F.coalesce(F.col(n), F.lit(0.0))), F.lit(0.0)).alias(n)
                      for n in names])
    if features is not None:
        prof = user_profile(interactions.join(users_all, user_col, "left_semi"), features, user_col,
                            item_col, plays_col, vec_col)
        ux = unexpectedness(recs, prof, features, 0.5, user_col, item_col, vec_col)
        ux = users_all.join(prof.select(user_col), user_col, "left_semi").join(ux, user_col, "left")
        ux_mean = ux.agg(F.coalesce(F.avg(F.coalesce("unexpectedness_score", F.lit(0.0))),
                                    F.lit(0.0)).alias("unexpectedness_score"))
    else:
        ux_mean = recs.sparkSession.range(1).select(F.lit(0.0).alias("unexpectedness_score"))
    out = (means.crossJoin(catalog_coverage(recs, catalog, item_col))
                .crossJoin(gini(recs, item_col)).crossJoin(ux_mean))
    return out.select("intra_list_diversity", "catalog_coverage", "genre_coverage", "shannon_entropy",
                      "gini_coefficient", "novelty_score", "unexpectedness_score")


def all_metrics(recs: DataFrame, relevant: DataFrame, catalog: DataFrame, k: int = 5,
                include_serendipity: bool = False, interactions: DataFrame | None = None,
                genres: DataFrame | None = None, features: DataFrame | None = None,
                users: DataFrame | None = None, user_col: str = "user_id",
                item_col: str = "artist", plays_col: str = "play_count") -> DataFrame:
    """E6 and, on demand, E15 as one row.  ``genres=None`` labels every
    catalogue item ``Unknown``; pass an empty frame for "no genre info"."""
    acc = accuracy_metrics(recs, relevant, catalog, k, user_col, item_col)
    if not include_serendipity or interactions is None:
        return acc
    if genres is None:
        genres = catalog.select(item_col).distinct().withColumn("genre", F.lit("Unknown"))
    ser = serendipity_metrics(recs, interactions, genres, catalog, features, users,
                              user_col, item_col, plays_col)
    return acc.crossJoin(ser)
