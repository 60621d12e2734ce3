"""Exploration: histories, search by items and demographics, summaries.

P3 user_history, P4 user_history_genre, P5 distinct_values, P6 items_in_list,
P9/P10 via user_demographics, A3 item_popularity, A4 item_genre,
A5 user_demographics, A6 demographic_domains, A7 dataset_summary,
A8 dataset_distribution, A9 user_stats, A10 user_genre_plays,
A11 genre_item_counts, A12 split_stats, J1 users_by_all_items,
J2 users_by_items_and_demographics, J6 common_items, J7 user_comparison.

Everything is computed for all users at once; a single user is a filter
on the result (or a semi join with a frame of wanted users).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import cosine, safe_div
from cadenza.operators.ordering import rank_within, spread_join
from cadenza.operators.prepare import interaction_triples
from cadenza.session import ensure_checkpoint_dir


def user_history(df: DataFrame, user_col: str = "user_id", item_col: str = "artist",
                 plays_col: str = "play_count", extra: tuple[str, ...] = (),
                 limit: int | None = None) -> DataFrame:
    """Each user's rows (not aggregated) ranked by plays desc, item asc.

    ``limit`` keeps the first rows per user (P4 shows 20); Spark plans it
    as a partial + final WindowGroupLimit, so a long history never reaches
    one task whole.  Without a limit the rows are ranked by a global range
    sort (``rank_within``), which splits a long history over tasks.
    """
    order = [F.col(plays_col).desc(), F.col(item_col).asc(), *[F.col(c).asc() for c in extra]]
    rows = df.select(user_col, item_col, plays_col, *extra)
    if limit is None:
        return rank_within(rows, user_col, order, "rank")
    w = Window.partitionBy(user_col).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def user_history_genre(df: DataFrame, limit: int = 20, **kw) -> DataFrame:
    """P3 with the row's genre, first ``limit`` rows per user."""
    return user_history(df, extra=("genre",), limit=limit, **kw)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """P5: distinct user ids or items."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def _wanted(names) -> list[str]:
    seen, out = set(), []
    for x in names:
        x = str(x).strip()
        if x and x not in seen:
            seen.add(x)
            out.append(x)
    return out


def _filter_items(df: DataFrame, names, item_col: str) -> DataFrame:
    if isinstance(names, DataFrame):
        # size unknown: a plain semi join; AQE broadcasts it when it is small
        wanted = names.select(F.trim(F.col(names.columns[0])).alias(item_col)).distinct()
        return df.join(wanted, item_col, "left_semi")
    # the list is in the plan anyway; as literals it reaches the scan
    return df.where(F.col(item_col).isin(_wanted(names)))


def items_in_list(df: DataFrame, names, item_col: str = "artist") -> DataFrame:
    """Rows whose item is in the wanted list; wanted names are trimmed,
    the data column is not."""
    return _filter_items(df, names, item_col)


def users_by_all_items(df: DataFrame, names, user_col: str = "user_id",
                       item_col: str = "artist") -> DataFrame:
    """Users who have every wanted item (relational division).

    Wanted names are trimmed and de-duplicated; an empty list matches
    nobody.  Only rows of wanted items reach the shuffle.
    """
    hits = _filter_items(df, names, item_col)
    per_user = hits.groupBy(user_col).agg(F.countDistinct(item_col).alias("_n"))
    if isinstance(names, DataFrame):
        wanted = names.select(F.trim(F.col(names.columns[0])).alias(item_col)).distinct()
        # one-row count joined lazily (broadcast of a single row)
        n_wanted = F.broadcast(wanted.agg(F.count(F.lit(1)).alias("_want")))
        return per_user.crossJoin(n_wanted).where(F.col("_n") == F.col("_want")).select(user_col)
    lst = _wanted(names)
    if not lst:
        return df.sparkSession.createDataFrame([], df.select(user_col).schema)
    return per_user.where(F.col("_n") == F.lit(len(lst))).select(user_col)


def user_demographics(df: DataFrame, user_col: str = "user_id",
                      date_col: str = "interaction_date") -> DataFrame:
    """A5: gender and age of each user from the earliest row (ties: smallest
    gender, then age).  ``first`` has no stable order in Spark, so the rule
    is explicit."""
    first = F.min(F.struct(F.col(date_col), F.col("gender"), F.col("age"))).alias("_f")
    return (df.groupBy(user_col).agg(first)
              .select(user_col, F.col("_f.gender").alias("gender"), F.col("_f.age").alias("age")))


def users_by_items_and_demographics(df: DataFrame, names, gender: str | None = None,
                                    age: str | None = None, user_col: str = "user_id",
                                    item_col: str = "artist") -> DataFrame:
    """J1 restricted to users whose demographics equal the given values
    (P9: an empty or missing value means no filter)."""
    users = users_by_all_items(df, names, user_col, item_col)
    demo = user_demographics(df.join(users, user_col, "left_semi"), user_col)
    if gender:
        demo = demo.where(F.col("gender") == gender)
    if age:
        demo = demo.where(F.col("age") == age)
    return demo


def demographic_domains(df: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Value domain of gender and of age over users: ``field, value``."""
    demo = user_demographics(df, user_col)
    # one pass: each user row yields its (field, value) pairs
    pairs = demo.select(F.explode(F.array(
        F.struct(F.lit("gender").alias("field"), F.col("gender").alias("value")),
        F.struct(F.lit("age").alias("field"), F.col("age").alias("value")))).alias("p"))
    return pairs.select("p.field", "p.value").where(F.col("value").isNotNull()).distinct()


def item_popularity(df: DataFrame, item_col: str = "artist", plays_col: str = "play_count") -> DataFrame:
    """A3: Σplays per item divided by the largest such sum."""
    totals = df.groupBy(item_col).agg(F.sum(plays_col).cast("double").alias("total_plays"))
    top = F.broadcast(totals.agg(F.max("total_plays").alias("_top")))   # one row
    return totals.crossJoin(top).select(item_col, safe_div(F.col("total_plays"), F.col("_top"))
                                        .alias("popularity"))


def item_genre(df: DataFrame, item_col: str = "artist", genre_col: str = "genre",
               unknown: str | None = "Unknown") -> DataFrame:
    """A4: one genre per item, the smallest if several; ``unknown`` if none."""
    g = F.min(genre_col)
    if unknown is not None:
        g = F.coalesce(g, F.lit(unknown))
    return df.groupBy(item_col).agg(g.alias("genre"))


def dataset_summary(df: DataFrame, user_col: str = "user_id", item_col: str = "artist",
                    approx: bool = False) -> DataFrame:
    """#users, #items, #rows in one pass."""
    cd = F.approx_count_distinct if approx else F.countDistinct
    return df.agg(cd(user_col).alias("n_users"), cd(item_col).alias("n_items"),
                  F.count(F.lit(1)).alias("n_rows"))


def dataset_distribution(df: DataFrame, plays_col: str = "play_count") -> DataFrame:
    """Row counts per gender, per age bucket and per genre plus the
    overall mean and total plays, read in one pass (grouping sets).

    ``field`` is ``gender``/``age``/``genre`` for the per-value rows and
    ``all`` for the overall row (``value`` null).
    """
    cols = ["gender", "age", "genre"]
    agg = df.groupingSets([[c] for c in cols] + [[]], *cols).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(plays_col).alias("mean_plays"),
        F.sum(plays_col).cast("long").alias("total_plays"),
        F.grouping_id().alias("_gid"))
    # grouping_id bits: gender=4, age=2, genre=1 (1 = column aggregated away)
    field = (F.when(F.col("_gid") == 3, "gender").when(F.col("_gid") == 5, "age")
              .when(F.col("_gid") == 6, "genre").otherwise("all"))
    value = F.when(F.col("_gid") == 3, F.col("gender")).when(F.col("_gid") == 5, F.col("age")) \
             .when(F.col("_gid") == 6, F.col("genre"))
    return agg.select(field.alias("field"), value.alias("value"), "n_rows", "mean_plays", "total_plays")


def user_stats(df: DataFrame, user_col: str = "user_id", plays_col: str = "play_count") -> DataFrame:
    """Rows, mean plays, total plays and distinct genres per user."""
    return df.groupBy(user_col).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(plays_col).alias("mean_plays"),
        F.sum(plays_col).cast("long").alias("total_plays"),
        F.countDistinct("genre").alias("n_genres"))


def user_genre_plays(df: DataFrame, top: int = 10, user_col: str = "user_id",
                     plays_col: str = "play_count") -> DataFrame:
    """A10: each user's plays per genre, the ``top`` genres by plays."""
    per = df.groupBy(user_col, "genre").agg(F.sum(plays_col).cast("long").alias("plays"))
    w = Window.partitionBy(user_col).orderBy(F.col("plays").desc(), F.col("genre").asc())
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def genre_item_counts(df: DataFrame, item_col: str = "artist") -> DataFrame:
    """Number of items per genre (over A4)."""
    return item_genre(df, item_col).groupBy("genre").agg(F.count(F.lit(1)).alias("n_items"))


def split_stats(labeled: DataFrame, user_col: str = "user_id", item_col: str = "artist",
                date_col: str = "interaction_date") -> DataFrame:
    """Rows, users, items and date range per side, and users/items on
    both sides, as one row.  Input: interactions with a ``split`` column.

    One pass: every row contributes a user record and an item record; one
    partial-aggregated ``(kind, key)`` aggregate holds per-side row counts
    and date ranges, and a final one-row aggregate derives every number
    (rows and dates from the user records, distinct counts from both).
    """
    tr, te = F.col("split") == "train", F.col("split") == "test"
    keyed = labeled.select(
        F.explode(F.array(
            F.struct(F.lit("user").alias("kind"), F.col(user_col).cast("string").alias("key")),
            F.struct(F.lit("item").alias("kind"), F.col(item_col).cast("string").alias("key")))).alias("k"),
        tr.alias("tr"), te.alias("te"), F.col(date_col).alias("d"))
    per = keyed.groupBy(F.col("k.kind").alias("kind"), F.col("k.key").alias("key")).agg(
        F.sum(F.col("tr").cast("long")).alias("n_tr"), F.sum(F.col("te").cast("long")).alias("n_te"),
        F.min(F.when(F.col("tr"), F.col("d"))).alias("tr_lo"), F.max(F.when(F.col("tr"), F.col("d"))).alias("tr_hi"),
        F.min(F.when(F.col("te"), F.col("d"))).alias("te_lo"), F.max(F.when(F.col("te"), F.col("d"))).alias("te_hi"))
    user, item, known = F.col("kind") == "user", F.col("kind") == "item", F.col("key").isNotNull()

    def n_keys(cond):
        return F.count(F.when(cond, F.lit(1)))

    def total(c):
        return F.coalesce(F.sum(F.when(user, F.col(c))), F.lit(0)).cast("long")

    return per.agg(
        total("n_tr").alias("train_interactions"),
        n_keys(user & known & (F.col("n_tr") > 0)).alias("train_users"),
        n_keys(item & known & (F.col("n_tr") > 0)).alias("train_items"),
        F.min(F.when(user, F.col("tr_lo"))).alias("train_min_date"),
        F.max(F.when(user, F.col("tr_hi"))).alias("train_max_date"),
        total("n_te").alias("test_interactions"),
        n_keys(user & known & (F.col("n_te") > 0)).alias("test_users"),
        n_keys(item & known & (F.col("n_te") > 0)).alias("test_items"),
        F.min(F.when(user, F.col("te_lo"))).alias("test_min_date"),
        F.max(F.when(user, F.col("te_hi"))).alias("test_max_date"),
        n_keys(user & (F.col("n_tr") > 0) & (F.col("n_te") > 0)).alias("common_users"),
        n_keys(item & (F.col("n_tr") > 0) & (F.col("n_te") > 0)).alias("common_items"))


def common_items(df: DataFrame, pairs: DataFrame, top_n: int = 10, user_col: str = "user_id",
                 item_col: str = "artist", plays_col: str = "play_count") -> DataFrame:
    """Items two users share with each one's Σplays, by total plays
    desc (ties: item asc), first ``top_n`` per pair.

    ``pairs`` has ``user_id1, user_id2``.  Rows are pre-aggregated to one
    cell per (user, item), and the cells of the users named in ``pairs`` are
    written once: the input and the pairs are evaluated once, and both join
    sides read the copy.
    """
    ensure_checkpoint_dir(df.sparkSession)
    pairs = pairs.select("user_id1", "user_id2").distinct().checkpoint(eager=True)
    named = pairs.select(F.explode(F.array("user_id1", "user_id2")).alias(user_col)).distinct()
    t = interaction_triples(df.join(named, user_col, "left_semi"), user_col, item_col,
                            plays_col).checkpoint(eager=True)
    a = t.select(F.col(user_col).alias("user_id1"), F.col(item_col), F.col("strength").alias("plays1"))
    b = t.select(F.col(user_col).alias("user_id2"), F.col(item_col), F.col("strength").alias("plays2"))
    j = spread_join(pairs, a, "user_id1").join(b, ["user_id2", item_col])
    w = Window.partitionBy("user_id1", "user_id2").orderBy(
        (F.col("plays1") + F.col("plays2")).desc(), F.col(item_col).asc())
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
             .select("user_id1", "user_id2", "rank", item_col, "plays1", "plays2"))


def user_comparison(df: DataFrame, pairs: DataFrame, user_vecs: DataFrame | None = None,
                    genres: DataFrame | None = None, user_col: str = "user_id",
                    item_col: str = "artist", vec_col: str = "features") -> DataFrame:
    """Per pair, number of shared items, number of shared genres and
    the cosine of the two users' factors (null without factors).

    ``genres`` maps item → genre (default: the ``genre`` column of ``df``).
    """
    ensure_checkpoint_dir(df.sparkSession)
    # pairs and histories are read by both counts, on both sides: written once
    p = pairs.select("user_id1", "user_id2").distinct().checkpoint(eager=True)
    users = p.select(F.explode(F.array("user_id1", "user_id2")).alias(user_col)).distinct()
    ui = df.select(user_col, item_col).join(users, user_col, "left_semi").distinct().checkpoint(eager=True)
    if genres is None:
        ig = item_genre(df.join(users, user_col, "left_semi"), item_col, unknown=None)
    else:
        ig = genres.select(item_col, "genre")
    ug = ui.join(ig, item_col).select(user_col, "genre").where(F.col("genre").isNotNull()).distinct()

    def shared(t, key, name):
        a = t.withColumnRenamed(user_col, "user_id1")
        b = t.withColumnRenamed(user_col, "user_id2")
        return (p.join(a, "user_id1").join(b, ["user_id2", key])
                 .groupBy("user_id1", "user_id2").agg(F.count(F.lit(1)).alias(name)))

    out = (p.join(shared(ui, item_col, "n_common_items"), ["user_id1", "user_id2"], "left")
            .join(shared(ug, "genre", "n_common_genres"), ["user_id1", "user_id2"], "left")
            .select("user_id1", "user_id2",
                    F.coalesce("n_common_items", F.lit(0)).cast("long").alias("n_common_items"),
                    F.coalesce("n_common_genres", F.lit(0)).cast("long").alias("n_common_genres")))
    if user_vecs is not None:
        v1 = user_vecs.select(F.col(user_col).alias("user_id1"), F.col(vec_col).alias("_v1"))
        v2 = user_vecs.select(F.col(user_col).alias("user_id2"), F.col(vec_col).alias("_v2"))
        out = (out.join(v1, "user_id1", "left").join(v2, "user_id2", "left")
                  .withColumn("cosine", F.when(F.col("_v1").isNotNull() & F.col("_v2").isNotNull(),
                                               cosine("_v1", "_v2")))
                  .drop("_v1", "_v2"))
    return out
