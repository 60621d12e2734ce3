"""Counts of any time split from one small table of sketches per day.

``daily_sketches`` reads the interactions once and keeps, per day, the number
of rows and a theta sketch of its users and of its items.  Sketches unite and
intersect, so the split statistics of any date, the users and items on both
sides included, and the data set's summary read the days only; new days are
added by ``merge_days`` without reading the old rows.

A sketch of ``2 ** lg`` entries is exact up to that many distinct values; above,
a union's relative standard error is about ``1 / sqrt(2 ** lg)``, and that of
an intersection the same times the root of (union / intersection).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.prepare import ratio_split_date

LG_ENTRIES = 16


def daily_sketches(df: DataFrame, user_col: str = "user_id", item_col: str = "artist",
                   date_col: str = "interaction_date", lg: int = LG_ENTRIES) -> DataFrame:
    """day, n_rows, users, items (theta sketches); rows without a date are in no day."""
    return df.where(F.col(date_col).isNotNull()).groupBy(F.col(date_col).alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.theta_sketch_agg(F.col(user_col).cast("string"), lg).alias("users"),
        F.theta_sketch_agg(F.col(item_col).cast("string"), lg).alias("items"))


def merge_days(days: DataFrame, lg: int = LG_ENTRIES) -> DataFrame:
    """One row per day of several tables of sketches put together."""
    return days.groupBy("day").agg(F.sum("n_rows").alias("n_rows"), F.theta_union_agg("users", lg).alias("users"),
                                   F.theta_union_agg("items", lg).alias("items"))


def _estimate(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("long")


def summary_from_days(days: DataFrame, lg: int = LG_ENTRIES) -> DataFrame:
    """n_users, n_items, n_rows."""
    one = days.agg(F.theta_union_agg("users", lg).alias("u"), F.theta_union_agg("items", lg).alias("i"), F.sum("n_rows").alias("n"))
    return one.select(_estimate(F.col("u")).alias("n_users"), _estimate(F.col("i")).alias("n_items"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))


def split_stats_from_days(days: DataFrame, split_date=None, train_ratio: float = 0.8, lg: int = LG_ENTRIES) -> DataFrame:
    """A12 of the split at ``split_date``, or at P8's date for ``train_ratio``: the
    columns of ``explore.split_stats``.  The sides' sketches are one row."""
    if split_date is not None:
        cut = days.withColumn("_cut", F.lit(split_date).cast("date"))
    else:
        cut = days.crossJoin(F.broadcast(ratio_split_date(days, train_ratio, "day").withColumnRenamed("split_date", "_cut")))
    sides = {"train": F.col("day") < F.col("_cut"), "test": F.col("day") >= F.col("_cut")}
    one = cut.agg(*[x for side, here in sides.items() for x in (
        F.coalesce(F.sum(F.when(here, F.col("n_rows"))), F.lit(0)).cast("long").alias(f"{side}_interactions"),
        F.theta_union_agg(F.when(here, F.col("users")), lg).alias(f"{side}_u"),
        F.theta_union_agg(F.when(here, F.col("items")), lg).alias(f"{side}_i"),
        F.min(F.when(here, F.col("day"))).alias(f"{side}_min_date"),
        F.max(F.when(here, F.col("day"))).alias(f"{side}_max_date"))])

    def common(kind: str) -> Column:
        return _estimate(F.theta_intersection(f"train_{kind}", f"test_{kind}"))

    columns = [x for side in sides for x in (
        F.col(f"{side}_interactions"), _estimate(F.col(f"{side}_u")).alias(f"{side}_users"),
        _estimate(F.col(f"{side}_i")).alias(f"{side}_items"), F.col(f"{side}_min_date"), F.col(f"{side}_max_date"))]
    return one.select(*columns, common("u").alias("common_users"), common("i").alias("common_items"))
