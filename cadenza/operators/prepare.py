"""Preparation: triples, dense indices, time splits, relevant items.

A1 interaction_triples, A2 index_ids, P7 split_by_date, P8 split_by_ratio,
J3 relevant_items, J4 prepare_evaluation_data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.ordering import dense_index


def interaction_triples(df: DataFrame, user_col: str = "user_id", item_col: str = "artist",
                        strength_col: str = "play_count") -> DataFrame:
    """A1: one cell per (user, item); repeated rows are summed.

    Partial (map-side) aggregation runs before the shuffle, so a hot
    user or item only ships one partial row per map task.
    """
    return (df.groupBy(user_col, item_col)
              .agg(F.sum(strength_col).cast("long").alias("strength")))


def index_ids(df: DataFrame, col: str, idx_col: str) -> DataFrame:
    """A2: dense 0-based int index of the distinct values of ``col``, in
    ascending order (reproducible across runs).

    Distinct values are range-sorted on the cluster and numbered from
    per-partition offsets (``ordering.dense_index``): no label list passes
    through the driver and no row through Python.  ALS needs int ids,
    hence the range check.
    """
    out = dense_index(df, col, idx_col)
    # assert_true yields null when it holds, so the guard is part of the value
    guard = F.expr(f"assert_true({idx_col} < 2147483647, 'index exceeds int range')").cast("long")
    return out.select(col, F.coalesce(guard, F.col(idx_col)).cast("int").alias(idx_col))


def split_by_date(df: DataFrame, split_date, date_col: str = "interaction_date"):
    """Train ``< split_date``, test ``>= split_date``.  A literal date
    is pushed down to the Parquet scan (and prunes date partitions)."""
    d = split_date
    if isinstance(d, str):
        d = F.lit(d).cast("date")
    train = df.filter(F.col(date_col) < d)
    test = df.filter(F.col(date_col) >= d)
    return train, test


def ratio_split_date(df: DataFrame, train_ratio: float = 0.8,
                     date_col: str = "interaction_date") -> DataFrame:
    """One-row frame with the P8 split date: date number ``int(n * ratio)``
    (0-based) of the sorted distinct dates, the last one when out of range.

    Distinct dates are reduced with a partial aggregate first; only the
    (calendar-bounded) set of distinct dates is ever sorted.
    """
    dates = df.select(F.col(date_col).alias("d")).where(F.col("d").isNotNull()).distinct()
    agg = dates.agg(F.sort_array(F.collect_list("d")).alias("ds"))
    n = F.size("ds")
    pos = F.least(F.floor(n.cast("double") * F.lit(float(train_ratio))).cast("int") + 1, n)
    # no dates at all: no split date (element_at(.., 0) would raise under ANSI)
    return agg.select(F.when(n > 0, F.element_at("ds", pos)).alias("split_date"))


def split_by_ratio(df: DataFrame, train_ratio: float = 0.8, date_col: str = "interaction_date"):
    """Split by ratio of distinct dates (not rows)."""
    sd = ratio_split_date(df, train_ratio, date_col).scalar()
    return split_by_date(df, sd, date_col)


def label_split(df: DataFrame, split_date=None, train_ratio: float = 0.8,
                date_col: str = "interaction_date") -> DataFrame:
    """Both sides in one frame with a ``split`` column (``train``/``test``);
    rows with a null date belong to neither side."""
    if split_date is None:
        d = ratio_split_date(df, train_ratio, date_col).scalar()
    else:
        d = F.lit(split_date).cast("date")
    return (df.where(F.col(date_col).isNotNull())
              .withColumn("split", F.when(F.col(date_col) < d, "train").otherwise("test")))


def relevant_items(train: DataFrame, test: DataFrame, user_col: str = "user_id",
                   item_col: str = "artist") -> DataFrame:
    """Distinct test items of users that appear on both sides.

    Items the user already has in train stay relevant (as in the source
    behaviour).
    """
    train_users = train.select(user_col).distinct()
    return (test.select(user_col, item_col).distinct()
                .join(train_users, user_col, "left_semi"))


@dataclass
class EvaluationData:
    train: DataFrame
    test: DataFrame
    relevant: DataFrame


def prepare_evaluation_data(df: DataFrame, split_date=None, train_ratio: float = 0.8,
                            user_col: str = "user_id", item_col: str = "artist",
                            date_col: str = "interaction_date") -> EvaluationData:
    """P7 when a date is given, else P8; then J3."""
    if split_date is not None:
        train, test = split_by_date(df, split_date, date_col)
    else:
        train, test = split_by_ratio(df, train_ratio, date_col)
    return EvaluationData(train, test, relevant_items(train, test, user_col, item_col))
