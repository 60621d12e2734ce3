"""Row numbers within a key, and joins, that stay balanced when one key is huge.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one
task.  With a limit (``row_number() <= k``) Spark inserts a partial
``WindowGroupLimit`` before the shuffle, so that is bounded; without a
limit a key holding a third of the table becomes one straggler task.

``rank_within`` first counts the rows of each key (a partial aggregate over
the key column alone).  Keys of up to ``hot_rows`` rows go through the window.
The rows of larger keys are sorted globally instead: range partitioning by
``(key, order...)`` splits a hot key over many partitions.  Each row's
position is its ``monotonically_increasing_id`` minus the first id of its
key in the same partition, plus the rows of that key in earlier
partitions.  Those offsets come from a small aggregate (one row per key
and partition).  The sorted, id-tagged rows are checkpointed first so
both branches read identical ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import ensure_checkpoint_dir

# rows of a key that one task ranks with ease
HOT_ROWS = 100_000


def rank_within(df: DataFrame, key: str, order: list[Column], rank_col: str = "rank",
                dtype: str = "int", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``row_number() OVER (PARTITION BY key ORDER BY order)`` as ``rank_col``
    (int), computed without collecting any key of more than ``hot_rows`` rows
    into a single task.  A null key is a group of its own, as in a window."""
    ensure_checkpoint_dir(df.sparkSession)
    large = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = large.select(F.col(key).alias("_hot")).checkpoint(eager=True)
    ranked = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast(dtype).alias(rank_col)
    if hot.isEmpty():
        return df.select(*df.columns, ranked)
    same = F.col(key).eqNullSafe(F.col("_hot"))
    cold = df.join(hot, same, "left_anti").select(*df.columns, ranked)
    return cold.unionByName(_rank_sorted(df.join(hot, same, "left_semi"), key, order, rank_col, dtype))


def _rank_sorted(df: DataFrame, key: str, order: list[Column], rank_col: str, dtype: str) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    # null-safe join columns: a null flag and the key as text
    jk = [F.col(key).isNull().alias("_knull"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k")]
    tagged = (df.orderBy(F.col(key).asc_nulls_first(), *order)
                .select("*", *jk)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    keys = ["_knull", "_k", "_pid"]
    per_part = tagged.groupBy(*keys).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per (key, partition): the partitions a key spans are few
    w = Window.partitionBy("_knull", "_k").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(*keys, "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    rank = (F.col("_mid") - F.col("_first") + F.col("_before") + 1).cast(dtype)
    return tagged.join(offsets, keys).select(*df.columns, rank.alias(rank_col))


def rank_all(df: DataFrame, order: list[Column], rank_col: str = "rank") -> DataFrame:
    """``row_number() OVER (ORDER BY order)`` as a long, without sending all rows to one task."""
    return _rank_sorted(df.withColumn("_one", F.lit(0)), "_one", order, rank_col, "long").drop("_one")


def dense_index(df: DataFrame, col: str, idx_col: str) -> DataFrame:
    """0-based position of each distinct non-null value of ``col`` in
    ascending order, as a long: a range sort plus per-partition offsets, all
    JVM-side, no label list through the driver or Python."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    ranked = rank_all(values, [F.col(col).asc()], "_pos")
    return ranked.select(col, (F.col("_pos") - 1).alias(idx_col))


# pairs of one key that one task makes with ease
HOT_PAIRS = 4_000_000


def spread_join(left: DataFrame, right: DataFrame, key: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Inner join on ``key`` whose work on one key is dealt over tasks.

    The rows of each key are counted on both sides.  Where their product
    exceeds ``hot_pairs``, the longer side's rows of that key are dealt to as many
    parts as bring each part's product below it, and the shorter side's rows are
    copied to every part.  Other keys are joined as they are."""
    ensure_checkpoint_dir(left.sparkSession)
    n = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l")).join(
        right.groupBy(key).agg(F.count(F.lit(1)).alias("_r")), key)
    pairs = F.col("_l").cast("double") * F.col("_r")
    # at most (all pairs / hot_pairs) keys
    hot = n.where(pairs > hot_pairs).select(
        key, F.least(F.ceil(pairs / hot_pairs), F.greatest("_l", "_r")).cast("int").alias("_parts"),
        (F.col("_l") >= F.col("_r")).alias("_deal_left")).checkpoint(eager=True)
    if hot.isEmpty():
        return left.join(right, key)

    def dealt(df: DataFrame, deals) -> DataFrame:
        one = F.array(F.pmod(F.xxhash64(*df.columns), F.col("_parts")).cast("int"))
        every = F.sequence(F.lit(0), F.col("_parts") - 1)
        part = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(deals, one).otherwise(every)
        spread = df.where(F.col(key).isNotNull()).join(hot, key, "left").select(*df.columns, F.explode(part).alias("_part"))
        # one column to join on: a partitioning by the key alone will not do
        return spread.withColumn("_dealt", F.struct(key, "_part")).drop("_part")

    a, b = dealt(left, F.col("_deal_left")), dealt(right, ~F.col("_deal_left")).drop(key)
    return a.join(b, "_dealt").drop("_dealt")
