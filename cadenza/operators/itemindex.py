"""Users by items from a bitmap index (J1 and J2 for many wanted lists at once).

Users get dense numbers (A2), cut into segments of 32,768.  The index holds, per
item and segment, a bitmap of the users who have the item.  The users who
have all items of a list are the bitwise and of its items' bitmaps, segment by
segment; a segment that an item lacks has none.  Users of the lists come from one
join and one aggregate with map-side combine, whose buffers are 4 KB each; their
numbers alone (``count_by_lists``) without a bitmap for each list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.prepare import index_ids
from cadenza.session import ensure_checkpoint_dir

SEGMENT = 32_768  # bits of Spark's bitmaps
GROUP_BITMAPS = 4096  # bitmaps that a task holds, 4 KB each
GROUP_SETS = 50_000  # sets that a task counts
_CELLS = 4_000_000  # words and-ed at once


def item_index(df: DataFrame, users: DataFrame, user_col: str = "user_id", item_col: str = "artist") -> DataFrame:
    """item, segment, bitmap.  ``users`` is ``(user, user_idx)`` from ``index_ids``."""
    cells = df.select(user_col, item_col).where(F.col(item_col).isNotNull()).distinct()
    # Spark counts buckets and bits from 1
    at = F.col("user_idx").cast("long") + 1
    return cells.join(users.select(user_col, "user_idx"), user_col).groupBy(
        F.col(item_col).alias("item"), F.bitmap_bucket_number(at).alias("segment")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def _matched(index: DataFrame, lists: DataFrame, list_col: str, item_col: str) -> DataFrame:
    """list, segment and the bitmap of the users with all its items; names are
    trimmed, repeats count once, empty names not at all."""
    wanted = lists.select(F.col(list_col).alias("list"), F.trim(F.col(item_col).cast("string")).alias("item")).where(
        "item <> ''").distinct()
    sizes = wanted.groupBy("list").agg(F.count(F.lit(1)).alias("size"))
    met = wanted.join(index, "item").groupBy("list", "segment").agg(
        F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("n"))
    return met.join(sizes, "list").where("n = size").select("list", "segment", "bitmap")


def _count_sets(index: pa.Table, sets: pa.Table) -> pa.Table:
    """set_id, n_users of a group's sets over its segments: the bitmaps are one
    grid (items x words, a last row of zeros for an absent item), of which each
    set's rows are and-ed, ``_CELLS`` words at a time."""
    items = pc.unique(index.column("item").combine_chunks())
    segments = pc.unique(index.column("segment").combine_chunks())
    words = SEGMENT // 64
    grid = np.zeros((len(items) + 1, len(segments), words), np.uint64)
    if index.num_rows:
        at = np.asarray(pc.index_in(index.column("item").combine_chunks(), items))
        seg = np.asarray(pc.index_in(index.column("segment").combine_chunks(), segments))
        for i, j, bits in zip(at.tolist(), seg.tolist(), index.column("bitmap").to_pylist()):
            grid[i, j] = np.frombuffer(bits, np.uint64)
    grid = grid.reshape(len(grid), -1)
    names = sets.column("items").combine_chunks()
    sizes = np.asarray(names.value_lengths(), np.int64)
    row = np.asarray(pc.fill_null(pc.index_in(names.flatten(), items), len(items)), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.zeros(len(sizes), np.int64)
    room = max(1, _CELLS // max(1, grid.shape[1]))
    lo = 0
    while lo < len(sizes) and len(segments):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + room, "right")) - 1)
        if hi == lo + 1:  # one set, however long: row by row
            met = grid[row[starts[lo]]].copy()
            for r in row[starts[lo] + 1:starts[hi]]:
                met &= grid[r]
            counts[lo] = int(np.bitwise_count(met).sum(dtype=np.int64))
        else:
            met = np.bitwise_and.reduceat(grid[row[starts[lo]:starts[hi]]], starts[lo:hi] - starts[lo], axis=0)
            counts[lo:hi] = np.bitwise_count(met).sum(axis=1, dtype=np.int64)
        lo = hi
    return pa.table({"set_id": sets.column("set_id").cast(pa.int64()), "n_users": pa.array(counts)})


def count_by_lists(index: DataFrame, lists: DataFrame, list_col: str = "list_id", item_col: str = "artist",
                   group_bitmaps: int = GROUP_BITMAPS, group_sets: int = GROUP_SETS) -> DataFrame:
    """list, n_items (distinct names wanted) and n_users (who have them all).

    Equal lists are one set.  A set's names, and no bitmap, go to each run of
    segments; there a task holds the wanted items' bitmaps of the run, about
    ``group_bitmaps``, and and-s them for about ``group_sets`` sets."""
    spark = index.sparkSession
    ensure_checkpoint_dir(spark)
    name = F.trim(F.col(item_col).cast("string"))
    per = lists.select(F.col(list_col).alias("list"), name.alias("item")).groupBy("list").agg(
        F.sort_array(F.collect_set(F.when(F.col("item") != "", F.col("item")))).alias("items")).checkpoint(eager=True)
    asked = F.col("list").isNotNull() & (F.size("items") > 0)
    sets = per.where(asked).select("items").distinct().withColumn("set_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    wanted = index.select(F.col("item").cast("string").alias("item"), "segment", "bitmap").join(
        sets.select(F.explode("items").alias("item")).distinct(), "item", "left_semi")
    # one row of three numbers
    shape = index.agg(F.countDistinct("item").alias("items"), F.max("segment").alias("last")).first()
    n_items, last = shape["items"], shape["last"] or 0
    span = max(1, group_bitmaps // max(1, n_items))
    runs, parts = -(-last // span), max(1, -(-sets.count() // group_sets))
    run = F.floor((F.col("segment") - 1) / span).cast("int").alias("_run")
    left = wanted.select("item", "segment", "bitmap", run, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    each = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))) if runs else F.explode(F.array().cast("array<int>"))
    right = sets.select("set_id", "items", F.pmod(F.xxhash64("set_id"), F.lit(parts)).cast("int").alias("_part"), each.alias("_run"))
    met = left.groupBy("_run", "_part").cogroup(right.groupBy("_run", "_part")).applyInArrow(
        _count_sets, "set_id long, n_users long")
    total = met.groupBy("set_id").agg(F.sum("n_users").alias("n_users"))
    counted = sets.join(total, "set_id", "left").select("items", "n_users").withColumn("_set", F.lit(True))
    return per.withColumn("_set", asked).join(counted, ["items", "_set"], "left").select(
        F.col("list").alias(list_col), F.size("items").cast("long").alias("n_items"),
        F.coalesce("n_users", F.lit(0)).cast("long").alias("n_users"))


def users_by_lists(index: DataFrame, lists: DataFrame, users: DataFrame, list_col: str = "list_id",
                   item_col: str = "artist", user_col: str = "user_id") -> DataFrame:
    """(list, user) of every user who has all items of the list."""
    met = _matched(index, lists, list_col, item_col)
    byte = F.conv(F.hex(F.substring("bitmap", F.col("_at") + 1, F.lit(1))), 16, 10).cast("int")
    filled = met.select("list", "segment", "bitmap", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT // 8 - 1))).alias("_at")).select(
        "list", "segment", "_at", byte.alias("_byte")).where("_byte <> 0")
    bits = filled.select("list", "segment", "_at", "_byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_bit")).where(
        F.call_function("shiftright", "_byte", "_bit").bitwiseAND(1) == 1)
    number = (F.col("segment") - 1) * SEGMENT + F.col("_at") * 8 + F.col("_bit")
    return bits.select(F.col("list").alias(list_col), number.cast("int").alias("user_idx")).join(
        users.select(user_col, "user_idx"), "user_idx").select(list_col, user_col)


def build(df: DataFrame, user_col: str = "user_id", item_col: str = "artist") -> tuple[DataFrame, DataFrame]:
    """The users' numbers and the index, each written once."""
    users = index_ids(df, user_col, "user_idx").checkpoint(eager=True)
    return users, item_index(df, users, user_col, item_col).checkpoint(eager=True)
