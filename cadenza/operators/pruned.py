"""Exact top-k by dot product that skips what cannot matter (M4, M7).

A score is at most the product of two lengths (Cauchy-Schwarz).  So the right
side is put in order of falling length and cut into blocks; a left row meets
them one after the other and stops as soon as its k-th best score is above its own
length times that of the next block's longest vector.  Factor models give popular
items long vectors, and most users stop after a few blocks.

The longest right rows, up to ``head_bytes``, are broadcast (that bound is their
size bound); each left row is read by one task, where it lies, and copied
nowhere.  With exclusions the left rows and each one's excluded head positions
are brought together once.  If the right side is longer than the head, the left
rows that have not stopped by then, and only they, go through the blocked
product (``vectors.topk``) with the rest; both results are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import norm
from cadenza.operators.ranking import Ranker
from cadenza.operators.vectors import topk
from cadenza.session import ensure_checkpoint_dir

HEAD_BYTES = 64 << 20
BLOCK_ROWS = 1024
_CELLS = 4_000_000  # scores held at once in a task


@dataclass(frozen=True)
class Pruned:
    """``lists``: left_id, right_id, score, rank.  ``work``: left_id, how many head
    blocks it met (``blocks_met``) of how many (``blocks``), and whether it went on
    to the rest (``went_on``)."""
    lists: DataFrame
    work: DataFrame


def _ranked(head) -> callable:
    def run(batches):
        h = head.value
        step = max(1, _CELLS // max(int((h.stops - h.starts).max(initial=1)), 1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                n = part.num_rows
                vec, seen = part.column(1), part.column(2)
                left = np.asarray(vec.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, h.vecs.shape[1]))
                sizes = np.asarray(seen.value_lengths().fill_null(0), np.int64)
                row, position = np.repeat(np.arange(n), sizes), np.asarray(seen.flatten(), np.int64)
                by = np.argsort(position, kind="stable")
                ids, scores, met, more = h.rank(left, row[by], position[by])
                found = np.isfinite(scores)
                offsets = np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids[found])),
                     pa.ListArray.from_arrays(offsets, pa.array(scores[found])), pa.array(met), pa.array(more)],
                    names=["left_id", "ids", "scores", "blocks_met", "went_on"])
    return run


def topk_pruned(left: DataFrame, right: DataFrame, k: int, *, left_id: str = "id", right_id: str = "id",
                left_vec: str = "embedding", right_vec: str = "embedding", exclude: DataFrame | None = None,
                exclude_left: str = "left_id", exclude_right: str = "right_id",
                head_bytes: int = HEAD_BYTES, block_rows: int = BLOCK_ROWS) -> Pruned:
    """The rows of ``vectors.topk``: the top ``k`` right rows per left row by dot
    product, without the excluded pairs, ties by right id.  Ids are integral,
    vectors of one size without nulls."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark = left.sparkSession
    ensure_checkpoint_dir(spark)
    lefts = left.select(F.col(left_id).cast("long").alias("left_id"), F.col(left_vec).cast("array<double>").alias("vec"))
    vec = F.col(right_vec).cast("array<double>")
    rights = right.select(F.col(right_id).cast("long").alias("id"), vec.alias("vec"), norm(vec).alias("length"))
    any_row = rights.first()
    if any_row is None:
        nothing = lefts.where("false").select("left_id", F.lit(0).cast("long").alias("right_id"),
                                              F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        work = lefts.select("left_id", *[F.lit(0).cast("long").alias(c) for c in ("blocks_met", "blocks")], F.lit(False).alias("went_on"))
        return Pruned(nothing, work)
    rows = max(k, head_bytes // (8 * (len(any_row.vec) + 2)))
    # at most head_bytes, and one row more, which tells the length of the rest
    top = rights.orderBy(F.col("length").desc(), "id").limit(rows + 1).toArrow()
    ids = np.asarray(top.column("id"), np.int64)
    lengths = np.asarray(top.column("length"), np.float64)
    vecs = np.asarray(top.column("vec").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
    whole = len(ids) <= rows
    head = Ranker(ids[:rows], vecs[:rows], lengths[:rows], -1.0 if whole else float(lengths[rows]), block_rows, k)
    places = spark.createDataFrame(pa.table({"_id": head.ids, "_at": np.arange(len(head.ids), dtype=np.int32)}))

    if exclude is None:
        given = lefts.withColumn("seen", F.array().cast("array<int>"))
    else:
        pairs = exclude.select(F.col(exclude_left).cast("long").alias("left_id"), F.col(exclude_right).cast("long").alias("_id"))
        # positions in the head: as many as it has rows at most
        seen = (pairs.join(F.broadcast(places), "_id")
                .groupBy("left_id").agg(F.collect_set("_at").alias("seen")))
        given = lefts.join(seen, "left_id", "left").select("left_id", "vec", F.coalesce("seen", F.array().cast("array<int>")).alias("seen"))
    shared = spark.sparkContext.broadcast(head)
    found = given.mapInArrow(_ranked(shared), "left_id long, ids array<long>, scores array<double>, blocks_met long, went_on boolean")
    found = found.checkpoint(eager=True)
    work = found.select("left_id", "blocks_met", F.lit(len(head.starts)).cast("long").alias("blocks"), "went_on")
    pairs = found.select("left_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("_at", "_x")).select(
        "left_id", F.col("_x.ids").alias("right_id"), F.col("_x.scores").alias("score"), (F.col("_at") + 1).cast("int").alias("rank"))
    # of the rest, only what reaches the k-th best score of the head
    least = F.when(F.size("scores") >= k, F.element_at("scores", -1)).otherwise(float("-inf"))
    on = found.where("went_on").select("left_id", least.alias("least"))
    if whole or on.isEmpty():
        return Pruned(pairs, work)
    rest = rights.join(F.broadcast(places), F.col("id") == F.col("_id"), "left_anti").select("id", "vec")
    still = lefts.join(on.groupBy("left_id").agg(F.min("least").alias("least")), "left_id")
    more = topk(still, rest, k, left_id="left_id", right_id="id", left_vec="vec", right_vec="vec", least="least", exclude=(
        None if exclude is None else exclude.select(F.col(exclude_left).alias("left_id"), F.col(exclude_right).alias("right_id"))
        .join(on, "left_id", "left_semi")))
    both = pairs.drop("rank").unionByName(more.drop("rank"))
    w = Window.partitionBy("left_id").orderBy(F.col("score").desc(), F.col("right_id").asc())
    return Pruned(both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), work)
