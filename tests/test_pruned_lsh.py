"""Pruned exact top-k and neighbours by signatures, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import lsh as L
from cadenza.operators import pruned as P
from cadenza.operators import recommend as RC
from cadenza.operators import vectors as V


def _frame(spark, x, name="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<double>")


def _brute(left, right, k, excluded=frozenset()):
    out = {}
    s = left @ right.T
    for i in range(len(left)):
        order = [j for j in np.lexsort((np.arange(len(right)), -np.round(s[i], 9))) if (i, j) not in excluded][:k]
        out[i] = order
    return out, s


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    left = rng.standard_normal((90, 8))
    left[5] = 0
    right = rng.standard_normal((400, 8)) * (1 / np.arange(1, 401))[rng.permutation(400), None]
    right[17] = right[18]  # a tie
    excluded = {(int(i), int(j)) for i in range(90) for j in rng.integers(0, 400, 20)}
    excluded |= {(7, j) for j in range(395)}  # nearly everything
    ex = spark.createDataFrame(sorted(excluded), "left_id long, right_id long")
    return left, right, excluded, ex


@pytest.mark.parametrize("head_bytes", [1, 8 * 10 * 60, 1 << 20])
@pytest.mark.parametrize("block_rows", [7, 64])
@pytest.mark.parametrize("excluding", [True, False])
def test_pruned_equals_brute_force(spark, vectors, head_bytes, block_rows, excluding):
    left, right, excluded, ex = vectors
    got = P.topk_pruned(_frame(spark, left), _frame(spark, right), 6, exclude=ex if excluding else None,
                        head_bytes=head_bytes, block_rows=block_rows)
    want, s = _brute(left, right, 6, excluded if excluding else frozenset())
    lists = {}
    for r in got.lists.collect():
        lists.setdefault(r.left_id, []).append((r.rank, r.right_id, r.score))
    for i in range(len(left)):
        mine = sorted(lists.get(i, []))
        assert [x[1] for x in mine] == [int(j) for j in want[i]], i
        assert [x[0] for x in mine] == list(range(1, len(mine) + 1))
        assert np.allclose([x[2] for x in mine], s[i][want[i]])
    work = got.work.collect()
    assert len(work) == len(left)
    if head_bytes == 1 << 20:
        assert not any(r.went_on for r in work)
        assert sum(r.blocks_met for r in work) < 0.7 * sum(r.blocks for r in work)  # most is skipped
    else:
        assert any(r.went_on for r in work)


def test_pruned_edges(spark, vectors):
    left, right, _, ex = vectors
    nothing = _frame(spark, right).limit(0)
    got = P.topk_pruned(_frame(spark, left), nothing, 3)
    assert got.lists.count() == 0 and got.work.count() == len(left)
    assert P.topk_pruned(_frame(spark, left).limit(0), _frame(spark, right), 3, exclude=ex).lists.count() == 0
    few = P.topk_pruned(_frame(spark, left), _frame(spark, right[:2]), 5)
    assert few.lists.groupBy("left_id").count().where("count <> 2").count() == 0
    with pytest.raises(ValueError):
        P.topk_pruned(_frame(spark, left), _frame(spark, right), 0)


def test_pruned_lists_are_those_of_the_blocked_plan(spark, vectors):
    left, right, _, ex = vectors
    users, items = _frame(spark, left, "user_id"), _frame(spark, right, "item_id")
    seen = ex.toDF("user_id", "item_id")
    wanted = users.where("user_id % 3 = 0").select("user_id")
    a, b = (sorted((r.user_id, r.rank, r.item_id, round(r.score, 9)) for r in RC.top_n_unseen(
        users, items, seen, 5, users=wanted, pruned=p).collect()) for p in (True, False))
    assert a == b and len(a) == 5 * 30


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((25, 16))
    return np.vstack([centres[rng.integers(0, 25, 1200)] + 0.5 * rng.standard_normal((1200, 16))])


def test_neighbours_by_signature_reach_their_recall(spark, clusters):
    df = _frame(spark, clusters)
    unit = V.unit_vectors(df).withColumnRenamed("embedding", "vec")
    setting = L.tune(unit, 10, 0.95, copy_cost=1.0)
    assert setting.recall >= 0.95 and setting.compared < 0.6
    found = L.similar_lsh(df, 10, setting=setting).checkpoint()
    got = L.recall(found, V.similar(df, 10)).first()
    assert got.links == 12000 and got.recall >= 0.9
    u = clusters / np.linalg.norm(clusters, axis=1, keepdims=True)
    for r in found.collect():
        assert r.left_id != r.right_id and r.similarity == pytest.approx(u[r.left_id] @ u[r.right_id])
    ranks = found.groupBy("left_id").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.countDistinct("right_id").alias("d"))
    assert ranks.where("n <> m OR n <> d OR n > 10").count() == 0


def test_large_buckets_are_split(spark, clusters):
    df = _frame(spark, clusters)
    setting = L.Bands(2, 12)
    whole = L.recall(L.similar_lsh(df, 5, setting=setting), V.similar(df, 5)).first().recall
    split = L.similar_lsh(df, 5, setting=setting, max_bucket=60).checkpoint()
    part = L.recall(split, V.similar(df, 5)).first().recall
    assert whole > 0.95 and 0.5 < part <= whole
    # all bands of all rows, none larger than allowed by much: the codes are split by their own signs
    unit = V.unit_vectors(df).withColumnRenamed("embedding", "vec")
    codes = L._codes(unit, setting, 42).checkpoint()
    assert L._depths(codes, setting, 60) is not None and L._depths(codes, setting, 10 ** 6) is None


def test_equal_vectors_are_one_row(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 6))
    x[20:50] = x[3]  # a large group of copies
    x[55] = 0
    df = _frame(spark, x)
    found = L.similar_lsh(df, 4, setting=L.Bands(1, 30), max_bucket=10_000).collect()
    lists = {}
    for r in found:
        lists.setdefault(r.left_id, []).append((r.rank, r.right_id, round(r.similarity, 9)))
    assert 55 not in lists and all(55 != y[1] for v in lists.values() for y in v)
    u = np.delete(x, 55, 0) / np.linalg.norm(np.delete(x, 55, 0), axis=1, keepdims=True)
    ids = np.delete(np.arange(60), 55)
    s = np.round(u @ u.T, 9)
    for a, i in enumerate(ids):
        order = [j for j in np.lexsort((ids, -s[a])) if ids[j] != i][:4]
        assert [y[1] for y in sorted(lists[i])] == [int(ids[j]) for j in order], i


def test_neighbours_of_few_rows(spark):
    x = np.eye(3)
    assert L.similar_lsh(_frame(spark, x[:1]), 3).count() == 0
    assert L.similar_lsh(_frame(spark, x).limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        L.similar_lsh(_frame(spark, x), 0)


def test_lsh_holds_few_cells_at_once(spark, monkeypatch):
    """Any bound on the numbers held at once gives the same lists."""
    from cadenza.operators import lsh as H
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((120, 6)))], "id long, embedding array<double>")
    lists = []
    for cells in (H._CELLS, 300):
        monkeypatch.setattr(H, "_CELLS", cells)
        lists.append({(r.left_id, r["rank"], r.right_id) for r in H.similar_lsh(df, 3).collect()})
    assert H._CELLS == 300 and lists[0] == lists[1] and len(lists[0]) > 300
