import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators import recommend as RC
from cadenza.operators import vectors as V
from cadenza.operators.reasons import item_reasons


def _vecs(spark, ids, dim, seed, col="embedding", id_col="id", ties=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(len(ids), dim))
    if ties:
        x = np.round(x)           # many equal scores
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)],
                                 f"{id_col} long, {col} array<double>"), x


def _brute(a, b, lid, rid, k, excl=frozenset(), self_ex=False):
    out = {}
    s = a @ b.T
    for i, li in enumerate(lid):
        cand = [(-s[i, j], rj, s[i, j]) for j, rj in enumerate(rid)
                if (li, rj) not in excl and not (self_ex and li == rj)]
        cand.sort()
        out[li] = [(rj, sc) for _, rj, sc in cand[:k]]
    return out


@pytest.mark.parametrize("block,chunk", [(7, 8_000_000), (64, 100), (None, 50)])
def test_blocked_topk_equals_brute_force(spark, block, chunk):
    lid, rid = list(range(40)), list(range(100, 160))
    left, a = _vecs(spark, lid, 4, 1, ties=True)
    right, b = _vecs(spark, rid, 4, 2, ties=True)
    rng = np.random.default_rng(5)
    excl = {(int(u), int(v)) for u, v in zip(rng.choice(lid, 300), rng.choice(rid, 300))}
    ex = spark.createDataFrame(sorted(excl), "left_id long, right_id long")
    got = V.topk(left, right, 6, exclude=ex, block_size=block, chunk_cells=chunk).collect()
    want = _brute(a, b, lid, rid, 6, excl)
    by = {}
    for r in got:
        by.setdefault(r.left_id, []).append((r.rank, r.right_id, r.score))
    for li in lid:
        rows = sorted(by.get(li, []))
        assert [rank for rank, _, _ in rows] == list(range(1, len(rows) + 1))
        assert [(rj, pytest.approx(sc)) for _, rj, sc in rows] == want[li]


def test_similar_excludes_self_and_zero_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0, 1.0])],
                               "id long, embedding array<double>")
    got = V.similar(df, 3, block_size=2).where("left_id = 1").orderBy("rank").collect()
    assert [r.right_id for r in got] == [4, 2, 3]
    assert [round(r.similarity, 6) for r in got] == [round(1 / np.sqrt(2), 6), 0.0, -1.0]


def _greedy_literal(rel, vecs, lam, n):
    u = [v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v * 0 for v in vecs]
    if len(rel) <= n:
        return list(range(len(rel)))
    chosen = []
    while len(chosen) < n:
        best, best_s = None, None
        for i in range(len(rel)):
            if i in chosen:
                continue
            ms = max([0.0] + [float(u[i] @ u[j]) for j in chosen])
            s = lam * rel[i] - (1 - lam) * ms
            if best_s is None or s > best_s:
                best, best_s = i, s
        chosen.append(best)
    return chosen


@pytest.mark.parametrize("lam", [0.0, 0.3, 1.0])
def test_mmr_batched_equals_literal_greedy(spark, lam):
    rng = np.random.default_rng(11)
    rows, expect = [], {}
    for u in range(30):
        m = int(rng.integers(1, 12))   # includes pools of at most n
        rel = np.sort(rng.normal(size=m))[::-1]
        vecs = rng.normal(size=(m, 3))
        for r in range(m):
            rows.append((u, r + 1, 1000 + u * 20 + r, float(rel[r]), [float(x) for x in vecs[r]]))
        expect[u] = [1000 + u * 20 + i for i in _greedy_literal(rel, vecs, lam, 4)]
    pool = spark.createDataFrame(rows, "user_id long, rank int, item_id long, score double, "
                                       "item_vec array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")   # force carry-over
    try:
        got = RC.mmr_rerank(pool, None, lam, 4, pool_vec_col="item_vec").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in got:
        by.setdefault(r.user_id, []).append((r.rank, r.item_id))
    for u, want in expect.items():
        assert [i for _, i in sorted(by[u])] == want


def test_top_n_unseen_never_returns_seen(spark):
    users, _ = _vecs(spark, range(10), 3, 4, id_col="user_id")
    items, _ = _vecs(spark, range(8), 3, 5, id_col="item_id")
    seen = spark.createDataFrame([(u, i) for u in range(10) for i in range(8) if (u + i) % 3 == 0],
                                 "user_id long, item_id long")
    recs = RC.top_n_unseen(users, items, seen, 5, block_size=3)
    assert recs.join(seen, ["user_id", "item_id"], "left_semi").count() == 0
    w = recs.groupBy("user_id").agg(F.count("*").alias("n"), F.max("rank").alias("mx"))
    assert all(r.n == r.mx <= 5 for r in w.collect())


def test_status_and_reasons(spark):
    users, _ = _vecs(spark, range(5), 3, 6, id_col="user_id")
    items, _ = _vecs(spark, range(6), 3, 7, id_col="item_id")
    seen = spark.createDataFrame([(0, 1), (0, 2)], "user_id long, item_id long")
    wanted = spark.createDataFrame([(0,), (9,)], "user_id long")
    recs = RC.top_n_unseen(users, items, seen, 3, users=wanted)
    st = {r.user_id: r.status for r in RC.recommend_status(wanted, users, recs).collect()}
    assert st == {0: "ok", 9: "unknown_user"}
    rs = item_reasons(recs, seen, items).collect()
    assert len(rs) == 3
    assert all((r.reason == "popularity") == (r.reason_item is None) for r in rs)
    assert all(r.similarity is None or r.similarity > 0 for r in rs)


def test_user_based_negative_similarity_subtracts(spark):
    uv = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.9, 0.1])],
                               "user_id long, embedding array<double>")
    inter = spark.createDataFrame([(2, 10, 5), (3, 10, 1), (3, 11, 2), (1, 12, 1)],
                                  "user_id long, item_id long, play_count long")
    got = RC.user_based_recommend(inter, uv, 5, 2).where("user_id = 1").orderBy("rank").collect()
    s3 = 0.9 / np.sqrt(0.82)
    assert [r.item_id for r in got] == [11, 10]
    assert got[0].score == pytest.approx(2 * s3)
    assert got[1].score == pytest.approx(1 * s3 - 5)
    _ = pd


def test_adaptive_block_size():
    assert V._block_size(15000, 20000, 8) == 3061
    assert V._block_size(10, 10, 8) == 512
    assert V._block_size(12_000_000, 20_000_000, 4000) == 16384


def test_topk_exclusions_travel_as_lists(spark):
    """A left row's excluded ids of a block are one row, as 64-bit numbers, and
    vectors stay Arrow columns: no Python object for a pair or a vector."""
    rng = np.random.default_rng(5)
    vecs = rng.standard_normal((60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, embedding array<double>")
    pairs = [(i, j) for i in range(60) for j in range(60) if (i * 7 + j) % 3] * 2 + [(3, None), (None, 4), (99, 1), (1, 99)]
    seen = spark.createDataFrame(pairs, "left_id long, right_id long")
    found = V.topk(df, df, 5, exclude=seen, block_size=16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "collect_set(other" in plan
    held = set(pairs)
    want = {(i, r, j) for i in range(60) for r, j in enumerate(sorted(
        (j for j in range(60) if (i, j) not in held), key=lambda j: (-(vecs[i] @ vecs[j]), j))[:5], 1)}
    assert {(r.left_id, r["rank"], r.right_id) for r in found.collect()} == want
    bad = spark.createDataFrame([(1, None), (2, [1.0] * 4)], "id long, embedding array<double>")
    with pytest.raises(Exception, match="vectors must be given"):
        V.topk(bad, df, 5).collect()


def test_item_reasons_shuffle_no_pairs(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "item_id long, embedding array<double>")
        seen = spark.createDataFrame([(1, 0), (1, 2), (1, 9), (2, 9), (None, 1)], "user_id long, item_id long")
        recs = spark.createDataFrame([(1, 1, 3), (1, 2, 8), (2, 1, 3), (None, 1, 1), (3, 1, 1)], "user_id long, rank int, item_id long")
        found = item_reasons(recs, seen, items)
        plan = found._jdf.queryExecution().executedPlan().toString()
        # the pairs stay where the join by user made them
        assert "hashpartitioning(user_id" in plan and "rank" not in "".join(
            line for line in plan.splitlines() if "hashpartitioning" in line)
        got = {(r.user_id, r.item_id): (r.reason_item, r.reason) for r in found.collect()}
        assert got == {(1, 3): (2, "similar_item"), (1, 8): (None, "popularity"), (2, 3): (None, "popularity"),
                       (None, 1): (None, "popularity"), (3, 1): (None, "popularity")}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
