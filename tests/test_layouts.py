"""Daily sketches, the bitmap index, the bucketed layout and spread joins."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cadenza.operators import daily as DY
from cadenza.operators import explore as X
from cadenza.operators import itemindex as IX
from cadenza.operators import ordering as O
from cadenza.operators import prepare as P
from cadenza.operators import recommend as RC
from cadenza.sources import layout as LY


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = [(f"u{min(int(rng.expovariate(0.02)), 399)}", f"a{rng.randrange(60)}", rng.randrange(9) + 1, f"2020-0{rng.randrange(1, 7)}-1{rng.randrange(10)}")
            for _ in range(6000)]
    data += [("hot", f"a{i % 60}", 1, "2020-03-11") for i in range(3000)] + [(None, "a1", 1, "2020-01-10"), ("u1", None, 1, "2020-01-10"),
                                                                           ("u1", "a1", 1, None)]
    return spark.createDataFrame(data, "user_id string, artist string, play_count long, d string").withColumn(
        "interaction_date", F.to_date("d")).drop("d")


def test_days_tell_every_split(rows):
    days = DY.daily_sketches(rows).checkpoint()
    for date in ("2020-01-01", "2020-03-11", "2020-06-19", "2021-01-01"):
        want = X.split_stats(P.label_split(rows, split_date=date)).first().asDict()
        assert DY.split_stats_from_days(days, date).first().asDict() == want
    by_ratio = DY.split_stats_from_days(days, train_ratio=0.5).first()
    assert by_ratio.asDict() == X.split_stats(P.label_split(rows, train_ratio=0.5)).first().asDict()
    parts = DY.daily_sketches(rows.where("play_count > 3")).unionByName(DY.daily_sketches(rows.where("play_count <= 3")))
    assert DY.split_stats_from_days(DY.merge_days(parts), "2020-03-11").first() == DY.split_stats_from_days(days, "2020-03-11").first()
    s = DY.summary_from_days(days).first()
    assert (s.n_users, s.n_items, s.n_rows) == (rows.select("user_id").distinct().count() - 1, 60, rows.count() - 1)


def test_small_sketches_keep_their_error_bound(spark):
    df = spark.range(200_000).select((F.col("id") % 60_000).cast("string").alias("user_id"), (F.col("id") * 7 % 45_000).cast("string").alias("artist"),
                                     F.lit(1).alias("play_count"), F.expr("date_add(DATE'2020-01-01', cast(id % 97 as int))").alias("interaction_date"))
    lg = 12
    got = DY.split_stats_from_days(DY.daily_sketches(df, lg=lg), "2020-02-20", lg=lg).first()
    want = X.split_stats(P.label_split(df, split_date="2020-02-20")).first()
    rse = 2 ** (-lg / 2)
    for c in ("train_users", "train_items", "test_users", "test_items"):
        assert abs(got[c] / want[c] - 1) < 4 * rse, c
    for kind in ("users", "items"):
        union = want[f"train_{kind}"] + want[f"test_{kind}"] - want[f"common_{kind}"]
        assert abs(got[f"common_{kind}"] - want[f"common_{kind}"]) < 4 * rse * (union * want[f"common_{kind}"]) ** 0.5
    assert got.train_interactions == want.train_interactions and got.test_max_date == want.test_max_date


def test_days_of_an_empty_table(rows):
    one = DY.split_stats_from_days(DY.daily_sketches(rows.limit(0)), "2020-01-01").first()
    assert (one.train_users, one.common_items, one.test_interactions, one.train_min_date) == (0, 0, 0, None)
    assert tuple(DY.summary_from_days(DY.daily_sketches(rows.limit(0))).first()) == (0, 0, 0)


def test_index_answers_many_lists(spark, rows, monkeypatch):
    rng = random.Random(2)
    lists = {i: [f"a{rng.randrange(66)}" for _ in range(rng.randrange(1, 5))] for i in range(40)}
    lists[40], lists[41], lists[42] = ["", "  "], [" a1 ", "a1"], ["a1", "no such"]
    frame = spark.createDataFrame([(i, a) for i, x in lists.items() for a in x], "list_id long, artist string")
    users, index = IX.build(rows)
    have = {}
    for r in rows.collect():
        if r.user_id is not None and r.artist is not None:
            have.setdefault(r.user_id, set()).add(r.artist)
    want = {i: {u for u, a in have.items() if {x.strip() for x in names} - {""} <= a} if "".join(names).strip() else set()
            for i, names in lists.items()}
    got = {i: set() for i in lists}
    for r in IX.users_by_lists(index, frame, users).collect():
        got[r.list_id].add(r.user_id)
    assert got == want and want[41]
    counts = {r.list_id: (r.n_items, r.n_users) for r in IX.count_by_lists(index, frame).collect()}
    assert counts == {i: (len({x.strip() for x in names} - {""}), len(want[i])) for i, names in lists.items()}
    assert {r.user_id for r in X.users_by_all_items(rows, lists[41]).collect()} - {None} == want[41]


def test_index_over_several_segments(spark):
    n = IX.SEGMENT + 500
    df = spark.range(n).select(F.format_string("%06d", "id").alias("user_id"), F.lit("x").alias("artist"))
    df = df.unionByName(df.where("user_id % 5000 = 7").withColumn("artist", F.lit("y")))
    users, index = IX.build(df)
    wanted = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "list_id int, artist string")
    assert index.count() == 3
    assert {r.list_id: r.n_users for r in IX.count_by_lists(index, wanted).collect()} == {1: 7, 2: n}
    got = sorted(int(r.user_id) for r in IX.users_by_lists(index, wanted.where("list_id = 1"), users).collect())
    assert got == [7 + 5000 * i for i in range(7)]


def test_list_counts_over_runs_and_parts(spark, monkeypatch):
    """Small bounds deal segments and sets over many groups; no list's bitmap is shuffled."""
    n = 3 * IX.SEGMENT + 9
    df = spark.range(n).select(F.format_string("%06d", "id").alias("user_id"), F.explode(F.expr(
        "filter(array('x', 'y', 'z'), (v, i) -> i = 0 OR id % (5 * i) = 0)")).alias("artist"))
    _, index = IX.build(df)
    lists = [(i, a) for i in range(30) for a in "xyzw"[:i % 4 + 1]] + [(40, " "), (41, None), (None, "x"), (42, "z"), (42, "y ")]
    frame = spark.createDataFrame(lists, "list_id int, artist string")
    size = {1: n, 2: -(-n // 5), 3: -(-n // 10), 4: 0}
    want = {i: (i % 4 + 1, size[i % 4 + 1]) for i in range(30)} | {40: (0, 0), 41: (0, 0), None: (1, 0), 42: (2, -(-n // 10))}
    monkeypatch.setattr(IX, "_CELLS", 3000)
    for bounds in ({}, {"group_bitmaps": 1, "group_sets": 2}):
        found = IX.count_by_lists(index, frame, **bounds)
        assert {r.list_id: (r.n_items, r.n_users) for r in found.collect()} == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "bitmap_and_agg" not in plan
    assert IX.count_by_lists(index, frame.limit(0)).collect() == []
    assert [tuple(r) for r in IX.count_by_lists(index.limit(0), frame.where("list_id = 42")).collect()] == [(42, 2, 0)]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_bucketed_plans_shuffle_nothing(spark, rows, tmp_path):
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    for c, v in zip(before, ("-1", "false")):
        spark.conf.set(c, v)
    try:
        seen = LY.write_bucketed(rows.where("user_id IS NOT NULL"), "seen_by_user", str(tmp_path / "a"), 8)
        wanted = LY.write_bucketed(rows.where("play_count > 5").select("user_id", "artist", "play_count"), "wanted_by_user", str(tmp_path / "b"), 8)
        assert _exchanges(P.interaction_triples(seen)) == 0  # A1
        assert _exchanges(RC.exclude_seen(wanted, seen.where("play_count < 3"), item_col="artist")) == 0  # J5
        assert _exchanges(X.user_history(seen)) == 0  # P3
        assert _exchanges(P.interaction_triples(rows)) == 1
        for f in (P.interaction_triples, X.user_history):
            assert sorted(map(repr, f(seen).collect())) == sorted(map(repr, f(rows.where("user_id IS NOT NULL")).collect()))
        # a session that does not know the table
        spark.sql("DROP TABLE seen_by_user")
        again = LY.attach(spark, "seen_again", str(tmp_path / "a"))
        assert again.schema == seen.schema and _exchanges(P.interaction_triples(again)) == 0
        assert again.count() == rows.where("user_id IS NOT NULL").count()
        assert LY.attach(spark, "seen_again", str(tmp_path / "a")).count() == again.count()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
        for t in ("seen_by_user", "wanted_by_user", "seen_again"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_spread_join_is_the_join(spark):
    rng = random.Random(4)
    left = spark.createDataFrame([(rng.choice("aabbc"), i) for i in range(300)] + [("h", 1000 + i) for i in range(500)] + [(None, -1)], "k string, x long")
    right = spark.createDataFrame([(rng.choice("abbd"), i) for i in range(90)] + [("h", i) for i in range(40)] + [(None, -2)], "k string, y long")
    want = sorted((r.k, r.x, r.y) for r in left.join(right, "k").collect())
    for hot in (1, 50, 1000, 10 ** 9):
        got = O.spread_join(left, right, "k", hot_pairs=hot)
        assert sorted((r.k, r.x, r.y) for r in got.collect()) == want
        assert sorted((r.k, r.x, r.y) for r in O.spread_join(right, left, "k", hot_pairs=hot).collect()) == want


def test_spread_join_deals_a_hot_key(spark):
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for c, v in zip(old, ("16", "false", "-1")):
        spark.conf.set(c, v)
    try:
        left = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id") % 400).alias("k"), F.col("id").alias("x"))
        right = spark.range(4000).select((F.col("id") % 400).alias("k"), F.col("id").alias("y"))

        def largest(df):
            n = sorted(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())
            return n[-1] / statistics.median(n)
        assert largest(left.join(right, "k")) > 10
        assert largest(O.spread_join(left, right, "k", hot_pairs=100)) <= 3
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
