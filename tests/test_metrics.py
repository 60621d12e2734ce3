import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import metrics as M

RECS = "user_id string, rank int, artist string"


def _recs(spark, lists):
    return spark.createDataFrame([(u, i + 1, a) for u, items in lists.items() for i, a in enumerate(items)],
                                 RECS)


def _rel(spark, rel):
    return spark.createDataFrame([(u, a) for u, items in rel.items() for a in items],
                                 "user_id string, artist string")


def test_accuracy_hand_example(spark):
    recs = _recs(spark, {"u1": ["a", "b", "c"], "u2": ["x", "y", "z", "w", "v"]})
    rel = _rel(spark, {"u1": ["b", "q"], "u2": ["v"], "u3": ["a"]})
    per = {r.user_id: r for r in M.per_user_accuracy(recs, rel, 5).collect()}
    # precision divides by k even when the list is shorter
    assert per["u1"]["precision_at_5"] == pytest.approx(1 / 5)
    assert per["u1"]["recall_at_5"] == pytest.approx(1 / 2)
    assert per["u1"]["ndcg_at_5"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert per["u2"]["ndcg_at_5"] == pytest.approx((1 / math.log2(6)) / 1.0)
    # a relevant user without a list scores 0 and counts in the mean
    assert per["u3"]["hit_rate_at_5"] == 0.0
    row = M.accuracy_metrics(recs, rel, spark.createDataFrame([(c,) for c in "abcxyzwvq"], "artist string"),
                             5).first()
    assert row.hit_rate_at_5 == pytest.approx(2 / 3)
    assert row.coverage == pytest.approx(8 / 9)


def test_k_zero(spark):
    recs = _recs(spark, {"u1": ["a"]})
    rel = _rel(spark, {"u1": ["a"]})
    r = M.per_user_accuracy(recs, rel, 0).first()
    assert (r.precision_at_0, r.recall_at_0, r.ndcg_at_0, r.hit_rate_at_0) == (0.0, 0.0, 0.0, 0.0)


def _gini_literal(counts):
    c = sorted(counts)
    n, s = len(c), sum(c)
    return 2 * sum((i + 1) * x for i, x in enumerate(c)) / (n * s) - (n + 1) / n


def _ild_literal(items, genre):
    if len(items) < 2:
        return 0.0
    pairs = [(a, b) for i, a in enumerate(items) for b in items[i + 1:]]
    return sum(genre.get(a, "") != genre.get(b, "") for a, b in pairs) / len(pairs)


def test_closed_forms_equal_literal_definitions(spark):
    rnd = random.Random(7)
    genre = {f"i{j}": f"g{j % 4}" for j in range(30) if j % 7}
    lists = {f"u{u}": rnd.sample([f"i{j}" for j in range(30)], rnd.randint(0, 8)) for u in range(60)}
    lists = {u: v for u, v in lists.items() if v}
    recs = _recs(spark, lists)
    genres = spark.createDataFrame(list(genre.items()), "artist string, genre string")
    ild = {r.user_id: r.intra_list_diversity for r in M.intra_list_diversity(recs, genres).collect()}
    for u, items in lists.items():
        assert ild[u] == pytest.approx(_ild_literal(items, genre))
    counts = {}
    for items in lists.values():
        for a in items:
            counts[a] = counts.get(a, 0) + 1
    assert M.gini(recs).first()[0] == pytest.approx(_gini_literal(list(counts.values())))


def test_entropy_counts_missing_genre_in_length(spark):
    recs = _recs(spark, {"u1": ["a", "b", "c", "d"]})
    genres = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2")], "artist string, genre string")
    e = M.shannon_entropy(recs, genres).first().shannon_entropy
    assert e == pytest.approx(-(0.5 * math.log2(0.5) + 0.25 * math.log2(0.25)))


def test_novelty_floor_and_missing(spark):
    recs = _recs(spark, {"u1": ["a", "b"], "u2": ["z"]})
    pop = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "artist string, popularity double")
    nov = {r.user_id: r.novelty_score for r in M.novelty(recs, pop).collect()}
    assert nov["u1"] == pytest.approx((1.0 + -math.log2(1e-10)) / 2)
    assert nov["u2"] == 0.0


def test_ild_features_cosine_matches_pairs(spark):
    rnd = random.Random(3)
    feats = {f"i{j}": [rnd.uniform(-1, 1) for _ in range(5)] for j in range(12)}
    feats["i0"] = [0.0] * 5   # zero vector: cosine 0
    lists = {f"u{u}": rnd.sample(list(feats), rnd.randint(1, 6)) for u in range(20)}
    recs = _recs(spark, lists)
    f = spark.createDataFrame([(k, v) for k, v in feats.items()], "artist string, features array<double>")

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return 0.0 if na == 0 or nb == 0 else sum(x * y for x, y in zip(a, b)) / (na * nb)

    got = {r.user_id: r.intra_list_diversity for r in M.intra_list_diversity_features(recs, f).collect()}
    for u, items in lists.items():
        pairs = [(a, b) for i, a in enumerate(items) for b in items[i + 1:]]
        want = sum(1 - cos(feats[a], feats[b]) for a, b in pairs) / len(pairs) if pairs else 0.0
        assert got[u] == pytest.approx(want, abs=1e-9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")   # lists cross batches
    try:
        eu = {r.user_id: r.intra_list_diversity
              for r in M.intra_list_diversity_features(recs, f, "euclidean").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for u, items in lists.items():
        pairs = [(a, b) for i, a in enumerate(items) for b in items[i + 1:]]
        want = (sum(math.dist(feats[a], feats[b]) for a, b in pairs) / len(pairs)) if pairs else 0.0
        assert eu[u] == pytest.approx(want, abs=1e-9)


def test_serendipity_one_row_and_unknown_genre(spark):
    recs = _recs(spark, {"u1": ["a", "b"], "u2": ["c"]})
    inter = spark.createDataFrame([("u1", "a", 3), ("u2", "b", 1), ("u2", "c", 5)],
                                  "user_id string, artist string, play_count long")
    cat = inter.select("artist").distinct()
    rel = _rel(spark, {"u1": ["b"]})
    row = M.all_metrics(recs, rel, cat, 5, include_serendipity=True, interactions=inter).first()
    # genres=None labels everything 'Unknown': one genre everywhere
    assert row.intra_list_diversity == 0.0 and row.genre_coverage == 1.0
    assert row.catalog_coverage == 1.0 and row.unexpectedness_score == 0.0
    assert 0.0 <= row.gini_coefficient <= 1.0


def test_user_profile_denominator_counts_all_plays(spark):
    inter = spark.createDataFrame([("u1", "a", 1), ("u1", "b", 3)],
                                  "user_id string, artist string, play_count long")
    f = spark.createDataFrame([("a", [1.0, 0.0])], "artist string, features array<double>")
    prof = M.user_profile(inter, f).first().profile
    assert prof == pytest.approx([0.25, 0.0])
    recs = _recs(spark, {"u1": ["a"]})
    ux = M.unexpectedness(recs, M.user_profile(inter, f), f).first().unexpectedness_score
    assert ux == pytest.approx(0.0)   # cosine 1 -> max(0, 0.5 - 1) = 0
    _ = F


def test_one_pass_equals_single_metrics(spark):
    rnd = random.Random(9)
    genre = {f"i{j}": (f"g{j % 4}" if j % 5 else ("" if j % 2 else None)) for j in range(25)}
    lists = {f"u{u}": rnd.sample(list(genre), rnd.randint(1, 7)) for u in range(40)}
    recs = _recs(spark, lists)
    genres = spark.createDataFrame(list(genre.items()), "artist string, genre string")
    pop = spark.createDataFrame([(f"i{j}", j / 24) for j in range(0, 25, 2)], "artist string, popularity double")
    one = {r.user_id: r for r in M.beyond_accuracy_per_user(recs, genres, pop).collect()}
    single = [M.intra_list_diversity(recs, genres), M.genre_coverage(recs, genres),
              M.shannon_entropy(recs, genres), M.novelty(recs, pop)]
    for df in single:
        col = df.columns[1]
        for r in df.collect():
            assert one[r.user_id][col] == pytest.approx(r[col], abs=1e-12), col


def test_profile_skips_users_without_plays(spark):
    inter = spark.createDataFrame([("u1", "a", 0), ("u2", "a", 2)], "user_id string, artist string, play_count long")
    f = spark.createDataFrame([("a", [1.0, 0.0])], "artist string, features array<double>")
    assert [r.user_id for r in M.user_profile(inter, f).collect()] == ["u2"]
