"""Lists from neighbours, against sums written out."""

import numpy as np


def test_user_based_candidates_are_shuffled_by_user_once(spark):
    from cadenza.operators import recommend as RC
    rng = np.random.default_rng(9)
    vecs = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(20)], "user_id long, embedding array<double>")
    cells = [(int(u), int(i), int(rng.integers(1, 5))) for u in range(20) for i in rng.choice(30, 6, replace=False)] + [(3, None, 2), (None, 4, 1)]
    plays = spark.createDataFrame(cells, "user_id long, item_id long, play_count long")
    got = RC.user_based_recommend(plays, vecs, 4, 3)
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
    near = {}
    for r in RC.similar_users(vecs, 3).collect():
        near.setdefault(r.user_id, []).append((r.similar_user, r.similarity))
    have = {(u, i) for u, i, _ in cells if u is not None and i is not None}
    want = set()
    for u, others in near.items():
        score = {}
        for o, sim in others:
            for v, i, n in cells:
                if v == o and (u, i) not in have:
                    score[i] = score.get(i, 0.0) + sim * n
        best = sorted(score, key=lambda i: (-round(score[i], 9), -1 if i is None else i))[:4]
        want |= {(u, r, i) for r, i in enumerate(best, 1)}
    assert {(r.user_id, r["rank"], r.item_id) for r in got.collect()} == want


def test_a_vector_is_measured_once(spark):
    from cadenza.operators import vectors as V
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, embedding array<double>")
    unit = V.unit_vectors(df)
    assert {r.id: r.embedding for r in unit.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None}
    # the sum is no part of what is done for an element
    plan = unit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") == 1
