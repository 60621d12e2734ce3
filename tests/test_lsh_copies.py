"""What the signatures' plan copies, and that its similarities are exact all the same."""

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import lsh as L
from cadenza.operators import vectors as V


def test_bands_hold_no_exact_vector(spark):
    x = np.random.default_rng(11).standard_normal((150, 9))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    unit = V.unit_vectors(df).withColumnRenamed("embedding", "vec")
    setting = L.Bands(1, 30)
    codes = L._codes(unit, setting, 42).checkpoint()
    # one row a vector, whatever the number of bands, and nothing in double precision
    assert codes.count() == 150 and codes.select(F.size("codes")).distinct().collect() == [(30,)]
    assert not any("double" in kind for _, kind in codes.dtypes)
    found = L.similar_lsh(df, 5, setting=setting).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    want = np.argsort(-s, axis=1)[:, :5]
    assert {(r.left_id, r["rank"], r.right_id) for r in found} == {(i, n, int(j)) for i in range(150) for n, j in enumerate(want[i], 1)}
    assert all(abs(r.similarity - s[r.left_id, r.right_id]) < 1e-12 for r in found)


def test_split_buckets_are_found_by_broadcast_or_join(spark, monkeypatch):
    x = np.random.default_rng(12).standard_normal((400, 6))
    x[100:250] = x[7] + 1e-12 * x[100:250]  # no sign parts these
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    lists = []
    for few in (L.FEW, 0):
        monkeypatch.setattr(L, "FEW", few)
        lists.append(sorted((r.left_id, r["rank"], r.right_id) for r in L.similar_lsh(df, 3, setting=L.Bands(2, 6), max_bucket=50).collect()))
    assert lists[0] == lists[1] and len(lists[0]) > 1000
