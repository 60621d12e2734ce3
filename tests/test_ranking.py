"""The ranker behind both exact top-k plans, against brute force."""

import numpy as np
import pytest

from cadenza.operators import vectors as V
from cadenza.operators.ranking import Ranker


def _ranked(left, right, k, block, excluded=(), least=None):
    lengths = np.sqrt(np.einsum("ij,ij->i", right, right))
    order = np.lexsort((np.arange(len(right)), -lengths))
    ranker = Ranker(order.astype(np.int64), right[order], lengths[order], -1.0, block, k)
    place = np.argsort(order)
    pairs = sorted((int(place[j]), i) for i, j in excluded)
    row, position = np.array([i for _, i in pairs], np.int64), np.array([p for p, _ in pairs], np.int64)
    return ranker.rank(left, row, position, least)


def _brute(left, right, k, excluded=()):
    s = np.einsum("id,jd->ij", left, right)
    for i, j in excluded:
        s[i, j] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(right)), s.shape), -s), axis=-1)[:, :k]
    best = np.take_along_axis(s, order, 1)
    return np.where(np.isfinite(best), order, -1), best


@pytest.mark.parametrize("block", [3, 50, 1000])
@pytest.mark.parametrize("scale", [1.0, 1e-120, 1e120])
@pytest.mark.parametrize("kind", ["plain", "ties", "close"])
def test_ranker_equals_brute_force(block, scale, kind):
    rng = np.random.default_rng(3)
    left, right = rng.standard_normal((40, 7)), rng.standard_normal((300, 7))
    if kind == "ties":
        left, right = np.round(left), np.round(right)
    if kind == "close":  # alike in single precision
        right = right[0] + 1e-9 * right
    left[4] = 0
    left, right = left * scale, right * scale
    excluded = {(int(i), int(j)) for i, j in zip(rng.integers(0, 40, 900), rng.integers(0, 300, 900))} | {(9, j) for j in range(297)}
    ids, scores, met, more = _ranked(left, right, 6, block, excluded)
    want, best = _brute(left, right, 6, excluded)
    assert not more.any() and (met <= -(-300 // block)).all()
    ok = np.isfinite(best)
    assert (np.isfinite(scores) == ok).all() and np.allclose(scores[ok], best[ok], rtol=1e-12)
    # sums in another order differ in the last place: only there may neighbours change places
    other = (ids != want) & ok
    s = np.einsum("id,jd->ij", left, right)
    assert kind != "ties" or not other.any() or scale != 1.0
    assert np.allclose(s[np.nonzero(other)[0], ids[other]], best[other], rtol=1e-12)


def test_ranker_wants_nothing_below_a_score():
    rng = np.random.default_rng(4)
    left, right = rng.standard_normal((30, 5)), rng.standard_normal((200, 5))
    want, best = _brute(left, right, 4)
    ids, scores, met, _ = _ranked(left, right, 4, 10, least=best[:, 1])
    assert (ids[:, :2] == want[:, :2]).all() and not np.isfinite(scores[:, 2:]).any()
    assert met.sum() < _ranked(left, right, 4, 10)[2].sum()


def test_blocks_hold_bytes_not_rows():
    # 770,000 by 900,000 rows on 12 slots: 16,384 rows a block ship each row 47 to 55 times
    assert V._block_size(770_000, 900_000, 12, V._BLOCK_BYTES // 400) > 100_000
    assert V._block_size(10 ** 8, 10 ** 8, 12, V._BLOCK_BYTES // 400) == V._BLOCK_BYTES // 400


def test_topk_with_a_least_score(spark):
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((25, 4)), rng.standard_normal((80, 4))
    want, best = _brute(a, b, 3)
    left = spark.createDataFrame([(i, v.tolist(), float(best[i, 1])) for i, v in enumerate(a)], "id long, embedding array<double>, floor double")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "id long, embedding array<double>")
    got = {(r.left_id, r["rank"], r.right_id) for r in V.topk(left, right, 3, block_size=30, least="floor").collect()}
    # the better two of each, a rounding apart from the floor
    assert {(i, 1, int(want[i, 0])) for i in range(25)} <= got and all(r <= 2 for _, r, _ in got)
