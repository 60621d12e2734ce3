"""The best right rows of many left rows by dot product, inside a task.

Right rows lie by falling length, cut into blocks.  A left row meets them one after
the other and stops when its k-th best score is above its own length times that of
the next block's longest vector (Cauchy-Schwarz).

A block's scores are first computed in single precision, of vectors scaled to
entries of at most 1.  Their error is bounded by the vectors' lengths, so a pair that
falls short of the k-th best score by more than that bound is out; the few others are
scored in double precision, and these scores alone decide.
"""

from __future__ import annotations

import numpy as np

# a bound is taken a little larger than computed: rounding must not skip an equal score
_SLACK = 1 + 1e-9
# rounding of a single-precision number; a number below which scaled scores may vanish
_EPS, _TINY = 2.0 ** -24, 1e-30
# pairs scored at once in double precision
_PAIRS = 50_000


def _scaled(x: np.ndarray, by: np.ndarray | float) -> np.ndarray:
    return (x / by).astype(np.float32)


class Ranker:
    """Right rows ``ids, vecs, lengths`` by falling length.  ``rest`` is the length of
    the longest right vector that is not among them (negative: there is none)."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, lengths: np.ndarray, rest: float, block_rows: int, k: int):
        self.ids, self.vecs, self.k = ids, vecs, k
        self.starts = np.arange(0, len(ids), block_rows)
        self.stops = np.minimum(self.starts + block_rows, len(ids))
        # length of each block's longest vector, and of the rest's
        self.longest = np.append(lengths[self.starts], rest)
        self._rough = None

    def rough(self):
        """Scaled vectors, what they were divided by, and the scaled length of each
        block's longest; made where they are used."""
        if self._rough is None:
            top = float(np.abs(self.vecs).max(initial=0.0))
            top = top if 0 < top < np.inf else 1.0
            vecs = _scaled(self.vecs, top)
            squares = np.einsum("ij,ij->i", vecs, vecs, dtype=np.float64)
            sizes = np.sqrt(np.maximum.reduceat(squares, self.starts)) if len(self.starts) else np.zeros(0)
            self._rough = vecs, top, sizes
        return self._rough

    def rank(self, left: np.ndarray, row: np.ndarray, position: np.ndarray, least: np.ndarray | None = None):
        """Best ids and scores of each left vector (-1 and -inf where there are
        fewer than k), blocks met, and whether the rest may hold better ones.
        ``row, position``: excluded pairs, by ascending position.  ``least``: per left
        row a score below which nothing is wanted."""
        m, k = len(left), self.k
        best_id = np.full((m, k), -1, np.int64)
        best = np.full((m, k), -np.inf)
        # what a pair has to reach
        bar = np.full(m, -np.inf) if least is None else least.astype(np.float64)
        met = np.zeros(m, np.int64)
        length = np.sqrt(np.einsum("ij,ij->i", left, left)) * _SLACK
        vecs, top, sizes = self.rough()
        unit = np.abs(left).max(axis=1, initial=0.0)
        unit = np.where((unit > 0) & np.isfinite(unit), unit, 1.0)
        scaled = _scaled(left, unit[:, None])
        error = (left.shape[1] + 8) * _EPS * np.sqrt(np.einsum("ij,ij->i", scaled, scaled, dtype=np.float64))
        active = np.arange(m)
        # written anew for every block
        widest = int((self.stops - self.starts).max(initial=0))
        cells = np.empty(m * widest, np.float32)
        for b, (lo, hi) in enumerate(zip(self.starts, self.stops)):
            active = active[length[active] * self.longest[b] >= bar[active]]
            if not len(active):
                break
            met[active] += 1
            shape = len(active), hi - lo
            s = np.matmul(scaled[active], vecs[lo:hi].T, out=cells[:shape[0] * shape[1]].reshape(shape))
            x0, x1 = np.searchsorted(position, [lo, hi])
            if x1 > x0:
                at = np.full(m, -1)
                at[active] = np.arange(len(active))
                r = at[row[x0:x1]]
                s[r[r >= 0], position[x0:x1][r >= 0] - lo] = -np.inf
            slack = error[active] * sizes[b] + _TINY
            need = bar[active] / unit[active] / top - slack
            short = np.flatnonzero(bar[active] == -np.inf)
            if len(short) and hi - lo > k:
                # k pairs of this block reach the k-th rough score less its error
                kth = np.partition(s[short], hi - lo - k, axis=1)[:, hi - lo - k]
                need[short] = np.maximum(need[short], kth - 2 * slack[short])
            need = need.astype(np.float32)
            rows = np.flatnonzero(s.max(axis=1) >= need)
            if not len(rows):
                continue
            r, c = np.divmod(np.flatnonzero((s[rows] >= need[rows, None]).ravel()), hi - lo)
            r = rows[r]
            there = s[r, c] > -np.inf
            r, c = active[r[there]], lo + c[there]
            scores = np.concatenate([np.einsum("ij,ij->i", left[r[i:i + _PAIRS]], self.vecs[c[i:i + _PAIRS]])
                                     for i in range(0, len(r), _PAIRS)] or [np.zeros(0)])
            good = np.isfinite(scores) & (scores >= bar[r])
            self._merge(best_id, best, r[good], self.ids[c[good]], scores[good])
            bar[active] = np.maximum(bar[active], best[active, -1])
        more = (length * self.longest[-1] >= bar) & (self.longest[-1] >= 0)
        return best_id, best, met, more

    def _merge(self, best_id, best, r, ids, scores) -> None:
        """Puts the pairs (``r`` ascending) among the best of their rows, by score, then id."""
        k = self.k
        rows, first, counts = np.unique(r, return_index=True, return_counts=True)
        # rows with many equal scores apart: the others need few columns
        for those in (np.flatnonzero(counts <= 2 * k), np.flatnonzero(counts > 2 * k)):
            if not len(those):
                continue
            n, who = counts[those], rows[those]
            at = np.repeat(np.arange(len(those)), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pick = np.repeat(first[those], n) + inside
            grid = np.full((len(those), k + n.max()), -np.inf)
            grid_id = np.full(grid.shape, -1, np.int64)
            grid[:, :k], grid_id[:, :k] = best[who], best_id[who]
            grid[at, k + inside], grid_id[at, k + inside] = scores[pick], ids[pick]
            order = np.lexsort((grid_id, -grid), axis=-1)[:, :k]
            best[who], best_id[who] = np.take_along_axis(grid, order, 1), np.take_along_axis(grid_id, order, 1)
