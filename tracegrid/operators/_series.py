"""Numpy kernels over many short series at once (sorted rows, one integer group code each)."""

from __future__ import annotations

import numpy as np

#: Longest excursion that counts as a spike, and neighbours looked at on either side.
WIDEST, SIDE = 3, 3


def shifted(a: np.ndarray, g: np.ndarray, k: int) -> np.ndarray:
    """``a`` of the row k before (k > 0) or after (k < 0) in the same group, NaN outside."""
    out = np.full(len(a), np.nan)
    if k == 0:
        out[:] = a
    elif abs(k) < len(a):
        if k > 0:
            out[k:] = np.where(g[k:] == g[:-k], a[:-k], np.nan)
        else:
            out[:k] = np.where(g[:k] == g[-k:], a[-k:], np.nan)
    return out


def second_difference(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """x less the mean of both neighbours; NaN at the ends of a group."""
    return x - 0.5 * (shifted(x, g, 1) + shifted(x, g, -1))


def _neighbour(n: int, g: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row at + k and whether it exists in the same group."""
    j = at + k
    ok = (j >= 0) & (j < n)
    j = np.clip(j, 0, n - 1)
    return j, ok & (g[j] == g[at])


def excursions(x: np.ndarray, t: np.ndarray, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the one to three rows starting at each row of ``at`` leave the course around them.

    Returns (deviation, width) with the width of the largest deviation.  The
    course is a line through up to three rows on either side whose slope comes
    from differences within the sides, once over positions and once over times;
    the smaller deviation counts.  Zero where the course does not resume: where a
    side has fewer than two rows, or the sides disagree by half the deviation or
    scatter by a third of it.
    """
    n, m = len(x), len(at)
    best, width = np.zeros(m), np.zeros(m, dtype=np.int64)
    if not m:
        return best, width
    reach = range(-SIDE, WIDEST + SIDE)
    rows = {k: _neighbour(n, g, at, k) for k in reach}
    X = {k: x[rows[k][0]] for k in reach}
    U = {"position": {k: np.full(m, float(k)) for k in reach}, "time": {k: t[rows[k][0]] - t[at] for k in reach}}
    for w in range(1, WIDEST + 1):
        sides = [range(-SIDE, 0), range(w, w + SIDE)]
        whole = np.logical_and.reduce([rows[k][1] for k in range(w)])
        dev = np.full(m, np.inf)
        for u in U.values():
            top, low, centre = np.zeros(m), np.zeros(m), []
            for ks in sides:
                ok = np.stack([rows[k][1] for k in ks])
                y, v = np.stack([X[k] for k in ks]), np.stack([u[k] for k in ks])
                c = np.maximum(ok.sum(0), 1)
                ym, vm = np.where(ok, y, 0).sum(0) / c, np.where(ok, v, 0).sum(0) / c
                dy, dv = np.where(ok, y - ym, 0), np.where(ok, v - vm, 0)
                top += (dy * dv).sum(0)
                low += (dv * dv).sum(0)
                centre.append((ym, vm, dy, dv, ok.sum(0)))
            slope = top / np.where(low > 0, low, 1)
            (ya, va, dya, dva, na), (yb, vb, dyb, dvb, nb) = centre
            mid = (va + vb) / 2
            left, right = ya + slope * (mid - va), yb + slope * (mid - vb)
            noise = np.maximum(np.abs(dya - slope * dva).max(0), np.abs(dyb - slope * dvb).max(0))
            off = np.stack([X[k] - ((left + right) / 2 + slope * (u[k] - mid)) for k in range(w)])
            one_way = (off > 0).all(0) | (off < 0).all(0)
            d = np.where(one_way & whole & (na >= 2) & (nb >= 2), np.abs(off).min(0), 0.0)
            dev = np.minimum(dev, np.where((np.abs(left - right) < 0.5 * d) & (noise < d / 3), d, 0.0))
        better = dev > best
        best[better], width[better] = dev[better], w
    return best, width


def runs(x: np.ndarray, same_series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) rows of the maximal runs of one value; ``same_series[i]``: row i continues row i-1."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(len(x), bool)
    fresh[1:] = ~(same_series[1:] & (x[1:] == x[:-1]))
    start = np.flatnonzero(fresh)
    return start, np.append(start[1:], len(x)) - 1


def group_quantiles(v: np.ndarray, g: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, counts and values at the ranks q (rows) of the non-NaN ``v``, all groups at once."""
    ok = ~np.isnan(v)
    v, g = v[ok], g[ok]
    order = np.lexsort((v, g))
    v, g = v[order], g[order]
    groups, first, count = np.unique(g, return_index=True, return_counts=True)
    at = first[:, None] + np.minimum((q[None, :] * count[:, None]).astype(np.int64), count[:, None] - 1)
    return groups, count, v[at] if len(v) else np.zeros((0, len(q)))
