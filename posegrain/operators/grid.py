"""Areas of the beta search for groups of any size, from rows that are read block by block and never sorted as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow.parquet as pq

from posegrain.session import open_shared

POINTS = 100
#: Rows of a block; rows of a group that a task keeps, else it reads them again for each pass; single values kept at once.
BLOCK, HELD, APART = 1 << 16, 4_000_000, 4_000_000
MANTISSA = 11
_SHIFT = 52 - MANTISSA
_LEAST = (int(np.array(2.0**-53).view(np.int64)) >> _SHIFT) - 1
_MIDDLE = (int(np.array(0.5).view(np.int64)) >> _SHIFT) - _LEAST


def read_blocks(files: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (err, det, two, ub) of up to ``BLOCK`` rows."""
    for f in files:
        with open_shared(f) as source:
            for b in pq.ParquetFile(source).iter_batches(BLOCK, columns=["err", "det", "two", "ub"]):
                yield tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("err", "det", "two", "ub"))


def points(rows: int) -> np.ndarray:
    """Ranks (by descending value, from 0) of the points of a curve, and the last rank."""
    m = min(rows, POINTS)
    return np.append(np.floor(np.arange(m - 1) * (1.0 / max(m - 1, 1)) * rows).astype(np.int64), rows - 1)


def bins(u: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each value and the number of ``cuts`` below it.  The bin never falls as the value grows, and rises at a cut.

    There are 2^MANTISSA bins for each halving of the distance to 0 or to 1, the nearer of both; 1 - u is exact from 0.5 on.
    Of the values from 0 to 1, the bins of 0 and of 1 hold no other, but positive ones below 2^-53.
    """
    near = np.subtract(1.0, u)
    np.minimum(near, u, out=near)
    b = near.view(np.int64)
    b >>= _SHIFT
    np.maximum(b, _LEAST, out=b)
    b -= _LEAST
    back = -(u >= 0.5).astype(np.int64)  # all bits or none: 2 * _MIDDLE - b or b
    b ^= back
    b -= back
    back &= 2 * _MIDDLE
    b += back
    below = np.zeros(len(u), np.int8)
    for c in cuts:
        below += (u > c).view(np.int8)
    if len(cuts):
        b += below
    return b, below


class Sums:
    """Rows and errors by bin, for each of some kinds of rows."""

    def __init__(self, kinds: int, cuts: np.ndarray) -> None:
        self.n, self.err = (np.zeros((kinds, 2 * _MIDDLE + 1 + len(cuts))) for _ in range(2))

    def add(self, b: np.ndarray, err: np.ndarray, kind: np.ndarray | None = None) -> None:
        if len(b):
            lo, hi = b.min(), b.max() + 1
            at = b - lo if kind is None else kind * (hi - lo) + (b - lo)
            for total, weights in ((self.n, None), (self.err, err)):
                total[:, lo:hi] += np.bincount(at, weights, len(total) * (hi - lo)).reshape(len(total), -1)


class Curve:
    """Retained errors at the points of one curve: from the rows and errors by bin, and the single values of the bins with a point."""

    def __init__(self, n: np.ndarray, err: np.ndarray, at: np.ndarray, cuts: np.ndarray, single: tuple[float, ...] = ()) -> None:
        """``single`` are values that are alone in their bin."""
        self.at, self.cuts, self.rows, self.total = at, cuts, n.sum(), err.sum()
        upto, upto_err = np.cumsum(n[::-1])[::-1], np.cumsum(err[::-1])[::-1]
        self.above, self.above_err = upto - n, upto_err - err
        self.open = np.unique(len(n) - 1 - np.searchsorted(upto[::-1], at, side="right"))
        self.table = np.zeros(len(n), bool)
        self.v, self.n, self.err, self.waiting = [], [], [], 0
        self.known: list[tuple[np.ndarray, ...]] = []  # of points: place in ``at``, retained error or, for the last one, mean error
        v = np.array(single, float)
        b = bins(v, cuts)[0]
        at_hand = np.isin(b, self.open)
        if at_hand.any():
            self.v, self.n, self.err = [v[at_hand]], [n[b[at_hand]]], [err[b[at_hand]]]
            self.close()
        self.open = np.setdiff1d(self.open, b)
        self.open_n = n[self.open]

    def take(self, u: np.ndarray, err: np.ndarray) -> None:
        self.v.append(u)
        self.n.append(np.ones(len(u)))
        self.err.append(err)
        self.waiting += len(u)
        if self.waiting > APART:
            self._count()

    def _count(self) -> None:
        """One entry a value."""
        v, n, err = (np.concatenate(x) for x in (self.v, self.n, self.err))
        order = np.argsort(v)
        v = v[order]
        at = np.flatnonzero(np.append(True, v[1:] != v[:-1])[: len(v)])
        self.v, self.n, self.err = [v[at]], [np.add.reduceat(n[order], at)], [np.add.reduceat(err[order], at)]
        self.waiting = 0

    def close(self) -> None:
        """The points of the bins that ``table`` names, from all their values."""
        self._count()
        v, n, err = (x[0][::-1] for x in (self.v, self.n, self.err))
        b = bins(v, self.cuts)[0]
        first = np.searchsorted(-b, -b, side="left")  # of the value's bin
        before = lambda x: (np.cumsum(x) - x) - (np.cumsum(x) - x)[first]
        lo, gone = self.above[b] + before(n), self.above_err[b] + before(err)
        i = np.searchsorted(lo, self.at, side="right") - 1
        mine = np.flatnonzero((i >= 0) & (self.at < lo[i] + n[i]))
        i, k = i[mine], self.at[mine]
        tie = err[i] / n[i]
        self.known.append((mine, np.where(mine < len(self.at) - 1, (self.total - gone[i] - (k - lo[i]) * tie) / (self.rows - k), tie)))
        self.table[:] = False
        self.v, self.n, self.err = [], [], []

    def retained_error(self) -> np.ndarray:
        out = np.full(len(self.at), np.nan)
        for mine, x in self.known:
            out[mine] = x
        return out


def _take_apart(curves: list[Curve], blocks: Callable[[], Iterable], give: Callable[[tuple], None]) -> None:
    """Closes all curves: as many of their bins in one pass over the blocks as hold ``APART`` rows, one at least.

    ``give`` hands the rows of a block to the curves whose ``table`` has their bin.
    """
    left = [(c, b, n) for c in curves for b, n in zip(c.open, c.open_n, strict=True)]
    left.reverse()
    while left:
        now, room = {}, APART
        while left and (not now or left[-1][2] <= room):
            c, b, n = left.pop()
            c.table[b] = True
            room -= n
            now[id(c)] = c
        for block in blocks():
            give(block)
        for c in now.values():
            c.close()


def areas(blocks: Callable[[], Iterable[tuple[np.ndarray, ...]]], rows: int, betas: list[float], taus: list[float]) -> list[tuple[str, float, float | None, float]]:
    """(strategy, beta, tau, ause) of a group of ``rows`` rows, which ``blocks()`` gives anew at each call as arrays (err, det, two, ub).

    The rows are counted by bins of the uncertainty, and only the bins with a point of the curve are taken apart.  The gating
    curves differ in the rows that take either uncertainty, so their counts are sums of counts by the number of taus below.
    The results are those of calibration.ause_array().
    """
    strategies = [("max_pooling", None), ("gating_k", None), *(("gating_tau", float(t)) for t in taus), ("softmax", None)]
    if rows < 2:
        return [(s, beta, t, 0.0) for beta in betas for s, t in strategies]
    kept = lambda make: list(make()).__iter__ if rows <= HELD else make
    at, cuts, none = points(rows), np.array(sorted(taus), float), np.array([])
    s = Sums(1, none)
    for err, *_ in blocks():
        s.add(bins(err, none)[0], err)
    oracle = Curve(s.n[0], s.err[0], at, none)

    def give_error(block: tuple) -> None:
        err = block[0]
        err = err[oracle.table[bins(err, none)[0]]]
        oracle.take(err, err)

    _take_apart([oracle], blocks, give_error)
    best, out = oracle.retained_error(), []
    whole = all(((ub == 0) | (ub >= 2.0**-53)).all() and (ub <= 1).all() and (det >= 0).all() for _, det, _, ub in blocks())
    single = (0.0, 1.0) if whole else ()  # often the value of many rows, where beta is very small or large
    base = kept(lambda: ((err, det, two, ub, bins(ub, cuts)[0], np.exp(ub)) for err, det, two, ub in blocks()))
    kinds = np.int64 if len(taus) > 5 else np.uint8  # a bit for each curve but the last
    of_tau = [1 << i for i in range(2, 2 + len(taus))]
    gated = np.array([sum(bit for bit, t in zip(of_tau, taus, strict=True) if (cuts < t).sum() < q) for q in range(len(cuts) + 1)], kinds)  # curves whose tau is below
    every = sum(of_tau) + 2
    for beta in betas:

        def both(beta: float = beta) -> Iterator[tuple[np.ndarray, ...]]:
            for err, det, two, ub, b, eb in base():
                ug = 1.0 - np.exp(-beta * det)
                eg = np.exp(ug)
                soft = (eb * ub + eg * ug) / (eb + eg)
                g, below = bins(ug, cuts)
                yield err, two, ub, b, ug, g, below, soft, bins(soft, none)[0]

        pairs = kept(both)
        top, mean, by_g, by_b = Sums(1, cuts), Sums(1, none), Sums(2, cuts), Sums(len(cuts) + 1, cuts)
        for err, two, _, b, _, g, below, _, f in pairs():
            top.add(np.maximum(b, g), err)
            mean.add(f, err)
            by_g.add(g, err, two.astype(np.int64))
            one = np.flatnonzero(~two)
            by_b.add(b[one], err[one], below[one].astype(np.int64))
        parts = ((by_g.n, by_b.n), (by_g.err, by_b.err))
        curves = [Curve(top.n[0], top.err[0], at, cuts, single), Curve(*(g[1] + b.sum(axis=0) for g, b in parts), at, cuts, single)]
        for t in taus:
            over, q = np.arange(by_g.n.shape[1]) > bins(np.array([float(t)]), cuts)[0][0], (cuts < t).sum()  # bins of what is above t
            curves.append(Curve(*(g[1] + np.where(over, g[0], 0.0) + b[: q + 1].sum(axis=0) for g, b in parts), at, cuts, single))
        curves.append(Curve(mean.n[0], mean.err[0], at, none))
        tables = np.zeros(by_g.n.shape[1], kinds)

        def give(block: tuple, curves: list[Curve] = curves, tables: np.ndarray = tables) -> None:
            err, two, ub, b, ug, g, below, soft, f = block
            from_g = np.where(two, kinds(every), gated[below]) | (ug > ub)  # bit 0: max_pooling takes the larger one
            near = np.flatnonzero((tables[g] & from_g) | (tables[b] & ~from_g))
            e, ug, ub, g, b, from_g = (x[near] for x in (err, ug, ub, g, b, from_g))
            for i, c in enumerate(curves[:-1]):
                mine = (from_g >> i & 1).astype(bool)
                k = np.flatnonzero(c.table[np.where(mine, g, b)])
                c.take(np.where(mine[k], ug[k], ub[k]), e[k])
            k = np.flatnonzero(curves[-1].table[f])
            curves[-1].take(soft[k], err[k])

        def passes(curves: list[Curve] = curves, tables: np.ndarray = tables, pairs: Callable = pairs) -> Iterable:
            tables[:] = 0
            for i, c in enumerate(curves[:-1]):
                tables |= c.table.astype(kinds) << kinds(i)
            return pairs()

        _take_apart(curves, passes, give)
        for (name, t), c in zip(strategies, curves, strict=True):
            gap = c.retained_error() - best
            out.append((name, beta, t, float((gap[1:] + gap[:-1]).sum() / 2 / (len(gap) - 1))))
    return out
