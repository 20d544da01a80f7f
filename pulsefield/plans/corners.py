"""Sums over a window of exp(-(|dx| + |dy|) / scale) times exponentials in time, without meeting most pairs.

|dx| has a kink, so no basis over all of space is small; but between two columns of cells exp(-|dx| / scale) is a product
of the target's and the source's distance to the edges, exactly, and so between two rows. Cells carry sums for each corner
(left or right, above or below), which one pass along each axis passes on to all columns and rows. What is left are the
pairs of one column or row, and those of the events about either end of the window of a block of targets: they are met in
blocks. Columns and rows hold equally many events, so work grows as the events of a window to the power 3/2 in a stretch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

#: Cells of an axis, and targets of a block, for each root of the events of a window; fewer events than this are met as pairs.
CELLS, TARGETS, FEW = 0.4, 3.5, 1500
#: Terms of a sum of exponentials at most, and e to what a rate may grow over a window; pairs in a processor's cache.
MOST_TERMS, MOST_RATE, NEAR = 40, 256, 1 << 14


def exponentials(values: Callable[[np.ndarray], np.ndarray], window: float, tolerance: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Rates, and weights of each function of `values`, whose sums of exponentials are the functions on (0, window].

    The error is below `tolerance` of a function's peak; None if `MOST_TERMS` do not reach it.
    """
    some = (1 - np.cos((np.arange(200) + 0.5) * math.pi / 200)) * window / 2
    lags = np.concatenate([np.linspace(0, window, 401)[1:], np.geomspace(window * 1e-6, window, 200)])
    given, want = values(some).T, values(lags).T
    peak = np.abs(want).max(axis=0)
    if not (np.isfinite(given).all() and np.isfinite(want).all() and (peak > 0).all()):
        return None
    given, want = given / peak, want / peak
    for n in range(4, MOST_TERMS + 1):
        top = 2.0
        while top <= MOST_RATE:
            rates = top / window * (1 - np.cos(np.arange(n) * math.pi / (2 * (n - 1))))
            weights = np.linalg.lstsq(np.exp(-np.outer(some, rates)), given, rcond=1e-15)[0]
            if np.abs(np.exp(-np.outer(lags, rates)) @ weights - want).max() < tolerance and np.abs(weights).sum(axis=0).max() < 1e4:
                return rates, weights.T * peak[:, None]
            top *= 2
    return None


class _Axis:
    """Cells of one coordinate, of equally many rows, and the rows' distances to their edges."""

    def __init__(self, v: np.ndarray, n: int):
        edges = np.unique(np.quantile(v, np.linspace(0, 1, n + 1)))
        self.edges = edges if len(edges) > 1 else np.repeat(edges, 2)
        self.n = len(self.edges) - 1
        self.cell = np.clip(np.searchsorted(self.edges, v, "right") - 1, 0, self.n - 1)
        self.low, self.high = v - self.edges[self.cell], self.edges[self.cell + 1] - v

    def sides(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For sources below and above a target: the cells in their direction and widths, sources' and targets' distances."""
        wide = np.diff(self.edges)
        yield self.cell, wide, self.high, self.low
        yield self.n - 1 - self.cell, wide[::-1], self.low, self.high


class Corners:
    """A stretch (see `windows.Stretch`) whose targets sum exp(-(|dx| + |dy|) / scale - rate dt) over their sources, for each rate."""

    def __init__(self, some, rates: np.ndarray):
        self.some, self.rates = some, rates
        own, n = some.own, float((some.hi - some.lo).mean()) if len(some.own) else 0.0
        side = 1 if n < FEW else max(2, int(CELLS * math.sqrt(n)))
        self.size = max(64, int(TARGETS * math.sqrt(n)))
        self.blocks = []
        if not len(own):
            return
        self.x, self.y = _Axis(some.x, side), _Axis(some.y, side)
        for a in range(0, len(own), self.size):
            b = min(a + self.size, len(own))
            p, q = int(some.lo[b - 1]), int(some.hi[a])  # every target of the block has these sources
            self.blocks.append((a, b, p, q) if p < q and self.x.n > 1 and self.y.n > 1 else (a, b, 0, 0))
        corners = [(*u, *v) for u in self.x.sides() for v in self.y.sides()]
        self.flat = np.stack([(ix * self.y.n + iy) * 4 + k for k, (ix, _, _, _, iy, _, _, _) in enumerate(corners)])
        self.source = np.stack([c[2] + c[6] for c in corners])
        self.target = np.stack([c[3] + c[7] for c in corners])
        self.wide = np.stack([c[1] for c in corners], axis=1), np.stack([c[5] for c in corners], axis=1)  # (cells, 4)
        self.base = float(some.t[own[0]])
        self.before = np.exp(np.outer(some.t - self.base, rates))
        self.after = np.exp(-np.outer(some.t[own] - self.base, rates))

    def _near(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Targets (numbers among the own rows), source rows, and which are pairs that cells do not hold."""
        some, cx, cy = self.some, self.x.cell, self.y.cell
        number = np.full(len(some.t), -1)
        number[some.own] = np.arange(len(some.own))

        def met(k: np.ndarray, j: np.ndarray, other: Callable[[np.ndarray, np.ndarray], np.ndarray] | None):
            g, once = some.own[k], max(64, NEAR // len(k))
            for low in range(0, len(j), once):
                part = j[low : low + once]
                hit = (part >= some.lo[k][:, None]) & (part < some.hi[k][:, None])
                if other is not None:
                    hit &= other(g[:, None], part)
                if hit.any():
                    yield k, part, hit

        def along(cell: np.ndarray, n: int, other):
            order = np.argsort(cell, kind="stable")  # by time inside a cell
            ends = np.searchsorted(cell[order], np.arange(n + 1))
            for c in range(n):
                rows = order[ends[c] : ends[c + 1]]
                mine = number[rows]
                mine = mine[mine >= 0]
                for a in range(0, len(mine), 64):
                    k = mine[a : a + 64]
                    first, last = np.searchsorted(rows, (some.lo[k[0]], some.hi[k[-1]]))
                    yield from met(k, rows[first:last], other)

        yield from along(cx, self.x.n, None)
        if self.x.n == 1:
            return
        yield from along(cy, self.y.n, lambda g, j: cx[g] != cx[j])
        for first, last, p, q in self.blocks:
            for a in range(first, last, 128):
                k = np.arange(a, min(a + 128, last))
                low, high = int(some.lo[k[0]]), int(some.hi[k[-1]])
                j = np.concatenate([np.arange(low, p), np.arange(q, high)]) if p < q else np.arange(low, high)
                yield from met(k, j, lambda g, j: (cx[g] != cx[j]) & (cy[g] != cy[j]))

    def _far(self, scale: float, moments: int) -> Iterator[tuple[slice, np.ndarray, float]]:
        """Targets, (moments, targets, rates) sums over the sources in other columns and rows, as of a time, and the time.

        The second moment is that times |dx| + |dy|.
        """
        some, rates, n = self.some, self.rates, len(self.rates)
        shape = (moments, self.x.n, self.y.n, 4 * n)
        state, passed, last = np.zeros(shape), np.empty(shape), np.empty(shape)
        rows = state.reshape(moments, -1, n)
        decay = np.exp(-self.source / scale)
        wide = [np.repeat(w, n, axis=1) for w in self.wide]
        fall = [np.exp(-w / scale) for w in wide]
        begin = end = 0
        at = float(some.t[0])
        for a, b, p, q in self.blocks:
            if p >= q:
                continue
            now = float(some.t[some.own[a]])
            if p >= end:
                state[:] = 0
                begin = end = p
            else:
                rows *= np.exp(-rates * (now - at))
            at = now
            moved = np.concatenate([np.arange(end, q), np.arange(begin, p)])
            sign = np.repeat([1.0, -1.0], [q - end, p - begin])
            begin, end = p, q
            for low in range(0, len(moved), 4096):  # bounds the products in memory
                j = moved[low : low + 4096]
                w = np.exp(-np.outer(at - some.t[j], rates)) * sign[low : low + 4096, None]
                put = (decay[:, j, None] * w).reshape(-1, n)
                to = self.flat[:, j].ravel()
                order = np.argsort(to, kind="stable")
                begins = np.flatnonzero(np.diff(to[order], prepend=-1))
                rows[0][to[order[begins]]] += np.add.reduceat(put[order], begins)
                if moments > 1:
                    put *= self.source[:, j].reshape(-1, 1)
                    rows[1][to[order[begins]]] += np.add.reduceat(put[order], begins)
            self._pass(state, passed, wide[0], fall[0])
            self._pass(passed.swapaxes(1, 2), last.swapaxes(1, 2), wide[1], fall[1])
            k = slice(a, b)
            g = some.own[k]
            held = last.reshape(moments, -1, n)[:, self.flat[:, g]]  # moments, corners, targets, rates
            if moments > 1:
                held[1] += self.target[:, g, None] * held[0]
            held *= np.exp(-self.target[:, g, None] / scale)
            yield k, held.sum(axis=1), at

    @staticmethod
    def _pass(given: np.ndarray, out: np.ndarray, wide: np.ndarray, fall: np.ndarray) -> None:
        """out[:, a]: the sums of given[:, b], b < a, brought to the lower edge of a."""
        now = np.zeros((len(given), *given.shape[2:]))
        for a in range(given.shape[1]):
            out[:, a] = now
            if len(now) > 1:
                now[1] += wide[a] * now[0]
            now *= fall[a]
            now += given[:, a]

    def _decays(self, scale: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """exp(-(|dx| + |dy|) / scale) of targets (rows) and sources (columns).

        The lesser of exp(dx / scale) and exp(-dx / scale), which are products: an exponential takes longer than all else.
        """
        some = self.some
        room = np.empty((3, max(NEAR, 64 * 128)))  # held, as new arrays of this size cost more than the sums
        if max(np.ptp(some.x), np.ptp(some.y)) / scale > 600:
            return lambda g, j: np.exp((np.abs(some.x[g][:, None] - some.x[j]) + np.abs(some.y[g][:, None] - some.y[j])) / -scale)
        up = [np.exp((v - (v.min() + v.max()) / 2) / scale) for v in (some.x, some.y)]
        down = [1 / v for v in up]

        def of(g: np.ndarray, j: np.ndarray) -> np.ndarray:
            out, a, b = (v[: len(g) * len(j)].reshape(len(g), len(j)) for v in room)
            for k, (u, d) in enumerate(zip(up, down, strict=True)):
                np.multiply(u[g][:, None], d[j], out=a)
                np.multiply(d[g][:, None], u[j], out=b)
                np.minimum(a, b, out=a if k else out)
            out *= a
            return out

        return of

    def sums(self, scale: float) -> np.ndarray:
        """(2, targets, rates): the sums of each target, and those times |dx| + |dy|."""
        some = self.some
        out = np.zeros((2, len(some.own), len(self.rates)))
        if not len(some.own):
            return out
        decays, room = self._decays(scale), np.empty((2, max(NEAR, 64 * 128)))
        for k, j, hit in self._near():
            g, before = some.own[k], self.before[j]
            z = decays(g, j)
            z *= hit
            out[0, k] += z @ before
            for v, lag in zip((some.x, some.y), room, strict=True):
                lag = lag[: z.size].reshape(z.shape)
                np.subtract(v[g][:, None], v[j], out=lag)
                np.abs(lag, out=lag)
            lag += room[0][: z.size].reshape(z.shape)
            z *= lag
            out[1, k] += z @ before
        out *= self.after
        for k, held, at in self._far(scale, 2):
            out[:, k] += held * np.exp(-np.outer(some.t[some.own[k]] - at, self.rates))
        return np.maximum(out, 0.0)

    def totals(self, scales: np.ndarray) -> np.ndarray:
        """(scales, rates): the sums over all targets."""
        some = self.some
        out = np.zeros((len(scales), len(self.rates)))
        if not len(some.own):
            return out
        decays = [self._decays(scale) for scale in scales]
        for k, j, hit in self._near():
            g, before, after, held = some.own[k], self.before[j], self.after[k], hit.astype(float)
            for n, of in enumerate(decays):
                z = of(g, j)
                z *= held
                out[n] += np.einsum("ij,ij->j", z @ before, after)
        for n, scale in enumerate(scales):
            for k, held, at in self._far(scale, 1):
                out[n] += (held[0] * np.exp(-np.outer(some.t[some.own[k]] - at, self.rates))).sum(axis=0)
        return out
