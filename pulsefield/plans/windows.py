"""Excitation inside a window without rows for pairs: a task holds a stretch of time and sums over its earlier events.

A stretch is as wide as the window; an event goes to its own stretch as a target and a source, and to the next one as a
source. A radius cuts stretches into strips of `STRIP` radii. Only sums leave a task: by event and draw, or, with the
background's logarithm taken there too, by draw alone. Inside a task (numpy on Arrow tables)

* exponentials in time and Gaussians in space of many draws are sums of few of either (`Decays`), so the pairs are met
  once for all draws and not once for each;
* without a radius they are taken in a basis that the Gaussians of all draws share: a matrix for each rate decays,
  gains the events that enter the window and loses those that leave it, so work is linear in the events, with an error
  below `TOLERANCE` of the kernel's peak; the events of a block about each end of the window are summed exactly;
* with a double exponential in space and no radius most pairs are met by cells (`corners`), if the kernel in time is a sum of
  exponentials there;
* totals of other kernels in time are taken by Chebyshev polynomials of the lag (`Lags`), once for all draws too;
* other kernels, or Gaussians too narrow for `MOST_BASIS` functions, are summed pair by pair, in blocks.

Draws are taken `DRAWS_AT_ONCE` at a time; the parameters and fields of so many visit the driver.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.functions.kernels import DoubleExponential, Exponential, Gaussian, Kernel
from pulsefield.plans.corners import Corners, exponentials

TOLERANCE = 1e-11
#: Draws at once; targets of a block; functions of a basis at most; width of strips in radii; pairs at once.
DRAWS_AT_ONCE, BLOCK, MOST_BASIS, STRIP, PAIRS = 256, 64, 80, 4, 1 << 18
#: Targets of a block if many draws meet it; terms of a polynomial of the lag at most; pairs in a processor's cache.
WIDE_BLOCK, MOST_LAGS, NEAR = 128, 48, 1 << 14
#: Windows of a stretch, and radii of a strip, where pairs are rows: events are then copied half as often.
LONG, BROAD = 4, 8


def summable(t_kernel: Kernel, s_kernel: Kernel) -> bool:
    """Whether both kernels give their density as numbers; others need pairs as rows."""
    return all(type(k).density is not Kernel.density and type(k).measure is not Kernel.measure for k in (t_kernel, s_kernel))


def _through(nodes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(at, nodes): the weights with which values at the nodes give those at `at`, by Lagrange."""
    wide = max(float(nodes.max() - nodes.min()), 1e-300)
    gaps = (nodes[:, None] - nodes) * 4 / wide
    np.fill_diagonal(gaps, 1.0)
    off = (at[:, None] - nodes) * 4 / wide
    out = 1 / gaps.prod(axis=1) / np.where(off == 0, 1.0, off)
    out /= out.sum(axis=1, keepdims=True)
    same = (off == 0).any(axis=1)
    out[same] = off[same] == 0
    return out


def _chebyshev(low: float, high: float, n: int) -> np.ndarray:
    return (low + high) / 2 - (high - low) / 2 * np.cos((np.arange(n) + 0.5) * math.pi / n)


def _squared(radius: float) -> float:
    """The largest number whose root is not above the radius."""
    out = radius * radius
    while math.sqrt(out) > radius:
        out = math.nextafter(out, 0.0)
    while math.sqrt(math.nextafter(out, math.inf)) <= radius:
        out = math.nextafter(out, math.inf)
    return out


class Decays:
    """exp(-rate lag) for each draw's rate and lags up to `most`, as weighted sums of those of few `rates`.

    `weights` is (draws, rates). The rates are a few even steps (`step`) apart, Chebyshev's in the logarithm, or the draws'
    own if those are fewer. With `near` they give way to powers of lag / most - 1/2 (`powers`), if the decay is so small
    that a few do.
    """

    def __init__(self, given: np.ndarray, most: float, near: bool = False):
        self.rates, which = np.unique(given, return_inverse=True)
        self.weights, self.step, self.most, self.powers = np.eye(len(self.rates))[which], None, most, False
        lags = np.concatenate([np.linspace(0, most, 300), np.geomspace(most * 1e-6, most, 300)])
        want = np.exp(-np.outer(given, lags))
        for n in range(2, 11 if near else 0):
            nodes = _chebyshev(-0.5, 0.5, n)
            weights = np.exp(-np.outer(given, (nodes + 0.5) * most)) @ np.linalg.inv(np.vander(nodes, n, increasing=True)).T
            if np.abs(weights @ np.vander(lags / most - 0.5, n, increasing=True).T - want).max() < TOLERANCE:
                self.rates, self.weights, self.powers = np.zeros(n), weights, True
                return
        for n in range(3, len(self.rates)):
            even, nodes = np.linspace(given.min(), given.max(), n), _chebyshev(math.log(given.min()), math.log(given.max()), n)
            for rates, weights, step in ((even, _through(even, given), even[1] - even[0]), (np.exp(nodes), _through(nodes, np.log(given)), None)):
                if (step is None or n <= 10) and np.abs(weights @ np.exp(-np.outer(rates, lags)) - want).max() < TOLERANCE:
                    self.rates, self.weights, self.step = rates, weights, step
                    return


class Lags:
    """Each draw's density in time for lags up to `window` as a polynomial of the lag; `size` 0: none of `MOST_LAGS` terms."""

    def __init__(self, densities: Callable[[np.ndarray], np.ndarray], window: float):
        self.window, self.size = window, 0
        lags = np.concatenate([np.linspace(0, window, 400)[1:], np.geomspace(window * 1e-6, window, 200)])
        want = densities(lags)
        peak = np.abs(want).max(axis=1, keepdims=True)
        if not np.isfinite(want).all() or not (peak > 0).all():
            return
        for n in range(4, MOST_LAGS + 1):
            nodes = _chebyshev(0, window, n)
            self.weights = densities(nodes) @ np.linalg.inv(np.polynomial.chebyshev.chebvander(nodes * 2 / window - 1, n - 1)).T
            if (np.abs(self.weights @ np.stack(list(self.at(lags, n))) - want) < TOLERANCE * peak).all():
                self.size = n
                return

    def at(self, lags: np.ndarray, n: int | None = None) -> Iterator[np.ndarray]:
        """The polynomials' values, one after the other."""
        z = lags * (2 / self.window) - 1
        last, now = np.ones_like(z), z
        yield last
        for _ in range((n or self.size) - 1):
            yield now
            last, now = now, 2 * z * now - last


class Basis:
    """Functions of one coordinate in which Gaussians of all the variances are R x R matrices; `size` 0: none small enough."""

    def __init__(self, low: float, high: float, variances: np.ndarray):
        self.mid, self.half = (low + high) / 2, max((high - low) / 2, 1e-9)
        self.variances, self.size = variances, 0
        some = np.unique(np.quantile(variances, np.linspace(0, 1, 8)))
        kernel = lambda a, b, v: np.exp(-((a[:, None] - b) ** 2) * self.half**2 / (2 * v))
        grid = np.linspace(-1, 1, 301)
        n = 16
        while n <= 4 * MOST_BASIS:
            nodes = np.cos((np.arange(n) + 0.5) * math.pi / n)
            back = np.linalg.inv(self._powers(nodes, n))
            u, s, _ = np.linalg.svd(np.hstack([kernel(nodes, nodes, v) for v in some]), full_matrices=False)
            u = u[:, s > TOLERANCE * s[0]]
            self.to, self.n = back @ u, n
            at = self._powers(grid, n) @ self.to
            if all(np.abs(at @ (u.T @ kernel(nodes, nodes, v) @ u) @ at.T - kernel(grid, grid, v)).max() < TOLERANCE * 10 for v in some):
                break
            n = n * 5 // 4
        else:
            return
        if u.shape[1] <= MOST_BASIS:
            self.size = u.shape[1]
            gap2 = ((nodes[:, None] - nodes) * self.half) ** 2
            self.matrices = np.stack([u.T @ kernel(nodes, nodes, v) @ u for v in variances])
            self.squares = np.stack([u.T @ (gap2 * kernel(nodes, nodes, v)) @ u for v in variances])

    @staticmethod
    def _powers(z: np.ndarray, n: int) -> np.ndarray:
        return np.polynomial.chebyshev.chebvander(z, n - 1)

    def at(self, x: np.ndarray) -> np.ndarray:
        return self._powers((x - self.mid) / self.half, self.n) @ self.to


class Stretch:
    """The rows of a task in order of time: targets are the own rows, and [lo, hi) are each one's sources."""

    def __init__(self, t: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, window: float):
        self.t, self.x, self.y, self.window = t, x, y, window
        self.own = np.flatnonzero(own)
        at = t[self.own]
        self.hi, self.lo = np.searchsorted(t, at, "left"), np.searchsorted(t, at - window, "left")
        while len(t):  # rounding: as the difference is compared
            late = (self.lo > 0) & (at - t[np.maximum(self.lo - 1, 0)] <= window)
            early = (self.lo < self.hi) & (at - t[np.minimum(self.lo, len(t) - 1)] > window)
            if not (late.any() or early.any()):
                break
            self.lo = self.lo - late + early

    def pairs(self, radius: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Target (number among the own rows, ascending), source row, dt, dx, dy of pairs, some at a time."""
        def met(k: np.ndarray, j: np.ndarray):
            g = self.own[k]
            dt = self.t[g][:, None] - self.t[j]
            hit = (dt > 0) & (dt <= self.window)
            if radius is not None:
                dx, dy = self.x[g][:, None] - self.x[j], self.y[g][:, None] - self.y[j]
                hit &= np.sqrt(dx * dx + dy * dy) <= radius
            a, b = np.nonzero(hit)
            if len(a):
                a, b = k[a], j[b]
                yield a, b, self.t[self.own[a]] - self.t[b], self.x[self.own[a]] - self.x[b], self.y[self.own[a]] - self.y[b]

        for k, j in self.blocks(radius):
            for low in range(0, len(j), PAIRS // BLOCK):
                yield from met(k, j[low : low + PAIRS // BLOCK])

    def blocks(self, radius: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Targets (numbers among the own rows, ascending), and the rows that hold all their sources."""
        if not len(self.own):
            return
        if radius is None:
            for a in range(0, len(self.own), BLOCK):
                k = np.arange(a, min(a + BLOCK, len(self.own)))
                yield k, np.arange(self.lo[k[0]], self.hi[k[-1]])
            return
        # Cells as small as half the radius, but so large that there are some targets in each for a window.
        windows = max(1.0, float(np.ptp(self.t[self.own])) / self.window)
        for part, reach in ((0.5, 2), (1, 1), (2, 1), (4, 1), (math.inf, 0)):
            side = part * radius * (1 + 1e-9)
            cx, cy = np.floor(self.x / side).astype(np.int64), np.floor(self.y / side).astype(np.int64)
            if len(self.own) >= 24 * windows * len(np.unique(cx[self.own] * (1 << 32) + cy[self.own])):
                break
        reach = range(-reach, reach + 1)
        rows = {}
        order = np.lexsort((cy, cx))  # stable: by time inside a cell
        edges = np.flatnonzero(np.diff(cx[order]) | np.diff(cy[order])) + 1
        for part in np.split(order, edges):
            rows[int(cx[part[0]]), int(cy[part[0]])] = part
        number = np.full(len(self.t), -1)
        number[self.own] = np.arange(len(self.own))
        for (gx, gy), part in rows.items():
            mine = number[part]
            mine = mine[mine >= 0]
            near = [rows[c] for c in ((gx + i, gy + j) for i in reach for j in reach) if c in rows]
            for a in range(0, len(mine), BLOCK):
                k = mine[a : a + BLOCK]
                first, last = self.lo[k[0]], self.hi[k[-1]]
                yield k, np.concatenate([r[np.searchsorted(r, first) : np.searchsorted(r, last)] for r in near])

    def sums(self, radius: float | None, values: Callable[..., list[np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
        """(size, targets): the sums of each of `values(dt, dx, dy)`; and whether a target has a pair."""
        out, some = np.zeros((size, len(self.own))), np.zeros(len(self.own), bool)
        for k, _, dt, dx, dy in self.pairs(radius):
            begins = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1])
            at = k[begins]
            some[at] = True
            for n, v in enumerate(values(dt, dx, dy)):
                out[n, at] += np.add.reduceat(v, begins)
        return out, some

    def hits(self, k: np.ndarray, j: np.ndarray, most: float | None, lag: Callable[..., np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The lag in space (the squared distance) and whether it is a pair, of targets (rows) and sources (columns).

        `most` is the largest squared distance of a pair.
        """
        g = self.own[k]
        hit = (j >= self.lo[k][:, None]) & (j < self.hi[k][:, None])
        far, dy = self.x[g][:, None] - self.x[j], self.y[g][:, None] - self.y[j]
        other = lag(far, dy) if lag is not None else None
        far *= far
        dy *= dy
        far += dy
        if most is not None:
            hit &= far <= most
        return far if other is None else other, hit

    def _near(self, k: np.ndarray, j: np.ndarray, radius: float | None, time: Decays, space: Decays, rates: np.ndarray, half: np.ndarray, both: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(draws, targets): sums of exp(-rate dt - half d2) over the sources j; and whether a target has a pair."""
        some, mid, at = np.zeros(len(k), bool), self.t[self.own[k[0]]], self.t[self.own[k]]
        steps, sizes = (rates, half) if both is None else (time.rates, space.rates)
        sums = np.zeros((len(rates), len(k)) if both is None else (len(k), len(sizes), len(steps)))
        most, once = None if radius is None else _squared(radius), max(64, NEAR // len(k))
        for low in range(0, len(j), once):
            part = j[low : low + once]
            d2, hit = self.hits(k, part, most)
            some |= hit.any(axis=1)
            held, z = hit.astype(float), np.empty_like(d2)
            before = np.exp(np.outer(self.t[part] - mid, steps))
            step = None
            if both is not None and space.powers:
                step, z = d2, held
                step /= space.most
                step -= 0.5
            elif both is not None and space.step is not None:
                step = np.exp(d2 * -space.step)
            for n, h in enumerate(sizes):
                if n and step is not None:
                    z *= step
                elif z is not held:
                    np.multiply(d2, -h, out=z)
                    np.exp(z, out=z)
                    z *= held
                if both is None:
                    sums[n] += z @ before[:, n]
                else:
                    sums[:, n] += z @ before
        after = np.exp(-np.outer(at - mid, steps))
        if both is None:
            return sums * after.T, some
        return both @ (sums * after[:, None]).reshape(len(k), -1).T, some

    def decayed(self, weights: np.ndarray, rates: np.ndarray, half: np.ndarray, time: Decays, space: Decays, bases: tuple[Basis, Basis] | None, radius: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Targets, (draws, targets) sums of w exp(-rate dt - half d2), and whether a target has a pair, a block after the other."""
        both = None
        if space.powers or len(rates) > len(space.rates):
            both = (space.weights[:, :, None] * time.weights[:, None]).reshape(len(rates), -1)
        if bases is None:
            for k, j in self.blocks(radius):
                e, some = self._near(k, j, radius, time, space, rates, half, both)
                yield k, e * weights[:, None], some
            return
        bx, by = bases
        px, py = bx.at(self.x), by.at(self.y)
        state = np.zeros((len(time.rates), bx.size, by.size))
        begin = end = 0
        at, size = float(self.t[0]) if len(self.t) else 0.0, WIDE_BLOCK if both is not None else BLOCK
        for a in range(0, len(self.own), size):
            k = np.arange(a, min(a + size, len(self.own)))
            g = self.own[k]
            first, last = int(self.lo[k[0]]), int(self.hi[k[-1]])
            p, q = int(self.lo[k[-1]]), int(self.hi[k[0]])
            near = np.concatenate([np.arange(first, p), np.arange(q, last)]) if p < q else np.arange(first, last)
            out, _ = self._near(k, near, None, time, space, rates, half, both)
            if p < q:
                now = float(self.t[g[0]])
                if p >= end:
                    state[:] = 0
                    begin = end = p
                else:
                    state *= np.exp(-time.rates * (now - at))[:, None, None]
                at = now
                moved = np.concatenate([np.arange(end, q), np.arange(begin, p)])
                sign = np.repeat([1.0, -1.0], [q - end, p - begin])
                begin, end = p, q
                for low in range(0, len(moved), 512):  # bounds the products in memory
                    j = moved[low : low + 512]
                    w = np.exp(-np.outer(time.rates, at - self.t[j])) * sign[low : low + 512]
                    left, right = px[j].T, py[j]
                    for n in range(len(state)):
                        state[n] += (left * w[n]) @ right
                mine = (time.weights @ state.reshape(len(state), -1)).reshape(-1, bx.size, by.size)
                mine = bx.matrices @ mine @ by.matrices
                held = (px[g][:, :, None] * py[g][:, None]).reshape(len(g), -1)
                out += (mine.reshape(len(rates), -1) @ held.T) * np.exp(-np.outer(rates, self.t[g] - at))
            yield k, np.maximum(out * weights[:, None], 0.0), self.hi[k] > self.lo[k]

    def totals(self, radius: float | None, lags: Lags, lag: Callable[..., np.ndarray], space: Decays) -> tuple[np.ndarray, int]:
        """(terms, rates): the sum over pairs of each polynomial of dt times exp(-rate lag); and the targets with a pair."""
        out, count, most = np.zeros((lags.size, len(space.rates))), 0, None if radius is None else _squared(radius)
        for k, j in self.blocks(radius):
            some, once = np.zeros(len(k), bool), max(64, NEAR // len(k))
            for low in range(0, len(j), once):
                part = j[low : low + once]
                far, hit = self.hits(k, part, most, lag)
                some |= hit.any(axis=1)
                met = np.flatnonzero(hit)
                far, dt = far.ravel()[met], (self.t[self.own[k]][:, None] - self.t[part]).ravel()[met]
                left, right = np.empty((lags.size, len(dt))), np.exp(-np.outer(space.rates, far))
                for n, v in enumerate(lags.at(dt)):
                    left[n] = v
                out += left @ right.T
            count += int(some.sum())
        return out, count

    def smooth(self, weights: np.ndarray, rates: np.ndarray, variances: np.ndarray, bx: Basis, by: Basis, moments: bool = False) -> np.ndarray:
        """(draws, targets): sums of w exp(-rate dt - d2 / (2 variance)); with moments (3, draws, targets), times 1, dt and d2."""
        n, count = len(rates), len(self.own)
        out = np.zeros((3 if moments else 1, n, count))
        px, py = bx.at(self.x), by.at(self.y)
        half = 1 / (2 * variances)
        state = np.zeros((2 if moments else 1, n, bx.size, by.size))
        begin = end = 0
        at = float(self.t[0]) if len(self.t) else 0.0
        buffer = np.empty((bx.size, 512))
        for a in range(0, count, BLOCK):
            k = slice(a, min(a + BLOCK, count))
            g = self.own[k]
            first, last = int(self.lo[k][0]), int(self.hi[k][-1])
            p, q = int(self.lo[k][-1]), int(self.hi[k][0])
            if p < q:
                now = float(self.t[g[0]])
                if p >= end:
                    state[:] = 0
                    begin = end = p
                elif now > at:
                    if moments:
                        state[1] += (now - at) * state[0]
                    state *= np.exp(-rates * (now - at))[:, None, None]
                at = now
                moved = np.concatenate([np.arange(end, q), np.arange(begin, p)])
                sign = np.repeat([1.0, -1.0], [q - end, p - begin])
                begin, end = p, q
                for low in range(0, len(moved), 512):  # bounds the products in memory
                    j = moved[low : low + 512]
                    lag, left, right = at - self.t[j], px[j].T.copy(), py[j]
                    w = np.exp(-rates[:, None] * lag) * sign[low : low + 512]
                    some = buffer[:, : len(j)]
                    for d in range(n):
                        np.multiply(left, w[d], out=some)
                        state[0, d] += some @ right
                        if moments:
                            some *= lag
                            state[1, d] += some @ right
                tx, ty, lag = px[g], py[g], self.t[g] - at
                for d in range(n):
                    ax, ay = tx @ bx.matrices[d], ty @ by.matrices[d]
                    for m in range(len(state)):
                        out[m, d, k] = np.einsum("ij,ij->i", ax @ state[m, d], ay)
                    if moments:
                        out[2, d, k] = np.einsum("ij,ij->i", tx @ bx.squares[d] @ state[0, d], ay) + np.einsum("ij,ij->i", ax @ state[0, d], ty @ by.squares[d])
                if moments:
                    out[1, :, k] += lag * out[0, :, k]
                out[:, :, k] *= np.exp(-rates[:, None] * lag)
            near = np.concatenate([np.arange(first, p), np.arange(q, last)]) if p < q else np.arange(first, last)
            for low in range(0, len(near), 512):
                j = near[low : low + 512]
                dt = self.t[g][:, None] - self.t[j]
                hit = (dt > 0) & (dt <= self.window)
                d2 = (self.x[g][:, None] - self.x[j]) ** 2 + (self.y[g][:, None] - self.y[j]) ** 2
                lag = np.where(hit, dt, np.inf)
                z, e = np.empty_like(dt), np.empty_like(dt)
                for d in range(n):
                    np.multiply(lag, -rates[d], out=z)
                    np.multiply(d2, half[d], out=e)
                    np.subtract(z, e, out=z)
                    np.exp(z, out=z)
                    out[0, d, k] += z.sum(axis=1)
                    if moments:
                        out[1, d, k] += (z * dt).sum(axis=1)
                        out[2, d, k] += (z * d2).sum(axis=1)
        out *= weights[:, None]
        return np.maximum(out, 0.0)


def stretches(ev: DataFrame, window: float, radius: float | None, key: str, t: str, x: str, y: str, extra: list[str], long: int = 1, strip: int = STRIP):
    """Events grouped by stretch (and strip): columns i, t, x, y, the extra ones, and own for targets.

    A stretch is `long` windows; beyond one, only the events of its last window go to the next, so fewer are copied.
    """
    base = ev.select(F.col(key).cast("long").alias("i"), *[F.col(c).cast("double").alias(n) for c, n in ((t, "t"), (x, "x"), (y, "y"))], *extra).filter("t is not null and x is not null and y is not null")
    b = F.floor(F.col("t") / (long * window))
    both = F.array(b, b + 1)
    if long > 1:  # with room for rounding
        late = F.col("t") >= (b + 1) * (long * window) - window * 1.000001 - F.abs("t") * 1e-12
        both = F.when(late, both).otherwise(F.array(b))
    rows = base.select("*", b.alias("_b0"), F.explode(both).alias("_b"))
    own, keys = F.col("_b") == F.col("_b0"), ["_b"]
    if radius is not None:
        wide, reach = strip * radius, radius * (1 + 1e-9)
        at = lambda v: F.floor(v / wide)
        rows = rows.select("*", F.explode(F.sequence(at(F.col("x") - reach), at(F.col("x") + reach))).alias("_s"))
        own, keys = own & (F.col("_s") == at(F.col("x"))), ["_b", "_s"]
    rows = rows.select(*keys, "i", "t", "x", "y", *extra, own.alias("own"))
    # A fixed number of partitions: the rows are few and their work is much, so they must not be drawn together by size. Few
    # partitions get several for each core, as stretches fall on them unevenly.
    n = int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(n, min(4 * n, 128)), *keys).groupBy(*keys)


def _table(rows: pa.Table, window: float) -> tuple[Stretch, np.ndarray, pa.Table]:
    """The stretch, its targets' ids, and their rows."""
    rows = rows.take(pa.array(np.argsort(rows.column("t").to_numpy(), kind="stable")))
    own = rows.column("own").to_numpy()
    some = Stretch(*(rows.column(c).to_numpy() for c in ("t", "x", "y")), own, window)
    mine = rows.filter(pa.array(own))
    return some, mine.column("i").to_numpy(), mine


class Draws:
    """The parameters of some draws, and how a stretch sums their kernels."""

    def __init__(self, given: list, t_kernel: Kernel, s_kernel: Kernel, window: float, radius: float | None, box: tuple[float, float, float, float]):
        self.ids = np.array([r["draw_id"] for r in given], np.int64)
        column = lambda n: np.array([r[n] for r in given], float)
        self.alpha, self.radius, self.t_kernel, self.s_kernel = column("alpha"), radius, t_kernel, s_kernel
        self.pars = {n: column(n) for n in (*t_kernel.params, *s_kernel.params)}
        self.bases = None
        self.plain = type(t_kernel) is Exponential and type(s_kernel) is Gaussian
        if self.plain and radius is None:
            bases = Basis(box[0], box[1], self.pars["sigmax_2"]), Basis(box[2], box[3], self.pars["sigmax_2"])
            self.bases = bases if all(b.size for b in bases) else None
        wide, high = box[1] - box[0], box[3] - box[2]
        most = math.hypot(wide, high) if radius is None else radius
        self.decays = None
        if self.plain and len(given) and (1 / self.pars["beta"]).max() * 2 * window < 300:  # or e to that overflows
            self.decays = Decays(1 / self.pars["beta"], 2 * window), Decays(1 / (2 * self.pars["sigmax_2"]), max(most**2, 1e-12), radius is not None)
        self.lags = self.times = None
        if not self.plain and len(given) and s_kernel.decay(**{n: self.pars[n] for n in s_kernel.params}) is not None:
            densities = lambda dt: np.stack([t_kernel.density(dt, **self._of(t_kernel, d)) for d in range(len(given))])
            if radius is None and type(s_kernel) is DoubleExponential:
                self.times = exponentials(densities, window, TOLERANCE)
            lags = Lags(densities, window)
            if lags.size or self.times is not None:
                self.peaks, rates = s_kernel.decay(**{n: self.pars[n] for n in s_kernel.params})
                self.lags, self.far = lags, Decays(rates, max(s_kernel.lag(wide, high) if radius is None else s_kernel.lag(most, most), 1e-12))

    def _of(self, kernel: Kernel, d: int) -> dict[str, float]:
        return {n: float(self.pars[n][d]) for n in kernel.params}

    def masses(self, some: Stretch, n_t: float) -> np.ndarray:
        """(draws,): alpha times the mass of the targets' kernels in the domain and the window, summed."""
        t, x, y = (v[some.own] for v in (some.t, some.x, some.y))
        upper = np.minimum(n_t - t, some.window)
        mass = lambda d: self.t_kernel.measure(upper, **self._of(self.t_kernel, d)) * self.s_kernel.measure(1 - x, x, 1 - y, y, **self._of(self.s_kernel, d))
        return np.array([a * mass(d).sum() for d, a in enumerate(self.alpha)])

    def excite(self, some: Stretch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Targets, (draws, targets) and whether a target has a pair; a block after the other if the kernels allow it."""
        if self.decays is not None:
            rates, variances = 1 / self.pars["beta"], self.pars["sigmax_2"]
            yield from some.decayed(self.alpha * rates / (2 * math.pi * variances), rates, 1 / (2 * variances), *self.decays, self.bases, self.radius)
            return
        values = lambda dt, dx, dy: (a * self.t_kernel.density(dt, **self._of(self.t_kernel, d)) * self.s_kernel.density(dx, dy, **self._of(self.s_kernel, d)) for d, a in enumerate(self.alpha))
        yield np.arange(len(some.own)), *some.sums(self.radius, values, len(self.alpha))

    def totals(self, some: Stretch) -> tuple[np.ndarray, int]:
        """(draws,): the sum of the targets' excitation; and the targets with a pair."""
        if self.times is not None:
            rates, weights = self.times
            sums = Corners(some, rates).totals(1 / self.far.rates)
            return self.alpha * self.peaks * (self.far.weights @ sums * weights).sum(axis=1), int((some.hi > some.lo).sum())
        if self.lags is not None:
            sums, n = some.totals(self.radius, self.lags, self.s_kernel.lag, self.far)
            return self.alpha * self.peaks * (self.lags.weights @ sums * self.far.weights).sum(axis=1), n
        total, n = np.zeros(len(self.alpha)), 0
        for _, e, hit in self.excite(some):
            total, n = total + e[:, hit].sum(axis=1), n + int(hit.sum())
        return total, n


def _box(ev: DataFrame, x: str, y: str) -> tuple[float, float, float, float]:
    row = ev.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return tuple(0.0 if v is None else float(v) for v in row)


def _parts(draws: DataFrame, names: list[str]) -> Iterator[list]:
    ranked = draws.select("draw_id", *[F.col(n).cast("double").alias(n) for n in names]).withColumn("_part", F.floor((F.row_number().over(Window.orderBy("draw_id")) - 1) / DRAWS_AT_ONCE))  # draws only
    last = ranked.agg(F.max("_part")).first()[0]
    for k in range(0 if last is None else last + 1):
        yield ranked.filter(F.col("_part") == k).collect()  # DRAWS_AT_ONCE at most


def _each(ev: DataFrame, draws: DataFrame, t_kernel: Kernel, s_kernel: Kernel, window: float, radius: float | None, names: list[str], extra: list[str], task, schema: str) -> DataFrame:
    """`task(draws, rows of the driver)` makes the function of a group's table; the parts of the draws are united."""
    box, groups = _box(ev, "sx", "sy"), stretches(ev, window, radius, "point_id", "u", "sx", "sy", extra)
    out = []
    for given in _parts(draws, [*dict.fromkeys(["alpha", *t_kernel.params, *s_kernel.params, *names])]):
        out.append(groups.applyInArrow(task(Draws(given, t_kernel, s_kernel, window, radius, box), given), schema))
    return reduce(DataFrame.unionByName, out) if out else ev.sparkSession.createDataFrame([], schema)


def near_excitation(ev: DataFrame, draws: DataFrame, t_kernel: Kernel, s_kernel: Kernel, window: float, radius: float | None = None) -> DataFrame:
    """draw_id, i, excitation: as `likelihood.excitation` on the pairs of the window and radius; rows for events with a pair."""
    schema = "draw_id long, i long, excitation double"

    def task(some: Draws, given: list):
        def run(rows: pa.Table) -> pa.Table:
            stretch, ids, _ = _table(rows, window)
            parts = [(ids[k][hit], e[:, hit]) for k, e, hit in some.excite(stretch)]
            mine = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int64)
            e = np.concatenate([e for _, e in parts], axis=1).ravel() if parts else np.zeros(0)
            return pa.table({"draw_id": np.repeat(some.ids, len(mine)), "i": np.tile(mine, len(some.ids)), "excitation": e})

        return run

    return _each(ev, draws, t_kernel, s_kernel, window, radius, [], [], task, schema)


def excitation_totals(ev: DataFrame, draws: DataFrame, t_kernel: Kernel, s_kernel: Kernel, window: float, radius: float | None = None) -> DataFrame:
    """draw_id, n, excitation: the events with a pair, and the sum of their excitation."""
    def task(some: Draws, given: list):
        def run(rows: pa.Table) -> pa.Table:
            stretch, _, _ = _table(rows, window)
            total, n = some.totals(stretch)
            return pa.table({"draw_id": some.ids, "n": np.full(len(some.ids), n, np.int64), "excitation": total})

        return run

    rows = _each(ev, draws, t_kernel, s_kernel, window, radius, [], [], task, "draw_id long, n long, excitation double")
    return rows.groupBy("draw_id").agg(F.sum("n").alias("n"), F.sum("excitation").alias("excitation")).filter("n > 0")


def near_pairs(ev: DataFrame, window: float, radius: float, key: str = "point_id", t: str = "u", x: str = "sx", y: str = "sy") -> DataFrame:
    """i, j, dt, dx, dy: the rows of `pairs.event_pairs`, met inside the tasks.

    An event is shuffled about one and a half times, for the next stretch and the strips in reach, and not eighteen times for
    all buckets about it. Pairs leave a task some at a time.
    """
    kind = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("dt", pa.float64()), ("dx", pa.float64()), ("dy", pa.float64())])
    most = _squared(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        rows = rows.take(pa.array(np.argsort(rows.column("t").to_numpy(), kind="stable")))
        some, ids = Stretch(*(rows.column(c).to_numpy() for c in ("t", "x", "y")), rows.column("own").to_numpy(), window), rows.column("i").combine_chunks()
        held, count = [], 0
        for k, j in some.blocks(radius):
            once = max(64, NEAR // len(k))
            for low in range(0, len(j), once):
                a, b = np.nonzero(some.hits(k, j[low : low + once], most)[1])
                if len(a):
                    held.append((some.own[k][a], j[low : low + once][b]))
                    count += len(a)
                    if count > PAIRS:
                        yield table(some, ids, held)
                        held, count = [], 0
        if held:
            yield table(some, ids, held)

    def table(some: Stretch, ids: pa.Array, held: list) -> pa.RecordBatch:
        a, b = (np.concatenate([h[n] for h in held]) for n in (0, 1))
        lags = [pa.array(v[a] - v[b]) for v in (some.t, some.x, some.y)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), *lags], schema=kind)

    return stretches(ev, window, radius, key, t, x, y, [], LONG, BROAD).applyInArrow(run, "i long, j long, dt double, dx double, dy double")


#: Where an event finds the value of each field.
CELLS = {"f_t": "time_bin", "f_a": "season_bin", "f_xy": "cell_id", "b_0": "cov_id"}


def event_terms(ev: DataFrame, draws: DataFrame, n_t: float, t_kernel: Kernel, s_kernel: Kernel, window: float, radius: float | None = None, values: DataFrame | None = None) -> DataFrame:
    """draw_id, some, n, itot_excite: the sum of log(excitation + background) over the events with a place, time and background,
    their number, and the kernels' mass up to the time `n_t`.

    The background is exp(a_0 + the sum of the fields' values at the event); `values` are draw_id, field, idx, value of
    the fields (and of the covariate effect, b_0). Those of `DRAWS_AT_ONCE` draws visit the driver.
    """
    names = [] if values is None else sorted(r[0] for r in values.select("field").distinct().collect())
    extra = [CELLS[n] for n in names]

    def task(some: Draws, given: list):
        a_0 = np.array([r["a_0"] for r in given])
        at = {int(d): k for k, d in enumerate(some.ids)}
        tables = {}
        if values is not None:
            held = values.filter(F.col("draw_id").between(int(some.ids.min()), int(some.ids.max()))).select("draw_id", "field", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")).toPandas()
            for n in names:
                one = held[(held["field"] == n) & held["draw_id"].isin(at.keys())]
                tables[n] = np.full((len(at), int(one["idx"].max()) + 2 if len(one) else 1), np.nan)
                tables[n][one["draw_id"].map(at).to_numpy(int), one["idx"].to_numpy(int)] = one["value"].to_numpy()

        def run(rows: pa.Table) -> pa.Table:
            stretch, ids, mine = _table(rows, window)
            places = {n: mine.column(CELLS[n]).fill_null(-1).to_numpy() for n in names}
            total, count = np.zeros(len(a_0)), np.zeros(len(a_0), np.int64)
            for k, e, _ in some.excite(stretch):
                log = np.repeat(a_0[:, None], len(k), axis=1)
                for n in names:
                    idx = places[n][k]
                    log += tables[n][:, np.where((idx < 0) | (idx >= tables[n].shape[1]), -1, idx)]  # the last column is NaN
                terms = np.log(e + np.exp(log))
                known = ~np.isnan(terms)
                total += np.where(known, terms, 0.0).sum(axis=1)
                count += known.sum(axis=1)
            return pa.table({"draw_id": some.ids, "some": total, "n": count, "itot_excite": some.masses(stretch, n_t)})

        return run

    rows = _each(ev, draws, t_kernel, s_kernel, window, radius, ["a_0"], extra, task, "draw_id long, some double, n long, itot_excite double")
    return rows.groupBy("draw_id").agg(F.sum("some").alias("some"), F.sum("n").alias("n"), F.sum("itot_excite").alias("itot_excite"))


def fit_sums(ev: DataFrame, now: dict[str, float], t_kernel: Kernel, s_kernel: Kernel, window: float, radius: float | None, logs: dict[str, tuple[Kernel, dict[str, float]]], mu: float | dict[int, float]) -> dict[str, float]:
    """What a step of EM needs of the pairs, of events by their share: n, f, terms, dt, d2, and a name of `logs` each.

    An event's f is its excitation and its intensity is f + mu, where mu may be a number for each cell_id. Of f, f dt, f d2
    and f times a kernel's log density (`logs`), summed over pairs, the events' sums over their intensities come back;
    terms is the sum of the logarithms of the intensities, and background (cell_id: sum of mu over intensity) if mu is by cell.
    Where `corners` takes the sums, d2 is left out.
    """
    names = list(logs)
    box, groups = _box(ev, "sx", "sy"), stretches(ev, window, radius, "point_id", "u", "sx", "sy", ["cell_id"])
    some = Draws([{"draw_id": 0, **now}], t_kernel, s_kernel, window, radius, box)
    plain = some.bases is not None  # both log densities are linear in dt and in d2
    times = None
    if radius is None and type(s_kernel) is DoubleExponential:

        def in_time(dt: np.ndarray) -> np.ndarray:
            g = t_kernel.density(dt, **some._of(t_kernel, 0))
            return np.stack([g, g * dt, *[g * np.log(kernel.density(dt, **pars)) for kernel, pars in logs.values() if kernel is t_kernel]])

        times = exponentials(in_time, window, TOLERANCE)

    summed = ["f", "dt", *(["d2"] if plain or times is None else []), *names]

    def by_cells(stretch: Stretch) -> np.ndarray:
        """f, f dt and f times the log densities; those in space are linear in |dx| + |dy|."""
        (peak,), (rate,) = s_kernel.decay(**{n: some.pars[n] for n in s_kernel.params})
        rates, weights = times
        held, far = Corners(stretch, rates).sums(1 / rate)
        f, ft, *more = now["alpha"] * peak * (weights @ held.T)
        f = np.maximum(f, 0.0)
        far, rest = now["alpha"] * peak * (far @ weights[0]), iter(more)

        def log_in_space(pars: dict[str, float]) -> np.ndarray:
            top, fall = s_kernel.decay(**pars)
            return f * math.log(top) - far * fall

        return np.stack([f, ft, *[next(rest) if kernel is t_kernel else log_in_space(pars) for kernel, pars in logs.values()]])

    def values(dt: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> Iterator[np.ndarray]:
        f = now["alpha"] * t_kernel.density(dt, **some._of(t_kernel, 0)) * s_kernel.density(dx, dy, **some._of(s_kernel, 0))
        yield from (f, f * dt, f * (dx * dx + dy * dy))
        for kernel, pars in logs.values():
            yield f * np.log(kernel.density(*((dt,) if kernel is t_kernel else (dx, dy)), **pars))

    def log_of(kernel: Kernel, pars: dict[str, float], f: np.ndarray, ft: np.ndarray, fd: np.ndarray) -> np.ndarray:
        if kernel is t_kernel:
            return -f * math.log(pars["beta"]) - ft / pars["beta"]
        return -f * math.log(2 * math.pi * pars["sigmax_2"]) - fd / (2 * pars["sigmax_2"])

    def run(rows: pa.Table) -> pa.Table:
        stretch, _, mine = _table(rows, window)
        if plain:
            rate, variance = np.array([1 / now["beta"]]), np.array([now["sigmax_2"]])
            f, ft, fd = stretch.smooth(now["alpha"] * rate / (2 * math.pi * variance), rate, variance, *some.bases, moments=True)[:, 0]
            sums = np.stack([f, ft, fd, *[log_of(k, p, f, ft, fd) for k, p in logs.values()]])
        elif times is not None:
            sums = by_cells(stretch)
        else:
            sums, _ = stretch.sums(radius, values, 3 + len(names))
        cells = mine.column("cell_id").fill_null(-1).to_numpy()
        back = np.array([mu.get(int(c), np.nan) for c in cells]) if isinstance(mu, dict) else np.full(len(cells), mu)
        held = ~np.isnan(back)
        cells, back, sums = cells[held], back[held], sums[:, held]
        whole = sums[0] + back
        found = [("n", -1, float(len(cells))), ("terms", -1, float(np.log(whole).sum())), *[(n, -1, float((v / whole).sum())) for n, v in zip(summed, sums, strict=True)]]
        if isinstance(mu, dict):
            at, inverse = np.unique(cells, return_inverse=True)
            found += [("background", int(c), float(v)) for c, v in zip(at, np.bincount(inverse, back / whole, len(at)), strict=True)]
        name, cell, value = zip(*found, strict=True)
        return pa.table({"name": pa.array(name), "cell": pa.array(cell, pa.int64()), "value": pa.array(value, pa.float64())})

    rows = groups.applyInArrow(run, "name string, cell long, value double").groupBy("name", "cell").agg(F.sum("value").alias("value")).collect()  # a row for each name and cell
    out = dict.fromkeys(["n", "terms", *summed], 0.0) | {r["name"]: r["value"] for r in rows if r["cell"] < 0}
    return out | {"background": {r["cell"]: r["value"] for r in rows if r["cell"] >= 0}}


def _dominance(x: np.ndarray, at: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query: the number and the sum of the x below `at` among the first `upto` of them, by a wavelet matrix."""
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    bits = max(1, int(len(x)).bit_length())
    bound = np.searchsorted(x[order], at, "left")
    low, high, now, value = np.zeros(len(at), np.int64), upto.astype(np.int64), rank, x
    count, total = np.zeros(len(at), np.int64), np.zeros(len(at))
    for bit in range(bits - 1, -1, -1):
        zero = (now >> bit) & 1 == 0
        zeros, sums = np.concatenate([[0], np.cumsum(zero)]), np.concatenate([[0.0], np.cumsum(np.where(zero, value, 0.0))])
        left, right = zeros[low], zeros[high]
        one = (bound >> bit) & 1 == 1
        count += np.where(one, right - left, 0)
        total += np.where(one, sums[high] - sums[low], 0.0)
        whole = zeros[-1]
        low, high = np.where(one, whole + low - left, left), np.where(one, whole + high - right, right)
        by = np.argsort(~zero, kind="stable")
        now, value = now[by], value[by]
    return count, total


def _extremes(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: bool) -> np.ndarray:
    """The least or largest of v[lo:hi], lo < hi, from tables of runs of powers of two."""
    pick, level, table = np.minimum if least else np.maximum, np.frexp(hi - lo)[1] - 1, v
    out = np.empty(len(lo), v.dtype)
    for k in range(int(level.max(initial=-1)) + 1):
        some = level == k
        out[some] = pick(table[lo[some]], table[hi[some] - (1 << k)])
        table = pick(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def lag_sums(ev: DataFrame, window: float, key: str = "point_id", t: str = "u", x: str | None = None, ends: bool = False, subset: Column | None = None) -> DataFrame:
    """i, n, dt: the earlier events in an event's window, and the sum of their lags; rows for events with one.

    And j_sum, the sum of their keys; with `x`, dx, the sum of the distances |x_i - x_j|; with `ends`, j_least and j_most.
    `subset` limits the events that are answered for, not the earlier ones. Work is n log n by prefix sums, a wavelet matrix
    and tables of extremes: no pair is met.
    """
    named = {"i": "long", "n": "long", "dt": "double", "j_sum": "decimal(38,0)"} | ({"dx": "double"} if x else {}) | ({"j_least": "long", "j_most": "long"} if ends else {})
    asked = "subset" if subset is not None else "own"
    rows = ev if subset is None else ev.withColumn("subset", subset)
    # An event needs no x to have a lag, unless distances are asked for.
    rows = rows.withColumn("_x", F.lit(0.0) if x is None else F.col(x).cast("double"))
    groups = stretches(rows, window, None, key, t, "_x", "_x", ["subset"] if subset is not None else [])

    def run(table: pa.Table) -> pa.Table:
        stretch, _, _ = _table(table, window)
        table = table.take(pa.array(np.argsort(table.column("t").to_numpy(), kind="stable")))
        ids, ask = table.column("i").to_numpy(), table.column(asked).fill_null(False).to_numpy()
        keep = (stretch.hi > stretch.lo) & ask[stretch.own]
        g, lo, hi = stretch.own[keep], stretch.lo[keep], stretch.hi[keep]
        n = hi - lo
        mid = float(stretch.t.mean()) if len(stretch.t) else 0.0
        before = lambda v: np.concatenate([np.zeros(1, v.dtype), np.cumsum(v)])
        times = before(stretch.t - mid)
        out = {"i": pa.array(ids[g], pa.int64()), "n": pa.array(n, pa.int64()), "dt": pa.array(n * (stretch.t[g] - mid) - (times[hi] - times[lo]))}
        # Sums of keys by halves of 32 bits, so that none overflows.
        high, rest = before(ids >> 32), before(ids & 0xFFFFFFFF)
        sums = [(int(a) << 32) + int(b) for a, b in zip(high[hi] - high[lo], rest[hi] - rest[lo], strict=True)]
        out["j_sum"] = pa.array([decimal.Decimal(v) for v in sums], pa.decimal128(38, 0))
        if x:
            at = stretch.x[g]
            mean = float(stretch.x.mean()) if len(stretch.x) else 0.0
            (c1, s1), (c0, s0) = (_dominance(stretch.x - mean, at - mean, k) for k in (hi, lo))
            whole = before(stretch.x - mean)
            below, less, every = c1 - c0, s1 - s0, whole[hi] - whole[lo]
            out["dx"] = pa.array((at - mean) * (2 * below - n) + every - 2 * less)
        if ends:
            out |= {"j_least": pa.array(_extremes(ids, lo, hi, True)), "j_most": pa.array(_extremes(ids, lo, hi, False))}
        return pa.table({c: out[c] for c in named})

    return groups.applyInArrow(run, ", ".join(f"{c} {k}" for c, k in named.items()))


def lag_counts(df: DataFrame, col: str, window: float, key: str = "point_id") -> DataFrame:
    """dt, n, i, j: for each lag the number of pairs, and the sums of their later and earlier keys.

    Equal values of `col` are counted first, so the pairs that meet are of distinct values.
    """
    at = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("t")).agg(F.count("*").alias("n"), F.sum(key).alias("k")).withColumn("b", F.floor(F.col("t") / window))
    earlier = at.select(F.col("t").alias("tj"), F.col("n").alias("nj"), F.col("k").alias("kj"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    dt = F.col("t") - F.col("tj")
    met = at.join(earlier.hint("merge"), "b").filter((dt > 0) & (dt <= window))
    return met.groupBy(dt.alias("dt")).agg(F.sum(F.col("n") * F.col("nj")).alias("n"), F.sum(F.col("k") * F.col("nj")).alias("i"), F.sum(F.col("kj") * F.col("n")).alias("j"))
