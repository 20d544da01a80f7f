"""Trigger kernels as Column expressions, so that user kernels stay inside code generation.

A temporal kernel has pdf(dt, pars) and mass(upper, pars); a spatial one has pdf(dx, dy, pars) and
mass(right, left, up, down, pars). `pars` maps each name in `params` to a Column or number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Pars = Mapping[str, "Column | float"]


def _c(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; the error is below 1.5e-7."""
    # Fixed values.
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    t = 1 / (1 + p * F.abs(x))
    return F.signum(x) * (1 - ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x))


def _erf(x: np.ndarray) -> np.ndarray:
    """The same, of numbers."""
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    t = 1 / (1 + p * np.abs(x))
    return np.sign(x) * (1 - ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * np.exp(-x * x))


def _nodes(stretches: int, points: int) -> list[tuple[float, float]]:
    """Places in (0, 1) and weights: Gauss-Legendre in stretches that halve towards 0."""
    x, w = np.polynomial.legendre.leggauss(points)
    edges = [0.0] + [2.0 ** -(stretches - 1 - k) for k in range(stretches)]
    return [(float((b - a) * (z + 1) / 2 + a), float((b - a) / 2 * v)) for a, b in zip(edges[:-1], edges[1:], strict=True) for z, v in zip(x, w, strict=True)]


def _summed(nodes: list[tuple[float, float]], value: Callable[[Column], Column]) -> Column:
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in nodes])
    return F.aggregate(rows, F.lit(0.0), lambda a, n: a + n["w"] * value(n["x"]))


class Kernel:
    """Base of all kernels. `params` are the names of the parameters; each needs a prior to be fitted."""

    params: tuple[str, ...] = ()

    def pars(self, columns: Pars | None = None) -> dict[str, Column]:
        """The parameters as columns of a draws table, or the given numbers."""
        given = columns or {}
        return {k: _c(given[k]) if k in given else F.col(k) for k in self.params}

    def pdf(self, *lags: Column, pars: Pars) -> Column:
        raise NotImplementedError

    def density(self, *lags: np.ndarray, **pars: float) -> np.ndarray:
        """The density as numbers, for sums inside a task; a kernel without it is summed over rows of pairs."""
        raise NotImplementedError

    def measure(self, *limits: np.ndarray, **pars: float) -> np.ndarray:
        """The mass as numbers, as of `mass`; goes with `density`."""
        raise NotImplementedError

    def lag(self, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        """The number of which a spatial density is peak exp(-rate lag), see `decay`."""
        raise NotImplementedError

    def decay(self, **pars: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Peak and rate of a spatial density that decays with its `lag`; None for others."""
        return None

    def mass(self, *limits: Column, pars: Pars) -> Column:
        """The integral of the density: from 0 to a limit in time; over (right, left, up, down) of the source in space.

        A kernel that gives only its density is integrated by Gauss-Legendre sums over stretches that halve towards the
        source, where kernels are steep. They are column expressions: 80 densities in time, 72 by 72 in space, so a kernel
        in space should give a closed form where many events are scored.
        """
        if len(limits) == 1:
            (upper,) = limits
            return upper * _summed(_nodes(10, 8), lambda x: self.pdf(upper * x, pars=pars))
        right, left, up, down = limits
        some = _nodes(6, 6)
        quarter = lambda a, b, i, j: a * b * _summed(some, lambda x: _summed(some, lambda y: self.pdf(a * x * i, b * y * j, pars=pars)))
        return sum((quarter(a, b, i, j) for a, i in ((right, 1), (left, -1)) for b, j in ((up, 1), (down, -1))), F.lit(0.0))

    def exponentials(self, tolerance: float, **pars: float) -> tuple[np.ndarray, np.ndarray]:
        """Weights and rates whose sum of w exp(-r t) is the temporal pdf, to `tolerance` of its peak."""
        raise NotImplementedError(f"{type(self).__name__} is no sum of exponentials here; give a window")


class Exponential(Kernel):
    params = ("beta",)

    def pdf(self, dt: Column, pars: Pars) -> Column:
        b = _c(pars["beta"])
        return F.exp(-dt / b) / b

    def density(self, dt: np.ndarray, beta: float) -> np.ndarray:
        return np.exp(dt / -beta) / beta

    def mass(self, upper: Column, pars: Pars) -> Column:
        return 1 - F.exp(-upper / _c(pars["beta"]))

    def measure(self, upper: np.ndarray, beta: float) -> np.ndarray:
        return 1 - np.exp(-upper / beta)

    def exponentials(self, tolerance: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
        return np.array([1 / beta]), np.array([1 / beta])


class PowerLaw(Kernel):
    """Lomax: beta / gamma (1 + t / gamma)^(-beta - 1)."""

    params = ("beta", "gamma")

    def pdf(self, dt: Column, pars: Pars) -> Column:
        b, g = _c(pars["beta"]), _c(pars["gamma"])
        return b / g * F.pow(1 + dt / g, -b - 1)

    def density(self, dt: np.ndarray, beta: float, gamma: float) -> np.ndarray:
        return beta / gamma * np.exp((-beta - 1) * np.log1p(dt / gamma))

    def mass(self, upper: Column, pars: Pars) -> Column:
        b, g = _c(pars["beta"]), _c(pars["gamma"])
        return 1 - F.pow(1 + upper / g, -b)

    def measure(self, upper: np.ndarray, beta: float, gamma: float) -> np.ndarray:
        return 1 - (1 + upper / gamma) ** -beta

    def exponentials(self, tolerance: float, beta: float, gamma: float) -> tuple[np.ndarray, np.ndarray]:
        """A mixture over rates with Gamma(beta + 1) weights, by the trapezoidal rule in the logarithm of the rate."""
        step = 0.8 * math.pi**2 / (math.log(1 / tolerance) + 4)
        low, high = math.log(tolerance) / (beta + 1) - 3, math.log(math.log(1 / tolerance) + 8 * (beta + 1))
        y = np.arange(low, high + step, step)
        return step * np.exp((beta + 1) * y - np.exp(y) - math.lgamma(beta)) / gamma, np.exp(y) / gamma


class Gaussian(Kernel):
    params = ("sigmax_2",)

    def pdf(self, dx: Column, dy: Column, pars: Pars) -> Column:
        s = _c(pars["sigmax_2"])
        return F.exp(-(dx * dx + dy * dy) / (2 * s)) / (2 * math.pi * s)

    def density(self, dx: np.ndarray, dy: np.ndarray, sigmax_2: float) -> np.ndarray:
        return np.exp((dx * dx + dy * dy) / (-2 * sigmax_2)) / (2 * math.pi * sigmax_2)

    def lag(self, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        return dx * dx + dy * dy

    def decay(self, sigmax_2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return 1 / (2 * math.pi * sigmax_2), 1 / (2 * sigmax_2)

    def mass(self, right: Column, left: Column, up: Column, down: Column, pars: Pars) -> Column:
        scale = F.sqrt(2 * _c(pars["sigmax_2"]))
        return (erf(right / scale) + erf(left / scale)) / 2 * (erf(up / scale) + erf(down / scale)) / 2

    def measure(self, right: np.ndarray, left: np.ndarray, up: np.ndarray, down: np.ndarray, sigmax_2: float) -> np.ndarray:
        scale = math.sqrt(2 * sigmax_2)
        return (_erf(right / scale) + _erf(left / scale)) / 2 * (_erf(up / scale) + _erf(down / scale)) / 2


class DoubleExponential(Kernel):
    params = ("Lambda",)

    def pdf(self, dx: Column, dy: Column, pars: Pars) -> Column:
        s = _c(pars["Lambda"])
        return F.exp(-(F.abs(dx) + F.abs(dy)) / s) / F.pow(2 * s, F.lit(2))

    def density(self, dx: np.ndarray, dy: np.ndarray, Lambda: float) -> np.ndarray:
        return np.exp((np.abs(dx) + np.abs(dy)) / -Lambda) / (2 * Lambda) ** 2

    def lag(self, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        return np.abs(dx) + np.abs(dy)

    def decay(self, Lambda: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return 1 / (2 * Lambda) ** 2, 1 / Lambda

    def mass(self, right: Column, left: Column, up: Column, down: Column, pars: Pars) -> Column:
        s = _c(pars["Lambda"])
        side = lambda a, b: 1 - (F.exp(-a / s) + F.exp(-b / s)) / 2
        return side(right, left) * side(up, down)

    def measure(self, right: np.ndarray, left: np.ndarray, up: np.ndarray, down: np.ndarray, Lambda: float) -> np.ndarray:
        side = lambda a, b: 1 - (np.exp(-a / Lambda) + np.exp(-b / Lambda)) / 2
        return side(right, left) * side(up, down)


KERNELS: dict[str, type[Kernel]] = {"exponential": Exponential, "power_law": PowerLaw, "gaussian": Gaussian, "double_exponential": DoubleExponential}
