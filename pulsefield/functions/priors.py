"""Log densities of the priors that parameters may have."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Normal:
    mean: float
    sd: float

    def log_density(self, x: Column) -> Column:
        return -F.pow((x - self.mean) / self.sd, 2) / 2 - math.log(self.sd) - math.log(2 * math.pi) / 2


@dataclass(frozen=True)
class HalfNormal:
    sd: float

    def log_density(self, x: Column) -> Column:
        inside = -F.pow(x / self.sd, 2) / 2 + math.log(2 / math.pi) / 2 - math.log(self.sd)
        return F.when(x >= 0, inside).otherwise(F.lit(float("-inf")))


@dataclass(frozen=True)
class Beta:
    a: float
    b: float

    def log_density(self, x: Column) -> Column:
        constant = math.lgamma(self.a + self.b) - math.lgamma(self.a) - math.lgamma(self.b)
        inside = (self.a - 1) * F.log(x) + (self.b - 1) * F.log(1 - x) + constant
        return F.when((x > 0) & (x < 1), inside).otherwise(F.lit(float("-inf")))


def log_prior(draws: DataFrame, priors: dict[str, Normal | HalfNormal | Beta]) -> DataFrame:
    """draw_id, log_prior: the sum of the log densities of a draw's parameters."""
    for name, prior in priors.items():
        if not isinstance(prior, Normal | HalfNormal | Beta):
            raise TypeError(f"{name} has no usable prior: {prior!r}")
    total = sum((p.log_density(F.col(name)) for name, p in priors.items()), F.lit(0.0))
    return draws.select("draw_id", total.alias("log_prior"))
