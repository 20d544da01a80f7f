"""The domain of a model: where, when, and how finely it is divided."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Domain:
    """Bounds in user units and the number of cells.

    Internal units: x and y from 0 to 1 over the bounds, time from 0 to `n_t`, season from 0 to `n_s`
    over a year of 365 days. `offset` is the day of year of time 0.
    """

    t_max: float
    x_min: float = 0.0
    x_max: float = 1.0
    y_min: float = 0.0
    y_max: float = 1.0
    offset: float = 0.0
    n_t: int = 50
    n_s: int = 24
    n_xy: int = 25
    area: float = 1.0
    year: float = 365.0
