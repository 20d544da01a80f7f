"""Excitation by the whole history of events, without a window and without pairs: work is linear in the events.

Gaussians that are not much narrower than the events' extent are taken in one basis over all of it (`windows.Basis`):
an event is shuffled once, and a stretch of time carries a matrix for each exponential. Narrower ones go by cells:

Space: a Gaussian around a source is expanded around the centre of the target's cell, exp(-(t - s)^2) as a sum of
powers of t times Hermite functions of s, in both axes. A cell is at most two units (sigma times root 2) wide, and
`terms` powers are taken, so many that what is left out stays below `tolerance` of the kernel's peak. A source goes to
the cells within `reach`, beyond which the kernel is below `tolerance` of its peak.

Time: the temporal kernel is a sum of exponentials (one for the exponential kernel; see `Kernel.exponentials`), so a
cell's matrix of sums only decays between events, and stretches of time combine associatively. Three steps, each
spread over all executors:
1. each cell and stretch sums its sources to a matrix, as of the stretch's end;
2. each cell carries these matrices over its stretches, a row per stretch whatever the number of events;
3. each cell and stretch starts from what is carried in and passes its events in blocks: inside a block exactly,
   from earlier blocks by the matrix.
The exchange of events of steps 1 and 3 is the same one. Equal times do not excite each other.

Draws are taken `DRAWS_AT_ONCE` at a time; the parameters of so many visit the driver. Draws whose sigmas need cells of
one size share the copies of the events.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.functions.kernels import Gaussian, Kernel
from pulsefield.plans.windows import Basis

TOLERANCE = 1e-11
#: Events of a stretch on average; draws whose parameters are on the driver at once; rows of a block (one exponential).
PER_STRETCH, DRAWS_AT_ONCE, BLOCK = 4_000, 2_000, 1024
#: With one basis: stretches before they grow longer, how much longer; exponentials and draws at once.
STRETCHES, LONGER, RATES_AT_ONCE, SHARED_DRAWS = 64, 12, 1_000, 64


def terms(half: float, tolerance: float) -> int:
    """Powers for targets up to `half` units from the centre: the rest is below `tolerance`."""
    n, size = 1, 1.0
    while True:
        size *= math.sqrt(2) * half / math.sqrt(n)
        if 4 * 1.09 * size < tolerance and n > 2 * half * half:
            return n
        n += 1


def _hermite(t: np.ndarray, n: int) -> np.ndarray:
    """(n, len(t)): Hermite functions H_k(t) exp(-t^2), over the root of 2^k k!."""
    out = np.zeros((n, len(t)))
    out[0] = np.exp(-t * t)
    if n > 1:
        out[1] = math.sqrt(2) * t * out[0]
    for k in range(1, n - 1):
        out[k + 1] = t * math.sqrt(2 / (k + 1)) * out[k] - math.sqrt(k / (k + 1)) * out[k - 1]
    return out


def _powers(t: np.ndarray, n: int) -> np.ndarray:
    """(n, len(t)): t^k times the root of 2^k / k!."""
    out = np.ones((n, len(t)))
    for k in range(1, n):
        out[k] = out[k - 1] * t * math.sqrt(2 / k)
    return out


class Draw:
    """One draw's numbers: weights and rates of its exponentials, the unit of space, its powers."""

    def __init__(self, alpha: float, weights: np.ndarray, rates: np.ndarray, variance: float, side: float, tolerance: float):
        self.unit = math.sqrt(2 * variance)
        self.weights, self.rates = alpha * weights / (2 * math.pi * variance), rates
        self.n = terms(side / 2 / self.unit, tolerance)
        self.block = max(128, int(BLOCK / math.sqrt(len(rates))))

    def sums(self, u: np.ndarray, x: np.ndarray, y: np.ndarray, at: float) -> np.ndarray:
        """(exponentials, n, n): the sources' matrix as of time `at`; x and y are from the cell's centre."""
        hx, hy = _hermite(x / self.unit, self.n), _hermite(y / self.unit, self.n)
        decayed = np.exp(-np.outer(self.rates, at - u))
        out = np.zeros((len(self.rates), self.n, self.n))
        for low in range(0, len(u), 1024):  # bounds the products in memory
            some = slice(low, low + 1024)
            out += (hx[None, :, some] * decayed[:, None, some]) @ hy[:, some].T
        return out

    def excite(self, u: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, carried: np.ndarray, start: float) -> np.ndarray:
        """The excitation of the own rows among rows in order of time, with `carried` as of `start`."""
        out, now, at = np.zeros(len(u)), carried, start
        for low, high in _blocks(u, self.block):
            t = np.flatnonzero(own[low:high]) + low
            if len(t):
                px, py = _powers(x[t] / self.unit, self.n), _powers(y[t] / self.unit, self.n)
                decayed = np.exp(-np.outer(self.rates, u[t] - at)) * self.weights[:, None]
                out[t] += (decayed * ((now.transpose(0, 2, 1) @ px) * py).sum(axis=1)).sum(axis=0)
                if u[low] < u[high - 1]:
                    dt = u[t][:, None] - u[None, low:high]
                    d2 = (x[t][:, None] - x[None, low:high]) ** 2 + (y[t][:, None] - y[None, low:high]) ** 2
                    earlier = dt > 0
                    lag = np.where(earlier, dt, 0)
                    f = sum(w * np.exp(-r * lag) for w, r in zip(self.weights, self.rates, strict=True))
                    out[t] += (np.where(earlier, f, 0) * np.exp(-d2 / self.unit**2)).sum(axis=1)
            end = float(u[high - 1])
            now = now * np.exp(-self.rates * (end - at))[:, None, None] + self.sums(u[low:high], x[low:high], y[low:high], end)
            at = end
        return out


def _blocks(u: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of about `size` rows that part no equal times; many rows of one time are a block of their own."""
    edges = np.append(np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])), len(u)) if len(u) else np.zeros(1, int)
    low = 0
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        if end - low > size and begin > low:
            yield low, int(begin)
            low = int(begin)
    if len(u):
        yield low, len(u)


def _sorted(table: pa.Table, side: float) -> tuple[np.ndarray, ...]:
    """u, and x and y from the cell's centre, in order of time; and the order."""
    u, x, y, cx, cy = (table.column(c).to_numpy() for c in ("u", "sx", "sy", "cx", "cy"))
    order = np.argsort(u, kind="stable")
    return u[order], (x - (cx + 0.5) * side)[order], (y - (cy + 0.5) * side)[order], order


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


_KEY = "level int, cx long, cy long, stretch long"


def _some(ev: DataFrame, draws: dict[int, tuple[float, np.ndarray, np.ndarray, float]], tolerance: float, per_stretch: int) -> DataFrame:
    """draw_id, i, excitation for the given draws {draw_id: alpha, weights, rates, variance}."""
    spark = ev.sparkSession
    base = ev.select(F.col("point_id").cast("long").alias("i"), "u", "sx", "sy").filter("u is not null and sx is not null and sy is not null")
    row = base.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("u", "sx", "sy") for k, f in (("low", F.min), ("high", F.max))]).first()
    if not row["n"] or not draws:
        return spark.createDataFrame([], "draw_id long, i long, excitation double")
    start = float(row["low_u"])
    stretches = max(1, math.ceil(row["n"] / per_stretch))
    width = max(1e-9, (row["high_u"] - start) / stretches)
    levels: dict[int, dict[int, Draw]] = {}
    reach: dict[int, float] = {}
    for draw_id, (alpha, weights, rates, variance) in draws.items():
        level = math.floor(math.log2(2 * math.sqrt(2 * variance)))
        levels.setdefault(level, {})[draw_id] = Draw(alpha, weights, rates, variance, 2.0**level, tolerance)
        reach[level] = max(reach.get(level, 0.0), math.sqrt(2 * variance * math.log(1 / tolerance)))

    def cells(axis: str, level: int):
        side, r, c = 2.0**level, reach[level], F.col(axis)
        low, high = (math.floor(row[f"{k}_{axis}"] / side) for k in ("low", "high"))
        return F.sequence(F.greatest(F.floor((c - r) / side), F.lit(low)), F.least(F.floor((c + r) / side), F.lit(high)))

    stretch = F.least(F.floor((F.col("u") - start) / width), F.lit(stretches - 1)).alias("stretch")
    copies = None
    for level in sorted(levels):
        side = 2.0**level
        own = (F.floor(F.col("sx") / side) == F.col("cx")) & (F.floor(F.col("sy") / side) == F.col("cy"))
        some = base.select("*", stretch, F.explode(cells("sx", level)).alias("cx")).select("*", F.explode(cells("sy", level)).alias("cy"))
        some = some.select(F.lit(level).alias("level"), "cx", "cy", "stretch", "i", "u", "sx", "sy", own.alias("own"))
        copies = some if copies is None else copies.union(some)
    keys = ["level", "cx", "cy", "stretch"]

    def summed(table: pa.Table) -> pa.Table:
        level, cx, cy, s = (table.column(k)[0].as_py() for k in keys)
        u, x, y, _ = _sorted(table, 2.0**level)
        at = start + (s + 1) * width
        return _rows(f"draw_id long, {_KEY}, sums array<double>", [(k, level, cx, cy, s, d.sums(u, x, y, at).ravel()) for k, d in levels[level].items()])

    def carried(table: pa.Table) -> pa.Table:
        level, cx, cy, k = (table.column(c)[0].as_py() for c in ("level", "cx", "cy", "draw_id"))
        stretches = table.column("stretch").to_numpy()
        rates, now, before, out = levels[level][k].rates, None, 0, []
        for at in np.argsort(stretches):
            s = int(stretches[at])
            if now is not None:
                now = now * np.exp(-rates * (s - before - 1) * width)[:, None]
                out.append((k, level, cx, cy, s, now.ravel()))
            sums = np.asarray(table.column("sums")[int(at)].values.to_numpy()).reshape(len(rates), -1)
            now = sums if now is None else now * np.exp(-rates * width)[:, None] + sums
            before = s
        return _rows(f"draw_id long, {_KEY}, carried array<double>", out)

    def excited(rows: pa.Table, before: pa.Table | None = None) -> pa.Table:
        if not rows.num_rows or not pc.any(rows.column("own")).as_py():
            return _rows("draw_id long, i long, excitation double", [])
        level, s = rows.column("level")[0].as_py(), rows.column("stretch")[0].as_py()
        u, x, y, order = _sorted(rows, 2.0**level)
        own, ids = rows.column("own").to_numpy()[order], rows.column("i").to_numpy()[order]
        known = {} if before is None else {k.as_py(): v.values.to_numpy() for k, v in zip(before.column("draw_id"), before.column("carried"), strict=True)}
        out = []
        for k, d in levels[level].items():
            shape = (len(d.rates), d.n, d.n)
            now = np.asarray(known[k]).reshape(shape) if k in known else np.zeros(shape)
            e = d.excite(u, x, y, own, now, start + s * width)
            out.append(pa.table({"draw_id": pa.array(np.full(int(own.sum()), k)), "i": pa.array(ids[own]), "excitation": pa.array(np.maximum(e[own], 0.0))}))
        return pa.concat_tables(out)

    if stretches == 1:
        return copies.groupBy(*keys).applyInArrow(lambda rows: excited(rows), "draw_id long, i long, excitation double")
    sums = copies.groupBy(*keys).applyInArrow(summed, f"draw_id long, {_KEY}, sums array<double>")
    carries = sums.groupBy("level", "cx", "cy", "draw_id").applyInArrow(carried, f"draw_id long, {_KEY}, carried array<double>")
    return copies.groupBy(*keys).cogroup(carries.groupBy(*keys)).applyInArrow(excited, "draw_id long, i long, excitation double")


class Shared:
    """Draws whose Gaussians share a basis: alpha, weights and rates of the exponentials, variances."""

    def __init__(self, draws: dict[int, tuple[float, np.ndarray, np.ndarray, float]], bases: tuple[Basis, Basis], density):
        self.ids, self.bases, self.density = list(draws), bases, density
        self.variances = np.array([d[3] for d in draws.values()])
        self.scale = np.array([d[0] for d in draws.values()]) / (2 * math.pi * self.variances)
        self.weights, self.rates = np.concatenate([d[1] for d in draws.values()]), np.concatenate([d[2] for d in draws.values()])
        self.starts = np.concatenate([[0], np.cumsum([len(d[1]) for d in draws.values()])])
        self.block = 64 if len(self.rates) <= 4 * len(draws) else 256

    def features(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        px, py = self.bases[0].at(x), self.bases[1].at(y)
        return (px[:, :, None] * py[:, None]).reshape(len(x), -1)

    def sums(self, u: np.ndarray, x: np.ndarray, y: np.ndarray, at: float) -> np.ndarray:
        """(rates, functions): the sources' matrices as of time `at`."""
        out = np.zeros((len(self.rates), self.bases[0].size * self.bases[1].size))
        for low in range(0, len(u), 256):  # bounds the products in memory
            some = slice(low, low + 256)
            out += np.exp(-np.outer(self.rates, at - u[some])) @ self.features(x[some], y[some])
        return out

    def excite(self, u: np.ndarray, x: np.ndarray, y: np.ndarray, now: np.ndarray, at: float) -> np.ndarray:
        """(draws, rows): the excitation of rows in order of time, with the matrices `now` as of the time `at`."""
        out, (bx, by) = np.zeros((len(self.ids), len(u))), self.bases
        for low, high in _blocks(u, self.block):
            whole = slice(low, high)
            end = float(u[high - 1])
            kept = now.reshape(-1, bx.size, by.size)
            turned = np.concatenate([bx.matrices[d] @ kept[a:b] @ by.matrices[d] for d, (a, b) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True))])
            now = now * np.exp(-self.rates * (end - at))[:, None]
            for first in range(low, high, self.block):  # more than a block only at one time
                some = slice(first, min(first + self.block, high))
                held = self.features(x[some], y[some])
                e = (turned.reshape(len(self.rates), -1) @ held.T) * np.exp(-np.outer(self.rates, u[some] - at)) * self.weights[:, None]
                out[:, some] = np.add.reduceat(e, self.starts[:-1], axis=0)
                now += np.exp(-np.outer(self.rates, end - u[some])) @ held
                if u[low] < end:
                    dt = u[some][:, None] - u[whole]
                    d2 = (x[some][:, None] - x[whole]) ** 2 + (y[some][:, None] - y[whole]) ** 2
                    earlier = dt > 0
                    lag = np.where(earlier, dt, 0.0)
                    for d, v in enumerate(self.variances):
                        f = self.density(lag, d)
                        f *= np.exp(d2 / (-2 * v))
                        f *= earlier
                        out[d, some] += f.sum(axis=1)
            at = end
        return np.maximum(out * self.scale[:, None], 0.0)


def _shared(ev: DataFrame, shared: Shared, row, per_stretch: int) -> DataFrame:
    """draw_id, i, excitation of events that `row` (n, low_u, high_u) is about."""
    schema = "draw_id long, i long, excitation double"
    base = ev.select(F.col("point_id").cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in ("u", "sx", "sy")]).filter("u is not null and sx is not null and sy is not null")
    start, stretches = float(row["low_u"]), max(1, math.ceil(row["n"] / per_stretch))
    if stretches > STRETCHES:
        stretches = max(STRETCHES, math.ceil(stretches / LONGER))
    width = max(1e-9, (row["high_u"] - start) / stretches)
    rows = base.withColumn("stretch", F.least(F.floor((F.col("u") - start) / width), F.lit(stretches - 1)))
    # The rows are few and their work is much, so they must not be drawn together by size.
    rows = rows.repartition(int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stretch")

    def ordered(table: pa.Table) -> tuple[np.ndarray, ...]:
        u, x, y, ids = (table.column(c).to_numpy() for c in ("u", "sx", "sy", "i"))
        order = np.argsort(u, kind="stable")
        return u[order], x[order], y[order], ids[order]

    def summed(table: pa.Table) -> pa.Table:
        s = table.column("stretch")[0].as_py()
        u, x, y, _ = ordered(table)
        return _rows("rate int, stretch long, sums array<double>", [(n, s, v) for n, v in enumerate(shared.sums(u, x, y, start + (s + 1) * width))])

    def carried(table: pa.Table) -> pa.Table:
        n, stretches = table.column("rate")[0].as_py(), table.column("stretch").to_numpy()
        rate, now, before, out = shared.rates[n], None, 0, []
        for at in np.argsort(stretches):
            s = int(stretches[at])
            if now is not None:
                out.append((n, s, now * math.exp(-rate * (s - before - 1) * width)))
            sums = np.asarray(table.column("sums")[int(at)].values.to_numpy())
            now = sums if now is None else now * math.exp(-rate * (s - before) * width) + sums
            before = s
        return _rows("rate int, stretch long, carried array<double>", out)

    def excited(table: pa.Table, before: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(schema, [])
        u, x, y, ids = ordered(table)
        now = np.zeros((len(shared.rates), shared.bases[0].size * shared.bases[1].size))
        for n, v in zip(before.column("rate"), before.column("carried"), strict=True):
            now[n.as_py()] = v.values.to_numpy()
        e = shared.excite(u, x, y, now, start + table.column("stretch")[0].as_py() * width)
        return pa.table({"draw_id": np.repeat(np.array(shared.ids, np.int64), len(ids)), "i": np.tile(ids, len(shared.ids)), "excitation": e.ravel()})

    sums = rows.groupBy("stretch").applyInArrow(summed, "rate int, stretch long, sums array<double>")
    carries = sums.groupBy("rate").applyInArrow(carried, "rate int, stretch long, carried array<double>")
    return rows.groupBy("stretch").cogroup(carries.groupBy("stretch")).applyInArrow(excited, schema)


def _in_one_basis(ev: DataFrame, given: dict, pars: dict, t_kernel: Kernel, per_stretch: int) -> DataFrame | None:
    """As `_some`, if the Gaussians of all the draws have a small basis over the events' extent."""
    base = ev.filter("u is not null and sx is not null and sy is not null")
    row = base.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("u", "sx", "sy") for k, f in (("low", F.min), ("high", F.max))]).first()
    if not row["n"] or not given:
        return None
    exact, out, ids = type(t_kernel).density is not Kernel.density, None, list(given)
    once = max(1, min(SHARED_DRAWS, RATES_AT_ONCE // max(len(d[1]) for d in given.values())))
    for low in range(0, len(ids), once):
        some = {k: given[k] for k in ids[low : low + once]}
        variances = np.array([d[3] for d in some.values()])
        bases = tuple(Basis(float(row[f"low_{c}"]), float(row[f"high_{c}"]), variances) for c in ("sx", "sy"))
        if not all(b.size for b in bases):
            return None
        own, sums = [pars[k] for k in some], [(d[1], d[2]) for d in some.values()]

        def density(lag: np.ndarray, d: int, own=own, sums=sums) -> np.ndarray:
            return t_kernel.density(lag, **own[d]) if exact else sum(w * np.exp(-r * lag) for w, r in zip(*sums[d], strict=True))

        part = _shared(ev, Shared(some, bases, density), row, per_stretch)
        out = part if out is None else out.unionByName(part)
    return out


def full_excitation(ev: DataFrame, draws: DataFrame, t_kernel: Kernel, s_kernel: Kernel, tolerance: float = TOLERANCE, per_stretch: int = PER_STRETCH) -> DataFrame:
    """draw_id, i, excitation of every event by all earlier ones, for each draw; a row for every event and draw."""
    if not isinstance(s_kernel, Gaussian):
        raise TypeError("the whole history is summed for the Gaussian kernel only; give a window for others")
    names = ["alpha", *t_kernel.params, *s_kernel.params]
    ranked = draws.select("draw_id", *[F.col(n).cast("double").alias(n) for n in names]).withColumn("_part", F.floor((F.row_number().over(Window.orderBy("draw_id")) - 1) / DRAWS_AT_ONCE))
    parts, out = ranked.agg(F.max("_part")).first()[0], None
    for k in range(0 if parts is None else parts + 1):
        rows = ranked.filter(F.col("_part") == k).collect()  # DRAWS_AT_ONCE at most
        given = {r["draw_id"]: (r["alpha"], *t_kernel.exponentials(tolerance, **{p: r[p] for p in t_kernel.params}), r[s_kernel.params[0]]) for r in rows}
        some = _in_one_basis(ev, given, {r["draw_id"]: {p: r[p] for p in t_kernel.params} for r in rows}, t_kernel, per_stretch)
        some = _some(ev, given, tolerance, per_stretch) if some is None else some
        out = some if out is None else out.unionByName(some)
    return ev.sparkSession.createDataFrame([], "draw_id long, i long, excitation double") if out is None else out
