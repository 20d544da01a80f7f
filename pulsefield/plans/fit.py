"""Fitting as Spark jobs: background regression, Hawkes EM, importance weights, smoothed fields.

These are point estimates and weights, not samples of a posterior.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pulsefield.config import Domain
from pulsefield.functions.kernels import Exponential, Gaussian, Kernel
from pulsefield.plans import windows
from pulsefield.plans.likelihood import excitation, one_draw

#: Steps of a regression at most.
MOST_STEPS = 200


def fit_background(counts: DataFrame, terms: list[str], ridge: float = 0.0):
    """Poisson regression of column n on indicator `terms` and columns, with offset log(exposure).

    The first step can overshoot far where many counts are zero, and comes back by one for each further
    step; a fit that has not converged after `MOST_STEPS` raises.
    """
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    cats = [t for t in terms if dict(counts.dtypes)[t] in ("int", "bigint")]
    rows = counts.withColumn("offset", F.log("exposure"))
    inputs = [t for t in terms if t not in cats]
    if cats:
        rows = OneHotEncoder(inputCols=cats, outputCols=[c + "_v" for c in cats], handleInvalid="keep").fit(rows).transform(rows)
        inputs += [c + "_v" for c in cats]
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)
    model = GeneralizedLinearRegression(family="poisson", link="log", labelCol="n", offsetCol="offset", regParam=ridge, maxIter=MOST_STEPS).fit(rows)
    if model.summary.numIterations >= MOST_STEPS:
        raise ValueError(f"the regression has not converged in {MOST_STEPS} steps")
    return model


def em_step(pairs: DataFrame | None, ev: DataFrame, d: Domain, a_0: float, alpha: float, beta: float, sigmax_2: float, window: float, radius: float | None = None) -> DataFrame:
    """One row: a_0, alpha, beta, sigmax_2 after one step (exponential and Gaussian kernels).

    A pair's weight is its share of the later event's intensity. The closed forms of beta and sigmax_2
    ignore that pairs end at the window and the radius. Without `pairs` those of window and radius are summed inside tasks.
    """
    sides = (1 - F.col("sx"), F.col("sx"), 1 - F.col("sy"), F.col("sy"))
    mass = Exponential().mass(F.least(d.n_t - F.col("u"), F.lit(float(window))), pars={"beta": beta}) * Gaussian().mass(*sides, pars={"sigmax_2": sigmax_2})
    whole = ev.agg(F.count("*").alias("n"), F.sum(mass).alias("mass"))
    new = lambda rows: rows.select(F.log((F.col("n") - F.col("p")) / (d.n_t * d.area)).alias("a_0"), (F.col("p") / F.col("mass")).alias("alpha"), (F.col("pt") / F.col("p")).alias("beta"), (F.col("pd") / (2 * F.col("p"))).alias("sigmax_2"))
    if pairs is None:
        found = windows.fit_sums(ev, {"alpha": alpha, "beta": beta, "sigmax_2": sigmax_2}, Exponential(), Gaussian(), window, radius, {}, math.exp(a_0))
        return new(whole.withColumns({c: F.lit(found[k]) for c, k in (("p", "f"), ("pt", "dt"), ("pd", "d2"))}))
    f = alpha * Exponential().pdf(F.col("dt"), pars={"beta": beta}) * Gaussian().pdf(F.col("dx"), F.col("dy"), pars={"sigmax_2": sigmax_2})
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    per_event = pairs.select("i", "dt", d2.alias("d2"), f.alias("f")).groupBy("i").agg(F.sum("f").alias("f"), F.sum(F.col("f") * F.col("dt")).alias("ft"), F.sum(F.col("f") * F.col("d2")).alias("fd"))
    mu = F.exp(F.lit(float(a_0)))
    share = F.col("f") / (F.col("f") + mu)
    sums = per_event.agg(F.sum(share).alias("p"), F.sum(F.col("ft") / (F.col("f") + mu)).alias("pt"), F.sum(F.col("fd") / (F.col("f") + mu)).alias("pd"))
    return new(sums.crossJoin(whole))  # a row on each side


def fit_hawkes_em(ev: DataFrame, pairs: DataFrame | None, d: Domain, window: float, start: dict[str, float], iterations: int = 10) -> DataFrame:
    """iteration, a_0, alpha, beta, sigmax_2: the path of a fixed number of EM steps. Persist `pairs`, or give None for those of the window."""
    path, now = [(0, *(float(start[k]) for k in ("a_0", "alpha", "beta", "sigmax_2")))], dict(start)
    for k in range(1, iterations + 1):
        row = em_step(pairs, ev, d, window=window, **now).first()  # four numbers
        now = {c: float(row[c]) for c in ("a_0", "alpha", "beta", "sigmax_2")}
        path.append((k, *now.values()))
    return ev.sparkSession.createDataFrame(path, "iteration int, a_0 double, alpha double, beta double, sigmax_2 double")


#: Steps of a kernel's parameters, in logarithms: for differences, and at most; halvings of a step that lowers the likelihood.
NEAR, FAR, HALVINGS = 0.01, 0.5, 10


def _stencil(now: dict[str, float], kernel: Kernel) -> list[dict[str, float]]:
    """The kernel's parameters moved by -NEAR, 0 or NEAR in the logarithm, in all combinations; the last moves fastest."""
    out: list[dict[str, float]] = [{}]
    for name in kernel.params:
        out = [o | {name: now[name] * math.exp(k * NEAR)} for o in out for k in (-1, 0, 1)]
    return out


def _newton(q: list[float]) -> list[float]:
    """The step, in logarithms, from values on a stencil of one or two parameters; uphill by gradient where the form is not concave."""
    if len(q) == 1:
        return []
    if len(q) == 3:
        slope, bend = (q[2] - q[0]) / (2 * NEAR), (q[2] - 2 * q[1] + q[0]) / NEAR**2
        step = [-slope / bend if bend < 0 else math.copysign(FAR, slope)]
    else:
        a, b = (q[7] - q[1]) / (2 * NEAR), (q[5] - q[3]) / (2 * NEAR)
        aa, bb, ab = (q[7] - 2 * q[4] + q[1]) / NEAR**2, (q[5] - 2 * q[4] + q[3]) / NEAR**2, (q[8] - q[6] - q[2] + q[0]) / (4 * NEAR**2)
        det = aa * bb - ab * ab
        concave = aa < 0 and det > 0
        step = [-(bb * a - ab * b) / det, -(aa * b - ab * a) / det] if concave else [math.copysign(FAR / 2, a), math.copysign(FAR / 2, b)]
    return [max(-FAR, min(FAR, x)) for x in step]


def gem_sums(pairs: DataFrame | None, ev: DataFrame, d: Domain, now: dict[str, float], t_kernel: Kernel, s_kernel: Kernel, window: float, background: DataFrame | None = None) -> Row | dict[str, float]:
    """What one step of `fit_hawkes_gem` needs, from one pass over the pairs and one over the events.

    n; p, the expected number of triggered events; terms, the sum of log intensities at the events; t_k and s_k, the
    expected log densities of the lags at the points of both stencils; mt_k and ms_k, the kernels' mass there. `background`
    (cell_id, mu) takes the place of exp(a_0). Without `pairs` those of the window are summed inside tasks.
    """
    temporal, spatial = _stencil(now, t_kernel), _stencil(now, s_kernel)
    lag, place = (F.col("dt"),), (F.col("dx"), F.col("dy"))
    f = now["alpha"] * t_kernel.pdf(*lag, pars=now) * s_kernel.pdf(*place, pars=now)
    logs = {f"t_{k}": F.log(t_kernel.pdf(*lag, pars=p)) for k, p in enumerate(temporal)} | {f"s_{k}": F.log(s_kernel.pdf(*place, pars=p)) for k, p in enumerate(spatial)}
    sides = (1 - F.col("sx"), F.col("sx"), 1 - F.col("sy"), F.col("sy"))
    t_mass = lambda p: t_kernel.mass(F.least(d.n_t - F.col("u"), F.lit(float(window))), pars=p)
    s_mass = lambda p: s_kernel.mass(*sides, pars=p)
    masses = {f"mt_{k}": t_mass(p) * s_mass(now) for k, p in enumerate(temporal)} | {f"ms_{k}": t_mass(now) * s_mass(p) for k, p in enumerate(spatial)}
    if pairs is None:
        sums = windows.fit_sums(ev, now, t_kernel, s_kernel, window, None, _stencils(now, t_kernel, s_kernel), _mu(now, background))
        held = ev if background is None else ev.join(background, "cell_id", "left_semi")
        row = held.agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in masses.items()]).first()
        # Events without a time or place have no pairs.
        rest = (row["n"] - sums["n"]) * now["a_0"] if background is None else held.filter(_LOST).join(background, "cell_id").agg(F.coalesce(F.sum(F.log("mu")), F.lit(0.0))).first()[0]
        return sums | row.asDict() | {"p": sums["f"], "terms": sums["terms"] + rest}
    per_event = pairs.select("i", f.alias("f"), *[v.alias(k) for k, v in logs.items()]).groupBy(F.col("i").alias("point_id")).agg(F.sum("f").alias("f"), *[F.sum(F.col("f") * F.col(k)).alias(k) for k in logs])
    events = ev.select("point_id", "cell_id", *[v.alias(k) for k, v in masses.items()])
    events = events.withColumn("mu", F.lit(math.exp(now["a_0"]))) if background is None else events.join(background, "cell_id")
    rows = events.join(per_event, "point_id", "left").withColumn("all", F.coalesce("f", F.lit(0.0)) + F.col("mu"))
    share = lambda c: F.sum(F.col(c) / F.col("all"))
    return rows.agg(F.count("*").alias("n"), share("f").alias("p"), F.sum(F.log("all")).alias("terms"), *[share(k).alias(k) for k in logs], *[F.sum(k).alias(k) for k in masses]).first()


_LOST = "u is null or sx is null or sy is null"


def _mu(now: dict[str, float], background: DataFrame | None) -> float | dict[int, float]:
    """The background's rate, or that of each cell: a row for each visits the driver."""
    return math.exp(now["a_0"]) if background is None else {r["cell_id"]: r["mu"] for r in background.collect()}


def _stencils(now: dict[str, float], t_kernel: Kernel, s_kernel: Kernel) -> dict[str, tuple[Kernel, dict[str, float]]]:
    return {f"{q}_{k}": (kernel, p) for q, kernel in (("t", t_kernel), ("s", s_kernel)) for k, p in enumerate(_stencil(now, kernel))}


def declustered_background(pairs: DataFrame | None, ev: DataFrame, d: Domain, now: dict[str, float], t_kernel: Kernel, s_kernel: Kernel, background: DataFrame, length: float, window: float | None = None) -> DataFrame:
    """cell_id, mu: the events, each by its share of background, smoothed over the cells by a Gaussian of `length`.

    Every cell's share is dealt out whole, so the integral over space and time is the expected number of background events.
    """
    if pairs is None:
        held = windows.fit_sums(ev, now, t_kernel, s_kernel, window, None, {}, _mu(now, background))["background"]
        for r in ev.filter(_LOST).join(background, "cell_id", "left_semi").groupBy("cell_id").agg(F.count("*").alias("n")).collect():  # a row for each cell
            held[r["cell_id"]] = held.get(r["cell_id"], 0.0) + r["n"]
    else:
        f = now["alpha"] * t_kernel.pdf(F.col("dt"), pars=now) * s_kernel.pdf(F.col("dx"), F.col("dy"), pars=now)
        per_event = pairs.select(F.col("i").alias("point_id"), f.alias("f")).groupBy("point_id").agg(F.sum("f").alias("f"))
        rows = ev.select("point_id", "cell_id").join(background, "cell_id").join(per_event, "point_id", "left")
        held = {r["cell_id"]: r["m"] for r in rows.groupBy("cell_id").agg(F.sum(F.col("mu") / (F.coalesce("f", F.lit(0.0)) + F.col("mu"))).alias("m")).collect()}  # a row for each cell
    at = (np.arange(d.n_xy) + 0.5) / d.n_xy
    k = np.exp(-0.5 * ((at[:, None] - at) / length) ** 2)
    k /= k.sum(axis=0)  # column by column: what a source deals out
    m = np.zeros((d.n_xy, d.n_xy))
    for cell, value in held.items():
        m[divmod(cell, d.n_xy)] = value
    mu = (k @ m @ k.T) * d.n_xy**2 / d.n_t
    return ev.sparkSession.createDataFrame([(int(c), float(v)) for c, v in enumerate(mu.ravel())], "cell_id int, mu double")


def fit_hawkes_gem(ev: DataFrame, pairs: DataFrame | None, d: Domain, window: float, start: dict[str, float], t_kernel: Kernel, s_kernel: Kernel, iterations: int = 10, smoothing: float | None = None) -> DataFrame:
    """iteration, a_0, alpha, the kernels' parameters, loglik: generalised EM for any kernels of one or two parameters.

    The E-step weighs each pair by its share of the later event's intensity. The M-step moves the kernels' parameters
    by a Newton step, in logarithms, on the expected log density less the logarithm of the kernels' mass in window and
    domain; its differences come from one Spark aggregate, so a kernel gives only its density and mass. A step that
    lowers the likelihood is halved, so the likelihood never falls, up to `HALVINGS` times, after which the fit ends.
    With `smoothing` the background is not exp(a_0) but the declustered events smoothed by that length, estimated
    anew each round (the grid's n_xy^2 numbers visit the driver); a smoothed background can lower the likelihood, and
    its steps are not halved. a_0 is then the logarithm of its mean. Persist `pairs`, or
    give None for those of the window, which are then summed inside tasks.
    """
    names = ["a_0", "alpha", *t_kernel.params, *s_kernel.params]
    spark, path, before = ev.sparkSession, [], None
    now = {n: float(start[n]) for n in names}
    background = None
    if smoothing is not None:
        background = spark.range(d.n_xy**2).select(F.col("id").cast("int").alias("cell_id"), F.lit(math.exp(now["a_0"])).alias("mu"))
    while len(path) <= iterations:
        for _ in range(HALVINGS + 1):
            row = gem_sums(pairs, ev, d, now, t_kernel, s_kernel, window, background)
            mass = row[f"mt_{3 ** len(t_kernel.params) // 2}"]
            loglik = row["terms"] - math.exp(now["a_0"]) * d.n_t * d.area - now["alpha"] * mass
            if before is None or smoothing is not None or loglik >= before[1] - 1e-9 * abs(loglik):
                break
            now = {n: (now[n] + before[0][n]) / 2 if n == "a_0" else math.sqrt(now[n] * before[0][n]) for n in names}
        else:
            break
        path.append((len(path), *[now[n] for n in names], loglik))
        before = (now, loglik)
        after = {"a_0": math.log((row["n"] - row["p"]) / (d.n_t * d.area)), "alpha": row["p"] / mass}
        for kernel, q, m in ((t_kernel, "t", "mt"), (s_kernel, "s", "ms")):
            values = [row[f"{q}_{k}"] - row["p"] * math.log(row[f"{m}_{k}"]) for k in range(3 ** len(kernel.params))]
            after |= {n: now[n] * math.exp(x) for n, x in zip(kernel.params, _newton(values), strict=True)}
        if background is not None:
            background = declustered_background(pairs, ev, d, now, t_kernel, s_kernel, background, smoothing, window)
        now = after
    return spark.createDataFrame(path, "iteration int, " + ", ".join(f"{n} double" for n in [*names, "loglik"]))


def triggered_probability(pairs: DataFrame | None, ev: DataFrame, draw: dict[str, float], t_kernel=None, s_kernel=None, window: float | None = None, radius: float | None = None) -> DataFrame:
    """point_id, p_triggered: the share of an event's intensity that earlier events explain; without `pairs`, those of window and radius."""
    one, kernels = one_draw(ev.sparkSession, **draw), (t_kernel or Exponential(), s_kernel or Gaussian())
    excite = (windows.near_excitation(ev, one, *kernels, window, radius) if pairs is None else excitation(pairs, one, *kernels)).select(F.col("i").alias("point_id"), "excitation")
    e = F.coalesce("excitation", F.lit(0.0))
    return ev.select("point_id").join(excite, "point_id", "left").select("point_id", (e / (e + F.exp(F.lit(float(draw["a_0"]))))).alias("p_triggered"))


def posterior_weights(scores: DataFrame, priors: DataFrame, proposal: DataFrame | None = None) -> DataFrame:
    """draw_id, weight: normalised importance weights of draws, from loglik, log_prior and log_proposal."""
    rows = scores.select("draw_id", "loglik").join(priors, "draw_id")
    rows = rows.join(proposal, "draw_id") if proposal is not None else rows.withColumn("log_proposal", F.lit(0.0))
    lw = rows.select("draw_id", (F.col("loglik") + F.col("log_prior") - F.col("log_proposal")).alias("lw"))
    top = lw.agg(F.max("lw").alias("top"))
    scaled = lw.crossJoin(top).select("draw_id", F.exp(F.col("lw") - F.col("top")).alias("w"))  # one row on the right
    return scaled.crossJoin(scaled.agg(F.sum("w").alias("sum"))).select("draw_id", (F.col("w") / F.col("sum")).alias("weight"))


def weighted_summary(weights: DataFrame, draws: DataFrame, params: list[str]) -> DataFrame:
    """One row: the weighted mean of each parameter and the effective sample size."""
    rows = weights.join(draws, "draw_id")
    return rows.agg(*[F.sum(F.col("weight") * F.col(p)).alias(p) for p in params], (1 / F.sum(F.pow("weight", F.lit(2)))).alias("effective_size"))


def kernel_matrix(a: DataFrame, b: DataFrame, var: float, length: float, jitter: float = 0.0, period: float | None = None) -> DataFrame:
    """i, j, k: exponential-square kernel between two small grids of points (id, x, y); with a period, x runs in a circle."""
    right = b.select(F.col("id").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    gap = F.abs(F.col("x") - F.col("x2"))
    gap = gap if period is None else F.least(gap, F.lit(float(period)) - gap)
    d2 = F.pow(gap, 2) + F.pow(F.col("y") - F.col("y2"), 2)
    k = var * F.exp(-0.5 * d2 / length**2) + F.when(F.col("id") == F.col("j"), jitter).otherwise(0.0)
    return a.crossJoin(right).select(F.col("id").alias("i"), "j", k.alias("k"))  # two dimension tables


def smooth_field(counts: DataFrame, grid: DataFrame, length: float, period: float | None = None) -> DataFrame:
    """idx, value: log of kernel-smoothed counts on a grid (id, x, y), less its mean. counts: idx, n.

    With a period, such as the year of a season field, x runs in a circle.
    """
    k = kernel_matrix(grid, grid, 1.0, length, period=period)
    summed = k.join(counts.select(F.col("idx").alias("j"), "n"), "j", "left").groupBy("i").agg((F.sum(F.col("k") * F.coalesce("n", F.lit(0))) / F.sum("k")).alias("s"))
    logs = summed.select(F.col("i").alias("idx"), F.log(F.col("s") + 1e-9).alias("log"))
    return logs.crossJoin(logs.agg(F.avg("log").alias("mean"))).select("idx", (F.col("log") - F.col("mean")).alias("value"))  # one row on the right


#: Lengths beyond which the separable smoothing takes its kernel as nothing: exp(-32), 1e-14 of the peak.
REACH = 8


def smooth_grid(counts: DataFrame, size: tuple[int, int], step: tuple[float, float], length: float, circular: bool = False) -> DataFrame:
    """ix, iy, value: as `smooth_field` on a regular grid, by one pass along each axis over a banded kernel.

    counts: ix, iy (from 0), n; nulls and places off the grid do not count. Work is the cells times the cells within
    `REACH` lengths of one along an axis, where a table of all pairs has the cells squared. `circular` bends x round.
    """
    (nx, ny), (hx, hy) = size, step

    def band(n: int, h: float, ring: bool) -> tuple[int, int]:
        far = math.ceil(REACH * length / h)
        return (min(far, (n - 1) // 2), min(far, n // 2)) if ring else (min(far, n - 1),) * 2

    def weight(k: Column, h: float) -> Column:
        return F.exp(-0.5 * (k * h / length) * (k * h / length))

    def spread(rows: DataFrame, axis: str, n: int, h: float, ring: bool) -> DataFrame:
        back, ahead = band(n, h, ring)
        low, high = (F.lit(-back), F.lit(ahead)) if ring else (F.greatest(F.lit(-back), -F.col(axis)), F.least(F.lit(ahead), n - 1 - F.col(axis)))
        met = rows.select("ix", "iy", "n", F.explode(F.sequence(low, high)).alias("k"))
        at = F.pmod(F.col(axis) + F.col("k"), F.lit(n)) if ring else F.col(axis) + F.col("k")
        return met.withColumns({axis: at, "n": F.col("n") * weight(F.col("k"), h)}).groupBy("ix", "iy").agg(F.sum("n").alias("n"))

    def mass(axis: str, n: int, h: float, ring: bool) -> Column:
        back, ahead = band(n, h, ring)
        low, high = (F.lit(-back), F.lit(ahead)) if ring else (F.greatest(F.lit(-back), -F.col(axis)), F.least(F.lit(ahead), n - 1 - F.col(axis)))
        return F.aggregate(F.sequence(low, high), F.lit(0.0), lambda a, k: a + weight(k, h))

    inside = F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1)
    rows = counts.filter(inside).select(F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), F.col("n").cast("double").alias("n")).groupBy("ix", "iy").agg(F.sum("n").alias("n"))
    summed = spread(spread(rows, "ix", nx, hx, circular), "iy", ny, hy, False)
    cells = counts.sparkSession.range(nx * ny).select((F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
    share = F.coalesce("n", F.lit(0.0)) / (mass("ix", nx, hx, circular) * mass("iy", ny, hy, False))
    logs = cells.join(summed, ["ix", "iy"], "left").select("ix", "iy", F.log(share + 1e-9).alias("log"))
    return logs.crossJoin(logs.agg(F.avg("log").alias("mean"))).select("ix", "iy", (F.col("log") - F.col("mean")).alias("value"))  # one row on the right


def fit_factors(counts: DataFrame, factors: list[str], prior: float = 1.0, cycles: int | None = None) -> DataFrame:
    """factor, level, effect: the log multipliers of a Poisson rate by the levels of each factor, and the log rate.

    counts: n, exposure and the factors, zeros included. A level's multiplier has a Gamma prior of mean 1 and shape
    `prior`, which also parts factors that move together. Given the others, a factor's multipliers are
    (events + prior) / (expected + prior), so one aggregate by level takes the place of one-hot rows and normal
    equations, and the posterior never falls. It ends when no effect moves by 1e-8 in a cycle and raises after `MOST_STEPS`
    cycles, or takes just `cycles`. A null level is a level; only levels visit the driver. Persist `counts` before.
    """
    spark = counts.sparkSession
    total = counts.agg(F.sum("n"), F.sum("exposure")).first()
    if not total[0] or not total[1]:
        raise ValueError("a rate needs events and exposure")
    rate = total[0] / total[1]
    types = {f: counts.schema[f].dataType.simpleString() for f in factors}
    found = {f: {r[0]: 0.0 for r in counts.select(f).distinct().collect()} for f in factors}
    for k in range(cycles or MOST_STEPS):
        moved = 0.0
        for f in factors:
            rows = counts.withColumn("_mu", F.col("exposure") * rate)
            for g in factors:
                if g != f:
                    levels = spark.createDataFrame([*found[g].items()], f"_level {types[g]}, _effect double")
                    rows = rows.join(levels, F.col(g).eqNullSafe(F.col("_level")), "left").withColumn("_mu", F.col("_mu") * F.exp("_effect")).drop("_level", "_effect")
            sums = rows.groupBy(f).agg(F.log((F.sum("n") + prior) / (F.sum("_mu") + prior))).collect()  # a row for each level
            moved = max([moved, *(abs(r[1] - found[f][r[0]]) for r in sums)])
            found[f] = dict(map(tuple, sums))
        if cycles is None and moved < 1e-8:
            break
        if cycles is None and k == MOST_STEPS - 1:
            raise ValueError(f"the effects have not converged in {MOST_STEPS} cycles")
    out = [("rate", None, math.log(rate)), *((f, None if level is None else str(level), v) for f in factors for level, v in found[f].items())]
    return spark.createDataFrame(out, "factor string, level string, effect double")
