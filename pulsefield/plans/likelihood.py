"""Log-likelihoods of log-Gaussian Cox, Hawkes and Cox-Hawkes models, for one or many draws.

With piecewise-constant fields a Cox model needs only counts per cell: the events are scanned once, and
any number of draws is scored on the counts. Only the logarithm of background plus excitation needs a
row per event. Fields are small tables beside the events; joins leave their strategy to Spark, which
checks sizes, and draws are broadcast by a number of bytes at a time.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefield.config import Domain
from pulsefield.functions.kernels import Exponential, Gaussian, Kernel
from pulsefield.functions.priors import Beta, HalfNormal, Normal
from pulsefield.operators import pairs as pair_ops
from pulsefield.operators import spatial
from pulsefield.operators.prepare import clean_events, prepare, season_of_time, space_grid
from pulsefield.plans import windows
from pulsefield.plans.history import full_excitation

#: Draws that a row of pairs or events meets at once.
DRAWS = 8
#: Bytes of draws that are broadcast at once.
AT_ONCE = 64 << 20
#: Bytes of a broadcast row beside its draws.
ROW = 64


def sufficient_counts(ev: DataFrame, covariate: str | None = None) -> DataFrame:
    """field, idx, n: events per time, season and space cell (and covariate cell), from one scan."""
    names = {"f_t": "time_bin", "f_a": "season_bin", "f_xy": "cell_id"} | ({"b_0": covariate} if covariate else {})
    cells = F.inline(F.array(*[F.struct(F.lit(k).alias("field"), F.col(v).cast("long").alias("idx")) for k, v in names.items()]))
    return ev.select(cells).groupBy("field", "idx").agg(F.count("*").alias("n"))


def covariate_effect(cov: DataFrame, draws: DataFrame, weights: Mapping[str, str], key: str = "cov_id") -> DataFrame:
    """draw_id, the key, b_0: the linear predictor of each covariate cell; weights maps covariate to weight."""
    stack = lambda names: F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(v).alias("v")) for k, v in names]))
    values = cov.select(key, stack([(c, c) for c in weights])).withColumnRenamed("v", "value")
    given = draws.select("draw_id", stack(list(weights.items()))).withColumnRenamed("v", "weight")
    return values.join(given, "name").groupBy("draw_id", key).agg(F.sum(F.col("value") * F.col("weight")).alias("b_0"))


def standardize(cov: DataFrame, columns: list[str]) -> DataFrame:
    """Covariates less their mean, over their population deviation; a constant one becomes null."""
    stats = cov.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.nullif(F.col(f"{c}_sd"), F.lit(0.0)) for c in columns}
    return cov.crossJoin(stats).withColumns(scaled).select(*cov.columns)  # one row on the right


def _in_blocks(draws: DataFrame, names: list[str]) -> DataFrame:
    """block, size and for each name the values of up to `DRAWS` draws as an array, in one order."""
    rows = draws.select("draw_id", *[F.col(n).cast("double").alias(n) for n in names])
    numbered = rows.withColumn("block", F.floor((F.row_number().over(Window.orderBy("draw_id")) - 1) / DRAWS))  # draws only
    packed = numbered.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("draw_id", *names))).alias("d"))
    return packed.select("block", *[F.col(f"d.{n}").alias(n) for n in ("draw_id", *names)])  # an array of each member


def _at(k: int, name: str) -> Column:
    return F.get(F.col(name), F.lit(k))


def _by_draw(rows: DataFrame, blocks: DataFrame, keys: list[str], value, name: str) -> DataFrame:
    """draw_id, the keys and the sum of value(element) for each draw, where element(n) is its parameter n.

    A row meets each block of draws once, not each draw, and a block's sums are shuffled as one row. Blocks are
    broadcast, at most `AT_ONCE` bytes of them; the rows meet more than that in turns.
    """
    found = blocks.agg(F.max(F.size("draw_id")), F.max("block")).first()
    n, last = max(1, found[0] or 0), found[1] or 0  # DRAWS, or fewer if there are no more
    at_once = max(1, AT_ONCE // (8 * DRAWS * len(blocks.columns)))

    def turn(some: DataFrame) -> DataFrame:
        sums = rows.join(F.broadcast(some)).groupBy("block", *keys).agg(*[F.sum(value(partial(_at, k))).alias(f"_{k}") for k in range(n)])
        each = F.arrays_zip(F.col("draw_id"), F.slice(F.array(*[f"_{k}" for k in range(n)]), F.lit(1), F.size("draw_id")).alias("sum"))
        return sums.join(F.broadcast(some.select("block", "draw_id")), "block").select(*keys, F.inline(each)).select("draw_id", *keys, F.col("sum").alias(name))

    turns = [blocks.filter(F.col("block").between(k, k + at_once - 1)) for k in range(0, last + 1, at_once)] if last >= at_once else [blocks]
    return reduce(DataFrame.unionByName, map(turn, turns))


def background_at_events(ev: DataFrame, fields: DataFrame, draws: DataFrame, effect: DataFrame | None = None) -> DataFrame:
    """draw_id, point_id, background: exp(a_0 + f_t + f_a + f_xy + b_0) at each event.

    Fields and the covariate effect (draw_id, cov_id, b_0; needs cov_id in `ev`) become an array of draws for each cell.
    These tables and the draws are broadcast, at most `AT_ONCE` bytes of them, so that no array is shuffled with an event;
    more draws are met in turns. The bare events are dealt out first: a small file of them has many rows to give.
    """
    ids = draws.select("draw_id", "a_0", (F.row_number().over(Window.orderBy("draw_id")) - 1).alias("k"))  # draws only
    values = fields.select("draw_id", "field", F.col("idx").cast("long").alias("idx"), "value")
    cells = {"f_t": "time_bin", "f_a": "season_bin", "f_xy": "cell_id"}
    if effect is not None:
        values = values.unionByName(effect.select("draw_id", F.lit("b_0").alias("field"), F.col("cov_id").cast("long").alias("idx"), F.col("b_0").alias("value")))
        cells["b_0"] = "cov_id"
    # Every draw in every cell, so that all arrays have the same order.
    known = values.select("field", "idx").distinct()
    full = known.crossJoin(ids.select("draw_id", "k")).join(values, ["field", "idx", "draw_id"], "left")
    n, fits = draws.count(), (AT_ONCE // max(1, known.count()) - ROW) // 8  # draws of all cells that fit
    at_once, small = (fits, F.broadcast) if fits > 0 else (DRAWS, lambda table: table)

    # A fixed number of partitions, which are not drawn together by size.
    events = ev.select("point_id", *cells.values()).repartition(int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions")), "point_id")

    def turn(first: int) -> DataFrame:
        mine = F.col("k").between(first, first + at_once - 1)
        arrays = full.filter(mine).groupBy("field", "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("v"))
        out = events
        for name, cell in cells.items():
            out = out.join(small(arrays.filter(F.col("field") == name).select(F.col("idx").alias(cell), F.col("v").alias(name))), cell, "left")
        total = sum((F.get(name, F.col("k") - first) for name in cells), F.col("a_0"))
        return out.crossJoin(F.broadcast(ids.filter(mine))).select("draw_id", "point_id", F.exp(total).alias("background"))

    return reduce(DataFrame.unionByName, map(turn, range(0, max(1, n), at_once)))


def excitation(pairs: DataFrame, draws: DataFrame, t_kernel: Kernel, s_kernel: Kernel) -> DataFrame:
    """draw_id, i, excitation: alpha times the sum over earlier events; rows only for events with a pair."""
    names = ["alpha", *t_kernel.params, *s_kernel.params]

    def value(p):
        of = lambda kernel: kernel.pars({n: p(n) for n in kernel.params})
        return p("alpha") * t_kernel.pdf(F.col("dt"), pars=of(t_kernel)) * s_kernel.pdf(F.col("dx"), F.col("dy"), pars=of(s_kernel))

    return _by_draw(pairs.select("i", "dt", "dx", "dy"), _in_blocks(draws, names), ["i"], value, "excitation")


def excitation_integral(ev: DataFrame, draws: DataFrame, d: Domain, t_kernel: Kernel, s_kernel: Kernel, window: float | None = None) -> DataFrame:
    """draw_id, itot_excite: alpha times the mass that each event's kernel has inside the domain (and the window)."""
    upper = d.n_t - F.col("u")
    upper = upper if window is None else F.least(upper, F.lit(float(window)))
    sides = (1 - F.col("sx"), F.col("sx"), 1 - F.col("sy"), F.col("sy"))
    names = ["alpha", *t_kernel.params, *s_kernel.params]

    def value(p):
        of = lambda kernel: kernel.pars({n: p(n) for n in kernel.params})
        return p("alpha") * t_kernel.mass(upper, pars=of(t_kernel)) * s_kernel.mass(*sides, pars=of(s_kernel))

    return _by_draw(ev.select("u", "sx", "sy"), _in_blocks(draws, names), [], value, "itot_excite")


def _field(fields: DataFrame, name: str, idx: str, value: str | None = None) -> DataFrame:
    return fields.filter(F.col("field") == name).select("draw_id", F.col("idx").cast("int").alias(idx), F.col("value").alias(value or name))


def time_integral(fields: DataFrame, draws: DataFrame, d: Domain) -> DataFrame:
    """draw_id, itot_time: the integral over time on the season diagonal."""
    seasons = season_of_time(draws.sparkSession, d)
    rows = _field(fields, "f_t", "time_bin").join(seasons, "time_bin").join(_field(fields, "f_a", "season_bin"), ["draw_id", "season_bin"]).join(draws.select("draw_id", "a_0"), "draw_id")
    return rows.groupBy("draw_id").agg(F.sum(F.exp(F.col("a_0") + F.col("f_t") + F.col("f_a"))).alias("itot_time"))


def space_integral(fields: DataFrame, d: Domain, cells: DataFrame | None = None) -> DataFrame:
    """draw_id, itot_xy: the integral over space without covariates, over the given cells or all."""
    f = _field(fields, "f_xy", "cell_id")
    f = f if cells is None else f.join(cells.select("cell_id").distinct(), "cell_id", "left_semi")
    return f.groupBy("draw_id").agg((F.sum(F.exp("f_xy")) / d.n_xy**2).alias("itot_xy"))


def space_integral_covariates(fields: DataFrame, overlay: DataFrame, effect: DataFrame, key: str = "cov_id") -> DataFrame:
    """draw_id, itot_xy over the common parts of cells and covariate polygons."""
    rows = overlay.join(_field(fields, "f_xy", "cell_id"), "cell_id").join(effect, ["draw_id", key])
    return rows.groupBy("draw_id").agg(F.sum(F.exp(F.col("b_0") + F.col("f_xy")) * F.col("area")).alias("itot_xy"))


def hawkes_integral(draws: DataFrame, d: Domain) -> DataFrame:
    """draw_id, itot_back: the integral of a constant background."""
    return draws.select("draw_id", (F.exp("a_0") * d.n_t * d.area).alias("itot_back"))


def hawkes_integral_covariates(draws: DataFrame, effect: DataFrame, areas: DataFrame, d: Domain, key: str = "cov_id") -> DataFrame:
    """draw_id, itot_back: the integral of a background with covariates, polygon by polygon."""
    rows = effect.join(areas.select(key, "area"), key).join(draws.select("draw_id", "a_0"), "draw_id")
    return rows.groupBy("draw_id").agg((F.sum(F.exp(F.col("a_0") + F.col("b_0")) * F.col("area")) * d.n_t).alias("itot_back"))


def rates(fields: DataFrame, draws: DataFrame, d: Domain) -> DataFrame:
    """draw_id, field, idx, rate: the marginal rates over time, season and space, and `part`, their share of the integral.

    The rate over time has the intercept; that over space is for a cell of unit area.
    """
    rows = fields.join(draws.select("draw_id", "a_0"), "draw_id")
    rate = F.when(F.col("field") == "f_t", F.exp(F.col("value") + F.col("a_0"))).otherwise(F.exp("value"))
    width = F.when(F.col("field") == "f_xy", F.lit(1.0 / d.n_xy**2)).otherwise(F.lit(1.0))
    return rows.select("draw_id", "field", "idx", rate.alias("rate"), (rate * width).alias("part"))


def marginal_rates(fields: DataFrame, draws: DataFrame, d: Domain) -> DataFrame:
    """draw_id, itot_t, itot_a, itot_xy: the marginal integrals that are reported beside the likelihood."""
    of = lambda name: F.sum(F.when(F.col("field") == name, F.col("part")))
    return rates(fields, draws, d).groupBy("draw_id").agg(of("f_t").alias("itot_t"), of("f_a").alias("itot_a"), of("f_xy").alias("itot_xy"))


def hawkes_scores(ev: DataFrame, pairs: DataFrame | None, draws: DataFrame, d: Domain, t_kernel: Kernel, s_kernel: Kernel, window: float | None = None, background: DataFrame | None = None, integral: DataFrame | None = None, radius: float | None = None, values: DataFrame | None = None) -> DataFrame:
    """draw_id, event_term, itot_back, itot_excite, loglik of every draw.

    Without `background` the background is exp(a_0) and events without a pair need no row of their own:
    their term is their number times a_0. Without a window (and pairs) all earlier events excite. With a window but no
    pairs, those of window and `radius` are summed inside the tasks, and `values` (of fields, see `windows.event_terms`)
    take the place of `background`.
    """
    if pairs is None and window is not None:
        hit = windows.event_terms(ev, draws, d.n_t, t_kernel, s_kernel, window, radius, values)
        if values is None:
            hit = draws.select("draw_id", "a_0").join(hit, "draw_id", "left").crossJoin(ev.agg(F.count("*").alias("events")))  # one row on the right
            some = F.coalesce("some", F.lit(0.0)) + (F.col("events") - F.coalesce("n", F.lit(0))) * F.col("a_0")
        else:
            some = F.when(F.col("n") > 0, F.col("some"))
        term = hit.select("draw_id", some.alias("event_term"), "itot_excite")
        rows = term.join(hawkes_integral(draws, d) if integral is None else integral, "draw_id").select("draw_id", "event_term", "itot_back", "itot_excite")
        return rows.withColumn("loglik", F.col("event_term") - F.col("itot_back") - F.col("itot_excite"))
    excite = full_excitation(ev, draws, t_kernel, s_kernel) if window is None else excitation(pairs, draws, t_kernel, s_kernel)
    excite = excite.withColumnRenamed("i", "point_id")
    if background is None:
        hit = excite.join(draws.select("draw_id", "a_0"), "draw_id")
        hit = hit.groupBy("draw_id").agg(F.sum(F.log(F.col("excitation") + F.exp("a_0"))).alias("some"), F.count("*").alias("n"))
        total = ev.agg(F.count("*").alias("events"))
        term = draws.select("draw_id", "a_0").join(hit, "draw_id", "left").crossJoin(total)  # one row on the right
        term = term.select("draw_id", (F.coalesce("some", F.lit(0.0)) + (F.col("events") - F.coalesce("n", F.lit(0))) * F.col("a_0")).alias("event_term"))
    else:
        both = background.join(excite, ["draw_id", "point_id"], "left")
        term = both.groupBy("draw_id").agg(F.sum(F.log(F.coalesce("excitation", F.lit(0.0)) + F.col("background"))).alias("event_term"))
    back = hawkes_integral(draws, d) if integral is None else integral
    rows = term.join(back, "draw_id").join(excitation_integral(ev, draws, d, t_kernel, s_kernel, window), "draw_id")
    return rows.withColumn("loglik", F.col("event_term") - F.col("itot_back") - F.col("itot_excite"))


def lgcp_scores(counts: DataFrame, fields: DataFrame, draws: DataFrame, d: Domain, space: DataFrame | None = None, effect: DataFrame | None = None) -> DataFrame:
    """draw_id, event_term, itot, loglik of a Cox model of every draw, from counts alone."""
    values = fields.select("draw_id", "field", "idx", "value")
    if effect is not None:
        values = values.union(effect.select("draw_id", F.lit("b_0"), F.col("cov_id"), "b_0"))
    n = counts.filter(F.col("field") == "f_t").agg(F.sum("n").alias("events"))
    linear = counts.join(values, ["field", "idx"]).groupBy("draw_id").agg(F.sum(F.col("n") * F.col("value")).alias("linear"))
    rows = linear.join(draws.select("draw_id", "a_0"), "draw_id").crossJoin(n)  # one row on the right
    rows = rows.join(time_integral(fields, draws, d), "draw_id").join(space if space is not None else space_integral(fields, d), "draw_id")
    rows = rows.select("draw_id", (F.col("events") * F.col("a_0") + F.col("linear")).alias("event_term"), (F.col("itot_time") * F.col("itot_xy")).alias("itot"))
    return rows.withColumn("loglik", F.col("event_term") - F.col("itot"))


def log_expected_likelihood(scores: DataFrame) -> DataFrame:
    """log of the mean likelihood over draws."""
    top = scores.agg(F.max("loglik").alias("top"))
    rows = scores.crossJoin(top)  # one row on the right
    return rows.agg((F.max("top") + F.log(F.sum(F.exp(F.col("loglik") - F.col("top")))) - F.log(F.count("*"))).alias("log_expected_likelihood"))


def expected_aic(scores: DataFrame, k: int) -> DataFrame:
    return scores.agg((-2 * F.avg("loglik") + 2 * k).alias("expected_aic"))


def excitation_share(scores: DataFrame) -> DataFrame:
    """draw_id, share: how much of the expected events is triggered."""
    return scores.select("draw_id", (F.col("itot_excite") / (F.col("itot_excite") + F.col("itot_back"))).alias("share"))


@dataclass
class Model:
    """Prepared events, the pairs of a Hawkes part, and what is needed to score draws.

    kind is lgcp, hawkes or cox_hawkes. `covariates` maps each covariate of `cov` (rectangles with cov_id,
    bounds and area that cover the domain) to the name of its weight in the draws. `polygons` (poly_id,
    ring) limit a Cox model's space to the cells they touch. Tables are lazy; `persist` keeps events and
    pairs.
    """

    kind: str
    domain: Domain
    events: DataFrame
    pairs: DataFrame | None = None
    t_kernel: Kernel = field(default_factory=Exponential)
    s_kernel: Kernel = field(default_factory=Gaussian)
    window: float | None = None
    radius: float | None = None
    covariates: dict[str, str] = field(default_factory=dict)
    cov: DataFrame | None = None
    polygons: DataFrame | None = None
    priors: dict[str, Normal | HalfNormal | Beta] = field(default_factory=dict)
    most_pairs: int | None = None

    def __post_init__(self):
        if bool(self.covariates) != (self.cov is not None):
            raise ValueError("covariates need both their weights' names and their table")
        if self.cov is not None and "cov_id" not in self.events.columns:
            held = spatial.rect_join(self.events, self.cov.select("cov_id", "x_min", "x_max", "y_min", "y_max"), "sx", "sy")
            self.events = held

    def persist(self) -> Model:
        self.events = self.events.persist()
        self.pairs = self.pairs.persist() if self.pairs is not None else None
        return self

    def n_params(self) -> int:
        """Free scalar parameters: a_0, covariate weights, and alpha and the kernels' of a Hawkes part."""
        hawkes = 1 + len(self.t_kernel.params) + len(self.s_kernel.params) if self.kind != "lgcp" else 0
        return 1 + len(self.covariates) + hawkes

    def _space(self, fields: DataFrame, effect: DataFrame | None) -> DataFrame:
        """draw_id, itot_xy over the model's domain, with its covariates."""
        spark = fields.sparkSession
        cells = spatial.cells_in_domain(space_grid(spark, self.domain), self.polygons).select("cell_id") if self.polygons is not None else None
        if effect is None:
            return space_integral(fields, self.domain, cells)
        overlay = spatial.overlay_rectangles(space_grid(spark, self.domain), self.cov)
        return space_integral_covariates(fields, overlay if cells is None else overlay.join(cells, "cell_id", "left_semi"), effect)

    def score(self, draws: DataFrame, fields: DataFrame | None = None) -> DataFrame:
        """draw_id, loglik and its parts for every draw; `fields` for a model with a Cox part."""
        effect = covariate_effect(self.cov, draws, self.covariates) if self.cov is not None else None
        if self.kind == "lgcp":
            counts = sufficient_counts(self.events, "cov_id" if effect is not None else None)
            return lgcp_scores(counts, fields, draws, self.domain, self._space(fields, effect), effect)
        common = (self.events, self.pairs, draws, self.domain, self.t_kernel, self.s_kernel, self.window)
        inside = self.pairs is None and self.window is not None
        given = None if effect is None else effect.select("draw_id", F.lit("b_0").alias("field"), F.col("cov_id").cast("long").alias("idx"), F.col("b_0").alias("value"))
        if self.kind == "hawkes":
            if effect is None:
                return hawkes_scores(*common, radius=self.radius)
            integral = hawkes_integral_covariates(draws, effect, self.cov, self.domain)
            if inside:
                return hawkes_scores(*common, integral=integral, radius=self.radius, values=given)
            at = self.events.select("point_id", "cov_id").join(effect, "cov_id").join(draws.select("draw_id", "a_0"), "draw_id")
            background = at.select("draw_id", "point_id", F.exp(F.col("a_0") + F.col("b_0")).alias("background"))
            return hawkes_scores(*common, background, integral)
        integral = time_integral(fields, draws, self.domain).join(self._space(fields, effect), "draw_id").select("draw_id", (F.col("itot_time") * F.col("itot_xy")).alias("itot_back"))
        if inside:
            values = fields.select("draw_id", "field", F.col("idx").cast("long").alias("idx"), "value")
            return hawkes_scores(*common, integral=integral, radius=self.radius, values=values if given is None else values.unionByName(given))
        return hawkes_scores(*common, background_at_events(self.events, fields, draws, effect), integral)

    def for_events(self, events: DataFrame, d: Domain | None = None) -> Model:
        """The same model over other events, such as held-out ones: cleaned, prepared, and paired anew."""
        new = prepare(clean_events(events), d or self.domain)
        pairs = _pairs_of(new, self.window, self.radius, self.most_pairs, self.t_kernel, self.s_kernel) if self.kind != "lgcp" and self.window is not None else None
        return replace(self, domain=d or self.domain, events=new, pairs=pairs)

    def heldout(self, events: DataFrame, draws: DataFrame, fields: DataFrame | None = None, d: Domain | None = None) -> DataFrame:
        """The log of the mean likelihood of held-out events over the draws."""
        return log_expected_likelihood(self.for_events(events, d).score(draws, fields))


def _pairs_of(ev: DataFrame, window: float, radius: float | None, most: int | None, t_kernel: Kernel, s_kernel: Kernel) -> DataFrame | None:
    """Pairs as rows where the kernels need them; refused above the limit."""
    as_rows = not windows.summable(t_kernel, s_kernel)
    if not as_rows and most is None:
        return None
    pairs = pair_ops.checked_pairs(ev, window, radius, pair_ops.MOST_PAIRS if most is None else most)
    return pairs if as_rows else None


def lgcp(events: DataFrame, d: Domain, covariates: dict[str, str] | None = None, cov: DataFrame | None = None, polygons: DataFrame | None = None, priors: dict | None = None) -> Model:
    ev = events if polygons is None else spatial.clip_to_domain(events, polygons)
    return Model("lgcp", d, prepare(ev, d), covariates=covariates or {}, cov=cov, polygons=polygons, priors=priors or {})


def hawkes(events: DataFrame, d: Domain, window: float | None = None, radius: float | None = None, cox_background: bool = False, t_kernel: Kernel | None = None, s_kernel: Kernel | None = None, covariates: dict[str, str] | None = None, cov: DataFrame | None = None, priors: dict | None = None, most_pairs: int | None = None) -> Model:
    """A Hawkes or Cox-Hawkes model. Without a window, all earlier events excite, and no pairs are made.

    With one, the kernels here are summed inside the tasks (`windows`). Kernels that give no numbers need pairs as rows,
    `pair_ops.MOST_PAIRS` at most. `most_pairs` refuses a window of more pairs for any kernel.
    A radius drops far pairs from the excitation but not their share of the integral, so it should
    cover nearly all of the spatial kernel.
    """
    ev = prepare(events, d)
    t_kernel, s_kernel = t_kernel or Exponential(), s_kernel or Gaussian()
    pairs = None if window is None else _pairs_of(ev, window, radius, most_pairs, t_kernel, s_kernel)
    kind = "cox_hawkes" if cox_background else "hawkes"
    return Model(kind, d, ev, pairs, t_kernel, s_kernel, window, radius, covariates or {}, cov, None, priors or {}, most_pairs)


def one_draw(spark: SparkSession, **values: float) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("draw_id"), *[F.lit(float(v)).alias(k) for k, v in values.items()])


