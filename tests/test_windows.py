"""Sums inside a window against rows of pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsefield.config import Domain
from pulsefield.functions.kernels import DoubleExponential, Exponential, Gaussian, PowerLaw
from pulsefield.operators import pairs
from pulsefield.operators.prepare import prepare
from pulsefield.plans import likelihood as lk
from pulsefield.plans import fit, windows
from pulsefield.sources import fixtures as fx

D = Domain(t_max=50.0)


@pytest.fixture(scope="module")
def ev(spark):
    """Three hundred events, some at equal times, some a whole window apart."""
    rows = [(k, (k * 37 % 101) / 101, (k * 53 % 103) / 103, float(k * 29 % 97) / 4) for k in range(300)]
    return prepare(spark.createDataFrame(rows, "point_id long, X double, Y double, T double"), D).persist()


@pytest.mark.parametrize("radius", [None, 0.3])
@pytest.mark.parametrize("kernels", [(Exponential(), Gaussian()), (PowerLaw(), DoubleExponential())])
def test_sums_inside_tasks_equal_those_of_pairs(spark, ev, radius, kernels):
    draws = fx.draws(spark, 9).withColumn("Lambda", F.col("sigmax_2") * 5).withColumn("beta", F.col("beta") * 10)
    want = {(r.draw_id, r.i): r.excitation for r in lk.excitation(pairs.event_pairs(ev, 1.25, radius), draws, *kernels).collect()}
    got = {(r.draw_id, r.i): r.excitation for r in windows.near_excitation(ev, draws, *kernels, 1.25, radius).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], v, rel_tol=1e-8, abs_tol=1e-9) for k, v in want.items())
    totals = {r.draw_id: (r.n, r.excitation) for r in windows.excitation_totals(ev, draws, *kernels, 1.25, radius).collect()}
    for d, (n, e) in totals.items():
        mine = [v for k, v in want.items() if k[0] == d]
        assert n == len(mine) and math.isclose(e, sum(mine), rel_tol=1e-8)


def test_a_window_of_very_many_pairs_is_not_refused(spark, ev, monkeypatch):
    monkeypatch.setattr(pairs, "checked_pairs", lambda *_: pytest.fail("pairs are made or counted"))
    draws = fx.draws(spark, 9)
    model = lk.hawkes(ev.select("point_id", "X", "Y", "T"), D, 1.25)
    got = {r.draw_id: r for r in model.score(draws).collect()}
    want = lk.hawkes_scores(ev, pairs.event_pairs(ev, 1.25), draws, D, Exponential(), Gaussian(), 1.25)
    for r in want.collect():
        assert all(math.isclose(got[r.draw_id][c], r[c], rel_tol=1e-9) for c in ("event_term", "itot_back", "itot_excite", "loglik"))


def test_heldout_events_of_very_many_pairs_are_not_refused(spark, ev, monkeypatch):
    """The model's own events and the held-out ones: neither has its pairs counted or made."""
    raw, draws = ev.select("point_id", "X", "Y", "T"), fx.draws(spark, 9)
    want = lk.log_expected_likelihood(lk.hawkes_scores(ev, pairs.event_pairs(ev, 1.25), draws, D, Exponential(), Gaussian(), 1.25)).first()[0]
    monkeypatch.setattr(pairs, "checked_pairs", lambda *_: pytest.fail("pairs are made or counted"))
    got = lk.hawkes(raw.filter("point_id < 20"), Domain(t_max=30.0), 1.25).heldout(raw, draws, d=D).first()[0]
    assert math.isclose(got, want, rel_tol=1e-9)


def test_fits_need_no_rows_of_pairs(spark, ev):
    now = {"a_0": 1.0, "alpha": 0.3, "beta": 0.4, "sigmax_2": 0.02}
    rows = pairs.event_pairs(ev, 1.25)
    for one, two in zip(fit.em_step(None, ev, D, window=1.25, **now).first(), fit.em_step(rows, ev, D, window=1.25, **now).first(), strict=True):
        assert math.isclose(one, two, rel_tol=1e-8)
    power = {"a_0": 1.0, "alpha": 0.3, "beta": 0.8, "gamma": 0.2, "Lambda": 0.1}
    for start, kernels, smoothing in ((now, (Exponential(), Gaussian()), 0.1), (power, (PowerLaw(), DoubleExponential()), None)):
        got, want = (fit.fit_hawkes_gem(ev, p, D, 1.25, start, *kernels, 2, smoothing).collect() for p in (None, rows))
        assert len(got) == len(want) == 3
        assert all(math.isclose(a, b, rel_tol=1e-6) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_lags_are_summed_without_pairs(spark, ev, monkeypatch):
    want = pairs.event_pairs(ev, 1.25).groupBy("i").agg(F.count("*").alias("n"), F.sum("dt").alias("dt"), F.sum(F.abs("dx")).alias("dx"), F.sum("j").alias("j"), F.min("j").alias("least"), F.max("j").alias("most")).collect()
    got = {r.i: r for r in windows.lag_sums(ev, 1.25, x="sx", ends=True).collect()}
    assert got.keys() == {r.i for r in want}
    for r in want:
        g = got[r.i]
        assert (g.n, int(g.j_sum), g.j_least, g.j_most) == (r.n, r.j, r.least, r.most)
        assert math.isclose(g.dt, r.dt, abs_tol=1e-9) and math.isclose(g.dx, r.dx, abs_tol=1e-9)
    some = {r.i for r in windows.lag_sums(ev, 1.25, subset=F.col("point_id") % 10 == 3).collect()}
    assert some == {i for i in got if i % 10 == 3}
    days = ev.select("point_id", F.floor("T").cast("double").alias("T"))
    brute = {(r.dt, r.n, r.i, r.j) for r in pairs.lag_pairs(days, "T", 3.0).groupBy("dt").agg(F.count("*").alias("n"), F.sum("i").alias("i"), F.sum("j").alias("j")).collect()}
    assert {(r.dt, r.n, r.i, r.j) for r in windows.lag_counts(days, "T", 3.0).collect()} == brute


def test_queries_on_lags_make_no_pairs(spark, monkeypatch):
    from pulsefield.plans.queries import QUERIES

    for name in ("event_pairs", "lag_pairs"):
        monkeypatch.setattr(pairs, name, lambda *_, **__: pytest.fail("pairs are made"))
    for name in ("pairs_time", "pairs_1d", "pairs_subset", "pairs_x_lag"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_background_over_all_draws_keeps_a_row_for_each(spark):
    from pulsefield.plans.queries import QUERIES

    rows = QUERIES["background_at_events_all"](spark, "/root/testdata/sf0.001")
    assert set(rows.columns) == {"draw_id", "point_id", "background"} and rows.count() == 200 * 1000


def test_events_meet_fields_without_a_shuffle_of_arrays(spark, ev):
    """The bare events are dealt out once; no join shuffles them with an array of draws for each."""
    found = lk.background_at_events(ev, fx.fields(spark, 20), fx.draws(spark, 20))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(point_id") == 1


@pytest.mark.parametrize("at_once", [60_000, 10_000])
def test_draws_of_the_background_are_met_in_turns(spark, ev, monkeypatch, at_once):
    """699 cells: the first limit has room for two draws of each, the second for none, so nothing is broadcast by force."""
    some = ev.limit(50).withColumn("time_bin", F.when(F.col("point_id") % 7 > 0, F.col("time_bin")))
    draws, fields = fx.draws(spark, 19).filter("draw_id % 5 <> 1"), fx.fields(spark, 19).filter("field <> 'f_a' or idx <> 3 or draw_id <> 4")
    values = {(r.draw_id, r.field, r.idx): r.value for r in fields.collect()}
    want = {}
    for d in draws.collect():
        for e in some.collect():
            parts = [d.a_0, *[values.get((d.draw_id, n, e[c])) for n, c in (("f_t", "time_bin"), ("f_a", "season_bin"), ("f_xy", "cell_id"))]]
            want[d.draw_id, e.point_id] = None if None in parts else math.exp(sum(parts))
    whole = lk.background_at_events(some, fields, draws).collect()
    monkeypatch.setattr(lk, "AT_ONCE", at_once)
    for rows in (whole, lk.background_at_events(some, fields, draws).collect()):
        got = {(r.draw_id, r.point_id): r.background for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys()
        assert all(got[k] is v if v is None else math.isclose(got[k], v, rel_tol=1e-12) for k, v in want.items())
    assert None in want.values() and len(set(want.values())) > 500


def test_backgrounds_are_rounded_as_sql_rounds(spark):
    import duckdb

    from pulsefield.plans.queries import _quick

    rows = [0.0, 0.125, 0.375, 2.5, 3.5, 0.000005, 20.123455, 1e15 / 3, 2.0**52, 1e305, math.inf, math.nan, None, *[math.exp(k / 97) for k in range(600)]]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v double").orderBy("k").select(*[F.struct(*[_quick(F.col("v"), n) for n in (0, 2, 5)])]).collect()]
    for v, mine in zip(rows, got, strict=True):
        want = duckdb.execute("SELECT round(?::DOUBLE, 0), round(?::DOUBLE, 2), round(?::DOUBLE, 5)", [v] * 3).fetchall()[0]
        assert tuple(map(str, mine)) == tuple(map(str, want))


def test_nearest_of_a_large_grid_is_not_sent_through_the_driver(spark):
    from pulsefield.operators import spatial

    grid = spark.range(1500).select(F.col("id").alias("idx"), (F.col("id") * 37 % 1009 / 1009.0).alias("X"), (F.col("id") * 53 % 1013 / 1013.0).alias("Y"))
    points = spark.range(200).select(F.col("id").alias("point_id"), (F.col("id") / 200.0).alias("X"), (F.col("id") * 7 % 200 / 200.0).alias("Y"))
    found = spatial.nearest_index(points, grid, ("X", "Y"))
    assert found.count() == 200
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("radius", [None, 0.05])
def test_pairs_are_met_once_for_very_many_draws(radius):
    i, rng = np.arange(200), np.random.default_rng(3)
    t, x, y = np.sort(rng.uniform(0, 0.8, 900)), rng.uniform(0, 1, 900), rng.uniform(0, 1, 900)
    some = windows.Stretch(t, x, y, t > 0.4, 0.4)
    beta, gamma, var, alpha = 0.02 + i * 53 % 223 / 2230, 0.5 + i * 31 % 233 / 233, 0.005 + i * 29 % 227 / 22700, 0.1 + i * 37 % 211 / 1055
    given = [{"draw_id": int(k), "alpha": alpha[k], "beta": beta[k], "gamma": gamma[k], "sigmax_2": var[k], "Lambda": 5 * var[k]} for k in i]
    dt, dx, dy = (v[some.own][:, None] - v for v in (t, x, y))
    hit = (dt > 0) & (dt <= 0.4) & (np.sqrt(dx * dx + dy * dy) <= (radius or 9))
    draws = windows.Draws(given, Exponential(), Gaussian(), 0.4, radius, (0, 1, 0, 1))
    assert len(draws.decays[1].rates) <= 20  # exponentials of a pair, for 200 draws
    got = np.zeros((200, len(some.own)))
    for k, e, has in draws.excite(some):
        got[:, k] = e
        assert (has == hit[k].any(axis=1)).all()
    totals, n = windows.Draws(given, PowerLaw(), DoubleExponential(), 0.4, radius, (0, 1, 0, 1)).totals(some)
    assert n == hit.any(axis=1).sum()
    for k in range(0, 200, 17):
        f = np.where(hit, Exponential().density(np.where(hit, dt, 0), beta[k]) * Gaussian().density(dx, dy, var[k]), 0).sum(axis=1) * alpha[k]
        assert np.allclose(got[k], f, rtol=1e-9, atol=1e-9 * f.max())
        g = np.where(hit, PowerLaw().density(np.where(hit, dt, 0), beta[k], gamma[k]) * DoubleExponential().density(dx, dy, 5 * var[k]), 0).sum() * alpha[k]
        assert math.isclose(totals[k], g, rel_tol=1e-9)


def test_near_pairs_are_those_of_the_join(spark, ev):
    want = sorted(map(tuple, pairs.event_pairs(ev, 1.25, 0.3).collect()))
    assert sorted(map(tuple, windows.near_pairs(ev, 1.25, 0.3).collect())) == want and len(want) > 100


def test_near_pairs_shuffle_an_event_few_times(spark, ev):
    """Eighteen copies of an event in the join, for its buckets; here its stretch and the next, by the strips in reach."""
    grouped = windows.stretches(ev, 0.4, 0.05, "point_id", "u", "sx", "sy", [])
    assert grouped.agg(F.count("*").alias("n")).agg(F.sum("n")).first()[0] <= 4 * ev.count()


def test_cox_hawkes_with_covariates_takes_every_draw_and_pair(spark):
    from pulsefield.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got, want = (sorted(map(tuple, QUERIES[name](spark, sf).collect())) for name in ("cox_hawkes_cov_loglik", "cox_hawkes_cov_loglik_all"))
    assert len(got) == 200 and got == want


@pytest.mark.parametrize("ties", [False, True])
def test_corners_sum_as_pairs_do(monkeypatch, ties):
    """Double exponentials by cells; with ties in time and place, and many events in one place."""
    from pulsefield.plans import corners

    monkeypatch.setattr(corners, "FEW", 100)
    rng, n = np.random.default_rng(5), 2500
    t, x, y = np.sort(rng.uniform(0, 0.8, n)), rng.uniform(0, 1, n), rng.uniform(0, 1, n) ** 2
    if ties:
        t, x = np.sort(np.round(t, 2)), np.round(x, 1)
        x[:300], y[:300] = 0.5, 0.25
    some = windows.Stretch(t, x, y, t >= 0.4, 0.4)
    rates, scales = np.array([0.0, 3.0, 160.0]), np.array([0.001, 0.03, 0.1])
    found = corners.Corners(some, rates)
    assert found.x.n > 5 and any(p < q for _, _, p, q in found.blocks)
    dt, lag = t[some.own][:, None] - t, np.abs(x[some.own][:, None] - x) + np.abs(y[some.own][:, None] - y)
    hit, totals = (dt > 0) & (dt <= 0.4), found.totals(scales)
    for k, scale in enumerate(scales):
        f = np.where(hit, np.exp(-lag / scale), 0)
        want = np.stack([np.stack([(f * v * np.exp(-r * np.where(hit, dt, 0))).sum(axis=1) for r in rates], axis=1) for v in (1, lag)])
        assert np.allclose(found.sums(scale), want, rtol=1e-10, atol=1e-13 * want.max())
        assert np.allclose(totals[k], want[0].sum(axis=0), rtol=1e-12)


def test_double_exponentials_meet_few_pairs(monkeypatch):
    """A window of 6,000 events: cells hold most pairs, and sums are those of all of them."""
    from pulsefield.plans import corners

    i, rng, n = np.arange(200), np.random.default_rng(6), 12_000
    t, x, y = np.sort(rng.uniform(0, 0.8, n)), rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    some = windows.Stretch(t, x, y, t >= 0.4, 0.4)
    given = [{"draw_id": int(k), "alpha": 0.2, "beta": 0.02 + k * 53 % 223 / 2230, "gamma": 0.5 + k * 31 % 233 / 233, "Lambda": 0.025 + k * 29 % 227 / 4540} for k in i]
    draws = windows.Draws(given, PowerLaw(), DoubleExponential(), 0.4, None, (0, 1, 0, 1))
    sums, count = some.totals(None, draws.lags, DoubleExponential().lag, draws.far)
    want = draws.alpha * draws.peaks * (draws.lags.weights @ sums * draws.far.weights).sum(axis=1)
    met = sum(int(h.sum()) for _, _, h in corners.Corners(some, draws.times[0])._near())
    assert met < int((some.hi - some.lo).sum()) / 5
    monkeypatch.setattr(windows.Stretch, "blocks", lambda *_: pytest.fail("all pairs are met"))
    got, n = draws.totals(some)
    assert n == count and np.allclose(got, want, rtol=1e-9)


def test_kernels_in_time_are_sums_of_exponentials():
    from pulsefield.plans.corners import exponentials

    lags = np.geomspace(1e-7, 0.4, 500)
    for beta, gamma in ((0.8, 0.1), (0.02, 1.5), (2.0, 0.03)):
        values = lambda dt: np.stack([PowerLaw().density(dt, beta, gamma), PowerLaw().density(dt, beta, gamma) * np.log1p(dt / gamma)])  # noqa: B023, E731
        rates, weights = exponentials(values, 0.4, 1e-11)
        error = np.abs(weights @ np.exp(-np.outer(rates, lags)) - values(lags)).max(axis=1)
        assert (error < 1e-11 * values(lags).max(axis=1)).all()


def test_nearest_of_a_large_grid_makes_no_copies_for_levels(spark, monkeypatch):
    """A row is shuffled about once, and the answers of many tiles are those of all pairs."""
    from pulsefield.operators import nearest, spatial

    monkeypatch.setattr(nearest, "TILE", 200)
    monkeypatch.setattr(nearest, "LAID", 500)
    rng = np.random.default_rng(9)
    g, p = np.round(rng.random((3000, 2)) ** 3, 3), np.concatenate([rng.random((1500, 2)), 0.2 * rng.random((500, 2)), [[5.0, -3.0]]])
    table = lambda at, name: spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)], f"{name} long, X double, Y double")
    found = spatial.nearest_index(table(p, "point_id"), table(g, "idx"), ("X", "Y"))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    d2 = (p[:, None, 0] - g[:, 0]) ** 2 + (p[:, None, 1] - g[:, 1]) ** 2
    assert {r.point_id: r.idx for r in found.collect()} == dict(enumerate(d2.argmin(axis=1).tolist()))


def test_pairs_as_rows_copy_an_event_less_than_twice(spark, monkeypatch):
    """Long stretches and broad strips; the pairs across their borders, and those a whole window apart, are all there."""
    used, real = [], windows.stretches
    monkeypatch.setattr(windows, "stretches", lambda *a: used.append(real(*a)) or used[0])
    rows = [(k, (k * 37 % 101) / 101, (k * 53 % 103) / 103, float(k % 997) / 20) for k in range(4000)]
    some = prepare(spark.createDataFrame(rows, "point_id long, X double, Y double, T double"), D)
    got = sorted(map(tuple, windows.near_pairs(some, 0.4, 0.05).collect()))
    assert used[0].agg(F.count("*").alias("n")).agg(F.sum("n")).first()[0] < 2 * 4000
    assert got == sorted(map(tuple, pairs.event_pairs(some, 0.4, 0.05).collect())) and len(got) > 100
