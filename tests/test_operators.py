"""Hand-computed cases and properties of the operators."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsefield.config import Domain
from pulsefield.functions.kernels import KERNELS, DoubleExponential, Exponential, Gaussian, Kernel, PowerLaw, erf
from pulsefield.functions.priors import Beta, HalfNormal, Normal, log_prior
from pulsefield.operators import hotspots, pairs, posterior, prepare, ranks, spatial
from pulsefield.operators.pairs import inter_arrival
from pulsefield.plans import fit, likelihood, proposals
from pulsefield.plans.history import full_excitation
from pulsefield.plans.likelihood import hawkes, one_draw
from pulsefield.sources import fixtures, tables

SF = "/root/testdata/sf0.001"
D = Domain(t_max=50.0)


def events(spark, rows):
    return spark.createDataFrame([(k, float(x), float(y), float(t)) for k, (x, y, t) in enumerate(rows)], "point_id long, X double, Y double, T double")


def test_clean_drops_bad_rows_and_raises_when_none_is_left(spark):
    df = spark.createDataFrame([("1", "2", "3", 1), ("x", "2", "3", 1), ("1", None, "3", 1)], "X string, Y string, T string, day int")
    assert prepare.clean_events(df).collect() == [(1.0, 2.0, 3.0)]
    with pytest.raises(ValueError):
        prepare.clean_events(df.filter("X = 'x'"), check=True)


def test_cells_are_half_open_and_closed_at_the_top(spark):
    rows = prepare.prepare(events(spark, [(0, 0, 0), (1, 1, 50), (0.04, 0, 1), (1.2, 0, 1), (0, 0, 51)]), D).orderBy("point_id").collect()
    assert [r.cell_id for r in rows] == [0, 624, 1, None, 0]
    assert [r.time_bin for r in rows] == [0, 49, 1, 1, None]
    assert prepare.outside(prepare.prepare(events(spark, [(2, 0, 0), (0, 0, 0)]), D)).count() == 1


def test_season_wraps_without_negative_days(spark):
    d = Domain(t_max=50.0, offset=-10.0)
    assert prepare.prepare(events(spark, [(0, 0, 0)]), d).first().season_bin == math.floor(355 / 365 * 24)


def test_season_check_is_not_circular(spark):
    df = spark.createDataFrame([(0, 0.1, 364.9), (1, 5.0, 5.5)], "point_id long, T double, A double")
    assert [r.point_id for r in prepare.validate_season(df, D).collect()] == [0]
    with pytest.raises(ValueError):
        prepare.validate_season(df, D, check=True)


def test_rows_and_columns_of_the_grid(spark):
    g = {r.cell_id: (r.grid_row, r.grid_col) for r in prepare.space_grid(spark, D).collect()}
    assert g[0] == (25, 1) and g[624] == (1, 25) and g[26] == (24, 2)


def test_month_ticks_label_every_nth_and_the_last(spark):
    rows = prepare.month_ticks(spark, "2024-01-15", 120, 3).orderBy("day").collect()
    assert [r.tick for r in rows] == ["2024-02-01", "2024-03-01", "2024-04-01", "2024-05-01"]
    assert [r.label for r in rows] == ["2024-02", None, None, "2024-05"]


@pytest.mark.parametrize("radius", [None, 0.3])
def test_pairs_equal_brute_force(spark, radius):
    rows = [((k * 37 % 101) / 101, (k * 53 % 103) / 103, (k * 29 % 97) / 4) for k in range(150)] + [(0.5, 0.5, 3.0), (0.5, 0.5, 3.0)]
    ev = prepare.prepare(events(spark, rows), D)
    got = {(r.i, r.j) for r in pairs.event_pairs(ev, 1.9, radius).collect()}
    far = lambda a, b: radius is not None and math.dist(a[:2], b[:2]) > radius
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if 0 < a[2] - b[2] <= 1.9 and not far(a, b)}
    assert got == want
    bound = pairs.pair_bound(ev, 1.9).first()[0]
    assert bound >= len(want)


def test_too_many_pairs_are_refused(spark):
    ev = prepare.prepare(events(spark, [(0.1, 0.1, t / 10) for t in range(50)]), D)
    with pytest.raises(ValueError):
        pairs.checked_pairs(ev, 5.0, most=10)


def test_erf_and_kernel_masses(spark):
    xs = spark.createDataFrame([(x / 10,) for x in range(-30, 31)], "x double")
    assert max(abs(r[1] - math.erf(r[0])) for r in xs.select("x", erf(F.col("x"))).collect()) < 2e-7
    one = spark.range(1)
    for kernel, pars in ((Exponential(), {"beta": 0.5}), (PowerLaw(), {"beta": 1.5, "gamma": 0.7})):
        up = lambda t, k=kernel, p=pars: k.mass(F.lit(t), pars=p)
        slope, pdf = one.select((up(1.001) - up(0.999)) / 0.002, kernel.pdf(F.lit(1.0), pars=pars)).first()
        assert abs(slope - pdf) < 1e-5
    for kernel, pars in ((Gaussian(), {"sigmax_2": 0.01}), (DoubleExponential(), {"Lambda": 0.01})):
        assert abs(one.select(kernel.mass(*[F.lit(9.0)] * 4, pars=pars)).first()[0] - 1) < 1e-6
    assert set(KERNELS) == {"exponential", "power_law", "gaussian", "double_exponential"}


def test_priors(spark):
    d = spark.createDataFrame([(0, 0.5, 0.5, 1.0)], "draw_id long, alpha double, beta double, a_0 double")
    got = log_prior(d, {"alpha": Beta(2, 2), "beta": HalfNormal(1), "a_0": Normal(0, 5)}).first().log_prior
    want = math.log(1.5) + (math.log(2 / math.pi) / 2 - 0.125) + (-0.02 - math.log(5) - math.log(2 * math.pi) / 2)
    assert abs(got - want) < 1e-12
    with pytest.raises(TypeError):
        log_prior(d, {"alpha": "uniform"})


def test_point_in_polygon_takes_one_side_of_a_shared_edge(spark):
    square = lambda x: [{"x": x, "y": 0.0}, {"x": x + 0.5, "y": 0.0}, {"x": x + 0.5, "y": 1.0}, {"x": x, "y": 1.0}]
    polys = spark.createDataFrame([(0, square(0.0)), (1, square(0.5))], "poly_id int, ring array<struct<x:double,y:double>>")
    ev = events(spark, [(0.5, 0.5, 0), (0.2, 0.2, 0), (2, 2, 0)])
    joined = spatial.pip_join(ev, polys)
    assert sorted((r.point_id, r.poly_id) for r in joined.collect()) == [(0, 1), (1, 0)]
    assert [(r.point_id, r.hits) for r in spatial.coverage_errors(ev, joined).collect()] == [(2, 0)]
    assert spatial.clip_to_domain(ev, polys).count() == 2


def test_overlay_areas_add_up(spark):
    grid = prepare.space_grid(spark, D)
    rect = spatial.overlay_rectangles(grid, fixtures.covariates(spark))
    assert rect.count() == 900
    assert abs(rect.agg(F.sum("area")).first()[0] - 1) < 1e-9
    areas = {r.poly_id: r.a for r in spatial.overlay_polygons(grid, fixtures.polygons(spark)).groupBy("poly_id").agg(F.sum("area").alias("a")).collect()}
    assert all(abs(areas[k] - a) < 1e-9 for k, a in ((0, 0.145), (1, 0.14), (2, 0.065)))
    inside = spatial.cells_in_domain(grid, fixtures.polygons(spark)).count()
    assert 0 < inside <= spatial.cells_in_domain(grid, fixtures.polygons(spark), touching=True).count() < 625


def test_covariates_from_centres_and_geojson(spark):
    cells = tables.read_covariates(spark, spark.createDataFrame([(0.5, 0.5)], "X double, Y double"), (0.2, 0.4)).first()
    assert (cells.x_min, cells.x_max, cells.y_min, cells.y_max) == (0.4, 0.6, 0.3, 0.7)
    shape = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}'
    ring = tables.read_covariates(spark, spark.createDataFrame([(shape,)], "ring string")).first().ring
    assert [(p.x, p.y) for p in ring] == [(0, 0), (1, 0), (1, 1)]


def test_reads_and_writes(spark, tmp_path):
    (tmp_path / "e.csv").write_text("X,Y,T,A\n0.1,0.2,3,4\n")
    assert tables.read_events(spark, str(tmp_path / "e.csv"), "csv").collect() == [(0.1, 0.2, 3.0, 4.0)]
    tables.write_draws(fixtures.draws(spark, 3), str(tmp_path / "d"))
    assert tables.read_draws(spark, str(tmp_path / "d")).count() == 3


def test_srid_check():
    spatial.require_same_srid(4326, 4326)
    with pytest.raises(ValueError):
        spatial.require_same_srid(4326, 3857)


def test_counts_give_the_per_event_likelihood(spark):
    ev = prepare.prepare(fixtures.events_e(spark, SF), fixtures.E_DOMAIN)
    draws, fields = fixtures.draws(spark, 2), fixtures.fields(spark, 2)
    a = {r.draw_id: r.event_term for r in likelihood.lgcp_scores(likelihood.sufficient_counts(ev), fields, draws, fixtures.E_DOMAIN).collect()}
    b = {r.draw_id: r.s for r in likelihood.background_at_events(ev, fields, draws).groupBy("draw_id").agg(F.sum(F.log("background")).alias("s")).collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_a_smaller_window_lowers_the_compensator(spark):
    ev = prepare.prepare(fixtures.events_e(spark, SF), fixtures.E_DOMAIN)
    one = likelihood.one_draw(spark, alpha=0.3, beta=0.5, sigmax_2=0.01)
    total = lambda w: likelihood.excitation_integral(ev, one, fixtures.E_DOMAIN, Exponential(), Gaussian(), w).first().itot_excite
    assert total(0.1) < total(1.0) < total(50.0)
    assert abs(total(50.0) - total(1e6)) < 1e-6


def test_parameter_counts(spark):
    ev = fixtures.events_e(spark, SF)
    assert likelihood.lgcp(ev, fixtures.E_DOMAIN).n_params() == 1
    assert likelihood.hawkes(ev, fixtures.E_DOMAIN, 0.1, 0.05).n_params() == 4
    with pytest.raises(ValueError):
        likelihood.hawkes(ev, fixtures.E_DOMAIN, 50.0, most_pairs=1000)


def test_em_moves_to_fixed_point_of_its_sums(spark):
    ev = prepare.prepare(fixtures.events_e(spark, SF), fixtures.E_DOMAIN)
    p = pairs.event_pairs(ev, 0.4, 0.05).persist()
    path = fit.fit_hawkes_em(ev, p, fixtures.E_DOMAIN, 0.4, {"a_0": 3.0, "alpha": 0.3, "beta": 0.05, "sigmax_2": 0.01}, 3).collect()
    assert [r.iteration for r in path] == [0, 1, 2, 3]
    assert all(r.alpha > 0 and r.beta > 0 and r.sigmax_2 > 0 for r in path)
    for a, b in zip(path, path[1:]):
        step = fit.em_step(p, ev, fixtures.E_DOMAIN, window=0.4, **{k: a[k] for k in ("a_0", "alpha", "beta", "sigmax_2")}).first()
        assert all(abs(step[k] - b[k]) < 1e-12 for k in ("a_0", "alpha", "beta", "sigmax_2"))
    p.unpersist()


def test_em_does_not_lower_the_likelihood(spark):
    d = fixtures.E_DOMAIN
    ev = prepare.prepare(fixtures.events_e(spark, SF), d)
    p = pairs.event_pairs(ev, 0.4).persist()  # every pair of the window
    path = fit.fit_hawkes_em(ev, p, d, 0.4, {"a_0": 3.0, "alpha": 0.3, "beta": 0.05, "sigmax_2": 0.01}, 3)
    draws = path.withColumnRenamed("iteration", "draw_id")
    scores = likelihood.hawkes_scores(ev, p, draws, d, Exponential(), Gaussian(), 0.4).orderBy("draw_id").collect()
    assert all(b.loglik >= a.loglik - 1e-6 * abs(a.loglik) for a, b in zip(scores, scores[1:]))
    p.unpersist()


def test_background_fit_recovers_its_coefficients(spark):
    rows = [(k, math.cos(k), math.sin(3 * k), 1.0 + k % 3) for k in range(400)]
    df = spark.createDataFrame([(k, c1, c2, e, math.exp(0.5 + 0.7 * c1 - 0.4 * c2) * e) for k, c1, c2, e in rows], "cell_id int, c1 double, c2 double, exposure double, n double")
    model = fit.fit_background(df, ["c1", "c2"], 0.0)
    assert abs(model.intercept - 0.5) < 1e-3 and abs(model.coefficients[0] - 0.7) < 1e-3 and abs(model.coefficients[1] + 0.4) < 1e-3


def test_polygons_with_holes_and_parts(spark, tmp_path):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    shapes = [
        (1, {"type": "Polygon", "coordinates": [square(0.1, 0.9), square(0.3, 0.7)]}),
        (2, {"type": "MultiPolygon", "coordinates": [[square(0.0, 0.05)], [square(0.4, 0.6), square(0.45, 0.55)]]}),
        (3, {"type": "Polygon", "coordinates": [square(0.92, 0.98)]}),
    ]
    df = spark.createDataFrame([(k, json.dumps(g)) for k, g in shapes], "poly_id int, ring string")
    polys = tables.read_covariates(spark, df)
    areas = {r.poly_id: r.area for r in spatial.polygon_stats(polys).collect()}
    assert abs(areas[1] - (0.64 - 0.16)) < 1e-12 and abs(areas[2] - (0.0025 + 0.04 - 0.01)) < 1e-12 and abs(areas[3] - 0.0036) < 1e-12
    points = [(k, 0.011 + (k % 37) / 37.5, 0.007 + (k // 37) / 37.5) for k in range(37 * 37)]
    got = {(r.point_id, r.poly_id) for r in spatial.pip_join(spark.createDataFrame(points, "point_id int, X double, Y double"), polys).collect()}
    held = lambda a, b, x, y: a < x < b and a < y < b
    want = {(k, 1) for k, x, y in points if held(0.1, 0.9, x, y) and not held(0.3, 0.7, x, y)}
    want |= {(k, 2) for k, x, y in points if held(0, 0.05, x, y) or (held(0.4, 0.6, x, y) and not held(0.45, 0.55, x, y))}
    want |= {(k, 3) for k, x, y in points if held(0.92, 0.98, x, y)}
    assert got == want
    pieces = spatial.overlay_polygons(prepare.space_grid(spark, fixtures.E_DOMAIN), polys).groupBy("poly_id").sum("area").collect()
    assert all(abs(r[1] - areas[r.poly_id]) < 1e-9 for r in pieces) and len(pieces) == 3


def test_points_on_the_end_of_the_domain_are_held(spark):
    got = spatial.rect_join(spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 1.0), (3, 0.1, 0.1)], "point_id int, X double, Y double"), fixtures.covariates(spark).withColumns({c: F.round(c, 9) for c in ("x_min", "x_max", "y_min", "y_max")}))
    assert {(r.point_id, r.cov_id) for r in got.collect()} == {(1, 99), (2, 95), (3, 11)}


def test_pair_bound_follows_the_buckets_of_the_join(spark):
    ev = prepare.prepare(fixtures.events_e(spark, SF), fixtures.E_DOMAIN)
    wide, near = (pairs.pair_bound(ev, 0.4, radius=r).first()[0] for r in (None, 0.05))
    assert pairs.event_pairs(ev, 0.4, 0.05).count() <= near < wide
    with pytest.raises(ValueError):
        pairs.checked_pairs(ev, 0.4, 0.05, most=10)


def test_models_need_their_covariates(spark):
    with pytest.raises(ValueError):
        likelihood.lgcp(fixtures.events_e(spark, SF), fixtures.E_DOMAIN, covariates={"c1": "w1"})


def test_weights_and_summaries(spark):
    scores = spark.createDataFrame([(0, -1e5), (1, -1e5 + math.log(3))], "draw_id long, loglik double")
    prior = spark.createDataFrame([(0, 0.0), (1, 0.0)], "draw_id long, log_prior double")
    w = {r.draw_id: r.weight for r in fit.posterior_weights(scores, prior).collect()}
    assert abs(w[0] - 0.25) < 1e-9 and abs(w[1] - 0.75) < 1e-9
    draws = spark.createDataFrame([(0, 1.0), (1, 2.0)], "draw_id long, b double")
    row = fit.weighted_summary(fit.posterior_weights(scores, prior), draws, ["b"]).first()
    assert abs(row.b - 1.75) < 1e-9 and abs(row.effective_size - 1.6) < 1e-9
    assert abs(likelihood.log_expected_likelihood(scores).first()[0] - (-1e5 + math.log(2))) < 1e-6


def test_shortest_interval(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in (0, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 40)], "k int, value double")
    r = posterior.hpdi(rows, ["k"]).first()
    assert (r.low, r.high) == (0.0, 19.0)
    assert posterior.hpdi(rows, ["k"], prob=0.5).first()[1:] == (10.0, 16.0)


def test_constant_field_has_no_correlation(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 3.0), (1, 1.0, 2.0), (1, 2.0, 4.0)], "k int, a double, b double")
    got = {r.k: r["corr"] for r in posterior.field_corr(rows, "a", "b", ["k"]).collect()}
    assert math.isnan(got[0]) and abs(got[1] - 1) < 1e-9


def test_histogram_closes_its_last_bin(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 1.0, 2.0)], "v double")
    assert {r.bin: r.n for r in posterior.histogram(rows, "v", 0, 1, 2).collect()} == {1: 1, 2: 3}


def test_constant_covariate_becomes_null(spark):
    rows = spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 5.0)], "cov_id int, c1 double, c2 double")
    assert [tuple(r) for r in likelihood.standardize(rows, ["c1", "c2"]).orderBy("cov_id").collect()] == [(0, -1.0, None), (1, 1.0, None)]


def test_hotspots_break_ties_by_cell_and_modes_are_checked(spark):
    cells = spark.createDataFrame([(k, 1.0 if k < 90 else 2.0) for k in range(100)], "cell_id int, post_mean double")
    got = hotspots.hotspots(cells, "90/10").filter("kind = 'hot'").orderBy("rank").collect()
    assert [r.cell_id for r in got[:3]] == [90, 91, 92]
    with pytest.raises(ValueError):
        hotspots.hotspots(cells, "best")
    with pytest.raises(ValueError):
        hotspots.daily_counts(cells, cells, "weekly")
    with pytest.raises(ValueError):
        hotspots.check_events(cells)


def test_daily_counts_of_a_stream(spark, tmp_path):
    from pulsefield.streaming.daily import daily_counts_stream

    ev = prepare.prepare(fixtures.events_e(spark, SF), fixtures.E_DOMAIN).select("ts", "cell_id")
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = daily_counts_stream(stream).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM daily").first()[0] == ev.count()


def test_queries_over_draws_cover_every_draw(spark):
    from pulsefield.plans.queries import QUERIES

    for name in ("score_draws", "cox_hawkes_loglik", "lgcp_cov_loglik", "posterior_weights"):
        assert {r.draw_id for r in QUERIES[f"{name}_all"](spark, SF).select("draw_id").distinct().collect()} == set(range(200))


def test_far_pairs_count_in_fits_and_scores(spark):
    from pulsefield.plans.queries import QUERIES

    cap = 0.05**2 / 2  # what a radius of 0.05 allows at most
    one, first = QUERIES["em_step_all"](spark, SF).first(), QUERIES["fit_hawkes_em"](spark, SF).filter("iteration = 1").first()
    assert one.sigmax_2 > cap and abs(first.sigmax_2 - one.sigmax_2) < 1e-6
    near, far = ({r.draw_id: r.event_term for r in QUERIES[k](spark, SF).collect()} for k in ("score_draws", "score_draws_all"))
    assert all(far[d] > near[d] for d in near)


def test_nearest_index_answers_for_a_grid_of_a_hundred_thousand(spark):
    grid = spark.range(100_001).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("T"))
    points = spark.createDataFrame([(0, 3.4), (1, 99_999.6), (2, 2.5), (3, -9.0), (4, 2e5)], "point_id long, T double")
    assert {r["point_id"]: r["idx"] for r in spatial.nearest_index(points, grid, ("T",)).collect()} == {0: 3, 1: 100_000, 2: 2, 3: 0, 4: 100_000}


def test_fit_background_converges_from_many_zeros(spark):
    """Counts with many zeros: the sums of counts and of fitted values agree, also weighted by the covariate."""
    rows = spark.createDataFrame([(0.0 if k % 3 else float(k), 0.0016, (k % 7) / 7.0 - 0.4) for k in range(300)], "n double, exposure double, c double")
    model = fit.fit_background(rows, ["c"])
    b, (w,) = model.intercept, model.coefficients
    left = [(r.n - r.exposure * math.exp(b + w * r.c), r.c) for r in rows.collect()]
    assert abs(sum(v for v, _ in left)) < 0.1 and abs(sum(v * c for v, c in left)) < 0.1


def test_buckets_follow_the_size_of_the_shapes(spark):
    """The same polygons and points in units a thousand times as long; a large shape among small ones."""
    shapes = [(k, [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]) for k, x in enumerate(range(20))] + [(99, [(0.0, 1.0), (20.0, 1.0), (20.0, 41.0), (0.0, 41.0)])]
    for unit in (0.001, 1.0, 1000.0):
        polys = spark.createDataFrame([(k, [{"x": x * unit, "y": y * unit} for x, y in ring]) for k, ring in shapes], "poly_id int, ring array<struct<x:double,y:double>>")
        points = spark.createDataFrame([(k, (k + 0.5) * unit, 0.5 * unit) for k in range(20)] + [(50, 3.0 * unit, 30.0 * unit), (51, 30.0 * unit, 3.0 * unit)], "point_id int, X double, Y double")
        got = {r.point_id: r.poly_id for r in spatial.pip_join(points, polys, "left").collect()}
        assert got == {**{k: k for k in range(20)}, 50: 99, 51: None}
        assert spatial._covered(spatial.polygon_stats(polys), spatial._sides(spatial.polygon_stats(polys))).count() < 2 * spatial.LEAST_COVER


def test_waiting_times_cross_stretches(spark):
    times = [0.1, 0.1, 0.4, 2.5, 2.75, 7.0]
    row = pairs.inter_arrival(spark.createDataFrame([("a", t) for t in times] + [("b", 1.0)], "k string, T double"), "k").collect()
    gaps = sorted(b - a for a, b in zip(times, times[1:]))
    assert [r.k for r in row] == ["a"] and row[0].n == 5
    assert row[0].median == pytest.approx(gaps[2]) and row[0].mean == pytest.approx(sum(gaps) / 5)
    assert row[0].p99 == pytest.approx(gaps[3] + 0.96 * (gaps[4] - gaps[3]))


def _clustered(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    u = np.sort(np.round(rng.random(n) * 20, 2))  # many equal times
    u[n // 3 : n // 2] = 7.0  # a sixth of all rows at one time
    return u, rng.random(n), rng.random(n)


def _by_pairs(u, x, y, pdf, variance, alpha=0.3):
    dt = u[:, None] - u[None]
    near = np.exp(-((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) / 2 / variance) / (2 * math.pi * variance)
    return alpha * (np.where(dt > 0, pdf(np.maximum(dt, 0)), 0) * near).sum(axis=1)


@pytest.mark.parametrize(("variance", "per_stretch"), [(0.01, 100), (0.0004, 20_000), (0.3, 1000)])
def test_full_history_equals_all_pairs(spark, variance, per_stretch):
    u, x, y = _clustered()
    ev = spark.createDataFrame(pd.DataFrame({"point_id": range(len(u)), "u": u, "sx": x, "sy": y}))
    draw = one_draw(spark, alpha=0.3, beta=0.7, sigmax_2=variance)
    found = full_excitation(ev, draw, Exponential(), Gaussian(), per_stretch=per_stretch).toPandas().set_index("i").sort_index()["excitation"].to_numpy()
    np.testing.assert_allclose(found, _by_pairs(u, x, y, lambda t: np.exp(-t / 0.7) / 0.7, variance), atol=1e-7)


def test_full_history_of_a_power_law(spark):
    u, x, y = _clustered(800)
    ev = spark.createDataFrame(pd.DataFrame({"point_id": range(len(u)), "u": u, "sx": x, "sy": y}))
    draw = one_draw(spark, alpha=0.3, beta=0.6, gamma=0.2, sigmax_2=0.02)
    found = full_excitation(ev, draw, PowerLaw(), Gaussian(), per_stretch=90).toPandas().set_index("i").sort_index()["excitation"].to_numpy()
    np.testing.assert_allclose(found, _by_pairs(u, x, y, lambda t: 3 * (1 + t / 0.2) ** -1.6, 0.02), atol=1e-6)


def test_full_history_without_rows_and_for_other_kernels(spark):
    ev = spark.createDataFrame([], "point_id long, u double, sx double, sy double")
    assert full_excitation(ev, one_draw(spark, alpha=0.3, beta=0.7, sigmax_2=0.1), Exponential(), Gaussian()).count() == 0
    with pytest.raises(TypeError):
        full_excitation(ev, one_draw(spark, alpha=0.3, beta=0.7, Lambda=0.1), Exponential(), DoubleExponential())


def test_no_window_is_the_limit_of_wide_windows(spark):
    """The default takes all history; a smaller window lowers the compensator."""
    u, x, y = _clustered(300)
    events = spark.createDataFrame(pd.DataFrame({"point_id": range(len(u)), "X": x, "Y": y, "T": u}))
    d, draw = Domain(t_max=20.0), one_draw(spark, a_0=1.0, alpha=0.3, beta=2.0, sigmax_2=0.05)
    score = lambda w: hawkes(events, d, w).score(draw).first()
    full, wide, small = score(None), score(50.0), score(1.0)
    assert full["loglik"] == pytest.approx(wide["loglik"], abs=1e-6)
    assert small["itot_excite"] < full["itot_excite"] - 1e-6


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_nearest_of_a_large_grid_is_exact(spark, dims):
    """A clustered grid with a far outlier, points inside, on grid points, in gaps and far outside; ties to the lower index."""
    rng = np.random.default_rng(dims)
    g = np.concatenate([0.01 * rng.random((500, dims)), np.round(rng.random((700, dims)), 1), np.full((1, dims), 90.0)])
    p = np.concatenate([rng.random((300, dims)), g[::40], np.full((1, dims), 40.0), np.full((1, dims), -70.0), np.round(rng.random((60, dims)), 1) + 0.05])
    names = tuple("xyz"[:dims])
    points = spark.createDataFrame(pd.DataFrame(p, columns=names).assign(point_id=range(len(p))))
    points = points.withColumn("x", F.when(F.col("point_id") == 0, float("nan")).when(F.col("point_id") == 1, None).otherwise(F.col("x")))
    grid = spark.createDataFrame(pd.DataFrame(g, columns=names).assign(idx=range(len(g))))
    found = {r["point_id"]: r["idx"] for r in spatial.nearest_index(points, grid, names, small=10).collect()}
    d2 = sum((p[:, None, i] - g[None, :, i]) ** 2 for i in range(dims))
    assert found == {k: int(np.argmin(d2[k])) for k in range(2, len(p))}
    assert spatial.nearest_index(points.limit(0), grid, names, small=10).count() == 0


@pytest.mark.parametrize("kind", ["lognormal", "outlier", "cluster"])
def test_quantiles_and_buckets_follow_any_spread(spark, kind):
    rng = np.random.default_rng(7)
    v = {"lognormal": np.exp(4 * rng.standard_normal(60_000)), "outlier": np.append(rng.random(60_000), 1e300), "cluster": 1 + 1e-9 * rng.random(60_000)}[kind]
    rows = spark.createDataFrame(pd.DataFrame({"k": "a", "value": v}))
    found = ranks.quantiles(rows, ["k"], "value", {"q1": 0.1, "q2": 0.5, "q3": 0.999}).first()
    np.testing.assert_allclose([found["q1"], found["q2"], found["q3"]], np.quantile(v, [0.1, 0.5, 0.999]), rtol=1e-12)
    sizes = [r["count"] for r in ranks.bucketed(rows, ["k"], "value").groupBy("bucket").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 2 * len(v) / 256


def test_ranks_set_nulls_apart_and_know_nan_and_infinity(spark):
    v = [float(k) for k in range(1, 11)]
    rows = spark.createDataFrame([("a", x) for x in v] + [("a", None)] * 10 + [(None, x) for x in v] + [("n", None)] + [("i", float("-inf")), ("i", 1.0), ("i", float("inf")), ("i", float("nan"))], "k string, value double")
    found = {r["k"]: (r["low"], r["high"]) for r in ranks.hpdi(rows, ["k"]).collect()}
    assert found["a"] == found[None] == (1.0, 10.0) and set(found) == {"a", None, "i"}
    q = {r["k"]: r["m"] for r in ranks.quantiles(rows, ["k"], "value", {"m": 1 / 3}).collect()}
    assert q["a"] == q[None] == 4.0 and q["i"] == 1.0
    assert ranks.quantiles(rows.filter("k = 'n'"), ["k"], "value", {"m": 0.5}).count() == 0


def test_waiting_times_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 0.0), (None, 2.0), (None, None), ("a", 1.0), ("a", 4.0), ("a", 5.0)], "k string, T double")
    assert {r["k"]: (r["n"], r["mean"], r["median"]) for r in inter_arrival(df, "k").collect()} == {None: (1, 2.0, 2.0), "a": (2, 2.0, 2.0)}


def test_generalised_em_raises_the_likelihood_and_finds_the_kernels(spark):
    """Clusters with Lomax lags and Laplace offsets around even background events."""
    rng = np.random.default_rng(11)
    n = 400
    u, x, y = rng.random(n) * 50, rng.random(n), rng.random(n)
    child = rng.random(n) < 0.5
    lag = 0.2 * (rng.random(n) ** (-1 / 3.0) - 1)
    rows = np.concatenate([np.stack([u, x, y]), np.stack([u + lag, x + rng.laplace(0, 0.02, n), y + rng.laplace(0, 0.02, n)])[:, child]], axis=1)
    rows = rows[:, (rows[0] < 50) & (rows[1:] > 0).all(axis=0) & (rows[1:] < 1).all(axis=0)]
    d = Domain(t_max=50.0)
    ev = prepare.prepare(spark.createDataFrame(pd.DataFrame({"point_id": range(rows.shape[1]), "X": rows[1], "Y": rows[2], "T": rows[0]})), d).persist()
    p = pairs.event_pairs(ev, 5.0).persist()
    path = fit.fit_hawkes_gem(ev, p, d, 5.0, {"a_0": 2.0, "alpha": 0.2, "beta": 1.5, "gamma": 0.5, "Lambda": 0.1}, PowerLaw(), DoubleExponential(), 8).toPandas()
    gains = path["loglik"].diff().dropna()
    assert (gains >= -1e-6 * path["loglik"].abs().max()).all() and gains.iloc[0] > 1
    last = path.iloc[-1]
    assert 0.28 < last["alpha"] < 0.42 and 0.014 < last["Lambda"] < 0.028
    mean_lag = last["gamma"] / max(last["beta"] - 1, 0.1)
    assert 0.03 < mean_lag < 0.4


def test_newton_steps_on_quadratic_forms():
    h = fit.NEAR
    one = [-((k * h - 0.2) ** 2) for k in (-1, 0, 1)]
    assert fit._newton(one) == pytest.approx([0.2])
    two = [-((i * h - 0.1) ** 2) - 2 * (j * h + 0.3) ** 2 - (i * h - 0.1) * (j * h + 0.3) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert fit._newton(two) == pytest.approx([0.1, -0.3])
    assert fit._newton([x * x for x in (-h + 1, 1, h + 1)]) == [fit.FAR] and fit._newton([0.0]) == []


def test_declustered_background_keeps_its_mass(spark):
    d = Domain(t_max=50.0, n_xy=5)
    ev = prepare.prepare(events(spark, [(0.1, 0.1, 1), (0.5, 0.5, 2), (0.9, 0.9, 3), (0.5, 0.52, 2.1)]), d)
    now = {"a_0": 0.0, "alpha": 0.5, "beta": 1.0, "sigmax_2": 0.01}
    flat = spark.range(25).select(F.col("id").cast("int").alias("cell_id"), F.lit(0.04).alias("mu"))
    args = (pairs.event_pairs(ev, 5.0), ev, d, now, Exponential(), Gaussian())
    found = fit.declustered_background(*args, flat, 0.2).toPandas()
    sums = fit.gem_sums(*args[:3], now, Exponential(), Gaussian(), 5.0, flat)
    assert found["mu"].sum() / 25 * 50 == pytest.approx(sums["n"] - sums["p"]) and sums["p"] > 0.1


def test_proposals_are_reproducible_and_state_their_density(spark):
    spec = {"a": proposals.Proposal(1.0, 0.5), "b": proposals.Proposal(-1.0, 0.3, "log"), "c": proposals.Proposal(0.5, 0.8, "logit")}
    one = proposals.proposal_draws(spark, 4000, spec, seed=3)
    assert one.repartition(7).orderBy("draw_id").collect() == proposals.proposal_draws(spark, 4000, spec, seed=3).orderBy("draw_id").collect()
    d = one.toPandas()
    z = np.stack([(d.a - 1) / 0.5, (np.log(d.b) + 1) / 0.3, (np.log(d.c / (1 - d.c)) - 0.5) / 0.8])
    assert abs(z.mean(axis=1)).max() < 0.06 and abs(z.std(axis=1) - 1).max() < 0.05 and abs(np.corrcoef(z) - np.eye(3)).max() < 0.06
    density = (-(z**2) / 2 - np.log(2 * np.pi) / 2).sum(axis=0) - np.log(0.5 * 0.3 * 0.8) - np.log(d.b) - np.log(d.c * (1 - d.c))
    np.testing.assert_allclose(d.log_proposal, density, atol=1e-9)
    with pytest.raises(ValueError):
        proposals.Proposal(0.0, 1.0, "square")


def test_smoothed_weights_find_a_posterior_and_its_shape(spark):
    """Normal target under a wider and under a narrower normal proposal; few and equal weights stay raw."""
    rng = np.random.default_rng(2)
    found = {}
    for sd in (1.5, 0.5):
        x = sd * rng.standard_normal(2000)
        df = spark.createDataFrame(pd.DataFrame({"draw_id": range(2000), "x": x, "lw": -(x**2) / 2 + x**2 / 2 / sd**2}))
        found[sd] = proposals.importance_summary(proposals.smoothed_weights(df.select("draw_id", "lw")), df, ["x"]).first()
    assert abs(found[1.5]["mean"]) < 0.1 and found[1.5]["sd"] == pytest.approx(1, abs=0.08) and found[1.5]["pareto_k"] < 0.5
    assert found[0.5]["pareto_k"] > 0.6 and found[0.5]["effective_size"] < found[1.5]["effective_size"]
    flat = spark.range(50).select(F.col("id").alias("draw_id"), F.lit(2.0).alias("lw"))
    assert {tuple(r) for r in proposals.smoothed_weights(flat).select("weight", "pareto_k").collect()} == {(0.02, None)}


def test_bootstrap_weights_are_poisson_and_give_the_standard_error(spark):
    rng = np.random.default_rng(4)
    v = rng.gamma(2.0, 1.0, 1500)
    df = spark.createDataFrame(pd.DataFrame({"draw_id": range(1500), "v": v, "w": np.nan})).withColumn("w", F.when(F.col("draw_id") == 3, 1.0))
    found = {r["name"]: r for r in proposals.bootstrap_means(df, ["v", "w"], 150).collect()}
    assert found["v"]["sd"] == pytest.approx(v.std() / math.sqrt(1500), rel=0.25) and found["v"]["low"] < v.mean() < found["v"]["high"]
    assert found["w"]["mean"] == 1.0 and found["w"]["sd"] == 0.0
    counts = spark.range(20_000).select(proposals.poisson_weight(F.col("id"), F.lit(0), 0).alias("c"))
    assert counts.agg(F.avg("c"), F.var_samp("c")).first() == pytest.approx((1, 1), abs=0.04)


def _even_odd(ring, x, y):
    p, q = np.array(ring), np.roll(np.array(ring), -1, axis=0)
    n = 0
    for (x1, y1), (x2, y2) in zip(p, q, strict=True):
        if (y1 > y) != (y2 > y):
            (x1, y1), (x2, y2) = sorted([(x1, y1), (x2, y2)], key=lambda v: (v[1], v[0]))
            n += x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)
    return n % 2 == 1


def test_covering_answers_as_the_whole_rings_do(spark):
    """Shapes on a lattice with level and upright edges, a star with 3,000 corners, overlaps, equal rows; points on corners and edges."""
    rng = np.random.default_rng(8)
    angle = np.linspace(0, 2 * np.pi, 3000, endpoint=False)
    r = 0.3 + 0.15 * rng.random(3000)
    star = [(float(0.5 + a * np.cos(t)), float(0.5 + a * np.sin(t))) for a, t in zip(r, angle, strict=True)]
    square = lambda x, y: [(x, y), (x + 0.25, y), (x + 0.25, y + 0.25), (x, y + 0.25)]
    rings = [star, square(0.25, 0.25), square(0.5, 0.25), square(0.25, 0.5), [(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (0.0, 1.0)], square(0.25, 0.25), [(5.0, 5.0), (6.0, 7.0), (7.0, 5.0)]]
    ids = [0, 1, 2, 3, 4, 1, 6]
    polys = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in ring]) for k, ring in zip(ids, rings, strict=True)], "poly_id int, ring array<struct<x:double,y:double>>")
    lattice = [(i / 8, j / 8) for i in range(9) for j in range(9)]
    pts = [*lattice, *map(tuple, rng.random((400, 2))), *star[::300], (6.0, 5.5), (-3.0, 0.2)]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(pts)] + [(9999, None, 0.5)], "point_id long, X double, Y double")
    found = sorted((r.point_id, r.poly_id) for r in spatial.pip_join(points, polys).collect())
    assert found == sorted((k, i) for k, (x, y) in enumerate(pts) for i, ring in zip(ids, rings, strict=True) if _even_odd(ring, x, y))
    assert spatial.pip_join(points, polys, "left").filter("poly_id is null").count() == len(pts) + 1 - len({k for k, _ in found})
    assert spatial.pip_join(points, polys.limit(0)).count() == 0 and spatial.pip_join(points, polys.limit(0), "left").count() == len(pts) + 1


def test_a_polygon_of_very_many_corners_costs_its_edges(spark):
    t = np.linspace(0, 2 * np.pi, 30_000, endpoint=False)
    polys = spark.createDataFrame([(0, [{"x": float(x), "y": float(y)} for x, y in zip(np.cos(t), np.sin(t), strict=True)])], "poly_id int, ring array<struct<x:double,y:double>>")
    cells = spatial.Cover(polys).cells.select(F.size("_edges").alias("n")).toPandas()["n"]
    assert cells.sum() < 2.5 * 30_000 and (cells == 0).mean() > 0.9 and cells.max() < 400


def test_kernels_without_a_mass_are_integrated_to_a_millionth(spark):
    bare = lambda kernel: type("Bare", (Kernel,), {"params": kernel.params, "pdf": kernel.pdf})()
    df = spark.createDataFrame([(0.3, 0.7, 0.05, 0.95, 1e-3), (1.0, 0.0, 0.5, 0.5, 50.0)], "a double, b double, c double, d double, t double")
    sides = [F.col(c) for c in "abcd"]
    for kernel, p in ((DoubleExponential(), {"Lambda": 0.02}), (Gaussian(), {"sigmax_2": 0.01}), (DoubleExponential(), {"Lambda": 3.0})):
        for row in df.select(kernel.mass(*sides, pars=p).alias("m"), bare(type(kernel)).mass(*sides, pars=p).alias("q")).collect():
            assert row["q"] == pytest.approx(row["m"], abs=1e-6)
    for kernel, p in ((Exponential(), {"beta": 0.05}), (PowerLaw(), {"beta": 0.8, "gamma": 0.1})):
        for row in df.select(kernel.mass(F.col("t"), pars=p).alias("m"), bare(type(kernel)).mass(F.col("t"), pars=p).alias("q")).collect():
            assert row["q"] == pytest.approx(row["m"], abs=1e-6)


def test_smooth_grid_equals_the_table_of_all_pairs(spark):
    """Also on a ring and with sides that are even, odd and one cell; nulls and places off the grid do not count."""
    rng = np.random.default_rng(5)
    for (nx, ny), (hx, hy), circular in [((7, 5), (1.0, 0.5), False), ((6, 1), (1.0, 1.0), True), ((5, 3), (1.0, 1.0), True), ((40, 1), (1.0, 1.0), True)]:
        n = rng.integers(0, 4, (ny, nx))
        rows = [(x, y, int(n[y, x])) for y in range(ny) for x in range(nx) if n[y, x]] + [(None, 0, 5), (nx, 0, 5), (0, -1, 5)]
        counts = spark.createDataFrame(rows, "ix int, iy int, n long")
        got = {(r.ix, r.iy): r.value for r in fit.smooth_grid(counts, (nx, ny), (hx, hy), 0.8, circular).collect()}
        dx = np.abs(np.arange(nx)[:, None] - np.arange(nx))
        wx = np.exp(-0.5 * ((np.minimum(dx, nx - dx) if circular else dx) * hx / 0.8) ** 2)
        wy = np.exp(-0.5 * ((np.arange(ny)[:, None] - np.arange(ny)) * hy / 0.8) ** 2)
        logs = np.log((wy @ n @ wx) / np.outer(wy.sum(1), wx.sum(1)) + 1e-9)
        assert len(got) == nx * ny
        for y in range(ny):
            for x in range(nx):
                assert got[x, y] == pytest.approx(logs[y, x] - logs.mean(), abs=1e-9)


def test_smooth_grid_without_counts_is_flat(spark):
    empty = spark.createDataFrame([], "ix int, iy int, n long")
    assert {r.value for r in fit.smooth_grid(empty, (3, 2), (1.0, 1.0), 1.0).collect()} == {0.0}


def test_fit_factors_of_one_factor_is_its_closed_form(spark):
    df = spark.createDataFrame([("u", 3, 1.0), ("u", 2, 1.0), (None, 0, 2.0)], "b string, n long, exposure double")
    found = {(r.factor, r.level): r.effect for r in fit.fit_factors(df, ["b"], 0.5).collect()}
    rate = 5 / 4
    assert found == pytest.approx({("rate", None): math.log(rate), ("b", "u"): math.log(5.5 / (2 * rate + 0.5)), ("b", None): math.log(0.5 / (2 * rate + 0.5))})
    with pytest.raises(ValueError):
        fit.fit_factors(df.limit(0), ["b"])


def test_fit_factors_takes_its_factors_in_turn(spark):
    rows = [(0, 0, 4, 1.0), (0, 1, 1, 2.0), (1, 0, 0, 1.0), (1, 1, 7, 1.5), (2, 1, 2, 0.5)]
    found = {(r.factor, r.level): r.effect for r in fit.fit_factors(spark.createDataFrame(rows, "a int, b int, n long, exposure double"), ["a", "b"], 2.0, cycles=2).collect()}
    rate, m = 14 / 6.0, ([1.0] * 3, [1.0] * 2)
    for at in (0, 1, 0, 1):
        for level in range(len(m[at])):
            mine = [r for r in rows if r[at] == level]
            m[at][level] = (sum(r[2] for r in mine) + 2) / (sum(rate * r[3] * m[1 - at][r[1 - at]] for r in mine) + 2)
    plain = {("rate", None): math.log(rate)} | {(f, str(k)): math.log(v) for f, at in (("a", 0), ("b", 1)) for k, v in enumerate(m[at])}
    assert found == pytest.approx(plain)


def test_draws_are_met_in_turns_beyond_a_size(spark, monkeypatch):
    pairs_ = spark.createDataFrame([(k % 3, 0.1 * k, 0.01 * k, 0.0) for k in range(1, 9)], "i long, dt double, dx double, dy double")
    draws = fixtures.draws(spark, 20)
    whole = likelihood.excitation(pairs_, draws, Exponential(), Gaussian()).orderBy("draw_id", "i").collect()
    monkeypatch.setattr(likelihood, "AT_ONCE", 1)  # a block at a time
    assert likelihood.excitation(pairs_, draws, Exponential(), Gaussian()).orderBy("draw_id", "i").collect() == whole
    assert len(whole) == 60


def test_the_whole_history_copies_no_event_for_wide_gaussians(spark, monkeypatch):
    from pulsefield.plans import history

    monkeypatch.setattr(history, "_some", lambda *_: pytest.fail("events are copied to cells"))
    rows = [(k, float(k * 29 % 97) / 4, (k * 37 % 101) / 101, (k * 53 % 103) / 103) for k in range(200)]
    ev = spark.createDataFrame(rows, "point_id long, u double, sx double, sy double")
    found = {r["i"]: r["excitation"] for r in full_excitation(ev, one_draw(spark, alpha=0.3, beta=0.7, sigmax_2=0.01), Exponential(), Gaussian(), per_stretch=20).collect()}
    for i, u, x, y in rows:
        want = sum(0.3 / 0.7 * math.exp(-(u - b) / 0.7 - ((x - c) ** 2 + (y - d) ** 2) / 0.02) / (2 * math.pi * 0.01) for _, b, c, d in rows if b < u)
        assert math.isclose(found[i], want, rel_tol=1e-8, abs_tol=1e-8)
