"""DuckDB SQL with the same results as the queries of `pulsefield.plans.queries`."""

from __future__ import annotations

import math

from pulsefield.sources.fixtures import POLYGONS

_RINGS = " UNION ALL ".join(
    f"SELECT {k} AS poly_id, {i} AS i, {p[0]}::DOUBLE AS x1, {p[1]}::DOUBLE AS y1, {q[0]}::DOUBLE AS x2, {q[1]}::DOUBLE AS y2"
    for k, ring in POLYGONS
    for i, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True))
)


def _prepared(source: str, t_max: float) -> str:
    cell = lambda v, n: f"CASE WHEN {v} >= 0 AND {v} <= {n} THEN least(floor({v}), {n - 1})::INT END"
    return f"""SELECT *, {cell('u', 50)} AS time_bin, {cell('a', 24)} AS season_bin, {cell('sy * 25', 25)} * 25 + {cell('sx * 25', 25)} AS cell_id
      FROM (SELECT *, T / {t_max}e0 * 50 AS u, T % 365e0 / 365e0 * 24 AS a, X AS sx, Y AS sy FROM {source})"""


_PAIRS = """SELECT a.point_id AS i, b.point_id AS j, a.u - b.u AS dt, a.sx - b.sx AS dx, a.sy - b.sy AS dy
  FROM eb a JOIN eb b ON b.u < a.u AND b.u >= a.u - 0.41
  WHERE a.u - b.u > 0 AND a.u - b.u <= 0.4 AND sqrt((a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy)) <= 0.05"""

_CTE = {
    "ev": """SELECT event_id AS point_id, ts, user_id,
        ((user_id*37)%101 + ((event_id*7919)%1009)/1009e0)/101e0 AS X, ((user_id*53)%103 + ((event_id*104729)%1013)/1013e0)/103e0 AS Y,
        (epoch_us(ts) - epoch_us(timestamp '2024-01-01'))/86400000000e0 AS T FROM events""",
    "ov": """SELECT o_orderkey AS point_id, ((o_custkey*37)%101 + ((o_orderkey*7919)%1009)/1009e0)/101e0 AS X,
        ((o_custkey*53)%103 + ((o_orderkey*104729)%1013)/1013e0)/103e0 AS Y, date_diff('day', date '1995-01-01', o_orderdate::DATE)::DOUBLE AS T FROM orders""",
    "eb": _prepared("ev", 30),
    "ob": _prepared("ov", 2405),
    "pairs": _PAIRS,
    "ring": _RINGS,
    "pip": """SELECT point_id, X, Y, poly_id FROM (SELECT point_id, X, Y, poly_id, count(*) FILTER (WHERE (y1 > Y) <> (y2 > Y) AND X < x1 + (Y - y1) / (y2 - y1) * (x2 - x1)) AS n
        FROM ev, ring GROUP BY ALL) WHERE n % 2 = 1""",
    "cov": """SELECT i AS cov_id, (i%10)/10e0 AS x_min, (i//10)/10e0 AS y_min, ((i*37)%101)/101e0 AS c1, ((i*53)%103)/103e0 AS c2, ((i*29)%107)/107e0 AS c3 FROM range(100) r(i)""",
    "in_cov": """SELECT *, least(floor(Y * 10), 9)::INT * 10 + least(floor(X * 10), 9)::INT AS cov_id FROM eb""",
    "sgrid": """SELECT i::INT AS cell_id, (25 - i//25)::INT AS grid_row, (i%25 + 1)::INT AS grid_col, (i%25)/25e0 AS x_min, (i%25+1)/25e0 AS x_max, (i//25)/25e0 AS y_min, (i//25+1)/25e0 AS y_max FROM range(625) r(i)""",
    "ncell": "SELECT cell_id, count(*) AS n FROM eb GROUP BY 1",
    "over": """SELECT * FROM (SELECT g.cell_id, c.cov_id, greatest(0, least(g.x_max, c.x_min + 0.1) - greatest(g.x_min, c.x_min)) * greatest(0, least(g.y_max, c.y_min + 0.1) - greatest(g.y_min, c.y_min)) AS area
        FROM sgrid g, cov c) WHERE area >= 1e-10""",
    "dom": "SELECT DISTINCT cell_id FROM over JOIN cov USING (cov_id) WHERE c1 > 0.5",
    "opairs": _PAIRS.replace("eb ", "ob "),
    "season_of": "SELECT i::INT AS time_bin, floor((i + 0.5) / 50 * 30e0 % 365e0 / 365e0 * 24)::INT AS season_bin FROM range(50) r(i)",
    "counts": "SELECT 'f_t' AS field, time_bin::BIGINT AS idx, count(*) AS n FROM eb GROUP BY ALL UNION ALL SELECT 'f_a', season_bin, count(*) FROM eb GROUP BY ALL UNION ALL SELECT 'f_xy', cell_id, count(*) FROM eb GROUP BY ALL",
    "hot": "SELECT cell_id, ln(0.5 + coalesce(n, 0)) AS post_mean FROM sgrid LEFT JOIN ncell USING (cell_id)",
}
for _n in (4, 20, 200):
    _CTE[f"draws{_n}"] = f"""SELECT i AS draw_id, 2 + ((i*41)%229)/229e0 AS a_0, 0.1 + ((i*37)%211)/1055e0 AS alpha, 0.02 + ((i*53)%223)/2230e0 AS beta, 0.5 + ((i*31)%233)/233e0 AS gamma,
        0.005 + ((i*29)%227)/22700e0 AS sigmax_2, ((i*17)%239)/239e0 - 0.5 AS w1, ((i*43)%239)/239e0 - 0.5 AS w2, ((i*61)%239)/239e0 - 0.5 AS w3 FROM range({_n}) r(i)"""
    _CTE[f"fields{_n}"] = " UNION ALL ".join(
        f"SELECT d AS draw_id, '{f}' AS field, i AS idx, ((d*7 + i*{k})%{m})/{m}e0 - 0.5 AS value FROM range({_n}) a(d), range({size}) b(i)" for f, size, k, m in (("f_t", 50, 13, 53), ("f_a", 24, 11, 29), ("f_xy", 625, 17, 641))
    )
    _CTE[f"effect{_n}"] = f"SELECT draw_id, cov_id, c1*w1 + c2*w2 + c3*w3 AS b_0 FROM cov, draws{_n}"
_NEEDS = {
    "eb": ["ev"], "ob": ["ov"], "pairs": ["eb"], "pip": ["ev", "ring"], "in_cov": ["eb"], "ncell": ["eb"], "over": ["sgrid", "cov"], "dom": ["over"], "opairs": ["ob"], "counts": ["eb"], "hot": ["sgrid", "ncell"],
    **{f"effect{n}": ["cov", f"draws{n}"] for n in (4, 20, 200)},
}


def _sql(needs: str, body: str) -> str:
    """`body` after the named common tables and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    with_ = ",\n".join(f"{n} AS MATERIALIZED ({_CTE[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {with_},\n{body[5:]}"
    return f"WITH {with_}\n{body}"


def _erf(x: str) -> str:
    t = f"(1/(1+0.3275911*abs({x})))"
    return f"(sign({x})*(1-((((1.061405429*{t}-1.453152027)*{t}+1.421413741)*{t}-0.284496736)*{t}+0.254829592)*{t}*exp(-({x})*({x}))))"


def _gauss_mass(s: str) -> str:
    e = lambda v: _erf(f"(({v})/sqrt(2*{s}))")
    return f"(({e('1-sx')}+{e('sx')})/2*({e('1-sy')}+{e('sy')})/2)"


def _scores(draws: str) -> str:
    """CTEs ending in `scores`: the Hawkes log-likelihood of each draw."""
    return f"""exc AS (
      SELECT draw_id, i, sum(alpha * exp(-dt/beta)/beta * exp(-(dx*dx+dy*dy)/(2*sigmax_2))/(2*pi()*sigmax_2)) AS e FROM pairs, {draws} GROUP BY ALL
    ), term AS (
      SELECT d.draw_id, sum(ln(coalesce(e, 0) + exp(a_0))) AS event_term FROM eb CROSS JOIN {draws} d LEFT JOIN exc ON exc.draw_id = d.draw_id AND i = point_id GROUP BY 1
    ), comp AS (
      SELECT draw_id, sum(alpha * (1-exp(-least(50-u, 0.4)/beta)) * {_gauss_mass('sigmax_2')}) AS itot_excite FROM eb, {draws} GROUP BY 1
    ), scores AS (
      SELECT draw_id, event_term, exp(a_0)*50 AS itot_back, itot_excite, event_term - exp(a_0)*50 - itot_excite AS loglik FROM term JOIN comp USING (draw_id) JOIN {draws} USING (draw_id)
    )"""


_ONE = "one AS (SELECT 0::BIGINT AS draw_id, 3e0 AS a_0, 0.3e0 AS alpha, 0.05e0 AS beta, 0.01e0 AS sigmax_2)"
_TI = """ti AS (SELECT t.draw_id, sum(exp(a_0 + t.value + a.value)) AS itot_time FROM fields4 t JOIN season_of ON t.idx = time_bin JOIN fields4 a ON a.draw_id = t.draw_id AND a.field = 'f_a' AND a.idx = season_bin
      JOIN draws4 d ON d.draw_id = t.draw_id WHERE t.field = 'f_t' GROUP BY 1)"""
_SI = "si AS (SELECT draw_id, sum(exp(value))/625 AS itot_xy FROM fields4 WHERE field = 'f_xy' GROUP BY 1)"
_PRIOR = "(-(a_0/5)*(a_0/5)/2 - ln(5) - ln(2*pi())/2 + ln(alpha) + ln(1-alpha) + ln(6) - beta*beta/2 + ln(2/pi())/2 - (sigmax_2/0.25)*(sigmax_2/0.25)/2 + ln(2/pi())/2 - ln(0.25))"


def _quantiles(rows: str, extra: str) -> str:
    return f"SELECT param, {extra} FROM ({rows}) GROUP BY param"


def _hpdi(rows: str, keys: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""r AS (SELECT {keys}, value, row_number() OVER (PARTITION BY {keys} ORDER BY value) AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM ({rows})),
    h AS (SELECT {cols}, min(struct_pack(w := b.value - a.value, low := a.value, high := b.value)) AS s FROM r a JOIN r b ON {on} AND b.r = a.r + least(floor(a.n*0.9), a.n - 1) GROUP BY ALL)"""


_EXPECTED = "(SELECT count(*) FROM eb)"
_LONG = lambda d, params: " UNION ALL ".join(f"SELECT draw_id, '{p}' AS param, {p}::DOUBLE AS value FROM {d}" for p in params)
_SCORED = lambda n: f"sc AS (SELECT *, exp(a_0)*50/{_EXPECTED} AS expected FROM draws{n})"
_CURVE = f"""cv AS (SELECT draw_id, i AS lag, (i*50e0/249)/50*30 AS days, exp(-(i*50e0/249)/b)/b AS value FROM (SELECT draw_id, beta*100*ln({_EXPECTED}::DOUBLE)/10 AS b FROM draws20), range(250) r(i))"""


def _hotspots(hot: float, cold: float) -> str:
    return f"""WITH lim AS (SELECT quantile_cont(post_mean, {hot}) AS h, quantile_cont(post_mean, {cold}) AS c FROM hot), k AS (
      SELECT 'hot' AS kind, cell_id, post_mean, -post_mean AS o FROM hot, lim WHERE post_mean >= h UNION ALL SELECT 'cold', cell_id, post_mean, post_mean FROM hot, lim WHERE post_mean <= c
    ), ranked AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY o, cell_id)::INT AS rank, cell_id, post_mean FROM k)"""


_DT_MASS = "(1-exp(-least(50-u, 0.4)/0.05))"
_KERNEL = "exp(-0.5*((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))/(0.08*0.08))"

ORACLES: dict[str, str] = {
    "read_events": _sql("ev", "SELECT point_id, round(X,6) AS X, round(Y,6) AS Y, round(T,6) AS T FROM ev"),
    "clean_events": _sql("ev", "SELECT point_id, round(X,6) AS X, round(Y,6) AS Y, round(T,6) AS T FROM ev WHERE point_id % 97 <> 0 AND point_id % 89 <> 0"),
    "binned_events": _sql("eb", "SELECT point_id, time_bin, season_bin, cell_id, round(u,6) AS u, round(a,6) AS a, round(sx,6) AS sx, round(sy,6) AS sy FROM eb"),
    "binned_orders": _sql("ob", "SELECT point_id, time_bin, season_bin, cell_id FROM ob"),
    "season_of_time": _sql("ob", """SELECT time_bin, least(floor((time_bin + 0.5)/50*2405e0 % 365e0 / 365e0 * 24), 23)::INT AS season_bin, season_bin AS own, count(*) AS n FROM ob GROUP BY ALL"""),
    "validate_season": _sql("ov", """SELECT point_id, round(A,6) AS A, round(derived,6) AS derived FROM (SELECT point_id, T % 365e0 + CASE WHEN point_id % 50 = 0 THEN 100e0 ELSE 0 END AS A, T % 365e0 AS derived FROM ov)
      WHERE abs(A % 365e0 - derived) > 1 + 1e-5*abs(derived)"""),
    "space_grid": _sql("sgrid ncell", "SELECT cell_id, grid_row, grid_col, round(x_min,6) AS x_min, round(x_max,6) AS x_max, round(y_min,6) AS y_min, round(y_max,6) AS y_max, coalesce(n,0) AS n FROM sgrid LEFT JOIN ncell USING (cell_id)"),
    "time_grid": _sql("ob", "SELECT i::INT AS time_bin, round(i/50e0*2405,6) AS day_from, round((i+1)/50e0*2405,6) AS day_to, (SELECT count(*) FROM ob WHERE time_bin = i) AS n FROM range(50) r(i)"),
    "season_grid": _sql("ob", "SELECT i::INT AS season_bin, round(i/24e0*365,6) AS day_from, round((i+1)/24e0*365,6) AS day_to, (SELECT count(*) FROM ob WHERE season_bin = i) AS n FROM range(24) r(i)"),
    "events_by_month": "SELECT month(o_orderdate)::INT AS month, count(*) AS n FROM orders GROUP BY 1",
    "month_ticks": """WITH t AS (SELECT unnest(generate_series(timestamp '1995-01-01', timestamp '1995-01-01' + interval 2404 day, interval 1 month))::DATE AS d), m AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, lead(d) OVER (ORDER BY d) IS NULL AS last FROM t),
      o AS (SELECT date_trunc('month', o_orderdate)::DATE AS d, count(*) AS n FROM orders GROUP BY 1)
      SELECT strftime(d, '%Y-%m-%d') AS tick, date_diff('day', date '1995-01-01', d)::INT AS day, CASE WHEN k % 3 = 0 OR last THEN strftime(d, '%Y-%m') END AS label, coalesce(n, 0) AS n FROM m LEFT JOIN o USING (d)""",
    "season_ticks": _sql("ov", """SELECT i::INT AS month, (dayofyear(make_date(2023, i::INT, 1)) - 1)::INT AS day, (SELECT count(*) FROM ov WHERE T % 365e0 = dayofyear(make_date(2023, i::INT, 1)) - 1) AS n FROM range(1, 13) r(i)"""),
    "time_axis": _sql("eb", "SELECT round(avg((T - u/50*30)*(T - u/50*30)),6) AS mse, round(sum((T - u/50*30)*(T - u/50*30)),6) AS sse FROM eb"),
    "squared_error": _sql("ev", "SELECT round(avg((X-Y)*(X-Y)),6) AS mse, round(sum((X-Y)*(X-Y)),6) AS sse FROM ev"),
    "pairs_time": _sql("eb", """SELECT a.point_id AS i, count(*) AS n, round(sum(a.u-b.u),4) AS dt, round(sum(abs(a.sx-b.sx)),4) AS dx, min(b.point_id) AS j_least, max(b.point_id) AS j_most
      FROM eb a JOIN eb b ON b.u < a.u AND b.u >= a.u - 0.11 WHERE a.u - b.u > 0 AND a.u - b.u <= 0.1 GROUP BY 1"""),
    "pairs_space_time": _sql("pairs", "SELECT i, j, round(dt,6) AS dt, round(dx,6) AS dx, round(dy,6) AS dy FROM pairs"),
    "pairs_1d": _sql("ov", "SELECT a.T - b.T AS dt, count(*) AS n, sum(a.point_id)::BIGINT AS i, sum(b.point_id)::BIGINT AS j FROM ov a JOIN ov b ON b.T < a.T AND b.T >= a.T - 3 GROUP BY 1"),
    "pairs_subset": _sql("ev", "SELECT a.point_id AS i, count(*) AS n, sum(b.point_id)::BIGINT AS j, round(sum(a.T-b.T),4) AS dt FROM ev a JOIN ev b ON b.T < a.T AND b.T >= a.T - 0.11 WHERE a.point_id % 10 = 3 AND a.T - b.T <= 0.1 GROUP BY 1"),
    "pairs_x_lag": _sql("eb", """SELECT a.point_id AS i, count(*) AS n, round(sum(a.sx-b.sx),4) AS dx, round(sum(abs(a.sy-b.sy)),4) AS dy FROM eb a JOIN eb b ON b.sx < a.sx AND b.sx >= a.sx - 0.006
      WHERE a.sx - b.sx > 0 AND a.sx - b.sx <= 0.005 GROUP BY 1"""),
    "pair_count": _sql("eb", "WITH c AS (SELECT floor(u/0.4) AS b, count(*) AS n FROM eb GROUP BY 1) SELECT sum(c.n * (c.n + coalesce(p.n, 0)))::BIGINT AS pairs_at_most FROM c LEFT JOIN c p ON p.b = c.b - 1"),
    "inter_arrival": _sql("ev", """SELECT user_id, count(*) AS n, round(avg(gap),6) AS mean, round(quantile_cont(gap,0.5),6) AS median, round(quantile_cont(gap,0.99),6) AS p99
      FROM (SELECT user_id, T - lag(T) OVER (PARTITION BY user_id ORDER BY T, point_id) AS gap FROM ev) WHERE gap IS NOT NULL GROUP BY 1"""),
    "read_covariates": _sql("ov cov", "SELECT cov_id, count(*) AS n, round(sum(c1),4) AS c1 FROM ov JOIN cov ON cov_id = least(floor(Y*10),9)*10 + least(floor(X*10),9) GROUP BY 1"),
    "polygon_stats": _sql("pip", """SELECT poly_id, round(min(x1),6) AS x_min, round(max(x1),6) AS x_max, round(min(y1),6) AS y_min, round(max(y1),6) AS y_max, round(abs(sum(x1*y2-x2*y1))/2,6) AS area, (SELECT count(*) FROM pip p WHERE p.poly_id = ring.poly_id) AS n FROM ring GROUP BY 1"""),
    "pip_join": _sql("pip", "SELECT point_id, poly_id FROM pip"),
    "coverage_errors": _sql("pip", "SELECT point_id, count(poly_id) AS hits FROM ev LEFT JOIN pip USING (point_id) GROUP BY 1 HAVING count(poly_id) <> 1"),
    "clip_to_domain": _sql("pip", "SELECT DISTINCT point_id, round(X,6) AS X, round(Y,6) AS Y FROM pip"),
    "cells_in_domain": _sql("dom eb", "SELECT cell_id, count(*) AS n FROM eb WHERE cell_id IN (SELECT cell_id FROM dom) GROUP BY 1"),
    "overlay_area": _sql("over ncell", "SELECT cell_id, cov_id, round(area,9) AS area, coalesce(n,0) AS n FROM over LEFT JOIN ncell USING (cell_id)"),
    "nearest_index": _sql("ev", """SELECT point_id, arg_min(i, struct_pack(d := (X-gx)*(X-gx)+(Y-gy)*(Y-gy), i := i)) AS idx FROM ev, (SELECT i, ((i*37)%50)/50e0 AS gx, ((i*23)%50)/50e0 AS gy FROM range(50) r(i)) GROUP BY 1"""),
    "nearest_index_1d": _sql("ev", "SELECT point_id, arg_min(i, struct_pack(d := (T-i)*(T-i), i := i)) AS idx FROM ev, range(31) r(i) GROUP BY 1"),
    "standardized_cov": _sql("in_cov cov", "SELECT cov_id, count(*) AS n, " + ", ".join(f"round(sum(({c}-(SELECT avg({c}) FROM cov))/(SELECT stddev_pop({c}) FROM cov)),4) AS {c}" for c in ("c1", "c2", "c3")) + " FROM in_cov JOIN cov USING (cov_id) GROUP BY 1"),
    "covariate_effect": _sql("in_cov effect4", "SELECT draw_id, round(sum(b_0),3) AS b_0, count(*) AS n FROM in_cov JOIN effect4 USING (cov_id) GROUP BY 1"),
    "background_at_events": _sql("eb fields4 draws4", """SELECT d.draw_id, point_id, round(exp(a_0 + t.value + a.value + x.value),5) AS background FROM eb CROSS JOIN draws4 d JOIN fields4 t ON t.draw_id = d.draw_id AND t.field = 'f_t' AND t.idx = time_bin
      JOIN fields4 a ON a.draw_id = d.draw_id AND a.field = 'f_a' AND a.idx = season_bin JOIN fields4 x ON x.draw_id = d.draw_id AND x.field = 'f_xy' AND x.idx = cell_id"""),
    "sufficient_counts": _sql("counts", "SELECT * FROM counts"),
    "excitation": _sql("pairs", "SELECT i, round(sum(0.3 * exp(-dt/0.05)/0.05 * exp(-(dx*dx+dy*dy)/0.02)/(2*pi()*0.01)),5) AS excitation FROM pairs GROUP BY 1"),
    "hawkes_loglik": _sql("pairs", f"WITH {_ONE}, {_scores('one')} SELECT round(event_term,3) AS event_term, round(itot_back,3) AS itot_back, round(itot_excite,3) AS itot_excite, round(loglik,3) AS loglik FROM scores"),
    "score_draws": _sql("pairs draws4", f"WITH {_scores('draws4')} SELECT draw_id, round(event_term,3) AS event_term, round(itot_back,3) AS itot_back, round(itot_excite,3) AS itot_excite, round(loglik,3) AS loglik FROM scores"),
    "power_law_excitation": _sql("pairs draws4", """SELECT draw_id, count(*) AS n, round(sum(e),2) AS excitation FROM (SELECT draw_id, i, sum(alpha * beta/gamma*pow(1+dt/gamma, -beta-1) * exp(-(abs(dx)+abs(dy))/(sigmax_2*5))/pow(2*sigmax_2*5,2)) AS e FROM pairs, draws4 GROUP BY ALL) GROUP BY 1"""),
    "power_law_integral": _sql("eb draws4", """SELECT draw_id, round(sum(alpha*(1-pow(1+least(50-u,0.4)/gamma,-beta))*(1-(exp(-(1-sx)/(sigmax_2*5))+exp(-sx/(sigmax_2*5)))/2)*(1-(exp(-(1-sy)/(sigmax_2*5))+exp(-sy/(sigmax_2*5)))/2)),3) AS itot_excite FROM eb, draws4 GROUP BY 1"""),
    "hawkes_cov_integral": _sql("effect4 eb", "SELECT draw_id, round(sum(exp(a_0+b_0)*0.01)*50,4) AS itot_back, round((SELECT count(*) FROM eb)/(sum(exp(a_0+b_0)*0.01)*50),4) AS observed FROM effect4 JOIN draws4 USING (draw_id) GROUP BY 1"),
    "hawkes_cov_loglik": _sql("pairs in_cov effect4", f"""WITH {_scores('draws4')}, et AS (SELECT f.draw_id, sum(ln(coalesce(e,0) + exp(a_0 + b_0))) AS et FROM in_cov JOIN effect4 f USING (cov_id) JOIN draws4 USING (draw_id) LEFT JOIN exc ON exc.draw_id = f.draw_id AND exc.i = point_id GROUP BY 1),
      ib AS (SELECT draw_id, sum(exp(a_0+b_0)*0.01)*50 AS ib FROM effect4 JOIN draws4 USING (draw_id) GROUP BY 1)
      SELECT draw_id, round(et,3) AS event_term, round(ib,3) AS itot_back, round(itot_excite,3) AS itot_excite, round(et - ib - itot_excite,3) AS loglik FROM et JOIN ib USING (draw_id) JOIN comp USING (draw_id)"""),
    "cox_hawkes_cov_loglik": _sql("pairs in_cov fields4 effect4 over season_of", f"""WITH {_scores('draws4')}, {_TI}, si AS (SELECT f.draw_id, sum(exp(b_0 + value)*area) AS itot_xy FROM over JOIN fields4 f ON f.field = 'f_xy' AND f.idx = over.cell_id JOIN effect4 e ON e.draw_id = f.draw_id AND e.cov_id = over.cov_id GROUP BY 1),
      bg AS (SELECT d.draw_id, point_id, exp(a_0 + t.value + a.value + x.value + b_0) AS b FROM in_cov CROSS JOIN draws4 d JOIN effect4 c ON c.draw_id = d.draw_id AND c.cov_id = in_cov.cov_id JOIN fields4 t ON t.draw_id = d.draw_id AND t.field = 'f_t' AND t.idx = time_bin
      JOIN fields4 a ON a.draw_id = d.draw_id AND a.field = 'f_a' AND a.idx = season_bin JOIN fields4 x ON x.draw_id = d.draw_id AND x.field = 'f_xy' AND x.idx = cell_id), et AS (SELECT bg.draw_id, sum(ln(coalesce(e,0)+b)) AS et FROM bg LEFT JOIN exc ON exc.draw_id = bg.draw_id AND exc.i = point_id GROUP BY 1)
      SELECT draw_id, round(et,3) AS event_term, round(itot_time*itot_xy,3) AS itot_back, round(itot_excite,3) AS itot_excite, round(et - itot_time*itot_xy - itot_excite,3) AS loglik FROM et JOIN ti USING (draw_id) JOIN si USING (draw_id) JOIN comp USING (draw_id)"""),
    "lgcp_domain_loglik": _sql("in_cov cov fields4 draws4 season_of dom", f"""WITH {_TI}, si AS (SELECT draw_id, sum(exp(value))/625 AS itot_xy FROM fields4 WHERE field = 'f_xy' AND idx IN (SELECT cell_id FROM dom) GROUP BY 1),
      held AS (SELECT in_cov.* FROM in_cov JOIN cov USING (cov_id) WHERE c1 > 0.5), lin AS (SELECT t.draw_id, sum(t.value + a.value + x.value) AS l, count(*) AS n FROM held JOIN fields4 t ON t.field = 'f_t' AND t.idx = time_bin
      JOIN fields4 a ON a.draw_id = t.draw_id AND a.field = 'f_a' AND a.idx = season_bin JOIN fields4 x ON x.draw_id = t.draw_id AND x.field = 'f_xy' AND x.idx = cell_id GROUP BY 1)
      SELECT draw_id, round(n*a_0 + l,3) AS event_term, round(itot_time*itot_xy,3) AS itot, round(n*a_0 + l - itot_time*itot_xy,3) AS loglik FROM lin JOIN draws4 USING (draw_id) JOIN ti USING (draw_id) JOIN si USING (draw_id)"""),
    "heldout_loglik": _sql("opairs draws4", f"WITH {_scores('draws4').replace('eb', 'ob').replace('FROM pairs', 'FROM opairs')}, m AS (SELECT max(loglik) AS m FROM scores) SELECT round(max(m) + ln(sum(exp(loglik-m))) - ln(count(*)),3) AS log_expected_likelihood FROM scores, m"),
    "rates": _sql("counts fields4 draws4", "SELECT draw_id, f.field, f.idx, round(exp(value + CASE WHEN f.field = 'f_t' THEN a_0 ELSE 0 END),5) AS rate, coalesce(n, 0) AS n FROM fields4 f JOIN draws4 USING (draw_id) LEFT JOIN counts c ON c.field = f.field AND c.idx = f.idx"),
    "smooth_season": _sql("ob", """WITH n AS (SELECT season_bin AS i, count(*) AS n FROM ob GROUP BY 1), w AS (SELECT a.i AS idx, b.i AS j, exp(-0.5*pow(least(abs(a.i-b.i), 24-abs(a.i-b.i)), 2)/(1.5*1.5)) AS k FROM range(24) a(i), range(24) b(i)),
      l AS (SELECT idx, ln(sum(k*coalesce(n,0))/sum(k) + 1e-9) AS l FROM w LEFT JOIN n ON n.i = j GROUP BY 1) SELECT idx::INT AS idx, round(l-(SELECT avg(l) FROM l),6) AS value FROM l"""),
    "lgcp_loglik": _sql("counts fields4 draws4 season_of", f"""WITH {_TI}, {_SI}, lin AS (SELECT draw_id, sum(n*value) AS l FROM counts JOIN fields4 USING (field, idx) GROUP BY 1)
      SELECT draw_id, round((SELECT count(*) FROM eb)*a_0 + l,3) AS event_term, round(itot_time*itot_xy,3) AS itot, round((SELECT count(*) FROM eb)*a_0 + l - itot_time*itot_xy,3) AS loglik FROM lin JOIN draws4 USING (draw_id) JOIN ti USING (draw_id) JOIN si USING (draw_id)"""),
    "lgcp_cov_loglik": _sql("counts in_cov fields4 effect4 over season_of", f"""WITH {_TI}, si AS (SELECT f.draw_id, sum(exp(b_0 + value)*area) AS itot_xy FROM over JOIN fields4 f ON f.field = 'f_xy' AND f.idx = over.cell_id JOIN effect4 e ON e.draw_id = f.draw_id AND e.cov_id = over.cov_id GROUP BY 1),
      lin AS (SELECT draw_id, sum(n*value) AS l FROM counts JOIN fields4 USING (field, idx) GROUP BY 1), linb AS (SELECT draw_id, sum(b_0) AS lb FROM in_cov JOIN effect4 USING (cov_id) GROUP BY 1)
      SELECT draw_id, round((SELECT count(*) FROM eb)*a_0 + l + lb,3) AS event_term, round(itot_time*itot_xy,3) AS itot, round((SELECT count(*) FROM eb)*a_0 + l + lb - itot_time*itot_xy,3) AS loglik FROM lin JOIN linb USING (draw_id) JOIN draws4 USING (draw_id) JOIN ti USING (draw_id) JOIN si USING (draw_id)"""),
    "cox_hawkes_loglik": _sql("pairs fields4 draws4 season_of", f"""WITH {_scores('draws4')}, {_TI}, {_SI}, bg AS (SELECT d.draw_id, point_id, exp(a_0 + t.value + a.value + x.value) AS b FROM eb CROSS JOIN draws4 d JOIN fields4 t ON t.draw_id = d.draw_id AND t.field = 'f_t' AND t.idx = time_bin
      JOIN fields4 a ON a.draw_id = d.draw_id AND a.field = 'f_a' AND a.idx = season_bin JOIN fields4 x ON x.draw_id = d.draw_id AND x.field = 'f_xy' AND x.idx = cell_id), et AS (SELECT bg.draw_id, sum(ln(coalesce(e,0)+b)) AS et FROM bg LEFT JOIN exc ON exc.draw_id = bg.draw_id AND i = point_id GROUP BY 1)
      SELECT draw_id, round(et,3) AS event_term, round(itot_time*itot_xy,3) AS itot_back, round(itot_excite,3) AS itot_excite, round(et - itot_time*itot_xy - itot_excite,3) AS loglik FROM et JOIN ti USING (draw_id) JOIN si USING (draw_id) JOIN comp USING (draw_id)"""),
    "marginal_rates": _sql("counts fields4 draws4", """WITH r AS (SELECT draw_id, field, idx, exp(value + CASE WHEN field = 'f_t' THEN a_0 ELSE 0 END) AS rate FROM fields4 JOIN draws4 USING (draw_id)), e AS (SELECT draw_id, sum(rate*n)/sum(n) AS seen FROM r JOIN counts USING (field, idx) GROUP BY 1)
      SELECT draw_id, round(sum(rate) FILTER (WHERE field='f_t'),4) AS itot_t, round(sum(rate) FILTER (WHERE field='f_a'),4) AS itot_a, round(sum(rate/625) FILTER (WHERE field='f_xy'),4) AS itot_xy, round(any_value(seen),4) AS rate_at_events FROM r JOIN e USING (draw_id) GROUP BY 1"""),
    "log_expected_likelihood": _sql("pairs draws4", f"WITH {_scores('draws4')}, m AS (SELECT max(loglik) AS m FROM scores) SELECT round(max(m) + ln(sum(exp(loglik-m))) - ln(count(*)),3) AS log_expected_likelihood FROM scores, m"),
    "expected_aic": _sql("pairs draws4", f"WITH {_scores('draws4')} SELECT round(-2*avg(loglik)+8,3) AS expected_aic FROM scores"),
    "excitation_share": _sql("pairs draws4", f"WITH {_scores('draws4')} SELECT draw_id, round(itot_excite/(itot_excite+itot_back),6) AS share FROM scores"),
    "log_prior_scores": _sql("pairs draws4", f"WITH {_scores('draws4')} SELECT draw_id, round({_PRIOR},6) AS log_prior, round(loglik+{_PRIOR},3) AS log_posterior FROM scores JOIN draws4 USING (draw_id)"),
    "posterior_weights": _sql("pairs draws4", f"WITH {_scores('draws4')}, lw AS (SELECT draw_id, loglik + {_PRIOR} AS lw FROM scores JOIN draws4 USING (draw_id)) SELECT draw_id, round(exp(lw-(SELECT max(lw) FROM lw))/(SELECT sum(exp(lw-(SELECT max(lw) FROM lw))) FROM lw),5) AS weight FROM lw"),
    "em_step": _sql("pairs", f"""WITH f AS (SELECT i, dt, dx*dx+dy*dy AS d2, 0.3*exp(-dt/0.05)/0.05*exp(-(dx*dx+dy*dy)/0.02)/(2*pi()*0.01) AS f FROM pairs), g AS (SELECT i, sum(f) AS f, sum(f*dt) AS ft, sum(f*d2) AS fd FROM f GROUP BY 1),
      s AS (SELECT sum(f/(f+exp(3e0))) AS p, sum(ft/(f+exp(3e0))) AS pt, sum(fd/(f+exp(3e0))) AS pd FROM g), m AS (SELECT count(*) AS n, sum({_DT_MASS}*{_gauss_mass('0.01')}) AS mass FROM eb)
      SELECT round(ln((n-p)/50),6) AS a_0, round(p/mass,6) AS alpha, round(pt/p,6) AS beta, round(pd/(2*p),6) AS sigmax_2 FROM s, m"""),
    "triggered_probability": _sql("pairs", """WITH e AS (SELECT i, sum(0.3*exp(-dt/0.05)/0.05*exp(-(dx*dx+dy*dy)/0.02)/(2*pi()*0.01)) AS e FROM pairs GROUP BY 1) SELECT point_id, round(coalesce(e,0)/(coalesce(e,0)+exp(3e0)),5) AS p_triggered FROM eb LEFT JOIN e ON i = point_id"""),
    "smooth_field": _sql("sgrid ncell", f"""WITH g AS (SELECT cell_id AS id, (x_min+x_max)/2 AS x, (y_min+y_max)/2 AS y FROM sgrid), l AS (SELECT a.id AS idx, ln(sum({_KERNEL}*coalesce(n,0))/sum({_KERNEL}) + 1e-9) AS l FROM g a, g b LEFT JOIN ncell ON ncell.cell_id = b.id GROUP BY 1)
      SELECT idx, round(l-(SELECT avg(l) FROM l),5) AS value FROM l"""),
    "kernel_matrix": _sql("eb", """WITH n AS (SELECT time_bin AS i, count(*) AS n FROM eb GROUP BY 1) SELECT j::INT AS j, round(sum((exp(-0.5*(i/50e0-j/50e0)*(i/50e0-j/50e0)/(0.1*0.1)) + CASE WHEN i=j THEN 0.001 ELSE 0 END)*n),4) AS k FROM n, range(50) r(j) GROUP BY 1"""),
    "summarize_draws": _sql("eb draws200", f"WITH {_SCORED(200)} " + _quantiles(_LONG("sc", ["a_0", "alpha", "beta", "w1", "w2", "expected"]), "round(avg(value),6) AS mean, round(stddev_pop(value),6) AS sd, round(avg((value>0)::INT),6) AS p_positive, round(quantile_cont(value,0.025),6) AS q025, round(quantile_cont(value,0.975),6) AS q975")),
    "recovery_table": _sql("eb draws200", f"WITH {_SCORED(200)}, s AS ({_quantiles(_LONG('sc', ['a_0', 'alpha', 'beta', 'expected']), 'avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value,0.05) AS q05, quantile_cont(value,0.95) AS q95')}) SELECT param, round(mean,6) AS mean, round(sd,6) AS sd, round(q05,6) AS q05, round(q95,6) AS q95, truth, truth BETWEEN q05 AND q95 AS covered FROM s JOIN (VALUES ('a_0', 2.5e0), ('alpha', 0.05e0), ('beta', 0.07e0), ('expected', 0.06e0)) t(param, truth) USING (param)"),
    "hpdi": "WITH " + _hpdi("SELECT event_type, value::DOUBLE AS value FROM events", "event_type") + " SELECT event_type, round(s.low,6) AS low, round(s.high,6) AS high FROM h",
    "field_summary": _sql("counts fields20", f"WITH {_hpdi('SELECT * FROM fields20', 'field, idx')}, m AS (SELECT field, idx, avg(value) AS mean FROM fields20 GROUP BY ALL) SELECT field, idx, round(mean,6) AS mean, round(s.low,6) AS low, round(s.high,6) AS high, round(CASE field WHEN 'f_t' THEN idx/50e0*30 WHEN 'f_a' THEN idx/24e0*365 END,6) AS day, coalesce(n,0) AS n FROM m JOIN h USING (field, idx) LEFT JOIN counts USING (field, idx)"),
    "intercept_combination": _sql("fields20 draws20 season_of eb", """SELECT d.draw_id, round(a_0 + (SELECT avg(value) FROM fields20 f WHERE f.draw_id = d.draw_id AND field = 'f_t') + (SELECT avg(value) FROM fields20 f JOIN season_of ON idx = season_bin WHERE f.draw_id = d.draw_id AND field = 'f_a')
      + (SELECT avg(value) FROM fields20 f WHERE f.draw_id = d.draw_id AND field = 'f_xy'),6) AS intercept, round(a_0 + (SELECT avg(value) FROM fields20 f WHERE f.draw_id = d.draw_id AND field = 'f_t') + (SELECT avg(value) FROM fields20 f JOIN season_of ON idx = season_bin WHERE f.draw_id = d.draw_id AND field = 'f_a')
      + (SELECT avg(value) FROM fields20 f WHERE f.draw_id = d.draw_id AND field = 'f_xy') - ln((SELECT count(*) FROM eb)/50e0),6) AS excess FROM draws20 d"""),
    "field_corr": _sql("counts fields20", "SELECT field, draw_id, round(CASE WHEN stddev_pop(value) = 0 OR stddev_pop(ln(0.5e0+coalesce(n,0))) = 0 THEN 'nan'::DOUBLE ELSE corr(value, ln(0.5e0+coalesce(n,0))) END,6) AS corr FROM fields20 LEFT JOIN counts USING (field, idx) GROUP BY ALL"),
    "histogram": _sql("ev", "SELECT least(floor(T/30*50)+1, 50)::INT AS bin, count(*) AS n FROM ev WHERE T BETWEEN 0 AND 30 GROUP BY 1"),
    "histogram_density": _sql("ev", "SELECT least(floor(X*25)+1, 25)::INT AS bin, round(count(*)/(SELECT count(*) FROM ev WHERE X BETWEEN 0 AND 1)::DOUBLE/0.04,6) AS density FROM ev WHERE X BETWEEN 0 AND 1 GROUP BY 1"),
    "trace": _sql("eb draws20", f"WITH {_SCORED(20)} SELECT draw_id, param, round(value,6) AS value FROM ({_LONG('sc', ['a_0', 'alpha', 'expected'])})"),
    "decay_curve": _sql("eb draws20", f"WITH {_CURVE} SELECT draw_id, lag, round(days,8) AS days, round(value,8) AS value FROM cv"),
    "decay_summary": _sql("eb draws20", f"""WITH {_CURVE}, p AS (SELECT *, max(value) OVER (PARTITION BY draw_id) AS peak FROM cv), k AS (SELECT draw_id, max(peak) AS peak, min(days) FILTER (WHERE value <= peak/2) AS half_life, min(days) FILTER (WHERE value <= peak*0.01) AS to1,
      count(*) FILTER (WHERE value > peak*0.01) AS k, min(lag) FILTER (WHERE value > peak*0.01) AS l0, max(lag) FILTER (WHERE value > peak*0.01) AS l1 FROM p GROUP BY 1)
      SELECT k.draw_id, round(peak,6) AS peak, round(half_life,6) AS half_life, round(to1,6) AS to_1_percent, round(CASE WHEN k > 5 AND a.value <> b.value THEN -1/((ln(b.value)-ln(a.value))/(c.days-z.days)) END,6) AS time_constant
      FROM k JOIN cv a ON a.draw_id=k.draw_id AND a.lag=l0 JOIN cv b ON b.draw_id=k.draw_id AND b.lag=l1 JOIN cv c ON c.draw_id=k.draw_id AND c.lag=k-1 JOIN cv z ON z.draw_id=k.draw_id AND z.lag=0"""),
    "grid_post_mean": _sql("fields20 ncell", "SELECT idx::INT AS cell_id, round(avg(value),6) AS post_mean, (25 - idx//25)::INT AS grid_row, (idx%25+1)::INT AS grid_col, coalesce(any_value(n),0) AS n FROM fields20 LEFT JOIN ncell ON idx = cell_id WHERE field = 'f_xy' GROUP BY idx"),
    "piece_post_mean": _sql("fields20 effect20 over ncell", """SELECT cell_id, cov_id, round(f+b,6) AS post_mean, (25 - cell_id//25)::INT AS grid_row, (cell_id%25+1)::INT AS grid_col, coalesce(n,0) AS n FROM over JOIN (SELECT idx AS cell_id, avg(value) AS f FROM fields20 WHERE field='f_xy' GROUP BY 1) USING (cell_id) JOIN (SELECT cov_id, avg(b_0) AS b FROM effect20 GROUP BY 1) USING (cov_id) LEFT JOIN ncell USING (cell_id)"""),
    "cell_covariate": _sql("effect20 over ncell", "SELECT cell_id, round(sum(b*area)/sum(area),6) AS post_mean, coalesce(any_value(n),0) AS n FROM over JOIN (SELECT cov_id, avg(b_0) AS b FROM effect20 GROUP BY 1) USING (cov_id) LEFT JOIN ncell USING (cell_id) GROUP BY 1"),
    "hotspots": _sql("hot", _hotspots(0.98, 0.02) + " SELECT kind, rank, cell_id, round(post_mean,6) AS post_mean FROM ranked"),
    "hotspots_90": _sql("hot", _hotspots(0.9, 0.1) + " SELECT kind, rank, cell_id, round(post_mean,6) AS post_mean FROM ranked"),
    "daily_counts": _sql("hot", _hotspots(0.9, 0.1) + " SELECT kind, ts::DATE AS day, count(*) AS n FROM eb JOIN ranked USING (cell_id) GROUP BY ALL"),
    "daily_counts_top5": _sql("hot", _hotspots(0.9, 0.1) + " SELECT kind, rank, ts::DATE AS day, count(*) AS n FROM eb JOIN ranked USING (cell_id) WHERE rank <= 5 GROUP BY ALL"),
    "check_events": _sql("eb", "SELECT count(*) FILTER (WHERE ts IS NULL) AS null_ts, count(*) FILTER (WHERE cell_id IS NULL) AS null_cell_id, count(*) AS n FROM eb"),
}


def _em_path(steps: int) -> str:
    """Unrolled EM steps on `pairs`; p0 is the start."""
    ctes = ["p0 AS (SELECT 3e0 AS a_0, 0.3e0 AS alpha, 0.05e0 AS beta, 0.01e0 AS sigmax_2)"]
    for k in range(1, steps + 1):
        o = f"p{k - 1}"
        ctes += [
            f"""g{k} AS MATERIALIZED (SELECT i, any_value(a_0) AS a_0, sum(f) AS f, sum(f*dt) AS ft, sum(f*d2) AS fd FROM (
              SELECT i, a_0, dt, dx*dx+dy*dy AS d2, alpha*exp(-dt/beta)/beta*exp(-(dx*dx+dy*dy)/(2*sigmax_2))/(2*pi()*sigmax_2) AS f FROM pairs, {o}) GROUP BY 1)""",
            f"s{k} AS (SELECT sum(f/(f+exp(a_0))) AS p, sum(ft/(f+exp(a_0))) AS pt, sum(fd/(f+exp(a_0))) AS pd FROM g{k})",
            f"m{k} AS (SELECT count(*) AS n, sum((1-exp(-least(50-u, 0.4)/beta)) * {_gauss_mass('sigmax_2')}) AS mass FROM eb, {o})",
            f"p{k} AS MATERIALIZED (SELECT ln((n-p)/50) AS a_0, p/mass AS alpha, pt/p AS beta, pd/(2*p) AS sigmax_2 FROM s{k}, m{k})",
        ]
    rows = " UNION ALL ".join(f"SELECT {k}::INT AS iteration, * FROM p{k}" for k in range(steps + 1))
    return f"WITH {', '.join(ctes)} SELECT iteration, round(a_0,6) AS a_0, round(alpha,6) AS alpha, round(beta,6) AS beta, round(sigmax_2,6) AS sigmax_2 FROM ({rows})"


def _newton(steps: int) -> str:
    """Newton steps of a Poisson regression of n on c1 and c2 with the log of the exposure as offset."""
    ctes = [
        "st AS (SELECT avg(c1) AS m1, stddev_pop(c1) AS s1, avg(c2) AS m2, stddev_pop(c2) AS s2 FROM cov)",
        """d AS MATERIALIZED (SELECT cell_id, sum((c1-m1)/s1*area)/sum(area) AS c1, sum((c2-m2)/s2*area)/sum(area) AS c2, sum(area) AS ex, coalesce(any_value(n),0) AS n
          FROM over JOIN cov USING (cov_id) CROSS JOIN st LEFT JOIN ncell USING (cell_id) GROUP BY 1)""",
        "b0 AS (SELECT ln(sum(n)/sum(ex)) AS a, 0e0 AS b, 0e0 AS c FROM d)",
    ]
    for k in range(1, steps + 1):
        ctes += [
            f"""h{k} AS (SELECT a, b, c, sum(n-u) AS g0, sum(c1*(n-u)) AS g1, sum(c2*(n-u)) AS g2, sum(u) AS h00, sum(u*c1) AS h01, sum(u*c2) AS h02, sum(u*c1*c1) AS h11, sum(u*c1*c2) AS h12, sum(u*c2*c2) AS h22
              FROM (SELECT d.*, q.*, ex*exp(a+b*c1+c*c2) AS u FROM d, b{k - 1} q) GROUP BY a, b, c)""",
            f"""i{k} AS (SELECT *, h11*h22-h12*h12 AS i00, h02*h12-h01*h22 AS i01, h01*h12-h02*h11 AS i02, h00*h22-h02*h02 AS i11, h01*h02-h00*h12 AS i12, h00*h11-h01*h01 AS i22 FROM h{k})""",
            f"""b{k} AS MATERIALIZED (SELECT a+(i00*g0+i01*g1+i02*g2)/t AS a, b+(i01*g0+i11*g1+i12*g2)/t AS b, c+(i02*g0+i12*g1+i22*g2)/t AS c FROM (SELECT *, h00*i00+h01*i01+h02*i02 AS t FROM i{k}))""",
        ]
    one = lambda term, v: f"SELECT '{term}' AS term, round({v},4) AS estimate FROM b{steps}"
    return f"WITH {', '.join(ctes)} {one('intercept', 'a')} UNION ALL {one('c1', 'b')} UNION ALL {one('c2', 'c')}"


_NEAR_STEP = 0.01


def _gem_path(steps: int, t: tuple, s: tuple, start: str, smoothing: float | None = None) -> str:
    """Unrolled steps of generalised EM. A kernel is (parameters, log density, mass) with its parameters in braces."""
    names, shown = ["a_0", "alpha", *t[0], *s[0]], {"lam": '"Lambda"'}  # a key word
    grid = lambda k: [[]] if not k else [o + [x] for o in grid(k - 1) for x in (-1, 0, 1)]
    at = lambda expr, params, move: expr.format(**{n: f"({n}*exp({m * _NEAR_STEP}e0))" for n, m in zip(params, move, strict=True)})
    ts, ss = grid(len(t[0])), grid(len(s[0]))
    zero = lambda k: [0] * len(k[0])

    def step(q: list[str]) -> list[str]:
        h = _NEAR_STEP
        held = lambda x: f"greatest(-0.5, least(0.5, {x}))"
        if len(q) == 3:
            slope, bend = f"(({q[2]}-{q[0]})/{2 * h})", f"(({q[2]}-2*{q[1]}+{q[0]})/{h * h})"
            return [held(f"CASE WHEN {bend} < 0 THEN -{slope}/{bend} ELSE sign({slope})*0.5 END")]
        a, b = f"(({q[7]}-{q[1]})/{2 * h})", f"(({q[5]}-{q[3]})/{2 * h})"
        aa, bb, ab = f"(({q[7]}-2*{q[4]}+{q[1]})/{h * h})", f"(({q[5]}-2*{q[4]}+{q[3]})/{h * h})", f"(({q[8]}-{q[6]}-{q[2]}+{q[0]})/{4 * h * h})"
        det = f"({aa}*{bb}-{ab}*{ab})"
        return [held(f"CASE WHEN {aa} < 0 AND {det} > 0 THEN -({x})/{det} ELSE sign({g})*0.25 END") for x, g in ((f"{bb}*{a}-{ab}*{b}", a), (f"{aa}*{b}-{ab}*{a}", b))]

    back = "exp(a_0)" if smoothing is None else "mu"
    ctes = [f"p0 AS (SELECT {start})", f"b0 AS (SELECT cell_id, exp(a_0) AS mu FROM sgrid, p0)"]
    if smoothing is not None:
        w = f"exp(-0.5*((a.x_min-b.x_min)*(a.x_min-b.x_min)+(a.y_min-b.y_min)*(a.y_min-b.y_min))/{smoothing * smoothing})"
        ctes.append(f"w AS MATERIALIZED (SELECT a.cell_id, b.cell_id AS src, {w} / sum({w}) OVER (PARTITION BY b.cell_id) AS w FROM sgrid a, sgrid b)")
    for k in range(steps + 1):
        logs = [f"sum(f*ln({at(t[1], t[0], m)})) AS t{i}" for i, m in enumerate(ts)] + [f"sum(f*ln({at(s[1], s[0], m)})) AS s{i}" for i, m in enumerate(ss)]
        mass = [f"sum({at(t[2], t[0], m)}*{at(s[2], s[0], zero(s))}) AS mt{i}" for i, m in enumerate(ts)] + [f"sum({at(t[2], t[0], zero(t))}*{at(s[2], s[0], m)}) AS ms{i}" for i, m in enumerate(ss)]
        columns = [f"t{i}" for i in range(len(ts))] + [f"s{i}" for i in range(len(ss))]
        ctes += [
            f"g{k} AS MATERIALIZED (SELECT i, sum(f) AS f, {', '.join(logs)} FROM (SELECT *, alpha*{at(t[1], t[0], zero(t))}*{at(s[1], s[0], zero(s))} AS f FROM pairs, p{k}) GROUP BY 1)",
            f"e{k} AS MATERIALIZED (SELECT eb.cell_id, {back} AS mu, coalesce(f, 0) + {back} AS al, f, {', '.join(columns)} FROM eb JOIN b{k} USING (cell_id) CROSS JOIN p{k} LEFT JOIN g{k} ON i = point_id)",
            f"m{k} AS (SELECT {', '.join(mass)} FROM eb, p{k})",
            f"q{k} AS MATERIALIZED (SELECT (SELECT count(*) FROM eb) AS n, sum(f/al) AS p, sum(ln(al)) AS terms, {', '.join(f'sum({c}/al) AS {c}' for c in columns)} FROM e{k})",
        ]
        tq, sq = [f"(t{i}-p*ln(mt{i}))" for i in range(len(ts))], [f"(s{i}-p*ln(ms{i}))" for i in range(len(ss))]
        values = [f"{n}*exp({x}) AS {n}" for n, x in zip([*t[0], *s[0]], step(tq) + step(sq), strict=True)]
        ctes.append(f"r{k} AS MATERIALIZED (SELECT {', '.join(names)}, terms - exp(a_0)*50 - alpha*mt{len(ts) // 2} AS loglik, ln((n-p)/50) AS na, p/mt{len(ts) // 2} AS nalpha, {', '.join(v.replace(' AS ', ' AS n') for v in values)} FROM q{k}, m{k}, p{k})")
        ctes.append(f"p{k + 1} AS (SELECT na AS a_0, nalpha AS alpha, {', '.join(f'n{n} AS {n}' for n in [*t[0], *s[0]])} FROM r{k})")
        ctes.append(f"b{k + 1} AS (SELECT cell_id, exp(a_0) AS mu FROM sgrid, p{k + 1})" if smoothing is None else f"b{k + 1} AS MATERIALIZED (SELECT w.cell_id, sum(w*m)*625/50 AS mu FROM w JOIN (SELECT cell_id AS src, sum(mu/al) AS m FROM e{k} GROUP BY 1) USING (src) GROUP BY 1)")
    rows = " UNION ALL ".join(f"SELECT {k}::INT AS iteration, {', '.join(f'round({n},4) AS {shown.get(n, n)}' for n in names)}, round(loglik,2) AS loglik FROM r{k}" for k in range(steps + 1))
    return f"WITH {', '.join(ctes)} {rows}"


_EXPONENTIAL = (("beta",), "(exp(-dt/{beta})/{beta})", "(1-exp(-least(50-u, 0.4)/{beta}))")
_POWER_LAW = (("beta", "gamma"), "({beta}/{gamma}*pow(1+dt/{gamma}, -{beta}-1))", "(1-pow(1+least(50-u, 0.4)/{gamma}, -{beta}))")
_GAUSSIAN = (("sigmax_2",), "(exp(-(dx*dx+dy*dy)/(2*{sigmax_2}))/(2*pi()*{sigmax_2}))", _gauss_mass("{sigmax_2}"))
_DOUBLE = (("lam",), "(exp(-(abs(dx)+abs(dy))/{lam})/pow(2*{lam}, 2))", "((1-(exp(-(1-sx)/{lam})+exp(-sx/{lam}))/2)*(1-(exp(-(1-sy)/{lam})+exp(-sy/{lam}))/2))")

_VALUES = "SELECT CASE WHEN event_id % 11 > 0 THEN event_type END AS event_type, pow(value::DOUBLE, 4) AS value FROM events WHERE event_id % 7 > 0"

_BELOW = lambda y: f"(pow(greatest(y_min, least({y}, y_max)) - y_min, 2)/2 + greatest({y} - y_max, 0)*(y_max - y_min))"

_FAR = " AND sqrt((a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy)) <= 0.05"
_EVERY = "(SELECT a.point_id AS i, a.u - b.u AS dt, a.sx - b.sx AS dx, a.sy - b.sy AS dy FROM eb a JOIN eb b ON b.u < a.u) pairs"
_FULL_SCORES = _scores("draws4").replace("FROM pairs", f"FROM {_EVERY}").replace("least(50-u, 0.4)", "(50-u)")

_FACTORS = ("time_bin", "season_bin", "cell_id")


def _factor_cycles(cycles: int, prior: float) -> str:
    """Closed-form updates of the multipliers of three factors, one CTE for each factor of each cycle."""
    ctes = [
        "stime AS (SELECT range::INT AS time_bin, least(floor((range + 0.5)/50*2405e0 % 365e0 / 365e0 * 24), 23)::INT AS season_bin FROM range(50))",
        "cnt AS (SELECT time_bin, cell_id, count(*) AS n FROM ob GROUP BY 1, 2)",
        "base AS MATERIALIZED (SELECT t.time_bin, t.season_bin, x.cell_id, coalesce(n, 0) AS n, 1e0/625 AS exposure FROM stime t CROSS JOIN (SELECT range AS cell_id FROM range(625)) x LEFT JOIN cnt USING (time_bin, cell_id))",
        "rate AS (SELECT sum(n)/sum(exposure) AS r FROM base)",
        *[f"{f}_0 AS (SELECT DISTINCT {f}, 1e0 AS {f}_m FROM base)" for f in _FACTORS],
    ]
    now = dict.fromkeys(_FACTORS, 0)
    for k in range(1, cycles + 1):
        for f in _FACTORS:
            others = [g for g in _FACTORS if g != f]
            joins = " ".join(f"JOIN {g}_{now[g]} USING ({g})" for g in others)
            ctes.append(f"{f}_{k} AS MATERIALIZED (SELECT {f}, (sum(n) + {prior})/(sum(r*exposure*{'*'.join(g + '_m' for g in others)}) + {prior}) AS {f}_m FROM base CROSS JOIN rate {joins} GROUP BY 1)")
            now[f] = k
    out = [f"SELECT '{f}' AS factor, {f}::VARCHAR AS level, round(ln({f}_m), 5) AS effect FROM {f}_{k}" for f, k in now.items()]
    return f"WITH {', '.join(ctes)} SELECT 'rate' AS factor, NULL AS level, round(ln(r), 5) AS effect FROM rate UNION ALL " + " UNION ALL ".join(out)


_NEAR = lambda a, b: f"exp(-0.5e0*pow(({a}-{b})*0.01e0/0.03e0, 2))"

ORACLES |= {
    "fit_factors": _sql("ob", _factor_cycles(4, 5e0)),
    "smooth_grid": _sql("eb", f"""WITH n AS (SELECT least(floor(sx*100), 99)::INT AS ix, least(floor(sy*100), 99)::INT AS iy, count(*) AS n FROM eb GROUP BY 1, 2),
      g AS (SELECT a.range::INT AS i, sum({_NEAR("a.range", "b.range")}) AS m FROM range(100) a, range(100) b GROUP BY 1),
      l AS (SELECT a.i AS ix, b.i AS iy, ln(sum(n.n*{_NEAR("n.ix", "a.i")}*{_NEAR("n.iy", "b.i")})/any_value(a.m*b.m) + 1e-9) AS l FROM g a, g b, n GROUP BY 1, 2)
      SELECT ix, iy, round(l - avg(l) OVER (), 4) AS value FROM l"""),
    "fit_power_law": _sql("pairs sgrid", _gem_path(3, _POWER_LAW, _DOUBLE, "3e0 AS a_0, 0.3e0 AS alpha, 0.8e0 AS beta, 0.1e0 AS gamma, 0.1e0 AS lam")).replace(_FAR, ""),
    "fit_declustered": _sql("pairs sgrid", _gem_path(3, _EXPONENTIAL, _GAUSSIAN, "3e0 AS a_0, 0.3e0 AS alpha, 0.05e0 AS beta, 0.01e0 AS sigmax_2", 0.1)).replace(_FAR, ""),
    "pip_join_stars": _sql("ev", f"""WITH c AS (SELECT id, k, 0.4e0 + 0.2e0*id + r*cos(k*({2 * math.pi!r}e0/2000)) AS x, 0.5e0 + r*sin(k*({2 * math.pi!r}e0/2000)) AS y FROM (SELECT id, k, 0.2e0 + 0.2e0*(((id*31 + k)*7919)%1009)/1009e0 AS r FROM range(2) a(id), range(2000) b(k))),
      e AS MATERIALIZED (SELECT p.id, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM c p JOIN c q ON q.id = p.id AND q.k = (p.k + 1) % 2000)
      SELECT point_id, id::INT AS poly_id FROM (SELECT point_id, id, count(*) FILTER (WHERE X < x1 + (Y - y1)/(y2 - y1)*(x2 - x1)) AS n FROM ev JOIN e ON (y1 > Y) <> (y2 > Y) GROUP BY 1, 2) WHERE n % 2 = 1"""),
    "user_kernel_integral": _sql("eb", "SELECT time_bin, round(sum(1 - exp(-pow(least(50 - u, 3)/0.9e0, 2)/2)),4) AS mass, count(*) AS n FROM eb GROUP BY 1"),
    "nearest_order": _sql("ev ov", "SELECT e.point_id, arg_min(o.point_id, struct_pack(d := (e.X-o.X)*(e.X-o.X)+(e.Y-o.Y)*(e.Y-o.Y), i := o.point_id)) AS idx FROM ev e, ov o GROUP BY 1"),
    "excitation_full_history": _sql("eb", f"""SELECT point_id AS i, round(coalesce(e, 0), 2) AS excitation FROM eb LEFT JOIN (
      SELECT i, sum(0.3 * exp(-dt/0.05)/0.05 * exp(-(dx*dx+dy*dy)/0.02)/(2*pi()*0.01)) AS e FROM {_EVERY} GROUP BY 1) ON i = point_id"""),
    "hawkes_loglik_full": _sql("eb draws4", f"WITH {_FULL_SCORES} SELECT draw_id, round(event_term,3) AS event_term, round(itot_back,3) AS itot_back, round(itot_excite,3) AS itot_excite, round(loglik,3) AS loglik FROM scores"),
    "power_law_full_history": _sql("eb draws4", f"""SELECT draw_id, (SELECT count(*) FROM eb) AS n, round(sum(alpha * beta/gamma*pow(1+dt/gamma, -beta-1) * exp(-(dx*dx+dy*dy)/(2*sigmax_2))/(2*pi()*sigmax_2)),2) AS excitation FROM {_EVERY}, draws4 GROUP BY 1"""),
    "value_quantiles": f"SELECT event_type, round(quantile_cont(value, 0.01), 4) AS q01, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.999), 4) AS q999 FROM ({_VALUES}) GROUP BY 1",
    "value_hpdi": "WITH " + _hpdi(_VALUES, "event_type").replace("a.n*0.9", "a.n*0.5").replace("a.event_type = b.event_type", "a.event_type IS NOT DISTINCT FROM b.event_type") + " SELECT event_type, round(s.low,4) AS low, round(s.high,4) AS high FROM h",
    "fit_hawkes_em": _sql("pairs", _em_path(4)),
    "fit_background": _sql("over ncell", _newton(8)),
    "overlay_polygons": _sql("sgrid ncell ring", f"""WITH e AS (SELECT cell_id, poly_id, y_min, y_max, x1, y1, x2, y2, greatest(x_min, least(x1, x_max)) AS b, greatest(x_min, least(x2, x_max)) AS e FROM sgrid, ring WHERE x1 <> x2),
      h AS (SELECT *, y1 + (b-x1)/(x2-x1)*(y2-y1) AS p, y1 + (e-x1)/(x2-x1)*(y2-y1) AS q FROM e WHERE b <> e),
      o AS (SELECT cell_id, poly_id, abs(sum((e-b) * CASE WHEN abs(q-p) < 1e-9 THEN greatest(y_min, least((p+q)/2, y_max)) - y_min ELSE ({_BELOW("q")} - {_BELOW("p")})/(q-p) END)) AS area FROM h GROUP BY 1, 2)
      SELECT poly_id::INT AS poly_id, round(sum(area),6) AS area, round(sum(area*625*coalesce(n,0)),3) AS expected FROM o LEFT JOIN ncell USING (cell_id) WHERE area >= 1e-10 GROUP BY 1"""),
}


_NEAR = _FAR


def _all(sql: str) -> str:
    """The SQL of a query over four draws and near pairs, over all 200 draws and pairs at any distance."""
    for name in ("draws", "fields", "effect"):
        sql = sql.replace(f"{name}4", f"{name}200")
    return sql.replace("range(4)", "range(200)").replace(_NEAR, "")


#: These take all pairs already, and a few draws: their SQL squares the events.
_WHOLE = ("hawkes_loglik_full", "power_law_full_history")
#: The queries over draws and the likelihoods and fits on pairs, with the same SQL over all of them.
ORACLES |= {f"{k}_all": _all(v) for k, v in ORACLES.items() if ("draws4" in v and k not in _WHOLE) or k in ("excitation", "em_step", "triggered_probability")}
#: This one takes every draw and every pair of the window itself.
ORACLES["cox_hawkes_cov_loglik"] = ORACLES["cox_hawkes_cov_loglik_all"]
#: EM takes every pair of the window.
ORACLES["fit_hawkes_em"] = ORACLES["fit_hawkes_em"].replace(_NEAR, "")
#: The mean and deviation at each event over all draws, beside the rows of background_at_events_all.
ORACLES["background_over_draws"] = _sql("eb fields200 draws200", """SELECT point_id, round(avg(b),5) AS mean, round(stddev_pop(b),5) AS sd, count(*) AS n FROM (SELECT point_id, exp(a_0 + t.value + a.value + x.value) AS b FROM eb CROSS JOIN draws200 d
  JOIN fields200 t ON t.draw_id = d.draw_id AND t.field = 'f_t' AND t.idx = time_bin JOIN fields200 a ON a.draw_id = d.draw_id AND a.field = 'f_a' AND a.idx = season_bin JOIN fields200 x ON x.draw_id = d.draw_id AND x.field = 'f_xy' AND x.idx = cell_id) GROUP BY 1""")


def _uniform(counter: str, name: str, seed: int) -> str:
    return f"((('0x' || substr(md5('{seed}:' || {counter} || ':{name}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496e0)"


def _z(name: str, seed: int) -> str:
    return f"(sqrt(-2*ln({_uniform('i', name + '/1', seed)}))*cos(2*pi()*{_uniform('i', name + '/2', seed)}))"


_ON_SCALE = {"a_0": ("{y}", "a_0", "0"), "alpha": ("1/(1+exp(-({y})))", "ln(alpha/(1-alpha))", "ln(alpha)+ln(1-alpha)"), "beta": ("exp({y})", "ln(beta)", "ln(beta)"), "sigmax_2": ("exp({y})", "ln(sigmax_2)", "ln(sigmax_2)")}
_MEANS = {"a_0": 3.0, "alpha": -0.85, "beta": -3.0, "sigmax_2": -4.6}
_CTE["pd"] = f"""SELECT *, {" + ".join(f"(-(({y})-({_MEANS[n]}))*(({y})-({_MEANS[n]}))/(2*0.05*0.05) - ln(0.05e0) - ln(2*pi())/2 - ({j}))" for n, (_, y, j) in _ON_SCALE.items())} AS log_proposal
  FROM (SELECT i AS draw_id, {", ".join(f"{v.format(y=f'{_MEANS[n]}e0 + 0.05e0*{_z(n, 7)}')} AS {n}" for n, (v, _, _) in _ON_SCALE.items())} FROM range(100) r(i))"""
_SUMMARY = " UNION ALL ".join(f"SELECT '{p}' AS param, sum(weight*{p}) AS mean, sqrt(greatest(sum(weight*{p}*{p}) - sum(weight*{p})*sum(weight*{p}), 0)) AS sd, 1/sum(weight*weight) AS effective_size, max(k) AS pareto_k FROM wt JOIN pd USING (draw_id)" for p in _MEANS)
ORACLES |= {
    "proposal_draws": _sql("pairs pd", f"WITH {_scores('pd')} SELECT draw_id, round(a_0,6) AS a_0, round(alpha,6) AS alpha, round(beta,6) AS beta, round(sigmax_2,6) AS sigmax_2, round(log_proposal,6) AS log_proposal, round(loglik,2) AS loglik FROM pd JOIN scores USING (draw_id)"),
    "importance_summary": _sql("pairs pd", f"""WITH {_scores('pd')}, lw AS MATERIALIZED (SELECT draw_id, loglik*100/(SELECT count(*) FROM eb) + {_PRIOR} - log_proposal AS lw FROM scores JOIN pd USING (draw_id)),
      rk AS MATERIALIZED (SELECT draw_id, exp(lw - max(lw) OVER ()) AS w, row_number() OVER (ORDER BY lw) - 1 AS r, count(*) OVER () AS n FROM lw), ms AS (SELECT any_value(n) AS n, ceil(least(any_value(n)/5, 3*sqrt(any_value(n)))) AS m FROM rk),
      tl AS MATERIALIZED (SELECT draw_id, w - base AS x, base, r - (ms.n - m) AS pos, m FROM rk, ms, (SELECT max(w) AS base FROM rk, ms WHERE r < ms.n - m) WHERE r >= ms.n - m),
      st AS (SELECT max(x) AS most, min(x) FILTER (WHERE pos >= floor(m/4 + 0.5) - 1) AS quarter, any_value(m) AS m, 30 + floor(sqrt(any_value(m))) AS g FROM tl),
      gr AS (SELECT j, m, (1 - sqrt(g/(j-0.5)))/(3*quarter) + 1/most AS theta FROM st, range(1, 60) r(j) WHERE j <= g), pf AS (SELECT j, theta, any_value(gr.m) AS m, avg(ln(1 - theta*x)) AS k FROM gr, tl GROUP BY 1, 2),
      ll AS (SELECT theta, m*(ln(-theta/k) - k - 1) AS l FROM pf), th AS (SELECT sum(theta*exp(l-b))/sum(exp(l-b)) AS theta FROM ll, (SELECT max(l) AS b FROM ll)),
      sh AS (SELECT theta, avg(ln(1 - theta*x)) AS k0, any_value(m) AS m FROM th, tl GROUP BY 1), sp AS (SELECT -k0/theta AS sigma, (m*k0 + 5)/(m + 10) AS k FROM sh),
      raw AS (SELECT draw_id, least(base + sigma/k*(pow(1 - (pos+0.5)/m, -k) - 1), 1) AS w, k FROM tl, sp UNION ALL SELECT draw_id, w, k FROM rk, ms, sp WHERE r < ms.n - ms.m), wt AS MATERIALIZED (SELECT draw_id, w/sum(w) OVER () AS weight, k FROM raw)
      SELECT param, round(mean,5) AS mean, round(sd,5) AS sd, round(effective_size,5) AS effective_size, round(pareto_k,5) AS pareto_k FROM ({_SUMMARY})"""),
}
_DECAY = ORACLES["decay_summary"].replace("round(peak,6) AS peak, round(half_life,6) AS half_life, round(to1,6) AS to_1_percent, round(CASE", "peak, half_life, to1 AS to_1_percent, (CASE").replace("END,6) AS time_constant", "END) AS time_constant")
_BELOW_COPIES = [sum(2.718281828459045**-1 / math.factorial(k) for k in range(n + 1)) for n in range(17)]
_COPIES = " + ".join(f"(u >= {b!r}e0)::INT" for b in _BELOW_COPIES)
ORACLES |= {
    "decay_means": f"SELECT {', '.join(f'round(avg({c}),6) AS {c}_mean, round(stddev_pop({c}),6) AS {c}_sd' for c in ('peak', 'half_life', 'to_1_percent', 'time_constant'))} FROM ({_DECAY})",
    "decay_bootstrap": f"""WITH sm AS MATERIALIZED ({_DECAY}), lg AS ({" UNION ALL ".join(f"SELECT draw_id, '{c}' AS name, {c} AS value FROM sm WHERE {c} IS NOT NULL" for c in ("peak", "half_life", "to_1_percent", "time_constant"))}),
      dl AS (SELECT name, value, b, {_uniform("draw_id || '/' || b", "poisson", 3)} AS u FROM lg, range(100) r(b)), mn AS (SELECT name, b, sum(({_COPIES})*value)/sum({_COPIES}) AS m FROM dl GROUP BY 1, 2)
      SELECT name, round((SELECT avg(value) FROM lg WHERE lg.name = mn.name),6) AS mean, round(stddev_pop(m),6) AS sd, round(quantile_cont(m, 0.05),6) AS low, round(quantile_cont(m, 0.95),6) AS high FROM mn GROUP BY 1""",
}
