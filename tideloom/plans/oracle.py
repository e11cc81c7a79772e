"""SQL that a second engine runs on the same tables to check the catalog queries.

Written from the definition of each operator with joins and spines, not from the array
plans, so that the two sides share no logic.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

# -- panels -----------------------------------------------------------------------------


def _segment(name: str, unit: str) -> str:
    return f"""{name} AS (
  SELECT c_mktsegment AS id, CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS ds,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


Y_M = _segment("ym", "month")
Y_D = _segment("yd", "day")
Y_CUST = """yc AS (
  SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y
  FROM orders GROUP BY 1, 2)"""
X_M = """xm AS (
  SELECT p_brand AS id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS x
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
Y_EVT = """ye AS (
  SELECT event_type AS id, CAST(ts AS DATE) AS ds,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS y
  FROM events GROUP BY 1, 2)"""
LAGS = r"""lags AS (
  SELECT id_y, id_x, CAST(no % 6 + 1 AS INTEGER) AS lag
  FROM (SELECT DISTINCT c_mktsegment AS id_y FROM customer) a,
       (SELECT DISTINCT p_brand AS id_x, CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INTEGER) AS no FROM part) b
  WHERE (length(id_y) + no) % 8 = 0)"""
ORIGINS = """origins AS (
  SELECT CAST(unnest(generate_series(DATE '2000-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS DATE) AS dsr)"""
MID_ORIGINS = """origins AS (
  SELECT unnest([DATE '2000-02-15', DATE '2000-03-15', DATE '2000-04-15']) AS dsr)"""


def _origins(*days: str) -> str:
    return f"origins AS (SELECT unnest([{', '.join(f'DATE {d!r}' for d in days)}]) AS dsr)"


def _filled(name: str, src: str, unit: str, step: str, value: str = "y") -> str:
    """Series summed per bucket over its own range with empty buckets at zero."""
    return f"""{name}_s AS (
  SELECT id, CAST(date_trunc('{unit}', ds) AS DATE) AS ds, sum({value}) AS {value} FROM {src} GROUP BY 1, 2),
{name}_r AS (SELECT id, min(ds) AS lo, max(ds) AS hi FROM {name}_s GROUP BY 1),
{name}_g AS (SELECT id, CAST(unnest(generate_series(lo, hi, INTERVAL {step})) AS DATE) AS ds FROM {name}_r),
{name} AS (SELECT g.id, g.ds, coalesce(s.{value}, 0.0) AS {value}
  FROM {name}_g g LEFT JOIN {name}_s s ON s.id = g.id AND s.ds = g.ds)"""


def _hist(src: str, unit: str = "month", step: str = "1 MONTH") -> str:
    """Zero-filled history per (id, dsr) with positions from both ends."""
    return f"""hist_s AS (
  SELECT s.id, o.dsr, CAST(date_trunc('{unit}', s.ds) AS DATE) AS ds, sum(s.y) AS y
  FROM {src} s JOIN origins o ON s.ds < o.dsr GROUP BY 1, 2, 3),
hist_r AS (SELECT id, dsr, min(ds) AS lo FROM hist_s GROUP BY 1, 2),
hist_g AS (
  SELECT id, dsr, CAST(unnest(generate_series(lo, CAST(date_trunc('{unit}', dsr - INTERVAL 1 DAY) AS DATE), INTERVAL {step})) AS DATE) AS ds
  FROM hist_r),
hist AS (
  SELECT g.id, g.dsr, g.ds, coalesce(s.y, 0.0) AS y,
         row_number() OVER (PARTITION BY g.id, g.dsr ORDER BY g.ds) AS pos,
         row_number() OVER (PARTITION BY g.id, g.dsr ORDER BY g.ds DESC) AS rn
  FROM hist_g g LEFT JOIN hist_s s ON s.id = g.id AND s.dsr = g.dsr AND s.ds = g.ds)"""


WINDOWS = {"m": {"01": 3, "02": 6, "03": 12}, "d": {"01": 7, "02": 30, "03": 90}}


def _log(models: list[str], freq: str = "m", h: int = 4, period_start: int = 0, name: str = "log") -> str:
    """Forecast log of the native models from ``hist``."""
    unit, step, season = {"m": ("month", "MONTH", 12), "d": ("day", "DAY", 365)}[freq]
    cols, rows = [], []
    for m in models:
        kind, size = m[:-2], m[-2:]
        n = WINDOWS[freq][size]
        if kind == "naive":
            cols.append("max(CASE WHEN rn = 1 THEN y END) AS naive01")
        elif kind == "sma":
            cols.append(f"sum(y) FILTER (rn <= {n}) / count(*) FILTER (rn <= {n}) AS {m}")
        elif kind == "wma":
            w = f"({n} - rn + 1)"
            cols.append(f"sum(y * {w}) FILTER (rn <= {n}) / sum({w}) FILTER (rn <= {n}) AS {m}")
        elif kind == "ema":
            w = f"pow(CAST('{1 - 2 / (n + 1)!r}' AS DOUBLE), rn - 1)"
            cols.append(f"sum(y * {w}) / sum({w}) AS {m}")
        if kind != "snaive":
            rows.append(f"SELECT id, dsr, step, '{m}' AS model, {m} AS forecast FROM stats, steps")
        else:
            rows.append(
                f"SELECT h.id, h.dsr, step, 'snaive01' AS model, h.y AS forecast FROM steps, stats t "
                f"JOIN hist h ON h.id = t.id AND h.dsr = t.dsr "
                f"WHERE t.n >= {season} AND h.pos = t.n - {season} + step % {season} + 1"
            )
    first = f"""CASE WHEN date_trunc('{unit}', dsr) = dsr THEN CAST(dsr AS DATE)
      ELSE CAST(date_trunc('{unit}', dsr) + INTERVAL 1 {step} AS DATE) END"""
    stats = ", ".join(["count(*) AS n", *cols])
    return f"""steps AS (SELECT CAST(unnest(range({h})) AS INTEGER) AS step),
stats AS (SELECT id, dsr, {stats} FROM hist GROUP BY id, dsr),
{name}_u AS ({' UNION ALL '.join(rows)}),
{name} AS (
  SELECT id, CAST({first} + to_{unit}s(step) AS DATE) AS ds, dsr,
         CAST(step + {period_start} AS INTEGER) AS period, model, forecast
  FROM {name}_u)"""


NATIVE = ["naive01", "snaive01"] + [f"{k}{s}" for s in ("01", "02", "03") for k in ("sma", "wma", "ema")]
LOG_OUT = "SELECT id, ds, dsr, period, model, round(forecast, 4) AS forecast FROM log"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# -- A ------------------------------------------------------------------------------------

SQL["a1_read_y"] = _with(Y_M) + "SELECT id, ds, round(y, 4) AS y FROM ym"
SQL["a2_read_x"] = _with(X_M) + "SELECT id, ds, round(x, 4) AS x FROM xm"
SQL["a3_read_lag"] = _with(LAGS) + "SELECT id_y, id_x, lag FROM lags"
SQL["a4_read_forecastlog"] = (
    _with(Y_M, ORIGINS, _hist("ym"), _log(["naive01"]))
    + "SELECT id, ds, dsr, period, model, round(forecast, 4) AS forecast, CAST(NULL AS DOUBLE) AS time FROM log"
)
SQL["a5_check_schema"] = """
SELECT 'id' AS "column", 'string' AS type, true AS present, CAST(0 AS BIGINT) AS bad FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'ds', 'date', true, count(*) FILTER (try_cast(o_orderdate AS DATE) IS NULL) FROM orders
UNION ALL SELECT 'y', 'double', true, count(*) FILTER (try_cast(o_orderpriority AS DOUBLE) IS NULL) FROM orders"""
SQL["a9_write_parts"] = (
    _with(Y_M, ORIGINS, _hist("ym"), _log(["naive01", "sma01"]))
    + "SELECT dsr, model, count(*) AS n, round(sum(forecast), 2) AS total FROM log GROUP BY 1, 2"
)
SQL["a11_union_log"] = (
    _with(Y_M, ORIGINS, _hist("ym"), _log(["naive01", "sma01"]))
    + """SELECT id, ds, dsr, period, model, round(forecast, 4) AS forecast FROM log
WHERE (model = 'sma01' AND dsr = DATE '2000-07-01') OR (model = 'naive01' AND dsr < DATE '2000-07-01')"""
)

# -- B ------------------------------------------------------------------------------------

SQL["b1_bucket"] = """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds, CAST(o_orderdate AS DATE) AS b_d,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS b_m,
  CAST(date_trunc('quarter', o_orderdate) AS DATE) AS b_q,
  CAST(date_trunc('year', o_orderdate) AS DATE) AS b_y FROM orders"""
SQL["b2_series_start"] = _with(Y_CUST) + "SELECT id, min(ds) AS act_st FROM yc GROUP BY id"
SQL["b3_clip_history"] = (
    _with(Y_CUST, ORIGINS) + "SELECT id, dsr, ds, round(y, 4) AS y FROM yc, origins WHERE ds < dsr"
)
SQL["b4_fill_gaps"] = (
    _with(Y_D, _filled("f", "yd", "day", "1 DAY")) + "SELECT id, ds, round(y, 4) AS y FROM f"
)
SQL["b5_resample"] = (
    _with(Y_CUST, _filled("f", "yc", "month", "1 MONTH")) + "SELECT id, ds, round(y, 4) AS y FROM f"
)
SQL["b5_resample_quarter"] = (
    _with(Y_D, _filled("f", "yd", "quarter", "3 MONTH")) + "SELECT id, ds, round(y, 4) AS y FROM f"
)
SQL["b5_history"] = (
    _with(Y_CUST, ORIGINS, _hist("yc")) + "SELECT id, dsr, ds, round(y, 4) AS y FROM hist"
)
SQL["b5_history_mid_month"] = (
    _with(Y_D, MID_ORIGINS, _hist("yd")) + "SELECT id, dsr, ds, round(y, 4) AS y FROM hist"
)
SQL["b6_actuals"] = (
    _with(Y_D, _filled("f", "yd", "month", "1 MONTH")) + "SELECT id, ds, round(y, 4) AS y FROM f"
)
SQL["b7_resample_x"] = (
    _with(X_M, "xo AS (SELECT * FROM xm WHERE ds < DATE '2000-01-01')", _filled("f", "xo", "quarter", "3 MONTH", "x"))
    + "SELECT id, ds, round(x, 4) AS x FROM f"
)
SQL["b8_shift_period"] = """
WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds FROM orders)
SELECT ds, CAST(ds + INTERVAL 1 DAY AS DATE) AS p_d, CAST(ds + INTERVAL 1 MONTH AS DATE) AS p_m,
  CAST(ds + INTERVAL 3 MONTH AS DATE) AS p_q, CAST(ds + INTERVAL 12 MONTH AS DATE) AS p_y,
  CAST(ds - INTERVAL 2 DAY AS DATE) AS m_d, CAST(ds - INTERVAL 2 MONTH AS DATE) AS m_m,
  CAST(ds - INTERVAL 6 MONTH AS DATE) AS m_q, CAST(ds - INTERVAL 24 MONTH AS DATE) AS m_y FROM t"""
SQL["b9_horizon"] = (
    _with(Y_M, MID_ORIGINS, "ids AS (SELECT DISTINCT id FROM ym)", "steps AS (SELECT unnest(range(4)) AS s)")
    + """SELECT id, dsr, CAST(date_trunc('month', dsr) + INTERVAL 1 MONTH + to_months(CAST(s AS INTEGER)) AS DATE) AS ds,
  CAST(s + 1 AS INTEGER) AS period FROM ids, origins, steps"""
)
SQL["b10_origins"] = (
    _with(Y_D, MID_ORIGINS, "st AS (SELECT id, min(ds) AS act_st FROM yd GROUP BY id)")
    + "SELECT id, act_st, dsr FROM st, origins WHERE act_st < dsr"
)
SQL["b11_clamp_zero"] = (
    _with(Y_M) + "SELECT id, ds, round(greatest(y - 9000000.0::DOUBLE, 0.0), 4) AS y FROM ym"
)
SQL["b12_work_units"] = (
    _with(Y_M, ORIGINS)
    + "SELECT DISTINCT id, dsr, model FROM ym, origins, (SELECT unnest(['naive01', 'sma01', 'ema03']) AS model)"
)
SQL["b12_errors"] = (
    _with(Y_CUST, _origins("1993-01-01", "2000-01-01"), _hist("yc"))
    + """SELECT id, dsr, 'snaive01' AS model,
  'history of ' || count(*) || ' periods, the model needs 12' AS text
FROM hist GROUP BY id, dsr HAVING count(*) < 12"""
)

# -- C ------------------------------------------------------------------------------------


def _rate(v: str, base: str) -> str:
    return f"""CASE WHEN {v} IS NULL OR {base} IS NULL THEN 1.0 WHEN {base} <> 0 THEN ({v} - {base}) / {base}
      WHEN {v} < 0 THEN -1.0 ELSE 1.0 END"""


def _growth(name: str, src: str, season: int) -> str:
    return f"""{name} AS (
  SELECT a.id, a.ds, a.y, CASE WHEN row_number() OVER (PARTITION BY a.id ORDER BY a.ds) > {season}
    THEN {_rate('a.y', 'b.y')} WHEN b.y <> 0 THEN (a.y - b.y) / b.y END AS gr
  FROM {src} a LEFT JOIN {src} b ON b.id = a.id AND b.ds = CAST(a.ds - INTERVAL 12 MONTH AS DATE))"""


PANEL_M = _filled("pm", "ym", "month", "1 MONTH")

SQL["c1_to_growth"] = (
    _with(Y_CUST, _filled("f", "yc", "month", "1 MONTH"), _growth("g", "f", 12))
    + "SELECT id, ds, round(y, 4) AS y, round(gr, 6) AS gr FROM g"
)
SQL["c1_to_growth_daily"] = (
    _with(Y_D, _filled("f", "yd", "day", "1 DAY"), _growth("g", "f", 365))
    + "SELECT id, ds, round(y, 4) AS y, round(gr, 6) AS gr FROM g"
)
SQL["c2_from_growth"] = (
    _with(
        Y_M, PANEL_M, _growth("g", "pm", 12),
        "fc AS (SELECT id, ds, round(gr, 6) AS g FROM g WHERE ds >= DATE '2000-01-01')",
        """v1 AS (SELECT fc.id, fc.ds, fc.g, (1 + fc.g) * p.y AS y FROM fc
  JOIN pm p ON p.id = fc.id AND fc.ds = CAST(p.ds + INTERVAL 12 MONTH AS DATE) AND p.ds < DATE '2000-01-01')""",
        """v2 AS (SELECT fc.id, fc.ds, fc.g, (1 + fc.g) * v1.y AS y FROM fc
  JOIN v1 ON v1.id = fc.id AND fc.ds = CAST(v1.ds + INTERVAL 12 MONTH AS DATE)
  WHERE NOT EXISTS (SELECT 1 FROM v1 k WHERE k.id = fc.id AND k.ds = fc.ds))""",
    )
    + "SELECT id, ds, g, round(y, 4) AS y FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2)"
)
SQL["c3_pct_change"] = (
    _with(X_M, """w AS (SELECT id, ds, x, lag(x, 12) OVER (PARTITION BY id ORDER BY ds) AS b,
  row_number() OVER (PARTITION BY id ORDER BY ds) AS rn FROM xm)""")
    + f"SELECT id, ds, round({_rate('x', 'b')}, 6) AS x FROM w WHERE rn > 12"
)

# -- D ------------------------------------------------------------------------------------

ACT_CUT = "act AS (SELECT * FROM pm WHERE ds < DATE '2000-01-01')"
SQL["d0_extend"] = (
    _with(
        Y_M, PANEL_M, ACT_CUT, _origins("2000-01-01"), _hist("ym"), _log(["sma01"]),
        "both_s AS (SELECT id, ds, y FROM act UNION ALL SELECT id, ds, forecast FROM log)",
        _filled("f", "both_s", "month", "1 MONTH"),
    )
    + "SELECT id, ds, round(y, 4) AS y FROM f"
)
SQL["d1_date_parts"] = (
    _with(Y_D, _filled("f", "yd", "day", "1 DAY"))
    + """SELECT id, ds, round(y, 4) AS y, CAST(day(ds) AS INTEGER) AS day, CAST(dayofyear(ds) AS INTEGER) AS dayofyear,
  CAST(week(ds) AS INTEGER) AS weekofyear, CAST(isodow(ds) - 1 AS INTEGER) AS weekday,
  CAST(month(ds) AS INTEGER) AS month, CAST(quarter(ds) AS INTEGER) AS quarter, CAST(year(ds) AS INTEGER) AS year FROM f"""
)
SQL["d2_one_hot"] = (
    _with(Y_M, PANEL_M) + "SELECT id, ds, "
    + ", ".join(f"CAST(month(ds) = {k} AS INTEGER) AS month_{k}" for k in range(1, 13)) + ", "
    + ", ".join(f"CAST(quarter(ds) = {k} AS INTEGER) AS quarter_{k}" for k in range(1, 5))
    + " FROM pm"
)


def _lasts(name: str, src: str, p: int) -> str:
    w = "OVER (PARTITION BY id ORDER BY ds)"
    return f"""{name}_w AS (SELECT id, ds, y, lag(y, 1) {w} AS last_period, lag(y, {p}) {w} AS last_year,
  lag(y, {p + 1}) {w} AS b, row_number() {w} AS rn FROM {src}),
{name} AS (SELECT id, ds, y, last_period, last_year,
  CASE WHEN rn > 12 THEN {_rate('last_year', 'b')} WHEN b <> 0 THEN (last_year - b) / b END AS last_momentum FROM {name}_w)"""


SQL["d3_last_values"] = (
    _with(Y_CUST, _filled("f", "yc", "month", "1 MONTH"), _lasts("l", "f", 12))
    + """SELECT id, ds, round(y, 4) AS y, round(last_period, 4) AS last_period, round(last_year, 4) AS last_year FROM l"""
)
SQL["d4_last_momentum"] = (
    _with(Y_M, PANEL_M, _lasts("l", "pm", 12))
    + "SELECT id, ds, round(last_momentum, 6) AS last_momentum FROM l"
)
SQL["d5_last_growth"] = (
    _with(Y_M, PANEL_M, _growth("g", "pm", 12))
    + """SELECT id, ds, round(gr, 6) AS gr, round(lag(gr, 1) OVER w, 6) AS lastgr_period,
  round(lag(gr, 12) OVER w, 6) AS lastgr_year FROM g WINDOW w AS (PARTITION BY id ORDER BY ds)"""
)


def _dec(lag: int) -> str:
    w = "OVER (PARTITION BY id ORDER BY ds)"
    return f"""t AS (SELECT id, ds, y, row_number() {w} AS rn,
  (lag(y, 2) {w} + 2 * lag(y, 1) {w} + 2 * y + 2 * lead(y, 1) {w} + lead(y, 2) {w}) / 8 AS trend FROM pm),
ph AS (SELECT id, (rn - 1) % 4 AS k, avg(y - trend) AS dev FROM t GROUP BY 1, 2),
mn AS (SELECT id, avg(dev) AS m FROM ph GROUP BY 1),
dc AS (SELECT t.id, t.ds, t.y, trend, dev - m AS seasonal, y - trend - (dev - m) AS resid
  FROM t JOIN ph ON ph.id = t.id AND ph.k = (t.rn - 1) % 4 JOIN mn ON mn.id = t.id),
de AS (SELECT id, ds, y, seasonal AS dec_seasonal, lag(trend, {lag}) {w} AS dec_trend,
  lag(resid, {lag}) {w} AS dec_residual FROM dc)"""


for _name, _lag in (("d6_decompose", 3), ("d6_decompose_lag2", 2)):
    SQL[_name] = (
        _with(Y_M, PANEL_M, _dec(_lag))
        + """SELECT id, ds, round(y, 4) AS y, round(dec_seasonal, 5) AS dec_seasonal,
  round(dec_trend, 5) AS dec_trend, round(dec_residual, 5) AS dec_residual FROM de"""
    )
X_CUT = "xo AS (SELECT * FROM xm WHERE ds < DATE '2000-01-01')"
X_FILL = _filled("xf", "xo", "month", "1 MONTH", "x")
SQL["d7_join_x_lagged"] = (
    _with(Y_M, PANEL_M, X_M, X_CUT, X_FILL, LAGS)
    + """SELECT pm.id, pm.ds, l.id_x, round(pm.y, 4) AS y, round(xf.x, 4) AS x
FROM pm JOIN lags l ON l.id_y = pm.id
LEFT JOIN xf ON xf.id = l.id_x AND CAST(xf.ds + to_months(l.lag) AS DATE) = pm.ds"""
)
SQL["d8_join_x_rnn"] = (
    _with(Y_M, PANEL_M, X_M, X_CUT, X_FILL, LAGS,
          """sh AS (SELECT id, greatest(date_diff('month', max(ds), DATE '2000-01-01'), 3) AS n FROM xf GROUP BY id)""")
    + """SELECT pm.id, pm.ds, l.id_x, round(pm.y, 4) AS y, round(xf.x, 4) AS xrnn
FROM pm JOIN lags l ON l.id_y = pm.id JOIN sh ON sh.id = l.id_x
LEFT JOIN xf ON xf.id = l.id_x AND CAST(xf.ds + to_months(CAST(sh.n AS INTEGER)) AS DATE) = pm.ds"""
)
SQL["d9_select_features"] = (
    _with(Y_M, PANEL_M, _lasts("l", "pm", 12), _dec(3))
    + """SELECT l.id, l.ds, round(l.y, 4) AS y, round(last_period, 4) AS last_period,
  round(dec_seasonal, 5) AS dec_seasonal, round(dec_trend, 5) AS dec_trend, round(dec_residual, 5) AS dec_residual
FROM l JOIN de ON de.id = l.id AND de.ds = l.ds WHERE l.ds BETWEEN DATE '1999-01-01' AND DATE '2000-12-01'"""
)
SQL["d10_standardize"] = (
    _with(Y_M, PANEL_M, "s AS (SELECT id, avg(y) AS m, stddev_pop(y) AS sd FROM pm WHERE ds < DATE '2000-01-01' GROUP BY id)")
    + "SELECT pm.id, ds, round((y - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS y FROM pm JOIN s ON s.id = pm.id"
)
SQL["d11_minmax_scale"] = (
    _with(Y_M, PANEL_M, "s AS (SELECT id, min(y) AS lo, max(y) AS hi FROM pm WHERE ds < DATE '2000-01-01' GROUP BY id)")
    + """SELECT pm.id, ds, round((y - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS y,
  round(lo, 4) AS y_min, round(y, 4) AS v FROM pm JOIN s ON s.id = pm.id"""
)
SQL["d12_sequence_windows"] = (
    _with(
        Y_M, PANEL_M, _lasts("l", "pm", 12),
        """f AS (SELECT id, ds, y, last_year, row_number() OVER (PARTITION BY id ORDER BY ds) AS r,
  count(*) OVER (PARTITION BY id) AS n FROM l WHERE last_year IS NOT NULL AND last_momentum IS NOT NULL AND last_period IS NOT NULL)""",
        """w AS (SELECT a.id, a.ds, a.r, a.n, s.last_year AS first_in, a.y AS last_in, o.y AS first_out, e.y AS last_out
  FROM f a JOIN f s ON s.id = a.id AND s.r = a.r - 23 JOIN f o ON o.id = a.id AND o.r = a.r + 1
  JOIN f e ON e.id = a.id AND e.r = a.r + 4 WHERE a.n > 12 + 24 + 4 - 1)""",
        """p AS (SELECT *, 'train' AS part FROM w WHERE r + 4 <= n - 12
  UNION ALL SELECT *, 'val' AS part FROM w WHERE r - 23 > n - (12 + 24 + 4 - 1))""",
    )
    + """SELECT id, ds, part, CAST(24 AS INTEGER) AS n_in, round(first_in, 4) AS first_in, round(last_in, 4) AS last_in,
  round(first_out, 4) AS first_out, round(last_out, 4) AS last_out FROM p"""
)
SQL["d13_feature_sets"] = (
    _with(
        Y_M, PANEL_M, _lasts("l", "pm", 12), _growth("g", "pm", 12), _dec(3),
        """lg AS (SELECT id, ds, lag(gr, 1) OVER w AS gp, lag(gr, 12) OVER w AS gy FROM g WINDOW w AS (PARTITION BY id ORDER BY ds))""",
        """sets(freq, dummies, parts) AS (VALUES ('d', 16, 2), ('m', 16, 2), ('q', 4, 1), ('y', 0, 0))""",
        """f AS (SELECT l.id, l.ds, freq, growth, dummies, parts, CASE WHEN growth THEN gp ELSE last_period END AS a,
  CASE WHEN freq = 'y' THEN NULL WHEN growth THEN gy ELSE last_year END AS b, CASE WHEN freq <> 'y' AND NOT growth THEN last_momentum END AS c,
  dec_trend AS d, dec_seasonal AS e, dec_residual AS r
  FROM l JOIN lg ON lg.id = l.id AND lg.ds = l.ds JOIN de ON de.id = l.id AND de.ds = l.ds, sets, (VALUES (false), (true)) v(growth))""",
    )
    + """SELECT id, ds, freq, growth,
  CAST(dummies + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT + (e IS NOT NULL)::INT + (r IS NOT NULL)::INT AS INTEGER) AS n_values,
  round(parts + coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0) + coalesce(e, 0) + coalesce(r, 0), 4) AS v FROM f"""
)

# -- E ------------------------------------------------------------------------------------

for _name, _models in {
    "e1_naive01": ["naive01"],
    "e2_snaive01": ["snaive01"],
    "e3_sma": ["sma01", "sma02", "sma03"],
    "e4_wma": ["wma01", "wma02", "wma03"],
    "e5_ema": ["ema01", "ema02", "ema03"],
}.items():
    SQL[_name] = _with(Y_M, ORIGINS, _hist("ym"), _log(_models)) + LOG_OUT
SQL["e1_e5_customers"] = (
    _with(Y_CUST, _origins("2000-01-01", "2001-01-01"), _hist("yc"), _log(NATIVE)) + LOG_OUT
)
SQL["e1_e5_daily_short"] = (
    _with(Y_EVT, _origins("2024-01-20", "2024-01-31"), _hist("ye", "day", "1 DAY"), _log(NATIVE, "d", 7)) + LOG_OUT
)
SQL["e1_e5_mid_month"] = (
    _with(Y_D, MID_ORIGINS, _hist("yd"), _log(NATIVE, period_start=1)) + LOG_OUT
)

HIST_LIST = "hl AS (SELECT id, dsr, list(y ORDER BY ds) AS ys FROM hist GROUP BY id, dsr)"
# level, then trend, then squared error, folded over the series; one list entry per state value
_SES = """list_reduce(list_prepend([ys[1], 0.0], list_transform(ys[2:], lambda v: [v])),
  lambda s, v: [s[1] + a * (v[1] - s[1]), s[2] + (v[1] - s[1]) * (v[1] - s[1])])"""
_HOLT = """list_reduce(list_prepend([ys[1], ys[2] - ys[1], 0.0], list_transform(ys[2:], lambda v: [v])),
  lambda s, v: [s[1] + s[2] + a * (v[1] - s[1] - s[2]),
             s[2] + b * ((s[1] + s[2] + a * (v[1] - s[1] - s[2])) - s[1] - s[2]),
             s[3] + (v[1] - s[1] - s[2]) * (v[1] - s[1] - s[2])])"""


def _smooth(fold: str, two: bool, ahead: str) -> str:
    grid = "SELECT round(i * 0.1, 2)::DOUBLE AS v, i AS k FROM range(1, 10) t(i)"
    near = "SELECT unnest([-0.1, -0.05, 0.0, 0.05, 0.1])::DOUBLE AS m, unnest(range(5)) AS k"
    b, bk = ("g2.v", "g2.k") if two else ("0.0::DOUBLE", "0")
    clip = "least(greatest(round({0}, 2), 0.01), 0.99)::DOUBLE"
    nb, nk = (clip.format("w.b + m2.m"), "m2.k") if two else ("0.0::DOUBLE", "0")
    sse = 3 if two else 2
    return f"""c AS (SELECT id, dsr, g1.v AS a, {b} AS b, g1.k AS k1, {bk} AS k2, ys
  FROM hl, ({grid}) g1{f', ({grid}) g2' if two else ''} WHERE len(ys) >= 2),
cs AS (SELECT id, dsr, ys, a, b, k1, k2, {fold} AS s FROM c),
w AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY id, dsr ORDER BY s[{sse}], k1, k2) = 1),
n AS (SELECT id, dsr, ys, {clip.format('w.a + m1.m')} AS a, {nb} AS b, m1.k AS k1, {nk} AS k2
  FROM w, ({near}) m1{f', ({near}) m2' if two else ''}),
ns AS (SELECT id, dsr, k1, k2, {fold} AS s FROM n),
best AS (SELECT * FROM ns QUALIFY row_number() OVER (PARTITION BY id, dsr ORDER BY s[{sse}], k1, k2) = 1)
SELECT id, CAST(dsr + to_months(step) AS DATE) AS ds, dsr, step AS period, '{'expo02' if two else 'expo01'}' AS model,
  round({ahead}, 4) AS forecast FROM best, (SELECT CAST(unnest(range(4)) AS INTEGER) AS step)"""


SQL["e6_expo01"] = _with(Y_M, ORIGINS, _hist("ym"), HIST_LIST, _smooth(_SES, False, "s[1]"))
SQL["e7_expo02"] = _with(
    Y_M, ORIGINS, _hist("ym"), HIST_LIST, _smooth(_HOLT, True, "s[1] + (step + 1) * s[2]")
)

# state: level, trend, squared error, then the season as a queue, oldest first
_HW = """list_reduce(list_prepend(
    list_concat([list_avg(ys[1:12]), (list_avg(ys[13:24]) - list_avg(ys[1:12])) / 12, 0.0],
                list_transform(ys[1:12], lambda u: u - list_avg(ys[1:12]))),
    list_transform(ys[13:], lambda v: [v])),
  lambda s, v: list_concat(
    [s[1] + s[2] + a * (v[1] - s[1] - s[2] - s[4]),
     s[2] + b * ((s[1] + s[2] + a * (v[1] - s[1] - s[2] - s[4])) - s[1] - s[2]),
     s[3] + (v[1] - s[1] - s[2] - s[4]) * (v[1] - s[1] - s[2] - s[4])],
    list_concat(s[5:15], [s[4] + g * (v[1] - s[1] - s[2] - s[4])])))"""
_CLIP = "least(greatest(round({0}, 2), 0.01), 0.99)::DOUBLE"
_COARSE = "SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS v, unnest(range(5)) AS k"
_NEAR = "SELECT unnest([-0.1, 0.0, 0.1])::DOUBLE AS m, unnest(range(3)) AS k"
SQL["e8_expo03"] = _with(
    Y_M, ORIGINS, _hist("ym"), HIST_LIST,
    f"""c AS (SELECT id, dsr, ys, g1.v AS a, g2.v AS b, g3.v AS g, g1.k AS k1, g2.k AS k2, g3.k AS k3
  FROM hl, ({_COARSE}) g1, ({_COARSE}) g2, ({_COARSE}) g3 WHERE len(ys) >= 24)""",
    f"cs AS (SELECT *, {_HW} AS s FROM c)",
    "w AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY id, dsr ORDER BY s[3], k1, k2, k3) = 1)",
    f"""n AS (SELECT id, dsr, ys, {_CLIP.format('w.a + m1.m')} AS a, {_CLIP.format('w.b + m2.m')} AS b,
    {_CLIP.format('w.g + m3.m')} AS g, m1.k AS k1, m2.k AS k2, m3.k AS k3
  FROM w, ({_NEAR}) m1, ({_NEAR}) m2, ({_NEAR}) m3)""",
    f"ns AS (SELECT id, dsr, k1, k2, k3, {_HW} AS s FROM n)",
    "best AS (SELECT * FROM ns QUALIFY row_number() OVER (PARTITION BY id, dsr ORDER BY s[3], k1, k2, k3) = 1)",
) + """SELECT id, CAST(dsr + to_months(step) AS DATE) AS ds, dsr, step AS period, 'expo03' AS model,
  round(s[1] + (step + 1) * s[2] + s[4 + step % 12], 4) AS forecast
FROM best, (SELECT CAST(unnest(range(4)) AS INTEGER) AS step)"""

# -- F ------------------------------------------------------------------------------------

APE = """CASE WHEN actual IS NULL OR forecast IS NULL THEN NULL WHEN actual = 0 AND forecast = 0 THEN 0.0
  WHEN actual = 0 THEN 1.0 ELSE abs((actual - forecast) / actual) END"""
SQL["f1_f2_errors"] = (
    _with(Y_CUST, ORIGINS, _hist("yc"), _log(["naive01", "sma01"]), _filled("act", "yc", "month", "1 MONTH"),
          "j AS (SELECT log.*, act.y AS actual FROM log LEFT JOIN act ON act.id = log.id AND act.ds = log.ds)")
    + f"""SELECT id, ds, dsr, period, model, round(forecast, 4) AS forecast, round(actual, 4) AS actual,
  round(abs(actual - forecast), 4) AS mae, round({APE}, 6) AS mape FROM j"""
)


def _rank(agg: str = "avg", shown: str = "mape", log: str = "log") -> str:
    return f"""ro AS (SELECT DISTINCT CAST(dsr + INTERVAL 1 MONTH AS DATE) AS i FROM {log}),
rj AS (SELECT l.id, l.ds, l.period, l.model, l.forecast, ro.i, CASE WHEN l.ds < ro.i THEN act.y END AS actual
  FROM {log} l JOIN ro ON l.dsr < ro.i AND l.ds >= ro.i - INTERVAL 6 MONTH
  LEFT JOIN act ON act.id = l.id AND act.ds = l.ds),
re AS (SELECT id, period, model, i, actual, abs(actual - forecast) AS mae, {APE} AS mape FROM rj),
rm AS (SELECT id, i, period, model, {agg}(mae) AS mae, {agg}(mape) AS mape, nullif(count(actual), 0) AS test_back
  FROM re GROUP BY 1, 2, 3, 4),
rv AS (SELECT i, period, max(test_back) AS tb FROM rm GROUP BY 1, 2),
ranking AS (SELECT rm.id, rm.i AS dsr, rm.period, CAST(CASE WHEN rv.tb IS NULL THEN 1 WHEN mae IS NOT NULL
    THEN dense_rank() OVER (PARTITION BY rm.id, rm.i, rm.period ORDER BY mae ASC NULLS LAST) END AS INTEGER) AS rank,
  rm.model, {shown} AS error, rm.test_back FROM rm JOIN rv ON rv.i = rm.i AND rv.period = rm.period)"""


def _ens(fc: str, agg: str = "avg") -> str:
    return f"""ej AS (SELECT f.id, f.ds, f.dsr, f.period, f.model, f.forecast, r.rank, r.error, r.test_back,
  count(r.rank) OVER (PARTITION BY f.id, f.dsr) AS ranked FROM {fc} f
  LEFT JOIN ranking r ON r.id = f.id AND r.dsr = f.dsr AND r.period = f.period AND r.model = f.model),
ep AS (SELECT *, CASE WHEN ranked = 0 THEN 1 WHEN rank IS NOT NULL
    THEN dense_rank() OVER (PARTITION BY id, dsr, period ORDER BY rank ASC NULLS LAST) END AS place FROM ej),
ens AS (SELECT id, ds, dsr, period, {agg}(forecast) AS forecast, {agg}(error) AS error,
  string_agg(model, ',' ORDER BY place, model) AS top_model, avg(test_back) AS test_back
  FROM ep WHERE place <= 3 GROUP BY 1, 2, 3, 4)"""


ACT = _filled("act", "ym", "month", "1 MONTH")
BACKTEST = (Y_M, ORIGINS, _hist("ym"), _log(NATIVE), ACT)
RANK_OUT = "SELECT id, dsr, period, rank, model, round(error, {}) AS error, test_back FROM ranking"
ENS_OUT = """SELECT id, ds, dsr, period, round(forecast, 4) AS forecast, round(error, {}) AS error, top_model,
  round(test_back, 6) AS test_back FROM ens"""

SQL["f3_rank_models"] = _with(*BACKTEST, _rank()) + RANK_OUT.format(6)
SQL["f3_rank_models_median"] = _with(*BACKTEST, _rank("median")) + RANK_OUT.format(6)
SQL["f5_ensemble_log"] = _with(*BACKTEST, _rank(), _ens("log")) + ENS_OUT.format(6)
SQL["f7_median_ensemble"] = (
    _with(*BACKTEST, _rank("median", "mae"), _ens("log", "median")) + ENS_OUT.format(5)
)
SQL["a10_write_output"] = (
    _with(*BACKTEST, _rank(), _ens("log"))
    + """SELECT id, dsr, ds, '["' || replace(top_model, ',', '","') || '"]' AS top_model FROM ens"""
)


def _with_start(start: str) -> tuple[str, ...]:
    """Back-test origins plus one production origin; ranks use the back-test rows only."""
    days = [f"2000-{m:02d}-01" for m in range(1, 13)] + [start]
    return (
        Y_M, _origins(*days), _hist("ym"), _log(NATIVE, name="every"), ACT,
        f"log AS (SELECT * FROM every WHERE dsr < DATE '{start}')",
        f"fresh AS (SELECT * FROM every WHERE dsr = DATE '{start}')",
        _rank(), _ens("fresh"),
    )


SQL["f4_ensemble"] = _with(*_with_start("2001-01-01")) + ENS_OUT.format(6)
SQL["f4_ensemble_no_rank"] = _with(*_with_start("2001-03-01")) + ENS_OUT.format(6)
SQL["h2_forecast_prod"] = SQL["f4_ensemble"]
SQL["h2_forecast_prod_log"] = _with(*_with_start("2001-01-01")[:4]) + LOG_OUT.replace("FROM log", "FROM every")
SQL["f6_evaluate"] = (
    _with(
        *BACKTEST, _rank(), _ens("log"),
        """u AS (SELECT id, ds, dsr, period, model, forecast, CAST(NULL AS VARCHAR) AS top_model,
    CAST(NULL AS DOUBLE) AS test_back FROM log
  UNION ALL SELECT id, ds, dsr, period, 'top3', forecast, top_model, test_back FROM ens)""",
        "j AS (SELECT u.*, act.y AS actual FROM u LEFT JOIN act ON act.id = u.id AND act.ds = u.ds)",
    )
    + f"""SELECT id, ds, dsr, period, model, round(forecast, 4) AS forecast, round(actual, 4) AS actual,
  round(abs(actual - forecast), 4) AS mae, round({APE}, 6) AS mape, top_model, round(test_back, 6) AS test_back,
  round(forecast, 4) AS y, 'forecast' AS y_type FROM j
UNION ALL SELECT id, ds, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(y, 4), 'actual' FROM act"""
)
SQL["h1_forecast_init"] = SQL["f6_evaluate"]

# -- G ------------------------------------------------------------------------------------


def _clean(name: str, src: str, value: str) -> str:
    return f"""{name}_s AS (SELECT id, ds, sum({value}) AS {value} FROM {src} GROUP BY 1, 2),
{name}_r AS (SELECT id, min(ds) AS lo, max(ds) AS hi FROM {name}_s GROUP BY 1),
{name}_g AS (SELECT id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS ds FROM {name}_r),
{name}_m AS (SELECT g.id, max(g.ds) AS gap FROM {name}_g g
  WHERE NOT EXISTS (SELECT 1 FROM {name}_s s WHERE s.id = g.id AND s.ds = g.ds) GROUP BY 1),
{name} AS (SELECT s.id, s.ds, s.{value} FROM {name}_s s LEFT JOIN {name}_m m ON m.id = s.id
  WHERE m.gap IS NULL OR s.ds > m.gap)"""


def _pct(name: str, src: str, value: str) -> str:
    return f"""{name}_w AS (SELECT id, ds, {value}, lag({value}, 12) OVER (PARTITION BY id ORDER BY ds) AS b,
  row_number() OVER (PARTITION BY id ORDER BY ds) AS rn FROM {src}),
{name} AS (SELECT id, ds, {_rate(value, 'b')} AS {value} FROM {name}_w WHERE rn > 12)"""


PREP_Y = (Y_M, _clean("cy", "ym", "y"), _pct("py", "cy", "y"))
PREP_X = (
    X_M, _clean("cx", "xm", "x"), _pct("gx", "cx", "x"),
    "px AS (SELECT id, ds, x FROM gx QUALIFY count(*) OVER (PARTITION BY id) >= 48)",
)
SQL["g1_clean_after_gap"] = _with(Y_CUST, _clean("c", "yc", "y")) + "SELECT id, ds, round(y, 4) AS y FROM c"
SQL["g2_prepare_x"] = _with(*PREP_X) + "SELECT id, ds, round(x, 6) AS x FROM px"
SQL["g2_x_report"] = (
    _with(*PREP_X)
    + "SELECT (SELECT count(DISTINCT id) FROM xm) AS total_x, (SELECT count(DISTINCT id) FROM px) AS total_test_x"
)
SQL["g3_prepare_y"] = _with(*PREP_Y) + "SELECT id, ds, round(y, 6) AS y FROM py"
CORR = """xr AS (SELECT id, ds, x, row_number() OVER (PARTITION BY id ORDER BY ds) AS r FROM px),
xl AS (SELECT a.id, a.ds, l.lag, b.x FROM xr a CROSS JOIN (SELECT CAST(unnest(range(2, 24)) AS INTEGER) AS lag) l
  LEFT JOIN xr b ON b.id = a.id AND b.r = a.r - l.lag),
co AS (SELECT py.id AS id_y, xl.id AS id_x, xl.lag, count(*) AS n,
    CASE WHEN count(*) > 1 AND min(py.y) <> max(py.y) AND min(xl.x) <> max(xl.x) THEN abs(corr(py.y, xl.x)) END AS c
  FROM xl JOIN py ON py.ds = xl.ds WHERE xl.x IS NOT NULL GROUP BY 1, 2, 3)"""
SQL["g4_lag_corr"] = (
    _with(*PREP_Y, *PREP_X, CORR) + "SELECT id_y, id_x, lag, n, round(c, 6) AS corr FROM co"
)
BEST = """bl AS (SELECT id_y, id_x, lag, c FROM co WHERE c IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id_y, id_x ORDER BY c DESC, lag) = 1)"""
SQL["g5_best_lag"] = (
    _with(*PREP_Y, *PREP_X, CORR, BEST) + "SELECT id_y, id_x, lag, round(c, 6) AS corr FROM bl"
)


def _aligned(lags: str) -> str:
    return f"""xr2 AS (SELECT id, ds, x, row_number() OVER (PARTITION BY id ORDER BY ds) AS r FROM px),
al AS (SELECT l.id_y, l.id_x, l.lag, a.ds, py.y, b.x FROM {lags} l JOIN xr2 a ON a.id = l.id_x
  JOIN xr2 b ON b.id = a.id AND b.r = a.r - l.lag JOIN py ON py.id = l.id_y AND py.ds = a.ds),
sc AS (SELECT id_y, id_x, lag, count(*) AS n, regr_syy(y, x) * (1 - regr_r2(y, x)) AS rss, regr_r2(y, x) AS r2
  FROM al GROUP BY 1, 2, 3)"""


# n ln(1/sqrt(2 pi v)) - rss/(2 v) with v = rss/n, doubled, less 2p and the small-sample term, p = 1
AICC = "n * -ln(2 * pi() * (rss / n)) - n - 2 - CASE WHEN n = 2 THEN 99999 ELSE 4.0 / (n - 2) END"
SQL["g6_align_lagged"] = (
    _with(*PREP_Y, *PREP_X, LAGS, _aligned("lags"))
    + "SELECT id_y, id_x, lag, ds, round(y, 6) AS y, round(x, 6) AS x FROM al"
)
SQL["g7_score_ols"] = (
    _with(*PREP_Y, *PREP_X, LAGS, _aligned("lags"))
    + f"SELECT id_y, id_x, lag, round({AICC}, 5) AS score FROM sc"
)
SQL["g8_score_r2adj"] = (
    _with(*PREP_Y, *PREP_X, LAGS, _aligned("lags"))
    + "SELECT id_y, id_x, lag, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS score FROM sc"
)
SQL["g9_forward_round1"] = (
    _with(*PREP_Y, *PREP_X, CORR, BEST, _aligned("bl"),
          f"sr AS (SELECT id_y, id_x, lag, {AICC} AS score FROM sc)")
    + """SELECT id_y, id_x, lag, CAST(1 AS INTEGER) AS step, round(score, 5) AS score FROM sr
QUALIFY row_number() OVER (PARTITION BY id_y ORDER BY score DESC, id_x) = 1"""
)


# two rounds of the selection: one regressor by its moments, two by the pairwise correlations
def _two_rounds(p1: str, p2: str) -> str:
    return f"""s1 AS (SELECT id_y, id_x, lag, {p1} AS score FROM sc),
c1 AS (SELECT * FROM s1 WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id_y ORDER BY score DESC, id_x) = 1),
a1 AS (SELECT al.* FROM al JOIN c1 ON c1.id_y = al.id_y AND c1.id_x = al.id_x),
m2 AS (SELECT b.id_y, b.id_x, b.lag, count(*) AS n, regr_syy(a1.y, a1.x) AS syy,
    corr(a1.y, a1.x) AS r1, corr(b.y, b.x) AS r2, corr(a1.x, b.x) AS r12
  FROM al b JOIN a1 ON a1.id_y = b.id_y AND a1.ds = b.ds AND a1.id_x <> b.id_x GROUP BY 1, 2, 3),
f2 AS (SELECT id_y, id_x, lag, n, syy, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) AS fit FROM m2),
s2 AS (SELECT id_y, id_x, lag, {p2} AS score FROM f2),
c2 AS (SELECT s2.* FROM s2 JOIN c1 ON c1.id_y = s2.id_y WHERE s2.score > c1.score
  QUALIFY row_number() OVER (PARTITION BY s2.id_y ORDER BY s2.score DESC, s2.id_x) = 1),
chosen AS (SELECT id_y, id_x, lag, CAST(1 AS INTEGER) AS step, score FROM c1
  UNION ALL SELECT id_y, id_x, lag, CAST(2 AS INTEGER), score FROM c2)"""


_LOG1 = "n * -ln(2 * pi() * (rss / n)) - n"
_LOG2 = "n * -ln(2 * pi() * (syy * (1 - fit) / n)) - n"
_SELECT = (*PREP_Y, *PREP_X, CORR, BEST, _aligned("bl"))
_CHOSEN = "SELECT id_y, id_x, lag, step, round(score, {}) AS score FROM chosen"
SQL["g10_aic01"] = _with(*_SELECT, _two_rounds(f"{_LOG1} - 2", f"{_LOG2} - 4")) + _CHOSEN.format(5)
SQL["g10_r2adj01"] = (
    _with(*_SELECT, _two_rounds("1 - (1 - r2) * (n - 1) / (n - 2)", "1 - (1 - fit) * (n - 2) / (n - 3)"))
    + _CHOSEN.format(6)
)
SQL["g9_forward_round2"] = (
    _with(*_SELECT, _two_rounds(f"{_LOG1} - 2 - 4.0 / (n - 2)", f"{_LOG2} - 4 - 12.0 / (n - 3)")) + _CHOSEN.format(5)
)
SQL["h3_feat_selection"] = SQL["g9_forward_round2"].replace(_CHOSEN.format(5), "SELECT id_y, id_x, lag FROM chosen")

# -- E: reduced cases and guards of the fitted models ---------------------------------------------

SQL["e15_arima_110"] = (
    _with(Y_M, ORIGINS, _hist("ym"))
    + """, steps AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS step),
changes AS (SELECT id, dsr, pos, y, y - lag(y) OVER (PARTITION BY id, dsr ORDER BY pos) AS w FROM hist),
pairs AS (SELECT id, dsr, pos, y, w, lag(w) OVER (PARTITION BY id, dsr ORDER BY pos) AS v FROM changes),
fits AS (SELECT id, dsr, sum(w * v) / sum(v * v) AS a, max_by(y, pos) AS last, max_by(w, pos) AS turn FROM pairs GROUP BY id, dsr),
inside AS (SELECT id, dsr, last, turn, CASE WHEN abs(a) > 1 THEN 1 / a ELSE a END AS a FROM fits)
SELECT id, CAST(dsr + to_months(step) AS DATE) AS ds, dsr, step AS period, 'arima01' AS model,
  round(last + turn * a * (1 - pow(a, step + 1)) / (1 - a), 4) AS forecast
FROM inside, steps"""
)


def _guards(models: dict[str, int], h: int = 4) -> str:
    rows = " UNION ALL ".join(f"SELECT '{m}' AS model, {n} AS need" for m, n in models.items())
    return f""", steps AS (SELECT CAST(unnest(range({h})) AS INTEGER) AS step), models AS ({rows}),
lengths AS (SELECT id, dsr, count(*) AS n FROM hist GROUP BY id, dsr)
SELECT id, CAST(date_trunc('month', dsr) + to_months(step) AS DATE) AS ds, dsr, step AS period, model, true AS finite
FROM lengths, models, steps WHERE n >= need"""


SQL["e15_e17_guards"] = _with(Y_CUST, _origins("1995-07-01", "2000-01-01"), _hist("yc")) + _guards({"arima01": 3, "arima02": 15, "autoarima01": 5})
SQL["e16_e18_guards"] = _with(Y_M, ORIGINS, _hist("ym")) + _guards({"arimax01": 3, "arimax02": 15, "autoarimax01": 3, "autoarimax02": 15})
SQL["e19_guards"] = (
    _with(Y_EVT, _origins("2024-01-03", "2024-02-01"), _hist("ye", "day", "1 DAY"))
    + """, steps AS (SELECT CAST(unnest(range(2)) AS INTEGER) AS step), lengths AS (SELECT id, dsr, count(*) AS n FROM hist GROUP BY id, dsr)
SELECT id, CAST(CASE WHEN date_trunc('month', dsr) = dsr THEN dsr ELSE date_trunc('month', dsr) + INTERVAL 1 MONTH END + to_months(step) AS DATE) AS ds, dsr, step AS period, 'prophet01' AS model, true AS finite
FROM lengths, steps WHERE n >= 2"""
)
