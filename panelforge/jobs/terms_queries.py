"""Costs, risks and compliance checks of the five portfolios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import checks as k, forecasts as f, terms as c
from . import testbeds as tb
from .cleaning_queries import r
from .market_job import stored
from .panel_queries import D
from .registry import query, shown, view
from .trading_queries import P, weights

BD = f"SELECT portfolio_id, {D}, "
SHIFT = 0.0000123457  # keeps exact halves, which libraries round differently, from the last digit


def value(df, digits=4, shift=SHIFT):
    return shown(df.withColumn("value", F.col("value") + shift), P, "ts", "value", digits=digits)


def v(x: str, digits: int = 4, shift: float = SHIFT) -> str:
    return r(f"{x} + {shift}", "value", digits)


view("tb_var", "SELECT symbol, ts, w2 / nullif(w0, 0) AS value FROM m_all", "m_all")
view("tb_mkt", "SELECT p.ts, p.symbol, sqrt(value) AS sigma, valuevolume, price FROM tb_panel p JOIN tb_var USING (symbol, ts)", "tb_panel", "tb_var")
view("tb_asset", "SELECT * FROM tb_trade WHERE NOT is_cash", "tb_trade")
view("tb_bm", "SELECT ts, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY ts) AS w FROM tb_w WHERE portfolio_id = 'MACHINERY' AND NOT is_cash AND month(ts) <> 11", "tb_w")
view("tb_bw", """
    SELECT portfolio_id, ts, symbol, CASE WHEN ts IN (SELECT ts FROM tb_bm) AND count(*) = count(w) THEN sum(w) END AS w FROM (SELECT portfolio_id, ts, symbol, w FROM tb_w WHERE NOT is_cash UNION ALL
      SELECT b.portfolio_id, b.ts, m.symbol, -m.w FROM (SELECT DISTINCT portfolio_id, ts FROM tb_w) b JOIN tb_bm m ON m.ts = b.ts) GROUP BY 1, 2, 3""", "tb_w", "tb_bm")
view("tb_cov", "SELECT a.symbol AS sym_i, b.symbol AS sym_j, avg(a.ret * b.ret) AS value FROM tb_panel a JOIN tb_panel b ON a.ts = b.ts AND a.symbol <= b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL AND a.ts < TIMESTAMP '1999-01-01' GROUP BY 1, 2", "tb_panel")


def kept(spark, sf):
    """The panel, few rows whatever the number of line items, written once for queries that read it many times."""
    return stored(spark, tb.panel(spark, sf), "panel")


def variances(spark, sf, panel=None):
    return f.variance(tb.panel(spark, sf) if panel is None else panel, name="value").select("symbol", "ts", "value")


def market(spark, sf):
    own = variances(spark, sf).select("symbol", "ts", F.sqrt("value").alias("sigma"))
    return tb.panel(spark, sf).join(own, ["symbol", "ts"]).select("ts", "symbol", "sigma", "valuevolume", "price")


def benchmark(spark, sf, own=None):
    """Equal weights over what one portfolio holds; there is none in November."""
    own = (weights(spark, sf) if own is None else own).where(f"{P} = 'MACHINERY' and not is_cash and month(ts) <> 11")
    return own.select("ts", "symbol", (1.0 / F.count("*").over(Window.partitionBy("ts"))).alias("w"))


def cov(spark, sf, panel=None):
    return f.covariance(kept(spark, sf) if panel is None else panel, at="1999-01-01").select("sym_i", "sym_j", "value")


def strict(x: str) -> str:
    """The sum, or null where a summand is."""
    return f"CASE WHEN count(*) = count({x}) THEN sum({x}) END"


def of(size: str, x: str) -> str:
    """What a position counts; one of zero is 0 whatever is unknown."""
    return f"CASE WHEN {size} = 0 THEN 0.0 ELSE {x} END"


# a bed with holes: one brand has no row in May, another no value in September
NO_ROW, NO_VALUE = "symbol = 'Brand#7' AND month(ts) = 5", "symbol = 'Brand#9' AND month(ts) = 9"


def holes(df, column):
    return df.where(f"NOT ({NO_ROW})").withColumn(column, F.when(~F.expr(NO_VALUE), F.col(column)))


for _view, _column in (("tb_mkt", "sigma"), ("tb_var", "value"), ("tb_expo", "f"), ("m_vol", "w1"), ("m_all", "w1")):
    view(f"{_view}_gaps", f"SELECT * REPLACE (CASE WHEN NOT ({NO_VALUE}) THEN {_column} END AS {_column}) FROM {_view} WHERE NOT ({NO_ROW})", _view)
GAPPY_PAIR = "month(ts) = 5 AND (sym_i = 'Brand#11' AND sym_j = 'Brand#12' OR sym_i = 'Brand#7' AND sym_j = 'Brand#7')"
view("tb_cov_ts", "SELECT ts, sym_i, sym_j, value FROM tb_cov, tb_cal", "tb_cov", "tb_cal")
view("tb_cov_ts_gaps", f"SELECT * FROM tb_cov_ts WHERE NOT ({GAPPY_PAIR})", "tb_cov_ts")

TD = "SELECT portfolio_id, CAST(t.ts AS DATE) AS ts, "
WITH_VAR = "tb_bw w LEFT JOIN tb_var{0} m ON m.ts = w.ts AND m.symbol = w.symbol"
ERROR = f"SELECT portfolio_id, w.ts, pow({strict(of('w', 'abs(w) * sqrt(value)'))}, 2) AS value FROM {WITH_VAR} GROUP BY 1, 2"
DIAG = f"SELECT portfolio_id, w.ts, {strict(of('w', 'w * w * value'))} AS value FROM {WITH_VAR} GROUP BY 1, 2"
FORECAST = f"SELECT portfolio_id, w.ts, {strict(of('w', 'w * (w1 / nullif(w0, 0))'))} AS value FROM (SELECT * FROM tb_w WHERE NOT is_cash) w LEFT JOIN m_all{{0}} m ON m.ts = w.ts AND m.symbol = w.symbol GROUP BY 1, 2"
FULL = """SELECT b.portfolio_id, b.ts, CASE WHEN coalesce(k, 0) = n * (n + 1) / 2 THEN coalesce(total, 0) END AS value FROM (SELECT portfolio_id, ts, count(*) FILTER (w <> 0 OR w IS NULL) AS n FROM tb_bw GROUP BY 1, 2) b
    LEFT JOIN (SELECT a.portfolio_id, a.ts, sum(CASE WHEN sym_i = sym_j THEN 1 ELSE 2 END * a.w * b.w * value) AS total, count(value) AS k FROM tb_bw a JOIN {0} c ON c.sym_i = a.symbol {1}
      JOIN tb_bw b ON b.portfolio_id = a.portfolio_id AND b.ts = a.ts AND b.symbol = c.sym_j WHERE a.w <> 0 AND b.w <> 0 GROUP BY 1, 2) p ON p.portfolio_id = b.portfolio_id AND p.ts = b.ts"""
LOADS = f"""SELECT * FROM (SELECT w.portfolio_id, w.ts, factor, {strict(of('w', 'w * f'))} AS y FROM tb_bw w LEFT JOIN tb_expo{{0}} e ON e.ts = w.ts AND e.symbol = w.symbol GROUP BY 1, 2, 3) WHERE factor IS NOT NULL OR y IS NULL"""
JOINED = "SELECT d.portfolio_id, CAST(d.ts AS DATE) AS ts, {0} FROM d LEFT JOIN a ON a.portfolio_id = d.portfolio_id AND a.ts = d.ts"


def exposures(spark, sf, panel=None):
    own = (tb.panel(spark, sf) if panel is None else panel).select("ts", "symbol").distinct()
    n = F.expr("CAST(substr(symbol, 7) AS INT)")
    one = own.select("ts", F.concat(F.lit("f"), (n % 3).cast("string")).alias("factor"), "symbol", (n / 25.0).alias("f"))
    return one.unionByName(own.select("ts", F.lit("all").alias("factor"), "symbol", F.lit(0.5).alias("f")))


view("tb_expo", "SELECT DISTINCT ts, 'f' || (CAST(substr(symbol, 7) AS INT) % 3) AS factor, symbol, CAST(substr(symbol, 7) AS INT) / 25.0::DOUBLE AS f FROM tb_panel UNION ALL SELECT DISTINCT ts, 'all', symbol, 0.5::DOUBLE FROM tb_panel", "tb_panel")


def _register(gaps: str) -> None:
    """The terms that read market data, on whole inputs and (``gaps``) on inputs with holes."""
    cut = (lambda df, column: holes(df, column)) if gaps else (lambda df, column: df)
    var = lambda s, d, panel=None: cut(variances(s, d, panel), "value")
    forecast = lambda s, d: cut(f.mean_return(tb.panel(s, d), name="value"), "value")
    traded = f"tb_asset t LEFT JOIN tb_mkt{gaps} m ON m.ts = t.ts AND m.symbol = t.symbol GROUP BY 1, t.ts"

    @query(f"transaction_cost{gaps}", f"{TD} {v(strict(of('u', '0.0005 * abs(u) + 0.7 * sigma * pow(abs(u), 1.5) / pow(valuevolume + 1e-8, 0.5) + 0.0001 * u')))} FROM {traded}", "tb_asset", f"tb_mkt{gaps}")
    def _(spark, sf):
        return value(c.transaction_cost(tb.trades(spark, sf), cut(market(spark, sf), "sigma"), 0.0005, 0.7, 0.0001))

    @query(f"stocks_transaction_cost{gaps}", f"{TD} {v(strict(of('u', '(0.0002 + 0.005 / price) * abs(u) + sigma * pow(abs(u), 1.5) / pow(valuevolume + 1e-8, 0.5)')))} FROM {traded}", "tb_asset", f"tb_mkt{gaps}")
    def _(spark, sf):
        return value(c.stocks_transaction_cost(tb.trades(spark, sf), cut(market(spark, sf), "sigma"), 0.0002))

    @query(f"term_returns_forecast{gaps}", f", a AS ({FORECAST.format(gaps)}) {BD} {v('value')} FROM a", "tb_w", f"m_all{gaps}")
    def _(spark, sf):
        return value(c.returns_forecast(weights(spark, sf), forecast(spark, sf)))

    @query(f"term_returns_error{gaps}", f"SELECT portfolio_id, CAST(w.ts AS DATE) AS ts, {v(strict(of('w', 'abs(w) * sqrt(value)')))} FROM {WITH_VAR.format(gaps)} GROUP BY 1, w.ts", "tb_bw", f"tb_var{gaps}")
    def _(spark, sf):
        errors = var(spark, sf).withColumn("value", F.sqrt("value"))
        return value(c.returns_error(weights(spark, sf), errors, benchmark(spark, sf)))

    if gaps:

        @query("risk_full_gaps", f", a AS ({FULL.format('tb_cov_ts_gaps', 'AND c.ts = a.ts')}) {BD} {v('value')} FROM a", "tb_bw", "tb_cov_ts_gaps")
        def _(spark, sf):
            panel, w = kept(spark, sf), weights(spark, sf)
            pairs = cov(spark, sf, panel).crossJoin(F.broadcast(panel.select("ts").distinct())).where(f"NOT ({GAPPY_PAIR})")
            return value(c.risk_full(w, pairs, benchmark(spark, sf, w)))

        @query("risk_by_matrix", f", a AS ({FULL.format('tb_cov_ts_gaps', 'AND c.ts = a.ts')}) {BD} {v('value')} FROM a", "tb_bw", "tb_cov_ts_gaps")
        def _(spark, sf):
            panel, w = kept(spark, sf), weights(spark, sf)
            pairs = cov(spark, sf, panel).crossJoin(F.broadcast(panel.select("ts").distinct())).where(f"NOT ({GAPPY_PAIR})")
            return value(c.risk_by_matrix(w, pairs, benchmark(spark, sf, w)))

    else:

        @query("risk_full", f", a AS ({FULL.format('tb_cov', '')}) {BD} {v('value')} FROM a", "tb_bw", "tb_cov")
        def _(spark, sf):
            w = weights(spark, sf)
            return value(c.risk_full(w, cov(spark, sf), benchmark(spark, sf, w)))

    @query(f"risk_diagonal{gaps}", f", a AS ({DIAG.format(gaps)}) {BD} {v('value')} FROM a", "tb_bw", f"tb_var{gaps}")
    def _(spark, sf):
        return value(c.risk_diagonal(weights(spark, sf), var(spark, sf), benchmark(spark, sf)))

    @query(f"risk_forecast_error{gaps}", f", e AS ({ERROR.format(gaps)}) {BD} {v('value')} FROM e", "tb_bw", f"tb_var{gaps}")
    def _(spark, sf):
        return value(c.risk_forecast_error(weights(spark, sf), var(spark, sf), benchmark(spark, sf)))

    needs = ("tb_bw", f"tb_expo{gaps}", f"tb_var{gaps}")

    @query(f"risk_factor_model{gaps}", f", l AS ({LOADS.format(gaps)}), a AS (SELECT portfolio_id, ts, {strict('y * y')} AS x FROM l GROUP BY 1, 2), d AS ({DIAG.format(gaps)}) {JOINED.format(v('a.x + d.value'))}", *needs)
    def _(spark, sf):
        panel, w = kept(spark, sf), weights(spark, sf)
        idio = var(spark, sf, panel).withColumnRenamed("value", "d")
        return value(c.risk_factor_model(w, cut(exposures(spark, sf, panel), "f"), idio, benchmark=benchmark(spark, sf, w)))

    both = "CASE WHEN p.factor = q.factor THEN 2 ELSE 0.5 END"

    @query(f"risk_factor_model_cov{gaps}", f", l AS ({LOADS.format(gaps)}), d AS ({DIAG.format(gaps)}), a AS (SELECT p.portfolio_id, p.ts, {strict(f'p.y * q.y * {both}')} AS x FROM l p JOIN l q ON p.portfolio_id = q.portfolio_id AND p.ts = q.ts GROUP BY 1, 2) {JOINED.format(v('a.x + d.value'))}", *needs)
    def _(spark, sf):
        panel, w = kept(spark, sf), weights(spark, sf)
        own = cut(exposures(spark, sf, panel), "f")
        pairs = own.select("ts", F.col("factor").alias("f1")).distinct().join(own.select("ts", F.col("factor").alias("f2")).distinct(), "ts")
        fc = pairs.withColumn("v", F.when(F.col("f1") == F.col("f2"), 2.0).otherwise(0.5))
        return value(c.risk_factor_model(w, own, var(spark, sf, panel).withColumnRenamed("value", "d"), fc, benchmark(spark, sf, w)))

    @query(f"risk_worst_case{gaps}", f", a AS (SELECT portfolio_id, ts, value * 20 AS value FROM ({DIAG.format(gaps)}) UNION ALL {ERROR.format(gaps)}) {BD} {v('CASE WHEN count(value) = 2 THEN max(value) END')} FROM a GROUP BY 1, ts", "tb_bw", f"tb_var{gaps}")
    def _(spark, sf):
        w, own, b = weights(spark, sf), var(spark, sf), benchmark(spark, sf)
        return value(c.risk_worst_case(c.risk_diagonal(w, own, b).withColumn("value", F.col("value") * 20), c.risk_forecast_error(w, own, b)))

    @query(f"objective_value{gaps}", f", a AS (SELECT portfolio_id, ts, value * -5 AS value FROM ({DIAG.format(gaps)}) UNION ALL {FORECAST.format(gaps)}) {BD} {v('CASE WHEN count(value) = 2 THEN sum(value) END', 3)} FROM a GROUP BY 1, ts", "tb_bw", "tb_w", f"m_all{gaps}", f"tb_var{gaps}")
    def _(spark, sf):
        w = weights(spark, sf)
        terms = {"risk": c.risk_diagonal(w, var(spark, sf), benchmark(spark, sf)), "return": c.returns_forecast(w, forecast(spark, sf))}
        return value(c.objective_value(terms, {"risk": -5.0}), 3)


for _gaps in ("", "_gaps"):
    _register(_gaps)


@query("missing_inputs", " UNION ALL ".join(f"""SELECT portfolio_id, CAST(t.ts AS DATE) AS ts, t.symbol, '{_input}' AS input FROM tb_asset t
    LEFT JOIN tb_mkt_gaps m ON m.ts = t.ts AND m.symbol = t.symbol WHERE u <> 0 AND {_input} IS NULL""" for _input in ("sigma", "valuevolume", "price")), "tb_asset", "tb_mkt_gaps")
def _(spark, sf):
    return shown(c.missing_inputs(tb.trades(spark, sf), holes(market(spark, sf), "sigma"), ["sigma", "valuevolume", "price"], "u"))


@query("tcost_forecast", f"{TD} {v(strict(of('u', '1.0 * sigma * pow(abs(u), 1.5) / pow(x + 1e-8, 0.5)')))} FROM tb_asset t LEFT JOIN (SELECT k.ts, k.symbol, sigma, w1 / nullif(w0, 0) AS x FROM tb_mkt k JOIN m_vol USING (symbol, ts)) m ON m.ts = t.ts AND m.symbol = t.symbol GROUP BY 1, t.ts", "tb_asset", "tb_mkt", "m_vol")
def _(spark, sf):
    """The same cost with forecast in place of realised volumes."""
    volumes = f.mean_volume(tb.panel(spark, sf), rolling=365.24 * 86_400).select("symbol", "ts", F.col("mean_volume").alias("valuevolume"))
    return value(c.transaction_cost(tb.trades(spark, sf), market(spark, sf).drop("valuevolume").join(volumes, ["symbol", "ts"]), 0.0, 1.0))


FEE = "(exp(ln(1 + {}) / periods) - 1)"
LENGTHS = "l AS (SELECT ts, 365.24 / (epoch(lead(ts) OVER (ORDER BY ts)) - epoch(ts)) * 86400 AS periods FROM (SELECT DISTINCT ts FROM tb_hold))"
FEES = of("h", f"{FEE.format('0.05')} * greatest(-h, 0) + {FEE.format('0.01')} * greatest(h, 0) - 0.0002 * h")


@query("holding_cost", f", {LENGTHS} SELECT portfolio_id, CAST(h.ts AS DATE) AS ts, {v(strict(FEES), 3)} FROM tb_hold h JOIN l ON l.ts = h.ts WHERE NOT is_cash GROUP BY 1, h.ts", "tb_hold")
def _(spark, sf):
    h = tb.holdings(spark, sf)
    return value(c.holding_cost(h, c.period_lengths(h), 5.0, 1.0, 0.0002), 3)


@query("stocks_holding_cost", f"{BD} {v('sum((exp(ln(1.05) / 12) - 1) * greatest(-h, 0))', 3)} FROM tb_hold WHERE NOT is_cash GROUP BY 1, ts", "tb_hold")
def _(spark, sf):
    return value(c.stocks_holding_cost(tb.holdings(spark, sf), 12.0), 3)


@query("stress_spread_cost", f", d AS (SELECT ts, lag(sd) OVER (ORDER BY ts) AS sd FROM (SELECT ts, stddev_samp(ret) AS sd FROM tb_panel GROUP BY 1)) SELECT portfolio_id, CAST(t.ts AS DATE) AS ts, {v(strict(of('u', '0.001 * CASE WHEN sd > 2 THEN 3 WHEN sd IS NOT NULL THEN 1 END * abs(u)')))} FROM tb_asset t LEFT JOIN d ON d.ts = t.ts GROUP BY 1, t.ts", "tb_asset", "tb_panel")
def _(spark, sf):
    return value(c.stress_spread_cost(tb.trades(spark, sf), tb.panel(spark, sf), 0.001, 2.0, 3.0))


@query("custom_cost", f"{BD} {v('sum(sqrt(abs(u)))')} FROM tb_asset GROUP BY 1, ts", "tb_asset")
def _(spark, sf):
    return value(c.custom_cost(tb.trades(spark, sf).where("not is_cash"), lambda t: F.sqrt(F.abs(t["u"]))))


@query("term_cash_return", f"SELECT portfolio_id, CAST(w.ts AS DATE) AS ts, {v('w * f', 9)} FROM tb_w w LEFT JOIN (SELECT ts, lag(cash_ret) OVER (ORDER BY ts) AS f FROM tb_cash) c ON c.ts = w.ts WHERE is_cash", "tb_w", "tb_cash")
def _(spark, sf):
    from ..operators.panel import add_cash

    forecast = f.cash_forecast(add_cash(tb.panel(spark, sf), tb.rates(spark, sf), 12.0))
    return value(c.cash_return(weights(spark, sf), forecast), 9)


@query("soft_violation", f"{BD} {v('sum(greatest(w - 0.05, 0))', 7, 0.0)} FROM tb_w WHERE NOT is_cash GROUP BY 1, ts", "tb_w")
def _(spark, sf):
    return value(c.soft_violation(k.chk_max_weights(weights(spark, sf), 0.05)), 7, 0.0)


# ---- checks ----------------------------------------------------------------------------------------------------------

view("tb_z", "SELECT t.portfolio_id, t.ts, t.symbol, t.is_cash, u / v AS z FROM tb_trade t JOIN tb_v v ON v.portfolio_id = t.portfolio_id AND v.ts = t.ts", "tb_trade", "tb_v")
view("tb_v", "SELECT portfolio_id, ts, sum(h) AS v FROM tb_hold GROUP BY 1, 2", "tb_hold")


def values(spark, sf):
    return tb.holdings(spark, sf).groupBy(P, "ts").agg(F.sum("h").alias("v"))


def zs(spark, sf):
    return tb.trades(spark, sf).join(values(spark, sf), [P, "ts"]).select(P, "ts", "symbol", "is_cash", (F.col("u") / F.col("v")).alias("z"))


def ck(name: str, source: str, lhs: str, op: str, rhs: str, needs: tuple, run, symbol: str = "symbol", digits: int = 6, where: str = "NOT is_cash", shift: float = 0.0, zero: bool = False) -> None:
    """Registers a check and its SQL twin; ``zero``: nothing on the left is always well."""
    ok = {"<=": "lhs <= rhs + 1e-9", ">=": "lhs >= rhs - 1e-9", "=": "abs(lhs - rhs) <= 1e-9"}[op]
    ok = f"CASE WHEN lhs = 0 THEN true ELSE {ok} END" if zero else ok
    sql = f", c AS (SELECT portfolio_id, ts, {symbol} AS symbol, {lhs} AS lhs, {rhs} AS rhs FROM {source} WHERE {where}) SELECT portfolio_id, {D}, CAST(symbol AS VARCHAR) AS symbol, round(lhs + {shift}, {digits}) + 0.0 AS lhs, round(CAST(rhs AS DOUBLE), {digits}) + 0.0 AS rhs, {ok} AS ok FROM c"

    @query(name, sql, *needs)
    def _(spark, sf):
        return shown(run(spark, sf).withColumn("lhs", F.col("lhs") + shift), P, "ts", "symbol", "lhs", "rhs", "ok", digits=digits)


GROSS = "(SELECT portfolio_id, ts, sum(CASE WHEN is_cash THEN w ELSE 0 END) AS cash, sum(CASE WHEN NOT is_cash THEN abs(w) END) AS lev FROM tb_w GROUP BY 1, 2)"
VALUED = "(SELECT g.*, v FROM " + GROSS + " g JOIN tb_v v ON v.portfolio_id = g.portfolio_id AND v.ts = g.ts)"
WV = "(SELECT w.*, v FROM tb_w w JOIN tb_v v ON v.portfolio_id = w.portfolio_id AND v.ts = w.ts)"
ZV = "(SELECT z.*, v FROM tb_z z JOIN tb_v v ON v.portfolio_id = z.portfolio_id AND v.ts = z.ts)"
ALL = "true"
ck("chk_long_only", "tb_w", "w", ">=", "0", ("tb_w",), lambda s, d: k.chk_long_only(weights(s, d)))
ck("chk_fixed_imbalance", GROSS, "cash", "=", "1 - 0.4", ("tb_w",), lambda s, d: k.chk_fixed_imbalance(weights(s, d), 0.4), "NULL", where=ALL)
ck("chk_no_cash", GROSS, "cash", "=", "0", ("tb_w",), lambda s, d: k.chk_no_cash(weights(s, d)), "NULL", where=ALL)
ck("chk_dollar_neutral", GROSS, "cash", "=", "1", ("tb_w",), lambda s, d: k.chk_dollar_neutral(weights(s, d)), "NULL", where=ALL)
ck("chk_min_cash", VALUED, "cash", ">=", "1000000 / v", ("tb_w", "tb_v"), lambda s, d: k.chk_min_cash(weights(s, d), values(s, d), 1e6), "NULL", where=ALL)
ck("chk_long_cash", VALUED, "cash", ">=", "0", ("tb_w", "tb_v"), lambda s, d: k.chk_long_cash(weights(s, d), values(s, d)), "NULL", where=ALL)
ck("chk_leverage", GROSS, "lev", "<=", "0.9", ("tb_w",), lambda s, d: k.chk_leverage(weights(s, d), 0.9), "NULL", where=ALL)
ck("chk_turnover", "(SELECT portfolio_id, ts, sum(CASE WHEN NOT is_cash THEN abs(z) END) / 2 AS x FROM tb_z GROUP BY 1, 2)", "x", "<=", "0.3", ("tb_z",), lambda s, d: k.chk_turnover(zs(s, d), 0.3), "NULL", where=ALL)
def _volumes(s, d):
    return f.mean_volume(tb.panel(s, d), rolling=365.24 * 86_400)


for _gaps in ("", "_gaps"):
    ck(f"chk_participation{_gaps}", f"(SELECT z.*, v, w1 / nullif(w0, 0) AS mv FROM {ZV} z LEFT JOIN m_vol{_gaps} m ON m.ts = z.ts AND m.symbol = z.symbol)", "v * abs(z)", "<=", "0.5 * mv", ("tb_z", "tb_v", f"m_vol{_gaps}"),
       lambda s, d, g=_gaps: k.chk_participation(zs(s, d), values(s, d), holes(_volumes(s, d), "mean_volume") if g else _volumes(s, d), 0.5), digits=3, shift=SHIFT, zero=True)
ck("chk_max_weights", "tb_w", "w", "<=", "0.05", ("tb_w",), lambda s, d: k.chk_max_weights(weights(s, d), 0.05))
ck("chk_min_weights", "tb_w", "w", ">=", "-0.03", ("tb_w",), lambda s, d: k.chk_min_weights(weights(s, d), -0.03))
ck("chk_max_trade_weights", "tb_z", "z", "<=", "0.05", ("tb_z",), lambda s, d: k.chk_max_trade_weights(zs(s, d), 0.05))
ck("chk_min_trade_weights", "tb_z", "z", ">=", "-0.05", ("tb_z",), lambda s, d: k.chk_min_trade_weights(zs(s, d), -0.05))
ck("chk_max_trades", ZV, "z", "<=", "50000 / v", ("tb_z", "tb_v"), lambda s, d: k.chk_max_trades(zs(s, d), values(s, d), 5e4))
ck("chk_min_trades", ZV, "z", ">=", "-50000 / v", ("tb_z", "tb_v"), lambda s, d: k.chk_min_trades(zs(s, d), values(s, d), -5e4))
ck("chk_max_holdings", WV, "w", "<=", "90000 / v", ("tb_w", "tb_v"), lambda s, d: k.chk_max_holdings(weights(s, d), values(s, d), 9e4))
ck("chk_min_holdings", WV, "w", ">=", "-90000 / v", ("tb_w", "tb_v"), lambda s, d: k.chk_min_holdings(weights(s, d), values(s, d), -9e4))
# every symbol of the book and, beside every book, of the benchmark
DEV = """(SELECT portfolio_id, ts, symbol, false AS is_cash, CASE WHEN ts IN (SELECT ts FROM tb_bm) THEN coalesce(w, 0) - coalesce(wb, 0) END AS dev FROM (SELECT * FROM tb_w WHERE NOT is_cash)
    FULL JOIN (SELECT b.portfolio_id, b.ts, m.symbol, m.w AS wb FROM (SELECT DISTINCT portfolio_id, ts FROM tb_w) b JOIN tb_bm m ON m.ts = b.ts) USING (portfolio_id, ts, symbol))"""
ck("chk_max_bm_deviation", DEV, "dev", "<=", "0.02", ("tb_w", "tb_bm"), lambda s, d: k.chk_max_bm_deviation(weights(s, d), benchmark(s, d), 0.02))
ck("chk_min_bm_deviation", DEV, "dev", ">=", "-0.02", ("tb_w", "tb_bm"), lambda s, d: k.chk_min_bm_deviation(weights(s, d), benchmark(s, d), -0.02))
FAC = f"""(SELECT portfolio_id, ts, factor AS symbol, CASE WHEN NOT lost THEN y END AS y, CASE WHEN NOT lost THEN g END AS g FROM (
    SELECT *, bool_or(factor IS NULL) OVER (PARTITION BY portfolio_id, ts) AS lost FROM (
      SELECT portfolio_id, w.ts, factor, {strict(of('w', 'w * f'))} AS y, {strict(of('w', 'abs(w) * f'))} AS g FROM tb_w w LEFT JOIN tb_expo e ON e.ts = w.ts AND e.symbol = w.symbol WHERE NOT is_cash GROUP BY 1, 2, 3) WHERE factor IS NOT NULL OR y IS NULL))"""
LIM = "CASE symbol WHEN 'all' THEN 0.3 WHEN 'f0' THEN 0.1 WHEN 'f1' THEN 0.05 WHEN 'f2' THEN 0.0 END"


def limits(spark):
    return spark.createDataFrame([("all", 0.3), ("f0", 0.1), ("f1", 0.05), ("f2", 0.0)], "factor string, limit double")


ck("chk_factor_max", FAC, "y", "<=", LIM, ("tb_w", "tb_expo"), lambda s, d: k.chk_factor_max(weights(s, d), exposures(s, d), limits(s)), where=ALL)
ck("chk_factor_max_gaps", FAC.replace("tb_expo", "tb_expo_gaps"), "y", "<=", LIM, ("tb_w", "tb_expo_gaps"), lambda s, d: k.chk_factor_max(weights(s, d), holes(exposures(s, d), "f"), limits(s)), where=ALL)
ck("chk_factor_min", FAC, "y", ">=", LIM, ("tb_w", "tb_expo"), lambda s, d: k.chk_factor_min(weights(s, d), exposures(s, d), limits(s)), where=ALL)
ck("chk_factor_gross", FAC, "g", "<=", LIM, ("tb_w", "tb_expo"), lambda s, d: k.chk_factor_gross(weights(s, d), exposures(s, d), limits(s)), where=ALL)
ck("chk_fixed_factor", FAC, "y", "=", LIM, ("tb_w", "tb_expo"), lambda s, d: k.chk_fixed_factor(weights(s, d), exposures(s, d), limits(s)), where=ALL)
ck("chk_factor_neutral", FAC, "y", "=", "0", ("tb_w", "tb_expo"), lambda s, d: k.chk_factor_neutral(weights(s, d), exposures(s, d)), where=ALL)
BETA = FAC.replace("tb_expo e", """(SELECT b.ts, 'market' AS factor, c.sym_j AS symbol, CASE WHEN count(value) = any_value(n) THEN sum(b.w * value) END AS f FROM tb_bm b JOIN (SELECT ts, count(*) AS n FROM tb_bm GROUP BY 1) n ON n.ts = b.ts
    JOIN (SELECT * FROM tb_cov UNION ALL SELECT sym_j, sym_i, value FROM tb_cov WHERE sym_i <> sym_j) c ON c.sym_i = b.symbol GROUP BY 1, 3) e""").replace("WHERE NOT is_cash", "WHERE NOT is_cash AND w.ts IN (SELECT ts FROM tb_bm)")
ck("chk_market_neutral", BETA, "y", "=", "0", ("tb_w", "tb_bm", "tb_cov"), lambda s, d: k.chk_market_neutral(weights(s, d), benchmark(s, d), cov(s, d)), where=ALL, digits=4)
ck("chk_no_trade", "tb_z", "z", "=", "0", ("tb_z",), lambda s, d: k.chk_no_trade(zs(s, d), "Brand#3", tb.panel(s, d).where("month(ts) = 4")), where="symbol = 'Brand#3' AND month(ts) = 4")
ck("chk_weights_at_times", "tb_w", "w", "<=", "0.04", ("tb_w",), lambda s, d: k.chk_weights_at_times(weights(s, d), 0.04, tb.panel(s, d).where("month(ts) = 4")), where="NOT is_cash AND month(ts) = 4")
ck("chk_cost_limit", f"({DIAG.format('')})", "value", "<=", "0.5", ("tb_bw", "tb_var"), lambda s, d: k.chk_cost_limit(c.risk_diagonal(weights(s, d), variances(s, d), benchmark(s, d)), 0.5), "NULL", where=ALL, digits=4)
