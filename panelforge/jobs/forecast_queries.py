"""Forecasts over the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors, forecasts as f, subspace
from . import testbeds as tb
from .cleaning_queries import r
from .panel_queries import D, s
from .registry import query, rnd, shown, view

DAY, YEAR = 86_400.0, 365.24 * 86_400
HL, ROLL = 180 * DAY, 400 * DAY
KEYS = ["symbol", "ts"]
FRAME = "OVER (PARTITION BY symbol ORDER BY e RANGE BETWEEN {} PRECEDING AND 1 PRECEDING)"


def moments_view(name: str, half_life: float | None, rolling: float | None, x: str = "ret") -> None:
    """A view with the past weighted count, sum and sum of squares, the weights taken relative to each time."""
    over = FRAME.format("UNBOUNDED" if rolling is None else int(rolling))
    w = f"pow(2.0, (e - e0) / {half_life})" if half_life else "CAST(1 AS DOUBLE)"
    back = f"pow(2.0, (e0 - e) / {half_life})" if half_life else "CAST(1 AS DOUBLE)"
    view(name, f"""
        SELECT symbol, ts, {back} * sum(w) {over} AS w0, {back} * sum(w * x) {over} AS w1, {back} * sum(w * x * x) {over} AS w2, count(x) {over} AS n FROM (
          SELECT symbol, ts, e, e0, {x} AS x, CASE WHEN {x} IS NOT NULL THEN {w} END AS w FROM (
            SELECT *, epoch(ts)::BIGINT AS e, epoch(min(ts) OVER (PARTITION BY symbol))::BIGINT AS e0 FROM tb_panel))""", "tb_panel")  # fmt: skip


for _name, _hl, _roll in (("m_all", None, None), ("m_ew", HL, None), ("m_roll", None, ROLL), ("m_both", HL, ROLL)):
    moments_view(_name, _hl, _roll)
moments_view("m_vol", None, YEAR, "valuevolume")

MEAN, VAR = "w1 / nullif(w0, 0)", "w2 / nullif(w0, 0)"
PLAIN = f"greatest({VAR} - ({MEAN}) * ({MEAN}), 0.0)"
HOW = {"": ("m_all", {}), "ew_": ("m_ew", {"half_life": HL}), "rolling_": ("m_roll", {"rolling": ROLL}), "rolling_ew_": ("m_both", {"half_life": HL, "rolling": ROLL})}


def _register(prefix: str, source: str, how: dict) -> None:
    def pick(x: str, name: str) -> str:
        return f"SELECT symbol, {D}, {r(x, name, 5)} FROM {source}"

    null_if_zero = "CASE WHEN w0 > 0 THEN {} END"

    @query(f"{prefix}mean_return", pick(MEAN, "mean"), source)
    def _(spark, sf):
        return shown(f.mean_return(tb.panel(spark, sf), **how), *KEYS, "mean", digits=5)

    @query(f"{prefix}variance", pick(VAR, "variance"), source)
    def _(spark, sf):
        return shown(f.variance(tb.panel(spark, sf), **how), *KEYS, "variance", digits=5)

    @query(f"{prefix}variance_plain", pick(null_if_zero.format(PLAIN), "variance"), source)
    def _(spark, sf):
        out = f.variance(tb.panel(spark, sf), kelly=False, **how)
        return shown(f.count_past(out, **how).withColumn("variance", F.when(F.col("n") > 0, F.col("variance"))), *KEYS, "variance", digits=5)

    @query(f"{prefix}std", pick(f"sqrt({VAR})", "std"), source)
    def _(spark, sf):
        return shown(f.std(tb.panel(spark, sf), **how), *KEYS, "std", digits=5)

    @query(f"{prefix}mean_error", pick(f"CASE WHEN n > 1 THEN sqrt({PLAIN} / nullif(w0, 0)) END", "mean_error"), source)
    def _(spark, sf):
        out = f.mean_error(tb.panel(spark, sf), **how)
        known = F.count("ret").over(f.trailing(how.get("rolling")))
        return shown(out.withColumn("mean_error", F.when(known > 1, F.col("mean_error"))), *KEYS, "mean_error", digits=5)

    @query(f"{prefix}count_past", f"SELECT symbol, {D}, {r('coalesce(w0, 0)', 'n')}, CASE WHEN n = 0 THEN 'none' WHEN n < 5 THEN 'low' ELSE 'ok' END AS status FROM {source}", source)
    def _(spark, sf):
        return shown(f.count_past(tb.panel(spark, sf), **how), *KEYS, "n", "status")


for _prefix, (_source, _how) in HOW.items():
    _register(_prefix, _source, _how)


@query("mean_volume", f"SELECT symbol, {D}, {r(MEAN, 'mean_volume', 2)} FROM m_vol", "m_vol")
def _(spark, sf):
    return shown(f.mean_volume(tb.panel(spark, sf), rolling=YEAR), *KEYS, "mean_volume", digits=2)


@query("ew_recursive", f"SELECT symbol, {D}, {r(MEAN, 'mean')}, {r('coalesce(w0, 0)', 'n')} FROM m_ew", "m_ew")
def _(spark, sf):
    return shown(f.ew_recursive(tb.panel(spark, sf), HL))


FAST = 1_200.0  # a half-life of twenty minutes: the ticks span more than two thousand
TICKS = f"""SELECT a.symbol, a.event_id, {{}} FROM tb_ticks a LEFT JOIN tb_ticks b ON b.symbol = a.symbol AND b.ts < a.ts {{}} GROUP BY 1, 2"""
AGE = f"pow(2.0, (epoch_us(b.ts) - epoch_us(a.ts)) / {FAST * 1e6})"
TICK_SUMS = f"{r(f'sum({AGE} * b.price) / nullif(sum({AGE}), 0)', 'mean', 6)}, {r(f'coalesce(sum({AGE}), 0)', 'n')}"


def _ticks(spark, sf, **how):
    """Exponential means over ticks whose history is thousands of half-lives long."""
    out = f.moments(tb.ticks(spark, sf).select("symbol", "ts", "price", "event_id"), "price", FAST, **how)
    return shown(out.select("symbol", "event_id", F.try_divide("w1", "w0").alias("mean"), F.coalesce("w0", F.lit(0.0)).alias("n")).withColumn("mean", F.round("mean", 6)))


@query("ew_long_history", TICKS.format(TICK_SUMS, ""), "tb_ticks")
def _(spark, sf):
    return _ticks(spark, sf)


@query("rolling_ew_long_history", TICKS.format(TICK_SUMS, "AND b.ts >= a.ts - INTERVAL 5 HOUR"), "tb_ticks")
def _(spark, sf):
    return _ticks(spark, sf, rolling=5 * 3_600.0)


HOT_FRAME = "OVER (PARTITION BY symbol ORDER BY epoch_us(ts) RANGE BETWEEN {} PRECEDING AND 1 PRECEDING)"

for _name, _rolling in (("chunked_moments", None), ("chunked_rolling_moments", 90_000.0)):
    _over = HOT_FRAME.format("UNBOUNDED" if _rolling is None else int(_rolling * 1e6))

    @query(_name, f"SELECT symbol, event_id, count(price) {_over} AS n, {r(f'avg(price) {_over}', 'mean', 6)}, {r(f'avg(price * price) {_over}', 'variance', 4)} FROM tb_hot", "tb_hot")
    def _(spark, sf, rolling=_rolling):
        """Trailing moments of ticks of which most are of one symbol, by chunks of a day."""
        from .panel_queries import hot_ticks

        out = f.all_moments(hot_ticks(spark, sf), "price", rolling=rolling, chunk=86_400.0)
        return out.select("symbol", "event_id", F.col("n").cast("long").alias("n"), rnd("mean", 6).alias("mean"), rnd("variance", 4).alias("variance"))


LAST = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"


@query("last_n_mean_std", f"SELECT symbol, {D}, {r(f'avg(ret) {LAST}', 'last_mean')}, {r(f'sqrt(avg(ret * ret) {LAST})', 'last_std')}, {r('stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING)', 'last_pstd')} FROM tb_dense", "tb_dense")
def _(spark, sf):
    return shown(f.last_n(s.dense(tb.panel(spark, sf)), 6), *KEYS, "last_mean", "last_std", "last_pstd")


PAIRS = "tb_panel a JOIN tb_panel b ON a.ts = b.ts AND a.symbol <= b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL AND a.ts < TIMESTAMP '2000-01-01'"


@query("joint_count", f"SELECT a.symbol AS sym_i, b.symbol AS sym_j, count(*) AS n FROM {PAIRS} GROUP BY 1, 2", "tb_panel")
def _(spark, sf):
    return f.pair_moments(tb.panel(spark, sf), at="2000-01-01").select("sym_i", "sym_j", "n")


@query("covariance", f"SELECT a.symbol AS sym_i, b.symbol AS sym_j, count(*) AS n, {r('avg(a.ret * b.ret)', 'value')} FROM {PAIRS} GROUP BY 1, 2", "tb_panel")
def _(spark, sf):
    return shown(f.covariance(tb.panel(spark, sf), at="2000-01-01"))


@query("covariance_plain", f"SELECT a.symbol AS sym_i, b.symbol AS sym_j, count(*) AS n, {r('avg(a.ret * b.ret) - avg(a.ret) * avg(b.ret)', 'value')} FROM {PAIRS} GROUP BY 1, 2", "tb_panel")
def _(spark, sf):
    return shown(f.covariance(tb.panel(spark, sf), kelly=False, at="2000-01-01"))


WEIGHT = f"pow(2.0, (epoch(a.ts) - epoch(TIMESTAMP '2000-01-01')) / {HL})"


@query("ew_covariance", f"SELECT a.symbol AS sym_i, b.symbol AS sym_j, count(*) AS n, {r(f'sum({WEIGHT} * a.ret * b.ret) / sum({WEIGHT})', 'value')} FROM {PAIRS} GROUP BY 1, 2", "tb_panel")
def _(spark, sf):
    return shown(f.covariance(tb.panel(spark, sf), half_life=HL, at="2000-01-01"))


def _updated(spark, sf, **how):
    """Moments stored before 1999 and written down, then a year of the panel added to them."""
    from ..functions.core import shared_folder

    panel, path = tb.panel(spark, sf), f"{shared_folder(spark, 'moments')}/rows"
    f.pair_moments(panel, at="1999-01-01", **how).write.parquet(path)
    return f.update_pair_moments(spark.read.parquet(path), panel, "1999-01-01", "2000-01-01", **how)


@query("covariance_updated", f"SELECT a.symbol AS sym_i, b.symbol AS sym_j, count(*) AS n, {r('avg(a.ret * b.ret) - avg(a.ret) * avg(b.ret)', 'value')} FROM {PAIRS} GROUP BY 1, 2", "tb_panel")
def _(spark, sf):
    return shown(f.covariance_of(_updated(spark, sf), kelly=False))


@query("ew_covariance_updated", f"SELECT a.symbol AS sym_i, b.symbol AS sym_j, count(*) AS n, {r(f'sum({WEIGHT} * a.ret * b.ret) / sum({WEIGHT})', 'value')} FROM {PAIRS} GROUP BY 1, 2", "tb_panel")
def _(spark, sf):
    return shown(f.covariance_of(_updated(spark, sf, half_life=HL)))


def _dates(spark, sf):
    return tb.panel(spark, sf).select("ts").distinct().where("month(ts) = 1 AND year(ts) > 1996")


BLOCKED = """SELECT CAST(d.ts AS DATE) AS ts, a.symbol AS sym_i, b.symbol AS sym_j, count(*) AS n, {} FROM tb_panel a JOIN tb_panel b
    ON a.ts = b.ts AND a.symbol <= b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL JOIN (SELECT ts FROM tb_cal WHERE month(ts) = 1 AND year(ts) > 1996) d ON a.ts < d.ts GROUP BY 1, 2, 3"""


@query("covariance_blocked", BLOCKED.format(r("avg(a.ret * b.ret) - avg(a.ret) * avg(b.ret)", "value")), "tb_panel", "tb_cal")
def _(spark, sf):
    return shown(f.covariance_blocked(tb.panel(spark, sf), _dates(spark, sf), kelly=False, block=8))


def _register_blocked(name: str, kelly: bool, half_life: float | None, rolling: float | None) -> None:
    """Covariances at many dates, plainly: every pair's common rows of each window, weighted by their age."""
    w = f"pow(2.0, (epoch(a.ts) - epoch(d.ts)) / {half_life})" if half_life else "1.0"
    mean = lambda x: f"sum({w} * {x}) / sum({w})"
    value = mean("a.ret * b.ret") + ("" if kelly else f" - {mean('a.ret')} * {mean('b.ret')}")
    sql = BLOCKED.format(r(value, "value", 8))
    if rolling is not None:
        sql = sql.replace("ON a.ts < d.ts", f"ON a.ts < d.ts AND epoch(a.ts) >= epoch(d.ts) - {int(rolling)}")

    @query(name, sql, "tb_panel", "tb_cal")
    def _(spark, sf):
        return shown(f.covariance_blocked(tb.panel(spark, sf), _dates(spark, sf), kelly, block=8, half_life=half_life, rolling=rolling, times=30), digits=8)


for _kelly, _end in ((True, ""), (False, "_plain")):
    _register_blocked(f"rolling_covariance_blocked{_end}", _kelly, None, ROLL)
    _register_blocked(f"ew_covariance_blocked{_end}", _kelly, HL, None)
    _register_blocked(f"rolling_ew_covariance_blocked{_end}", _kelly, HL, ROLL)


@query("last_n_cov", f"SELECT a.symbol AS sym_i, b.symbol AS sym_j, count(*) AS n, {r('covar_samp(a.ret, b.ret)', 'value')} FROM {PAIRS} AND a.ts IN (SELECT ts FROM tb_cal WHERE ts < TIMESTAMP '2000-01-01' ORDER BY ts DESC LIMIT 12) GROUP BY 1, 2", "tb_panel", "tb_cal")
def _(spark, sf):
    return shown(f.last_n_covariance(tb.panel(spark, sf), 12, "2000-01-01"))


def _cov_at_dates(spark, sf):
    return f.covariance_blocked(tb.panel(spark, sf), _dates(spark, sf))


@query("psd_factor")
def _(spark, sf):
    return shown(factors.psd_factor(_cov_at_dates(spark, sf)))


@query("psd_factor_product", f"""SELECT CAST(d.ts AS DATE) AS ts, a.symbol AS sym_i, b.symbol AS sym_j, {r('avg(coalesce(a.ret, 0) * coalesce(b.ret, 0))', 'value', 6)} FROM tb_dense a JOIN tb_dense b
    ON a.ts = b.ts AND a.symbol <= b.symbol JOIN (SELECT ts FROM tb_cal WHERE month(ts) = 1 AND year(ts) >= 2000) d ON a.ts < d.ts GROUP BY 1, 2, 3""", "tb_dense", "tb_cal")
def _(spark, sf):
    """F'F gives back each covariance of returns without gaps, which is positive."""
    whole = s.dense(tb.panel(spark, sf)).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    own = factors.psd_factor(f.covariance_blocked(whole, _dates(spark, sf).where("year(ts) >= 2000")))
    a, b = own.toDF("ts", "factor", "sym_i", "fi"), own.toDF("ts", "factor", "sym_j", "fj")
    pairs = a.join(b, ["ts", "factor"]).where("sym_i <= sym_j").groupBy("ts", "sym_i", "sym_j").agg(F.sum(F.col("fi") * F.col("fj")).alias("value"))
    return shown(pairs, digits=6)


@query("factor_model_pca")
def _(spark, sf):
    return shown(factors.factor_model_pca(_cov_at_dates(spark, sf), 3))


def _whole_covariances(spark, sf):
    """Covariances of returns without gaps: positive, so factors and what they leave add up to the variances."""
    whole = s.dense(tb.panel(spark, sf)).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    return f.covariance_blocked(whole, _dates(spark, sf).where("year(ts) >= 2000"))


@query("factor_model_pca_blocked_variances", f"""SELECT CAST(d.ts AS DATE) AS ts, symbol, {r('avg(coalesce(ret, 0) * coalesce(ret, 0))', 'value', 6)} FROM tb_dense a
    JOIN (SELECT ts FROM tb_cal WHERE month(ts) = 1 AND year(ts) >= 2000) d ON a.ts < d.ts GROUP BY 1, 2""", "tb_dense", "tb_cal")
def _(spark, sf):
    """What the factors explain of each symbol and what they leave, together."""
    model = subspace.factor_model_pca_blocked(_whole_covariances(spark, sf), 4, iters=4, block=8)
    part = F.when(F.col("part") == "exposure", F.col("value") * F.col("value")).otherwise(F.col("value"))
    return shown(model.groupBy("ts", "symbol").agg(F.sum(part).alias("value")), digits=6)


@query("factor_model_svd")
def _(spark, sf):
    return shown(factors.factor_model_svd(tb.panel(spark, sf), _dates(spark, sf), 3, 730))


@query("factor_model_monthly")
def _(spark, sf):
    return shown(factors.factor_model_monthly(tb.panel(spark, sf), 5, 730))


view("tb_x", "SELECT p.symbol, p.ts, p.ret, p.ret * k.rate AS product, k.rate FROM tb_panel p JOIN (SELECT c.ts, rate FROM tb_cal c ASOF LEFT JOIN tb_rate r ON c.ts >= r.ts) k ON p.ts = k.ts", "tb_panel", "tb_cal", "tb_rate")
BEFORE = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("regressor_xty", f"SELECT symbol, {D}, {r(f'CASE WHEN count(product) {BEFORE} >= 10 THEN avg(product) {BEFORE} END', 'xty')} FROM tb_x", "tb_x")
def _(spark, sf):
    return shown(f.regressor_xty(tb.panel(spark, sf), tb.rates(spark, sf).withColumnRenamed("rate", "value")), *KEYS, "xty")


def _arrays(spark, sf):
    return tb.rates(spark, sf).select("ts", F.array("rate").alias("x"))


@query("linear_regression_return", """
    , l AS (SELECT rate AS x FROM tb_rate WHERE ts <= TIMESTAMP '2000-01-01' ORDER BY ts DESC LIMIT 1)
    SELECT symbol, round(regr_intercept(ret, rate) + regr_slope(ret, rate) * (SELECT x FROM l), 6) + 0.0 AS forecast FROM tb_x WHERE ret IS NOT NULL AND rate IS NOT NULL AND ts < TIMESTAMP '2000-01-01' GROUP BY 1""", "tb_x", "tb_rate")
def _(spark, sf):
    return shown(factors.linear_regression_return(tb.panel(spark, sf), _arrays(spark, sf), "2000-01-01"), digits=6)


# ridge of one standardised regressor and an intercept, in closed form
view("tb_z1", """
    SELECT ts, (rate - avg(rate) OVER ()) / stddev_pop(rate) OVER () AS z FROM (SELECT c.ts, rate FROM tb_cal c ASOF LEFT JOIN tb_rate r ON c.ts >= r.ts) WHERE rate IS NOT NULL AND ts <= TIMESTAMP '2000-01-01'""", "tb_cal", "tb_rate")
view("tb_ridge", """
    SELECT (now - m) / (q + 0.1 - m * m) AS b, 1 - m * (now - m) / (q + 0.1 - m * m) AS a FROM (
      SELECT avg(z * z) FILTER (ts < TIMESTAMP '2000-01-01') AS q, avg(z) FILTER (ts < TIMESTAMP '2000-01-01') AS m, arg_max(z, ts) AS now FROM tb_z1)""", "tb_z1")
ZPAIRS = "tb_panel a JOIN tb_panel b ON a.ts = b.ts AND a.symbol <= b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL JOIN tb_z1 x ON x.ts = a.ts AND x.ts < TIMESTAMP '2000-01-01'"


@query("regression_mean", f"SELECT symbol, {r('avg(ret * z) * (SELECT b FROM tb_ridge) + avg(ret) * (SELECT a FROM tb_ridge)', 'forecast', 6)} FROM tb_panel p JOIN tb_z1 x ON x.ts = p.ts AND x.ts < TIMESTAMP '2000-01-01' WHERE ret IS NOT NULL GROUP BY 1", "tb_panel", "tb_ridge")
def _(spark, sf):
    return shown(factors.regression_mean(tb.panel(spark, sf), _arrays(spark, sf), "2000-01-01"), digits=6)


@query("regression_covariance", f"SELECT a.symbol AS sym_i, b.symbol AS sym_j, {r('avg(a.ret * b.ret * z) * (SELECT b FROM tb_ridge) + avg(a.ret * b.ret) * (SELECT a FROM tb_ridge)', 'value', 6)} FROM {ZPAIRS} GROUP BY 1, 2", "tb_panel", "tb_ridge")
def _(spark, sf):
    return shown(factors.regression_covariance(tb.panel(spark, sf), _arrays(spark, sf), "2000-01-01"), digits=6)


@query("decayed_forecast", f"SELECT symbol, {D}, CAST(k AS INT) AS step, {r(f'{MEAN} * pow(0.5, k)', 'mean')} FROM m_all, range(4) t(k)", "m_all")
def _(spark, sf):
    return shown(f.decayed_forecast(f.mean_return(tb.panel(spark, sf)), 4, 0.5), *KEYS, "step", "mean")


@query("cash_forecast", f"SELECT {D}, {r('lag(cash_ret) OVER (ORDER BY ts)', 'forecast', 12)} FROM tb_cash", "tb_cash")
def _(spark, sf):
    from ..operators.panel import add_cash

    return shown(f.cash_forecast(add_cash(tb.panel(spark, sf), tb.rates(spark, sf), 12.0)), "ts", "forecast", digits=12)


@query("vol_target_to_period_risk", f"SELECT {D}, {r('0.01 / nullif(round_even(count(*) OVER o / nullif((epoch(ts) - epoch(min(ts) OVER o)) / (86400 * 365.24), 0), 0), 0)', 'risk', 12)} FROM tb_cal WINDOW o AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)", "tb_cal")
def _(spark, sf):
    return shown(f.vol_target_to_period_risk(tb.panel(spark, sf), 0.1), digits=12)


@query("stress_indicator", f"""
    , b AS (SELECT ts, avg(ret) AS bm_ret FROM tb_panel GROUP BY 1), v AS (SELECT ts, stddev_samp(bm_ret) OVER (ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) / 0.5 AS x FROM b)
    SELECT {D}, {r('CASE WHEN x IS NOT NULL THEN greatest(0, least(1, x)) END', 'indicator')}, {r('0.5 + (1 - CASE WHEN x IS NOT NULL THEN greatest(0, least(1, x)) END)', 'leverage')} FROM v""", "tb_panel")
def _(spark, sf):
    bm = tb.panel(spark, sf).groupBy("ts").agg(F.avg("ret").alias("bm_ret"))
    return shown(f.stress_indicator(bm, 12, 0.5), "ts", "indicator", "leverage")


@query("forecast_at", f"""
    SELECT CAST(d.ts AS DATE) AS ts, symbol, {r('median(ret)', 'value')} FROM tb_panel p JOIN (SELECT ts FROM tb_cal WHERE month(ts) = 1 AND year(ts) > 1996) d ON p.ts < d.ts AND p.ts >= d.ts - INTERVAL 366 DAY
    GROUP BY 1, 2""", "tb_panel", "tb_cal")
def _(spark, sf):
    out = f.forecast_at(tb.panel(spark, sf), _dates(spark, sf), lambda past: past.median(), 366)
    return shown(out.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))))
