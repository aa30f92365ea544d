"""Cleaning, forecasts and covariances over daily bars of all suppliers, costs, checks and reports over a portfolio of each customer: beds that grow with the scale factor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as a, checks as k, cleaning as c, forecasts as f, terms as t
from . import testbeds as tb
from .cleaning_queries import CLEAN_SHOWN, clean_views, r, sql
from .forecast_queries import FRAME
from .panel_queries import D
from .registry import query, rnd, shown

YEAR = 365 * 86_400
HOW = {"max_dividend": 1e6, "missing_run": 20, "anomalous": 20.0, "passes": 2, "threshold": 6.0, "false_above": 3.0}
DAILY = clean_views("tb_dc", "tb_daily", 1e6, 20, 20.0, 6.0, 3.0, passes=2)


@query("daily_clean_bars", sql(CLEAN_SHOWN, DAILY), DAILY)
def _(spark, sf):
    out = c.clean_bars(tb.daily_bars(spark, sf), longest=tb.most_lines(spark, sf), **HOW)
    return shown(out.withColumn("ret", rnd("return")).drop("return"))


FADE = 90 * 86_400
W = f"pow(2.0, (epoch(a.ts) - epoch(d.ts)) / {FADE}.0)"
ROLLED = FRAME.format(YEAR)


@query("daily_rolling_moments", f"SELECT symbol, {D}, {r(f'avg(ret) {ROLLED}', 'mean', 6)}, {r(f'avg(ret * ret) {ROLLED}', 'variance', 5)} FROM (SELECT *, epoch(ts)::BIGINT AS e FROM tb_daily_panel)", "tb_daily_panel")
def _(spark, sf):
    out = f.all_moments(tb.daily_panel(spark, sf), rolling=float(YEAR))
    return out.select("symbol", F.to_date("ts").alias("ts"), rnd("mean", 6).alias("mean"), rnd("variance", 5).alias("variance"))


@query("daily_covariance_blocked", f"""
    SELECT CAST(d.ts AS DATE) AS ts, a.symbol AS sym_i, b.symbol AS sym_j, count(*) AS n, {r('avg(a.ret * b.ret)', 'value', 5)} FROM tb_daily_panel a JOIN tb_daily_panel b
    ON a.ts = b.ts AND a.symbol <= b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL JOIN (SELECT unnest([TIMESTAMP '1995-01-01', TIMESTAMP '1998-01-01']) AS ts) d ON a.ts < d.ts GROUP BY 1, 2, 3""", "tb_daily_panel")
def _(spark, sf):
    dates = spark.createDataFrame([("1995-01-01",), ("1998-01-01",)], "d string").select(F.to_timestamp("d").alias("ts"))
    return shown(f.covariance_blocked(tb.daily_panel(spark, sf), dates), digits=5)


@query("daily_rolling_covariance_blocked", f"""
    SELECT CAST(d.ts AS DATE) AS ts, a.symbol AS sym_i, b.symbol AS sym_j, count(*) AS n, {r(f'sum({W} * a.ret * b.ret) / sum({W}) - sum({W} * a.ret) / sum({W}) * sum({W} * b.ret) / sum({W})', 'value', 5)}
    FROM tb_daily_panel a JOIN tb_daily_panel b ON a.ts = b.ts AND a.symbol <= b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL
    JOIN (SELECT unnest([TIMESTAMP '1995-01-01', TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01']) AS ts) d ON a.ts < d.ts AND epoch(a.ts) >= epoch(d.ts) - {2 * YEAR} GROUP BY 1, 2, 3""", "tb_daily_panel")
def _(spark, sf):
    dates = spark.createDataFrame([("1995-01-01",), ("1996-01-01",), ("1998-01-01",)], "d string").select(F.to_timestamp("d").alias("ts"))
    return shown(f.covariance_blocked(tb.daily_panel(spark, sf), dates, kelly=False, half_life=float(FADE), rolling=float(2 * YEAR)), digits=5)


SHIFT = 0.0000123457  # keeps exact halves from the last digit
COST = "0.0005 * abs(u) + 0.7 * sigma * pow(abs(u), 1.5) / pow(valuevolume + 1e-8, 0.5)"


@query("books_transaction_cost", f"""SELECT portfolio_id, CAST(b.ts AS DATE) AS ts, {r(f'CASE WHEN count(*) = count({COST}) THEN sum({COST}) END + {SHIFT}', 'value', 4)}
    FROM (SELECT *, h / 10 AS u FROM tb_books) b LEFT JOIN tb_supply s ON s.ts = b.ts AND s.symbol = b.symbol GROUP BY 1, b.ts""", "tb_books", "tb_supply")
def _(spark, sf):
    """What it costs every customer's portfolio to buy a tenth more of what it holds."""
    trades = tb.books(spark, sf).withColumn("u", F.col("h") / 10)
    cost = t.transaction_cost(trades, tb.supply(spark, sf), 0.0005, 0.7)
    return shown(cost.withColumn("value", F.col("value") + SHIFT), "portfolio_id", "ts", "value", digits=4)


@query("books_leverage", f"""SELECT portfolio_id, CAST(ts AS DATE) AS ts, {r(f'sum(h) * 1.5 + {SHIFT}', 'v', 4)}, {r('1 / 1.5', 'leverage')}, max(h) / (sum(h) * 1.5) <= 0.5 + 1e-9 AS ok FROM tb_books GROUP BY 1, ts""", "tb_books")
def _(spark, sf):
    """Value and leverage of every book, and whether no position is beyond half of it."""
    books = tb.books(spark, sf)
    largest = k.chk_max_weights(a.weights(books), 0.5).groupBy("portfolio_id", "ts").agg(F.min("ok").alias("ok"))
    out = a.nav(books).join(largest, ["portfolio_id", "ts"])
    return shown(out.withColumn("v", F.col("v") + SHIFT).withColumn("v", rnd("v", 4)), "portfolio_id", "ts", "v", "leverage", "ok")


BOOK_PATH = "SELECT *, lead(v) OVER (PARTITION BY portfolio_id ORDER BY ts) / v - 1 AS ret FROM (SELECT portfolio_id, ts, sum(h) * 1.5 AS v FROM tb_books GROUP BY 1, 2)"


@query("books_growth", f"SELECT portfolio_id, count(*) AS periods, {r('avg(ret)', 'mean', 6)}, {r('exp(sum(ln(1 + ret))) - 1', 'total', 6)}, {r(f'arg_max(v, ts) - arg_min(v, ts) + {SHIFT}', 'profit', 3)} FROM ({BOOK_PATH}) GROUP BY 1", "tb_books")
def _(spark, sf):
    """Returns of all customers' portfolios in one pass by portfolio."""
    navs = a.nav(tb.books(spark, sf))
    path = a.returns(navs).groupBy("portfolio_id").agg(F.count("*").alias("periods"), F.avg("ret").alias("mean"), (F.exp(F.sum("growth")) - 1).alias("total"))
    gain = a.profit(navs).select("portfolio_id", rnd(F.col("profit") + SHIFT, 3).alias("profit"))
    return path.join(gain, "portfolio_id").select("portfolio_id", "periods", rnd("mean", 6).alias("mean"), rnd("total", 6).alias("total"), "profit")
