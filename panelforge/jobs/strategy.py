"""The flagship job: from line items to a performance report of a long-short strategy on past mean returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analytics, forecasts, weights
from ..operators.panel import add_cash, with_cash_rows
from ..schemas import CASH
from . import testbeds as tb


def strategy_report(spark: SparkSession, sf_dir: str, longs: int = 5, shorts: int = 5, leverage: float = 0.02) -> DataFrame:
    """One row per look-back: annualised return, volatility, Sharpe ratio and worst drawdown of ranking brands by trailing means.

    A portfolio that loses everything in a period is ``bankrupt``; its path ends with that period.
    """
    panel = tb.panel(spark, sf_dir)
    everything = with_cash_rows(panel, add_cash(panel, tb.rates(spark, sf_dir), 12.0)).select("ts", "symbol", "ret")
    signals = panel.select("symbol", "ts", "ret")
    names = {f"look-back {days} days": days for days in (180, 365, 730)}
    for name, days in names.items():  # frames of one window: one exchange by symbol for all look-backs
        signals = forecasts.mean_return(signals, name=name, rolling=days * 86_400.0)
    long = signals.unpivot(["ts", "symbol"], [*names], "portfolio_id", "signal")
    books = weights.w_rank_long_short(long, longs, shorts, leverage, by=["portfolio_id", "ts"])
    cash = F.max(F.when(F.col("symbol") == CASH, F.col("ret")))
    period = books.join(everything, ["ts", "symbol"]).groupBy("portfolio_id", "ts").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("r"), cash.alias("cash_ret"))
    before = Window.partitionBy("portfolio_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    solvent = period.withColumn("least", F.min("r").over(before)).where("least is null or least > -1")
    growth = F.exp(F.coalesce(F.sum(F.log1p("r")).over(before), F.lit(0.0)))
    navs = solvent.select("portfolio_id", "ts", "r", "cash_ret", F.lit(None).cast("double").alias("bm_ret"), growth.alias("v"))
    path = analytics.drawdown(analytics.relative_returns(navs))
    report = analytics.summary(path, periods=F.count("*"), min_drawdown=F.min("drawdown"), bankrupt=F.max(F.col("r") <= -1))
    return report.select("portfolio_id", "periods", "bankrupt", "min_drawdown", "ann_ret", "ann_vol_ret", "sharpe").orderBy("portfolio_id")
