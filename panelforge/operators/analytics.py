"""Results of many portfolios at once: value, weights, returns, risk-adjusted figures, reports and rankings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import DAY, YEAR_DAYS, asof_join, divided
from .terms import strict_sum

BOOK = ["portfolio_id", "ts"]
TINY = 1e-8


def _path() -> Window:
    return Window.partitionBy("portfolio_id").orderBy("ts")


def _gross(x: str) -> Column:
    """Gross size of all but cash; null if one is unknown."""
    return F.when(F.count_if(~F.col("is_cash") & F.col(x).isNull()) == 0, F.sum(F.when(~F.col("is_cash"), F.abs(x))))


def _value() -> Column:
    """A book's value beside its rows; null if a holding is unknown."""
    own = Window.partitionBy(*BOOK)
    return F.when(F.count_if(F.col("h").isNull()).over(own) == 0, F.sum("h").over(own))


def nav(holdings: DataFrame) -> DataFrame:
    """``(portfolio_id, ts, v, leverage)``: value, and gross assets over it; one aggregation for both. Null where a holding is unknown."""
    out = holdings.groupBy(*BOOK).agg(strict_sum(F.col("h")).alias("v"), _gross("h").alias("gross"))
    return out.select(*BOOK, "v", divided(F.col("gross"), F.col("v")).alias("leverage"))


def profit(navs: DataFrame) -> DataFrame:
    """Initial and final value, and their difference."""
    ends = navs.groupBy("portfolio_id").agg(F.min_by("v", "ts").alias("initial"), F.max_by("v", "ts").alias("final"))
    return ends.withColumn("profit", F.col("final") - F.col("initial"))


def weights(holdings: DataFrame) -> DataFrame:
    return holdings.withColumn("w", divided(F.col("h"), _value()))


def post_trade(holdings: DataFrame, trades: DataFrame) -> DataFrame:
    """``(…, h_plus, w_plus, z)`` where there are trades."""
    own = weights(holdings).withColumn("v", _value())
    own = own.join(trades.select(*BOOK, "symbol", "u"), [*BOOK, "symbol"]).withColumn("h_plus", F.col("h") + F.col("u"))
    return own.select(*BOOK, "symbol", "is_cash", "h_plus", divided(F.col("h_plus"), F.col("v")).alias("w_plus"), divided(F.col("u"), F.col("v")).alias("z"))


def turnover(trades: DataFrame, navs: DataFrame) -> DataFrame:
    """``(portfolio_id, ts, turnover)``: gross trades (cash apart) over twice the value."""
    gross = trades.groupBy(*BOOK).agg(_gross("u").alias("gross"))
    return gross.join(navs.select(*BOOK, "v"), BOOK).select(*BOOK, divided(F.col("gross"), 2 * F.col("v")).alias("turnover"))


def returns(navs: DataFrame) -> DataFrame:
    """Adds ``ret``, from each time to the next, and ``growth``, its logarithm."""
    out = navs.withColumn("ret", divided(F.lead("v").over(_path()), F.col("v")) - 1)
    return out.withColumn("growth", F.log1p("ret"))


def relative_returns(navs: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """:func:`returns` with excess and active ones, against ``cash_ret`` and ``bm_ret`` of ``periods`` (without: of ``navs``)."""
    own = returns(navs)
    if periods is not None:
        own = own.join(periods.select(*BOOK, "cash_ret", "bm_ret"), BOOK, "left")
    excess, active = F.col("ret") - F.col("cash_ret"), F.col("ret") - F.col("bm_ret")
    return own.withColumns({"excess": excess, "active": active}).withColumns({"excess_growth": F.log1p("excess"), "active_growth": F.log1p("active")})


def drawdown(navs: DataFrame) -> DataFrame:
    """Adds ``drawdown``: value over its running maximum, less one (never above 0)."""
    top = F.max("v").over(_path().rowsBetween(Window.unboundedPreceding, 0))
    return navs.withColumn("drawdown", divided(F.col("v"), top) - 1)


def _ppy() -> Column:
    """Rows per year of a group."""
    years = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / (1e6 * DAY * YEAR_DAYS)
    return F.rint(divided(F.count("*").cast("double"), years))


SERIES = ("ret", "growth", "excess", "excess_growth", "active", "active_growth")


def summary(relative: DataFrame, **more: Column) -> DataFrame:
    """One row per portfolio: averages, annualised averages, volatilities (population), quadratic risks, Sharpe and information ratio.

    All aggregates, and those in ``more`` by their names, come from one pass over :func:`relative_returns`.
    """
    aggregates = [_ppy().alias("ppy"), *(c.alias(k) for k, c in more.items())]
    for c in SERIES:
        aggregates.append(F.avg(c).alias(f"avg_{c}"))
    for c in ("ret", "excess", "active"):
        aggregates += [F.stddev_pop(c).alias(f"vol_{c}"), F.avg(F.col(c) * F.col(c)).alias(f"quad_{c}")]
    out = relative.groupBy("portfolio_id").agg(*aggregates)
    out = out.withColumns({f"ann_{c}": F.col(f"avg_{c}") * F.col("ppy") for c in SERIES})
    out = out.withColumns({f"ann_vol_{c}": F.col(f"vol_{c}") * F.sqrt("ppy") for c in ("ret", "excess", "active")})
    ratio = lambda c: F.col(f"ann_{c}") / (F.col(f"ann_vol_{c}") + TINY)
    return out.withColumns({"sharpe": ratio("excess"), "information_ratio": ratio("active")})


def cost_bp(costs: DataFrame, navs: DataFrame) -> DataFrame:
    """Average and largest cost in basis points of value, per portfolio and cost name."""
    bp = divided(F.col("value"), F.col("v")) * 1e4
    return costs.join(navs.select(*BOOK, "v"), BOOK).groupBy("portfolio_id", "cost").agg(F.avg(bp).alias("avg_bp"), F.max(bp).alias("max_bp"))


def period_stats(navs: DataFrame, turnovers: DataFrame, times: DataFrame) -> DataFrame:
    """Average and largest leverage and turnover, average and total run times ``(portfolio_id, ts, policy_s, simulator_s)``."""
    own = navs.join(turnovers, BOOK, "left").join(times, BOOK, "left").groupBy("portfolio_id")
    return own.agg(
        F.avg("leverage").alias("avg_leverage"), F.max("leverage").alias("max_leverage"), F.avg("turnover").alias("avg_turnover"), F.max("turnover").alias("max_turnover"),
        F.avg("policy_s").alias("avg_policy_s"), F.avg("simulator_s").alias("avg_simulator_s"), F.sum(F.col("policy_s") + F.col("simulator_s")).alias("total_s"),
    )


def result_report(holdings: DataFrame, trades: DataFrame, periods: DataFrame, costs: DataFrame | None = None, cost_names: Sequence[str] = (), times: DataFrame | None = None) -> DataFrame:
    """One row per portfolio with everything above; active columns are null without a benchmark.

    ``costs(portfolio_id, ts, cost, value)`` add, for each of ``cost_names``, average and largest cost in basis points of value as
    ``avg_bp_<cost>`` and ``max_bp_<cost>``; ``times(portfolio_id, ts, policy_s, simulator_s)`` add average and total run times.
    Holdings, trades and costs are summed to (portfolio, time) once each; the rest works on those small rows, by portfolio, in one pass.
    """
    navs = nav(holdings)
    rel = drawdown(relative_returns(navs, periods)).join(turnover(trades, navs), BOOK, "left")
    more: dict[str, Column] = {}
    if costs is not None:
        each = {f"cost_{n}": F.sum(F.when(F.col("cost") == n, F.col("value"))) for n in cost_names}
        rel = rel.join(costs.groupBy(*BOOK).agg(*(s.alias(n) for n, s in each.items())), BOOK, "left")
        for n in cost_names:
            bp = divided(F.col(f"cost_{n}"), F.col("v")) * 1e4
            more |= {f"avg_bp_{n}": F.avg(bp), f"max_bp_{n}": F.max(bp)}
    if times is not None:
        rel = rel.join(times.select(*BOOK, "policy_s", "simulator_s"), BOOK, "left")
        more |= {"avg_policy_s": F.avg("policy_s"), "avg_simulator_s": F.avg("simulator_s"), "total_s": F.sum(F.col("policy_s") + F.col("simulator_s"))}
    out = summary(
        rel, periods=F.count("*"), first=F.min("ts"), last=F.max("ts"), initial=F.min_by("v", "ts"), final=F.max_by("v", "ts"),
        avg_drawdown=F.avg("drawdown"), min_drawdown=F.min("drawdown"), avg_leverage=F.avg("leverage"), max_leverage=F.max("leverage"),
        avg_turnover=F.avg("turnover"), max_turnover=F.max("turnover"), **more,
    )
    return out.withColumn("profit", F.col("final") - F.col("initial"))


def top_weights(weighted: DataFrame, k: int = 7) -> DataFrame:
    """The ``k`` symbols with the largest mean absolute weight of each portfolio; ties by symbol."""
    means = weighted.groupBy("portfolio_id", "symbol").agg(F.avg(F.abs("w")).alias("mean_abs"))
    rank = F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.col("mean_abs").desc(), "symbol"))
    return means.withColumn("rank", rank).where(F.col("rank") <= k)


def leaderboard(report: DataFrame, metrics: Sequence[str], k: int = 1) -> DataFrame:
    """``(metric, rank, portfolio_id, value)``: the best ``k`` portfolios by each metric; ties by name."""
    long = report.unpivot("portfolio_id", [*metrics], "metric", "value").where("value is not null")
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.col("value").desc(), "portfolio_id"))
    return long.withColumn("rank", rank).where(F.col("rank") <= k).select("metric", "rank", "portfolio_id", "value")


def parameter_grid(spark, **ranges: Sequence[float]) -> DataFrame:
    """Every combination of the listed values, one column per name."""
    columns = [spark.createDataFrame([(float(x),) for x in v], f"{k} double") for k, v in ranges.items()]
    return reduce(DataFrame.crossJoin, columns)  # a grid is the product, and as small as its lists


def ladder(spark, name: str, spacing: float, low: int, high: int) -> DataFrame:
    """spacing^k for whole k in [low, high]."""
    return spark.range(low, high + 1).select(F.pow(F.lit(spacing), F.col("id").cast("double")).alias(name))


def neighbours(tried: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Points of whole-number coordinates one step from a tried one in one coordinate, and not tried."""
    moves = [F.array(*(F.struct(*(F.col(c) + (d if c == s else 0) for c in steps)) for d in (-1, 1))) for s in steps]
    near = tried.select(F.explode(F.flatten(F.array(*moves))).alias("p"))
    near = near.select(*(F.col("p")[f].cast("long").alias(c) for f, c in zip(near.schema["p"].dataType.names, steps))).distinct()
    return near.join(tried.select(*(F.col(c).cast("long").alias(c) for c in steps)), [*steps], "left_anti")


def efficient_frontier(relative: DataFrame, periods: float = 12.0) -> DataFrame:
    """Annualised mean and sample deviation of excess returns per portfolio."""
    return relative.groupBy("portfolio_id").agg((F.avg("excess") * periods).alias("mean"), (F.stddev_samp("excess") * periods**0.5).alias("risk"))


def active_table(relative: DataFrame, costs: DataFrame, turnovers: DataFrame, labels: DataFrame, periods: float = 250.0) -> DataFrame:
    """Per (size, frequency) of ``labels(portfolio_id, size, frequency)``: active return and risk in percent, cost, turnover."""
    total = costs.groupBy(*BOOK).agg(F.sum("value").alias("cost"))
    own = relative.join(total, BOOK, "left").join(turnovers, BOOK, "left").join(labels, "portfolio_id")
    return own.groupBy("size", "frequency").agg(
        (100 * periods * F.avg("active")).alias("active_return"), (100 * periods**0.5 * F.stddev_pop("active")).alias("active_risk"),
        (100 * periods * F.avg(divided(F.col("cost"), F.col("v")))).alias("cost"), (100 * periods * F.avg("turnover")).alias("turnover"),
    )


def pivot_active(table: DataFrame, metric: str, frequencies: Sequence[str]) -> DataFrame:
    """One row per size, one column per frequency."""
    return table.groupBy("size").pivot("frequency", [*frequencies]).agg(F.first(metric))


def return_correlation(relative: DataFrame) -> DataFrame:
    return relative.groupBy("portfolio_id").agg(F.corr("ret", "bm_ret").alias("correlation"))


def strategy_vs_index(navs: DataFrame, index: DataFrame) -> DataFrame:
    """Log growth of each portfolio beside the index ``(ts, growth)`` at common times, with running sums."""
    own = returns(navs).select(*BOOK, "growth").join(F.broadcast(index.select("ts", F.col("growth").alias("index_growth"))), "ts").where("growth is not null")
    sofar = _path().rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumns({"curve": F.sum("growth").over(sofar), "index_curve": F.sum("index_growth").over(sofar)})


def reconcile_holdings(days: DataFrame, targets: DataFrame, universe: DataFrame) -> DataFrame:
    """The latest target at or before each day, on the day's universe: absent weights are 0, cash is what is left.

    ``days(ts)``, ``targets(ts, symbol, w)``, ``universe(ts, symbol)``; returns ``(ts, symbol, w)`` with a cash row. With a ``portfolio_id`` in
    ``targets`` every portfolio has its own targets on every day.
    """
    by = [c for c in ("portfolio_id",) if c in targets.columns]
    snaps = targets.select(*by, F.col("ts").alias("snap")).distinct().withColumn("ts", F.col("snap"))
    dates = days.select("ts").distinct()
    if by:  # as many rows as the answer has cash rows
        dates = targets.select(*by).distinct().join(F.broadcast(dates))
    picked = asof_join(dates, snaps, ["snap"], by=by)
    wanted = universe.join(picked, "ts").join(targets.select(*by, F.col("ts").alias("snap"), "symbol", "w"), [*by, "snap", "symbol"], "left")
    own = wanted.select(*by, "ts", "symbol", F.coalesce("w", F.lit(0.0)).alias("w"))
    return own.unionByName(own.groupBy(*by, "ts").agg((1 - F.sum("w")).alias("w")).select(*by, "ts", F.lit("cash").alias("symbol"), "w"))
