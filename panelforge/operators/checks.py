"""Compliance checks: who breaks which rule, when, and by how much.

Every check returns ``(portfolio_id, ts, symbol, name, lhs, op, rhs, slack, ok)``; ``symbol`` is null for rules on a whole book.
What cannot be checked, since a volume, value or exposure is missing, has a null ``ok`` and counts as a violation.
Weights tables are ``(portfolio_id, ts, symbol, is_cash, w)`` after trading; trade weights have ``z``; values ``(portfolio_id, ts, v)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import divided, param_lookup
from .terms import _beside, loads_of

BOOK = ["portfolio_id", "ts"]
Limit = DataFrame | float


def check(df: DataFrame, name: str, lhs: Column, op: str, rhs: Column, tol: float = 1e-9) -> DataFrame:
    """The common last step: slack is how far inside the limit (negative: outside) a row is; equalities allow ``tol``."""
    gap = rhs - lhs
    slack = {"<=": gap, ">=": -gap, "=": -F.abs(gap)}[op]
    symbol = F.col("symbol") if "symbol" in df.columns else F.lit(None).cast("string")
    out = df.select(*BOOK, symbol.alias("symbol"), F.lit(name).alias("name"), lhs.cast("double").alias("lhs"), F.lit(op).alias("op"), rhs.cast("double").alias("rhs"), slack.alias("slack"))
    return out.withColumn("ok", F.col("slack") >= -tol)


def violations(checks: DataFrame) -> DataFrame:
    """Rows that break their limit, or of which it is not known."""
    return checks.where("not coalesce(ok, false)")


def _each(df: DataFrame, name: str, column: str, op: str, limit: Limit, asof: bool = False, cash: bool = False) -> DataFrame:
    """A limit on every row, cash apart; rows without a limit (a table that lists only some) are not checked."""
    own = param_lookup(df if cash else df.where("not is_cash"), limit, "limit", asof).where("limit is not null")
    return check(own, name, F.col(column), op, F.col("limit"))


def _book(df: DataFrame, name: str, total: Column, op: str, limit: Limit) -> DataFrame:
    """A limit on an aggregate of every book."""
    own = df.groupBy(*BOOK).agg(total.alias("total"))
    own = param_lookup(own, limit, "limit").where("limit is not null")
    return check(own, name, F.col("total"), op, F.col("limit"))


def _cash_weight() -> Column:
    """The cash weight; null for a book without a cash row."""
    return F.when(F.count_if(F.col("is_cash") & F.col("w").isNull()) == 0, F.sum(F.when(F.col("is_cash"), F.col("w"))))


def _gross(column: str) -> Column:
    """Gross size of all but cash; null if one is unknown, 0 for a book of cash alone."""
    unknown = F.count_if(~F.col("is_cash") & F.col(column).isNull())
    return F.when(unknown == 0, F.coalesce(F.sum(F.when(~F.col("is_cash"), F.abs(column))), F.lit(0.0)))


def _over_value(limit: float, values: DataFrame, df: DataFrame) -> DataFrame:
    return df.join(values, BOOK, "left").withColumn("limit", divided(F.lit(limit), F.col("v")))


def chk_long_only(weights: DataFrame, cash: bool = False) -> DataFrame:
    return _each(weights, "long only", "w", ">=", 0.0, cash=cash)


def chk_fixed_imbalance(weights: DataFrame, imbalance: Limit, name: str = "fixed imbalance") -> DataFrame:
    """Weights without cash sum to ``imbalance``, so cash is one less that."""
    own = param_lookup(weights.groupBy(*BOOK).agg(_cash_weight().alias("total")), imbalance, "limit")
    return check(own, name, F.col("total"), "=", 1 - F.col("limit"))


def chk_no_cash(weights: DataFrame) -> DataFrame:
    return chk_fixed_imbalance(weights, 1.0, "no cash")


def chk_dollar_neutral(weights: DataFrame) -> DataFrame:
    return chk_fixed_imbalance(weights, 0.0, "dollar neutral")


def chk_min_cash(weights: DataFrame, values: DataFrame, least: float) -> DataFrame:
    """Cash of at least ``least`` in currency."""
    own = _over_value(least, values, weights.groupBy(*BOOK).agg(_cash_weight().alias("total")))
    return check(own, "min cash", F.col("total"), ">=", F.col("limit"))


def chk_long_cash(weights: DataFrame, values: DataFrame) -> DataFrame:
    return chk_min_cash(weights, values, 0.0)


def chk_leverage(weights: DataFrame, limit: Limit) -> DataFrame:
    return _book(weights, "leverage", _gross("w"), "<=", limit)


def chk_turnover(trades: DataFrame, limit: Limit) -> DataFrame:
    """Half the gross trade weight, cash apart."""
    return _book(trades, "turnover", _gross("z") / 2, "<=", limit)


def chk_participation(trades: DataFrame, values: DataFrame, volumes: DataFrame, share: float) -> DataFrame:
    """v |z| is at most ``share`` of the mean value volume ``(ts, symbol, mean_volume)``; no trade needs no volume."""
    own = trades.where("not is_cash").join(values, BOOK, "left").join(volumes.select("ts", "symbol", "mean_volume"), ["ts", "symbol"], "left")
    out = check(own, "participation", F.col("v") * F.abs("z"), "<=", share * F.col("mean_volume"))
    return out.withColumn("ok", F.when(F.col("lhs") == 0, True).otherwise(F.col("ok")))


def chk_max_weights(weights: DataFrame, limit: Limit) -> DataFrame:
    return _each(weights, "max weight", "w", "<=", limit)


def chk_min_weights(weights: DataFrame, limit: Limit) -> DataFrame:
    return _each(weights, "min weight", "w", ">=", limit)


def chk_max_trade_weights(trades: DataFrame, limit: Limit) -> DataFrame:
    return _each(trades, "max trade weight", "z", "<=", limit)


def chk_min_trade_weights(trades: DataFrame, limit: Limit) -> DataFrame:
    return _each(trades, "min trade weight", "z", ">=", limit)


def _value_limit(df: DataFrame, values: DataFrame, name: str, column: str, op: str, limit: float) -> DataFrame:
    own = _over_value(limit, values, df.where("not is_cash"))
    return check(own, name, F.col(column), op, F.col("limit"))


def chk_max_trades(trades: DataFrame, values: DataFrame, limit: float) -> DataFrame:
    return _value_limit(trades, values, "max trade", "z", "<=", limit)


def chk_min_trades(trades: DataFrame, values: DataFrame, limit: float) -> DataFrame:
    return _value_limit(trades, values, "min trade", "z", ">=", limit)


def chk_max_holdings(weights: DataFrame, values: DataFrame, limit: float) -> DataFrame:
    return _value_limit(weights, values, "max holding", "w", "<=", limit)


def chk_min_holdings(weights: DataFrame, values: DataFrame, limit: float) -> DataFrame:
    return _value_limit(weights, values, "min holding", "w", ">=", limit)


def _deviation(weights: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Symbols of the book and of the benchmark, each with its deviation; null where a weight, or the time's benchmark, is unknown."""
    return _beside(weights, benchmark).select(*BOOK, "symbol", F.lit(False).alias("is_cash"), F.col("w").alias("dev"))


def chk_max_bm_deviation(weights: DataFrame, benchmark: DataFrame, limit: Limit) -> DataFrame:
    return _each(_deviation(weights, benchmark), "max benchmark deviation", "dev", "<=", limit)


def chk_min_bm_deviation(weights: DataFrame, benchmark: DataFrame, limit: Limit) -> DataFrame:
    return _each(_deviation(weights, benchmark), "min benchmark deviation", "dev", ">=", limit)


def _factor(weights: DataFrame, exposures: DataFrame, name: str, op: str, limits: DataFrame | float, gross: bool = False) -> DataFrame:
    """Exposure of each book to each factor of ``exposures(ts?, factor, symbol, f)``; the factor stands in ``symbol``.

    A held symbol without any exposure makes all of its book's exposures unknown, and adds a row without a factor. Factors without a limit are not checked.
    """
    own = loads_of(weights.where("not is_cash"), exposures, F.abs("w") if gross else F.col("w"))
    lost = F.max(F.col("factor").isNull()).over(Window.partitionBy(*BOOK))
    own = own.withColumn("lost", lost).withColumn("y", F.when(~F.col("lost"), F.col("y")))
    if isinstance(limits, DataFrame):
        own = own.join(limits, "factor", "left").where("limit is not null or factor is null")
    else:
        own = own.withColumn("limit", F.lit(float(limits)))
    return check(own.withColumnRenamed("factor", "symbol"), name, F.col("y"), op, F.col("limit"))


def chk_factor_max(weights: DataFrame, exposures: DataFrame, limits: DataFrame | float) -> DataFrame:
    return _factor(weights, exposures, "max factor", "<=", limits)


def chk_factor_min(weights: DataFrame, exposures: DataFrame, limits: DataFrame | float) -> DataFrame:
    return _factor(weights, exposures, "min factor", ">=", limits)


def chk_factor_gross(weights: DataFrame, exposures: DataFrame, limits: DataFrame | float) -> DataFrame:
    """f' |w|; exposures are not negative."""
    return _factor(weights, exposures, "gross factor", "<=", limits, gross=True)


def chk_fixed_factor(weights: DataFrame, exposures: DataFrame, targets: DataFrame | float) -> DataFrame:
    return _factor(weights, exposures, "fixed factor", "=", targets)


def chk_factor_neutral(weights: DataFrame, exposures: DataFrame) -> DataFrame:
    return _factor(weights, exposures, "factor neutral", "=", 0.0)


def chk_market_neutral(weights: DataFrame, benchmark: DataFrame, cov: DataFrame) -> DataFrame:
    """w_b' S w = 0: the benchmark's covariances ``(sym_i, sym_j, value)``, i <= j, become one exposure per symbol; pairs are not forced into a broadcast.

    A symbol that lacks a covariance with one of the benchmark's has no known exposure. Times without a benchmark are not checked.
    """
    both = cov.select("sym_i", "sym_j", "value").union(cov.where("sym_i <> sym_j").select("sym_j", "sym_i", "value"))
    held = benchmark.where("w <> 0")
    beta = held.select("ts", F.col("symbol").alias("sym_i"), "w").join(both, "sym_i").groupBy("ts", F.col("sym_j").alias("symbol")).agg(F.sum(F.col("w") * F.col("value")).alias("f"), F.count("value").alias("k"))
    whole = held.groupBy("ts").agg(F.count("*").alias("n"))
    beta = beta.join(F.broadcast(whole), "ts").select("ts", "symbol", F.when(F.col("k") == F.col("n"), F.col("f")).alias("f"))
    return _factor(weights.join(F.broadcast(whole), "ts", "left_semi"), beta.withColumn("factor", F.lit("market")), "market neutral", "=", 0.0)


def chk_no_trade(trades: DataFrame, asset: str, times: DataFrame) -> DataFrame:
    own = trades.where(F.col("symbol") == asset).join(F.broadcast(times.select("ts").distinct()), "ts", "left_semi")
    return check(own, "no trade", F.col("z"), "=", F.lit(0.0))


def chk_weights_at_times(weights: DataFrame, limit: float, times: DataFrame, op: str = "<=") -> DataFrame:
    """A weight limit that holds at listed times alone."""
    own = weights.where("not is_cash").join(F.broadcast(times.select("ts").distinct()), "ts", "left_semi")
    return check(own, "weight at times", F.col("w"), op, F.lit(limit))


def chk_cost_limit(term: DataFrame, limit: Limit) -> DataFrame:
    """Any term ``(portfolio_id, ts, value)`` is at most ``limit`` (a number or ``(ts, v)``)."""
    return check(param_lookup(term, limit, "limit").where("limit is not null"), "cost limit", F.col("value"), "<=", F.col("limit"))
