"""Cost and risk terms over weight, trade and holding tables: one row per (portfolio, time). Cash rows carry ``is_cash``.

What a position needs and does not find (a row or a value of the market, a forecast, a covariance, an exposure) makes its book's value
null, never smaller; positions of zero need nothing. :func:`missing_inputs` lists what is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import DAY, YEAR_DAYS, divided, param_lookup, resample_return
from ..schemas import CASH

BOOK = ("portfolio_id", "ts")


def strict_sum(value: Column) -> Column:
    """The sum, or null where any summand is."""
    return F.when(F.count(value) == F.count("*"), F.sum(value))


def _sum(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(*BOOK).agg(strict_sum(value).alias(name))


def _of(size: Column | str, value: Column) -> Column:
    """The value of a position; a position of zero is worth 0 whatever is unknown about it."""
    return F.when((F.col(size) if isinstance(size, str) else size) == 0, 0.0).otherwise(value)


def missing_inputs(positions: DataFrame, inputs: DataFrame, columns: Sequence[str], size: str = "w") -> DataFrame:
    """Rows ``(portfolio_id, ts, symbol, input)``: what positions other than zero need of ``inputs(ts, symbol, …)`` and do not find. Cash needs nothing."""
    own = _assets(positions).where(F.coalesce(F.col(size) != 0, F.lit(True)))
    found = own.join(inputs.select("ts", "symbol", *(F.col(c).alias(f"input_{c}") for c in columns)), ["ts", "symbol"], "left")
    gone = F.array(*(F.when(F.col(f"input_{c}").isNull(), F.lit(c)) for c in columns))
    return found.select(*BOOK, "symbol", F.explode(F.array_compact(gone)).alias("input"))


def _assets(df: DataFrame) -> DataFrame:
    return df.where("not is_cash") if "is_cash" in df.columns else df


def _beside(df: DataFrame, benchmark: DataFrame | None) -> DataFrame:
    """Weights less the benchmark's ``(ts, symbol, w)``; symbols of either side are kept, once each. Cash rows are left out.

    Unknown on either side, and all of a book whose time has no benchmark, is null.
    """
    own = _assets(df).select(*BOOK, "symbol", "w")
    if benchmark is None:
        return own.groupBy(*BOOK, "symbol").agg(strict_sum(F.col("w")).alias("w"))
    other = benchmark.where(F.col("symbol") != CASH).select("ts", "symbol", (-F.col("w")).alias("w"))
    both = own.unionByName(own.select(*BOOK).distinct().join(other, "ts").select(*BOOK, "symbol", "w")).groupBy(*BOOK, "symbol").agg(strict_sum(F.col("w")).alias("w"))
    dated = benchmark.select("ts", F.lit(True).alias("dated")).distinct()
    return both.join(dated, "ts", "left").select(*BOOK, "symbol", F.when(F.col("dated"), F.col("w")).alias("w"))


def transaction_cost(trades: DataFrame, market: DataFrame, a: float | DataFrame = 0.0, b: float | None = None, c: float = 0.0, exponent: float = 1.5, per_share: float = 0.0) -> DataFrame:
    """``a |u| + b sigma |u|^p / V^(p-1) + c u`` summed per book.

    ``market(ts, symbol, sigma, valuevolume, price)`` holds forecasts or realised values; ``per_share`` adds per_share / price to
    ``a``; ``a`` may be a parameter table.
    """
    own = param_lookup(_assets(trades), a, "a").join(market, ["ts", "symbol"], "left")
    size = F.abs("u")
    spread = F.col("a") + (divided(F.lit(per_share), F.col("price")) if per_share else F.lit(0.0))
    cost = spread * size + c * F.col("u")
    if b:
        cost = cost + b * F.col("sigma") * F.pow(size, F.lit(exponent)) / F.pow(F.col("valuevolume") + 1e-8, F.lit(exponent - 1))
    return _sum(own, _of("u", cost))


def stocks_transaction_cost(trades: DataFrame, market: DataFrame, a: float | DataFrame = 0.0, per_share: float = 0.005, b: float = 1.0, **how) -> DataFrame:
    return transaction_cost(trades, market, a, b, per_share=per_share, **how)


def period_lengths(times: DataFrame) -> DataFrame:
    """``(ts, periods)``: how many periods of each time's length a year has, by the days to the next time."""
    nxt = F.lead("ts").over(Window.orderBy("ts"))
    days = (F.unix_micros(nxt) - F.unix_micros("ts")) / (1e6 * DAY)
    return times.select("ts").distinct().select("ts", divided(F.lit(YEAR_DAYS), days).alias("periods"))


def holding_cost(holdings: DataFrame, periods: DataFrame | float, short_fee: float = 0.0, long_fee: float = 0.0, dividends: float = 0.0) -> DataFrame:
    """Annual percent fees on shorts and longs per period, less dividends per period, on post-trade holdings ``h``.

    ``periods`` is the number of periods per year, or a table ``(ts, periods)`` of each time's own.
    """
    own = _assets(holdings)
    own = own.withColumn("periods", F.lit(float(periods))) if not isinstance(periods, DataFrame) else own.join(F.broadcast(periods), "ts", "left")
    fee = lambda percent: resample_return(F.lit(percent / 100), F.col("periods"))
    h = F.col("h")
    return _sum(own, _of(h, fee(short_fee) * F.greatest(-h, F.lit(0.0)) + fee(long_fee) * F.greatest(h, F.lit(0.0)) - dividends * h))


def stocks_holding_cost(holdings: DataFrame, periods: DataFrame | float, short_fee: float = 5.0) -> DataFrame:
    return holding_cost(holdings, periods, short_fee)


def stress_spread_cost(trades: DataFrame, returns: DataFrame, spread: float, threshold: float, factor: float) -> DataFrame:
    """spread |u|, times ``factor`` where the last returns' cross-section is wider than ``threshold``; null where that width is not known."""
    wide = returns.groupBy("ts").agg(F.stddev_samp("ret").alias("sd"))
    wide = wide.select("ts", F.lag("sd").over(Window.orderBy("ts")).alias("sd"))
    own = _assets(trades).join(F.broadcast(wide), "ts", "left")
    times = F.when(F.col("sd") > threshold, factor).when(F.col("sd").isNotNull(), 1.0)
    return _sum(own, _of("u", spread * times * F.abs("u")))


def custom_cost(table: DataFrame, fn: Callable[[DataFrame], Column]) -> DataFrame:
    """A user's cost of a row, as an expression of its columns, summed per book."""
    return _sum(table, fn(table))


def _with(own: DataFrame, inputs: DataFrame, value: str, name: str) -> DataFrame:
    """Positions with an input of their time and symbol, if there is one."""
    return own.join(inputs.select("ts", "symbol", F.col(value).alias(name)), ["ts", "symbol"], "left")


def returns_forecast(weights: DataFrame, forecast: DataFrame) -> DataFrame:
    """w * forecast, ``forecast(ts, symbol, value)``."""
    return _sum(_with(_assets(weights), forecast, "value", "f"), _of("w", F.col("w") * F.col("f")))


def returns_error(weights: DataFrame, errors: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """delta |w - w_b|, ``errors(ts, symbol, value)``."""
    return _sum(_with(_beside(weights, benchmark), errors, "value", "d"), _of("w", F.abs("w") * F.col("d")))


def cash_return(weights: DataFrame, forecast: DataFrame) -> DataFrame:
    """w_cash * cash forecast ``(ts, forecast)``; null without a forecast."""
    return weights.where("is_cash").join(F.broadcast(forecast.select("ts", "forecast")), "ts", "left").select(*BOOK, (F.col("w") * F.col("forecast")).alias("value"))


def risk_full(weights: DataFrame, cov: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """(w - w_b)' S (w - w_b) with ``cov(ts?, sym_i, sym_j, value)``, i <= j. Zero weights leave before the join.

    A book of n symbols needs n (n + 1) / 2 pairs, and its value is null if one is missing. Pairs grow with the square of the symbols, so
    their join is left to the optimiser, which broadcasts them by size alone; for large universes there are :func:`risk_by_matrix`, and
    :func:`risk_factor_model` with n rows a factor.
    """
    everything = _beside(weights, benchmark)
    own = everything.where("w <> 0 or w is null")
    on = ["ts"] if "ts" in cov.columns else []
    a = own.select(*BOOK, F.col("symbol").alias("sym_i"), F.col("w").alias("wi"))
    b = own.select(*BOOK, F.col("symbol").alias("sym_j"), F.col("w").alias("wj"))
    pairs = a.join(cov, [*on, "sym_i"]).join(b, [*BOOK, "sym_j"])
    term = F.when(F.col("sym_i") == F.col("sym_j"), 1.0).otherwise(2.0) * F.col("wi") * F.col("wj") * F.col("value")
    found = pairs.groupBy(*BOOK).agg(F.sum(term).alias("total"), F.count(term).alias("pairs"))
    books = everything.groupBy(*BOOK).agg(F.count_if((F.col("w") != 0) | F.col("w").isNull()).alias("n"))
    whole = F.coalesce("pairs", F.lit(0)) == F.col("n") * (F.col("n") + 1) / 2
    return books.join(found, [*BOOK], "left").select(*BOOK, F.when(whole, F.coalesce("total", F.lit(0.0))).alias("value"))


def risk_by_matrix(weights: DataFrame, cov: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """:func:`risk_full` for many books and large universes, with covariances of every time ``cov(ts, sym_i, sym_j, value)``, i <= j.

    Weights and covariances meet by time as matrices, so books x symbols and symbols squared values are shuffled, not books x symbols squared. A
    time's matrix is one pandas group: up to some thousand symbols. Null under the same rule: a book needs the pairs of its symbols other than zero.
    """
    own = _beside(weights, benchmark).withColumn("w", F.coalesce("w", F.lit(float("nan"))))

    def run(w: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(w):
            return pd.DataFrame({"portfolio_id": [], "ts": [], "value": []})
        wide = w.pivot(index="portfolio_id", columns="symbol", values="w").fillna(0.0)
        unknown = w[w["w"].isna()]["portfolio_id"]
        at = {n: i for i, n in enumerate(wide.columns)}
        s = s[s["sym_i"].isin(at) & s["sym_j"].isin(at) & s["value"].notna()]
        i, j = s["sym_i"].map(at), s["sym_j"].map(at)
        matrix, known = np.zeros((len(at), len(at))), np.zeros((len(at), len(at)))
        matrix[i, j] = matrix[j, i] = s["value"]
        known[i, j] = known[j, i] = 1.0
        x = wide.to_numpy(float)
        held = (x != 0).astype(float)
        value = ((x @ matrix) * x).sum(axis=1)
        gone = ((held @ known) * held).sum(axis=1) < held.sum(axis=1) ** 2
        out = pd.DataFrame({"portfolio_id": wide.index, "ts": w["ts"].iloc[0], "value": value})
        return out.assign(value=out["value"].astype(object).where(~(gone | out["portfolio_id"].isin(unknown)), None))

    pairs = cov.select("ts", "sym_i", "sym_j", "value")
    return own.groupBy("ts").cogroup(pairs.groupBy("ts")).applyInPandas(run, "portfolio_id string, ts timestamp, value double")


def risk_diagonal(weights: DataFrame, variances: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Sum of variance (w - w_b)^2, ``variances(ts, symbol, value)``."""
    return _sum(_with(_beside(weights, benchmark), variances, "value", "s"), _of("w", F.col("w") ** 2 * F.col("s")))


def risk_forecast_error(weights: DataFrame, variances: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """(Sum of sigma |w - w_b|)^2."""
    own = _with(_beside(weights, benchmark), variances, "value", "s")
    return _sum(own, _of("w", F.sqrt("s") * F.abs("w"))).withColumn("value", F.col("value") ** 2)


def loads_of(own: DataFrame, exposures: DataFrame, value: Column) -> DataFrame:
    """``(portfolio_id, ts, factor, y)``: ``value`` times exposure summed by factor, null where an exposure is.

    A symbol without any exposure at its time stands as a row without a factor, null unless its value is 0.
    """
    on = [c for c in ("ts", "symbol") if c in exposures.columns]
    y = strict_sum(F.when(value == 0, 0.0).otherwise(value * F.col("f")))
    return own.join(exposures, on, "left").groupBy(*BOOK, "factor").agg(y.alias("y")).where("factor is not null or y is null")


def risk_factor_model(weights: DataFrame, exposures: DataFrame, idio: DataFrame, factor_cov: DataFrame | None = None, benchmark: DataFrame | None = None) -> DataFrame:
    """||F (w - w_b)||^2 (or with factor covariances) plus sum d (w - w_b)^2.

    ``exposures(ts, factor, symbol, f)`` times weights is summed to (portfolio, time, factor) right after the join. Every symbol needs an
    exposure to one factor at least, and every two factors of a book a covariance.
    """
    own = _beside(weights, benchmark)
    loads = loads_of(own, exposures, F.col("w"))
    if factor_cov is None:
        common = _sum(loads, F.col("y") ** 2, "common")
    else:
        a, b = loads.withColumnsRenamed({"factor": "f1", "y": "y1"}), loads.withColumnsRenamed({"factor": "f2", "y": "y2"})
        pairs = a.join(factor_cov, ["ts", "f1"]).join(b, [*BOOK, "f2"])
        found = pairs.groupBy(*BOOK).agg(F.sum(F.col("y1") * F.col("y2") * F.col("v")).alias("total"), F.count(F.col("y1") * F.col("y2") * F.col("v")).alias("pairs"))
        common = loads.groupBy(*BOOK).agg(F.count("*").alias("n")).join(found, [*BOOK], "left").select(*BOOK, F.when(F.col("pairs") == F.col("n") * F.col("n"), F.col("total")).alias("common"))
    rest = _sum(_with(own, idio, "d", "d"), _of("w", F.col("w") ** 2 * F.col("d")), "rest")
    none = F.col("n").isNull()  # a book of zeros alone has no loads
    out = rest.join(common.withColumn("n", F.lit(1)), [*BOOK], "left")
    return out.select(*BOOK, (F.when(none, 0.0).otherwise(F.col("common")) + F.col("rest")).alias("value"))


def risk_worst_case(*risks: DataFrame) -> DataFrame:
    """The largest of several risk terms per book; null where one is."""
    return reduce(DataFrame.unionByName, risks).groupBy(*BOOK).agg(F.when(F.count("value") == len(risks), F.max("value")).alias("value"))


def objective_value(terms: dict[str, DataFrame], multipliers: dict[str, float]) -> DataFrame:
    """The terms' sum, each times its multiplier; null for a book that lacks one of them."""
    scaled = [t.select(*BOOK, (F.col("value") * multipliers.get(k, 1.0)).alias("value")) for k, t in terms.items()]
    return reduce(DataFrame.unionByName, scaled).groupBy(*BOOK).agg(F.when(F.count("value") == len(terms), F.sum("value")).alias("value"))


def soft_violation(check: DataFrame) -> DataFrame:
    """How far rows of a compliance check are beyond their limits, per book: excess for inequalities, distance for equalities."""
    gap = F.col("lhs") - F.col("rhs")
    excess = F.when(F.col("op") == "=", F.abs(gap)).when(F.col("op") == "<=", F.greatest(gap, F.lit(0.0))).otherwise(F.greatest(-gap, F.lit(0.0)))
    return _sum(check, excess)
