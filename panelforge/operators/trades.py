"""One trading step over every (portfolio, time) row, and wealth curves in closed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import divided
from .terms import strict_sum


def book() -> Window:
    return Window.partitionBy("portfolio_id", "ts")


def self_financing(trades: DataFrame) -> DataFrame:
    """The cash trade pays for all others."""
    others = F.sum(F.when(~F.col("is_cash"), F.col("u"))).over(book())
    return trades.withColumn("u", F.when(F.col("is_cash"), -F.coalesce(others, F.lit(0.0))).otherwise(F.col("u")))


def _market(trades: DataFrame, panel: DataFrame) -> DataFrame:
    """Trades with the value volume and price of their time; cash rows stay out of the join on symbol."""
    own = trades.where("not is_cash").join(panel.select("ts", "symbol", "valuevolume", "price"), ["ts", "symbol"], "left")
    return own.unionByName(trades.where("is_cash"), allowMissingColumns=True).select(*trades.columns, "valuevolume", "price")


def cancel_untraded(marked: DataFrame) -> DataFrame:
    """No trade where nothing was traded (rows of :func:`with_market`)."""
    gone = ~F.col("is_cash") & ~F.coalesce(F.col("valuevolume") > 0, F.lit(False))
    return marked.withColumn("u", F.when(gone, 0.0).otherwise(F.col("u")))


def cap_liquidity(marked: DataFrame, share: float = 0.05) -> DataFrame:
    """A trade is at most ``share`` of the value volume; cash apart."""
    most = share * F.col("valuevolume")
    over = ~F.col("is_cash") & (F.abs("u") > most)
    return marked.withColumn("u", F.when(F.coalesce(over, F.lit(False)), F.signum("u") * most).otherwise(F.col("u")))


def round_to_shares(marked: DataFrame) -> DataFrame:
    """Whole shares, half to even; the residual goes to cash."""
    whole = F.rint(divided(F.col("u"), F.col("price"))) * F.col("price")
    return self_financing(marked.withColumn("u", F.when(F.col("is_cash"), F.col("u")).otherwise(F.coalesce(whole, F.col("u")))))


def reject_small(marked: DataFrame, threshold: float) -> DataFrame:
    """Trades under ``threshold`` are not made."""
    return marked.withColumn("u", F.when(F.abs("u") < threshold, 0.0).otherwise(F.col("u")))


def with_market(trades: DataFrame, panel: DataFrame) -> DataFrame:
    return _market(trades, panel)


def apply_trade_filters(trades: DataFrame, panel: DataFrame, share: float = 0.05, whole_shares: bool = True, smallest: float | None = None) -> DataFrame:
    """Untraded, liquidity, shares, small trades, then cash: in this order, from one join with the market."""
    out = cap_liquidity(cancel_untraded(_market(self_financing(trades), panel)), share)
    if whole_shares:
        out = round_to_shares(out)
    if smallest is not None:
        out = reject_small(out, smallest)
    return self_financing(out).select(*trades.columns)


def step_holdings(holdings: DataFrame, trades: DataFrame, returns: DataFrame, costs: DataFrame) -> DataFrame:
    """Holdings of the next time: (h + u), cash less costs, times 1 + return.

    ``returns(ts, symbol, ret)`` includes cash; ``costs(portfolio_id, ts, value)``. A position or book that the trades or costs do not name has none;
    a trade, cost or return that is null, or a return that is not there, makes the position null, unless it is 0.
    """
    paid = costs.groupBy("portfolio_id", "ts").agg(F.coalesce(strict_sum(F.col("value")), F.lit(float("nan"))).alias("paid"))
    trades = trades.withColumn("u", F.coalesce("u", F.lit(float("nan"))))  # told apart from trades that are not there
    own = holdings.join(trades.select("portfolio_id", "ts", "symbol", "u"), ["portfolio_id", "ts", "symbol"], "left").join(paid, ["portfolio_id", "ts"], "left").join(returns.select("ts", "symbol", "ret"), ["ts", "symbol"], "left")
    after = F.col("h") + F.coalesce("u", F.lit(0.0)) - F.when(F.col("is_cash"), F.coalesce("paid", F.lit(0.0))).otherwise(0.0)
    return own.select(*holdings.columns, F.nullif(F.when(after == 0, 0.0).otherwise(after * (1 + F.col("ret"))), F.lit(float("nan"))).alias("h_next"))


def adjust_universe(holdings: DataFrame, universe: DataFrame) -> DataFrame:
    """``(portfolio_id, ts, symbol, is_cash, h)`` on the time's universe: what left it is cash, what joined it is 0."""
    inside = holdings.where("not is_cash").join(universe, ["ts", "symbol"], "left_semi")
    lost = holdings.where("not is_cash").join(universe, ["ts", "symbol"], "left_anti").groupBy("portfolio_id", "ts").agg(F.sum("h").alias("lost"))
    cash = holdings.where("is_cash").join(lost, ["portfolio_id", "ts"], "left").withColumn("h", F.col("h") + F.coalesce("lost", F.lit(0.0)))
    books = holdings.select("portfolio_id", "ts").distinct()
    new = books.join(universe, "ts").join(holdings, ["portfolio_id", "ts", "symbol"], "left_anti").select("portfolio_id", "ts", "symbol", F.lit(False).alias("is_cash"), F.lit(0.0).alias("h"))
    kept = ["portfolio_id", "ts", "symbol", "is_cash", "h"]
    return inside.select(*kept).unionByName(cash.select(*kept)).unionByName(new)


def is_bankrupt(holdings: DataFrame) -> DataFrame:
    """``(portfolio_id, since)``: the first time a portfolio's value is not above zero."""
    return holdings.groupBy("portfolio_id", "ts").agg(F.sum("h").alias("v")).where("v <= 0").groupBy("portfolio_id").agg(F.min("ts").alias("since"))


def cut_bankrupt(holdings: DataFrame) -> DataFrame:
    """Holdings without what follows a bankruptcy."""
    since = is_bankrupt(holdings)
    return holdings.join(since, "portfolio_id", "left").where("since is null or ts <= since").select(*holdings.columns)


def benchmark_return(weights: DataFrame, returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, ts, bm_ret)``: the sum of weights times returns, cash included; null where a held symbol has no return."""
    own = weights.join(returns.select("ts", "symbol", "ret"), ["ts", "symbol"], "left")
    return own.groupBy(*by, "ts").agg(strict_sum(F.when(F.col("w") == 0, 0.0).otherwise(F.col("w") * F.col("ret"))).alias("bm_ret"))


def _growth(ret: Column | str, *keys: str) -> Column:
    """Product of 1 + return over the rows before each one; null from the first unknown return on."""
    past = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    ret = F.col(ret) if isinstance(ret, str) else ret
    unknown = F.coalesce(F.count_if(ret.isNull()).over(past), F.lit(0))
    return F.when(unknown == 0, F.exp(F.coalesce(F.sum(F.log1p(ret)).over(past), F.lit(0.0))))


def _whole(parts: DataFrame, held: DataFrame, returns: DataFrame, name: str) -> DataFrame:
    """``(portfolio_id, ts, name)``: sums of ``part`` at every time of ``returns``, null where one of a portfolio's held symbols has none."""
    sums = parts.groupBy("portfolio_id", "ts").agg(F.count("part").alias("found"), F.sum("part").alias("total"))
    asked = held.groupBy("portfolio_id").agg(F.count("*").alias("n"))
    grid = asked.crossJoin(returns.select("ts").distinct())  # portfolios times the calendar: the result's rows
    out = grid.join(sums, ["portfolio_id", "ts"], "left")
    return out.select("portfolio_id", "ts", F.when(F.coalesce("found", F.lit(0)) == F.col("n"), F.coalesce("total", F.lit(0.0))).alias(name))


def buy_and_hold_curve(start: DataFrame, returns: DataFrame) -> DataFrame:
    """``(portfolio_id, ts, v)`` of holding ``start(portfolio_id, symbol, h)`` from the first time on, without costs.

    Null where the way of a held symbol is not known: after a missing return, at times without its row, always for a symbol without any.
    """
    held = start.where("h <> 0 or h is null")
    own = returns.withColumn("g", _growth("ret", "symbol"))
    return _whole(own.join(held, "symbol").withColumn("part", F.col("h") * F.col("g")), held, returns, "v")


def constant_mix_curve(mix: DataFrame, returns: DataFrame, value: float = 1.0) -> DataFrame:
    """``(portfolio_id, ts, v)`` of going back to ``mix(portfolio_id, symbol, w)`` at every time, without costs; null after a period with an unknown return of the mix."""
    held = mix.where("w <> 0 or w is null")
    step = _whole(returns.join(held, "symbol").withColumn("part", F.col("w") * F.col("ret")), held, returns, "r")
    return step.select("portfolio_id", "ts", (value * _growth("r", "portfolio_id")).alias("v"))


def drifted_weights(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Weights after a period without trading: w (1 + r) over their sum; a book's are null if the return of one of its positions is unknown."""
    grown = weights.join(returns.select("ts", "symbol", "ret"), ["ts", "symbol"], "left").withColumn("g", F.when(F.col("w") == 0, 0.0).otherwise(F.col("w") * (1 + F.col("ret"))))
    total = F.when(F.count_if(F.col("g").isNull()).over(book()) == 0, F.sum("g").over(book()))
    return grown.withColumn("w", divided(F.col("g"), total)).select(*weights.columns)


