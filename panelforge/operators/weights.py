"""Closed-form weight rules, for all dates (and portfolios) at once. Weights are rows ``(…, symbol, w)`` with a cash row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.core import asof_join, divided
from ..schemas import CASH

YEAR = 365.24 * 86_400


def _at(by: Sequence[str] = ("ts",)) -> WindowSpec:
    return Window.partitionBy(*by)


def _with_cash(weights: DataFrame, cash: Column, by: Sequence[str] = ("ts",)) -> DataFrame:
    """Adds each time's cash row; ``cash`` is an aggregate of its other weights."""
    rows = weights.groupBy(*by).agg(cash.alias("w")).select(*by, F.lit(CASH).alias("symbol"), "w")
    return weights.select(*by, "symbol", "w").unionByName(rows)


def w_uniform(universe: DataFrame, leverage: float = 1.0) -> DataFrame:
    """leverage / n on each tradable symbol, the rest in cash."""
    own = universe.select("ts", "symbol", (F.lit(leverage) / F.count("*").over(_at())).alias("w"))
    return _with_cash(own, 1 - F.sum("w"))


def w_all_cash(universe: DataFrame) -> DataFrame:
    return _with_cash(universe.select("ts", "symbol", F.lit(0.0).alias("w")), F.lit(1.0) + 0 * F.count("*"))


def w_market(panel: DataFrame, rolling: float = YEAR) -> DataFrame:
    """Weights in proportion to trailing mean value volumes; no cash."""
    from .forecasts import mean_volume

    own = mean_volume(panel, rolling=rolling).where("mean_volume is not null")
    own = own.withColumn("w", divided(F.col("mean_volume"), F.sum("mean_volume").over(_at())))
    return _with_cash(own, F.lit(0.0) + 0 * F.count("*"))


def _ranked(longs: int, shorts: int, by: Sequence[str] = ("ts",)) -> Column:
    """+1 for the highest ``longs``, else -1 for the lowest ``shorts``, else 0; equal signals by symbol."""
    up = F.row_number().over(_at(by).orderBy("signal", "symbol"))
    down = F.row_number().over(_at(by).orderBy(F.col("signal").desc(), F.col("symbol").desc()))
    return F.when(down <= longs, 1.0).when(up <= shorts, -1.0).otherwise(0.0)


def w_rank_long_short(signal: DataFrame, longs: int = 1, shorts: int = 1, leverage: float = 1.0, by: Sequence[str] = ("ts",)) -> DataFrame:
    """Equal long and short weights by rank of ``signal(ts, symbol, signal)``; the cash weight is 1 by definition.

    ``by`` names the columns of one cross-section, e.g. portfolio and time.
    """
    own = signal.where("signal is not null").withColumn("s", _ranked(longs, shorts, by))
    own = own.withColumn("w", divided(F.col("s"), F.sum(F.abs("s")).over(_at(by))) * leverage)
    return _with_cash(own, F.lit(1.0) + 0 * F.count("*"), by)


def z_rank_turnover(signal: DataFrame, longs: int, shorts: int, turnover: float) -> DataFrame:
    """The same ranks as trades of gross size 2 * turnover, paid from cash: rows ``(ts, symbol, z)``."""
    own = signal.where("signal is not null").withColumn("s", _ranked(longs, shorts))
    own = own.withColumn("w", divided(F.col("s"), F.sum(F.abs("s")).over(_at())) * (2 * turnover))
    return _with_cash(own, -F.sum("w")).withColumnRenamed("w", "z")


def w_fixed(current: DataFrame, target: DataFrame) -> DataFrame:
    """The target weight where one is given for the time, else the current one (``w`` in both); symbols of the target that are not held come in."""
    joined = _beside_target(current, target)
    return joined.withColumn("w", F.coalesce("goal", "w")).select(*current.columns)


def _beside_target(current: DataFrame, target: DataFrame) -> DataFrame:
    """``current`` with the target as ``goal``. Symbols that a target names and a book of its time does not hold stand with weight 0 and ``new_``."""
    on = [c for c in ("portfolio_id", "ts", "symbol") if c in target.columns]
    goals = target.select(*on, F.col("w").alias("goal"))
    book = [c for c in ("portfolio_id", "ts") if c in current.columns]
    # only the books' keys meet the target here: no row is multiplied
    wanted = current.select(*book).distinct().join(goals, [c for c in on if c != "symbol"]).select(*book, "symbol")
    new = wanted.join(current.select(*book, "symbol"), [*book, "symbol"], "left_anti").withColumns({"w": F.lit(0.0), "new_": F.lit(True)})
    if "is_cash" in current.columns:
        new = new.withColumn("is_cash", F.col("symbol") == CASH)
    whole = current.withColumn("new_", F.lit(False)).unionByName(new, allowMissingColumns=True)
    return whole.join(goals, on, "left")


def z_fixed(current: DataFrame, trades: DataFrame) -> DataFrame:
    """Current weights plus given trade weights ``z``; no trade where none is given."""
    on = [c for c in ("portfolio_id", "ts", "symbol") if c in trades.columns]
    joined = current.join(trades, on, "left")
    return joined.withColumn("w", F.col("w") + F.coalesce("z", F.lit(0.0))).select(*current.columns)


def w_periodic(current: DataFrame, target: DataFrame, times: DataFrame) -> DataFrame:
    """One target ``(symbol, w)`` at listed times, current weights at others."""
    return w_fixed(current, times.select("ts").distinct().join(F.broadcast(target)))


def rebalance_dates(calendar: DataFrame, unit: str) -> DataFrame:
    """Times whose number of the day (in its year), week, month, quarter or year is another than that of the time before; the first is none.

    Numbers are compared without their year, so times a whole year apart are none by month: the calendar is taken to have rows in every unit.
    """
    parts = {"day": F.dayofyear, "week": F.weekofyear, "month": F.month, "quarter": F.quarter, "year": F.year}[unit]
    own = calendar.select("ts").distinct().withColumn("now", parts("ts"))
    return own.withColumn("before", F.lag("now").over(Window.orderBy("ts"))).where("now <> before").select("ts")


def w_proportional_to_target(current: DataFrame, targets: DataFrame) -> DataFrame:
    """One step of an even path to the next target: w + (target - w) / trading times left.

    ``targets(ts, symbol, w)`` are for all portfolios, or ``targets(portfolio_id, ts, symbol, w)`` for each its own. Unchanged where no target is
    ahead, or the target is now. The calendar is that of ``current``.
    """
    by = [c for c in ("portfolio_id",) if c in targets.columns]
    times = current.select("ts").distinct().withColumn("n", F.row_number().over(Window.orderBy("ts")))
    books = current.select(*by, "ts").distinct().join(F.broadcast(times), "ts") if by else times
    goals = targets.select(*by, "ts").distinct().withColumn("goal_ts", F.col("ts"))
    ahead = asof_join(books, goals, ["goal_ts"], by=by, forward=True)
    reach = ahead.join(F.broadcast(times.select(F.col("ts").alias("goal_ts"), F.col("n").alias("goal_n"))), "goal_ts", "left").select(*by, "ts", "goal_ts", (F.col("goal_n") - F.col("n")).alias("left"))
    goal = targets.select(*by, F.col("ts").alias("goal_ts"), "symbol", F.col("w").alias("goal"))
    # the goal as a target of every time on the way to it, so that its symbols come in
    ahead = reach.where("left > 0").join(goal, [*by, "goal_ts"]).select(*by, "ts", "symbol", F.col("goal").alias("w"))
    out = _beside_target(current, ahead).join(reach, [*by, "ts"])
    step = F.when(F.col("left") > 0, (F.coalesce("goal", F.lit(0.0)) - F.col("w")) / F.col("left"))
    return out.withColumn("w", F.col("w") + F.coalesce(step, F.lit(0.0))).select(*current.columns)


def target_faults(targets: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Target times (of each portfolio, if there are several) whose weights do not sum to one."""
    return targets.groupBy(*(c for c in ("portfolio_id",) if c in targets.columns), "ts").agg(F.sum("w").alias("total")).where(F.abs(F.col("total") - 1) > tol)


def _to_target_if(current: DataFrame, target: DataFrame, trigger: Callable[[DataFrame], Column]) -> DataFrame:
    """The whole target, its symbols that are not held too, where ``trigger`` is true of a book; unchanged where the book's time has no target."""
    joined = _beside_target(current, target).withColumn("given_", F.count("goal").over(_book()) > 0).withColumn("goal", F.coalesce("goal", F.lit(0.0)))
    out = joined.withColumn("hit_", F.col("given_") & F.coalesce(trigger(joined), F.lit(False))).where("hit_ or not new_")
    return out.withColumn("w", F.when(F.col("hit_"), F.col("goal")).otherwise(F.col("w"))).select(*current.columns)


def _book() -> Window:
    return Window.partitionBy("portfolio_id", "ts")


def w_adaptive(current: DataFrame, target: DataFrame, tol: float) -> DataFrame:
    """The target where the weights are farther than ``tol`` (Euclidean) from it, else unchanged."""
    gap = F.sqrt(F.sum((F.col("w") - F.col("goal")) ** 2).over(_book()))
    return _to_target_if(current, target, lambda _: gap > tol)


def w_leverage_band(current: DataFrame, target: DataFrame, low: float, high: float) -> DataFrame:
    """The target where leverage (cash apart) leaves ``[low, high]``, else unchanged."""
    gross = F.sum(F.when(F.col("symbol") != CASH, F.abs("w"))).over(_book())
    return _to_target_if(current, target, lambda _: (gross < low) | (gross > high))


def rebalance_to_orders(holdings: DataFrame, target: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows ``(…, v, w, z, u, shares)`` from holdings ``h``, target weights and prices; shares are rounded half to even."""
    on = [c for c in ("portfolio_id", "ts", "symbol") if c in target.columns]
    own = holdings.withColumn("v", F.sum("h").over(_book()))
    own = own.withColumn("w", divided(F.col("h"), F.col("v"))).join(target.withColumnRenamed("w", "goal"), on, "left")
    own = own.withColumn("z", F.coalesce("goal", F.lit(0.0)) - F.col("w")).withColumn("u", F.col("z") * F.col("v"))
    shares = F.when(F.col("symbol") != CASH, F.rint(divided(F.col("u"), F.col("price"))))
    priced = own.join(prices.select("ts", "symbol", "price"), ["ts", "symbol"], "left").withColumn("shares", shares)
    return priced.select(*holdings.columns, "v", "w", "z", "u", "shares")


def order_rejects(holdings: DataFrame, target: DataFrame) -> DataFrame:
    """``(portfolio_id, ts, reason)``: missing holdings, values not above zero, symbols of a target that are not held."""
    books = holdings.groupBy("portfolio_id", "ts").agg(F.count_if(F.col("h").isNull()).alias("gone"), F.sum("h").alias("v"))
    missing = books.where("gone > 0").select("portfolio_id", "ts", F.lit("missing holding").alias("reason"))
    broke = books.where("v <= 0").select("portfolio_id", "ts", F.lit("no value").alias("reason"))
    other = target.join(holdings, ["portfolio_id", "ts", "symbol"], "left_anti").select("portfolio_id", "ts").distinct()
    return missing.union(broke).union(other.select("portfolio_id", "ts", F.lit("other universe").alias("reason")))


def custom_policy(panel: DataFrame, fn: Callable[[DataFrame], DataFrame], tol: float = 1e-9) -> DataFrame:
    """A user's rule ``fn(panel) -> (ts, symbol, w)``, with ``ok``: whether the time's weights sum to one."""
    return fn(panel).withColumn("ok", F.abs(F.sum("w").over(_at()) - 1) <= tol)
