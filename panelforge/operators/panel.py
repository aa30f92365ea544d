"""Point-in-time panels: calendars, cash, universes, masks and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import DAY, YEAR_DAYS, asof_join, by_symbol, divided, resample_return
from ..schemas import CASH
from ..sources.files import dense

UNITS = {"weekly": "week", "monthly": "month", "quarterly": "quarter", "annual": "year"}


def build_panel(clean: DataFrame, dense_grid: bool = False) -> DataFrame:
    """Returns, value volumes and open prices of cleaned bars; ``dense_grid`` adds missing rows for a common calendar."""
    panel = clean.select("symbol", "ts", F.col("return").alias("ret"), "valuevolume", F.col("open").alias("price"))
    return dense(panel) if dense_grid else panel


def index_panel(series: DataFrame, standard: bool = False) -> DataFrame:
    """Returns from prices alone: 1 - p / p_next, or with ``standard`` p_next / p - 1."""
    nxt = F.lead("value").over(by_symbol())
    ret = divided(nxt, F.col("value")) - 1 if standard else 1 - divided(F.col("value"), nxt)
    return series.select("symbol", "ts", ret.alias("ret"), F.col("value").alias("price"))


def calendar_of(panel: DataFrame) -> DataFrame:
    """Distinct times with their number from 1. Calendars hold thousands of rows, whatever the number of symbols."""
    return panel.select("ts").distinct().withColumn("n", F.row_number().over(Window.orderBy("ts")))


def periods_per_year(panel: DataFrame) -> DataFrame:
    """One row: calendar rows by years spanned, rounded half to even."""
    c = panel.select("ts").distinct().agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    years = (F.unix_micros("last") - F.unix_micros("first")) / (1e6 * DAY * YEAR_DAYS)
    return c.select(F.rint(divided(F.col("rows").cast("double"), years)).cast("long").alias("ppy"))


def add_cash(panel: DataFrame, rates: DataFrame, ppy: Column | float) -> DataFrame:
    """``(ts, cash_ret)`` for the panel's calendar: the last known annual percent rate, as the return of a period."""
    days = asof_join(panel.select("ts").distinct(), rates, ["rate"])
    return days.select("ts", resample_return(F.col("rate") / 100, ppy).alias("cash_ret"))


def with_cash_rows(panel: DataFrame, cash: DataFrame) -> DataFrame:
    """The panel with cash as one more symbol."""
    return panel.unionByName(cash.select(F.lit(CASH).alias("symbol"), "ts", F.col("cash_ret").alias("ret")), allowMissingColumns=True)


def drop_missing_recent(panel: DataFrame, rows: int = 5) -> DataFrame:
    """Cuts after the first of the last ``rows`` times at which a price is missing (that time itself stays); then the last
    row's return and volume are unknown, and a missing last price is the one before. Expects a dense panel."""
    times = panel.groupBy("ts").agg(F.max(F.col("price").isNull()).alias("gap"))
    last = times.withColumn("k", F.row_number().over(Window.orderBy(F.col("ts").desc()))).where(F.col("k") <= rows)
    cut = last.agg(F.min(F.when(F.col("gap"), F.col("ts"))).alias("cut"))
    kept = panel.join(F.broadcast(cut), how="left").where("cut is null or ts <= cut").drop("cut")
    end = kept.agg(F.max("ts").alias("end"))
    before = F.lag("price").over(by_symbol())
    marked = kept.withColumn("before", before).join(F.broadcast(end), how="left")
    is_last = F.col("ts") == F.col("end")
    out = {c: F.when(~is_last, F.col(c)) for c in ("ret", "valuevolume")} | {"price": F.when(is_last, F.coalesce("price", "before")).otherwise(F.col("price"))}
    return marked.withColumns(out).select(*panel.columns)


def downsample(panel: DataFrame, interval: str) -> DataFrame:
    """Longer periods: returns compounded, volumes summed, prices the first known; a period is named by its first time.

    Missing values are skipped, and a period with none known is missing. Partial sums meet on (symbol, period).
    """
    period = F.date_trunc(UNITS[interval], "ts")
    labels = panel.groupBy(period.alias("period")).agg(F.min("ts").alias("label"))
    sums = panel.groupBy("symbol", period.alias("period")).agg(
        (F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret"), F.sum("valuevolume").alias("valuevolume"), F.min_by("price", F.when(F.col("price").isNotNull(), F.col("ts"))).alias("price")
    )
    return sums.join(F.broadcast(labels), "period").select("symbol", F.col("label").alias("ts"), "ret", "valuevolume", "price")


def downsample_edges(coarse: DataFrame) -> DataFrame:
    """What a downsampled panel does not know: the last period's return and volume, each column's first known value; the first
    period is dropped. Expects every symbol at every period."""
    ends = coarse.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    out = coarse.join(F.broadcast(ends), how="left")
    whole = Window.partitionBy("symbol")
    for c in ("ret", "valuevolume"):
        out = out.withColumn(c, F.when(F.col("ts") < F.col("t1"), F.col(c)))
    for c in ("ret", "valuevolume", "price"):
        first = F.min(F.when(F.col(c).isNotNull(), F.col("ts"))).over(whole)
        out = out.withColumn(c, F.when(F.col("ts") != first, F.col(c)))
    return out.where("ts > t0").select(*coarse.columns)


def min_history_filter(panel: DataFrame, least: int) -> DataFrame:
    """Adds ``eligible``: at least ``least`` returns are known before each row."""
    past = F.count("ret").over(by_symbol().rowsBetween(Window.unboundedPreceding, -1))
    return panel.withColumn("eligible", past >= least)


def membership_asof(times: DataFrame, membership: DataFrame) -> DataFrame:
    """``(ts, symbol, tradable)`` at every time of ``times``: the whole last snapshot at or before it."""
    snaps = membership.select(F.col("ts").alias("snap")).distinct().withColumn("ts", F.col("snap"))
    picked = asof_join(times.select("ts").distinct(), snaps, ["snap"])
    return F.broadcast(picked).join(membership.withColumnRenamed("ts", "snap"), "snap").select("ts", "symbol", "tradable")


def universe_at(panel: DataFrame, membership: DataFrame | None, least: int, online: bool = False) -> DataFrame:
    """``(ts, symbol)`` tradable at each time: enough history, a member, and (unless ``online``) a known current return."""
    own = min_history_filter(panel, least).where("eligible")
    if not online:
        own = own.where("ret is not null")
    own = own.select("ts", "symbol")
    if membership is None:
        return own
    return own.join(membership_asof(panel.select("ts"), membership).where("tradable"), ["ts", "symbol"], "left_semi")


def universe_errors(universe: DataFrame, times: DataFrame) -> DataFrame:
    """Times with fewer than two symbols to trade."""
    n = times.select("ts").distinct().join(universe.groupBy("ts").agg(F.count("*").alias("n")), "ts", "left")
    return n.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where("n < 2")


def calendar(panel: DataFrame, least: int = 1, start: str | None = None, end: str | None = None, include_end: bool = True) -> DataFrame:
    """Trading times: from the ``least``-th time with any return, inside ``[start, end]``, with or without the last one."""
    any_ret = panel.groupBy("ts").agg(F.count("ret").alias("known")).where("known > 0")
    numbered = any_ret.withColumn("k", F.row_number().over(Window.orderBy("ts"))).where(F.col("k") >= least)
    if start is not None:
        numbered = numbered.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        numbered = numbered.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    if not include_end:
        last = numbered.agg(F.max("ts").alias("last"))
        numbered = numbered.join(F.broadcast(last), how="left").where("ts < last")
    return numbered.select("ts")


def serve(panel: DataFrame, at: str, universe: DataFrame | None = None) -> DataFrame:
    """What is seen at a time: past rows, and the current one marked, for the symbols tradable then."""
    now = F.lit(at).cast("timestamp")
    seen = panel.where(F.col("ts") <= now).withColumn("current", F.col("ts") == now)
    if universe is None:
        return seen
    return seen.join(universe.where(F.col("ts") == now).select("symbol"), "symbol", "left_semi").select(*seen.columns)


def validate_gaps(panel: DataFrame) -> DataFrame:
    """Symbols whose returns come and go more than twice. Expects a dense panel."""
    gone = F.col("ret").isNull()
    flips = panel.withColumn("flip", (gone != F.lag(gone).over(by_symbol())).cast("long")).groupBy("symbol").agg(F.sum("flip").alias("flips"))
    return flips.where("flips > 2")


def validate_schema(returns: DataFrame, volumes: DataFrame) -> DataFrame:
    """Symbols that one of the two has and the other lacks (cash apart): rows ``(symbol, fault)``."""
    a, b = returns.where(F.col("symbol") != CASH).select("symbol"), volumes.select("symbol")
    only = lambda x, y, name: x.subtract(y).select("symbol", F.lit(name).alias("fault"))
    return only(a, b, "no volume").union(only(b, a, "no return"))


def universe_changes(universe: DataFrame) -> DataFrame:
    """``(ts, symbol, change)``: what each time's universe adds or removes against the time before."""
    times = universe.select("ts").distinct().withColumn("before", F.lag("ts").over(Window.orderBy("ts"))).where("before is not null")
    times = F.broadcast(times)
    now = universe.join(times, "ts").select("ts", "before", "symbol")
    nxt = times.select(F.col("ts").alias("after"), F.col("before").alias("ts"))
    added = now.join(universe.select(F.col("ts").alias("before"), "symbol"), ["before", "symbol"], "left_anti")
    removed = universe.join(nxt, "ts").select(F.col("after").alias("ts"), "symbol").join(universe, ["ts", "symbol"], "left_anti")
    return added.select("ts", "symbol", F.lit("added").alias("change")).union(removed.select("ts", "symbol", F.lit("removed").alias("change")))


def fx_convert(panel: DataFrame, fx: DataFrame) -> DataFrame:
    """Returns, volumes and prices in another currency. ``fx(ts, fx)`` is the rate known at the close; each time uses the one before."""
    known = fx.select("ts", F.lag("fx").over(Window.orderBy("ts")).alias("fx"))
    times = asof_join(panel.select("ts").distinct(), known.where("fx is not null"), ["fx"])
    times = times.withColumn("fx_ret", divided(F.lead("fx").over(Window.orderBy("ts")), F.col("fx")) - 1)
    joined = panel.join(F.broadcast(times), "ts")
    cash = F.col("symbol") == CASH
    return joined.select(
        "symbol", "ts", F.when(cash, F.col("ret")).otherwise((1 + F.col("ret")) * (1 + F.col("fx_ret")) - 1).alias("ret"), (F.col("valuevolume") * F.col("fx")).alias("valuevolume"), (F.col("price") * F.col("fx")).alias("price")
    )
