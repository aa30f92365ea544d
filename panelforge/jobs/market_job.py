"""The data job: from landed vendor payloads to a stored, downsampled panel with cash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import shared_folder
from ..operators import cleaning as c, panel as p
from ..sources import files, store


def market_panel(clean: DataFrame, interval: str | None = None, recent: int = 5) -> DataFrame:
    """All symbols on one calendar, cut where recent prices are missing, in longer periods if ``interval`` names one."""
    out = p.drop_missing_recent(p.build_panel(clean, dense_grid=True), recent)
    return out if interval is None else p.downsample_edges(p.downsample(out, interval))


def with_cash(panel: DataFrame, rates: DataFrame, per_year: float) -> DataFrame:
    """The panel with the cash rate ``(ts, rate)`` as one more symbol."""
    return p.with_cash_rows(panel, p.add_cash(panel, rates, per_year))


def stored(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to a new shared folder and read back: what follows reads them several times, and a lost executor costs a re-read."""
    path = f"{shared_folder(spark, name)}/rows"
    rows.sortWithinPartitions(*(c for c in ("symbol", "ts") if c in rows.columns)).write.parquet(path)
    return spark.read.parquet(path)


BARS = "symbol string, ts timestamp, open double, low double, high double, close double, `return` double, valuevolume double"
OVERLAP = 5  # stored rows that later payloads bring again


def update_bars(spark: SparkSession, root: str, payloads: DataFrame, announced: DataFrame | None = None, **thresholds) -> store.Version:
    """One run of incremental cleaning: landed payloads into the bars stored under ``root``, of which the last years alone are read and written.

    Bars of a symbol that has enough stored rows count from the fifth last of them on, whatever earlier ones the payload repeats, and are cleaned with up to
    200 stored rows lent to the rules; their last two stored rows are then replaced and later ones added. Other symbols are cleaned from their start.
    """
    bars = files.parse_chart_json(payloads)
    if announced is not None:
        bars = files.fix_last_open_time(bars, announced)
    before = store.latest(spark, root)
    if before is None:
        return store.append(spark, root, _settled(c.clean_bars(bars, **thresholds)))
    known = store.tails(spark, before).where(F.size("times") >= OVERLAP).select("symbol", F.element_at("times", F.lit(-OVERLAP)).alias("since"))
    bars = bars.join(known, "symbol", "left").where("since is null or ts >= since").drop("since")
    firsts = bars.groupBy("symbol").agg(F.min("ts").alias("first")).join(known.select("symbol"), "symbol")
    saved = stored(spark, store.lent(spark, before, firsts, BARS).join(firsts, "symbol").where("ts < first").drop("first"), "lent")
    fresh = stored(spark, _settled(c.clean_bars(bars, saved, **thresholds), known.select("symbol")), "fresh")
    return store.append(spark, root, fresh)


def _settled(clean: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What the last bar has not settled is missing; the first bar of a symbol that is not ``known`` goes unless it is whole."""
    own = c.value_volume(c.null_last_row(clean))
    if known is None:
        return c.drop_first_if_null(own)
    return c.drop_first_if_null(own.join(known, "symbol", "left_anti")).unionByName(own.join(known, "symbol", "left_semi"))


def audit_run(spark: SparkSession, before: store.Version, after: store.Version, **tolerances) -> DataFrame:
    """What a run changed of the bars stored before, beyond the last one of each symbol: rows ``(symbol, ts, column, fault)``, from the rewritten years alone."""
    old, new = store.changed(spark, before, after, BARS)
    return files.audit_append_only(old, new, ["open", "low", "high", "close", "return", "valuevolume"], **tolerances)


def run(spark: SparkSession, payloads: DataFrame, rates: DataFrame, root: str, interval: str = "quarterly", per_year: float = 4.0, **thresholds) -> DataFrame:
    """One run of the whole job: the stored bars under ``root`` are brought up to date, and the panel ``(symbol, ts, ret, valuevolume, price)`` made of them."""
    after = update_bars(spark, root, payloads, **thresholds)
    panel = stored(spark, market_panel(store.read(spark, after, BARS), interval), "periods")
    return with_cash(panel, rates, per_year)
