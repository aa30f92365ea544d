"""Reading and writing of panels, series, vendor payloads and snapshots; append-only maintenance and its audits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.core import DAY, rows_from_end


def read_wide_panel(spark: SparkSession, path: str, value: str = "ret", fmt: str = "csv") -> DataFrame:
    """A date-indexed wide file (one column per symbol) as rows ``(symbol, ts, value)``; blanks are left out.

    Only the header is read to learn the symbols; nothing is inferred from the data.
    """
    if fmt == "csv":
        names = spark.read.option("header", True).csv(path).columns
        wide = spark.read.option("header", True).csv(path, schema=", ".join(f"`{n}` string" for n in names))
    else:
        wide = spark.read.format(fmt).load(path)
    first, *symbols = wide.columns
    typed = wide.select(F.col(f"`{first}`").cast("timestamp").alias("ts"), *(F.col(f"`{s}`").try_cast("double").alias(s) for s in symbols))
    return unpivot_panel(typed, value)


def unpivot_panel(wide: DataFrame, value: str = "ret") -> DataFrame:
    """``(ts, one column per symbol)`` to ``(symbol, ts, value)``, without missing cells."""
    symbols = [c for c in wide.columns if c != "ts"]
    return wide.unpivot("ts", symbols, "symbol", value).where(F.col(value).isNotNull()).select("symbol", "ts", value)


def to_wide(panel: DataFrame, value: str, symbols: Sequence[str]) -> DataFrame:
    """Rows to one column per listed symbol; the list is given, so no extra pass looks for it."""
    return panel.groupBy("ts").pivot("symbol", [*symbols]).agg(F.first(value))


def write_series(series: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Store a series in parquet, orc, json or csv, sorted inside its files by symbol and time."""
    own = series.sortWithinPartitions("symbol", "ts").write.mode("overwrite")
    (own.option("header", True) if fmt == "csv" else own).partitionBy(*partition_by).format(fmt).save(path)


def read_series(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = schemas.SERIES) -> DataFrame:
    """What :func:`write_series` stored, with exact types whatever the format."""
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def read_index_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """A two-column file of dates and values; cells that are no number are missing, dates are UTC."""
    raw = spark.read.schema("d string, v string").option("header", True).csv(path)
    return parse_index(raw, symbol)


def parse_index(raw: DataFrame, symbol: str) -> DataFrame:
    return raw.select(F.lit(symbol).alias("symbol"), F.to_timestamp("d").alias("ts"), F.col("v").try_cast("double").alias("value"))


def parse_chart_json(raw: DataFrame, column: str = "raw", symbol: str = "symbol") -> DataFrame:
    """Landed payloads of parallel arrays (unix seconds and quotes) as bars."""
    body = F.from_json(column, schemas.CHART_JSON)
    quote = F.col("body.indicators.quote")[0]
    zipped = F.arrays_zip(
        F.col("body.timestamp").alias("t"), *(quote[c].alias(c) for c in ("open", "low", "high", "close")), F.col("body.indicators.adjclose")[0]["adjclose"].alias("adjclose"), quote["volume"].alias("volume")
    )
    rows = raw.withColumn("body", body).select(F.col(symbol).alias("symbol"), F.explode(zipped).alias("b"))
    # arrays_zip names the fields by position when they are not plain columns
    names = ["t", "open", "low", "high", "close", "adjclose", "volume"]
    fields = rows.schema["b"].dataType.names
    values = [F.col("b")[f].alias(n) for f, n in zip(fields, names)]
    return rows.select("symbol", *values).select("symbol", F.timestamp_seconds("t").alias("ts"), *names[1:])


def fix_last_open_time(bars: DataFrame, announced: DataFrame) -> DataFrame:
    """Sets a symbol's last bar to the announced open where their times of day differ by other than an hour.

    ``announced(symbol, open_ts)`` has one row per symbol. An hour's difference is a clock change and is left.
    """
    last = rows_from_end(bars).join(announced, "symbol", "left")
    gap = F.pmod(F.abs(F.unix_seconds("ts") - F.unix_seconds("open_ts")), F.lit(DAY))
    moved = (F.col("from_end") == 1) & (gap != 0) & (gap != 3600)
    return last.withColumn("ts", F.when(F.coalesce(moved, F.lit(False)), F.col("open_ts")).otherwise(F.col("ts"))).select(*bars.columns)


def read_snapshots(raw: DataFrame, column: str = "raw", value: str = "h") -> DataFrame:
    """JSON ``{time: {symbol: value}}`` as rows ``(ts, symbol, value)``, with the other columns of ``raw`` (but a ``ts``) before them."""
    keys = [c for c in raw.columns if c not in (column, "ts")]
    times = raw.select(*keys, F.explode(F.from_json(column, schemas.SNAPSHOTS)).alias("t", "m"))
    return times.select(*keys, "t", F.explode("m").alias("symbol", value)).select(*keys, F.to_timestamp("t").alias("ts"), "symbol", value)


def write_snapshots(rows: DataFrame, value: str = "h", by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, ts, raw)``: one JSON object ``{time: {symbol: value}}`` for every time (of each portfolio, say)."""
    own = F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", value))))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return rows.groupBy(*by, "ts").agg(own.alias("m")).select(*by, "ts", F.to_json(F.create_map(time, "m")).alias("raw"))


def stale_symbols(series: DataFrame, now: str, grace_seconds: int) -> DataFrame:
    """Symbols whose last observation is older than ``grace_seconds`` at ``now``."""
    last = series.groupBy("symbol").agg(F.max("ts").alias("last"))
    return last.where(F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("last") > grace_seconds)


def append_only_merge(current: DataFrame, new: DataFrame, overwrite_last: int = 2) -> DataFrame:
    """``current`` without each symbol's last ``overwrite_last`` rows, and the rows of ``new`` later than what is kept."""
    kept = rows_from_end(current).where(F.col("from_end") > overwrite_last).select(*current.columns)
    upto = kept.groupBy("symbol").agg(F.max("ts").alias("upto"))
    later = new.join(upto, "symbol", "left").where("upto is null or ts > upto").select(*new.columns)
    return kept.unionByName(later)


def audit_append_only(current: DataFrame, updated: DataFrame, columns: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """What an update changed that it should not: rows ``(symbol, ts, column, fault)``.

    Faults: a row gone, or a value changed beyond ``atol + rtol * |current|``, in all but a symbol's last stored row (of
    that only ``open``, where it is listed, must stay). Missing equals missing.
    """
    old = rows_from_end(current).select("symbol", "ts", "from_end", *(F.col(c).alias(f"old_{c}") for c in columns))
    both = old.join(updated.select("symbol", "ts", F.lit(True).alias("there"), *columns), ["symbol", "ts"], "left")
    checks = []
    for c in columns:
        a, b = F.col(c), F.col(f"old_{c}")
        close = F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), a.isNull() & b.isNull())
        inside = (F.col("from_end") > 1) if c != "open" else F.lit(True)
        checks.append(F.struct(F.lit(c).alias("column"), F.when(F.col("there").isNull(), F.when(F.col("from_end") > 1, "gone")).when(inside & ~close, "changed").alias("fault")))
    return both.select("symbol", "ts", F.explode(F.array(*checks)).alias("x")).select("symbol", "ts", "x.column", "x.fault").where("fault is not null")


def audit_nulls(series: DataFrame) -> DataFrame:
    """Missing values per symbol and column in all but the last row: rows ``(symbol, column, missing)``, missing > 0."""
    values = [c for c in series.columns if c not in ("symbol", "ts")]
    counts = rows_from_end(series).where("from_end > 1").groupBy("symbol").agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in values))
    return counts.unpivot("symbol", values, "column", "missing").where("missing > 0")


def merge_universes(*lists: DataFrame, how: str = "union") -> DataFrame:
    """Sorted distinct symbols of all lists (``union``), of the first but no other (``minus``), or of each (``intersect``)."""
    steps = {"union": lambda a, b: a.union(b), "minus": lambda a, b: a.subtract(b), "intersect": lambda a, b: a.intersect(b)}
    return reduce(steps[how], [x.select("symbol") for x in lists]).distinct().orderBy("symbol")


def normalize_tickers(df: DataFrame, suffix: str = "", column: str = "symbol") -> DataFrame:
    """Dots to dashes, no dashes at the end, then the exchange's suffix."""
    dashed = F.regexp_replace(F.regexp_replace(F.trim(column), r"\.", "-"), "-+$", "")
    return df.withColumn(column, F.concat(dashed, F.lit(suffix)))


def universe_signature(df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """A ten-character signature of the set of symbols (of each group ``by``), whatever the row order."""
    joined = F.concat_ws(",", F.sort_array(F.collect_set("symbol")))
    return df.groupBy(*by).agg(F.substring(F.sha2(joined, 256), 1, 10).alias("signature"), F.count_distinct("symbol").alias("n"))


def dense(panel: DataFrame) -> DataFrame:
    """Every symbol at every timestamp of the panel; the calendar (small by nature) is broadcast."""
    calendar, symbols = panel.select("ts").distinct(), panel.select("symbol").distinct()
    grid = symbols.crossJoin(F.broadcast(calendar))
    return grid.join(panel, ["symbol", "ts"], "left").select(*panel.columns)


def calendar_window() -> Window:
    return Window.orderBy("ts")
