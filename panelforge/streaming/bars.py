"""Structured Streaming: bars and rolling figures from ticks, append-only storage, online forecasts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.core import finite


def _bar_columns():
    """Open and close are the prices at the least and greatest (time, id); equal times go by id."""
    order = F.struct("ts", "event_id")
    return [F.min_by("price", order).alias("open"), F.min("price").alias("low"), F.max("price").alias("high"), F.max_by("price", order).alias("close"), F.count("*").alias("ticks")]


def stream_bars(ticks: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Bars ``(symbol, ts, open, low, high, close, ticks)`` of ticks ``(symbol, ts, price, event_id)``.

    In append mode a bar comes once, when the watermark has passed its end; ticks later than ``delay`` are left out. On a
    batch frame it is the plain aggregation.
    """
    seen = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    bars = seen.groupBy("symbol", F.window("ts", width).alias("w")).agg(*_bar_columns())
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "low", "high", "close", "ticks")


LATEST = "symbol string, ts timestamp, end timestamp, open double, low double, high double, close double, ticks long, last_tick timestamp"


def stream_latest_bars(ticks: DataFrame, path: str, checkpoint: str, width: str = "1 hour", delay: str = "10 minutes"):
    """Bars as they form: every micro-batch stores the bars that it changed, the last ones too, as a further version of their rows under ``path``.

    Returns the started query (update mode, available-now trigger). A batch overwrites its own folder, so one that is tried again leaves its version once.
    A table belongs to one checkpoint, whose state holds the open bars. :func:`latest_bars` reads each bar's last version.
    """
    seen = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width).alias("w"))
    bars = seen.agg(*_bar_columns(), F.max("ts").alias("last_tick"))
    rows = bars.select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("end"), "open", "low", "high", "close", "ticks", "last_tick")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return rows.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_bars(spark: SparkSession, path: str, delay_seconds: int = 600) -> DataFrame:
    """``(symbol, ts, open, low, high, close, ticks, provisional)``: each bar once, as last stored.

    A bar is provisional until ticks of any symbol have passed its end by ``delay_seconds``, the delay of its stream: until then further ticks may change it.
    """
    stored = spark.read.schema(f"{LATEST}, version long").parquet(path)
    fields = ("end", "open", "low", "high", "close", "ticks")
    last = stored.groupBy("symbol", "ts").agg(F.max_by(F.struct(*fields), "version").alias("x")).select("symbol", "ts", "x.*")
    seen = stored.agg(F.max("last_tick").alias("seen"))
    open_ = F.unix_micros("end") > F.unix_micros("seen") - delay_seconds * 1_000_000
    return last.join(F.broadcast(seen), how="left").select("symbol", "ts", *fields[1:], open_.alias("provisional"))


def stream_rolling(ticks: DataFrame, length: str = "4 hours", slide: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Trailing mean, root mean square and count of prices, for windows that end every ``slide``."""
    seen = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    out = seen.groupBy("symbol", F.window("ts", length, slide).alias("w")).agg(F.avg("price").alias("mean"), F.sqrt(F.avg(F.col("price") * F.col("price"))).alias("rms"), F.count("*").alias("n"))
    return out.select("symbol", F.col("w.end").alias("ts"), "mean", "rms", "n")


def stream_clean(ticks: DataFrame) -> DataFrame:
    """Stateless rules: infinite or non-positive prices are missing and leave."""
    return ticks.withColumn("price", finite("price")).where("price > 0")


def stream_append_only(rows: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes"):
    """Appends each (symbol, ts) once to the Parquet table at ``path``, never rows at or before a symbol's last stored one.

    Returns the started query (available-now trigger). Every micro-batch overwrites its own folder ``run=…/batch=…`` (the run is the
    checkpoint's), so a batch that is tried again leaves its rows once. A symbol's last stored times are a small table beside the rows, one
    version a batch: a batch reads the version before it, never the rows, and drops the ones that no retry can ask for.
    """
    unique = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])
    run = sha256(checkpoint.encode()).hexdigest()[:12]

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine, version = f"run={run}/batch={number}", lambda n: f"{path}/_upto/run={run}/batch={n}"
        files = spark.sparkContext._jvm.org.apache.hadoop.fs
        store_of = files.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        exists = lambda p: store_of.exists(files.Path(p))
        kind = "symbol string, upto timestamp"
        if number and exists(version(number - 1)):
            before = spark.read.schema(kind).parquet(version(number - 1))
        elif exists(f"{path}/_upto"):
            stored = spark.read.schema(f"{kind}, run string, batch long").parquet(f"{path}/_upto")
            before = stored.where((F.col("run") != run) | (F.col("batch") < number)).select("symbol", "upto")
        else:
            before = spark.createDataFrame([], kind)
        before = before.groupBy("symbol").agg(F.max("upto").alias("upto"))
        new = batch.join(before, "symbol", "left").where("upto is null or ts > upto").select(*batch.columns).persist()
        try:
            new.write.mode("overwrite").parquet(f"{path}/{mine}")
            last = before.unionByName(new.select("symbol", F.col("ts").alias("upto"))).groupBy("symbol").agg(F.max("upto").alias("upto"))
            last.write.mode("overwrite").parquet(version(number))
        finally:
            new.unpersist()
        if number > 1:
            store_of.delete(files.Path(version(number - 2)), True)

    return unique.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ONLINE = "symbol string, ts timestamp, mean double, variance double, n double, dropped long"
STATE = "num double, den double, num2 double, last double, dropped long"


def step_online(state: tuple, times, values, half_life: float) -> Iterator[tuple]:
    """Folds observations into decayed sums; what comes out of order is dropped and counted. Yields the state after each kept one."""
    num, den, num2, last, dropped = state
    for t, x in zip(times, values):
        if last is not None and t < last:
            dropped += 1
            continue
        fade = 1.0 if last is None else 2.0 ** ((last - t) / half_life)
        num, den, num2, last = num * fade + x, den * fade + 1.0, num2 * fade + x * x, t
        yield num, den, num2, last, dropped


def stream_online_forecast(ticks: DataFrame, half_life: float) -> DataFrame:
    """Exponentially weighted mean, variance (about zero) and count of each symbol after every observation.

    State per symbol: three decayed sums, the last time, and the number of rows dropped for being out of order, because
    the recursion depends on order. Rows of one batch are put in order first.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else (0.0, 0.0, 0.0, None, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        seconds = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        out = []
        for held in step_online(held, seconds, rows["price"].to_numpy(float), half_life):
            num, den, num2, last, dropped = held
            out.append((key[0], pd.Timestamp(round(last * 1e6), unit="us"), num / den, num2 / den, den, dropped))
        num, den, num2, last, dropped = held
        state.update((float(num), float(den), float(num2), None if last is None else float(last), int(dropped)))
        yield pd.DataFrame(out, columns=["symbol", "ts", "mean", "variance", "n", "dropped"])

    own = ticks.select("symbol", "ts", "price").groupBy("symbol")
    return own.applyInPandasWithState(update, ONLINE, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an append-mode stream over what is there to its end into Parquet under ``folder``, and returns the rows."""
    to = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    to.option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
