"""Bars, panels, portfolios and ticks from the general tables, in Spark and as views for the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import view

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of every part brand: one shuffle after map-side partial aggregation, whatever the number of line items."""
    lines = table(spark, sf_dir, "lineitem").select(*ORDER)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    price, order = F.col("l_extendedprice") / F.col("l_quantity"), F.struct(*ORDER)
    out = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy(F.col("p_brand").alias("symbol"), F.date_trunc("month", "l_shipdate").alias("ts"))
    close = F.max_by(price, order)
    return out.agg(
        F.min_by(price, order).alias("open"), F.min(price).alias("low"), F.max(price).alias("high"), close.alias("close"), close.alias("adjclose"), F.sum("l_quantity").alias("volume")
    )


view("tb_bars", f"""
    SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts,
           arg_min(l_extendedprice / l_quantity, row({', '.join(ORDER)})) AS open, min(l_extendedprice / l_quantity) AS low,
           max(l_extendedprice / l_quantity) AS high, arg_max(l_extendedprice / l_quantity, row({', '.join(ORDER)})) AS close,
           arg_max(l_extendedprice / l_quantity, row({', '.join(ORDER)})) AS adjclose, sum(l_quantity) AS volume
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")  # fmt: skip

#: Which fault a dirty bar has: a rule of brand and month.
_FAULT = "(CAST(substr(symbol, 7) AS INT) * 7 + (year(ts) * 12 + month(ts)) * 3) % 41"


def dirty_bars(spark: SparkSession, sf_dir: str, closes: bool = True) -> DataFrame:
    """:func:`bars` with one kind of fault in some cells, and early adjusted closes of some brands halved; without ``closes`` both closes stay sound."""
    k = F.expr(_FAULT)
    b = bars(spark, sf_dir).withColumn("k", k)
    halved = (F.expr("CAST(substr(symbol, 7) AS INT) % 5 = 0")) & (F.col("ts") < "1996-01-01")
    faulty = {
        "open": F.when(F.col("k") == 0, -F.col("open")).when(F.col("k") == 3, F.col("high") * 1.5).when(F.col("k") == 7, F.col("low") / 100).otherwise(F.col("open")),
        "low": F.when(F.col("k") != 2, F.when(F.col("k") == 9, F.col("close") * 1.2).otherwise(F.col("low"))),
        "high": F.when(F.col("k") == 4, F.lit(float("inf"))).when(F.col("k") == 11, F.col("close") * 0.5).otherwise(F.col("high")),
        "close": F.when(F.col("k") != 10, F.when(F.col("k") == 1, 0.0).otherwise(F.col("close"))) if closes else F.col("close"),
        "adjclose": F.when(F.col("k") != 8, F.when(halved, F.col("adjclose") / 2).otherwise(F.col("adjclose"))) if closes else F.col("adjclose"),
        "volume": F.when(F.col("k") != 6, F.when(F.col("k") == 5, -F.col("volume")).otherwise(F.col("volume"))),
    }
    return b.select("symbol", "ts", *(x.alias(n) for n, x in faulty.items()))


view("tb_landed", "SELECT d.symbol, d.ts, d.open, d.low, d.high, b.close, b.adjclose, d.volume FROM tb_dirty d JOIN tb_bars b ON b.symbol = d.symbol AND b.ts = d.ts", "tb_dirty", "tb_bars")
view("tb_dirty", f"""
    SELECT symbol, ts, CASE k WHEN 0 THEN -open WHEN 3 THEN high * 1.5 WHEN 7 THEN low / 100 ELSE open END AS open,
           CASE k WHEN 2 THEN NULL WHEN 9 THEN close * 1.2 ELSE low END AS low,
           CASE k WHEN 4 THEN CAST('inf' AS DOUBLE) WHEN 11 THEN close * 0.5 ELSE high END AS high,
           CASE k WHEN 10 THEN NULL WHEN 1 THEN 0.0 ELSE close END AS close,
           CASE WHEN k = 8 THEN NULL WHEN CAST(substr(symbol, 7) AS INT) % 5 = 0 AND ts < TIMESTAMP '1996-01-01' THEN adjclose / 2 ELSE adjclose END AS adjclose,
           CASE k WHEN 6 THEN NULL WHEN 5 THEN -volume ELSE volume END AS volume
    FROM (SELECT *, {_FAULT} AS k FROM tb_bars)""", "tb_bars")  # fmt: skip


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns, value volumes and prices of :func:`bars`; cells whose fault rule says so have a missing return."""
    from ..operators.cleaning import open_to_open_return, value_volume

    b = value_volume(open_to_open_return(bars(spark, sf_dir)))
    gone = F.expr(f"{_FAULT} in (0, 1)")
    return b.select("symbol", "ts", F.when(~gone, F.col("return")).alias("ret"), "valuevolume", F.col("open").alias("price"))


view("tb_panel", f"""
    SELECT symbol, ts, CASE WHEN {_FAULT} IN (0, 1) THEN NULL ELSE lead(open) OVER (PARTITION BY symbol ORDER BY ts) / open - 1 END AS ret,
           volume * open AS valuevolume, open AS price FROM tb_bars""", "tb_bars")  # fmt: skip
view("tb_cal", "SELECT DISTINCT ts FROM tb_panel", "tb_panel")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percent rate for every third month, in the middle of it."""
    o = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("p"))
    return o.where("month(m) % 3 = 1").select((F.col("m") + F.expr("INTERVAL 14 DAYS")).alias("ts"), (F.col("p") / 100_000).alias("rate"))


view("tb_rate", """
    SELECT m + INTERVAL 14 DAY AS ts, p / 100000 AS rate FROM (
      SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, avg(o_totalprice) AS p FROM orders GROUP BY 1) WHERE month(m) % 3 = 1""")  # fmt: skip


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly snapshots of which symbols may be traded, by rule."""
    p = panel(spark, sf_dir).where("month(ts) % 3 = 1").select("ts", "symbol")
    return p.withColumn("tradable", F.expr("(CAST(substr(symbol, 7) AS INT) + year(ts) * 4 + quarter(ts)) % 5 <> 0"))


view("tb_member", """
    SELECT ts, symbol, (CAST(substr(symbol, 7) AS INT) + year(ts) * 4 + quarter(ts)) % 5 <> 0 AS tradable FROM tb_panel WHERE month(ts) % 3 = 1""", "tb_panel")  # fmt: skip


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five portfolios (market segments): signed value by brand and month, and a cash row.

    Customers meet orders before line items do, which are shuffled by order and by part alone; the sums, few whatever the number of line items, are
    written once, since queries read them many times.
    """
    from .market_job import stored

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sold = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    joined = lines.join(sold, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "l_shipdate", "l_extendedprice", "c_mktsegment")
    joined = joined.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    h = joined.groupBy(F.col("c_mktsegment").alias("portfolio_id"), F.date_trunc("month", "l_shipdate").alias("ts"), F.col("p_brand").alias("symbol")).agg(F.sum("l_extendedprice").alias("x"))
    h = stored(spark, h, "holdings")
    short = F.expr("(CAST(substr(symbol, 7) AS INT) + month(ts)) % 4 = 0")
    held = h.select("portfolio_id", "ts", "symbol", F.lit(False).alias("is_cash"), F.when(short, -F.col("x")).otherwise(F.col("x")).alias("h"))
    cash = h.groupBy("portfolio_id", "ts").agg((F.sum("x") * 0.6).alias("h"))
    return held.unionByName(cash.select("portfolio_id", "ts", F.lit("cash").alias("symbol"), F.lit(True).alias("is_cash"), "h"))


view("tb_gross", """
    SELECT c_mktsegment AS portfolio_id, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts, p_brand AS symbol, sum(l_extendedprice) AS x
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""")
view("tb_hold", """
    SELECT portfolio_id, ts, symbol, false AS is_cash, CASE WHEN (CAST(substr(symbol, 7) AS INT) + month(ts)) % 4 = 0 THEN -x ELSE x END AS h FROM tb_gross
    UNION ALL SELECT portfolio_id, ts, 'cash', true, sum(x) * 0.6 FROM tb_gross GROUP BY 1, 2""", "tb_gross")


def trades(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """What changes each holding (:func:`holdings`, or those ``held``) into its next one; cash pays for the rest."""
    from ..operators.trades import self_financing

    h = holdings(spark, sf_dir) if held is None else held
    nxt = F.lead("h").over(_by_position())
    return self_financing(h.select("portfolio_id", "ts", "symbol", "is_cash", F.coalesce(nxt - F.col("h"), F.lit(0.0)).alias("u")))


def _by_position():
    from pyspark.sql import Window

    return Window.partitionBy("portfolio_id", "symbol").orderBy("ts")


view("tb_trade0", "SELECT portfolio_id, ts, symbol, is_cash, coalesce(lead(h) OVER (PARTITION BY portfolio_id, symbol ORDER BY ts) - h, 0) AS u FROM tb_hold", "tb_hold")
view("tb_trade", """
    SELECT portfolio_id, ts, symbol, is_cash, CASE WHEN is_cash THEN -sum(CASE WHEN is_cash THEN 0 ELSE u END) OVER (PARTITION BY portfolio_id, ts) ELSE u END AS u FROM tb_trade0""", "tb_trade0")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks of twenty symbols."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")


view("tb_ticks", "SELECT CAST(user_id % 20 AS VARCHAR) AS symbol, ts, value AS price, event_id FROM events")


def period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash and benchmark returns of every portfolio's periods: the mean return of the panel is the benchmark."""
    bm = panel(spark, sf_dir).groupBy("ts").agg(F.avg("ret").alias("bm_ret"))
    keys = holdings(spark, sf_dir).where("is_cash").select("portfolio_id", "ts")
    return keys.join(bm, "ts", "left").select("portfolio_id", "ts", F.lit(0.002).alias("cash_ret"), "bm_ret")


view("tb_period", """
    SELECT portfolio_id, h.ts, CAST(0.002 AS DOUBLE) AS cash_ret, bm_ret FROM tb_hold h LEFT JOIN (SELECT ts, avg(ret) AS bm_ret FROM tb_panel GROUP BY 1) b ON h.ts = b.ts
    WHERE is_cash""", "tb_hold", "tb_panel")  # fmt: skip


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of every supplier: symbols, and with them rows, grow with the scale factor.

    Line items, hardly more than bars, are dealt by symbol, so that what follows by symbol needs no further exchange.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), *ORDER).repartition("symbol")
    price, order = F.col("l_extendedprice") / F.col("l_quantity"), F.struct(*ORDER)
    close = F.max_by(price, order)
    out = lines.groupBy("symbol", F.date_trunc("day", "l_shipdate").alias("ts"))
    return out.agg(
        F.min_by(price, order).alias("open"), F.min(price).alias("low"), F.max(price).alias("high"), close.alias("close"), close.alias("adjclose"), F.sum("l_quantity").alias("volume")
    )


def most_lines(spark: SparkSession, sf_dir: str) -> int:
    """The line items of the supplier that has most: at least the rows of any of :func:`daily_bars`' histories."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").count().agg(F.max("count")).first()[0] or 0


view("tb_daily", f"""
    SELECT 'S' || l_suppkey AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts,
           arg_min(l_extendedprice / l_quantity, row({', '.join(ORDER)})) AS open, min(l_extendedprice / l_quantity) AS low,
           max(l_extendedprice / l_quantity) AS high, arg_max(l_extendedprice / l_quantity, row({', '.join(ORDER)})) AS close,
           arg_max(l_extendedprice / l_quantity, row({', '.join(ORDER)})) AS adjclose, sum(l_quantity) AS volume
    FROM lineitem GROUP BY 1, 2""")  # fmt: skip


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns, value volumes and prices of :func:`daily_bars`."""
    from ..operators.cleaning import open_to_open_return, value_volume

    b = value_volume(open_to_open_return(daily_bars(spark, sf_dir)))
    return b.select("symbol", "ts", F.col("return").alias("ret"), "valuevolume", F.col("open").alias("price"))


view("tb_daily_panel", "SELECT symbol, ts, lead(open) OVER (PARTITION BY symbol ORDER BY ts) / open - 1 AS ret, volume * open AS valuevolume, open AS price FROM tb_daily", "tb_daily")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio for every customer: its value in every supplier's goods by month, and cash. Portfolios, and with them rows, grow with the scale factor."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    month = F.date_trunc("month", "l_shipdate").alias("ts")
    h = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    h = h.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("portfolio_id"), month, F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol")).agg(F.sum("l_extendedprice").alias("h"))
    cash = h.groupBy("portfolio_id", "ts").agg((F.sum("h") * 0.5).alias("h"))
    held = h.select("portfolio_id", "ts", "symbol", F.lit(False).alias("is_cash"), "h")
    return held.unionByName(cash.select("portfolio_id", "ts", F.lit("cash").alias("symbol"), F.lit(True).alias("is_cash"), "h"))


view("tb_books", """
    SELECT 'C' || o_custkey AS portfolio_id, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts, 'S' || l_suppkey AS symbol, sum(l_extendedprice) AS h
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""")


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ts, symbol, sigma, valuevolume, price)`` of every supplier's goods by month; months of little business have no known deviation."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    own = lines.groupBy(F.date_trunc("month", "l_shipdate").alias("ts"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"))
    out = own.agg(F.sum("l_extendedprice").alias("valuevolume"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.count("*").alias("n"))
    return out.select("ts", "symbol", F.when(F.col("n") > 1, 0.02).alias("sigma"), "valuevolume", "price")


view("tb_supply", """
    SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts, 'S' || l_suppkey AS symbol, CASE WHEN count(*) > 1 THEN 0.02::DOUBLE END AS sigma, sum(l_extendedprice) AS valuevolume,
           avg(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2""")
