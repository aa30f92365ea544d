"""Expressions and joins that all layers use."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

DAY = 86_400
YEAR_DAYS = 365.24


def by_symbol(*keys: str) -> WindowSpec:
    """Rows of a symbol (or of ``keys``) in time order."""
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("ts")


def seconds(ts: Column | str) -> Column:
    """Whole microseconds as a long, the key of time-range frames (interval frames would need equal units)."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def micros(length: float) -> int:
    return round(length * 1_000_000)


def finite(x: Column | str) -> Column:
    """NaN and infinities as missing."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def divided(a: Column, b: Column) -> Column:
    """a / b, missing where b is 0 (ANSI division would fail the job)."""
    return F.try_divide(a, b)


def log_of(x: Column) -> Column:
    """Natural logarithm, missing where x is not positive."""
    return F.when(x > 0, F.log(x))


def resample_return(annual: Column, periods: Column | float) -> Column:
    """The return of one of ``periods`` equal periods that compound to ``annual``."""
    return F.exp(F.log1p(annual) / periods) - 1


def rows_from_end(df: DataFrame, keys: Sequence[str] = ("symbol",), name: str = "from_end") -> DataFrame:
    """Numbers each key's rows from its last one, 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("ts").desc())))


def sorted_position(values: Column, key: Column, inclusive: bool = True, field: str | None = None) -> Column:
    """How many elements of a sorted array (or their ``field``) are at most, or without ``inclusive`` less than, ``key``: a binary search."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(31))))

    def step(at: Column, s: Column) -> Column:
        x = F.try_element_at(values, at + s)
        x = x if field is None else x[field]
        inside = (at + s <= F.size(values)) & ((x <= key) if inclusive else (x < key))
        return F.when(F.coalesce(inside, F.lit(False)), at + s).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def seen_from(panel: DataFrame, dates: DataFrame, days: int) -> DataFrame:
    """Each row of ``panel`` once for every date of ``dates(ts)`` (a calendar-sized list), as ``at``, that sees it among its past ``days``.

    The dates are one sorted array beside the rows; a row finds its own by binary search, so no range join compares all pairs.
    """
    listed = dates.select("ts").where("ts is not null").distinct().agg(F.sort_array(F.collect_list("ts")).alias("dates_"))
    after = sorted_position(F.col("dates_"), F.col("ts"))
    upto = sorted_position(F.col("dates_"), F.timestamp_micros(F.unix_micros("ts") + micros(days * DAY)))
    own = panel.join(F.broadcast(listed), how="left").withColumns({"after_": after, "upto_": upto})
    return own.withColumn("at", F.explode(F.slice("dates_", F.col("after_") + 1, F.col("upto_") - F.col("after_")))).drop("dates_", "after_", "upto_")


#: Rows of a right side that asof_join looks up as one array.
ARRAY_ROWS = 100_000


def asof_join(
    left: DataFrame, right: DataFrame, values: Sequence[str], by: Sequence[str] = (), forward: bool = False, exclusive: bool = False, on: str = "ts", bucket: float | None = None
) -> DataFrame:
    """``left`` with ``values`` of the last ``right`` row at or before its time (``forward``: the first at or after).

    The two sides are stacked and one window per key carries values along, so a row is shuffled once and no range join
    multiplies rows. ``exclusive`` leaves out right rows at the same time. A right row counts whatever its values: one that is
    null is carried as null (leave such rows out to have the value before them). Repeated right times: the greatest value wins (looking ahead: the least).

    Without ``by`` a right side of up to ``ARRAY_ROWS`` rows (a calendar; they are counted) is looked up as one sorted array, by binary search. A
    larger one is joined inside days, and where a day has nothing, by the last (first) row of the other days, which are an array again.

    With ``by``, ``bucket`` (seconds) does the same inside each key, for keys that hold so many rows that one task should not sort them: rows are dealt by key
    and time bucket, and what earlier (later) buckets hold last (first) is carried by a scan over a row for each key and bucket.
    """
    by = list(by)
    packed = F.struct(F.col(on).alias("t"), *(F.col(v).alias(v) for v in values))
    if not by:
        known = right.where(F.col(on).isNotNull())
        if known.limit(ARRAY_ROWS + 1).count() <= ARRAY_ROWS:
            return _asof_array(left, known.select(on, *values), values, forward, exclusive, on)
        day = F.floor(F.unix_micros(on) / float(micros(DAY)))
        inner = asof_join(left.withColumn("asof_day", day), known.select(day.alias("asof_day"), on, F.struct(*values).alias("asof_in")), ["asof_in"], ["asof_day"], forward, exclusive, on)
        edge = (F.min if forward else F.max)(packed).alias("x")
        days = known.groupBy(day.alias("asof_day")).agg(edge).select("asof_day", F.struct(*(F.col(f"x.{v}").alias(v) for v in values)).alias("asof_out"))
        outer = _asof_array(inner, days, ["asof_out"], forward, True, "asof_day")
        return outer.select(*left.columns, *(F.coalesce("asof_in", "asof_out")[v].alias(v) for v in values))
    if bucket is not None:
        return _asof_buckets(left, right.where(F.col(on).isNotNull()), values, by, forward, exclusive, on, bucket)
    # the window runs in the order of the search, so that it only ever grows (frames that end at the last row are summed anew for each row); ties: the
    # right row stands before the left one, or after it if exclusive
    side = 1 if exclusive else -1
    stacked = left.withColumns({"asof_row": F.lit(None), "asof_side": F.lit(0)}).unionByName(
        right.select(*by, on, packed.alias("asof_row"), F.lit(side).alias("asof_side")), allowMissingColumns=True
    )
    order = [F.col(on).desc_nulls_first(), "asof_side", F.col("asof_row").desc()] if forward else [on, "asof_side", "asof_row"]
    carried = F.last("asof_row", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = stacked.withColumn("asof_row", carried).where("asof_side = 0")
    return out.select(*left.columns, *(F.col(f"asof_row.{v}").alias(v) for v in values))


def _asof_buckets(left: DataFrame, right: DataFrame, values: Sequence[str], by: list[str], forward: bool, exclusive: bool, on: str, bucket: float) -> DataFrame:
    """:func:`asof_join` dealt by key and time bucket; a key's buckets are joined by their last (first) right rows."""
    at = F.floor(F.unix_micros(on) / float(micros(bucket)))
    keys = [*by, "asof_bucket"]
    inner = asof_join(left.withColumn("asof_bucket", at), right.select(*by, at.alias("asof_bucket"), on, F.struct(*values).alias("asof_in")), ["asof_in"], keys, forward, exclusive, on)
    packed = F.struct(F.col(on).alias("t"), F.struct(*values).alias("v"))
    edges = right.groupBy(*by, at.alias("asof_bucket")).agg((F.min if forward else F.max)(packed).alias("x")).select(*keys, F.col("x.v").alias("asof_out"))
    # a row for each key and bucket of the left side: the scan never sees the rows themselves
    asked = left.where(F.col(on).isNotNull()).select(*by, at.alias("asof_bucket")).distinct()
    carried = asof_join(asked, edges, ["asof_out"], by, forward, True, "asof_bucket")
    return inner.join(carried, keys, "left").select(*left.columns, *(F.coalesce("asof_in", "asof_out")[v].alias(v) for v in values))


def _asof_array(left: DataFrame, right: DataFrame, values: Sequence[str], forward: bool, exclusive: bool, on: str) -> DataFrame:
    """:func:`asof_join` with a counted right side as one sorted array beside the left rows."""
    packed = F.struct(F.col(on).alias("t"), *(F.col(v).alias(v) for v in values))
    table = right.agg(F.sort_array(F.collect_list(packed)).alias("asof_rows"))
    at = sorted_position(F.col("asof_rows"), F.col(on), inclusive=exclusive == forward, field="t")
    at = at + 1 if forward else F.nullif(at, F.lit(0))
    joined = left.join(F.broadcast(table), how="left").withColumn("asof_row", F.when(F.col(on).isNotNull(), F.try_element_at("asof_rows", at)))
    return joined.select(*left.columns, *(F.col(f"asof_row.{v}").alias(v) for v in values))


def param_lookup(keys: DataFrame, param: DataFrame | float, name: str = "v", asof: bool = False) -> DataFrame:
    """``keys(ts, symbol, …)`` with a user parameter as column ``name``.

    A number is a constant; a table ``(symbol, v)``, ``(ts, v)`` or ``(ts, symbol, v)`` is matched on the columns it has, on
    the exact time or, with ``asof``, on the last time at or before.
    """
    if not isinstance(param, DataFrame):
        return keys.withColumn(name, F.lit(float(param)))
    param = param.withColumnRenamed("v", name)
    on = [c for c in ("ts", "symbol") if c in param.columns]
    if asof and on == ["ts"]:  # looked up once for each distinct time, not for each row
        times = asof_join(keys.select("ts").distinct(), param, [name])
        return keys.join(times, "ts", "left").select(*keys.columns, name)
    if asof and "ts" in on:
        return asof_join(keys, param, [name], by=["symbol"])
    return keys.join(param.select(*on, name), on, "left").select(*keys.columns, name)


def param_audit(keys: DataFrame, param: DataFrame) -> DataFrame:
    """Rows of ``keys(ts, symbol)`` that a parameter leaves without a value, with the reason."""
    out = None
    for column, reason in (("ts", "missing time"), ("symbol", "missing symbol")):
        if column in param.columns:
            lost = keys.join(param.select(column).distinct(), column, "left_anti").select("ts", "symbol", F.lit(reason).alias("reason"))
            out = lost if out is None else out.unionByName(lost)
    on = [c for c in ("ts", "symbol") if c in param.columns]
    blank = keys.join(param.where("v is null").select(*on).distinct(), on, "left_semi").select("ts", "symbol", F.lit("missing value").alias("reason"))
    return blank if out is None else out.unionByName(blank)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under the session's ``spark.checkpoint.dir``; where it is unset, a temporary one for a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base}/{name}-{uuid4().hex}"
