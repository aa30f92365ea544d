"""Cleaning of bars, symbol by symbol but all symbols at once: every rule is a projection or a window by symbol."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.core import by_symbol, divided, finite, log_of, rows_from_end, shared_folder

WINDOWS = (10, 20, 50, 100, 200)
PRICES = ("open", "low", "high", "close")


def _last(column: str) -> Column:
    """The last known value up to each row."""
    return F.last(column, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def _whole() -> Window:
    return Window.partitionBy("symbol")


def null_infinite(bars: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN and infinities of the double columns become missing."""
    names = columns or [c for c, t in bars.dtypes if t == "double"]
    return bars.withColumns({c: finite(c) for c in names})


def null_nonpositive(bars: DataFrame, column: str) -> DataFrame:
    return bars.withColumn(column, F.when(F.col(column) > 0, F.col(column)))


def truncate_bad_dividends(bars: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Drops all rows up to the last one where adjusted and plain close imply a negative or too large dividend."""
    gap = F.log(_last("adjclose")) - F.log(_last("close"))
    with_gap = bars.withColumn("gap", gap)
    step = F.col("gap") - F.lag("gap").over(by_symbol())
    bad = (step < -1e-5) | (step > float(np.log1p(threshold)))
    last_bad = F.max(F.when(F.col("bad"), F.col("ts"))).over(_whole())
    kept = with_gap.withColumn("bad", bad).withColumn("last_bad", last_bad).where("last_bad is null or ts > last_bad")
    return kept.select(*bars.columns)


def truncate_missing_runs(bars: DataFrame, run: int = 20) -> DataFrame:
    """Drops all rows up to the end of the last run of ``run`` missing adjusted closes."""
    gone = F.sum(F.col("adjclose").isNull().cast("int")).over(by_symbol().rowsBetween(1 - run, 0))
    marked = bars.withColumn("full", gone == run)
    last = F.max(F.when(F.col("full"), F.col("ts"))).over(_whole())
    return marked.withColumn("last_full", last).where("last_full is null or ts > last_full").select(*bars.columns)


def drop_leading_null(bars: DataFrame, column: str = "adjclose") -> DataFrame:
    """Drops the rows before the column's first value."""
    return bars.withColumn("known", _last(column)).where("known is not null").select(*bars.columns)


def ffill(bars: DataFrame, column: str, saved: DataFrame | None = None) -> DataFrame:
    """Missing values repeat the last known one; ``saved`` rows of before may give the first, and are not returned."""
    if saved is None:
        return bars.withColumn(column, _last(column))
    tail = rows_from_end(saved).where("from_end <= 2").select("symbol", "ts", F.col(column))
    stacked = bars.withColumn("own", F.lit(True)).unionByName(tail.withColumn("own", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("own", "ts").rowsBetween(Window.unboundedPreceding, 0)
    return stacked.withColumn(column, F.last(column, ignorenulls=True).over(order)).where("own").select(*bars.columns)


def null_negative_volume(bars: DataFrame) -> DataFrame:
    return bars.withColumn("volume", F.when(F.col("volume") >= 0, F.col("volume")))


def fill_volume_zero(bars: DataFrame) -> DataFrame:
    return bars.withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def null_open_outside(bars: DataFrame) -> DataFrame:
    """An open below low, or above high, is missing."""
    out = (F.col("open") < F.col("low")) | (F.col("open") > F.col("high"))
    return bars.withColumn("open", F.when(~F.coalesce(out, F.lit(False)), F.col("open")))


def unlikeliness_score(x: Column | str, windows: Iterable[int] = WINDOWS) -> Column:
    """How large \\|x\\| is against its median around each row: the median over the windows of their ratios.

    Exact zeros count as missing, so that filled-in stretches do not pull the scale down. Windows are centred rows of a symbol. As an expression it
    sorts every window anew; :func:`with_scores` is the way for whole tables.
    """
    x = F.col(x) if isinstance(x, str) else x
    size = F.abs(F.nullif(x, F.lit(0.0)))
    ratios = []
    for w in windows:
        around = F.percentile(size, F.lit(0.5)).over(by_symbol().rowsBetween(-(w // 2), (w - 1) // 2))
        ratios.append(divided(size, around))
    known = F.sort_array(F.filter(F.array(*ratios), lambda r: r.isNotNull()))
    n = F.size(known)
    low, high = F.try_element_at(known, F.floor((n + 1) / 2).cast("int")), F.try_element_at(known, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2)


#: Rows of a chunk of a symbol's history, and those that each side of it is lent, so that every window is whole.
CHUNK, LENT = 8_192, max(WINDOWS) // 2


def in_chunks(rows: DataFrame, chunk: int | None, lent: int) -> DataFrame:
    """Rows with ``chunk_``, consecutive pieces of each symbol's history, ``own_``, false where a row is lent to the chunk before or behind, and the
    row's place ``at_`` (from 0) and the ``last_`` one of its symbol. Chunks are pieces of what is dealt by symbol already: no further exchange. Without a
    ``chunk`` each history is one, and ``last_`` the row's own place.
    """
    at = (F.row_number().over(by_symbol()) - 1).cast("long")
    if chunk is None:
        return rows.withColumn("at_", at).withColumns({"last_": F.col("at_"), "chunk_": F.lit(0).cast("long"), "own_": F.lit(True)})
    inside = F.pmod(F.col("at_"), F.lit(chunk))
    k = F.floor(F.col("at_") / chunk)
    mine = F.struct(k.alias("k"), F.lit(True).alias("own"))
    deals = F.array(
        mine,
        F.when((inside < lent) & (k > 0), F.struct((k - 1).alias("k"), F.lit(False).alias("own"))),
        F.when((inside >= chunk - lent) & (F.col("last_") >= (k + 1) * chunk), F.struct((k + 1).alias("k"), F.lit(False).alias("own"))),
    )
    placed = rows.withColumn("at_", at).withColumn("last_", F.max("at_").over(_whole()))
    return placed.withColumn("d_", F.explode(F.array_compact(deals))).withColumns({"chunk_": F.col("d_.k"), "own_": F.col("d_.own")}).drop("d_")


def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of rows in order of symbol and chunk, as tables of whole chunks with the place at which each begins."""
    held: pa.Table | None = None

    def differ(x: pa.ChunkedArray) -> np.ndarray:
        a, b = x.slice(1), x.slice(0, len(x) - 1)
        return pc.fill_null(pc.not_equal(a, b), False).to_numpy() | (a.is_null().to_numpy() != b.is_null().to_numpy())

    def starts(own: pa.Table) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], differ(own["symbol"]) | differ(own["chunk_"])]))

    for batch in batches:
        if batch.num_rows:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if (begun := starts(held))[-1]:
                yield held.slice(0, begun[-1]), begun[:-1]
                held = held.slice(begun[-1])
    if held is not None and len(held):
        yield held, starts(held)


def _medians(size: np.ndarray, at: np.ndarray, first: np.ndarray, stop: np.ndarray, w: int) -> np.ndarray:
    """The medians of the windows of ``w`` rows around the places ``at``, inside their groups' bounds."""
    place = at[:, None] + np.arange(-(w // 2), (w - 1) // 2 + 1)
    inside = (place >= first[:, None]) & (place < stop[:, None])
    held = np.sort(np.where(inside, size[np.clip(place, 0, len(size) - 1)], np.nan), axis=1)
    n = (~np.isnan(held)).sum(axis=1)
    low, high = (np.take_along_axis(held, np.maximum(k, 0)[:, None], axis=1)[:, 0] for k in ((n - 1) // 2, n // 2))
    return (low + high) / 2


def _middle(ratios: np.ndarray) -> np.ndarray:
    ratios = np.sort(ratios, axis=0)
    n = (~np.isnan(ratios)).sum(axis=0)
    low, high = (np.take_along_axis(ratios, np.maximum(k, 0)[None], axis=0)[0] for k in ((n - 1) // 2, n // 2))
    return np.where(n > 0, (low + high) / 2, np.nan)


def unlikely(x: np.ndarray, starts: np.ndarray, threshold: float) -> np.ndarray:
    """Whether :func:`scores_of` is above ``threshold``, without a median for most rows.

    A score above it needs three of the five windows, so one of the three smallest. A window's median can only be below size / threshold if at least
    half of its values are: those are counted for all rows, and the few rows left are scored.
    """
    near, size = sorted(WINDOWS)[:3], np.abs(x)
    if len(WINDOWS) != 5 or not threshold >= 1:
        return scores_of(x, starts) > threshold
    size[size == 0] = np.nan
    counted = np.where(np.isinf(size), np.nan, size)  # as in pandas' windows
    stops = np.append(starts[1:], len(x))
    groups = np.repeat(np.arange(len(starts)), stops - starts)
    pad = max(near)
    at = np.arange(len(x)) + (groups + 1) * pad
    padded = np.full(at[-1] + 1 + pad, np.nan)
    padded[at] = counted
    known = np.concatenate([[0], np.cumsum(~np.isnan(padded))])
    n = len(padded) - 2 * pad
    below = padded[pad : pad + n] / threshold * (1 + 1e-12)
    count, maybe, done = np.zeros(n, dtype=np.int16), np.zeros(n, dtype=bool), (0, 0)
    for w in near:
        low, high = -(w // 2), (w - 1) // 2 + 1
        for k in [*range(low, done[0]), *range(done[1], high)]:
            count += padded[pad + k : pad + k + n] < below
        done = low, high
        maybe |= 2 * count >= known[pad + high : pad + high + n] - known[pad + low : pad + low + n]
    rows = np.flatnonzero((maybe[at - pad] & ~np.isnan(size)) | np.isinf(size))
    out = np.zeros(len(x), dtype=bool)
    if 4 * len(rows) > len(x):
        return scores_of(x, starts) > threshold
    for some in np.split(rows, range(4096, len(rows), 4096)):
        first, stop = starts[groups[some]], stops[groups[some]]
        with np.errstate(invalid="ignore"):
            out[some] = _middle(np.stack([size[some] / _medians(counted, some, first, stop, w) for w in WINDOWS])) > threshold
    return out


def scores_of(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """:func:`unlikeliness_score` inside each of the groups that begin at ``starts``: sliding medians of all groups at once, kept apart by blank rows."""
    size = np.abs(x)
    size[size == 0] = np.nan
    group = np.zeros(len(x), dtype=np.int64)
    group[starts[1:]] = 1
    at = np.arange(len(x)) + np.cumsum(group) * max(WINDOWS)
    padded = np.full(at[-1] + 1, np.nan)
    padded[at] = size
    rolled = pd.Series(padded)
    return _middle(np.stack([size / rolled.rolling(w, center=True, min_periods=1).median().to_numpy()[at] for w in WINDOWS]))


def _by_chunk(rows: DataFrame, schema: T.StructType, fn: Callable[[pa.Table, np.ndarray], pa.Table], chunk: int | None, lent: int = LENT) -> DataFrame:
    """``fn`` of tables of chunks of histories, each with ``lent`` rows of both sides, and the places where they begin; columns that it leaves pass through as they are."""
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, starts in slabs(batches):
            own = fn(own, starts)
            yield from own.filter(own["own_"]).select(shape.names).cast(shape).to_batches()

    dealt = in_chunks(rows, chunk, lent).drop("at_", "last_").sortWithinPartitions("symbol", "chunk_", "ts")
    return dealt.mapInArrow(run, schema)


def _added(rows: DataFrame, new: dict[str, str], fn: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str, chunk: int) -> DataFrame:
    """Adds ``fn`` of columns (``{new: column}``) over chunks of histories."""

    def add(own: pa.Table, starts: np.ndarray) -> pa.Table:
        for name, column in new.items():
            own = own.append_column(name, pa.array(fn(own[column].to_numpy().astype(float), starts), from_pandas=True))
        return own

    return _by_chunk(rows, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {kind}" for n in new)).fields]), add, chunk)


def with_scores(rows: DataFrame, scores: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """Adds :func:`unlikeliness_score` of several columns (``{new: column}``) in one pass: sliding medians, a logarithm of the window a row, for all windows and columns.

    Histories come in chunks with half a window lent on each side; a task works on a few chunks at a time, however long the histories.
    """
    return _added(rows, scores, scores_of, "double", chunk)


def _beside_saved(bars: DataFrame, saved: DataFrame | None, prices: Sequence[str]) -> DataFrame:
    """``bars`` as ``own``, and the last 200 of the ``saved`` rows before each symbol's first one."""
    rows = bars.withColumn("own", F.lit(True))
    if saved is None:
        return rows
    tail = rows_from_end(saved.join(bars.groupBy("symbol").agg(F.min("ts").alias("begin")), "symbol").where("ts < begin"))
    tail = tail.where(f"from_end <= {max(WINDOWS)}").select("symbol", "ts", "close", *prices, F.lit(False).alias("own"))
    return rows.unionByName(tail, allowMissingColumns=True)


def _gaps(prices: Sequence[str]) -> dict[str, Column]:
    return {f"gap_{c}": log_of(F.col("close")) - log_of(F.col(c)) for c in prices}


def null_anomalous(bars: DataFrame, prices: str | Sequence[str], threshold: float = 20.0, saved: DataFrame | None = None) -> DataFrame:
    """Missing where ln(close / price) is very unlikely; ``saved`` cleaned rows of before only serve as reference. Several prices share one window."""
    prices = [prices] if isinstance(prices, str) else [*prices]
    rows = _beside_saved(bars, saved, prices).withColumns(_gaps(prices))
    rows = _added(rows, {f"wild_{c}": f"gap_{c}" for c in prices}, lambda x, starts: unlikely(x, starts, threshold), "boolean", CHUNK)
    return rows.where("own").withColumns({c: F.when(~F.col(f"wild_{c}"), F.col(c)) for c in prices}).select(*bars.columns)


def null_anomalous_prices(bars: DataFrame, threshold: float = 20.0, saved: DataFrame | None = None, chunk: int | None = CHUNK) -> DataFrame:
    """:func:`null_anomalous` of opens, :func:`fill_open`, :func:`null_low_high_incompatible`, and :func:`null_anomalous` of lows and highs, in one pass.

    What is lent reaches twice as far: lows and highs are scored beside rows whose opens are. Without a ``chunk`` histories come whole.
    """
    prices = ["open", "low", "high"]
    rows = _beside_saved(bars.withColumn("before_", F.lag("close").over(by_symbol())), saved, prices).withColumns(_gaps(prices))

    def judge(table: pa.Table, starts: np.ndarray) -> pa.Table:
        own = table["own"].to_numpy()
        x = {c: table[c].to_numpy().astype(float) for c in (*prices, "close", "before_", *(f"gap_{p}" for p in prices))}
        x["open"][own & unlikely(x["gap_open"], starts, threshold)] = np.nan
        x["open"] = np.where(own & np.isnan(x["open"]), x["before_"], x["open"])
        # an unknown comparison does not count
        off = {"low": (x["low"] > x["close"]) | (x["low"] > x["open"]), "high": (x["high"] < x["close"]) | (x["high"] < x["open"])}
        for c, bad in off.items():
            x[f"gap_{c}"][own & bad] = np.nan
            x[c][own & (bad | unlikely(x[f"gap_{c}"], starts, threshold))] = np.nan
        for c in prices:
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(x[c], from_pandas=True))
        return table

    return _by_chunk(rows, rows.schema, judge, chunk, 2 * LENT).where("own").select(*bars.columns)


def fill_open(bars: DataFrame) -> DataFrame:
    return bars.withColumn("open", F.coalesce("open", F.lag("close").over(by_symbol())))


def null_low_high_incompatible(bars: DataFrame) -> DataFrame:
    """Low above close or open, and high below close or open, are missing."""
    low = F.coalesce((F.col("low") > F.col("close")) | (F.col("low") > F.col("open")), F.lit(False))
    high = F.coalesce((F.col("high") < F.col("close")) | (F.col("high") < F.col("open")), F.lit(False))
    # an unknown comparison beside a true one is true, beside a false one unknown: it does not count
    low = low | F.coalesce(F.col("low") > F.col("close"), F.lit(False)) | F.coalesce(F.col("low") > F.col("open"), F.lit(False))
    high = high | F.coalesce(F.col("high") < F.col("close"), F.lit(False)) | F.coalesce(F.col("high") < F.col("open"), F.lit(False))
    return bars.withColumns({"low": F.when(~low, F.col("low")), "high": F.when(~high, F.col("high"))})


def fill_low(bars: DataFrame) -> DataFrame:
    return bars.withColumn("low", F.coalesce("low", F.least("open", "close")))


def fill_high(bars: DataFrame) -> DataFrame:
    return bars.withColumn("high", F.coalesce("high", F.greatest("open", "close")))


def open_to_open_total_return(bars: DataFrame) -> DataFrame:
    """Adds ``return``: from open to the next open, with what adjusted closes say of dividends and splits."""
    intraday = F.log("close") - F.log("open")
    w = by_symbol()
    total = F.lead(F.log("adjclose")).over(w) - F.log("adjclose") + intraday - F.lead(intraday).over(w)
    return bars.withColumn("return", F.exp(total) - 1)


def open_to_open_return(bars: DataFrame) -> DataFrame:
    return bars.withColumn("return", divided(F.lead("open").over(by_symbol()), F.col("open")) - 1)


def null_last_row(bars: DataFrame, columns: Iterable[str] = ("high", "low", "close", "return", "volume")) -> DataFrame:
    """What the last bar has not settled yet is missing."""
    numbered = rows_from_end(bars)
    return numbered.withColumns({c: F.when(F.col("from_end") > 1, F.col(c)) for c in columns if c in bars.columns}).select(*bars.columns)


def value_volume(bars: DataFrame) -> DataFrame:
    return bars.withColumn("valuevolume", F.col("volume") * F.col("open")).drop("volume")


def drop_first_if_null(bars: DataFrame) -> DataFrame:
    """Drops a symbol's first row if any of its columns is missing."""
    blank = F.greatest(*(F.col(c).isNull() for c in bars.columns))
    first = F.row_number().over(by_symbol()) == 1
    return bars.withColumn("drop", first & blank).where("not drop").select(*bars.columns)


def quality_flags(clean: DataFrame, threshold: float = 40.0) -> DataFrame:
    """Rows ``(symbol, ts, flag, score)``: zero volumes, and extreme log returns of four kinds."""
    log_open = log_of(F.col("open"))
    scores = {
        "total return": F.log1p("return"),
        "open to close": log_of(F.col("close")) - log_open,
        "open to high": log_of(F.col("high")) - log_open,
        "open to low": log_of(F.col("low")) - log_open,
    }
    scored = with_scores(clean.select("symbol", "ts", "volume", *(v.alias(f"of {k}") for k, v in scores.items())), {k: f"of {k}" for k in scores})
    scored = scored.withColumn("zero volume", F.when(F.col("volume") == 0, F.lit(float("inf"))))
    flags = [*scores, "zero volume"]
    long = scored.select("symbol", "ts", *flags).unpivot(["symbol", "ts"], flags, "flag", "score")
    return long.where(F.col("score") > threshold).withColumn("score", finite("score"))


def log_return_curve(clean: DataFrame, column: str = "return", base10: bool = False) -> DataFrame:
    """Cumulative log returns of each symbol, shifted to end at 0."""
    growth = F.log1p(column) / (float(np.log(10)) if base10 else 1.0)
    running = F.sum(growth).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return clean.withColumn("curve", running - F.sum(growth).over(_whole()))


def cleaning_summary(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Per symbol: share of rows dropped, extreme log returns, share of zero volumes."""
    before = raw.groupBy("symbol").agg(F.count("*").alias("rows_before"))
    after = clean.groupBy("symbol").agg(
        F.count("*").alias("rows_after"), F.min(F.log1p("return")).alias("min_log_return"), F.max(F.log1p("return")).alias("max_log_return"), F.avg((F.col("volume") == 0).cast("double")).alias("zero_volume")
    )
    out = before.join(after, "symbol", "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0).cast("long")))
    return out.withColumn("dropped", 1 - F.col("rows_after") / F.col("rows_before"))


# ---- data-dependent repair: chunks of a symbol's history in pandas ---------------------------------------------------

#: Rows that a chunk of the repair is lent on each side for every pass: what one pass can carry along, and room for gaps.
CARRIED = LENT + 21


def _filled(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each value or the last known one before it in its group; ``first`` has the place at which a row's group begins."""
    at = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))
    return np.where(at >= first, x[np.maximum(at, 0)], np.nan)


def _sure(known: np.ndarray, low: int, high: int, begins: bool, ends: bool) -> tuple[int, int]:
    """The rows of ``low`` to ``high`` that one more pass leaves certain, if what lies beyond an end that is not the history's may change."""
    if not begins:
        later = known[np.searchsorted(known, low) :]
        low = (int(later[0]) if len(later) else high) + LENT + 1
    return low, high if ends else high - LENT


def repair_slab(own: pa.Table, starts: np.ndarray, passes: int = 21, threshold: float = 50.0, false_above: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of bars in order: which rows are blanked, around anomalous adjusted closes until none is left, or ``passes`` are done, and which are in doubt.

    Rows with a ``step_`` are of before (cleaned bars that lend their steps). In doubt is what lies beyond the chunk's lent rows might have changed.
    """
    n = len(own)
    stops = np.append(starts[1:], n)
    first = np.repeat(starts, stops - starts)
    earlier = own["earlier_"].to_numpy()
    given = own["step_"].to_numpy().astype(float)
    before = own["before_"].fill_null(False).to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        close = np.log10(own["adjclose"].to_numpy().astype(float))
    blank = np.zeros(n, dtype=bool)
    ends_group = np.zeros(n, dtype=bool)
    ends_group[stops - 1] = True
    place, last = own["at_"].to_numpy(), own["last_"].to_numpy()
    sure = {}  # chunks that do not hold their symbol's whole history: the rows that are certain
    for low, high in zip(starts.tolist(), stops.tolist()):
        begins, ends = place[low] <= 0, place[high - 1] == last[high - 1]
        if not (begins and ends):
            sure[low] = (low, high, begins, ends, low, high)
    for _ in range(passes):
        filled = _filled(close, first)
        steps = np.concatenate([[np.nan], np.diff(filled)])
        steps[starts] = np.nan
        steps = np.where(earlier, given, steps)
        steps[1:][earlier[:-1] & ~earlier[1:]] = np.nan
        wild = unlikely(steps, starts, threshold) | ((np.abs(steps) > false_above) & before)
        wild &= ~earlier
        bad = wild | np.append(wild[1:] & ~ends_group[:-1], False)
        bad &= ~earlier
        for k, (low, high, begins, ends, a, b) in sure.items():
            known = low + np.flatnonzero(~np.isnan(close[low:high]))
            sure[k] = (low, high, begins, ends, *_sure(known, a, b, begins, ends))
        if not (bad & ~blank).any() and not sure:
            break
        blank |= bad
        close[bad] = np.nan
    doubt = np.zeros(n, dtype=bool)
    for low, high, *_, a, b in sure.values():
        doubt[low:high] = True
        doubt[max(low, a) : max(low, min(high, b))] = False
    return blank, doubt


def _steps(saved: DataFrame) -> DataFrame:
    """``(symbol, ts, step_)`` of the last 200 rows of cleaned bars: the steps that adjusted closes would have taken."""
    intraday = F.log10("close") - F.log10("open")
    w = by_symbol()
    tail = rows_from_end(saved).where(f"from_end <= {max(WINDOWS)}")
    step = F.log10(1 + F.col("return")) - intraday + F.lead(intraday).over(w)
    return tail.withColumn("step_", step).withColumn("step_", F.lag("step_").over(w)).select("symbol", "ts", "step_")


def longest_history(bars: DataFrame) -> int:
    """The rows of the symbol that has most; counts by symbol and task reach one task."""
    return bars.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0


def null_bad_adjclose(bars: DataFrame, saved: DataFrame | None = None, chunk: int = CHUNK, longest: int | None = None, false_before: str = "2000-01-01", **how) -> DataFrame:
    """:func:`repair_slab` for every symbol; ``saved`` are cleaned bars with ``return`` that lend their last 200 rows' steps.

    Histories of more than ``chunk`` rows are repaired in chunks with rows lent on each side, enough for what ``passes`` passes can carry. Each chunk tells
    which of its own rows something beyond its lent rows might still have changed; symbols with such rows are repaired again in chunks four times as long,
    until nothing can move, so the result is that of whole histories. Shorter histories are one lazy pass; ``longest`` is at least the rows of the longest
    one; these are counted if it is not given or beyond a chunk.
    """
    lent = how.get("passes", 21) * CARRIED
    chunk = max(chunk, 2 * lent)

    values = [c for c in bars.columns if c not in ("symbol", "ts")]
    schema = T.StructType([*bars.schema.fields, T.StructField("doubt_", T.BooleanType())])
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, starts in slabs(batches):
            blank, doubt = repair_slab(own, starts, **how)
            if blank.any():
                for c in values:
                    own = own.set_column(own.schema.get_field_index(c), c, pc.if_else(pa.array(blank), pa.scalar(None, own[c].type), own[c]))
            own = own.append_column("doubt_", pa.array(doubt))
            yield from own.filter(own["own_"]).select(shape.names).cast(shape).to_batches()

    def repaired(some: DataFrame, chunk: int | None, lent: int) -> DataFrame:
        rows = in_chunks(some, chunk, lent).withColumns({"step_": F.lit(None).cast("double"), "earlier_": F.lit(False), "before_": F.col("ts") < F.lit(false_before).cast("timestamp")})
        if saved is not None:
            # fresh columns: the two sides may come from one table
            old = saved.select(*(F.col(c).alias(c) for c in ("symbol", "ts", "open", "close", "return")))
            begin = some.groupBy("symbol").agg(F.min("ts").alias("begin_"))
            old = _steps(old).join(begin, "symbol").where("ts < begin_").drop("begin_")
            old = old.withColumns({"chunk_": F.lit(0).cast("long"), "own_": F.lit(False), "at_": F.lit(-1).cast("long"), "earlier_": F.lit(True)})
            rows = rows.unionByName(old, allowMissingColumns=True)
        dealt = rows.repartition("symbol") if saved is not None else rows
        ordered = dealt.sortWithinPartitions("symbol", "chunk_", F.desc("earlier_"), "ts")
        return ordered.mapInArrow(run, schema)

    if (longest is not None and longest <= chunk) or longest_history(bars) <= chunk:
        return repaired(bars, None, 0).drop("doubt_")
    done, todo = None, bars
    while True:
        # written down: the rows are looked at again
        path = f"{shared_folder(bars.sparkSession, 'repaired')}/rows"
        repaired(todo, chunk, lent).write.parquet(path)
        out = bars.sparkSession.read.parquet(path)
        doubtful = out.where("doubt_").select("symbol").distinct()
        sound = out.join(doubtful, "symbol", "left_anti").drop("doubt_").select(*bars.columns)
        done = sound if done is None else done.unionByName(sound)
        if doubtful.isEmpty():
            return done
        todo, chunk, lent = todo.join(doubtful, "symbol", "left_semi"), 4 * chunk, 4 * lent


def clean_ohlcv(bars: DataFrame, saved: DataFrame | None = None, anomalous: float = 20.0, longest: int | None = None) -> DataFrame:
    """Open, low, high, close and volume rules in their order; adjusted closes are left alone. ``anomalous`` is the score from which a price is dropped;
    if no history has more rows than a chunk (``longest`` is at least their number), none is cut."""
    for column in PRICES:
        bars = null_nonpositive(bars, column)
    bars = ffill(null_infinite(bars), "close", saved)
    bars = null_open_outside(fill_volume_zero(null_negative_volume(bars)))
    return fill_high(fill_low(null_anomalous_prices(bars, anomalous, saved, CHUNK if longest is None or longest > CHUNK else None)))


def clean_bars(bars: DataFrame, saved: DataFrame | None = None, max_dividend: float = 0.2, missing_run: int = 20, anomalous: float = 20.0, longest: int | None = None, **repair) -> DataFrame:
    """The whole pipeline: adjusted closes, then the bars, then total returns. All steps share one exchange by symbol.

    ``max_dividend`` and ``missing_run`` go to the truncations, ``anomalous`` to the price rules, and ``repair`` (``passes``, ``threshold``,
    ``false_above``, ``false_before``) to :func:`null_bad_adjclose`. ``longest`` is at least the rows of the longest history, for callers to whom that is
    cheaper than a count of the bars.
    """
    if longest is None:
        longest = longest_history(bars)  # before rows leave: a count that needs none of the rules
    bars = null_nonpositive(null_infinite(bars), "adjclose")
    bars = truncate_missing_runs(truncate_bad_dividends(bars, max_dividend), missing_run)
    bars = truncate_missing_runs(null_bad_adjclose(bars, saved, longest=longest, **repair), missing_run)
    bars = drop_leading_null(ffill(bars, "adjclose"))
    return open_to_open_total_return(clean_ohlcv(bars, saved, anomalous, longest)).drop("adjclose")
