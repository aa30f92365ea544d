"""Cleaning rules over monthly bars with known faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as c
from . import testbeds as tb
from .registry import query, rnd, shown, view

ALL = ["symbol", "ts", "open", "low", "high", "close", "adjclose", "volume"]
W = "OVER (PARTITION BY symbol ORDER BY ts)"
SOFAR = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def sql(select: str, source: str = "tb_dirty") -> str:
    return f"SELECT symbol, CAST(ts AS DATE) AS ts, {select} FROM {source}"


def r(x: str, name: str = "", digits: int = 9) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


FINITE = "CASE WHEN isfinite({0}) THEN {0} END"


@query("null_infinite", sql(r(FINITE.format("high"), "high")), "tb_dirty")
def _(spark, sf):
    return shown(c.null_infinite(tb.dirty_bars(spark, sf)), "symbol", "ts", "high")


@query("null_nonpositive", sql(r("CASE WHEN close > 0 THEN close END", "close")), "tb_dirty")
def _(spark, sf):
    return shown(c.null_nonpositive(tb.dirty_bars(spark, sf), "close"), "symbol", "ts", "close")


@query("truncate_bad_dividends", f"""
    , g AS (SELECT *, ln(last_value(adjclose IGNORE NULLS) {SOFAR}) - ln(last_value(CASE WHEN close > 0 THEN close END IGNORE NULLS) {SOFAR}) AS gap FROM tb_dirty),
    s AS (SELECT *, gap - lag(gap) {W} AS step FROM g),
    b AS (SELECT *, max(CASE WHEN step < -1e-5 OR step > ln(1.2) THEN ts END) OVER (PARTITION BY symbol) AS last_bad FROM s)
    SELECT symbol, CAST(ts AS DATE) AS ts, round(adjclose, 9) + 0.0 AS adjclose FROM b WHERE last_bad IS NULL OR ts > last_bad""", "tb_dirty")
def _(spark, sf):
    bars = c.null_nonpositive(tb.dirty_bars(spark, sf), "close")
    return shown(c.truncate_bad_dividends(bars), "symbol", "ts", "adjclose")


@query("truncate_missing_runs", f"""
    , f AS (SELECT *, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) = 5 AS hit
            FROM (SELECT symbol, ts, CASE WHEN month(ts) <= 5 AND year(ts) % 3 = CAST(substr(symbol, 7) AS INT) % 3 THEN NULL ELSE adjclose END AS x FROM tb_bars)),
    b AS (SELECT *, max(CASE WHEN hit THEN ts END) OVER (PARTITION BY symbol) AS last_hit FROM f)
    SELECT symbol, CAST(ts AS DATE) AS ts, round(x, 9) + 0.0 AS adjclose FROM b WHERE last_hit IS NULL OR ts > last_hit""", "tb_bars")
def _(spark, sf):
    gone = F.expr("month(ts) <= 5 AND year(ts) % 3 = CAST(substr(symbol, 7) AS INT) % 3")
    bars = tb.bars(spark, sf).withColumn("adjclose", F.when(~gone, F.col("adjclose")))
    return shown(c.truncate_missing_runs(bars, run=5), "symbol", "ts", "adjclose")


@query("ffill", sql(r(f"last_value(close IGNORE NULLS) {SOFAR}", "close")), "tb_dirty")
def _(spark, sf):
    return shown(c.ffill(tb.dirty_bars(spark, sf), "close"), "symbol", "ts", "close")


@query("ffill_saved", f"""
    , cutoff AS (SELECT TIMESTAMP '1998-01-01' AS t),
    s AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM tb_dirty, cutoff WHERE ts < t),
    a AS (SELECT symbol, ts, close, 0 AS own FROM s WHERE k <= 2
          UNION ALL SELECT symbol, ts, CASE WHEN month(ts) <> 1 THEN close END, 1 FROM tb_dirty, cutoff WHERE ts >= t),
    f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY own, ts ROWS UNBOUNDED PRECEDING) AS x FROM a)
    SELECT symbol, CAST(ts AS DATE) AS ts, round(x, 9) + 0.0 AS close FROM f WHERE own = 1""", "tb_dirty")
def _(spark, sf):
    bars = tb.dirty_bars(spark, sf)
    new = bars.where("ts >= '1998-01-01'").withColumn("close", F.when(F.month("ts") != 1, F.col("close")))
    return shown(c.ffill(new, "close", bars.where("ts < '1998-01-01'")), "symbol", "ts", "close")


@query("drop_leading_null", f"""
    , f AS (SELECT *, last_value(x IGNORE NULLS) {SOFAR} AS known FROM (
        SELECT symbol, ts, CASE WHEN year(ts) > 1994 + CAST(substr(symbol, 7) AS INT) % 4 THEN adjclose END AS x FROM tb_dirty))
    SELECT symbol, CAST(ts AS DATE) AS ts, round(x, 9) + 0.0 AS adjclose FROM f WHERE known IS NOT NULL""", "tb_dirty")
def _(spark, sf):
    late = F.expr("year(ts) > 1994 + CAST(substr(symbol, 7) AS INT) % 4")
    bars = tb.dirty_bars(spark, sf).withColumn("adjclose", F.when(late, F.col("adjclose")))
    return shown(c.drop_leading_null(bars), "symbol", "ts", "adjclose")


@query("null_negative_volume", sql(r("CASE WHEN volume >= 0 THEN volume END", "volume")), "tb_dirty")
def _(spark, sf):
    return shown(c.null_negative_volume(tb.dirty_bars(spark, sf)), "symbol", "ts", "volume")


@query("fill_volume_zero", sql(r("coalesce(CASE WHEN volume >= 0 THEN volume END, 0)", "volume")), "tb_dirty")
def _(spark, sf):
    return shown(c.fill_volume_zero(c.null_negative_volume(tb.dirty_bars(spark, sf))), "symbol", "ts", "volume")


@query("null_open_outside", sql(r("CASE WHEN open < low OR open > high THEN NULL ELSE open END", "open")), "tb_dirty")
def _(spark, sf):
    return shown(c.null_open_outside(tb.dirty_bars(spark, sf)), "symbol", "ts", "open")


def _score_sql(x: str, source: str, windows: tuple[int, ...]) -> str:
    """CTEs that add ``score`` of the expression ``x`` to ``source`` as ``scored``."""
    parts = ", ".join(f"a / nullif(median(a) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING), 0) AS s{w}" for w in windows)
    listed = ", ".join(f"s{w}" for w in windows)
    return f"""sized AS (SELECT *, abs(nullif({x}, 0)) AS a FROM {source}), ratios AS (SELECT *, {parts} FROM sized),
        scored AS (SELECT *, list_aggregate([{listed}], 'median') AS score FROM ratios)"""


GAP = "ln(CASE WHEN close > 0 THEN close END) - ln(CASE WHEN open > 0 THEN open END)"


@query("unlikeliness_score", f", {_score_sql(GAP, 'tb_dirty', (10, 20, 50))} SELECT symbol, CAST(ts AS DATE) AS ts, round(score, 9) + 0.0 AS score FROM scored", "tb_dirty")
def _(spark, sf):
    from ..functions.core import log_of

    bars = tb.dirty_bars(spark, sf).withColumn("gap", log_of(F.col("close")) - log_of(F.col("open")))
    return shown(bars.withColumn("score", c.unlikeliness_score("gap", (10, 20, 50))), "symbol", "ts", "score")


@query("null_anomalous", f", {_score_sql(GAP, 'tb_dirty', c.WINDOWS)} SELECT symbol, CAST(ts AS DATE) AS ts, round(CASE WHEN score > 20 THEN NULL ELSE open END, 9) + 0.0 AS open FROM scored", "tb_dirty")
def _(spark, sf):
    return shown(c.null_anomalous(tb.dirty_bars(spark, sf), "open"), "symbol", "ts", "open")


@query("fill_open", sql(r(f"coalesce(CASE WHEN open > 0 THEN open END, lag(close) {W})", "open")), "tb_dirty")
def _(spark, sf):
    return shown(c.fill_open(c.null_nonpositive(tb.dirty_bars(spark, sf), "open")), "symbol", "ts", "open")


@query("null_low_high_incompatible", sql(r("CASE WHEN low > close OR low > open THEN NULL ELSE low END", "low") + ", " + r(f"CASE WHEN high < close OR high < open THEN NULL ELSE {FINITE.format('high')} END", "high")), "tb_dirty")
def _(spark, sf):
    return shown(c.null_low_high_incompatible(c.null_infinite(tb.dirty_bars(spark, sf))), "symbol", "ts", "low", "high")


@query("fill_low", sql(r("coalesce(low, least(open, close))", "low")), "tb_dirty")
def _(spark, sf):
    return shown(c.fill_low(tb.dirty_bars(spark, sf)), "symbol", "ts", "low")


@query("fill_high", sql(r(f"coalesce({FINITE.format('high')}, greatest(open, close))", "high")), "tb_dirty")
def _(spark, sf):
    return shown(c.fill_high(c.null_infinite(tb.dirty_bars(spark, sf))), "symbol", "ts", "high")


TOTAL = f"exp(ln(lead(adjclose) {W}) - ln(adjclose) + ln(close) - ln(open) - (ln(lead(close) {W}) - ln(lead(open) {W}))) - 1"


@query("open_to_open_total_return", sql(r(TOTAL, "ret"), "tb_bars"), "tb_bars")
def _(spark, sf):
    return shown(c.open_to_open_total_return(tb.bars(spark, sf)).withColumnRenamed("return", "ret"), "symbol", "ts", "ret")


@query("open_to_open_return", sql(r(f"lead(open) {W} / open - 1", "ret"), "tb_bars"), "tb_bars")
def _(spark, sf):
    return shown(c.open_to_open_return(tb.bars(spark, sf)).withColumnRenamed("return", "ret"), "symbol", "ts", "ret")


@query("null_last_row", f"""
    , n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) > 1 AS ok FROM tb_bars)
    SELECT symbol, CAST(ts AS DATE) AS ts, {', '.join(r(f'CASE WHEN ok THEN {x} END', x) for x in ('high', 'low', 'close', 'volume'))}, {r('open')} FROM n""", "tb_bars")
def _(spark, sf):
    return shown(c.null_last_row(tb.bars(spark, sf)), "symbol", "ts", "high", "low", "close", "volume", "open")


@query("value_volume", sql("volume * open AS valuevolume", "tb_bars"), "tb_bars")
def _(spark, sf):
    return c.value_volume(tb.bars(spark, sf)).select("symbol", F.to_date("ts").alias("ts"), "valuevolume")


@query("drop_first_if_null", f"""
    , n AS (SELECT *, row_number() {W} AS k FROM tb_dirty)
    SELECT symbol, CAST(ts AS DATE) AS ts, {r('close')} FROM n WHERE k > 1 OR (open IS NOT NULL AND low IS NOT NULL AND high IS NOT NULL AND close IS NOT NULL AND adjclose IS NOT NULL AND volume IS NOT NULL)""", "tb_dirty")
def _(spark, sf):
    return shown(c.drop_first_if_null(tb.dirty_bars(spark, sf)), "symbol", "ts", "close")


def _flag_sql() -> str:
    kinds = {"total return": "ln(1 + ret)", "open to close": "ln(close) - ln(open)", "open to high": "ln(high) - ln(open)", "open to low": "ln(low) - ln(open)"}
    parts = []
    for name, x in kinds.items():
        parts.append(f"SELECT * FROM (WITH {_score_sql(x, 'q0', c.WINDOWS)} SELECT symbol, ts, '{name}' AS flag, score FROM scored WHERE score > 4)")
    parts.append("SELECT symbol, ts, 'zero volume' AS flag, CAST(NULL AS DOUBLE) AS score FROM q0 WHERE volume = 0")
    q0 = f"q0 AS (SELECT symbol, ts, open, low, high, close, CASE WHEN volume < 400 THEN 0 ELSE volume END AS volume, lead(open) {W} / open - 1 AS ret FROM tb_bars)"
    return f", {q0} SELECT symbol, CAST(ts AS DATE) AS ts, flag, round(score, 9) + 0.0 AS score FROM ({' UNION ALL '.join(parts)})"


@query("quality_flags", _flag_sql(), "tb_bars")
def _(spark, sf):
    bars = c.open_to_open_return(tb.bars(spark, sf)).withColumn("volume", F.when(F.col("volume") < 400, 0.0).otherwise(F.col("volume")))
    return shown(c.quality_flags(bars, threshold=4.0), "symbol", "ts", "flag", "score")


@query("log_return_curve", f"""
    , q AS (SELECT symbol, ts, ln(1 + (lead(open) {W} / open - 1)) AS g FROM tb_bars)
    SELECT symbol, CAST(ts AS DATE) AS ts, round(sum(g) {SOFAR} - sum(g) OVER (PARTITION BY symbol), 9) + 0.0 AS curve FROM q""", "tb_bars")
def _(spark, sf):
    return shown(c.log_return_curve(c.open_to_open_return(tb.bars(spark, sf))), "symbol", "ts", "curve")


view("tb_clean", f"""
    SELECT symbol, ts, o AS open, low, h AS high, c AS close, volume, lead(o) {W} / o - 1 AS ret FROM (
      SELECT symbol, ts, coalesce(CASE WHEN open > 0 THEN open END, lag(close) {W}) AS o, low, {FINITE.format('high')} AS h, CASE WHEN close > 0 THEN close END AS c,
             coalesce(CASE WHEN volume >= 0 THEN volume END, 0) AS volume FROM tb_dirty) WHERE c IS NOT NULL""", "tb_dirty")


@query("cleaning_summary", f"""
    SELECT symbol, rows_before, coalesce(rows_after, 0) AS rows_after, {r('min_log_return')}, {r('max_log_return')}, {r('zero_volume')}, {r('1 - coalesce(rows_after, 0) / rows_before', 'dropped')}
    FROM (SELECT symbol, count(*) AS rows_before FROM tb_dirty GROUP BY 1) LEFT JOIN (
      SELECT symbol, count(*) AS rows_after, min(ln(1 + ret)) AS min_log_return, max(ln(1 + ret)) AS max_log_return, avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0 END) AS zero_volume
      FROM tb_clean GROUP BY 1) USING (symbol)""", "tb_clean")
def _(spark, sf):
    raw = tb.dirty_bars(spark, sf)
    some = c.fill_volume_zero(c.null_negative_volume(c.null_nonpositive(c.null_infinite(raw), "open")))
    some = c.null_nonpositive(some.withColumn("open", F.coalesce("open", F.lag(F.col("close")).over(c.by_symbol()))), "close")
    return shown(c.cleaning_summary(raw, c.open_to_open_return(some.where("close is not null"))))


VALUES = ("open", "low", "high", "close", "adjclose", "volume")


def repair_views(prefix: str, source: str, threshold: float, above: float, passes: int) -> str:
    """Views of the repair of adjusted closes, its passes one after the other; the last one's name. A pass that finds nothing changes nothing."""
    for k in range(passes):
        view(f"{prefix}_step{k}", f"SELECT *, log10(f) - lag(log10(f)) {W} AS step FROM (SELECT *, last_value(adjclose IGNORE NULLS) {SOFAR} AS f FROM {source})", source)
        values = ", ".join(f"CASE WHEN NOT (wild OR coalesce(lead(wild) {W}, false)) THEN {x} END AS {x}" for x in VALUES)
        wild = f"coalesce(score > {threshold}, false) OR coalesce(abs(step) > {above} AND ts < TIMESTAMP '2000-01-01', false)"
        view(f"{prefix}_pass{k}", f"SELECT symbol, ts, {values} FROM (WITH {_score_sql('step', f'{prefix}_step{k}', c.WINDOWS)} SELECT *, {wild} AS wild FROM scored)", f"{prefix}_step{k}")
        source = f"{prefix}_pass{k}"
    return source


def clean_views(prefix: str, source: str, dividend: float, run: int, anomalous: float, threshold: float, above: float, passes: int = 6) -> str:
    """Views of the whole cleaning of ``source``; the last one's name."""
    at, number = source, 0

    def step(text: str, *needs: str) -> None:
        nonlocal at, number
        name, number = f"{prefix}_{number}", number + 1
        view(name, text.replace("{src}", at), at, *needs)
        at = name

    def scored(price: str) -> str:
        gap = f"CASE WHEN close > 0 THEN ln(close) END - CASE WHEN {price} > 0 THEN ln({price}) END"
        return f"SELECT * EXCLUDE (a, score, {', '.join(f's{w}' for w in c.WINDOWS)}) REPLACE (CASE WHEN score > {anomalous} THEN NULL ELSE {price} END AS {price}) FROM (WITH {_score_sql(gap, '{src}', c.WINDOWS)} SELECT * FROM scored)"

    missing = f"SELECT * EXCLUDE (hit, last_hit) FROM (SELECT *, max(CASE WHEN hit THEN ts END) OVER (PARTITION BY symbol) AS last_hit FROM (SELECT *, sum(CASE WHEN adjclose IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS {run - 1} PRECEDING) = {run} AS hit FROM {{src}})) WHERE last_hit IS NULL OR ts > last_hit"
    step("SELECT symbol, ts, " + ", ".join(f"{FINITE.format(x)} AS {x}" for x in VALUES) + " FROM {src}")
    step("SELECT * REPLACE (CASE WHEN adjclose > 0 THEN adjclose END AS adjclose) FROM {src}")
    log = "CASE WHEN {0} > 0 THEN ln({0}) END"
    step(f"""SELECT * EXCLUDE (fa, fc, gap, jump, last_bad) FROM (SELECT *, max(CASE WHEN jump < -1e-5 OR jump > ln(1 + {dividend}) THEN ts END) OVER (PARTITION BY symbol) AS last_bad FROM (
        SELECT *, gap - lag(gap) {W} AS jump FROM (SELECT *, {log.format('fa')} - {log.format('fc')} AS gap FROM (
          SELECT *, last_value(adjclose IGNORE NULLS) {SOFAR} AS fa, last_value(close IGNORE NULLS) {SOFAR} AS fc FROM {{src}})))) WHERE last_bad IS NULL OR ts > last_bad""")
    step(missing)
    at = repair_views(prefix, at, threshold, above, passes)
    step(missing)
    step(f"SELECT * FROM (SELECT * REPLACE (last_value(adjclose IGNORE NULLS) {SOFAR} AS adjclose) FROM {{src}}) WHERE adjclose IS NOT NULL")
    step("SELECT * REPLACE (" + ", ".join(f"CASE WHEN {x} > 0 THEN {x} END AS {x}" for x in c.PRICES) + ") FROM {src}")
    step(f"SELECT * REPLACE (last_value(close IGNORE NULLS) {SOFAR} AS close) FROM {{src}}")
    step("SELECT * REPLACE (coalesce(CASE WHEN volume >= 0 THEN volume END, 0) AS volume, CASE WHEN open < low OR open > high THEN NULL ELSE open END AS open) FROM {src}")
    step(scored("open"))
    step(f"SELECT * REPLACE (coalesce(open, lag(close) {W}) AS open) FROM {{src}}")
    step("SELECT * REPLACE (CASE WHEN low > close OR low > open THEN NULL ELSE low END AS low, CASE WHEN high < close OR high < open THEN NULL ELSE high END AS high) FROM {src}")
    step(scored("low"))
    step("SELECT * REPLACE (coalesce(low, least(open, close)) AS low) FROM {src}")
    step(scored("high"))
    step("SELECT * REPLACE (coalesce(high, greatest(open, close)) AS high) FROM {src}")
    step(f"SELECT *, {TOTAL} AS ret FROM {{src}}")
    return at


REPAIRED = repair_views("tb_fix", "tb_dirty", 4.0, 3.0, 6)
SHOWN = ", ".join(r(x) for x in ("open", "low", "close", "adjclose", "volume")) + ", " + r(FINITE.format("high"), "high")


@query("null_bad_adjclose", sql(SHOWN, REPAIRED), REPAIRED)
def _(spark, sf):
    return shown(c.null_infinite(c.null_bad_adjclose(tb.dirty_bars(spark, sf), threshold=4.0, false_above=3.0, passes=6)), *ALL)


@query("null_bad_adjclose_saved")
def _(spark, sf):
    saved = c.open_to_open_return(tb.bars(spark, sf).where("ts < '1998-01-01'"))
    return shown(c.null_bad_adjclose(tb.dirty_bars(spark, sf).where("ts >= '1998-01-01'"), saved), *ALL)


# the test bed's prices leap, so its jumps of a factor of three are no faults; both sides make six passes
BED = {"max_dividend": 0.5, "threshold": 4.0, "false_above": 3.0, "passes": 6}
CLEANED = clean_views("tb_cb", "tb_dirty", 0.5, 20, 20.0, 4.0, 3.0)
MILD = {"max_dividend": 3.0, "missing_run": 12, "anomalous": 5.0, "threshold": 4.0, "false_above": 3.0, "passes": 6}
MILDLY = clean_views("tb_cm", "tb_dirty", 3.0, 12, 5.0, 4.0, 3.0)
LANDED = clean_views("tb_cl", "tb_landed", 3.0, 12, 5.0, 4.0, 3.0)
# without the rules that look at rows to come, a history cleaned in two runs is the history cleaned in one
FIRM = MILD | {"anomalous": 1e9, "threshold": 1e9, "passes": 1}
LANDED_FIRM = clean_views("tb_cf", "tb_landed", 3.0, 12, 1e9, 1e9, 3.0, passes=1)
CLEAN_SHOWN = ", ".join(r(x) for x in ("open", "low", "high", "close", "volume", "ret"))


@query("clean_bars", sql(CLEAN_SHOWN, CLEANED), CLEANED)
def _(spark, sf):
    out = c.clean_bars(tb.dirty_bars(spark, sf), **BED).withColumn("ret", rnd("return")).drop("return")
    return shown(out)


@query("clean_bars_thresholds", sql(CLEAN_SHOWN, MILDLY), MILDLY)
def _(spark, sf):
    out = c.clean_bars(tb.dirty_bars(spark, sf), **MILD).withColumn("ret", rnd("return")).drop("return")
    return shown(out)


@query("clean_bars_defaults")
def _(spark, sf):
    out = c.clean_bars(tb.dirty_bars(spark, sf)).withColumn("ret", rnd("return")).drop("return")
    return shown(out)


@query("null_anomalous_saved", f"""
    , past AS (SELECT symbol, ts, open, close FROM tb_dirty WHERE ts < TIMESTAMP '1999-01-01'), both_ AS (SELECT symbol, ts, open, close, 1 AS own FROM tb_dirty WHERE ts >= TIMESTAMP '1999-01-01' UNION ALL SELECT *, 0 FROM past),
    {_score_sql(GAP, 'both_', c.WINDOWS)} SELECT symbol, CAST(ts AS DATE) AS ts, round(CASE WHEN score > 5 THEN NULL ELSE open END, 9) + 0.0 AS open FROM scored WHERE own = 1""", "tb_dirty")
def _(spark, sf):
    bars = tb.dirty_bars(spark, sf)
    return shown(c.null_anomalous(bars.where("ts >= '1999-01-01'"), "open", 5.0, saved=bars.where("ts < '1999-01-01'")), "symbol", "ts", "open")
