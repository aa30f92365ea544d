"""Operators that SQL does not express against pandas and NumPy; invariants; planted faults; streams."""

import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge import schemas
from panelforge.functions import core
from panelforge.functions.core import asof_join, resample_return
from panelforge.operators import checks, cleaning, factors, forecasts, panel as panels, subspace, terms, trades, weights
from panelforge.sources import files, store
from panelforge.streaming import bars as st

START = datetime(2020, 1, 1)


def make_panel(spark, n_times=60, symbols="abcde", seed=0, gaps=()):
    rng = np.random.default_rng(seed)
    wide = pd.DataFrame(rng.normal(0, 0.02, (n_times, len(symbols))), columns=list(symbols), index=[START + timedelta(days=i) for i in range(n_times)])
    for s, a, b in gaps:
        wide.iloc[a:b, list(symbols).index(s)] = np.nan
    rows = [(s, t.to_pydatetime(), None if np.isnan(x) else float(x), 1e6, 10.0) for s in wide for t, x in wide[s].items()]
    return wide, spark.createDataFrame(rows, schemas.PANEL)


def wide_of(df, value, symbols="abcde"):
    return df.toPandas().pivot(index="ts", columns="symbol", values=value)[list(symbols)]


GAPS = (("b", 0, 20), ("a", 10, 30), ("c", 25, 40))


def test_means_against_pandas(spark):
    wide, panel = make_panel(spark, gaps=GAPS)
    got = wide_of(forecasts.mean_return(panel), "mean")
    want = wide.expanding().mean().shift(1)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(), rtol=1e-9)


def test_exponential_means_against_pandas(spark):
    wide, panel = make_panel(spark, gaps=GAPS)
    want = wide.ewm(halflife="10 days", times=wide.index).mean().shift(1)
    for got in (forecasts.mean_return(panel, half_life=10 * 86_400.0), forecasts.ew_recursive(panel, 10 * 86_400.0)):
        np.testing.assert_allclose(wide_of(got, "mean").to_numpy(float), want.to_numpy(), rtol=1e-9)


def test_long_history_keeps_recursion_finite(spark):
    wide, panel = make_panel(spark, n_times=300)
    got = wide_of(forecasts.ew_recursive(panel, 600.0), "mean").to_numpy(float)  # 43,000 half-lives
    np.testing.assert_allclose(got[1:], wide.to_numpy()[:-1])


@pytest.mark.parametrize("hours", [None, 30])
def test_exponential_sums_over_thousands_of_half_lives(spark, hours):
    """Hourly rows, a half-life of twelve minutes, gaps of up to 300 half-lives: 7,500 half-lives in all."""
    rng = np.random.default_rng(11)
    at = np.sort(rng.choice(1500, 700, replace=False))
    at = at[(at < 400) | (at > 455)]
    x = rng.normal(0, 0.02, len(at))
    rows = [("s", START + timedelta(hours=int(h)), float(v), 1.0, 1.0) for h, v in zip(at, x)]
    panel = spark.createDataFrame(rows, schemas.PANEL)
    how = {} if hours is None else {"rolling": hours * 3600.0}
    got = forecasts.moments(panel, half_life=720.0, **how).orderBy("ts").toPandas()
    for i, h in enumerate(at):
        past = [j for j in range(i) if hours is None or h - at[j] <= hours]
        w = 2.0 ** ((at[past] - h) * 5.0)
        if len(past):
            np.testing.assert_allclose(got[["w0", "w1", "w2"]].iloc[i].to_numpy(float), [w.sum(), (w * x[past]).sum(), (w * x[past] ** 2).sum()], rtol=1e-9)
        else:
            assert got.w0.isna().iloc[i]
    if hours is None:
        same = forecasts.ew_recursive(panel, 720.0).orderBy("ts").toPandas()
        np.testing.assert_allclose((got.w1 / got.w0).to_numpy(float), same["mean"].to_numpy(float), rtol=1e-9)


def test_no_look_ahead(spark):
    wide, panel = make_panel(spark)
    later = F.col("ts") >= F.lit(START + timedelta(days=30))
    changed = panel.withColumn("ret", F.when(later, F.col("ret") * 100).otherwise(F.col("ret")))
    for run in (forecasts.variance, forecasts.mean_error, forecasts.mean_return):
        a, b = (wide_of(run(p), run.__name__ if run is not forecasts.mean_return else "mean").to_numpy(float)[:31] for p in (panel, changed))
        np.testing.assert_array_equal(a, b)


def test_covariances_against_loop(spark):
    wide, panel = make_panel(spark, gaps=GAPS)
    date = START + timedelta(days=50)
    dates = spark.createDataFrame([(date,), (START + timedelta(days=35),)], "ts timestamp")
    past = wide[wide.index < date]
    for kelly in (True, False):
        got = {(r.sym_i, r.sym_j): r.value for r in forecasts.covariance_blocked(panel, dates, kelly, block=2).where(F.col("ts") == date).collect()}
        pair = {(r.sym_i, r.sym_j): r.value for r in forecasts.covariance(panel, kelly, at=str(date)).collect()}
        for i in wide:
            for j in wide:
                if i <= j:
                    both = past[[i, j]].dropna().to_numpy()
                    want = (both[:, 0] * both[:, -1]).mean() - (0 if kelly else both[:, 0].mean() * both[:, -1].mean())
                    assert got[i, j] == pytest.approx(want) and pair[i, j] == pytest.approx(want)


def test_partitioning_does_not_matter(spark):
    _, panel = make_panel(spark)
    a = forecasts.variance(panel.repartition(1)).orderBy("symbol", "ts").toPandas()
    b = forecasts.variance(panel.orderBy(F.rand(1)).repartition(7)).orderBy("symbol", "ts").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_factor_models_agree_without_gaps(spark):
    wide, panel = make_panel(spark)
    date = START + timedelta(days=50)
    dates = spark.createDataFrame([(date,)], "ts timestamp")
    svd = factors.factor_model_svd(panel, dates, 2, 1000).toPandas()
    pca = factors.factor_model_pca(forecasts.covariance_blocked(panel, dates), 2).toPandas()
    key = ["part", "factor", "symbol"]
    both = svd.merge(pca, on=key, suffixes=("_a", "_b"))
    assert len(both) == len(svd) == 15
    np.testing.assert_allclose(both.value_a, both.value_b, atol=1e-10)


def test_psd_factor_clips_negative_eigenvalues(spark):
    rows = [(START, "a", "a", 1.0), (START, "a", "b", 2.0), (START, "b", "b", 1.0)]
    f = factors.psd_factor(spark.createDataFrame(rows, "ts timestamp, sym_i string, sym_j string, value double")).toPandas()
    m = f.pivot(index="factor", columns="symbol", values="f").to_numpy()
    np.testing.assert_allclose(m.T @ m, [[1.5, 1.5], [1.5, 1.5]])


def test_regressions_against_numpy(spark):
    wide, panel = make_panel(spark)
    x = pd.Series(np.random.default_rng(5).normal(size=len(wide)), index=wide.index)
    reg = spark.createDataFrame([(t.to_pydatetime(), [float(v)]) for t, v in x.items()], "ts timestamp, x array<double>")
    at = 50
    design = np.column_stack([np.ones(at), x.to_numpy()[:at]])
    want = np.array([1, x.iloc[at]]) @ np.linalg.lstsq(design, wide.to_numpy()[:at], rcond=None)[0]
    got = {r.symbol: r.forecast for r in factors.linear_regression_return(panel, reg, str(wide.index[at])).collect()}
    np.testing.assert_allclose([got[s] for s in wide], want)
    z = x.iloc[: at + 1] - x.iloc[: at + 1].mean()
    z = np.column_stack([z / np.sqrt((z**2).mean()), np.ones(at + 1)])
    lhs = np.linalg.solve(z[:-1].T @ z[:-1] / at + np.diag([0.1, 0]), z[-1])
    r = wide.to_numpy()[:at]
    means = {q.symbol: q.forecast for q in factors.regression_mean(panel, reg, str(wide.index[at])).collect()}
    np.testing.assert_allclose([means[s] for s in wide], lhs @ (z[:-1].T @ r / at))
    cov = {(q.sym_i, q.sym_j): q.value for q in factors.regression_covariance(panel, reg, str(wide.index[at])).collect()}
    assert cov["a", "c"] == pytest.approx(float(lhs @ (z[:-1].T @ (r[:, 0] * r[:, 2]) / at)))


def test_monthly_factors_reach_second_moment(spark):
    wide, panel = make_panel(spark)
    out = factors.factor_model_monthly(panel, 5, 730).toPandas()
    last = out[out.ts == out.ts.max()]
    f = last[last.part == "exposure"].pivot(index="factor", columns="symbol", values="value").to_numpy(float)
    var = last[last.part == "factor_variance"].sort_values("factor").value.to_numpy(float)
    past = wide[wide.index < last.ts.iloc[0]].to_numpy()
    np.testing.assert_allclose(f.T @ np.diag(var) @ f, past.T @ past / len(past), atol=1e-12)


# ---- cleaning --------------------------------------------------------------------------------------------------------


def make_bars(spark, n=120, seed=1, **faults):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    b = pd.DataFrame({"symbol": "s", "ts": [START + timedelta(days=i) for i in range(n)], "open": np.append(close[0], close[:-1]) * (1 + rng.normal(0, 0.001, n)), "low": 0.0, "high": 0.0, "close": close, "adjclose": close, "volume": 1000.0})
    b["low"], b["high"] = b[["open", "close"]].min(axis=1) * 0.999, b[["open", "close"]].max(axis=1) * 1.001
    for column, (row, value) in faults.items():
        b.loc[row, column] = value
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x.to_pydatetime() if hasattr(x, "to_pydatetime") else x for x in r) for r in b.itertuples(index=False)]
    return b, spark.createDataFrame(rows, schemas.BARS)


@pytest.mark.parametrize("fault", [{"open": (50, -1.0)}, {"close": (50, float("nan")), "adjclose": (50, float("nan"))}, {"low": (50, 200.0)}, {"high": (50, 1.0)}, {"volume": (50, -5.0)}, {"open": (50, 1.0)}, {"high": (50, float("inf"))}])
def test_one_fault_is_repaired(spark, fault):
    _, bars = make_bars(spark, **fault)
    out = cleaning.clean_bars(bars).toPandas().sort_values("ts")
    assert len(out) == 120
    assert out.iloc[1:][["open", "low", "high", "close", "volume"]].notna().all().all()
    inner = out.iloc[1:]
    assert (inner.low <= inner[["open", "close"]].min(axis=1)).all() and (inner.high >= inner[["open", "close"]].max(axis=1)).all()


def test_wild_adjclose_blanks_the_day_and_the_one_before(spark):
    raw, bars = make_bars(spark, adjclose=(60, 1e6))
    out = cleaning.null_bad_adjclose(bars).toPandas().sort_values("ts", ignore_index=True)
    assert list(np.nonzero(out.adjclose.isna())[0]) == [59, 60, 61] or list(np.nonzero(out.adjclose.isna())[0]) == [59, 60]
    assert out.loc[out.adjclose.isna(), ["open", "close", "volume"]].isna().all().all()


def test_repair_does_nothing_to_sound_prices(spark):
    raw, bars = make_bars(spark)
    saved = cleaning.open_to_open_return(bars.where(F.col("ts") < START + timedelta(days=60)))
    for out in (cleaning.null_bad_adjclose(bars), cleaning.null_bad_adjclose(bars, saved)):
        assert out.where("adjclose is null").count() == 0


def plain_scores(x):
    """The median over the windows of each size against its median around it."""
    size = x.abs().where(x != 0)
    return pd.concat([size / size.rolling(w, center=True, min_periods=1).median() for w in cleaning.WINDOWS], axis=1).median(axis=1, skipna=True)


def test_scores_against_pandas(spark):
    raw, bars = make_bars(spark)
    rows = bars.withColumn("x", F.log("close") - F.log("open"))
    want = plain_scores(np.log(raw.close) - np.log(raw.open))
    np.testing.assert_allclose(rows.withColumn("s", cleaning.unlikeliness_score("x")).orderBy("ts").toPandas().s, want)
    np.testing.assert_allclose(cleaning.with_scores(rows, {"s": "x"}).orderBy("ts").toPandas().s, want)


def gappy(spark, symbols=5, n=1500, seed=2):
    """Several symbols' bars with missing closes, wild ones in clusters, and drifts that move the medians."""
    frames = []
    for k in range(symbols):
        raw, _ = make_bars(spark, n=n - 100 * k, seed=seed + k)
        rng = np.random.default_rng(seed + k)
        raw["symbol"] = f"s{k}"
        raw.loc[rng.random(len(raw)) < 0.03, ["close", "adjclose"]] = np.nan
        for at in rng.integers(5, len(raw) - 5, 12):
            raw.loc[at : at + rng.integers(0, 4), "adjclose"] *= rng.choice([1e-3, 40.0, 1e4])
        frames.append(raw)
    rows = pd.concat(frames, ignore_index=True)
    return rows, spark.createDataFrame([tuple(None if isinstance(x, float) and np.isnan(x) else x.to_pydatetime() if hasattr(x, "to_pydatetime") else x for x in r) for r in rows.itertuples(index=False)], schemas.BARS)


def test_scores_in_chunks(spark):
    raw, bars = gappy(spark)
    rows = bars.withColumn("x", F.log("adjclose") - F.log("open"))
    got = cleaning.with_scores(rows, {"a": "x", "b": "open"}, chunk=250).orderBy("symbol", "ts").toPandas()
    assert len(got) == len(raw)
    for name, x in (("a", np.log(raw.adjclose) - np.log(raw.open)), ("b", raw.open)):
        want = pd.concat([plain_scores(own) for _, own in x.groupby(raw.symbol)])
        np.testing.assert_allclose(got[name], want, equal_nan=True)


def plain_repair(own, earlier, passes, threshold, above=0.5, before="2000-01-01"):
    """One symbol's whole history, pass after pass."""
    own = own.sort_values("ts", ignore_index=True)
    values = [c for c in own.columns if c not in ("symbol", "ts")]
    for _ in range(passes):
        steps = np.log10(own.adjclose.ffill()).diff()
        scores = plain_scores(pd.concat([earlier, steps], ignore_index=True)).iloc[len(earlier) :].reset_index(drop=True)
        wild = (scores > threshold) | ((steps.abs() > above) & (own.ts < pd.Timestamp(before)))
        own.loc[wild | wild.shift(-1, fill_value=False), values] = np.nan
    return own


@pytest.mark.parametrize("threshold, passes, lent", [(50.0, 21, None), (4.0, 6, None), (4.0, 21, 20)])
def test_repair_in_chunks_equals_whole_histories(spark, monkeypatch, threshold, passes, lent):
    """Histories many chunks long; with too few lent rows, chunks in doubt are repaired again until nothing can move."""
    raw, bars = gappy(spark, n=1500 if lent else 9000, symbols=3)
    if lent:
        monkeypatch.setattr(cleaning, "CARRIED", lent)
    got = cleaning.null_bad_adjclose(bars, chunk=10, passes=passes, threshold=threshold).orderBy("symbol", "ts").toPandas()
    want = pd.concat([plain_repair(own, pd.Series(dtype=float), passes, threshold) for _, own in raw.groupby("symbol")])
    assert len(got) == len(want) and got.adjclose.isna().sum() > raw.adjclose.isna().sum()
    for c in ("adjclose", "close", "open", "volume"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_repair_with_lent_history(spark):
    raw, bars = gappy(spark, symbols=3, n=700)
    cut = START + timedelta(days=300)
    saved = cleaning.open_to_open_return(bars.where(F.col("ts") < cut))
    got = cleaning.null_bad_adjclose(bars.where(F.col("ts") >= cut), saved, threshold=4.0).orderBy("symbol", "ts").toPandas()
    old = saved.orderBy("symbol", "ts").toPandas()
    parts = []
    for symbol, own in raw[raw.ts >= cut].groupby("symbol"):
        tail = old[old.symbol == symbol].iloc[-200:]
        intraday = np.log10(tail["close"]) - np.log10(tail["open"])
        parts.append(plain_repair(own, (np.log10(1 + tail["return"]) - intraday + intraday.shift(-1)).shift(1).reset_index(drop=True), 21, 4.0))
    np.testing.assert_allclose(got.adjclose.astype(float), pd.concat(parts).adjclose.astype(float), equal_nan=True)


def test_total_returns_match_plain_ones_without_dividends(spark):
    _, bars = make_bars(spark)
    a = cleaning.open_to_open_total_return(bars).orderBy("ts").toPandas()["return"]
    b = cleaning.open_to_open_return(bars).orderBy("ts").toPandas()["return"]
    np.testing.assert_allclose(a[:-1], b[:-1])
    assert np.isnan(a.iloc[-1])


# ---- panels, sources -------------------------------------------------------------------------------------------------


def test_downsampling_conserves(spark):
    wide, panel = make_panel(spark)
    out = panels.downsample(panel, "monthly").toPandas()
    assert out.valuevolume.sum() == pytest.approx(1e6 * wide.size)
    whole = out.assign(g=np.log1p(out.ret)).groupby("symbol").g.sum()
    np.testing.assert_allclose(whole, np.log1p(wide).sum())


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_series_round_trip(spark, tmp_path, fmt):
    rows = [("a", START, 1.5), ("a", START + timedelta(hours=1), None), ("b", START, -2.25)]
    series = spark.createDataFrame(rows, schemas.SERIES)
    files.write_series(series, str(tmp_path / fmt), fmt)
    back = files.read_series(spark, str(tmp_path / fmt), fmt)
    assert back.schema == series.schema
    assert sorted(back.collect(), key=str) == sorted(series.collect(), key=str)


def test_wide_csv(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_text("Date,A,B\n2020-01-01,1.5,\n2020-01-02,.,2\n")
    rows = {(r.symbol, r.ts.day): r.ret for r in files.read_wide_panel(spark, str(p)).collect()}
    assert rows == {("A", 1): 1.5, ("B", 2): 2.0}


def test_index_csv(spark, tmp_path):
    p = tmp_path / "i.csv"
    p.write_text("DATE,V\n2020-01-01,1.5\n2020-01-02,.\n")
    assert [r.value for r in files.read_index_csv(spark, str(p), "x").orderBy("ts").collect()] == [1.5, None]


def test_asof_edges(spark):
    left = spark.createDataFrame([("a", START), ("a", START + timedelta(days=2)), ("b", START)], "k string, ts timestamp")
    right = spark.createDataFrame([("a", START, 1), ("a", START + timedelta(days=1), 2)], "k string, ts timestamp, v int")
    pick = lambda **how: sorted((r.k, r.ts.day, r.v) for r in asof_join(left, right, ["v"], by=["k"], **how).collect())
    assert pick() == [("a", 1, 1), ("a", 3, 2), ("b", 1, None)]
    assert pick(exclusive=True) == [("a", 1, None), ("a", 3, 2), ("b", 1, None)]
    assert pick(forward=True) == [("a", 1, 1), ("a", 3, None), ("b", 1, None)]
    assert pick(forward=True, exclusive=True) == [("a", 1, 2), ("a", 3, None), ("b", 1, None)]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_asof_without_a_key(spark, monkeypatch, forward, exclusive):
    """The array, and the way for right sides too large for one, against a loop."""
    rng = np.random.default_rng(2)
    left = [(START + timedelta(hours=int(h)), i) for i, h in enumerate(rng.integers(-50, 900, 120))] + [(None, 999)]
    right = [(START + timedelta(hours=int(h)), None if k % 7 == 0 else k) for k, h in enumerate(rng.choice(800, 60, replace=False))]
    want = {}
    for t, i in left:
        ok = [r for r in right if t is not None and ((r[0] > t or r[0] == t and not exclusive) if forward else (r[0] < t or r[0] == t and not exclusive))]
        want[i] = (min if forward else max)(ok, key=lambda r: r[0])[1] if ok else None
    a, b = spark.createDataFrame(left, "ts timestamp, i long"), spark.createDataFrame(right, "ts timestamp, k long")
    for most in (100, 10):
        monkeypatch.setattr(core, "ARRAY_ROWS", most)
        assert {r.i: r.k for r in asof_join(a, b, ["k"], forward=forward, exclusive=exclusive).collect()} == want


def test_asof_windows_only_grow(spark):
    """Frames that end at a key's last row are summed anew for each row; looking ahead runs the order backwards instead."""
    rows = hot_rows(spark)
    got = asof_join(rows, rows.select("symbol", "ts", F.col("ret").alias("x")), ["x"], by=["symbol"], forward=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "specifiedwindowframe" in plan and "unboundedfollowing" not in plan


def test_rows_find_the_dates_that_see_them(spark):
    panel = spark.createDataFrame([(START + timedelta(days=d),) for d in range(40)], "ts timestamp")
    dates = [START + timedelta(days=d) for d in (0, 3, 10, 39, 60)]
    got = {(r.ts, r.at) for r in core.seen_from(panel, spark.createDataFrame([(d,) for d in dates], "ts timestamp"), 7).collect()}
    assert got == {(d - timedelta(days=k), d) for d in dates for k in range(1, 8) if 0 <= (d - timedelta(days=k) - START).days < 40}


def test_a_batch_tried_again_leaves_its_rows_once(spark, tmp_path):
    """The sink's own folder of the last batch is written again after a failure behind it."""
    import shutil

    source, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), tmp_path / "check"
    source.mkdir()
    schema = "symbol string, ts timestamp, price double"
    rows = lambda a, b: spark.createDataFrame([(s, START + timedelta(minutes=m), float(m)) for s in "ab" for m in range(a, b)], schema)
    want = []
    for k in range(4):
        rows(10 * k - (k > 0), 10 * k + 10).coalesce(1).write.mode("append").parquet(str(source))
        for again in range(2):
            stream = spark.readStream.schema(schema).parquet(str(source))
            st.stream_append_only(stream, table, str(checkpoint)).awaitTermination()
            want = sorted((s, START + timedelta(minutes=m)) for s in "ab" for m in range(10 * k + 10))
            assert sorted((r.symbol, r.ts) for r in spark.read.parquet(table).collect()) == want
            if not again:  # as if the batch had failed after its write: the commit is lost, and the batch comes again
                last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
                last.unlink()
                (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    st.stream_append_only(spark.readStream.schema(schema).parquet(str(source)), table, str(tmp_path / "other")).awaitTermination()
    assert sorted((r.symbol, r.ts) for r in spark.read.parquet(table).collect()) == want
    shutil.rmtree(checkpoint)


def test_what_is_missing_never_vanishes(spark):
    """An unpriced position makes its book unknown; zero positions need nothing."""
    book = [("p", START, s, False, w, w) for s, w in (("a", 0.5), ("b", 0.4), ("z", 0.0))] + [("q", START, "a", False, 1.0, 1.0)]
    own = spark.createDataFrame(book, "portfolio_id string, ts timestamp, symbol string, is_cash boolean, w double, u double")
    one = spark.createDataFrame([(START, "a", 2.0)], "ts timestamp, symbol string, value double")
    market = one.select("ts", "symbol", F.col("value").alias("sigma"), F.lit(1e6).alias("valuevolume"), F.lit(3.0).alias("price"))
    cov = spark.createDataFrame([("a", "a", 2.0), ("b", "b", 1.0)], "sym_i string, sym_j string, value double")
    loads = one.select("ts", F.lit("f").alias("factor"), "symbol", F.col("value").alias("f"))
    for out in (
        terms.transaction_cost(own, market, 0.1, 1.0), terms.returns_forecast(own, one), terms.returns_error(own, one), terms.risk_full(own, cov), terms.risk_diagonal(own, one),
        terms.risk_forecast_error(own, one), terms.risk_factor_model(own, loads, one.withColumnRenamed("value", "d")),
    ):
        got = {r.portfolio_id: r.value for r in out.collect()}
        assert got["p"] is None and got["q"] > 0
    bad = checks.violations(checks.chk_factor_max(own, loads, 5.0)).collect()
    assert {r.portfolio_id for r in bad} == {"p"}
    values = spark.createDataFrame([("p", START, 10.0), ("q", START, 10.0)], "portfolio_id string, ts timestamp, v double")
    part = checks.chk_participation(own.withColumnRenamed("u", "z"), values, one.withColumnRenamed("value", "mean_volume"), 100.0)
    assert [(r.portfolio_id, r.symbol) for r in checks.violations(part).collect()] == [("p", "b")]
    assert [(r.symbol, r.input) for r in terms.missing_inputs(own, one, ["value"]).collect()] == [("b", "value")]


def test_resampled_return_compounds(spark):
    r = spark.range(1).select(resample_return(F.lit(0.1), 12.0)).first()[0]
    assert (1 + r) ** 12 == pytest.approx(1.1)


def test_fill_from_saved_rows(spark):
    saved = spark.createDataFrame([("a", START, 5.0)], "symbol string, ts timestamp, close double")
    new = spark.createDataFrame([("a", START + timedelta(days=1), None), ("a", START + timedelta(days=2), 6.0)], "symbol string, ts timestamp, close double")
    assert [r.close for r in cleaning.ffill(new, "close", saved).orderBy("ts").collect()] == [5.0, 6.0]


# ---- weights and trades ----------------------------------------------------------------------------------------------


def test_rank_ties_go_by_symbol_and_long_wins(spark):
    s = spark.createDataFrame([(START, x, 0.0) for x in "abc"], "ts timestamp, symbol string, signal double")
    w = {r.symbol: r.w for r in weights.w_rank_long_short(s, 2, 2).collect()}
    assert w == {"a": pytest.approx(-1 / 3), "b": pytest.approx(1 / 3), "c": pytest.approx(1 / 3), "cash": 1.0}


def test_proportional_path_arrives(spark):
    times = [START + timedelta(days=i) for i in range(4)]
    goal = spark.createDataFrame([(times[3], "a", 1.0)], "ts timestamp, symbol string, w double")
    w = 0.0
    for i, t in enumerate(times):
        cur = spark.createDataFrame([("p", x, "a", w) for x in times], "portfolio_id string, ts timestamp, symbol string, w double")
        w = [r.w for r in weights.w_proportional_to_target(cur, goal).orderBy("ts").collect()][i]
    assert w == pytest.approx(1.0)


def test_cap_at_huge_size(spark):
    rows = [("p", START, "a", False, 1e11), ("p", START, "cash", True, 0.0)]
    u = spark.createDataFrame(rows, "portfolio_id string, ts timestamp, symbol string, is_cash boolean, u double")
    market = spark.createDataFrame([("a", START, None, 1e6, 10.0)], schemas.PANEL)
    out = {r.symbol: r.u for r in trades.apply_trade_filters(u, market).collect()}
    assert out == {"a": 5e4, "cash": -5e4}


# ---- streams ---------------------------------------------------------------------------------------------------------


def test_online_steps_drop_what_is_late():
    states = list(st.step_online((0.0, 0.0, 0.0, None, 0), [0.0, 10.0, 5.0, 20.0], [1.0, 2.0, 99.0, 3.0], 10.0))
    assert len(states) == 3 and states[-1][4] == 1
    assert states[-1][0] == pytest.approx(1 / 4 + 2 / 2 + 3)


def test_late_ticks_leave_no_mark_on_closed_bars(spark, tmp_path):
    cols = "symbol string, ts timestamp, price double, event_id long"
    one = [("a", START + timedelta(minutes=m), float(m + 1), m) for m in (0, 30, 200)]
    two = [("a", START + timedelta(minutes=10), 99.0, 9), ("a", START + timedelta(minutes=400), 1.0, 10)]
    src = str(tmp_path / "in")
    for k, rows in enumerate((one, two)):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(cols).parquet(src)
        out = st.stream_bars(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        out.awaitTermination()
    bars = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert (bars[0].open, bars[0].high, bars[0].close) == (1.0, 31.0, 31.0)
    assert len(bars) == 2


def folders(path):
    """Every file under a folder with its time of change."""
    return {p: os.stat(p).st_mtime_ns for d, _, names in os.walk(path) for n in names for p in [f"{d}/{n}"] if "/data/" in p}


def test_appends_leave_old_years_alone(spark, tmp_path):
    """Later bars, an overlap, a restated bar, a new symbol, and a symbol that brings nothing."""
    root = str(tmp_path / "store")
    day = lambda y, m, d: datetime(y, m, d)
    schema = "symbol string, ts timestamp, x double"
    first = [("a", day(1999, 5, 1), 1.0), ("a", day(2000, 5, 1), 2.0), ("a", day(2001, 5, 1), 3.0), ("a", day(2001, 6, 1), 4.0), ("b", day(1999, 5, 1), 5.0), ("b", day(2000, 6, 1), 6.0)]
    one = store.append(spark, root, spark.createDataFrame(first, schema))
    before = folders(root)
    later = [("a", day(2000, 5, 1), 20.0), ("a", day(2001, 5, 1), 30.0), ("a", day(2001, 6, 1), 40.0), ("a", day(2002, 1, 1), 50.0), ("c", day(2002, 3, 1), 7.0), ("c", day(2002, 3, 1), 7.0)]
    two = store.append(spark, root, spark.createDataFrame(later, schema))
    after = folders(root)
    assert store.latest(spark, root) == two and {p: after[p] for p in before} == before
    got = {(r.symbol, r.ts): r.x for r in store.read(spark, two, schema).collect()}
    kept = {(s, t): x for s, t, x in first if (s, t) not in {("a", day(2001, 5, 1)), ("a", day(2001, 6, 1))}}
    assert got == kept | {("a", day(2001, 5, 1)): 30.0, ("a", day(2001, 6, 1)): 40.0, ("a", day(2002, 1, 1)): 50.0, ("c", day(2002, 3, 1)): 7.0}
    assert {y: two.years[y] == one.years.get(y) for y in two.years} == {1999: True, 2000: True, 2001: False, 2002: False}
    assert {(r.symbol, r.ts) for r in store.read(spark, one, schema).collect()} == {(s, t) for s, t, _ in first}
    assert {r.symbol: len(r.times) for r in store.tails(spark, two).collect()} == {"a": 5, "b": 2, "c": 1}
    lent = store.lent(spark, two, spark.createDataFrame([("a",)], "symbol string"), schema, 2)
    assert sorted(r.x for r in lent.collect()) == [40.0, 50.0]
    old, new = store.changed(spark, one, two, schema)
    assert {r.ts.year for r in old.collect()} == {2001} and {r.ts.year for r in new.collect()} == {2001, 2002}
    assert {(r.ts, r.fault) for r in files.audit_append_only(old, new, ["x"]).collect()} == {(day(2001, 5, 1), "changed")}
    # a payload that begins behind the last stored rows takes none away
    three = store.append(spark, root, spark.createDataFrame([("b", day(2002, 5, 1), 8.0)], schema))
    assert {(r.ts, r.x) for r in store.read(spark, three, schema).where("symbol = 'b'").collect()} == {(day(1999, 5, 1), 5.0), (day(2000, 6, 1), 6.0), (day(2002, 5, 1), 8.0)}


def test_pruned_reads_open_the_years_asked_for(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [("a", datetime(1990 + k, 1, 1), float(k)) for k in range(12)]
    version = store.append(spark, root, spark.createDataFrame(rows, "symbol string, ts timestamp, x double"))
    asked = store.read(spark, version, "symbol string, ts timestamp, x double", since=2000)
    assert sorted(r.x for r in asked.collect()) == [10.0, 11.0] and all("year=200" in f for f in asked.inputFiles())


def test_incremental_cleaning_is_what_the_two_runs_say(spark, tmp_path):
    """Kept rows of the first run, then the second payload cleaned with the stored rows before it; nothing else moves."""
    from panelforge.jobs import market_job
    from panelforge.jobs.panel_queries import payloads

    bars = None
    for k in range(3):
        own = make_bars(spark, n=500, seed=k, open=(397 + k, 1.0), high=(396, 900.0), low=(392 + k, 1e-3))[1].withColumn("symbol", F.lit(f"s{k}"))
        bars = own if bars is None else bars.unionByName(own)
    cut, since = START + timedelta(days=399), START + timedelta(days=300)
    root = str(tmp_path / "bars")
    one = market_job.update_bars(spark, root, payloads(bars.where(F.col("ts") <= cut)))
    two = market_job.update_bars(spark, root, payloads(bars.where(F.col("ts") >= since)))
    got = store.read(spark, two, market_job.BARS).orderBy("symbol", "ts").toPandas()
    old = store.read(spark, one, market_job.BARS)
    parts = []
    for symbol, own in old.toPandas().sort_values("ts").groupby("symbol"):
        begin, kept = own.ts.iloc[-5], own.iloc[:-2]
        new = cleaning.clean_bars(bars.where((F.col("symbol") == symbol) & (F.col("ts") >= begin)), old.where((F.col("symbol") == symbol) & (F.col("ts") < begin)))
        new = cleaning.value_volume(cleaning.null_last_row(new)).toPandas().sort_values("ts")
        parts += [kept, new[new.ts > kept.ts.iloc[-1]]]
    want = pd.concat(parts)[list(got.columns)].reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    faults = market_job.audit_run(spark, one, two).toPandas()
    assert faults.empty or set(faults.ts) <= {t for _, own in old.toPandas().sort_values("ts").groupby("symbol") for t in own.ts.iloc[-2:-1]}


BOOK = "portfolio_id string, ts timestamp, symbol string, is_cash boolean"
T0, T1, T2 = (START + timedelta(days=i) for i in range(3))


def book_rows(spark, rows, name="w"):
    return spark.createDataFrame([("p", t, s, s == "cash", x) for t, s, x in rows], f"{BOOK}, {name} double")


def values_of(df, key="ts", value="value"):
    return {r[key]: r[value] for r in df.collect()}


def test_unknown_weights_and_benchmarks_make_risks_unknown(spark):
    w = book_rows(spark, [(T0, "A", None), (T0, "cash", 0.5), (T1, "A", 0.5), (T1, "cash", 0.5), (T2, "A", 0.5), (T2, "cash", 0.5)])
    bm = spark.createDataFrame([(T0, "A", 0.4), (T1, "A", 0.4), (T1, "cash", 0.6)], "ts timestamp, symbol string, w double")
    var = spark.createDataFrame([(t, "A", 0.04) for t in (T0, T1, T2)], "ts timestamp, symbol string, value double")
    cov = var.select("ts", F.col("symbol").alias("sym_i"), F.col("symbol").alias("sym_j"), "value")
    for got in (terms.risk_diagonal(w, var, bm), terms.risk_full(w, cov, bm), terms.risk_by_matrix(w, cov, bm), terms.risk_forecast_error(w, var, bm)):
        out = values_of(got)
        assert out[T0] is None and out[T2] is None and abs(out[T1] - 0.01 * 0.04) < 1e-12
    twice = w.unionByName(w)
    assert abs(values_of(terms.risk_by_matrix(twice, cov))[T1] - values_of(terms.risk_full(twice, cov))[T1]) < 1e-12


def test_checks_do_not_pass_what_is_unknown(spark):
    w = book_rows(spark, [(T0, "A", None), (T0, "B", 0.5), (T0, "cash", 0.5), (T1, "A", 0.2), (T2, "cash", None)])
    ok = lambda df: {r.ts: r.ok for r in df.collect()}
    assert ok(checks.chk_leverage(w, 0.6)) == {T0: None, T1: True, T2: True}
    assert ok(checks.chk_turnover(w.withColumnRenamed("w", "z"), 0.6)) == {T0: None, T1: True, T2: True}
    values = spark.createDataFrame([("p", t, 1.0) for t in (T0, T1, T2)], "portfolio_id string, ts timestamp, v double")
    assert ok(checks.chk_min_cash(w, values, 0.1)) == {T0: True, T1: None, T2: None}
    bm = spark.createDataFrame([(T1, "A", 0.2), (T1, "C", 0.5)], "ts timestamp, symbol string, w double")
    rows = {(r.ts, r.symbol): r.ok for r in checks.chk_min_bm_deviation(w, bm, -0.1).collect()}
    assert rows == {(T0, "A"): None, (T0, "B"): None, (T1, "A"): True, (T1, "C"): False}


def test_unknown_holdings_and_returns_make_values_unknown(spark):
    h = book_rows(spark, [(T0, "A", None), (T0, "cash", 1.0), (T1, "A", 3.0), (T1, "cash", 1.0)], "h")
    from panelforge.operators import analytics

    assert values_of(analytics.nav(h), value="v") == {T0: None, T1: 4.0}
    assert {(r.ts, r.symbol): r.w for r in analytics.weights(h).collect()} == {(T0, "A"): None, (T0, "cash"): None, (T1, "A"): 0.75, (T1, "cash"): 0.25}
    returns = spark.createDataFrame([(T0, "A", 0.1), (T1, "A", None), (T2, "A", 0.1), (T0, "B", 0.1), (T2, "B", 0.1)], "ts timestamp, symbol string, ret double")
    start = spark.createDataFrame([("a", "A", 100.0), ("ab", "A", 100.0), ("ab", "B", 50.0), ("c", "C", 1.0), ("z", "A", 1.0), ("z", "C", 0.0)], "portfolio_id string, symbol string, h double")
    v = {(r.portfolio_id, r.ts): r.v for r in trades.buy_and_hold_curve(start, returns).collect()}
    assert v["a", T0] == 100 and abs(v["a", T1] - 110) < 1e-9 and v["a", T2] is None and v["ab", T0] == 150 and v["ab", T1] is None and v["z", T0] == 1.0
    assert {t: v["c", t] for t in (T0, T1, T2)} == {T0: None, T1: None, T2: None}
    drifted = {(r.ts, r.symbol): r.w for r in trades.drifted_weights(book_rows(spark, [(T0, "A", 0.5), (T0, "B", 0.5), (T1, "A", 0.5), (T1, "B", 0.5)]), returns).collect()}
    assert drifted[T0, "A"] == 0.5 and drifted[T1, "A"] is None
    u = book_rows(spark, [(T1, "cash", None)], "u")
    cash = returns.unionByName(spark.createDataFrame([(T0, "cash", 0.0), (T1, "cash", 0.0)], returns.schema))
    nxt = {(r.ts, r.symbol): r.h_next for r in trades.step_holdings(h, u, cash, spark.createDataFrame([], "portfolio_id string, ts timestamp, value double")).collect()}
    assert nxt[T0, "cash"] == 1.0 and nxt[T1, "A"] is None and nxt[T1, "cash"] is None


def test_targets_bring_in_what_is_not_held(spark):
    now = book_rows(spark, [(T0, "A", 0.5), (T0, "cash", 0.5), (T1, "A", 0.5), (T1, "cash", 0.5)])
    target = spark.createDataFrame([("p", T0, "B", 0.7), ("p", T0, "cash", 0.3)], "portfolio_id string, ts timestamp, symbol string, w double")
    got = lambda df: {(r.ts, r.symbol): r.w for r in df.collect()}
    after = got(weights.w_adaptive(now, target, 0.1))
    assert after == {(T0, "A"): 0.0, (T0, "B"): 0.7, (T0, "cash"): 0.3, (T1, "A"): 0.5, (T1, "cash"): 0.5}
    assert got(weights.w_adaptive(now.where(F.col("ts") == T0), target, 5.0)) == {(T0, "A"): 0.5, (T0, "cash"): 0.5}
    assert got(weights.w_leverage_band(now.where(F.col("ts") == T0), target, 0.6, 1.0)) == {(T0, "A"): 0.0, (T0, "B"): 0.7, (T0, "cash"): 0.3}
    fixed = got(weights.w_fixed(now, target))
    assert fixed[T0, "B"] == 0.7 and fixed[T1, "A"] == 0.5 and (T1, "B") not in fixed
    way = got(weights.w_proportional_to_target(now, target.withColumn("ts", F.lit(T1))))
    assert way[T0, "B"] == 0.7 and way[T0, "A"] == 0.0 and abs(sum(w for (t, _), w in way.items() if t == T0) - 1) < 1e-12
    assert {r.is_cash for r in weights.w_fixed(now, target).where("symbol = 'B'").collect()} == {False}


def test_unknown_spreads_are_not_calm(spark):
    u = book_rows(spark, [(T0, "A", 5.0), (T1, "A", 5.0), (T1, "B", 0.0)], "u")
    returns = spark.createDataFrame([(t, s, x) for t in (T0, T1) for s, x in (("A", 0.1), ("B", -0.1))], "ts timestamp, symbol string, ret double")
    assert values_of(terms.stress_spread_cost(u, returns, 0.01, 0.01, 3.0)) == {T0: None, T1: 0.01 * 3 * 5.0}


def exchanges(df):
    """The keys of every hash exchange of a plan."""
    import re

    return re.findall(r"hashpartitioning\(([^)]*), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def hot_rows(spark, n=4000):
    rng = np.random.default_rng(6)
    secs = np.sort(rng.integers(0, 9 * 86_400, n))
    return spark.createDataFrame([("hot" if i % 5 else f"s{i % 3}", START + timedelta(seconds=int(t)), None if i % 11 == 0 else float(rng.normal())) for i, t in enumerate(secs)], "symbol string, ts timestamp, ret double")


@pytest.mark.parametrize("forward, exclusive", [(False, False), (False, True), (True, False), (True, True)])
def test_asof_joins_by_bucket_equal_plain_ones(spark, forward, exclusive):
    """One key holds most rows, with gaps of days on the right side, equal times, null values and null times."""
    left = hot_rows(spark).select("symbol", "ts", F.monotonically_increasing_id().alias("id"))
    right = hot_rows(spark).where("day(ts) % 3 <> 2 and second(ts) < 9").withColumnRenamed("ret", "x")
    more = spark.createDataFrame([("hot", None, 1.0), ("hot", START + timedelta(days=1), 2.0), ("other", START, 3.0)], "symbol string, ts timestamp, x double")
    left = left.unionByName(more.where("ts is null").select("symbol", "ts", F.lit(-1).alias("id")))
    right = right.unionByName(more)
    plain = asof_join(left, right.where("ts is not null"), ["x"], by=["symbol"], forward=forward, exclusive=exclusive)
    got = asof_join(left, right, ["x"], by=["symbol"], forward=forward, exclusive=exclusive, bucket=7_200.0)
    assert {r.id: r.x for r in got.collect()} == {r.id: r.x for r in plain.where("ts is not null").collect()} | {-1: None}
    keys = exchanges(got)
    assert any("asof_bucket" in k for k in keys)


@pytest.mark.parametrize("rolling", [None, 3_600.0, 200_000.0])
def test_trailing_sums_by_chunk_equal_plain_ones(spark, rolling):
    rows = hot_rows(spark).withColumn("id", F.monotonically_increasing_id()).cache()
    plain, got = (forecasts.moments(rows, rolling=rolling, chunk=c) for c in (None, 40_000.0))
    want = {r.id: (r.w0, r.w1, r.w2) for r in plain.collect()}
    for r in got.collect():
        for a, b in zip((r.w0, r.w1, r.w2), want[r.id]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-8)
    assert got.count() == len(want) and all("k_" in k for k in exchanges(got) if rolling) and any("k_" in k for k in exchanges(got))


@pytest.mark.parametrize("how", [{"rolling": 90_000.0, "chunk": 86_400.0}, {"rolling": 18_000.0, "half_life": 1_200.0}])
def test_rolling_sums_do_not_add_up_windows_row_by_row(spark, how):
    """No frame slides over rows, and what has left a window, however huge, leaves no trace in it; a null time sees null times alone; zones other than UTC hold."""
    n = 3_000
    values = [1e90 if i == 5 else float("inf") if i == 9 else 0.25 * (i % 7) for i in range(n)]
    rows = [("a", START + timedelta(seconds=60 * i), x, [i]) for i, x in enumerate(values)] + [("a", None, 3.0, None), ("b", START, None, None)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = forecasts.moments(spark.createDataFrame(rows, "symbol string, ts timestamp, ret double, extra array<int>").repartition(7), **how)
        assert "specifiedwindowframe(RangeFrame, -" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.symbol, r.extra[0] if r.extra else None): r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(got) == n + 2 and got["b", None].w0 is None
    back, half_life = int(how["rolling"] // 60), how.get("half_life")
    for i in (0, 1, 6, 2_000, 2_345, n - 1):
        past = range(max(0, i - back), i)
        w = [2.0 ** ((j - i) * 60 / half_life) if half_life else 1.0 for j in past]
        want = [sum(w), sum(a * values[j] for a, j in zip(w, past)), sum(a * values[j] * values[j] for a, j in zip(w, past))]
        r = got["a", i]
        assert [r.w0, r.w1, r.w2] == ([None] * 3 if not past else pytest.approx(want, rel=1e-12))


@pytest.mark.parametrize("name", ["stream_bars", "stream_bars_replay"])
def test_bars_hold_ticks_at_zero(spark, tmp_path, name):
    """The bars of a table are those of all its ticks, whatever they cost; cleaning is a step of its own."""
    from panelforge.jobs.queries import QUERIES

    ticks = [(i, START + timedelta(minutes=m), 20, x) for i, (m, x) in enumerate([(0, 5.0), (1, 0.0), (2, 7.0), (59, -1.0), (200, 3.0), (300, 4.0)])]
    own = pd.DataFrame(ticks, columns=["event_id", "ts", "user_id", "value"]).astype({"ts": "datetime64[us]"})
    own.to_parquet(tmp_path / "events.parquet")
    first = min(QUERIES[name](spark, str(tmp_path)).collect(), key=lambda r: r.t)
    assert (first.open, first.low, first.high, first.close, first.ticks) == (5.0, -1.0, 7.0, -1.0, 4)


@pytest.mark.parametrize("name", ["period_stats", "risk_full", "risk_full_gaps", "risk_factor_model", "risk_factor_model_gaps", "risk_factor_model_cov", "risk_factor_model_cov_gaps"])
def test_line_items_are_summed_once(spark, name):
    """Holdings and panel are read many times; what is read is their stored sums, never the line items again."""
    from panelforge.jobs.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "l_shipdate" not in plan


@pytest.mark.parametrize("name", ["market_job", "market_job_incremental"])
def test_landed_payloads_are_files(spark, monkeypatch, name):
    """The runs of the job read what has landed, they do not make it anew from the line items."""
    from panelforge.jobs import market_job
    from panelforge.jobs.queries import QUERIES

    seen, run = [], market_job.run
    monkeypatch.setattr(market_job, "run", lambda s, landed, *a, **k: (seen.append(landed), run(s, landed, *a, **k))[1])
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and all("l_shipdate" not in p._jdf.queryExecution().executedPlan().toString() for p in seen)


@pytest.mark.parametrize("name", ["market_job", "market_job_incremental"])
def test_rates_are_made_once(spark, name):
    """The panel with cash joins stored rates: orders are not read again wherever the plan names them."""
    from panelforge.jobs.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in plan and "orders.parquet" not in plan


def test_provisional_bars_settle_once(spark, tmp_path):
    """A bar is there while it forms, changes with further ticks, and is settled and single once ticks have passed it."""
    schema = "symbol string, ts timestamp, price double, event_id long"
    at = lambda h, m: START + timedelta(hours=h, minutes=m)
    batches = [[("a", at(0, 5), 1.0, 1), ("a", at(1, 2), 2.0, 2)], [("a", at(1, 30), 5.0, 3), ("a", at(0, 59), 9.0, 4)], [("a", at(3, 0), 3.0, 5)], [("a", at(1, 40), 77.0, 6), ("b", at(3, 1), 4.0, 7)]]
    source, table, seen = tmp_path / "in", str(tmp_path / "table"), []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        st.stream_latest_bars(stream, table, str(tmp_path / "cp")).awaitTermination()
        seen.append({(r.symbol, r.ts): (r.open, r.close, r.ticks, r.provisional) for r in st.latest_bars(spark, table).collect()})
    zero, one, three = at(0, 0), at(1, 0), at(3, 0)
    assert seen[0] == {("a", zero): (1.0, 1.0, 1, True), ("a", one): (2.0, 2.0, 1, True)}
    assert seen[1][("a", one)] == (2.0, 5.0, 2, True) and seen[1][("a", zero)][3] is False
    assert seen[2][("a", one)] == (2.0, 5.0, 2, False) and seen[2][("a", three)] == (3.0, 3.0, 1, True)
    # what comes later than the delay no longer moves a settled bar
    assert seen[3][("a", one)] == (2.0, 5.0, 2, False) and seen[3][("b", three)] == (4.0, 4.0, 1, True) and len(seen[3]) == 4


def test_subspace_factors_equal_whole_ones(spark):
    """Blocks of three symbols: the same factors, exposures and rests as from each date's whole matrix."""
    rng = np.random.default_rng(7)
    loads = rng.normal(size=(12, 3)) * [3.0, 2.0, 1.0]
    dates = [T0, T1]
    rows = []
    for k, t in enumerate(dates):
        m = loads @ loads.T + np.diag(0.05 + 0.05 * rng.random(12)) + k * 0.1 * np.eye(12)
        rows += [(t, f"s{i:02d}", f"s{j:02d}", float(m[i, j])) for i in range(12) for j in range(i, 12) if k == 0 or j < 11]
    cov = spark.createDataFrame(rows, "ts timestamp, sym_i string, sym_j string, value double")
    key = ["ts", "part", "factor", "symbol"]
    got = subspace.factor_model_pca_blocked(cov, 3, extra=2, iters=8, block=3).toPandas().sort_values(key, ignore_index=True)
    want = factors.factor_model_pca(cov, 3).toPandas().sort_values(key, ignore_index=True)
    pd.testing.assert_frame_equal(got[key], want[key])
    np.testing.assert_allclose(got["value"], want["value"], atol=1e-8)
    small = cov.where("sym_i <= 's01' and sym_j <= 's01'")
    few = subspace.factor_model_pca_blocked(small, 3, extra=2, iters=4).toPandas()
    assert set(few[few.part == "exposure"].factor) == {"f0000", "f0001"} and few[few.part == "idio"]["value"].abs().max() < 1e-8


def test_blocked_covariances_shuffle_no_pairs_and_subtract_nothing(spark):
    """Windows are sums of their own rows: a huge return that has left leaves no trace; no exchange or window is above the rows of pairs."""
    rng = np.random.default_rng(3)
    rows = [(s, START + timedelta(days=d), 1e9 if d < 5 else float(rng.normal(0, 0.01)), 1.0, 1.0) for d in range(60) for s in "abcde" if (d + ord(s)) % 7]
    panel = spark.createDataFrame(rows, schemas.PANEL)
    dates = spark.createDataFrame([(START + timedelta(days=d),) for d in (30, 40, 59)], "ts timestamp")
    out = forecasts.covariance_blocked(panel, dates, kelly=False, block=2, rolling=20 * 86_400.0, times=7)
    above = out._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Window" not in above
    wide = pd.DataFrame(rows, columns=["symbol", "ts", "ret", "v", "p"]).pivot(index="ts", columns="symbol", values="ret")
    found = out.collect()
    assert len(found) == 3 * 15
    for r in found:
        past = wide[(wide.index < r.ts) & (wide.index >= r.ts - timedelta(days=20))][[r.sym_i, r.sym_j]].dropna().to_numpy()
        want = (past[:, 0] * past[:, -1]).mean() - past[:, 0].mean() * past[:, -1].mean()
        assert r.n == len(past) and r.value == pytest.approx(want, rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("block", [12, 6, 4, 3, 2, 1])
def test_blocked_covariances_store_rows_once(spark, block):
    """Rows are packed and stored once, however many blocks they meet, and are not dealt to pairs; every pair comes once."""
    rng = np.random.default_rng(block)
    rows = [(f"s{i:02d}", START + timedelta(days=d), float(rng.normal()), 1.0, 1.0) for d in range(30) for i in range(12) if (d + i) % 5]
    dates = spark.createDataFrame([(START + timedelta(days=d),) for d in (20, 30)], "ts timestamp")
    out = forecasts.covariance_blocked(spark.createDataFrame(rows, schemas.PANEL), dates, block=block, times=7)
    assert "hashpartitioning(a" not in out._jdf.queryExecution().executedPlan().toString()
    stored = spark.read.parquet(*out.inputFiles())
    assert stored.select(F.explode("pieces.body").alias("body")).agg(F.sum(F.length("body"))).first()[0] == 12 * len(rows)
    assert stored.count() == stored.select("g").distinct().count() <= 12 // block
    wide = pd.DataFrame(rows, columns=["symbol", "ts", "ret", "v", "p"]).pivot(index="ts", columns="symbol", values="ret")
    found = {(r.ts, r.sym_i, r.sym_j): (r.n, r.value) for r in out.collect()}
    assert out.count() == len(found) == 2 * 78
    for (ts, i, j), (n, value) in found.items():
        past = wide[wide.index < ts][[i, j]].dropna().to_numpy()
        assert i <= j and n == len(past) and value == pytest.approx((past[:, 0] * past[:, -1]).mean(), rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("threshold", [0.5, 1.0, 4.0, 20.0, float("inf")])
def test_unlikely_rows_without_medians_for_most(threshold):
    rng = np.random.default_rng(4)
    x = rng.standard_cauchy(3000) * rng.choice([1e-3, 1.0, 30.0], 3000)
    x[rng.random(3000) < 0.1], x[rng.random(3000) < 0.05], x[rng.integers(0, 3000, 4)] = np.nan, 0.0, np.inf
    x[1000:1400] = rng.choice([1.0, 4.0, 20.0], 400)  # ratios that are just the threshold
    starts = np.array([0, 1, 3, 40, 900, 1000, 1700])
    with np.errstate(invalid="ignore"):
        np.testing.assert_array_equal(cleaning.unlikely(x.copy(), starts, threshold), cleaning.scores_of(x.copy(), starts) > threshold)


@pytest.mark.parametrize("chunk", [None, 450])
@pytest.mark.parametrize("lent", [False, True])
def test_price_rules_in_one_pass_equal_their_steps(spark, chunk, lent):
    raw, bars = gappy(spark, symbols=3, n=1300)
    wild = F.xxhash64("symbol", "ts") % 50
    bars = bars.withColumns({"open": F.when(wild == 0, F.col("open") * 8).when(wild != 1, F.col("open")), "low": F.when(wild == 2, F.col("low") / 9).otherwise(F.col("low")), "high": F.when(wild == 3, F.col("high") / 3).when(wild == 4, F.col("high") * 9).otherwise(F.col("high"))})
    bars = cleaning.ffill(bars, "close")
    cut = F.lit(START + timedelta(days=150))
    saved = bars.where(F.col("ts") < cut) if lent else None
    bars = bars.where(F.col("ts") >= cut) if lent else bars
    got = cleaning.null_anomalous_prices(bars, 8.0, saved, chunk).orderBy("symbol", "ts").toPandas()
    steps = cleaning.null_low_high_incompatible(cleaning.fill_open(cleaning.null_anomalous(bars, "open", 8.0, saved)))
    want = cleaning.null_anomalous(steps, ["low", "high"], 8.0, saved).orderBy("symbol", "ts").toPandas()
    assert want.low.isna().sum() > 10 and want.high.isna().sum() > 10
    pd.testing.assert_frame_equal(got, want)


def test_daily_cleaning_is_dealt_by_symbol_four_times_at_most(spark):
    """Line items, repaired bars and judged prices are dealt once each; it took six exchanges of whole rows before."""
    from panelforge.jobs.queries import QUERIES

    plan = QUERIES["daily_clean_bars"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("MapInArrow") == 2
