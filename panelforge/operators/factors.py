"""Matrix work, one date (or symbol) to a pandas group: factorisations, factor models, regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import asof_join, divided, seen_from

FACTORS = "ts timestamp, factor string, symbol string, f double"
MODEL = "ts timestamp, part string, factor string, symbol string, value double"


def _square(own: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Symbols, and the full matrix of rows (sym_i <= sym_j, value); absent pairs are 0."""
    names = sorted({*own["sym_i"], *own["sym_j"]})
    at = {s: i for i, s in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    i, j = own["sym_i"].map(at), own["sym_j"].map(at)
    out[i, j] = out[j, i] = own["value"]
    return names, out


def _factor(matrix: np.ndarray) -> np.ndarray:
    """Q sqrt(max(eigenvalues, 0)), ascending; each column's largest entry is positive, so that the sign is defined."""
    values, vectors = np.linalg.eigh(matrix)
    out = vectors * np.sqrt(np.maximum(values, 0.0))
    flip = np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])
    return out * np.where(flip == 0, 1.0, flip)


def psd_factor(cov: DataFrame) -> DataFrame:
    """``(ts, factor, symbol, f)`` with F'F the nearest positive form of each date's ``(ts, sym_i, sym_j, value)``.

    One date is one task: up to some thousand symbols.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        names, matrix = _square(own)
        f = _factor(matrix)
        n = len(names)
        return pd.DataFrame({"ts": own["ts"].iloc[0], "factor": np.repeat([f"f{k:04d}" for k in range(n)], n), "symbol": names * n, "f": f.T.ravel()})

    return cov.groupBy("ts").applyInPandas(run, FACTORS)


def _model(ts: pd.Timestamp, names: list[str], f: np.ndarray, idio: np.ndarray) -> pd.DataFrame:
    k = len(f)
    parts = [pd.DataFrame({"ts": ts, "part": "exposure", "factor": np.repeat([f"f{i:04d}" for i in range(k)], len(names)), "symbol": names * k, "value": f.ravel()})]
    parts.append(pd.DataFrame({"ts": ts, "part": "idio", "factor": None, "symbol": names, "value": idio}))
    return pd.concat(parts)


def factor_model_pca(cov: DataFrame, k: int) -> DataFrame:
    """``(ts, part, factor, symbol, value)``: the k largest factors as exposures, the rest of each variance as idio."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        names, matrix = _square(own)
        f = _factor(matrix)
        return _model(own["ts"].iloc[0], names, f[:, -k:].T[::-1], (f[:, :-k] ** 2).sum(axis=1))

    return cov.groupBy("ts").applyInPandas(run, MODEL)


def factor_model_svd(panel: DataFrame, dates: DataFrame, k: int, days: int, iters: int = 10) -> DataFrame:
    """Low rank plus diagonal at each date, from the past ``days``, missing returns imputed by repeated truncated SVD.

    A negative idiosyncratic variance (too many gaps) is reported as missing, for the caller to reject.
    """
    seen = seen_from(panel, dates, days)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        wide = own.pivot(index="ts", columns="symbol", values="ret").sort_index().dropna(axis=1, how="all")
        x = wide.to_numpy(float)
        gaps, guess = np.isnan(x), np.zeros_like(x)
        for _ in range(iters if gaps.any() else 0):
            u, s, v = np.linalg.svd(np.where(gaps, guess, x), full_matrices=False)
            guess = u[:, :k] * s[:k] @ v[:k]
        if not gaps.any():
            u, s, v = np.linalg.svd(x, full_matrices=False)
        f = s[:k, None] * v[:k] / np.sqrt(len(x))
        f *= np.where(np.take_along_axis(f, np.abs(f).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
        idio = np.nanmean(x**2, axis=0) - (f**2).sum(axis=0)
        return _model(own["at"].iloc[0], list(wide.columns), f, np.where(idio >= 0, idio, np.nan))

    return seen.select("at", "ts", "symbol", "ret").groupBy("at").applyInPandas(run, MODEL)


def factor_model_monthly(panel: DataFrame, k: int = 15, days: int = 730) -> DataFrame:
    """At each month's first time: the k largest principal factors of the second moment of the past ``days``.

    Parts: ``exposure`` (unit vectors), ``factor_variance`` (their variances) and ``idio``. Symbols with a gap are left out.
    """
    months = panel.select("ts").distinct().groupBy(F.date_trunc("month", "ts")).agg(F.min("ts").alias("ts")).select("ts")
    seen = seen_from(panel, months, days)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        wide = own.pivot(index="ts", columns="symbol", values="ret").dropna(axis=1)
        x, names = wide.to_numpy(float), list(wide.columns)
        at, top = own["at"].iloc[0], min(k, len(names))
        if not top:
            return pd.DataFrame({"ts": [], "part": [], "factor": [], "symbol": [], "value": []})
        values, vectors = np.linalg.eigh(x.T @ x / len(x))
        values, vectors = np.maximum(values[::-1][:top], 0.0), vectors[:, ::-1][:, :top].T
        vectors *= np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
        idio = np.maximum((x**2).mean(axis=0) - (values[:, None] * vectors**2).sum(axis=0), 0.0)
        variances = pd.DataFrame({"ts": at, "part": "factor_variance", "factor": [f"f{i:04d}" for i in range(top)], "symbol": None, "value": values})
        return pd.concat([_model(at, names, vectors, idio), variances])

    return seen.select("at", "ts", "symbol", "ret").groupBy("at").applyInPandas(run, MODEL)


def linear_regression_return(panel: DataFrame, regressors: DataFrame, at: str) -> DataFrame:
    """``(symbol, forecast)``: per symbol least squares on an intercept and the regressors, solved at the last known values.

    ``regressors(ts, x)`` holds an array of values. Moments are summed by Spark; only the small solve is NumPy.
    """
    now = F.lit(at).cast("timestamp")
    times = asof_join(panel.select("ts").distinct(), regressors, ["x"]).where("x is not null")
    one = F.concat(F.array(F.lit(1.0)), F.col("x"))
    rows = panel.where((F.col("ts") < now) & F.col("ret").isNotNull()).join(F.broadcast(times.withColumn("x", one)), "ts")
    last = asof_join(panel.sparkSession.range(1).select(now.alias("ts")), regressors, ["x"]).select(one.alias("last"))
    cells = rows.select("symbol", "ret", "x", F.posexplode("x").alias("i", "xi"))
    xty = cells.groupBy("symbol", "i").agg(F.sum(F.col("xi") * F.col("ret")).alias("b"))
    xtx = cells.select("symbol", "i", "xi", F.posexplode("x").alias("j", "xj")).groupBy("symbol", "i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("a"))
    flat = lambda df, *order: df.groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda c: c[order[-1]]).alias(order[-1]))
    packed = flat(xtx, "i", "j", "a").join(flat(xty, "i", "b"), "symbol").join(F.broadcast(last), how="left")

    @F.pandas_udf("double")
    def solve(a: pd.Series, b: pd.Series, last: pd.Series) -> pd.Series:
        """All systems of a batch in one call: least squares by the pseudo-inverse."""
        if not len(a):
            return pd.Series([], dtype=float)
        right, now = np.stack(b.to_list()), np.stack(last.to_list())
        k = right.shape[1]
        inverse = np.linalg.pinv(np.stack(a.to_list()).reshape(-1, k, k), rcond=k * np.finfo(float).eps, hermitian=True)
        return pd.Series(np.einsum("nk,nkj,nj->n", now, inverse, right))

    return packed.select("symbol", solve("a", "b", "last").alias("forecast"))


def regression_weights(panel: DataFrame, regressors: DataFrame, at: str, gamma: float = 0.1) -> tuple[DataFrame, list[float]]:
    """``(ts, x)`` of standardised past regressors and an intercept, and the ridge weights of the current ones (intercept not penalised).

    Means, deviations and second moments are summed by Spark; the driver sees one row of regressors squared sums, whatever the calendar.
    """
    now = F.lit(at).cast("timestamp")
    times = asof_join(panel.where(F.col("ts") <= now).select("ts").distinct(), regressors, ["x"]).where("x is not null")
    cells = times.select("ts", F.posexplode("x").alias("i", "x"))
    scale = cells.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = cells.join(F.broadcast(scale), "i").select("ts", F.struct("i", divided(F.col("x") - F.col("m"), F.col("s")).alias("z")).alias("c"))
    rows = z.groupBy("ts").agg(F.sort_array(F.collect_list("c")).alias("c")).select("ts", F.concat(F.transform("c", lambda c: c["z"]), F.array(F.lit(1.0))).alias("x"))
    past = rows.where(F.col("ts") < now)
    pairs = past.select(F.posexplode("x").alias("i", "xi"), "x").select("i", "xi", F.posexplode("x").alias("j", "xj"))
    moments = pairs.groupBy("i", "j").agg(F.avg(F.col("xi") * F.col("xj")).alias("a")).collect()  # regressors squared
    current = rows.agg(F.max_by("x", "ts").alias("x")).first()["x"]
    k = len(current)
    matrix = np.diag([gamma] * (k - 1) + [0.0])
    for c in moments:
        matrix[c["i"], c["j"]] += c["a"]
    return past, np.linalg.solve(matrix, np.array(current)).tolist()


def regression_mean(panel: DataFrame, regressors: DataFrame, at: str, gamma: float = 0.1) -> DataFrame:
    """``(symbol, forecast)``: the weights times the regressor-weighted mean returns."""
    past, weights = regression_weights(panel, regressors, at, gamma)
    rows = panel.where("ret is not null").join(F.broadcast(past), "ts")
    means = rows.groupBy("symbol").agg(*(F.avg(F.col("ret") * F.col("x")[i]).alias(f"m{i}") for i in range(len(weights))))
    return means.select("symbol", sum((F.col(f"m{i}") * w for i, w in enumerate(weights)), F.lit(0.0)).alias("forecast"))


def regression_covariance(panel: DataFrame, regressors: DataFrame, at: str, gamma: float = 0.1) -> DataFrame:
    """``(sym_i, sym_j, value)``: the weights times the regressor-weighted second moments of each pair's common rows."""
    past, weights = regression_weights(panel, regressors, at, gamma)
    rows = panel.where("ret is not null").join(F.broadcast(past), "ts")
    pairs = rows.select("ts", F.col("symbol").alias("sym_i"), F.col("ret").alias("ri"), "x").join(rows.select("ts", F.col("symbol").alias("sym_j"), F.col("ret").alias("rj")), "ts").where("sym_i <= sym_j")
    own = pairs.groupBy("sym_i", "sym_j").agg(*(F.avg(F.col("ri") * F.col("rj") * F.col("x")[i]).alias(f"m{i}") for i in range(len(weights))))
    return own.select("sym_i", "sym_j", sum((F.col(f"m{i}") * w for i, w in enumerate(weights)), F.lit(0.0)).alias("value"))
