"""Principal factors of large universes by subspace iteration over blocks of a covariance: no task holds a date's matrix."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import shared_folder

PART = "ts timestamp, g int, x array<double>"


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rows(frames: Iterator[pd.DataFrame], make: Callable[[pd.Series], tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame([make(r) for r in frame.itertuples(index=False)], columns=columns)


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays ``x`` added up by key, entry by entry, on the map side first."""
    entries = parts.select(*keys, F.posexplode("x").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    listed = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("l"))  # a block's entries
    return listed.select(*keys, F.transform("l", lambda e: e["v"]).alias("x"))


def symbol_blocks(cov: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``(ts, g, symbols)`` and the covariance as dense matrices ``(ts, a, b, x)``, row by row, for each pair of symbol blocks; absent pairs are 0."""
    both = cov.select("ts", "sym_i", "sym_j", "value").union(cov.where("sym_i <> sym_j").select("ts", "sym_j", "sym_i", "value"))
    count = max(1, -(-cov.agg(F.count_distinct("sym_i")).first()[0] // block))
    named = both.select("ts", F.col("sym_i").alias("symbol")).distinct().withColumn("g", F.pmod(F.xxhash64("symbol"), F.lit(count)).cast("int"))
    members = _stored(named.groupBy("ts", "g").agg(F.sort_array(F.collect_list("symbol")).alias("symbols")), "members")
    placed = members.select("ts", "g", F.posexplode("symbols").alias("at", "symbol"), F.size("symbols").alias("n"))
    left, right = (placed.select("ts", F.col("g").alias(g), F.col("at").alias(i), F.col("symbol").alias(s), F.col("n").alias(n)) for g, i, s, n in (("a", "i", "sym_i", "na"), ("b", "j", "sym_j", "nb")))
    cells = both.join(left, ["ts", "sym_i"]).join(right, ["ts", "sym_j"]).select("ts", "a", "b", "i", "j", "na", "nb", "value")

    def dense(own: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((own["na"].iloc[0], own["nb"].iloc[0]))
        x[own["i"], own["j"]] = own["value"]
        return pd.DataFrame({"ts": [own["ts"].iloc[0]], "a": [own["a"].iloc[0]], "b": [own["b"].iloc[0]], "x": [x.ravel()]})

    return members, _stored(cells.groupBy("ts", "a", "b").applyInPandas(dense, "ts timestamp, a int, b int, x array<double>"), "blocks")


def _times(blocks: DataFrame, v: DataFrame, width: int) -> DataFrame:
    """The covariance times ``v(ts, g, x)``, of ``width`` columns: one product for each block, summed by row block."""
    joined = blocks.join(v.select("ts", F.col("g").alias("b"), F.col("x").alias("y")), ["ts", "b"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def product(r: tuple) -> tuple:
            y = np.asarray(r.y).reshape(-1, width)
            return r.ts, r.a, (np.asarray(r.x).reshape(-1, len(y)) @ y).ravel()

        return _rows(frames, product, ["ts", "g", "x"])

    return _summed(joined.select("ts", "a", "x", "y").mapInPandas(run, PART), ["ts", "g"])


def _inner(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """``(ts, m)``: a'b of every date, width squared numbers."""
    both = a.join(b.withColumnRenamed("x", "y"), ["ts", "g"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _rows(frames, lambda r: (r.ts, (np.asarray(r.x).reshape(-1, width).T @ np.asarray(r.y).reshape(-1, width)).ravel()), ["ts", "x"])

    return _summed(both.select("ts", "x", "y").mapInPandas(run, "ts timestamp, x array<double>"), ["ts"]).withColumnRenamed("x", "m")


def _turned(v: DataFrame, small: DataFrame, width: int, by: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``v`` times a small matrix that ``by`` makes of each date's ``m``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _rows(frames, lambda r: (r.ts, r.g, (np.asarray(r.x).reshape(-1, width) @ by(np.asarray(r.m).reshape(width, width))).ravel()), ["ts", "g", "x"])

    return v.join(small, "ts").select("ts", "g", "x", "m").mapInPandas(run, PART)


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """What makes columns with these products orthonormal; columns that depend on others become 0."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-14 * max(values.max(), 1e-300)
    return vectors * np.where(good, 1 / np.sqrt(np.where(good, values, 1.0)), 0.0)


def factor_model_pca_blocked(cov: DataFrame, k: int, extra: int = 8, iters: int = 12, block: int = 256) -> DataFrame:
    """:func:`~panelforge.operators.factors.factor_model_pca` for universes whose matrix no task should hold: ``(ts, part, factor, symbol, value)``.

    ``k + extra`` columns are multiplied by the covariance block by block and made orthonormal by their small inner products, ``iters`` times; the k largest
    factors of the small matrix that is left are the model. An error in a factor shrinks by the ratio of variance ``k + extra + 1`` to the factor's own in
    every round. ``idio`` is what the factors leave of each variance; of a covariance that is not positive, it bears the negative parts too.
    """
    width = k + extra
    members, blocks = symbol_blocks(cov, block)

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _rows(frames, lambda r: (r.ts, r.g, np.concatenate([np.random.default_rng(zlib.crc32(s.encode())).normal(size=width) for s in r.symbols])), ["ts", "g", "x"])

    v = _stored(members.mapInPandas(begin, PART), "columns")
    for _ in range(iters):
        y = _stored(_times(blocks, v, width), "columns")
        v = _stored(_turned(y, _inner(y, y, width), width, _orthonormal), "columns")

    def largest(small: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        return vectors[:, ::-1] * np.sqrt(np.maximum(values[::-1], 0.0))

    found = _stored(_turned(v, _inner(v, _times(blocks, v, width), width), width, largest), "columns")
    rows = found.join(members, ["ts", "g"]).select("ts", "g", F.posexplode("symbols").alias("at", "symbol"), "x")
    rows = rows.select("ts", "g", "at", "symbol", F.posexplode(F.slice("x", F.col("at") * width + 1, k)).alias("factor", "f"))
    # the largest entry of each factor is positive; a factor beyond the symbols' number is none
    sign = rows.groupBy("ts", "factor").agg(F.signum(F.max_by("f", F.struct(F.abs("f"), "symbol"))).alias("sign"))
    count = members.groupBy("ts").agg(F.sum(F.size("symbols")).alias("n"))
    rows = _stored(rows.join(sign, ["ts", "factor"]).join(count, "ts").where("factor < n").withColumn("f", F.col("f") * F.when(F.col("sign") < 0, -1.0).otherwise(1.0)), "factors")
    exposure = rows.select("ts", F.lit("exposure").alias("part"), F.format_string("f%04d", "factor").alias("factor"), "symbol", F.col("f").alias("value"))
    own = cov.where("sym_i = sym_j").select("ts", F.col("sym_i").alias("symbol"), F.col("value").alias("whole"))
    taken = rows.groupBy("ts", "symbol").agg(F.sum(F.col("f") * F.col("f")).alias("taken")).join(own, ["ts", "symbol"], "left")
    rest = F.coalesce("whole", F.lit(0.0)) - F.col("taken")
    return exposure.union(taken.select("ts", F.lit("idio").alias("part"), F.lit(None).cast("string").alias("factor"), "symbol", rest.alias("value")))
