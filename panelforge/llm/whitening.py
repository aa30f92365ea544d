"""Embedding whitening: covariance over distinct vectors weighted by their copies, each distinct vector whitened once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import constant, cut, shuffle_tasks
from .vectors import matrix, reach, slices, usable, width

LONG = (1 << 63) - 1


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Rows ``(vec_id, x)`` with x = floor(scale * entry) + shift.

    Left out: null vectors, vectors with null or non-finite entries (entries of 2^50 or more count as such), and vectors of another length than the commonest.
    """
    chosen = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    own = chosen.where(F.size("v") == width(chosen, "v"))
    return own.select("vec_id", F.transform("v", lambda c: (F.floor(c.cast("double") * scale) + shift).cast("long")).alias("x"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``(x, copies)`` of every distinct vector, counted on the map side first."""
    return rows.groupBy("x").agg(F.count("*").alias("copies"))


@dataclass(frozen=True)
class Fit:
    """Sums and principal axes of a weighted list of whole vectors: ``axes`` has a column for each component by falling variance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    axes: np.ndarray
    trace: float

    def base(self) -> np.ndarray:
        """The whole part of the mean; taken off first, exactly, so that centring loses no digit."""
        return np.array([s // max(1, self.n) for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean."""
        return (x - self.base()).astype(float) - np.array([s % self.n / self.n for s in self.sums])

    def scales(self) -> np.ndarray:
        """One over each component's deviation; 0 where rounding alone is left of its variance."""
        floor = np.finfo(float).eps * len(self.sums) * max(self.variances, default=0.0)
        return np.where(self.variances > floor, 1 / np.sqrt(np.maximum(self.variances, np.finfo(float).tiny)), 0.0)


def _sums(distinct: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many vectors there are, and exact sums of their entries: a row for each dimension and task, added up in decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in slices(batches, dims):
            x, w = matrix(batch.column("x"), dims), batch.column("copies").to_numpy()
            exact = reach(x) * int(w.sum()) < LONG
            part = w @ x if exact else w.astype(object) @ x.astype(object)
            n, total = n + int(w.sum()), [a + int(b) for a, b in zip(total, part)]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, dims), pa.int32()), "part": pa.array([str(v) for v in [n, *total]])})

    parts = distinct.select("x", "copies").mapInArrow(run, "at int, part string")
    rows = parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()  # a row for each dimension
    by = {r["at"]: int(r["s"]) for r in rows}
    return by.get(-1, 0), [by.get(i, 0) for i in range(dims)]


def _moment(rows: DataFrame, dims: int, n: int, centred) -> np.ndarray:
    """Weighted mean outer product of ``centred`` rows: a Gram matrix in each task, its upper entries added up by Spark."""
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dims, dims))
        for batch in slices(batches, dims):
            z = centred(matrix(batch.column(0), dims))
            gram += (z * batch.column("copies").to_numpy()[:, None]).T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), pa.int64()), pa.array(gram[upper])], names=["at", "part"])

    out = np.zeros((dims, dims))
    for r in rows.mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("s")).collect():  # dims squared / 2 numbers
        i, j = upper[0][r["at"]], upper[1][r["at"]]
        out[i, j] = out[j, i] = r["s"] / n
    return out


def fit(distinct: DataFrame, weighted: bool = True) -> Fit:
    """Principal axes of ``distinct(x, copies)``, copies as weights, or (``weighted=False``) one for each distinct vector.

    Vectors are centred before they are multiplied. The driver holds dims squared numbers. An empty table gives a fit of n 0 without components.
    """
    first = distinct.select(F.size("x").alias("d")).first()
    dims = first["d"] if first else 0
    rows = distinct if weighted else distinct.select("x", F.lit(1).cast("long").alias("copies"))
    n, sums = _sums(rows, dims)
    none = Fit(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    if not n or not dims:
        return none
    covariance = _moment(rows.select("x", "copies"), dims, n, none.centred)
    values, axes = np.linalg.eigh(covariance)
    return Fit(n, sums, np.maximum(values[::-1], 0.0), axes[:, ::-1], float(np.trace(covariance)))


def transform(distinct: DataFrame, model: Fit, components: int = 32) -> DataFrame:
    """``(x, copies, deviation, whitened)`` of every distinct vector.

    ``deviation`` is the sum over dimensions of (n * x - S)^2, exact; null where a long cannot hold it. ``whitened`` has the first ``components``
    coordinates on the axes over their deviations; null for a component without variance, which cannot be whitened.
    """
    dims, n = len(model.sums), model.n
    scales = model.scales()[:components]
    flat = np.broadcast_to(scales == 0, (1, len(scales)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(model.sums, dtype=object)
        for batch in slices(batches, dims):
            x = matrix(batch.column("x"), dims)
            if (reach(x) * n + max(map(abs, model.sums), default=0)) < LONG:
                away = x * n - sums.astype(np.int64)
                away = away if reach(away) ** 2 * dims < LONG else away.astype(object)
            else:
                away = x.astype(object) * n - sums
            squares = (away * away).sum(axis=1) if dims else np.zeros(len(x), dtype=np.int64)
            z = model.centred(x) @ (model.axes[:, : len(scales)] * scales)
            values = pa.array(z.ravel(), pa.float64(), mask=np.broadcast_to(flat, z.shape).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(scales), pa.int32()), values)
            whole = pa.array([int(v) if v <= LONG else None for v in squares], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("copies"), whole, lists], names=["x", "copies", "deviation", "whitened"])

    return distinct.select("x", "copies").mapInArrow(run, "x array<long>, copies long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, model: Fit, components: int = 32, weighted: bool = True) -> float:
    """The largest absolute entry of the whitened list's covariance less the identity, over components that have variance."""
    live = np.nonzero(model.scales()[:components])[0].tolist()
    if not live:
        return 0.0
    copies = F.col("copies") if weighted else F.lit(1).cast("long")
    rows = whitened.select(F.array(*(F.get("whitened", F.lit(i)) for i in live)).alias("z"), copies.alias("copies"))
    sums = rows.select(F.posexplode("z").alias("at", "v"), "copies").groupBy("at").agg(F.sum(F.col("v") * F.col("copies")).alias("s")).collect()  # a row for each component
    mean = np.array([x["s"] for x in sorted(sums, key=lambda x: x["at"])]) / model.n
    got = _moment(rows, len(live), model.n, lambda z: z - mean)
    return float(np.abs(got - np.eye(len(live))).max())


def whiten(rows: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, weighted: bool = True) -> DataFrame:
    """Rows ``(vec_id, n, deviation, whitened, explained, identity_error)``, one per usable row; the two arrays have a number for each component.

    Identical vectors are grouped, the covariance of all rows is fitted on the groups with their counts as weights, each distinct vector is whitened
    once, and rows take its result by a join on the vector. See :func:`whole_vectors` for rows that are left out. Repeated rows and null ids
    stay; an empty table gives an empty result; other columns are ignored.

    Scale: one shuffle of the vectors to count them, one to join back. A vector that many rows share is one row of the fit; in the join its rows are
    dealt to as many copies of it as its count asks for. The vectors that are dealt so are fewer than four for each shuffle task, so their list is broadcast.
    """
    spark = rows.sparkSession
    own = cut(whole_vectors(rows, id_col, vector_col, scale, shift))
    distinct = cut(distinct_vectors(own))
    model = fit(distinct, weighted)
    done = cut(transform(distinct, model, components))
    error = identity_error(done, model, components, weighted)
    explained = [float(v / model.trace) if model.trace else 0.0 for v in model.variances[:components]]

    total = distinct.agg(F.sum("copies").alias("n")).first()["n"] or 0
    share = max(64, total // (4 * shuffle_tasks(spark)))
    key = F.xxhash64("x").alias("key")
    hot = distinct.where(F.col("copies") > share).groupBy(key).agg(F.max(F.ceil(F.col("copies") / share)).cast("int").alias("parts"))
    hot = F.broadcast(cut(hot))
    parts = F.coalesce("parts", F.lit(1))
    asked = own.withColumns({"key": key, "tie": F.monotonically_increasing_id()}).join(hot, "key", "left").withColumn("part", F.pmod("tie", parts).cast("int"))
    given = done.withColumn("key", key).join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    joined = asked.select("vec_id", "x", "key", "part").join(given.select("x", "key", "part", "deviation", "whitened"), ["key", "part", "x"])
    return joined.select(
        "vec_id",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        constant(explained, "array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
