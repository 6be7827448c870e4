"""Whitening of embeddings by the covariance of distinct vectors, weighted by how often each occurs.

Vectors become integers, x = floor(scale * entry) + shift, so that equal vectors are equal exactly. Identical x are grouped
with map-side combine; counts, or one each, are the weights of the fit. Sums are exact integers, the covariance comes from
centred products alone (a weighted matrix product per Arrow batch, added up per task, one row per row of the matrix), and
only the d x d covariance goes to the driver for its eigenvectors; d is the width of the vectors, so this does not grow with
the rows. Each distinct vector is whitened once and joined back to its rows. The copies of one vector, were it a third of
the table, spread over ``SLICES`` join keys.

Defined results: a null vector, an empty one, and one with null, NaN, infinite or unrepresentable entries (beyond 2**52 after
scaling) is dropped. The width is that of most vectors, or the larger one in a tie; vectors of another width are dropped.
Rows that repeat an id stay rows, a null id stays null, other columns are never read. Components of no variance (below 1e-12
of the trace) cannot be scaled and are left out, so equal vectors alone, or an empty table, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.sources.staging import stage

#: Join keys over which the copies of one vector are dealt.
SLICES = 64
#: Variance below this share of the trace counts as none.
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """A fit: number of fit vectors, exact sums per dimension, eigenvalues and unit eigenvectors (as rows) of the covariance."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, from the exact integers n * x - sums, so that nothing cancels in floating point."""
        top = int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) // max(self.n, 1) + 1
        if top * self.n < 2**62:
            return (x * np.int64(self.n) - np.array(self.sums, np.int64)) / self.n
        whole = np.array([s // self.n for s in self.sums], np.int64)  # the integer part of the mean, then its fraction
        return (x - whole) - np.array([s % self.n / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(id, x array<long>, slice) of the rows that hold a finite vector of the common width."""
    entry = F.transform(rows[vector_col].cast("array<double>"), lambda c: F.floor(F.when(F.abs(c) < float(2**52 // scale), c) * scale) + shift)
    x = rows.select(common.id_key(rows[id_col]).alias("id"), entry.alias("x")).filter((F.size("x") > 0) & ~F.exists("x", F.isnull))
    widths = x.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    x = x.filter(F.size("x") == (widths[0] if widths else 0))
    return x.withColumn("slice", F.pmod(F.xxhash64("id", F.rand(7)), F.lit(SLICES)).cast("int"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(x, copies, slices) of ``integer_vectors``: each distinct vector, its rows, and the slices in which they lie."""
    return rows.groupBy("x").agg(F.count("*").alias("copies"), F.collect_set("slice").alias("slices"))


def batches_of(x: pa.Array) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py() : x.offsets[-1].as_py()].reshape(len(x), -1)


def summed_rows(distinct: DataFrame, of_batch, width: int) -> np.ndarray:
    """The sum over all batches of the width x width matrices ``of_batch(x, weights)``.

    A task adds up its own matrix and emits a row for each of its rows; these are added entry by entry in a shuffle.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                total += of_batch(batches_of(batch["x"]), batch["weight"].to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = distinct.select("x", "weight").mapInArrow(add, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for i, j, v in cells.collect():  # width x width cells
        out[i, j] = v
    return out


def fit(distinct: DataFrame, components: int = 8, weighted: bool = True) -> Whitening | None:
    """The fit over stored distinct vectors, with their copies or one each as weights; None if there are none."""
    weight = F.col("copies") if weighted else F.lit(1).cast("long")
    distinct = distinct.select("x", weight.alias("weight"))
    n = distinct.agg(F.sum("weight")).first()[0]
    if not n:
        return None
    exact = (F.col("v").cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")).cast("decimal(38,0)")
    cells = distinct.select("weight", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(exact).alias("s")).collect()
    sums = tuple(int(s) for _, s in sorted(cells))  # a row per dimension
    width = len(sums)
    centre = Whitening(n, sums, 0.0, np.ones(0), np.ones((0, width)))

    def products(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        d = centre.centred(x)
        return d.T @ (d * weights[:, None])

    covariance = summed_rows(distinct, products, width) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > NO_VARIANCE * trace]
    return Whitening(n, sums, trace, values[order], vectors[:, order].T.copy())


def identity_error(distinct: DataFrame, fitted: Whitening, weighted: bool = True) -> float:
    """Largest absolute entry of the covariance of the whitened fit vectors minus the identity, measured on all of them."""
    weight = F.col("copies") if weighted else F.lit(1).cast("long")
    width = len(fitted.values)

    def moments(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Products and, in the last row, sums: what a covariance needs. The whitened mean is 0 but for rounding."""
        y = np.column_stack((fitted.apply(x), np.ones(len(x))))
        return y.T @ (y * weights[:, None])

    total = summed_rows(distinct.select("x", weight.alias("weight")), moments, width + 1) / fitted.n
    mean = total[-1, :width]
    return float(np.abs(total[:width, :width] - np.outer(mean, mean) - np.eye(width)).max(initial=0))


def whiten(rows: DataFrame, distinct: DataFrame, fitted: Whitening) -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>) of all rows; each distinct vector is worked on once.

    ``deviation`` is the exact sum over dimensions of (n * x - sums)**2.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batches_of(batch["x"])
            width = max(1, x.shape[1])
            top = (int(np.abs(x).max(initial=0)) * fitted.n + max(map(abs, fitted.sums))) ** 2 * width
            if top < 2**63:
                d = x * np.int64(fitted.n) - np.array(fitted.sums, np.int64)
                deviation = (d * d).sum(1).tolist()
            else:  # beyond 64 bits: Python's integers
                deviation = [sum((fitted.n * v - s) ** 2 for v, s in zip(row, fitted.sums, strict=True)) for row in x.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch["x"], batch["slices"], pa.array([str(d) for d in deviation]), pa.array(list(fitted.apply(x)), pa.list_(pa.float64()))],
                ["x", "slices", "deviation", "whitened"],
            )

    once = distinct.select("x", "slices").mapInArrow(work, "x array<long>, slices array<int>, deviation string, whitened array<double>")
    dealt = once.select("x", F.explode("slices").alias("slice"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened")
    return rows.join(dealt, ["x", "slice"]).select(common.public_id(F.col("id")).alias("id"), "deviation", "whitened")


def whitened_components(rows: DataFrame, id_col: str, vector_col: str, components: int = 8, weighted: bool = True) -> DataFrame:
    """A row for each kept vector and component, the largest variance first: (id, component, n, deviation, whitened, explained, identity_error)."""
    kept = stage(integer_vectors(rows, id_col, vector_col), "integer-vectors")
    distinct = stage(distinct_vectors(kept), "distinct-vectors")
    fitted = fit(distinct, components, weighted)
    schema = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, fitted, weighted)
    explained = F.array(*(F.lit(float(v / fitted.trace)) for v in fitted.values))
    long = whiten(kept, distinct, fitted).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
