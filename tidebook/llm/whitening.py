"""Embedding whitening: principal components from one aggregation over all pairs of dimensions.

Vectors become whole numbers first, so that counts and sums are exact. A first aggregation has the number of vectors and each dimension's sum; a
second one has generated Spark SQL expressions that sum the centred products of every pair of dimensions in the upper triangle. Both combine before the shuffle, so
what travels from a task is the size of the covariance, and so is what comes to the driver, whatever the number of vectors. There it is assembled,
and LAPACK's symmetric eigensolver gives its components; the vectors are projected where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidebook.llm.common import replacing

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries of this magnitude or more are no whole number of 64 bits once scaled; a vector with one is dropped like one with an infinite entry.
TOO_LARGE = float(1 << 52)
#: A component whose share of the largest eigenvalue is not above this has no spread but rounding.
NO_SPREAD = 1e-12


@dataclass(frozen=True)
class Whitening:
    """The number of vectors fitted, each dimension's sum, least and greatest number, the eigenvalues, largest first, and their unit eigenvectors as rows."""

    n: int
    sums: tuple[int, ...]
    least: tuple[int, ...]
    greatest: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def spread(self, k: int) -> bool:
        return bool(self.values[k] > NO_SPREAD * self.values[0]) and self.values[0] > 0


def whole_vectors(rows: DataFrame, vector: str = "embedding", column: str = "_x") -> DataFrame:
    """rows with their vectors as arrays of longs, without those whose vector is null, or has an entry that is null, not finite or TOO_LARGE."""
    sound = lambda c: F.coalesce(F.abs(c.cast("double")) < TOO_LARGE, F.lit(False))  # noqa: E731  NaN is above every number
    entry = lambda c: F.when(sound(c), F.floor(SCALE * c.cast("double")).cast("long") + SHIFT)  # noqa: E731  Spark may take it of rows before they are dropped
    return rows.where(F.col(vector).isNotNull() & F.forall(F.col(vector), sound)).withColumn(column, F.transform(F.col(vector), entry))


def common_length(rows: DataFrame, column: str = "_x") -> int:
    """The length that most vectors have (of several the greatest); 0 without vectors."""
    most = rows.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return most["size"] if most else 0


def covariance(rows: DataFrame, sums: tuple[int, ...], n: int) -> np.ndarray:
    """The covariance (divisor n) of the column _x, of rows whose sums and number are given.

    Turned by o places, a centred vector stands beside itself so that dimension i meets i + o (modulo their number): turns up to the half bring every pair together. So all pairs are
    one aggregation by turn, with a generated sum for each dimension, and the plan grows with the dimensions, not with their square.
    """
    d = len(sums)
    centred = rows.select(F.expr(f"array({', '.join(f'coalesce(get(_x, {i}), 0L) - {s / n!r}D' for i, s in enumerate(sums))})").alias("_d"))
    turned = centred.select("_d", F.explode(F.sequence(F.lit(0), F.lit(d // 2))).alias("_o")).withColumn("_r", F.expr(f"concat(slice(_d, _o + 1, {d} - _o), slice(_d, 1, _o))"))
    found = turned.groupBy("_o").agg(*(F.expr(f"sum(_d[{i}] * _r[{i}])").alias(f"_{i}") for i in range(d))).collect()
    out = np.zeros((d, d))
    for row in found:
        i = np.arange(d)
        j = (i + row["_o"]) % d
        out[i, j] = out[j, i] = np.array(row[1:]) / n
    return out


def fit(vectors: DataFrame) -> Whitening | None:
    """The components of the column _x, whose arrays have one length; None without vectors."""
    d = common_length(vectors)
    if not d:
        return None
    first = vectors.selectExpr("count(*) AS n", *(f"{f}(get(_x, {i})) AS {f}_{i}" for f in ("sum", "min", "max") for i in range(d))).first()
    n, (sums, least, greatest) = first["n"], (tuple(first[f"{f}_{i}"] for i in range(d)) for f in ("sum", "min", "max"))
    cov = covariance(vectors, sums, n)
    values, columns = np.linalg.eigh(cov)
    return Whitening(n, sums, least, greatest, np.maximum(values[::-1], 0.0), columns.T[::-1], float(np.trace(cov)))


def deviations(x: np.ndarray, of: Whitening) -> list[int | None]:
    """Of each whole vector the sum over dimensions of (n * x - S)^2, exact; None where it passes 64 bits. The fit's own bounds tell whether 64 bits are enough for every row."""
    reach = sum(max(of.n * hi - s, s - of.n * lo) ** 2 for s, lo, hi in zip(of.sums, of.least, of.greatest, strict=True))
    if reach < 1 << 63:
        return ((of.n * x - np.array(of.sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((of.n * x.astype(object) - np.array(of.sums, object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact.tolist()]


def whitened(vectors: DataFrame, of: Whitening, components: int = COMPONENTS, column: str = "whitened") -> DataFrame:
    """vectors (with _x) with an array of their first components, each the centred vector's projection over the root of the eigenvalue (null for a component without spread), and _deviation."""
    ks = [k for k in range(min(components, of.dimensions)) if of.spread(k)]
    mean = np.array([s / of.n for s in of.sums])
    weights = (of.vectors[ks] / np.sqrt(of.values[ks])[:, None]).T
    rest = [None] * (min(components, of.dimensions) - len(ks))  # eigenvalues fall: what has no spread comes last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy().reshape(-1, of.dimensions)
            projected = pa.array([v + rest for v in ((x - mean) @ weights).tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, projected, pa.array(deviations(x, of), pa.int64())], names=[*batch.schema.names, column, "_deviation"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField(column, ArrayType(DoubleType())), StructField("_deviation", LongType())]))


def identity_error(white: DataFrame, of: Whitening, components: int = COMPONENTS, column: str = "whitened") -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity; they are centred. Components without spread are left out; None if there is no other."""
    ks = [k for k in range(min(components, of.dimensions)) if of.spread(k)]
    pairs = [(i, j) for i in ks for j in ks if i <= j]
    if not pairs:
        return None
    found = white.selectExpr(*(f"sum({column}[{i}] * {column}[{j}]) AS _{i}_{j}" for i, j in pairs)).first()
    return max(abs(v / of.n - (i == j)) for (i, j), v in zip(pairs, found, strict=True))


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """rows with _x, whitened (an array of their first components) and _deviation, and the fit. Rows with a null, not finite or too large entry are dropped, and so are those whose
    vector has not the length of most; a repeated row counts as often as it occurs. Other columns stay, but for ones of these names."""
    vectors = whole_vectors(replacing(rows, "_x", "whitened", "_deviation"), vector)
    d = common_length(vectors)
    vectors = vectors.where(F.size("_x") == d) if d else vectors.limit(0)
    of = fit(vectors)
    if of is None:
        return vectors.withColumns({"whitened": F.array().cast("array<double>"), "_deviation": F.lit(None).cast("long")}), None
    return whitened(vectors, of, components), of


def whitening_report(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each vector and component.

    Null vectors and those with null or non-finite entries are dropped, as are those whose length isn't that of most, or with an entry of 2^52 or more. Components
    are numbered from 1 by falling eigenvalue. One without spread (all vectors alike along it) has whitened null; without any spread explained is null too, and without any
    component that has some so is identity_error. deviation is null where it passes 64 bits. Rows that repeat come out as often; a null vec_id stays null. Other
    columns are ignored. Without vectors, or with vectors of no dimension, there are no rows.
    """
    white, of = whiten(rows.select("vec_id", "embedding"), "embedding", components)
    kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if of is None:
        return white.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in kinds.split(", "))))
    shares = F.array(*(F.lit(float(v / of.trace) if of.trace > 0 else None).cast("double") for v in of.values[: min(components, of.dimensions)]))
    error = F.lit(identity_error(white, of, components)).cast("double")
    each = white.select("vec_id", F.col("_deviation").alias("deviation"), F.posexplode("whitened").alias("_k", "whitened"))
    return each.select("vec_id", (F.col("_k") + 1).alias("component"), F.lit(of.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_k")).alias("explained"), error.alias("identity_error"))
