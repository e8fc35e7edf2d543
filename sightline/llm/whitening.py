"""Whitening of candidates' score vectors by principal components, with a check of the result.

The table is read three times.  The first pass sums every dimension, the second sums the products of the
centred entries block by block into the scatter, and the third projects.  Between the passes the driver
holds one ``width x width`` matrix and nothing that grows with the rows.  Its factor is a Cholesky factor
with the largest diagonal left as pivot, which stops at the numerical rank.  Plane rotations of pairs of
its columns (one-sided Jacobi) go on until all columns are orthogonal: then their squared norms are the
eigenvalues of the scatter and the columns of unit length its components, small ones as precise as large.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import by_value, field, map_arrow
from sightline.session import reliable_checkpoint

#: An entry ``c`` counts as the whole number ``floor(SCALE * c) + SHIFT``.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Whole numbers up to here are exact as doubles; vectors with larger entries count as not finite.
EXACT = 2.0**53
#: Rows whose products are added up at once.
ROWS = 4096
#: The largest number of a DECIMAL(38, 0).
DIGITS = 10**38 - 1


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """``G`` with ``G @ G.T == scatter`` and as many columns as its numerical rank.

    Every step takes the dimension with the most scatter left; the rows of ``G`` stay in the given order,
    so ``G`` is a lower triangle whose rows are permuted.
    """
    left = np.array(scatter, float)
    width = len(left)
    diagonal = left.diagonal().copy()
    least = width * np.finfo(float).eps * max(diagonal.max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    open_ = np.ones(width, bool)
    for _ in range(width):
        pivot = int(np.argmax(np.where(open_, diagonal, -np.inf)))
        if not diagonal[pivot] > least:
            break
        column = left[:, pivot].copy()
        if columns:
            before = np.stack(columns, axis=1)
            column -= before @ before[pivot]
        column = np.where(open_, column, 0.0) / np.sqrt(diagonal[pivot])
        columns.append(column)
        diagonal -= column**2
        open_[pivot] = False
    return np.stack(columns, axis=1) if columns else np.zeros((width, 0))


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``n`` columns in rounds of disjoint pairs, as a tournament deals them."""
    seats = np.arange(n + n % 2)
    for _ in range(len(seats) - 1):
        a, b = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
        real = (a < n) & (b < n)
        yield np.minimum(a, b)[real], np.maximum(a, b)[real]
        seats = np.r_[seats[:1], seats[-1:], seats[1:-1]]


def jacobi_components(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of ``factor @ factor.T``.

    Columns are rotated in pairs until none are further from orthogonal than rounding.  The entry of most
    weight in a component is positive.
    """
    g = factor[:, np.argsort(-(factor**2).sum(axis=0), kind="stable")].astype(float)
    close = len(g) * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for a, b in _rounds(g.shape[1]):
            x, y = g[:, a], g[:, b]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            apart = np.abs(xy) > close * np.sqrt(xx) * np.sqrt(yy)
            if not apart.any():
                continue
            turned = True
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                cot = (yy - xx) / (2 * xy)
                tan = np.where(cot == 0, 1.0, np.sign(cot) / (np.abs(cot) + np.sqrt(1 + cot * cot)))
            tan = np.where(apart, tan, 0.0)
            cos = 1 / np.sqrt(1 + tan * tan)
            sin = cos * tan
            g[:, a], g[:, b] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    values = (g * g).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    values, g = values[order], g[:, order]
    units = g / np.sqrt(values)
    most = units[np.abs(units).argmax(axis=0), np.arange(units.shape[1])] if units.size else np.zeros(0)
    return values, units * np.where(most < 0, -1.0, 1.0)


def _whole_numbers(column: pa.Array, width: int, scale: int, shift: int) -> np.ndarray:
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return np.floor(scale * entries).astype(np.int64) + shift


def usable_vectors(candidates: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``(_id, _v)``: candidates with a vector of finite numbers, none of them too large to be exact."""
    number = F.col("_v").cast("array<double>")
    whole = F.forall(number, lambda x: x.isNotNull() & (F.abs(x) * scale < F.lit(EXACT)))
    given = candidates.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    return given.where(F.col("_v").isNotNull() & (F.size("_v") > 0)).where(whole).select("_id", number.alias("_v"))


class Whitening:
    """What the first two passes find: ``n``, the whole numbers' sums, eigenvalues and components."""

    def __init__(self, width: int, n: int, sums: list[int], trace: float, values: np.ndarray, components: np.ndarray) -> None:
        self.width, self.n, self.sums, self.trace, self.values, self.components = width, n, sums, trace, values, components
        #: Mean of every dimension as a whole number and a fraction, so that centring loses nothing.
        self.floors = np.array([s // n for s in sums] if n else [], np.int64)
        self.rests = [s % n for s in sums] if n else []
        self.fractions = np.array([r / n for r in self.rests])


def fit_whitening(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> Whitening:
    """Sums, scatter and components of the usable vectors ``rows (_id, _v)`` of the most frequent length."""
    width = (
        rows.groupBy(F.size("_v").alias("width")).count()
        .agg(F.max(F.struct("count", "width"))["width"]).first()[0]
    )
    if not width:
        return Whitening(0, 0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    vectors = rows.where(F.size("_v") == width).select("_v")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            x = _whole_numbers(batch.column(0), width, scale, shift)
            n += len(x)
            low = (x & 0xFFFFFFFF).sum(axis=0)  # halves, so that no sum of a batch overflows
            total += low.astype(object) + ((x >> 32).sum(axis=0).astype(object) << 32)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))],
                names=["dimension", "n", "total"],
            )

    whole = T.DecimalType(38, 0)
    summed = map_arrow(vectors, add, [T.StructField("dimension", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", whole)])
    summed = summed.groupBy("dimension").agg(F.sum("n").alias("n"), F.sum("total").cast(whole).alias("total")).orderBy("dimension").collect()
    found = Whitening(width, summed[0]["n"], [int(r["total"]) for r in summed], 0.0, np.zeros(0), np.zeros((width, 0)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = np.zeros((width, width))
        for batch in batches:
            x = _whole_numbers(batch.column(0), width, scale, shift)
            for at in range(0, len(x), ROWS):
                z = (x[at : at + ROWS] - found.floors) - found.fractions
                scatter += z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array(list(scatter), pa.list_(pa.float64()))], names=["dimension", "products"]
        )

    parts = map_arrow(vectors, products, [T.StructField("dimension", T.IntegerType()), T.StructField("products", T.ArrayType(T.DoubleType()))])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            products_ = batch.column(1).flatten().to_numpy().reshape(-1, width)
            for dimension, row in zip(batch.column(0).to_pylist(), products_, strict=True):
                held[dimension] = held[dimension] + row if dimension in held else row.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["dimension", "products"]
        )

    # One line of the matrix per dimension reaches the driver, whatever the number of tasks.
    dealt = parts.withColumn("_part", F.spark_partition_id()).repartition("dimension").sortWithinPartitions("dimension", "_part")
    lines = map_arrow(dealt.select("dimension", "products"), total, parts.schema)
    scatter = np.zeros((width, width))
    for r in lines.collect():
        scatter[r["dimension"]] = r["products"]
    covariance = (scatter + scatter.T) / (2 * found.n)
    values, units = jacobi_components(pivoted_cholesky(covariance))
    found.trace, found.values, found.components = float(covariance.trace()), values[:components], units[:, :components]
    return found


def whitened_vectors(
    candidates: DataFrame, id_col: str = "candidate_id", vector: str = "score_components",
    components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT,
) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)`` per usable candidate and component.

    Entries become whole numbers ``x = floor(scale * c) + shift`` and all figures are of those: ``n`` rows,
    ``S`` their sums, ``V`` their covariance with divisor ``n``.  ``deviation`` (DECIMAL(38, 0), null where
    it has more digits) is the exact sum of ``(n * x - S) ** 2``; ``whitened`` is the centred vector on
    component ``component`` over the root of its eigenvalue; ``explained`` is the eigenvalue's share of
    ``V``'s trace.  ``identity_error`` is the largest entry, without sign, of the covariance of all
    ``whitened`` less the identity.

    Candidates whose vector is null, empty or of another length than most (the longer of lengths alike in
    number), or holds a null, a non-finite number or one beyond ``2 ** 53 / scale`` are left out.  There are
    as many components as ``V`` has rank, at most ``components``: rows that are all alike, a single row or
    none give no rows.  Repeated rows and null ids are rows like others; of components with equal
    eigenvalues any rotation may be returned.  Other columns are not read and may have any name.  The driver
    holds ``width ** 2`` doubles, ``width`` being the vectors' length.
    """
    rows = usable_vectors(candidates, id_col, vector, scale)
    found = fit_whitening(rows, scale, shift, components)
    width, kept = found.width, len(found.values)
    names = [f"w{k}" for k in range(kept)]
    fields = [
        field(rows, "_id", "_id"), T.StructField("deviation", T.DecimalType(38, 0)),
        *[T.StructField(name, T.DoubleType()) for name in names],
    ]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, square = found.n, sum(r * r for r in found.rests)
        rests = np.array(found.rests, object)
        small = max(found.rests, default=0) < 2**31
        for batch in batches:
            y = _whole_numbers(batch.column(1), width, scale, shift) - found.floors
            onto = ((y - found.fractions) @ found.components) / np.sqrt(found.values)
            # sum((n * y - rest) ** 2) in whole numbers; 64 bits hold the inner sums of all but huge entries
            exact = y if small and np.abs(y).max(initial=0) * width < 2**31 else y.astype(object)
            squares, crosses = (exact * exact).sum(axis=1).tolist(), (exact @ (rests.astype(np.int64) if exact is y else rests)).tolist()
            sums = [n * n * a - 2 * n * b + square for a, b in zip(squares, crosses, strict=True)]
            deviation = pa.array([Decimal(s) if s <= DIGITS else None for s in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), deviation, *[pa.array(np.ascontiguousarray(onto[:, k])) for k in range(kept)]], names=[f.name for f in fields]
            )

    projected = map_arrow(rows.where(F.size("_v") == width), project, fields)
    if kept:
        projected = reliable_checkpoint(projected)
    error = identity_error(projected, names)
    each = F.array(*[
        F.struct(F.lit(k + 1).alias("component"), F.col(name).alias("whitened"), F.lit(float(found.values[k] / found.trace)).alias("explained"))
        for k, name in enumerate(names)
    ])
    if not kept:
        each = F.array().cast("array<struct<component: int, whitened: double, explained: double>>")
    return projected.select("_id", "deviation", F.explode(each).alias("c")).select(
        F.col("_id").alias(id_col), "c.component", F.lit(found.n).cast("bigint").alias("n"), "deviation",
        "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(whitened: DataFrame, names: list[str]) -> float | None:
    """Largest entry, without sign, of the columns' covariance less the identity; None without columns."""
    if not names:
        return None
    entries = [F.abs(F.covar_pop(a, b) - F.lit(float(a == b))) for i, a in enumerate(names) for b in names[i:]]
    return whitened.select(F.greatest(*entries, F.lit(0.0))).first()[0]


by_value(__name__)
