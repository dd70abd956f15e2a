"""Whitening of vectors from an exact covariance found by polarisation.

Components ``c`` are counted as whole numbers ``x = floor(scale * c) + shift``.  Three passes over the vectors:

1. how many there are (``n``) and the sum ``S`` of every dimension;
2. centred values ``y`` squared and summed for every dimension, and for the sum of every pair of dimensions.  A
   variance needs nothing else, and ``2 cov(a, b) = var(a + b) - var(a) - var(b)``;
3. the covariance of the whitened values themselves, from which ``identity_error`` is read.

Values are centred by the whole number below the mean; what is left of the mean, ``S - n m``, enters the variances
at the end, ``n^2 var = n sum(y^2) - (sum y)^2`` in whole numbers, so every entry of the covariance is the exact one rounded
once.  Tasks sum blocks of rows in 64-bit integers where these cannot overflow and in Python's own integers
otherwise, cut sums into pieces of ``LIMB_BITS`` bits, and Spark adds the pieces up; the driver gets one sum per
dimension and pair of dimensions, whatever the number of rows.

Defined cases: vectors that are null, empty or hold a null or non-finite entry take no part, nor do
vectors whose length is not the commonest one (of equally common ones the greatest); finite entries of any size count.
Repeated rows and ids are rows of their own, a null id stays.  ``deviation`` is null where it does not
fit into 64 bits; ``deviation_exact`` always has its digits.  A component without variance (fewer different vectors than
components) has null for ``whitened`` and takes no part in ``identity_error``; ``explained`` is null if there is
no variance at all.  Fewer dimensions than ``components`` give as many components as dimensions.  Of the two signs of a
component the one is taken whose entry of greatest size is positive.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMB_BITS = 40
BLOCK_ROWS = 2048
#: Products of whitened values are summed in whole multiples of this, so that their order does not matter.
FIXED_POINT = 2.0**-30
#: An eigenvalue below this share of the greatest is rounding, not variance.
NO_VARIANCE = 1e-13


def _finite(df: DataFrame, keep: list[str], vector_col: str) -> DataFrame:
    """``_0, _1, ...`` (the columns ``keep``) and ``_v``, the entries as doubles, of rows that take part."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    own = df.select(
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)],
        F.col(f"`{vector_col}`").cast("array<double>").alias("_v"),
    )
    return own.where(F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", odd))


def _counted(batch: pa.RecordBatch, scale: int, shift: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of a batch: first row and the whole numbers, 64-bit if all are far from its ends, else Python's."""
    column = batch.column(batch.num_columns - 1)
    for low in range(0, batch.num_rows, BLOCK_ROWS):
        part = column.slice(low, BLOCK_ROWS)
        entries = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
        with np.errstate(over="ignore"):
            floors = np.floor(entries * scale)
        if np.abs(floors).max(initial=0) < 2.0**62:
            yield low, floors.astype(np.int64) + shift
        else:
            exact = [
                math.floor(f) if math.isfinite(f) else int(c) * scale
                for c, f in zip(entries.ravel().tolist(), floors.ravel().tolist())
            ]
            yield low, np.array(exact, dtype=object).reshape(entries.shape) + shift


def _less(x: np.ndarray, center: list[int]) -> np.ndarray:
    """``x`` less the center of every dimension, in 64 bits if nothing can overflow."""
    if x.dtype != object and max(map(abs, center), default=0) < 1 << 62:
        return x - np.array(center, dtype=np.int64)
    return x.astype(object) - np.array(center, dtype=object)


def _greatest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _sum(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if x.dtype != object and _greatest(x) * len(x) >= 1 << 62:
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=0)] if len(x) else [0] * x.shape[1]


def _squares(y: np.ndarray) -> list[int]:
    """Exact sums of the squares of every dimension, then of every sum of two dimensions (a, b), a < b."""
    if y.dtype != object and 4 * _greatest(y) ** 2 * len(y) >= 1 << 62:
        y = y.astype(object)
    out = [int(v) for v in (y * y).sum(axis=0)]
    for a in range(y.shape[1] - 1):
        both = y[:, a, None] + y[:, a + 1:]
        out += [int(v) for v in (both * both).sum(axis=0)]
    return out


def _added(rows: DataFrame, sums: Callable[[np.ndarray], list[int]], scale: int, shift: int) -> dict[int, int]:
    """Exact totals over all rows of what ``sums`` makes of blocks of them, by place."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            for _, x in _counted(batch, scale, shift):
                own = sums(x)
                total = [a + b for a, b in zip(total, own)] if total else own
        item, limb, value = [], [], []
        for at, rest in enumerate(total):
            k = 0
            while True:
                last = -(1 << LIMB_BITS) < rest < 1 << LIMB_BITS
                item.append(at)
                limb.append(k)
                value.append(rest if last else rest & ((1 << LIMB_BITS) - 1))
                if last:
                    break
                rest, k = rest >> LIMB_BITS, k + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())],
            names=["item", "limb", "value"],
        )

    found = rows.select("_v").mapInArrow(pieces, "item int, limb int, value long")
    out: dict[int, int] = {}
    for row in found.groupBy("item", "limb").agg(F.sum("value").alias("value")).collect():
        out[row.item] = out.get(row.item, 0) + (row.value << (LIMB_BITS * row.limb))
    return out


def covariance(n: int, sums: list[int], squares: dict[int, int]) -> tuple[np.ndarray, int]:
    """Covariances (divisor ``n``) from the sums of centred values and of their squares, and a power of two: the
    matrix is that of the values divided by it, so that no entry leaves the range of doubles."""
    dim = len(sums)
    # n^2 times the variance of one dimension, or of the sum of two.
    own = [n * squares[a] - sums[a] ** 2 for a in range(dim)]
    unit = 1 << max(0, (max(own).bit_length() - 2 * n.bit_length()) // 2)
    parts = (n * unit) ** 2
    out, at = np.zeros((dim, dim)), dim
    for a in range(dim):
        out[a, a] = Fraction(own[a], parts)
        for b in range(a + 1, dim):
            both = n * squares[at] - (sums[a] + sums[b]) ** 2
            out[a, b] = out[b, a] = Fraction(both - own[a] - own[b], 2 * parts)
            at += 1
    return out, unit


def principal(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def whiten(
    df: DataFrame, keep: list[str] | None = None, vector_col: str = "embedding", components: int = 8,
    scale: int = 1024, shift: int = 100_000,
) -> DataFrame:
    """One row per vector and component: the columns ``keep`` (``vec_id`` unless named), ``component`` (from 1), ``n``,
    ``deviation`` (sum over dimensions of ``(n x - S)^2``), ``deviation_exact`` (the same as text), ``whitened``,
    ``explained`` and ``identity_error``."""
    spark, keep = df.sparkSession, ["vec_id"] if keep is None else keep
    finite = _finite(df, keep, vector_col)
    kinds = ", ".join(f"{c} {kind}" for c, kind in finite.dtypes if c != "_v")
    schema = (
        (kinds + ", " if kinds else "") + "_component int, _n long, _deviation long, _deviation_exact string, "
        "_whitened double, _explained double, _identity_error double"
    )
    names = [*keep, "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"]
    length = F.size("_v")
    common = finite.groupBy(length.alias("dim")).agg(F.count("*").alias("n")).orderBy(
        F.col("n").desc(), F.col("dim").desc()
    ).first()
    if common is None:
        return spark.createDataFrame([], schema).toDF(*names)
    dim, n = common["dim"], common["n"]
    rows = finite.where(length == dim)
    totals = _added(rows, _sum, scale, shift)
    center = [totals[a] // n for a in range(dim)]
    rest = [totals[a] - n * center[a] for a in range(dim)]
    cov, unit = covariance(n, rest, _added(rows, lambda x: _squares(_less(x, center)), scale, shift))
    values, vectors = principal(cov, components)
    real = values > NO_VARIANCE * values.max(initial=0.0)
    # One rounding less: eigenvectors over the root of their eigenvalue, and the mean already projected.
    columns = np.divide(vectors, np.sqrt(np.where(real, values, 1.0)))
    fraction = np.array([r / (n * unit) for r in rest])

    def projected(x: np.ndarray) -> np.ndarray:
        """Whitened values, added up dimension by dimension so that a row's do not depend on its block."""
        y = _less(x, center)
        y = (y / unit).astype(np.float64) - fraction
        out = np.zeros((len(x), len(values)))
        for a in range(dim):
            out += y[:, a, None] * columns[a]
        return out

    used = np.flatnonzero(real)
    pairs = [(a, b) for i, a in enumerate(used) for b in used[i:]]

    def moments(x: np.ndarray) -> list[int]:
        w = projected(x)
        products = [w[:, a] for a in used] + [w[:, a] * w[:, b] for a, b in pairs]
        return _sum(np.rint(np.stack(products, axis=1) / FIXED_POINT).astype(np.int64)) if products else []

    second = {at: v * FIXED_POINT / n for at, v in _added(rows, moments, scale, shift).items()}
    mean = {a: second[i] for i, a in enumerate(used)}
    error = max(
        (abs(second[len(used) + i] - mean[a] * mean[b] - (a == b)) for i, (a, b) in enumerate(pairs)), default=None
    )
    trace = float(np.trace(cov))
    explained = [max(float(v), 0.0) / trace if trace > 0 else None for v in values]

    def deviations(x: np.ndarray) -> list[int]:
        y = _less(x, center)
        if y.dtype != object and _greatest(y) * max(_greatest(y), n) * dim >= 1 << 62:
            y = y.astype(object)
        r = np.array(rest, dtype=object if y.dtype == object else np.int64)
        own, cross, last = (y * y).sum(axis=1), (y * r).sum(axis=1), sum(v * v for v in rest)
        return [n * n * int(a) - 2 * n * int(b) + last for a, b in zip(own.tolist(), cross.tolist())]

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            for low, x in _counted(batch, scale, shift):
                w, exact, m = projected(x), deviations(x), len(x)
                held = np.repeat(np.arange(low, low + m), k)
                yield pa.RecordBatch.from_arrays([
                    *[column.take(pa.array(held)) for column in batch.columns[:-1]],
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, dtype=np.int64)),
                    pa.array([d if d < 1 << 63 else None for d in exact for _ in range(k)], pa.int64()),
                    pa.array([str(d) for d in exact for _ in range(k)], pa.string()),
                    pa.array(w.ravel(), pa.float64(), mask=np.tile(~real, m)),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ], names=[c.split(" ")[0] for c in schema.split(", ")])

    return rows.mapInArrow(results, schema).toDF(*names)
