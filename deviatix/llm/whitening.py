"""Embedding whitening: exact integer scatter matrices from bit planes, then principal components."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c is counted as floor(SCALE * c) + SHIFT; SCALE * c is held within +-LIMIT.
SCALE, SHIFT, LIMIT = 1024, 100_000, 1 << 40
#: Rows whose bit planes are held at a time.
ROWS = 8192
#: A covariance of so many dimensions at most meets on the driver.
MOST_DIMS = 2048
#: A component with less than this share of the variance has no direction of its own in double precision.
LEAST_SHARE = 1e-12


def bit_planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimension, bit, 64-bit words over the rows) of each plane that isn't zero; values (rows, dims) are not negative."""
    dims, bits, words = [], [], []
    for b in range(int(values.max(initial=0)).bit_length()):
        packed = np.packbits((values >> b & 1).astype(np.uint8).T, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        used = np.flatnonzero(packed.any(axis=1))
        dims.append(used)
        bits.append(np.full(len(used), b))
        words.append(packed[used].view(np.uint64))
    if not dims:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, 1), np.uint64)
    return np.concatenate(dims), np.concatenate(bits), np.concatenate(words)


def cross_products(values: np.ndarray) -> np.ndarray:
    """The exact sums over the rows of values[:, i] * values[:, j], as whole numbers of any size.

    Each dimension is shifted to its least value and packed to bit planes; planes of bits p and q have
    popcount(p AND q) rows in common, which weigh 2^(p + q). The shift is taken out at the end.
    """
    n, d = values.shape
    low = values.min(axis=0)
    shifted = values - low
    dims, bits, words = bit_planes(shifted)
    common = np.zeros((len(dims), len(dims)), np.int64)
    for k in range(len(dims)):
        common[k, k:] = np.bitwise_count(words[k] & words[k:]).sum(axis=1, dtype=np.int64)
    common = np.triu(common) + np.triu(common, 1).T
    wide = 2 * int(bits.max(initial=0)) + 2 + n.bit_length() > 62
    weights = np.zeros((len(dims), d), object if wide else np.int64)
    weights[np.arange(len(dims)), dims] = [1 << int(b) for b in bits]
    inner = (weights.T @ common.astype(weights.dtype) @ weights).astype(object)
    sums, low = shifted.sum(axis=0).astype(object), low.astype(object)
    return inner + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("v") > 0))


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def scatter(rows: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, sums of products) of the rows' whole numbers, exact. Each task sums its blocks of rows; Spark sums the
    tasks' numbers, dims * (dims + 3) / 2 + 1 of them, which meet on the driver."""
    import pyarrow as pa

    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            x = whole_numbers(_matrix(batch.column(0), dims))
            for k in range(0, len(x), ROWS):
                block = x[k : k + ROWS]
                n, sums, products = n + len(block), sums + block.sum(axis=0).astype(object), products + cross_products(block)
        if n:
            values = [n, *sums, *products[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(map(Decimal, map(int, values)), pa.decimal128(38, 0))], names=["cell", "value"])

    found = rows.select("v").mapInArrow(run, "cell int, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    cells = {r.cell: int(r.value) for r in found}
    products = np.zeros((dims, dims), object)
    products[upper] = [cells[1 + dims + k] for k in range(len(upper[0]))]
    return cells[0], [cells[1 + i] for i in range(dims)], np.triu(products) + np.triu(products, 1).T


def components(n: int, sums: list[int], products: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors as columns, trace) of the covariance, largest first. Its entries are centred as whole
    numbers, n * products - sums * sums, and only then divided."""
    s = np.array(sums, object)
    centred = n * products - np.outer(s, s)
    covariance = np.array([[x / (n * n) for x in row] for row in centred], float)
    value, vector = np.linalg.eigh(covariance)
    order = np.argsort(-value, kind="stable")[:most]
    return value[order], vector[:, order], int(np.trace(centred)) / (n * n)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """A row per usable vector and component up to ``most``: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null, empty or hold a null, NaN or infinite entry are dropped, as are those of another length than
    the most usual one (of equally usual ones the longest). Entries are counted as whole numbers, so the scatter matrix
    is exact whatever the order of rows and partitions; no row leaves its partition. ``deviation`` is the sum of
    (n * x - S)^2, null where it is no long. ``whitened`` is null for components without variance (all of them if all
    vectors are equal), ``explained`` if there is no variance at all; ``identity_error`` is over the other components and
    null if there are none. Entries beyond +-2^30 count as that. Repeated rows each count, null ids get their rows, an
    empty table has none. Other columns are ignored.
    """
    import pyarrow as pa

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = _usable(vectors, id_col, vector_col)
    usual = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = usual.dims
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} dimensions: their covariance does not fit the driver")
    rows = rows.where(F.size("v") == dims)
    n, sums, products = scatter(rows, dims)
    value, vector, trace = components(n, sums, products, most)
    varied = [k for k in range(len(value)) if trace > 0 and value[k] > LEAST_SHARE * trace]
    explained = [float(v) / trace if trace > 0 else None for v in value]
    axes = vector[:, varied] / np.sqrt(value[varied])

    def centred(column) -> np.ndarray:
        """n * x - S, in whole numbers."""
        x = whole_numbers(_matrix(column, dims))
        if max(int(np.abs(x).max(initial=0)) * n, *map(abs, sums)) < 1 << 62:
            return x * np.int64(n) - np.array(sums, np.int64)
        return x.astype(object) * n - np.array(sums, object)

    def projected(c: np.ndarray) -> np.ndarray:
        return (c / n).astype(float) @ axes

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(varied)
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = projected(centred(batch.column(0)))
            first, second = first + w.sum(axis=0), second + w.T @ w
        values = [*first, *second.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], names=["cell", "value"])

    error = None
    if varied:
        k = len(varied)
        got = {r.cell: r.value for r in rows.select("v").mapInArrow(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()}
        mean = np.array([got[i] for i in range(k)]) / n
        second = np.array([got[k + i] for i in range(k * k)]).reshape(k, k) / n
        error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())

    def deviations(c: np.ndarray) -> list:
        top = int(np.abs(c).max(initial=0))
        if c.dtype != object and dims * top * top < 1 << 63:
            return (c * c).sum(axis=1).tolist()
        whole = [sum(int(x) ** 2 for x in row) for row in c]
        return [x if x < 1 << 63 else None for x in whole]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(value)
        for batch in batches:
            c = centred(batch.column(1))
            w = np.full((len(c), many), np.nan)
            w[:, varied] = projected(c)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(c)), many))),
                pa.array(np.tile(np.arange(1, many + 1), len(c)), pa.int32()),
                pa.array(np.full(len(c) * many, n), pa.int64()),
                pa.array(deviations(c), pa.int64()).take(pa.array(np.repeat(np.arange(len(c)), many))),
                pa.array(w.ravel(), pa.float64(), from_pandas=True),
                pa.array(explained * len(c), pa.float64()),
                pa.array([error] * (len(c) * many), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, schema)
