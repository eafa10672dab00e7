"""Whitening of embeddings by a covariance summed in two passes.

Entries become whole numbers, floor(SCALE * c) + SHIFT, whose sums are exact whatever the order of the tasks; they give the mean
S / n. A second pass centres every block of vectors and multiplies it with itself (NumPy GEMM); the triangles of these
products go up a tree of partial sums (treeAggregate), so that the driver sees a handful of them at any number of partitions. LAPACK's
symmetric solver gives the eigenvectors on the driver, whose matrix is as large as a vector is wide squared, and the
projection on the first `COMPONENTS`, one row of numbers each, is broadcast. A third pass measures the covariance of what
came out: blocks are centred by their own mean and merged by counts and means.

Defined results: rows whose vector is null, or holds null or non-finite entries, or entries beyond `LARGEST`, give nothing; neither do vectors of
another than the most frequent length (of several, the greatest), nor empty ones. Repeated and null ids are rows of their own. A
component without variance (an eigenvalue of no more than rounding) has null whitened values; explained is then 0, or null if
nothing varies at all. `deviation` is null where it exceeds a long; `deviation_digits` has it at any size.
Eigenvectors of equal eigenvalues are any basis of their space; the sign makes the entry of greatest size positive.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import table, trimmed

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries of a greater size would leave the whole numbers that a double and a long hold.
LARGEST = float(1 << 42)
#: Partial sums that meet in one node of the tree; entries of vectors that a worker takes at once.
FAN, BLOCK = 8, 1 << 20
#: An eigenvalue counts as rounding below so many units of the greatest one's last place, times the width.
ROUNDING = 64


def _rows(batch: pa.RecordBatch, name: str, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, whole numbers) of its usable vectors, block by block."""
    column = batch.column(name)
    fits = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False) == width))
    for at in range(0, len(fits), max(1, BLOCK // width)):
        some = fits[at : at + max(1, BLOCK // width)]
        flat = column.take(pa.array(some)).flatten()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # null becomes NaN
        with np.errstate(invalid="ignore"):
            good = (np.isfinite(values) & (np.abs(values) <= LARGEST)).all(axis=1)
        if good.any():
            yield some[good], np.floor(SCALE * values[good]).astype(np.int64) + SHIFT


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - S / n, of whole parts first, so that nothing is lost of them."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])
    return (x - whole) - rest


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int]:
    """The sum over dimensions of (n * x - S)^2, exact."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    low = x - whole
    bound = n * (int(np.abs(low).max(initial=0)) + 1)
    if bound < 1 << 62 and x.shape[1] * bound * bound < 1 << 63:
        d = n * low - rest
        return (d * d).sum(axis=1).tolist()
    if bound < 1 << 62:  # squares in two words of 32 bits: d = 2^32 a + b
        d = np.abs(n * low - rest)
        a, b = (d >> 32).astype(np.uint64), (d & 0xFFFFFFFF).astype(np.uint64)
        terms = ((a * a, 64), (a * b, 33), (b * b, 0))
        out = [0] * len(d)
        for term, shift in terms:
            for part, by in ((term >> np.uint64(32), shift + 32), (term & np.uint64(0xFFFFFFFF), shift)):  # sums of words fit
                out = [o + (v << by) for o, v in zip(out, part.sum(axis=1, dtype=np.uint64).tolist())]
        return out
    return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]


def _merged(a: tuple | None, b: tuple | None) -> tuple | None:
    """Counts, means and centred products of two blocks together."""
    if a is None or b is None:
        return b if a is None else a
    (n, p, c), (m, q, d) = a, b
    apart = q - p
    return n + m, p + apart * (m / (n + m)), c + d + np.outer(apart, apart) * (n * m / (n + m))


class Fit:
    """What all rows share: n, S, eigenvalues, the projection, the trace and the measured error."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray):
        self.n, self.sums = n, sums
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:COMPONENTS]
        self.values, vectors = values[order], vectors[:, order]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        self.trace = float(np.trace(covariance))
        self.real = self.values > ROUNDING * len(covariance) * np.finfo(float).eps * max(float(values[-1]), 0.0)
        self.projection = vectors / np.sqrt(np.where(self.real, self.values, 1.0))
        self.error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.sums, self.n) @ self.projection


def _tree(rdd, zero, add, merge):
    """treeAggregate, so deep that FAN partial results meet in a node and about as many reach the driver."""
    parts = rdd.getNumPartitions()
    return zero if not parts else rdd.treeAggregate(zero, add, merge, max(2, math.ceil(math.log(max(parts, 2), FAN))))


def _partials(vectors: DataFrame, fn) -> object:
    """An RDD of one pickled partial result a partition, made from Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fn(batches)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["partial"])

    return vectors.mapInArrow(trimmed(run), "partial binary").rdd.map(lambda row: pickle.loads(row[0]))


def fit(vectors: DataFrame, column: str = "embedding") -> tuple[Fit, int] | None:
    """The fit over all usable vectors and their width; None without any."""
    entries = F.col(column)
    usable = entries.isNotNull() & ~F.exists(entries, lambda e: F.coalesce(F.isnan(e) | (F.abs(e) > LARGEST), F.lit(True)))
    most = vectors.filter(usable & (F.size(entries) > 0)).groupBy(F.size(entries).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if most is None:
        return None
    width = most["width"]

    def sums(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[int]] | None:
        n, total = 0, [0] * width
        for batch in batches:
            for _, x in _rows(batch, column, width):
                n += len(x)
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                total = [t + (h << 32) + w for t, h, w in zip(total, high, low)]
        return (n, total) if n else None

    def plus(a, b):
        return a if b is None else b if a is None else (a[0] + b[0], [s + t for s, t in zip(a[1], b[1])])

    n, total = _tree(_partials(vectors, sums), None, plus, plus)
    upper = np.triu_indices(width)

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        own = None
        for batch in batches:
            for _, x in _rows(batch, column, width):
                c = centred(x, total, n)
                own = c.T @ c if own is None else own + c.T @ c
        return None if own is None else own[upper]

    def added(a, b):
        return a if b is None else b if a is None else a + b

    triangle = _tree(_partials(vectors, products), None, added, added)
    covariance = np.zeros((width, width))
    covariance[upper] = triangle / n
    found = Fit(n, total, covariance + np.triu(covariance, 1).T)

    def measured(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        out = None
        for batch in batches:
            for _, x in _rows(batch, column, width):
                w = found.whitened(x)
                mean = w.mean(axis=0)
                out = _merged(out, (len(w), mean, (w - mean).T @ (w - mean)))
        return out

    count, _, spread = _tree(_partials(vectors, measured), None, _merged, _merged)
    real = found.real
    if real.any():
        found.error = float(np.abs((spread / count)[np.ix_(real, real)] - np.eye(int(real.sum()))).max())
    return found, width


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits for every usable vector and component."""
    spark = vectors.sparkSession
    ship(spark)
    kind = dict(vectors.dtypes)[column]
    entries = F.col(column) if kind in ("array<float>", "array<double>") else F.col(column).cast("array<double>")
    vectors = vectors.select(F.col(id_column).cast("long").alias("vec_id"), entries.alias("embedding"))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"]
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    got = fit(vectors)
    if got is None:
        return spark.createDataFrame([], schema)
    shared, width = spark.sparkContext.broadcast(got[0]), got[1]  # as large as COMPONENTS + 1 vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        k = len(f.values)
        explained = np.where(f.real, f.values, 0.0) / f.trace if f.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            ids = batch.column("vec_id")
            for at, x in _rows(batch, "embedding", width):
                m, w = len(x), np.where(f.real, f.whitened(x), np.nan)
                far = deviations(x, f.sums, f.n)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at[each])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, f.n, np.int64)),
                        pa.array([d if d < 1 << 63 else None for d in far], pa.int64()).take(pa.array(each)),
                        pa.array(w.reshape(-1), from_pandas=True),
                        pa.array(np.tile(explained, m), from_pandas=True),
                        pa.array([f.error] * (m * k), pa.float64()),
                        pa.array([str(d) for d in far]).take(pa.array(each)),
                    ],
                    names,
                )

    return vectors.mapInArrow(trimmed(run), schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
