"""Whitening of embeddings by hierarchical SVD merging.

A summary of rows is their number, exact sums and all singular values with their vectors, as a factor R with as many rows as
there are dimensions: R'R is the scatter of the centred rows. Two summaries merge by stacking their factors and one row,
the difference of the means times sqrt(n1 n2 / (n1 + n2)), and taking the SVD anew. As every dimension is kept, nothing is
lost, however often summaries are merged. Tasks summarise their rows, and summaries merge by FAN until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Summaries that one task merges, and numbers of a block of rows that is summarised or projected at once.
FAN, BLOCK = 16, 1 << 20
#: Entries of this size or more are taken for broken, as SCALE times one would not fit a long.
LARGEST = float(1 << 46)

Summary = tuple[int, list[int], np.ndarray]


def summary(x: np.ndarray) -> Summary:
    """Of rows of whole numbers: how many, their sums, and the factor of their centred scatter."""
    pivot = x[0]
    part = (x - pivot).astype(np.float64)
    _, s, v = np.linalg.svd(part - part.mean(axis=0), full_matrices=False)
    sums = [int(a) + len(x) * int(b) for a, b in zip((x - pivot).sum(axis=0), pivot)]
    return len(x), sums, s[:, None] * v


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of the rows of both."""
    n, m = a[0], b[0]
    apart = np.array([(x * m - y * n) / (n * m) for x, y in zip(a[1], b[1])])  # whole numbers up to the division
    stacked = np.vstack([a[2], b[2], apart * np.sqrt(n * m / (n + m))])
    _, s, v = np.linalg.svd(stacked, full_matrices=False)
    return n + m, [x + y for x, y in zip(a[1], b[1])], s[:, None] * v


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


_SHAPE = "n long, sums array<string>, factor array<double>"


def _told(found: Summary | None) -> Iterator[pa.RecordBatch]:
    if found:
        n, sums, factor = found
        columns = [pa.array([n], pa.int64()), pa.array([[str(x) for x in sums]]), pa.array([factor.ravel()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["n", "sums", "factor"])


def _read(batch: pa.RecordBatch, k: int) -> Summary:
    sums = [int(x) for x in batch.column("sums")[k].as_py()]
    factor = batch.column("factor")[k].values.to_numpy(zero_copy_only=False)
    return batch.column("n")[k].as_py(), sums, factor.reshape(-1, len(sums))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about BLOCK numbers."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, BLOCK // max(1, len(batch.column("x")[0])))
            for k in range(0, batch.num_rows, step):
                yield batch.slice(k, step)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = None
    for part in _parts(batches):
        own = summary(_matrix(part.column("x")))
        found = merge(found, own) if found else own
    yield from _told(found)


def _merge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = None
    for batch in batches:
        for k in range(batch.num_rows):
            own = _read(batch, k)
            found = merge(found, own) if found else own
    yield from _told(found)


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Per usable row its id and x, the entries as whole numbers: floor(64 * entry) + 1000000."""
    entries = F.col(vector_col).cast("array<double>")
    sound = entries.isNotNull() & (F.size(entries) > 0)
    sound = sound & F.forall(entries, lambda c: F.coalesce((F.abs(c) < LARGEST) & ~F.isnan(c), F.lit(False)))
    whole = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return rows.where(sound).select(F.col(id_col).alias("id"), whole.alias("x"))


class Whitener:
    """Of n distinct vectors with sums S: components (a row each), their eigenvalues, and the trace of the covariance."""

    def __init__(self, found: Summary, components: int):
        self.n, self.sums, factor = found
        missing = max(0, factor.shape[1] - len(factor))  # of few rows, so that every component has a vector
        _, s, v = np.linalg.svd(np.vstack([factor, np.zeros((missing, factor.shape[1]))]), full_matrices=False)
        self.trace = float((s * s).sum()) / self.n
        s, v = s[:components], v[:components]
        tiny = s <= s.max(initial=0) * np.finfo(float).eps * len(self.sums)
        self.values = np.where(tiny, 0.0, s * s / self.n)
        self.vectors = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs while they fit, else as Python's whole numbers."""
        largest = max(int(np.abs(x).max(initial=0)) * self.n, *[abs(y) for y in self.sums])
        kind = np.int64 if largest < 1 << 61 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Projections over the deviation along each component; NaN where there is none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return (centred / self.n).astype(np.float64) @ self.vectors.T * scaled


def deviations(centred: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None if it does not fit a long."""
    if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    found = (sum(int(y) ** 2 for y in row) for row in centred)
    return [x if x < 1 << 63 else None for x in found]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of the rows' column x, None without rows. One summary of dimensions squared numbers comes to the driver."""
    found = cut(vectors.mapInArrow(_summarise, _SHAPE))
    count = found.count()
    while count > 1:
        count = -(-count // FAN)
        found = cut(found.repartition(count).mapInArrow(_merge_all, _SHAPE))
    rows = found.collect()
    if not rows:
        return None
    sums = [int(x) for x in rows[0].sums]
    return Whitener((rows[0].n, sums, np.array(rows[0].factor).reshape(-1, len(sums))), components)


def _moments(batches: Iterator[pa.RecordBatch], model: Whitener) -> Iterator[pa.RecordBatch]:
    """Sums and sums of products of whitened rows, a row a pair; sums stand at j = -1."""
    size = len(model.values)
    total, products = np.zeros(size), np.zeros((size, size))
    for part in _parts(batches):
        found = model.whitened(model.centred(_matrix(part.column("x"))))
        total, products = total + found.sum(axis=0), products + found.T @ found
    i, j = np.triu_indices(size)
    values = np.concatenate([products[i, j], total])
    i, j = np.concatenate([i, np.arange(size)]), np.concatenate([j, np.full(size, -1)])
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(values)], ["i", "j", "value"])


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """Largest entry of the covariance of the whitened rows less the identity, over the components that vary."""
    found = vectors.mapInArrow(lambda x: _moments(x, model), "i long, j long, value double")
    found = {(r.i, r.j): r.value / model.n for r in found.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    varies = [k for k in range(len(model.values)) if model.values[k] > 0]
    apart = (abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in varies for j in varies if i <= j)
    return float(max(apart, default=0.0))


def _project(batches: Iterator[pa.RecordBatch], model: Whitener, error: float) -> Iterator[pa.RecordBatch]:
    size = len(model.values)
    share = model.values / model.trace if model.trace else np.zeros(size)
    for part in _parts(batches):
        n = part.num_rows
        centred = model.centred(_matrix(part.column("x")))
        away = deviations(centred)
        each = np.repeat(np.arange(n), size)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), n)),
                pa.array(np.full(n * size, model.n)),
                pa.array(away, pa.int64()).take(pa.array(each)),
                pa.array(model.whitened(centred).ravel(), from_pandas=True),
                pa.array(np.tile(share, n)),
                pa.array(np.full(n * size, error)),
            ],
            ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def _commonest(size: Column, rows: DataFrame) -> int:
    found = rows.groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").first()
    return found["size"] if found else 0


def whitened_embeddings(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Per usable row and component: the id, component, n, deviation, whitened, explained, identity_error.

    A row is unusable, and goes, if its vector is null or empty, holds a null, non-finite or huge (LARGEST) entry, or is not
    as long as most vectors are (of equally common lengths the shortest counts). Entries become whole numbers x; the fit
    list is each distinct x once: n vectors with sums S. Components are the unit eigenvectors of its covariance by falling
    eigenvalue, each with its largest entry positive; whitened is x - S / n on a component, over the root of its eigenvalue,
    and null where nothing varies along it. deviation is the sum of (n x - S)^2, exact, and null where no long holds it.
    explained is the eigenvalue's share of all. identity_error is measured on the whitened fit list.

    Repeated rows and ids get results of their own, a null id stays null, other columns are ignored. No usable rows give no
    rows. Copies of a vector are reduced to one before any shuffle, so a vector that many rows share makes no task large.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = whole_vectors(rows, id_col, vector_col)
    usable = usable.where(F.size("x") == _commonest(F.size("x"), usable))
    vectors = cut(usable.select("x").distinct())
    model = fit(vectors, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], shape).withColumnRenamed("id", id_col)
    error = identity_error(vectors, model)
    return usable.mapInArrow(lambda x: _project(x, model, error), shape).withColumnRenamed("id", id_col)

