"""Spectral bi-clustering of a wide matrix (a row for each read, a column for each site) by the log scheme.

Rows stay where they are. The driver sees what follows the number of columns (column means, the Gram matrix, singular
vectors over columns) and of clusters (centres), never rows. Each pass over the rows is one aggregate.

1. All cells are shifted so that the smallest is at least one; the interactions are their logarithms without row and
   column means. Their Gram matrix gives the right singular vectors, a row's products with these the left ones.
2. Of the first COMPONENTS pairs, the BEST vectors of each side are those nearest to a vector with as many levels as the side
   has clusters.
3. Rows are projected on the best right vectors and clustered, columns on the best left ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import stored

COMPONENTS, BEST, ROUNDS = 6, 3, 50
#: Columns that a Gram matrix is made of at most: its square comes to the driver.
COLUMNS = 2000


def _points(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), dtype=float).reshape(batch.num_rows, -1)


def _mapped(rows: DataFrame, function) -> DataFrame:
    """(key, x) with x, an array, mapped by a function of the rows of a batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(function(_points(b, 1))), pa.list_(pa.float64()))], ["key", "x"])

    return rows.select("key", "x").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, x array<double>")


def _summed(rows: DataFrame, function, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of what a function returns for a batch's rows: partial sums a task, added in the engine; as many
    numbers come to the driver as the shape has."""

    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += function(_points(b, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    out = np.zeros(int(np.prod(shape)))
    for r in rows.select("key", "x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i] = r.v
    return out.reshape(shape)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def _far(rows: DataFrame, parts: list[list[int]], centres: list[np.ndarray]) -> list[np.ndarray]:
    """For each part (some of the coordinates) the point farthest from its centres; of equals the largest."""

    def run(batches):
        best: dict[int, tuple] = {}
        for b in batches:
            if not b.num_rows:
                continue
            points = _points(b, 1)
            for k, (part, c) in enumerate(zip(parts, centres)):
                x = points[:, part]
                d = _nearest(x, c)[1] if len(c) else -x[:, 0]  # the first centre is where the first coordinate is least
                i = np.lexsort((*x.T[::-1], d))[-1]
                best[k] = max(best.get(k, (-np.inf,)), (float(d[i]), x[i].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([v[0] for v in best.values()], pa.float64()), pa.array([v[1] for v in best.values()], pa.list_(pa.float64()))], ["k", "d", "x"])

    far = rows.select("key", "x").mapInArrow(run, "k int, d double, x array<double>").groupBy("k").agg(F.max(F.struct("d", "x")).alias("m"))
    return [np.array(m) for _, m in sorted((r.k, r.m.x) for r in far.collect())]  # a row for each part


def centres_of(rows: DataFrame, parts: list[list[int]], k: int) -> list[np.ndarray]:
    """Centres of k clusters of the rows' points (key, x) for each part of the coordinates: from farthest points, by
    means, each round one aggregate for all parts."""
    centres = [np.zeros((0, len(p))) for p in parts]
    for _ in range(k):
        new = _far(rows, parts, centres)
        if not new:
            return centres
        centres = [np.vstack([c, x]) for c, x in zip(centres, new)]
    width = max(map(len, parts))
    for _ in range(ROUNDS):

        def sums(points, centres=centres):
            out = np.zeros((len(parts), k, width + 1))
            for i, (part, c) in enumerate(zip(parts, centres)):
                x = points[:, part]
                to = _nearest(x, c)[0]
                np.add.at(out[i, :, : len(part)], to, x)
                out[i, :, width] += np.bincount(to, minlength=k)
            return out

        got = _summed(rows, sums, (len(parts), k, width + 1))
        moved = [np.where(g[:, width:] > 0, g[:, : len(p)] / np.maximum(g[:, width:], 1), c) for g, p, c in zip(got, parts, centres)]
        same = all(np.allclose(a, b, atol=1e-9) for a, b in zip(moved, centres))
        centres = moved
        if same:
            break
    return centres


def _local_centres(x: np.ndarray, k: int) -> np.ndarray:
    """The same for points that the driver has: one for each column."""
    c = x[[np.lexsort((*x.T[::-1], x[:, 0]))[0]]]
    while len(c) < k:
        c = np.vstack([c, x[_nearest(x, c)[1].argmax()]])
    for _ in range(ROUNDS):
        to = _nearest(x, c)[0]
        new = np.array([x[to == i].mean(axis=0) if (to == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c, atol=1e-9):
            break
        c = new
    return c


def bicluster(matrix: DataFrame, key: str, columns: list[str], rows: int = 6, cols: int = 3) -> tuple[DataFrame, dict[str, int]]:
    """((key, label) for every row, label of every column) of a numeric matrix without nulls. Labels are ordered by their
    centres, so they don't depend on how rows are dealt. A matrix of constant cells has one cluster of each."""
    if len(columns) > COLUMNS:
        raise ValueError(f"more than {COLUMNS} columns")
    data = stored(matrix.select(F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")), "matrix")
    first = data.agg(F.count("*").alias("n"), F.min(F.array_min("x")).alias("low")).first()
    if not first.n:
        return data.select(F.col("key").alias(key), F.lit(0).alias("label")), dict.fromkeys(columns, 0)
    shift, m = max(0.0, 1.0 - first.low), len(columns)
    means = _summed(data, lambda x: np.log(x + shift).sum(axis=0), (m,)) / first.n

    def interactions(x):
        logs = np.log(x + shift)
        return logs - logs.mean(axis=1, keepdims=True) - means + means.mean()

    gram = _summed(data, lambda x: interactions(x).T @ interactions(x), (m, m))
    value, vector = np.linalg.eigh(gram)
    top = np.argsort(-value, kind="stable")[: min(COMPONENTS, m)]
    top = top[value[top] > 1e-9 * max(1.0, value.max())]
    if not len(top):
        return data.select(F.col("key").alias(key), F.lit(0).alias("label")), dict.fromkeys(columns, 0)
    right = vector[:, top] * np.where(np.abs(vector[:, top]).max(axis=0) == vector[:, top].max(axis=0), 1.0, -1.0)
    scale = np.sqrt(value[top])

    def rest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return _nearest(x, c)[1]

    # the vectors nearest to one with as many levels as there are clusters
    left = stored(_mapped(data, lambda x: interactions(x) @ right / scale), "left")
    parts = [[i] for i in range(len(top))]
    levels = centres_of(left, parts, rows)
    off = _summed(left, lambda u: np.array([rest(u[:, p], c).sum() for p, c in zip(parts, levels)]), (len(top),))
    best_left = np.sort(np.argsort(off, kind="stable")[:BEST])
    off = [rest(right[:, [i]], _local_centres(right[:, [i]], min(cols, m))).sum() for i in range(len(top))]
    best_right = right[:, np.sort(np.argsort(off, kind="stable")[:BEST])]

    projected = stored(_mapped(data, lambda x: x @ best_right), "projected")
    centres = centres_of(projected, [list(range(best_right.shape[1]))], rows)[0]
    centres = centres[np.lexsort(centres.T[::-1])]
    labels = _mapped(projected, lambda x: _nearest(x, centres)[0][:, None].astype(float)).select(F.col("key").alias(key), F.get("x", F.lit(0)).cast("int").alias("label"))
    side = _summed(data, lambda x: x.T @ (interactions(x) @ right / scale)[:, best_left], (m, len(best_left)))
    c = _local_centres(side, min(cols, m))
    c = c[np.lexsort(c.T[::-1])]
    return labels, dict(zip(columns, _nearest(side, c)[0].tolist()))
