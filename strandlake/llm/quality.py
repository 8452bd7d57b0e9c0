"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

A document becomes N_STATS statistics of its bytes, words and lines. Cosines of random projections of the standardised
statistics approximate a Gaussian kernel; the ridge weights solve the normal equations, which the partitions sum; an
isotonic fit (pool adjacent violators) of out-of-fold scores turns scores into probabilities of label 1.

Labels are learnt from rows whose crc32(doc_id as text) mod 4 is not 2, and of those from the SAMPLE rows with the
smallest hash of their doc_id, all of them where there are fewer; every document is scored. Statistics only ever see
the text. Null text is empty; an empty text has a score like any other. Labels that are null are left out; a doc_id
with two labels is two training rows; one with several texts is learnt from the text with the smallest statistics.
Without any label each score is 1. Long texts are scored whole; ties have one score. Rows that repeat get the same score;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, SPACE, distinct, eight, flat, pieces, words

SAMPLE = 20_000
FEATURES = 256
GAMMA = 0.35
RIDGE = 1e-2
CUT = 0.7
SEED = 20

_KIND = np.zeros(256, dtype=np.int64)  # 0 controls and the rest
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = 5, 6
_KIND[[44, 46]], _KIND[[33, 63]], _KIND[124] = 7, 8, 9
_KIND[[35, 36, 37, 38, 42, 64, 94, 126, 60, 62, 61, 43, 95, 92]] = 10
_KIND[[34, 39, 40, 41, 45, 47, 58, 59, 91, 93, 96, 123, 125]] = 11
_KINDS = 12
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
N_STATS = 28


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values between the bounds."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return c[at[1:]] - c[at[:-1]]


def variety(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many different words (numbers) it has, and how often its most frequent one occurs."""
    n = len(at) - 1
    if not len(word):
        return np.zeros(n), np.zeros(n)
    width = int(word.max()) + 1
    key = np.sort(np.repeat(np.arange(n, dtype=np.int64), np.diff(at)) * width + word)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    of = key[first] // width
    runs = np.diff(np.append(first, len(key)))
    most = np.zeros(n)
    np.maximum.at(most, of, runs)
    return np.bincount(of, minlength=n).astype(float), most


def statistics(col: pa.Array) -> np.ndarray:
    """One row of N_STATS for each text."""
    buf, offs = flat(col)
    n, size = len(offs) - 1, np.diff(offs).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offs))
    kinds = np.bincount(owner * _KINDS + _KIND[buf], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    share = kinds / np.maximum(size, 1)[:, None]
    starts, ends, at = words(buf, offs, SPACE)
    count = np.diff(at).astype(float)
    per = np.maximum(count, 1)
    length = (ends - starts).astype(float)
    load = eight(buf)
    word = distinct(load, starts, ends)[2]
    kinds_of, most = variety(word, at)
    if len(starts):
        head, tail = _KIND[buf[starts]], _KIND[buf[ends - 1]]
        before = _KIND[buf[np.maximum(ends - 2, starts)]]
        upper = per_text(np.isin(before, (2,)) & (length > 1), at) / per
        symbol = per_text(np.isin(tail, (10,)), at) / per
        shout = per_text(tail == 8, at) / per
        capital = per_text(head == 2, at) / per
        stop = per_text(tail == 7, at) / per
        bare = per_text(NOT_ALNUM[buf[starts]] & (head != 2) & (length < 3), at) / per
        same = np.zeros(len(word))
        same[1:] = word[1:] == word[:-1]
        twice = per_text(same, at) / per
    else:
        upper = symbol = shout = capital = stop = bare = twice = np.zeros(n)
    mean = per_text(length, at) / per
    spread = np.sqrt(np.maximum(per_text(length * length, at) / per - mean * mean, 0))
    ls, le, lat = words(buf, offs, _NEWLINE)
    lines = np.diff(lat).astype(float)
    lkinds, _ = variety(distinct(load, ls, le)[2], lat)
    return np.column_stack(
        [np.log1p(size), np.log1p(count), mean, spread, *[share[:, k] for k in range(1, _KINDS)], upper, symbol, shout, capital, stop, bare, twice]
        + [kinds_of / per, np.log1p(kinds_of), most / per, np.log1p(lines), lkinds / np.maximum(lines, 1), np.log1p(size / np.maximum(lines, 1))]
    )


def pool(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: increasing scores and their fitted values."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, weight, sum of scores
    for s, y in zip(scores[order], labels[order]):
        blocks.append([float(y), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y1, w1, s1 = blocks.pop()
            blocks[-1][0] += y1
            blocks[-1][1] += w1
            blocks[-1][2] += s1
    return np.array([s / w for _, w, s in blocks]), np.array([y / w for y, w, _ in blocks])


class Model:
    """Scores arrays of texts; small, so it travels with the task."""

    def __init__(self, mean, scale, project, phase, weights, xs, ys):
        self.mean, self.scale, self.project, self.phase, self.weights, self.xs, self.ys = mean, scale, project, phase, weights, xs, ys

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.project + self.phase) * np.sqrt(2 / FEATURES), np.ones(len(z))])

    def score(self, col: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(col))
        return np.interp(self.features(statistics(col)) @ self.weights, self.xs, self.ys)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    chosen = labels.filter(~held_out()).filter("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(SAMPLE)  # at most SAMPLE rows: small enough to broadcast
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", F.col("doc_id").cast("long").alias("doc_id"), F.col("_y"))

    def stats(batches):
        for b in pieces(batches):
            s = statistics(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(s), pa.list_(pa.float64())), b.column(1), b.column(2)], ["stats", "doc_id", "y"])

    # statistics of at most SAMPLE rows (28 doubles each): a few MB
    got = rows.mapInArrow(stats, "stats array<double>, doc_id long, y int")
    got = got.groupBy("doc_id", "y").agg(F.min("stats").alias("stats")).select("stats", "doc_id", "y").cache()
    moments = got.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    if not moments:
        got.unpersist()
        return Model(None, None, None, None, None, None, None)
    mean, scale = np.array([r.m for r in moments]), np.array([max(r.s, 1e-6) for r in moments])
    rng = np.random.default_rng(SEED)
    project = rng.normal(size=(N_STATS, FEATURES)) * np.sqrt(2 * GAMMA / N_STATS * 2)
    model = Model(mean, scale, project, rng.uniform(0, 2 * np.pi, FEATURES), None, None, None)
    width = FEATURES + 1

    def sums(batches):
        total = np.zeros((2, width, width + 1))
        for b in batches:
            x = model.features(np.array(b.column(0).to_pylist()).reshape(-1, N_STATS))
            y = np.asarray(b.column(2), dtype=float)
            half = np.asarray(b.column(1)) // 4 % 2
            for k in (0, 1):
                xk = x[half == k]
                total[k] += xk.T @ np.column_stack([xk, y[half == k]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = sum(np.frombuffer(r.sums).reshape(2, width, width + 1) for r in got.mapInArrow(sums, "sums binary").toLocalIterator())

    def solve(t):
        return np.linalg.solve(t[:, :width] + RIDGE * np.eye(width), t[:, width])

    fold = [solve(total[1]), solve(total[0])]  # each half is scored by the other's weights
    held = got.toPandas()
    got.unpersist()
    x, half = model.features(np.array(held["stats"].tolist()).reshape(-1, N_STATS)), held["doc_id"].to_numpy() // 4 % 2
    out_of_fold = np.where(half == 0, x @ fold[0], x @ fold[1])
    model.xs, model.ys = pool(out_of_fold, held["y"].to_numpy())
    model.weights = solve(total[0] + total[1])
    return model


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text, ...)."""
    model = fit(docs, labels)

    def run(batches):
        for b in pieces(batches):
            s = np.clip(model.score(b.column(2)), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, whose score is at least CUT; one pass, no join."""
    model = fit(docs, labels)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        for b in pieces(batches):
            yield b.filter(pa.array(model.score(b.column(at).cast(pa.string())) >= CUT))

    return docs.mapInArrow(run, schema)
