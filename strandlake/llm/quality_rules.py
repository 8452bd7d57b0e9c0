"""Quality rules: base rules on counts, and gradient-boosted trees over document statistics as the verdict on the rest.

The counts of a text: its words (runs without ASCII white space), the code points in them, symbol characters, lines that
repeat an earlier line of the text, and words inside windows of WINDOW words that occur twice or more in it. Windows are
compared by their words, words by their bytes, all texts of a batch at once. A text with fewer than FEWEST words, or
with more than REPEATED percent of its words in repeated windows, fails the base rules.

The trees learn ``labels.quality`` by logistic loss from histograms of quantile bins. Along the statistics in FALLING
(symbols, repeated lines, repeated words) scores may only fall: a split that breaks this isn't made, and the bound between
two children's values is handed down to their leaves. All trees are flattened into arrays of nodes (statistic, cut, left,
right, value), through which all texts of a batch walk together. Labels are learnt from rows whose crc32(doc_id as text) mod 4
isn't 2, and of those from the SAMPLE rows with the smallest hash of their doc_id (all, where there are fewer): the driver
fits on SAMPLE rows of statistics at most. Every document is scored, in one pass without a shuffle; labels, doc_id and other
columns are no inputs of a score.

Null text has no words and fails the base rules, as empty and blank texts do. Long texts are judged whole. Labels that are
null are left out; a doc_id with two labels is two training rows, one with several texts is learnt from the text with the
smallest statistics. Without any label the base rules decide alone. Ties have one score; rows that repeat get equal rows;
an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, distinct, eight, flat, pieces, text_column, words
from .quality import N_STATS, SAMPLE, held_out, per_text, statistics, variety

FEWEST, WINDOW, REPEATED = 20, 8, 30
#: A text stays if its score, the probability of label 1, is at least this.
CUT = 0.5
TREES, DEPTH, RATE, BINS, SHRINK, LEAST = 60, 3, 0.2, 32, 1.0, 5.0

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True

#: The statistics after the N_STATS ones of the quality scores, and those along which scores may only fall.
RATES = ["word_chars", "symbols", "dup_lines", "repeat_words"]
FALLING = [N_STATS + RATES.index(c) for c in ("symbols", "dup_lines", "repeat_words")]


def repeated_words(word: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text: how many of its words lie in windows that it has twice or more. The window is a power of two."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), np.maximum(n - window + 1, 0))
    if not len(owner):
        return np.zeros(len(n), dtype=np.int64)
    rank, k = word.astype(np.int64), 1
    while k < window:  # numbers of runs of k words become numbers of runs of 2 k words
        rank = np.unique(rank[:-k] * (int(rank.max()) + 1) + rank[k:], return_inverse=True)[1]
        k *= 2
    place = np.arange(len(owner)) + np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(np.maximum(n - window + 1, 0))[:-1]]), np.maximum(n - window + 1, 0))
    _, back, count = np.unique(owner * (int(rank.max()) + 1) + rank[place], return_inverse=True, return_counts=True)
    twice = place[count[back] > 1]
    cover = np.zeros(len(word) + 1, dtype=np.int64)
    cover[twice] += 1  # a place occurs once
    cover[twice + window] -= 1
    return per_text(np.cumsum(cover[:-1]) > 0, at).astype(np.int64)


def rule_counts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and its lines with a word."""
    buf, offs = flat(col)
    load = eight(buf)
    starts, ends, at = words(buf, offs, SPACE)
    solid = ~SPACE[buf]
    ls, le, lat = words(buf, offs, _NEWLINE)
    sums = np.concatenate([[0], np.cumsum(solid)])
    said = sums[le] > sums[ls]
    lat = np.concatenate([[0], np.cumsum(said)])[lat]
    lines = np.diff(lat)
    different, _ = variety(distinct(load, ls[said], le[said])[2], lat)
    repeats = repeated_words(distinct(load, starts, ends)[2], at)
    return np.column_stack([np.diff(at), per_text(solid & ((buf & 0xC0) != 0x80), offs), per_text(_SYMBOL[buf], offs), lines - different, repeats]).astype(np.int64), lines


def all_statistics(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The statistics that trees see, and the counts of the base rules."""
    counts, lines = rule_counts(col)
    n = np.maximum(counts[:, 0], 1)
    rates = np.column_stack([counts[:, 1] / n, counts[:, 2] / n, counts[:, 3] / np.maximum(lines, 1), counts[:, 4] / n])
    return np.column_stack([statistics(col), rates]), counts


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < FEWEST) | (100 * counts[:, 4] > REPEATED * counts[:, 0])


# ---------------------------------------------------------------- the trees
class Trees:
    """Boosted trees as arrays of nodes: a text at node k goes left if its statistic is at most the cut. Leaves lead to
    themselves, so all texts take DEPTH steps through all trees together."""

    def __init__(self, start: float, roots, feature, cut, left, right, value, depth: int):
        self.start, self.depth = start, depth
        self.roots, self.feature, self.left, self.right = (np.array(x, dtype=np.int64) for x in (roots, feature, left, right))
        self.cut, self.value = np.array(cut, dtype=float), np.array(value, dtype=float)

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def best_splits(g: np.ndarray, h: np.ndarray, low: np.ndarray, high: np.ndarray, falling: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each node, from histograms of gradients and curvatures by (node, statistic, bin): the gain, statistic and last
    bin on the left of its best split, and the values of both sides, kept between the node's bounds."""
    gl, hl = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
    gt, ht = g.sum(axis=2)[:, :1, None], h.sum(axis=2)[:, :1, None]
    lo, hi = low[:, None, None], high[:, None, None]

    def fitted(gs, hs):
        v = np.clip(-gs / (hs + SHRINK), lo, hi)
        return v, -(gs * v + 0.5 * (hs + SHRINK) * v * v)

    left, by_left = fitted(gl, hl)
    right, by_right = fitted(gt - gl, ht - hl)
    gain = by_left + by_right - fitted(gt, ht)[1]
    gain[(hl < LEAST) | (ht - hl < LEAST) | ((left < right) & falling[None, :, None])] = -1
    best = gain.reshape(len(gain), -1).argmax(axis=1)
    f, b = np.divmod(best, gain.shape[2])
    k = np.arange(len(gain))
    return gain[k, f, b], f, b, left[k, f, b], right[k, f, b]


def fit_trees(x: np.ndarray, y: np.ndarray, falling: list[int], trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for the probability of label 1."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])  # bin b: at most cut b
    place = bins + np.arange(width) * BINS
    falls = np.isin(np.arange(width), falling)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    roots, feature, cut, left, right, value = [], [], [], [], [], []

    def node(v: float) -> int:
        k = len(value)
        feature.append(0), cut.append(np.inf), left.append(k), right.append(k), value.append(v)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.full(n, node(0.0))
        roots.append(len(value) - 1)
        open_, low, high = np.array([roots[-1]]), np.array([-np.inf]), np.array([np.inf])
        for _ in range(depth):
            slot = np.full(len(value), -1)
            slot[open_] = np.arange(len(open_))
            rows = np.flatnonzero(slot[at] >= 0)
            key = (slot[at[rows]][:, None] * (width * BINS) + place[rows]).ravel()
            shape = (len(open_), width, BINS)
            sums = [np.bincount(key, np.repeat(v[rows], width), len(open_) * width * BINS).reshape(shape) for v in (g, h)]
            gain, f, b, lv, rv = best_splits(*sums, low, high, falls)
            grown = []
            for k in np.flatnonzero(gain > 1e-6).tolist():
                top, column = int(open_[k]), int(f[k])
                if b[k] >= len(cuts[column]):  # beyond the last cut nothing is on the right
                    continue
                feature[top], cut[top] = column, float(cuts[column][b[k]])
                left[top], right[top] = node(RATE * lv[k]), node(RATE * rv[k])
                here = rows[at[rows] == top]
                at[here] = np.where(bins[here, column] <= b[k], left[top], right[top])
                middle = (lv[k] + rv[k]) / 2
                a = (max(low[k], middle), high[k]) if falls[column] else (low[k], high[k])
                z = (low[k], min(high[k], middle)) if falls[column] else (low[k], high[k])
                grown += [(left[top], *a), (right[top], *z)]
            if not grown:
                break
            open_, low, high = (np.array(v) for v in zip(*grown))
        margin += np.array(value)[at]
    return Trees(start, roots, feature, cut, left, right, value, depth)


# ---------------------------------------------------------------- over documents
def fit(docs: DataFrame, labels: DataFrame) -> Trees | None:
    """Trees learnt from at most SAMPLE labelled rows that aren't held out."""
    chosen = labels.filter(~held_out()).filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(SAMPLE)  # small enough to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "doc_id", "_y")

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(all_statistics(b.column(0))[0]), pa.list_(pa.float64())), b.column(1), b.column(2)], ["stats", "doc_id", "y"])

    got = rows.mapInArrow(run, "stats array<double>, doc_id long, y int").groupBy("doc_id", "y").agg(F.min("stats").alias("stats")).orderBy("doc_id", "y").toArrow()
    if not got.num_rows:
        return None
    x = np.asarray(got.column("stats").combine_chunks().flatten()).reshape(got.num_rows, -1)
    return fit_trees(x, np.asarray(got.column("y")).astype(float), FALLING)


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts, whether the base rules fail, the score, and whether the text stays, for every row of docs (doc_id, text, ...)."""
    model = fit(docs, labels)

    def run(batches):
        for b in pieces(batches):
            x, counts = all_statistics(b.column(1))
            score = model.score(x) if model else np.ones(len(x))
            failed = base_failed(counts)
            columns = [b.column(0), *(pa.array(c) for c in counts.T.copy()), pa.array(failed), pa.array(~failed & (score >= CUT)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, _OUT)
