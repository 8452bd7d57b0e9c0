"""Benchmark decontamination with an FM-index of every training shard.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. A test item's windows are its runs of
WINDOW words; an item of fewer words is one window. A shard (a slice of a partition's documents) becomes a sequence of
word numbers; words that no window has are one separator symbol, and runs too short for any window are left out, which
loses no occurrence. Its suffix array (prefix doubling) gives the Burrows-Wheeler transform; a wavelet matrix of that
answers rank queries. All windows search backward together; the rows that remain are located by walking to the next
sampled suffix position. Occurrences are merged into spans of words per document.

The test set is broadcast in parts of about PART bytes of text (a broadcast is a few times that), one after the other, each a
pass over the same rows without a shuffle; passes but the last are written. So its size needs no bound. Null and empty
texts have no words and no hits; long texts are slices of their own. Items without id or words are left out; rows of one
item id are one item. Ties don't arise: each item that occurs counts. An empty table on either side is allowed. Rows
that repeat have the same result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_ALNUM, Words, Workspace, distinct, eight, flat, pieces, ranges, text_column, word_hashes, words

WINDOW = 13
SHARD = 1_000_000
SAMPLED = 16
PART = 8 << 20


class Windows:
    """The windows of items, by length: a sorted array of the different rows of word numbers (1, 2, ...), and the pairs
    of row and item, sorted by row. Words are looked up by hash and bytes."""

    def __init__(self, items: pa.Array, text: pa.Array, window: int = WINDOW):
        buf, offs = flat(text)
        buf = LOWER[buf]
        starts, ends, at = words(buf, offs, NOT_ALNUM)
        load = eight(buf)
        u, first, back = distinct(load, starts, ends)
        self.words = Words()
        raw = buf.tobytes()
        self.words.place(u, [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())])
        number = np.append(back.astype(np.int32) + 1, np.int32(0))
        ids = np.asarray(items).astype(np.int64)
        size = np.diff(at)
        self.by_length = {}
        for n in np.unique(np.minimum(size, window)).tolist():
            if not n:
                continue
            some = np.flatnonzero(size == n if n < window else size >= n)
            place, bounds = ranges(at[some], size[some] - n + 1)
            owner = np.repeat(ids[some], np.diff(bounds))
            # windows as numbers, one word after the other; the rows are only made for the different ones
            key = number[place].astype(np.int64)
            for k in range(1, n):
                key = np.unique(key * (len(u) + 1) + number[place + k], return_inverse=True)[1]
            _, one, row = np.unique(key, return_index=True, return_inverse=True)
            rows = number[place[one][:, None] + np.arange(n)[None, :]]
            by = np.lexsort((owner, row))
            row, owner = row[by], owner[by]
            fresh = np.ones(len(row), dtype=bool)
            fresh[1:] = (row[1:] != row[:-1]) | (owner[1:] != owner[:-1])
            row, owner = row[fresh], owner[fresh]
            self.by_length[n] = rows, np.searchsorted(row, np.arange(len(rows) + 1)).astype(np.int64), owner
        self.shortest = min(self.by_length, default=window)


class WaveletMatrix:
    """rank(c, i): how often c occurs before i, for arrays of both."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            count = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(ones, out=count[1:])
            self.levels.append((bit, count, len(symbols) - int(count[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i
        for bit, count, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            lo1, hi1 = count[lo], count[hi]
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo


class FMIndex:
    """Over symbols 1.. with separators 0, of which each is smaller than all symbols and equals no other."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        sep = text == 0
        nsep = int(sep.sum())
        rank = text.astype(np.int64) + nsep
        rank[sep] = np.arange(nsep)
        k = 1
        while True:
            second = np.zeros(n, dtype=np.int64)
            second[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (n + nsep + int(text.max(initial=0)) + 2) + second
            order = np.argsort(key, kind="stable")
            same = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = same
            if not n or same[-1] == n - 1:
                break
            k *= 2
        self.bwt = text[order - 1]
        self.wave = WaveletMatrix(self.bwt, int(text.max(initial=0)))
        counts = np.bincount(text, minlength=int(text.max(initial=0)) + 2)
        self.below = np.cumsum(counts) - counts
        # sampled positions: every SAMPLED-th, and what follows a separator, so that no walk crosses one
        before = np.concatenate([[True], sep[:-1]])
        kept = (np.arange(n) % SAMPLED == 0) | before
        self.sampled = np.where(kept[order], order, -1)

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.below[c] + self.wave.rank(c, i)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of equally long patterns: their numbers, and positions."""
        n = len(self.bwt)
        live = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            known = c < len(self.below) - 1
            live, lo, hi, c = live[known], lo[known], hi[known], c[known]
            lo, hi = self.step(c, lo), self.step(c, hi)
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
        size = hi - lo
        which = np.repeat(live, size)
        row = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        steps, at = np.zeros(len(row), np.int64), self.sampled[row]
        while (open_ := np.flatnonzero(at < 0)).size:
            r = row[open_]
            row[open_] = self.step(self.bwt[r], r)
            steps[open_] += 1
            at[open_] = self.sampled[row[open_]]
        return which, at + steps


def hits(col: pa.Array, w: Windows) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]]]:
    """For each text: its number of words, merged spans of words that are hit, and the items whose windows occur."""
    buf, offs = flat(col)
    buf = LOWER[buf]
    starts, ends, at = words(buf, offs, NOT_ALNUM)
    n = len(offs) - 1
    spans: list = [[] for _ in range(n)]
    items: list = [set() for _ in range(n)]
    counts = np.diff(at)
    if not len(starts) or not w.by_length:
        return counts, spans, items
    load = eight(buf)
    near = w.words.find(load, starts, ends, word_hashes(load, starts, ends))
    known = near >= 0
    # runs of known words inside a text, long enough for the shortest window
    head = np.zeros(len(starts) + 1, dtype=bool)
    head[at] = True
    opens = known & (head[:-1] | np.concatenate([[True], ~known[:-1]]))
    closes = known & (head[1:] | np.concatenate([~known[1:], [True]]))
    a, z = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long_ = z - a >= w.shortest
    a, z = a[long_], z[long_]
    if not len(a):
        return counts, spans, items
    size = z - a
    to = np.cumsum(size + 1) - size - 1  # each run and a separator after it
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    word = np.repeat(a, size) + inner
    text = np.zeros(int(size.sum()) + len(size), dtype=np.int64)
    place = np.repeat(to, size) + inner
    text[place] = near[word] + 1
    word_at = np.full(len(text), -1, dtype=np.int64)
    word_at[place] = word
    index = FMIndex(text)
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    for length, (patterns, cut, owner) in w.by_length.items():
        which, pos = index.search(patterns)
        if not len(which):
            continue
        first = word_at[pos]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + length, -1)
        doc = np.searchsorted(at, first, "right") - 1
        pair = np.unique(np.column_stack([doc, which]), axis=0)
        for d, p in pair.tolist():
            items[d].update(owner[cut[p] : cut[p + 1]].tolist())
    hit = np.cumsum(cover[:-1]) > 0
    opens = hit & (head[:-1] | np.concatenate([[True], ~hit[:-1]]))
    closes = hit & (head[1:] | np.concatenate([~hit[1:], [True]]))
    for s, e in zip(np.flatnonzero(opens).tolist(), (np.flatnonzero(closes) + 1).tolist()):
        d = int(np.searchsorted(at, s, "right")) - 1
        spans[d].append((s - int(at[d]), e - int(at[d])))
    return counts, spans, items


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not a or not b:
        return a or b
    out: list[tuple[int, int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_FOUND = {"n_words": T.LongType(), "starts": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType()), "items": T.ArrayType(T.LongType())}


def part_count(benchmark: DataFrame, part: int) -> int:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // part))


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")


def part_numbers(benchmark: DataFrame, parts: int) -> list[int]:
    """The parts that have items; at least one."""
    if parts == 1:
        return [0]
    return sorted(r.k for r in items_of(benchmark).select(F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("k")).distinct().collect()) or [0]


def test_set(benchmark: DataFrame, k: int, parts: int, window: int) -> Windows:
    """The windows of one of the parts that the items are dealt to by hash. An item whose rows differ is in one part."""
    rows = items_of(benchmark)
    some = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else rows
    got = some.toArrow().combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in got.columns]
    return Windows(columns[0], columns[1].cast(pa.string()), window)


def scan(ws: Workspace, docs: DataFrame, benchmark: DataFrame, keep: str = "", part: int = PART, window: int = WINDOW) -> DataFrame:
    """docs with the columns of _FOUND (names begin with ``keep``). Parts of the test set run one after another, each a
    pass over docs that adds to what the passes before found: the driver and the tasks hold one part."""
    spark = docs.sparkSession
    out, shared = docs, None
    at = docs.columns.index("text")
    width = len(docs.columns)
    parts = part_count(benchmark, part)
    for k, number in enumerate(part_numbers(benchmark, parts)):
        if shared is not None:  # the passes so far are written, so that their part can go
            out = ws.put(out, f"part-{k}", compression="zstd")
            shared.unpersist()
            if k > 1:
                ws.drop(f"part-{k - 1}")
        shared = spark.sparkContext.broadcast(test_set(benchmark, number, parts, window))
        schema = out.schema
        if not k:
            schema = T.StructType([*schema.fields, *(T.StructField(keep + x, kind) for x, kind in _FOUND.items())])

        def run(batches, shared=shared, first=not k, columns=[f.name for f in schema]):
            for b in pieces(batches, columns[at], SHARD):
                counts, spans, items = hits(b.column(at).cast(pa.string()), shared.value)
                cols = list(b.columns[:width])
                if not first:
                    for i, (s, e, it) in enumerate(zip(*(b.column(width + c).to_pylist() for c in (1, 2, 3)))):
                        spans[i] = merged(list(zip(s, e)), spans[i])
                        items[i] |= set(it)
                cols += [pa.array(counts, pa.int64()), pa.array([[s for s, _ in x] for x in spans], pa.list_(pa.int32())), pa.array([[e for _, e in x] for x in spans], pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, columns)

        out = out.mapInArrow(run, schema)
    return out


def _hit(prefix: str = ""):
    return F.aggregate(F.zip_with(prefix + "ends", prefix + "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


def contamination(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, starts, ends) for every row of docs; starts and
    ends are the merged spans, in words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    found = scan(Workspace(docs.sparkSession, "contamination"), rows, benchmark, part=part).withColumn("n_hit", _hit())
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "starts",
        "ends",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, that aren't contaminated; no join. Columns of docs keep their names, whatever
    these are: the scan's own begin with a prefix that no column of docs has."""
    own = "_fm"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    found = scan(Workspace(docs.sparkSession, "clean"), docs, benchmark, keep=own)
    hit = _hit(own)
    return found.filter(~((hit > 0) & (20 * hit >= F.col(own + "n_words")))).select(docs.columns)
