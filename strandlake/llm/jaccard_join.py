"""Exact n-gram Jaccard self-join by grouped prefixes, and its connected components.

A document is the set of its distinct shingles of N words (A-Z in lower case, words are runs without ASCII white
space; with fewer words the whole sequence is the one shingle). Two documents link when their sets' Jaccard
similarity is at least PERCENT / 100. All shingles have one global order, frequent ones last; two sets that link share a
shingle among the first of each (the prefix filter). Frequencies come from all documents; the order only has to be the
same for all, so the list of frequent shingles can be bounded (HEAVY_MOST) without touching the result.

Documents with the same size and prefix are one group; inside it, documents with the same sequence of words (by a 128-bit
cryptographic digest) are one class with the smallest doc_id as representative. Prefix shingles of groups (never of
copies) are dealt by shingle; a shingle's groups are a run. Shingles are numbered by 63-bit hashes up to here. Equal hashes
inside a text are compared by their bytes, and shingles that share a hash get a key each (the k-th of a hash the same key in
every text): so sizes are exact, and texts have at least as many keys in common as shingles, as the filter needs. Whether
two texts link is decided by their words, compared byte by byte.

Linked classes are found in two rounds, so that k near copies cost about k checks and not k * k:
1. Each group is checked with one central group: of the groups with the most shared prefix shingles in its runs (a text
   that others are edits of has none of its own) the one that it meets most often; and inside groups each class with the
   group's first. Links that hold give components.
2. All pairs of groups in a run that aren't in one component already and can still link, and pairs of classes of a group
   that aren't, are expanded to their classes and verified (first by counts of their shingles in classes of hashes, an
   upper bound of the overlap, then by their texts). No pair that could link different components is left out,
   so the components are exact.

Whether two groups can link at a run is bounded from their sizes: the overlap that they need, less what lies beyond the
shorter prefix, must be among the shingles from this one on. A run of over TILE groups isn't one task's: in round 1 its
central group is found by an aggregate and joined to its groups; in round 2 its groups are cut into tiles by hash, and
each pair of tiles is a task's. Buckets and partitions follow the bytes of the texts; a partition holds a bucket at a time.

Null and empty texts, and texts without words, have an empty set and link with nothing; long texts are taken whole. Ties
(groups that are equally central) are broken by the groups' hashes, and don't touch the result. Rows that repeat an id
and its text are one document; rows that repeat an id with another text are rows of their own with the component of
their text. Rows without id take part like any others and can join what links with them; their component is the smallest id
that they reach, null if they reach none. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_LEAST, LOWER, PARTITIONS, SPACE, Workspace, attach_groups, bucket_count, components, dealt, distinct, eight, flat, give_back, id_filter, maybe_in, mix, pieces, ranges, same_bytes, text_bytes, text_column, without, word_hashes, words

N = 4
PERCENT = 85
#: A shingle's count in a slice of a partition below this isn't reported, nor is a total below 4 times this heavy.
HEAVY_LOCAL = 3
HEAVY_MOST = 1 << 18
SLICE = 2_000_000
#: Keys of heavy shingles begin here.
HEAVY = np.uint64(1 << 63)
#: Shingles with so many documents are dealt by group, to all buckets: their runs need no bucket to be found.
SPREAD = 10_000
#: Most central groups of a run that round 1 tries; round 2 has no such bound.
CENTRES = 3
#: Classes of hashes in which a set's shingles are counted before two texts are compared.
TALLIES = 128
#: Runs up to this size are paired by whole arrays, runs above TILE by tiles in different tasks.
SHORT, TILE = 12, 4096
#: Pairs that a task holds before it hands them on.
HELD = 500_000
#: Copies at most that are made of a text so that its pairs aren't one task's.
SALTS = 4096
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def _cut(col: pa.Array, n: int):
    """The texts' bytes in lower case with their words, and for each shingle its first word and how many it has."""
    buf, offs = flat(col)
    buf = LOWER[buf]
    starts, ends, at = words(buf, offs, SPACE)
    count = np.diff(at)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first, bounds = ranges(at[:-1], size)
    return buf, starts, ends, at, first, np.minimum(np.repeat(count, size), n), bounds


def shingles(col: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all shingles (not distinct yet), and each text's bounds in them."""
    parts = _cut(col, n)
    return _hashed(parts, n, eight(parts[0]))


def _hashed(parts, n: int, load: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, starts, ends, _, first, have, bounds = parts
    m = word_hashes(load, starts, ends)
    if not len(m):
        return np.zeros(0, np.uint64), bounds
    h = have.astype(np.uint64)
    for k in range(n):
        inside = k < have
        h = h + np.where(inside, mix(m[np.minimum(first + k, len(m) - 1)] * _FACTORS[k % 7] + np.uint64(k)), np.uint64(0))
    return mix(h) >> np.uint64(1), bounds


def more_keys(parts, n: int, load: np.ndarray, h: np.ndarray, a: int, z: int) -> np.ndarray:
    """Keys for the different shingles of one text (its occurrences are a .. z - 1) that share a hash: one for each but the
    first. Equal hashes are compared by the words' bytes, so a text has as many keys as it has shingles, and two texts have
    at least as many keys in common as shingles."""
    buf, starts, ends, _, first, have, _ = parts
    by = np.argsort(h[a:z], kind="stable")
    heads = np.concatenate([[True], h[a:z][by][1:] != h[a:z][by][:-1]])
    i, j = a + by, a + by[np.flatnonzero(heads)[np.cumsum(heads) - 1]]
    i, j = i[i != j], j[i != j]
    same, size = np.ones(len(i), dtype=bool), ends - starts
    for k in range(min(n, int(have[a]))):
        p, q = first[i] + k, first[j] + k
        same &= size[p] == size[q]
        live = np.flatnonzero(same)
        same[live] = same_bytes(load, starts[p[live]], load, starts[q[live]], size[p[live]])
    if same.all():
        return np.zeros(0, np.uint64)
    raw, kinds = buf.tobytes(), {}
    for x in np.flatnonzero(np.isin(h[a:z], h[i[~same]])).tolist():
        w = range(int(first[a + x]), int(first[a + x] + have[a + x]))
        kinds.setdefault(int(h[a + x]), set()).add(b" ".join(raw[starts[k] : ends[k]] for k in w))
    return np.array([int(mix(np.array([u], np.uint64) * np.uint64(3) + np.uint64(k))[0]) >> 1 for u, some in kinds.items() for k in range(1, len(some))], np.uint64)


def sequences(parts) -> np.ndarray:
    """A 128-bit digest of each text's words (joined by one space), as two numbers."""
    buf, starts, ends, at, *_ = parts
    take, bounds = ranges(starts, ends - starts + 1)
    joined = np.append(buf, np.uint8(32))[take]
    joined[bounds[1:] - 1] = 32
    cut = bounds[at]
    raw = b"".join([hashlib.blake2b(joined[a:z], digest_size=16).digest() for a, z in zip(cut[:-1], cut[1:])])
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def linked(x: pa.Array, y: pa.Array, n: int, percent: int) -> np.ndarray:
    """Whether the texts of each pair link; shingles are compared by their words, and these by their bytes."""
    rows = len(x)
    buf, starts, ends, _, first, have, bounds = _cut(pa.concat_arrays([x, y]), n)
    if not len(starts):
        return np.zeros(rows, dtype=bool)
    number = np.append(distinct(eight(buf), starts, ends)[2] + 1, 0)
    key = number[first]
    for k in range(1, n):
        key = np.unique(key * len(number) + np.where(k < have, number[np.minimum(first + k, len(starts))], 0), return_inverse=True)[1]
    owner = np.repeat(np.arange(2 * rows) % rows, np.diff(bounds))
    split, width = bounds[rows], int(key.max(initial=0)) + 1
    px, py = _unique(owner[:split] * width + key[:split]), _unique(owner[split:] * width + key[split:])
    both = np.bincount(np.intersect1d(px, py, assume_unique=True) // width, minlength=rows)
    every = np.bincount(px // width, minlength=rows) + np.bincount(py // width, minlength=rows) - both
    return (both > 0) & (100 * both >= percent * every)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def _unique(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


class Order:
    """The global order: heavy shingles by their count after all others, which stand by their hash."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray):
        by = np.argsort(heavy)
        self.heavy = heavy[by]
        rank = np.empty(len(heavy), dtype=np.uint64)
        rank[np.lexsort((heavy, counts))] = np.arange(len(heavy), dtype=np.uint64)
        self.spread = HEAVY + np.uint64((counts < SPREAD).sum())  # the keys of shingles that many documents have
        self.rank = rank[by]
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(heavy & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def keys(self, h: np.ndarray) -> np.ndarray:
        if not len(self.heavy):
            return h
        maybe = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(maybe):
            return h
        near = np.minimum(np.searchsorted(self.heavy, h[maybe]), len(self.heavy) - 1)
        hit = self.heavy[near] == h[maybe]
        out = h.copy()
        out[maybe[hit]] = HEAVY + self.rank[near[hit]]
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def heavy_shingles(texts: DataFrame, n: int) -> DataFrame:
    def count(batches):
        held, size = [], 0

        def out():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c >= HEAVY_LOCAL], c[c >= HEAVY_LOCAL]
            return pa.RecordBatch.from_arrays([_signed(h), pa.array(c, pa.int64())], ["h", "n"])

        for b in pieces(batches):
            h, bounds = shingles(b.column(1), n)
            for a, z in zip(bounds[:-1], bounds[1:]):
                held.append(_unique(h[a:z]))
                size += len(held[-1])
            if size >= SLICE:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    found = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= 4 * HEAVY_LOCAL)
    return found


def _top(ws: Workspace, found: DataFrame) -> Order:
    """At most HEAVY_MOST of the most frequent shingles come to the driver: by doubling classes of counts."""
    found = ws.put(found.withColumn("class", F.floor(F.log2("n")).cast("int")), "heavy")
    total, least = 0, 64
    for r in sorted(found.groupBy("class").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["class"]):  # a row for each power of two
        total += r.k
        if total > HEAVY_MOST:
            break
        least = r["class"]
    top = found.filter(F.col("class") >= least).select("h", "n").toPandas()
    return Order(top["h"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64))


_ROWS = "kind int, doc_id long, n long, gid long, s1 long, s2 long, bucket int, blob binary, last long, tally binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _rows(kind, doc_id=None, n=None, gid=None, s1=None, s2=None, bucket=None, blob=None, last=None, tally=None, size=0) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
    cols = [np.full(size, kind, np.int32), doc_id, n, gid, s1, s2, bucket, blob, last, tally]
    return pa.RecordBatch.from_arrays([pa.nulls(size, k) if c is None else (c if isinstance(c, pa.Array) else pa.array(c, k)) for c, k in zip(cols, kinds)], _NAMES)


def _by_run(batches, width: int):
    """Rows that come sorted by their first column, as arrays of whole runs with the runs' bounds."""
    rest: list = []
    for b in chain(batches, [None]):
        if b is not None:
            rest.append([np.asarray(b.column(k)) for k in range(width)])
            if sum(len(x[0]) for x in rest) < 200_000:
                continue
        if not rest:
            return
        columns = [np.concatenate([x[k] for x in rest]) for k in range(width)]
        key = columns[0]
        cut = len(key) if b is None else int(np.searchsorted(key, key[-1]))  # the last run may go on
        rest = [[x[cut:] for x in columns]]
        if cut:
            heads = np.flatnonzero(np.concatenate([[True], key[1:cut] != key[: cut - 1]]))
            yield [x[:cut] for x in columns], list(zip(heads.tolist(), [*heads[1:].tolist(), cut]))
    give_back()


def similar_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text, ...)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    order = spark.sparkContext.broadcast(_top(ws, heavy_shingles(texts, n)))
    buckets = bucket_count(spark, text_bytes(texts))
    parts = min(buckets, PARTITIONS)

    def prefixes(batches):
        """kind 0: a row for each document; kind 1: prefix shingles of groups new to this task, packed by bucket."""
        seen: set[int] = set()
        held: list[tuple] = []
        size = seed = 0

        def out():
            key, gid, length = (np.concatenate([x[k] for x in held]) for k in range(3))
            to = (mix(key ^ np.where(key >= order.value.spread, mix(gid), np.uint64(0))) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[by], np.arange(buckets + 1))
            key, gid, length = key[by], gid[by], length[by]
            some = np.flatnonzero(np.diff(cut))
            blob = [key[cut[k] : cut[k + 1]].tobytes() + gid[cut[k] : cut[k + 1]].tobytes() + length[cut[k] : cut[k + 1]].tobytes() for k in some]
            return _rows(1, bucket=some.astype(np.int32), blob=blob, size=len(some))

        for b in pieces(batches):
            cut = _cut(b.column(1), n)
            load = eight(cut[0])
            h, bounds = _hashed(cut, n, load)
            key = order.value.keys(h)
            rows = b.num_rows
            count, sequence = np.zeros(rows, np.int64), sequences(cut)
            gids, last = (np.zeros(rows, np.uint64) for _ in range(2))
            tally = [b""] * rows
            for i in range(rows):
                o = _unique(key[bounds[i] : bounds[i + 1]])
                if len(o) < bounds[i + 1] - bounds[i]:  # a shingle occurs again, or two of them share a hash
                    more = more_keys(cut, n, load, h, int(bounds[i]), int(bounds[i + 1]))
                    if len(more):
                        o = _unique(np.concatenate([o, more]))
                k = len(o)
                if not k:
                    continue
                m = mix(o)
                p = k - needed(k, percent) + 1
                count[i] = k
                tally[i] = np.minimum(np.bincount((m & np.uint64(TALLIES - 1)).astype(np.int64), minlength=TALLIES), 65535).astype("<u2").tobytes()
                g = int(mix(m[:p].sum(keepdims=True) * np.uint64(3) + np.uint64(k))[0])
                gids[i], last[i] = g, o[p - 1] ^ np.uint64(1 << 63)  # as a signed number it keeps its order
                if g not in seen:
                    seen.add(g)
                    held.append((o[:p], np.full(p, g, np.uint64), np.full(p, k, np.uint32)))
                    size += p
            to = (mix(sequence[:, 0] + np.uint64(seed) + np.arange(rows, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int32)  # anywhere: copies aren't kept together
            seed += rows
            yield _rows(0, b.column(0), count, _signed(gids), _signed(sequence[:, 0]), _signed(sequence[:, 1]), to, None, _signed(last), tally, rows)
            if size >= 500_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def runs(batches):
        """Documents pass; kind 2: runs of two and more groups, packed. Rows come sorted by bucket, one is held at a time."""
        bucket, blobs = None, []
        for b in batches:
            kinds = np.asarray(b.column(0))
            if (kinds == 0).any():
                yield b.filter(pa.array(kinds == 0))
            packed = b.filter(pa.array(kinds == 1))
            for to, blob in zip(packed.column(6).to_pylist(), packed.column(7).to_pylist()):
                if to != bucket:
                    yield from bucket_runs(blobs)
                    bucket, blobs = to, []
                blobs.append(blob)
        yield from bucket_runs(blobs)
        give_back()

    def bucket_runs(blobs):
        if not blobs:
            return
        sizes = [len(x) // 20 for x in blobs]
        key = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(blobs, sizes)])
        gid = np.concatenate([np.frombuffer(x, np.uint64, k, 8 * k) for x, k in zip(blobs, sizes)])
        length = np.concatenate([np.frombuffer(x, np.uint32, k, 16 * k) for x, k in zip(blobs, sizes)])
        by = np.argsort(key, kind="stable")
        key = key[by]
        twin = np.zeros(len(key), dtype=bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:]
        twin |= key >= order.value.spread  # other groups may be in other buckets
        key, by = key[twin], by[twin]
        gid, length = gid[by], length[by]
        by = np.lexsort((gid, key))
        key, gid, length = key[by], gid[by], length[by]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (gid[1:] != gid[:-1])  # a group that several tasks sent
        key, gid, length = key[fresh], gid[fresh], length[fresh]
        if not len(key):
            return
        of = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        several = (np.bincount(of)[of] > 1) | (key >= order.value.spread)
        key, gid, length = key[several], gid[several], length[several]
        for a in range(0, len(key), 100_000):
            z = a + 100_000
            yield _rows(2, blob=[key[a:z].tobytes() + gid[a:z].tobytes() + length[a:z].tobytes()], size=1)

    flow = dealt(texts.mapInArrow(prefixes, _ROWS), F.col("bucket"), buckets).sortWithinPartitions("kind", "bucket").mapInArrow(runs, _ROWS)
    flow = ws.put(flow, "flow", compression="zstd")
    docrows = flow.filter("kind = 0").select("doc_id", "n", "gid", "last", "tally", F.struct("s1", "s2", "n").alias("class"))
    classes = docrows.filter("n > 0").groupBy("class", "gid", "n", "last").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.min("tally").alias("tally"))
    classes = ws.put(classes.withColumn("node", F.monotonically_increasing_id()), "classes", compression="zstd")
    lost = not classes.filter("rep is null").isEmpty()  # classes that only rows without id have

    lead = classes.groupBy("gid").agg(F.min("node").alias("lead"), F.count("*").alias("k"), F.min("last").alias("last"))
    lead = ws.put(lead, "lead", compression="zstd")

    def unpack(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                k = len(x) // 20
                yield pa.RecordBatch.from_arrays([_signed(np.frombuffer(x, np.uint64, k)), _signed(np.frombuffer(x, np.uint64, k, 8 * k)), pa.array(np.frombuffer(x, np.uint32, k, 16 * k).astype(np.int64))], ["key", "gid", "n"])

    entries = flow.filter("kind = 2").select("blob").mapInArrow(unpack, "key long, gid long, n long")
    # rank: how many of a group's shingles with runs come at this one or after it in the global order
    order_ = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    mine = Window.partitionBy("gid")
    entries = entries.withColumn("rank", F.row_number().over(mine.orderBy(order_.desc()))).withColumn("shared", F.count("*").over(mine))
    entries = ws.put(entries.join(lead.select("gid", "last"), "gid").select("key", "gid", "n", "last", "rank", "shared"), "entries", compression="zstd")

    def able(size, last, rank, i, j):
        """Whether a link of groups i and j can have its first shared shingle here."""
        beyond = -(-percent * size // 100) - 1
        overlap = -(-percent * (size[i] + size[j]) // (100 + percent))
        tail = np.where(last[j] > last[i], beyond[i], np.where(last[j] < last[i], beyond[j], np.minimum(beyond[i], beyond[j])))
        return (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & (overlap - tail <= np.minimum(rank[i], rank[j]))

    def counted(made: list) -> pa.RecordBatch:
        x, y = (np.concatenate([m[k] for m in made]) for k in range(2))
        pair, c = np.unique(np.rec.fromarrays([x, y]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair.f0), pa.array(pair.f1), pa.array(c, pa.int64())], ["a", "b", "c"])

    def short_pairs(key, spans):
        """All pairs (i, j) of places in runs of at most SHORT, and the other runs."""
        bounds = np.array(spans, dtype=np.int64)
        size = bounds[:, 1] - bounds[:, 0]
        short = np.repeat(size <= SHORT, size)
        out_i, out_j = [], []
        for d in range(1, SHORT):
            i = np.flatnonzero(short[:-d] & (key[:-d] == key[d:])) if d < len(key) else np.zeros(0, np.int64)
            if not len(i):
                break
            out_i.append(i)
            out_j.append(i + d)
        none = np.zeros(0, np.int64)
        return np.concatenate(out_i or [none]), np.concatenate(out_j or [none]), [x for x, m in zip(spans, size) if m > SHORT]

    def stars(batches):
        """Pairs of each run's most central groups and its others (of short runs all pairs), as far as they can link; the
        more central group first."""
        for (key, gid, size, last, rank, shared), spans in _by_run(batches, 6):
            i, j, long_ = short_pairs(key, spans)
            ok = able(size, last, rank, i, j)
            i, j = i[ok], j[ok]
            swap = (shared[j] > shared[i]) | ((shared[j] == shared[i]) & (gid[j] < gid[i]))
            made = [(np.where(swap, gid[j], gid[i]), np.where(swap, gid[i], gid[j]))]
            for a, z in long_:
                for i in a + np.lexsort((gid[a:z], -shared[a:z]))[:CENTRES]:
                    j = np.arange(a, z)
                    ok = able(size, last, rank, i, j) & ((shared[j] < shared[i]) | ((shared[j] == shared[i]) & (gid[j] > gid[i])))
                    made.append((np.full(int(ok.sum()), gid[i]), gid[j[ok]]))
            yield counted(made)

    # runs that are too long for one task: their keys
    total = entries.count()
    any_long = total > TILE
    if any_long:
        long_keys = ws.put(entries.groupBy("key").agg(F.count("*").alias("k"), F.max_by(F.struct("gid", "n", "last", "rank", "shared"), F.struct("shared", -F.col("gid"))).alias("top")).filter(F.col("k") > TILE), "long")
        any_long = not long_keys.isEmpty()
    short = entries.join(long_keys, "key", "left_anti") if any_long else entries

    # round 1
    pairs = short.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(stars, "a long, b long, c long")
    if any_long:
        met = attach_groups(entries.join(long_keys.select("key"), "key", "left_semi"), long_keys, "key", "k", total)
        met = met.filter((F.col("gid") != F.col("top.gid")) & able_here(percent, F.col("top"), F.struct("n", "last", "rank")))
        pairs = pairs.unionByName(met.select(F.col("top.gid").alias("a"), F.col("gid").alias("b")).groupBy("a", "b").agg(F.count("*").alias("c")))
    pairs = pairs.groupBy("a", "b").agg(F.sum("c").alias("c")).groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
    across = pairs.join(lead.select(F.col("gid").alias("a"), F.col("lead").alias("x")), "a").join(lead.select(F.col("gid").alias("b"), F.col("lead").alias("y")), "b").select("x", "y")
    several = lead.filter("k > 1").select("gid", "lead")
    inside = classes.join(several, "gid").filter("node != lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))
    tallies = classes.select("node", "rep", "n", "tally", F.col("class.s1").alias("s1"))
    checked = verify(ws, texts, tallies, across.unionByName(inside).distinct(), "round1", n, percent, lost)
    links = ws.put(checked, "links1") if checked is not None else spark.createDataFrame([], "a long, b long")
    comp = components(ws, links, "comp1") if checked is not None else spark.createDataFrame([], "id long, component long")

    # round 2: what round 1 hasn't connected
    of = classes.join(comp.withColumnRenamed("id", "node"), "node", "left").select("gid", "n", "last", "node", F.coalesce("component", "node").alias("comp"))
    of = ws.put(of, "of", compression="zstd")
    state = of.groupBy("gid").agg(F.min("comp").alias("comp"), (F.min("comp") != F.max("comp")).alias("mixed"))
    entries = ws.put(entries.join(state, "gid"), "entries2", compression="zstd")
    open_ = entries.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("mixed").alias("mixed")).filter("lo != hi or mixed").select("key")

    def crossing(batches):
        """Pairs of groups of a run in different components (or in several) that can still link."""
        for (key, gid, size, last, rank, comp_, mixed), spans in _by_run(batches, 7):
            made: list = []
            size_ = 0

            def add(i, j):
                open__ = (comp_[j] != comp_[i]) | mixed[j] | mixed[i]
                i, j = (i[open__] if np.ndim(i) else np.full(int(open__.sum()), i)), j[open__]
                ok = able(size, last, rank, i, j)
                i, j = i[ok], j[ok]
                made.append((np.minimum(gid[i], gid[j]), np.maximum(gid[i], gid[j])))
                return len(i)

            i, j, long_ = short_pairs(key, spans)
            size_ += add(i, j)
            for a, z in long_:
                for i in range(a, z - 1):
                    size_ += add(i, np.arange(i + 1, a + int(np.searchsorted(size[a:z], size[i] * 100 // percent, "right"))))
                    if size_ > HELD:  # pairs don't pile up over long runs
                        yield counted(made)
                        made, size_ = [], 0
            yield counted(made)

    short = (entries.join(long_keys, "key", "left_anti") if any_long else entries).join(open_, "key", "left_semi")
    runs2 = short.select("key", "gid", "n", "last", "rank", "comp", "mixed").repartition(parts, "key").sortWithinPartitions("key", "n")
    cross = runs2.mapInArrow(crossing, "a long, b long, c long").select("a", "b")
    if any_long:
        open_ = ws.put(open_, "open")
        some = attach_groups(entries.join(open_, "key", "left_semi").join(long_keys.select("key"), "key", "left_semi"), long_keys.select("key", "k"), "key", "k", total)
        met = tile_pairs(some.select("key", "k", "gid", "n", "last", "rank", "comp", "mixed"), "key", "k", "gid")
        i, j = F.struct("i.n", "i.last", "i.rank"), F.struct("j.n", "j.last", "j.rank")
        met = met.filter((F.col("i.comp") != F.col("j.comp")) | F.col("i.mixed") | F.col("j.mixed")).filter(able_here(percent, i, j))
        cross = cross.unionByName(met.select(F.least("i.gid", "j.gid").alias("a"), F.greatest("i.gid", "j.gid").alias("b")))
    cross = cross.distinct()
    one = of.select(F.col("gid").alias("a"), F.col("node").alias("x"), F.col("comp").alias("cx"))
    two = of.select(F.col("gid").alias("b"), F.col("node").alias("y"), F.col("comp").alias("cy"))
    across = cross.join(one, "a").join(two, "b").filter("cx != cy").select("x", "y")
    torn = state.filter("mixed").select("gid")
    if not torn.isEmpty():
        torn = of.join(torn, "gid").select("gid", "node", "comp")
        torn = ws.put(torn.join(torn.groupBy("gid").agg(F.count("*").alias("k")), "gid"), "torn")
        inside = tile_pairs(torn, "gid", "k", "node").filter("i.comp != j.comp").select(F.least("i.node", "j.node").alias("x"), F.greatest("i.node", "j.node").alias("y"))
        across = across.unionByName(inside)
    more = verify(ws, texts, tallies, across.distinct(), "round2", n, percent, lost)
    if more is not None:
        more = ws.put(more, "links2")
    if more is not None and not more.isEmpty():
        comp = components(ws, links.unionByName(more), "comp2")

    # a component's name is its smallest id; one of rows without id alone has none
    joined = ws.put(classes.join(comp.withColumnRenamed("id", "node"), "node").select("node", "component", "rep"), "joined", compression="zstd")
    names = ws.put(joined.groupBy("component").agg(F.min("rep").alias("name"), F.count("*").alias("k")), "names")
    total = names.agg(F.sum("k")).first()[0] or 0
    named = attach_groups(joined.select("node", "component"), names, "component", "k", total).select("node", "name")
    final = classes.join(named, "node", "left").select("class", "rows", F.coalesce("name", "rep").alias("component"))
    total = classes.agg(F.sum("rows")).first()[0] or 0
    some = attach_groups(docrows.filter("n > 0"), final, "class", "rows", total)
    out = some.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.unionByName(docrows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def able_here(percent: int, i, j):
    """Whether a link of groups i and j (structs of n, last, rank) can have its first shared shingle here."""
    beyond = [F.ceil(percent * x["n"] / 100) - 1 for x in (i, j)]
    overlap = F.ceil(percent * (i["n"] + j["n"]) / (100 + percent))
    tail = F.when(j["last"] > i["last"], beyond[0]).when(j["last"] < i["last"], beyond[1]).otherwise(F.least(*beyond))
    return (100 * F.least(i["n"], j["n"]) >= percent * F.greatest(i["n"], j["n"])) & (overlap - tail <= F.least(i["rank"], j["rank"]))


def tile_pairs(rows: DataFrame, key: str, k: str, ident: str, tile: int | None = None) -> DataFrame:
    """Pairs (i, j: structs of all columns) of the rows of each key, each pair once, i with the smaller ``ident``. ``k``:
    rows of the key; those above ``tile`` are cut into tiles by hash, and each pair of tiles is joined by itself."""
    tiles = F.ceil(F.col(k) / (tile or TILE)).cast("int")
    rows = rows.select(F.struct(*rows.columns).alias("r"), F.col(key).alias("key"), tiles.alias("tiles"), F.pmod(F.xxhash64(ident), tiles).cast("int").alias("t"))
    rows = rows.select("r", "key", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    rows = rows.select("r", "key", "t", F.least("t", "other").alias("lo"), F.greatest("t", "other").alias("hi"))
    one = rows.select("key", "lo", "hi", F.col("r").alias("i"), F.col("t").alias("ti"))
    two = rows.select("key", "lo", "hi", F.col("r").alias("j"), F.col("t").alias("tj"))
    # two rows of one tile meet in the tile's pair with itself alone
    return one.join(two, ["key", "lo", "hi"]).filter(f"i.{ident} < j.{ident} and (lo = hi or ti != tj)").select("i", "j")


def promising(ws: Workspace, pairs: DataFrame, total: int, tallies: DataFrame, percent: int, name: str) -> DataFrame:
    """Pairs whose sets can overlap enough: two sets have at most as many shingles in common as the sum over TALLIES
    classes of hashes of the smaller counts. Exact: no pair that links goes (a count at its limit counts as any). Ids with
    many pairs are no single task's."""
    side = tallies.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("tally").alias("tx"), F.col("s1").alias("sx"), F.col("rep").alias("rx"))
    if total <= HOT_LEAST:  # no id has more pairs than that
        rows = pairs.join(side, "x")
    else:
        mine = pairs.groupBy("x").agg(F.count("*").alias("pairs"))
        rows = attach_groups(pairs, ws.put(mine.join(side, "x"), f"{name}-x"), "x", "pairs", total)
    other = tallies.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("tally").alias("ty"), F.col("s1").alias("sy"), F.col("rep").alias("ry"))
    rows = rows.join(other, "y").select("x", "y", "nx", "ny", "tx", "ty", "sx", "sy", "rx", "ry")

    def bound(batches):
        for b in batches:
            if not b.num_rows:
                continue
            nx, ny = np.asarray(b.column(2)), np.asarray(b.column(3))
            tx, ty = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, TALLIES).astype(np.int64) for k in (4, 5))
            most = np.where((tx == 65535) | (ty == 65535), np.maximum(nx, ny)[:, None], np.minimum(tx, ty)).sum(axis=1)
            kept = b.filter(pa.array(((100 + percent) * np.minimum(most, np.minimum(nx, ny)) >= percent * (nx + ny))))
            yield pa.RecordBatch.from_arrays([kept.column(k) for k in (0, 1, 6, 7, 8, 9)], ["x", "y", "sx", "sy", "rx", "ry"])

    return rows.mapInArrow(bound, "x long, y long, sx long, sy long, rx long, ry long")


def verify(ws: Workspace, texts: DataFrame, tallies: DataFrame, pairs: DataFrame, name: str, n: int, percent: int, lost: bool) -> DataFrame | None:
    """The pairs (x, y) of classes whose texts link, as (a, b); None if there are no pairs. A text goes once to each salt
    that its pairs use, SALTS at most; of an id with several texts, the one of the class that was paired. ``lost``: some
    classes have no id; their texts are found by their digest."""
    pairs = ws.put(pairs, f"{name}-all")
    total = pairs.count()
    if not total:
        return None
    pairs = promising(ws, pairs, total, tallies, percent, name)
    salt = lambda of: F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int")
    pairs = ws.put(pairs.withColumn("ux", salt("y")).withColumn("uy", salt("x")), f"{name}-pairs")
    ids = pairs.select(F.col("x").alias("node"), F.col("rx").alias("doc_id"), F.col("sx").alias("s1")).unionByName(pairs.select(F.col("y").alias("node"), F.col("ry").alias("doc_id"), F.col("sy").alias("s1"))).distinct()
    ids = ws.put(ids, f"{name}-ids")

    def classed(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _signed(sequences(_cut(b.column(1), n))[:, 0])], ["doc_id", "text", "s1"])

    some = maybe_in(texts.filter("doc_id is not null"), id_filter(ids, "doc_id", ws, f"{name}-bits")).join(ids.select("doc_id").distinct(), "doc_id")
    some = some.mapInArrow(classed, "doc_id long, text string, s1 long").join(ids, ["doc_id", "s1"]).select("node", "text")
    if lost:
        without_id = texts.filter("doc_id is null").mapInArrow(classed, "doc_id long, text string, s1 long").drop("doc_id")
        some = some.unionByName(without_id.join(ids.filter("doc_id is null").select("node", "s1"), "s1").select("node", "text"))
    some = ws.put(some.dropDuplicates(["node"]), f"{name}-texts", compression="zstd")
    left = pairs.select("x", "ux").distinct().join(some.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x")
    right = pairs.select("y", "uy").distinct().join(some.select(F.col("node").alias("y"), F.col("text").alias("ty")), "y")
    both = pairs.join(right, ["y", "uy"]).join(left, ["x", "ux"]).select("x", "y", "tx", "ty")

    def check(batches):
        for b in pieces(batches, "ty", 1 << 20):
            for lo in range(0, b.num_rows, 512):  # the texts x aren't in the slices' bytes
                c = b.slice(lo, 512)
                kept = c.filter(pa.array(linked(c.column(2), c.column(3), n, percent)))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all their columns, whose doc_id is the smallest of its component; rows without id stay."""
    ws = Workspace(docs.sparkSession, "one")
    return without(ws, docs, similar_components(docs, n, percent).filter("doc_id != component_id").select("doc_id"))
