"""Removal of repeated 100-byte strings by a distributed merge sort of suffixes that knows common prefixes.

Texts are UTF-8 bytes. A byte goes when a LENGTH-byte string that covers it also starts earlier: in a document with a
smaller doc_id, or earlier in the same document. Strings never cross documents and are judged on the input.

Sorting a suffix for every byte isn't needed: each window of LENGTH bytes names one anchor, the leftmost of its GRAM-byte
grams with the smallest hash, so equal windows have equal anchors at equal places. Consecutive windows with one anchor are
a segment; suffixes start at anchors. The steps:

1. Each slice of a partition sends the different hashes of its anchors' grams, with their counts, packed by bucket; a
   bucket says which occur twice or more. Only documents with such anchors, and only those anchors, go on: nothing that
   repeats is lost.
2. Slices collapse equal segments (all but the earliest are repeats), sort the suffixes at their anchors, and send them by
   the gram's bucket as front-coded runs: how many bytes a suffix shares with the one before, and the rest.
3. A bucket merges its runs with a loser tree. Each loser knows how long a prefix it shares with the last winner: the
   longer one wins without a look at the strings, and equal ones are compared from there on only. Suffixes that share a
   gram come out next to each other; equal segments are collapsed as they come, and windows of the others, in order of
   (doc_id, position), are repeats if seen. Suffixes are dealt by their gram's hash, so the order is one inside buckets, not
   over all of them: no repeat needs more, as equal windows have one gram.
4. Repeats are united per document and cut out.

A gram that occurs FAMILY times or more (a passage in many documents has such grams at its ends, before and behind which
every document goes on differently) is no single bucket's: windows of its segments are collapsed in their slice and
go on as rows, of which those whose hash occurs twice meet by their bytes.

Buckets follow the bytes of the texts; a partition holds a bucket at a time. Null text is empty, null ids come after all
others. Rows with one doc_id are ordered by their text's hash; rows that repeat id and text are one document and have the
same result. Ties don't arise: of equal strings the one that starts first stays. Long texts are slices of their own. An
empty table gives no rows. Extra columns are ignored; nothing is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, bucket_count, dealt, flat, give_back, id_filter, maybe_in, mix, pieces, powers, prefix_sums, text_bytes, text_column

LENGTH = 100
GRAM = 32
#: Anchors of a slice in step 1, and segments of a slice in step 2.
SLICE = 400_000
RUN = 100_000
#: A gram with so many occurrences isn't merged in one task.
FAMILY = 4096
#: Marks the anchors of such grams.
HOT = np.uint32(1 << 31)
#: Windows that a slice remembers while it collapses those of hot grams.
WINDOWS = 200_000


def segments(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """For all texts of a chunk: anchors, first and last windows of segments, gram hashes, and each text's bounds."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    s = prefix_sums(buf)
    _, inv = powers(n + 1)
    h = mix((s[gram:] - s[:-gram]) * inv[: n - gram + 1])
    # half of the hash, then the place: the choice must not depend on the chunk, and of equal ones the leftmost wins
    bits = np.uint64(32)
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    # the smallest of each w keys in a row: prefix and suffix minima of blocks of w
    w = length - gram + 1
    block = np.full(-(-len(key) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    block[: len(key)] = key
    block = block.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    anchor = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # windows that cross into the next text are none
    cross = np.zeros(n + 1, dtype=np.int32)
    np.add.at(cross, np.maximum(offs[1:] - length + 1, offs[:-1]), 1)
    np.add.at(cross, offs[1:], -1)
    good = np.cumsum(cross[:windows]) == 0
    new = good.copy()
    new[1:] &= ~good[:-1] | (anchor[1:] != anchor[:-1])
    p0 = np.flatnonzero(new)
    last = good.copy()
    last[:-1] &= ~good[1:] | (anchor[1:] != anchor[:-1])
    p1 = np.flatnonzero(last)
    a = anchor[p0]
    return a, p0, p1, h[a], np.searchsorted(p0, offs)


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m - (x.bit_length() + 7) // 8 if x else m


def pack_run(rows: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A front-coded run of (suffix, what stands before it, document number, position), sorted by suffix."""
    n = len(rows)
    share, size, lefts = (np.zeros(n, "<u4") for _ in range(3))
    rest, before = [], b""
    for k, (right, left, _, _) in enumerate(rows):
        c = _common(before, right, 0)
        share[k], size[k], lefts[k] = c, len(right) - c, len(left)
        rest.append(right[c:])
        rest.append(left)
        before = right
    docs, at = np.array([r[2] for r in rows], dtype="<u4"), np.array([r[3] for r in rows], dtype="<u4")
    return b"".join([np.uint32(n).tobytes(), share.tobytes(), size.tobytes(), lefts.tobytes(), docs.tobytes(), at.tobytes(), *rest])


def unpack_run(blob: bytes, docs: list[tuple[int, int]]):
    """The rows of a run one by one, with the prefix that each shares with the one before."""
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    share, size, lefts, which, at = (np.frombuffer(blob, "<u4", n, 4 + 4 * k * n).tolist() for k in range(5))
    i, right = 4 + 20 * n, b""
    for c, m, left, d, p in zip(share, size, lefts, which, at):
        right = right[:c] + blob[i : i + m]
        i += m
        yield right, c, blob[i : i + left], docs[d], p
        i += left


def merge_runs(runs: list):
    """Rows of all runs in order of suffix; each with the prefix that it shares with the row before."""
    k = 1
    while k < len(runs):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    shares = [0] * k  # with the last winner
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's share with the winner is set."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        s, t = shares[a], shares[b]
        if s > t:
            return a, b
        if t > s:
            return b, a
        x, y = x[0], y[0]
        c = _common(x, y, s)
        if (x[c] if c < len(x) else -1) <= (y[c] if c < len(y) else -1):
            shares[b] = c
            return a, b
        shares[a] = c
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, losers[node] = play(build(2 * node), build(2 * node + 1))
        return w

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        yield heads[winner], shares[winner]
        new = next(runs[winner], None)
        heads[winner] = new
        shares[winner] = new[1] if new is not None else 0
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def family_repeats(family: dict, length: int):
    """Of different segments whose suffixes share a gram, (right, left) -> (document, position): spans (document, start,
    end) that repeat earlier windows."""
    if len(family) < 2:
        return
    seen: set[bytes] = set()
    for (right, left), (doc, at) in sorted(family.items(), key=lambda x: x[1]):
        s, start = left + right, at - len(left)
        open_ = -1
        for p in range(len(s) - length + 1):
            w = s[p : p + length]
            if w in seen:
                if open_ < 0:
                    open_ = p
            else:
                seen.add(w)
                if open_ >= 0:
                    yield doc, start + open_, start + p - 1 + length
                    open_ = -1
        if open_ >= 0:
            yield doc, start + open_, at + len(right)


_NULL = (1 << 63) - 1
_SPANS = "shard int, spans binary"


def _span_rows(spans: dict[tuple[int, int], list[int]], shards: int) -> list[tuple[int, bytes]]:
    """Spans by shard of the document, packed as rows (doc_id, h, start, end)."""
    if not spans:
        return []
    keys, n = np.array(list(spans), dtype=np.int64), np.array([len(x) // 2 for x in spans.values()])
    rows = np.column_stack([np.repeat(keys, n, axis=0), np.concatenate([np.array(x, dtype=np.int64) for x in spans.values()]).reshape(-1, 2)]).astype("<i8")
    to = (mix(rows[:, 0].copy().view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    rows, to = rows[by], to[by]
    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    return [(int(to[a]), rows[a:z].tobytes()) for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(to)])]


def _span_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["shard", "spans"])


def gathered(batches):
    """(doc_id, h, spans) of packed rows, which come sorted by shard: a row for each document."""

    def result(blobs):
        if not blobs:
            return
        rows = np.concatenate([np.frombuffer(x, "<i8") for x in blobs]).reshape(-1, 4)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        cut = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
        pairs = np.ascontiguousarray(rows[:, 2:])
        blobs = [pairs[a:z].tobytes() for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)])]
        for lo in range(0, len(cut), 1000):
            at = cut[lo : lo + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(rows[at, 0]), pa.array(rows[at, 1]), pa.array(blobs[lo : lo + 1000], pa.binary())], ["doc_id", "h", "spans"])

    shard, blobs = None, []
    for b in batches:
        for to, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if to != shard:
                yield from result(blobs)
                shard, blobs = to, []
            blobs.append(blob)
    yield from result(blobs)
    give_back()


def repeats(ws: Workspace, texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, spans) of texts (doc_id, h, text): packed pairs of start and end, which may overlap."""
    spark = texts.sparkSession
    buckets = bucket_count(spark, text_bytes(texts))
    flow_schema = "bucket int, part long, kind int, blob binary"
    names = ["bucket", "part", "kind", "blob"]

    def grams(batches):
        """Step 1: packed hashes with their numbers and counts in the slice, by bucket; and the slice's documents with the
        numbers of their anchors' hashes."""
        task = TaskContext.get().partitionId()
        part, held, docs, size = 0, [], [], 0

        def out():
            u, number, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            to = (mix(u) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[by], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cut))
            which = [by[cut[k] : cut[k + 1]] for k in some]
            blobs = [u[w].tobytes() + w.astype("<u4").tobytes() + count[w].astype("<u4").tobytes() for w in which]
            rows = np.concatenate([np.column_stack(x) for x in docs]).astype("<i8")
            listed = np.uint64(len(rows)).tobytes() + rows.tobytes() + number.astype("<u4").tobytes()
            uid = task << 32 | part
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(some, (task + 7 * part) % buckets).astype(np.int32)), pa.array([uid] * (len(some) + 1), pa.int64()), pa.array([0] * len(some) + [1], pa.int32()), pa.array([*blobs, listed], pa.binary())], names
            )

        for b in pieces(batches):
            buf, offs = flat(b.column(2))
            _, _, _, h, at = segments(buf, offs, length, gram)
            if not len(h):
                continue
            docs.append((np.asarray(b.column(0)), np.asarray(b.column(1)), np.diff(at)))
            held.append(h)
            size += len(h)
            if size >= SLICE:
                yield out()
                part, held, docs, size = part + 1, [], [], 0
        if held:
            yield out()

    def twice(batches):
        """The numbers, by slice, of hashes that occur twice or more; lists of documents pass. Rows come sorted by bucket."""

        def result(blobs, parts):
            if not blobs:
                return
            sizes = [len(x) // 16 for x in blobs]
            h = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(blobs, sizes)])
            count = np.concatenate([np.frombuffer(x, "<u4", k, 12 * k) for x, k in zip(blobs, sizes)])
            _, of = np.unique(h, return_inverse=True)
            total = np.bincount(of, weights=count)[of]
            at = 0
            for x, k, uid in zip(blobs, sizes, parts):
                mine = total[at : at + k]
                at += k
                if (mine > 1).any():
                    number = np.frombuffer(x, "<u4", k, 8 * k) | np.where(mine >= FAMILY, HOT, np.uint32(0))
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([uid], pa.int64()), pa.array([0], pa.int32()), pa.array([number[mine > 1].astype("<u4").tobytes()], pa.binary())], names)

        bucket, blobs, parts = None, [], []
        for b in batches:
            kinds = np.asarray(b.column(2))
            if (kinds == 1).any():
                yield b.filter(pa.array(kinds == 1))
            some = b.filter(pa.array(kinds == 0))
            for to, uid, blob in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(3).to_pylist()):
                if to != bucket:
                    yield from result(blobs, parts)
                    bucket, blobs, parts = to, [], []
                blobs.append(blob)
                parts.append(uid)
        yield from result(blobs, parts)
        give_back()

    def by_document(batches):
        """Each document's anchors that go on; rows come sorted by slice, its documents last."""
        uid, held = None, []
        for b in batches:
            for part, kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if part != uid:
                    uid, held = part, []
                if kind == 0:
                    held.append(np.frombuffer(blob, "<u4"))
                    continue
                if not held:
                    continue
                n = int(np.frombuffer(blob, "<u8", 1)[0])
                docs, number = np.frombuffer(blob, "<i8", 3 * n, 8).reshape(-1, 3), np.frombuffer(blob, "<u4", -1, 8 + 24 * n)
                known = np.concatenate(held)
                mark = np.zeros(int(number.max()) + 1, dtype=np.int8)
                mark[known & ~HOT] = 1 + (known >= HOT)
                kept = np.flatnonzero(mark[number])
                begin = np.concatenate([[0], np.cumsum(docs[:, 2])])
                cut = np.searchsorted(kept, begin)
                hot = np.where(mark[number[kept]] == 2, HOT, np.uint32(0))
                some = np.flatnonzero(np.diff(cut))
                blobs = [((kept[cut[k] : cut[k + 1]] - begin[k]).astype("<u4") | hot[cut[k] : cut[k + 1]]).astype("<u4").tobytes() for k in some]
                for lo in range(0, len(some), 1000):
                    few = slice(lo, lo + 1000)
                    yield pa.RecordBatch.from_arrays([pa.array(docs[some[few], 0]), pa.array(docs[some[few], 1]), pa.array(blobs[few], pa.binary())], ["doc_id", "h", "anchors"])

    # packed rows: slices times buckets of them
    found = dealt(texts.mapInArrow(grams, flow_schema), F.col("bucket"), buckets).sortWithinPartitions("kind", "bucket").mapInArrow(twice, flow_schema)
    found = dealt(found, F.xxhash64("part"), buckets).sortWithinPartitions("part", "kind").mapInArrow(by_document, "doc_id long, h long, anchors binary")
    found = ws.put(found, "anchors", compression="zstd")
    bits = id_filter(found.select("doc_id"), "doc_id", ws, "anchor-bits")
    found = found.dropDuplicates(["doc_id", "h"])
    some = maybe_in(texts, bits).dropDuplicates(["doc_id", "h"]).join(found, ["doc_id", "h"])

    run_schema = "bucket int, doc_id long, h long, spans binary, run binary, docs binary"
    run_names = [x.split()[0] for x in run_schema.split(", ")]

    def sort_runs(batches):
        """Step 2: repeats inside the slice (bucket -1), sorted runs by bucket, and windows of hot grams (bucket -2)."""
        first: dict[tuple[bytes, int], list] = {}
        spans: dict[tuple[int, int], list[int]] = {}

        def hot_windows(some):
            """Windows that are new in this slice, by blocks; the others are repeats. some: (segment, document, start)."""
            seen: set[bytes] = set()
            rows: list = []
            for text, doc, start in sorted(some, key=lambda x: x[1:]):
                for p in range(len(text) - length + 1):
                    w = text[p : p + length]
                    if w in seen:
                        spans.setdefault(doc, []).extend((start + p, start + p + length))
                    else:
                        seen.add(w)
                        rows.append((-2, doc[0], doc[1], np.int64(start + p).tobytes(), w, None))
                if len(seen) >= WINDOWS:
                    seen.clear()
                    yield from batches_of(rows)
                    rows = []
            yield from batches_of(rows)

        def batches_of(rows):
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            step = 256 if rows and rows[0][0] >= -1 else 8192
            for lo in range(0, len(rows), step):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + step]), kinds)], run_names)

        def out():
            by: dict[int, list] = {}
            for (s, left), (doc, at, b) in first.items():
                by.setdefault(b, []).append((s[left:], s[:left], doc, at))
            yield from hot_windows([(left + right, doc, at - len(left)) for right, left, doc, at in by.pop(-2, [])])
            rows = []
            for b, entries in by.items():
                entries.sort(key=lambda r: r[0])
                numbers: dict[tuple[int, int], int] = {}
                run = pack_run([(r, l, numbers.setdefault(d, len(numbers)), p) for r, l, d, p in entries])
                rows.append((b, None, None, None, run, np.array(list(numbers), dtype="<i8").tobytes()))
            rows += [(-1, shard, None, packed, None, None) for shard, packed in _span_rows(spans, buckets)]
            yield from batches_of(rows)

        for b in pieces(batches):
            buf, offs = flat(b.column(2))
            a, p0, p1, h, at = segments(buf, offs, length, gram)
            to = (mix(h) % np.uint64(buckets)).astype(np.int64)
            for i, (doc_id, dh, anchors) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist())):
                doc, base = (doc_id, dh), int(offs[i])
                text = buf[base : offs[i + 1]].tobytes()
                known = np.frombuffer(anchors, "<u4")
                k = (known & ~HOT).astype(np.int64) + at[i]
                for x, s, e, t in zip((a[k] - base).tolist(), (p0[k] - base).tolist(), (p1[k] - base + length).tolist(), np.where(known >= HOT, -2, to[k]).tolist()):
                    key = (text[s:e], x - s)
                    old = first.get(key)
                    if old is None:
                        first[key] = [doc, x, t]
                    elif (old[0], old[1]) <= (doc, x):
                        spans.setdefault(doc, []).extend((s, e))
                    else:  # the earlier one comes later here
                        left = x - s
                        spans.setdefault(old[0], []).extend((old[1] - left, old[1] - left + e - s))
                        first[key] = [doc, x, t]
            if len(first) >= RUN:
                yield from out()
                first, spans = {}, {}
        yield from out()

    def merge(batches):
        """Step 3: all runs of a bucket; rows come sorted by bucket."""

        def repeat_rows(runs):
            spans: dict[tuple[int, int], list[int]] = {}
            family: dict = {}

            def end():
                for doc, s, e in family_repeats(family, length):
                    spans.setdefault(doc, []).extend((s, e))
                family.clear()

            for (right, _, left, doc, at), share in merge_runs(runs):
                if share < gram:
                    end()
                old = family.setdefault((right, left), (doc, at))
                if old != (doc, at):  # of equal segments the earliest stays
                    later = max(old, (doc, at))
                    family[right, left] = min(old, (doc, at))
                    spans.setdefault(later[0], []).extend((later[1] - len(left), later[1] + len(right)))
            end()
            if spans:
                yield _span_batch(_span_rows(spans, buckets))

        bucket, runs = None, []
        for b in batches:
            for to, run, docs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if to != bucket:
                    if runs:
                        yield from repeat_rows(runs)
                    bucket, runs = to, []
                listed = [tuple(x) for x in np.frombuffer(docs, "<i8").reshape(-1, 2).tolist()]
                runs.append(unpack_run(run, listed))
        if runs:
            yield from repeat_rows(runs)
        del runs
        give_back()

    runs = ws.put(some.select("doc_id", "h", "text", "anchors").mapInArrow(sort_runs, run_schema), "runs", compression="zstd")
    sent = runs.filter("bucket >= 0").select("bucket", "run", "docs")
    out = dealt(sent, F.col("bucket"), buckets).sortWithinPartitions("bucket").mapInArrow(merge, _SPANS)
    out = out.unionByName(runs.filter("bucket = -1").select(F.col("doc_id").cast("int").alias("shard"), "spans"))
    windows = runs.filter("bucket = -2").select("doc_id", "h", F.col("spans").alias("at"), F.col("run").alias("w"), F.xxhash64("run").alias("wh"))
    out = out.unionByName(window_repeats(ws, windows, length, buckets))
    return dealt(out, F.col("shard"), buckets).sortWithinPartitions("shard").mapInArrow(gathered, "doc_id long, h long, spans binary")


def window_repeats(ws: Workspace, windows: DataFrame, length: int, shards: int) -> DataFrame:
    """Packed spans of windows (doc_id, h, at, w, wh) of hot grams, at most one of each slice, that aren't the earliest of equal
    ones. Windows whose hash has no second row don't move."""
    shared = windows.groupBy("wh").agg(F.count("*").alias("n")).filter("n > 1").select("wh")
    shared = ws.put(shared, "hot-windows", compression="zstd")
    some = maybe_in(windows, id_filter(shared, "wh", ws, "hot-bits"), "wh").join(shared, "wh", "left_semi")

    def place(batches):
        for b in batches:
            at = np.frombuffer(b"".join(b.column(2).to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at), b.column(3)], ["doc_id", "h", "at", "w"])

    some = some.select("doc_id", "h", "at", "w").mapInArrow(place, "doc_id long, h long, at long, w binary")
    first = Window.partitionBy("w").orderBy("doc_id", "h", "at")
    later = some.withColumn("k", F.row_number().over(first)).filter("k > 1")

    def pack(batches):
        for b in batches:
            spans: dict[tuple[int, int], list[int]] = {}
            for doc, h, at in zip(*(b.column(k).to_pylist() for k in range(3))):
                spans.setdefault((doc, h), []).extend((at, at + length))
            if spans:
                yield _span_batch(_span_rows(spans, shards))

    return later.select("doc_id", "h", "at").mapInArrow(pack, _SPANS)


def _cut(text: bytes, spans: bytes) -> tuple[bytes, int, list[tuple[int, int]]]:
    """What is left, how many bytes went, and the maximal runs that went."""
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
    cover = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(cover, pairs[:, 0], 1)
    np.add.at(cover, pairs[:, 1], -1)
    gone = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    raw = np.frombuffer(text, np.uint8)
    return raw[~gone].tobytes(), int(gone.sum()), list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of docs (doc_id, text, ...)."""
    ws = Workspace(docs.sparkSession, "suffix")
    text = text_column(docs)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), F.xxhash64(text, F.lit(5)).alias("h"), text.cast("binary").alias("text"))
    spans = ws.put(repeats(ws, texts, length, gram), "spans", compression="zstd")
    marked = id_filter(spans, "doc_id", ws, "marked")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches):
        for b in pieces(batches):
            rows = []
            for raw, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kept, gone, parts = _cut(raw, blob) if blob else (raw, 0, [])
                rows.append((len(raw), gone, len(parts), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols][: len(names)], names)

    touched = maybe_in(texts, marked).join(spans, ["doc_id", "h"], "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)
    whole = maybe_in(texts, marked, negate=True)
    size = F.octet_length("text").cast("long")
    cols = ["doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")]
    whole = whole.select(*cols, *([F.col("text").alias("kept")] if with_bytes else []))
    return touched.unionByName(whole).withColumn("doc_id", F.when(F.col("doc_id") != _NULL, F.col("doc_id")))
