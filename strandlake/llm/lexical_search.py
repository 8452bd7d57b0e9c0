"""Ranked lexical search: a two-level quantised index, searched by bounds and rescored exactly.

Terms are runs of letters, digits and non-ASCII characters, A-Z in lower case. With N documents that have a term, L terms in
them, df documents that hold a term and tf of its occurrences among a document's n, a term weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))) and gives a document that holds it w * s, s = (10**9 tf) div (1000 tf + 8 m), where
m = 100 - 90 + (90 n N) div L. A query's score is the sum over its terms, once each; all but w is in 64-bit integers.

1. Every document is read once, in blocks of about BLOCK bytes: postings (document, tf) of the terms that any query has, term
   by term. N, L and df are sums over the blocks.
2. The index's first level holds s of each posting as one byte, rounded upward in units of UNIT; the second the exact tf.
3. The first level bounds each score from both sides. Every task keeps the K highest lower bounds of each query; the
   K-th of all tasks' is the query's threshold.
4. Every document whose upper bound reaches the threshold is rescored from the second level. A task hands on its K best
   of each query, which a ranking by query merges. So nothing but K rows for each task and query is ever shuffled,
   however many equal documents tie, and no result depends on how blocks are cut.

Queries are taken in parts of about PART bytes of text, one after another: the driver and each task hold the vocabulary of
one part. Rows of one item_id are one query with all their terms; those without id or terms have no rows in the result. Null and
empty texts have no terms and never rank. Very long texts are blocks of their own. Equal scores go by ascending doc_id, rows
without id last; rows that repeat all count and each take a rank. Either table may be empty; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_ALNUM, Words, Workspace, distinct, eight, flat, pieces, text_column, word_hashes, words
from .fm_decontam import items_of, part_count, part_numbers

K = 10
BLOCK = 1_000_000
PART = 8 << 20
#: s is at most 10**6; UNIT times 255 isn't less.
UNIT = 3922
#: Cells of the matrices that bounds are summed in.
CELLS = 2_000_000


class Queries:
    """The different terms of some queries, and each query's terms by number."""

    def __init__(self, ids: np.ndarray, text: pa.Array):
        buf, offs = flat(text)
        buf = LOWER[buf]
        starts, ends, at = words(buf, offs, NOT_ALNUM)
        u, first, back = distinct(eight(buf), starts, ends)
        raw = buf.tobytes()
        self.words = Words()
        self.words.place(u, [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())])
        self.size = len(u)
        self.ids, item = np.unique(ids, return_inverse=True)
        pairs = np.unique(np.repeat(item, np.diff(at)) * max(1, self.size) + back)
        self.term = pairs % max(1, self.size)
        self.at = np.searchsorted(pairs, np.arange(len(self.ids) + 1) * max(1, self.size))


def queries_of(items: DataFrame, k: int, parts: int) -> Queries:
    """One of the parts that the items are dealt to by hash."""
    rows = items_of(items)
    got = (rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else rows).toArrow().combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in got.columns]
    return Queries(np.asarray(columns[0]).astype(np.int64), columns[1].cast(pa.string()))


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest bytes, the first of which says how many bytes each has."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind.newbyteorder("<")).tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


_POSTINGS = "docs binary, lost binary, n binary, term array<int>, df array<int>, place binary, tf binary, n_docs long, n_terms long"


def postings(docs: DataFrame, shared) -> DataFrame:
    """One row for each block: ids and lengths of its documents, and the postings of the queries' terms, by term."""

    def run(batches):
        known = shared.value
        for b in pieces(batches, most=BLOCK):
            buf, offs = flat(b.column(1))
            buf = LOWER[buf]
            starts, ends, at = words(buf, offs, NOT_ALNUM)
            n = np.diff(at)
            load = eight(buf)
            t = known.words.find(load, starts, ends, word_hashes(load, starts, ends)) if known.size else np.full(len(starts), -1)
            place = np.repeat(np.arange(len(n)), n)[t >= 0]
            key, tf = np.unique(t[t >= 0] * len(n) + place, return_counts=True)
            term, df = np.unique(key // len(n), return_counts=True)
            ids = b.column(0)
            lost = np.asarray(ids.is_null())
            row = [np.asarray(ids.fill_null(0)).astype("<i8").tobytes(), lost.tobytes() if lost.any() else b"", pack(n)]
            row += [term, df, pack(key % len(n)), pack(tf), int((n > 0).sum()), int(n.sum())]
            kinds = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [c.split()[0] for c in _POSTINGS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, _POSTINGS)


def saturation(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """s of postings."""
    m = 100 - 90 + (90 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def with_impacts(blocks: DataFrame, docs: int, terms: int) -> DataFrame:
    """The blocks with the first level: a byte for each posting."""

    def run(batches):
        for b in batches:
            n, place, tf = (b.column(b.schema.get_field_index(c)) for c in ("n", "place", "tf"))
            impacts = []
            for i in range(b.num_rows):
                s = saturation(unpack(tf[i].as_py()), unpack(n[i].as_py())[unpack(place[i].as_py())], docs, terms)
                impacts.append((-(-s // UNIT)).astype(np.uint8).tobytes())
            yield b.append_column("impact", pa.array(impacts, pa.binary()))

    kept = blocks.select("docs", "lost", "n", "term", "df", "place", "tf")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("impact", T.BinaryType())]))


class Block:
    """One row of the index, and the queries' terms that it has."""

    def __init__(self, row: dict, queries: Queries, weights: np.ndarray):
        self.row, self.place = row, unpack(row["place"])
        term = np.asarray(row["term"], dtype=np.int64)
        self.line = np.repeat(np.arange(len(term)), np.asarray(row["df"], dtype=np.int64))
        self.weight = weights[term]
        slot = np.full(queries.size + 1, -1)
        slot[term] = np.arange(len(term))
        lines = slot[queries.term]
        have = np.concatenate([[0], np.cumsum(lines >= 0)])
        cut = have[queries.at]
        self.item = np.flatnonzero(np.diff(cut))  # queries with a term here
        self.lines, self.cut = lines[lines >= 0], np.append(cut[self.item], cut[-1])
        self.n_docs = int(self.place.max(initial=-1)) + 1

    def tiles(self):
        """(first document, past, first query, past, rows of terms, where each query's begin): matrices stay near CELLS."""
        a = 0
        while a < len(self.item):
            z = max(a + 1, int(np.searchsorted(self.cut, self.cut[a] + 16_384, "right")) - 1)
            z = min(z, len(self.item))
            rows = self.lines[self.cut[a] : self.cut[z]]
            wide = max(64, CELLS // max(len(rows), len(self.weight)))
            for d in range(0, self.n_docs, wide):
                yield d, min(d + wide, self.n_docs), a, z, rows, self.cut[a:z] - self.cut[a]
            a = z

    def matrix(self, values: np.ndarray, d: int, to: int) -> np.ndarray:
        """values of the postings, weighted, by term and document."""
        m = np.zeros((len(self.weight), to - d), dtype=np.int64)
        some = (self.place >= d) & (self.place < to)
        m[self.line[some], self.place[some] - d] = values[some] * self.weight[self.line[some]]
        return m


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}


def lower_bounds(index: DataFrame, shared, weights, k: int) -> DataFrame:
    """(item, bound): the k highest positive lower bounds of each query that each task meets."""

    def run(batches):
        queries, w = shared.value, weights.value
        best = np.zeros((len(queries.ids), k), dtype=np.int64)
        for row in _rows(batches):
            block = Block(row, queries, w)
            low = np.maximum(np.frombuffer(row["impact"], np.uint8).astype(np.int64) - 1, 0) * UNIT
            for d, to, a, z, rows, cut in block.tiles():
                sums = np.add.reduceat(block.matrix(low, d, to)[rows], cut, axis=0)
                if sums.shape[1] > k:
                    sums = np.partition(sums, sums.shape[1] - k, axis=1)[:, -k:]
                both = np.concatenate([best[block.item[a:z]], sums], axis=1)
                best[block.item[a:z]] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        item, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[item, place])], ["item", "bound"])

    return index.select("term", "df", "place", "impact").mapInArrow(run, "item long, bound long")


def best_documents(index: DataFrame, shared, weights, thresholds, docs: int, terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's k best of every query among the documents whose upper bound reaches its
    threshold, rescored exactly."""

    def run(batches):
        queries, w, least = shared.value, weights.value, np.maximum(thresholds.value, 1)
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for row in _rows(batches):
            block = Block(row, queries, w)
            high = np.frombuffer(row["impact"], np.uint8).astype(np.int64) * UNIT
            exact = None
            for d, to, a, z, rows, cut in block.tiles():
                item, doc = np.nonzero(np.add.reduceat(block.matrix(high, d, to)[rows], cut, axis=0) >= least[block.item[a:z], None])
                if not len(item):
                    continue
                if exact is None:
                    exact = saturation(unpack(row["tf"]), unpack(row["n"])[block.place], docs, terms)
                    ids = np.frombuffer(row["docs"], "<i8")
                    lost = np.frombuffer(row["lost"], bool) if row["lost"] else np.zeros(len(ids), bool)
                m = block.matrix(exact, d, to)
                at = np.searchsorted(item, np.arange(z - a + 1))
                for i in np.flatnonzero(np.diff(at)).tolist():
                    some = doc[at[i] : at[i + 1]]
                    score = m[np.ix_(rows[cut[i] : cut[i + 1] if i + 1 < len(cut) else None], some)].sum(axis=0)
                    have = best.get(int(block.item[a + i]))
                    new = score, lost[d + some], ids[d + some]
                    if have:
                        new = tuple(np.concatenate(x) for x in zip(have, new))
                    by = np.lexsort((new[2], new[1], -new[0]))[:k]
                    best[int(block.item[a + i])] = tuple(x[by] for x in new)
        item = [i for i, x in best.items() for _ in x[0]]
        score, lost, ids = (np.concatenate([x[c] for x in best.values()]) if best else np.zeros(0, t) for c, t in enumerate((np.int64, bool, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[item]), pa.array(ids, mask=lost), pa.array(score)], ["item_id", "doc_id", "score"])

    return index.select("docs", "lost", "n", "term", "df", "place", "tf", "impact").mapInArrow(run, "item_id long, doc_id long, score long").filter("score > 0")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, part: int = PART) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of docs (doc_id, text, ...) for each of items (item_id, text, ...)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "search")
    parts = part_count(items, part)
    found = []
    for number in part_numbers(items, parts):
        queries = queries_of(items, number, parts)
        shared = spark.sparkContext.broadcast(queries)
        blocks = ws.put(postings(docs, shared), f"postings-{number}", compression="zstd")
        totals = blocks.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
        n_docs, n_terms = int(totals.docs or 0), int(totals.terms or 0)
        w = np.zeros(queries.size, dtype=np.int64)
        # as many rows as the part's queries have terms
        pairs = blocks.select(F.explode(F.arrays_zip("term", "df")).alias("p")).groupBy(F.col("p.term").alias("term")).agg(F.sum(F.col("p.df").cast("long")).alias("df"))
        for r in pairs.toLocalIterator():
            w[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
        weights = spark.sparkContext.broadcast(w)
        index = ws.put(with_impacts(blocks, n_docs, max(1, n_terms)), f"index-{number}", compression="zstd")
        ws.drop(f"postings-{number}")
        order = Window.partitionBy("item").orderBy(F.desc("bound"))
        kth = lower_bounds(index, shared, weights, k).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).filter(F.col("r") == k)
        least = np.zeros(len(queries.ids), dtype=np.int64)
        for r in kth.toLocalIterator():  # one row for each of the part's queries
            least[r.item] = r.bound
        found.append(best_documents(index, shared, weights, spark.sparkContext.broadcast(least), n_docs, max(1, n_terms), k))
        if parts > 1:  # the index of a part goes before the next is made
            found[-1] = ws.put(ranked(found[-1], k).drop("rank"), f"found-{number}")
            ws.drop(f"index-{number}")
    return ranked(reduce(DataFrame.unionByName, found), k)
