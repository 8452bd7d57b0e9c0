"""What several operators share: tables in the shared folder, group look-ups that survive hot keys,
id filters of a bounded size, sizes of exchanges that follow the data, and the vectorised word scanner.

Tables are written below ``spark.checkpoint.dir`` (read from the session; in local mode, where that is unset, a
folder of our own), so they outlive any executor and cut lineage.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the rows; so there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: Keys with fewer rows than this are never hot.
HOT_LEAST = 1000
#: Arrow batches are cut into pieces of about this many text bytes before numpy arrays are made of them.
CHUNK_BYTES = 1_000_000


# ---------------------------------------------------------------- tables in the shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where driver and executors are one
    process, one of our own will do; on a cluster a machine's own folder won't, so an unset one is an error there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
        at = getattr(spark, "_strandlake_dir", None)
        if at is None:
            at = "file://" + tempfile.mkdtemp(prefix="strandlake-")
            spark._strandlake_dir = at
    return at.rstrip("/")


class Workspace:
    """Tables of one run of an operator, in a folder of their own below the shared one.

    ``put`` writes a frame and returns the written table (lineage ends there); ``drop`` deletes tables that nothing
    reads any more. What a returned frame still reads is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        """root: a folder to stay in; tables there outlive the driver."""
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/strandlake-{name}-{uuid.uuid4().hex[:12]}"
        if root is None:
            atexit.register(self.drop)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def put(self, df: DataFrame, table: str, **options) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(table))
        return self.get(table, df.schema)

    def get(self, table: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(table))

    def exists(self, table: str) -> bool:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)

    def drop(self, *tables: str) -> None:
        try:
            sc = self.spark.sparkContext
            for at in [self.path(t) for t in tables] or [self.root]:
                p = sc._jvm.org.apache.hadoop.fs.Path(at)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone when the driver ends; the folder is only litter then
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Text bytes that a bucket stands for; where that makes more than BUCKETS buckets, up to LARGER.
BUCKET, BUCKETS, LARGER = 16 << 20, 1 << 14, 64 << 20
#: Most partitions of an exchange by bucket; partitions that get several buckets hold one at a time.
PARTITIONS = 1 << 15


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0


def bucket_count(spark: SparkSession, size: int) -> int:
    """How many buckets for texts of that many bytes: a bucket's share of them stays the same as they grow."""
    return max(shuffle_parts(spark), min(size // BUCKET, BUCKETS), size // LARGER, 1)


def dealt(df: DataFrame, bucket: Column, buckets: int) -> DataFrame:
    """Rows by bucket (a number), an equal number of buckets to each partition."""
    parts = min(buckets, PARTITIONS)
    return df.repartitionById(parts, F.pmod(bucket, F.lit(parts)).cast("int"))


# ---------------------------------------------------------------- groups with hot keys
def attach_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Left-joins each row's group (unique ``key``, ``n`` rows) without sending a hot key's rows to one task.

    Groups with at least 1/HOT_SHARE of all ``total`` rows are fewer than HOT_SHARE by that very bound; they are
    broadcast and their rows stay where they are. All other rows meet their group in a sort-merge join whose
    partitions are bounded by that share.
    """
    hot = groups.filter(F.col(n) >= max(total // HOT_SHARE, HOT_LEAST))
    rest = groups.filter(F.col(n) < max(total // HOT_SHARE, HOT_LEAST))
    at_hot = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    return at_hot.unionByName(others)


# ---------------------------------------------------------------- fixed-size filter of ids
#: An id filter has FILTER_EACH bits for each id, but at least FILTER_LEAST and at most FILTER_MOST (16 MB, which is what
#: is broadcast). Beyond FILTER_MOST / 2 ids or so it lets most rows through: these are then shuffled to meet the ids, as
#: all would be without a filter; no row is lost at any size.
FILTER_EACH, FILTER_LEAST, FILTER_MOST = 8, 1 << 20, 1 << 27
_PER_MAP = 32768  # bits of one bitmap of bitmap_construct_agg


class IdFilter:
    """The hashed ids as Spark's own bitmaps, a row (bucket, bitmap) for each _PER_MAP bits that has any."""

    def __init__(self, ids: DataFrame, column: str = "doc_id", ws: Workspace | None = None, name: str = "bits", n: int | None = None):
        """n: how many ids there are about, if that is known."""
        n = ids.count() if n is None else n
        self.bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_EACH * n - 1).bit_length() if n else 0))
        bit = self.bit(column)
        maps = ids.select((bit / _PER_MAP).cast("int").alias("b"), F.pmod(bit, F.lit(_PER_MAP)).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
        self.maps = ws.put(maps, name) if ws else maps

    def bit(self, column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.bits))


def id_filter(ids: DataFrame, column: str = "doc_id", ws: Workspace | None = None, name: str = "bits", n: int | None = None) -> IdFilter:
    return IdFilter(ids, column, ws, name, n)


def free_name(df: DataFrame, stem: str) -> str:
    """A name that no column of df has."""
    names = {c.lower() for c in df.columns}
    while stem.lower() in names:
        stem += "_"
    return stem


def maybe_in(rows: DataFrame, ids: IdFilter, column: str = "doc_id", negate: bool = False) -> DataFrame:
    """Rows whose id may be in the filter (all that are, and a few more); ``negate``: the other rows, none of which
    is. The broadcast side is bounded by FILTER_MOST. All columns of rows stay, whatever their names."""
    bucket, bitmap = free_name(rows, "_sl_bucket"), free_name(rows, "_sl_map")
    bit = ids.bit(column)
    maps = ids.maps.select(F.col("b").alias(bucket), F.col("m").alias(bitmap))
    joined = rows.withColumn(bucket, (bit / _PER_MAP).cast("int")).join(F.broadcast(maps), bucket, "left")
    pos = F.pmod(bit, F.lit(_PER_MAP))
    byte = F.conv(F.hex(F.substring(bitmap, (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    power = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (pos % 8).cast("int") + 1)
    hit = F.coalesce(byte.bitwiseAND(power) != 0, F.lit(False))
    return joined.filter(~hit if negate else hit).select(*rows.columns)


def without(ws: Workspace, rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows, all their columns, whose id isn't among ``ids`` (doc_id); rows without id stay. Only rows that the
    filter suspects are shuffled to meet the ids."""
    own = free_name(rows, "_sl_id")
    gone = ws.put(ids.select(F.col("doc_id").alias(own)).filter(F.col(own).isNotNull()).distinct(), "gone")
    bits = id_filter(gone, own, ws, "gone-bits")
    suspects = maybe_in(rows, bits, column)
    kept = suspects.join(gone, suspects[column] == gone[own], "left_anti")
    return maybe_in(rows, bits, column, negate=True).unionByName(kept)


# ---------------------------------------------------------------- connected components
def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(id, component): the smallest id reachable, for each id that has an edge (a, b).

    Alternating large-star and small-star rounds, each written to the shared folder; a star's centre meets its
    neighbours through attach_groups, so a hot centre is no single task. Only counts come to the driver.
    """
    e = ws.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), f"{name}-0")
    k, last = 0, None
    while True:
        k += 1
        # large star: every larger neighbour of u hangs on the smallest of u's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        near = ws.put(near, f"{name}-{k}-near")
        total = near.agg(F.sum("n")).first()[0] or 0
        e1 = attach_groups(both, near, "u", "n", total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        e1 = ws.put(e1, f"{name}-{k}-large")
        # small star: the smaller neighbours of u, and u, hang on the smallest of them
        low = ws.put(e1.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{name}-{k}-low")
        e2 = attach_groups(e1, low, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e2 = ws.put(e2.filter("u != v").distinct(), f"{name}-{k}")
        ws.drop(f"{name}-{k}-near", f"{name}-{k}-low", f"{name}-{k}-large", f"{name}-{k - 1}")
        # a fixed point: the same edges, by an order-free digest of them
        now = e2.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        e, last = e2, tuple(now)
    return e2.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e2.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


# ---------------------------------------------------------------- Arrow batches and words
def give_back() -> None:
    """Returns freed memory to the system at a task's end: worker processes live on and would keep their peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``most`` text bytes, so that memory doesn't follow the batch; a longer text is
    a slice of its own."""
    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        if not b.num_rows:
            continue
        if b.num_rows == 1:
            yield b
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        cum, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            done = cum[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(cum, done + most, "right")))
            yield b.slice(at, to - at)
            at = to
    give_back()


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end, and where each begins (one more than there are texts); null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if col.type in (pa.large_string(), pa.large_binary()) else np.int32
    offs = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words: ASCII white space; and everything in ASCII but letters and digits.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:48] = NOT_ALNUM[58:97] = NOT_ALNUM[123:128] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n of each at least."""
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        mod = 1 << 64

        def table_of(base: int) -> np.ndarray:
            out = np.ones(size, np.uint64)
            have, step = 1, base % mod
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(step)
                have, step = 2 * have, step * step % mod
            return out

        _POW, _INV = table_of(_BASE), table_of(pow(_BASE, -1, mod))
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = the polynomial of bytes i..j-1; times the inverse power of i it is a hash of them."""
    power, _ = powers(len(buf) + 1)
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=s[1:])
    return s


def words(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts (runs of bytes that are no separators, never across texts), and for
    each text where its words begin in these (one more than there are texts)."""
    inside = ~sep[buf]
    n = len(buf)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    heads = offs[:-1]
    heads = heads[heads < n]
    start[heads] |= inside[heads]
    tails = offs[1:] - 1
    tails = tails[tails >= 0]
    end[tails] |= inside[tails]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Words of more bytes than this are hashed one by one, by a cryptographic hash.
LONG = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of buf on, as one number each (zeros beyond the end); a view of one copy."""
    return view_of(np.concatenate([buf, np.zeros(8, np.uint8)]))


def view_of(padded: np.ndarray) -> np.ndarray:
    return np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))


def word_hashes(load: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a buffer (load: its ``eight``), the same wherever they stand. Different words of up
    to seven bytes have different hashes; of longer ones equal hashes prove nothing: see ``distinct`` and ``Words``."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, np.uint64)
    h = mix((load[starts] & _MASKS[np.minimum(n, 8)]) ^ (np.minimum(n, 8).astype(np.uint64) << np.uint64(56)))
    live, k = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(live):
        h[live] = mix(h[live] * np.uint64(_BASE) + (load[starts[live] + k] & _MASKS[np.minimum(n[live] - k, 8)]))
        k += 8
        live = live[n[live] > k]
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(_raw(load, int(starts[i]), int(ends[i])), digest_size=8).digest(), "little")
    return h


def _raw(load: np.ndarray, start: int, end: int) -> bytes:
    whole = (end - start) // 8 * 8
    tail = load[start + whole : start + whole + 1].tobytes()[: end - start - whole]
    return load[start : start + whole : 8].tobytes() + tail


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from ``at`` on in one buffer are those from ``bt`` on in another (a, b: their ``eight``)."""
    out = np.ones(len(n), dtype=bool)
    live, k = np.flatnonzero((n > 0) & (n <= LONG)), 0
    while len(live):
        same = ((a[at[live] + k] ^ b[bt[live] + k]) & _MASKS[np.minimum(n[live] - k, 8)]) == 0
        out[live[~same]] = False
        k += 8
        live = live[same & (n[live] > k)]
    for i in np.flatnonzero(n > LONG).tolist():
        s, t, m = int(at[i]), int(bt[i]), int(n[i])
        out[i] = np.array_equal(a[s : s + m - 7 : 8], b[t : t + m - 7 : 8]) and a[s + m - 8] == b[t + m - 8]
    return out


def distinct(load: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words, told apart by their bytes: their hashes (sorted), an occurrence of each, and the word of each
    occurrence. Every occurrence is compared with its hash's first one, by bytes; words that differ are split."""
    u, first, back = np.unique(word_hashes(load, starts, ends), return_index=True, return_inverse=True)
    n, rep = ends - starts, first[back]
    other = n[rep] != n
    long_ = np.flatnonzero(~other & (n > 7))  # up to seven bytes the hash is the word
    other[long_] = ~same_bytes(load, starts[long_], load, starts[rep[long_]], n[long_])
    if other.any():
        more: dict[bytes, int] = {}
        places = []
        for i in np.flatnonzero(other).tolist():
            word = _raw(load, int(starts[i]), int(ends[i]))
            if word not in more:
                more[word] = len(u) + len(more)
                places.append(i)
            rep[i], back[i] = i, more[word]
        u, first = np.concatenate([u, u[np.searchsorted(u, word_hashes(load, starts[places], ends[places]))]]), np.concatenate([first, places])
        by = np.argsort(u, kind="stable")
        to = np.empty(len(by), dtype=np.int64)
        to[by] = np.arange(len(by))
        u, first, back = u[by], first[by], to[back]
    return u, first, back


class Words:
    """Words that can be looked up by hash; a hit is only one if the stored bytes are the same."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted; different words may share one
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.letters, self.end = np.zeros(1 << 12, np.uint8), 0
        self.load = view_of(self.letters)

    def find(self, load: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The place of each word among the stored ones, -1 for those that aren't."""
        n = ends - starts
        out, near = np.full(len(h), -1, dtype=np.int64), np.searchsorted(self.hashes, h)
        open_ = np.flatnonzero(near < len(self.hashes))
        while len(open_):
            open_ = open_[self.hashes[near[open_]] == h[open_]]
            e = near[open_]
            same = self.size[e] == n[open_]
            long_ = np.flatnonzero(same & (n[open_] > 7))
            same[long_] = same_bytes(load, starts[open_[long_]], self.load, self.begin[e[long_]], n[open_[long_]])
            out[open_[same]] = e[same]
            open_ = open_[~same]
            near[open_] += 1
            open_ = open_[near[open_] < len(self.hashes)]
        return out

    def place(self, h: np.ndarray, words_: list[bytes]) -> np.ndarray:
        """Adds words (h: their hashes, sorted); where they go among the hashes so far."""
        raw, n = np.frombuffer(b"".join(words_), np.uint8), np.array([len(w) for w in words_], dtype=np.int64)
        if self.end + len(raw) + 8 > len(self.letters):
            grown = np.zeros(2 * (self.end + len(raw)) + 8, np.uint8)
            grown[: self.end] = self.letters[: self.end]
            self.letters, self.load = grown, view_of(grown)
        self.letters[self.end : self.end + len(raw)] = raw
        at = np.searchsorted(self.hashes, h)
        self.hashes = np.insert(self.hashes, at, h)
        self.begin = np.insert(self.begin, at, self.end + np.cumsum(n) - n)
        self.size = np.insert(self.size, at, n)
        self.end += len(raw)
        return at


class Known(Words):
    """Words with a run of integers for each; number 0 of ``flat`` can be set aside."""

    def __init__(self, first: int = 0):
        self.first = first
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.where, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.full(1 << 16, self.first, np.uint32), 1

    def add(self, h: np.ndarray, words_: list[bytes], runs: list[bytes]) -> None:
        """h: sorted; runs: little-endian 32-bit."""
        count = np.array([len(x) // 4 for x in runs], dtype=np.int64)
        more = np.frombuffer(b"".join(runs), "<u4")
        while self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(more)] = more
        at = self.place(h, words_)
        self.where = np.insert(self.where, at, self.used + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.used += len(more)

    def runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the integers of the words at these places lie and how many they are; none for -1."""
        if not len(self.hashes):
            return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        return self.where[at], np.where(at < 0, 0, self.count[at])


def ranges(where: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """where[0], where[0] + 1, ... (count[0] of them), where[1], ...; and each run's bounds in that."""
    bounds = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(where - bounds[:-1], count) + np.arange(bounds[-1]), bounds


def text_column(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
