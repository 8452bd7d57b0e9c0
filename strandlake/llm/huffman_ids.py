"""Token ids in binary files: canonical length-limited Huffman codes from global counts, in independent blocks.

Every text is encoded with a public byte-level BPE through the tokenizers library; an end id follows. The ids' counts
over all documents give code lengths (package-merge, at most LIMIT bits), and lengths give canonical codes. A file
holds one range of doc_id in ascending order, as rows of independent blocks; a block holds whole documents (BLOCK ids
and the rest of the document that reaches them). Within it each document starts on a byte, and every STEP ids there is a
checkpoint, the number of bits since the one before. Decoding looks LIMIT bits up in a table, at all checkpoints of a
block at once.

Block payload, little-endian: b"HUF1", documents u32, ids u64; then for all documents doc_id i64, ids u32, code
bytes u32; then checkpoints u16; then code bytes. A folder of ids holds the blocks (``files``) and the code book
(``code``: id, length), which is all that the reader needs.

Words (the pieces that the tokenizer's pattern cuts a text into) are encoded once by the library and then looked up by
hash and bytes; texts with characters outside a safe set go to the library whole. Strings of special tokens in a text are
ordinary text. Null and empty texts have the end id alone; long texts are encoded whole. Null ids come first; rows that
repeat an id (ties) stay in one file next to each other, in the order of their ids' numbers and codes. An empty table gives
no blocks and no rows. Extra columns are ignored. Files are as many as their ids ask for, about SHARD each.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Known, Workspace, distinct, eight, flat, pieces, ranges, shuffle_parts

END = 2
LIMIT = 18
BLOCK = 1 << 16
STEP = 64
#: Ids of a file, about, and most files.
SHARD, SHARDS = 1 << 22, 1 << 15
#: Words that an encoder remembers, about (some 25 MB); then it starts anew.
REMEMBER = 800_000

_L = "A-Za-zÀ-ÖØ-öø-ɏ"
#: On texts of these characters, WORDS cuts as the tokenizer's own pattern does.
UNSAFE = re.compile(f"[^\t\n\r\x20-\x7e{_L}]")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\t\n\r {_L}0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")


#: Bytes that send a text to WORDS: apostrophes and the first bytes of what UNSAFE finds.
_BAD = np.zeros(256, dtype=bool)
_BAD[:32] = _BAD[127:195] = _BAD[202:] = _BAD[39] = True
_BAD[[9, 10, 13]] = False
_BAD[128:192] = False  # second bytes
_CLASS = np.full(256, 3, dtype=np.uint8)  # white space 0, letters 1, digits 2, others 3
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
PLAIN = re.compile(f" [{_L}]+$")

#: One for each vocabulary and worker process: the words it knows serve all tasks of the process.
_ENCODERS: dict = {}


def encoder_of(path: str) -> "Encoder":
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Ids of whole chunks of texts. A byte scan cuts texts of safe characters without apostrophes as the pattern does;
    other texts are cut by WORDS, and texts with characters outside the safe set, or with the text of an added token (an id of
    its own), go to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values(), default=0) + 1, dtype=np.int64)  # bytes that each id stands for
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.known = Known(END)  # its number 0 is the end id

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, new: list[str]) -> list[bytes]:
        """Ids of each word. Words of a space and letters are encoded as one running text, which the tokenizer's pattern
        cuts before each space; the ids' widths in bytes tell where each word ends. All others are texts of their own."""
        out: list = [None] * len(new)
        plain = [k for k, w in enumerate(new) if PLAIN.match(w)]
        for lo in range(0, len(plain), 2000):
            some = plain[lo : lo + 2000]
            raw = self.library(["".join([new[k] for k in some])])[0]
            ends = np.cumsum(self.width[np.frombuffer(raw, "<u4")])
            cut = (np.searchsorted(ends, np.cumsum([len(new[k].encode()) for k in some])) + 1) * 4
            at = 0
            for k, to in zip(some, cut.tolist()):
                out[k] = raw[at:to]
                at = to
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.library([new[k] for k in rest])):
            out[k] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers, without an end."""
        ids, at = self.chunk(pa.array(texts, pa.string()))
        return [ids[a : z - 1].astype("<u4").tobytes() for a, z in zip(at[:-1], at[1:])]

    def chunk(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, an end id after each, and where each text's ids begin (one more than texts)."""
        buf, offs = flat(col)
        n = len(offs) - 1
        odd, held = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        starts, at = np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        if len(buf):
            bad = _BAD[buf]
            after = buf[1:]
            bad[:-1] |= ((buf[:-1] == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((buf[:-1] == 0xC9) & (after > 0x8F))
            odd[np.searchsorted(offs, np.flatnonzero(bad), "right") - 1] = True
            if self.added:  # an added token is cut out before all else; one that seems to cross texts does no harm
                for m in self.added.finditer(buf):
                    held[np.searchsorted(offs, [m.start(), m.end() - 1], "right") - 1] = True
                odd |= held
            cls = _CLASS[buf]
            start = np.empty(len(buf), dtype=bool)
            start[0] = True
            white = cls == 0
            start[1:] = (cls[1:] != cls[:-1]) & (white[1:] | (buf[:-1] != 32))
            start[:-1] |= white[:-1] & ~white[1:]  # the last white space before a word
            heads = offs[:-1][np.diff(offs) > 0]
            ends_ = heads[1:] - 1  # the last byte of a text has nothing after it
            tail = white[ends_] & (ends_ > np.concatenate([[0], heads[1:-1]])) if len(heads) > 1 else np.zeros(0, bool)
            if len(ends_):
                inner = ends_[tail]
                start[inner] = ~white[inner - 1]
            start[heads] = True
            starts = np.flatnonzero(start)
            at = np.searchsorted(starts, offs)
        load, ends = eight(buf), np.append(starts[1:], len(buf)) if len(starts) else starts
        u, first, back = distinct(load, starts, ends)
        if len(self.known.hashes) > REMEMBER:
            self.known.forget()
        a, z = starts[first], ends[first]
        places = self.known.find(load, a, z, u)
        new = places < 0
        if odd.any():
            # words that only odd texts have aren't looked up
            plain = np.zeros(len(u), dtype=bool)
            plain[back[np.repeat(~odd, np.diff(at))]] = True
            new &= plain
        if new.any():
            raw = buf.tobytes()
            some = [raw[i:j] for i, j in zip(a[new].tolist(), z[new].tolist())]
            self.known.add(u[new], some, self.words([w.decode() for w in some]))
            places = self.known.find(load, a, z, u)
        where, count = self.known.runs(places)
        # words in text order with an end after each text; odd texts have their end alone for now
        keep = np.repeat(~odd, np.diff(at))
        size = np.where(odd, 0, np.diff(at))
        to = np.cumsum(size)
        where = np.insert(where[back[keep]], to, 0)
        count = np.insert(count[back[keep]], to, 1)
        take, bounds = ranges(where, count)
        ids = self.known.flat[take]
        begin = bounds[np.concatenate([[0], to + np.arange(1, n + 1)])]
        if not odd.any():
            return ids, begin
        which = np.flatnonzero(odd)
        texts = [buf[offs[k] : offs[k + 1]].tobytes().decode() for k in which]
        cut = [None if held[k] or UNSAFE.search(t) else WORDS.findall(t) for k, t in zip(which, texts)]
        some = sorted({w for ws in cut if ws for w in ws})
        of = dict(zip(some, self.words(some))).__getitem__
        whole = iter(self.library([t for t, ws in zip(texts, cut) if ws is None]))
        got = [next(whole) if ws is None else b"".join(map(of, ws)) for ws in cut]
        extra = np.zeros(n, np.int64)
        extra[which] = [len(x) // 4 for x in got]
        ids = np.insert(ids, np.repeat(begin[which], extra[which]), np.frombuffer(b"".join(got), "<u4"))
        return ids, begin + np.concatenate([[0], np.cumsum(extra)])


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    out = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if 1 << limit < len(used):
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    # levels[k]: which of the merged list are leaves; packages pair neighbours of the level below
    leaf_flags = []
    package = np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, package])
        at = np.argsort(merged, kind="stable")
        leaf_flags.append(at < n)
        merged = merged[at]
        package = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    lengths = np.zeros(n, dtype=np.int64)
    for flags in reversed(leaf_flags):
        chosen = flags[:take]
        leaves = int(chosen.sum())
        lengths[:leaves] += 1
        take = 2 * (len(chosen) - leaves)
    out[order] = lengths
    return out


class Code:
    """A canonical code: codes by (length, id), the table that decodes, and both directions on arrays."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.limit = max(1, int(lengths.max(initial=0)))
        self.codes = np.zeros(len(lengths), dtype=np.uint32)
        symbols = np.flatnonzero(lengths)
        symbols = symbols[np.lexsort((symbols, lengths[symbols]))]
        code, last = 0, 0
        spans = []
        for s in symbols.tolist():
            k = int(lengths[s])
            code <<= k - last
            self.codes[s], last = code, k
            spans.append(1 << (self.limit - k))
            code += 1
        self.symbol = np.zeros(1 << self.limit, dtype=np.uint32)
        self.size = np.ones(1 << self.limit, dtype=np.uint8)
        filled = np.repeat(symbols, spans) if spans else np.zeros(0, int)
        self.symbol[: len(filled)] = filled
        self.size[: len(filled)] = lengths[filled]

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Code bytes of documents (counts: ids of each) end to end, each from a byte on; bytes of each; checkpoints."""
        if not len(ids):
            return b"", np.zeros(len(counts), np.int64), np.zeros(0, np.uint16)
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        last = np.cumsum(counts)
        doc_bits = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], last])])
        doc_bytes = (doc_bits + 7) // 8
        shift = np.concatenate([[0], np.cumsum(doc_bytes * 8 - doc_bits)[:-1]])
        at = ends - bits + np.repeat(shift, counts)
        word = self.codes[ids].astype(np.uint64) << (32 - bits - (at & 7)).astype(np.uint64)
        size = int(doc_bytes.sum())
        out = np.zeros(size + 4)
        for k in range(4):
            out += np.bincount((at >> 3) + k, weights=((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), minlength=size + 4)[: size + 4]
        # checkpoints: at the ids STEP, 2 * STEP, ... of each document
        first = last - counts
        marks = (counts - 1) // STEP
        of = np.repeat(np.arange(len(counts)), marks)
        k = np.arange(len(of)) - np.repeat(np.cumsum(marks) - marks, marks) + 1
        points = first[of] + k * STEP
        delta = at[points] - at[points - STEP]
        return out[:size].astype(np.uint8).tobytes(), doc_bytes, delta.astype("<u2")

    def decode(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray, deltas: np.ndarray) -> np.ndarray:
        """Ids of documents whose code begins at the byte ``starts``; all checkpoints advance together."""
        marks = np.maximum(counts - 1, 0) // STEP
        lanes = marks + 1
        of = np.repeat(np.arange(len(counts)), lanes)
        k = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        jump = np.zeros(len(of), dtype=np.int64)
        jump[k > 0] = deltas
        total = np.cumsum(jump)
        head = np.cumsum(lanes) - lanes
        pos = starts[of] * 8 + total - np.repeat(total[head], lanes)
        left = np.minimum(STEP, counts[of] - k * STEP)
        to = np.repeat(np.cumsum(counts) - counts, lanes) + k * STEP
        out = np.zeros(int(counts.sum()), dtype=np.uint32)
        b = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        order = np.argsort(-left, kind="stable")
        pos, left, to = pos[order], left[order], to[order]
        down = np.uint32(32 - self.limit)
        for t in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -t, "left"))
            p = pos[:live]
            peek = (window[p >> 3] << (p & 7).astype(np.uint32)) >> down
            out[to[:live] + t] = self.symbol[peek]
            pos[:live] += self.size[peek]
        return out


def block_bytes(doc_ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, deltas: list[bytes], codes: list[bytes]) -> bytes:
    head = b"HUF1" + np.uint32(len(doc_ids)).tobytes() + np.uint64(counts.sum()).tobytes()
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), *deltas, *codes])


def read_block(code: Code, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids of each, and all ids of a block."""
    if payload[:4] != b"HUF1":
        raise ValueError("not a block")
    n = int(np.frombuffer(payload, "<u4", 1, 4)[0])
    doc_ids = np.frombuffer(payload, "<i8", n, 16)
    counts = np.frombuffer(payload, "<u4", n, 16 + 8 * n).astype(np.int64)
    sizes = np.frombuffer(payload, "<u4", n, 16 + 12 * n).astype(np.int64)
    marks = int((np.maximum(counts - 1, 0) // STEP).sum())
    deltas = np.frombuffer(payload, "<u2", marks, 16 + 16 * n).astype(np.int64)
    data = np.frombuffer(payload, np.uint8, -1, 16 + 16 * n + 2 * marks)
    return doc_ids, counts, code.decode(data, np.cumsum(sizes) - sizes, counts, deltas)


_NULL = -(1 << 63)


BLOCKS = "shard int, block int, start long, payload binary"


def write_ids(docs: DataFrame, path: str, ws: Workspace) -> tuple[DataFrame, np.ndarray]:
    """Writes the files of docs (doc_id, text, ...) and the code book into ws; returns their table (shard, block, start,
    payload) and the code lengths."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def encode(batches):
        e = encoder_of(path)
        for b in pieces(batches):
            ids, at = e.chunk(b.column(1))
            data = pa.py_buffer(ids.astype(f"<u{wide}").tobytes())
            cells = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * wide).astype(np.int32).tobytes()), data])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), cells], ["doc_id", "n", "ids"])

    from tokenizers import Tokenizer

    vocab = max(Tokenizer.from_file(path).get_vocab_size(), END + 1)
    wide = 2 if vocab <= 1 << 16 else 4
    ids = ws.put(rows.mapInArrow(encode, "doc_id long, n long, ids binary"), "ids", compression="zstd")

    shards = max(8, shuffle_parts(spark), min(SHARDS, (ids.agg(F.sum("n")).first()[0] or 0) // SHARD))
    bounds = np.unique(np.array(ids.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.1 / shards) or [], dtype=np.float64)).astype(np.int64)

    def count(batches):
        by_id, by_shard = np.zeros(vocab, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            raw = b"".join(b.column(2).to_pylist())
            by_id += np.bincount(np.frombuffer(raw, f"<u{wide}"), minlength=vocab)
            by_shard += np.bincount(np.searchsorted(bounds, np.asarray(b.column(0)), "right"), weights=np.asarray(b.column(1)), minlength=len(by_shard)).astype(np.int64)
        k, s = np.flatnonzero(by_id), np.flatnonzero(by_shard)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(len(k), bool), np.ones(len(s), bool)])), pa.array(np.concatenate([k, s])), pa.array(np.concatenate([by_id[k], by_shard[s]]))], ["shard", "k", "n"])

    # at most vocabulary + shards rows come to the driver
    got = ids.mapInArrow(count, "shard boolean, k long, n long").groupBy("shard", "k").agg(F.sum("n").alias("n")).toPandas()
    counts, shard_counts = np.zeros(vocab, np.int64), np.zeros(len(bounds) + 1, np.int64)
    of_id, of_shard = got[~got["shard"].astype(bool)], got[got["shard"].astype(bool)]
    counts[of_id["k"].astype(int)], shard_counts[of_shard["k"].astype(int)] = of_id["n"], of_shard["n"]
    first = np.cumsum(shard_counts) - shard_counts
    lengths = code_lengths(counts, max(LIMIT, int(vocab - 1).bit_length() + 1))
    spark.createDataFrame([(int(k), int(lengths[k])) for k in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.mode("overwrite").parquet(ws.path("code"))
    shared = spark.sparkContext.broadcast(lengths)  # as long as the vocabulary

    def code_rows(batches):
        code = Code(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                c = b.slice(lo, 512)
                n = np.asarray(c.column(1))
                data, sizes, deltas = code.encode(np.frombuffer(b"".join(c.column(2).to_pylist()), f"<u{wide}").astype(np.int64), n)
                cut, marks = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0) // STEP)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(bounds, np.asarray(c.column(0)), "right").astype(np.int32)), c.column(0), c.column(1)]
                    + [pa.array([deltas[marks[i] : marks[i + 1]].tobytes() for i in range(len(n))], pa.binary()), pa.array([data[cut[i] : cut[i + 1]] for i in range(len(n))], pa.binary())],
                    ["shard", "doc_id", "n", "marks", "code"],
                )

    def blocks(batches):
        held: list = []
        shard, block, start, size = None, 0, 0, 0

        def out():
            ids_, n, marks, codes = zip(*held)
            n = np.array(n, dtype=np.int64)
            payload = block_bytes(np.array(ids_, dtype=np.int64), n, np.array([len(x) for x in codes]), list(marks), list(codes))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([payload], pa.binary())], ["shard", "block", "start", "payload"])

        for b in batches:
            for s, d, n, m, c in zip(*(b.column(k).to_pylist() for k in range(5))):
                if held and (s != shard or size >= BLOCK):
                    yield out()
                    start, block, held, size = start + size, block + 1, [], 0
                if s != shard:
                    shard, block, start = s, 0, int(first[s])
                held.append((d, n, m, c))
                size += n
        if held:
            yield out()

    coded = ids.mapInArrow(code_rows, "shard int, doc_id long, n long, marks binary, code binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n", "code")
    files = ws.put(coded.mapInArrow(blocks, BLOCKS), "files", compression="uncompressed")
    ws.drop("ids")
    return files, lengths


def read_ids(files: DataFrame, lengths: np.ndarray, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    shared = files.sparkSession.sparkContext.broadcast(lengths)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        code = Code(shared.value)
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc_ids, counts, ids = read_block(code, payload)
                cut = np.concatenate([[0], np.cumsum(counts)])
                ids = ids.astype("<u4")
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(cut[:-1], cut[1:])]
                cols = [pa.array(doc_ids, mask=doc_ids == _NULL), pa.array(start + cut[:-1]), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return files.select("start", "payload").mapInArrow(run, schema)


def load_ids(spark: SparkSession, at: str, with_ids: bool = False) -> DataFrame:
    """The documents of a folder that ``encode_documents`` has written; needs nothing but its files."""
    book = spark.read.schema("id int, length int").parquet(f"{at}/code").toArrow()  # at most a row for each id of the vocabulary
    ids, length = book.column(0).to_numpy(), book.column(1).to_numpy()
    lengths = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    lengths[ids] = length
    return read_ids(spark.read.schema(BLOCKS).parquet(f"{at}/files"), lengths, with_ids)


def encode_documents(docs: DataFrame, path: str, out: str | None = None) -> DataFrame:
    """Writes all documents into the folder ``out`` and reads its files back. Without ``out`` the folder is a temporary one
    in the shared folder, deleted when the driver ends."""
    ws = Workspace(docs.sparkSession, "huffman", out)
    write_ids(docs, path, ws)
    return load_ids(docs.sparkSession, ws.root)
