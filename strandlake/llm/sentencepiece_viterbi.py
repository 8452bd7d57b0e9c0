"""SentencePiece encoding and decoding by a shared-prefix forward pass (Viterbi's recursion over a trie of words).

A text gets the model's dummy space before it and is cut into marked words: a run of spaces with what follows up to the
next space, and line feeds (no piece reaches across those cuts). The different words of a chunk, sorted, are the
depth-first order of their trie: the forward states of a word's prefix that it shares with the word before are kept, and
only the rest is worked out. Each position's state is the last piece of the prefix's best encoding, and a back pointer.

What is best is the model's own rule. For a unigram model it is the highest sum of piece scores (of equal sums, the one
whose last piece is longest, and so on). For a BPE model it is the result of merging by falling score. That is no sum of
scores, but it is a path through the same lattice: a sequence of pieces is an encoding exactly if every two neighbours
encode to themselves, and an encoding's prefixes are the encodings of the prefixes, so each position has one piece
that is compatible with the state it extends. Compatibility of two pieces is worked out once and remembered.

A character that no piece covers becomes its UTF-8 bytes' pieces. Decoding joins the pieces, puts spaces for marks and
drops the dummy space. encode and decode are exact inverses on every text: a literal mark character in a text is encoded
by its bytes. Null and empty texts have no pieces. Rows that repeat have the same result; ties between pieces don't
arise under a model's own rule; long texts are cut into words and encoded whole. An empty table gives no rows. Extra
columns are ignored; nothing is capped.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, distinct, eight, flat, pieces, ranges

CHUNK = 1_000_000
#: Words that a process remembers, about (some 20 MB); then it starts anew.
REMEMBER = 600_000
#: How much less a character without a piece scores than the worst piece.
UNKNOWN = 10.0
#: Pairs of pieces that a process remembers at most; then it starts anew.
PAIRS = 300_000


def shared(a: str, b: str) -> int:
    """Characters of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


#: One for each model and worker process: what it has learnt about pairs serves all tasks of the process.
_MODELS: dict = {}


def model_of(path: str, merges: bool) -> Pieces:
    if (path, merges) not in _MODELS:
        _MODELS[path, merges] = Pieces(path, merges)
    m = _MODELS[path, merges]
    if len(m.pairs) > PAIRS:
        m.pairs.clear()
    return m


class Pieces:
    """A model's vocabulary: pieces with spaces for marks, their ids and scores, and the byte pieces."""

    def __init__(self, path: str, merges: bool = True):
        """merges: a BPE model; else a unigram model."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.merges = merges
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes = [0] * 256
        self.surface = [b""] * m.get_piece_size()
        for i in range(m.get_piece_size()):
            if m.is_byte(i):
                b = int(m.id_to_piece(i)[1:-1], 16)
                self.bytes[b], self.surface[i] = i, bytes([b])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                p = m.id_to_piece(i).replace("▁", " ")
                self.scores[p], self.surface[i] = (m.get_score(i), i), p.encode()
        self.ids = {p: i for p, (_, i) in self.scores.items()}
        self.longest = max(map(len, self.scores))
        self.unknown = min(s for s, _ in self.scores.values()) - UNKNOWN
        self.pairs: dict[int, bool] = {}
        self.known = Known()
        self.sizes = np.array([len(x) for x in self.surface], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(self.surface), np.uint8)

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b by falling score, leftmost first, never joins across their border."""
        get = self.scores.get
        parts, border = [*a, *b], len(a)
        joined = [get(x + y) for x, y in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for k, x in enumerate(joined):
                if x is not None and (best is None or x[0] > best):
                    best, at = x[0], k
            if at < 0:
                return True
            if at + 1 == border:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            border -= at + 1 < border
            joined[at : at + 1] = []
            if at:
                joined[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(joined):
                joined[at] = get(parts[at] + parts[at + 1])

    def merged(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian 32-bit) of each of the words, which are different and sorted, by the BPE rule."""
        get, longest, pairs = self.ids.get, self.longest, self.pairs
        known = pairs.get
        last, back = [-1], [0]  # of each prefix: the id of its encoding's last piece (-1: none, or a character without)
        out: dict[str, bytes] = {}
        before = ""
        for w in words:
            k = shared(w, before)
            del last[k + 1 :], back[k + 1 :]
            for j in range(k + 1, len(w) + 1):
                for i in range(j - longest if j > longest else 0, j):
                    piece = get(w[i:j])
                    if piece is not None:
                        left = last[i]
                        if left < 0:
                            break
                        pair = left << 32 | piece
                        fits = known(pair)
                        if fits is None:
                            fits = pairs[pair] = self.compatible(w[back[i] : i], w[i:j])
                        if fits:
                            break
                else:
                    i, piece = j - 1, -1
                last.append(piece)
                back.append(i)
            out[w] = self.trace(w, last, back)
            before = w
        return out

    def trace(self, w: str, last: list[int], back: list[int]) -> bytes:
        path, j = [], len(w)
        while j:
            if last[j] < 0:
                path.extend(self.bytes[b] for b in reversed(w[back[j] : j].encode()))
            else:
                path.append(last[j])
            j = back[j]
        path.reverse()
        return array("i", path).tobytes()

    def scored(self, words: list[str]) -> dict[str, bytes]:
        """As merged, by the highest sum of scores."""
        get, longest, unknown = self.scores.get, self.longest, self.unknown
        best, last, back = [0.0], [-1], [0]
        out: dict[str, bytes] = {}
        before = ""
        for w in words:
            k = shared(w, before)
            del best[k + 1 :], last[k + 1 :], back[k + 1 :]
            for j in range(k + 1, len(w) + 1):
                top, at, what = None, j - 1, -1
                for i in range(j - longest if j > longest else 0, j):
                    got = get(w[i:j])
                    if got is not None:
                        s = best[i] + got[0]
                        if top is None or s > top:
                            top, at, what = s, i, got[1]
                if w[j - 1] not in self.scores and (top is None or best[j - 1] + unknown > top):
                    top, at, what = best[j - 1] + unknown, j - 1, -1
                best.append(top)
                last.append(what)
                back.append(at)
            out[w] = self.trace(w, last, back)
            before = w
        return out

    def segment(self, words: list[str]) -> dict[str, bytes]:
        return self.merged(words) if self.merges else self.scored(words)

    def chunk(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin (one more than there are texts). Words that the
        process knows are looked up (by hash and bytes); the others are sorted into a trie and segmented."""
        buf, offs = flat(col)
        full = np.diff(offs) > 0
        buf = np.insert(buf, offs[:-1][full], 32)  # the dummy space
        offs = offs + np.concatenate([[0], np.cumsum(full)])
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        space, feed = buf == 32, buf == 10
        start = feed.copy()
        start[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
        start[offs[:-1][full]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(buf))
        at = np.searchsorted(starts, offs)
        load = eight(buf)
        u, first, back = distinct(load, starts, ends)
        if len(self.known.hashes) > REMEMBER:
            self.known.forget()
        a, z = starts[first], ends[first]
        places = self.known.find(load, a, z, u)
        new = places < 0
        if new.any():
            raw = buf.tobytes()
            some = [raw[i:j] for i, j in zip(a[new].tolist(), z[new].tolist())]
            got = self.segment(sorted(w.decode() for w in some))
            self.known.add(u[new], some, [got[w.decode()] for w in some])
            places = self.known.find(load, a, z, u)
        where, count = self.known.runs(places)
        take, bounds = ranges(where[back], count[back])
        return self.known.flat[take], bounds[at]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self.chunk(pa.array(texts, pa.string()))
        return [ids[a:z].astype("<i4").tobytes() for a, z in zip(at[:-1], at[1:])]

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the texts end to end, without their dummy spaces, and where each begins."""
        take, bounds = ranges(self.begins[ids], self.sizes[ids])
        bounds = bounds[at]
        keep = np.ones(len(take), dtype=bool)
        keep[bounds[:-1][np.diff(bounds) > 0]] = False
        return self.letters[take[keep]], bounds - np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of one text."""
        return self.decoded(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))[0].tobytes()


def encode(docs: DataFrame, path: str, merges: bool = True) -> DataFrame:
    """(doc_id, n_pieces, pieces, pieces_crc32) for every row of docs (doc_id, text, ...)."""
    return _run(docs, path, merges, False)


def encode_decode(docs: DataFrame, path: str, merges: bool = True) -> DataFrame:
    """Also (round_trip, decoded_sha256): the pieces decoded again, compared with the text."""
    return _run(docs, path, merges, True)


def _run(docs: DataFrame, path: str, merges: bool, decoded: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_pieces long, pieces array<int>, pieces_crc32 long" + (", round_trip boolean, decoded_sha256 string" if decoded else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        model = model_of(path, merges)
        for b in pieces(batches, most=CHUNK):
            ids, at = model.chunk(b.column(1))
            ids = ids.astype("<i4")
            cols = [b.column(0), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array([zlib.crc32(ids[a:z].tobytes()) for a, z in zip(at[:-1], at[1:])], pa.int64())]
            if decoded:
                back, cut = model.decoded(ids, at)
                text, offs = flat(b.column(1))
                texts = [(back[a:z].tobytes(), text[c:e].tobytes()) for a, z, c, e in zip(cut[:-1], cut[1:], offs[:-1], offs[1:])]
                cols += [pa.array([x == y for x, y in texts]), pa.array([hashlib.sha256(x).hexdigest() for x, _ in texts])]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, schema)
