"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

The vocabulary's pieces (and every single byte) cover a marked word, its bytes after one marker, in many ways. Each
language has a probability for every piece; a forward pass over the byte positions sums the probability of all
segmentations of a word, for all languages at once and rescaled so that no word underflows, and a text's score is the sum
of its words' logarithms plus the logarithm of the language's share. Words and pieces are told apart by their bytes.
Probabilities come from expected piece counts: a forward and a backward pass over the training words under a uniform
prior over pieces, whose posterior counts are added up per language and smoothed.

Languages are learnt from rows with a lang whose crc32(doc_id as text) mod 4 is not 2: all of them up to about SAMPLE
rows a language, else those with the smallest hashes in expectation SAMPLE. lang, source and doc_id are no inputs of a
prediction. A text that is null or has no letter is `und` with score 0; so is every text if nothing could be learnt.
Words of any length are scored whole, with one marker; those over APART bytes one by one (texts in scripts without spaces
are such words), at some bytes of memory per byte of the word and language. Ties go to the alphabetically first language.
Rows that repeat get the same prediction; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, distinct, eight, flat, pieces, word_hashes, words
from .quality import held_out

SAMPLE = 2000
#: Words over so many bytes are worked out one by one.
APART = 96
#: Most languages that are learnt; more raise an error, as the counts' table is languages times vocabulary.
LANGUAGES = 1000
SMOOTH = 0.05
#: Each byte's factor keeps products near 1; it is the same for every segmentation of a word.
PER_BYTE = 24.0
MARK = 32
#: Forward sums outside of this range are scaled to 1 and their logarithm is kept, so that no word underflows.
LOW, HIGH = 1e-60, 1e60


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model as bytes, with one marker byte in place of the mark; then single bytes."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(m.get_piece_size()):
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)):
            p = m.id_to_piece(i).encode().replace("▁".encode(), bytes([MARK]))
            if len(p) > 1 and not p.startswith(bytes([MARK, MARK])):
                out.append(p)
    return sorted(set(out)) + [bytes([b]) for b in range(256)]


class Lattice:
    """Finds the pieces that end at each position of many words at once."""

    def __init__(self, pieces_: list[bytes]):
        self.n, self.longest = len(pieces_), max(map(len, pieces_))
        self.singles = self.n - 256
        self.lengths = sorted({len(p) for p in pieces_})
        # for each length the pieces by hash; a hit counts if the bytes are the same
        self.of: dict[int, tuple[Words, np.ndarray]] = {}
        for k in self.lengths[1:]:
            some = [i for i in range(self.singles) if len(pieces_[i]) == k]
            raw = np.frombuffer(b"".join(pieces_[i] for i in some), np.uint8)
            starts = np.arange(len(some)) * k
            h = word_hashes(eight(raw), starts, starts + k)
            by = np.argsort(h, kind="stable")
            held = Words()
            held.place(h[by], [pieces_[some[i]] for i in by])
            self.of[k] = held, np.array(some)[by]
            self.slots(k, h[by])

    def slots(self, k: int, h: np.ndarray) -> None:
        """A filter of the hashes' lowest bits, so that few places need a search."""
        bits = self.__dict__.setdefault("bits", {})
        bits[k] = np.zeros(1 << 20, dtype=bool)
        bits[k][(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, load: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places begin a piece of k bytes, and its number."""
        h = word_hashes(load, at, at + k)
        maybe = np.flatnonzero(self.bits[k][(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        held, number = self.of[k]
        got = held.find(load, at[maybe], at[maybe] + k, h[maybe])
        hit = got >= 0
        return maybe[hit], number[got[hit]]

    def edges(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray):
        """Words sorted by falling length. Yields for each end position j the edges (rows, from, piece)."""
        load = eight(buf)
        for j in range(1, int(lens[0]) + 1 if len(lens) else 1):
            live = int(np.searchsorted(-lens, -j, "right"))
            here = starts[:live]
            found = [(np.arange(live), j - 1, self.singles + buf[here + j - 1].astype(np.int64))]
            for k in self.lengths[1:]:
                if k > j:
                    break
                rows, ids = self.find(load, here + (j - k), k)
                if len(rows):
                    found.append((rows, j - k, ids))
            yield j, found

    def word_edges(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All edges of one word in order of their ends: ends, from, piece; and where each end's edges begin."""
        load, n = eight(word), len(word)
        end, frm, piece = [np.arange(1, n + 1)], [np.arange(n)], [self.singles + word.astype(np.int64)]
        for k in self.lengths[1:]:
            if k > n:
                break
            a, ids = self.find(load, np.arange(n - k + 1), k)
            end.append(a + k)
            frm.append(a)
            piece.append(ids)
        end, frm, piece = np.concatenate(end), np.concatenate(frm), np.concatenate(piece)
        by = np.argsort(end, kind="stable")
        end, frm, piece = end[by], frm[by], piece[by]
        return end, frm, piece, np.searchsorted(end, np.arange(1, n + 2))


def marked(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A buffer in which each word has the marker before it; words' starts in it and their lengths, falling; the order."""
    lens = ends - starts + 1
    order = np.argsort(-lens, kind="stable")
    lens, src = lens[order], starts[order]
    at = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(lens) else np.zeros(0, np.int64)
    idx = np.arange(int(lens.sum())) - np.repeat(at, lens) - 1 + np.repeat(src, lens)
    out = buf[np.maximum(idx, 0)] if len(idx) else np.zeros(0, np.uint8)
    out[at] = MARK
    return out, at, lens, order


def distinct_words(buf: np.ndarray, offs: np.ndarray):
    """Different words of a chunk: starts, ends, for each occurrence its word, and the texts' bounds."""
    starts, ends, at = words(buf, offs, SPACE)
    _, first, back = distinct(eight(buf), starts, ends)
    return starts[first], ends[first], back, at


def blocks(lens: np.ndarray, width: int):
    """Bounds of blocks of words (lengths falling) whose forward tables have at most 2 million numbers, or one word."""
    lo = 0
    while lo < len(lens):
        hi = min(len(lens), lo + max(1, min(20_000, 2_000_000 // ((int(lens[lo]) + 1) * width))))
        yield lo, hi
        lo = hi


class Model:
    def __init__(self, langs: list[str], prior: np.ndarray, probability: np.ndarray, lattice: Lattice):
        self.langs, self.prior, self.lattice = langs, prior, lattice
        self.probability = probability  # pieces x languages

    def log_words(self, buf, starts, ends) -> np.ndarray:
        """log P(word | language), up to the same constant for all languages, for each word."""
        out = np.zeros((len(starts), len(self.langs)))
        far = np.flatnonzero(ends - starts > APART)
        for k in far.tolist():
            out[k] = self.log_word(np.concatenate([[np.uint8(MARK)], buf[starts[k] : ends[k]]]))
        near = np.flatnonzero(ends - starts <= APART)
        if not len(near):
            return out
        m, at, lens, order = marked(buf, starts[near], ends[near])
        score = np.zeros((len(near), len(self.langs)))
        for lo, hi in blocks(lens, len(self.langs)):
            n, longest = hi - lo, int(lens[lo])
            alpha = np.zeros((longest + 1, n, len(self.langs)))
            alpha[0] = 1.0
            shift = np.zeros((n, len(self.langs)))
            base = at[lo]
            for j, found in self.lattice.edges(m[base : at[hi - 1] + lens[hi - 1]], at[lo:hi] - base, lens[lo:hi]):
                for rows, i, ids in found:
                    alpha[j, rows] += alpha[i, rows] * self.probability[ids]
                live = alpha[j, : len(found[0][0])]  # single bytes reach all words that are as long
                r, k = np.nonzero((live < LOW) | (live > HIGH))
                if len(r):
                    by = live[r, k]
                    shift[r, k] += np.log(by)
                    alpha[max(0, j - self.lattice.longest) : j + 1, r, k] /= by
            score[lo:hi] = np.log(alpha[lens[lo:hi], np.arange(n)]) + shift
        out[near[order]] = score
        return out

    def log_word(self, word: np.ndarray) -> np.ndarray:
        """The same for one marked word of any length, byte by byte."""
        _, frm, piece, cut = self.lattice.word_edges(word)
        alpha, shift = np.zeros((len(word) + 1, len(self.langs))), np.zeros(len(self.langs))
        alpha[0] = 1.0
        cut = cut.tolist()
        for j in range(1, len(word) + 1):
            a, z = cut[j - 1], cut[j]
            now = (alpha[frm[a:z]] * self.probability[piece[a:z]]).sum(axis=0)
            if now.min() < LOW or now.max() > HIGH:
                shift += np.log(now)
                alpha[max(0, j - self.lattice.longest) : j] /= now
                now = np.ones(len(now))
            alpha[j] = now
        return np.log(alpha[len(word)]) + shift

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        buf, offs = flat(col)
        n = len(offs) - 1
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        s, e, back, at = distinct_words(buf, offs)
        logs = self.log_words(buf, s, e)
        c = np.zeros((len(back) + 1, len(self.langs)))
        np.cumsum(logs[back], axis=0, out=c[1:])
        total = c[at[1:]] - c[at[:-1]] + self.prior
        total -= total.max(axis=1, keepdims=True)
        share = np.exp(total)
        share /= share.sum(axis=1, keepdims=True)
        best = np.argmax(share, axis=1)
        ascii_letter = ((buf >= 97) & (buf <= 122)) | ((buf >= 65) & (buf <= 90))
        letters = np.concatenate([[0], np.cumsum(ascii_letter)])
        some = letters[offs[1:]] > letters[offs[:-1]]
        other = np.concatenate([[0], np.cumsum(buf >= 128)])
        for k in np.flatnonzero(~some & (other[offs[1:]] > other[offs[:-1]])):
            some[k] = any(ch.isalpha() for ch in buf[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace"))
        return [self.langs[b] if ok else "und" for b, ok in zip(best, some)], np.where(some, share[np.arange(n), best], 0.0)


def expected(lattice: Lattice, buf, starts, ends, weight: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces (rows of weight: one column for each language) under the uniform prior."""
    total = np.zeros((lattice.n, weight.shape[1]))
    uniform = [PER_BYTE**k / lattice.n for k in range(lattice.longest + 1)]
    for k in np.flatnonzero(ends - starts > APART).tolist():
        piece, post = expected_word(lattice, np.concatenate([[np.uint8(MARK)], buf[starts[k] : ends[k]]]), np.array(uniform))
        count = np.bincount(piece, weights=post, minlength=lattice.n)
        total += count[:, None] * weight[k]
    near = np.flatnonzero(ends - starts <= APART)
    m, at, lens, order = marked(buf, starts[near], ends[near])
    for lo, hi in blocks(lens, 2):
        n, longest, base = hi - lo, int(lens[lo]), at[lo]
        w = weight[near[order[lo:hi]]]
        steps = list(lattice.edges(m[base : at[hi - 1] + lens[hi - 1]], at[lo:hi] - base, lens[lo:hi]))
        alpha, beta, scale = np.zeros((longest + 1, n)), np.zeros((longest + 1, n)), np.zeros((longest + 1, n))
        alpha[0] = 1.0
        moved = longest + 1  # the first position that is scaled
        for j, found in steps:
            scale[j] = scale[j - 1]
            for rows, i, _ in found:
                step = alpha[i, rows] * uniform[j - i]
                alpha[j, rows] += step * np.exp(scale[i, rows] - scale[j, rows]) if j > moved else step
            far = np.flatnonzero(((alpha[j] < LOW) & (alpha[j] > 0)) | (alpha[j] > HIGH))  # 0 where a word has ended
            if len(far):
                moved = min(moved, j)
                scale[j, far] += np.log(alpha[j, far])
                alpha[j, far] = 1.0
        whole = alpha[lens[lo:hi], np.arange(n)]
        beta[lens[lo:hi], np.arange(n)] = 1.0 / whole
        for j, found in reversed(steps):
            for rows, i, ids in found:
                back = beta[j, rows] * uniform[j - i]
                if j >= moved:
                    back *= np.exp(scale[i, rows] - scale[j, rows])
                beta[i, rows] += back
                post = alpha[i, rows] * back
                for k in range(w.shape[1]):
                    total[:, k] += np.bincount(ids, weights=post * w[rows, k], minlength=lattice.n)
    return total


def expected_word(lattice: Lattice, word: np.ndarray, uniform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of one marked word of any length and the posterior of each edge."""
    end, frm, piece, cut = lattice.word_edges(word)
    step, n = uniform[end - frm], len(word)
    alpha, scale, beta = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    alpha[0] = 1.0
    bounds = cut.tolist()
    for j in range(1, n + 1):
        e = slice(bounds[j - 1], bounds[j])
        f = frm[e]
        scale[j] = scale[j - 1]
        now = float((alpha[f] * step[e] * np.exp(scale[f] - scale[j])).sum())
        if not LOW < now < HIGH:
            scale[j] += np.log(now)
            now = 1.0
        alpha[j] = now
    post = np.zeros(len(end))
    beta[n] = 1.0 / alpha[n]
    for j in range(n, 0, -1):
        e = slice(bounds[j - 1], bounds[j])
        f = frm[e]
        back = beta[j] * step[e] * np.exp(scale[f] - scale[j])
        beta[f] += back  # each from place once
        post[e] = alpha[f] * back
    return piece, post


def fit(docs: DataFrame, vocab_path: str) -> Model:
    rows = docs.filter(~F.coalesce(held_out(), F.lit(False))).filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted(counts)
    pieces_ = vocabulary(vocab_path)
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, 0)), Lattice(pieces_))
    part = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, SAMPLE / counts[lang]))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < part[F.col("lang")] * 1_000_000)

    def count(batches):
        lattice = Lattice(vocabulary(vocab_path))
        total = np.zeros((lattice.n, len(langs)))
        seen = False
        for b in pieces(batches):
            seen = True
            buf, offs = flat(b.column(1))
            s, e, back, at = distinct_words(buf, offs)
            which = np.array([langs.index(x) for x in b.column(0).to_pylist()])
            of = np.repeat(which, np.diff(at))
            weight = np.bincount(back * len(langs) + of, minlength=len(s) * len(langs)).reshape(len(s), len(langs)).astype(float)
            total += expected(lattice, buf, s, e, weight)
        if seen:
            piece, lang = np.nonzero(total > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, lang])], ["lang", "piece", "n"])

    # at most languages x vocabulary rows come to the driver
    got = sample.select("lang", "text").mapInArrow(count, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    total = np.full((len(pieces_), len(langs)), SMOOTH)
    total[got["piece"], got["lang"]] += got["n"]
    size = np.array([[PER_BYTE ** len(p)] for p in pieces_])
    n = np.array([counts[x] for x in langs], dtype=float)
    return Model(langs, np.log(n / n.sum()), total / total.sum(axis=0) * size, Lattice(pieces_))


def language(docs: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang, ...)."""
    model = fit(docs, vocab_path)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages: no larger with more rows

    def run(batches):
        m = shared.value
        for b in pieces(batches):
            lang, score = m.predict(b.column(2))
            lang = [x if ok else "und" for x, ok in zip(lang, b.column(2).is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
