"""Periodic runs of words: Main-Lorentz divide and conquer over interned word ids.

A run is a stretch of consecutive words whose smallest period is q (words q apart are the same), with at least LEAST words
and at least EXPONENT periods, that no neighbouring word extends keeping period q.

Every text is halved again and again. A run that crosses a midpoint with EXPONENT periods has at least two of them on one
side, so its period is one at which the Z-function of that side (read away from the midpoint) reaches the period itself.
The nodes of one level, of all texts of a batch, are worked on together: the first SHORT words of all Z-values are found
by array comparisons, and nodes where some value goes on get their whole Z-function, in linear time. A period that
is found is extended over the whole text; what a known run of a divisor of the period covers already isn't looked at again,
so intervals come once, with their smallest period, and a text of one word a million times stays quasilinear.

Words are told apart by their bytes. A word is dropped from the collapsed text if any run holds it after that run's
first period; what stays is joined by one space. Texts are independent, so nothing is shuffled and a lost executor's
tasks just run again.

Null and empty texts have no words, no runs and an empty collapsed text. Long texts are judged whole, a slice of their own.
Ties (two runs of one start) are ordered by period. Rows that repeat give equal rows; rows without id stay; an empty table
gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, distinct, eight, flat, pieces, text_column, words

LEAST, EXPONENT = 6, 4
#: Z-values up to this many words are found by array comparisons over all nodes of a level.
SHORT = 16


def z_function(s: list[int]) -> list[int]:
    """z[i]: how many items from i on are those from 0 on."""
    n, z, left, right = len(s), [0] * len(s), 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def squares(w: np.ndarray, base: np.ndarray, step: int, room: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """(node, period), sorted: where the words read from ``base`` on (``room`` words, forward or backward) begin with
    half of a run of that period."""
    top = np.maximum(room, 0) // 2
    node = np.repeat(np.arange(len(base)), top)
    q = np.arange(len(node)) - np.repeat(np.cumsum(top) - top, top) + 1
    need = (np.maximum(least, exponent * q) + 1) // 2 - q
    fits = q + need <= room[node]
    node, q, need = node[fits], q[fits], need[fits]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(SHORT):
        if not len(node):
            break
        at = base[node] + step * t
        same = w[at] == w[at + step * q]
        node, q, need = node[same], q[same], need[same]
        full = need <= t + 1
        if full.any():
            found.append((node[full], q[full]))
            node, q, need = node[~full], q[~full], need[~full]
    if len(node):
        cut = np.flatnonzero(np.diff(node)) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(node)]):
            k = node[a]
            side = w[base[k] + step * np.arange(room[k])]
            reach = np.array(z_function(side.tolist()))
            good = reach[q[a:z]] >= need[a:z]
            found.append((node[a:z][good], q[a:z][good]))
    if not found:
        return node[:0], q[:0]
    node, q = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    by = np.lexsort((q, node))
    return node[by], q[by]


def _extend(w: np.ndarray, a: int, q: int, lo: int, hi: int) -> tuple[int, int]:
    """The longest stretch of period q, between lo and hi, around the words a .. a + 2q."""
    end, size = a + q, 64
    while end + q < hi:
        m = min(size, hi - q - end)
        other = w[end : end + m] != w[end + q : end + q + m]
        k = int(other.argmax())
        if other[k]:
            end += k
            break
        end, size = end + m, size * 4
    start, size = a, 64
    while start > lo:
        m = min(size, start - lo)
        other = (w[start - m : start] != w[start - m + q : start + q])[::-1]
        k = int(other.argmax())
        if other[k]:
            start -= k
            break
        start, size = start - m, size * 4
    return start, end + q


def find_runs(w: np.ndarray, at: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period), sorted by start and period, of each text that has any. w: word numbers of all texts;
    at: where each text's words begin. The exponent is 4 at least."""
    if exponent < 4:
        raise ValueError("halves hold two whole periods only for exponents of four and more")
    out: dict[int, list[tuple[int, int, int]]] = {}
    known: dict[tuple[int, int], list[tuple[int, int]]] = {}  # runs by text and period; such runs overlap by less than a period
    text = np.flatnonzero(np.diff(at) >= least)
    lo, hi = at[text], at[text + 1]
    while len(lo):
        mid = (lo + hi) // 2
        for base, step, room in ((mid, 1, hi - mid), (mid - 1, -1, mid - lo)):
            node, periods = squares(w, base, step, room, least, exponent)
            cut = np.flatnonzero(np.diff(node)) + 1 if len(node) else []
            for a, z in zip([0, *cut] if len(node) else [], [*cut, len(node)]):
                k, qs = int(node[a]), periods[a:z]
                t, m = int(text[k]), int(mid[k])
                while len(qs):
                    q = int(qs[0])
                    first, past = (m, m + 2 * q) if step > 0 else (m - 2 * q, m)
                    runs = known.setdefault((t, q), [])
                    near = bisect_right(runs, (first, len(w)))
                    if near and runs[near - 1][1] >= past:
                        start, end = runs[near - 1]
                    else:
                        start, end = _extend(w, first, q, int(at[t]), int(at[t + 1]))
                        if end - start >= max(least, exponent * q):
                            insort(runs, (start, end))
                            out.setdefault(t, []).append((start - int(at[t]), end - start, q))
                    # multiples of a period inside its run have that period, not their own
                    if len(qs) == 1:
                        break
                    inside = (m + 2 * qs <= end) if step > 0 else (m - 2 * qs >= start)
                    qs = qs[1:][~((qs[1:] % q == 0) & inside[1:])]
        text, lo, hi = np.concatenate([text, text]), np.concatenate([lo, mid]), np.concatenate([mid, hi])
        long_ = hi - lo >= least
        text, lo, hi = text[long_], lo[long_], hi[long_]
    for runs in out.values():
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(raw: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The text's words, joined by one space, without those that repeat a run's period."""
    have = raw.split()  # bytes.split knows just the six ASCII separators
    if runs:
        stays = np.ones(len(have), dtype=bool)
        for start, length, period in runs:
            stays[start + period : start + length] = False
        have = compress(have, stays.tolist())
    return b" ".join(have)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs (doc_id, text, ...); runs are sorted by start and period."""

    def run(batches):
        for b in pieces(batches):
            text = b.column(1)
            buf, offs = flat(text)
            starts, ends, at = words(buf, offs, SPACE)
            found = find_runs(distinct(eight(buf), starts, ends)[2], at)
            raw = buf.tobytes()
            short = [collapsed(raw[offs[i] : offs[i + 1]], found.get(i, [])) for i in range(b.num_rows)]
            rows = [[dict(zip(("start", "length", "period"), r)) for r in found.get(i, ())] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(rows, pa.list_(_RUN)), pa.array(short, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of documents whose h = crc32(doc_id as text) is a multiple of ten, the words from a on become the
    first p of these again and again: g = h div 10, a = g mod n, p = 1 + (n - a) div (3 + g mod 8), n words in all."""
    text = F.col("text").cast("string")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, g = F.size(w).cast("long"), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = (n - a).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(tail / p).cast("int"))), F.lit(1), tail)
    changed = F.array_join(F.concat(F.slice(w, F.lit(1), a), again), " ")
    return docs.select(F.col("doc_id"), F.when((h % 10 == 0) & (n > 0), changed).otherwise(text).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of periodic_runs."""

    def best(column: str) -> Column:
        return F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))[column]

    length, period = -best("l"), best("p")
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best("s").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
