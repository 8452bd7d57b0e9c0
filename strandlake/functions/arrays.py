"""Array expressions (higher-order functions), for the ragged columns kept as one array per read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ragged(line: Column, kind: str = "double", sep: str = ",") -> Column:
    """One line of a ragged matrix; a trailing separator gives no element."""
    return F.transform(F.filter(F.split(F.rtrim(line), sep), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast(kind))


def keyed(values: Column) -> tuple[Column, Column]:
    """First element as the read's number, and the rest."""
    return F.element_at(values, 1), F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))


def every_second(a: Column, start: int) -> Column:
    return F.filter(a, lambda _, i: i % 2 == start)


def inner(a: Column) -> Column:
    """Without first and last element."""
    return F.when(F.size(a) > 2, F.slice(a, F.lit(2), F.size(a) - 2)).otherwise(F.slice(a, 1, 0))


def difference(a: Column) -> Column:
    """a[i + 1] - a[i]."""
    return F.zip_with(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda y, x: y - x)


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once: in a lambda a plain expression is worked out again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def state_border(states: Column) -> Column:
    """0, every index where a 0/1 state changes, and the length: sorted."""

    def border(s: Column) -> Column:
        changes = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) != F.get(s, i - 1))
        changes = F.when(F.size(s) > 1, changes).otherwise(F.array().cast("array<int>"))
        return F.array_sort(F.concat(F.array(F.lit(0)), changes, F.array(F.size(s))))

    return bound(states, border)


def base_ends(states: Column) -> Column:
    """Leading and trailing runs of state 1 become 0, so that both ends are base; all ones become zeros."""

    def based(s: Column) -> Column:
        ends = F.struct((F.array_position(s, 0) - 1).alias("first"), (F.size(s) - F.array_position(F.reverse(s), 0)).alias("last"))
        inside = lambda e: F.transform(s, lambda x, i: F.when((e["first"] < 0) | (i < e["first"]) | (i > e["last"]), x * 0).otherwise(x))
        return bound(ends, inside)

    return bound(states, based)


def border_blocks(border: Column, transitions: bool = False) -> Column:
    """Base blocks (pairs from even places) or the transitions between them."""

    def blocks(b: Column) -> Column:
        n = (F.size(b) / 2).cast("int")
        if transitions:
            pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get(b, 2 * i - 1).alias("start"), F.get(b, 2 * i).alias("end")))
            return F.when(n > 1, pairs).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(b, 2 * i).alias("start"), F.get(b, 2 * i + 1).alias("end")))

    return bound(border, blocks)


def valid_border(border: Column) -> Column:
    """Even length, first element 0, strictly rising."""
    return (F.size(border) % 2 == 0) & (F.get(border, F.lit(0)) == 0) & F.forall(difference(border), lambda d: d > 0)


def valid_states(states: Column) -> Column:
    """First state 1 to 4, all others 0 to 4."""
    return F.get(states, F.lit(0)).between(1, 4) & F.forall(states, lambda s: s.between(0, 4))


def blocks_in_range(blocks: Column, low: Column, high: Column) -> Column:
    """Blocks whose start lies in [low, high]."""
    return F.filter(blocks, lambda b: b["start"].between(low, high))


def consistent_blocks(blocks: Column) -> Column:
    """start + len <= end for every block."""
    return F.forall(blocks, lambda b: b["start"] + b["len"] <= b["end"])


#: Letters of a slice of a sequence: a substring is found by walking from the beginning of what it is cut from.
SLICE = 256


def kmers_of(seq: Column, k: int = 5, each=lambda kmer, place: kmer) -> Column:
    """The k-mers of a sequence in order, in time proportional to its length: it is cut into slices that overlap by k - 1.
    ``each`` makes an element of a k-mer and its place."""
    starts = F.when(F.length(seq) >= k, F.sequence(F.lit(0), F.length(seq) - k, F.lit(SLICE))).otherwise(F.array().cast("array<int>"))
    slices = F.transform(starts, lambda s: F.struct(s.alias("at"), F.substring(seq, s + 1, F.lit(SLICE + k - 1)).alias("part")))
    return F.flatten(F.transform(slices, lambda x: F.transform(F.sequence(F.lit(0), F.length(x["part"]) - k), lambda i: each(F.substring(x["part"], i + 1, F.lit(k)), x["at"] + i))))


def windows_of(seq: Column, k: int = 5, gap: bool = False, origin: int = 0) -> Column:
    """k-mers centred at each base with their positions; those with N are left out but the position advances.
    ``gap`` puts the gap k-mer with position -1 before them."""
    half = k // 2
    all_ = kmers_of(seq, k, lambda kmer, place: F.struct(kmer.alias("kmer"), (place + half + origin).cast("int").alias("pos")))
    all_ = F.filter(all_, lambda w: ~w["kmer"].contains("N"))
    return F.concat(F.array(F.struct(F.lit("-").alias("kmer"), F.lit(-1).alias("pos"))), all_) if gap else all_


def mean_of(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def std_of(a: Column) -> Column:
    """Population standard deviation, two passes; the mean is worked out once."""
    spread = lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))
    return F.when(F.size(a) > 0, bound(mean_of(a), spread))


def to_picoampere(signal: Column, offset: Column, range_: Column, digitisation: Column) -> Column:
    return F.transform(signal, lambda x: (x + offset) * range_ / digitisation)
