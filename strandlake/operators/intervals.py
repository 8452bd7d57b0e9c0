"""Joins of rows by ranges: overlaps of stretches of one read, as an equi-join of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the left side that one bin's task takes; larger bins are split.
HOT = 50_000


def bin_width(left: DataFrame, right: DataFrame) -> int:
    """The mean extent of both sides' ranges (_low, _high). Ranges then touch three bins each on average at most, however
    their extents differ: the sum of extents over the width is the number of rows."""
    extent = (F.col("_high") - F.col("_low") + 1).cast("double")
    sums = [x.select(extent.alias("e")).agg(F.sum("e").alias("e"), F.count("e").alias("n")) for x in (left, right)]
    got = sums[0].unionByName(sums[1]).agg(F.sum("e").alias("e"), F.sum("n").alias("n")).first()
    return max(1, round(got.e / got.n)) if got.n else 1


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], mine: tuple[str, str], other: tuple[str, str], width: int | None = None, hot: int = HOT) -> DataFrame:
    """Pairs of rows of equal keys whose closed ranges (whole numbers; ``mine``: first and last of left, ``other``: of right)
    overlap, each pair once: (keys, left's other columns, right's other columns; these must differ in name).

    A range is a row for each bin of ``width`` that it touches; a pair counts in the bin where the later of its two begins.
    A bin with more than ``hot`` rows of left is split: its left rows are dealt to parts by hash and its right rows go to
    each part, so no bin of a key is one task's. Rows with a null key, a null bound or an empty range join nothing."""
    taken = set(left.columns) | set(right.columns)
    names = {c: c + "_" * (1 + max((len(t) for t in taken), default=0)) for c in ("bin", "salt", "salts")}
    bin_, salt, salts = names["bin"], names["salt"], names["salts"]
    a = left.withColumns({"_low": F.col(mine[0]).cast("long"), "_high": F.col(mine[1]).cast("long")}).filter("_low <= _high")
    b = right.withColumns({"_low": F.col(other[0]).cast("long"), "_high": F.col(other[1]).cast("long")}).filter("_low <= _high")
    width = width or bin_width(a, b)

    def binned(df: DataFrame, low: str, high: str) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / width).cast("long")
        return df.withColumn(bin_, F.explode(F.sequence(at("_low"), at("_high")))).withColumnsRenamed({"_low": low, "_high": high})

    a, b = binned(a, "_a", "_az"), binned(b, "_b", "_bz")
    large = a.groupBy(*keys, bin_).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(*keys, bin_, F.ceil(F.col("_n") / hot).cast("int").alias(salts))
    one: Column = F.coalesce(F.col(salts), F.lit(1))
    rest = F.xxhash64(*[c for c in left.columns if left.schema[c].dataType.simpleString() != "variant"])
    a = a.join(large, [*keys, bin_], "left").withColumn(salt, F.pmod(rest, one).cast("int")).drop(salts)
    b = b.join(large, [*keys, bin_], "left").withColumn(salt, F.explode(F.sequence(F.lit(0), one - 1))).drop(salts)
    pairs = a.join(b, [*keys, bin_, salt]).filter((F.col("_a") <= F.col("_bz")) & (F.col("_b") <= F.col("_az")))
    pairs = pairs.filter(F.col(bin_) == F.floor(F.greatest("_a", "_b") / width))
    return pairs.select(*left.columns, *[c for c in right.columns if c not in keys])


def rows_in_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str], place: str, low: str, high: str, width: int | None = None) -> DataFrame:
    """Rows whose place lies in [low, high] of a range of the same keys, with the range's columns; once for each range."""
    return overlap_join(rows, ranges, keys, (place, place), (low, high), width)
