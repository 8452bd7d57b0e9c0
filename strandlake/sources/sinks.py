"""Sinks: one distributed write per table, Parquet natively, text formats for exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import six_digits
from ..schema import ALIGNMENT_COLUMNS, GAP_KMER, MISSING, struct


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Overwrites. Reads that later stages join by stay together if partitioned."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_text(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header, emptyValue="", quote="")


def write_ragged(df: DataFrame, path: str, values: str, key: str | None = None) -> None:
    """A line for each row: the values, behind the read's number if a key is given."""
    line: Column = F.array_join(F.transform(values, lambda x: x.cast("string")), ",")
    if key:
        line = F.concat_ws(",", F.col(key).cast("string"), line)
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def with_sentinels(alignment: DataFrame) -> DataFrame:
    """Nulls of an alignment as the text format writes them: '-' and -1."""
    return alignment.fillna({"kmer": GAP_KMER, "pos": MISSING, "start": MISSING, "end": MISSING, "len": MISSING, "mu": 0.0, "sigma": 0.0})


def write_alignment(alignment: DataFrame, path: str) -> None:
    """An alignment as text for exchange: no header, sentinels for nulls, levels with six significant digits (what
    `readers.alignment_table` reads back; averages of such levels are averages of rounded ones)."""
    rows = with_sentinels(alignment)
    for c in ("mu", "sigma"):
        rows = rows.withColumn(c, six_digits(F.col(c)))
    # a file for each range of reads, in the order of the reads and their rows
    rows = rows.repartitionByRange("read_index").sortWithinPartitions("read_index", "row_no")
    write_text(rows.select(*[f.name for f in struct(ALIGNMENT_COLUMNS).fields]), path, header=False)


def failed_as_minus_one(df: DataFrame, values: str) -> DataFrame:
    """A failed read's null array as [-1]."""
    return df.withColumn(values, F.coalesce(F.col(values), F.array(F.lit(-1)).cast(df.schema[values].dataType)))
