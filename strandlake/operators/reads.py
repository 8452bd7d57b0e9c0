"""Strand and order of reads, and the filters and joins on reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import reverse_complement
from ..schema import UNMODELLED


def add_strand(events: DataFrame, read: str = "read_index", order: str = "row_no") -> DataFrame:
    """map_strand: + or - by the first row of the read whose model k-mer is known, * if there is none."""
    known = F.when(F.col("model_kmer") != UNMODELLED, F.when(F.col("reference_kmer") == F.col("model_kmer"), "+").otherwise("-"))
    w = Window.partitionBy(read).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return events.withColumn("map_strand", F.coalesce(F.first(known, ignorenulls=True).over(w), F.lit("*")))


def strand_quality(events: DataFrame, read: str = "read_index", order: str = "row_no") -> DataFrame:
    """For each read: its strand, whether all k-mers agree with it, its order (1 falling starts, 0 rising, -1 mixed or
    a single row), and whether order and strand agree."""
    w = Window.partitionBy(read).orderBy(order)
    step = F.col("start_idx") - F.lag("start_idx").over(w)
    agree = (
        F.when(F.col("model_kmer") == UNMODELLED, True)
        .when(F.col("map_strand") == "+", F.col("reference_kmer") == F.col("model_kmer"))
        .when(F.col("map_strand") == "-", F.col("reference_kmer") == reverse_complement(F.col("model_kmer")))
        .otherwise(True)
    )
    rows = add_strand(events, read, order).withColumn("_step", step).withColumn("_agree", agree)
    direction = F.when(F.count("_step") == 0, -1).when(F.max("_step") < 0, 1).when(F.min("_step") > 0, 0).otherwise(-1)
    out = rows.groupBy(read, "map_strand").agg(F.count("*").alias("rows"), F.bool_and("_agree").alias("kmers_agree"), direction.cast("int").alias("direction"))
    return out.withColumn("order_agrees", F.when(F.col("map_strand") == "+", F.col("direction") == 1).when(F.col("map_strand") == "-", F.col("direction") == 0).otherwise(True))


def mapped_forward(stranded: DataFrame) -> DataFrame:
    """Drops reads mapped to the reverse strand; keeps + and unknown ones."""
    return stranded.filter("map_strand != '-'")


def in_summary(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    return rows.join(summary.select(key), key, "left_semi")


def not_in_summary(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    return rows.join(summary.select(key), key, "left_anti")


def enrich(raw: DataFrame, events: DataFrame, polya: DataFrame) -> DataFrame:
    """Raw reads with their events and polyA record, each null where absent."""
    coordinates = polya.select(F.col("readname").alias("read_id"), F.struct(F.col("polya_start").cast("int").alias("start"), F.col("transcript_start").cast("int").alias("end")).alias("polya"))
    return raw.join(events.withColumnRenamed("read_name", "read_id"), "read_id", "left").join(coordinates, "read_id", "left")


def one_kmer(rows: DataFrame, kmer: str) -> DataFrame:
    return rows.filter(F.col("kmer") == kmer)


def kept_segmentations(blocks: DataFrame) -> DataFrame:
    """Drops failed reads: their blocks are null."""
    return blocks.filter("blocks is not null")
