"""Run collapse: adjacent rows with one key become a row. Groups are contiguous runs in order, never all rows of a key.

One shuffle by read serves the window that finds the runs and the aggregation: both hash on the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import modification_state, reference_slice, round_np


def islands(df: DataFrame, read: list[str], order: list[str], key: list[str], name: str = "island") -> DataFrame:
    """Numbers the runs of equal keys in each read. What breaks runs besides (a contig) belongs into the key."""
    w = Window.partitionBy(*read).orderBy(*order)
    row = F.struct(*[F.col(k) for k in key])
    changed = F.when(F.lag(row).over(w).eqNullSafe(row), 0).otherwise(1)
    return df.withColumn(name, F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def weighted_mean(value: Column, weight: Column, places: int = 3) -> Column:
    """Sum of weight * value over the sum of weights, rounded; null where the weights add up to 0."""
    total = F.sum(weight)
    return F.when(total != 0, round_np(F.sum(weight * value) / total, places))


def collapse_runs(df: DataFrame, read: list[str], order: list[str], key: list[str], value: str, weight: Column, start: str, end: str) -> DataFrame:
    """(read, key, first_no, mean, start, end, weight, rows): start and end are the smallest and largest of the run."""
    runs = islands(df, read, order, key)
    return runs.groupBy(*read, "island", *key).agg(
        F.min(F.struct(*order)).alias("first_row"),
        weighted_mean(F.col(value), weight).alias("mean"),
        F.min(start).alias("start_idx"),
        F.max(end).alias("end_idx"),
        F.sum(weight).alias("event_len"),
        F.count("*").alias("rows"),
    )


def collapse_events(events: DataFrame, shift: int = 2) -> DataFrame:
    """Aligner events to one row per run of (contig, k-mer, position): mean weighted by the number of samples, position
    moved to the k-mer's centre. A run without samples has a null mean."""
    out = collapse_runs(events, ["read_index"], ["row_no"], ["contig", "reference_kmer", "position"], "event_level_mean", F.abs(F.col("end_idx") - F.col("start_idx")), "start_idx", "end_idx")
    return out.select(
        F.col("read_index").alias("read_idx"), "contig", (F.col("position") + shift).alias("pos"), F.col("reference_kmer").alias("kmer"), "mean", "start_idx", "end_idx", F.col("first_row.row_no").alias("row_no")
    )


def collapse_alignment(alignment: DataFrame, kmer_index: DataFrame, kmer_model: DataFrame) -> DataFrame:
    """Alignment rows to one row per run of (contig, k-mer, position) with its modification state. Rows without k-mer or
    block go before runs are found; runs whose lengths add up to 0 go after."""
    rows = alignment.filter("kmer is not null and kmer != '-' and end is not null and end != -1")
    out = collapse_runs(rows, ["read_index"], ["row_no"], ["contig", "kmer", "pos"], "mu", F.col("len"), "start", "end").filter("event_len != 0")
    # k-mer tables have 1025 rows by their alphabet: small enough for the planner to broadcast; larger ones it shuffles
    out = out.join(kmer_index, "kmer").join(kmer_model, "kmer")
    state = modification_state(F.col("mean"), F.col("mean_un"), F.col("stdv_un"), F.col("mean_mod"), F.col("stdv_mod"))
    return out.select(
        F.col("read_index").alias("read_idx"), "contig", "pos", "kmer", F.col("index").alias("kmer_idx"), "mean", "start_idx", "end_idx", F.col("event_len").cast("int").alias("event_len"), state.alias("mod"), F.col("first_row.row_no").alias("row_no")
    )


def missing_kmers(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """k-mers that a dimension lacks: a check that would otherwise be a lookup error."""
    return rows.select("kmer").distinct().join(dimension, "kmer", "left_anti")


def summarise_reads(collapsed: DataFrame, summary: DataFrame, reference: DataFrame, shift: int = 2) -> DataFrame:
    """A row for each read of the summary: first and last position, extent of the first and last collapsed row, names, and
    the slice of the reference. Contigs come from first rows; a contig without reference drops out (see missing_contigs)."""
    first, last = F.min_by(F.struct("contig", "pos", "start_idx", "end_idx"), "row_no"), F.max_by(F.struct("pos", "start_idx", "end_idx"), "row_no")
    reads = collapsed.groupBy("read_idx").agg(first.alias("f"), last.alias("l"))
    reads = reads.select(
        F.col("f.contig").alias("contig"), F.col("read_idx").alias("read_index"), F.lit("+").alias("strand"), F.col("f.pos").alias("trans_position_start"), F.col("l.pos").alias("trans_position_end"),
        F.least("f.start_idx", "f.end_idx", "l.start_idx", "l.end_idx").alias("start_idx"), F.greatest("f.start_idx", "f.end_idx", "l.start_idx", "l.end_idx").alias("end_idx"),
    )
    reads = reads.join(summary, "read_index").join(reference.withColumnRenamed("id", "contig"), "contig")
    ref = reference_slice(F.col("seq"), F.col("trans_position_start"), F.col("trans_position_end"), shift)
    return reads.select("contig", "read_index", "strand", "trans_position_start", "trans_position_end", "start_idx", "end_idx", "read_name", "fast5_path", ref.alias("ref"))


def require_none(missing: DataFrame, what: str) -> None:
    """Raises a lookup error that names some of the keys that a table lacks."""
    some = [str(r[0]) for r in missing.limit(5).collect()]
    if some:
        raise KeyError(f"{what} missing: {', '.join(some)}")


def missing_contigs(collapsed: DataFrame, reference: DataFrame) -> DataFrame:
    return collapsed.select("contig").distinct().join(reference.select(F.col("id").alias("contig")), "contig", "left_anti")


def gather_events(collapsed: DataFrame, event_summary: DataFrame, kmer_index: DataFrame) -> DataFrame:
    """(read_name, event struct): a read's collapsed rows as an array; of a name with several (read, contig) the largest."""
    rows = collapsed.join(kmer_index, "kmer")
    item = F.struct("row_no", "pos", F.col("index").alias("kmer_idx"), "mean", "start_idx", "end_idx")
    reads = rows.groupBy(F.col("read_idx").alias("read_index"), "contig").agg(F.array_sort(F.collect_list(item)).alias("events"))
    reads = reads.join(event_summary.drop("contig"), "read_index")
    w = Window.partitionBy("read_name").orderBy(F.col("read_index").desc(), F.col("contig").desc())
    reads = reads.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1")
    events = F.transform("events", lambda e: F.struct(e["pos"].alias("pos"), e["kmer_idx"].alias("kmer_idx"), e["mean"].alias("mean"), e["start_idx"].alias("start_idx"), e["end_idx"].alias("end_idx")))
    return reads.select("read_name", F.struct("read_index", "contig", "trans_position_start", "trans_position_end", "start_idx", "end_idx", F.col("ref").alias("reference"), events.alias("events")).alias("event"))
