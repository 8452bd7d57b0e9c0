"""The three end-to-end entries, as chains of DataFrame stages, and the loop of align and fit over versions of the k-mer table.

Reads are independent of each other, so every stage keeps the partitioning by read where it can: the run windows and the
aggregations behind them share one shuffle, the per-read kernels need none. The k-mer tables (1025 rows) travel with the
tasks. Stage results are written as Parquet where an entry ends; nothing is collected but those tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import consistent_blocks, valid_states
from ..operators import align as AL
from ..operators import mixture, reads, runs, segment, signal
from ..sources.readers import normalized_reads


def events_to_reads(events: DataFrame, summary: DataFrame, reference: DataFrame, polya: DataFrame, raw: DataFrame, kmer_index: DataFrame, shift: int = 2) -> DataFrame:
    """Entry A: event table to standardized reads. events with row_no; summary (read_index, read_name, fast5_path);
    reference (id, seq); polya (passing rows); raw (read_id, signal, digitisation, offset, range)."""
    forward = reads.mapped_forward(reads.add_strand(events))
    forward = reads.in_summary(forward, summary, "read_index")
    collapsed = runs.collapse_events(forward, shift)
    table = runs.summarise_reads(collapsed, summary, reference, shift)
    enriched = reads.enrich(raw, runs.gather_events(collapsed, table, kmer_index), polya)
    return signal.standardize(enriched)


def reads_to_blocks(standardized: DataFrame, distance: int = 10, compat: bool = True) -> DataFrame:
    """Entry B: standardized reads to segmented reads with block parameters: (read_id, event, signal, blocks), blocks null
    for reads that can't be segmented."""
    some = normalized_reads(standardized).select("read_id", "event", F.col("normalized.signal").alias("signal"))
    border = signal.initial_border(some, ["read_id"], distance=distance)
    ready = some.join(border, "read_id")
    return blocks_of(some, segment.segment_reads(ready, ["read_id"], compat=compat))


def blocks_of(some: DataFrame, states: DataFrame) -> DataFrame:
    """Reads (read_id, event, signal) with their blocks' parameters from segmentations (read_id, final_border, states)."""
    segmented = some.join(states, "read_id")
    stats = segment.block_statistics(segment.block_samples(segmented, ["read_id"]), ["read_id"])
    n = (F.size("final_border") / 2).cast("int")
    bounds = segmented.filter("final_border is not null").select("read_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("final_border", 2 * i).alias("start"), F.get("final_border", 2 * i + 1).alias("end")))).alias("block_no", "b"))
    rounded = lambda c: F.rint(F.col(c) * 1e4) / 1e4
    item = F.struct("block_no", F.col("b.start").alias("start"), F.col("b.end").alias("end"), rounded("curr_mu").alias("mu"), rounded("curr_sigma").alias("sigma"), F.col("curr_len").cast("int").alias("len"))
    blocks = bounds.join(stats, ["read_id", "block_no"]).groupBy("read_id").agg(F.array_sort(F.collect_list(item)).alias("blocks"))
    return some.join(blocks, "read_id", "left")


def invalid_reads(states: DataFrame, blocks: DataFrame) -> DataFrame:
    """Read ids whose states (read_id, states) or blocks (read_id, blocks) can't be: a first state that is none of 1 to 4,
    another beyond 0 to 4, a block that holds more samples than it is long. Failed reads (nulls) aren't invalid."""
    bad = states.filter("states is not null").filter(~valid_states(F.col("states"))).select("read_id")
    return bad.unionByName(blocks.filter("blocks is not null").filter(~consistent_blocks(F.col("blocks"))).select("read_id")).distinct()


def blocks_to_sites(segmented: DataFrame, kmer_index: DataFrame, kmer_model: DataFrame, variant: str = "two") -> DataFrame:
    """Entry C: blocks of segmented reads to one row per read and position with its modification state."""
    aligned = AL.align_reads(align_ready(segmented), AL.model_dict(kmer_model), ["read_index", "read_id", "contig"], variant, origin="origin")
    return runs.collapse_alignment(aligned, kmer_index, kmer_model)


def align_ready(segmented: DataFrame) -> DataFrame:
    """Segmented reads as the aligner takes them: blocks between the first and last aligned sample, reference, origin."""
    kept = reads.kept_segmentations(segmented).select("read_id", "event", "blocks")
    kept = kept.select("read_id", F.col("event.read_index").alias("read_index"), F.col("event.contig").alias("contig"), F.col("event.trans_position_start").alias("origin"), F.col("event.reference").alias("reference"), "blocks", F.col("event.start_idx").alias("lo"), F.col("event.end_idx").alias("hi"))
    return segment.align_inputs(kept, "lo", "hi")


def reestimate(sites: DataFrame, kmer_model: DataFrame, kmers: list[str]) -> DataFrame:
    """A new k-mer table from the collapsed levels: the unmodified mean of each chosen k-mer stays fixed. One round of
    align and fit is blocks_to_sites and this."""
    chosen = sites.filter(F.col("kmer").isin(kmers)).select("kmer", "mean")
    fixed = kmer_model.filter(F.col("kmer").isin(kmers)).select("kmer", F.col("mean_un").alias("fixed_mean"))
    return mixture.next_model(kmer_model, mixture.fixed_mean_mixtures(chosen, "kmer", "mean", fixed))


#: A k-mer counts as settled when none of its parameters moves by more.
SETTLED = 0.05


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the k-mer tables in a folder that were written whole."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if n.startswith("model-") and fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("model-")) for n in done)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kmer, change): the largest move of a k-mer's parameters between two tables."""
    columns = ["mean_un", "stdv_un", "mean_mod", "stdv_mod"]
    old = before.select("kmer", *[F.col(c).alias(f"_{c}") for c in columns])
    return after.join(old, "kmer").select("kmer", F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in columns]).alias("change"))


def refine(align: Callable[[DataFrame], DataFrame], kmer_model: DataFrame, kmers: list[str], folder: str, rounds: int = 10, settled: float = SETTLED) -> DataFrame:
    """The k-mer table after rounds of align and fit, until no parameter of the chosen k-mers moves by more than ``settled``
    or the folder has ``rounds`` versions beyond the first. ``align`` makes sites (kmer, mean, ...) with a k-mer table, as
    `blocks_to_sites` does.

    Every version is a table of its own below the folder, written before it is used: model-0 is the table given, and a
    run that was stopped goes on from the last version that was written whole (kmer_model is only read for model-0). Each
    round reads one version and writes the next, so no lineage grows over rounds."""
    spark = kmer_model.sparkSession
    have = versions(spark, folder)
    if not have:
        kmer_model.select("kmer", "mean_un", "stdv_un", "mean_mod", "stdv_mod").write.mode("overwrite").parquet(f"{folder}/model-0")
        have = [0]
    k = have[-1]
    at = lambda v: spark.read.parquet(f"{folder}/model-{v}")
    while k < rounds and not (k and _quiet(at(k - 1), at(k), kmers, settled)):
        reestimate(align(at(k)), at(k), kmers).write.mode("overwrite").parquet(f"{folder}/model-{k + 1}")
        k += 1
    return at(k)


def _quiet(before: DataFrame, after: DataFrame, kmers: list[str], settled: float) -> bool:
    return changes(before, after).filter(F.col("kmer").isin(kmers)).filter(F.col("change") > settled).isEmpty()
