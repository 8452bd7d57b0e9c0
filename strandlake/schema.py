"""Schemas of the engine's tables. Row order of text inputs is data, so every ingested table carries ``row_no``."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of the text formats that the engine reads and writes.
EVENT_COLUMNS = (
    "contig string, position int, reference_kmer string, read_index int, strand string, event_index int, event_level_mean double, event_stdv double, "
    "event_length double, model_kmer string, model_mean double, model_stdv double, standardized_level double, start_idx int, end_idx int"
)
SUMMARY_COLUMNS = (
    "read_index int, read_name string, fast5_path string, model_name string, strand string, num_events int, num_steps int, num_skips int, num_stays int, "
    "total_duration double, shift double, scale double, drift double, var double"
)
POLYA_COLUMNS = (
    "readname string, contig string, position int, leader_start double, adapter_start double, polya_start double, transcript_start double, read_rate double, "
    "polya_length double, qc_tag string"
)
COLLAPSED_COLUMNS = "read_idx int, contig string, pos int, kmer string, mean double, start_idx int, end_idx int"
EVENT_SUMMARY_COLUMNS = "contig string, read_index int, strand string, trans_position_start int, trans_position_end int, start_idx int, end_idx int, read_name string, fast5_path string, ref string"
ALIGNMENT_COLUMNS = "read_index int, read_name string, contig string, kmer string, pos int, mu double, sigma double, start int, end int, len int"
ALIGNMENT_COLLAPSED_COLUMNS = "read_idx int, contig string, pos int, kmer string, kmer_idx int, mean double, start_idx int, end_idx int, event_len int, mod int"
KMER_INDEX_COLUMNS = "index int, kmer string"
KMER_MODEL_COLUMNS = "kmer string, mean_un double, stdv_un double, mean_mod double, stdv_mod double"
UNMODELLED, GAP_KMER, MISSING = "NNNNN", "-", -1


def struct(columns: str) -> T.StructType:
    return T.StructType.fromDDL(columns)


RAW_READS = ("read_id string, signal array<int>, digitisation double, offset double, range double")
READS = (
    "read_id string, signal array<int>, digitisation double, offset double, range double, "
    "event struct<read_index: int, contig: string, trans_position_start: int, trans_position_end: int, start_idx: int, end_idx: int, reference: string>, "
    "normalized struct<signal: array<double>, polya_start: int, polya_end: int, polya_mu: double, polya_sigma: double>"
)
