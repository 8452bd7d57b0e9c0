"""Command line: every stage as a program, and the three entries as chains. Stage tables are Parquet folders.

    python -m strandlake strand    --events events.tsv --out DIR
    python -m strandlake collapse  --strand DIR --summary s.tsv --reference r.fa --out DIR [--shift 2] [--strict]
    python -m strandlake standardize --collapsed DIR --polya p.tsv --raw raw.parquet --kmer-index k.csv --out DIR
    python -m strandlake border    --reads DIR --out DIR [--peak-distance 10]
    python -m strandlake states    --states states.parquet --out DIR
    python -m strandlake segment   --reads DIR --border DIR --out DIR [--no-compat] [--strict]
    python -m strandlake align     --blocks DIR --kmer-model m.csv --out DIR [--variant two|one|ivt|reverse_ivt] [--text DIR]
    python -m strandlake sites     --alignment DIR --kmer-index k.csv --kmer-model m.csv --out DIR [--text] [--strict]
    python -m strandlake mixture   --sites DIR --kmer GGACT --kmer-model m.csv --out DIR
    python -m strandlake refine    --blocks DIR --kmers GGACT,AGACT --kmer-index k.csv --kmer-model m.csv --versions DIR --out DIR [--rounds 10]
    python -m strandlake reconcile --tables reads=DIR,blocks=DIR --out DIR [--key read_id]
    python -m strandlake rates     --sites DIR --out DIR

``states`` makes borders from 0/1 states (read_id, states) that another program found, in the place of ``border``. ``--text``
writes, and reads, an alignment as text with six significant digits. ``--strict``: a contig or k-mer that a table lacks is
an error; without it its rows drop out, and are listed. ``strand`` lists the lines that it can't read, with what is wrong. ``refine``
goes on from the last version of the k-mer table that it finds. ``reconcile`` counts each key's rows in the tables of several stages and says
whether they agree.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .operators import align, evaluate, mixture, reads, runs, segment, signal
from .plans import entries
from .sources import readers, sinks

# Options of each command; those without a default are required.
OPTIONS = {
    "strand": {"events": None},
    "collapse": {"strand": None, "summary": None, "reference": None, "shift": 2, "strict": False},
    "standardize": {"collapsed": None, "polya": None, "raw": None, "kmer-index": None},
    "border": {"reads": None, "peak-distance": 10},
    "states": {"states": None},
    "segment": {"reads": None, "border": None, "compat": True, "strict": False},
    "align": {"blocks": None, "kmer-model": None, "variant": "two", "text": ""},
    "sites": {"alignment": None, "kmer-index": None, "kmer-model": None, "text": False, "strict": False},
    "mixture": {"sites": None, "kmer": None, "kmer-model": None},
    "refine": {"blocks": None, "kmers": None, "kmer-index": None, "kmer-model": None, "versions": None, "rounds": 10, "variant": "two"},
    "reconcile": {"tables": None, "key": "read_id"},
    "rates": {"sites": None},
}


def stage(spark: SparkSession, name: str, a: argparse.Namespace) -> dict[str, DataFrame]:
    """The tables that a command writes, by the name of their folder below --out ("" is --out itself)."""
    table = spark.read.parquet
    if name == "strand":
        lines = readers.with_reasons(spark, a.events, S.EVENT_COLUMNS)
        good = readers.accepted(lines)
        return {"events": reads.mapped_forward(reads.add_strand(good)), "quality": reads.strand_quality(good), "rejected": readers.rejected(lines)}
    if name == "collapse":
        summary = readers.read_summary(spark, a.summary)
        collapsed = runs.collapse_events(reads.in_summary(table(f"{a.strand}/events"), summary, "read_index"), a.shift)
        reference = readers.fasta(spark, a.reference)
        if a.strict:
            runs.require_none(runs.missing_contigs(collapsed, reference), "contigs")
        return {"events": collapsed, "reads": runs.summarise_reads(collapsed, summary, reference, a.shift), "missing": runs.missing_contigs(collapsed, reference)}
    if name == "standardize":
        events = runs.gather_events(table(f"{a.collapsed}/events"), table(f"{a.collapsed}/reads"), readers.kmer_index(spark, a.kmer_index))
        return {"": signal.standardize(reads.enrich(readers.raw_reads(spark, a.raw), events, readers.polya_table(spark, a.polya)))}
    if name == "border":
        some = readers.normalized_reads(table(a.reads)).select("read_id", F.col("normalized.signal").alias("signal"))
        return {"peaks": signal.pick_peaks(some, ["read_id"], distance=a.peak_distance), "border": signal.initial_border(some, ["read_id"], distance=a.peak_distance)}
    if name == "states":
        return {"border": signal.border_from_states(table(a.states), ["read_id"])}
    if name == "segment":
        some = readers.normalized_reads(table(a.reads)).select("read_id", "event", F.col("normalized.signal").alias("signal"))
        states = segment.segment_reads(some.join(table(f"{a.border}/border"), "read_id"), ["read_id"], compat=a.compat)
        blocks = entries.blocks_of(some, states)
        if a.strict:
            runs.require_none(entries.invalid_reads(states, blocks), "valid states or blocks of reads")
        return {"": blocks}
    if name == "align":
        kept = entries.align_ready(table(a.blocks))
        rows = align.align_reads(kept, align.model_dict(readers.kmer_model(spark, a.kmer_model)), ["read_index", "read_id", "contig"], a.variant, origin="origin")
        if a.text:
            sinks.write_alignment(rows.withColumnRenamed("read_id", "read_name"), a.text)
        return {"": rows}
    if name == "sites":
        rows = readers.alignment_table(spark, a.alignment) if a.text else table(a.alignment)
        index, model = readers.kmer_index(spark, a.kmer_index), readers.kmer_model(spark, a.kmer_model)
        if a.strict:
            seen = rows.filter("kmer is not null and kmer != '-'")
            for dimension in (index, model):
                runs.require_none(runs.missing_kmers(seen, dimension), "k-mers")
        return {"": runs.collapse_alignment(rows, index, model)}
    if name == "mixture":
        chosen = reads.one_kmer(table(a.sites), a.kmer).select("kmer", "mean")
        fixed = reads.one_kmer(readers.kmer_model(spark, a.kmer_model), a.kmer).select("kmer", F.col("mean_un").alias("fixed_mean"))
        fits = mixture.fixed_mean_mixtures(chosen, "kmer", "mean", fixed)
        return {"fit": fits, "model": mixture.next_model(readers.kmer_model(spark, a.kmer_model), fits), "histogram": evaluate.density_histogram(chosen, "kmer", "mean")}
    if name == "refine":
        index, ready = readers.kmer_index(spark, a.kmer_index), table(a.blocks)
        model = entries.refine(lambda m: entries.blocks_to_sites(ready, index, m, a.variant), readers.kmer_model(spark, a.kmer_model), a.kmers.split(","), a.versions, a.rounds)
        return {"": model}
    if name == "reconcile":
        stages = dict(x.split("=", 1) for x in a.tables.split(","))
        return {"": evaluate.reconcile({stage: table(path).select(a.key) for stage, path in stages.items()}, a.key)}
    rows = table(a.sites).withColumn("site", F.concat_ws("_", "contig", "kmer", "pos"))
    return {"": evaluate.site_rates(rows, "site", "mod")}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in OPTIONS.items():
        p = commands.add_parser(name)
        p.add_argument("--out", required=True)
        for option, default in options.items():
            if isinstance(default, bool):
                p.add_argument(f"--{option}", action=argparse.BooleanOptionalAction, default=default)
            else:
                p.add_argument(f"--{option}", required=default is None, default=default, type=type(default) if default is not None else str)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"strandlake {a.command}").getOrCreate()
    for folder, df in stage(spark, a.command, a).items():
        sinks.write_table(df, f"{a.out}/{folder}" if folder else a.out)


if __name__ == "__main__":
    main()
