"""Tables of the engine on small fixtures with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import queries
from strandlake import schema as S
from strandlake.functions import arrays as A
from strandlake.functions import scalars as C
from strandlake.operators import align, bicluster, evaluate, mixture, reads, runs, segment, signal
from strandlake.plans import entries
from strandlake.sources import readers, sinks


def one(df):
    return df.collect()[0]


def events(spark, rows):
    """rows: (read_index, contig, position, kmer, level, start, end)."""
    cols = "read_index int, contig string, position int, reference_kmer string, event_level_mean double, start_idx int, end_idx int, row_no long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], cols)


def test_run_collapse_weights_by_samples(spark):
    e = events(spark, [(0, "t", 14, "TAGGC", 79.04, 53396, 53405), (0, "t", 14, "TAGGC", 95.28, 53374, 53396)])
    r = one(runs.collapse_events(e))
    assert (r.read_idx, r.contig, r.pos, r.kmer, r.mean, r.start_idx, r.end_idx) == (0, "t", 16, "TAGGC", 90.565, 53374, 53405)


def test_runs_are_contiguous_not_global(spark):
    e = events(spark, [(0, "t", 1, "AAAAA", 1.0, 0, 2), (0, "t", 2, "AAAAC", 2.0, 2, 4), (0, "t", 1, "AAAAA", 3.0, 4, 6), (0, "u", 1, "AAAAA", 5.0, 6, 8), (1, "u", 1, "AAAAA", 7.0, 8, 10), (1, "u", 1, "AAAAA", 7.0, 10, 10)])
    rows = runs.collapse_events(e).orderBy("row_no").collect()
    assert [(r.read_idx, r.contig, r.kmer, r.mean) for r in rows] == [(0, "t", "AAAAA", 1.0), (0, "t", "AAAAC", 2.0), (0, "t", "AAAAA", 3.0), (0, "u", "AAAAA", 5.0), (1, "u", "AAAAA", 7.0)]


def test_zero_length_run_has_no_mean(spark):
    assert one(runs.collapse_events(events(spark, [(0, "t", 1, "AAAAA", 1.0, 5, 5)]))).mean is None


def alignment(spark, rows):
    return spark.createDataFrame([(0, "r", "t", *r, i) for i, r in enumerate(rows)], S.ALIGNMENT_COLUMNS + ", row_no long")


KMERS = [("TAGGC", 1), ("AGGCA", 2)]
MODEL = [("TAGGC", 88.0, 2.0, 88.0, 2.0), ("AGGCA", 111.0, 2.0, 111.0, 2.0)]


def tables(spark):
    return spark.createDataFrame([(i, k) for k, i in KMERS], S.KMER_INDEX_COLUMNS), spark.createDataFrame(MODEL, S.KMER_MODEL_COLUMNS)


def test_alignment_collapse(spark):
    rows = [
        ("TAGGC", 16, 80.5237, 1.3826, 53397, 53423, 26), ("-", -1, 0.0, 0.0, 1, 2, 1), ("TAGGC", 16, 95.779, 2.7758, 53376, 53393, 17), ("TAGGC", 16, 102.227, 2.8678, 53339, 53372, 7),
        ("AGGCA", 17, 111.711, 4.7163, 53278, 53332, 36), ("AGGCA", 17, 103.782, 5.6484, 53260, 53274, 13), ("AGGCA", 17, 1.0, 1.0, -1, -1, 9), ("AGGCA", 17, 116.527, 5.3756, 53229, 53256, 25),
        ("AGGCA", 17, 100.959, 5.2579, 53216, 53225, 4), ("AGGCA", 17, 111.676, 3.778, 53201, 53210, 7), ("TAGGC", 20, 90.0, 1.0, 5, 6, 0),
    ]
    got = runs.collapse_alignment(alignment(spark, rows), *tables(spark)).orderBy("pos").collect()
    assert [(r.pos, r.kmer, r.mean, r.start_idx, r.end_idx, r.event_len, r.mod) for r in got] == [(16, "TAGGC", 88.749, 53339, 53423, 50, 0), (17, "AGGCA", 111.406, 53201, 53332, 85, 0)]


def test_modification_call(spark):
    rows = [(123.83, 123.83, 3.01, 117.79, 2.87), (117.79, 123.83, 3.01, 117.79, 2.87), (100.0, 108.9, 2.68, 108.9, 2.68), (60.0, 123.83, 3.01, 117.79, 2.87)]
    df = spark.createDataFrame(rows, "x double, a double, b double, c double, d double")
    assert [r.m for r in df.select(C.modification_state(*[F.col(c) for c in "xabcd"]).alias("m")).collect()] == [0, 1, 0, 0]


def test_rounding(spark):
    for x, k, want in ((64.8225, 3, 64.823), (0.0015, 3, 0.002), (1.0025, 3, 1.002), (2.675, 2, 2.68), (2.5, 0, 2.0)):
        want = float(np.around(x, k))
        assert one(spark.range(1).select(C.round_np(F.lit(x), k).alias("r"))).r == want
    assert one(spark.range(1).select(C.six_digits(F.lit(80.523749)).alias("r"))).r == 80.5237


def test_strand_and_order(spark):
    rows = [(0, "AAACC", "NNNNN", 9), (0, "AAACC", "AAACC", 5), (0, "AAACG", "AAACG", 2), (1, "AAACC", "GGTTT", 1), (1, "AAACG", "CGTTT", 4), (2, "AAACC", "NNNNN", 1), (3, "AAACC", "AAACC", 1)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "read_index int, reference_kmer string, model_kmer string, start_idx int, row_no long")
    got = {r.read_index: (r.map_strand, r.kmers_agree, r.direction, r.order_agrees) for r in reads.strand_quality(df).collect()}
    assert got == {0: ("+", True, 1, True), 1: ("-", True, 0, True), 2: ("*", True, -1, True), 3: ("+", True, -1, False)}
    assert {r.read_index for r in reads.mapped_forward(reads.add_strand(df)).collect()} == {0, 2, 3}


def test_array_expressions(spark):
    df = spark.createDataFrame([([1, 0, 0, 1, 0, 1], "ACGTNACGTA")], "s array<int>, q string")
    r = one(df.select(A.base_ends(F.col("s")).alias("e"), A.state_border(A.base_ends(F.col("s"))).alias("b"), A.windows_of(F.col("q"), 5, gap=True).alias("w"), C.base_ids(F.col("q")).alias("i"), C.bases(C.base_ids(F.col("q"))).alias("back"), C.reverse_complement(F.col("q")).alias("rc")))
    assert r.e == [0, 0, 0, 1, 0, 0] and r.b == [0, 3, 4, 6]
    assert [(w.kmer, w.pos) for w in r.w] == [("-", -1), ("ACGTA", 7)]
    assert r.i == [1, 2, 3, 4, 5, 1, 2, 3, 4, 1] and r.back == "ACGTNACGTA" and r.rc == "TACGTNACGT"
    r = one(spark.createDataFrame([([0, 3, 4, 6],)], "b array<int>").select(A.border_blocks(F.col("b")).alias("x"), A.border_blocks(F.col("b"), True).alias("t"), A.valid_border(F.col("b")).alias("v")))
    assert [tuple(x) for x in r.x] == [(0, 3), (4, 6)] and [tuple(x) for x in r.t] == [(3, 4)] and r.v
    assert one(spark.createDataFrame([([1, 0, 4],)], "s array<int>").select(A.valid_states(F.col("s")).alias("v"))).v


def test_base_ids_cover_whole_sequences(spark, tmp_path):
    rows = [(1, "acgt " * 40), (2, "ACG" * 100), (3, "xyz"), (4, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: ["ACGT".index(c) + 1 for c in t.upper() if c in "ACGT"] for i, t in rows}
    assert {r.doc_id: r.ids for r in queries.base_ids(spark, str(tmp_path)).collect()} == {i: x for i, x in want.items() if x}


def test_common_tags_are_of_all_users(spark, tmp_path):
    rows = [(2, "click", 500.0), (2, "view", 1.0), (3, "odd", 500.0), (5, "low", 2.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.kmer: r.common for r in queries.common_kmer_tag(spark, str(tmp_path)).collect()}
    assert got == {"click": 1, "view": 0, "odd": 1, "low": 0}


def test_list_literals_and_labels(spark):
    df = spark.createDataFrame([("['GGACC', 'GGACA']", "[122728161, 122729637]")], "k string, p string")
    assert one(df.select(evaluate.site_labels(df, "k", "p").alias("l"))).l == ["GGACC_122728162", "GGACA_122729638"]


def test_reference_slice(spark):
    df = spark.createDataFrame([("ABCDEFGHIJ", 4, 6), ("ABCDEFGHIJ", 1, 2)], "s string, a int, b int")
    assert [r.x for r in df.select(C.reference_slice(F.col("s"), F.col("a"), F.col("b"), 2).alias("x")).collect()] == ["CDEFGHI", None]


def test_text_sources(spark, tmp_path):
    names = [f.name for f in S.struct(S.EVENT_COLUMNS).fields]
    line = "t\t14\tTAGGC\t0\tt\t1\t79.04\t1\t0.1\tTAGGC\t79\t1\t0\t53396\t53405"
    (tmp_path / "e.txt").write_text("\n".join(["\t".join(names), line, line + "\textra", line.rsplit("\t", 1)[0], line.replace("TAGGC", "AGGCA")]) + "\n")
    e = readers.event_table(spark, str(tmp_path / "e.txt"))
    assert [(r.row_no, r.reference_kmer) for r in e.orderBy("row_no").collect()] == [(1, "TAGGC"), (4, "AGGCA")]
    with pytest.raises(ValueError):
        readers.polya_table(spark, str(tmp_path / "e.txt"))
    (tmp_path / "r.fa").write_text(">a one\nACGT\nAC\n>b\nTTTT\n")
    assert {(r.id, r.seq) for r in readers.fasta(spark, str(tmp_path / "r.fa")).collect()} == {("a", "ACGTAC"), ("b", "TTTT")}
    (tmp_path / "m.csv").write_text("1,2.5,3,\n2\n")
    m = readers.ragged(spark, str(tmp_path / "m.csv"))
    assert [r["values"] for r in m.orderBy("row_no").collect()] == [[1.0, 2.5, 3.0], [2.0]]
    assert one(readers.ragged_row(m, 1))["values"] == [2.0] and readers.ragged_values(m).count() == 4
    assert {(r.read_index, tuple(r["values"])) for r in readers.keyed_ragged(m).collect()} == {(1, (2.5, 3.0)), (2, ())}
    header = "\t".join(f.name for f in S.struct(S.POLYA_COLUMNS).fields)
    row = "x\tt\t1\t0\t0\t10.7\t90.2\t1\t30\t{}"
    (tmp_path / "p.tsv").write_text("\n".join([header, row.format("PASS"), row.format("NOREGION"), row.format("PASS").replace("10.7", "11.7")]) + "\n")
    assert [r.polya_start for r in readers.polya_table(spark, str(tmp_path / "p.tsv")).collect()] == [11.7]
    (tmp_path / "k.csv").write_text("AAAAA,1,2,3,4\r\nAAAAA,9,9,9,9\r\n")
    assert one(readers.kmer_model(spark, str(tmp_path / "k.csv"))).mean_un == 1.0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.5, 2.0]), (2, [])], "k int, v array<double>")
    sinks.write_ragged(df.coalesce(1), str(tmp_path / "x"), "v", "k")
    back = readers.keyed_ragged(readers.ragged(spark, str(tmp_path / "x")))
    assert {(r.read_index, tuple(r["values"])) for r in back.collect()} == {(1, (1.5, 2.0)), (2, ())}
    sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_table(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert one(sinks.failed_as_minus_one(spark.createDataFrame([(None,)], "b array<int>"), "b")).b == [-1]


def test_site_rates(spark):
    cells = spark.createDataFrame([("a", 1)] * 173 + [("a", 0)] * 309 + [("a", -1)] * 66 + [("b", -1)], "site string, state int")
    got = {r.site: (r.modified, r.unmodified, r.missing, r.rate) for r in evaluate.site_rates(cells, "site", "state").collect()}
    assert got == {"a": (173, 309, 66, 0.36), "b": (0, 0, 1, None)}


def test_kmer_intersection_and_tags(spark):
    a = spark.createDataFrame([(k,) for k in ("AGACA", "AGACG", "GGACT")], "kmer string")
    b = spark.createDataFrame([(k,) for k in ("AGACA", "GGACT", "AAACT")], "kmer string")
    assert {r.kmer for r in evaluate.common_kmers(a, b).collect()} == {"AGACA", "GGACT"}
    assert {(r.kmer, r.common) for r in evaluate.tag_common(a, b).collect()} == {("AGACA", 1), ("AGACG", 0), ("GGACT", 1)}


def plain_auc(rows):
    p, q = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in q) / len(p) / len(q)


def test_curves(spark):
    r = np.random.default_rng(5)
    rows = [(float(round(x, 1)), int(x + r.normal() > 0)) for x in r.normal(size=200)]
    df = spark.createDataFrame([*rows, (None, 1)], "s double, y int")
    assert one(evaluate.roc_auc(df, "s", "y")).auc == round(plain_auc(rows), 3)
    pr = one(evaluate.pr_auc(df, "s", "y")).auc
    area, last_p = 0.0, 1.0
    tp = fp = 0
    n = sum(y for _, y in rows)
    for s in sorted({s for s, _ in rows}, reverse=True):
        p, q = sum(y for t, y in rows if t == s), sum(1 - y for t, y in rows if t == s)
        tp, fp = tp + p, fp + q
        area += p / n * (tp / (tp + fp) + last_p) / 2
        last_p = tp / (tp + fp)
    assert pr == pytest.approx(area, abs=6e-4)


def test_standardize(spark):
    r = np.random.default_rng(2)
    raw = [int(v) for v in r.normal(500, 2, 400)]
    df = spark.createDataFrame([("a", raw, 8192.0, 10.0, 1400.0, (50, 350)), ("b", raw, 8192.0, 10.0, 1400.0, (50, 80)), ("c", raw, 8192.0, 10.0, 140000.0, (50, 350)), ("d", raw, 8192.0, 10.0, 1400.0, None)], "read_id string, signal array<int>, digitisation double, offset double, `range` double, polya struct<start: int, end: int>")
    got = {x.read_id: x for x in signal.standardize(df).collect()}
    assert got["b"].refused == "short" and got["c"].refused == "noisy" and got["d"].normalized is None and got["d"].refused is None
    n = got["a"].normalized
    x = (np.array(raw) + 10.0) * 1400 / 8192
    part = x[50:350]
    smooth = np.convolve(part, np.ones(50), "same")[75:225] / 50
    rest = part[75:225] - smooth
    lo, hi = np.percentile(rest, [5, 95])
    sd = rest[(rest >= lo) & (rest <= hi)].std()
    assert np.allclose(n.signal, np.around((x - smooth.mean()) / sd * 1.67 + 108.9, 3), atol=2e-3)
    assert n.polya_mu == pytest.approx(smooth.mean(), abs=1e-5) and n.polya_sigma == pytest.approx(sd, abs=1e-5)


def test_signal_windows_match_kernels(spark):
    from strandlake.operators import kernels as K

    x = np.random.default_rng(4).normal(size=120)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "r int, i int, value double")
    got = signal.slope_magnitude(df, "value", "r", "i").withColumn("b", signal.box_smooth("value", "r", "i", 50)).orderBy("i").collect()
    assert np.allclose([g.magnitude for g in got], K.box(np.abs(K.slope(x)), 3))
    assert np.allclose([g.b for g in got], K.box(x, 50))


def test_end_to_end(spark):
    """Entry A to C on two synthetic reads whose k-mer levels are known."""
    r = np.random.default_rng(9)
    seq = "ACGTTGCATCGGACTTAGCA"
    kmers = [seq[i : i + 5] for i in range(len(seq) - 4)]
    levels = {k: 80.0 + 7.0 * ((i * 5) % 11) for i, k in enumerate(kmers)}
    model = spark.createDataFrame([(k, v, 3.0, v, 3.0) for k, v in levels.items()], S.KMER_MODEL_COLUMNS)
    index = spark.createDataFrame([(i, k) for i, k in enumerate(kmers)], S.KMER_INDEX_COLUMNS)
    rows, raw, polya = [], [], []
    for read in (0, 1):
        poly = list(r.normal(500, 1.5, 300))
        body, at = [], 300
        for k, kmer in reversed(list(enumerate(kmers))):
            width = int(r.integers(18, 30))
            body += list(500 + (levels[kmer] - 108.9) * 2 + r.normal(0, 2, width))
            rows.append(("t", k, kmer, read, "t", 1, levels[kmer], 1.0, 0.1, kmer, 0.0, 1.0, 0.0, at, at + width))
            at += width
        raw.append((f"r{read}", [int(v) for v in poly + body], 8192.0, 0.0, 8192.0 / 4))
        polya.append((f"r{read}", "t", 0, 0.0, 0.0, 0.0, 300.0, 1.0, 30.0, "PASS"))
    rows.sort(key=lambda e: (e[3], -e[13]))
    e = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], S.EVENT_COLUMNS + ", row_no long")
    summary = spark.createDataFrame([(0, "r0", "a.h5"), (1, "r1", "a.h5")], "read_index int, read_name string, fast5_path string")
    reference = spark.createDataFrame([("t", seq)], "id string, seq string")
    standard = entries.events_to_reads(e, summary, reference, spark.createDataFrame(polya, S.POLYA_COLUMNS), spark.createDataFrame(raw, S.RAW_READS), index)
    got = {x.read_id: x for x in standard.collect()}
    assert got["r0"].event.reference == seq and len(got["r0"].event.events) == len(kmers) and got["r0"].normalized is not None
    blocks = entries.reads_to_blocks(standard)
    assert blocks.filter("blocks is not null").count() == 2
    sites = entries.blocks_to_sites(blocks, index, model)
    assert sites.count() > 5 and sites.filter("mod not in (0, 1)").count() == 0
    assert {x.kmer for x in sites.collect()} <= set(kmers)
    new = entries.reestimate(sites, model, kmers[:2])
    assert new.count() == len(levels)


def test_command_line(spark, tmp_path):
    """The stages as programs, on a few text files."""
    from strandlake.__main__ import main

    names = [f.name for f in S.struct(S.EVENT_COLUMNS).fields]
    rows = [("t", p, k, 0, "t", 1, 80.0 + p, 1.0, 0.1, k, 0.0, 1.0, 0.0, 100 - 10 * p, 110 - 10 * p) for p, k in enumerate(("ACGTA", "CGTAC", "GTACG"))]
    (tmp_path / "e.tsv").write_text("\n".join("\t".join(map(str, r)) for r in [names, *rows]) + "\n")
    names = [f.name for f in S.struct(S.SUMMARY_COLUMNS).fields]
    (tmp_path / "s.tsv").write_text("\n".join("\t".join(map(str, r)) for r in [names, (0, "r0", "x/a.h5", "m", "t", 1, 1, 1, 1, 1.0, 1.0, 1.0, 1.0, 1.0)]) + "\n")
    (tmp_path / "r.fa").write_text(">t\nACGTACG\n")
    at = lambda x: str(tmp_path / x)
    main(["strand", "--events", at("e.tsv"), "--out", at("strand")])
    main(["collapse", "--strand", at("strand"), "--summary", at("s.tsv"), "--reference", at("r.fa"), "--out", at("collapsed")])
    r = one(spark.read.parquet(at("collapsed/reads")))
    assert (r.read_name, r.fast5_path, r.trans_position_start, r.trans_position_end, r.start_idx, r.end_idx, r.ref) == ("r0", "a.h5", 2, 4, 80, 110, "ACGTACG")
    assert spark.read.parquet(at("collapsed/missing")).count() == 0


def test_alignment_variants(spark):
    block = [(k * 4, k * 4 + 4, 90.0 + k, 1.0, 4) for k in range(6)]
    df = spark.createDataFrame([(1, block, "ACGTACGT", 10), (2, [], "ACGTACGT", 10), (3, block, "ACG", 10)], "id int, blocks array<struct<start: int, end: int, mu: double, sigma: double, len: int>>, reference string, origin int")
    model = {"ACGTA": (90.0, 2.0, 0.0, 1.0), "CGTAC": (92.0, 2.0, 99.0, 2.0), "GTACG": (94.0, 2.0, 94.0, 2.0), "TACGT": (96.0, 2.0, 96.0, 2.0)}
    for variant in ("two", "one", "ivt", "reverse_ivt"):
        rows = align.align_reads(df, model, ["id"], variant, origin="origin").orderBy("row_no").collect()
        assert {r.id for r in rows} == {1}
        assert [r.start for r in rows if r.start is not None] == [b[0] for b in (block if variant == "reverse_ivt" else block[::-1])]
        assert all(r.pos is None or 10 <= r.pos < 14 for r in rows)


def test_mixtures_per_group(spark):
    r = np.random.default_rng(1)
    rows = [("GGACT", float(v)) for v in np.concatenate([r.normal(123.83, 2, 400), r.normal(114, 2, 200)])] + [("AAAAA", 1.0)]
    fixed = spark.createDataFrame([("GGACT", 123.83), ("AAAAA", 1.0)], "kmer string, fixed_mean double")
    got = {x.kmer: x for x in mixture.fixed_mean_mixtures(spark.createDataFrame(rows, "kmer string, mean double"), "kmer", "mean", fixed).collect()}
    assert got["GGACT"].mean1 == 123.83 and abs(got["GGACT"].mean2 - 114) < 0.5 and got["GGACT"].n == 600 and got["AAAAA"].n == 1


def test_block_statistics(spark):
    rows = [(1, 0, 5.0, 1), (1, 0, 7.0, 1), (1, 0, 9.0, 2), (1, 1, 4.0, 4)]
    got = {r.block_no: r for r in segment.block_statistics(spark.createDataFrame(rows, "r int, block_no int, value double, state int"), ["r"]).collect()}
    assert (got[0].curr_mu, got[0].curr_sigma, got[0].curr_len, got[0].prev_mu, got[0].prev_len, got[0].next_mu) == (6.0, 1.0, 2, 9.0, 1, 0.0)
    assert (got[1].curr_mu, got[1].curr_len) == (0.0, 0)


def test_checks_and_order(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    assert {(r.k, r.complete) for r in evaluate.reconcile({"a": a, "b": b}, "k").collect()} == {(1, True), (2, False), (3, False)}
    assert one(evaluate.unique_check(a, "k")).is_unique is False
    assert [(r.k, r.n, r.running) for r in evaluate.label_frequency(a, "k").orderBy("k").collect()] == [(1, 2, 2), (2, 1, 3)]
    assert {(r.k, r.place) for r in evaluate.reorder(a, "k", [2, 1]).collect()} == {(2, 0), (1, 1)}



def planted(n, sites, seed=0, noise=0.03):
    """Rows of six kinds and sites of three, each block of the matrix with a rate of its own."""
    r = np.random.default_rng(seed)
    rates = np.array([[0.95, 0.05, 0.1], [0.05, 0.95, 0.1], [0.1, 0.05, 0.95], [0.95, 0.95, 0.05], [0.05, 0.95, 0.95], [0.95, 0.05, 0.95]])
    kinds, of = np.repeat(np.arange(6), n), np.arange(sites) % 3
    x = (rates[kinds][:, of] + r.normal(0, noise, (6 * n, sites))).round(6)
    by = r.permutation(6 * n)
    return [(int(i), *x[i].tolist()) for i in by], kinds, of


def agree(a, b):
    """Whether two labellings are the same but for names."""
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_bicluster_finds_planted_blocks(spark):
    rows, kinds, of = planted(40, 12)
    names = [f"s{k}" for k in range(12)]
    m = spark.createDataFrame(rows, "r int, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    labels, cols = bicluster.bicluster(m, "r", names)
    got = {x.r: x.label for x in labels.collect()}
    assert agree([got[i] for i in range(240)], kinds.tolist()) and agree([cols[c] for c in names], of.tolist())
    again, same = bicluster.bicluster(m.repartition(2), "r", names)
    assert {x.r: x.label for x in again.collect()} == got and same == cols  # however rows are dealt


def test_bicluster_of_few_and_constant_cells(spark):
    m = spark.createDataFrame([(i, int(i < 3), int(i < 3), int(i >= 3)) for i in range(6)], "r int, a int, b int, c int")
    labels, cols = bicluster.bicluster(m, "r", ["a", "b", "c"], 2, 2)
    rows = {x.r: x.label for x in labels.collect()}
    assert cols["a"] == cols["b"] != cols["c"] and rows[0] == rows[1] != rows[5]
    labels, cols = bicluster.bicluster(m.selectExpr("r", "1 as a", "1 as b"), "r", ["a", "b"])
    assert {x.label for x in labels.collect()} == {0} and set(cols.values()) == {0}
    labels, cols = bicluster.bicluster(m.limit(0), "r", ["a", "b"])
    assert labels.count() == 0 and set(cols.values()) == {0}


def test_streaming_runs_match_batch(spark, tmp_path):
    from strandlake.streaming.runs import stream_runs

    rows = [(1, i, i, t, float(i), 1 + i % 3) for i, t in enumerate("aabbbac")] + [(2, i + 10, i, t, 2.0, 1) for i, t in enumerate("xxy")]
    cols = "user_id long, event_id long, t int, event_type string, value double, k int"
    df = spark.createDataFrame(rows, cols).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = stream_runs(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("runs_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    got = {(r.user_id, r.event_type, r.start_idx, r.end_idx, r.mean) for r in spark.table("runs_out").collect()}
    batch = runs.collapse_runs(df, ["user_id"], ["ts", "event_id"], ["event_type"], "value", F.col("k"), "event_id", "event_id")
    every = {(r.user_id, r.event_type, r.start_idx, r.end_idx, r.mean) for r in batch.collect()}
    open_ = {(1, "c"), (2, "y")}  # the last run of each read is still open
    assert got == {x for x in every if x[:2] not in open_}


def test_kmer_score_has_no_gap(spark, tmp_path):
    """Events of level 0, of type "-" and of a second mean of 0 are scored as all others, as in the query's SQL."""
    rows = [("view", v) for v in (0.0, 1e-12, 5.0, 11.0)] + [("-", v) for v in (3.0, 8.0)] + [("low", v) for v in (-2.0, 0.0)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.score for r in queries.kmer_score(spark, str(tmp_path)).collect()}
    for i, (kind, v) in enumerate(rows):
        own = [x for k, x in rows if k == kind]
        m, s = np.rint(np.mean(own) * 100) / 100, np.rint(np.std(own) * 100) / 100
        pdf = lambda mu, sd: -0.5 * ((v - mu) / sd) ** 2 - np.log(sd) - 0.5 * np.log(2 * np.pi)  # noqa: B023, E731
        assert got[i] == pytest.approx(max(pdf(m, s), pdf(m + s, 2 * s)), abs=1e-6), (kind, v)
