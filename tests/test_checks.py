"""Strict commands, borders from given states, polyA levels, invalid reads, reconciled counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import schema as S
from strandlake.__main__ import main
from strandlake.functions import arrays as A
from strandlake.operators import evaluate, runs, signal
from strandlake.plans import entries


def test_missing_keys_raise_only_when_strict(spark, tmp_path):
    rows = spark.createDataFrame([("AAAAA",), ("CCCCC",), ("GGGGG",)], "kmer string")
    index = spark.createDataFrame([(1, "AAAAA")], S.KMER_INDEX_COLUMNS)
    gone = runs.missing_kmers(rows, index)
    assert {r.kmer for r in gone.collect()} == {"CCCCC", "GGGGG"}
    with pytest.raises(KeyError, match="k-mers missing: (CCCCC|GGGGG)"):
        runs.require_none(gone, "k-mers")
    runs.require_none(runs.missing_kmers(rows.filter("kmer = 'AAAAA'"), index), "k-mers")

    at = lambda x: str(tmp_path / x)
    fields = [f.name for f in S.struct(S.ALIGNMENT_COLUMNS).fields]
    data = [(0, "r0", "t", k, 16 + i, 90.0 + i, 1.0, 10 * i, 10 * i + 9, 9, i) for i, k in enumerate(("AAAAA", "CCCCC"))]
    spark.createDataFrame(data, ", ".join(f.simpleString().replace(":", " ") for f in S.struct(S.ALIGNMENT_COLUMNS).fields) + ", row_no int").write.parquet(at("a"))
    (tmp_path / "k.csv").write_text(",".join(f.name for f in S.struct(S.KMER_INDEX_COLUMNS).fields) + "\n1,AAAAA\n")
    (tmp_path / "m.csv").write_text("AAAAA,90,2,95,2\n")
    assert "kmer" in fields
    call = ["sites", "--alignment", at("a"), "--kmer-index", at("k.csv"), "--kmer-model", at("m.csv"), "--out", at("s")]
    main(call)
    assert [r.kmer for r in spark.read.parquet(at("s")).collect()] == ["AAAAA"]
    with pytest.raises(KeyError, match="CCCCC"):
        main([*call, "--strict"])


def test_states_of_another_program(spark, tmp_path):
    rows = [("a", [0, 1, 1, 0, 0, 1, 0]), ("b", [1, 1, 0, 0, 1]), ("c", [1, 1, 1]), ("d", [0, 0])]
    spark.createDataFrame(rows, "read_id string, states array<int>").write.parquet(str(tmp_path / "s"))
    main(["states", "--states", str(tmp_path / "s"), "--out", str(tmp_path / "o")])
    got = {r.read_id: r.border for r in spark.read.parquet(str(tmp_path / "o" / "border")).collect()}
    assert got == {"a": [0, 1, 3, 5, 6, 7], "b": [0, 5], "c": [0, 3], "d": [0, 2]}
    df = spark.createDataFrame([(x,) for x in got.values()], "b array<int>")
    assert all(r.v for r in df.select(A.valid_border(F.col("b")).alias("v")).collect())


def test_polya_levels_against_plain_steps(spark):
    r = np.random.default_rng(6)
    x = np.round(r.normal(108, 1.5, 400), 3)
    noisy = np.round(r.normal(108, 9, 400), 3)
    rows = [(1, x.tolist(), 20, 320), (2, noisy.tolist(), 0, 300), (3, x.tolist(), 0, 49), (4, x.tolist(), -1, 90), (5, x.tolist(), 350, 401), (6, x.tolist(), None, None), (7, None, 0, 100)]
    df = spark.createDataFrame(rows, "k int, s array<double>, a int, z int")
    got = {q.k: q.l for q in df.select("k", signal.polya_levels(F.col("s"), F.col("a"), F.col("z")).alias("l")).collect()}
    part = x[20:320]
    smooth = np.array([sum(part[max(0, i - 25) : i + 25]) / 50 for i in range(300)])[75:225]
    rest = part[75:225] - smooth
    lo, hi = np.percentile(rest, [5, 95])
    assert got[1].mu == pytest.approx(smooth.mean()) and got[1].sigma == pytest.approx(rest[(rest >= lo) & (rest <= hi)].std()) and got[1].refused is None
    assert [got[k].refused for k in (2, 3, 4, 5)] == ["noisy", "short", "short", "short"]
    assert all(got[k] is None or got[k].mu is None for k in (6, 7))


def test_invalid_reads_are_named(spark):
    states = spark.createDataFrame([("a", [1, 0, 4]), ("b", [0, 1]), ("c", [1, 5]), ("d", None)], "read_id string, states array<int>")
    item = "array<struct<start:int,end:int,len:int>>"
    blocks = spark.createDataFrame([("a", [(0, 5, 5), (7, 9, 1)]), ("e", [(0, 5, 6)]), ("f", None)], f"read_id string, blocks {item}")
    assert {r.read_id for r in entries.invalid_reads(states, blocks).collect()} == {"b", "c", "e"}


def test_selected_rows_make_the_curve(spark):
    df = spark.createDataFrame([(0.9, 1, 1), (0.8, 0, 1), (0.7, 1, 0), (None, 1, 1), (0.1, 0, 1)], "score double, label int, `select` int")
    assert [tuple(r) for r in evaluate.selected(df).orderBy("score").collect()] == [(0.1, 0, 1), (0.8, 0, 1), (0.9, 1, 1)]
    assert evaluate.roc_auc(evaluate.selected(df), "score", "label").collect()[0].auc == 1.0


def test_running_sums_over_many_ranges(spark, monkeypatch):
    """Ranges of a few rows give the same sums as one."""
    monkeypatch.setattr(evaluate, "RANGE_ROWS", 7)
    rows = [(float(k * 37 % 101), k % 5, k % 3) for k in range(101)]
    df = spark.createDataFrame(rows, "s double, p int, q int").repartition(4)
    for falling in (True, False):
        got = [tuple(r) for r in evaluate.cumulated(df, "s", {"tp": "p", "fp": "q"}, falling).select("s", "tp", "fp").orderBy(F.desc("s") if falling else "s").collect()]
        tp = fp = 0
        want = []
        for s, p, q in sorted(rows, reverse=falling):
            tp, fp = tp + p, fp + q
            want.append((s, tp, fp))
        assert got == want
    assert evaluate.cumulated(df.limit(0), "s", {"tp": "p"}).count() == 0


def test_stages_are_reconciled(spark, tmp_path):
    """Reads that a stage lost, or has twice, are named."""
    for name, ids in (("reads", "abcd"), ("blocks", "abd"), ("sites", "aabbd")):
        spark.createDataFrame([(x, 1) for x in ids], "read_id string, n int").write.parquet(str(tmp_path / name))
    main(["reconcile", "--tables", ",".join(f"{x}={tmp_path / x}" for x in ("reads", "blocks", "sites")), "--out", str(tmp_path / "o")])
    got = {r.read_id: (r.reads, r.blocks, r.sites, r.complete) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {"a": (1, 1, 2, False), "b": (1, 1, 2, False), "c": (1, 0, 0, False), "d": (1, 1, 1, True)}
