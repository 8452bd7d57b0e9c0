"""Scans and sinks: lines over several blocks, rejected lines, round trips."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake import schema as S
from strandlake.sources import readers, sinks


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of a few lines."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_over_blocks_and_files_are_numbered_in_order(spark, tmp_path, small_blocks):
    r = random.Random(1)
    lines = [f"{k} " + "x" * r.randrange(90) for k in range(120)]
    for k, (a, z) in enumerate(((0, 1), (1, 70), (70, 120))):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(lines[a:z]) + "\n")
    got = readers.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert [(x.row_no, x.value) for x in got.orderBy("row_no").collect()] == list(enumerate(lines))
    assert readers.first_line(spark, str(tmp_path), F.col("value")) == lines[0]


def test_good_and_bad_lines_add_up(spark, tmp_path, small_blocks):
    columns = "a int, b string, c double"
    lines = ["a\tb\tc", "1\tx\t2.5", "2\ty", "3\tz\t1\t9", "four\tx\t1", "5\t\t7", "6\tx\tnan?", "", "8\tp\t1e3\r"] + [f"{k}\tq\t{k}" for k in range(9, 60)]
    (tmp_path / "t.tsv").write_text("\n".join(lines) + "\n", newline="")
    rows = readers.with_reasons(spark, str(tmp_path / "t.tsv"), columns)
    bad = {r.row_no: (r.reason, r.line) for r in readers.rejected(rows).collect()}
    assert bad == {2: ("2 of 3 fields", lines[2]), 3: ("4 of 3 fields", lines[3]), 4: ("a: four", lines[4]), 6: ("c: nan?", lines[6]), 7: ("1 of 3 fields", "")}
    good = {r.row_no: (r.a, r.b, r.c) for r in readers.accepted(rows).collect()}
    assert good[1] == (1, "x", 2.5) and good[5] == (5, "", 7.0) and good[8] == (8, "p", 1000.0)
    assert 1 + len(good) + len(bad) == len(lines)
    assert {r.kind: r.lines for r in readers.line_counts(rows).collect()} == {"good": len(good), "fields": 3, "a": 1, "c": 1}
    with pytest.raises(ValueError):
        readers.with_reasons(spark, str(tmp_path / "t.tsv"), "a int, b string")


def test_tables_without_a_test_of_their_own(spark, tmp_path):
    """Stranded events, collapsed tables, transcript numbers and quoted CSV are read back as they were written."""
    e = spark.createDataFrame([("t", 14, "TAGGC", 0, "t", 1, 79.04, 1.0, 0.1, "TAGGC", 79.0, 1.0, 0.0, 53396, 53405, "+")], S.EVENT_COLUMNS + ", map_strand string")
    sinks.write_text(e.coalesce(1), str(tmp_path / "e"))
    back = readers.stranded_event_table(spark, str(tmp_path / "e")).drop("row_no")
    assert back.collect() == e.collect()
    names = [f.name for f in S.struct(S.COLLAPSED_COLUMNS).fields]
    row = ["1" if f.dataType.simpleString() != "string" else "x" for f in S.struct(S.COLLAPSED_COLUMNS).fields]
    (tmp_path / "c.tsv").write_text("\t".join(names) + "\n" + "\t".join(row) + "\n")
    assert [str(v).split(".")[0] for v in readers.collapsed_table(spark, str(tmp_path / "c.tsv")).drop("row_no").collect()[0]] == row
    (tmp_path / "i.csv").write_text("index,transcript\n0,ENST1\n1,ENST2\n")
    assert {tuple(r)[:2] for r in readers.transcript_index(spark, str(tmp_path / "i.csv")).collect()} == {(0, "ENST1"), (1, "ENST2")}
    (tmp_path / "q.csv").write_text('k,v\n1,"a, ""b"""\n2,c\n')
    assert [(r.k, r.v) for r in readers.csv_table(spark, str(tmp_path / "q.csv"), "k int, v string").orderBy("k").collect()] == [(1, 'a, "b"'), (2, "c")]


def test_alignment_text_round_trip(spark, tmp_path):
    """Nulls are sentinels in the text, levels have six digits, rows keep the order of reads and steps."""
    fields = [f.name for f in S.struct(S.ALIGNMENT_COLUMNS).fields]
    rows = [(r, f"r{r}", "t", "TAGGC", 16, 80.523749, 1.3826, 53397 - k, 53423, 26, k) for r in (2, 1) for k in range(30)]
    rows += [(1, "r1", "t", None, None, 91.5, 2.0, 5, 6, 1, 30), (1, "r1", "t", "AGGCA", 17, 0.0, 0.0, None, None, None, 31)]
    df = spark.createDataFrame(rows, S.ALIGNMENT_COLUMNS + ", row_no int").repartition(4)
    sinks.write_alignment(df, str(tmp_path / "a"))
    back = readers.alignment_table(spark, str(tmp_path / "a")).orderBy("row_no").collect()
    want = sorted(rows, key=lambda x: (x[0], x[-1]))
    assert [r.read_index for r in back] == [x[0] for x in want]
    digits = lambda v: float(f"{v:.6g}")
    fixed = [tuple({"kmer": "-", "mu": 0.0, "sigma": 0.0}.get(c, -1) if v is None else digits(v) if c in ("mu", "sigma") else v for c, v in zip(fields, x)) for x in want]
    assert [tuple(r[c] for c in fields) for r in back] == fixed
