"""Interval joins and packed k-mers against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandlake.functions import arrays as A
from strandlake.functions import kmers as P
from strandlake.operators import intervals as I
from strandlake.operators import segment


def made(seed):
    r = random.Random(seed)
    left = [(r.choice(["a", "b", None]), k, *sorted((r.randrange(-50, 400), r.randrange(-50, 400)))) for k in range(60)]
    left += [("a", 100 + k, x := r.randrange(300), x + r.randrange(3)) for k in range(80)] + [("a", 300, None, 5), ("b", 301, 9, 3), ("c", 302, 0, 1)]
    right = [(r.choice(["a", "b"]), f"r{k}", x := r.randrange(-60, 380), x + r.choice([0, 1, 5, 200])) for k in range(70)] + [("a", "r5", 7, 7), ("a", "null", None, None), (None, "no", 0, 900)]
    return left, right


@pytest.mark.parametrize("width,hot", [(None, 50_000), (1, 4), (7, 3), (1000, 10)])
def test_overlaps_against_all_pairs(spark, width, hot):
    """Each overlapping pair once, whatever the bins; rows that repeat repeat; nulls and empty ranges join nothing."""
    left, right = made(width or 0)
    a = spark.createDataFrame(left + left[:3], "read string, block int, start long, end long").repartition(3)
    b = spark.createDataFrame(right, "read string, bin string, low long, high long")
    got = I.overlap_join(a, b, ["read"], ("start", "end"), ("low", "high"), width, hot)
    assert got.columns == ["read", "block", "start", "end", "bin", "low", "high"]
    want = [(*x, *y[1:]) for x in left + left[:3] for y in right if x[0] is not None and x[0] == y[0] and None not in x and None not in y and x[2] <= x[3] and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hot_bins_are_split(spark):
    """All rows in one bin: parts of the left side meet copies of the right side, and no part holds most of the rows."""
    a = spark.range(2000).select(F.lit("a").alias("read"), F.col("id").alias("block"), (F.col("id") % 5).alias("start"))
    b = spark.createDataFrame([("a", k, 0, k) for k in range(5)], "read string, n int, low long, high long")
    got = I.rows_in_ranges(a, b, ["read"], "start", "low", "high", 1000)
    assert got.count() == sum(400 * (k + 1) for k in range(5))
    split = I.overlap_join(a, b, ["read"], ("start", "start"), ("low", "high"), 1000, 100)
    assert sorted(map(tuple, split.select("block", "n").collect())) == sorted(map(tuple, got.select("block", "n").collect()))


def test_join_of_rows_is_the_filter_of_arrays(spark):
    """Blocks between two samples: joined as rows, and filtered as one array a read."""
    r = random.Random(8)
    reads = [(k, r.randrange(100), r.randrange(60, 160), [(s, s + 3) for s in sorted(r.sample(range(200), 40))]) for k in range(25)]
    arrays = spark.createDataFrame(reads, "read int, lo int, hi int, blocks array<struct<start:int,end:int>>")
    want = {x.read: [b.start for b in x.blocks] for x in segment.align_inputs(arrays, "lo", "hi").collect() if x.blocks}
    rows = arrays.select("read", F.explode("blocks").alias("b")).select("read", "b.start", "b.end")
    got = I.rows_in_ranges(rows, arrays.select("read", "lo", "hi"), ["read"], "start", "lo", "hi").groupBy("read").agg(F.array_sort(F.collect_list("start")).alias("s"))
    assert {x.read: x.s for x in got.collect()} == want


def test_empty_sides(spark):
    a = spark.createDataFrame([], "read string, start long, end long")
    b = spark.createDataFrame([("a", 1, 2)], "read string, low long, high long")
    assert I.overlap_join(a, b, ["read"], ("start", "end"), ("low", "high")).count() == 0
    assert I.overlap_join(b, a, ["read"], ("low", "high"), ("start", "end")).count() == 0


@pytest.mark.parametrize("k", [1, 5, 9, 15])
def test_packed_kmers(spark, k):
    r = random.Random(k)
    seqs = ["", "ACGT"[:k], "N" * 40, "ACGTNACGTA", None] + ["".join(r.choice("ACGT" if r.random() < 0.97 else "NXn") for _ in range(n)) for n in (k, k + 1, 26, 27, 28, 31, 32, 54, 200, 1000)]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string")
    got = P.packed_kmers(df, "s", k, ["id"]).select("id", "place", P.kmer_text(F.col("kmer"), k).alias("t"), "kmer")
    got = got.withColumn("n", P.kmer_number(F.col("t")))
    rows = got.collect()
    want = [(i, p, s[p : p + k]) for i, s in enumerate(seqs) if s for p in range(len(s) - k + 1) if set(s[p : p + k]) <= set("ACGT")]
    assert sorted((x.id, x.place, x.t) for x in rows) == sorted(want)
    assert all(x.n == x.kmer for x in rows)


def test_packed_and_written_kmers_agree(spark):
    df = spark.createDataFrame([(1, "ACGTNACGTAGGCATNNACGTTT")], "id int, s string")
    words = {(w.pos - 2, w.kmer) for w in df.select(F.explode(A.windows_of(F.col("s"), 5)).alias("w")).select("w.*").collect()}
    packed = {(x.place, x.t) for x in P.packed_kmers(df, "s").select("place", P.kmer_text(F.col("kmer")).alias("t")).collect()}
    assert words == packed
    with pytest.raises(ValueError):
        P.packed_kmers(df, "s", 16)


def test_long_sequences_are_linear(spark):
    """Two million letters in one row."""
    df = spark.createDataFrame([(1, "ACGGT" * 400_000)], "id int, s string")
    P.packed_kmers(df.limit(0), "s").count()
    start = time.perf_counter()
    assert P.packed_kmers(df, "s").groupBy("kmer").count().count() == 5
    assert time.perf_counter() - start < 20
