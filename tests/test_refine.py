"""The loop of align and fit: rounds, versions, when it stops and how it goes on."""

import numpy as np
from pyspark.sql import functions as F

from strandlake import schema as S
from strandlake.plans import entries


def sites(spark, calls):
    """An aligner whose levels depend on the table: each round the second component is found half-way to its place."""
    r = np.random.default_rng(2)
    noise = r.normal(0, 1.5, 600).tolist()

    def align(model):
        calls.append(1)
        m = {x.kmer: x for x in model.collect()}
        rows = []
        for kmer, goal in (("GGACT", 117.0), ("AGACT", 96.0)):
            x = m[kmer]
            near = x.mean_mod + (goal - x.mean_mod) / 2
            rows += [(kmer, round((x.mean_un if k % 3 else near) + v, 3)) for k, v in enumerate(noise)]
        return spark.createDataFrame([*rows, ("AAAAA", 1.0)], "kmer string, mean double")

    return align


def model(spark):
    return spark.createDataFrame([("GGACT", 124.0, 3.0, 108.0, 3.0), ("AGACT", 110.0, 3.0, 90.0, 3.0), ("AAAAA", 80.0, 2.0, 80.0, 2.0)], S.KMER_MODEL_COLUMNS)


def test_three_rounds_and_a_restart(spark, tmp_path):
    calls, folder = [], f"file://{tmp_path}/versions"
    first = entries.refine(sites(spark, calls), model(spark), ["GGACT", "AGACT"], folder, rounds=3, settled=0.001)
    assert len(calls) == 3 and entries.versions(spark, folder) == [0, 1, 2, 3]
    means = [{r.kmer: r.mean_mod for r in spark.read.parquet(f"{folder}/model-{k}").collect()} for k in range(4)]
    gaps = [abs(m["GGACT"] - 117.0) for m in means]
    assert gaps[0] == 9.0 and all(b < a for a, b in zip(gaps, gaps[1:])) and all(m["AAAAA"] == 80.0 for m in means)
    assert {r.kmer: r.mean_un for r in first.collect()} == {"GGACT": 124.0, "AGACT": 110.0, "AAAAA": 80.0}
    # a version that wasn't written whole doesn't count; the run goes on after the last whole one
    (tmp_path / "versions" / "model-4").mkdir()
    assert entries.versions(spark, folder) == [0, 1, 2, 3]
    calls.clear()
    again = entries.refine(sites(spark, calls), model(spark).limit(0), ["GGACT", "AGACT"], folder, rounds=4, settled=0.001)
    assert len(calls) == 1 and entries.versions(spark, folder) == [0, 1, 2, 3, 4]
    whole = entries.refine(sites(spark, []), model(spark), ["GGACT", "AGACT"], f"file://{tmp_path}/other", rounds=4, settled=0.001)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(again) == key(whole)


def test_it_stops_when_nothing_moves(spark, tmp_path):
    calls, folder = [], f"file://{tmp_path}/versions"
    out = entries.refine(sites(spark, calls), model(spark), ["GGACT", "AGACT"], folder, rounds=50, settled=0.5)
    last = entries.versions(spark, folder)[-1]
    assert 3 < last < 50 and len(calls) == last
    moved = entries.changes(spark.read.parquet(f"{folder}/model-{last - 1}"), out)
    assert moved.filter(F.col("change") > 0.5).isEmpty()
    entries.refine(sites(spark, calls), model(spark), ["GGACT", "AGACT"], folder, rounds=50, settled=0.5)
    assert len(calls) == last  # settled already
