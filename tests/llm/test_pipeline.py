"""The pipeline's stages against brute force, on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F
from test_dedup import plain_components, plain_exact
from test_text import good_and_bad, plain_hits

import corpus_pipeline
from strandlake.llm.common import Workspace


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t) for i, t, _ in good_and_bad(400)]
    r = random.Random(8)
    for i in range(400, 430):  # near copies of clean documents
        w = rows[(i * 7) % 400][1].split()
        if len(w) > 60:
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(430 + k, rows[k][1] + "\n") for k in range(1, 20)]
    passage = " ".join(f"item{k}" for k in range(20))
    rows += [(500, f"{rows[1][1]} {passage}."), (501, None), (502, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in good_and_bad(400)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, passage


def test_stages(spark, folder):
    at, passage = folder
    ws = Workspace(spark, "test")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(x.doc_id, x.text) for x in docs.collect()]
        docs = ws.put(stage(spark, docs, at), f"{k}")
        if k < 4:
            assert docs.columns == columns
            after = {x.doc_id: x.text for x in docs.collect()}
            assert all(after[i] == t for i, t in before if i in after)
        else:
            after = {x.doc_id: x for x in docs.collect()}
        seen.append((name, before, after))
    (_, before, after), exact, near, clean, pieces = seen
    good = {i for i, _, y in good_and_bad(400) if y}
    assert len(good - set(after)) <= 0.02 * len(good) and len(set(after) & (set(range(400)) - good)) <= 2
    assert set(exact[2]) == {k[0] for k in plain_exact(exact[1]) if k[3]}
    assert set(near[2]) == {i for i, (_, c) in plain_components(near[1], 5, 80).items() if i == c}
    assert set(clean[2]) == {x[0] for x in plain_hits(clean[1], [(1, passage)]) if not x[5]}
    assert 500 not in clean[2]
    assert set(pieces[2]) == set(clean[2]) and all(x.round_trip for x in pieces[2].values())


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 100


def test_stages_on_odd_tables(spark, folder, clash, empty):
    """Clashing columns, null ids, null texts, rows that repeat, and a table without rows: every stage works, all but the
    last return the columns that they got and texts as they were."""
    at, _ = folder
    odd = clash.withColumns({c: F.lit(3) for c in ("_sl_bucket", "_sl_map", "_sl_id", "_sl_text", "ends", "pieces", "component_id", "group_size", "item_id")})
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    for docs in (odd, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, at)
            rows = out.collect()
            if k < 4:
                assert out.columns == docs.columns and {(r.doc_id, r.text) for r in rows} <= texts
            assert bool(rows) == (docs is odd)


def test_without_labels_and_items(spark, folder, tmp_path):
    """No label: nothing is rejected. No test item: nothing is contaminated."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == docs.count()
