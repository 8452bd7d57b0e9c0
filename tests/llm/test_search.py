"""Ranked search against a plain loop over all documents and items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from texts import prose

from strandlake.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    have = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in have if c), sum(c.total() for _, c in have)
    df = Counter(t for _, c in have for t in c)
    asked: dict = {}
    for i, t in items:
        if i is not None and t is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scores = []
        for d, c in have:
            if not c:
                continue
            m = 100 - 90 + (90 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out)


def asked():
    r = random.Random(9)
    items = [(i, prose(f"item{i}", r.choice([1, 3, 12, 40]))) for i in range(25)]
    return [*items, (100, "The hot OF of"), (101, ""), (102, None), (None, "the of"), (103, "nosuchterm"), (104, "ha x90 é 日本語 don"), (105, prose("shared", 40)), (3, "rows of one item"), (3, "rows of one item")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(asked(), "item_id long, text string")


def found(df):
    return sorted(tuple(x) for x in df.collect())


def test_against_a_plain_loop(docs, rows, items):
    """Null, empty and odd texts, ties among copies, rows of one item, terms that nothing has."""
    got = S.search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == plain(rows, asked())


@pytest.mark.parametrize("k", [1, 3, 40])
def test_depths_and_small_blocks(docs, rows, items, k, monkeypatch):
    """Any depth, and any cut into parts, gives the same documents."""
    monkeypatch.setattr(S, "CELLS", 500)
    assert found(S.search(docs, items, k=k, part=900)) == plain(rows, asked(), k)


def test_clashing_columns_repeated_rows_and_null_ids(clash, spark):
    data = [(x.doc_id, x.text) for x in clash.collect()]
    items = spark.createDataFrame([(1, prose(1, 20), 0), (2, "only here", 0)], "item_id long, text string, score int")
    got = S.search(clash, items).collect()
    assert sorted((x.item_id, x.rank, str(x.doc_id), x.score) for x in got) == sorted((a, b, str(c), d) for a, b, c, d in plain(data, [(1, prose(1, 20)), (2, "only here")]))


def test_empty_tables(empty, docs, items, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert S.search(empty, items).count() == 0
    assert S.search(docs, none).count() == 0
    assert S.search(empty, none).count() == 0


def test_one_very_long_text(spark):
    data = [(1, "alpha beta " * 300_000), (2, "alpha"), (3, "beta gamma"), (4, None)]
    items = [(7, "Alpha"), (8, "beta gamma delta")]
    assert found(S.search(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == plain(data, items)


def test_bounds_hold(spark):
    """A byte, a unit less, is below the exact value, and never above 255."""
    r = np.random.default_rng(0)
    tf, n = r.integers(1, 10**6, 10_000), r.integers(1, 10**7, 10_000)
    s = S.saturation(np.minimum(tf, n), n, 10**6, 10**9)
    b = -(-s // S.UNIT)
    assert b.max() <= 255 and (b * S.UNIT >= s).all() and ((b - 1) * S.UNIT < s).all()
    assert S.saturation(np.array([10**9]), np.array([10**9]), 1, 10**9)[0] <= S.UNIT * 255
    assert (S.unpack(S.pack(tf)) == tf).all() and len(S.unpack(S.pack(tf[:0]))) == 0
