"""Periodic runs against a loop over all periods, and the query's columns against the contract's words."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from strandlake.llm import periodic_runs as P


def plain_runs(w, least=6, exponent=4):
    """All stretches of each period, kept where no smaller period fits."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(r, n):
    """Words with runs inside runs, over few or many letters."""
    w = []
    while len(w) < n:
        root = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, r.choice([3, 8, 40])))]
        if r.random() < 0.3:
            root += [root[0]] * 7
        w += root * r.choice([1, 1, 2, 3, 4, 5, 9]) + root[: r.randrange(len(root) + 1)]
    return w[:n]


def test_runs_against_a_plain_loop():
    r = random.Random(1)
    texts = [made(r, r.choice([0, 1, 5, 6, 7, 20, 60, 200])) for _ in range(400)] + [[0] * k for k in range(12)] + [[0, 1] * 40, list(range(300)) * 4, [*range(90)] * 5 + [1]]
    w = np.array([x for t in texts for x in t])
    at = np.cumsum([0] + [len(t) for t in texts])
    got = P.find_runs(w, at)
    assert sum(map(len, got.values())) > 300
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_runs(t), t


def test_long_periods_and_one_word_a_million_times():
    n = 200_000
    w = np.concatenate([np.arange(40_000).repeat(1)] + [np.arange(40_000)] * 4 + [np.zeros(n, np.int64)])
    got = P.find_runs(w, np.array([0, 200_000, 200_000 + n]))
    assert got == {0: [(0, 200_000, 40_000)], 1: [(0, n, 1)]}


def test_z_function():
    r = random.Random(2)
    for _ in range(200):
        s = [r.randrange(2) for _ in range(r.randrange(1, 40))]
        z = P.z_function(s)
        for i in range(1, len(s)):
            k = 0
            while i + k < len(s) and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


def test_other_exponents_are_refused():
    with pytest.raises(ValueError):
        P.find_runs(np.zeros(9, np.int64), np.array([0, 9]), exponent=3)


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, ln, q in runs for i in range(s + q, s + ln)}
    s, ln, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), s, ln, q, 1000 * ln // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_columns(spark, rows, clash, empty):
    """Nulls, empty and odd texts, rows that repeat, clashing columns, and texts with runs of words."""
    r = random.Random(5)
    more = [(1000 + i, " ".join(map(str, made(r, r.randrange(1, 150)))) + r.choice(["", " ", "\n\t"])) for i in range(300)]
    more += [(None, "a " * 7), (2000, "\x0b\x0c a b " * 9), (2001, "x\x1cy " * 6), (2001, "x\x1cy " * 6), (2002, "  " * 8)]
    data = [*rows, *more]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = P.digests(P.periodic_runs(P.with_repeats(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda x: str(x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((contract(*x) for x in data), key=key)
    clashing = [(x.doc_id, x.text) for x in clash.collect()]
    assert sorted(map(tuple, P.digests(P.periodic_runs(P.with_repeats(clash))).collect()), key=key) == sorted((contract(*x) for x in clashing), key=key)
    assert P.digests(P.periodic_runs(P.with_repeats(empty))).count() == 0


def test_spans_and_text_of_the_operator(spark):
    """Runs inside runs; the text itself comes back collapsed. A very long text is one row like any other."""
    long = "p q r " * 700_000
    got = {x.doc_id: x for x in P.periodic_runs(spark.createDataFrame([(1, "s " + "a a a a a a b " * 4 + "t"), (2, long)], "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 6, 1), (1, 28, 7), (8, 6, 1), (15, 6, 1), (22, 6, 1)]
    assert got[1].collapsed == "s a b t" and got[1].n_words == 30
    assert [tuple(x) for x in got[2].runs] == [(0, 2_100_000, 3)] and got[2].collapsed == "p q r"
