"""Peaks and borders: the engine's rows, the array kernels and the plain forms agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import queries
from strandlake.functions import arrays as A
from strandlake.operators import borders as B
from strandlake.operators import kernels as K
from strandlake.operators import signal


def signals():
    r = np.random.default_rng(11)
    out = [np.full(60, 3.0), np.zeros(1), np.arange(3.0), np.zeros(20), np.repeat([1.0, 5.0, 2.0], 15), np.tile([0.0, 8.0], 40), np.arange(300) % 7 * 30.0]  # slopes are whole numbers: equal heights are equal
    out += [np.repeat(r.integers(0, 9, 12) * 30.0, 15)] + [np.repeat(r.normal(100, 20, 12), 15) + r.normal(0, s, 180) for s in (0.5, 3.0)]
    out += [np.cumsum(r.normal(0, 6, n)) for n in (9, 17, 30, 200)] + [r.integers(0, 4, n) * 30.0 for n in (25, 120)]
    out.append(np.concatenate([np.arange(8) * 30.0 * k * (-1) ** k for k in range(1, 30)]))  # each turn is higher: a long chain
    return out


@pytest.mark.parametrize("distance", [1, 10])
def test_windows_of_all_peaks_against_the_plain_form(distance):
    """transition_windows is transition_window at random places, at edges and on flat signals."""
    r = np.random.default_rng(distance)
    many = 0
    for y in signals():
        at = np.unique(r.integers(0, len(y), 12))
        got = K.transition_windows(y, at)
        want = [K.transition_window(y, int(p)) for p in at]
        for g, w, p in zip(got, want, at):
            if g != w:  # sums in another order may part equal scores by a rounding
                score = lambda v: K.line_score(y[v[0] : v[1] + 1], False) + K.line_score(y[max(0, p - 8) : v[0]], True) + K.line_score(y[v[1] + 1 : min(len(y) - 1, p + 8)], True)  # noqa: B023, E731
                assert g is not None and w is not None and g[1] - g[0] > 2 and score(g) == pytest.approx(score(w), abs=1e-9)
            many += 1
    assert many > 100
    assert K.transition_windows(np.zeros(30), np.array([15])) == [K.transition_window(np.zeros(30), 15)]


def rows_of(spark, some):
    return spark.createDataFrame([(i, k, float(v)) for i, y in enumerate(some) for k, v in enumerate(y)], "read int, place long, value double").repartition(3)


def test_peaks_in_the_engine(spark):
    some = signals()
    got: dict = {}
    for r in B.pick_peaks(rows_of(spark, some), ["read"]).collect():
        got.setdefault(r.read, []).append(r.place)
    for i, y in enumerate(some):
        assert sorted(got.get(i, [])) == K.peaks(K.box(np.abs(K.slope(y)), 3), 10).tolist(), i


def test_greedy_spacing_needs_many_rounds(spark):
    """A rising chain is decided from its end: more rounds than one job holds."""
    rows = [("up", 5 * k, float(k)) for k in range(60)] + [("equal", 3 * k, 1.0) for k in range(10)] + [("one", 7, 1.0)]
    got: dict = {}
    for r in B.spaced(spark.createDataFrame(rows, "read string, place long, y double"), ["read"], 10).collect():
        got.setdefault(r.read, set()).add(r.place)
    assert got == {"up": {5 * k for k in range(59, -1, -2)}, "equal": {27, 15, 3}, "one": {7}}


def test_borders_in_the_engine_and_by_arrays(spark):
    some = signals()
    arrays = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(some)], "read int, signal array<double>")
    by_array = {r.read: r.border for r in signal.initial_border(arrays, ["read"]).collect()}
    by_rows = {r.read: r.border for r in B.initial_border(rows_of(spark, some), ["read"]).collect()}
    assert set(by_rows) == set(by_array) == set(range(len(some)))
    for i, y in enumerate(some):
        states = np.zeros(len(y), dtype=np.int8)
        for p in K.peaks(K.box(np.abs(K.slope(y)), 3), 10)[1:-1]:
            w = K.transition_window(y, int(p))
            if w:
                states[w[0] : w[1] + 1] = 1
        want = K.border_of(states).tolist()
        assert by_rows[i] == by_array[i] == want, i


def test_stretches_at_the_ends_are_base(spark):
    sizes = spark.createDataFrame([(1, 30), (2, 30), (3, 30)], "read int, n long")
    windows = spark.createDataFrame([(1, 0, 4), (1, 3, 8), (1, 10, 12), (1, 13, 15), (1, 25, 29), (2, 0, 29)], "read int, start long, end long")
    got = {r.read: r.border for r in B.borders_of(windows, sizes, ["read"]).collect()}
    assert got == {1: [0, 10, 16, 30], 2: [0, 30], 3: [0, 30]}


def plain_blocks(states):
    """Base blocks of one read's states by a loop."""
    zeros = [i for i, s in enumerate(states) if s == 0]
    s = [x if zeros and zeros[0] <= i <= zeros[-1] else 0 for i, x in enumerate(states)]
    border = [0, *[i for i in range(1, len(s)) if s[i] != s[i - 1]], len(s)]
    return [(border[k], border[k + 1]) for k in range(0, len(border), 2)]


def test_base_blocks_of_long_reads(spark, tmp_path):
    """Work follows the number of states: neither the array functions nor the query work out a read's states again for each
    of them. Reads without zeros, of one event, without user and events without value are there too."""
    r = np.random.default_rng(5)
    some = {1: r.integers(0, 2, 4000).tolist(), 2: [1] * 9, 3: [0] * 9, 4: [1], 5: [0], 6: [1, 1, 0, 1, 0, 0, 1], 7: [1, 0, 1], 8: [0, 1]}
    got: dict = {}
    rows = spark.createDataFrame([(i, s) for i, s in some.items()], "read int, s array<int>")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    twice = F.transform("s", lambda x: x * 2)
    blocks = A.border_blocks(A.state_border(A.base_ends(twice)))
    assert plan(rows.select(blocks)).count("transform(s#") == plan(rows.select(twice)).count("transform(s#") == 1
    for x in rows.select("read", A.border_blocks(A.state_border(A.base_ends(F.col("s")))).alias("b")).collect():
        assert [tuple(b) for b in x.b] == plain_blocks(some[x.read]), x.read
    events = [(i, k, None if k % 5 == 0 and not v else 120.0 if v else 80.0) for i, s in [*some.items(), (None, [0, 1, 0])] for k, v in enumerate(s)]
    events = [(e, i, k, v) for e, (i, k, v) in enumerate(events)]
    spark.createDataFrame(events, "event_id long, user_id long, k long, value double").selectExpr("event_id", "timestamp_seconds(k) AS ts", "user_id", "value").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for x in queries.blocks_from_border(spark, str(tmp_path)).orderBy("user_id", "block_no").collect():
        assert x.block_no == len(got.setdefault(x.user_id, []))
        got[x.user_id].append((x.start, x.end))
    assert got == {i: plain_blocks(s) for i, s in some.items()}
