"""The whole segmentation of a read against plain loops: windows one by one, paths by enumeration."""

import math

import numpy as np
import pytest

from strandlake.operators import kernels as K
from strandlake.operators import mixture, segment

PRIOR = [0.85, 0.05, 0.05, 0.05]
MOVES = [[0.925, 0.025, 0.025, 0.025], [0.3, 0.5, 0.1, 0.1], [0.3, 0.1, 0.5, 0.1], [0.3, 0.1, 0.1, 0.5]]


def normal(x, mu, sd):
    d = math.exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))
    return 1e-38 if math.isnan(d) or d < 1e-38 else d


def window(x, mu, sd, before, after, rounds):
    """Score, states, mean and deviation of one window after that many rounds of hard re-estimation."""
    if len(x) < 4:
        return -10.0, None, mu, sd
    for _ in range(rounds):
        e = [[normal(v, m, s) for m, s in ((mu, sd), before, after)] + [1 / 80] for v in x]
        alpha, scale = [], []
        for t, row in enumerate(e):
            a = [row[j] * (PRIOR[j] if not t else sum(alpha[-1][i] * MOVES[i][j] for i in range(4))) for j in range(4)]
            scale.append(sum(a))
            alpha.append([v / scale[-1] for v in a])
        beta = [[1.0] * 4]
        for t in range(len(x) - 1, 0, -1):
            beta.insert(0, [sum(MOVES[i][j] * e[t][j] * beta[0][j] for j in range(4)) / scale[t] for i in range(4)])
        score = sum(map(math.log, scale)) / len(x)
        states = [max(range(4), key=lambda s: (a[s] * b[s], -s)) for a, b in zip(alpha, beta)]
        own = [v for v, s in zip(x, states) if s == 0]
        if own:
            mu = sum(own) / len(own)
            sd = min(4.0, max(1.0, math.sqrt(sum((v - mu) ** 2 for v in own) / len(own))))
        else:
            mu = math.nan
    return score, [s + 1 for s in states], mu, sd


def paths(n):
    if not n:
        yield ()
    for j in range(1, min(5, n) + 1):
        for rest in paths(n - j):
            yield (j, *rest)


def best(first, last, score, length, t_score, t_len):
    """The best of all ways to merge the blocks: the first of equals, blocks alone if none is above the floor."""
    top, pick = -math.inf, None
    for p in paths(last - first):
        total, at = 0.0, last
        for j in reversed(p):
            at -= j
            s = score[at, j - 1] * length[at, j - 1] + math.log(0.99) * (length[at, j - 1] - 1)
            if at + j < last:
                t = at + j - 1
                s += math.log(0.01) + math.log(0.1) + t_score[t] * t_len[t] + math.log(0.9) * (t_len[t] - 1) + total
            total = s
        if total > top:
            top, pick = total, p
    if pick is None or not top > -9999:
        pick = (1,) * (last - first)
    out, at = [], first
    for j in pick:
        out.append((at, j - 1))
        at += j
    return out


def plain(x, border, compat):
    if len(border) % 2 or len(border) < 12 or len(border) - 1 >= len(x):
        return None
    bs, be, ts, te = border[::2], border[1::2], border[1:-1:2], border[2:-1:2]
    n = len(bs)
    t_score, t_len = [], [e - s for s, e in zip(ts, te)]
    for s, e in zip(ts, te):
        y, k = x[s:e], np.arange(e - s)
        if e - s < 2:
            t_score.append(-10.0)
            continue
        slope, at = np.polyfit(k, y, 1) if e - s > 2 else (y[1] - y[0], y[0])
        res = y - at - slope * k
        sd = math.sqrt(float(res @ res) / len(y))
        t_score.append(-0.5 * math.log(2 * math.pi) - math.log(sd) - 0.5 if e - s > 2 and sd > 1e-9 else math.nan)
    par = {(i, j): (float(x[bs[i] : be[i + j]].mean()), max(float(x[bs[i] : be[i + j]].std()), 0.1)) for i in range(n) for j in range(5) if i + j < n}
    length = np.zeros((n, 5))
    for i, j in par:
        length[i, j] = be[i + j] - bs[i]
    none = (-2000.0, 2.0)
    for _ in range(2):
        score, new = np.full((n, 5), np.nan), {}
        for (i, j), (mu, sd) in par.items():
            before, after = par[i - 1, 0] if i else none, par[i + j + 1, 0] if i + j + 1 < n else none
            s, _, mu, sd = window(x[bs[i] : be[i + j]].tolist(), mu, sd, before, after, 20)
            score[i, j], new[i, j] = s, (mu, sd)
        par = new
        cuts = [*range(0, n, 11), n]
        regions = [best(a, z, score, length, t_score, t_len) for a, z in zip(cuts, cuts[1:])]
        repairs = [best(l[-1][0], r[0][0] + r[0][1] + 1, score, length, t_score, t_len) for l, r in zip(regions, regions[1:]) if l[-1][1] or r[0][1]]
    state = np.zeros(len(x), int)

    def stand(path):
        for b, m in path[:-1]:
            state[ts[b + m] : te[b + m]] = 1

    for r in regions:
        stand(r)
    if not compat:
        for l, r in zip(regions, regions[1:]):
            if not l[-1][1] and not r[0][1]:
                state[ts[r[0][0] - 1] : te[r[0][0] - 1]] = 1
    for p in repairs:
        state[bs[p[0][0]] : be[p[-1][0] + p[-1][1]]] = 0
        stand(p)
    final = [0] + [k for k in range(1, len(x)) if state[k] != state[k - 1]] + [len(x)]
    out = np.zeros(len(x), int)
    spans = list(zip(final[::2], final[1::2]))
    own = []
    for a, z in spans:
        hit = [(i, j) for i, j in par if bs[i] == a and be[i + j] == z]
        mu, sd = par[hit[0]] if hit else (math.nan, min(4.0, max(1.0, float(x[a:z].std()))))
        own.append((float(x[a:z].mean()) if math.isnan(mu) else mu, sd))
    for k, (a, z) in enumerate(spans):
        before, after = own[max(k - 1, 0)], own[min(k + 1, len(own) - 1)]
        states = window(x[a:z].tolist(), *own[k], before, after, 1)[1]
        out[a:z] = states or 1
    return final, out.tolist()


def read(seed):
    """A read of blocks at levels with transitions between, some of which are no change of level."""
    r = np.random.default_rng(seed)
    parts, border, level = [], [0], 100.0
    n = int(r.integers(6, 27))
    for k in range(n):
        level = level if r.random() < 0.4 else 100 + r.normal(0, 12)
        parts.append(level + r.normal(0, r.choice([1.0, 2.5]), int(r.integers(2, 12))))
        border.append(border[-1] + len(parts[-1]))
        if k < n - 1:
            parts.append(level + np.linspace(0, 6, int(r.integers(1, 5))) + r.normal(0, 1, 1)[0])
            border.append(border[-1] + len(parts[-1]))
    return np.concatenate(parts), border


@pytest.mark.parametrize("compat", [True, False])
def test_segmentation_against_plain_loops(compat):
    reads = [read(seed) for seed in range(12)]
    got = K.segment_many([(x, np.array(b)) for x, b in reads], compat)
    merged = 0
    for (x, b), g in zip(reads, got):
        final, states = plain(x, b, compat)
        assert g[0].tolist() == final and g[1].tolist() == states
        merged += len(final) < len(b)
    assert merged > 4
    assert plain(np.zeros(30), [0, 3, 5, 30], compat) is None and K.segment(np.zeros(30), np.array([0, 3, 5, 30]), compat) is None


def test_forward_scores_in_the_engine(spark):
    r = np.random.default_rng(4)
    rows = [(k, [float(v) for v in r.normal(100, 3, n)]) for k, n in enumerate((1, 3, 4, 9, 40))] + [(9, None)]
    got = {x.k: x.loglik for x in segment.forward_scores(spark.createDataFrame(rows, "k int, signal array<double>"), ["k"]).collect()}
    for k, x in rows[:-1]:
        mu, sd = float(np.mean(x)), max(float(np.std(x)), 0.1)
        assert got[k] == pytest.approx(window(x, mu, sd, (-2000.0, 2.0), (-2000.0, 2.0), 1)[0])
    assert got[9] is None


def test_window_fits_in_the_engine(spark):
    """Rounds of hard re-estimation against plain loops; short, empty and null signals."""
    r = np.random.default_rng(14)
    rows = [(k, [float(v) for v in r.normal(100, 4, n)]) for k, n in enumerate((4, 5, 30, 80))] + [(7, [1.0, 2.0]), (8, []), (9, None)]
    got = {x.k: x for x in segment.window_fits(spark.createDataFrame(rows, "k int, signal array<double>"), ["k"], rounds=6).collect()}
    for k, x in rows[:4]:
        score, states, mu, sd = window(x, float(np.mean(x)), max(float(np.std(x)), 0.1), (-2000.0, 2.0), (-2000.0, 2.0), 6)
        assert (got[k].mu, got[k].sigma, got[k].loglik) == pytest.approx((mu, sd, score), nan_ok=True) and got[k].states == states
    assert (got[7].mu, got[7].sigma, got[7].loglik, got[7].states) == (1.5, 0.5, -10.0, None)
    assert all(got[k].mu is None and got[k].loglik is None for k in (8, 9))


def test_restarts_keep_the_best_fit():
    """Ten starts are at least as good as the first alone, and the same every time."""
    for seed in range(12):
        r = np.random.default_rng(seed)
        x = np.round(np.concatenate([r.normal(100, 1, 300), r.normal(103, 2, 80), r.normal(140, 1, int(r.integers(2, 40)))]), 1)
        v, w = np.unique(x, return_counts=True)
        one, ten = (mixture.fit(v, w.astype(float), 100.0, restarts=k) for k in (1, 10))
        assert ten[-1][-1] >= one[-1][-1] - 1e-12 and ten == mixture.fit(v, w.astype(float), 100.0)
        assert all(b >= a - 1e-9 for a, b in zip(ten[-1], ten[-1][1:]))


def test_mixtures_of_all_groups_at_once(spark):
    """Groups of their own sizes and places; each fit is as good at least as the one of its histogram alone."""
    r = np.random.default_rng(8)
    rows, want = [], {}
    for name, f, m, n in (("a", 120.0, 112.0, 400), ("b", 95.0, 104.0, 150), ("c", 80.0, 80.0, 60)):
        x = np.round(np.concatenate([r.normal(f, 1.5, n), r.normal(m, 2.0, n // 2)]), 2)
        rows += [(name, float(v)) for v in x]
        v, w = np.unique(x, return_counts=True)
        want[name] = mixture.fit(v, w.astype(float), f), len(x)
    rows += [("a", None), ("b", math.nan), ("d", 1.0), ("one", 5.0)]
    fixed = spark.createDataFrame([("a", 120.0), ("b", 95.0), ("c", 80.0), ("none", 1.0), ("one", 5.0)], "k string, fixed_mean double")
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    got = {g.k: g for g in mixture.mixtures_of_groups(df, "k", "x", fixed, starts=3).collect()}
    assert set(got) == {"a", "b", "c", "one"}
    for name, (fit, n) in want.items():
        g = got[name]
        assert g.n == n and g.mean1 == fit[0] and g.bic < fit[6] + 4e-3 * n
        if name != "c":
            assert abs(g.mean2 - fit[3]) < 0.3 and abs(g.weight1 - fit[2]) < 0.04
    assert mixture.mixtures_of_groups(df.limit(0), "k", "x", fixed, starts=2).count() == 0
