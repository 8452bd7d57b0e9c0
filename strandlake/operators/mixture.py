"""Two-component normal mixtures of one-dimensional values in which the first mean is fixed; one fit per group.

`mixtures_of_groups` fits all groups and starts at once: a round of expectation and maximisation is one aggregate over the
counted values of all groups, so no group is one task's, and groups leave as they settle. `fixed_mean_mixtures` fits a
group's histogram where its rows meet, which is cheaper for groups of few different values.

In `fixed_mean_mixtures` values are first counted, so a fit sees a weighted histogram; expectation and maximisation run in NumPy per group. The
first start is deterministic: a two-means split of the values, the side nearer the fixed mean first. RESTARTS - 1 more
begin with two-means from random centres, by a fixed seed; the fit with the highest bound stays (of equal ones the first).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import round_np
from ..tables import stored

# Tolerance, rounds, regularisation, largest deviation, parameters counted by the criterion.
TOLERANCE, ROUNDS, REGULAR, MOST_SIGMA, PARAMETERS, RESTARTS = 1e-3, 100, 1e-6, 4.0, 5, 10


def split(values: np.ndarray, weight: np.ndarray, a: float | None = None, b: float | None = None) -> np.ndarray:
    """True for the values of the upper cluster of two-means, from the extremes or the given centres a < b."""
    a, b = values.min() if a is None else a, values.max() if b is None else b
    for _ in range(100):
        up = np.abs(values - b) < np.abs(values - a)
        if up.all() or not up.any():
            break
        na, nb = np.average(values[~up], weights=weight[~up]), np.average(values[up], weights=weight[up])
        if (na, nb) == (a, b):
            break
        a, b = na, nb
    return np.abs(values - b) < np.abs(values - a)


def fit(values: np.ndarray, weight: np.ndarray, fixed: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE, restarts: int = RESTARTS):
    """(mean1, sigma1, weight1, mean2, sigma2, weight2, bic, bounds): bounds are the mean log-likelihoods per round."""
    best = _fit(values, weight, fixed, split(values, weight), rounds, tolerance)
    rng = np.random.default_rng(0)
    for _ in range(restarts - 1 if len(values) > 2 else 0):
        centres = np.sort(rng.choice(values, 2, replace=False, p=weight / weight.sum()))
        got = _fit(values, weight, fixed, split(values, weight, *centres), rounds, tolerance)
        if got[-1][-1] > best[-1][-1] + 1e-12:
            best = got
    return best


def _fit(values: np.ndarray, weight: np.ndarray, fixed: float, up: np.ndarray, rounds: int, tolerance: float):
    first = up if weight[up].sum() and abs(np.average(values[up], weights=weight[up]) - fixed) < abs(np.average(values[~up], weights=weight[~up]) - fixed) else ~up
    r = np.column_stack([first, ~first]).astype(float)
    total = weight.sum()
    bounds: list[float] = []
    logp = None
    for _ in range(rounds + 1):
        nk = (r * weight[:, None]).sum(axis=0) + 10 * np.finfo(float).eps
        mean = (r * (weight * values)[:, None]).sum(axis=0) / nk
        mean[0] = fixed
        var = (r * weight[:, None] * (values[:, None] - mean) ** 2).sum(axis=0) / nk + REGULAR
        var = np.minimum(var, MOST_SIGMA**2)
        share = nk / total
        logs = -0.5 * (math.log(2 * math.pi) + np.log(var) + (values[:, None] - mean) ** 2 / var) + np.log(share)
        top = logs.max(axis=1, keepdims=True)
        logp = (top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True)))[:, 0]
        bounds.append(float((weight * logp).sum() / total))
        if len(bounds) > 1 and abs(bounds[-1] - bounds[-2]) < tolerance:
            break
        r = np.exp(logs - logp[:, None])
    bic = -2 * float((weight * logp).sum()) + PARAMETERS * math.log(total)
    sd = np.sqrt(var)
    return float(mean[0]), float(sd[0]), float(share[0]), float(mean[1]), float(sd[1]), float(share[1]), bic, bounds


def fixed_mean_mixtures(rows: DataFrame, group: str, value: str, fixed: DataFrame, places: int | None = None) -> DataFrame:
    """(group, mean1, sigma1, weight1, mean2, sigma2, weight2, bic, n): parameters rounded to 2 places. fixed: (group,
    fixed_mean). A group's histogram is one task's and has a row for each different value: levels of collapsed runs have
    three decimals, so it is small; for values of any precision ``places`` rounds them first."""
    level = F.col(value) if places is None else F.rint(F.col(value) * 10.0**places) / 10.0**places
    counts = rows.select(group, level.cast("double").alias("v")).filter("v is not null and not isnan(v)").groupBy(group, "v").agg(F.count("*").cast("double").alias("w"))
    kind = rows.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        got = fit(pdf["v"].to_numpy(), pdf["w"].to_numpy(), float(pdf["fixed_mean"].iloc[0]))
        return pd.DataFrame([[pdf[group].iloc[0], *[round(x, 2) for x in got[:6]], round(got[6], 6), int(pdf["w"].sum())]], columns=[group, "mean1", "sigma1", "weight1", "mean2", "sigma2", "weight2", "bic", "n"])

    return counts.join(fixed, group).groupBy(group).applyInPandas(one, f"{group} {kind}, mean1 double, sigma1 double, weight1 double, mean2 double, sigma2 double, weight2 double, bic double, n long")


#: Rounds that one job holds.
UNROLLED = 4
_EPS = 10 * float(np.finfo(float).eps)
_SUMS = ["_n1", "_n2", "_a", "_q1", "_q2"]


def _start_sums(up_first: Column) -> list[Column]:
    """Weights, and sums of the distance from the fixed mean and of its square, of both sides of a start."""
    side = lambda c, of: F.sum(F.when(of, c).otherwise(0.0))
    u, w = F.col("v") - F.col("f"), F.col("w")
    return [side(w, up_first), side(w, ~up_first), side(w * u, ~up_first), side(w * u * u, up_first), side(w * u * u, ~up_first)]


def _parameters(df: DataFrame, total: Column) -> DataFrame:
    """_v1, _m (second mean's distance from the fixed one), _v2, _p1, _p2 from the sums."""
    df = df.withColumns({"_k1": F.col("_n1") + _EPS, "_k2": F.col("_n2") + _EPS}).withColumn("_m", F.col("_a") / F.col("_k2"))
    var2 = (F.col("_q2") - 2 * F.col("_m") * F.col("_a") + F.col("_m") * F.col("_m") * F.col("_n2")) / F.col("_k2")
    most = F.lit(MOST_SIGMA * MOST_SIGMA)
    return df.withColumns(
        {"_v1": F.least(F.col("_q1") / F.col("_k1") + REGULAR, most), "_v2": F.least(F.greatest(var2, F.lit(0.0)) + REGULAR, most), "_p1": F.col("_k1") / total, "_p2": F.col("_k2") / total}
    )


def mixtures_of_groups(rows: DataFrame, group: str, value: str, fixed: DataFrame, places: int | None = None, starts: int = RESTARTS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(group, mean1, sigma1, weight1, mean2, sigma2, weight2, bic, n), parameters rounded to 2 places, for every group of
    rows that ``fixed`` (group, fixed_mean) names. Start s cuts a group's range at s / (starts + 1): the side whose mean is
    nearer the fixed mean is the first component. Each start goes on until its mean log-likelihood changes by less than
    ``tolerance``; of a group's starts the one with the highest stays (of equal ones the first). Null and NaN values are
    left out; a group without values has no row."""
    level = F.col(value).cast("double") if places is None else F.rint(F.col(value) * 10.0**places) / 10.0**places
    counts = rows.select(F.col(group).alias("g"), level.cast("double").alias("v")).filter("v is not null and not isnan(v)").groupBy("g", "v").agg(F.count("*").cast("double").alias("w"))
    means = fixed.select(F.col(group).alias("g"), F.col("fixed_mean").cast("double").alias("f"))
    hist = stored(counts.join(means, "g"), "histogram")
    range_ = hist.groupBy("g", "f").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.sum("w").alias("n"))
    begun = range_.select("*", F.explode(F.sequence(F.lit(1), F.lit(starts))).alias("s")).withColumn("_cut", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("s") / (starts + 1))
    up = F.col("v") > F.col("_cut")
    sides = hist.join(begun, ["g", "f"]).groupBy("g", "f", "s", "n", "_cut").agg(*[F.sum(F.when(of, x)).alias(name) for name, of, x in (("_wu", up, F.col("w")), ("_wd", ~up, F.col("w")), ("_su", up, F.col("w") * F.col("v")), ("_sd", ~up, F.col("w") * F.col("v")))])
    up_nearer = F.coalesce(F.abs(F.col("_su") / F.col("_wu") - F.col("f")) < F.abs(F.col("_sd") / F.col("_wd") - F.col("f")), F.lit(False))
    sides = sides.select("g", "f", "s", "n", "_cut", up_nearer.alias("_up"))
    sums = [c.alias(name) for name, c in zip(_SUMS, _start_sums(F.when(F.col("_up"), up).otherwise(~up)))]
    state = _parameters(hist.join(sides, ["g", "f"]).groupBy("g", "f", "s", "n").agg(*sums), F.col("n"))
    keep = ["g", "f", "s", "n", "_v1", "_m", "_v2", "_p1", "_p2", "_bound", "_done", "_round"]
    state = state.withColumns({"_bound": F.lit(None).cast("double"), "_done": F.lit(False), "_round": F.lit(0)}).select(*keep)

    def log_density(u: Column, var: Column, share: Column) -> Column:
        return -0.5 * (math.log(2 * math.pi) + F.log(var) + u * u / var) + F.log(share)

    finished = []
    while True:
        for _ in range(UNROLLED):
            both = hist.join(state, ["g", "f"])
            u = F.col("v") - F.col("f")
            both = both.withColumns({"_u": u, "_l1": log_density(u, F.col("_v1"), F.col("_p1")), "_l2": log_density(u - F.col("_m"), F.col("_v2"), F.col("_p2"))})
            top = F.greatest("_l1", "_l2")
            both = both.withColumn("_l", top + F.log(F.exp(F.col("_l1") - top) + F.exp(F.col("_l2") - top)))
            both = both.withColumns({"_r1": F.exp(F.col("_l1") - F.col("_l")) * F.col("w"), "_r2": F.exp(F.col("_l2") - F.col("_l")) * F.col("w")})
            own = [F.sum("_r1"), F.sum("_r2"), F.sum(F.expr("_r2 * _u")), F.sum(F.expr("_r1 * _u * _u")), F.sum(F.expr("_r2 * _u * _u"))]
            old = both.groupBy(*keep).agg(*[c.alias(name) for name, c in zip(_SUMS, own)], (F.sum(F.expr("w * _l")) / F.col("n")).alias("_now"))
            old = old.withColumnsRenamed({c: f"{c}_" for c in ("_v1", "_m", "_v2", "_p1", "_p2")})
            new = _parameters(old, F.col("n"))
            # a start whose bound has settled, or that has had its rounds, keeps the parameters that the bound is of
            settled = F.coalesce(F.abs(F.col("_now") - F.col("_bound")) < tolerance, F.lit(False)) | (F.col("_round") >= rounds)
            over = F.col("_done") | settled
            state = new.select("g", "f", "s", "n", *[F.when(over, F.col(f"{c}_")).otherwise(F.col(c)).alias(c) for c in ("_v1", "_m", "_v2", "_p1", "_p2")], F.when(F.col("_done"), F.col("_bound")).otherwise(F.col("_now")).alias("_bound"), over.alias("_done"), (F.col("_round") + 1).alias("_round"))
        seen = Observation()
        state = stored(state.observe(seen, F.count_if(~F.col("_done")).alias("open")), "mixtures")
        finished.append(state.filter("_done"))
        if not seen.get["open"]:
            break
        state = state.filter("not _done")
    whole = finished[0]
    for more in finished[1:]:
        whole = whole.unionByName(more)
    best = whole.groupBy("g").agg(F.max_by(F.struct("f", "n", "_v1", "_m", "_v2", "_p1", "_p2", "_bound"), F.struct("_bound", -F.col("s"))).alias("b")).select("g", "b.*")
    bic = -2 * F.col("_bound") * F.col("n") + PARAMETERS * F.log("n")
    values = {"mean1": F.col("f"), "sigma1": F.sqrt("_v1"), "weight1": F.col("_p1"), "mean2": F.col("f") + F.col("_m"), "sigma2": F.sqrt("_v2"), "weight2": F.col("_p2")}
    return best.select(F.col("g").alias(group), *[round_np(c, 2).alias(name) for name, c in values.items()], bic.alias("bic"), F.col("n").cast("long").alias("n"))


def next_model(model: DataFrame, fits: DataFrame) -> DataFrame:
    """A k-mer table with the fitted components in the place of the old ones: the step that ends a round of align and fit."""
    f = fits.select("kmer", F.col("sigma1").alias("_s1"), F.col("mean2").alias("_m2"), F.col("sigma2").alias("_s2"))
    out = model.join(f, "kmer", "left")
    return out.select("kmer", "mean_un", F.coalesce("_s1", "stdv_un").alias("stdv_un"), F.coalesce("_m2", "mean_mod").alias("mean_mod"), F.coalesce("_s2", "stdv_mod").alias("stdv_mod"))
