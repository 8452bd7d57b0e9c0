"""Two-level segmentation of reads and what follows from it. A read is independent of all others, so the recursion runs
where the read's row is: no shuffle, a slice of reads at a time, whose windows are fitted together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import blocks_in_range
from . import kernels as K
from .signal import per_read, per_reads


def segment_reads(reads: DataFrame, keys: list[str], signal: str = "signal", border: str = "border", compat: bool = True) -> DataFrame:
    """(keys, final_border, states): both null for reads that can't be segmented."""

    def some(held):
        got = K.segment_many([(x.astype(float), b.astype(np.int64)) for x, b in held], compat)
        return [None if g is None else (g[0].tolist(), g[1].tolist()) for g in got]

    return per_reads(reads, keys, [signal, border], some, "final_border array<int>, states array<int>")


def forward_scores(rows: DataFrame, keys: list[str], signal: str = "signal") -> DataFrame:
    """(keys, loglik): mean forward log-likelihood of a window under its own mean and deviation (at least 0.1) and no
    neighbours."""

    def one(x: np.ndarray):
        x = x.astype(float)
        if len(x) < K.SHORTEST:
            return (K.SHORT_SCORE,)
        mu, sd = np.array([[x.mean(), K.NO_NEIGHBOUR[0], K.NO_NEIGHBOUR[0]]]), np.array([[max(x.std(), 0.1), K.NO_NEIGHBOUR[1], K.NO_NEIGHBOUR[1]]])
        _, scale = K.forward(K.emissions(x[None, :], mu, sd), np.array([len(x)]))
        return (float(np.log(scale[0]).mean()),)

    return per_read(rows, keys, [signal], one, "loglik double")


def window_fits(rows: DataFrame, keys: list[str], signal: str = "signal", rounds: int = 20) -> DataFrame:
    """(keys, mu, sigma, loglik, states): every signal as one window without neighbours, after so many rounds of hard
    re-estimation from its own mean and deviation (at least 0.1). Windows of fewer than SHORTEST samples keep these, with
    SHORT_SCORE and no states; empty ones are nulls."""

    def some(held):
        live = [x.astype(float) for (x,) in held if len(x)]
        if not live:
            return [None] * len(held)
        size = np.array([len(x) for x in live])
        ends = np.cumsum(size)
        mu, sd = np.array([x.mean() for x in live]), np.array([max(x.std(), 0.1) for x in live])
        none = np.tile(K.NO_NEIGHBOUR, (len(live), 1))
        got = iter(zip(*K.fit_windows(np.concatenate(live), ends - size, ends, mu, sd, none, none, rounds)))
        out = []
        for (x,) in held:
            m, s, score, states = next(got) if len(x) else (None, None, None, None)
            out.append((m, s, score, None if states is None else states.tolist()))
        return out

    return per_reads(rows, keys, [signal], some, "mu double, sigma double, loglik double, states array<int>")


def block_statistics(samples: DataFrame, keys: list[str]) -> DataFrame:
    """From sample rows (keys, block_no, value, state): mean, population deviation and count of samples in state 1
    (current), 2 (previous), 3 (next) of each block; 0 where there is none."""
    aggs = []
    for k, name in ((1, "curr"), (2, "prev"), (3, "next")):
        x = F.when(F.col("state") == k, F.col("value"))
        aggs += [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{name}_mu"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias(f"{name}_sigma"), F.count(x).alias(f"{name}_len")]
    return samples.groupBy(*keys, "block_no").agg(*aggs)


def block_samples(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Sample rows of all base blocks of segmented reads (signal, final_border, states)."""
    n = (F.size("final_border") / 2).cast("int")
    block = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            i.alias("block_no"),
            F.slice("signal", F.get("final_border", 2 * i) + 1, F.get("final_border", 2 * i + 1) - F.get("final_border", 2 * i)).alias("x"),
            F.slice("states", F.get("final_border", 2 * i) + 1, F.get("final_border", 2 * i + 1) - F.get("final_border", 2 * i)).alias("s"),
        ),
    )
    rows = reads.filter("final_border is not null").select(*keys, F.explode(block).alias("b"))
    return rows.select(*keys, "b.block_no", F.explode(F.arrays_zip(F.col("b.x").alias("value"), F.col("b.s").alias("state"))).alias("z")).select(*keys, "block_no", "z.value", "z.state")


def merge_windows(blocks: DataFrame, read: str, block: str, most: int = K.MERGE) -> DataFrame:
    """Every window of 1 to ``most`` consecutive blocks: (read, first block, merged, start, end), without a self-join: the
    end comes from the block that many rows ahead."""
    w = Window.partitionBy(read).orderBy(block)
    ends = F.array(*[F.lead("end", j).over(w) if j else F.col("end") for j in range(most)])
    out = blocks.select(read, F.col(block).alias("first_block"), "start", ends.alias("_ends")).select(read, "first_block", "start", F.posexplode("_ends").alias("merged", "end"))
    return out.filter("end is not null")


def window_moments(windows: DataFrame, sums: DataFrame, read: str) -> DataFrame:
    """Mean and deviation (at least 0.1) of the samples in [start, end) of each window, from running sums
    (read, place, s1, s2), where s1 and s2 add up all samples before the place."""
    a = sums.select(read, F.col("place").alias("start"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    z = sums.select(read, F.col("place").alias("end"), F.col("s1").alias("z1"), F.col("s2").alias("z2"))
    n = F.col("end") - F.col("start")
    mean = (F.col("z1") - F.col("a1")) / n
    var = (F.col("z2") - F.col("a2")) / n - mean * mean
    return windows.join(a, [read, "start"]).join(z, [read, "end"]).withColumn("mu", mean).withColumn("sigma", F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.1))).drop("a1", "a2", "z1", "z2")


def transition_loglik(samples: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per group: mean log density around its regression line; -10 for fewer than 2 points, null for an exact fit."""
    n = F.count("*")
    syy, sxy, sxx = F.regr_syy(F.col(y), F.col(x)), F.regr_sxy(F.col(y), F.col(x)), F.regr_sxx(F.col(y), F.col(x))
    var = F.greatest((syy - sxy * sxy / sxx) / n, F.lit(0.0))
    score = F.when(n < 2, F.lit(K.SHORT_SCORE)).when((n > 2) & (var > 1e-12), -0.5 * K.LOG_2PI - 0.5 * F.log(var) - 0.5)
    return samples.groupBy(*keys).agg(n.alias("n"), score.alias("loglik"))


def region_of(block: str):
    return F.floor(F.col(block) / K.REGION).cast("int")


def align_inputs(blocks: DataFrame, low: str, high: str) -> DataFrame:
    """Blocks of a read between two samples, for the aligner."""
    return blocks.withColumn("blocks", blocks_in_range(F.col("blocks"), F.col(low), F.col(high)))
