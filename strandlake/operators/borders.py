"""Peaks, transition windows and first borders over sample rows (keys, place, value), in the engine.

A signal of any length is rows here, not an array in one task's memory: plateaus and slopes are windows, greedy spacing of
peaks is rounds of local dominance, and the windows around a peak are scored from running sums of its own few samples.
The array kernels of ``signal`` give the same borders for reads that are short enough to be one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import discard, stored
from . import kernels as K
from .signal import slope_magnitude

#: Rounds of dominance that one job holds.
ROUNDS = 4
REACH, STEEP, SPREAD = 8, 5.0, 2.0
_CONSTANT = -0.5 * (K.LOG_2PI + 2 * math.log(SPREAD))


def tops(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, place, y): middles of the flat stretches of ``value`` that are above the stretches before and after."""
    w = Window.partitionBy(*keys).orderBy("place")
    edge = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.lag("place").over(w).isNotNull()), 0).otherwise(1)
    flat = rows.select(*keys, "place", F.col(value).alias("y"), edge.alias("_edge")).withColumn("_flat", F.sum("_edge").over(w))
    flat = flat.groupBy(*keys, "_flat").agg(F.first("y").alias("y"), F.min("place").alias("_a"), F.max("place").alias("_b"))
    v = Window.partitionBy(*keys).orderBy("_flat")
    flat = flat.withColumn("_before", F.lag("y").over(v)).withColumn("_after", F.lead("y").over(v)).filter("y > _before and y > _after")
    return flat.select(*keys, F.floor((F.col("_a") + F.col("_b")) / 2).cast("long").alias("place"), "y")


def spaced(peaks: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """The peaks (keys, place, y) that stay when, highest first (of equals the later), each removes all nearer than the
    distance. A peak that is highest among the undecided ones around it stays and its neighbours go; ROUNDS such rounds
    share one shuffle and sort, and are repeated from the written table until nothing is undecided. There are as many
    rounds as the longest chain of peaks has members of which each is near the next, higher one."""
    near = Window.partitionBy(*keys).orderBy("place").rangeBetween(-(distance - 1), distance - 1)
    rank = F.struct("y", "place")
    state, last = peaks.withColumn("_stays", F.lit(None).cast("boolean")), None
    while True:
        for _ in range(ROUNDS):
            open_ = F.col("_stays").isNull()
            state = state.withColumn("_top", open_ & (rank == F.max(F.when(open_, rank)).over(near)))
            gone = open_ & F.max("_top").over(near)
            state = state.withColumn("_stays", F.when(F.col("_top"), True).when(gone, False).otherwise(F.col("_stays"))).drop("_top")
        seen = Observation()
        state = stored(state.observe(seen, F.count_if(F.col("_stays").isNull()).alias("undecided")), "peaks")
        if last is not None:
            discard(last)
        last = state
        if not seen.get["undecided"]:
            return state.filter("_stays").drop("_stays")


def pick_peaks(samples: DataFrame, keys: list[str], distance: int = 10) -> DataFrame:
    """(keys, place, y): peaks of the smoothed slope magnitude, no two closer than the distance."""
    return spaced(tops(slope_magnitude(samples, "value", keys, "place"), keys, "magnitude"), keys, distance)


def transition_windows(samples: DataFrame, peaks: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """(keys, peak, start, end): around each peak the window that is best as a steep line with flat flanks, the first of
    equals; peaks without a window are left out. Sums of a window are differences of running arrays of the peak's few
    samples; every candidate is a row. Around a line of slope b the squares add up to syy - 2 b sxy + b b sxx, with the
    best b or, where that is less steep, STEEP with its sign."""
    around = peaks.select(*keys, F.col("place").alias("peak"), F.explode(F.sequence(F.col("place") - reach, F.col("place") + reach)).alias("place"))
    held = around.join(samples.select(*keys, "place", "value"), [*keys, "place"]).groupBy(*keys, "peak").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("s"))
    middle = F.get("s", (F.col("peak") - F.col("s")[0]["place"]).cast("int"))["value"]
    held = held.select(*keys, "peak", "s", F.col("s")[0]["place"].alias("lo"), F.element_at("s", -1)["place"].alias("hi"), middle.alias("mid")).filter("lo < peak")
    held = held.withColumn("d", F.transform("s", lambda x: x["value"] - F.col("mid")))

    def running(term) -> Column:
        """Running sums, 0 first."""
        return F.aggregate("d", F.array(F.lit(0.0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + term(x, F.size(a) - 1)))

    held = held.select(*keys, "peak", "lo", "hi", running(lambda x, i: x).alias("c1"), running(lambda x, i: x * x).alias("c2"), running(lambda x, i: x * i).alias("ck"))

    def flat(a: Column, z: Column) -> Column:
        """Mean log density of samples a .. z - 1 around their mean; 0 for none."""
        s1 = F.get("c1", z) - F.get("c1", a)
        sse = F.get("c2", z) - F.get("c2", a) - s1 * s1 / (z - a)
        return F.when(z > a, _CONSTANT - F.greatest(sse, F.lit(0.0)) / (2 * SPREAD * SPREAD * (z - a))).otherwise(F.lit(0.0))

    size = (F.col("hi") - F.col("lo")).cast("int")
    flanks = (F.transform(F.sequence(F.lit(0), size), lambda i: flat(F.lit(0), i)), F.transform(F.sequence(F.lit(0), size), lambda i: flat(i + 1, size)))
    held = held.select(*keys, "peak", "lo", "hi", "c1", "c2", "ck", flanks[0].alias("left"), flanks[1].alias("right"))
    mid = (F.col("peak") - F.col("lo")).cast("int")
    held = held.withColumn("a", F.explode(F.sequence(F.lit(0), mid - 1)))
    first = F.greatest(mid + 1, F.col("a") + 3)
    held = held.filter(first <= size).withColumn("z", F.explode(F.sequence(first, size)))

    def part(c: str) -> Column:
        return F.get(c, F.col("z") + 1) - F.get(c, F.col("a"))

    n = (F.col("z") - F.col("a") + 1).cast("double")
    held = held.select(*keys, "peak", "lo", "a", "z", n.alias("n"), part("c1").alias("s1"), part("c2").alias("s2"), part("ck").alias("sk"), (F.get("left", F.col("a")) + F.get("right", F.col("z"))).alias("flanks"))
    sxy = F.abs(F.expr("sk - (a + z) / 2.0D * s1"))
    sxx = F.expr("n * (n * n - 1) / 12")
    sse = F.expr("s2 - s1 * s1 / n") - F.when(sxy >= STEEP * sxx, sxy * sxy / sxx).otherwise(STEEP * (2 * sxy - STEEP * sxx))
    score = _CONSTANT - F.greatest(sse, F.lit(0.0)) / (2 * SPREAD * SPREAD * F.col("n")) + F.col("flanks")
    best = F.max(F.struct(score.alias("score"), (-F.col("a")).alias("a"), (-F.col("z")).alias("z"))).alias("w")
    return held.groupBy(*keys, "peak", "lo").agg(best).select(*keys, "peak", (F.col("lo") - F.col("w.a")).alias("start"), (F.col("lo") - F.col("w.z")).alias("end"))


def borders_of(windows: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, border): 0, where the union of a read's windows begins and ends, and the read's size (keys, n). A stretch
    that touches an end of the read counts as base."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = windows.select(*keys, "start", "end", F.when(F.col("start") <= before + 1, 0).otherwise(1).alias("_new")).withColumn("_part", F.sum("_new").over(w))
    parts = parts.groupBy(*keys, "_part").agg(F.min("start").alias("start"), (F.max("end") + 1).alias("end"))
    parts = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_p"))
    out = sizes.join(parts, keys, "left")
    inner = F.filter(F.coalesce("_p", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda p: (p["start"] > 0) & (p["end"] < F.col("n")))
    border = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform(inner, lambda p: F.array(p["start"], p["end"]))), F.array(F.col("n").cast("long")))
    return out.select(*keys, border.cast("array<int>").alias("border"))


def initial_border(samples: DataFrame, keys: list[str], distance: int = 10) -> DataFrame:
    """(keys, border) of every read of sample rows (keys, place from 0 on, value): from the transition windows at all
    peaks but the first and last."""
    peaks = pick_peaks(samples, keys, distance)
    w = Window.partitionBy(*keys).orderBy("place")
    inner = peaks.withColumn("_b", F.lag("place").over(w)).withColumn("_a", F.lead("place").over(w)).filter("_b is not null and _a is not null")
    sizes = samples.groupBy(*keys).agg((F.max("place") + 1).alias("n"))
    return borders_of(transition_windows(samples, inner, keys), sizes, keys)
