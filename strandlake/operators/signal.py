"""Signal operators. Kernels with bounded reach are window expressions over sample rows (read, sample, value); the
recursions (peaks, transition windows) are grouped NumPy calls, one read at a time, over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import to_picoampere
from . import kernels as K

# The level and spread that polyA is standardized to, the spread above which a read is refused.
STANDARD_MU, STANDARD_SIGMA, REFUSED_SIGMA, POLYA_WIDTH = 108.9, 1.67, 3.0, 50


def samples(reads: DataFrame, signal: str, key: str = "read_id") -> DataFrame:
    """(read, sample_no, value) rows of array signals."""
    return reads.select(key, F.posexplode(signal).alias("sample_no", "value"))


def _order(read, order) -> Window:
    return Window.partitionBy(*([read] if isinstance(read, str) else read)).orderBy(*([order] if isinstance(order, str) else order))


def box_smooth(value: str, read, order, width: int) -> Column:
    """Sum over rows -width//2 .. (width-1)//2 divided by width, also at the ends."""
    return F.sum(value).over(_order(read, order).rowsBetween(-(width // 2), (width - 1) // 2)) / width


def slope(value: str, read, order) -> Column:
    """Slopes over 3 and 5 points added; where a window leaves the read it counts 0."""
    w = _order(read, order)
    x = {k: (F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)) for k in (-2, -1, 1, 2)}
    one = (x[1] - x[-1]) / 2
    two = (-2 * x[-2] - x[-1] + x[1] + 2 * x[2]) / 10
    return F.coalesce(one, F.lit(0.0)) + F.coalesce(two, F.lit(0.0))


def slope_magnitude(df: DataFrame, value: str, read, order, name: str = "magnitude") -> DataFrame:
    """|slope| smoothed over 3 rows."""
    df = df.withColumn("_slope", F.abs(slope(value, read, order)))
    return df.withColumn(name, box_smooth("_slope", read, order, 3)).drop("_slope")


def gaussian_smooth(value: str, read, order, bandwidth: float) -> Column:
    """Gaussian weights over 3 bandwidths on either side, renormalised at the ends."""
    w = _order(read, order)
    reach = int(3 * bandwidth)
    total, weight = None, None
    for k in range(-reach, reach + 1):
        g = math.exp(-(k * k) / (2 * bandwidth * bandwidth))
        x = F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k < 0 else F.col(value)
        part, share = F.coalesce(x * g, F.lit(0.0)), F.when(x.isNotNull(), g).otherwise(0.0)
        total, weight = (part, share) if total is None else (total + part, weight + share)
    return total / weight


def local_maxima(df: DataFrame, value: str, read, order) -> DataFrame:
    """Rows above both neighbours."""
    w = _order(read, order)
    return df.withColumn("_before", F.lag(value).over(w)).withColumn("_after", F.lead(value).over(w)).filter(f"{value} > _before and {value} > _after").drop("_before", "_after")


def changes(df: DataFrame, state: str, read, order, name: str = "border_no") -> DataFrame:
    """Rows where the state differs from the row before, numbered; the first row of a read counts."""
    w = _order(read, order)
    place = F.row_number().over(w) - 1
    df = df.withColumn("place", place).withColumn("_before", F.lag(state).over(w))
    return df.filter(F.col("_before").isNull() | (F.col("_before") != F.col(state))).drop("_before").withColumn(name, F.row_number().over(_order(read, "place")) - 1)


def base_blocks(df: DataFrame, state: str, read, order) -> DataFrame:
    """(read, block_no, start, end): the base blocks of 0/1 states, one a row. Leading and trailing runs of state 1 count as
    base, as does a read of ones only; a block goes from one run of zeros to where the next run begins. No read is an array."""
    keys = [read] if isinstance(read, str) else read
    runs = changes(df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))), state, read, order, "_run")
    w = _order(read, "place")
    runs = runs.withColumn("_next", F.lead("place").over(w)).withColumn("_after", F.lead("place", 2).over(w))
    base = runs.filter((F.col(state) == 0) | ((F.col("_run") == 0) & F.col("_next").isNull()))
    start = F.when(F.col("_run") < 2, 0).otherwise(F.col("place")).cast("long")
    end = F.when(F.col("_after").isNull(), F.col("_n")).otherwise(F.col("_next")).cast("long")
    return base.select(*keys, F.floor(F.col("_run") / 2).cast("long").alias("block_no"), start.alias("start"), end.alias("end"))


def neighbour_parameters(blocks: DataFrame, read: str, block: str) -> DataFrame:
    """Parameters of the blocks before and after; the fixed values of no neighbour at the ends."""
    w = _order(read, block)
    out = blocks
    for name, move in (("prev", F.lag), ("next", F.lead)):
        out = out.withColumn(f"{name}_mu", move("mu", 1, K.NO_NEIGHBOUR[0]).over(w)).withColumn(f"{name}_sigma", move("sigma", 1, K.NO_NEIGHBOUR[1]).over(w))
    return out


def trimmed_std(df: DataFrame, value: str, read, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(read, n, sigma, sigma_trimmed): population deviation of all values, and of those between the exact, linearly
    interpolated percentiles (both included)."""
    read = [read] if isinstance(read, str) else read
    bounds = df.groupBy(*read).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_b"), F.count(value).alias("n"), F.stddev_pop(value).alias("sigma"))
    inside = F.when(F.col(value).between(F.get("_b", F.lit(0)), F.get("_b", F.lit(1))), F.col(value))
    return df.join(bounds, read).groupBy(*read, "n", "sigma").agg(F.stddev_pop(inside).alias("sigma_trimmed"))


def _polya(raw: np.ndarray, start: int, end: int):
    """(level, spread) of the middle half of the polyA signal, or why it is refused."""
    n = end - start
    if start < 0 or end > len(raw) or n < POLYA_WIDTH:
        return None, None, "short"
    part = raw[start:end]
    a, z = int(n * 0.25), int(n * 0.75)
    smooth = K.box(part, POLYA_WIDTH)[a:z]
    rest = part[a:z] - smooth
    if not np.std(rest) < REFUSED_SIGMA:
        return None, None, "noisy"
    lo, hi = np.percentile(rest, [5, 95])
    return float(np.mean(smooth)), float(np.std(rest[(rest >= lo) & (rest <= hi)])), None


def polya_levels(signal: Column, start: Column, end: Column) -> Column:
    """Level and spread of the polyA part of a signal, or why a read is refused (struct mu, sigma, refused); nulls without
    coordinates."""

    @F.pandas_udf("mu double, sigma double, refused string")
    def levels(signal: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if s is None or pd.isna(a) or pd.isna(z) else _polya(np.asarray(s, dtype=float), int(a), int(z)) for s, a, z in zip(signal, start, end)]
        return pd.DataFrame(rows, columns=["mu", "sigma", "refused"])

    return levels(signal, start, end)


def standardized(current: Column, mu: Column, sigma: Column) -> Column:
    """A signal moved to the standard level and spread, to three decimals."""
    return F.transform(current, lambda x: F.rint(((x - mu) / sigma * STANDARD_SIGMA + STANDARD_MU) * 1e3) / 1e3)


def standardize(reads: DataFrame) -> DataFrame:
    """Adds ``normalized`` (null for reads without polyA or that are refused) and ``refused`` (why) to reads with
    ``polya`` coordinates. The signal's arithmetic stays in the engine; two numbers a read come from NumPy."""
    pa_signal = reads.withColumn("_pa", to_picoampere(F.col("signal"), F.col("offset"), F.col("range"), F.col("digitisation")))
    out = pa_signal.withColumn("_l", polya_levels(F.col("_pa"), F.col("polya.start"), F.col("polya.end")))
    mu, sigma = F.col("_l.mu"), F.col("_l.sigma")
    scaled = standardized(F.col("_pa"), mu, sigma)
    rounded = lambda c: F.rint(c * 1e5) / 1e5
    normal = F.struct(scaled.alias("signal"), F.col("polya.start").alias("polya_start"), F.col("polya.end").alias("polya_end"), rounded(mu).alias("polya_mu"), rounded(sigma).alias("polya_sigma"))
    return out.withColumn("normalized", F.when(mu.isNotNull(), normal)).withColumn("refused", F.col("_l.refused")).drop("_pa", "_l")


#: Samples that are worked on at once: a batch of reads is cut into slices of about so many.
SAMPLES = 500_000


def lists(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The values of a list column, and where each row's begin and end in them; a null row is empty."""
    offsets = np.asarray(col.offsets).astype(np.int64)
    return col.values, offsets[:-1], np.where(np.asarray(col.is_null()), offsets[:-1], offsets[1:])


_ARROW = {"int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def per_reads(reads: DataFrame, keys: list[str], arrays: list[str], function, schema: str) -> DataFrame:
    """Maps slices of reads (rows with array columns) by a NumPy function; no shuffle. function takes a list of reads (a
    list of arrays each) and returns for each a tuple of the columns in schema behind the keys, or None for a failed
    read (nulls). Reads with a null array fail without a call. A slice has SAMPLES samples, or one longer read. Arrays are
    views of the batch, and results become columns at once: nothing is a row of Python objects."""
    names, kinds_ = zip(*[x.split() for x in schema.split(", ")])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.select(*keys).schema.fields)

    def run(batches):
        for b in batches:
            columns = [lists(b.column(len(keys) + k)) for k in range(len(arrays))]
            lost = np.zeros(b.num_rows, dtype=bool)
            for k in range(len(arrays)):
                lost |= np.asarray(b.column(len(keys) + k).is_null())
            held = [(values.to_numpy(zero_copy_only=False), a, z) for values, a, z in columns]
            done = np.concatenate([[0], np.cumsum(held[0][2] - held[0][1])])
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(done, done[at] + SAMPLES, "right")) - 1)
                to = min(to, b.num_rows)
                some = [i for i in range(at, to) if not lost[i]]
                got = dict(zip(some, function([[x[a[i] : z[i]] for x, a, z in held] for i in some])))
                rows = [got.get(i) or (None,) * len(names) for i in range(at, to)]
                out = [pa.array([r[c] for r in rows], _ARROW[kind]) for c, kind in enumerate(kinds_)]
                part = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *out], [*b.schema.names[: len(keys)], *names])
                at = to

    return reads.select(*keys, *arrays).mapInArrow(run, f"{kinds}, {schema}")


def per_read(reads: DataFrame, keys: list[str], arrays: list[str], function, schema: str) -> DataFrame:
    """per_reads for a function of one read's arrays."""
    return per_reads(reads, keys, arrays, lambda some: [function(*x) for x in some], schema)


def pick_peaks(reads: DataFrame, keys: list[str], signal: str = "signal", distance: int = 10) -> DataFrame:
    """(keys, peaks): places of slope peaks, no two closer than the distance."""
    return per_read(reads, keys, [signal], lambda x: (K.peaks(K.box(np.abs(K.slope(x.astype(float))), 3), distance).tolist(),), "peaks array<int>")


def initial_border(reads: DataFrame, keys: list[str], signal: str = "signal", distance: int = 10) -> DataFrame:
    """(keys, border): from the best transition window at each inner peak."""
    return per_read(reads, keys, [signal], lambda x: (K.border_of(K.initial_states(x.astype(float), distance)).tolist(),), "border array<int>")


def border_from_states(reads: DataFrame, keys: list[str], states: str = "states") -> DataFrame:
    """(keys, border): from 0/1 states that another program made."""
    return per_read(reads, keys, [states], lambda s: (K.border_of(s).tolist(),), "border array<int>")
