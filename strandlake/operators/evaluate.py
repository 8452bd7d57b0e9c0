"""Rates, curves and checks over results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import list_literal, round_np, site_label
from ..tables import discard, stored


def site_rates(cells: DataFrame, site: str, state: str) -> DataFrame:
    """Share of state 1 among states 0 and 1, rounded to 2 places; other states (-1: unmapped) are missing."""
    known = F.when(F.col(state) >= 0, F.col(state))
    return cells.groupBy(site).agg(F.count(F.when(F.col(state) == 1, 1)).alias("modified"), F.count(F.when(F.col(state) == 0, 1)).alias("unmodified"), F.count(F.when(F.col(state) < 0, 1)).alias("missing"), round_np(F.avg(known.cast("double")), 2).alias("rate"))


def wide_to_long(df: DataFrame, keys: list[str], columns: list[str], name: str = "site", value: str = "state") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


#: Rows that one task cumulates.
RANGE_ROWS = 1_000_000


def cumulated(rows: DataFrame, order: str, sums: dict[str, str], falling: bool = False) -> DataFrame:
    """rows (one for each value of ``order``) with running sums, {new column: column}, in that order. Rows are written
    once; where they are more than RANGE_ROWS, as ranges of the order, each of which cumulates its own and adds the totals
    of the ranges before it."""
    key = F.col(order).desc() if falling else F.col(order).asc()
    placed = stored(rows, "counts")
    n = -(-placed.count() // RANGE_ROWS)
    if n > 1:
        ranges = stored(placed.repartitionByRange(n, key).withColumn("_range", F.spark_partition_id()), "ranges")
        discard(placed)
        placed = ranges
    else:
        placed = placed.withColumn("_range", F.lit(0))
    inside = Window.partitionBy("_range").orderBy(key)
    held = placed.select(*placed.columns, *[F.sum(c).over(inside).alias(f"_own{k}") for k, c in enumerate(sums.values())])
    if n <= 1:
        return held.select(*rows.columns, *[F.col(f"_own{k}").alias(name) for k, name in enumerate(sums)])
    totals = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_{k}") for k, c in enumerate(sums.values())])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in range(len(sums))])
    return held.join(F.broadcast(totals), "_range").select(*rows.columns, *[(F.col(f"_own{k}") + F.col(f"_{k}")).alias(name) for k, name in enumerate(sums)])


def _curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Distinct scores, falling, with cumulated true and false positives. Rows of a score are added up first, so no more
    rows than there are scores are ordered."""
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    return cumulated(rows, "score", {"tp": "p", "fp": "q"}, falling=True)


def selected(df: DataFrame, flag: str = "select") -> DataFrame:
    """Rows that a curve is made of: those marked 1 that have no null."""
    return df.filter(F.col(flag) == 1).na.drop()


def roc_auc(df: DataFrame, score: str, label: str, places: int = 3) -> DataFrame:
    """(positives, negatives, auc): exact, equal scores grouped. A trapezoid for each score: no order between partitions is
    needed once the counts are cumulated."""
    c = _curve(df, score, label)
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0))
    return c.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), area.alias("_a")).select("positives", "negatives", round_np(F.col("_a") / (F.col("positives") * F.col("negatives")), places).alias("auc"))


def pr_auc(df: DataFrame, score: str, label: str, places: int = 3) -> DataFrame:
    """(positives, negatives, auc): trapezoids over recall, the curve ends at recall 0 with precision 1."""
    c = _curve(df, score, label)
    before = F.when(F.col("tp") + F.col("fp") - F.col("p") - F.col("q") > 0, (F.col("tp") - F.col("p")) / (F.col("tp") + F.col("fp") - F.col("p") - F.col("q"))).otherwise(1.0)
    area = F.sum(F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp")) + before) / 2.0)
    return c.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), area.alias("_a")).select("positives", "negatives", round_np(F.col("_a") / F.col("positives"), places).alias("auc"))


def density_histogram(df: DataFrame, group: str, value: str, width: float = 0.5) -> DataFrame:
    """(group, bin, n, density): density is the share of the group's rows per unit."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, (F.floor(F.col(value) / width)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("_t"))
    return counts.join(totals, group).select(group, "bin", "n", (F.col("n") / (F.col("_t") * width)).alias("density"))


def common_kmers(a: DataFrame, b: DataFrame, key: str = "kmer") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def tag_common(a: DataFrame, common: DataFrame, key: str = "kmer") -> DataFrame:
    """Rows with a flag whether their key is common."""
    return a.join(common.select(key).distinct().withColumn("_c", F.lit(1)), key, "left").withColumn("common", F.coalesce(F.col("_c"), F.lit(0)).cast("int")).drop("_c")


def label_frequency(df: DataFrame, label: str) -> DataFrame:
    """(label, n, running): counts and their running sum in the labels' order (one row per label)."""
    return cumulated(df.groupBy(label).agg(F.count("*").alias("n")), label, {"running": "n"})


def site_labels(df: DataFrame, kmers: str, positions: str) -> Column:
    """Labels of two list literals, element by element."""
    return F.zip_with(list_literal(F.col(kmers)), list_literal(F.col(positions), "int"), site_label)


def reconcile(counts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, counts per table, complete): whether every table has as many rows of a key as the others."""
    parts = [df.groupBy(key).agg(F.count("*").alias(name)) for name, df in counts.items()]
    out = reduce(lambda a, b: a.join(b, key, "full"), parts).na.fill(0, list(counts))
    same = reduce(lambda a, b: a & b, [F.col(x) == F.col(next(iter(counts))) for x in counts])
    return out.withColumn("complete", same)


def unique_check(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(column).alias("rows"), F.count_distinct(column).alias("different")).withColumn("is_unique", F.col("rows") == F.col("different"))


def groups_of(df: DataFrame, prefix: Column, size: int) -> DataFrame:
    """Prefixes that have exactly ``size`` rows."""
    return df.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).filter(F.col("n") == size)


def reorder(df: DataFrame, key: str, order: list) -> DataFrame:
    """Rows whose key is in the list, numbered by its place."""
    places = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(order)], f"{key} {df.schema[key].dataType.simpleString()}, place int")
    return df.join(F.broadcast(places), key)
