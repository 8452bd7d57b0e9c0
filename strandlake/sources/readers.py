"""Scans. Text inputs keep their line order in ``row_no``; malformed lines are left out of the tables, and `with_reasons`
returns them with what is wrong with them, so that lines, header, good and bad rows add up (`line_counts`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions.arrays import keyed, parse_ragged
from ..functions.scalars import basename


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, value) of text files in the order of their names. Lines are numbered where they are read; the number of
    lines of each block of a file, a row for each block, gives where its numbers begin. No line leaves the engine."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(blocks, ["_file", "_block"]).select((F.col("_id") - F.col("_first") + F.col("_before")).alias("row_no"), "value")


def delimited(spark: SparkSession, path: str, columns: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """A table of exactly these columns. The header must be the columns' names; lines with another number of fields are
    left out, fields that can't be cast raise (ANSI)."""
    fields = S.struct(columns).fields
    return _cast(_split_lines(spark, path, fields, sep, header), fields, F.col("row_no") > 0 if header else F.lit(True))


def _split_lines(spark: SparkSession, path: str, fields: list, sep: str, header: bool) -> DataFrame:
    """(row_no, value, parts) of every line, after a look at the header."""
    clean = F.regexp_replace("value", "[\\r\\n]+$", "")
    if header:
        names = [f.name for f in fields]
        if first_line(spark, path, clean) != sep.join(names):
            raise ValueError(f"header of {path} isn't {names}")
    rows = numbered_lines(spark, path).withColumn("value", clean)
    return rows.withColumn("parts", F.split("value", "\\Q" + sep + "\\E", -1))


def first_line(spark: SparkSession, path: str, value: Column) -> str | None:
    """The first line of the first file: no more than its first block is opened."""
    files = spark.read.text(path).inputFiles()
    rows = spark.read.text(min(files)).filter(F.col("_metadata.file_block_start") == 0).select(value.alias("v")).take(1) if files else []
    return rows[0].v if rows else None


def with_reasons(spark: SparkSession, path: str, columns: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """Every line of a table but its header: the columns, row_no, ``reason`` and ``line``. reason is null for a row that
    `delimited` would return; otherwise it says how many fields the line has, or which field can't be cast, and the columns
    are null. One scan gives both kinds."""
    fields = S.struct(columns).fields
    rows = _split_lines(spark, path, fields, sep, header)
    if header:
        rows = rows.filter("row_no > 0")
    text = [F.get("parts", F.lit(i)) for i in range(len(fields))]
    cast = [t.try_cast(f.dataType) for t, f in zip(text, fields)]
    bad = F.coalesce(*[F.when(t.isNotNull() & c.isNull(), F.concat(F.lit(f"{f.name}: "), t)) for t, c, f in zip(text, cast, fields)])
    reason = F.when(F.size("parts") != len(fields), F.concat(F.size("parts").cast("string"), F.lit(f" of {len(fields)} fields"))).otherwise(bad)
    rows = rows.withColumn("reason", reason)
    return rows.select(*[F.when(F.col("reason").isNull(), c).alias(f.name) for c, f in zip(cast, fields)], "row_no", "reason", F.col("value").alias("line"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is null").drop("reason", "line")


def rejected(rows: DataFrame) -> DataFrame:
    """(row_no, reason, line)."""
    return rows.filter("reason is not null").select("row_no", "reason", "line")


def line_counts(rows: DataFrame) -> DataFrame:
    """(reason kind, lines): good rows, and bad ones by what is wrong with them."""
    kind = F.when(F.col("reason").isNull(), "good").when(F.col("reason").contains(" of "), "fields").otherwise(F.substring_index("reason", ":", 1))
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("lines"))


def _cast(rows: DataFrame, fields: list, held: Column) -> DataFrame:
    """The fields of the rows that have all of them. A field is null where its row goes, so that a filter on a column,
    which the planner may move before the rows are numbered or counted, casts no header and no broken line."""
    held = held & (F.size("parts") == len(fields))
    return rows.filter(held).select(*[F.when(held, F.get("parts", F.lit(i))).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)], "row_no")


def event_table(spark, path):
    return delimited(spark, path, S.EVENT_COLUMNS)


def stranded_event_table(spark, path):
    """Events that have their strand already, as `sinks.write_text` leaves them."""
    return delimited(spark, path, S.EVENT_COLUMNS + ", map_strand string")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by order, as when a map is written again."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def read_summary(spark, path) -> DataFrame:
    """(read_index, read_name, fast5_path): the last row of each index, the path's last part."""
    df = delimited(spark, path, S.SUMMARY_COLUMNS).withColumn("fast5_path", basename(F.col("fast5_path")))
    return last_wins(df, ["read_index"], ["row_no"]).select("read_index", "read_name", "fast5_path")


def polya_table(spark, path) -> DataFrame:
    """Passing rows, the last of each read."""
    df = delimited(spark, path, S.POLYA_COLUMNS).filter("qc_tag = 'PASS'")
    return last_wins(df, ["readname"], ["row_no"]).drop("row_no")


def event_summary(spark, path) -> DataFrame:
    return last_wins(delimited(spark, path, S.EVENT_SUMMARY_COLUMNS, ","), ["read_index"], ["row_no"]).drop("row_no")


def collapsed_table(spark, path) -> DataFrame:
    return delimited(spark, path, S.COLLAPSED_COLUMNS)


def alignment_table(spark, path) -> DataFrame:
    """No header; a trailing separator on each line."""
    fields = S.struct(S.ALIGNMENT_COLUMNS).fields
    rows = numbered_lines(spark, path).withColumn("parts", F.split(F.regexp_replace("value", "\\s+$", ""), "\t"))
    return _cast(rows, fields, F.lit(True))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): id is the text up to the first white space, seq all lines joined, case kept."""
    rows = spark.read.text(path, lineSep=">").filter(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    return rows.select(F.regexp_extract(head, "^(\\S*)", 1).alias("id"), F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), "[\\r\\n]", "").alias("seq"))


def kmer_index(spark, path) -> DataFrame:
    return delimited(spark, path, S.KMER_INDEX_COLUMNS, ",").drop("row_no")


def transcript_index(spark, path) -> DataFrame:
    """(index, transcript): the numbers that transcripts are known by."""
    return delimited(spark, path, "index int, transcript string", ",").drop("row_no")


def kmer_model(spark, path) -> DataFrame:
    """No header; the first row of a k-mer counts."""
    return first_wins(delimited(spark, path, S.KMER_MODEL_COLUMNS, ",", header=False), ["kmer"], ["row_no"]).drop("row_no")


def raw_reads(spark, path) -> DataFrame:
    return spark.read.schema(S.RAW_READS).parquet(path)


def normalized_reads(reads: DataFrame) -> DataFrame:
    """Reads that have both events and a normalized signal."""
    return reads.filter("event is not null and normalized is not null")


def ragged(spark, path, kind: str = "double") -> DataFrame:
    """(row_no, values) of a matrix with lines of any length."""
    return numbered_lines(spark, path).select("row_no", parse_ragged(F.col("value"), kind).alias("values"))


def ragged_row(df: DataFrame, row: int) -> DataFrame:
    """One row by number: a filter, not a rescan."""
    return df.filter(F.col("row_no") == row)


def ragged_values(df: DataFrame) -> DataFrame:
    """All values of all rows, in order."""
    return df.select("row_no", F.posexplode("values").alias("place", "value"))


def keyed_ragged(df: DataFrame) -> DataFrame:
    """(read_index, values): the first element is the read's number."""
    key, rest = keyed(F.col("values"))
    return df.select(key.cast("int").alias("read_index"), rest.alias("values"))


def csv_table(spark, path, columns: str) -> DataFrame:
    """A headed CSV with quoted fields."""
    return spark.read.csv(path, header=True, schema=S.struct(columns), multiLine=False, escape='"')
