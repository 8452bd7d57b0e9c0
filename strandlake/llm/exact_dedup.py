"""Exact deduplication by a log-structured merge index, with DataFrame operations only.

A memtable is what TASKS tasks read. Each task flushes its part as a run sorted by digest, with a Bloom filter of the run's
digests in the file (level 0), without a shuffle. Compaction is tiered: all memtables of a tier are merged at once, FAN to
a sorted run of the next, until one level is left, so an entry is written as often as the number of memtables has digits to
the base FAN: once up to TASKS * FAN tasks. An entry is a digest with its smallest identifier and its number of rows;
partial aggregates keep a digest with a third of all rows from being one task's work. Rows that are flushed later are
merged with the level in the same way (``compact``).

All rows are then resolved through the index: a filter of the digests that have several rows rules out all others, which
are resolved where they are, and only what it lets pass meets the entries in a join. If a row's entry names another row (a
hit), the two texts are compared byte by byte, rows without an id too; texts that differ under one digest are grouped by
the text itself. `lookup` finds the entries of a few digests: a table of all files' filters, made at the first
lookup, says which files may hold one, and only these are opened.

Texts are equal when identical after each run of ASCII white space becomes one space. Null is the empty text; long texts
are digested whole. Of equal texts, the smallest id stays; rows without an id stay only where no row of their group has
one. Rows that repeat an id and its text are one document: they get the same result (ties: all of them are kept or
none). Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_LEAST, Workspace, attach_groups, free_name, id_filter, maybe_in, text_column

#: Tasks whose rows are one memtable, and memtables that one compaction merges.
TASKS, FAN = 64, 16
ENTRY = "digest binary, keep_id long, n long"
#: Bits of the filter of one file of the index.
FILE_BITS, _PER_MAP = 1 << 20, 32768


def normalised(df: DataFrame, text: str = "text"):
    """Each run of ASCII white space becomes one space; only runs that aren't one space already are rewritten."""
    return F.regexp_replace(text_column(df, text), "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")


class DigestIndex:
    """The index: ``flush`` adds the rows of a table as memtables of sorted runs, ``compact`` merges runs with the level
    before, ``resolve`` finds every row's entry, ``lookup`` the entries of a few digests."""

    def __init__(self, spark: SparkSession, ws: Workspace, bits: int = 256):
        """bits: of the digest that are used; fewer than 256 only serve to test what happens to texts that share one."""
        self.spark, self.ws, self.bits = spark, ws, bits
        self.flushed, self.compacted, self.shared = 0, 0, 0
        self.runs: list[str] = []  # memtables that no compaction has merged, oldest first
        self.level: str | None = None

    def digest(self, column):
        whole = F.sha2(column.cast("binary"), 256)
        return whole if self.bits == 256 else F.substring(whole, 1, self.bits // 4)

    def _written(self, rows: DataFrame, table: str) -> None:
        """Writes files of the index; each has Parquet's Bloom filter of its digests."""
        w = rows.write.mode("overwrite").options(**{"compression": "zstd", "parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled#digest": "true"})
        (w.partitionBy("memtable") if "memtable" in rows.columns else w).parquet(self.ws.path(table))

    def filters(self, table: str) -> DataFrame:
        """(file, bucket, bitmap): which digests each file of a table of the index may hold; made when first asked for."""
        name = f"{table}-filters"
        if not self.ws.exists(name):
            bit = F.pmod(F.xxhash64("digest"), F.lit(FILE_BITS))
            files = self.ws.get(table, "digest binary").select(F.col("_metadata.file_path").alias("file"), (bit / _PER_MAP).cast("int").alias("bucket"), F.pmod(bit, F.lit(_PER_MAP)).alias("p"))
            self.ws.put(files.groupBy("file", "bucket").agg(F.bitmap_construct_agg("p").alias("bitmap")), name)
        return self.ws.get(name, "file string, bucket int, bitmap binary")

    def flush(self, docs: DataFrame, memtables: int = 1, tasks: int | None = None) -> DataFrame:
        """Sorted runs with their filters, one for each task: no shuffle. Tasks are dealt to ``memtables``, or ``tasks`` of
        them to each. Returns (doc_id, digest) of the rows."""
        self.flushed += 1
        table = f"level0-{self.flushed}"
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(self.digest(normalised(docs))).alias("digest"))
        memtable = F.floor(F.spark_partition_id() / tasks) if tasks else F.pmod(F.spark_partition_id(), F.lit(memtables))
        rows = rows.withColumn("memtable", memtable.cast("int")).sortWithinPartitions("memtable", "digest", "doc_id")
        self._written(rows, table)
        if tasks:
            memtables = 1 + (self.ws.get(table, "doc_id long, digest binary, memtable int").agg(F.max("memtable")).first()[0] or 0)
        self.runs += [f"{table}/memtable={k}" for k in range(memtables)]
        return self.ws.get(table, "doc_id long, digest binary, memtable int").select("doc_id", "digest")

    def build(self, docs: DataFrame, tasks: int | None = None, fan: int | None = None) -> DataFrame:
        """Flushes the rows of a table and merges all memtables, tier by tier, into the first level; (doc_id, digest)."""
        tasks, fan = tasks or TASKS, fan or FAN
        rows = self.flush(docs, tasks=tasks)
        table, n = f"level0-{self.flushed}", len(self.runs)
        parts = self.ws.get(table, "doc_id long, digest binary, memtable int").select("memtable", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
        tier = 0
        while n > fan:
            merged = parts.groupBy(F.floor(F.col("memtable") / fan).cast("int").alias("memtable"), "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
            tier, n = tier + 1, -(-n // fan)
            self._written(merged.sortWithinPartitions("memtable", "digest"), f"tier-{tier}")
            if tier > 1:
                self.ws.drop(f"tier-{tier - 1}")
            parts = self.ws.get(f"tier-{tier}", f"{ENTRY}, memtable int")
        self.compacted += 1
        self.runs, self.level = [], f"level1-{self.compacted}"
        merged = parts.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")).sortWithinPartitions("digest")
        self._written(merged, self.level)
        return rows

    def compact(self, most: int | None = None) -> DataFrame:
        """Merges the oldest ``most`` memtables (all, if None) with the level before: (digest, keep_id, n), sorted. Runs
        that were merged, and the level before, aren't read again."""
        taken, self.runs = self.runs[:most], self.runs[most:] if most is not None else []
        parts = []
        for run in taken:
            if self.ws.exists(run):  # of few tasks, some memtables have none
                parts.append(self.ws.get(run, "doc_id long, digest binary").select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")))
        if self.level:
            parts.append(self.ws.get(self.level, ENTRY))
        if not parts:
            parts.append(self.spark.createDataFrame([], ENTRY))
        merged = reduce(DataFrame.unionByName, parts)
        merged = merged.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")).sortWithinPartitions("digest")
        self.compacted += 1
        before, self.level = self.level, f"level1-{self.compacted}"
        self._written(merged, self.level)
        if before:
            self.ws.drop(before, f"{before}-filters")
        return self.ws.get(self.level, ENTRY)

    def resolve(self, rows: DataFrame) -> DataFrame:
        """(doc_id, digest, keep_id, n) of rows (doc_id, digest) that the index holds. Digests that the filter of shared
        ones rules out have one row: their entry is the row itself."""
        shared = self.ws.put(self.ws.get(self.level, ENTRY).filter("n > 1"), "shared", compression="zstd")
        total, entries = (x or 0 for x in shared.agg(F.sum("n"), F.count("*")).first())
        self.shared = total
        bits = id_filter(shared, "digest", self.ws, "shared-bits", entries)
        single = maybe_in(rows, bits, "digest", negate=True).select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
        found = attach_groups(maybe_in(rows, bits, "digest"), shared, "digest", "n", total)
        passed = F.col("n").isNull()  # the filter let a single row pass
        found = found.select("doc_id", "digest", F.when(passed, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"))
        return single.unionByName(found)

    def files(self, digests: DataFrame) -> list[str]:
        """Files of the level and of memtables not merged yet whose filters may hold one of a few digests."""
        bit = F.pmod(F.xxhash64("digest"), F.lit(FILE_BITS))
        wanted = digests.select((bit / _PER_MAP).cast("int").alias("bucket"), F.pmod(bit, F.lit(_PER_MAP)).alias("p")).distinct()
        tables = {run.split("/")[0] for run in self.runs} | ({self.level} if self.level else set())
        out: list[str] = []
        for t in sorted(tables):
            filters = self.filters(t).join(F.broadcast(wanted), "bucket")
            byte = F.conv(F.hex(F.substring("bitmap", (F.col("p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            hit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col("p") % 8).cast("int") + 1)) != 0
            names = [r.file for r in filters.filter(hit).select("file").distinct().orderBy("file").collect()]  # of few digests
            out += [f for f in names if t == self.level or any(f"/{run}/" in f for run in self.runs)]
        return out

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, keep_id, n) of those of a few digests that the index holds; reads only the files that ``files`` names."""
        some = self.files(digests)
        level = [f for f in some if self.level and f"/{self.level}/" in f]
        runs = [f for f in some if f not in level]
        empty = self.spark.createDataFrame([], ENTRY)
        parts = [self.spark.read.schema(ENTRY).parquet(*level) if level else empty]
        if runs:
            parts.append(self.spark.read.schema("doc_id long, digest binary").parquet(*runs).select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")))
        rows = reduce(DataFrame.unionByName, parts).join(F.broadcast(digests.select("digest").distinct()), "digest", "left_semi")
        return rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def differing(ws: Workspace, docs: DataFrame, index: DigestIndex, found: DataFrame) -> DataFrame:
    """Digests under which texts differ: each row of a group of two and more is compared, byte by byte, with the row that
    stays. A filter of ids keeps the texts of other rows from moving; a large group's rows are dealt by salt."""
    member = found.filter("n > 1")
    named = member.filter("doc_id is not null").select("doc_id", "digest", "keep_id", "n").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(docs).alias("body"))
    side = maybe_in(texts.filter("doc_id is not null"), id_filter(member.filter("doc_id is not null"), "doc_id", ws, "member-bits", index.shared))
    side = side.withColumn("digest", F.unhex(index.digest(F.col("body")))).join(named, ["doc_id", "digest"])
    side = side.withColumn("salts", F.ceil(F.col("n") / HOT_LEAST).cast("int"))
    keeper = side.filter("doc_id = keep_id").dropDuplicates(["doc_id", "digest"]) if index.bits == 256 else side.filter("doc_id = keep_id")
    keeper = keeper.select("digest", F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hits = side.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    differ = hits.join(keeper, ["digest", "salt"]).filter(F.col("body") != F.col("kept_body")).select("digest")
    nameless = docs.filter("doc_id is null")
    if not nameless.isEmpty():
        groups = member.filter("doc_id is null").select("digest", "keep_id", "n").distinct()
        bare = nameless.select(normalised(docs).alias("body")).withColumn("digest", F.unhex(index.digest(F.col("body"))))
        # rows without id that share a digest: one text if the smallest and the largest are the same
        own = bare.groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).join(groups, "digest")
        kept = keeper.filter("salt = 0").select("digest", "kept_body")
        own = own.join(kept, "digest", "left")
        differ = differ.unionByName(own.filter("lo != hi or (kept_body is not null and kept_body != lo)").select("digest"))
    return ws.put(differ.distinct(), "differ")


def exact_dedup(docs: DataFrame, bits: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs (doc_id, text, ...)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    index = DigestIndex(spark, ws, bits)
    rows = index.build(docs)
    found = ws.put(index.resolve(rows), "found", compression="zstd")
    differ = differing(ws, docs, index, found)
    if differ.isEmpty():
        result = found.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
    else:
        # texts that share a digest with another text: grouped by the text itself
        bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(docs).alias("body"))
        bodies = ws.put(bodies.withColumn("digest", F.unhex(index.digest(F.col("body")))).join(differ, "digest", "left_semi"), "bodies", compression="zstd")
        groups = ws.put(bodies.groupBy("body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "body-groups", compression="zstd")
        again = attach_groups(bodies, groups, "body", "group_size", bodies.count()).select("doc_id", "keep_id", "group_size", "digest")
        same = found.join(differ, "digest", "left_anti").select("doc_id", "keep_id", F.col("n").alias("group_size"), "digest")
        result = same.unionByName(again).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, that exact_dedup keeps. Texts only move where a filter suspects their id; rows
    without id, if any, meet by their digest."""
    ws = Workspace(docs.sparkSession, "copies")
    gone = ws.put(exact_dedup(docs).filter("not kept").select("doc_id", F.unhex("text_sha256").alias("digest")), "not-kept")
    # an id that repeats with different texts loses only the rows whose text is a copy
    own, text = free_name(docs, "_sl_id"), free_name(docs, "_sl_text")
    named = ws.put(gone.filter("doc_id is not null").select(F.col("doc_id").alias(own), F.col("digest").alias(text)).distinct(), "gone")
    bits = id_filter(named, own, ws, "gone-bits")
    suspects = maybe_in(docs, bits)
    same = (suspects["doc_id"] == named[own]) & (F.unhex(F.sha2(normalised(suspects).cast("binary"), 256)) == named[text])
    kept = maybe_in(docs, bits, negate=True).unionByName(suspects.join(named, same, "left_anti"))
    if gone.filter("doc_id is null").isEmpty():
        return kept
    digests = gone.filter("doc_id is null").select(F.col("digest").alias(text)).distinct()
    nameless = docs.filter("doc_id is null")
    nameless = nameless.join(digests, F.unhex(F.sha2(normalised(nameless).cast("binary"), 256)) == digests[text], "left_anti")
    return kept.filter("doc_id is not null").unionByName(nameless)
