"""Shards by vector bin packing, with DataFrame operations and a small plan on the driver.

Rows of equal text form a group. A group that is large in bytes, tokens or rows (over 1/SMALL of the total; so there
are fewer than 3 * SMALL of them) is an item of its own; all others are bundled by their digest into BUNDLES items, so
what the driver sees has a fixed size at any input. Items, largest first, go to the shard where the dot product of their
vector (bytes, tokens, rows, each as a share of a shard's room) with the shard's residual capacity is highest among
those where they fit; where none fits, to the one that they overfill least. Groups above the room of SPLIT of a shard
are packed first; those that would then take a shard above its room in bytes are cut into parts by the hash of the
doc_id, as law `bytes` can't hold with them whole. All other groups stay in one shard.

Law `bytes`: the shards' sizes are near equal. Slots: 0, 1, ... in each shard, by the item's place and then by doc_id;
each chunk of rows that is numbered in one task has at most 1/NUMBERED of all rows, about.

Null text is empty: size 1. Null ids come first in their chunk. Rows that repeat are rows of their own. Ties: items of
equal bytes are packed in the order of their names, and of equal shards the first takes an item. Very long texts are items like
any other; one row that is larger than a shard's room can't be cut, so its shard is as large as it and the law holds
for the other shards alone. Tokens are words here (runs without ASCII white space). Extra columns are ignored; an empty table gives no rows; with fewer items than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, attach_groups, text_column

BUNDLES = 8192
SMALL = 2048
SPLIT = 0.25
NUMBERED = 4096


def pack(vectors: np.ndarray, shards: int, total: np.ndarray | None = None) -> np.ndarray:
    """The shard of each item (rows of vectors: bytes, tokens, rows); total: of all items, if these are the first."""
    total = np.maximum(vectors.sum(axis=0) if total is None else total, 1).astype(float)
    share = vectors / total * shards
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=int)
    for i in np.argsort(-share[:, 0], kind="stable"):
        rest = left - share[i]
        fits = (rest >= -1e-9).all(axis=1)
        if fits.any():
            score = np.where(fits, left @ share[i], -np.inf)
            k = int(np.argmax(score))
        else:  # bytes are the law: the emptiest in bytes, other sums break ties
            k = int(np.argmax(rest[:, 0] + 1e-6 * rest.sum(axis=1)))
        out[i], left[k] = k, rest[k]
    return out


def too_large(vectors: np.ndarray, shards: int, total: np.ndarray) -> list[int]:
    """The groups (rows of vectors: bytes, tokens, rows) that have to be cut: while a shard is above its room in bytes,
    the smallest group of several rows there."""
    whole = list(range(len(vectors)))
    cut = []
    while whole:
        at = pack(vectors[whole], shards, total)
        used = np.bincount(at, weights=vectors[whole, 0], minlength=shards)
        over = [i for i, k in zip(whole, at) if used[k] * shards > total[0] and vectors[i, 2] > 1]
        if not over:
            break
        cut.append(min(over, key=lambda i: (vectors[i, 0], -i)))
        whole.remove(cut[-1])
    return cut


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text, ...)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "shards")
    text = text_column(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"),
    )
    rows = ws.put(rows, "rows", compression="zstd")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    groups = ws.put(groups, "groups", compression="zstd")
    all_bytes, all_tokens, all_rows = (x or 0 for x in groups.agg(F.sum("bytes"), F.sum("tokens"), F.sum("n")).first())
    big = (F.col("bytes") * SMALL > all_bytes) | (F.col("tokens") * SMALL > all_tokens) | (F.col("n") * SMALL > all_rows)
    room = max(all_bytes / shards, 1)
    # fewer than shards / SPLIT groups
    large = groups.filter(F.col("bytes") > SPLIT * room).select(F.hex("digest").alias("name"), "bytes", "tokens", "n").orderBy("name").toPandas()
    cut = too_large(large[["bytes", "tokens", "n"]].to_numpy(dtype=float), shards, np.array([all_bytes, all_tokens, all_rows], dtype=float))
    parts = F.when(F.hex("digest").isin([large["name"][i] for i in cut]), F.ceil(F.col("bytes") / (SPLIT * room / 4))).otherwise(F.lit(1)).cast("int")
    bundle = F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("int")
    groups = groups.select("digest", "n", F.when(big, F.hex("digest")).otherwise(F.concat(F.lit("b"), bundle)).alias("base"), F.when(big & (F.col("n") > 1), F.least(parts, F.col("n").cast("int"))).otherwise(F.lit(1)).alias("parts"))
    placed = attach_groups(rows, groups, "digest", "n", all_rows)
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")).cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", "tokens", F.concat_ws("/", "base", part).alias("item"))
    placed = ws.put(placed, "placed", compression="zstd")

    # at most BUNDLES + a fixed number of items: the plan is made on the driver
    items = placed.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).orderBy("item").toPandas()
    plan = items.assign(shard=pack(items[["bytes", "tokens", "n"]].to_numpy(dtype=float), shards) if len(items) else [])
    most = max(1, -(-all_rows // NUMBERED))
    plan["chunks"] = np.maximum(1, -(-plan["n"] // most)).astype(int)
    spread = spark.createDataFrame([(r.item, int(r.shard), int(r.chunks)) for r in plan.itertuples()], "item string, shard int, chunks int")
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("chunks")).cast("int")
    dealt = placed.join(F.broadcast(spread), "item").select("doc_id", "size", "text_crc32", "shard", "item", chunk.alias("chunk"))
    counts = dealt.groupBy("shard", "item", "chunk").agg(F.count("*").alias("rows")).orderBy("shard", "item", "chunk").toPandas()
    counts["first"] = counts.groupby("shard")["rows"].cumsum() - counts["rows"] if len(counts) else []
    first = spark.createDataFrame([(int(r.shard), r.item, int(r.chunk), int(r.first)) for r in counts.itertuples()], "shard int, item string, chunk int, first long")
    order = Window.partitionBy("shard", "item", "chunk").orderBy("doc_id", "size", "text_crc32")
    out = dealt.join(F.broadcast(first), ["shard", "item", "chunk"]).withColumn("slot", F.col("first") + F.row_number().over(order) - 1)
    ws.drop("rows", "groups")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
