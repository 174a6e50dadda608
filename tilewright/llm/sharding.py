"""Weighted rendezvous sharding, in DataFrame functions alone.

Every shard bids -ln(u) / weight for a record, u being a uniform value in (0, 1) taken from the MD5 digest of
the shard's number and the record's key; the least bid wins, of equal ones the least shard's. A bid depends on
one key and one shard, so one more shard takes records only into itself, and a changed weight moves records only
from or to that shard. Places inside a shard are counted in 4096 blocks of a digest of key, checksum and size: the
4096 x shards block counts are the only rows that meet in one task, whatever the input, and records of one key
are further told apart by size and checksum.

Defined results: a null key is a key like any other; a null text has size 1 and the checksum of no bytes; rows
alike in key, size and checksum get consecutive slots; an empty table gives no rows; other columns of the records
do not matter, as only the key and those that tell records apart are taken along.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 4096


def _digits(n: int, *parts: Column) -> Column:
    """The first n hex digits of the MD5 digest of the parts, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, n), 16, 10).cast("long")


def bid(key: Column, shard: int, weight: float = 1.0) -> Column:
    return -F.ln((_digits(13, F.lit(shard), key).cast("double") + 0.5) / float(2**52)) / float(weight)


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The winning shard's number. weights: shard -> weight above 0; there must be one at least."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be above 0, for one shard at least")
    bids = [F.struct(bid(key, s, w).alias("bid"), F.lit(s).alias("shard")) for s, w in weights.items()]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def shard_records(df: DataFrame, key: str, weights: Mapping[int, float], *order: str) -> DataFrame:
    """key, order, shard int and slot long, gapless from 0 in each shard, of every row of df.

    order: columns that tell records of one key apart. Rows alike in key and order are counted before any
    shuffle, and get consecutive slots, so that no record repeated however often lands in one task.
    """
    alike = df.groupBy(key, *order).agg(F.count("*").alias("_n"))
    placed = alike.withColumn("shard", rendezvous(F.col(key), weights)).withColumn("_block", F.pmod(_digits(8, *[F.col(c) for c in (key, *order)]), F.lit(BLOCKS)).cast("int"))
    counts = placed.groupBy("shard", "_block").agg(F.sum("_n").alias("_n"))
    offsets = counts.select("shard", "_block", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).alias("_offset"))
    inner = F.sum("_n").over(Window.partitionBy("shard", "_block").orderBy(key, *order)) - F.col("_n")
    starts = placed.withColumn("_inner", inner).join(F.broadcast(offsets), ["shard", "_block"]).withColumn("_start", F.col("_offset") + F.col("_inner"))
    return starts.select(key, *order, "shard", F.explode(F.sequence("_start", F.col("_start") + F.col("_n") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, weights: Mapping[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law 'key', shard, slot, grown_shard (the shard if there were one more of weight 1)."""
    weights = dict(weights or dict.fromkeys(range(shards), 1.0))
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = shard_records(rows, "doc_id", weights, "text_crc32", "size")
    grown = rendezvous(F.col("doc_id"), weights | {max(weights) + 1: 1.0})
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))
