"""Sharding by jump consistent hashing: a stable key's shard follows from the key and the number of shards alone.

There is no ring table.  Going from n to n + 1 shards moves the share 1 / (n + 1) of the keys, all into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.llm._shared import others, quoted

GROUPS = 256  # groups within a shard whose rows are numbered apart


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key: follow the key's sequence of jumps to the last one below ``shards``."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    jump = np.zeros(len(key))
    while len(live):
        out[live] = jump[live].astype(np.int64)
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        jump[live] = np.floor((out[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1)))
        live = live[jump[live] < shards]
    return out.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a row by the XXH64 of its key; equal keys, null ones too, share a shard."""

    @F.pandas_udf("int")
    def shard(h: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(h.to_numpy(np.int64), shards))

    return shard(F.xxhash64(key))


MADE = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", groups: int = GROUPS) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard, in place of columns so called in any case of letters.

    Slots number a shard's rows from 0 without gaps.  A shard is cut into ``groups`` by a hash of the key and checksum;
    rows are numbered within a group by (key, checksum), behind the rows of the groups before it, so no task sorts a whole
    shard.  Size is the text's UTF-8 bytes (null: none) plus 1; null and empty texts have checksum 0.  Null keys share a
    shard, and so do repeated ones, each with a slot of its own.  An empty table gives an empty result.  Other columns may
    have any name: they go through under names of their own.
    """
    kept = others(docs, MADE)
    carried = [f"c{i}" for i in range(len(kept))]
    body = F.coalesce(quoted(text), F.lit("")).cast("binary")
    rows = docs.select(
        *[quoted(c).alias(name) for c, name in zip(kept, carried, strict=True)],
        quoted(key).alias("key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    group = F.pmod(F.xxhash64("key", "text_crc32", F.lit(1)), F.lit(groups)).cast("int")
    placed = rows.withColumns({"shard": jump_shard(F.col("key"), shards), "group": group})
    counted = placed.groupBy("shard", "group").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    starts = counted.select("shard", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "group").orderBy(F.col("key").asc_nulls_first(), "text_crc32", "size")
    # shards * groups rows at most
    numbered = placed.withColumn("place", F.row_number().over(within) - 1).join(F.broadcast(starts), ["shard", "group"])
    slot = (F.col("start") + F.col("place")).cast("long")
    done = numbered.select(*carried, "size", "text_crc32", F.lit("key"), "shard", slot, jump_shard(F.col("key"), shards + 1))
    return done.toDF(*kept, *MADE)
