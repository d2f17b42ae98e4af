"""Hashes: rows (key, field, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.keyspace import ranked
from keyloom.operators.strings import float_sum

KF = ["key", "field"]


def unpivot(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A wide table as hashes: a field for each column that is not null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return table.select(F.col(key).alias("key"), F.inline(pairs)).where("value is not null")


def hset(log: DataFrame, seq: str = "seq") -> DataFrame:
    """HSET, HMSET: the last write of each field."""
    return log.groupBy(*KF).agg(F.max_by("value", seq).alias("value"))


def hsetnx(log: DataFrame, seq: str = "seq") -> DataFrame:
    """HSETNX: the first write of each field."""
    return log.groupBy(*KF).agg(F.min_by("value", seq).alias("value"))


def hreplace(hashes: DataFrame, writes: DataFrame, seq: str = "seq") -> DataFrame:
    """Replace all fields of hashes that exist; writes to others have no effect, and of repeated fields the last wins."""
    there = writes.join(hashes.select("key").distinct(), "key", "left_semi")
    return hashes.join(there.select("key").distinct(), "key", "left_anti").unionByName(hset(there, seq))


def hget(hashes: DataFrame, field: str) -> DataFrame:
    """HGET of one field, for all keys."""
    return hashes.where(F.col("field") == field).select("key", "value")


def hmget(hashes: DataFrame, fields: list[str]) -> DataFrame:
    """HMGET: a column for each field, null where it is missing."""
    return hashes.where(F.col("field").isin(fields)).groupBy("key").pivot("field", fields).agg(F.first("value"))


def hgetall(hashes: DataFrame) -> DataFrame:
    """HGETALL: a map for each key."""
    return hashes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("hash"))


def hkeys(hashes: DataFrame) -> DataFrame:
    return hashes.select("key", "field")


def hvals(hashes: DataFrame) -> DataFrame:
    return hashes.select("key", "value")


def hlen(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.count("*").alias("hlen"))


def hexists(hashes: DataFrame, requests: DataFrame) -> DataFrame:
    """HEXISTS: requests (key, field) with ``found`` 0 or 1."""
    return requests.join(hashes.select(*KF, F.lit(1).alias("hit")), KF, "left").select(*requests.columns, F.coalesce("hit", F.lit(0)).alias("found"))


def hstrlen(hashes: DataFrame) -> DataFrame:
    return hashes.select("key", "field", F.coalesce(F.octet_length("value"), F.lit(0)).alias("length"))


def hdel(hashes: DataFrame, requests: DataFrame) -> DataFrame:
    """HDEL: what remains; a key without fields is gone by having no rows."""
    return hashes.join(requests, KF, "left_anti")


def hincrby(log: DataFrame, delta: str = "delta") -> DataFrame:
    """HINCRBY: 64-bit sums by field; overflow is an error."""
    return log.groupBy(*KF).agg(F.sum(F.col(delta).cast("bigint")).alias("value"))


def hincrbyfloat(log: DataFrame, delta: str = "delta") -> DataFrame:
    """HINCRBYFLOAT: sums of deltas as text, as INCRBYFLOAT gives them."""
    return log.groupBy(*KF).agg(float_sum(F.col(delta)).alias("value"))


def sample(frame: DataFrame, element: str, count: int, seed: int = 0) -> DataFrame:
    """HRANDFIELD, SRANDMEMBER, ZRANDMEMBER by key: ``count`` different elements, or -count draws with replacement.

    Draws are those of the MD5 of seed, key and element, so any engine can repeat them.
    """
    placed = ranked(frame, ["key"], draw_order(element, seed))
    if count >= 0:
        return placed.where(F.col("rn") <= count).drop("rn")
    sizes = frame.groupBy("key").agg(F.count("*").alias("n"))
    draws = sizes.select("key", "n", F.explode(F.sequence(F.lit(1), F.lit(-count))).alias("draw"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("key"), F.col("draw"))), 1, 15), 16, 10).cast("bigint")
    draws = draws.select("key", "draw", (F.pmod(number, F.col("n")) + 1).alias("rn"))
    return draws.join(placed, ["key", "rn"]).drop("rn")


def draw_order(element: str, seed: int) -> list[Column]:
    return [F.md5(F.concat_ws(":", F.lit(seed), F.col("key"), F.col(element))), F.col(element)]
