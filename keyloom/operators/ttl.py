"""Expiry: absolute milliseconds beside each key, null for keys that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.keyspace import live


def expire(frame: DataFrame, at_ms: Column, condition: str | None = None, now_ms: int | None = None) -> DataFrame:
    """EXPIRE, PEXPIRE, EXPIREAT and PEXPIREAT: a new deadline where the condition (NX, XX, GT, LT) holds; passed ones delete.

    A key without expiry counts as one that expires never: GT never applies to it, LT always.
    """
    old = F.col("expire_at_ms")
    fits = {None: F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (at_ms > old), "LT": old.isNull() | (at_ms < old)}[condition]
    out = frame.withColumn("expire_at_ms", F.when(fits, at_ms).otherwise(old))
    return out if now_ms is None else live(out, now_ms)


def applied(at_ms: Column, condition: str | None = None) -> Column:
    """1 where ``expire`` takes effect, else 0."""
    old = F.col("expire_at_ms")
    fits = {None: F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (at_ms > old), "LT": old.isNull() | (at_ms < old)}[condition]
    return F.coalesce(fits, F.lit(False)).cast("int")


def persist(frame: DataFrame) -> DataFrame:
    """PERSIST: without deadlines; ``persisted`` is 1 where there was one."""
    return frame.withColumn("persisted", F.col("expire_at_ms").isNotNull().cast("int")).withColumn("expire_at_ms", F.lit(None).cast("bigint"))


def _of(frame: DataFrame, requests: DataFrame, now_ms: int, name: str, value: Column) -> DataFrame:
    found = live(frame, now_ms).select("key", "expire_at_ms", F.lit(True).alias("there"))
    out = F.when(F.col("there").isNull(), F.lit(-2)).when(F.col("expire_at_ms").isNull(), F.lit(-1)).otherwise(value)
    return requests.join(found, "key", "left").select(requests["key"], out.cast("bigint").alias(name))


def pttl(frame: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """PTTL: milliseconds left; -1 without expiry, -2 without the key."""
    return _of(frame, requests, now_ms, "pttl", F.col("expire_at_ms") - now_ms)


def ttl(frame: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """TTL: seconds left, rounded to the nearest."""
    return _of(frame, requests, now_ms, "ttl", F.floor((F.col("expire_at_ms") - now_ms + 500) / 1000))


def expiretime(frame: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """EXPIRETIME: the deadline in seconds, rounded to the nearest."""
    return _of(frame, requests, now_ms, "expiretime", F.floor((F.col("expire_at_ms") + 500) / 1000))


def pexpiretime(frame: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    return _of(frame, requests, now_ms, "pexpiretime", F.col("expire_at_ms"))


def expired(frame: DataFrame, now_ms: int, limit: int | None = None) -> DataFrame:
    """Active expiry: keys past their deadline, earliest first, at most ``limit`` in a cycle."""
    due = frame.where(F.col("expire_at_ms") <= now_ms)
    return due if limit is None else due.orderBy("expire_at_ms", "key").limit(limit)
