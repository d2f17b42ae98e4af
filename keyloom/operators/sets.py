"""Sets: rows (key, member).  Operators on several sets take frames with a member column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.keyspace import ranked
from keyloom.operators.hashes import draw_order


def members(sets: DataFrame, key: object) -> DataFrame:
    """SMEMBERS of one key."""
    return sets.where(F.col("key") == key).select("member")


def sadd(sets: DataFrame, new: DataFrame) -> DataFrame:
    """SADD: with the new rows, each once."""
    return sets.unionByName(new).dropDuplicates(["key", "member"])


def srem(sets: DataFrame, gone: DataFrame) -> DataFrame:
    return sets.join(gone, ["key", "member"], "left_anti")


def scard(sets: DataFrame) -> DataFrame:
    """SCARD of rows that may repeat."""
    return sets.groupBy("key").agg(F.countDistinct("member").alias("scard"))


def sismember(sets: DataFrame, requests: DataFrame) -> DataFrame:
    """SISMEMBER, SMISMEMBER: requests (key, member and others) with ``found`` 0 or 1; ``sets`` without repeats."""
    hit = sets.select("key", "member", F.lit(1).alias("hit"))
    return requests.join(hit, ["key", "member"], "left").select(*requests.columns, F.coalesce("hit", F.lit(0)).alias("found"))


def sinter(sources: list[DataFrame]) -> DataFrame:
    """SINTER: semi joins, equal frames once; name the smallest first."""
    return reduce(lambda a, b: a.join(b.select("member"), "member", "left_semi"), _different(sources)).select("member").distinct()


def _different(sources: list[DataFrame]) -> list[DataFrame]:
    out: list[DataFrame] = []
    for s in sources:
        if not any(s is x for x in out):
            out.append(s)
    return out


def sinter_keys(sets: DataFrame, keys: list) -> DataFrame:
    """SINTER of keys of one frame: members that all of them have, in one pass with partial counts."""
    wanted = list(dict.fromkeys(keys))
    hit = sets.where(F.col("key").isin(wanted)).select("key", "member").distinct()
    return hit.groupBy("member").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("member")


def sintercard(sources: list[DataFrame], limit: int = 0) -> DataFrame:
    """SINTERCARD: how many members are in all, counting to ``limit`` (0: to the end)."""
    common = sinter(sources)
    return (common.limit(limit) if limit else common).agg(F.count("*").alias("sintercard"))


def sunion(sources: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [s.select("member") for s in _different(sources)]).distinct()


def sdiff(first: DataFrame, others: list[DataFrame]) -> DataFrame:
    """SDIFF: anti joins."""
    return reduce(lambda a, b: a.join(b.select("member"), "member", "left_anti"), others, first.select("member").distinct())


def store(sets: DataFrame, key: object, result: DataFrame) -> DataFrame:
    """SINTERSTORE, SUNIONSTORE, SDIFFSTORE: ``result`` in place of ``key``; an empty one deletes it."""
    kind = sets.schema["key"].dataType
    return sets.where(F.col("key") != key).select("key", "member").unionByName(result.select(F.lit(key).cast(kind).alias("key"), "member"))


def smove(sets: DataFrame, source: object, target: object, member: object) -> DataFrame:
    """SMOVE: the member leaves ``source`` for ``target``, where it may be already."""
    moved = F.when((F.col("key") == source) & (F.col("member") == member), F.lit(target).cast(sets.schema["key"].dataType)).otherwise(F.col("key"))
    return sets.withColumn("key", moved).dropDuplicates(["key", "member"])


def spop(sets: DataFrame, count: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """SPOP by key: ``count`` members drawn by a seeded hash, and what remains."""
    placed = ranked(sets, ["key"], draw_order("member", seed))
    return placed.where(F.col("rn") <= count).drop("rn"), placed.where(F.col("rn") > count).drop("rn")
