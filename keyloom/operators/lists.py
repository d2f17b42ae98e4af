"""Lists: rows (key, pos, value); positions are any numbers in order, dense only in replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.keyspace import ranked



def _head(lists: DataFrame) -> DataFrame:
    return ranked(lists, ["key"], [F.col("pos")])


def _tail(lists: DataFrame) -> DataFrame:
    return ranked(lists, ["key"], [F.col("pos").desc()])


def push(lists: DataFrame, new: DataFrame, left: bool = False, only_if_exists: bool = False) -> DataFrame:
    """LPUSH, RPUSH (X: to lists that exist) of rows (key, seq, value): beyond the ends, in order of seq."""
    ends = lists.groupBy("key").agg((F.min("pos") if left else F.max("pos")).alias("end"))
    placed = new.join(ends, "key", "inner" if only_if_exists else "left")
    away = F.coalesce("end", F.lit(0)) + (-F.col("seq") - 1 if left else F.col("seq") + 1)
    return lists.select("key", "pos", "value").unionByName(placed.select("key", away.alias("pos"), "value"))


def pop(lists: DataFrame, count: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """LPOP, RPOP by key: rows with their place ``rn`` in the reply, and what remains."""
    side = _head if left else _tail
    return side(lists).where(F.col("rn") <= count), side(lists).where(F.col("rn") > count).drop("rn")


def llen(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.count("*").alias("llen"))


def lindex(lists: DataFrame, index: int) -> DataFrame:
    """LINDEX by key; a negative index counts from the end."""
    want = index + 1 if index >= 0 else -index
    side = _head if index >= 0 else _tail
    return side(lists).where(F.col("rn") <= want).where(F.col("rn") == want).select("key", "value")


def lrange(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE by key: rows with ``idx`` from 0 in the list."""
    sizes = lists.groupBy("key").agg(F.count("*").alias("n"))
    placed = _head(lists)
    if start >= 0 and stop >= 0:
        return placed.where(F.col("rn") <= stop + 1).where(F.col("rn") > start).select("key", (F.col("rn") - 1).alias("idx"), "value")
    idx = F.col("rn") - 1
    first = F.lit(start) if start >= 0 else F.col("n") + start
    last = F.lit(stop) if stop >= 0 else F.col("n") + stop
    return placed.join(sizes, "key").where((idx >= first) & (idx <= last)).select("key", idx.alias("idx"), "value")


def lset(lists: DataFrame, index: int, value: str) -> DataFrame:
    """LSET at an index of every list; one that a list doesn't have is an error."""
    want = index + 1 if index >= 0 else -index
    side = _head if index >= 0 else _tail
    sizes = lists.groupBy("key").agg(F.count("*").alias("n"))
    wrong = F.raise_error(F.lit("ERR index out of range")).cast("string")
    new = F.when(F.col("n") < want, wrong).when(F.col("rn") == want, F.lit(value)).otherwise(F.col("value"))
    return side(lists).join(sizes, "key").withColumn("value", new).select(*lists.columns)


def linsert(lists: DataFrame, pivot: str, value: str, after: bool = False) -> DataFrame:
    """LINSERT beside the first pivot of each list; positions come back dense, from 0."""
    firsts = lists.where(F.col("value") == pivot).groupBy("key").agg(F.min("pos").alias("pos"))
    side = 1 if after else -1
    every = lists.select("key", "pos", F.lit(0).alias("side"), "value").unionByName(firsts.select("key", "pos", F.lit(side).alias("side"), F.lit(value).alias("value")))
    return ranked(every, ["key"], [F.col("pos"), F.col("side")]).select("key", (F.col("rn") - 1).alias("pos"), "value")


def lrem(lists: DataFrame, count: int, value: str) -> DataFrame:
    """LREM: the first (positive count), last (negative) or all (0) rows with the value go."""
    hit = F.col("value") == value
    if count == 0:
        return lists.where(~hit | F.col("value").isNull())
    order = F.col("pos") if count > 0 else F.col("pos").desc()
    gone = ranked(lists.where(hit), ["key"], [order]).where(F.col("rn") <= abs(count)).select("key", "pos")
    return lists.join(gone, ["key", "pos"], "left_anti")


def ltrim(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """LTRIM: only rows in the range stay; positions come back dense, as ``idx``."""
    return lrange(lists, start, stop)


def lpos(lists: DataFrame, value: str, rank: int = 1, count: int | None = None, maxlen: int = 0) -> DataFrame:
    """LPOS: (key, idx) of matches from the ``rank``-th on (negative: from the end), ``count`` of them (0: all), looking at ``maxlen`` rows."""
    if rank == 0:
        raise ValueError("RANK can't be zero")
    side = _head if rank > 0 else _tail
    placed = side(lists)
    if maxlen:
        placed = placed.where(F.col("rn") <= maxlen)
    sizes = lists.groupBy("key").agg(F.count("*").alias("n"))
    found = ranked(placed.where(F.col("value") == value), ["key"], [F.col("rn")], "match").where(F.col("match") >= abs(rank))
    many = 1 if count is None else count
    if many:
        found = found.where(F.col("match") < abs(rank) + many)
    if rank > 0:
        return found.select("key", (F.col("rn") - 1).alias("idx"))
    return found.join(sizes, "key").select("key", (F.col("n") - F.col("rn")).alias("idx"))


def lmove(lists: DataFrame, source: object, target: object, from_left: bool = True, to_left: bool = False) -> DataFrame:
    """LMOVE, RPOPLPUSH: one row from an end of ``source`` to an end of ``target``."""
    end = W.partitionBy(F.lit(0)).orderBy(F.col("pos") if from_left else F.col("pos").desc())
    taken = lists.where(F.col("key") == source).withColumn("rn", F.row_number().over(end)).where("rn = 1").select("key", F.col("pos").alias("from"), "value")
    edge = lists.where(F.col("key") == target).agg((F.min("pos") - 1 if to_left else F.max("pos") + 1).alias("to"))
    moved = taken.join(F.broadcast(edge), F.lit(True)).select(F.lit(target).cast(lists.schema["key"].dataType).alias("key"), F.coalesce("to", F.lit(0)).alias("pos"), "value")  # one row
    rest = lists.join(F.broadcast(taken.select("key", F.col("from").alias("pos"))), ["key", "pos"], "left_anti")  # one row
    return rest.select("key", "pos", "value").unionByName(moved)


def lmpop(lists: DataFrame, keys: list, count: int = 1, left: bool = True) -> DataFrame:
    """LMPOP: rows from an end of the first of ``keys`` that has any."""
    wanted = lists.where(F.col("key").isin(keys)).withColumn("place", F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key")))
    first = wanted.agg(F.min("place").alias("place"))
    return wanted.join(F.broadcast(first), "place").drop("place").orderBy(F.col("pos") if left else F.col("pos").desc()).limit(count)  # one row
