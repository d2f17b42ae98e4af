"""Sorted sets: rows (key, member, score), in the total order (score, member)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.keyspace import ranked
from keyloom.operators.generic import scan_by as zscan  # noqa: F401
from keyloom.operators.hashes import sample

KM = ["key", "member"]


def order(reverse: bool = False) -> list[Column]:
    return [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score"), F.col("member")]


def zadd(log: DataFrame, flag: str | None = None, seq: str = "seq") -> DataFrame:
    """ZADD of a log of (key, member, score, seq) into new sets: the last score; GT the greatest, LT the least, NX the first, INCR the sum.

    Mixed logs, with removals, go through ``keyloom.plans.fold``.
    """
    how = {None: F.max_by("score", seq), "GT": F.max("score"), "LT": F.min("score"), "NX": F.min_by("score", seq), "INCR": F.sum("score")}[flag]
    return log.groupBy(*KM).agg(how.alias("score"))


def zadd_to(zsets: DataFrame, new: DataFrame, nx: bool = False, xx: bool = False, gt: bool = False, lt: bool = False) -> tuple[DataFrame, DataFrame]:
    """ZADD of one row per member into ``zsets``: the rows after it, and by key how many were added and changed."""
    if nx and (xx or gt or lt) or gt and lt:
        raise ValueError("GT, LT, and/or NX options at the same time are not compatible")
    both = zsets.select(*KM, "score").join(new.select(*KM, F.col("score").alias("new")), KM, "full_outer")
    there, written = F.col("score").isNotNull(), F.col("new").isNotNull()
    better = (F.col("new") > F.col("score")) if gt else (F.col("new") < F.col("score")) if lt else F.lit(not nx)
    takes = written & F.when(there, better).otherwise(F.lit(not xx))
    after = both.where(there | takes).select(*KM, F.when(takes, F.col("new")).otherwise(F.col("score")).alias("score"))
    changed = takes & there & (F.col("new") != F.col("score"))
    counts = both.where(written).groupBy("key").agg(F.count_if(takes & ~there).alias("added"), F.count_if(changed | (takes & ~there)).alias("changed"))
    return after, counts


def zincrby(log: DataFrame, delta: str = "delta") -> DataFrame:
    """ZINCRBY: scores as sums of increments, partially summed before the shuffle."""
    return log.groupBy(*KM).agg(F.sum(delta).alias("score"))


def zrem(zsets: DataFrame, gone: DataFrame) -> DataFrame:
    return zsets.join(gone, KM, "left_anti")


def zcard(zsets: DataFrame) -> DataFrame:
    return zsets.groupBy("key").agg(F.count("*").alias("zcard"))


def zmscore(zsets: DataFrame, requests: DataFrame) -> DataFrame:
    """ZSCORE, ZMSCORE: requests with their score, null where missing."""
    return requests.join(zsets.select(*KM, "score"), KM, "left")


def score_range(low: float | str, high: float | str) -> Column:
    """A condition from bounds like ``1``, ``(1``, ``-inf``."""

    def bound(x: float | str, closed, open_) -> Column:
        text = str(x)
        return open_(float(text[1:])) if text.startswith("(") else closed(float(text))

    s = F.col("score")
    return bound(low, lambda v: s >= v, lambda v: s > v) & bound(high, lambda v: s <= v, lambda v: s < v)


def lex_range(low: str, high: str) -> Column:
    """A condition from bounds like ``-``, ``+``, ``[a``, ``(a``."""
    m = F.col("member").cast("string")

    def side(x: str, least: bool) -> Column:
        if x in ("-", "+"):
            return F.lit((x == "-") == least)
        if x[:1] not in ("[", "("):
            raise ValueError("min or max not valid string range item")
        v = x[1:]
        return {("[", True): m >= v, ("(", True): m > v, ("[", False): m <= v, ("(", False): m < v}[x[0], least]

    return side(low, True) & side(high, False)


def zcount(zsets: DataFrame, low: float | str, high: float | str) -> DataFrame:
    return zsets.where(score_range(low, high)).groupBy("key").agg(F.count("*").alias("zcount"))


def zlexcount(zsets: DataFrame, low: str, high: str) -> DataFrame:
    return zsets.where(lex_range(low, high)).groupBy("key").agg(F.count("*").alias("zlexcount"))


def zrank(zsets: DataFrame, requests: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """ZRANK, ZREVRANK: the place from 0 of every member, or of those requested (key, member)."""
    if requests is not None:
        zsets = zsets.join(requests.select("key").distinct(), "key", "left_semi")
    out = ranked(zsets, ["key"], order(reverse)).select(*KM, "score", (F.col("rn") - 1).alias("rank"))
    return out if requests is None else requests.join(out, KM)


def zrange(zsets: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """ZRANGE, ZREVRANGE by place, both ends included, negative ones from the end: rows with ``rank`` in reply order.

    Ends of one sign become one bound on the row number, which plans as a group limit before the shuffle; ends of both
    signs need the key's size beside it.
    """
    if start >= 0 and stop >= 0:
        return ranked(zsets, ["key"], order(reverse)).where(F.col("rn") <= stop + 1).where(F.col("rn") > start).select("*", (F.col("rn") - 1).cast("bigint").alias("rank")).drop("rn")
    if start < 0 and stop < 0:
        tail = ranked(zsets, ["key"], order(not reverse)).where(F.col("rn") <= -start).where(F.col("rn") >= -stop)
        return ranked(tail.drop("rn"), ["key"], order(reverse)).select("*", (F.col("rn") - 1).cast("bigint").alias("rank")).drop("rn")
    sizes = zsets.groupBy("key").agg(F.count("*").alias("n"))
    rn = F.col("rn") - 1
    first = F.lit(start) if start >= 0 else F.greatest(F.col("n") + start, F.lit(0))
    last = F.lit(stop) if stop >= 0 else F.col("n") + stop
    placed = ranked(zsets, ["key"], order(reverse)).join(sizes, "key")
    return placed.where((rn >= first) & (rn <= last)).select(*zsets.columns, rn.cast("bigint").alias("rank"))


def zrange_where(zsets: DataFrame, condition: Column, reverse: bool = False, offset: int = 0, count: int = -1) -> DataFrame:
    """ZRANGE BYSCORE or BYLEX: rows in range with their place ``pos`` in the reply.  A negative offset gives none, a negative count all."""
    if offset < 0:
        return ranked(zsets.where(F.lit(False)), ["key"], order(reverse), "pos")
    placed = ranked(zsets.where(condition), ["key"], order(reverse))
    if count >= 0:
        placed = placed.where(F.col("rn") <= offset + count)
    return placed.where(F.col("rn") > offset).select(*zsets.columns, (F.col("rn") - offset).cast("bigint").alias("pos"))


def zrangebyscore(zsets: DataFrame, low: float | str, high: float | str, offset: int = 0, count: int = -1) -> DataFrame:
    return zrange_where(zsets, score_range(low, high), False, offset, count)


def zrevrangebyscore(zsets: DataFrame, high: float | str, low: float | str, offset: int = 0, count: int = -1) -> DataFrame:
    return zrange_where(zsets, score_range(low, high), True, offset, count)


def zrangebylex(zsets: DataFrame, low: str, high: str, offset: int = 0, count: int = -1) -> DataFrame:
    return zrange_where(zsets, lex_range(low, high), False, offset, count)


def zrevrangebylex(zsets: DataFrame, high: str, low: str, offset: int = 0, count: int = -1) -> DataFrame:
    return zrange_where(zsets, lex_range(low, high), True, offset, count)


def zremrangebyrank(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    return zrem(zsets, zrange(zsets, start, stop).select(*KM))


def zremrangebyscore(zsets: DataFrame, low: float | str, high: float | str) -> DataFrame:
    return zsets.where(~score_range(low, high))


def zremrangebylex(zsets: DataFrame, low: str, high: str) -> DataFrame:
    return zsets.where(~lex_range(low, high))


def zpop(zsets: DataFrame, count: int = 1, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """ZPOPMIN, ZPOPMAX by key: what comes out, and what remains."""
    if count < 0:
        raise ValueError("value is out of range, must be positive")
    out = ranked(zsets, ["key"], order(highest)).where(F.col("rn") <= count).drop("rn")
    rest = ranked(zsets, ["key"], order(highest)).where(F.col("rn") > count).drop("rn")
    return out, rest


def zmpop(zsets: DataFrame, keys: list, count: int = 1, highest: bool = False) -> DataFrame:
    """ZMPOP: from the first of ``keys`` that has members."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    wanted = zsets.where(F.col("key").isin(keys)).withColumn("place", place)
    first = wanted.agg(F.min("place").alias("place"))
    return wanted.join(F.broadcast(first), "place").drop("place").orderBy(*order(highest)).limit(count)  # one row


def zrandmember(zsets: DataFrame, count: int, seed: int = 0) -> DataFrame:
    return sample(zsets, "member", count, seed)


def _zero_nan(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(0.0)).otherwise(c)


def _weighted(sources: list[DataFrame], weights: list[float] | None) -> list[DataFrame]:
    """(member, score) with weights; plain sets count with score 1."""
    weights = weights or [1.0] * len(sources)
    return [s.select("member", ((F.col("score") if "score" in s.columns else F.lit(1.0)) * F.lit(float(w))).alias("score")) for s, w in zip(sources, weights, strict=True)]


def zunion(sources: list[DataFrame], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """ZUNION: (member, score); products that are not numbers count as 0, and so do sums of opposite infinities."""
    parts = [p.withColumn("score", _zero_nan(F.col("score"))) for p in _weighted(sources, weights)]
    how = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}[aggregate]("score")
    return reduce(DataFrame.union, parts).groupBy("member").agg(how.alias("score")).select("member", _zero_nan(F.col("score")).alias("score"))


def zinter(sources: list[DataFrame], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """ZINTER: inner joins on the member; NaN becomes 0 only after a later source is combined."""
    first, *rest = _weighted(sources, weights)
    combine = {"SUM": lambda a, b: a + b, "MIN": F.least, "MAX": F.greatest}[aggregate]
    out = first
    for p in rest:
        out = out.join(p.withColumnRenamed("score", "other"), "member").select("member", _zero_nan(combine(F.col("score"), F.col("other"))).alias("score"))
    return out


def zintercard(sources: list[DataFrame], limit: int = 0) -> DataFrame:
    from keyloom.operators.sets import sintercard

    return sintercard(sources, limit).withColumnRenamed("sintercard", "zintercard")


def zdiff(first: DataFrame, others: list[DataFrame]) -> DataFrame:
    """ZDIFF: the first's members, with its scores, that no other has."""
    return reduce(lambda a, b: a.join(b.select("member"), "member", "left_anti"), others, first.select("member", "score"))


def store(zsets: DataFrame, key: object, result: DataFrame) -> DataFrame:
    """ZUNIONSTORE and others, ZRANGESTORE: ``result`` in place of ``key``."""
    kind = zsets.schema["key"].dataType
    return zsets.where(F.col("key") != key).select(*KM, "score").unionByName(result.select(F.lit(key).cast(kind).alias("key"), "member", "score"))
