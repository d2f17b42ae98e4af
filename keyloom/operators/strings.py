"""String values.  Writes are logs of rows (key, seq, ...) folded to what they leave behind."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.scalars import canonical_int, getrange, setrange, strlen  # noqa: F401


def get(strings: DataFrame, key: str) -> DataFrame:
    """GET: the row of one key."""
    return strings.where(F.col("key") == key)


def set_last(log: DataFrame, seq: str = "seq", value: str = "value", by: str = "key") -> DataFrame:
    """SET: the last write of each key stays."""
    return log.groupBy(by).agg(F.max_by(value, seq).alias(value))


def set_first(log: DataFrame, seq: str = "seq", value: str = "value", by: str = "key") -> DataFrame:
    """SETNX, SET NX: the first write of each key stays."""
    return log.groupBy(by).agg(F.min_by(value, seq).alias(value))


def set_values(strings: DataFrame, writes: DataFrame, condition: str | None = None, keep_ttl: bool = False) -> DataFrame:
    """SET [NX|XX] [KEEPTTL] for one write per key (key, value, expire_at_ms): the values after it.  Without KEEPTTL the write's expiry, or none, replaces the old one."""
    new = writes.select("key", F.col("value").alias("new_value"), F.col("expire_at_ms").alias("new_expiry"), F.lit(True).alias("written"))
    both = strings.withColumn("there", F.lit(True)).join(new, "key", "full_outer")
    there, written = F.col("there").isNotNull(), F.col("written").isNotNull()
    takes = written & {None: F.lit(True), "NX": ~there, "XX": there}[condition]
    expiry = F.when(takes, F.coalesce("new_expiry", F.col("expire_at_ms")) if keep_ttl else F.col("new_expiry")).otherwise(F.col("expire_at_ms"))
    return both.where(there | takes).select("key", F.when(takes, F.col("new_value")).otherwise(F.col("value")).alias("value"), expiry.alias("expire_at_ms"))


def getset(strings: DataFrame, writes: DataFrame) -> DataFrame:
    """GETSET, SET GET: (key, old, value) for every written key."""
    return writes.select("key", "value").join(strings.select("key", F.col("value").alias("old")), "key", "left").select("key", "old", "value")


def getdel(strings: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GETDEL: the values, and what remains."""
    return requests.join(strings, "key", "left"), strings.join(requests, "key", "left_anti")


def getex(strings: DataFrame, requests: DataFrame, expire_at_ms: Column | None, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """GETEX: the values, and the frame with new deadlines (None: PERSIST); passed deadlines delete."""
    asked = strings.join(requests.select("key").withColumn("asked", F.lit(True)), "key", "left")
    deadline = F.lit(None).cast("bigint") if expire_at_ms is None else expire_at_ms
    moved = asked.withColumn("expire_at_ms", F.when(F.col("asked"), deadline).otherwise(F.col("expire_at_ms"))).drop("asked")
    return requests.join(strings, "key", "left"), moved.where(F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms))


def append(log: DataFrame, seq: str = "seq", value: str = "value", by: str = "key") -> DataFrame:
    """APPEND: each key's pieces in order, as one value.  A value is at most 512 MiB, so a key's pieces fit a task."""
    pieces = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))))
    return log.groupBy(by).agg(F.concat_ws("", F.transform(pieces, lambda x: x["v"])).alias(value))


def incrby(log: DataFrame, delta: str = "delta", by: str = "key") -> DataFrame:
    """INCR, DECR, INCRBY, DECRBY: sums of deltas; leaving 64 bits is an error, as ANSI sums are."""
    return log.groupBy(by).agg(F.sum(F.col(delta).cast("bigint")).alias("value"))


def float_sum(delta: Column) -> Column:
    """Text of a sum of floats: exact to 17 places below 1e20, and beyond that the nearest double's digits."""
    exact, near = F.try_sum(delta.try_cast("decimal(38,17)")), F.sum(delta.cast("double"))
    text = F.regexp_replace(F.regexp_replace(exact.cast("decimal(38,17)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when((F.abs(near) < 1e20) & exact.isNotNull(), text).otherwise(F.format_string("%.0f", near))


def incrbyfloat(log: DataFrame, delta: str = "delta", by: str = "key") -> DataFrame:
    """INCRBYFLOAT: sums of deltas as text without trailing zeros (see ``float_sum``)."""
    return log.groupBy(by).agg(float_sum(F.col(delta)).alias("value"))


def require_int(value: Column) -> Column:
    """The integer in a text; other texts are an error."""
    return F.coalesce(canonical_int(value), F.raise_error(F.lit("ERR value is not an integer or out of range")).cast("bigint"))


def lcs(pairs: DataFrame, a: str = "a", b: str = "b", idx: bool = False, min_match_len: int = 0) -> DataFrame:
    """LCS: ``pairs`` with the longest common subsequence and its length, for values too long for expression folds (Arrow batches).

    With ``idx`` also ``matches``: the ranges of characters, last first, that both have in common in it, with their
    positions in each and their length; those shorter than ``min_match_len`` are left out (IDX, MINMATCHLEN, WITHMATCHLEN).
    """
    found = ", matches:array<struct<a_start:int,a_end:int,b_start:int,b_end:int,length:int>>" * idx
    columns = ["lcs", "length", "matches"][: 2 + idx]

    @F.pandas_udf(f"struct<lcs:string,length:int{found}>")
    def common(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        both = list(zip(left, right, strict=True))
        known = {pair: _lcs(pair[0] or "", pair[1] or "", min_match_len)[: 2 + idx] for pair in dict.fromkeys(both)}  # once for equal pairs of a batch
        return pd.DataFrame([known[pair] for pair in both], columns=columns)

    return pairs.withColumn("_r", common(F.col(a), F.col(b))).select(*pairs.columns, *[f"_r.{c}" for c in columns])


def _lcs(x: str, y: str, least: int = 0) -> tuple[str, int, list[tuple[int, int, int, int, int]]]:
    """The subsequence, its length and its ranges.  Of the table two bits a cell are kept: whether it exceeds its left and its upper neighbour."""
    row, other = np.zeros(len(y) + 1, np.int32), np.array(list(y), "U1")
    beyond_left, beyond_up = [], []
    for c in x if y else "":
        new = np.concatenate([row[:1], np.maximum.accumulate(np.where(other == c, row[:-1] + 1, row[1:]))])
        beyond_left.append(np.packbits(new[1:] > new[:-1]))
        beyond_up.append(np.packbits(new[1:] > row[1:]))
        row = new
    bit = lambda bits, k: int(bits[k >> 3]) >> (7 - (k & 7)) & 1
    i, j, here, out, matches = len(x), len(y), int(row[-1]), [], []
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.append(x[i - 1])
            i, j, here = i - 1, j - 1, here - 1
            if matches and matches[-1][:2] == [i + 1, j + 1]:
                matches[-1][:2] = [i, j]
            else:
                matches.append([i, j, i, j])
        else:
            up, left = here - bit(beyond_up[i - 1], j - 1), here - bit(beyond_left[i - 1], j - 1)
            i, j, here = (i - 1, j, up) if up > left else (i, j - 1, left)
    ranges = [(a, c, b, d, c - a + 1) for a, b, c, d in matches if c - a + 1 >= least]
    return "".join(reversed(out)), len(out), ranges
