"""Bitmaps, as rows (key, bit) of set bits or as bytes with the most significant bit first."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import scalars


def getbit(value: Column, offset: int) -> Column:
    """GETBIT of bytes; bits beyond the end are 0."""
    byte = F.conv(F.hex(F.substring(value, offset // 8 + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.shiftright(byte, 7 - offset % 8).bitwiseAND(1), F.lit(0))


def setbit(bits: DataFrame, key: str, offset: int, on: bool) -> DataFrame:
    """SETBIT on rows."""
    rest = bits.where((F.col("key") != key) | (F.col("bit") != offset))
    if not on:
        return rest
    one = bits.sparkSession.range(1).select(F.lit(key).cast(bits.schema["key"].dataType).alias("key"), F.lit(offset).cast(bits.schema["bit"].dataType).alias("bit"))
    return rest.unionByName(one)


def bitcount(bits: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """BITCOUNT by key over a range of bit positions (both included, not negative); counts different bits."""
    if start is not None:
        bits = bits.where(F.col("bit") >= start)
    if end is not None:
        bits = bits.where(F.col("bit") <= end)
    return bits.groupBy("key").agg(F.countDistinct("bit").alias("bitcount"))


def bit_text(value: Column) -> Column:
    """The bits of bytes as a text of 0 and 1."""
    raw = value.cast("binary")
    places = F.when(F.octet_length(raw) > 0, F.sequence(F.lit(1), F.octet_length(raw))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: F.lpad(F.bin(F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint")), 8, F.lit("0"))), "")


def _range(n: Column, start: int, end: int) -> tuple[Column, Column]:
    """First and last place of a range over n places; negative ones count from the end, and both are clamped to the value."""
    first, last = (F.greatest((n + x) if x < 0 else F.lit(x), F.lit(0)) for x in (start, end))
    return first, F.least(last, n - 1)


def bitcount_bytes(value: Column, start: int | None = None, end: int | None = None, unit: str = "BYTE") -> Column:
    """BITCOUNT of bytes, 0 for a missing value: set bits, all or those between two bytes or (BIT) two bits, both included."""
    if start is not None and end is not None and 0 > start > end:
        return F.lit(0)
    if start is not None and unit == "BIT":
        bits = bit_text(F.coalesce(value.cast("binary"), F.lit(b"")))
        first, last = _range(F.length(bits), start, -1 if end is None else end)
        return F.coalesce(F.length(F.regexp_replace(F.substring(bits, first + 1, F.greatest(last - first + 1, F.lit(0))), "0", "")), F.lit(0))
    if start is not None:
        value = scalars.getrange(value, start, -1 if end is None else end)
    digits = F.hex(value)
    groups = {1: "1248", 2: "3569AC", 3: "7BDE", 4: "F"}
    return F.coalesce(sum((F.length(F.regexp_replace(digits, f"[^{d}]", "")) * n for n, d in groups.items()), F.lit(0)), F.lit(0))


def bitpos_bytes(value: Column, on: bool = True, start: int | None = None, end: int | None = None, unit: str = "BYTE") -> Column:
    """BITPOS of bytes: place of the first bit that is ``on`` within a range of bytes or (BIT) bits, -1 where there is none.

    Looking for a clear bit without an end, a value of set bits has one behind its last.  A missing value is all clear, an
    empty one has no bits.
    """
    bits = bit_text(F.coalesce(value.cast("binary"), F.lit(b"")))
    width = 8 if unit == "BYTE" else 1
    first, last = _range(F.floor(F.length(bits) / width).cast("int"), start or 0, -1 if end is None else end)
    first, last = first * width, last * width + width - 1
    at = F.locate("1" if on else "0", F.substring(bits, first + 1, F.greatest(last - first + 1, F.lit(0))))
    beyond = F.lit(-1) if on or end is not None else F.when(first <= last, F.length(bits)).otherwise(F.lit(-1))
    return F.when(value.isNull(), F.lit(-1 if on else 0)).when(at > 0, first + at - 1).otherwise(beyond).cast("bigint")


def bitpos(bits: DataFrame, on: bool = True, length: int | None = None) -> DataFrame:
    """BITPOS by key: the first set bit, or the first clear one (``length`` bits when all are set)."""
    if on:
        return bits.groupBy("key").agg(F.min("bit").alias("bitpos"))
    # set bits in order have no gap as long as bit = place; the first clear one is their count
    from keyloom.keyspace import ranked

    placed = ranked(bits.select("key", "bit").distinct(), ["key"], [F.col("bit")])
    filled = placed.groupBy("key").agg(F.sum((F.col("bit") == F.col("rn") - 1).cast("bigint")).alias("bitpos"))
    return filled if length is None else filled.withColumn("bitpos", F.least("bitpos", F.lit(length)))


def bitop(operation: str, sources: list[DataFrame], domain: DataFrame | None = None) -> DataFrame:
    """BITOP AND, OR, XOR of frames of bits, or NOT of one within ``domain``; repeated rows of a source count once."""
    sets = [s.select("bit").distinct() for s in sources]
    if operation == "NOT":
        if len(sets) != 1 or domain is None:
            raise ValueError("BITOP NOT must be called with a single source key")
        return domain.select("bit").join(sets[0], "bit", "left_anti")
    if operation == "AND":
        return reduce(lambda a, b: a.join(b, "bit", "left_semi"), sets)
    rows = reduce(DataFrame.union, sets)
    if operation == "OR":
        return rows.distinct()
    return rows.groupBy("bit").agg(F.count("*").alias("n")).where("n % 2 = 1").select("bit")


def bitfield(frame: DataFrame, operations: list[tuple], value: str = "value") -> DataFrame:
    """BITFIELD: ``frame`` with ``replies`` (an array, null for a failed write) and the value after all operations.

    Operations: ("GET", "u8", offset), ("SET", "i16", offset, number), ("INCRBY", "u4", offset, delta), ("OVERFLOW", "WRAP" |
    "SAT" | "FAIL") for those that follow.  An offset ``"#3"`` counts in fields.  Later operations see earlier ones.
    """
    steps = list(operations)

    @F.pandas_udf("struct<replies:array<bigint>,value:binary>")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_bitfield(bytes(v or b""), steps) for v in values], columns=["replies", "value"])

    out = frame.withColumn("_r", run(F.col(value).cast("binary")))
    return out.select(*[c for c in frame.columns if c != value], F.col("_r.value").alias(value), "_r.replies")


def _bitfield(raw: bytes, steps: list[tuple]) -> tuple[list[int | None], bytes]:
    replies: list[int | None] = []
    raw, overflow = bytearray(raw), "WRAP"
    for step in steps:
        if step[0] == "OVERFLOW":
            overflow = step[1]
            continue
        signed, width = step[1][0] == "i", int(step[1][1:])
        at = int(step[2][1:]) * width if str(step[2]).startswith("#") else int(step[2])
        first, last = at // 8, -(-(at + width) // 8)  # the bytes that hold the field
        piece = raw[first:last].ljust(last - first, b"\0")
        number, shift = int.from_bytes(piece, "big"), last * 8 - at - width
        old = number >> shift & (1 << width) - 1
        old -= (signed and old >> width - 1) << width
        if step[0] == "GET":
            replies.append(old)
            continue
        low, high = (-(1 << width - 1), (1 << width - 1) - 1) if signed else (0, (1 << width) - 1)
        new = step[3] if step[0] == "SET" else old + step[3]
        if not low <= new <= high:
            if overflow == "FAIL":
                replies.append(None)
                continue
            if overflow == "SAT":
                new = high if new > high else low
            else:
                new &= (1 << width) - 1
                new -= (signed and new >> width - 1) << width
        replies.append(old if step[0] == "SET" else new)
        number = number & ~((1 << width) - 1 << shift) | (new & (1 << width) - 1) << shift
        if len(raw) < last:
            raw.extend(bytes(last - len(raw)))
        raw[first:last] = number.to_bytes(last - first, "big")
    return replies, bytes(raw)
