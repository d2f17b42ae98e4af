"""Scalar expressions on values: all of them built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_TEXT = r"^(0|-?[1-9][0-9]*)$"


def canonical_int(value: Column) -> Column:
    """A 64-bit integer from its canonical text; null for others (``+1``, ``010``, ``-0``, out of range)."""
    text = value.cast("string")
    return F.when(text.rlike(INT_TEXT), text.try_cast("bigint"))


def strlen(value: Column) -> Column:
    """Bytes of a value; 0 where it is missing."""
    return F.coalesce(F.octet_length(value), F.lit(0))


def getrange(value: Column, start: int, end: int) -> Column:
    """The bytes from start to end, both included; negative positions count from the end, and the range is clamped."""
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    first = F.greatest(F.lit(start) + (n if start < 0 else F.lit(0)), F.lit(0))
    last = F.least(F.greatest(F.lit(end) + n, F.lit(0)) if end < 0 else F.lit(end), n - 1)
    none = F.lit(start < 0 and end < 0 and start > end)
    return F.when(none | (first > last) | (n == 0), F.lit(b"")).otherwise(F.substring(raw, first + 1, last - first + 1))


def setrange(value: Column, offset: int, piece: Column) -> Column:
    """``value`` with ``piece`` written at a byte offset, zero bytes filling a gap; an empty piece changes nothing."""
    if offset < 0:
        raise ValueError("offset is out of range")
    raw, put = F.coalesce(value.cast("binary"), F.lit(b"")), piece.cast("binary")
    n, k = F.octet_length(raw), F.octet_length(put)
    head = F.rpad(F.substring(raw, 1, offset), offset, F.lit(b"\x00")) if offset else F.lit(b"")
    tail = F.substring(raw, F.lit(offset) + k + 1, F.greatest(n - offset - k, F.lit(0)))
    return F.when(k == 0, raw).otherwise(F.concat(head, put, tail))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of the dynamic programme, as folds over characters.

    A row whose shorter text has 62 characters at most is a long, with a bit cleared where it grows; longer ones are arrays.
    """
    swap = F.length(a) < F.length(b)
    # both texts are split once and bound to a lambda's variable, as its body is evaluated for every element
    texts = F.array(F.struct(F.split(F.when(swap, b).otherwise(a), "").alias("left"), F.split(F.when(swap, a).otherwise(b), "").alias("right")))

    def bits(t: Column) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
        whole = bit(F.size(t["right"])) - 1
        places = F.transform(t["right"], lambda c, i: F.struct(c.alias("c"), bit(i).alias("bit")))

        def step(row: Column, c: Column) -> Column:
            u = row["v"].bitwiseAND(F.aggregate(row["places"], F.lit(0).cast("bigint"), lambda m, p: F.when(p["c"] == c, m.bitwiseOR(p["bit"])).otherwise(m)))
            return F.struct(((row["v"] + u).bitwiseOR(row["v"] - u)).bitwiseAND(row["whole"]).alias("v"), row["whole"].alias("whole"), row["places"].alias("places"))

        start = F.struct(whole.alias("v"), whole.alias("whole"), places.alias("places"))
        return F.aggregate(t["left"], start, step, lambda row: F.size(row["places"]) - F.bit_count(row["v"]))

    def arrays(t: Column) -> Column:
        right = t["right"]

        def step(row: Column, c: Column) -> Column:
            # the new row grows by the best of: above-left + 1 on a match, above, left
            return F.aggregate(
                F.sequence(F.lit(1), F.size(right)),
                F.array(F.lit(0)),
                lambda acc, j: F.concat(acc, F.array(F.when(F.get(right, j - 1) == c, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(acc, -1))))),
            )

        return F.element_at(F.aggregate(t["left"], F.array_repeat(F.lit(0), F.size(right) + 1), step), -1)

    whole = F.get(F.transform(texts, lambda t: F.when(F.size(t["right"]) <= 62, bits(t)).otherwise(arrays(t))), F.lit(0))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(whole)


def score_text(score: Column) -> Column:
    """A score as replies show it: the shortest digits that read back as the same number.

    Whole numbers have no point; point notation holds up to seven zeros before or behind the digits, then ``1.5e+30``.
    """
    # each step is bound to a variable: written out, one in the other, they are beyond the size of generated code
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    named = lambda **parts: F.struct(*[v.alias(k) for k, v in parts.items()])
    split = lambda plain: named(mantissa=F.regexp_extract(plain, r"^([0-9.]+)", 1), exponent=F.coalesce(F.regexp_extract(plain, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0)))
    joined = lambda p: named(every=F.regexp_replace(p["mantissa"], r"\.", ""), point=p["exponent"] - F.length(F.regexp_extract(p["mantissa"], r"\.([0-9]+)$", 1)))
    stripped = lambda p: named(short=F.rtrim(p["every"], F.lit("0")), k=p["point"] + F.length(p["every"]))
    counted = lambda p: named(digits=F.ltrim(p["short"], F.lit("0")), k=p["k"] - F.length(p["short"]))

    def shown(p: Column) -> Column:
        digits, k, n = p["digits"], p["k"], F.length(p["digits"])
        top = k + n - 1
        pointed = F.when(n + k > 0, F.concat(F.substring(digits, F.lit(1), n + k), F.lit("."), F.substring(digits, n + k + 1, n))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -(n + k)), digits))
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit(""))
        scientific = F.concat(F.substring(digits, 1, 1), tail, F.when(top < 0, "e-").otherwise("e+"), F.abs(top).cast("string"))
        return F.when((k >= 0) & (F.abs(top) < n + 7), F.concat(digits, F.repeat(F.lit("0"), k))).when((k < 0) & ((k > -7) | (F.abs(top) < 4)), pointed).otherwise(scientific)

    text = bind(bind(bind(bind(bind(F.abs(score).cast("string"), split), joined), stripped), counted), shown)
    return (
        F.when(F.isnan(score), "nan")
        .when(F.abs(score) == float("inf"), F.when(score > 0, "inf").otherwise("-inf"))
        .when(score == 0, F.when(score.cast("string") == "-0.0", "-0").otherwise("0"))
        .when((F.floor(score) == score) & (F.abs(score) < 4.5e18), score.cast("bigint").cast("string"))
        .when((F.abs(score) >= 0.001) & (F.abs(score) < 10_000), F.rtrim(score.cast("string"), F.lit("0")))  # in point notation already
        .otherwise(F.concat(F.when(score < 0, "-").otherwise(""), text))
    )


def millis(time: Column) -> Column:
    """Milliseconds since 1970 of a time, read as UTC whatever the session's zone is."""
    return F.unix_millis(F.from_utc_timestamp(time.cast("timestamp"), F.current_timezone()))
