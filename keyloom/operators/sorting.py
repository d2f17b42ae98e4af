"""SORT: order the elements of a list, set or sorted set by looked-up weights, and fetch looked-up values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(pattern: str) -> tuple[str, str, str | None]:
    """Text before and after the star, and a hash field behind ``->``."""
    name, _, field = pattern.partition("->")
    before, _, after = name.partition("*")
    return before, after, field or None


def dereference(rows: DataFrame, element: str, pattern: str, name: str, strings: DataFrame | None, hashes: DataFrame | None) -> DataFrame:
    """``rows`` with the value that a pattern names: ``#`` the element, ``w_*`` a string, ``h_*->f`` a hash field; null if missing."""
    if pattern == "#":
        return rows.withColumn(name, F.col(element))
    before, after, field = _parts(pattern)
    if "*" not in pattern:
        return rows.withColumn(name, F.lit(None).cast("string"))
    if field is None:
        found = strings.select(F.col("key").cast("string").alias("_k"), F.col("value").cast("string").alias(name))
    else:
        found = hashes.where(F.col("field") == field).select(F.col("key").cast("string").alias("_k"), F.col("value").cast("string").alias(name))
    return rows.withColumn("_k", F.concat(F.lit(before), F.col(element).cast("string"), F.lit(after))).join(found, "_k", "left").drop("_k")


def sort(
    elements: DataFrame,
    by: str | None = None,
    get: tuple[str, ...] = ("#",),
    alpha: bool = False,
    descending: bool = False,
    offset: int = 0,
    count: int = -1,
    strings: DataFrame | None = None,
    hashes: DataFrame | None = None,
    element: str = "element",
) -> DataFrame:
    """SORT of (element): rows (pos, get0, get1, ...) in order.

    Weights are the elements or what ``by`` names; a missing one counts 0 (``alpha``: as the smallest), a text that is not
    a number is an error even outside the limit, and ties go by the element.  ``by`` without a star leaves the order, given
    by a column ``pos``.  The limit plans as a top-k, and lookups of ``get`` follow it.
    """
    names = [f"get{k}" for k in range(len(get))]
    order: list[Column]
    if by is not None and "*" not in by and by != "#":
        order = [F.col("pos").desc() if descending else F.col("pos")] if "pos" in elements.columns else [F.col(element)]
        rows = elements
    else:
        rows = elements.select(element) if by is None else dereference(elements.select(element), element, by, "_w", strings, hashes)
        weight = F.col(element if by is None else "_w").cast("string")
        if not alpha:
            number = weight.try_cast("double")
            wrong = F.raise_error(F.lit("ERR One or more scores can't be converted into double")).cast("double")
            weight = F.when(weight.isNull(), F.lit(0.0)).when(number.isNull() | F.isnan(number), wrong).otherwise(number)
        rows = rows.withColumn("_s", weight)
        if not alpha:
            # every weight is checked, whatever the limit shows
            rows = rows.where(F.col("_s").isNotNull())
        order = [F.col("_s").desc_nulls_last(), F.col(element).desc()] if descending else [F.col("_s").asc_nulls_first(), F.col(element)]
    ordered = rows.orderBy(*order)
    if offset > 0:
        ordered = ordered.offset(offset)
    if count >= 0:
        ordered = ordered.limit(count)
    kept = [c for c in ("_s", element, "pos") if c in ordered.columns]
    out = ordered.select(*kept)
    for pattern, name in zip(get, names, strict=True):
        out = dereference(out, element, pattern, name, strings, hashes)
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy(*order))  # the reply itself is one ordered list
    return out.select(place.alias("place"), *names)


def store(lists: DataFrame, key: object, result: DataFrame, column: str = "get0") -> DataFrame:
    """SORT STORE: the reply as a list in place of ``key``, missing values as empty texts."""
    new = result.select(F.lit(key).cast(lists.schema["key"].dataType).alias("key"), F.col("place").cast("bigint").alias("pos"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value"))
    return lists.where(F.col("key") != key).select("key", "pos", "value").unionByName(new)
