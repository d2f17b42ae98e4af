"""Operators on keys of any type.  A keys frame has key, type and expire_at_ms; requests are frames with a key column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.glob import glob_match
from keyloom.functions.keyslot import keyslot
from keyloom.keyspace import live


def keys(frame: DataFrame, pattern: str) -> DataFrame:
    """KEYS: rows whose key matches a glob."""
    return frame.where(glob_match(F.col("key").cast("string"), pattern))


def scan(frame: DataFrame, after: tuple[int, str] | None = None, pattern: str | None = None, type_: str | None = None, count: int = 10) -> DataFrame:
    """SCAN: the next page of keys in the order (slot, key) behind the cursor ``after``; its last row is the next cursor."""
    rows = frame.withColumn("slot", keyslot(F.col("key").cast("string")))
    if after is not None:
        rows = rows.where((F.col("slot") > after[0]) | ((F.col("slot") == after[0]) & (F.col("key") > after[1])))
    if pattern is not None:
        rows = rows.where(glob_match(F.col("key").cast("string"), pattern))
    if type_ is not None:
        rows = rows.where(F.col("type") == type_)
    return rows.orderBy("slot", "key").limit(count)


def scan_by(frame: DataFrame, element: str, after: str | None = None, pattern: str | None = None, count: int = 10) -> DataFrame:
    """HSCAN, SSCAN, ZSCAN: a page of one key's elements in element order, behind the cursor."""
    rows = frame if after is None else frame.where(F.col(element) > after)
    if pattern is not None:
        rows = rows.where(glob_match(F.col(element).cast("string"), pattern))
    return rows.orderBy(element).limit(count)


def dbsize(frame: DataFrame, now_ms: int) -> DataFrame:
    """DBSIZE: how many keys are live, by database where there is one."""
    by = ["db"] if "db" in frame.columns else []
    return live(frame, now_ms).groupBy(*by).agg(F.count("*").alias("dbsize"))


def randomkey(frame: DataFrame, now_ms: int, seed: int = 0) -> DataFrame:
    """RANDOMKEY: a live key, by a seeded draw."""
    return live(frame, now_ms).orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(1).select("key")


def type_of(frame: DataFrame, requests: DataFrame) -> DataFrame:
    """TYPE: of each requested key, ``none`` where there is none."""
    return requests.join(frame.select("key", "type"), "key", "left").withColumn("type", F.coalesce("type", F.lit("none")))


def exists(frame: DataFrame, requests: DataFrame) -> DataFrame:
    """EXISTS and TOUCH: how many requests meet a key, repeated ones counted again."""
    return requests.join(frame.select("key"), "key", "left_semi").agg(F.count("*").alias("found"))


def delete(frame: DataFrame, requests: DataFrame) -> DataFrame:
    """DEL and UNLINK: what remains."""
    return frame.join(requests.select("key"), "key", "left_anti")


def deleted(frame: DataFrame, requests: DataFrame) -> DataFrame:
    """How many different keys DEL removes."""
    return frame.join(requests.select("key"), "key", "left_semi").agg(F.countDistinct("key").alias("deleted"))


def rename(frame: DataFrame, old: str, new: str, only_if_new: bool = False) -> DataFrame:
    """RENAME and RENAMENX: rows of ``old`` under ``new``, whose own rows go; the expiry moves along."""
    if old == new:
        return frame
    if only_if_new:
        taken = frame.where(F.col("key") == new).select(F.lit(True).alias("taken")).limit(1)
        flagged = frame.join(F.broadcast(taken), F.lit(True), "left")  # one row
        return flagged.withColumn("key", F.when((F.col("key") == old) & F.col("taken").isNull(), F.lit(new)).otherwise(F.col("key"))).drop("taken")
    return frame.where(F.col("key") != new).withColumn("key", F.when(F.col("key") == old, F.lit(new)).otherwise(F.col("key")))


def copy(frame: DataFrame, source: str, target: str, db: int | None = None, replace: bool = False) -> DataFrame:
    """COPY: rows of ``source`` once more under ``target`` (in another database), with their expiry; an existing target stays unless replaced."""
    if source == target and db is None:
        raise ValueError("source and destination objects are the same")
    here = F.col("key") == target
    if db is not None:
        here = here & (F.col("db") == db)
    new = frame.where(F.col("key") == source).withColumn("key", F.lit(target))
    if db is not None:
        new = new.withColumn("db", F.lit(db).cast(frame.schema["db"].dataType))
    if replace:
        return frame.where(~here).unionByName(new)
    taken = frame.where(here).select(F.lit(1).alias("taken")).limit(1)
    return frame.unionByName(new.join(F.broadcast(taken), F.lit(True), "left_anti"))  # one row


def flushdb(frame: DataFrame, db: int | None = None) -> DataFrame:
    """FLUSHDB of one database, FLUSHALL without one."""
    return frame.where(F.lit(False)) if db is None else frame.where(F.col("db") != db)


def mget(strings: DataFrame, wanted: list[str]) -> DataFrame:
    """MGET: (pos, key, value) in request order, null where a key is missing.  The requests, a literal list, travel to the data."""
    spark = strings.sparkSession
    kind = strings.schema["key"].dataType
    requests = spark.createDataFrame([(i, str(k)) for i, k in enumerate(wanted)], "pos int, key string").withColumn("key", F.col("key").cast(kind))
    found = strings.join(F.broadcast(requests.select("key").distinct()), "key", "left_semi")
    return requests.join(found.select("key", "value"), "key", "left").select("pos", "key", "value")


def mset(strings: DataFrame, pairs: DataFrame, by: str = "pos", only_if_new: bool = False) -> DataFrame:
    """MSET and MSETNX: later pairs win; MSETNX changes nothing when any of the keys is there already."""
    last = pairs.groupBy("key").agg(F.max_by("value", by).alias("value"))
    if only_if_new:
        taken = strings.join(last.select("key"), "key", "left_semi").select(F.lit(1).alias("taken")).limit(1)
        return strings.unionByName(last.join(F.broadcast(taken), F.lit(True), "left_anti"), allowMissingColumns=True)
    return strings.join(last.select("key"), "key", "left_anti").unionByName(last, allowMissingColumns=True)


def dump(frame: DataFrame, columns: list[str]) -> DataFrame:
    """DUMP: each key's rows as one JSON payload with its checksum.  Made for single keys: the payload is a value of its own."""
    body = F.to_json(F.sort_array(F.collect_list(F.struct(*columns))))
    return frame.groupBy("key").agg(body.alias("payload")).withColumn("checksum", F.crc32(F.col("payload").cast("binary")))


def restore(payloads: DataFrame, schema: str, existing: DataFrame | None = None, replace: bool = False) -> DataFrame:
    """RESTORE: rows from DUMP payloads.  A wrong checksum fails, and so does a key that exists unless it may be replaced."""
    if existing is not None and not replace:
        busy = payloads.join(existing.select("key").distinct().withColumn("busy", F.lit(True)), "key", "left")
        payloads = busy.withColumn("payload", F.when(F.col("busy"), F.raise_error(F.lit("BUSYKEY Target key name already exists.")).cast("string")).otherwise(F.col("payload"))).drop("busy")
    fine = F.crc32(F.col("payload").cast("binary")) == F.col("checksum")
    body = F.when(fine, F.col("payload")).otherwise(F.raise_error(F.lit("DUMP payload version or checksum are wrong")).cast("string"))
    return payloads.select("key", F.inline(F.from_json(body, f"array<struct<{schema}>>")))


def slots(frame: DataFrame, key: Column | None = None) -> DataFrame:
    """Keys per hash slot."""
    return frame.select(keyslot(key if key is not None else F.col("key").cast("string")).alias("slot")).groupBy("slot").agg(F.count("*").alias("keys"))


def countkeysinslot(frame: DataFrame, slot: int) -> DataFrame:
    """CLUSTER COUNTKEYSINSLOT."""
    return getkeysinslot(frame, slot).agg(F.count("*").alias("keys"))


def getkeysinslot(frame: DataFrame, slot: int, count: int | None = None) -> DataFrame:
    """CLUSTER GETKEYSINSLOT: different keys of a slot, ``count`` at most, in key order."""
    if not 0 <= slot < 16384:
        raise ValueError("Invalid or out of range slot")
    rows = frame.where(keyslot(F.col("key").cast("string")) == slot).select("key").distinct()
    return rows if count is None else rows.orderBy("key").limit(count)
