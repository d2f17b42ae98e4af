"""Introspection as frames: the registry of operators, configuration, counters and the log of slow queries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.command_keys import command_keys
from keyloom.functions.glob import glob_match


def commands(spark: SparkSession) -> DataFrame:
    """COMMAND: (family, name, summary) of every operator function."""
    from keyloom.operators import bitmaps, generic, geo, hashes, lists, pubsub, sets, sorting, streams, strings, ttl, zsets

    rows = []
    for module in (bitmaps, generic, geo, hashes, lists, pubsub, sets, sorting, streams, strings, ttl, zsets):
        family = module.__name__.rpartition(".")[2]
        rows += [(family, n, (f.__doc__ or "").split("\n")[0]) for n, f in vars(module).items() if callable(f) and getattr(f, "__module__", "") == module.__name__ and not n.startswith("_")]
    return spark.createDataFrame(rows, "family string, name string, summary string")


def command_count(spark: SparkSession) -> DataFrame:
    return commands(spark).agg(F.count("*").alias("commands"))


def config_get(spark: SparkSession, pattern: str) -> DataFrame:
    """CONFIG GET: settings whose name matches a glob."""
    rows = [(r["key"], r["value"]) for r in spark.sql("SET").collect()]  # the session's settings
    return spark.createDataFrame(rows, "key string, value string").where(glob_match(F.col("key"), pattern))


def config_set(spark: SparkSession, settings: dict[str, str]) -> None:
    for k, v in settings.items():
        spark.conf.set(k, v)


def info(frames: dict[str, DataFrame]) -> DataFrame:
    """INFO keyspace: keys, those with expiry and their mean deadline, by database, from a keys frame."""
    return frames["keys"].groupBy("db").agg(F.count("*").alias("keys"), F.count("expire_at_ms").alias("expires"), F.avg("expire_at_ms").alias("avg_expire_at_ms"))


def ping(message: str | None = None) -> str:
    """PING, and with a message ECHO."""
    return "PONG" if message is None else message


def wait(replicas: int, timeout_ms: int) -> int:
    """WAIT: there are no replicas, so none has acknowledged and nothing is waited for."""
    if replicas < 0 or timeout_ms < 0:
        raise ValueError("value is out of range, must be positive")
    return 0


def getkeys(log: DataFrame) -> DataFrame:
    """COMMAND GETKEYS of a log (cmd, key, args): its rows with ``keys``."""
    words = F.when(F.col("key").isNull(), F.array().cast("array<string>")).otherwise(F.concat(F.array("key"), F.coalesce("args", F.array().cast("array<string>"))))
    return log.withColumn("keys", command_keys(F.col("cmd"), words))


def metrics(frames: dict[str, DataFrame], prefix: str = "keyloom") -> DataFrame:
    """Metrics in the text form that monitoring systems scrape: a line for the rows of each frame, and keys and expiring keys by database."""
    rows = None
    for name, frame in sorted(frames.items()):
        one = frame.agg(F.count("*").alias("n")).select(F.format_string(f'{prefix}_rows{{table="{name}"}} %d', "n").alias("line"))
        rows = one if rows is None else rows.unionByName(one)
    if "keys" in frames:
        about = info(frames)
        for column in ("keys", "expires"):
            rows = rows.unionByName(about.select(F.format_string(f'{prefix}_{column}{{db="%d"}} %d', F.col("db").cast("int"), column).alias("line")))
    return rows


class SlowLog:
    """SLOWLOG: runs that took long, newest first, at most ``size``; LATENCY: their percentiles."""

    def __init__(self, threshold_us: int = 10_000, size: int = 128):
        self.threshold_us, self.size, self.entries, self.next = threshold_us, size, [], 0

    def run(self, name: str, action: Callable[[], object]) -> object:
        began, clock = time.time(), time.perf_counter()
        out = action()
        took = int((time.perf_counter() - clock) * 1e6)
        if took >= self.threshold_us:
            self.entries = [(self.next, int(began), took, name), *self.entries][: self.size]
            self.next += 1
        return out

    def get(self, spark: SparkSession, count: int = 10) -> DataFrame:
        return spark.createDataFrame(self.entries[: count if count >= 0 else None], "id long, at long, micros long, command string")

    def len(self) -> int:
        return len(self.entries)

    def reset(self) -> None:
        self.entries = []

    def latency(self, spark: SparkSession) -> DataFrame:
        return self.get(spark, -1).groupBy("command").agg(F.count("*").alias("n"), F.percentile_approx("micros", 0.5).alias("p50"), F.percentile_approx("micros", 0.99).alias("p99"))
