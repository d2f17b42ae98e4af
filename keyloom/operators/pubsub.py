"""Publish and subscribe: messages (channel, payload, ...) against subscriptions (session, kind, name).

The same functions work when messages are a stream: a stream joined with a static table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.glob import glob_match
from keyloom.keyspace import ranked


def subscribe(subscriptions: DataFrame, session: str, names: list[str], kind: str = "channel") -> DataFrame:
    """SUBSCRIBE, PSUBSCRIBE."""
    new = subscriptions.sparkSession.createDataFrame([(session, kind, n) for n in names], "session string, kind string, name string")
    return subscriptions.select("session", "kind", "name").unionByName(new).distinct()


def unsubscribe(subscriptions: DataFrame, session: str, names: list[str] | None = None, kind: str = "channel") -> DataFrame:
    """UNSUBSCRIBE, PUNSUBSCRIBE; without names from all."""
    own = (F.col("session") == session) & (F.col("kind") == kind)
    return subscriptions.where(~(own if names is None else own & F.col("name").isin(names)))


def deliveries(messages: DataFrame, subscriptions: DataFrame, patterns: list[str]) -> DataFrame:
    """PUBLISH: a row for each receiver.  ``patterns`` are the different names of pattern subscriptions.

    Exact channels are an equi-join.  A channel's matching patterns are found by expressions on the message, and joined
    with their sessions by the pattern's name, so no message meets every subscription.
    """
    exact = messages.join(subscriptions.where("kind = 'channel'").select("session", F.col("name").alias("channel")), "channel").withColumn("pattern", F.lit(None).cast("string"))
    if not patterns:
        return exact
    hits = F.filter(F.array(*[F.when(glob_match(F.col("channel"), p), F.lit(p)) for p in patterns]), lambda x: x.isNotNull())
    by_pattern = messages.withColumn("pattern", F.explode(hits)).join(subscriptions.where("kind = 'pattern'").select("session", F.col("name").alias("pattern")), "pattern")
    return exact.unionByName(by_pattern)


def receivers(messages: DataFrame, subscriptions: DataFrame, patterns: list[str], by: list[str]) -> DataFrame:
    """What PUBLISH returns for each message: its receivers, an exact subscription and each matching pattern counting one each."""
    sent = deliveries(messages, subscriptions, patterns).groupBy(*by).agg(F.count("*").alias("receivers"))
    return messages.select(*by).join(sent, by, "left").select(*by, F.coalesce("receivers", F.lit(0)).alias("receivers"))


def heads(messages: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` messages of each channel."""
    return ranked(messages, ["channel"], [F.col(order)], "_n").where(F.col("_n") <= n).drop("_n")


def limited(sent: DataFrame, order: str, frames: int = 10_000, size: int = 128 << 20, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Back-pressure on deliveries that wait to be read: (those that go out, sessions that are closed).

    A session whose queue would pass ``frames`` messages or ``size`` bytes is closed with the first one beyond; it gets
    what came before, and nothing after.  The message that closes a session is its ``frames`` + 1st at the latest, so
    deliveries of ``heads(messages, order, frames + 1)`` give the same: a message behind as many of its own channel is
    behind as many in every queue, and a channel needn't be sent whole to each of its sessions.
    """
    first = ranked(sent, ["session"], [F.col(order), F.col("channel")], "_n").where(F.col("_n") <= frames + 1)
    so_far = W.partitionBy("session").orderBy(order, "channel").rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = first.withColumn("_size", F.sum(F.coalesce(F.octet_length(payload), F.lit(0))).over(so_far))
    fits = (F.col("_n") <= frames) & (F.col("_size") <= size)
    return queued.where(fits).drop("_n", "_size"), queued.where(~fits).groupBy("session").agg(F.min(order).alias("closed_at"))


def channels(subscriptions: DataFrame, pattern: str | None = None) -> DataFrame:
    """PUBSUB CHANNELS: different channels with subscribers, sorted."""
    rows = subscriptions.where("kind = 'channel'").select(F.col("name").alias("channel")).distinct()
    return (rows if pattern is None else rows.where(glob_match(F.col("channel"), pattern))).orderBy("channel")


def numsub(subscriptions: DataFrame, requests: DataFrame) -> DataFrame:
    """PUBSUB NUMSUB: subscribers of each requested channel."""
    n = subscriptions.where("kind = 'channel'").groupBy(F.col("name").alias("channel")).agg(F.countDistinct("session").alias("numsub"))
    return requests.join(n, "channel", "left").withColumn("numsub", F.coalesce("numsub", F.lit(0)))


def numpat(subscriptions: DataFrame) -> DataFrame:
    """PUBSUB NUMPAT: different patterns."""
    return subscriptions.where("kind = 'pattern'").agg(F.countDistinct("name").alias("numpat"))
