"""Streams in several batches, with state carried between them."""

import time

from pyspark.sql import functions as F

from keyloom.streaming import processors


def run(spark, tmp_path, make, batches, schema, mode="append"):
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        time.sleep(0.05 * (i == 0))
        out = make(spark.readStream.schema(schema).parquet(f"file://{source}"))
        q = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return spark.read.parquet(f"file://{tmp_path}/out").collect()


def test_late_ids_are_dropped_across_batches(spark, tmp_path):
    got = run(spark, tmp_path, processors.xadd, [[("a", 5, 0, 1), ("a", 4, 0, 2), ("b", 1, 0, 3)], [("a", 5, 0, 4), ("a", 5, 1, 5), ("b", 0, 9, 6)]], "key string, ms long, seq long, arrival long")
    assert sorted(r["arrival"] for r in got) == [1, 3, 5]


def test_consumer_group(spark, tmp_path):
    schema = "key string, group string, arrival long, action string, ms long, seq long, consumer string, n long, now_ms long"
    add = lambda t, ms: ("s", "g", t, "add", ms, 0, None, 0, 0)
    first = [add(1, 1), add(2, 2), add(3, 3), ("s", "g", 4, "read", 0, 0, "c1", 2, 100), ("s", "g", 5, "ack", 1, 0, "c1", 0, 100)]
    second = [("s", "g", 6, "read", 0, 0, "c2", 5, 200), ("s", "g", 7, "claim", 50, 0, "c3", 5, 220)]
    got = run(spark, tmp_path, processors.consumer_groups, [first, second], schema)
    assert sorted((r["ms"], r["consumer"], r["deliveries"]) for r in got) == [(1, "c1", 1), (2, "c1", 1), (2, "c3", 2), (3, "c2", 1)]


def test_publish_and_windows(spark, tmp_path):
    subs = spark.createDataFrame([("s1", "channel", "x"), ("s2", "pattern", "x*")], "session string, kind string, name string")
    got = run(spark, tmp_path, lambda m: processors.publish(m, subs, ["x*"]).select("session", "payload"), [[("x", "p1"), ("xy", "p2"), ("z", "p3")]], "channel string, payload string")
    assert sorted(map(tuple, got)) == [("s1", "p1"), ("s2", "p1"), ("s2", "p2")]
    batch = spark.createDataFrame([("a", 0), ("a", 50), ("a", 4000)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r["n"] for r in processors.windowed_counts(batch, "ts", "k", "1 hour").collect()) == [1, 2]
    assert sorted(r["n"] for r in processors.sessions(batch, "ts", "k", "5 minutes").collect()) == [1, 2]


def test_waiters_are_served_in_line(spark):
    items = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, pos long, value string")
    waiters = spark.createDataFrame([("k", "w2", 20), ("k", "w1", 10), ("k", "w3", 30)], "key string, waiter string, since long")
    assert sorted((r["waiter"], r["value"]) for r in processors.serve_waiters(items, waiters).collect()) == [("w1", "a"), ("w2", "b")]


def test_waiters_across_batches(spark, tmp_path):
    """Two wait before anything is there, one gives up, one is let go, ends differ, and what is left waits for the next."""
    schema = "key string, arrival long, now_ms long, action string, value string, waiter string, until_ms long, left boolean"
    far = 1 << 45
    wait = lambda t, who, until=0, left=True: ("k", t, t, "wait", None, who, until, left)
    push = lambda t, value, left=False: ("k", t, t, "push", value, None, 0, left)
    first = [wait(1, "a"), wait(2, "b", far + 10), wait(3, "c"), ("k", 4, 4, "unblock", None, "c", 0, True), ("other", 5, 5, "wait", None, "o", 0, True)]
    second = [push(6, "one"), ("k", 7, far + 10, "push", "two", None, 0, False), ("k", 8, far + 11, "push", "three", None, 0, False)]
    third = [wait(9, "d", 0, False), wait(10, "e"), wait(11, "f")]
    got = run(spark, tmp_path, processors.blocking_pops, [first, second, third], schema)
    assert sorted((r["waiter"], str(r["value"]), r["outcome"]) for r in got) == [("a", "one", "served"), ("b", "None", "timeout"), ("c", "None", "unblocked"), ("d", "three", "served"), ("e", "two", "served")]
