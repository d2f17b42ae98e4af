"""Steps whose work has to grow with the input and no faster, and rows that only larger tables have."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from keyloom import queries
from keyloom.functions import scalars
from keyloom.operators import geo, pubsub, strings

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("frames", "size"), [(3, 10**6), (10**4, 12), (4, 9), (1, 0), (0, 5)])
def test_heads_of_channels_close_the_same_sessions(spark, frames, size):
    rng = random.Random(frames)
    sent = [(i, rng.choice("abcd"), "x" * rng.randint(0, 3)) for i in range(60)]
    messages = spark.createDataFrame(sent, "id long, channel string, payload string")
    names = {(f"s{rng.randint(0, 9)}", *rng.choice([("channel", "a"), ("channel", "b"), ("channel", "c"), ("pattern", "[ad]"), ("pattern", "*")])) for _ in range(25)}
    subscriptions = spark.createDataFrame(sorted(names), "session string, kind string, name string")
    out, closed = pubsub.limited(pubsub.deliveries(pubsub.heads(messages, "id", frames + 1), subscriptions, ["[ad]", "*"]), "id", frames, size)
    match = {"a": "a", "b": "b", "c": "c", "[ad]": "ad", "*": "abcd"}
    want, ends = [], {}
    for session in {s for s, _, _ in names}:
        n = total = 0
        for i, channel, payload in sent:
            for _ in [name for s, _, name in names if s == session and channel in match[name]]:
                n, total = n + 1, total + len(payload)
                if n <= frames and total <= size:
                    want.append((session, i))
                else:
                    ends.setdefault(session, i)
    assert sorted((r["session"], r["id"]) for r in out.collect()) == sorted(want)
    assert {r["session"]: r["closed_at"] for r in closed.collect()} == ends


@pytest.mark.parametrize("name", ["pubsub_backpressure", "pubsub_closed_sessions"])
def test_channels_are_not_sent_whole_to_each_session(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert "WindowGroupLimit [channel" in plan and "WindowGroupLimit [session" in plan


def of_duckdb(name, path, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return con.execute(queries.ORACLE[name])


def test_streams_of_any_length_are_trimmed(spark, tmp_path):
    """More rows to trim than the 10,000 that XTRIM takes at once unless it is told otherwise."""
    rows = spark.range(10_400).selectExpr("id AS event_id", "timestamp_millis(1704067200000 + id * 7) AS ts", "id % 9 AS user_id", "'click' AS event_type")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["stream_xtrim_approx"](spark, str(tmp_path)).select("key", "ms", "seq", "event_id", "user_id")
    assert sorted(map(tuple, got.collect())) == sorted(of_duckdb("stream_xtrim_approx", tmp_path, "events").fetchall())


def test_points_of_one_cell_are_searched_by_several_tasks(spark):
    rows = spark.range(4000).select(F.lit("k").alias("key"), F.col("id").alias("member"), (F.col("id") % 100 / 1000 + 15).alias("lon"), (F.col("id") / 40000 + 38).alias("lat"))
    centres = spark.createDataFrame([("k", "c", 15.0, 38.0), ("other", "d", 15.0, 38.0)], "key string, centre string, lon double, lat double")
    for key in ("key", F.concat("key", F.lit("")).alias("key")):
        found = geo.geosearch(geo.geoadd(rows.select(key, "member", "lon", "lat")), centres, radius=1000, unit="km")
        assert found.select("member").distinct().count() == found.count() == 4000
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_score_text_fits_generated_code_and_reads_back(spark):
    values = spark.createDataFrame([(0.001,), (-0.002,), (9999.5,), (10000.25,), (1234567.12345678,), (1.5e-9,), (-2.5e30,)], "x double").select("x", scalars.score_text(F.col("x")).alias("t"))
    assert values._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 3
    got = dict(map(tuple, values.collect()))
    assert all(float(t) == x for x, t in got.items()) and got[-0.002] == "-0.002" and got[-2.5e30] == "-2.5e+30"


def test_lcs_length_splits_its_texts_once(spark):
    rows = [("ab" * 31, "ba" * 31, 61), ("ab" * 32, "ba" * 32, 63), ("ab" * 40, "a", 1), ("abé", "é", 1), ("", "a", 0), (None, "a", None)]
    found = spark.createDataFrame(rows, "a string, b string, n int").select(scalars.lcs_length(F.col("a"), F.col("b")).alias("got"), "n")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    assert all(r["got"] == r["n"] for r in found.collect())


def test_equal_pairs_are_searched_once_a_batch(spark):
    """100,000 pairs of 400 characters; one by one they would take minutes."""
    began = time.monotonic()
    pairs = spark.range(100_000).select(F.repeat(F.lit("abcd"), 100).alias("a"), F.repeat(F.lit("dbca"), 100).alias("b"))
    assert strings.lcs(pairs).select("lcs", "length").distinct().count() == 1
    assert time.monotonic() - began < 30
