"""Cases with known replies, beside the queries over tables."""

import pytest
from pyspark.sql import functions as F

from keyloom.operators import bitmaps, generic, lists, sorting, streams, ttl, zsets


def scores(df):
    return {r["member"]: r["score"] for r in df.collect()}


def zset(spark, **members):
    return spark.createDataFrame(list(members.items()), "member string, score double") if members else spark.createDataFrame([], "member string, score double")


def test_weighted_algebra(spark):
    a, b = zset(spark, a=1.0, b=2.0, c=3.0), zset(spark, b=1.0, c=2.0, d=3.0)
    assert scores(zsets.zunion([a, b])) == {"a": 1, "b": 3, "d": 3, "c": 5}
    assert scores(zsets.zunion([a, b], [2, 3])) == {"a": 2, "b": 7, "d": 9, "c": 12}
    assert scores(zsets.zinter([a, b], [2, 3])) == {"b": 7, "c": 12}
    assert scores(zsets.zunion([a.select("member"), b], [2, 3])) == {"a": 2, "b": 5, "c": 8, "d": 9}
    assert scores(zsets.zinter([a, b], None, "MAX")) == {"b": 2, "c": 3}


def test_opposite_infinities_are_zero(spark):
    a, b = zset(spark, x=float("inf")), zset(spark, x=float("-inf"))
    assert scores(zsets.zunion([a, b])) == {"x": 0.0}
    assert scores(zsets.zinter([a, b])) == {"x": 0.0}
    assert scores(zsets.zunion([a], [0.0])) == {"x": 0.0}


def test_zrange_limits(spark):
    z = spark.createDataFrame([("k", m, float(s)) for m, s in zip("abcdefg", range(7), strict=True)], "key string, member string, score double")
    names = lambda df: "".join(r["member"] for r in df.orderBy("pos").collect())
    assert names(zsets.zrangebyscore(z, 1, 5, 1, 2)) == "cd"
    assert names(zsets.zrangebyscore(z, 1, 5, -1, 2)) == ""
    assert names(zsets.zrangebyscore(z, 1, 5, 2, -1)) == "def"
    assert names(zsets.zrevrangebyscore(z, "(5", "-inf", 0, 3)) == "edc"
    for start, stop in ((0, -1), (-3, 1), (2, -2), (-2, -1), (5, 2), (-100, 100), (-3, -2)):
        got = [r["member"] for r in zsets.zrange(z, start, stop).orderBy("rank").collect()]
        lo, hi = (start if start >= 0 else max(7 + start, 0)), (stop if stop >= 0 else 7 + stop)
        assert got == list("abcdefg")[lo : hi + 1], (start, stop)


def test_zadd_flags(spark):
    z = spark.createDataFrame([("k", "a", 1.0)], "key string, member string, score double")
    new = spark.createDataFrame([("k", "a", 5.0), ("k", "b", 2.0)], "key string, member string, score double")
    assert scores(zsets.zadd_to(z, new, nx=True)[0]) == {"a": 1, "b": 2}
    assert scores(zsets.zadd_to(z, new, xx=True)[0]) == {"a": 5}
    assert scores(zsets.zadd_to(z, new, lt=True)[0]) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        zsets.zadd_to(z, new, nx=True, gt=True)


def elements(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "element string")


def test_sort(spark):
    got = lambda df, c="get0": [r[c] for r in df.orderBy("place").collect()]
    numbers = elements(spark, "3", "10", "2", "1")
    assert got(sorting.sort(numbers)) == ["1", "2", "3", "10"]
    assert got(sorting.sort(numbers, alpha=True, descending=True, offset=1, count=2)) == ["2", "10"]
    strings = spark.createDataFrame([("weight_a", "2"), ("weight_b", "1"), ("weight_c", "3"), ("label_a", "A"), ("label_b", "B")], "key string, value string")
    out = sorting.sort(elements(spark, "a", "b", "c"), by="weight_*", get=("#", "label_*"), strings=strings)
    assert [(r["get0"], r["get1"]) for r in out.orderBy("place").collect()] == [("b", "B"), ("a", "A"), ("c", None)]
    hashes = spark.createDataFrame([("object_a", "weight", "20"), ("object_b", "weight", "10"), ("object_a", "label", "hash-a"), ("object_b", "label", "hash-b")], "key string, field string, value string")
    out = sorting.sort(elements(spark, "a", "b", "c"), by="object_*->weight", get=("#", "object_*->label"), hashes=hashes)
    assert [(r["get0"], r["get1"]) for r in out.orderBy("place").collect()] == [("c", None), ("b", "hash-b"), ("a", "hash-a")]
    with pytest.raises(Exception, match="converted into double"):
        sorting.sort(elements(spark, "1", "not-a-double"), count=1).collect()


def a_list(spark, text, key="k"):
    return spark.createDataFrame([(key, i, c) for i, c in enumerate(text)], "key string, pos long, value string")


def test_lists(spark):
    xs = a_list(spark, "abcdefcc")  # c at 2, 6 and 7
    idx = lambda df: sorted(r["idx"] for r in df.collect())
    assert [idx(lists.lpos(xs, "c", rank=r)) for r in (1, 2, -1, -2)] == [[2], [6], [7], [6]]
    assert idx(lists.lpos(xs, "c", count=0)) == [2, 6, 7]
    assert idx(lists.lpos(xs, "c", count=0, maxlen=7)) == [2, 6]
    text = lambda df: "".join(r["value"] for r in df.orderBy("pos").collect())
    assert text(lists.lrem(xs, 1, "c")) == "abdefcc" and text(lists.lrem(xs, -2, "c")) == "abcdef" and text(lists.lrem(xs, 0, "c")) == "abdef"
    assert text(lists.linsert(xs, "c", "X", after=True)) == "abcXdefcc"
    new = spark.createDataFrame([("k", 0, "1"), ("k", 1, "2"), ("new", 0, "3")], "key string, seq int, value string")
    assert text(lists.push(xs, new, left=True).where("key = 'k'")) == "21abcdefcc"
    assert lists.push(xs, new, only_if_exists=True).where("key = 'new'").count() == 0
    moved = lists.lmove(xs.union(a_list(spark, "zz", "t")), "k", "t", from_left=False, to_left=True)
    assert text(moved.where("key = 't'")) == "czz" and text(moved.where("key = 'k'")) == "abcdefc"
    with pytest.raises(ValueError):
        lists.lpos(xs, "c", rank=0)


def test_bitfield():
    run = bitmaps._bitfield
    assert run(b"", [("SET", "u8", 0, 255), ("INCRBY", "u8", 0, 1), ("GET", "i8", 0)]) == ([0, 0, 0], b"\0")
    assert run(b"", [("OVERFLOW", "SAT"), ("INCRBY", "i4", 0, 100), ("OVERFLOW", "FAIL"), ("INCRBY", "i4", 0, 1)]) == ([7, None], b"\x70")
    assert run(b"\xff", [("GET", "u4", "#1"), ("GET", "i8", 0), ("GET", "u8", 4)])[0] == [15, -1, 240]


def test_expiry_conditions(spark):
    keys = spark.createDataFrame([("stay", None), ("soon", 100), ("late", 900)], "key string, expire_at_ms long")
    after = lambda c: {r["key"]: r["expire_at_ms"] for r in ttl.expire(keys, F.lit(500), c).collect()}
    assert after("GT") == {"stay": None, "soon": 500, "late": 900}
    assert after("LT") == {"stay": 500, "soon": 100, "late": 500}
    assert after("NX") == {"stay": 500, "soon": 100, "late": 900}
    asked = spark.createDataFrame([("stay",), ("soon",), ("late",), ("none",)], "key string")
    assert {r["key"]: r["pttl"] for r in ttl.pttl(keys, asked, 200).collect()} == {"stay": -1, "soon": -2, "late": 700, "none": -2}


def test_keys(spark):
    v = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    state = lambda df: {r["key"]: r["value"] for r in df.collect()}
    assert state(generic.rename(v, "a", "b")) == {"b": "1"}
    assert state(generic.rename(v, "a", "b", only_if_new=True)) == {"a": "1", "b": "2"}
    assert state(generic.rename(v, "a", "c", only_if_new=True)) == {"c": "1", "b": "2"}
    assert state(generic.copy(v, "a", "b")) == {"a": "1", "b": "2"}
    assert state(generic.copy(v, "a", "b", replace=True)) == {"a": "1", "b": "1"}
    new = spark.createDataFrame([("b", "x", 0), ("c", "y", 1), ("c", "z", 2)], "key string, value string, pos int")
    assert state(generic.mset(v, new)) == {"a": "1", "b": "x", "c": "z"}
    assert state(generic.mset(v, new, only_if_new=True)) == {"a": "1", "b": "2"}
    assert [r["value"] for r in generic.mget(v, ["b", "no", "a", "b"]).orderBy("pos").collect()] == ["2", None, "1", "2"]
    dumped = generic.dump(v, ["value"])
    assert state(generic.restore(dumped, "value:string")) == {"a": "1", "b": "2"}
    with pytest.raises(Exception, match="BUSYKEY"):
        generic.restore(dumped, "value:string", v).collect()
    with pytest.raises(Exception, match="checksum"):
        generic.restore(dumped.withColumn("checksum", F.lit(1)), "value:string").collect()


def entries(spark, *ids):
    return spark.createDataFrame([("s", ms, seq) for ms, seq in ids], "key string, ms long, seq long")


def test_stream_ranges(spark):
    x = entries(spark, (0, 1), (1, 0), (42, 0), (42, 42), (43, 5))
    ids = lambda df: [(r["ms"], r["seq"]) for r in df.orderBy("ms", "seq").collect()]
    assert ids(streams.xrange(x, "1", "42")) == [(1, 0), (42, 0), (42, 42)]
    assert ids(streams.xrange(x, "(42-0", "+")) == [(42, 42), (43, 5)]
    assert ids(streams.xrange(x, count=0)) == []
    assert ids(streams.xtrim_minid(x, "42-1")) == [(42, 42), (43, 5)]
    with pytest.raises(ValueError):
        streams.xrange(x, "(-")


def test_claims(spark):
    pel = spark.createDataFrame([("s", "g", 1, 0, "a", 100, 1), ("s", "g", 2, 0, "a", 900, 1), ("s", "g", 3, 0, "b", 100, 2)], "key string, group string, ms long, seq long, consumer string, delivery_ms long, deliveries long")
    x = entries(spark, (1, 0), (2, 0), (4, 0))
    ids = spark.createDataFrame([("s", "g", i, 0) for i in (1, 2, 3, 4)], "key string, group string, ms long, seq long")
    after = {r["ms"]: (r["consumer"], r["deliveries"]) for r in streams.xclaim(pel, ids, x, "me", 1000, 500, force=True).collect()}
    assert after == {1: ("me", 2), 2: ("a", 1), 4: ("me", 2)}
    auto = {r["ms"]: r["outcome"] for r in streams.xautoclaim(pel, x, 1000, 500).collect()}
    assert auto == {1: "claimed", 3: "deleted"}
    delivered, groups, pending = streams.xreadgroup(x, spark.createDataFrame([("s", "g", 2, 0, 2)], "key string, group string, last_ms long, last_seq long, entries_read long"), pel, "new", 1000)
    assert [r["ms"] for r in delivered.collect()] == [4] and groups.first()["last_ms"] == 4 and groups.first()["entries_read"] == 3 and pending.count() == 4
