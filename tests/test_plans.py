import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyloom.plans import admin, fold, scripts, transactions
from keyloom.sources import rdb, resp


def log(spark, *lines):
    return fold.parse_lines(spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "seq long, ts_ms long, line string"))


def test_fold(spark):
    state = fold.fold(log(spark, "SET a 1", "INCRBY a 41", "SETNX a 9", "SET b x PX 5", "ZADD z 1 m", "ZADD z GT 0 m", "ZADD z NX 5 m", "ZADD z INCR 2 m", "RPUSH l 1 2 3", "LPUSH l 0", "LPOP l", "HSET h f 1 g 2", "HDEL h f g", "SADD s q", "EXPIRE s 100", "SET s text KEEPTTL"), 1000).collect()
    by = {(r["key"], r["element"], r["pos"]): r["value"] if r["score"] is None else r["score"] for r in state}
    assert by == {("a", None, None): "42", ("z", "m", None): 3.0, ("l", None, 0): "1", ("l", None, 1): "2", ("l", None, 2): "3", ("s", None, None): "text"}
    assert {r["key"]: r["expire_at_ms"] for r in state if r["key"] == "s"} == {"s": 14 + 100_000}


def test_errors_stand_alone(spark):
    bad = fold.errors(log(spark, "SET a 9223372036854775807", "INCRBY a 1", "SADD a x", "NOPE a")).collect()
    assert sorted(r["seq"] for r in bad) == [1, 2, 3]


def test_store_and_transaction(spark, tmp_path):
    store = transactions.Store(spark, f"file://{tmp_path}/store")
    keys = spark.createDataFrame([("a", 1), ("b", 1)], "key string, version long")
    assert store.version() == 0 and store.save({"keys": keys}) == 1 and store.save({"keys": keys.limit(1)}) == 2
    assert store.load("keys").count() == 1 and store.load("keys", 1).count() == 2 and store.lastsave() > 0
    drop = lambda frames: (frames | {"keys": frames["keys"].where("key <> 'a'")}, 1)
    t = transactions.Transaction({"keys": keys})
    t.watch("a")
    t.multi(drop)
    t.multi(lambda frames: 1 / 0)
    after, replies = t.exec()
    assert after["keys"].count() == 1 and replies[0] == 1 and isinstance(replies[1], ZeroDivisionError)
    t = transactions.Transaction({"keys": keys})
    t.watch("a", "missing")
    t.multi(drop)
    assert t.exec({"keys": keys.withColumn("version", F.lit(2).cast("long"))})[1] is None
    assert transactions.due([(60, 100), (3600, 1)], 5, 0, 4000) and not transactions.due([(60, 100)], 5, 0, 4000)


def test_scripts(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "key string, n long")
    source = "def total(pdf, args):\n    return pd.DataFrame({'key': [pdf['key'].iloc[0]], 'n': [int(pdf['n'].sum()) * int(args[0])]})\n"
    r = scripts.Registry()
    sha = r.script_load(source, "key string, n long", "total")
    assert r.script_exists(sha, "0" * 40) == [1, 0]
    assert {x["key"]: x["n"] for x in r.evalsha(sha, frame, ["a"], ["10"]).collect()} == {"a": 30}
    r.function_load("lib", [scripts.Function("total", source, "key string, n long", ["no-writes"])])
    assert {x["key"]: x["n"] for x in r.fcall("total", frame, None, ["1"], read_only=True).collect()} == {"a": 3, "b": 5}
    other = scripts.Registry()
    other.function_restore(r.function_dump())
    assert other.function_list("l*") == [("lib", ["total"])]
    with pytest.raises(ValueError):
        other.function_restore(r.function_dump())
    r.script_flush()
    with pytest.raises(ValueError, match="NOSCRIPT"):
        r.evalsha(sha, frame)


def test_admin(spark):
    assert admin.commands(spark).where("name = 'zrange'").count() == 1
    assert admin.config_get(spark, "spark.sql.shuffle.*").first()["value"] == "8"
    slow = admin.SlowLog(0)
    slow.run("count", lambda: spark.range(3).count())
    assert slow.len() == 1 and slow.get(spark).first()["command"] == "count" and slow.latency(spark).count() == 1


def test_command_log_round_trip(spark, tmp_path):
    rows = [(0, "k1", "SET", ["välue\r\nx"]), (1, "k2", "RPUSH", ["a", ""]), (2, "k1", "DEL", [])]
    resp.write_log(spark.createDataFrame(rows, "seq long, key string, cmd string, args array<string>"), f"file://{tmp_path}/log")
    back = resp.read_log(spark, f"file://{tmp_path}/log/*.txt").orderBy("file", "seq").collect()
    assert sorted((r["key"], r["cmd"], tuple(r["args"])) for r in back) == sorted((k, c, tuple(a)) for _, k, c, a in rows)
    assert list(resp.parse(b"PING\r\n*2\r\n$3\r\nGET\r\n$1\r\na\r\n*2\r\n$3\r\nGE")) == [[b"PING"], [b"GET", b"a"]]


def test_snapshot_round_trip(spark, tmp_path):
    rows = [(0, "s", "string", 123, None, "v" * 70, None, None), (0, "l", "list", None, None, "a", None, 0), (0, "l", "list", None, None, "b", None, 1), (3, "h", "hash", None, "f", "1", None, None), (3, "z", "zset", None, "m", None, 1.5, None), (3, "t", "set", None, "q", None, None, None)]
    out = rdb.export(spark.createDataFrame(rows, rdb.ROWS)).orderBy("db", "key").collect()
    (tmp_path / "x.rdb").write_bytes(rdb.file_of((r["db"], r["body"]) for r in out))
    back = rdb.read_rdb(spark, f"file://{tmp_path}/x.rdb").collect()
    assert sorted(map(str, map(tuple, back))) == sorted(map(str, rows))


def test_packed_encodings():
    assert rdb.lzf(bytes([2]) + b"abc" + bytes([0x20 | 0, 2]) + bytes([0]) + b"x", 7) == b"abcabcx"
    assert rdb.listpack(b"\0" * 6 + b"\x05\x01" + b"\x83abc\x04" + b"\xf1\xff\xff\x03" + b"\xff") == [b"5", b"abc", b"-1"]
    assert rdb.ziplist(b"\0" * 10 + b"\x00\x02hi" + b"\x04\xf3" + b"\x02\xc0\xfe\xff" + b"\xff") == [b"hi", b"2", b"-2"]
    assert rdb.intset(b"\x02\0\0\0\x02\0\0\0\x01\x00\xff\xff") == [b"1", b"-1"]
    with pytest.raises(ValueError, match="not supported"):
        list(rdb.parse(b"REDIS0011" + b"\x07\x01k"))


def test_live_rows(spark):
    state = spark.createDataFrame(pd.DataFrame({"key": ["a"], "expire_at_ms": [5]}))
    assert fold.live_rows(state, 5).count() == 0 and fold.live_rows(state, 4).count() == 1


STREAM = [
    (0, "x", "stream", 99, "5-1", '["a", "1", "b", "ü"]', None, 0),
    (0, "x", "stream", 99, "5-7", '["a", "' + "v" * 5000 + '"]', None, 1),
    (0, "x", "stream", 99, "1700000000000-0", "[]", None, 2),
    (0, "x", "stream_meta", 99, None, '{"length": 3, "last": "1700000000000-3", "first": "5-1", "max_deleted": "4-0", "entries_added": 9}', None, None),
    (0, "x", "stream_group", 99, "g", '{"last": "5-7", "entries_read": null}', None, None),
    (0, "x", "stream_group", 99, "h", '{"last": "5-1", "entries_read": 70000}', None, None),
    (0, "x", "stream_consumer", 99, "c", '{"group": "g", "seen_ms": 7, "active_ms": 6}', None, None),
    (0, "x", "stream_pending", 99, "5-1", '{"group": "g", "delivery_ms": 3, "deliveries": 2, "consumer": "c"}', None, None),
]


def test_streams_in_snapshots(spark, tmp_path):
    frame = spark.createDataFrame([*STREAM, *[(1, "y", "stream", None, f"{i}-0", f'["n", "{i}"]', None, i - 1) for i in range(1, 251)]], rdb.ROWS)
    whole = rdb.file_of((r["db"], r["body"]) for r in rdb.export(frame).orderBy("db", "key").collect())
    (tmp_path / "x.rdb").write_bytes(whole)
    back = rdb.read_rdb(spark, f"file://{tmp_path}/x.rdb")
    assert sorted(map(str, map(tuple, back.where("key = 'x'").collect()))) == sorted(map(str, STREAM))
    assert back.where("key = 'y' and type = 'stream'").count() == 250
    with pytest.raises(ValueError, match="checksum"):
        list(rdb.parse(whole[:40] + bytes([whole[40] ^ 1]) + whole[41:]))


def test_stream_nodes_of_other_writers():
    """A master entry with fields, an entry that shares them, one deleted, one with its own; version 1 without counters."""
    item = rdb._item
    parts = [2, 1, 2, "f", "g", 0, 2, 0, 0, "1", "2", 5, 3, 1, 0, "3", "4", 5, 0, 2, 4, 1, "h", "5", 6]
    body = b"".join(map(item, parts))
    node = (len(body) + 7).to_bytes(4, "little") + len(parts).to_bytes(2, "little") + body + b"\xff"
    key = (9).to_bytes(8, "big") + (1).to_bytes(8, "big")
    raw = b"\x01" + rdb._bytes(key) + rdb._bytes(node) + bytes([2, 11, 5, 0])
    rows = rdb._stream(rdb._Input(raw), rdb.STREAM)
    assert rows[:2] == [("stream", "9-1", '["f", "1", "g", "2"]', 0), ("stream", "11-5", '["h", "5"]', 1)]
    assert '"entries_added": 2' in rows[2][2]


def test_crc64():
    assert rdb.crc64(b"123456789") == 0xE9C6D914C4B8D9CA and rdb.crc64(b"") == 0
    raw = bytes(range(256)) * 41
    assert len({rdb.crc64(raw, lanes) for lanes in (1, 7, 2048)}) == 1


def test_dump_and_restore(spark):
    rows = spark.createDataFrame([(0, "s", "string", 5, None, "v" * 300, None, None), (0, "z", "zset", None, "m", None, 1.5, None), (0, "l", "list", None, None, "a", None, 0), (0, "l", "list", None, None, "b", None, 1), *STREAM], rdb.ROWS)
    dumped = rdb.dump(rows).cache()
    same = lambda df: sorted(map(str, df.drop("expire_at_ms").collect()))
    with_ttl = dumped.withColumn("ttl", F.when(F.col("key") == "s", 50).otherwise(0).cast("long"))
    back = rdb.restore(with_ttl, 1000)
    assert same(back) == same(rows)
    assert {r["key"]: r["expire_at_ms"] for r in back.collect()} == {"s": 1050, "z": None, "l": None, "x": None}
    assert {r["key"] for r in rdb.restore(with_ttl, 1000, absttl=True).collect()} == {"z", "l", "x"}
    with pytest.raises(Exception, match="BUSYKEY"):
        rdb.restore(with_ttl, 1000, rows.where("key = 'z'")).collect()
    assert rdb.restore(with_ttl, 1000, rows, replace=True).count() == rows.count()
    with pytest.raises(Exception, match="checksum are wrong"):
        rdb.restore(with_ttl.withColumn("payload", F.concat(F.col("payload"), F.lit(b"x"))), 1000).collect()


def test_keys_of_commands(spark):
    cases = [
        ("get", "a", [], ["a"]),
        ("MSET", "a", ["1", "b", "2"], ["a", "b"]),
        ("DEL", "a", ["b", "c"], ["a", "b", "c"]),
        ("BITOP", "AND", ["d", "a", "b"], ["d", "a", "b"]),
        ("BLPOP", "a", ["b", "0"], ["a", "b"]),
        ("RENAME", "a", ["b"], ["a", "b"]),
        ("ZUNIONSTORE", "d", ["2", "a", "b", "WEIGHTS", "1", "2"], ["d", "a", "b"]),
        ("ZINTER", "2", ["a", "b", "WITHSCORES"], ["a", "b"]),
        ("EVAL", "return 1", ["1", "k", "arg"], ["k"]),
        ("XREAD", "COUNT", ["2", "streams", "a", "b", "0", "0"], ["a", "b"]),
        ("SORT", "a", ["BY", "w_*", "store", "d"], ["a", "d"]),
        ("GEORADIUS", "g", ["1", "1", "1", "m", "STOREDIST", "d"], ["g", "d"]),
        ("XGROUP", "CREATE", ["s", "g", "$"], ["s"]),
        ("PING", None, None, []),
        ("ZUNION", "x", ["a"], []),
    ]
    log = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "seq int, cmd string, key string, args array<string>")
    assert {r["seq"]: r["keys"] for r in admin.getkeys(log).collect()} == {i: c[3] for i, c in enumerate(cases)}


def test_changes_and_metrics(spark, tmp_path):
    store = transactions.Store(spark, f"file://{tmp_path}/feed")
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "key string, value string")
    new = spark.createDataFrame([("a", "9"), ("b", "2")], "key string, value string")
    store.save({"strings": old})
    store.save({"strings": new})
    assert sorted(tuple(r) for r in store.changes("strings", 1).collect()) == [("a", "1", "-"), ("a", "9", "+"), ("b", "2", "-")]
    keys = spark.createDataFrame([(0, "a", None), (0, "b", 5), (2, "c", None)], "db int, key string, expire_at_ms long")
    lines = {r["line"] for r in admin.metrics({"keys": keys, "strings": new}).collect()}
    assert lines == {'keyloom_rows{table="keys"} 3', 'keyloom_rows{table="strings"} 2', 'keyloom_keys{db="0"} 2', 'keyloom_keys{db="2"} 1', 'keyloom_expires{db="0"} 1', 'keyloom_expires{db="2"} 0'}
    assert admin.ping() == "PONG" and admin.ping("x") == "x" and admin.wait(1, 5) == 0


def test_lset_range(spark):
    from keyloom.operators import lists

    frame = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 5, "z")], "key string, pos long, value string")
    assert sorted(map(tuple, lists.lset(frame, -1, "new").collect())) == [("a", 0, "x"), ("a", 1, "new"), ("b", 5, "new")]
    with pytest.raises(Exception, match="index out of range"):
        lists.lset(frame, 1, "new").collect()
