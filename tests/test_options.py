"""Options of commands, against plain code and known replies."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import geohash as gh
from keyloom.operators import bitmaps, geo, streams, strings
from keyloom.operators.strings import _lcs


def metres(x1, y1, x2, y2):
    from math import asin, cos, radians, sin, sqrt

    u, v = sin(radians(y2 - y1) / 2), sin(radians(x2 - x1) / 2)
    return 2 * gh.EARTH_RADIUS * asin(min(1.0, sqrt(u * u + cos(radians(y1)) * cos(radians(y2)) * v * v)))


@pytest.mark.parametrize("shape", [(50_000.0, None), (900_000.0, None), (7_000_000.0, None), (0.0, None), (None, (400_000.0, 2_000_000.0)), (None, (9_000_000.0, 300_000.0))])
def test_geosearch_is_brute_force_at_poles_and_the_date_line(spark, shape):
    """Cells of longitude lose nothing: points all over, many close to a pole or to 180 degrees, centres among them."""
    radius, box = shape
    rng = random.Random(3)
    at = [(rng.uniform(-180, 180), rng.uniform(-85, 85)) for _ in range(250)]
    at += [(rng.choice((-1, 1)) * rng.uniform(178, 180), rng.uniform(-85, 85)) for _ in range(80)]
    at += [(rng.uniform(-180, 180), rng.choice((-1, 1)) * rng.uniform(83, 85.05)) for _ in range(80)] + [(180.0, 0.0), (-180.0, 0.0)]
    points = geo.geoadd(spark.createDataFrame([("k", i, x, y) for i, (x, y) in enumerate(at)], "key string, member long, lon double, lat double"))
    cells = {r["member"]: (r["lon"], r["lat"]) for r in geo.geopos(points).collect()}
    asked = [i for i in range(len(at)) if i % 9 == 0 or i >= len(at) - 2]
    centres = spark.createDataFrame([("k", i, i) for i in asked], "key string, centre long, member long")
    got = {(r["centre"], r["member"]) for r in geo.geosearch(points, centres, radius=radius, box=box).collect()}
    want = set()
    for c in asked:
        cx, cy = cells[c]
        for m, (x, y) in cells.items():
            inside = metres(cx, cy, x, y) <= radius if box is None else metres(cx, y, x, y) <= box[0] / 2 and metres(x, cy, x, y) <= box[1] / 2
            if inside:
                want.add((c, m))
    assert got == want


def test_geosearch_errors(spark):
    points = geo.geoadd(spark.createDataFrame([("k", "a", 1.0, 1.0)], "key string, member string, lon double, lat double"))
    lost = spark.createDataFrame([("k", 1, "no")], "key string, centre int, member string")
    with pytest.raises(Exception, match="could not decode requested zset member"):
        geo.geosearch(points, lost, radius=1).collect()
    assert geo.geosearch(points, lost.withColumn("key", F.lit("other")), radius=1).count() == 0
    for options in ({}, {"radius": -1}, {"radius": 1, "count": 0}, {"radius": 1, "any_": True}):
        with pytest.raises(ValueError):
            geo.geosearch(points, lost, **options)


def test_few_points_meet_a_centre(spark):
    """A search of a city in 20,000 points over the earth compares it with its neighbourhood alone."""
    grid = spark.range(20_000).select(F.lit("k").alias("key"), F.col("id").alias("member"), (F.col("id") % 200 * 1.8 - 179).alias("lon"), (F.floor(F.col("id") / 200) * 1.6 - 79).alias("lat"))
    centre = spark.createDataFrame([("k", 0, 10.0, 50.0)], "key string, centre int, lon double, lat double")
    points = geo.geoadd(grid).cache()
    near = geo.geosearch(points, centre, radius=400, unit="km")
    joined = near._jdf.queryExecution().optimizedPlan().toString()
    assert "cell" in joined and near.count() > 0
    all_round = geo.geosearch(points, centre, radius=400, unit="km").select("member").count()
    assert all_round < 60


def subsequence(x, y):
    table = [[""] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            up, left = table[i][j + 1], table[i + 1][j]
            table[i + 1][j + 1] = table[i][j] + a if a == b else up if len(up) > len(left) else left
    return table[-1][-1]


def test_lcs_and_its_ranges(spark):
    rng = random.Random(4)
    for _ in range(300):
        x, y = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        text, n, ranges = _lcs(x, y)
        assert text == subsequence(x, y) and n == len(text) == sum(r[4] for r in ranges)
        assert "".join(x[a : b + 1] for a, b, *_ in reversed(ranges)) == text
        assert all(x[a : b + 1] == y[c : d + 1] and b - a + 1 == k for a, b, c, d, k in ranges)
    frame = spark.createDataFrame([("ohmytext", "mynewtext")], "a string, b string")
    row = strings.lcs(frame, idx=True).first()
    assert (row["lcs"], row["length"], [tuple(m) for m in row["matches"]]) == ("mytext", 6, [(4, 7, 5, 8, 4), (2, 3, 0, 1, 2)])
    assert [tuple(m) for m in strings.lcs(frame, idx=True, min_match_len=4).first()["matches"]] == [(4, 7, 5, 8, 4)]
    assert strings.lcs(frame).columns == ["a", "b", "lcs", "length"]


def test_bit_ranges(spark):
    rng = random.Random(5)
    for _ in range(12):
        raw = bytes(rng.choice((0, 255, rng.randrange(256))) for _ in range(rng.randint(0, 5)))
        bits = "".join(f"{b:08b}" for b in raw)
        frame = spark.createDataFrame([(bytearray(raw),)], "v binary")
        asked, want = [], []
        for _ in range(12):
            start, end, unit, on = rng.randint(-50, 50), rng.choice((None, rng.randint(-50, 50))), rng.choice(("BYTE", "BIT")), rng.random() < 0.5
            width = 8 if unit == "BYTE" else 1
            n = len(bits) // width
            first, last = max(start + n if start < 0 else start, 0), min(n - 1 if end is None else max(end + n if end < 0 else end, 0), n - 1)
            own = bits[first * width : (last + 1) * width] if first <= last else ""
            asked.append(bitmaps.bitcount_bytes(F.col("v"), start, end, unit))
            want.append(0 if end is not None and 0 > start > end else own.count("1"))
            asked.append(bitmaps.bitpos_bytes(F.col("v"), on, start, end, unit))
            at = own.find("1" if on else "0")
            want.append(first * width + at if at >= 0 else len(bits) if not on and end is None and first <= last else -1)
        assert list(frame.select(*[c.alias(f"r{i}") for i, c in enumerate(asked)]).first()) == want


def test_float_sums(spark):
    rows = [("a", "0.1"), ("a", "0.2"), ("b", "1e25"), ("b", "1"), ("c", "-3.0"), ("d", "5e3")]
    got = dict(strings.incrbyfloat(spark.createDataFrame(rows, "key string, delta string")).collect())
    assert got["a"] == "0.3" and got["c"] == "-3" and got["d"] == "5000" and float(got["b"]) == 1e25


def test_stream_ids(spark):
    top = (1 << 64) - 1
    frame = spark.createDataFrame([("5", 7), (f"5-{top}", 3), ("9-1", 3)], "last string, now long")
    nxt = frame.select(streams.whole_id(F.col("last")).alias("i"), "now").select(streams.next_id(F.col("i.ms"), F.col("i.seq"), F.col("now")).alias("n")).collect()
    assert [(int(r["n"]["ms"]), int(r["n"]["seq"])) for r in nxt] == [(7, 0), (6, 0), (9, 2)]
    full = spark.createDataFrame([(f"{top}-{top}",)], "last string").select(streams.whole_id(F.col("last")).alias("i"))
    with pytest.raises(Exception, match="exhausted the last possible ID"):
        full.select(streams.next_id(F.col("i.ms"), F.col("i.seq"), F.lit(1))).collect()
    for bad in ("x", "1-", "1-2-3x", str(1 << 64)):
        with pytest.raises(Exception, match="Invalid stream ID"):
            spark.createDataFrame([(bad,)], "t string").select(streams.whole_id(F.col("t"))).collect()


@pytest.mark.parametrize(("maxlen", "node", "limit", "left"), [(0, 4, 0, 0), (0, 4, 5, 6), (3, 4, 0, 6), (1, 4, 0, 2), (3, 4, 3, 10), (20, 4, 0, 10)])
def test_trimming_by_nodes(spark, maxlen, node, limit, left):
    rows = spark.createDataFrame([("k", i, 0) for i in range(10)], "key string, ms long, seq long")
    assert sorted(r["ms"] for r in streams.xtrim_maxlen(rows, maxlen, node, limit).collect()) == list(range(10 - left, 10))
    with pytest.raises(ValueError, match="LIMIT"):
        streams.xtrim_maxlen(rows, 3, limit=2)


def test_entries_read_step_by_step(spark):
    """XREADGROUP's counter against delivering entry by entry, with deletions before, within and behind what is delivered."""
    rng = random.Random(6)
    cases, want = [], []
    for k in range(60):
        ids = sorted(rng.sample(range(1, 30), rng.randint(1, 8)))
        gone = rng.choice([None, rng.randint(1, 30)])
        live = [i for i in ids if i != gone] or [31]
        added, top = len(live) + (gone is not None), max(live + [gone or 0])
        cursor, known, count = rng.choice([0, rng.choice(live)]), rng.choice([None, 0, rng.randint(0, 5)]), rng.randint(1, 5)
        deleted = gone or 0

        def estimate(i, live=live, added=added, top=top, deleted=deleted):
            if i == top:
                return added
            if i > top:
                return None
            if deleted < live[0]:
                return added - len(live) + (i == live[0]) if i <= live[0] else None
            return None

        read = known
        for i in [x for x in live if x > cursor][:count]:
            read = read + 1 if read is not None and deleted < i else estimate(i)
        cases.append((f"k{k}", live, cursor, known, count, gone, added, top))
        want.append(read)
    for count in range(1, 6):
        own = [(c, w) for c, w in zip(cases, want, strict=True) if c[4] == count]
        x = spark.createDataFrame([(c[0], i, 0) for c, _ in own for i in c[1]], "key string, ms long, seq long")
        groups = spark.createDataFrame([(c[0], "g", c[2], 0, c[3]) for c, _ in own], "key string, `group` string, last_ms long, last_seq long, entries_read long")
        pair = lambda i: None if i is None else (i, 0)
        meta = spark.createDataFrame([(c[0], len(c[1]), c[6], pair(c[7]), pair(c[1][0]), pair(c[5])) for c, _ in own], "key string, length long, entries_added long, top struct<ms:long,seq:long>, first struct<ms:long,seq:long>, max_deleted struct<ms:long,seq:long>")
        pel = spark.createDataFrame([], "key string, `group` string, ms long, seq long, consumer string, delivery_ms long, deliveries long")
        got = {r["key"]: r["entries_read"] for r in streams.xreadgroup(x, groups, pel, "c", 1, count, meta=meta)[1].collect()}
        assert got == {c[0]: w for c, w in own}
