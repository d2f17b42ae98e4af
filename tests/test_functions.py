import random

from pyspark.sql import functions as F

from keyloom.functions import scalars
from keyloom.functions.glob import glob_match, glob_regex
from keyloom.functions.keyslot import keyslot
from keyloom.operators import geo


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first())


def model(p: str, t: str) -> bool:
    """Glob by recursion, from the stated rules."""
    if not t:
        return not p

    def go(i: int, j: int) -> bool:
        if i == len(p):
            return j == len(t)
        if p[i] == "*":
            return any(go(i + 1, k) for k in range(j, len(t) + 1))
        if j == len(t):
            return False
        if p[i] == "?":
            return go(i + 1, j + 1)
        if p[i] == "[":
            k, no, hit = i + 1, False, False
            if k < len(p) and p[k] == "^":
                no, k = True, k + 1
            while k < len(p) and p[k] != "]":
                a, escaped = p[k], False
                if a == "\\" and k + 1 < len(p):
                    a, escaped, k = p[k + 1], True, k + 1
                k += 1
                if not escaped and k + 1 < len(p) and p[k] == "-":
                    lo, hi = sorted((a, p[k + 1]))
                    hit |= lo <= t[j] <= hi
                    k += 2
                else:
                    hit |= a == t[j]
            return hit != no and go(min(k + 1, len(p)), j + 1)
        if p[i] == "\\" and i + 1 < len(p):
            i += 1
        return p[i] == t[j] and go(i + 1, j + 1)

    return go(0, 0)


def test_glob_is_the_model(spark):
    rng = random.Random(3)
    patterns = ["*", "", "a*", "[a-c]", "[^a]b", "[a-", "[]", "[^]", "\\*", "a\\", "[b-]c]", "**b", "?*"] + ["".join(rng.choice("ab*?[]^-\\c") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    texts = ["", "a", "b", "ab", "abc", "*", "]", "-", "c]", "a\nb"] + ["".join(rng.choice("abc]-") for _ in range(rng.randint(1, 5))) for _ in range(30)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for begin in range(0, len(patterns), 40):
        some = patterns[begin : begin + 40]
        got = rows.select("t", *[glob_match(F.col("t"), p).alias(f"c{i}") for i, p in enumerate(some)]).collect()
        for r in got:
            for i, p in enumerate(some):
                assert r[f"c{i}"] == model(p, r["t"]), (p, r["t"], glob_regex(p))


def test_keyslot(spark):
    assert one(spark, *[keyslot(F.lit(x)) for x in ("foo", "123456789", "{user1000}.following", "{user1000}.followers", "")]) == (12182, 12739, 3443, 3443, 0)


def test_score_text(spark):
    cases = {3.0: "3", -0.0: "-0", 1e20: "1e+20", 1.5: "1.5", 12345678.5: "12345678.5", 0.001: "0.001", 1e-9: "1e-9", 1.5e-9: "1.5e-9", 1e300: "1e+300", float("inf"): "inf", float("-inf"): "-inf", float("nan"): "nan", -2.25: "-2.25", 123456.789: "123456.789"}
    assert one(spark, *[scalars.score_text(F.lit(x)) for x in cases]) == tuple(cases.values())


def test_getrange_and_setrange(spark):
    v = F.lit("Hello World")
    cases = {(0, 4): b"Hello", (-5, -1): b"World", (0, -1): b"Hello World", (5, 3): b"", (0, 1000): b"Hello World", (-100, 2): b"Hel", (-1, -5): b"", (20, 30): b""}
    assert tuple(map(bytes, one(spark, *[scalars.getrange(v, a, b) for a, b in cases]))) == tuple(cases.values())
    assert tuple(map(bytes, one(spark, scalars.setrange(F.lit("abc"), 5, F.lit("x")), scalars.setrange(F.lit(None).cast("string"), 2, F.lit("z")), scalars.setrange(F.lit("abc"), 1, F.lit("")), scalars.setrange(F.lit("abcdef"), 1, F.lit("XY"))))) == (b"abc\0\0x", b"\0\0z", b"abc", b"aXYdef")


def test_lcs(spark):
    from keyloom.operators import strings

    pairs = spark.createDataFrame([("abcbdab", "bdcaba"), ("", "a"), ("same", "same"), (None, "x")], "a string, b string")
    got = strings.lcs(pairs).collect()
    assert [r["length"] for r in got] == [4, 0, 4, 0]
    assert got[2]["lcs"] == "same"
    assert one(spark, scalars.lcs_length(F.lit("abcbdab"), F.lit("bdcaba")), scalars.lcs_length(F.lit(""), F.lit("a"))) == (4, 0)


def test_geo_golden(spark):
    z = geo.geoadd(spark.createDataFrame([("s", "Palermo", 13.361389, 38.115556), ("s", "Catania", 15.087269, 37.502669)], "key string, member string, lon double, lat double"))
    assert {r["member"]: r["geohash"] for r in geo.geohash(z).collect()} == {"Palermo": "sqc8b49rny0", "Catania": "sqdtr74hyu0"}
    at = {r["member"]: (r["lon"], r["lat"]) for r in geo.geopos(z).collect()}
    assert abs(at["Palermo"][0] - 13.36138933897018) < 1e-12 and abs(at["Palermo"][1] - 38.1155563954963) < 1e-12
    pair = spark.createDataFrame([("s", "Palermo", "Catania"), ("s", "Palermo", "none")], "key string, a string, b string")
    assert {r["b"]: r["dist"] for r in geo.geodist(z, pair, "km").collect()} == {"Catania": 166.2742, "none": None}
    centre = spark.createDataFrame([("s", "c", 15.0, 37.0)], "key string, centre string, lon double, lat double")
    assert [r["member"] for r in geo.geosearch(z, centre, radius=200, unit="km", count=1).collect()] == ["Catania"]
