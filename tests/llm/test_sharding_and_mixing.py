import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import mixing, sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_loop():
    keys = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 2000)
    for n in (1, 2, 16, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k) % (1 << 64), n) for k in keys]


def test_assignment(spark):
    rows = [(i, f"text {i} é", "old", 3) for i in range(500)] + [(None, None, "old", 3), (None, "", "old", 3), (7, "text 7 é", "old", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, law string, slot int")
    out = sharding.assign(docs, 16, groups=8).collect()
    assert len(out) == len(rows)
    slots, shard_of = defaultdict(list), {}
    for r in out:
        body = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 1, zlib.crc32(body), "key")
        assert r["grown_shard"] in (r["shard"], 16)
        assert shard_of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(docs.limit(0), 16).count() == 0


def test_sharding_takes_odd_columns(spark):
    docs = spark.createDataFrame([(1, "t", 1, 2, 3, 4, 5, 6)] * 3, "doc_id long, text string, s int, g int, start int, `Shard` int, `group` int, `a.b` int")
    out = sharding.assign(docs, 4)
    assert out.columns == ["doc_id", "text", "s", "g", "start", "group", "a.b", *sharding.MADE]
    assert sorted(r["slot"] for r in out.collect()) == [0, 1, 2] and {(r["s"], r["g"], r["start"], r["group"], r["a.b"]) for r in out.collect()} == {(1, 2, 3, 5, 6)}


def corpus(spark):
    rows = [(i, "word " * (1 + i % 7) + ("| a | b " if i % 5 == 0 else "") + ("?" if i % 3 == 0 else ""), ["en", "de", None][i % 3], "hot" if i % 2 else f"s{i % 10}") for i in range(2000)]
    rows += [(None, None, None, None), (5000, "", "en", "only-empty"), (5000, "", "en", "only-empty")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_raked_marginals_meet_their_targets(spark):
    """All three marginals, whichever came last; with a source for null and one for its sign."""
    docs = corpus(spark).where("doc_id < 2000")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 11 == 0, F.lit("∅")).when(F.col("doc_id") % 13 == 0, F.lit(None)).when(F.col("doc_id") % 17 == 0, F.lit("")).when(F.col("doc_id") % 19 == 0, F.lit("=")).otherwise(F.col("source")))
    cells = mixing.cell_probabilities(docs, targets={"lang": {"en": 2.0, "de": 1.0, None: 1.0}}, tolerance=1e-7).collect()
    total = sum(c["tokens"] for c in cells)
    by, seen = {d: Counter() for d in mixing.DIMS}, {d: Counter() for d in mixing.DIMS}
    for c in cells:
        for d in mixing.DIMS:
            by[d][c[d]] += c["raked"]
            seen[d][c[d]] += c["tokens"]
    assert {"∅", None, "", "="} <= set(by["source"])
    goals = {"lang": {"en": 0.5, "de": 0.25, None: 0.25}}
    for d, alpha in (("source", 0.7), ("topic", 1.0)):
        power = {k: (v / total) ** alpha for k, v in seen[d].items() if v}
        goals[d] = {k: v / sum(power.values()) for k, v in power.items()}
    for d in mixing.DIMS:
        for k, goal in goals[d].items():
            assert abs(by[d][k] / total - goal) <= 1e-6 * goal, (d, k)
    assert all(0 < c["probability"] <= 1 for c in cells) and max(c["probability"] for c in cells if c["tokens"]) == 1


def test_targets_that_contradict(spark):
    """Each source has one language: the targets cannot all be met, raking ends, and a warning says so."""
    cells = spark.createDataFrame([("a", "x", "t", 10.0), ("b", "y", "t", 30.0)], "source string, lang string, topic string, tokens double")
    with pytest.warns(UserWarning, match="off its target"):
        raked = mixing.rake(cells, mixing.DIMS, "tokens").collect()
    assert abs(sum(r["raked"] for r in raked) - 40) < 1e-6
    assert mixing.rake(cells.limit(0), mixing.DIMS, "tokens").count() == 0


def test_sample(spark):
    docs = corpus(spark)
    got = mixing.mix(docs, tolerance=1e-3).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in mixing.mix(docs.repartition(3), tolerance=1e-3).collect())
    share = lambda rows: sum(len((r["text"] or "").split()) for r in rows if r["source"] == "hot") / sum(len((r["text"] or "").split()) for r in rows)
    before, after = share(docs.collect()), share(got)
    want = before**0.7 / (before**0.7 + 5 * ((1 - before) / 5) ** 0.7)
    assert abs(after - want) < 0.04 < before - after
    assert sum(r["source"] == "only-empty" for r in got) == 2
    assert mixing.mix(docs.limit(0)).count() == 0


def test_draw_is_uniform(spark):
    u = [r["u"] for r in spark.range(4000).select(mixing.draw(F.col("id")).alias("u")).collect()]
    assert abs(np.mean(u) - 0.5) < 0.02 and 0 <= min(u) and max(u) < 1


def test_mixing_plan_has_no_python(spark):
    plan = mixing.mix(corpus(spark), sweeps=2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_takes_odd_columns(spark):
    """Names of the operator's own are replaced or kept as its docstring says, and so are names with dots."""
    docs = corpus(spark).limit(50).selectExpr("*", "1 AS _source", "2 AS _Probability", "3 AS tokens", "4 AS probability", "5 AS row", "6 AS topic", "7 AS key", "8 AS `a.b`")
    out = mixing.mix(docs, sweeps=1)
    assert out.columns == ["doc_id", "text", "lang", "source", "tokens", "probability", "row", "topic", "key", "a.b", *mixing.MADE]
    assert {(r["tokens"], r["probability"], r["row"], r["topic"], r["key"], r["a.b"]) for r in out.collect()} == {(3, 4, 5, 6, 7, 8)}


def test_topics(spark):
    texts = {None: "none", " \n": "none", "a | b | c": "table", "x = y + z * 3": "code", "write to me@home now please do": "contact", "see http://a b c d e f g": "contact", "one\ntwo\nthree": "list", "seven words on a line are here": "note", "word " * 100: "prose"}
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.topic_of(F.col("text")).alias("topic")).collect()
    assert {r["text"]: r["topic"] for r in got} == texts
