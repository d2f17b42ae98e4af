import math
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import decontaminate, mixing, quality, queries, sharding, sql

DATA = "/root/testdata/sf0.001"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]


def plain_words(t):
    """Words with only A-Z lower-cased, as the near-duplicate stage takes them."""
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def runs(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def held(docs, items):
    out = []
    for d, t in docs:
        for i, w in sorted({(i, tuple(words(x))) for i, x in items if i is not None}):
            k = min(len(w), 5)
            if k:
                own = runs(w, k)
                if not own:
                    continue
                hit = len(own & runs(words(t), k))
                if hit >= math.ceil(0.8 * len(own) - 1e-9):
                    out.append((str(d), i, len(own), hit))
    return sorted(out)


def case():
    rng = random.Random(0)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(8, 40)))) for i in range(30)] + [(100, "Tiny item"), (101, ""), (102, None), (None, "w1 w2 w3 w4 w5 w6"), (103, "same same same same same same same same"), (104, "one"), (105, items_text := "dup dup2 dup3 dup4 dup5 dup6"), (106, items_text), (107, "w1 w2"), (107, "w3 w4 w5 w6 w7 w8 w9 w10"), (107, "w3 w4 w5 w6 w7 w8 w9 w10"), (108, "one two"), (108, "One  two three four five six seven")]
    docs = []
    for d in range(80):
        body = text(rng.randint(0, 300))
        if d % 2:
            x = items[rng.randrange(30)][1].upper().split()
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = "changed"
            body[50:50] = x
        docs.append((d, "  \n".join(body)))
    docs += [(200, None), (201, ""), (202, "tiny item"), (203, "a TINY item here"), (None, items[0][1]), (5, items[1][1]), (5, items[1][1]), (204, "same " * 5), (205, "one"), (208, "w1 w2"), (209, "w2 w3 w4 w5 w6 w7 w8 w9 w10"), (210, "one two three"), (206, items_text), (207, "x " * 50_000 + items[2][1])]
    return docs, items


def test_containment_is_brute_force(spark):
    docs, items = case()
    frame = spark.createDataFrame([(d, t, 1, "n") for d, t in docs], "doc_id long, text string, _text_key int, item string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = sorted((str(r["doc_id"]), r["item_id"], r["item_shingles"], r["matched"]) for r in decontaminate.contamination(frame.select("doc_id", "text"), bench).collect())
    assert got == held(docs, items)
    kept = decontaminate.decontaminate(frame, bench)
    bad = {t for d, t in docs if held([(d, t)], items)}
    assert kept.columns == frame.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted((str(d), str(t)) for d, t in docs if t not in bad)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, bench).count() == 0 and decontaminate.decontaminate(docs, bench).count() == 1
    assert decontaminate.contamination(docs.limit(0), docs.toDF("item_id", "text")).count() == 0


def test_plan_has_no_python(spark):
    docs, items = case()
    plan = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    plain = lambda df: df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain(queries.QUERIES[name](spark, DATA).toPandas()), plain(con.execute(sql.ORACLE[name]).fetchdf()), check_dtype=False, atol=1e-6)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.ORACLE)))
def test_query_has_a_row_for_each_input_row(spark, name):
    source = {"op2": "embeddings", "op7": "pages", "op9": "pages"}.get(name.split("_")[0], "documents")
    assert queries.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{source}.parquet").count()


def test_pipeline_is_brute_force(spark):
    """Each stage held against plain code over what the stage before kept; scores come from tested parts."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, frame, DATA).collect()}
    assert sum(labels[d]["quality"] == (d in kept) for d in labels) / len(labels) > 0.95
    order = sorted(kept)
    sets = {d: runs(w, min(len(w), 5)) if (w := plain_words(docs[d]["text"])) else set() for d in order}
    first = {d: d for d in order}
    for i, d in enumerate(order):
        for e in order[:i]:
            if first[d] != first[e] and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]):
                a, b = sorted((first[d], first[e]))
                first = {e: a if r == b else r for e, r in first.items()}
    kept = {d for d in order if first[d] == d}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept -= {int(d) for d, *_ in held([(d, docs[d]["text"]) for d in kept], items)}
    p = {(c["source"], c["lang"], c["topic"]): c["probability"] for c in mixing.cell_probabilities(frame.where(F.col("doc_id").isin(sorted(kept)))).collect()}
    draws = {r["doc_id"]: r for r in frame.select("doc_id", mixing.draw(F.col("doc_id")).alias("u"), mixing.topic_of(F.col("text")).alias("t")).collect()}
    kept = {d for d in kept if draws[d]["u"] < p[docs[d]["source"], docs[d]["lang"], draws[d]["t"]]}
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in out} == kept and len(out) == len(kept)
    shards = {r["doc_id"]: r["shard"] for r in frame.select("doc_id", sharding.jump_shard(F.col("doc_id"), 16).alias("shard")).collect()}
    assert all(r["shard"] == shards[r["doc_id"]] and r["text"] == docs[r["doc_id"]]["text"] for r in out)


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, further columns, and no rows at all."""
    names = ["score", "_score", "_source", "_probability", "_text_key", "_group", "odd_id", "gone_id", "c0", "fp", "row", "start", "key", "Label", "a.b", "law"]
    rows = [(1, "plain words stand here in a row", "en", "s", 31, *names), (1, "plain words stand here in a row", "en", "s", 31, *names), (None, None, None, None, None, *[None] * 16), (2, "", "de", None, 0, *names), (3, "other words that nobody else has used so far", None, "s", None, *[None] * 16), (4, "long words and a very long text " * 200_000, "en", "t", 9, *names)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert set(docs.columns) - {"law"} <= set(out.columns) if name == "sharding" else out.columns == docs.columns
            got = out.select("doc_id", *[f"`{n}`" for n in names[:-1]]).collect()
            assert len(got) <= docs.count() and all(list(r)[1:] == [None] * 15 or list(r)[1:] == names[:-1] for r in got)
    assert quality.THRESHOLD == 0.3
