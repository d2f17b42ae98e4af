import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import quality, queries


def prose(rng):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))).capitalize() + "."


def test_features_do_not_depend_on_neighbours():
    rng = random.Random(0)
    texts = [prose(rng) for _ in range(20)] + ["", None, "a", "\n\n", "x\nx\nx\n", "é ü", "!!! ### $$$", "A" * 5000, "\ny"]
    together = quality.features(pa.array(texts))
    assert np.isfinite(together).all() and together.shape == (len(texts), len(quality.NAMES))
    for i, t in enumerate(texts):
        assert np.allclose(quality.features(pa.array([t], pa.string()))[0], together[i])
    lines = quality.NAMES.index("repeated_lines")
    assert np.isclose(together[texts.index("x\nx\nx\n"), lines], np.sqrt(2 / 3)) and not together[20].any()


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_windows_give_the_same_statistics(size):
    rng = random.Random(2)
    texts = ["a", "\n\n\n", " x", "no end of line" * 9, "x\nx\nx\n", "!!! ### $$$ || ||\n\n", "é ü é ü", "word " * 40 + "\n" * 9 + "word"] + ["".join(rng.choice("ab 1#.|!\n\t") for _ in range(rng.randint(1, 400))) for _ in range(40)]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(quality._long(data, size)[0], quality.features(pa.array([t]))[0]), t


def naive(t):
    """The statistics by their definition, in plain code."""
    raw = (t or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    if not words:
        return [0.0] * len(quality.NAMES)
    solid = sum(len(w) for w in words)
    share = lambda chars: math.sqrt(sum(raw.count(bytes([c])) for c in set(chars)) / solid)
    marks, symbols = b"!?,;:'\"()-", b"#$%&*+/<=>@[\\]^_`{}~"
    lines = re.findall(rb"[^\n]*\n|[^\n]+", raw)
    mean = solid / len(words)
    pairs = list(zip(words, words[1:]))
    return [
        math.log1p(len(words)),
        math.log1p(mean),
        math.log1p(math.sqrt(max(sum(len(w) ** 2 for w in words) / len(words) - mean**2, 0))),
        share(range(65, 91)),
        share(range(48, 58)),
        share(marks),
        share(symbols),
        share(b"|"),
        math.sqrt(sum(a == b and a in marks + symbols for a, b in zip(raw, raw[1:])) / solid),
        math.log1p(len(words) / len(lines)),
        math.sqrt(sum(len(x) < 20 for x in lines) / len(lines)),
        len(set(words)) / len(words),
        len(set(pairs)) / max(len(pairs), 1),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt(raw.count(b".") / len(words)),
        math.sqrt(sum(c >= 128 for c in raw) / solid),
    ]


def test_query_is_brute_force(spark):
    """Every score of op4 from plain code: the statistics, the class moments, the shrunk covariances and the densities."""
    data = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{data}/labels.parquet").collect()]
    x = {d: np.array(naive(t)) for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in docs}
    own = [np.array([x[d] for d, q in labels if q == k and d in x and not held[d]]) for k in (0, 1)]
    pooled = sum((len(a) - 1) * np.cov(a.T) for a in own) / (sum(map(len, own)) - 2)
    logs = []
    for a in own:
        cov = 0.9 * np.cov(a.T) + 0.1 * (pooled + 1e-6 * np.eye(len(pooled)))
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-6 * np.eye(len(cov))
        inverse, log_det, mean = np.linalg.inv(cov), np.linalg.slogdet(cov)[1], a.mean(axis=0)
        share = math.log((len(a) + 1e-3) / (sum(map(len, own)) + 2e-3))
        logs.append({d: share - 0.5 * ((v - mean) @ inverse @ (v - mean) + log_det) for d, v in x.items()})
    got = queries.op4_quality(spark, data).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        want = 1 / (1 + math.exp(min(max(logs[0][r["doc_id"]] - logs[1][r["doc_id"]], -700), 700)))
        assert math.isclose(r["score"], want, abs_tol=1e-6), r
        assert r["held_out"] == held[r["doc_id"]] and r["predicted"] == (r["score"] >= 0.3)


def test_a_sample_of_labels_learns_nearly_the_same(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng) if i % 3 else "$ " + prose(rng)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    assert 80 < quality.chosen_labels(labels, "doc_id", "quality", 120).count() < 160
    model = quality.learn_from_texts(docs, labels, F.lit(True), sample=120)
    out = quality.with_scores(docs, model).collect()
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in out) > 285


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng) if i % 3 else " ".join(w + "$$$" for w in prose(rng).split()), 0) for i in range(300)]
    docs = spark.createDataFrame([*rows, (1000, None, 0), (1001, "", 0), (None, "text", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1000, None), (5, 1), (None, 0), (77777, 1)], "doc_id long, quality int")
    model = quality.learn_from_texts(docs, labels, F.col("doc_id") % 2 == 0)
    out = quality.with_scores(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    right = [(r["score"] >= quality.THRESHOLD) == (r["doc_id"] % 3 > 0) for r in out if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] % 2]
    assert sum(right) / len(right) > 0.95


def test_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, "more words there")], "doc_id long, text string")
    none = quality.learn_from_texts(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert [r["score"] for r in quality.with_scores(docs, none).collect()] == [0.5, 0.5]
    one = quality.learn_from_texts(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"), F.lit(True))
    assert all(r["score"] > 0.9 for r in quality.with_scores(docs, one).collect())
    assert quality.with_scores(docs.limit(0), one).count() == 0


def test_score_is_the_density_formula():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = [rng.standard_normal((60, d)) @ rng.standard_normal((d, d)) + k for k in (0, 1)]
    n = np.array([60.0, 60.0])
    model = quality.fit(n, np.stack([a.sum(axis=0) for a in x]), np.stack([a.T @ a for a in x]))
    point = rng.standard_normal((5, d))
    logs = []
    for k in (0, 1):
        cov = np.linalg.inv(model.factor[k].T @ model.factor[k])
        diff = point - x[k].mean(axis=0)
        logs.append(np.log(0.5) - 0.5 * (np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(logs[0] - logs[1])))
