import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from keyloom.llm import _shared, _text
from keyloom.llm.components import connected_components


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


TEXTS = ["", None, "One", "two  WORDS", " lead and\ttail\n", "ünï Çode İ ẞ", "x" * 100 + " y", "\u00a0no break\u2003em", "a b c d e f g " * 50, "supercalifragilistic expialidocious antidisestablishmentarianism"]


@pytest.mark.parametrize("piece", [1, 16, 1 << 20])
def test_words_and_shingles(piece):
    data, offsets = _text.column_bytes(pa.array(["skipped", *TEXTS]).slice(1))
    got, shingles = [], []
    for a, b in _text.pieces(offsets, piece):
        w = _text.split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        raw = [bytes(w.buffer[s : s + n]).decode() for s, n in zip(w.starts, w.lens, strict=True)]
        got += [raw[w.first[i] : w.first[i + 1]] for i in range(b - a)]
        starts, lens, cum = _text.shingle_spans(w, 3)
        h = _text.xxh64(w.buffer, starts, lens)
        shingles += [h[cum[i] : cum[i + 1]].tolist() for i in range(b - a)]
    want = [words(t) for t in TEXTS]
    assert got == want
    runs = [[" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else [] for w in want]
    assert shingles == [[xxhash.xxh64_intdigest(s.encode(), 42) for s in r] for r in runs]


@pytest.mark.parametrize("size", [1, 3, 16, 64, 1 << 20])
@pytest.mark.parametrize("width", [1, 3, 5])
def test_windows_lose_and_repeat_nothing(size, width):
    rng = random.Random(0)
    texts = [*TEXTS, " " * 50, "a" * 40 + " b " + " " * 30, "  " + " ".join(f"w{rng.randrange(99)}" for _ in range(200)) + "  \n", "z" * 300, "x y", "one"]
    got = [[] for _ in texts]
    for a, b, w, opens, closes in _text.word_pieces(pa.array(texts), width - 1, size):
        assert b - a == 1 or (opens and closes)
        starts, lens, cum = _text.shingle_spans(w, width, closes)
        h = _text.xxh64(w.buffer, starts, lens)
        for i in range(b - a):
            got[a + i] += h[cum[i] : cum[i + 1]].tolist()
    runs = [[" ".join(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))] if w else [] for w in map(words, texts)]
    assert got == [[xxhash.xxh64_intdigest(s.encode(), 42) for s in r] for r in runs]


def test_xxh64_of_all_lengths():
    raw = np.random.default_rng(0).integers(0, 256, 300, dtype=np.uint8)
    starts, lens = np.arange(100), np.arange(100)
    want = [xxhash.xxh64_intdigest(raw[s : s + n].tobytes(), 7) for s, n in zip(starts, lens, strict=True)]
    assert _text.xxh64(raw, starts, lens, 7).tolist() == want


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    n = 200
    edges = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(120)], "chain": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "none": [(3, 3)]}[shape]
    parent = list(range(n + 1))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for e in edges for x in e if e[0] != e[1]}
    rows = [*edges, *edges[:3], (None, 1)]
    got = connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i, i % 7 if i < 60 else 3) for i in range(200)] + [(500, None)], "id long, k long")
    known = rows.where("k is not null").groupBy("k").count().selectExpr("k", "k * 10 as v", "count as n").where("k <> 6")
    got = sorted((r["id"], r["k"], r["v"]) for r in _shared.join_spread(rows, known, "k").collect())
    assert got == [(i, k, k * 10) for i in range(200) if (k := i % 7 if i < 60 else 3) != 6]


def test_a_cluster_needs_its_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        _shared.shared_dir(Session)
