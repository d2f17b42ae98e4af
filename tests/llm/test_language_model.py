import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from keyloom.llm import kneser_ney


def tokens(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["\n"]


class Brute:
    def __init__(self, texts):
        uni, bi = Counter(), Counter()
        for t in map(tokens, texts):
            uni.update(t)
            bi.update(zip([" ", *t[:-1]], t, strict=True))
        starts = len(texts)
        self.n, self.v = sum(uni.values()), len(uni)
        self.uni, self.bi, self.context = uni, bi, Counter(uni) | Counter({" ": starts})
        self.kinds, self.before = defaultdict(Counter), Counter()
        for (v, w), c in bi.items():
            self.kinds[v][min(c, 3)] += 1
            self.before[w] += 1
        of = lambda values: kneser_ney.discounts([0, *[Counter(values)[k] for k in (1, 2, 3, 4)]])
        self.d, self.low = of(bi.values()), of(self.before.values())
        self.floor = sum(self.low[min(x, 3)] for x in self.before.values()) / len(bi) / (self.v + 1)

    def q(self, w):
        return (self.before[w] - self.low[min(self.before[w], 3)]) / len(self.bi) + self.floor

    def p(self, v, w):
        total = self.context[v]
        if not total:
            return self.q(w)
        back = sum(self.d[k] * self.kinds[v][k] for k in (1, 2, 3)) / total
        return (self.bi[v, w] - self.d[min(self.bi[v, w], 3)]) / total + back * self.q(w)


TEXTS = ["The cat sat on the mat", "the cat  ate\tthe rat", "a rat sat", "", None, "the the the the", "A cat and a rat and a mat sat", "word " * 300, "the cat sat on the mat"]
LONG = "w1 w2  w3 " * 120_000 + "x" * 1_200_000 + " tail"  # over several windows


@pytest.mark.parametrize(("part", "tasks"), [(1 << 20, 1 << 14), (4, 1 << 14), (4, 3)])
def test_scores_are_brute_force(spark, monkeypatch, part, tasks):
    """With parts of 4 entries vocabulary and bigrams lie in many files, several to a task, and frequent contexts are spread."""
    monkeypatch.setattr(kneser_ney, "PART", part)
    monkeypatch.setattr(kneser_ney, "TASKS", tasks)
    texts = [*TEXTS, LONG] if part > 4 else TEXTS
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    model = kneser_ney.train(docs)
    assert part > 4 or (len(model.words) > 1 and len(model.hot))
    brute = Brute(texts)
    assert model.tokens == brute.n and model.types == brute.v and model.pair_types == len(brute.bi)
    new = [*TEXTS, LONG, "unknown words the cat", "zzz", "mat the"]
    scored = {r["id"]: r for r in kneser_ney.score(spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(new)], "id int, text string, score double"), model).collect()}
    for i, t in enumerate(new):
        w = tokens(t)
        r = scored[i]
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(brute.uni[x] > 0 for x in w)
        assert math.isclose(r["score"], sum(math.log10(brute.p(a, b)) for a, b in zip([" ", *w[:-1]], w, strict=True)), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["base_score"], sum(math.log10((brute.uni[x] + 1) / (brute.n + brute.v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-9)
    for v in (" ", "the", "rat", "zzz"):
        assert math.isclose(sum(brute.p(v, w) for w in brute.uni) + brute.p(v, "no such word"), 1.0)


def test_empty_training_table(spark):
    model = kneser_ney.train(spark.createDataFrame([], "text string"))
    row = kneser_ney.score(spark.createDataFrame([(1, "a b")], "id int, text string"), model).first()
    assert (row["n_tokens"], row["n_known"], row["score"], row["base_score"]) == (3, 0, 0.0, 0.0)
    assert kneser_ney.score(spark.createDataFrame([], "id int, text string"), model).count() == 0


@pytest.mark.parametrize("held", [0, 3, 10**9])
def test_gathered_counts_add_up(monkeypatch, held):
    monkeypatch.setattr(kneser_ney, "HELD", 5)
    rng = np.random.default_rng(0)
    parts = [np.unique(rng.integers(0, 30, 6).astype(np.uint64), return_counts=True) for _ in range(40)]
    got = Counter()
    for keys, counts in kneser_ney._gathered(iter(parts), held):
        assert (np.diff(keys.astype(np.int64)) > 0).all() and (held < 10**9 or len(keys) == 30)
        got.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    want = Counter()
    for keys, counts in parts:
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert got == want


def test_odd_columns_and_repeated_rows(spark):
    """Names that clash with the operator's own, names with dots and blanks, null keys and repeated rows."""
    rows = [(None, "a b a", 1, 2, 3, 4), (7, "a b a", 1, 2, 3, 4), (7, "a b a", 1, 2, 3, 4), (8, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "id int, `the.text` string, Score int, part int, `a.b` int, `c d` int")
    out = kneser_ney.score(docs, kneser_ney.train(docs, "the.text"), "the.text")
    assert out.columns == ["id", "part", "a.b", "c d", *kneser_ney.MADE]
    got = out.collect()
    assert len(got) == 4 and len({r["score"] for r in got if r["n_tokens"] == 4}) == 1 and [r["n_tokens"] for r in got if r["id"] == 8] == [1]
