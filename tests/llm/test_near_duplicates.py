import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import embedding_dedup, simhash_dedup
from keyloom.llm.components import connected_components


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def fingerprint(t):
    w = words(t)
    runs = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(ids, near):
    comp = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if near(i, j) and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for c, d in zip(comp, ids, strict=True):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return [least.get(c) for c in comp]


def corpus():
    rng = random.Random(1)
    base = [[rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(300)] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(rng.randint(1, 5)):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = "changed"
            texts.append(" ".join(c))
    return [*texts, "", None, "  \n", "one", "ONE", "two words"]


def test_simhash_is_brute_force(spark):
    texts = corpus()
    ids = [1000 - i for i in range(len(texts))]
    rows = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.simhash_groups(docs).collect()}
    fps = [fingerprint(t) for t in texts]
    want = groups(ids, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert got == {d: (f"{f:016x}", w) for d, f, w in zip(ids, fps, want, strict=True)}
    kept = sorted(r["doc_id"] for r in simhash_dedup.keep_representatives(docs, width=3).collect())
    assert kept == sorted(set(want))


def test_blocks_of_a_large_key_lose_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(63)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5))) for _ in range(150)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash_dedup.fingerprint_links(frame, block=8).collect()
    assert all((e["src"] ^ e["dst"]).bit_count() <= 3 for e in edges)
    near = groups(fps, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    linked = {(e["src"], e["dst"]) for e in edges} | {(e["dst"], e["src"]) for e in edges}
    place = {f: i for i, f in enumerate(fps)}
    pairs = {(place[a], place[b]) for a, b in linked}
    assert groups(fps, lambda i, j: (i, j) in pairs) == near


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash_dedup.covering_masks(3)
    rng = random.Random(3)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(diff & (m & (1 << 64) - 1) == 0 for m in masks)


def test_representatives_of_odd_rows(spark):
    rows = [(5, "same text here now"), (5, "same text here now"), (3, "same text here now"), (None, "same text here now"), (None, "lonely null words stand"), (None, "lonely null words stand"), (9, "repeated key of its own"), (9, "repeated key of its own"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, *"klmnopqrs") for i, t in rows], "doc_id long, text string, root string, odd_id string, gone_id string, fp string, told string, place string, c0 string, node string, `a.b` string")
    kept = simhash_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, simhash_dedup.keep_representatives(docs, similar=True).collect())) == sorted(map(str, kept.collect()))
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect())
    assert got == [("3", "same text here now"), ("7", "None"), ("9", "repeated key of its own"), ("None", "lonely null words stand")]
    assert simhash_dedup.simhash_groups(docs).count() == len(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_dedup.simhash_groups(docs).count() == 0 and simhash_dedup.keep_representatives(docs).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("block", [8, 512])
def test_embeddings_are_brute_force(spark, block):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    vectors = np.concatenate([base, base[:20] + 0.1 * rng.standard_normal((20, 16)), base[:1] + 0.05 * rng.standard_normal((60, 16)), base[3:6], base[7:8] * 5])
    rows = [(i, [float(x) for x in v], "l") for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [(n, None, "l"), (n + 1, [0.0] * 16, "l"), (n + 2, [float("nan")] * 16, "l"), (n + 3, [None, 1.0], "l"), (n + 4, [], "l"), (n + 5, [1.0, 0.0], "l"), (n + 6, [2.0, 0.0], "l"), (n + 7, [float("inf"), 1.0], "l")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(frame, block=block).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    comp = groups(list(range(n)), lambda i, j: near[i, j])
    missed = sum(got[i][0] != near[i].sum() - 1 for i in range(n))
    assert missed <= 0.02 * n and all(got[i][0] <= near[i].sum() - 1 for i in range(n))
    assert sum(got[i][1] != comp[i] for i in range(n)) <= 0.02 * n
    assert all(got[i][2] == (got[i][1] == i) for i in range(n))
    assert [got[n + k] for k in range(5)] == [(0, n + k, True) for k in range(5)] and got[n + 7] == (0, n + 7, True)
    assert got[n + 5] == (1, n + 5, True) and got[n + 6] == (1, n + 5, False)


def test_repeated_vectors_and_null_ids(spark):
    rows = [(4, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [1.0, 2.0]), (2, [1.0, 2.01])]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got) == [("2", 3, 2, True), ("4", 3, 2, False), ("4", 3, 2, False), ("None", 3, 2, False)]


def test_recall_at_the_threshold():
    bits, tables = embedding_dedup.plan(10**6)
    agree = (1 - np.arccos(0.9) / np.pi) ** bits
    assert 1 - (1 - agree) ** tables >= 0.99


def test_result_ignores_labels(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 2)], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(base).agg(F.sum("n_links")).first()[0] == 2


def test_similar_texts(spark):
    rng = random.Random(6)
    # as in prose, few words make up much of a text
    base = [" ".join(f"w{int(3000 ** rng.random())}" for _ in range(400)) for _ in range(12)]

    def edit(t, n):
        w = t.split()
        for k in rng.sample(range(len(w)), n):
            w[k] = f"edited{k}"
        return " ".join(w)

    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edit(t, 4).upper()) for i, t in enumerate(base)]  # similarity about 0.9
    rows += [(200, " ".join(sorted(base[0].split()))), (300, ""), (301, None), (302, "three words only"), (303, "three words  ONLY"), (304, "three words too"), (None, base[1]), (5, base[5])]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, sketch string")
    kept = simhash_dedup.keep_representatives(docs, similar=True)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(12), 200, 300, 302, 304]
    assert simhash_dedup.keep_representatives(docs.limit(0), similar=True).count() == 0


@pytest.mark.parametrize("block", [4, 20, 512])
def test_large_keys_lose_no_similar_pair(spark, block):
    """Texts in which one word prevails share a word fingerprint: dealt by bands and blocks they link as by brute force."""
    rng = random.Random(9)
    texts = []
    for k in range(12):
        w = [x for _ in range(60) for x in (f"c{rng.randrange(10**5)}", "|")]
        for _ in range(8 if k else 40):
            v = list(w)
            v[2 * rng.randrange(60)] = f"c{rng.randrange(10**5)}"
            texts.append(" ".join(v))
    nodes = simhash_dedup.with_shingles(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).cache()
    node = {r["id"]: r["node"] for r in nodes.select("id", "node").collect()}
    links = {(r["src"], r["dst"]) for r in simhash_dedup.similar_links(nodes.drop("id").dropDuplicates(["node"]), block=block).collect()}
    sets = [shingles(t) for t in texts]
    n = list(range(len(texts)))
    linked = lambda i, j: node[i] == node[j] or (node[i], node[j]) in links or (node[j], node[i]) in links
    want = groups(n, lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    assert groups(n, linked) == want and len(set(want)) >= 12


def shingles(t):
    w = words(t)
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def zipf(rng, n):
    return [f"w{int(3000 ** rng.random())}" for _ in range(n)]


def similar_pairs(rng, lengths, low, high, each):
    """(length, text, its edited form): text appended or words replaced until the similarity lies between low and high."""
    out = []
    for n in lengths:
        for k in range(each):
            w = zipf(rng, n)
            for _ in range(1000):
                if k % 2:
                    v = w + zipf(rng, rng.randint(1, max(n // 4, 1)))
                else:
                    v = list(w)
                    for at in rng.sample(range(n), rng.randint(1, max(n // 30, 1))):
                        v[at] = f"edited{rng.randrange(10**6)}"
                if low <= jaccard(shingles(" ".join(w)), shingles(" ".join(v))) < high:
                    out.append((n, " ".join(w), " ".join(v)))
                    break
    return out


def long_fingerprint(t):
    """An own SimHash of the different five-word shingles, in eight words of 64 bits."""
    mask = 2**64 - 1
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in shingles(t)]
    out = []
    for k in range(8):
        mixed = []
        for h in hs:
            x = h + (k + 1) * 0x9E3779B97F4A7C15 & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            mixed.append(x ^ x >> 31)
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)))
    return out


@pytest.mark.parametrize("block", [40, 2048])
def test_families_of_near_duplicates_come_from_simhash(spark, block):
    """the stage's candidates are pairs within the radius in a part of a SimHash of five-word shingles, and no such pair is lost."""
    rng = random.Random(14)
    texts = [t for _, *both in similar_pairs(rng, (9, 30, 200), 0.4, 0.9, 16) for t in both]
    w = zipf(rng, 60)
    for _ in range(150):  # more than are compared side by side
        v = list(w)
        v[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(v))
    texts += [" ".join(zipf(rng, 30)) for _ in range(200)]
    nodes = simhash_dedup.with_shingles(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), only=("bands",)).cache()
    rows = {r["id"]: r for r in nodes.collect()}
    prints = [long_fingerprint(t) for t in texts]
    assert [[x % 2**64 for x in rows[i]["bands"]] for i in range(len(texts))] == prints
    whole = [sum(x << 64 * k for k, x in enumerate(p[:5])) for p in prints]
    spare = [sum(x << 64 * k for k, x in enumerate(p[5:])) for p in prints]

    def near(i, j):
        differ = whole[i] ^ whole[j]
        return any((differ >> 24 * p & 0xFFFFFF).bit_count() <= 3 for p in range(12)) and (spare[i] ^ spare[j]).bit_count() <= 57

    family = {r["node"]: r["component"] for r in connected_components(simhash_dedup.band_links(nodes.drop("id").distinct(), block=block)).collect()}
    got = [family.get(rows[i]["node"], rows[i]["node"]) for i in range(len(texts))]
    n = range(len(texts))
    assert all(got[i] == got[j] for i in n for j in range(i) if near(i, j))
    # pairs further apart in every part meet by chance, if their spare words are near
    together = groups(list(n), lambda i, j: (spare[i] ^ spare[j]).bit_count() <= 57)
    assert all(together[i] == together[j] for i in n for j in range(i) if got[i] == got[j])
    assert len(set(got)) > 200


def test_similar_pairs_share_a_band_at_any_length(spark):
    """Pairs from 0.8 up, most of them just above, in short, long, edited and extended texts."""
    pairs = similar_pairs(random.Random(10), (12, 20, 40, 80, 300, 1000), 0.8, 0.85, 40)
    assert len(pairs) >= 200
    assert {n for n, *_ in pairs} == {12, 20, 40, 80, 300, 1000}
    docs = spark.createDataFrame([(2 * i + k, t) for i, (_, *both) in enumerate(pairs) for k, t in enumerate(both)], "id long, text string")
    nodes = simhash_dedup.with_shingles(docs, only=("bands",)).cache()
    place = {r["id"]: r["node"] for r in nodes.collect()}
    family = {r["node"]: r["component"] for r in connected_components(simhash_dedup.band_links(nodes.distinct())).collect()}
    assert [n for i, (n, *_) in enumerate(pairs) if place[2 * i] != place[2 * i + 1] and family.get(place[2 * i], 0) != family.get(place[2 * i + 1], 1)] == []


def test_similar_pairs_are_found_at_any_length(spark):
    """Pairs from 0.8 up, most of them just above, in short, long, edited and extended texts."""
    pairs = similar_pairs(random.Random(10), (12, 20, 40, 80, 300, 1000), 0.8, 0.85, 40)
    assert len(pairs) >= 200
    docs = spark.createDataFrame([(2 * i + k, t) for i, (_, *both) in enumerate(pairs) for k, t in enumerate(both)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash_dedup.keep_representatives(docs, similar=True).collect()}
    assert [n for i, (n, *_) in enumerate(pairs) if 2 * i + 1 in kept] == []


@pytest.mark.parametrize(("block", "held"), [(16, 1 << 21), (512, 1 << 21), (512, 1500)])
def test_similar_links_are_exact(spark, block, held):
    """Families of templated texts on both sides of 0.8 and pairs close to it link as by brute force."""
    rng = random.Random(11)
    texts = []
    for n, family in ((100, 0.72), (100, 0.78), (100, 0.81)):
        own = round(n * (1 - family) / (1 + family))  # appended words, so that two texts share about that much
        w = zipf(rng, n - own)
        texts += [" ".join([*w, *[f"x{rng.randrange(10**7)}" for _ in range(own)]]) for _ in range(60)]
    for low, high in ((0.76, 0.8), (0.8, 0.83)):
        texts += [t for _, *both in similar_pairs(rng, (30, 100, 400), low, high, 12) for t in both]
    nodes = simhash_dedup.with_shingles(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).cache()
    place = {r["node"]: r["id"] for r in nodes.select("node", "id").collect()}
    links = [(place[r["src"]], place[r["dst"]]) for r in simhash_dedup.similar_links(nodes.drop("id", "text"), block=block, held=held).collect()]
    sets = [shingles(t) for t in texts]
    assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in links)
    both = {*links, *((b, a) for a, b in links)}
    n = list(range(len(texts)))
    assert groups(n, lambda i, j: (i, j) in both) == groups(n, lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)


def test_repeated_and_null_keys_link_by_their_own_text(spark):
    rng = random.Random(12)
    a, b, c = (zipf(rng, 200) for _ in range(3))
    near = lambda w: " ".join([*w[:100], "edited", *w[101:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (4, near(a)), (7, near(b)), (None, " ".join(c)), (None, near(c))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in simhash_dedup.keep_representatives(docs, similar=True).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(4, near(a)), (5, " ".join(b)), (None, min(" ".join(c), near(c)))]))


def test_representatives_are_those_of_exact_similarity(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = sorted((r["doc_id"], r["text"]) for r in frame.collect())
    sets = [shingles(t) for _, t in docs]
    want = groups([d for d, _ in docs], lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    kept = [r["doc_id"] for r in simhash_dedup.keep_representatives(frame, similar=True).collect()]
    assert sorted(kept) == sorted(set(want))


def test_recall_over_ten_thousand_documents(spark):
    """Every document whose id 50 divides, against all rows: no pair from 0.8 up is in two groups, and groups hold together by such pairs."""
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows, groups_of = simhash_dedup._similar_classes(frame, "doc_id", "text")
    group = {r["id"]: r["component_id"] for r in rows.join(groups_of, "fp").collect()}
    sets = {r["doc_id"]: np.unique([hash(x) for x in shingles(r["text"])]).astype(np.int64) for r in frame.collect()}
    ids = np.array(sorted(sets))
    assert len(ids) >= 10_000
    held, size = np.concatenate([sets[d] for d in ids]), np.array([len(sets[d]) for d in ids])
    owner = np.repeat(np.arange(len(ids)), size)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    pairs = missed = 0
    for d in ids[ids % 50 == 0].tolist():
        own = sets[d]
        first, last = np.searchsorted(held, own), np.searchsorted(held, own, "right")
        common = np.bincount(np.concatenate([np.zeros(0, np.int64), *[owner[a:b] for a, b in zip(first, last, strict=True)]]), minlength=len(ids))
        near = ids[(common >= 0.8 * (len(own) + size - common)) & (ids != d) & (common > 0)].tolist()
        pairs += len(near)
        missed += sum(group[e] != group[d] for e in near)
        assert near or not len(own) or group[d] == d
    assert pairs > 50 and missed == 0, (pairs, missed)


def test_embedding_recall_over_all_rows(spark):
    """n_links of every vector against all rows: a plain table's, and 1,500 more at cosines of 0.9 to 0.93 to one of them."""
    rng = np.random.default_rng(13)
    base = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], np.float64)
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = base[rng.integers(0, 500, 1500)]
    off = rng.standard_normal(near.shape)
    off -= (off * near).sum(axis=1)[:, None] * near
    cos = rng.uniform(0.9, 0.93, len(near))[:, None]
    x = np.concatenate([base, cos * near + np.sqrt(1 - cos**2) * off / np.linalg.norm(off, axis=1)[:, None]])
    links = (x @ x.T >= 0.9).sum(axis=1) - 1
    most = (x @ x.T >= 0.9 - 1e-9).sum(axis=1) - 1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(frame).collect()}
    got = np.array([got[i] for i in range(len(x))])
    asked = np.arange(len(x)) % 50 == 0
    assert (got <= most).all() and links[asked].sum() > 50
    assert got[asked].sum() >= 0.9 * links[asked].sum() and got.sum() >= 0.98 * links.sum(), (got.sum(), links.sum())
