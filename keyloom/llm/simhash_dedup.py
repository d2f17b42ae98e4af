"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the 64-bit SimHash of its word shingles.  Two fingerprints link when they differ in at most
``RADIUS`` bits.  Candidates come from 2**(RADIUS+1) - 1 tables whose bit masks are built from parity: bit i gets a
non-zero vector m(i) of RADIUS + 1 bits, and table v keeps bit i when the parity of m(i) & v is odd.  The bits in which
a pair differs span at most RADIUS dimensions, so some v is orthogonal to all of them, and in that table the pair shares
its key.  No pair within the radius is missed.

Near copies by the similarity of five-word shingles differ in more bits than one such fingerprint can cover.  They have
a long fingerprint, the SimHash of their different five-word shingles: ``PARTS`` parts of it meet under covering masks,
each as above, pairs that meet are held against ``SPARE`` words of it that belong to no part, and the families of what
is left are compared by exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.llm import _text
from keyloom.llm._shared import bounded, carried, cut, join_spread, quoted, with_made, without
from keyloom.llm.components import connected_components

WIDTH = 3  # words in a shingle
RADIUS = 3  # bits in which linked fingerprints may differ
SIMILARITY = 0.8  # share of common five-word shingles from which texts count as near copies
WORDS = 5  # words in a shingle of that share
PARTS, BITS = 12, 24  # parts of a long fingerprint and bits of each: at 0.8 no part is within the radius 5 times in a million
SPARE, SPARE_RADIUS = 3, 57  # words beside the parts, and bits in which they may differ: more at 0.8 once in ten million
FIRST = -(-PARTS * BITS // 64)  # the first spare word
RUN = 64  # rows of a group up to which all its pairs are compared side by side with other groups'
SAMPLE = 50_000  # nodes that tell which keys are large
HELD = 1 << 21  # shingles in a block of texts that are compared, about
BLOCK = 256  # fingerprints of one key compared in one group; larger keys are cut into pairs of blocks


def simhash(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """SimHash of every text of a string column, as unsigned 64-bit integers; 0 for texts without words or null."""
    counts, many = np.zeros((len(column), 64), np.int64), np.zeros(len(column), np.int64)
    for a, b, words, _, closes in _text.word_pieces(column, width - 1):
        starts, lens, cum = _text.shingle_spans(words, width, closes)
        many[a:b] += np.diff(cum)
        for at in range(0, len(starts), _text.SHINGLES):
            to = min(at + _text.SHINGLES, len(starts))
            h = _text.xxh64(words.buffer, starts[at:to], lens[at:to], 42)
            counts[a:b] += _bit_counts(h, np.clip(cum, at, to) - at)
    ones = (counts * 2 > many[:, None]).astype(np.uint64)
    return (ones << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _bit_counts(h: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in h[cum[i]:cum[i + 1]], for every i: byte counters in 64-bit words, 255 hashes at a time."""
    many = np.diff(cum)
    blocks = -(-many // 255)
    out = np.zeros((len(many), 64), np.int64)
    if not len(h):
        return out
    order = np.concatenate([[0], np.cumsum(blocks)])
    begin = np.repeat(cum[:-1] - 255 * order[:-1], blocks) + 255 * np.arange(order[-1])
    each = np.zeros((len(begin), 8, 8), np.int64)
    for bit in range(8):
        spread = (h >> np.uint64(bit)) & np.uint64(0x0101010101010101)
        each[:, :, bit] = np.add.reduceat(spread, begin).view(np.uint8).reshape(-1, 8)
    full = np.flatnonzero(blocks)
    out[full] = np.add.reduceat(each.reshape(-1, 64), order[full], axis=0)
    return out


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` without the text, and its fingerprint as a signed 64-bit ``fp``."""
    return with_made(docs, text, {"fp": "long"}, lambda: lambda c: [pa.array(simhash(c, width).view(np.int64))], keep=False)


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The tables' bit masks, as signed 64-bit integers."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (src, dst) that span the same components as all pairs of ``distinct.fp`` within the radius.

    Every pair within the radius meets in some group; a group compares its at most 2 * ``block`` fingerprints as
    bits and returns a spanning forest, never the pairs.  A key with more than ``block`` fingerprints is cut into blocks
    that meet two by two, so that no task takes a whole hot key.
    """
    masks = covering_masks(radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("tab", "key"))
    sizes = keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["tab", "key"]).withColumn("m", F.ceil(F.col("n") / block).cast("int"))
    met = met.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    met = met.select("tab", "key", "fp", F.col("c"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("x"))
    met = met.select("tab", "key", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"), "fp")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(pdf["fp"].to_numpy())
        return pd.DataFrame(spanning_forest(fp, radius), columns=["src", "dst"])

    return met.groupBy("tab", "key", "i", "j").applyInPandas(forest, "src long, dst long")


def spanning_forest(fp: np.ndarray, radius: int) -> np.ndarray:
    """Edges of a spanning forest of the sorted fingerprints' graph, found by sweeping breadth first over what is left."""
    bits = fp.view(np.uint64)
    left = np.arange(len(fp))
    edges = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(bits[left][:, None] ^ bits[front][None, :]) <= radius
            hit = near.any(axis=1)
            edges.append(np.stack([fp[front[near[hit].argmax(axis=1)]], fp[left[hit]]], axis=1))
            front, left = left[hit], left[~hit]
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def _classes(docs: DataFrame, key: str, text: str, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, fp) of ``docs``, and per fingerprint (fp, root, component_id, n rows); root names a component even without keys."""
    rows = cut(fingerprints(docs.select(quoted(key).alias("id"), quoted(text).alias("text")), "text", width), "fingerprints")
    named = rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    linked = connected_components(fingerprint_links(named.select("fp"), radius)).toDF("fp", "component")
    return rows, _named(named.join(linked, "fp", "left").withColumn("root", F.coalesce("component", "fp")))


def _named(nodes: DataFrame) -> DataFrame:
    """(fp, root, component_id, n) of nodes (fp, root, least, n): the least key of all the root's nodes."""
    classes = cut(nodes.select("fp", "least", "n", "root"), "classes")
    ids = cut(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")), "roots")
    return cut(join_spread(classes, ids, "root", "nodes").select("fp", "root", "component_id", "n"), "groups")


def _hashes(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of ranges a to b of texts, the hashes of all their shingles and the b - a + 1 offsets into them.  Those of a long text come at once."""
    held = []
    for a, b, words, _, closes in _text.word_pieces(column, width - 1):
        starts, lens, cum = _text.shingle_spans(words, width, closes)
        at = range(0, len(starts), _text.SHINGLES)
        held += [_text.xxh64(words.buffer, starts[k : k + _text.SHINGLES], lens[k : k + _text.SHINGLES], 42) for k in at]
        if closes:
            h, held = np.concatenate([np.zeros(0, np.uint64), *held]), []
            yield a, b, h, cum if b - a > 1 else np.array([0, len(h)])


def _long_simhash(h: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """SimHash of the hashes h[cum[i]:cum[i + 1]], for every i, in ``FIRST + SPARE`` words of 64 bits."""
    many, out = np.diff(cum), np.zeros((len(cum) - 1, FIRST + SPARE), np.uint64)
    for k in range(FIRST + SPARE):
        counts = np.zeros((len(many), 64), np.int64)
        for at in range(0, len(h), _text.SHINGLES):
            to = min(at + _text.SHINGLES, len(h))
            x = h[at:to] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            counts += _bit_counts(x ^ (x >> np.uint64(31)), np.clip(cum, at, to) - at)
        out[:, k] = np.packbits(counts * 2 > many[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_shingles(docs: DataFrame, text: str = "text", width: int = WORDS, only: tuple[str, ...] = ("bands", "shingles")) -> DataFrame:
    """``docs`` without the text, with the columns ``only`` and node: a hash of all shingles, equal for copies whatever their case and white space.

    Bands are the words of the long fingerprint: a bit is 1 if set in over half of a hash of each different shingle, and
    texts of a similarity of 0.8 differ in 15 % of the bits, whatever their length; null without shingles.  Shingles are
    the different hashes in ascending order, eight bytes each; size counts all, repeats included.
    """
    made = {c: {"bands": "array<long>", "shingles": "binary", "size": "long"}[c] for c in only} | {"node": "long"}

    def make(column: pa.Array) -> list[pa.Array]:
        node = np.zeros(len(column), np.uint64)
        out: dict[str, list] = {c: [] for c in only}
        for a, b, h, cum in _hashes(column, width):
            full = np.flatnonzero(np.diff(cum))
            if len(full):
                node[a + full] = np.add.reduceat(h, cum[:-1][full])
            sets = [np.unique(h[x:y]) for x, y in pairwise(cum)] if only and only != ("size",) else []
            if "bands" in out:
                words = _long_simhash(np.concatenate([h[:0], *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
                out["bands"] += [x if n else None for x, n in zip(words.view(np.int64), np.diff(cum), strict=True)]
            if "size" in out:
                out["size"] += np.diff(cum).tolist()
            if "shingles" in out:
                out["shingles"] += [x.tobytes() for x in sets]
        types = {"bands": pa.list_(pa.int64()), "shingles": pa.binary(), "size": pa.int64()}
        return [*[pa.array(out[c], types[c]) for c in only], pa.array(node.view(np.int64))]

    return with_made(docs, text, made, lambda: make, keep=False)


def _keyed(nodes: DataFrame) -> DataFrame:
    """A row (cell, a, b, c) for each node, part and covering mask: the cell holds the part's masked bits, the rest are the spare words."""
    masks = covering_masks(RADIUS, BITS)
    cells = []
    for p in range(PARTS):
        word, shift = divmod(p * BITS, 64)
        part = F.shiftrightunsigned(F.col("bands")[word], shift)
        if shift + BITS > 64:
            part = part.bitwiseOR(F.shiftleft(F.col("bands")[word + 1], 64 - shift))
        cells += [part.bitwiseAND(F.lit(m)) + F.lit((p * len(masks) + v) << BITS) for v, m in enumerate(masks)]
    return nodes.select(F.explode(F.array(*cells)).alias("cell"), *[F.col("bands")[FIRST + i].alias(c) for i, c in enumerate("abc")])


def _far(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    return reduce(np.add, [np.bitwise_count(u ^ v) for u, v in zip(x, y, strict=True)]) > SPARE_RADIUS


def _near_in_groups(group: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """For each row the first one of its component, of all pairs within ``SPARE_RADIUS`` in a run of one group."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.append(starts[1:], len(group))
    left = np.repeat(ends, ends - starts) - np.arange(len(group))  # rows of the group from here on
    at = np.flatnonzero(np.repeat(ends - starts, ends - starts) <= RUN)
    found = [np.zeros((2, 0), np.int64)]
    for step in range(1, RUN):
        at = at[left[at] > step]
        if not len(at):
            break
        near = at[~_far([w[at] for w in words], [w[at + step] for w in words])]
        found.append(np.stack([near, near + step]))
    i, j = np.concatenate(found, axis=1)
    root, before = np.arange(len(group)), None
    while before is None or (root != before).any():
        before, least = root.copy(), np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
    for first, end in zip(starts[ends - starts > RUN], ends[ends - starts > RUN], strict=True):
        place, rest = np.arange(first, end), [w[first:end] for w in words]
        front: list[list] = []
        while len(place):
            if not front:
                seed, front = place[0], [[w[0] for w in rest]]
                place, rest = place[1:], [w[1:] for w in rest]
            far = _far(rest, front.pop())
            if not far.all():
                hit = np.flatnonzero(~far)
                root[place[hit]] = seed
                front += [[w[k] for w in rest] for k in hit]
                place, rest = place[far], [w[far] for w in rest]
    return root


def _near_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (src, dst) of spare words a to the least of their component in a cell, from rows (cell, i, j, a, b, c) in ascending order."""
    held: list[pa.RecordBatch] = []

    def links(rows: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
        cell, i, j, *words = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in rows]) for k in range(6))
        new = (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        group = np.concatenate([[0], np.cumsum(new)])
        end = len(group) if last else int(np.searchsorted(group, group[-1]))  # the last group may go on
        own = [w[:end] for w in words]
        root = _near_in_groups(group[:end], [w.view(np.uint64) for w in own]) if end else np.zeros(0, np.int64)
        edges = np.stack([own[0][root], own[0]], axis=1)
        edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
        rest = pa.RecordBatch.from_arrays([pa.array(x[end:]) for x in (cell, i, j, *words)], names=list("gijabc"))
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["src", "dst"]), [rest]

    for batch in batches:
        held.append(batch)
        if sum(len(b) for b in held[1:]) >= _text.SHINGLES // 8:  # at most RUN pairs each are held
            out, held = links(held, False)
            yield out
    if sum(len(b) for b in held):
        yield links(held, True)[0]
    _text.release()


def band_links(nodes: DataFrame, block: int = 8 * BLOCK) -> DataFrame:
    """Links (src, dst) that span the families of ``nodes``: of all pairs near in a part of the long fingerprint and in its spare words.

    Every pair of which some part differs in at most ``RADIUS`` bits meets in some cell of the covering masks; within a
    cell all pairs are held against each other.  Cells of more than about ``block`` nodes, which a sample tells, are cut
    into blocks that meet two by two, so that no task takes a whole hot key; none of it loses a pair.  Nodes with the
    same first spare word are one family.
    """
    nodes = nodes.where("bands is not null").select("node", "bands")
    share = max(nodes.count() // SAMPLE, 1)
    sampled = _keyed(nodes.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0))
    sizes = sampled.groupBy("cell").agg((F.count("*") * share).alias("n")).where(F.col("n") > block)
    large = bounded(cut(sizes.select("cell", F.least(F.ceil(F.col("n") / block), F.lit(1 << 30)).cast("int").alias("m")), "large"))
    dealt = _keyed(nodes).join(large, "cell", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64("a", "b", "c"), F.col("m")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    met = dealt.select("cell", F.least("at", "x").alias("i"), F.greatest("at", "x").alias("j"), "a", "b", "c")
    near = met.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "a").mapInArrow(_near_in_cells, "src long, dst long")
    named = nodes.select("node", F.col("bands")[FIRST].alias("word"))
    least = cut(named.groupBy("word").agg(F.min("node").alias("least")), "words")
    stars = near.groupBy("dst").agg(F.collect_set("src").alias("all"))  # one or a few for each cell of a node
    stars = stars.select(F.array_min("all").alias("src"), F.explode(F.array_append("all", F.col("dst"))).alias("dst"))
    near = cut(stars.where("src <> dst").distinct(), "near").join(least.toDF("src", "a"), "src").join(least.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return near.unionByName(named.join(least, "word").where("node <> least").select(F.col("least").alias("src"), F.col("node").alias("dst")))


def similar_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the sets' graph, where those of an exact Jaccard similarity of ``least`` or more are linked."""
    size = np.array([len(x) for x in sets])
    cum = np.concatenate([[0], np.cumsum(size)])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.repeat(np.arange(len(sets)), size)[np.argsort(term, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(term))])
    left = np.ones(len(sets), bool)
    edges = []
    for seed in range(len(sets)):
        front = [seed] if left[seed] else []
        left[seed] = False
        while front and left.any():
            a = front.pop()
            own = term[cum[a] : cum[a + 1]]
            many = first[own + 1] - first[own]
            at = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            common = np.bincount(held[at], minlength=len(sets))
            hit = np.flatnonzero(left & (common >= least * (size[a] + size - common) - 1e-9))
            edges += [(a, int(b)) for b in hit]
            left[hit] = False
            front += hit.tolist()
    return edges


def similar_links(nodes: DataFrame, docs: DataFrame | None = None, least: float = SIMILARITY, block: int = 2 * BLOCK, held: int = HELD) -> DataFrame:
    """Links (src, dst) that span the same components as all pairs of ``nodes`` whose shingles have a Jaccard similarity of ``least`` or more.

    ``nodes`` has node and bands, and either shingles or size and, as least, the key of a row of ``docs`` (id, text) to
    make them from.  Nodes whose long fingerprints are near, directly or through others, make up a family; within it every pair is
    compared by exact similarity.  A family of more than ``block`` nodes, or ``held`` shingles, is cut into blocks that
    meet two by two, so that no task takes a whole one.
    """
    family = connected_components(band_links(nodes)).toDF("node", "family")
    size = F.col("size") if "size" in nodes.columns else F.octet_length("shingles") / 8
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / held))
    sizes = family.join(nodes.select("node", size.alias("size")), "node").groupBy("family").agg(parts.cast("int").alias("m"))
    dealt = family.join(sizes, "family").withColumn("c", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    if docs is None:
        sets = nodes.select("node", "shingles")
    else:
        wanted = cut(nodes.join(family, "node").where("least is not null").select(F.col("least").alias("wanted")).distinct(), "wanted")
        texts = docs.join(bounded(wanted), docs["id"] == F.col("wanted"), "left_semi").unionByName(docs.where("id is null"))
        sets = with_shingles(texts.select("text"), only=("shingles",)).dropDuplicates(["node"])
    met = dealt.join(sets, "node").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    met = met.select("family", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"), "node", "shingles")

    def link(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        edges = np.array(similar_forest([np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()], least), np.int64).reshape(-1, 2)
        return pa.table({"src": node[edges[:, 0]], "dst": node[edges[:, 1]]})

    return met.groupBy("family", "i", "j").applyInArrow(link, "src long, dst long")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: (key, fingerprint as 16 hex digits, component_id: smallest key reachable by links).

    Null and empty texts have fingerprint zero and link like any other.  Null keys form part of a component without
    naming it (a component of null keys only has a null id).  Repeated rows come back as often as they went in; an
    empty table gives an empty result; further columns are ignored, whatever their names.  Long texts are read in windows.
    """
    rows, classes = _classes(docs, key, text, width, radius)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_spread(rows, classes.drop("root"), "fp").select(F.col("id").alias(key), hexed.alias("fingerprint"), "component_id")


def _similar_classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """As ``_classes``, by similarity: ``fp`` is the node there."""
    texts = docs.select(quoted(key).alias("id"), quoted(text).alias("text"))
    rows = cut(with_shingles(texts, only=("bands", "size")), "bands")
    named = cut(rows.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("size").alias("size")), "nodes")
    linked = connected_components(similar_links(named, texts)).toDF("node", "component")
    nodes = named.join(linked, "node", "left").select(F.col("node").alias("fp"), "least", "n", F.coalesce("component", "node").alias("root"))
    return rows.select("id", F.col("node").alias("fp")), _named(nodes)


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS, similar: bool = False) -> DataFrame:
    """``docs``, all columns whatever their names, with one row of each near-duplicate group: the one with the smallest key.

    Groups are those of ``simhash_groups``, or with ``similar`` of texts whose five-word shingles agree to ``SIMILARITY``:
    long SimHash fingerprints under covering masks find the families and exact similarity of shingles links within them.

    Rows whose key is null or repeated are told apart by their fingerprint: of those that tie for their group's place
    the one with the smallest text stays; a null key has its place only in a group of null keys.  Null and empty texts are
    copies of each other, and an empty table gives an empty result.
    """
    rows, classes = _similar_classes(docs, key, text) if similar else _classes(docs, key, text, width, radius)
    own = carried(docs)
    key_at, text_at = (f"c{docs.columns.index(c)}" for c in (key, text))
    repeated = cut(rows.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "repeated")
    placed = join_spread(rows, classes.drop("root"), "fp").select("id", "component_id")
    gone = placed.where("id <> component_id").select("id").union(repeated).distinct()
    gone = cut(gone.toDF("gone_id"), "gone")
    kept = without(own.where(F.col(key_at).isNotNull()), gone, key_at, "gone_id")
    odd = own.join(bounded(repeated.toDF("odd_id")), F.col(key_at) == F.col("odd_id"), "left_semi").unionByName(own.where(F.col(key_at).isNull()))
    told = odd.withColumn("told", F.col(text_at))
    marked = with_shingles(told, "told", only=()).withColumnRenamed("node", "fp") if similar else fingerprints(told, "told", width)
    tied = marked.join(classes.drop("n"), "fp").where(F.col(key_at).eqNullSafe(F.col("component_id")))
    first = tied.withColumn("place", F.row_number().over(W.partitionBy("root").orderBy(F.col(text_at).asc_nulls_first()))).where("place = 1")
    return kept.unionByName(first.select(*own.columns)).toDF(*docs.columns)
