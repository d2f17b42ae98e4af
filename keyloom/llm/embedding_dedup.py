"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

A table's key is the signs of a vector's products with ``bits`` random planes.  Vectors at the threshold's angle agree on a
sign with probability 1 - angle / pi, so with the number of tables chosen here a pair at the threshold itself is missed
once in a hundred times, and closer pairs more rarely.  Pairs that share a key are compared in double precision inside
the key's group, which returns how many links each vector gained and a spanning forest of them, never the pairs.  A pair
counts in the first table in which it meets.  Groups are of bounded size: keys with more vectors are cut into blocks
that meet two by two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm._shared import cut, join_spread, quoted
from keyloom.llm.components import connected_components

THRESHOLD = 0.9
RECALL = 0.99  # of pairs at the threshold
PER_KEY = 64  # vectors that share a key by chance, about
BLOCK = 512


def plan(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): enough bits that keys stay small, enough tables for the recall."""
    bits = min(24, max(8, math.ceil(math.log2(max(vectors, 1) / PER_KEY))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, without null, NaN or infinite components, not zero."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles of length 1 (scaled by the largest component first, so squares stay finite)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def signatures(vectors: DataFrame, bits: int, tables: int, seed: int = 7) -> DataFrame:
    """``vectors`` (id, n, embedding) with ``keys``: the key of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column(2).offsets))
            keys = np.zeros((batch.num_rows, tables), np.int32)
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, bits * tables))
                signs = _matrix(batch.column(2).take(pa.array(own))) @ planes[d] > 0
                keys[own] = (signs.reshape(len(own), tables, bits) << np.arange(bits)).sum(axis=2)
            flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), keys.reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["id", "n", "embedding", "keys"])

    return vectors.mapInArrow(run, vectors.select("id", "n", "embedding", F.lit(None).cast("array<int>").alias("keys")).schema)


def forest(near: np.ndarray) -> np.ndarray:
    """Index pairs of a spanning forest of the graph with this symmetric matrix."""
    left, edges = np.arange(len(near)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            part = near[np.ix_(left, front)]
            hit = part.any(axis=1)
            edges.append(np.stack([front[part[hit].argmax(axis=1)], left[hit]], axis=1))
            front, left = left[hit], left[~hit]
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


def compare(table: pa.Table, threshold: float) -> pa.Table:
    """Of one group (tab, i, j, c, id, n, embedding, keys): rows (id, links, null) and forest edges (id, null, other)."""
    tab, i, j = (table.column(k)[0].as_py() for k in ("tab", "i", "j"))
    x, n = _matrix(table.column("embedding")), table.column("n").to_numpy()
    ids = table.column("id").to_numpy()
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    if i != j:
        c = table.column("c").to_numpy()
        near &= c[:, None] != c[None, :]
    if tab and near.any():
        keys = np.array(table.column("keys").combine_chunks().flatten()).reshape(len(ids), -1)[:, :tab]
        a, b = np.nonzero(near)
        for begin in range(0, len(a), 1 << 16):
            s = slice(begin, begin + (1 << 16))
            met = (keys[a[s]] == keys[b[s]]).any(axis=1)
            near[a[s][met], b[s][met]] = False
    links = near @ n
    some = np.flatnonzero(links)
    edges = forest(near[np.ix_(some, some)]) if len(some) else np.zeros((0, 2), np.int64)
    own, a, b = ids[some], ids[some][edges[:, 0]], ids[some][edges[:, 1]]
    none = pa.nulls
    return pa.table({"id": np.concatenate([own, a]), "links": pa.chunked_array([pa.array(links[some]), none(len(a), pa.int64())]), "other": pa.chunked_array([none(len(own), pa.int64()), pa.array(b)])})


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: (key, n_links, component_id, kept).

    n_links counts the other rows linked directly, component_id is the smallest key reachable, kept marks the row that has
    it.  Vectors that cannot link (see ``usable``) stand alone, and only vectors of one length link.  Equal vectors are one
    class with a count, so copies are never compared.  Rows with null keys count, but name no component and are not kept.
    Repeated rows link with each other, an empty table gives an empty result, and other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(quoted(key).alias("id"), quoted(embedding).alias("embedding"), usable(quoted(embedding)).alias("fine"))
    able = rows.where("fine")
    classes = able.groupBy("embedding").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "n", "least", "embedding"), "vectors")  # written once, so the numbers hold
    bits, tables = plan(classes.count(), threshold)
    signed = cut(signatures(classes.select("id", "n", "embedding"), bits, tables), "signatures")
    thin = signed.select("id", F.size("embedding").alias("d"), F.posexplode("keys").alias("tab", "k"))
    sizes = thin.groupBy("d", "tab", "k").agg(F.count("*").alias("m")).where("m > 1")
    met = thin.join(sizes, ["d", "tab", "k"]).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    met = met.withColumn("c", F.pmod(F.xxhash64("id", "tab"), F.col("blocks")).cast("int"))
    met = met.select("d", "tab", "k", "id", "c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    met = met.select("d", "tab", "k", "id", "c", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j")).join(signed, "id")
    found = met.groupBy("d", "tab", "k", "i", "j").applyInArrow(lambda table: compare(table, threshold), "id long, links long, other long")
    found = cut(found, "links")
    links = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    linked = connected_components(found.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst"))).toDF("id", "component")
    linked_to = classes.join(links, "id", "left").join(linked, "id", "left")
    named = cut(linked_to.select("id", "n", "least", "embedding", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("root")), "named")
    roots = cut(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")), "roots")
    named = join_spread(named, roots, "root", "nodes").select("embedding", "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    done = join_spread(able.select("id", "embedding"), cut(named, "classes"), "embedding").select("id", "n_links", "component_id")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
