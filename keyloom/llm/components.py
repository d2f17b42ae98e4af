"""Connected components by repeated contraction, without collecting nodes, links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm._shared import cut, join_spread, remove


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph of ``edges`` (src, dst; 64-bit integers).

    Returns (node, component): every node that has a link to another one, with the smallest node of its component.
    Loops, repeated links and links with a null end are ignored; without links the result is empty.

    Each round every node moves to the best of its neighbours and itself, by number in even rounds (which folds stars
    onto their smallest node at once) and by a fresh hash in odd ones (which halves long chains), and links are drawn
    anew between what remains.  Choosing is a minimum with partial sums, so a node of many links does not weigh on one
    task, and the joins around it are ones that adaptive execution can split.
    """
    used: list[str] = []
    edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    edges = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "links", used)
    spark = edges.sparkSession
    labels, k = None, 0
    while not edges.isEmpty():
        rank = (lambda c: c) if k % 2 == 0 else (lambda c, k=k: F.xxhash64(c, F.lit(k)))
        ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")).select("e.*")
        best = ends.groupBy("node").agg(F.min_by("other", rank(F.col("other"))).alias("other"))
        moved = cut(best.select("node", F.when(rank(F.col("other")) < rank(F.col("node")), F.col("other")).otherwise(F.col("node")).alias("to")), f"moves{k}", used)
        drawn = edges.join(moved.toDF("src", "a"), "src").join(moved.toDF("dst", "b"), "dst").where("a <> b")
        edges = cut(drawn.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), f"links{k}", used)
        if labels is None:
            labels = moved.toDF("node", "label")
        else:
            labels = cut(labels.join(moved.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"labels{k}", used)
        k += 1
    if labels is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    least = cut(labels.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n")), "least", used)
    out = cut(join_spread(labels, least, "label").select("node", "component"), "components")
    for path in used:
        remove(spark, path)
    return out
