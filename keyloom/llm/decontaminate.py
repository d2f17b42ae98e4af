"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Finds the short test items whose word shingles a document holds to a share of at least ``CONTAINMENT``.  Items are dealt
into partitions by size (powers of two of their shingle counts).  An item's MinHash sketch is its smallest shingle hashes,
as many as its partition needs: with n shingles and share t, a document that holds t * n of them misses at most
n - ceil(t * n), so it holds one of any n - ceil(t * n) + 1, and no contained item is lost.  Documents stay whole: each
of their shingles' hashes is looked up among the sketches, which is one join of all shingles with a table that grows
with the benchmark alone.  Pairs found are then counted over the exact shingles.

Only DataFrame functions are used.  Words are split at white space after ``lower``; an item of fewer than ``WIDTH``
words is one shingle of all its words, looked up among the documents' runs of that many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm._shared import bounded, cut, quoted, without

WIDTH = 5
CONTAINMENT = 0.8
SPACES = r"[\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """Lower-cased words; none for null and for texts of white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` words, in order, repeats included."""
    heads = F.sequence(F.lit(0), F.size(words) - width)
    runs = F.transform(heads, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def shingles(words: Column, width: int) -> Column:
    """The runs themselves, as strings."""
    heads = F.sequence(F.lit(0), F.size(words) - width)
    runs = F.transform(heads, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, runs).otherwise(F.array().cast("array<string>"))


def item_shingles(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(item, version, width, n, need, sketch, h, shingle): one row for each different shingle of an item.

    n counts an item's shingles, need of them have to be found, and ``sketch`` marks those of its MinHash sketch.
    Items without words, or with a null key, have none.  Rows with one key and different words are items of their own:
    ``version`` tells them apart.
    """
    words = items.where(quoted(key).isNotNull()).select(quoted(key).alias("item"), word_array(quoted(text)).alias("w"))
    words = words.distinct().withColumn("version", F.xxhash64("w"))
    parts = [words.where(F.size("w") >= width).select("item", "version", F.lit(width).alias("width"), F.explode(shingles(F.col("w"), width)).alias("shingle"))]
    parts += [words.where(F.size("w") == k).select("item", "version", F.lit(k).alias("width"), F.concat_ws(" ", "w").alias("shingle")) for k in range(1, width)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = rows.distinct()
    pieces = F.split("shingle", " ")
    h = F.when(F.col("width") == width, F.xxhash64(*[F.get(pieces, F.lit(k)) for k in range(width)]))
    for k in range(1, width):
        h = h.when(F.col("width") == k, F.xxhash64(*[F.get(pieces, F.lit(i)) for i in range(k)]))
    rows = rows.withColumn("h", h)
    # a benchmark item is short: its shingles are sorted as one array
    grouped = rows.groupBy("item", "version", "width").agg(F.array_sort(F.collect_list(F.struct("h", "shingle"))).alias("s"))
    n = F.size("s")
    need = F.ceil(n * F.lit(CONTAINMENT) - 1e-9).cast("int")
    top = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")  # the partition's largest size
    size = F.least(n, top - F.ceil(top * F.lit(CONTAINMENT) - 1e-9).cast("int") + 1)
    laid = grouped.select("item", "version", "width", n.alias("n"), need.alias("need"), size.alias("size"), F.posexplode("s").alias("at", "e"))
    return laid.select("item", "version", "width", "n", "need", (F.col("at") < F.col("size")).alias("sketch"), F.col("e.h").alias("h"), F.col("e.shingle").alias("shingle"))


TEXT = ["t1", "t2", "t3"]


def _same_text(text: Column) -> list[Column]:
    """96 bits of hash and the length: rows of equal text share these, and so one decision."""
    return [F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), F.coalesce(F.length(text), F.lit(-1)).alias("t3")]


def contained(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """(t1, t2, t3, item, version, n, matched): the different texts of ``docs`` and the items contained in them."""
    of_items = cut(item_shingles(items, item_key, item_text, width), "items")
    widths = sorted(r["width"] for r in of_items.select("width").distinct().collect())  # at most ``width`` rows
    sketch = of_items.where("sketch").select("width", "h", "item", "version")
    texts = docs.select(quoted(text).alias("text")).where("text is not null")
    hashed = texts.select(*_same_text(F.col("text")), word_array(F.col("text")).alias("w"))
    found = None
    for k in widths:
        runs = hashed.select(*TEXT, F.explode(shingle_hashes(F.col("w"), k)).alias("h"))
        hits = runs.join(bounded(sketch.where(F.col("width") == k).select("h", "item", "version")), "h").select(*TEXT, "item", "version")
        found = hits if found is None else found.union(hits)
    if found is None:
        return texts.select(*_same_text(F.col("text"))).limit(0).select(*TEXT, F.lit(0).alias("item"), F.lit(0).alias("version"), F.lit(0).alias("n"), F.lit(0).alias("matched"))
    candidates = cut(found.distinct(), "candidates")
    pairs = candidates.join(of_items.groupBy("item", "version", "width").agg(F.max("n").alias("n"), F.max("need").alias("need"), F.collect_list("shingle").alias("of_item")), ["item", "version"])
    whole = texts.select(*_same_text(F.col("text")), "text")
    own = whole.join(bounded(candidates.select(*TEXT).distinct()), TEXT, "left_semi").dropDuplicates(TEXT)
    own = own.select(*TEXT, word_array(F.col("text")).alias("w"))
    checked = None
    for k in widths:
        per = own.select(*TEXT, F.array_distinct(shingles(F.col("w"), k)).alias("of_doc")).join(pairs.where(F.col("width") == k), TEXT)
        per = per.select(*TEXT, "item", "version", "n", "need", F.size(F.array_intersect("of_item", "of_doc")).alias("matched"))
        checked = per if checked is None else checked.union(per)
    return checked.where("matched >= need").select(*TEXT, "item", "version", "n", "matched")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document row and item contained in it: (key, item_key, item_shingles, matched).

    Equal texts give equal rows, null keys come back as null, and texts that are null or without words contain nothing.
    Repeated items count once; of items with one key and different words each that is contained gives its row.  Items that
    are null, without words or without a key are in nothing, and empty tables give an empty result.  Other columns are
    ignored, whatever their names.
    """
    held = cut(contained(docs, items, text, item_key, item_text, width), "contained")
    rows = docs.select(quoted(key).alias("id"), *_same_text(quoted(text)))
    joined = rows.join(bounded(held), TEXT)
    return joined.select(F.col("id").alias(key), F.col("item").alias(item_key), F.col("n").cast("long").alias("item_shingles"), F.col("matched").cast("long").alias("matched"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs``, all columns whatever their names, without the rows whose text contains an item; rows and items count as in ``contamination``."""
    held = cut(contained(docs, items, text, item_key, item_text, width).select(F.struct(*TEXT).alias("gone")).distinct(), "contained")
    named = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), F.struct(*_same_text(quoted(text))).alias("of_text"))
    return without(named, held, "of_text", "gone").select("row.*")
