"""Token counts of flat, unindexed token files by a separator scan.

A token file is identifiers of two or four bytes, little-endian, one document after the other, each closed by an
end-of-document identifier; there is no index.  The files are cut into blocks; each block finds its separators in one
vectorised comparison, knowing nothing of other blocks.  A prefix scan over the blocks' summaries (separators so far, place
of the last one) then gives each block where its first document began and what number it has.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.llm import _text
from keyloom.llm._files import filesystem, open_new
from keyloom.llm._shared import cut, fresh_path, quoted, tasks_of

BLOCK = 4 << 20  # tokens looked through by one step of a task
PER_TASK = 16  # blocks that a task looks through one after the other, where there are many
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-pair tokenizers of this family cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """A byte-pair vocabulary of ranks (a file of base64 token and rank on each line); its end identifier is the first free one."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.end = max(ranks.values()) + 1
        self.dtype = "<u2" if self.end < 1 << 16 else "<u4"
        self.of = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """Identifiers of a text; none for null.  The whole text goes through at once."""
        if not text:
            return np.zeros(0, self.dtype)
        return np.array(self.of.encode_ordinary(text), self.dtype)


def write_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokenise ``docs`` into token files under ``folder``, one for each task.

    Returns (file, tokens, place, key): for every file its length in tokens, and for every document its place in it.
    Each attempt of a task writes a file of its own; only files in the result count.
    """
    chosen = docs.select(quoted(key).alias("id"), quoted(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Tokenizer(tokenizer)
        end = np.array([of.end], of.dtype).tobytes()
        uri, out, ids = "", None, []
        for batch in batches:
            for k in range(batch.num_rows):
                if out is None:
                    uri, out = open_new(folder, "tokens")
                out.write(of.encode(batch.column(1)[k].as_py()).tobytes())
                out.write(end)
            ids.append(batch.column(0))
        if out is not None:
            tokens = out.tell() // np.dtype(of.dtype).itemsize
            out.close()
            ids = pa.concat_arrays(ids)
            yield pa.RecordBatch.from_pydict({"file": [uri] * len(ids), "tokens": [tokens] * len(ids), "place": np.arange(len(ids)), "id": ids})
        _text.release()

    schema = chosen.select(F.lit("").alias("file"), *[F.lit(0).cast("long").alias(c) for c in ("tokens", "place")], "id").schema
    return cut(chosen.mapInArrow(run, schema), "token-files").withColumnRenamed("id", key)


def scan(files: DataFrame, end: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Documents of token files (file, tokens): (file, place, start, n_tokens), the end identifier not counted.

    Tokens after a file's last separator are a document too, without an end.  An empty file has none.
    """
    width = np.dtype(dtype).itemsize
    steps = F.when(F.col("tokens") > 0, F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block).cast("long")))
    blocks = files.select("file", "tokens", F.explode(steps).alias("at"))
    blocks = blocks.repartition(tasks_of(blocks, PER_TASK), "file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, tokens, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as file:
                    ids = np.frombuffer(file.read_at(min(block, tokens - at) * width, at * width), dtype)
                ends = np.flatnonzero(ids == end) + at
                last = at + len(ids) == tokens and (not len(ids) or ids[-1] != end)
                ends = np.append(ends, tokens) if last else ends  # an open document at the end of the file
                yield pa.RecordBatch.from_pydict({"file": [uri], "at": [at], "ends": pa.array([ends.tolist()], pa.list_(pa.int64()))})

    summaries = cut(blocks.mapInArrow(run, "file string, at long, ends array<long>"), "separators")
    before = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    thin = summaries.select("file", "at", F.size("ends").alias("n"), F.element_at(F.col("ends"), F.when(F.size("ends") > 0, -1)).alias("last"))
    carried = thin.select("file", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open"))
    joined = summaries.join(carried, ["file", "at"])
    each = joined.select("file", "first", "open", "ends", F.posexplode("ends").alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    return each.select("file", (F.col("first") + F.col("k")).cast("long").alias("place"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """(key, n_tokens) of every row of ``docs``, by way of token files in the shared folder.

    Null and empty texts have no tokens; repeated rows and null keys, of any type, come back as they are.  An empty table
    gives an empty result, and other columns are ignored.  A text goes through the tokenizer whole: of a very long one a
    task holds the text and four bytes for each token.
    """
    spark: SparkSession = docs.sparkSession
    of = Tokenizer(tokenizer)
    written = write_files(docs.select(quoted(key).alias("key"), quoted(text).alias("text")), fresh_path(spark, "tokens"), "key", "text", tokenizer)
    files = written.select("file", "tokens").where("place = 0")
    counted = scan(files, of.end, of.dtype, block)
    return written.join(counted, ["file", "place"]).select(F.col("key").alias(key), "n_tokens")
