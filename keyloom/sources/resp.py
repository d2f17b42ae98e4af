"""Command logs in the wire format: arrays of length-prefixed texts, as in append-only files.

Files are read by Spark's own binary reader, so any store that Spark knows will do; a file is one task, of 2 GB at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.glob import glob_match

LOG = "file string, seq long, db int, key string, cmd string, args array<string>"


def parse(raw: bytes) -> Iterator[list[bytes]]:
    """Commands of a log: arrays, and inline lines of words; a last command that breaks off is left out."""
    at, n = 0, len(raw)
    while at < n:
        end = raw.find(b"\r\n", at)
        if end < 0:
            return
        line, at = raw[at:end], end + 2
        if not line:
            continue
        if line[:1] != b"*":
            yield line.split()
            continue
        parts = []
        for _ in range(int(line[1:])):
            end = raw.find(b"\r\n", at)
            if end < 0 or raw[at : at + 1] != b"$":
                if end < 0:
                    return
                raise ValueError("Protocol error: expected '$'")
            size = int(raw[at + 1 : end])
            if end + 4 + size > n:
                return
            parts.append(raw[end + 2 : end + 2 + size])
            at = end + 4 + size
        yield parts


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, db, key, cmd, args): commands in order of each file, with the database that SELECT left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                db, rows = 0, []
                for seq, parts in enumerate(parse(bytes(content))):
                    words = [p.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode() for p in parts]
                    if words and words[0].upper() == "SELECT":
                        db = int(words[1])
                    elif words:
                        rows.append((file, seq, db, words[1] if len(words) > 1 else None, words[0].upper(), words[2:]))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["file", "seq", "db", "key", "cmd", "args"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "seq", "db", "key", "cmd", "args"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, LOG)


def encode(cmd: Column, key: Column, args: Column) -> Column:
    """A command in the wire format, without its last line end."""
    words = F.concat(F.array(cmd, key), F.coalesce(args, F.array().cast("array<string>")))
    bulk = F.transform(words, lambda w: F.concat(F.lit("$"), F.octet_length(w).cast("string"), F.lit("\r\n"), w))
    return F.concat(F.lit("*"), F.size(words).cast("string"), F.lit("\r\n"), F.array_join(bulk, "\r\n"))


def write_log(log: DataFrame, path: str) -> None:
    """A log (seq, key, cmd, args) as files in the wire format, in order within each."""
    lines = log.repartitionByRange("seq").sortWithinPartitions("seq").select(encode(F.col("cmd"), F.col("key"), F.col("args")).alias("value"))
    lines.write.option("lineSep", "\r\n").text(path)


def monitor(log: DataFrame, pattern: str = "*") -> DataFrame:
    """MONITOR: the log as lines, of keys that match."""
    words = F.transform(F.concat(F.array("cmd", "key"), "args"), lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    return log.where(glob_match(F.col("key"), pattern)).select("seq", F.array_join(words, " ").alias("line"))


def numbered(log: DataFrame) -> DataFrame:
    """A log of several files with one running ``seq``, by file and place."""
    return log.withColumn("seq", F.row_number().over(W.orderBy("file", "seq")) - 1)
