"""The folder that driver and executors share, and tables cut from their lineage in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import _text

BROADCAST_ROWS = 1_000_000  # of a few integers each, so about 32 MB as a hash table
HOT, HOT_ROWS = 100_000, 500


def quoted(name: str) -> Column:
    """The column of just this name, dots and blanks in it or not."""
    return F.col(f"`{name}`")


def others(docs: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``docs`` that none of ``names`` would replace, which upper and lower case do not tell apart."""
    return [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]


def with_made(docs: DataFrame, source: str, made: dict[str, str], start: Callable[[], Callable[[pa.Array], list[pa.Array]]], keep: bool = True) -> DataFrame:
    """``docs`` with columns ``made`` (name: type) in Python from the column ``source``, which stays if ``keep``.

    ``start`` is called once in a task and gives the function from the source to the arrays made.  Other columns go
    through under names of their own, so they may be called anything; those of a made name are replaced.
    """
    kept = [c for c in others(docs, list(made)) if keep or c != source]
    chosen = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], quoted(source).alias("source"))
    shape = chosen.select(*[f"c{i}" for i in range(len(kept))], *[F.lit(None).cast(t).alias(f"m{i}") for i, t in enumerate(made.values())]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *make(batch.column(len(kept)))], names=shape.names)
        _text.release()

    return chosen.mapInArrow(run, shape).toDF(*kept, *made)


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder in ``spark.checkpoint.dir``.  Where none is set, a local master gets a temporary one; a cluster's is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='keyloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/keyloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete what ``fresh_path`` or ``cut`` has made."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder and read back, so that lost executors lose nothing.

    ``paths`` gets the path, for callers that remove the table once it is used up.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_of(pieces: DataFrame, per_task: int) -> int:
    """Into how many tasks to deal few rows of large work: each its own up to four for each core, beyond that ``per_task`` together."""
    n, cores = pieces.count(), pieces.sparkSession.sparkContext.defaultParallelism
    return max(min(n, 4 * cores), n // per_task, 1)


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, marked for broadcast if its rows are counted and few; otherwise as it is, for a shuffled join."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def join_spread(rows: DataFrame, known: DataFrame, key: str, size: str = "n") -> DataFrame:
    """``rows`` with what ``known`` says of their key: a row for each key, ``size`` of which counts the key's rows and goes.

    Keys with more than one in ``HOT`` of the rows, fewer than ``HOT`` therefore, are sent to the rows, so that a key's
    rows never meet in one task; the others are joined by a shuffle.
    """
    total = known.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > max(total // HOT, HOT_ROWS)
    few, rest = known.where(hot).drop(size), known.where(~hot).drop(size)
    plain = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key)  # fewer than HOT rows
    return plain.unionByName(rows.join(F.broadcast(few), key))  # fewer than HOT rows


def carried(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns called c0, c1 and so on, for operators that add columns of their own."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def without(rows: DataFrame, gone: DataFrame, key: str, gone_key: str) -> DataFrame:
    """``rows`` whose key isn't in ``gone``; the rows stay where they are as long as ``gone`` is small enough to send round."""
    return rows.join(bounded(gone), rows[key] == gone[gone_key], "left_anti")
