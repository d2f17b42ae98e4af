"""Snapshots on disk, and transactions over them.

A store is a directory of numbered versions of Parquet tables and a pointer to the current one.  A save writes a new
version and moves the pointer by a rename, so readers see whole versions only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """The current version, 0 before the first save."""
        if not self._fs.exists(self._hadoop(self.path)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.path))]
        return max([int(n[8:]) for n in names if n.startswith("current-")], default=0)

    def save(self, frames: dict[str, DataFrame]) -> int:
        """SAVE, BGSAVE: all tables as the next version."""
        n = self.version() + 1
        for name, df in frames.items():
            df.write.parquet(f"{self.path}/v{n}/{name}")
        mark = self._hadoop(f"{self.path}/.current-{n}")
        self._fs.create(mark).close()
        if not self._fs.rename(mark, self._hadoop(f"{self.path}/current-{n}")):
            raise RuntimeError("another save took this version")
        return n

    def lastsave(self) -> int:
        """LASTSAVE: seconds since 1970 of the current version."""
        n = self.version()
        return self._fs.getFileStatus(self._hadoop(f"{self.path}/current-{n}")).getModificationTime() // 1000 if n else 0

    def load(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version or self.version()}/{name}")

    def changes(self, name: str, since: int, until: int | None = None) -> DataFrame:
        """The feed of changes between two versions of a table: its rows with ``change`` + for those that came and - for those that went."""
        old, new = self.load(name, since), self.load(name, until)
        came, went = new.exceptAll(old), old.exceptAll(new)
        return came.withColumn("change", F.lit("+")).unionByName(went.withColumn("change", F.lit("-")))

    def compact(self, name: str, files: int, by: str = "key") -> DataFrame:
        """A table rewritten as few files clustered by key, for range pruning; save the result as a new version."""
        return self.load(name).repartitionByRange(files, by).sortWithinPartitions(by)


def due(policies: list[tuple[int, int]], changes: int, last_save: int, now: int | None = None) -> bool:
    """Whether a policy (seconds, changes) asks for a save."""
    at = int(time.time()) if now is None else now
    return any(changes >= c and at - last_save >= s for s, c in policies)


@dataclass
class Transaction:
    """MULTI ... EXEC over one snapshot of frames.

    Commands are functions (frames -> (frames, reply)).  They run in order, each on what the one before left; one that
    raises gives its error as the reply and changes nothing, and the others stand.  ``watch`` notes versions of keys; when
    one differs at EXEC the reply is None and nothing runs.
    """

    frames: dict[str, DataFrame]
    watched: dict[str, int | None] = field(default_factory=dict)
    queue: list[Callable[[dict[str, DataFrame]], tuple[dict[str, DataFrame], object]]] = field(default_factory=list)

    def _versions(self, keys: list[str]) -> dict[str, int | None]:
        rows = self.frames["keys"].where(F.col("key").isin(keys)).select("key", "version").collect()  # the watched keys
        found = {r["key"]: r["version"] for r in rows}
        return {k: found.get(k) for k in keys}

    def watch(self, *keys: str) -> None:
        self.watched |= self._versions(list(keys))

    def unwatch(self) -> None:
        self.watched = {}

    def multi(self, command: Callable[[dict[str, DataFrame]], tuple[dict[str, DataFrame], object]]) -> None:
        self.queue.append(command)

    def discard(self) -> None:
        self.queue, self.watched = [], {}

    def exec(self, current: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], list | None]:
        """The frames after, and the replies.  ``current`` is the snapshot at this moment, if it may have moved on."""
        before = self.watched
        if current is not None:
            self.frames = current
        if before and self._versions(list(before)) != before:
            self.discard()
            return self.frames, None
        frames, replies = dict(self.frames), []
        for command in self.queue:
            try:
                frames, reply = command(dict(frames))
            except Exception as e:  # noqa: BLE001  a child's failure is its reply
                reply = e
            replies.append(reply)
        self.discard()
        return frames, replies
