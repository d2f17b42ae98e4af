"""The keyspace as tables: one row per element, keys as columns, and expiry beside the key.

Operators take the frame of one type and work on all its keys at once.  A clock is an argument (``now_ms``), so a plan
gives the same rows whenever it runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMAS = {
    "keys": "db tinyint, key string, type string, expire_at_ms bigint, version bigint",
    "strings": "db tinyint, key string, value binary",
    "lists": "db tinyint, key string, pos bigint, value string",
    "hashes": "db tinyint, key string, field string, value string",
    "sets": "db tinyint, key string, member string",
    "zsets": "db tinyint, key string, member string, score double",
    "streams": "db tinyint, key string, ms decimal(20,0), seq decimal(20,0), fields array<struct<field:string,value:string>>",
    "command_log": "seq bigint, db tinyint, key string, cmd string, args array<string>, ts_ms bigint",
}
TYPES = ["string", "list", "hash", "set", "zset", "stream"]


def live(frame: DataFrame, now_ms: int | Column, expiry: str = "expire_at_ms") -> DataFrame:
    """Rows that have not expired; the comparison reaches the scan."""
    at = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return frame.where(F.col(expiry).isNull() | (F.col(expiry) > at))


def require_type(frame: DataFrame, wanted: str, column: str = "type") -> DataFrame:
    """Fails with WRONGTYPE when a row is of another type."""
    wrong = F.col(column).isNotNull() & (F.col(column) != wanted)
    guard = F.when(wrong, F.raise_error(F.lit("WRONGTYPE Operation against a key holding the wrong kind of value")).cast("string")).otherwise(F.col(column))
    return frame.withColumn(column, guard)


def ranked(frame: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """Rows with their place, from 1, within their key.  Filter it as ``rn <= k`` and the plan keeps only k rows a key before the shuffle."""
    return frame.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


@dataclass
class Keyspace:
    """A snapshot: a frame of each type, and the database and clock that its operators read with."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    now_ms: int = 0
    db: int = 0

    def select(self, db: int) -> Keyspace:
        if not 0 <= db < 16:
            raise ValueError("DB index is out of range")
        return Keyspace(self.frames, self.now_ms, db)

    def __getitem__(self, name: str) -> DataFrame:
        frame = self.frames[name]
        return frame.where(F.col("db") == self.db) if "db" in frame.columns else frame
