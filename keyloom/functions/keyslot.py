"""Hash slots: CRC16 of a key, or of its part in braces, over 16384 slots."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 16384


@lru_cache(maxsize=1)
def _table() -> list[int]:
    """CRC16 (polynomial 0x1021, most significant bit first) of each byte."""
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


def hash_tag(key: Column) -> Column:
    """What is between the first ``{`` and the next ``}`` if that is not empty, otherwise the key."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def keyslot(key: Column) -> Column:
    """Slot of a key, as a fold over its bytes."""
    table = F.array(*[F.lit(x) for x in _table()])
    digits = F.hex(hash_tag(key).cast("binary"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    crc = F.aggregate(places, F.lit(0), lambda acc, i: F.shiftleft(acc, 8).bitwiseAND(0xFFFF).bitwiseXOR(F.get(table, F.shiftright(acc, 8).bitwiseXOR(byte(i)).bitwiseAND(255))))
    return crc.bitwiseAND(SLOTS - 1)
