"""Mixed command logs folded to state.  Logs of one kind of write have shorter ways, as plain aggregates, beside their type.

A log has (seq, key, cmd, args array<string>, ts_ms).  Order matters within a key only, so the fold runs key by key in Arrow
batches: sorted in the shuffle, one pass, holding one key's value.  A value has to fit a worker, as it does its command log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "key string, type string, expire_at_ms long, element string, value string, score double, pos long"
KINDS = {"SET": "string", "SETNX": "string", "APPEND": "string", "INCRBY": "string", "GETDEL": "string", "HSET": "hash", "HDEL": "hash", "HINCRBY": "hash", "SADD": "set", "SREM": "set", "ZADD": "zset", "ZREM": "zset", "ZINCRBY": "zset", "LPUSH": "list", "RPUSH": "list", "LPOP": "list", "RPOP": "list"}


class Value:
    """One key while its log is read."""

    def __init__(self) -> None:
        self.type: str | None = None
        self.expiry: int | None = None
        self.data: object = None

    def clear(self) -> None:
        self.type = self.expiry = self.data = None

    def apply(self, cmd: str, args: list[str], now: int) -> str | None:
        """Run one command; an error is returned and changes nothing."""
        if self.expiry is not None and self.expiry <= now:
            self.clear()
        kind = KINDS.get(cmd)
        if kind and self.type not in (None, kind) and cmd != "SET":
            return "WRONGTYPE Operation against a key holding the wrong kind of value"
        run = getattr(self, f"_{cmd.lower()}", None)
        if run is None:
            return f"ERR unknown command '{cmd}'"
        try:
            run(args, now)
        except (ValueError, IndexError) as e:
            return f"ERR {e}"
        if kind and kind != "string" and not self.data:
            self.clear()
        return None

    def _own(self, kind: str, empty: object) -> object:
        if self.type is None:
            self.type, self.data = kind, empty
        return self.data

    def _set(self, args: list[str], now: int) -> None:
        flags = [a.upper() for a in args[1:]]
        if ("NX" in flags and self.type is not None) or ("XX" in flags and self.type is None):
            return
        keep = self.expiry if "KEEPTTL" in flags else None
        for name, scale, base in (("EX", 1000, now), ("PX", 1, now), ("EXAT", 1000, 0), ("PXAT", 1, 0)):
            if name in flags:
                keep = base + int(args[flags.index(name) + 2]) * scale
        self.type, self.data, self.expiry = "string", args[0], keep

    def _setnx(self, args: list[str], now: int) -> None:
        self._set([args[0], "NX"], now)

    def _append(self, args: list[str], now: int) -> None:
        self._own("string", "")
        self.data += args[0]

    def _incrby(self, args: list[str], now: int) -> None:
        old, delta = (self.data if self.type else "0"), args[0]
        if str(int(old)) != old or str(int(delta)) != delta or not -(1 << 63) <= int(old) + int(delta) < 1 << 63:
            raise ValueError("value is not an integer or out of range")
        self._own("string", "0")
        self.data = str(int(old) + int(delta))

    def _getdel(self, args: list[str], now: int) -> None:
        self.clear()

    _del = _getdel

    def _hset(self, args: list[str], now: int) -> None:
        if not args or len(args) % 2:
            raise ValueError("wrong number of arguments")
        self._own("hash", {}).update(zip(args[::2], args[1::2], strict=True))

    def _hdel(self, args: list[str], now: int) -> None:
        for f in args:
            (self.data or {}).pop(f, None)

    def _hincrby(self, args: list[str], now: int) -> None:
        total = int((self.data or {}).get(args[0], "0")) + int(args[1])
        if not -(1 << 63) <= total < 1 << 63:
            raise ValueError("increment or decrement would overflow")
        self._own("hash", {})[args[0]] = str(total)

    def _sadd(self, args: list[str], now: int) -> None:
        self._own("set", {}).update(dict.fromkeys(args))

    def _srem(self, args: list[str], now: int) -> None:
        self._hdel(args, now)

    def _zadd(self, args: list[str], now: int) -> None:
        flags = set()
        while args and args[0].upper() in ("NX", "XX", "GT", "LT", "CH", "INCR"):
            flags.add(args[0].upper())
            args = args[1:]
        if "NX" in flags and flags & {"XX", "GT", "LT"} or {"GT", "LT"} <= flags:
            raise ValueError("GT, LT, and/or NX options at the same time are not compatible")
        scores = [float(s) for s in args[::2]]
        if any(s != s for s in scores):
            raise ValueError("value is not a valid float")
        own = self._own("zset", {})
        for new, member in zip(scores, args[1::2], strict=True):
            old = own.get(member)
            if "INCR" in flags:
                new += old or 0.0
                if new != new:
                    raise ValueError("resulting score is not a number (NaN)")
            if old is None and "XX" in flags or old is not None and ("NX" in flags or "GT" in flags and new <= old or "LT" in flags and new >= old):
                continue
            own[member] = new

    def _zincrby(self, args: list[str], now: int) -> None:
        self._zadd(["INCR", *args], now)

    def _zrem(self, args: list[str], now: int) -> None:
        self._hdel(args, now)

    def _lpush(self, args: list[str], now: int) -> None:
        self._own("list", [])[:0] = reversed(args)

    def _rpush(self, args: list[str], now: int) -> None:
        self._own("list", []).extend(args)

    def _lpop(self, args: list[str], now: int) -> None:
        del (self.data or [])[: int(args[0]) if args else 1]

    def _rpop(self, args: list[str], now: int) -> None:
        n = int(args[0]) if args else 1
        if n and self.data:
            del self.data[-n:]

    def _pexpireat(self, args: list[str], now: int) -> None:
        at, flag = int(args[0]), (args[1].upper() if len(args) > 1 else None)
        old = self.expiry
        fits = {None: True, "NX": old is None, "XX": old is not None, "GT": old is not None and at > old, "LT": old is None or at < old}[flag]
        if self.type is not None and fits:
            self.expiry = at

    def _pexpire(self, args: list[str], now: int) -> None:
        self._pexpireat([str(now + int(args[0])), *args[1:]], now)

    def _expire(self, args: list[str], now: int) -> None:
        self._pexpireat([str(now + int(args[0]) * 1000), *args[1:]], now)

    def _persist(self, args: list[str], now: int) -> None:
        self.expiry = None

    def rows(self, key: str) -> list[tuple]:
        head = (key, self.type, self.expiry)
        if self.type == "string":
            return [(*head, None, self.data, None, None)]
        if self.type == "list":
            return [(*head, None, v, None, i) for i, v in enumerate(self.data)]
        if self.type == "zset":
            return [(*head, m, None, s, None) for m, s in self.data.items()]
        return [(*head, f, v, None, None) for f, v in (self.data or {}).items()]


def _run(pdf: pd.DataFrame, now_ms: int) -> tuple[Value, list[tuple]]:
    value, errors = Value(), []
    ordered = pdf.sort_values("seq")
    for seq, cmd, args, ts in zip(ordered["seq"], ordered["cmd"], ordered["args"], ordered["ts_ms"], strict=True):
        error = value.apply(str(cmd).upper(), [str(a) for a in args], int(ts))
        if error:
            errors.append((int(seq), str(ordered["key"].iloc[0]), error))
    if value.expiry is not None and value.expiry <= now_ms:
        value.clear()
    return value, errors


def fold(log: DataFrame, now_ms: int) -> DataFrame:
    """The state that a mixed log leaves at ``now_ms``: a row for each element (see STATE)."""

    def state(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _run(pdf, now_ms)[0].rows(str(pdf["key"].iloc[0]))
        return pd.DataFrame(rows, columns=["key", "type", "expire_at_ms", "element", "value", "score", "pos"])

    return log.groupBy("key").applyInPandas(state, STATE)


def errors(log: DataFrame) -> DataFrame:
    """(seq, key, error) of commands that failed; each is alone in that, the others take effect."""

    def failed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_run(pdf, 0)[1], columns=["seq", "key", "error"])

    return log.groupBy("key").applyInPandas(failed, "seq long, key string, error string")


def from_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Commands in text form (``line``) as cmd and args, for logs that people write."""
    import shlex

    for pdf in batches:
        parts = [shlex.split(x) for x in pdf["line"]]
        out = pdf.drop(columns="line")
        out["cmd"], out["key"], out["args"] = [p[0].upper() for p in parts], [p[1] if len(p) > 1 else None for p in parts], [p[2:] for p in parts]
        yield out


def parse_lines(lines: DataFrame) -> DataFrame:
    """(seq, ts_ms, line) as a command log."""
    return lines.select("seq", "ts_ms", "line").mapInPandas(from_frames, "seq long, ts_ms long, cmd string, key string, args array<string>")


def live_rows(state: DataFrame, now_ms: int) -> DataFrame:
    return state.where(F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms))
