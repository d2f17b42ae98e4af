"""Streams as Structured Streaming: stateful processors by key, windows, and stream-static joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyloom.operators import pubsub


class LastId(StatefulProcessor):
    """XADD on a stream: keeps a key's last id and passes entries with greater ones, in arrival order within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values("arrival")
        top = tuple(self.last.get()) if self.last.exists() else (0, 0)
        keep = []
        for ms, seq in zip(got["ms"], got["seq"], strict=True):
            ok = (int(ms), int(seq)) > top
            keep.append(ok)
            if ok:
                top = (int(ms), int(seq))
        self.last.update(top)
        yield got[keep][["key", "ms", "seq", "arrival"]].reset_index(drop=True)

    def close(self) -> None:
        pass


def xadd(entries: DataFrame) -> DataFrame:
    """Accepted entries of a stream (key, ms, seq, arrival); late ones, at or before the last id, are dropped."""
    return entries.groupBy("key").transformWithStateInPandas(LastId(), "key string, ms long, seq long, arrival long", "Append", "None")


class Group(StatefulProcessor):
    """XREADGROUP, XACK and XAUTOCLAIM of one (key, group) on a stream of actions.

    Rows (key, group, arrival, action, ms, seq, consumer, n, now_ms): ``add`` an entry, ``read`` up to n new ones as a
    consumer, ``ack`` an id, ``claim`` up to n entries that have been idle for ``ms`` milliseconds.  Deliveries come out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.new = handle.getMapState("new", "ms long, seq long", "arrival long")
        self.pending = handle.getMapState("pending", "ms long, seq long", "consumer string, delivery_ms long, deliveries long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for r in pd.concat(list(rows)).sort_values("arrival").itertuples():
            at = (int(r.ms), int(r.seq))
            if r.action == "add":
                self.new.updateValue(at, (int(r.arrival),))
            elif r.action == "ack":
                if self.pending.containsKey(at):
                    self.pending.removeKey(at)
            elif r.action == "read":
                for i in sorted(tuple(k) for k in self.new.keys())[: int(r.n)]:  # noqa: SIM118
                    self.new.removeKey(i)
                    self.pending.updateValue(i, (r.consumer, int(r.now_ms), 1))
                    out.append((*key, *i, r.consumer, 1))
            elif r.action == "claim":
                idle = sorted(tuple(k) for k, v in self.pending.iterator() if int(r.now_ms) - v[1] >= int(r.ms))
                for i in idle[: int(r.n)]:
                    times = self.pending.getValue(i)[2] + 1
                    self.pending.updateValue(i, (r.consumer, int(r.now_ms), times))
                    out.append((*key, *i, r.consumer, times))
        yield pd.DataFrame(out, columns=["key", "group", "ms", "seq", "consumer", "deliveries"])

    def close(self) -> None:
        pass


def consumer_groups(actions: DataFrame) -> DataFrame:
    return actions.groupBy("key", "group").transformWithStateInPandas(Group(), "key string, group string, ms long, seq long, consumer string, deliveries long", "Append", "None")


class Expiry(StatefulProcessor):
    """Expiry as timers: a key's latest deadline (key, expire_at_ms) is kept, and the key comes out once it has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = pd.concat(list(rows)).sort_values("arrival")["expire_at_ms"].iloc[-1]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if pd.isna(last):
            self.deadline.clear()
        else:
            self.deadline.update((int(last),))
            self.handle.registerTimer(int(last))
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "expired_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.deadline.clear()
        yield pd.DataFrame({"key": [key[0]], "expired_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def expiries(deadlines: DataFrame) -> DataFrame:
    return deadlines.groupBy("key").transformWithStateInPandas(Expiry(), "key string, expired_ms long", "Append", "ProcessingTime")


def publish(messages: DataFrame, subscriptions: DataFrame, patterns: list[str]) -> DataFrame:
    """Deliveries of a stream of messages to a static table of subscriptions."""
    return pubsub.deliveries(messages, subscriptions, patterns)


def windowed_counts(events: DataFrame, time: str, by: str, size: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by tumbling or sliding window, dropping what comes later than ``late``."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(window, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, time: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts by session: events of a key less than ``gap`` apart."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def serve_waiters(items: DataFrame, waiters: DataFrame) -> DataFrame:
    """BLPOP and its kin in a micro-batch: of each key the n-th waiter in line gets the n-th item."""
    from keyloom.keyspace import ranked

    return ranked(items, ["key"], [F.col("pos")]).join(ranked(waiters, ["key"], [F.col("since")]), ["key", "rn"]).drop("rn")


class Waiters(StatefulProcessor):
    """BLPOP, BRPOP and their kin on a stream: items and those who wait for them, in line and across batches.

    Rows (key, arrival, now_ms, action, value, waiter, until_ms, left): ``push`` a value to an end, ``wait`` for one from an
    end until a time (0: for ever), ``unblock`` a waiter, ``tick`` to tell the time.  Out come (key, waiter, value, outcome):
    ``served`` in the order in which they began to wait, ``timeout`` with the key's first row whose clock has reached the
    deadline, ``unblocked``.  The rows' clocks alone decide, so a replay gives the same replies.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "n long", "value string")
        self.line = handle.getMapState("line", "n long", "waiter string, until_ms long, left boolean")

    def _late(self, now_ms: int) -> list[tuple[str, None, str]]:
        late = [(n[0], w) for n, w in self.line.iterator() if 0 < w[1] <= now_ms]
        for n, _ in late:
            self.line.removeKey((n,))
        return [(w[0], None, "timeout") for _, w in sorted(late)]

    def _served(self) -> list[tuple[str, str, str]]:
        out, places = [], sorted(n[0] for n in self.items.keys())  # noqa: SIM118
        for n, w in sorted((n[0], tuple(w)) for n, w in self.line.iterator()):
            if not places:
                break
            at = places.pop(0 if w[2] else -1)
            out.append((w[0], self.items.getValue((at,))[0], "served"))
            self.items.removeKey((at,))
            self.line.removeKey((n,))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for r in pd.concat(list(rows)).sort_values("arrival").itertuples():
            out += self._late(int(r.now_ms))
            if r.action == "push":
                places = [n[0] for n in self.items.keys()]  # noqa: SIM118
                at = (min(places) - 1 if r.left else max(places) + 1) if places else 0
                self.items.updateValue((at,), (r.value,))
            elif r.action == "wait":
                self.line.updateValue((int(r.arrival),), (r.waiter, int(r.until_ms), bool(r.left)))
            elif r.action == "unblock":
                for n in [n for n, w in self.line.iterator() if w[0] == r.waiter]:
                    self.line.removeKey(n)
                    out.append((r.waiter, None, "unblocked"))
            out += self._served()
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "waiter", "value", "outcome"])

    def close(self) -> None:
        pass


def blocking_pops(actions: DataFrame) -> DataFrame:
    return actions.groupBy("key").transformWithStateInPandas(Waiters(), "key string, waiter string, value string, outcome string", "Append", "None")
