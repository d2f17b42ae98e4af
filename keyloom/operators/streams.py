"""Streams: rows (key, ms, seq, ...) in the order (ms, seq); groups and pending entries are frames of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.keyspace import ranked

ID = ["ms", "seq"]
MAX_SEQ = "18446744073709551615"


def _number(x: int | str) -> Column:
    """An id part: a long where it fits, so that the comparison reaches the scan, otherwise a decimal."""
    return F.lit(int(x)) if int(x) < 1 << 63 else F.lit(str(x)).cast("decimal(20,0)")


def _after(ms: Column, seq: Column, than: tuple, closed: bool) -> Column:
    a, b = _number(than[0]), _number(than[1])
    return (ms > a) | ((ms == a) & ((seq >= b) if closed else (seq > b)))


def id_after(than: tuple, closed: bool = False) -> Column:
    """Ids behind one; the bound on ``ms`` alone reaches the scan."""
    return (F.col("ms") >= _number(than[0])) & _after(F.col("ms"), F.col("seq"), than, closed)


def id_before(than: tuple, closed: bool = False) -> Column:
    return (F.col("ms") <= _number(than[0])) & ~_after(F.col("ms"), F.col("seq"), than, not closed)


def parse_id(text: str, end: bool = False) -> tuple[tuple[str, str], bool]:
    """((ms, seq), closed) of a range bound; an end without seq reaches to the last one of its ms."""
    if text in ("-", "+"):
        return (("0", "0") if text == "-" else (MAX_SEQ, MAX_SEQ)), True
    closed = not text.startswith("(")
    text = text.lstrip("(")
    if text in ("-", "+"):
        raise ValueError("Invalid stream ID specified as stream command argument")
    ms, _, seq = text.partition("-")
    return (ms, seq or (MAX_SEQ if end else "0")), closed


def auto_ids(log: DataFrame, order: str = "arrival") -> DataFrame:
    """XADD with ``*``: ids from the arrival clock ``ms``, never behind the last one; seq numbers those of one ms.

    The clock of a key runs as the greatest so far, so an entry that arrives with an older clock continues its sequence.
    """
    so_far = W.partitionBy("key").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    clocked = log.withColumn("ms", F.max("ms").over(so_far))
    within = W.partitionBy("key", "ms").orderBy(order)
    return clocked.withColumn("seq", F.row_number().over(within) - 1)


def accepted(log: DataFrame, order: str = "arrival") -> DataFrame:
    """XADD with ids: only entries whose id is greater than all before them in arrival order; 0-0 never is."""
    before = W.partitionBy("key").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    id_ = F.struct("ms", "seq")
    top = log.withColumn("_top", F.max(id_).over(before))
    return top.where((F.col("_top").isNull() | (id_ > F.col("_top"))) & ~((F.col("ms") == 0) & (F.col("seq") == 0))).drop("_top")


def partial_ids(log: DataFrame, order: str = "arrival") -> DataFrame:
    """XADD with ``ms-*``: entries whose ms is not behind any before them; seq numbers those of one ms."""
    so_far = W.partitionBy("key").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    kept = log.withColumn("_top", F.max("ms").over(so_far)).where(F.col("ms") == F.col("_top")).drop("_top")
    return kept.withColumn("seq", F.row_number().over(W.partitionBy("key", "ms").orderBy(order)) - 1)


def whole_id(text: Column) -> Column:
    """(ms, seq) of an id as XADD takes it: a bare ms means seq 0; the greatest id leaves none for ``*`` after it."""
    parts = F.split(text, "-")
    number = lambda c: c.try_cast("decimal(20,0)")
    wrong = F.raise_error(F.lit("ERR Invalid stream ID specified as stream command argument")).cast("decimal(20,0)")
    fits = lambda c: F.when(number(c).between(0, _number(MAX_SEQ)), number(c)).otherwise(wrong)
    return F.struct(fits(F.get(parts, F.lit(0))).alias("ms"), F.when(F.size(parts) == 1, F.lit(0).cast("decimal(20,0)")).when(F.size(parts) > 2, wrong).otherwise(fits(F.get(parts, F.lit(1)))).alias("seq"))


def next_id(last_ms: Column, last_seq: Column, now_ms: Column) -> Column:
    """(ms, seq) that ``*`` gives behind a last id: now, or the last one's successor; behind the greatest id there is none, an error."""
    top = _number(MAX_SEQ)
    full = F.raise_error(F.lit("ERR The stream has exhausted the last possible ID, unable to add more items")).cast("decimal(20,0)")
    last_ms, last_seq, now = (c.cast("decimal(20,0)") for c in (last_ms, last_seq, now_ms))
    ms = F.when(now > last_ms, now).when(last_seq < top, last_ms).when(last_ms < top, (last_ms + 1).cast("decimal(20,0)")).otherwise(full)
    seq = F.when((now <= last_ms) & (last_seq < top), (last_seq + 1).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    return F.struct(ms.alias("ms"), seq.alias("seq"))


def xadd(streams: DataFrame, log: DataFrame, order: str = "arrival", nomkstream: bool = False, maxlen: int | None = None, minid: str | None = None, node: int | None = None, limit: int | None = None) -> DataFrame:
    """XADD of a log with ids (key, ms, seq, ``order``, ...) to ``streams``: the rows after it.

    Only ids behind a stream's newest entry and behind all before them in the log are taken.  NOMKSTREAM leaves out keys
    without rows, MAXLEN or MINID trims afterwards, ``node`` and ``limit`` as in XTRIM.
    """
    if maxlen is not None and minid is not None:
        raise ValueError("syntax error, MAXLEN and MINID options at the same time are not compatible")
    tops = last_ids(streams)
    new = accepted(log, order).drop(order).join(tops, "key", "inner" if nomkstream else "left")
    behind = (F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq")))
    after = streams.unionByName(new.where(F.col("last_ms").isNull() | behind).drop("last_ms", "last_seq"))
    if maxlen is not None:
        return xtrim_maxlen(after, maxlen, node, limit)
    return after if minid is None else xtrim_minid(after, minid, node, limit)


def xlen(streams: DataFrame) -> DataFrame:
    return streams.groupBy("key").agg(F.count("*").alias("xlen"))


def xrange(streams: DataFrame, start: str = "-", end: str = "+", count: int | None = None, reverse: bool = False) -> DataFrame:
    """XRANGE, XREVRANGE by key: rows with their place ``pos``; a count of 0 or less gives none."""
    (low, low_closed), (high, high_closed) = parse_id(start), parse_id(end, True)
    rows = streams
    if start != "-":
        rows = rows.where(id_after(low, low_closed))
    if end != "+":
        rows = rows.where(id_before(high, high_closed))
    order = [F.col(c).desc() if reverse else F.col(c) for c in ID]
    placed = ranked(rows, ["key"], order, "pos")
    return placed if count is None else placed.where(F.col("pos") <= max(count, 0))


def xread(streams: DataFrame, cursors: DataFrame, count: int = 0) -> DataFrame:
    """XREAD: of every stream in ``cursors`` (key, last_ms, last_seq) the entries behind its cursor, ``count`` at most (0: all)."""
    behind = (F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq")))
    rows = streams.join(cursors, "key").where(behind).drop("last_ms", "last_seq")
    placed = ranked(rows, ["key"], [F.col(c) for c in ID], "pos")
    return placed.where(F.col("pos") <= count) if count > 0 else placed


def last_ids(streams: DataFrame) -> DataFrame:
    """The cursors that ``$`` means."""
    top = streams.groupBy("key").agg(F.max(F.struct(*ID)).alias("t"))
    return top.select("key", F.col("t.ms").alias("last_ms"), F.col("t.seq").alias("last_seq"))


def _whole_nodes(streams: DataFrame, spare: Column, node: int, limit: int | None) -> DataFrame:
    """Rows without the oldest nodes that lie within the ``spare`` rows (of n) and, together, within the limit (0: none)."""
    limit = min(max(100 * node, 1), 1_000_000) if limit is None else limit
    whole = lambda c: F.floor(c / node) * node
    gone = F.when(spare >= F.col("n"), F.col("n")).otherwise(whole(spare))  # the last node may be a part
    if limit:
        gone = F.when(gone <= limit, gone).otherwise(F.floor(F.lit(limit) / node) * node)
    sizes = streams.groupBy("key").agg(F.count("*").alias("n"))
    placed = ranked(streams, ["key"], [F.col(c) for c in ID]).join(sizes, "key")
    return placed.where(F.col("rn") > gone).drop("rn", "n")


def xtrim_maxlen(streams: DataFrame, maxlen: int, node: int | None = None, limit: int | None = None) -> DataFrame:
    """XTRIM MAXLEN: the newest rows stay; with ``~`` (a node size) only whole nodes of the oldest go, at most ``limit`` rows."""
    if node is None:
        if limit is not None:
            raise ValueError("syntax error, LIMIT cannot be used without the special ~ option")
        return ranked(streams, ["key"], [F.col(c).desc() for c in ID]).where(F.col("rn") <= maxlen).drop("rn")
    return _whole_nodes(streams, F.greatest(F.col("n") - maxlen, F.lit(0)), node, limit)


def xtrim_minid(streams: DataFrame, minid: str, node: int | None = None, limit: int | None = None) -> DataFrame:
    """XTRIM MINID: rows before the id go; with ``~`` as MAXLEN does."""
    bound = parse_id(minid)[0]
    if node is None:
        if limit is not None:
            raise ValueError("syntax error, LIMIT cannot be used without the special ~ option")
        return streams.where(id_after(bound, True))
    counted = streams.withColumn("_old", F.count_if(~id_after(bound, True)).over(W.partitionBy("key")))
    return _whole_nodes(counted, F.col("_old"), node, limit).drop("_old")


def xdel(streams: DataFrame, ids: DataFrame) -> DataFrame:
    return streams.join(ids, ["key", *ID], "left_anti")


def xsetid(meta: DataFrame, key: object, ms: int, seq: int, entries_added: int | None = None, max_deleted: tuple[int, int] | None = None) -> DataFrame:
    """XSETID: another last id of a stream (last_ms, last_seq of ``meta``), and with the options its counter and greatest deleted id.

    The id may not lie before the newest entry (top_ms, top_seq) nor, where ``meta`` has those columns, before the greatest
    deleted one (max_deleted_ms, max_deleted_seq); the counter not below the ``length``.
    """
    if max_deleted is not None and (ms, seq) < tuple(max_deleted):
        raise ValueError("The ID specified in XSETID is smaller than the provided max_deleted_entry_id")
    if entries_added is not None and entries_added < 0:
        raise ValueError("entries_added must be positive")
    here = F.col("key") == key
    less = lambda a, b: F.coalesce((F.col(a) > ms) | ((F.col(a) == ms) & (F.col(b) > seq)), F.lit(False))
    checks = [(less("top_ms", "top_seq"), "ERR The ID specified in XSETID is smaller than the target stream top item")]
    if "max_deleted_ms" in meta.columns:
        checks.append((less("max_deleted_ms", "max_deleted_seq"), "ERR The ID specified in XSETID is smaller than current max_deleted_entry_id"))
    if entries_added is not None and "length" in meta.columns:
        checks.append((F.col("length") > entries_added, "ERR The entries_added specified in XSETID is smaller than the target stream length"))
    value = F.lit(ms)
    for wrong, text in checks:
        value = F.when(wrong, F.raise_error(F.lit(text)).cast("bigint")).otherwise(value)
    new = {"last_ms": value, "last_seq": F.lit(seq)}
    if entries_added is not None:
        new["entries_added"] = F.lit(entries_added)
    if max_deleted is not None and any(max_deleted):
        new |= {"max_deleted_ms": F.lit(max_deleted[0]), "max_deleted_seq": F.lit(max_deleted[1])}
    return meta.select(*[F.when(here, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in meta.columns])


GROUP = ["key", "group"]


def xgroup_create(groups: DataFrame, key: object, group: str, ms: int = 0, seq: int = 0, entries_read: int | None = None) -> DataFrame:
    """XGROUP CREATE: one more group; a name in use is an error."""
    new = groups.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(group).alias("group"), F.lit(ms).alias("last_ms"), F.lit(seq).alias("last_seq"), F.lit(entries_read).cast("bigint").alias("entries_read"))
    busy = groups.select(*GROUP, F.lit(True).alias("busy"))
    checked = new.join(busy, GROUP, "left").withColumn("group", F.when(F.col("busy"), F.raise_error(F.lit("BUSYGROUP Consumer Group name already exists")).cast("string")).otherwise(F.col("group")))
    return groups.select(*new.columns).unionByName(checked.drop("busy"))


def xgroup_setid(groups: DataFrame, key: object, group: str, ms: int, seq: int) -> DataFrame:
    here = (F.col("key") == key) & (F.col("group") == group)
    return groups.withColumn("last_ms", F.when(here, F.lit(ms)).otherwise(F.col("last_ms"))).withColumn("last_seq", F.when(here, F.lit(seq)).otherwise(F.col("last_seq")))


def xgroup_destroy(frame: DataFrame, key: object, group: str) -> DataFrame:
    """Rows of other groups; for groups, consumers and pending entries alike."""
    return frame.where(~((F.col("key") == key) & (F.col("group") == group)))


def xgroup_createconsumer(consumers: DataFrame, key: object, group: str, consumer: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """XGROUP CREATECONSUMER on (key, group, consumer, seen_ms, active_ms): the rows after it, and ``created``, 1 or 0.  A new one has not been active."""
    new = consumers.sparkSession.range(1).select(F.lit(key).cast(consumers.schema["key"].dataType).alias("key"), F.lit(group).alias("group"), F.lit(consumer).alias("consumer"), F.lit(now_ms).cast("bigint").alias("seen_ms"), F.lit(0).cast("bigint").alias("active_ms"))
    new = new.join(consumers.select(*GROUP, "consumer"), [*GROUP, "consumer"], "left_anti")
    return consumers.unionByName(new), new.agg(F.count("*").alias("created"))


def xgroup_delconsumer(pel: DataFrame, key: object, group: str, consumer: str) -> tuple[DataFrame, DataFrame]:
    """Pending entries without the consumer's, and how many those were."""
    own = (F.col("key") == key) & (F.col("group") == group) & (F.col("consumer") == consumer)
    return pel.where(~own), pel.where(own).agg(F.count("*").alias("pending"))


def xreadgroup(streams: DataFrame, groups: DataFrame, pel: DataFrame, consumer: str, now_ms: int, count: int = 0, noack: bool = False, meta: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """XREADGROUP with ``>`` for every group: delivered entries, groups with new cursors, pending entries after it.

    An entry that is pending already, behind a cursor that was set back, becomes the consumer's as a first delivery.
    The number of entries read grows by those delivered; where ``meta`` (as in ``group_lag``) tells of a deletion at or
    behind them, or the number was unknown, it is estimated anew and may be null.
    """
    behind = (F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq")))
    rows = streams.join(groups.select(*GROUP, "last_ms", "last_seq"), "key").where(behind).drop("last_ms", "last_seq")
    placed = ranked(rows, GROUP, [F.col(c) for c in ID], "pos")
    out = placed.where(F.col("pos") <= count) if count > 0 else placed
    tops = out.groupBy(*GROUP).agg(F.max(F.struct(*ID)).alias("t"), F.min(F.struct(*ID)).alias("head"), F.count("*").alias("delivered"))
    both = groups.join(tops, GROUP, "left")
    read = F.col("entries_read") + F.coalesce("delivered", F.lit(0))
    if meta is not None:
        both = both.join(meta, "key", "left")
        sure = F.col("entries_read").isNotNull() & (F.col("max_deleted").isNull() | (F.col("max_deleted") < F.col("head")))
        clean = (F.col("max_deleted").isNull() | (F.col("max_deleted") < F.col("first"))) & (F.col("entries_added") >= F.col("length"))
        from_front = F.when(clean & (F.col("head") == F.col("first")), F.col("entries_added") - F.col("length") + F.col("delivered"))
        read = F.when(F.col("delivered").isNull(), F.col("entries_read")).when(sure, read).otherwise(F.coalesce(from_front, F.when(F.col("t") == F.col("top"), F.col("entries_added"))))
    moved = both.select(*GROUP, F.coalesce("t.ms", "last_ms").alias("last_ms"), F.coalesce("t.seq", "last_seq").alias("last_seq"), read.cast("bigint").alias("entries_read"))
    if noack:
        return out, moved, pel
    new = out.select(*GROUP, *ID, F.lit(consumer).alias("consumer"), F.lit(now_ms).cast("bigint").alias("delivery_ms"), F.lit(1).cast("bigint").alias("deliveries"))
    return out, moved, pel.join(new.select(*GROUP, *ID), [*GROUP, *ID], "left_anti").unionByName(new)


def xreadgroup_history(streams: DataFrame, pel: DataFrame, consumer: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """XREADGROUP with an id: the consumer's pending entries (``live`` false where deleted), and pending entries with their deliveries counted; deleted ones do not count."""
    there = streams.select("key", *ID, F.lit(True).alias("live"))
    both = pel.join(there, ["key", *ID], "left").withColumn("live", F.coalesce("live", F.lit(False)))
    again = (F.col("consumer") == consumer) & F.col("live")
    after = both.withColumn("deliveries", F.when(again, F.col("deliveries") + 1).otherwise(F.col("deliveries"))).withColumn("delivery_ms", F.when(again, F.lit(now_ms)).otherwise(F.col("delivery_ms")))
    return both.where(F.col("consumer") == consumer), after.drop("live")


def xack(pel: DataFrame, acks: DataFrame) -> DataFrame:
    """XACK: what stays pending."""
    return pel.join(acks, [*GROUP, *ID], "left_anti")


def xpending(pel: DataFrame) -> DataFrame:
    """XPENDING, the summary by group: how many, and the first and last id."""
    ids = F.struct(*ID)
    s = pel.groupBy(*GROUP).agg(F.count("*").alias("pending"), F.min(ids).alias("lo"), F.max(ids).alias("hi"))
    return s.select(*GROUP, "pending", F.col("lo.ms").alias("min_ms"), F.col("lo.seq").alias("min_seq"), F.col("hi.ms").alias("max_ms"), F.col("hi.seq").alias("max_seq"))


def xpending_consumers(pel: DataFrame) -> DataFrame:
    return pel.groupBy(*GROUP, "consumer").agg(F.count("*").alias("pending"))


def xpending_range(pel: DataFrame, now_ms: int, min_idle: int = 0, count: int = 10, consumer: str | None = None, start: str = "-", end: str = "+") -> DataFrame:
    """XPENDING, the range form: entries in id order with their idle time."""
    rows = pel.withColumn("idle", F.lit(now_ms) - F.col("delivery_ms")).where(F.col("idle") >= min_idle)
    if consumer is not None:
        rows = rows.where(F.col("consumer") == consumer)
    if start != "-":
        rows = rows.where(id_after(*parse_id(start)))
    if end != "+":
        rows = rows.where(id_before(*parse_id(end, True)))
    return ranked(rows, GROUP, [F.col(c) for c in ID]).where(F.col("rn") <= count).drop("rn")


def xclaim(pel: DataFrame, ids: DataFrame, streams: DataFrame, consumer: str, now_ms: int, min_idle: int, force: bool = False, justid: bool = False, retrycount: int | None = None, idle: int | None = None, time: int | None = None) -> DataFrame:
    """XCLAIM of ``ids`` (key, group, ms, seq): pending entries after it.

    Entries idle for long enough go to the consumer; those deleted from the stream go away; FORCE makes live ids pending
    that are not.  JUSTID leaves the number of deliveries.  IDLE and TIME say when the entries count as delivered, by
    default now and never later.  LASTID is ``advance`` on the groups.
    """
    at_ms = min(now_ms, time) if time is not None else now_ms - idle if idle is not None and idle <= now_ms else now_ms
    on = [*GROUP, *ID]
    live = streams.select("key", *ID, F.lit(True).alias("live"))
    asked = ids.select(*on, F.lit(True).alias("asked"))
    both = pel.join(asked, on, "left").join(live, ["key", *ID], "left")
    claims = F.col("asked") & F.col("live") & (F.lit(now_ms) - F.col("delivery_ms") >= min_idle)
    claims = F.coalesce(claims, F.lit(False))
    count = F.lit(retrycount).cast("bigint") if retrycount is not None else F.col("deliveries") + (0 if justid else 1)
    kept = both.where(F.col("asked").isNull() | F.col("live").isNotNull()).select(
        *on,
        F.when(claims, F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"),
        F.when(claims, F.lit(at_ms)).otherwise(F.col("delivery_ms")).cast("bigint").alias("delivery_ms"),
        F.when(claims, count).otherwise(F.col("deliveries")).alias("deliveries"),
    )
    if not force:
        return kept
    first = retrycount if retrycount is not None else 1 if justid else 2
    new = ids.join(pel, on, "left_anti").join(live, ["key", *ID]).select(*on, F.lit(consumer).alias("consumer"), F.lit(at_ms).cast("bigint").alias("delivery_ms"), F.lit(first).cast("bigint").alias("deliveries"))
    return kept.unionByName(new)


def advance(groups: DataFrame, key: object, group: str, ms: int, seq: int) -> DataFrame:
    """XCLAIM LASTID: the group's cursor at that id, unless it is there or behind already."""
    here = (F.col("key") == key) & (F.col("group") == group) & ((F.col("last_ms") < ms) | ((F.col("last_ms") == ms) & (F.col("last_seq") < seq)))
    return groups.withColumns({"last_ms": F.when(here, F.lit(ms)).otherwise(F.col("last_ms")), "last_seq": F.when(here, F.lit(seq)).otherwise(F.col("last_seq"))})


def _walk(pel: DataFrame, streams: DataFrame, now_ms: int, min_idle: int, count: int, start: str) -> DataFrame:
    """``pel`` from ``start`` on, with ``outcome`` (claimed, deleted or null) and whether XAUTOCLAIM gets as far as the row.

    It looks at ten times ``count`` entries at most, and claimed and deleted ones both use up the count.
    """
    if count <= 0:
        raise ValueError("COUNT must be > 0")
    rows = pel if start == "-" else pel.where(id_after(*parse_id(start)))
    live = streams.select("key", *ID, F.lit(True).alias("live"))
    placed = ranked(rows.join(live, ["key", *ID], "left"), GROUP, [F.col(c) for c in ID])
    outcome = F.when(F.col("live").isNull(), "deleted").when(F.lit(now_ms) - F.col("delivery_ms") >= min_idle, "claimed")
    before = W.partitionBy(*GROUP).orderBy(*ID).rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.count("outcome").over(before), F.lit(0))
    return placed.withColumn("outcome", outcome).withColumn("walked", (F.col("rn") <= 10 * count) & (used < count)).drop("rn", "live")


def xautoclaim(pel: DataFrame, streams: DataFrame, now_ms: int, min_idle: int, count: int = 100, start: str = "-") -> DataFrame:
    """XAUTOCLAIM of every group: (key, group, ms, seq, outcome) of the entries from ``start`` on that it claims or finds deleted."""
    return _walk(pel, streams, now_ms, min_idle, count, start).where("walked and outcome is not null").select(*GROUP, *ID, "outcome")


def xautoclaim_next(pel: DataFrame, streams: DataFrame, now_ms: int, min_idle: int, count: int = 100, start: str = "-") -> DataFrame:
    """The cursor XAUTOCLAIM returns for each group: the first entry that it did not get to, or 0-0."""
    rest = _walk(pel, streams, now_ms, min_idle, count, start).where("not walked").groupBy(*GROUP).agg(F.min(F.struct(*ID)).alias("i"))
    zero = lambda c: F.coalesce(F.col(f"i.{c}"), F.lit(0)).alias(f"next_{c}")
    return pel.select(*GROUP).distinct().join(rest, GROUP, "left").select(*GROUP, zero("ms"), zero("seq"))


def xautoclaim_pending(pel: DataFrame, streams: DataFrame, consumer: str, now_ms: int, min_idle: int, count: int = 100, start: str = "-", justid: bool = False) -> DataFrame:
    """Pending entries after XAUTOCLAIM: deleted ones gone, claimed ones the consumer's, delivered once more unless JUSTID."""
    done = xautoclaim(pel, streams, now_ms, min_idle, count, start)
    both = pel.join(done, [*GROUP, *ID], "left").where(F.col("outcome").isNull() | (F.col("outcome") == "claimed"))
    own = F.col("outcome").isNotNull()
    return both.select(*GROUP, *ID, F.when(own, F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"), F.when(own, F.lit(now_ms)).otherwise(F.col("delivery_ms")).cast("bigint").alias("delivery_ms"), (F.col("deliveries") + F.when(own, F.lit(int(not justid))).otherwise(F.lit(0))).alias("deliveries"))


def xinfo_consumers(consumers: DataFrame, pel: DataFrame, now_ms: int) -> DataFrame:
    """XINFO CONSUMERS of (key, group, consumer, seen_ms, active_ms): pending entries, idle and inactive time (-1: never active)."""
    counted = consumers.join(xpending_consumers(pel), [*GROUP, "consumer"], "left")
    inactive = F.when(F.col("active_ms") == 0, F.lit(-1)).otherwise(F.lit(now_ms) - F.col("active_ms"))
    return counted.select(*GROUP, "consumer", F.coalesce("pending", F.lit(0)).alias("pending"), F.greatest(F.lit(now_ms) - F.col("seen_ms"), F.lit(0)).alias("idle"), inactive.cast("bigint").alias("inactive"))


def xinfo_full(streams: DataFrame, groups: DataFrame, pel: DataFrame, count: int = 10) -> tuple[DataFrame, DataFrame]:
    """XINFO STREAM FULL: by key its length and first ``count`` ids (0: all), and by group its cursor, pending count and first pending ids with their consumers."""
    head = lambda rows, by: ranked(rows, by, [F.col(c) for c in ID]).where(F.col("rn") <= count if count > 0 else F.lit(True))
    ids = head(streams, ["key"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*ID))).alias("entries"))
    first = head(pel, GROUP).groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct(*ID, "consumer"))).alias("pending"))
    counted = pel.groupBy(*GROUP).agg(F.count("*").alias("pel_count"))
    of_groups = groups.join(counted, GROUP, "left").join(first, GROUP, "left")
    return xlen(streams).join(ids, "key"), of_groups.select(*GROUP, "last_ms", "last_seq", F.coalesce("pel_count", F.lit(0)).alias("pel_count"), "pending")


def xinfo_stream(streams: DataFrame) -> DataFrame:
    """XINFO STREAM: length, first and last id by key."""
    ids = F.struct(*ID)
    s = streams.groupBy("key").agg(F.count("*").alias("length"), F.min(ids).alias("lo"), F.max(ids).alias("hi"))
    return s.select("key", "length", F.col("lo.ms").alias("first_ms"), F.col("lo.seq").alias("first_seq"), F.col("hi.ms").alias("last_ms"), F.col("hi.seq").alias("last_seq"))


def group_lag(groups: DataFrame, meta: DataFrame) -> DataFrame:
    """XINFO GROUPS: entries not yet read by group, null where deletions make that unknown.

    ``meta`` has by key: length, entries_added, top (last id), first (first live id) and max_deleted ids as structs.
    """
    j = groups.join(meta, "key")
    at = F.struct(F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq"))
    added, n = F.col("entries_added"), F.col("length")
    clean = (F.col("max_deleted").isNull() | (F.col("max_deleted") < F.col("first"))) & (added >= n)
    guess = (
        F.when(((n == 0) & (at <= F.col("top"))) | (at == F.col("top")), added)
        .when((at > F.col("top")) | (n == 0), F.lit(None))
        .when(clean & (at < F.col("first")), added - n)
        .when(clean & (at == F.col("first")), added - n + 1)
    )
    known = F.col("entries_read").isNotNull() & (F.col("max_deleted").isNull() | (F.col("max_deleted") < at))
    read = F.when(known, F.col("entries_read")).otherwise(guess)
    lag = F.when(added == 0, F.lit(0)).when(read <= added, added - read)
    return j.select(*GROUP, lag.cast("bigint").alias("lag"))
