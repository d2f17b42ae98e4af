"""Which words of a command are keys, as an expression over a log's rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where commands have their keys, counted from the word behind the name; a last place below 0 counts from the
# end.  Commands that are not listed have one key, their first word, or none.
NONE = "PING ECHO AUTH HELLO QUIT RESET SELECT DBSIZE FLUSHDB FLUSHALL KEYS SCAN RANDOMKEY MULTI EXEC DISCARD UNWATCH SAVE BGSAVE LASTSAVE INFO ROLE CONFIG CLIENT COMMAND LATENCY SLOWLOG MONITOR WAIT SCRIPT FUNCTION PUBLISH SUBSCRIBE UNSUBSCRIBE PSUBSCRIBE PUNSUBSCRIBE PUBSUB CLUSTER READONLY READWRITE SHUTDOWN"
RANGES = {
    (0, -1, 1): "DEL UNLINK EXISTS TOUCH MGET WATCH SINTER SUNION SDIFF SINTERSTORE SUNIONSTORE SDIFFSTORE",
    (0, -1, 2): "MSET MSETNX",
    (0, 1, 1): "RENAME RENAMENX COPY SMOVE LMOVE BLMOVE RPOPLPUSH BRPOPLPUSH LCS ZRANGESTORE GEOSEARCHSTORE",
    (0, -2, 1): "BLPOP BRPOP BZPOPMIN BZPOPMAX",
    (1, -1, 1): "BITOP",
    (1, 1, 1): "XGROUP XINFO OBJECT",
}
COUNTED = {  # place of the number of keys, which follow it, and whether a destination is the first word
    (0, False): "ZUNION ZINTER ZDIFF ZINTERCARD SINTERCARD LMPOP ZMPOP",
    (0, True): "",
    (1, False): "EVAL EVAL_RO EVALSHA EVALSHA_RO FCALL FCALL_RO BLMPOP BZMPOP",
    (1, True): "ZUNIONSTORE ZINTERSTORE ZDIFFSTORE",
}


def command_keys(cmd: Column, words: Column) -> Column:
    """Keys among the words behind a command's name, in order: by its places, its count of keys, or what follows STREAMS or STORE."""
    n, name = F.size(words), F.upper(cmd)
    none = F.array().cast("array<string>")
    cut = lambda first, many: F.when((many > 0) & (n > first), F.slice(words, first + 1, F.least(many, n - first))).otherwise(none)
    upper = F.transform(words, lambda w: F.upper(w))
    out = F.when(name.isin(NONE.split()), none)
    for (first, last, step), names in RANGES.items():
        own = cut(F.lit(first), (n + last if last < 0 else F.lit(last)) - first + 1)
        out = out.when(name.isin(names.split()), own if step == 1 else F.filter(own, lambda w, i: i % 2 == 0))
    for (at, target), names in COUNTED.items():
        if names:
            many = F.coalesce(F.get(words, F.lit(at)).try_cast("int"), F.lit(0))
            counted = cut(F.lit(at + 1), many)
            out = out.when(name.isin(names.split()), F.concat(cut(F.lit(0), F.lit(1)), counted) if target else counted)
    begin = F.array_position(upper, "STREAMS").cast("int")
    out = out.when(name.isin("XREAD", "XREADGROUP"), F.when(begin > 0, cut(begin, F.floor((n - begin) / 2).cast("int"))).otherwise(none))
    stored = F.greatest(F.array_position(upper, "STORE"), F.array_position(upper, "STOREDIST")).cast("int")
    out = out.when(name.isin("SORT", "GEORADIUS", "GEORADIUSBYMEMBER"), F.concat(cut(F.lit(0), F.lit(1)), F.when(stored > 0, cut(stored, F.lit(1))).otherwise(none)))
    return out.otherwise(cut(F.lit(0), F.lit(1)))
