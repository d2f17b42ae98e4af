"""URL filters by a bit-parallel wildcard automaton.

All rules are glob patterns packed one behind the other into the bits of a few 64-bit words.  A state bit says that a
pattern's prefix matches what has been read; reading a character shifts all states at once, keeps those that the
character's mask allows (Shift-And), and lets stars keep theirs.  Thousands of URLs step together in numpy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm import _text
from keyloom.llm._shared import others, quoted, with_made

SLICE = 1 << 14  # URLs that step together
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # fits this host and all below it
    path: str  # and paths that begin so

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """Over ``.host/path``: ``*`` stands for any characters but a slash, ``**`` for any at all."""
        plain = "".join(f"\\{c}" if c in "*?\\" else c for c in f".{self.host}{self.path}")
        return f"*{plain}**"


class Automaton:
    """Glob patterns as bits.  ``?`` is any byte, ``*`` any run without a slash, ``**`` any run, ``\\`` takes the next byte as it is."""

    def __init__(self, globs: list[str]):
        places: list[tuple[bytes | None, str]] = []  # byte that leads into the state (None: any), kind of loop in it
        self.first, self.last = [], []
        for glob in globs:
            raw, at = glob.encode(), 0
            self.first.append(len(places))
            places.append((b"", ""))
            while at < len(raw):
                if raw[at : at + 2] == b"**":
                    places[-1] = (places[-1][0], "any")
                    at += 2
                elif raw[at : at + 1] == b"*":
                    places[-1] = (places[-1][0], places[-1][1] or "part")
                    at += 1
                elif raw[at : at + 1] == b"?":
                    places.append((None, ""))
                    at += 1
                else:
                    at += raw[at : at + 1] == b"\\" and at + 1 < len(raw)
                    places.append((raw[at : at + 1], ""))
                    at += 1
            self.last.append(len(places) - 1)
        self.words = max(1, -(-len(places) // 64))
        self.step, self.loop = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for i, (byte, loop) in enumerate(places):
            word, bit = divmod(i, 64)
            mask = np.uint64(1) << np.uint64(bit)
            if byte is None:
                self.step[:, word] |= mask
            elif byte:
                self.step[byte[0], word] |= mask
            if loop:
                self.loop[:, word] |= mask
                if loop == "part":
                    self.loop[ord("/"), word] &= ~mask
        for i in self.first:
            self.start[i // 64] |= np.uint64(1) << np.uint64(i % 64)

    def match(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Which patterns match the whole of each string: a row of booleans per string."""
        state = np.tile(self.start, (len(starts), 1))
        order = np.argsort(-lens, kind="stable")
        ordered = lens[order]
        for k in range(int(ordered[0]) if len(ordered) else 0):
            live = order[: np.searchsorted(-ordered, -k)]
            byte = data[starts[live] + k]
            now = state[live]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[live] = (shifted & self.step[byte]) | (now & self.loop[byte])
        last = np.array(self.last, np.int64)
        return (state[:, last // 64] >> (last % 64).astype(np.uint64)) & np.uint64(1) == 1


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null and where ``://`` is missing."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, shape, k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, UPPER.lower()), path


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict; columns of those names, in any case of letters, are replaced.

    Of the rules that fit, the one with the longest name wins, of equally long ones the longer host, then the first given.
    Null and empty URLs have empty parts, fit no rule and get ``default``.  Every row gives a row, repeated ones too, and
    an empty table an empty result; other columns may have any name.
    """
    best = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    kept = others(pages, ["host", "path", "rule", "verdict"])
    own = pages.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], *[c.alias(n) for c, n in zip(url_parts(quoted(url)), ("host", "path"), strict=True)])
    own = own.withColumn("name", F.concat(F.lit("."), "host", "path"))

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        automaton = Automaton([r.glob for r in best])
        names, verdicts = pa.array([*[r.name for r in best], None], pa.string()), pa.array([*[r.verdict for r in best], default], pa.string())

        def make(column: pa.Array) -> list[pa.Array]:
            won = []
            for at in range(0, len(column), SLICE):
                data, offsets = _text.column_bytes(column.slice(at, SLICE))
                fits = automaton.match(data, offsets[:-1], np.diff(offsets)) if best else np.zeros((len(offsets) - 1, 0), bool)
                won.append(np.concatenate([fits, np.ones((len(fits), 1), bool)], axis=1).argmax(axis=1))
            place = pa.array(np.concatenate([np.zeros(0, np.int64), *won]))
            return [names.take(place), verdicts.take(place)]

        return make

    done = with_made(own, "name", {"rule": "string", "verdict": "string"}, start, keep=False)
    return done.toDF(*kept, "host", "path", "rule", "verdict")
