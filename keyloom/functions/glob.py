"""Glob patterns as Java regular expressions, compiled on the driver and matched by ``rlike``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _class(pattern: str, at: int) -> tuple[str, int]:
    """Regular expression for the class that opens before ``at``, and where the pattern goes on."""
    negate = at < len(pattern) and pattern[at] == "^"
    at += negate
    ranges: list[tuple[str, str]] = []
    while at < len(pattern) and pattern[at] != "]":
        escaped = pattern[at] == "\\" and at + 1 < len(pattern)
        at += escaped
        low = pattern[at]
        at += 1
        if not escaped and at + 1 < len(pattern) and pattern[at] == "-":
            high = pattern[at + 1]  # even a bracket: the class then runs on
            at += 2
        else:
            high = low
        ranges.append((min(low, high), max(low, high)))
    body = "".join(f"\\x{{{ord(a):x}}}-\\x{{{ord(b):x}}}" for a, b in ranges)
    if not body:
        return ("[\\s\\S]" if negate else "(?!)"), min(at + 1, len(pattern))
    return f"[{'^' if negate else ''}{body}]", min(at + 1, len(pattern))


def glob_regex(pattern: str) -> str:
    """``*`` any run, ``?`` any character, ``[a-c]`` and ``[^a-c]`` classes, ``\\`` the next character as it is.

    Two old habits are kept: an unterminated class runs to the end of the pattern, and a pattern other than the empty one
    never matches the empty text.
    """
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif c == "[":
            part, at = _class(pattern, at)
            out += part
        else:
            if c == "\\" and at < len(pattern):
                c = pattern[at]
                at += 1
            out += f"\\x{{{ord(c):x}}}"
    return f"^(?!$){out}\\z" if pattern else "^\\z"


def glob_match(text: Column, pattern: str) -> Column:
    return text.rlike(glob_regex(pattern))


def like_any(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns match."""
    return sum((glob_match(text, p).cast("int") for p in patterns), F.lit(0))
