"""Vectorised text handling on Arrow string columns: ASCII lower-casing, words, word shingles and XXH64.

A *word* is a maximal run of bytes outside ``\\x20\\x09-\\x0D``.  Everything works on the UTF-8 buffer of a whole
Arrow column, cut into pieces of about ``PIECE`` bytes so that temporary arrays stay small whatever the batch holds: short
texts together, a long one in windows that end at white space.  Only a single word has to fit into memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE = 1 << 20  # bytes of text handled at once
SHINGLES = 1 << 18  # hashes made at once

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Words:
    """Words of consecutive texts: ``buffer`` has them one space apart; text i owns words first[i] to first[i + 1]."""

    buffer: np.ndarray
    starts: np.ndarray
    lens: np.ndarray
    first: np.ndarray


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the len + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts, each of at most ``size`` bytes or a single text."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts that ``offsets`` cut out of ``data``."""
    low = LOWER[data] if lower else data
    solid = ~SPACE[low]
    n = len(low)
    if not n or not solid.any():
        return Words(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(solid & ~before)
    lens = np.flatnonzero(solid & ~after) + 1 - starts
    first = np.searchsorted(starts, offsets)
    after_word = np.cumsum(lens + 1) - 1
    inside = np.ones(after_word[-1] + 1, bool)
    inside[after_word] = False
    buffer = np.full(len(inside), 0x20, np.uint8)
    buffer[inside] = low[solid]
    return Words(buffer, after_word - lens, lens, first)


def _first(of: np.ndarray, data: np.ndarray, at: int, stop: int) -> int:
    """The first place from ``at`` on whose byte belongs to ``of``, or ``stop``."""
    while at < stop:
        hit = np.flatnonzero(of[data[at : min(at + PIECE, stop)]])
        if len(hit):
            return at + int(hit[0])
        at += PIECE
    return stop


def cut_after(data: np.ndarray, at: int, stop: int) -> int:
    """The first place from ``at`` on where a word begins behind white space, or ``stop``."""
    return _first(~SPACE, data, _first(SPACE, data, at - 1, stop), stop)


def word_pieces(column: pa.Array | pa.ChunkedArray, back: int = 0, size: int | None = None) -> Iterator[tuple[int, int, Words, bool, bool]]:
    """(a, b, words, opens, closes) for pieces of a string column: the lower-cased words of texts a to b.

    A text of more than ``size`` bytes comes in several windows, of which the first ``opens`` and the last ``closes``.
    Each further window begins with the last ``back`` words of the one before, or all if it has fewer.
    """
    size = PIECE if size is None else size
    data, offsets = column_bytes(column)
    for a, b in pieces(offsets, size):
        at, stop = int(offsets[a]), int(offsets[b])
        end = cut_after(data, at + size, stop) if stop - at > size else stop
        if end == stop:
            yield a, b, split_words(data[at:stop], offsets[a : b + 1] - at), True, True
            continue
        opens = True
        while True:
            yield a, b, split_words(data[at:end], np.array([0, end - at])), opens, end == stop
            if end == stop:
                break
            if back:
                solid = ~SPACE[data[at:end]]
                solid[1:] &= ~solid[:-1]
                starts = np.flatnonzero(solid)
                at += int(starts[-back]) if len(starts) >= back else 0
            else:
                at = end
            opens, end = False, cut_after(data, min(end + size, stop), stop)


def release() -> None:
    """Hand memory that a task no longer needs back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_libc = ctypes.CDLL(None)


def shingle_spans(words: Words, width: int, closes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length in ``words.buffer`` of every shingle, and the len + 1 offsets of the texts' shingles.

    A text of fewer words than ``width`` has one shingle of all its words, a text without words none.  Of a window that
    does not close its text, so few words have none: they come again in the next one.
    """
    n = np.diff(words.first)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1) if closes else 0)
    cum = np.concatenate([[0], np.cumsum(many)])
    head = np.repeat(words.first[:-1] - cum[:-1], many) + np.arange(cum[-1])
    tail = np.minimum(head + width - 1, np.repeat(words.first[1:], many) - 1)
    starts = words.starts[head]
    return starts, words.starts[tail] + words.lens[tail] - starts, cum


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buffer: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many spans of ``buffer``; spans under 32 bytes together in numpy, longer ones by the library."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    lane8 = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    lane4 = np.ndarray((len(padded) - 3,), "<u4", padded, 0, (1,))
    h = np.uint64((seed + int(P5)) & 0xFFFFFFFFFFFFFFFF) + lens.astype(np.uint64)
    for k in range(3):
        at = np.flatnonzero(lens >= 8 * (k + 1))
        if not len(at):
            break
        lane = _rotl(lane8[starts[at] + 8 * k] * P2, 31) * P1
        h[at] = _rotl(h[at] ^ lane, 27) * P1 + P4
    at = np.flatnonzero(lens & 4)
    h[at] = _rotl(h[at] ^ (lane4[starts[at] + (lens[at] & -8)].astype(np.uint64) * P1), 23) * P2 + P3
    for k in range(3):
        at = np.flatnonzero((lens & 3) > k)
        h[at] = _rotl(h[at] ^ (padded[starts[at] + (lens[at] & -4) + k].astype(np.uint64) * P5), 11) * P1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    whole = memoryview(np.ascontiguousarray(buffer))
    for i in np.flatnonzero(lens >= 32):
        h[i] = xxhash.xxh64_intdigest(whole[starts[i] : starts[i] + lens[i]], seed)
    return h
