"""Language-model scoring: interpolated modified Kneser-Ney over word bigrams.

Counting runs in Spark; the model is a set of sorted hash arrays in the shared folder, which workers memory-map.

* Words are known by XXH64.  The vocabulary is one sorted array of those hashes, cut by leading bits into parts; a word's
  number is its place in it.  Beside it lie its count, its distinct predecessors and its back-off weight.
* A bigram's key mixes both numbers one to one into 64 bits, so no two bigrams share it.  Keys are sorted within parts,
  with the counts beside them.  A part holds whole contexts, and of contexts too frequent for that a share.
* A text is its words and one end; its first word's context is a start mark, which is never predicted.

With c the counts, N1+ the distinct neighbours and D a discount by count 1, 2 or more (from the counts of counts):

    p(w | v) = (c(v w) - D(c(v w))) / c(v) + g(v) * q(w)          g(v) = sum of D over v's bigrams / c(v)
    q(w) = (N1+(. w) - D'(N1+(. w))) / N1+(. .) + g' / (V + 1)    an unknown context leaves q(w)

Memory is bounded whatever the input: a task holds a piece of text, at most about ``HELD`` different entries that it has
counted, or one part of the arrays.  Parts lie one after the other in the tasks that store them, of which there are at
most ``TASKS``.

Bigrams, not longer ones: 137 million words have over 75 million distinct trigrams, whose counting and arrays take more
than the disk that this job may use (README has the figures).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import _text
from keyloom.llm._files import array_uri, map_array, new_tag, save_array
from keyloom.llm._shared import cut, fresh_path, quoted, remove, with_made

PART = 1 << 20  # entries in a part of the arrays, about
HELD = 1 << 20  # different entries that a task gathers before it hands them on
TASKS = 1 << 14  # at most, for the storing of parts
ROWS = 1 << 16  # rows in a batch that a task hands on
END = int(_text.xxh64(np.frombuffer(b"\n", np.uint8), np.array([0]), np.array([1]))[0])  # no word can be white space
START = int(_text.xxh64(np.frombuffer(b" ", np.uint8), np.array([0]), np.array([1]))[0])
UNKNOWN = np.uint64(0xFFFFFFFF)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _empty() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Model:
    """The totals, and of each part's files the tag that ends their names (0: there are none): a number for each million entries."""

    folder: str
    tokens: int
    types: int
    word_bits: int
    words: np.ndarray = field(default_factory=_empty)  # of hashes and counts
    base: np.ndarray = field(default_factory=_empty)  # number of a part's first word; one more than parts
    known: np.ndarray = field(default_factory=_empty)  # of distinct predecessors and back-off weights
    pair_bits: int = 0
    hot: np.ndarray = field(default_factory=_empty)
    pairs: np.ndarray = field(default_factory=_empty)  # of keys and counts
    discount: list[float] = field(default_factory=lambda: [0.0] * 4)
    low_discount: list[float] = field(default_factory=lambda: [0.0] * 4)
    pair_types: int = 0
    floor: float = 1.0  # what q gives to any word: g' / (V + 1)


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more from n[1..4], the numbers of entries seen so often.

    Where a number that divides is zero, Y falls back to 1 and the discount to half the count.
    """
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 1.0
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2
        out.append(min(max(d, 0.0), float(k)))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def _with_marks(ids: np.ndarray, first: np.ndarray, start: np.uint64, end: np.uint64, closes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, words, first pair of each text) of the texts' bigrams; ``start`` is what comes before each, ``end`` the last if it ``closes``."""
    n = np.diff(first) + closes
    cum = np.concatenate([[0], np.cumsum(n)])
    word = np.full(cum[-1], end, np.uint64)
    inner = np.ones(cum[-1], bool)
    if closes:
        inner[cum[1:] - 1] = False
    word[inner] = ids
    context = np.empty(cum[-1], np.uint64)
    context[1:] = word[:-1]
    context[cum[:-1][n > 0]] = start
    return context, word, cum


def _bigrams(column: pa.Array, look: Lookup) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last, contexts, words, first pair of each text) for pieces of the column, in numbers of words."""
    start, end = look.ids(np.array([START, END], np.uint64))
    before = start
    for a, b, words, opens, closes in _text.word_pieces(column):
        ids = look.ids(_text.xxh64(words.buffer, words.starts, words.lens))
        yield a, b, *_with_marks(ids, words.first, start if opens else before, end, closes)
        before = ids[-1] if len(ids) else (start if opens else before)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _gathered(counted: Iterator[tuple[np.ndarray, np.ndarray]], held: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) summed as they come, and handed on once more than ``held`` different keys are there."""
    done, waiting = [], 0
    for keys, counts in counted:
        done.append((keys, counts))
        waiting += len(keys)
        if waiting >= HELD:
            done, waiting = [_summed(done)], 0
            if len(done[0][0]) > held:
                yield done.pop()
    if done:
        yield _summed(done)


def _part_of_word(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _part_of_pair(key: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """The part of a packed bigram: its context's, or for hot contexts its own."""
    context = key >> np.uint64(32)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
        context = np.where(hot[at] == context, _mix(key), context)
    return (_mix(context) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _batches(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(next(iter(columns.values()))), ROWS):
        yield pa.RecordBatch.from_pydict({k: v[at : at + ROWS] for k, v in columns.items()})


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """``rows``, each part's in one task and one part's after the other's."""
    tasks = min(parts, TASKS)
    out = rows.repartitionById(tasks, (F.col("part") % tasks).cast("int"))
    return out.sortWithinPartitions("part") if parts > tasks else out


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[list[np.ndarray]]]]:
    """(part, its rows' other columns, batch by batch) for each part of a task."""

    def runs() -> Iterator[tuple[int, list[np.ndarray]]]:
        for batch in batches:
            part, *rest = (batch.column(i).to_numpy() for i in range(batch.num_columns))
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in pairwise(edges):
                if a < b:
                    yield int(part[a]), [c[a:b] for c in rest]

    for part, group in groupby(runs(), key=itemgetter(0)):
        yield part, (columns for _, columns in group)


class Lookup:
    """The memory-mapped arrays of a model, in a worker; a part's are mapped when they are first asked for."""

    def __init__(self, model: Model):
        self.m = model
        self.base, self.hot = model.base.astype(np.uint64), model.hot.astype(np.uint64)
        self.array = lru_cache(maxsize=4096)(self._array)

    def _array(self, name: str, tags: str, part: int, kind: str = "<i8") -> np.ndarray:
        tag = int(getattr(self.m, tags)[part])
        return map_array(array_uri(self.m.folder, f"{name}-{part}", tag), kind) if tag else np.zeros(0, kind)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, UNKNOWN for those not in the vocabulary; ``hashes`` sorted and distinct."""
        out = np.full(len(hashes), UNKNOWN, np.uint64)
        part = _part_of_word(hashes, self.m.word_bits)
        for p in np.unique(part).tolist():
            words, (a, b) = self.array("words", "words", p, "<u8"), np.searchsorted(part, [p, p + 1])
            if len(words):
                at = np.minimum(np.searchsorted(words, hashes[a:b]), len(words) - 1)
                hit = words[at] == hashes[a:b]
                out[a:b][hit] = at[hit].astype(np.uint64) + self.base[p]
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(hashes, return_inverse=True)
        return self.word_ids(distinct)[back]

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of known numbers, and their places there."""
        part = np.searchsorted(self.base, ids, "right") - 1
        return part, (ids - self.base[part]).astype(np.int64)

    def of_words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, distinct predecessors and back-off weights of sorted, distinct known numbers."""
        count, known, backoff = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.ones(len(ids))
        part, at = self.places(ids)
        for p in np.unique(part).tolist():
            a, b = np.searchsorted(part, [p, p + 1])
            count[a:b] = self.array("counts", "words", p)[at[a:b]]
            known[a:b] = self.array("known", "known", p)[at[a:b]]
            backoff[a:b] = self.array("backoff", "known", p, "<f8")[at[a:b]]
        return count, known, backoff

    def of_pairs(self, packed: np.ndarray) -> np.ndarray:
        """Counts of packed, distinct bigrams."""
        part, key = _part_of_pair(packed, self.m.pair_bits, self.hot), _mix(packed)
        order = np.lexsort((key, part))
        part, key = part[order], key[order]
        found = np.zeros(len(packed), np.int64)
        for p in np.unique(part).tolist():
            keys, (a, b) = self.array("keys", "pairs", p, "<u8"), np.searchsorted(part, [p, p + 1])
            if len(keys):
                raw = self.array("pairs", "pairs", p, "<u1")
                counts = raw.view("<u4" if len(raw) == 4 * len(keys) else "<i8")
                at = np.minimum(np.searchsorted(keys, key[a:b]), len(keys) - 1)
                found[order[a:b]] = np.where(keys[at] == key[a:b], counts[at], 0)
        return found


def _vocabulary(docs: DataFrame, folder: str) -> Model:
    """The model as far as words go: their hashes, counts and numbers, and which contexts are frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for a, b, words, opens, closes in _text.word_pieces(batch.column(0)):
                    h, n = np.unique(_text.xxh64(words.buffer, words.starts, words.lens), return_counts=True)
                    yield np.concatenate([h, np.array([END, START], np.uint64)]), np.concatenate([n, [(b - a) * closes, (b - a) * opens]])

        for h, n in _gathered(counted(), HELD):
            yield from _batches(h=h.view(np.int64), n=n)
        _text.release()

    used: list[str] = []
    counted = cut(docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "vocabulary", used)
    mark = F.lit(START - (1 << 64) if START >> 63 else START)
    total = counted.agg(F.count("*").alias("types"), F.coalesce(F.sum(F.when(F.col("h") != mark, F.col("n"))), F.lit(0)).alias("tokens")).first()
    if total["types"] >= int(UNKNOWN):
        raise ValueError(f"{total['types']} different words; their numbers have 32 bits")
    bits = max(0, math.ceil(math.log2(max(total["types"], 1) / PART)))
    model = Model(folder, total["tokens"], max(total["types"] - 1, 0), bits)
    model.pair_bits = max(3, math.ceil(math.log2(max(model.tokens, 1) / PART)))
    limit = max(model.tokens >> model.pair_bits + 2, 1)  # contexts seen more often are spread over all parts: at most 4 for each part

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, columns in _by_part(batches):
            ((h, n),) = _gathered(((h.view(np.uint64), n) for h, n in columns), math.inf)
            tag = new_tag()
            save_array(folder, f"words-{part}", h, tag)
            save_array(folder, f"counts-{part}", n.astype("<i8"), tag)
            yield pa.RecordBatch.from_pydict({"part": [part], "tag": [int(tag, 16)], "n": [len(h)], "hot": [np.flatnonzero(n > limit)]})
        _text.release()

    part = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    rows = _dealt(counted.select(part.alias("part"), "h", "n"), 1 << bits)
    stored = rows.mapInArrow(store, "part long, tag long, n long, hot array<long>").collect()  # a row for each part, and 4 numbers
    model.words, size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for r in stored:
        model.words[r["part"]], size[r["part"]] = r["tag"], r["n"]
    model.base = np.concatenate([[0], np.cumsum(size)])
    model.hot = np.sort(np.concatenate([_empty(), *(model.base[r["part"]] + np.array(r["hot"], np.int64) for r in stored)]))
    for path in used:
        remove(docs.sparkSession, path)
    return model


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count ``docs`` and store the model in the shared folder.

    Null texts count as empty: one end after a start.  Repeated rows count as often as they come, a long text is read in
    windows, other columns are ignored, and an empty table gives a model without words.  More than 2**32 - 2 different
    words are an error.
    """
    docs = docs.select(quoted(text).alias("text"))
    folder = fresh_path(docs.sparkSession, "kneser-ney")
    model = _vocabulary(docs, folder)
    parts = 1 << model.pair_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model)
        pieces = (_bigrams(batch.column(0), look) for batch in batches)
        counted = (np.unique(context << np.uint64(32) | word, return_counts=True) for piece in pieces for _, _, context, word, _ in piece)
        for key, n in _gathered(counted, HELD):
            yield from _batches(part=_part_of_pair(key, model.pair_bits, look.hot).astype(np.int32), key=key.view(np.int64), n=n)
        _text.release()

    schema = pa.schema([("part", pa.int32()), ("code", pa.int64()), ("v", pa.int64()), ("about", pa.list_(pa.int64()))])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bigram arrays of the parts dealt to this task, and what they say of words: their part, code 4 * place + kind, value.

        Kind 0: distinct predecessors; 1, 2, 3: a context's bigrams seen once, twice, more often.  Rows of part -1 tell
        of a part of bigrams: its number, tag, size and counts of counts.
        """
        look = Lookup(model)
        for part, columns in _by_part(batches):
            ((own, c),) = _gathered(((key.view(np.uint64), n) for key, n in columns), math.inf)
            tag, mixed = new_tag(), _mix(own)
            order = np.argsort(mixed)
            save_array(folder, f"keys-{part}", mixed[order], tag)
            save_array(folder, f"pairs-{part}", c[order].astype("<u4" if c.max() < 1 << 32 else "<i8"), tag)
            about = [part, int(tag, 16), len(own), *_counts_of_counts(c)]
            yield pa.RecordBatch.from_pydict({"part": [-1], "code": [0], "v": [0], "about": [about]}, schema)
            del mixed, order
            last, n = np.unique(own & np.uint64(0xFFFFFFFF), return_counts=True)
            kinds, m = np.unique((own >> np.uint64(32)) * np.uint64(4) + np.minimum(c, 3).astype(np.uint64), return_counts=True)
            for ids, kind, v in ((last, 0, n), (kinds >> np.uint64(2), (kinds & np.uint64(3)).astype(np.int64), m)):
                p, at = look.places(ids)
                for batch in _batches(part=p.astype(np.int32), code=4 * at + kind, v=v):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.list_(pa.int64()))], schema=schema)
        _text.release()

    used: list[str] = []
    counted = _dealt(docs.mapInArrow(count, "part int, key long, n long"), parts)
    stored = cut(counted.mapInArrow(store, "part int, code long, v long, about array<long>"), "bigrams", used)
    model.pairs, seen = np.zeros(parts, np.int64), np.zeros(5, np.int64)
    for r in stored.where("part < 0").select("about").collect():  # a row for each part
        part, model.pairs[r["about"][0]], types, *n = r["about"]
        seen[1:] += n
        model.pair_types += types
    model.discount = discounts(seen.tolist())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model)
        for part, columns in _by_part(batches):
            each = np.zeros((int(model.base[part + 1] - model.base[part]), 4), np.int64)
            for code, v in columns:
                np.add.at(each.reshape(-1), code, v)
            backoff = each[:, 1:] @ np.array(model.discount[1:]) / np.maximum(look.array("counts", "words", part), 1)
            tag = new_tag()
            save_array(folder, f"known-{part}", each[:, 0].astype("<i8"), tag)
            save_array(folder, f"backoff-{part}", backoff.astype("<f8"), tag)
            yield pa.RecordBatch.from_pydict({"about": [[part, int(tag, 16), *_counts_of_counts(each[:, 0])]]})
        _text.release()

    described = _dealt(stored.where("part >= 0").select("part", "code", "v"), len(model.words)).mapInArrow(describe, "about array<long>")
    model.known, seen = np.zeros(len(model.words), np.int64), np.zeros(5, np.int64)
    for r in described.collect():  # a row for each part
        part, model.known[r["about"][0]], *n = r["about"]
        seen[1:] += n
    model.low_discount = d = discounts(seen.tolist())
    held = d[1] * seen[1] + d[2] * seen[2] + d[3] * (model.types - seen[1] - seen[2])
    model.floor = float((held / model.pair_types if model.pair_types else 1.0) / (model.types + 1))
    for path in used:
        remove(docs.sparkSession, path)
    return model


MADE = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "perplexity": "double"}


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text and with n_tokens, n_known, base_score, score (log10 probability) and perplexity.

    Null texts count as empty: their one token is the end.  Repeated rows and null keys come back as they are, an empty
    table gives an empty result, and a long text is scored in windows.  Other columns stay, but for those of these five
    names, in any case of letters, which are replaced.
    """

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        look = Lookup(model)

        def make(column: pa.Array) -> list[pa.Array]:
            whole, logs = np.zeros((2, len(column)), np.int64), np.zeros((2, len(column)))
            for a, b, context, word, cum in _bigrams(column, look):
                if len(word):
                    known, base, log = _score_piece(look, context, word)
                    whole[0, a:b] += np.diff(cum)
                    whole[1, a:b] += np.add.reduceat(known, cum[:-1])
                    logs[0, a:b] += np.add.reduceat(base, cum[:-1])
                    logs[1, a:b] += np.add.reduceat(log, cum[:-1])
            perplexity = 10.0 ** np.minimum(-logs[1] / np.maximum(whole[0], 1), 300.0)
            return [pa.array(x) for x in (*whole, *logs, perplexity)]

        return make

    return with_made(docs, text, MADE, start, keep=False)


def _score_piece(look: Lookup, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: whether its word is known, and the logarithms of its base and model probabilities."""
    m = look.m
    packed, back = np.unique(context << np.uint64(32) | word, return_inverse=True)
    v, w = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
    ids, place = np.unique(np.concatenate([v, w]), return_inverse=True)
    is_known = ids != UNKNOWN
    count, known, backoff = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.ones(len(ids))
    count[is_known], known[is_known], backoff[is_known] = look.of_words(ids[is_known])
    at_v, at_w = place[: len(packed)], place[len(packed) :]
    pair = look.of_pairs(packed)
    d, low = np.array(m.discount), np.array(m.low_discount)
    q = (known - low[np.minimum(known, 3)]) / max(m.pair_types, 1) + m.floor
    seen = count[at_v] > 0
    p = np.where(seen, (pair - d[np.minimum(pair, 3)]) / np.maximum(count[at_v], 1) + backoff[at_v] * q[at_w], q[at_w])
    base = np.log10((count[at_w] + 1) / (m.tokens + 1 * (m.types + 1)))
    return (count[at_w] > 0)[back].astype(np.int64), base[back], np.log10(p)[back]
