"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes ``len(NAMES)`` numbers, logarithms and square roots of lengths and shares that lie near a normal
distribution for prose.  Class means and covariances come from sums over all labelled rows; a covariance is drawn towards
the pooled one and towards its diagonal, so that a small or degenerate class still inverts.  Its Cholesky factor is
computed once and kept in the model; a score is the logistic of the difference of the log densities (from Mahalanobis
distances) plus that of the log class shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm import _text
from keyloom.llm._shared import bounded, quoted, with_made

NAMES = ["words", "word_length", "word_length_spread", "upper", "digit", "mark", "symbol", "bar", "doubled_mark", "line_words", "short_lines", "distinct_words", "distinct_pairs", "repeated_lines", "sentence_ends", "wide"]
TO_POOLED, TO_DIAGONAL = 0.1, 0.05  # shrinkage
SAMPLE = 500_000  # labelled rows to learn from, about, at most
LONG = 4 << 20  # bytes of a text from which its statistics are gathered window by window
THRESHOLD = 0.3  # score from which a text counts as good

PAIR = np.uint64(0x9E3779B97F4A7C15)
_CLASS = np.zeros((256, 7), bool)
_CLASS[65:91, 0] = True  # upper-case letters
_CLASS[48:58, 1] = True  # digits
_CLASS[[ord(c) for c in "!?,;:'\"()-"], 2] = True  # marks of prose
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"], 3] = True  # symbols
_CLASS[ord("|"), 4] = True
_CLASS[ord("."), 5] = True
_CLASS[128:, 6] = True


def features(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text of a string column; null is as empty, and an empty text has zeros throughout."""
    data, offsets = _text.column_bytes(column)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    for a, b in _text.pieces(offsets):
        own = data[offsets[a] : offsets[b]]
        out[a:b] = _piece(own, offsets[a : b + 1] - offsets[a]) if len(own) <= LONG else _long(own)
    return out


def _sums(values: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """Sums of values[cum[i]:cum[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[cum[1:]] - total[cum[:-1]]


def _distinct(h: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """How many different values each owner has."""
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return np.bincount(own[new], minlength=n).astype(np.float64)


def _merged(known: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([known, new]))


def _long(data: np.ndarray, size: int = _text.PIECE) -> np.ndarray:
    """The statistics of one long text, in windows: beside them only the hashes of its different words, pairs and lines are held."""
    share, doubled, solid, sums = np.zeros(7), 0, 0, np.zeros(3)
    seen = {k: np.zeros(0, np.uint64) for k in ("words", "pairs", "lines")}
    lines, short, begin, last = 0, 0, 0, np.zeros(0, np.uint64)
    at, stop = 0, len(data)
    while at < stop:
        end = _text.cut_after(data, min(at + size, stop), stop)
        own = data[at:end]
        share += [np.count_nonzero(_CLASS[own, k]) for k in range(7)]
        solid += np.count_nonzero(~_text.SPACE[own])
        doubled += np.count_nonzero((own[1:] == own[:-1]) & (_CLASS[own[1:], 2] | _CLASS[own[1:], 3]))
        words = _text.split_words(own, np.array([0, len(own)]), lower=False)
        sums += [len(words.lens), words.lens.sum(), (words.lens.astype(np.float64) ** 2).sum()]
        h = _text.xxh64(words.buffer, words.starts, words.lens)
        row = np.concatenate([last, h])
        seen["words"], seen["pairs"] = _merged(seen["words"], h), _merged(seen["pairs"], row[:-1] * PAIR + row[1:])
        last = row[-1:]
        ends = np.flatnonzero(own == 10) + at + 1
        ends = np.append(ends, stop) if end == stop and (not len(ends) or ends[-1] < stop) else ends
        if len(ends):
            starts = np.concatenate([[begin], ends[:-1]])
            seen["lines"] = _merged(seen["lines"], _text.xxh64(data[begin : ends[-1]], starts - begin, ends - starts))
            lines, short, begin = lines + len(ends), short + np.count_nonzero(ends - starts < 20), ends[-1]
        at = end
    one = lambda x: np.array([x], np.float64)
    distinct = {k: one(len(v)) for k, v in seen.items()}
    return _row(one(sums[0]), one(sums[1]), one(sums[2]), [one(x) for x in share], one(max(solid, 1)), one(doubled), one(lines), one(short), distinct)


def _row(many: np.ndarray, letters: np.ndarray, squares: np.ndarray, share: list[np.ndarray], solid: np.ndarray, doubled: np.ndarray, lines: np.ndarray, short: np.ndarray, distinct: dict[str, np.ndarray]) -> np.ndarray:
    """Statistics, transformed, from each text's counts."""
    some, rows = np.maximum(many, 1), np.maximum(lines, 1)
    mean = letters / some
    out = [
        np.log1p(many),
        np.log1p(mean),
        np.log1p(np.sqrt(np.maximum(squares / some - mean**2, 0))),
        *(np.sqrt(share[k] / solid) for k in range(5)),
        np.sqrt(doubled / solid),
        np.log1p(many / rows),
        np.sqrt(short / rows),
        distinct["words"] / some,
        distinct["pairs"] / np.maximum(many - 1, 1),
        np.sqrt(np.maximum(1 - distinct["lines"] / rows, 0)) * (lines > 0),
        np.sqrt(share[5] / some),
        np.sqrt(share[6] / solid),
    ]
    return np.stack(out, axis=1) * (many > 0)[:, None]


def _piece(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    words = _text.split_words(data, offsets, lower=False)
    many = np.diff(words.first)
    doubled = np.zeros(len(data), bool)
    if len(data) > 1:
        doubled[1:] = (data[1:] == data[:-1]) & (_CLASS[data[1:], 2] | _CLASS[data[1:], 3])
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        doubled[inner] = False
    owner = np.repeat(np.arange(n), many)
    h = _text.xxh64(words.buffer, words.starts, words.lens)
    inside = owner[1:] == owner[:-1]
    ends = np.flatnonzero(data == 10) + 1
    edge = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], ends[~np.isin(ends, offsets)]]))
    stop = np.append(edge[1:], len(data))
    line_owner = np.searchsorted(offsets, edge, "right") - 1
    distinct = {"words": _distinct(h, owner, n), "pairs": _distinct((h[:-1] * PAIR + h[1:])[inside], owner[1:][inside], n), "lines": _distinct(_text.xxh64(data, edge, stop - edge), line_owner, n)}
    return _row(
        many.astype(np.float64),
        _sums(words.lens, words.first),
        _sums(words.lens.astype(np.float64) ** 2, words.first),
        [_sums(_CLASS[data, k], offsets) for k in range(7)],
        np.maximum(_sums(~_text.SPACE[data], offsets), 1),
        _sums(doubled, offsets),
        np.bincount(line_owner, minlength=n).astype(np.float64),
        np.bincount(line_owner[stop - edge < 20], minlength=n),
        distinct,
    )


@dataclass
class Model:
    """Class means, inverse Cholesky factors of the covariances, their log determinants and the log class shares, for 0 and 1."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_share: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.factor[k].T
            density.append(self.log_share[k] - 0.5 * ((z**2).sum(axis=1) + self.log_det[k]))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(n: np.ndarray, total: np.ndarray, square: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Model:
    """From each class's row count, sums and sums of products.  A class without rows takes the other's shape and a share of next to nothing; without any, all scores are 0.5."""
    d = total.shape[1]
    mean = total / np.maximum(n, 1)[:, None]
    if (n == 0).any():
        mean[n == 0] = mean[n > 0].mean(axis=0) if n.any() else 0
    scatter = square - n[:, None, None] * mean[:, :, None] * mean[:, None, :] * (n > 0)[:, None, None]
    pooled = scatter.sum(axis=0) / max(n.sum() - 2, 1) + 1e-6 * np.eye(d)
    factor, log_det = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        own = scatter[k] / (n[k] - 1) if n[k] > 1 else pooled
        mixed = (1 - to_pooled) * own + to_pooled * pooled
        mixed = (1 - to_diagonal) * mixed + to_diagonal * np.diag(np.diag(mixed)) + 1e-6 * np.eye(d)
        low = np.linalg.cholesky(mixed)
        factor[k], log_det[k] = np.linalg.inv(low), 2 * np.log(np.diag(low)).sum()
    share = (n + 1e-3) / (n.sum() + 2e-3)
    return Model(mean, factor, log_det, np.log(share))


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1))


def with_features(docs: DataFrame, text: str = "text", name: str = "features") -> DataFrame:
    """``docs`` with the statistics of each text; null texts count as empty."""
    return with_made(docs, text, {name: "array<double>"}, lambda: lambda c: [_vectors(features(c))])


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each text, 0 to 1, higher for likelier good ones; null texts are scored as empty.

    Rows come back as they are, repeated ones and null keys too, other columns whatever their names; one called ``name``,
    in any case of letters, is replaced.  An empty table gives an empty result.
    """
    return with_made(docs, text, {name: "double"}, lambda: lambda c: [pa.array(model.score(features(c)))])


def with_scores_of(ready: DataFrame, model: Model, features: str = "features", name: str = "score") -> DataFrame:
    """As ``with_scores``, from features that are there already and are dropped."""
    make = lambda c: [pa.array(model.score(np.array(c.flatten().to_numpy()).reshape(-1, len(NAMES))))]
    return with_made(ready, features, {name: "double"}, lambda: make, keep=False)


def train(labelled: DataFrame, features: str = "features", label: str = "label") -> Model:
    """Fit on all rows with a label of 0 or 1 (others, and null, are left out); only sums leave the executors."""
    d = len(NAMES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = np.array(batch.column(0).flatten().to_numpy()).reshape(-1, d)
            y = batch.column(1).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                total[k] += own.sum(axis=0)
                square[k] += own.T @ own
        flat = np.concatenate([n, total.reshape(-1), square.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])

    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(features), F.col(label).cast("int"))
    sums = np.zeros(2 + 2 * d + 2 * d * d)
    for r in rows.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # len(sums) rows
        sums[r["at"]] = r["v"]
    return fit(sums[:2], sums[2 : 2 + 2 * d].reshape(2, d), sums[2 + 2 * d :].reshape(2, d, d))


def chosen_labels(labels: DataFrame, key: str, label: str, sample: int) -> DataFrame:
    """(label_key, label): labels of 0 or 1, all of them or, where there are more than ``sample``, about so many by a hash of the key."""
    own = labels.select(quoted(key).alias("label_key"), quoted(label).cast("int").alias("label")).where("label in (0, 1) and label_key is not null")
    n = own.count()
    share = F.pmod(F.xxhash64("label_key", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * sample / n) if n > sample else F.lit(True)
    return bounded(own.where(share))


def learn(docs: DataFrame, labels: DataFrame, use: Column, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the documents, with ``features``, for which ``use`` (of the key) holds, joined with their labels on the key.

    A document with several labels counts with each, repeated documents each time; labels of null or of other numbers, and
    those without a document, have no say.
    """
    rows = docs.where(use).select(quoted(key).alias("key"), "features")
    return train(rows.join(chosen_labels(labels, key, label, sample), F.col("key") == F.col("label_key")).select("features", "label"))


def learn_from_texts(docs: DataFrame, labels: DataFrame, use: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """As ``learn``, from texts: only those that have a chosen label are looked through."""
    rows = docs.where(use).select(quoted(key).alias("key"), quoted(text).alias("text"))
    rows = rows.join(chosen_labels(labels, key, label, sample), F.col("key") == F.col("label_key")).select("text", "label")
    return train(with_features(rows).drop("text"))
