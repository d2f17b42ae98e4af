"""Mixing sources to target weights by iterative proportional fitting, then sampling by calibrated probabilities.

Token counts are summed by source, language and topic.  Raking scales these cells in turn until the sums by source, by
language and by topic each meet their targets; a cell's factor is its raked over its observed tokens.  A document stays
with the probability (its cell's factor) / (the largest factor), so the expected tokens of the sample have the target
shares and nothing is repeated.  The draw is a hash of the key: the same rows on every run.

Only DataFrame functions are used.  A step of raking is a grouped sum over the cells, partial sums first, and a join of
the sums with the cells; after each the cells are written, so plans stay short and no task or driver holds them all.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm._shared import bounded, cut, others, quoted, remove

SWEEPS = 60  # at most
TOLERANCE = 1e-9  # raking ends with a sweep that finds no marginal sum further off its goal, relatively
SETTLED, GAIN = 8, 0.99  # sweeps after which one that leaves more than this share of the error before is the last
DIMS = ["source", "lang", "topic"]
MADE = [f"_{d}" for d in DIMS] + ["_probability"]
#: Targets are each marginal's observed shares to these powers: rarer sources gain, languages and topics keep their shares.
ALPHA = {"source": 0.7, "lang": 1.0, "topic": 1.0}
SYMBOLS = "#$%&*+<=>^_{}~"


def token_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column | None = None) -> Column:
    """A topic by the form of a text, for tables that have none.

    none: null, or without words; table: bars are a fiftieth of the characters or more; code: symbols are a hundredth or
    more; contact: an address with @ or ://; list: under six words a line; note: under a hundred words; prose: the rest.
    """
    body, words = F.coalesce(text, F.lit("")), token_count(text) if tokens is None else tokens
    n = F.length(body)
    without = lambda c: n - F.length(F.replace(body, F.lit(c), F.lit("")))
    return (
        F.when(words == 0, "none")
        .when(without("|") * 50 >= n, "table")
        .when((n - F.length(F.translate(body, SYMBOLS, ""))) * 100 >= n, "code")
        .when(F.contains(body, F.lit("://")) | (F.contains(body, F.lit("@")) & body.rlike("[A-Za-z0-9]@[A-Za-z0-9]")), "contact")
        .when(words < 6 * (without("\n") + 1), "list")
        .when(words < 100, "note")
        .otherwise("prose")
    )


def _known(value: Column) -> Column:
    """A value as text that null doesn't share with any: the cells' own form of it."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _shown(known: Column) -> Column:
    return F.when(known != "", F.substring(known, 2, 1 << 30))


def _marked(docs: DataFrame, key: str, text: str, topic: Column | None) -> DataFrame:
    """(row, key, tokens, source, lang, topic) of every row: the row itself as a struct, so no other column can clash."""
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(key).cast("string").alias("key"), *[_known(quoted(d)).alias(d) for d in DIMS[:2]], quoted(text).cast("string").alias("text"), *([] if topic is None else [topic.alias("topic")]))
    rows = rows.withColumn("tokens", token_count(F.col("text")))
    named = topic_of(F.col("text"), F.col("tokens")) if topic is None else F.col("topic")
    return rows.select("row", "key", "tokens", *DIMS[:2], _known(named).alias("topic"))


def _goals(cells: DataFrame, dim: str, weight: str, wanted: dict[str | None, float] | None, alpha: float, total: float) -> DataFrame:
    """(dim, goal): what the weights of each value have to add up to."""
    own = cells.groupBy(dim).agg((F.sum(weight).cast("double") / F.lit(total)).alias("share"))
    if wanted is None:
        own = own.withColumn("w", F.pow("share", F.lit(float(alpha))))
    else:
        given = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in ("" if k is None else f"={k}", float(v))])
        own = own.withColumn("w", F.coalesce(F.element_at(given, F.col(dim)), F.lit(0.0)))
    whole = own.agg(F.sum("w")).first()[0]
    if not whole:
        raise ValueError(f"no {dim} that occurs has a target weight above 0")
    return own.select(dim, (F.col("w") / F.lit(whole) * F.lit(total)).alias(f"goal_{dim}"))


def rake(cells: DataFrame, dims: list[str], weight: str, targets: dict[str, dict[str | None, float]] | None = None, alpha: dict[str, float] = ALPHA, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``raked``: the weights scaled to the marginals' target shares, keeping the total.

    ``targets`` may give weights by value for a dimension (values it leaves out get 0, null is the key None; they are
    scaled to the values that occur); other dimensions get their observed shares to the power that ``alpha`` has for them.
    Weights have to be positive.  Sweeps end when one finds every marginal sum within ``tolerance`` of its goal.  Targets that
    contradict each other on the cells that occur never do: when sweeps gain no more, or after ``sweeps``, a warning
    states the error that is left (the last dimension's targets are met then).  Without cells the result is empty.
    """
    used: list[str] = []
    total = cells.agg(F.sum(F.col(weight).cast("double"))).first()[0]
    if not total:
        return cells.withColumn("raked", F.col(weight).cast("double"))
    out = cells.withColumn("raked", F.col(weight).cast("double"))
    for d in dims:
        out = out.join(_goals(cells, d, weight, (targets or {}).get(d), alpha.get(d, 1.0), total), d)
    out, error = cut(out, "raked", used), float("inf")
    for done in range(1, sweeps + 1):
        for k, d in enumerate(dims):
            sums = out.groupBy(d).agg(F.sum("raked").alias("own"))
            goal, own = F.col(f"goal_{d}"), F.col("own")
            off = F.abs(own - goal) / F.when(goal > 0, goal).otherwise(F.lit(total))
            out = out.join(sums, d).withColumn("off", F.greatest(off, F.col("off")) if k else off)
            out = cut(out.withColumn("raked", F.when(own > 0, F.col("raked") * goal / own).otherwise(F.lit(0.0))).drop("own"), "raked", used)
            remove(cells.sparkSession, used.pop(-2))
        before, error = error, out.agg(F.max("off")).first()[0]
        if error <= tolerance or (done >= SETTLED and error > GAIN * before):
            break
    if error > tolerance:
        warnings.warn(f"raking ended with a marginal {error:.2g} off its target", stacklevel=2)
    return out.select(*cells.columns, "raked")


def _probabilities(marked: DataFrame, targets: dict[str, dict[str | None, float]] | None, alpha: dict[str, float], sweeps: int, tolerance: float) -> DataFrame:
    """(source, lang, topic, tokens, raked, probability), values in the cells' own form."""
    cells = cut(marked.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "cells")
    some = rake(cells.where("tokens > 0"), DIMS, "tokens", targets, alpha, sweeps, tolerance)
    some = some.withColumn("factor", F.col("raked") / F.col("tokens"))
    top = some.agg(F.max("factor")).first()[0]
    some = some.withColumn("probability", F.col("factor") / F.lit(top or 1.0)).drop("factor")
    return cut(some.unionByName(cells.where("tokens = 0").select("*", F.lit(0.0).alias("raked"), F.lit(1.0).alias("probability"))), "probabilities")


def cell_probabilities(docs: DataFrame, text: str = "text", topic: Column | None = None, targets: dict[str, dict[str | None, float]] | None = None, alpha: dict[str, float] = ALPHA, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, lang, topic, tokens, raked, probability): one row for each combination that occurs, null among the values.

    Documents without words weigh nothing and have no say; their cells, if of no other documents, are sampled like the
    largest factor (probability 1).
    """
    cells = _probabilities(_marked(docs, text, text, topic), targets, alpha, sweeps, tolerance)
    return cells.select(*[_shown(F.col(d)).alias(d) for d in DIMS], "tokens", "raked", "probability")


def draw(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from 48 bits of the key's MD5; a null key draws as the word null."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", topic: Column | None = None, targets: dict[str, dict[str | None, float]] | None = None, alpha: dict[str, float] = ALPHA, sweeps: int = SWEEPS, tolerance: float = TOLERANCE, marks: bool = True) -> DataFrame:
    """The sampled rows of ``docs``, and with ``marks`` columns _source, _lang, _topic and _probability (in place of any so called).

    Null is a source, language or topic of its own, apart from any text.  Repeated rows are drawn together, null keys as
    one; rows without words are sampled as ``cell_probabilities`` says.  An empty table gives an empty result, and other
    columns may have any name.  One short row for each combination that occurs is broadcast, while those are few.
    """
    if marks:
        docs = docs.select(*[quoted(c) for c in others(docs, MADE)])
    marked = _marked(docs, key, text, topic)
    cells = _probabilities(marked.select("tokens", *DIMS), targets, alpha, sweeps, tolerance)
    kept = marked.join(bounded(cells.select(*DIMS, "probability")), DIMS).where(draw(F.col("key")) < F.col("probability"))
    made = [*[_shown(F.col(d)).alias(f"_{d}") for d in DIMS], F.col("probability").alias("_probability")]
    return kept.select("row.*", *(made if marks else []))
