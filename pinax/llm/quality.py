"""Quality rules with risk-controlled cutoffs (operator 5).

Each document gets plain measures of its text.  A rule rejects documents whose
measure lies above a cutoff; the cutoffs are not guessed but chosen on labelled
holdout documents, per stratum: a set of cutoffs, one for each rule, is used
only if an exact binomial bound shows, with confidence ``1 - delta`` over all
strata at once, that its rules together reject at most ``alpha`` of the good
documents.

Cases: a null or empty text has no words, so the base rules reject it.  Repeated
rows are judged alike.  A null stratum is a stratum of its own.  Labels that are
null, or of documents that are not in the table, are not used.  Input columns
that carry an output's name are replaced, and names that start with
``_quality_`` are reserved.  A stratum with fewer than ``log(delta / strata) / log(1 - alpha)`` good labels past the base
rules can have no cutoff certified, and only the base rules reject there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import (as_struct_type, blocks, is_separator, numbered, packed, per_row, repeated, reserved, runs, staged,
                     utf8, without, words)

#: Fixed values of the base rules and measures.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
REPEAT_WORDS = 3

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Candidate cutoffs of each rule, from lenient to strict; a document fails a
#: rule if its measure is above the cutoff.
RULES: dict[str, list[float]] = {
    "symbols_per_word": [2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_share": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "long_words": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0],
    "short_words": [-1.0, -1.5, -2.0, -2.5, -3.0],
}

#: The fixed order in which rule sets are tested: no rule at first, then each step tightens one rule by one
#: candidate, so that all rules have gone the same share of their candidates.
STEPS: list[tuple[str, int]] = [(rule, i) for _, _, rule, i in sorted(
    ((i + 1) / len(cuts), k, rule, i) for k, (rule, cuts) in enumerate(RULES.items()) for i in range(len(cuts)))]


def _values() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "long_words": per("word_chars", "n_words"),
        "short_words": -per("word_chars", "n_words"),
    }


def _measures(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    n = len(offs) - 1
    row_of = lambda at: np.searchsorted(offs[1:], at, side="right")
    starts, ends, row = words(data, offs)
    n_words = per_row(row, n)

    code_point = (data & 0xC0) != 0x80
    in_words = np.flatnonzero(code_point & ~is_separator(data))
    word_chars = per_row(row_of(in_words), n)
    n_symbols = per_row(row_of(np.flatnonzero(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))), n)

    # Lines with a word: runs of bytes other than \n that hold a word's start.
    ls, le, lrow = runs(data != 10, offs)
    filled = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, lrow = ls[filled], le[filled], lrow[filled]
    _, again = repeated(lrow, numbered(data, ls, le))
    n_lines, n_dup_lines = per_row(lrow, n), per_row(lrow[again], n)

    # Words in windows that occur twice: a window is the numbers of its words in order.
    k = REPEAT_WORDS
    covered = np.zeros(len(starts) + k, bool)
    if len(starts) >= k:
        number = numbered(data, starts, ends)
        inside = np.flatnonzero(row[:len(starts) - k + 1] == row[k - 1:])
        many, _ = repeated(*packed([row[inside], *(number[inside + i] for i in range(k))]))
        for i in range(k):
            covered[inside[many] + i] = True
    n_repeat = per_row(row[covered[:len(starts)]], n)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines]


def measure(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns ``MEASURES`` of the whole text."""
    docs = without(docs, MEASURES)
    shape = docs if keep_text else docs.drop(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in blocks(batches, text_col):
            at = rb.schema.get_field_index(text_col)
            found = _measures(*utf8(rb.column(at)))
            if not keep_text:
                rb = rb.remove_column(at)
            for name, x in zip(MEASURES, found):
                rb = rb.append_column(name, pa.array(x))
            yield rb

    return docs.mapInArrow(add, as_struct_type(shape, *[(m, LongType()) for m in MEASURES]))


def base_failed() -> Column:
    return ((F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p).

    Terms are added from the largest on the shorter side of the mean, each from
    the one before it, until they no longer change the sum: their number grows
    with the root of ``n``.
    """
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    below = k <= n * p
    i = k if below else k + 1
    top = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p)
           + (n - i) * math.log1p(-p))
    odds, term, total = p / (1 - p), 1.0, 0.0
    while term > total * 1e-17 and 0 <= i <= n:
        total += term
        if below:
            term *= i / ((n - i + 1) * odds)
            i -= 1
        else:
            term *= (n - i) / (i + 1) * odds
            i += 1
    side = math.exp(top + math.log(total))
    return min(1.0, side) if below else max(0.0, 1.0 - side)


def _first_step() -> Column:
    """The first of ``STEPS`` whose rule set rejects the document, ``len(STEPS)`` if none does."""
    values, no = _values(), {step: k for k, step in enumerate(STEPS)}
    firsts = []
    for rule, cuts in RULES.items():
        first = F.lit(len(STEPS))
        for i in reversed(range(len(cuts))):
            first = F.when(values[rule] > F.lit(cuts[i]), F.lit(no[rule, i])).otherwise(first)
        firsts.append(first)
    return F.least(*firsts)


def calibrate(holdout: DataFrame, stratum: str, good: Column, alpha: float = 0.02,
              delta: float = 0.05) -> DataFrame:
    """Certified cutoffs: ``(stratum, rule, cutoff, n_good, n_rejected)``.

    ``holdout`` has the measures and the stratum of labelled documents; ``good``
    marks those that must not be rejected.  Rule sets are tested whole: the set
    after each of ``STEPS`` has a cutoff for every rule tightened so far, and
    rejects what the sets before it reject.  For each stratum the sets are
    tested from lenient to strict, each at level ``delta / strata``: "the share
    of good documents that any of its rules rejects exceeds alpha" is rejected
    when the exact binomial probability of so few rejected good documents is at
    most the level, and testing stops at the first set that is not certified.
    Tests in a fixed order until the first failure need no further correction.
    Of the certified sets, the stratum uses the most lenient one that rejects
    as many bad documents as the strictest does.  ``n_rejected`` is the number
    of good documents that the whole set rejects.

    The counts form one aggregate with map-side partial sums: a row for each
    stratum (two columns for each step), whatever the number of documents.
    """
    first, counts = F.col("_quality_first"), [F.count_if(good).alias("n_good")]
    for k in range(len(STEPS)):
        counts += [F.count_if(good & (first <= k)).alias(f"{k}|good"), F.count_if(~good & (first <= k)).alias(f"{k}|bad")]
    tested = staged(holdout.filter(~base_failed()).withColumn("_quality_first", _first_step())
                    .groupBy(F.col(stratum).cast("string").alias("stratum")).agg(*counts), "holdout")
    level = delta / max(1, tested.count())

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                n, passed = int(r["n_good"]), 0
                while passed < len(STEPS) and binomial_tail(int(r[f"{passed}|good"]), n, alpha) <= level:
                    passed += 1
                if passed:
                    last = next(k for k in range(passed) if r[f"{k}|bad"] == r[f"{passed - 1}|bad"])
                    strictest = dict(STEPS[:last + 1])  # the last candidate of each rule
                    out += [(r["stratum"], rule, RULES[rule][i], n, int(r[f"{last}|good"]))
                            for rule, i in strictest.items()]
            yield pd.DataFrame(out, columns=["stratum", "rule", "cutoff", "n_good", "n_rejected"])

    return tested.mapInPandas(
        choose, "stratum string, rule string, cutoff double, n_good long, n_rejected long")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``.

    The cutoffs, a row per stratum, join on the stratum; Spark picks a broadcast
    by their size, and splits a hot stratum if it must shuffle.
    """
    values, rules = _values(), list(RULES)
    wide = cutoffs.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_quality_cut_{r}") for r in rules])
    wide = wide.withColumnRenamed("stratum", "_quality_stratum")
    m = without(measured, ["base_failed", "kept"])
    j = m.join(wide, F.col(stratum).cast("string").eqNullSafe(F.col("_quality_stratum")), "left")
    fails = F.lit(False)
    for r in rules:
        fails = fails | F.coalesce(values[r] > F.col(f"_quality_cut_{r}"), F.lit(False))
    return (j.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~fails)
            .drop("_quality_stratum", *[f"_quality_cut_{r}" for r in rules]))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02,
                  delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text",
                  keep_text: bool = True) -> DataFrame:
    """``docs`` with measures, ``base_failed`` and ``kept``.

    ``labels`` has ``id_col`` and ``quality`` (1: good, 0: bad; of a document
    labelled more than once the lowest counts).  The holdout is every labelled
    document.  Texts are measured once, into a staged table, from whose numbers
    cutoffs are chosen and documents judged.
    """
    docs = without(reserved(docs, "_quality_"), ["base_failed", "kept"])
    measured = staged(measure(docs, text_col, keep_text), "quality")
    label = (labels.filter(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_quality_id"))
             .agg(F.min("quality").alias("_quality_label")))
    numbers = measured.select(F.col(id_col).alias("_quality_doc"), F.col(stratum).alias("_quality_of"), *MEASURES)
    holdout = numbers.join(label, F.col("_quality_doc") == F.col("_quality_id"))
    cutoffs = calibrate(holdout, "_quality_of", F.col("_quality_label") == 1, alpha, delta)
    return judge(measured, cutoffs, stratum)
