"""Stacking frames, entity lists and coverage checks.

Entity lists stay DataFrames (a dimension table) and are compared with joins;
nothing is collected to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import recode


def stack(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Vertical concat by column name, duplicates kept (F1/F2).

    The schemas are compared first: ``union`` is positional and coerces types
    (and raises under ANSI), so differing names or types raise here with a
    readable message.  ``allow_missing`` fills absent columns with nulls.
    """
    if not frames:
        raise ValueError("nothing to stack")
    first = {f.name: f.dataType for f in frames[0].schema.fields}
    for i, df in enumerate(frames[1:], start=1):
        other = {f.name: f.dataType for f in df.schema.fields}
        if not allow_missing and set(other) != set(first):
            raise ValueError(f"frame {i} columns {sorted(other)} differ from {sorted(first)}")
        bad = {c: (first[c], other[c]) for c in set(first) & set(other) if first[c] != other[c]}
        if bad:
            raise TypeError(f"frame {i} has columns of other types: {bad}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def distinct_values(df: DataFrame, col: str, sort: bool = False) -> DataFrame:
    """Distinct values of one column (G1), optionally sorted nulls first.

    The sort is a range exchange; keep it for report output only.
    """
    out = df.select(col).distinct()
    return out.orderBy(F.col(col).asc_nulls_first()) if sort else out


def harmonise(df: DataFrame, col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Apply ordered spelling rules to an entity column (D6 on a dimension)."""
    return recode(df, col, rules)


def recode_report(df: DataFrame, col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """What ordered recode rules do to a column: ``(before, after, n)`` for every
    value they change (D6).  Greedy rules (``P.*tange``) that catch more than
    the intended spelling show up here instead of silently merging entities."""
    return (recode(df.select(F.col(col).alias("before")), "before", rules, to="after")
              .filter(~F.col("before").eqNullSafe(F.col("after")))
              .groupBy("before", "after").agg(F.count(F.lit(1)).alias("n")))


def missing_from(df: DataFrame, key: str, dim: DataFrame, dim_key: str | None = None,
                 sort: bool = False) -> DataFrame:
    """Distinct non-null ``key`` values of ``df`` absent from ``dim``.

    ``left_anti`` keeps null keys (``NOT IN`` would drop them, and ``NOT IN`` a
    list holding a null returns nothing), so nulls are removed explicitly.  An
    empty result means full coverage.  ``sort`` orders the report, at the cost
    of a range exchange.
    """
    dim_key = dim_key or key
    d = dim.select(F.col(dim_key).alias("__k")).filter(F.col("__k").isNotNull())
    left = df.select(key).filter(F.col(key).isNotNull()).distinct()
    out = left.join(d, left[key] == d["__k"], "left_anti")
    return out.orderBy(F.col(key).asc()) if sort else out
