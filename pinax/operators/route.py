"""Row routing: classify rows by ordered regex rules and split them.

One ``row_class`` column is computed once; branches are filters on it, so a
row can never land in two branches and the classification is evaluated in the
same Project as the scan.  When several branches are consumed by one job,
persist or stage the classified frame once (``sinks.stage``) instead of
re-reading the source per branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import class_expr, contains


def route(df: DataFrame, col: str, rules: list[tuple[str, str]], default: str = "detail",
          class_col: str = "row_class", null_class: str = "null") -> DataFrame:
    """Add ``class_col``: the first rule whose regex matches ``col`` wins."""
    return df.withColumn(class_col, class_expr(col, rules, default, null_class))


def branch(df: DataFrame, name: str, class_col: str = "row_class") -> DataFrame:
    """Rows of one class, without the class column."""
    return df.filter(F.col(class_col) == name).drop(class_col)


def drop_matching(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """``filter(~col.rlike(p))`` (C2).  Null values are dropped too (null predicate)."""
    return df.filter(~contains(col, pattern))


def keep_matching(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """``filter(col.rlike(p))``."""
    return df.filter(contains(col, pattern))
