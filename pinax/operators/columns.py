"""Column naming, selection and whole-frame column transforms.

All functions are ``DataFrame -> DataFrame`` and only touch the projection,
so they compose with ``df.transform`` and Catalyst collapses them into one
Project next to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_name
from ..functions.text import lenient_double, strip_ws


def clean_columns(df: DataFrame, rule: Callable[[str], str] = clean_name) -> DataFrame:
    """Rename every column with ``rule`` (B1); raises if two names collide."""
    new = [rule(c) for c in df.columns]
    dupes = sorted({n for n in new if new.count(n) > 1})
    if dupes:
        raise ValueError(f"column names collide after renaming: {dupes}")
    return df.toDF(*new)


def rename_strict(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by mapping (B3); every source name must exist.

    ``withColumnsRenamed`` silently ignores missing names, which hides a
    changed delivery; this raises instead.
    """
    missing = [k for k in mapping if k not in df.columns]
    if missing:
        raise KeyError(f"columns to rename not found: {missing}; have {df.columns}")
    return df.withColumnsRenamed(mapping)


def columns_matching(df: DataFrame, *, contains: str | None = None,
                     startswith: str | None = None, exclude: Iterable[str] = ()) -> list[str]:
    """Names selected by substring / prefix, minus ``exclude``."""
    ex = set(exclude)
    out = []
    for c in df.columns:
        if c in ex:
            continue
        if contains is not None and contains not in c:
            continue
        if startswith is not None and not c.startswith(startswith):
            continue
        out.append(c)
    return out


def apply_to(df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Replace each listed column by ``fn(col)`` in place, one projection."""
    cols = list(cols)
    return df.withColumns({c: fn(F.col(c)) for c in cols}) if cols else df


def strip_all(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Strip Unicode whitespace on every string column."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return apply_to(df, cols, strip_ws)


def lenient_cast(df: DataFrame, cols: Iterable[str], dtype: str = "double",
                 thousands_sep: str | None = None) -> DataFrame:
    """Cast text columns, unparseable text -> null.

    ``double`` uses the decimal-number guard of ``lenient_double``; other types
    use ``try_cast``.
    """
    if dtype == "double":
        return apply_to(df, cols, lambda c: lenient_double(c, thousands_sep))
    return apply_to(df, cols, lambda c: c.try_cast(dtype))


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    """Constant column; replacing an existing one keeps its position."""
    return df.withColumn(name, F.lit(value))
