"""Output series: selections, comparison with a reference series, wide and
long layouts (J1-J3, C5, A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_entities(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows of the listed entities (J1, C5), the list being one parameter.

    A predicate on the key: below a window or an aggregate by the entity Spark
    pushes it to the scan, so only the listed entities are computed.
    """
    return df.filter(F.col(key).isin(list(values)))


def long_series(df: DataFrame, keys: list[str], period: str, measures: list[str],
                series_col: str = "series", value_col: str = "value") -> DataFrame:
    """Wide measures to ``(keys, period, series, value)`` (A12), via ``unpivot``."""
    return df.unpivot([*keys, period], measures, series_col, value_col)


def compare_to(df: DataFrame, ref: DataFrame, on: list[str], value: str, ref_value: str,
               gap_col: str = "gap", digits: int | None = None) -> DataFrame:
    """Join each entity's series to a reference series on the period.

    ``ref`` is one row per period (a national series); the join is on the
    period only, so the reference side is as small as the number of periods.
    """
    gap = F.col(value) - F.col(ref_value)
    if digits is not None:
        gap = F.round(gap, digits)
    return df.join(ref.select(*on, ref_value), on=on, how="inner").withColumn(gap_col, gap)


def pivot_wide(df: DataFrame, period: str, entity: str, value: str, entities: list,
               periods: DataFrame | None = None) -> DataFrame:
    """One column per listed entity, one row per period.

    The values are given, so Spark does not run a job to find them and the
    output schema is fixed.  Other entities are filtered out first.
    ``periods`` (one column) adds rows for periods in which no listed entity
    has one.  (period, entity) is expected unique; ``max`` keeps the result
    deterministic.
    """
    wide = (select_entities(df, entity, entities).groupBy(period).pivot(entity, entities)
            .agg(F.max(F.col(value))))
    return wide if periods is None else periods.select(period).distinct().join(wide, period, "left")
