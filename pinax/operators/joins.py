"""Joins with the guards the panel work needs.

Join strategy is left to Spark: a side whose size is known to be under
``spark.sql.autoBroadcastJoinThreshold`` (file statistics, or the measured
shuffle size under AQE) is broadcast, anything else is a sort-merge join with
AQE's skew splitting.  No helper here forces a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_on(df: DataFrame, keys: list[str], what: str = "lookup side") -> DataFrame:
    """``df`` with a lazy guard: the job fails if ``keys`` repeat.

    Implemented as an aggregation (combined map-side) and a filter that raises,
    so the check costs one shuffle of the lookup side, no extra action, and stays
    when later steps drop the value columns.  Rows with a null key are dropped:
    they cannot match an inner or left join, and are not checked.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    others = [c for c in df.columns if c not in keys]
    g = df.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"),
                                            *[F.max(F.col(c)).alias(c) for c in others])
    msg = F.lit(f"keys {keys} are not unique in the {what}")
    once = F.when(F.col("__n") > 1, F.raise_error(msg)).otherwise(F.lit(True))
    return g.filter(once).select(*df.columns)


def join_lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Many-to-one join (E1): ``right`` must be unique on ``on`` or the job fails,
    so rows of ``left`` can never be multiplied."""
    return left.join(unique_on(right, on), on=on, how=how)
