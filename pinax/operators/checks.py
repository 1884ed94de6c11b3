"""Data checks as ordinary Spark jobs (C4, K1-K6).

Each check returns a DataFrame (a report); an empty report or all-true flags
mean "pass".  Comparisons of two versions use a union + ``groupBy`` rather
than a full outer join: the aggregation combines map-side, so a key that holds
a large share of the rows does not end up as one huge join partition, and one
shuffle replaces two.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import lenient_double


def null_rows(df: DataFrame, col: str) -> DataFrame:
    """Rows where ``col`` is null (C4, listing form)."""
    return df.filter(F.col(col).isNull())


def null_report(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """One row: ``n_rows`` and ``<col>_nulls`` for each column, in one pass (C4)."""
    cols = list(cols) if cols is not None else df.columns
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols])


def duplicate_keys(df: DataFrame, keys: list[str], count_col: str = "n") -> DataFrame:
    """Key combinations that occur more than once (K6), with their count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
              .filter(F.col(count_col) > 1))


def totals_match(detail: DataFrame, totals: DataFrame, period: str, value: str,
                 total_value: str, tolerance: float = 0.0) -> DataFrame:
    """Per period: sum of details against the published total (K1).

    Output ``(period, total, detail_sum, diff, ok)``; a period present on one
    side only gets ``ok = false``.
    """
    d = detail.select(period, F.col(value).alias("__v"), F.lit(None).cast("double").alias("__t"))
    t = totals.select(period, F.lit(None).cast("double").alias("__v"),
                      F.col(total_value).cast("double").alias("__t"))
    g = (d.unionByName(t).groupBy(period)
          .agg(F.max("__t").alias("total"), F.sum("__v").alias("detail_sum"),
               F.count("__t").alias("__nt")))
    diff = F.col("detail_sum") - F.col("total")
    ok = F.coalesce((F.abs(diff) <= F.lit(tolerance)) & (F.col("__nt") == 1), F.lit(False))
    return g.select(period, "total", "detail_sum", diff.alias("diff"), ok.alias("ok"))


def revisions(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows added, removed or changed between two deliveries (K2).

    Output ``(keys, kind, old_<v>, new_<v>)`` for every key whose row differs;
    ``kind`` is ``added`` / ``removed`` / ``changed`` / ``duplicate`` (a key
    occurring twice in one version).  Values compare null-safely.
    """
    def side(df, tag):
        return df.select(*keys, F.lit(tag).alias("__ver"), *[F.col(v) for v in values])

    u = side(old, 0).unionByName(side(new, 1))
    is_old, is_new = F.col("__ver") == 0, F.col("__ver") == 1
    g = u.groupBy(*keys).agg(
        F.count_if(is_old).alias("__n_old"), F.count_if(is_new).alias("__n_new"),
        *[F.max(F.when(is_old, F.col(v))).alias(f"old_{v}") for v in values],
        *[F.max(F.when(is_new, F.col(v))).alias(f"new_{v}") for v in values])
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    kind = (F.when((F.col("__n_old") > 1) | (F.col("__n_new") > 1), F.lit("duplicate"))
             .when(F.col("__n_old") == 0, F.lit("added"))
             .when(F.col("__n_new") == 0, F.lit("removed"))
             .when(~same, F.lit("changed")))
    return (g.withColumn("kind", kind).filter(F.col("kind").isNotNull())
             .select(*keys, "kind", *[f"old_{v}" for v in values], *[f"new_{v}" for v in values]))


def cast_failures(df: DataFrame, cols: Iterable[str], tolerance: float = 0.0) -> DataFrame:
    """Share of non-null values that a lenient double cast turns into null (K3).

    One row: ``<col>_fail_share`` per column, and ``ok`` when all are within
    ``tolerance``.
    """
    cols = list(cols)
    shares = [F.avg(F.when(F.col(c).isNotNull(),
                           lenient_double(F.col(c)).isNull().cast("double"))).alias(f"{c}_fail_share")
              for c in cols]
    out = df.agg(*shares)
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.coalesce(F.col(f"{c}_fail_share") <= F.lit(tolerance), F.lit(True))
    return out.withColumn("ok", ok)


def schema_drift(expected: StructType, df: DataFrame) -> list[tuple[str, str, str]]:
    """Metadata diff ``[(column, expected_type, actual_type)]`` (K3); no job runs."""
    exp = {f.name: f.dataType.simpleString() for f in expected.fields}
    act = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for name in sorted(set(exp) | set(act)):
        if exp.get(name) != act.get(name):
            out.append((name, exp.get(name, "missing"), act.get(name, "missing")))
    return out


def schema_versions(headers: DataFrame, expected: list[str]) -> DataFrame:
    """``(columns, n_parts, n_files, first_path, missing, unexpected, moved)``: layouts found in many files (K3).

    ``headers`` has ``path, part, columns``, a row for each file or sheet (see
    ``sheet_headers`` and ``file_headers``).  A layout is told with how many have
    it; ``missing`` and ``unexpected`` are names against ``expected``, ``moved``
    that the same names stand in another order.  A null ``columns`` is a part without a header.
    ``headers`` joined with a layout gives the files that hold it.
    """
    want = F.array(*[F.lit(c) for c in expected])
    found = headers.groupBy("columns").agg(F.count("*").alias("n_parts"), F.count_distinct("path").alias("n_files"),
                                           F.min("path").alias("first_path"))
    here = F.coalesce("columns", F.array().cast("array<string>"))
    missing, unexpected = F.array_sort(F.array_except(want, here)), F.array_sort(F.array_except(here, want))
    moved = ((F.size(missing) == 0) & (F.size(unexpected) == 0) & (F.size(here) == len(expected))
             & ~here.eqNullSafe(want))
    return found.select("*", missing.alias("missing"), unexpected.alias("unexpected"), moved.alias("moved"))


def drifted(versions: DataFrame, expected: list[str]) -> DataFrame:
    """The layouts of ``schema_versions`` that differ from the expected one in any way."""
    return versions.filter(~F.col("columns").eqNullSafe(F.array(*[F.lit(c) for c in expected])))


def churn(df: DataFrame, key: str, period: str) -> DataFrame:
    """First and last period per entity, flagged against the whole panel (K4).

    ``appeared``: first period after the panel's first; ``vanished``: last
    period before the panel's last.  The panel bounds are scalar subqueries over
    the entities' spans, whose aggregate Spark computes once and reuses.
    """
    spans = df.groupBy(key).agg(F.min(period).alias("first_period"),
                                F.max(period).alias("last_period"))
    lo = spans.select(F.min("first_period")).scalar()
    hi = spans.select(F.max("last_period")).scalar()
    return spans.select(key, "first_period", "last_period",
                        (F.col("first_period") > lo).alias("appeared"),
                        (F.col("last_period") < hi).alias("vanished"))


def fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Order-free fingerprint of a table (K5): row count and two sums of row hashes.

    Independent of partitioning and row order; equal inputs give equal
    fingerprints on any cluster size.  A row is hashed as text: each value after its
    length, nulls marked, so neither a null that moves between columns nor a
    shifted border between two values goes unnoticed.  MD5 is what other engines
    have too; two 60-bit parts of it are summed exactly.
    """
    cells = [F.coalesce(F.concat(F.length(s), F.lit(":"), s), F.lit("-"))
             for s in (F.col(f"`{c}`").cast("string") for c in cols or df.columns)]
    h = F.md5(F.concat(*cells))
    part = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.coalesce(F.sum(part(1)), F.lit(0)).cast("string").alias("hash_sum"),
                  F.coalesce(F.sum(part(17)), F.lit(0)).cast("string").alias("hash_sum_2"))
