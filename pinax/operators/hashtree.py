"""Where two versions of a table differ (K5): hash trees over key buckets.

Keys fall into a fixed number of buckets.  A bucket's hash is a sum over its
rows, a node's the sum over its buckets, so equal tables have equal roots in any
order and on any cluster.  Two trees are compared from the root down, through
differing nodes only, and of the tables only differing buckets are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import drop_staged, stage
from .checks import revisions

#: Hexadecimal digits of a bucket's number (4,096 buckets), and those by which each level goes down.
DIGITS, STEP = 3, 1


def _text(cols: list[str]) -> Column:
    """The values as one text, each after its length, nulls marked."""
    return F.concat(*[F.coalesce(F.concat(F.length(s), F.lit(":"), s), F.lit("-"))
                      for s in (F.col(f"`{c}`").cast("string") for c in cols)])


def bucket_of(keys: list[str], digits: int = DIGITS) -> Column:
    return F.substring(F.md5(_text(keys)), 1, digits)


def write_bucketed(df: DataFrame, path: str, keys: list[str], digits: int = DIGITS) -> None:
    """Write a version with its rows in order of their buckets.

    Rows are range-partitioned and sorted by ``bucket``, so each file and row
    group holds few buckets and a reader that asks for some skips the others by
    their statistics.
    """
    (df.withColumn("bucket", bucket_of(keys, digits)).repartitionByRange("bucket").sortWithinPartitions("bucket")
     .write.mode("overwrite").parquet(path))


def leaves(version: DataFrame, cols: list[str]) -> DataFrame:
    """``(node, n_rows, sum_1, sum_2)`` for each bucket: at most ``16 ** digits`` rows."""
    h = F.md5(_text(cols))
    part = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")
    return version.groupBy(F.col("bucket").alias("node")).agg(
        F.count("*").alias("n_rows"), F.sum(part(1)).alias("sum_1"), F.sum(part(17)).alias("sum_2"))


def differing(old: DataFrame, new: DataFrame, digits: int = DIGITS, step: int = STEP) -> DataFrame:
    """``(node, old_rows, new_rows)`` of the buckets in which two tables of ``leaves`` differ.

    Goes down level by level: below a node that is equal in both nothing is compared.
    """
    both = old.withColumn("v", F.lit("old")).unionByName(new.withColumn("v", F.lit("new")))
    for at in range(0, digits + 1, step):
        nodes = both.groupBy(F.substring("node", 1, at).alias("above")).agg(*[
            F.sum(F.when(F.col("v") == v, F.col(c)).otherwise(F.lit(0))).alias(f"{v}_{c}")
            for v in ("old", "new") for c in ("n_rows", "sum_1", "sum_2")])
        same = [F.col(f"old_{c}") == F.col(f"new_{c}") for c in ("n_rows", "sum_1", "sum_2")]
        unequal = nodes.filter(~(same[0] & same[1] & same[2]))
        if at < digits:
            both = both.join(unequal.select("above"), F.substring("node", 1, at) == F.col("above"), "left_semi")
    return unequal.select(F.col("above").alias("node"), F.col("old_n_rows").cast("long").alias("old_rows"),
                          F.col("new_n_rows").cast("long").alias("new_rows"))


#: Buckets up to which a reader is told their names, so that files without them are skipped.
NAMED = 256


def _read(spark: SparkSession, path: str, changed: DataFrame, names: list[str] | None) -> DataFrame:
    rows = spark.read.parquet(path)
    if names is not None:
        return rows.filter(F.col("bucket").isin(names))
    return rows.join(changed.select(F.col("node").alias("bucket")), "bucket", "left_semi")


def changes(spark: SparkSession, old_path: str, new_path: str, keys: list[str], values: list[str],
            digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """Differing buckets, and the rows in them that were added, removed or changed.

    Both versions were written by ``write_bucketed``.  The second frame is
    ``revisions`` of the differing buckets' rows alone: with few of them their
    names become a filter that the scan applies to its statistics.
    """
    cols = [*keys, *values]
    trees = [leaves(spark.read.parquet(p).select("bucket", *cols), cols) for p in (old_path, new_path)]
    changed = stage(differing(*trees, digits), "hash-tree")
    first = changed.select("node").limit(NAMED + 1).collect()
    names = [r[0] for r in first] if len(first) <= NAMED else None
    rows = [_read(spark, p, changed, names) for p in (old_path, new_path)]
    return changed, revisions(*rows, keys, values)


def same(old: DataFrame, new: DataFrame) -> bool:
    """Whether two tables of ``leaves`` have equal roots."""
    found = stage(differing(old, new, 0), "hash-root")
    equal = found.isEmpty()
    drop_staged(found)
    return equal
