"""Differing buckets of two versions, found from the root down."""

import os

from pyspark.sql import functions as F

from pinax.operators import hashtree


def versions(spark, folder, n=6000):
    old = spark.range(n).select("id", (F.col("id") * 7).alias("v"), F.when(F.col("id") % 5 > 0, F.lit("x")).alias("s"))
    new = (old.filter("id <> 77").withColumn("v", F.col("v") + (F.col("id") == 500).cast("long"))
           .union(spark.range(n, n + 1).select("id", F.lit(1), F.lit(None))))
    paths = [os.path.join(folder, x) for x in ("old", "new")]
    hashtree.write_bucketed(old, paths[0], ["id"])
    hashtree.write_bucketed(new.repartition(5), paths[1], ["id"])
    return paths


def test_only_changed_buckets_are_told(spark, tmpdir_path):
    paths = versions(spark, tmpdir_path)
    changed, rows = hashtree.changes(spark, *paths, ["id"], ["v", "s"])
    want = {r[0] for r in spark.createDataFrame([(77,), (500,), (6000,)], "id long").select(hashtree.bucket_of(["id"])).collect()}
    assert {r.node for r in changed.collect()} == want
    assert {(r.id, r.kind) for r in rows.collect()} == {(77, "removed"), (500, "changed"), (6000, "added")}
    assert "PushedFilters: [In(bucket" in rows._jdf.queryExecution().executedPlan().toString()


def test_equal_versions_have_equal_roots(spark, tmpdir_path):
    paths = versions(spark, tmpdir_path)
    read = lambda p: hashtree.leaves(spark.read.parquet(p), ["id", "v", "s"])
    assert hashtree.same(read(paths[0]), hashtree.leaves(spark.read.parquet(paths[0]).repartition(3), ["id", "v", "s"]))
    assert not hashtree.same(read(paths[0]), read(paths[1]))
    assert hashtree.differing(read(paths[0]), read(paths[0])).count() == 0


def test_many_changes_are_read_by_a_join(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(hashtree, "NAMED", 1)
    _, rows = hashtree.changes(spark, *versions(spark, tmpdir_path), ["id"], ["v", "s"])
    assert {(r.id, r.kind) for r in rows.collect()} == {(77, "removed"), (500, "changed"), (6000, "added")}


def test_nulls_that_move_are_seen(spark):
    rows = lambda a, b: spark.createDataFrame([("k", a, b)], "k string, a string, b string").withColumn(
        "bucket", hashtree.bucket_of(["k"]))
    tree = lambda a, b: hashtree.leaves(rows(a, b), ["k", "a", "b"])
    assert not hashtree.same(tree("x", None), tree(None, "x")) and not hashtree.same(tree("ab", "c"), tree("a", "bc"))
    assert hashtree.same(tree(None, "x"), tree(None, "x"))
