
import re

import pytest

from pinax.plans import catalog
from tests.conftest import SF01

PYTHON_NODES = ("MapInPandas", "PythonMapInArrow", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas")
PY_ALLOWED = {"q36_page_tables"}
# A national series (one row per year, an aggregate) is indexed in one task.
ONE_SERIES = {"q16_vs_national", "q33_delivery_vs_country"}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan_text(fn(spark, SF01)) for n, fn in catalog.QUERIES.items()}


def test_no_cartesian_or_nested_loop(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_single_partition_only_after_partial_aggregation(plans):
    """A whole table never funnels into one task: a SinglePartition exchange may
    only carry the per-task results of a partial aggregate."""
    for name, p in plans.items():
        if name in ONE_SERIES:
            continue
        lines = p.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                child = lines[i + 1] if i + 1 < len(lines) else ""
                assert "partial_" in child or "keys=[]" in child and "HashAggregate" in child, \
                    f"{name}: {line.strip()} <- {child.strip()}"


def test_python_only_where_parsing_needs_it(plans):
    for name, p in plans.items():
        has_py = any(n in p for n in PYTHON_NODES)
        assert has_py == (name in PY_ALLOWED), name


def test_windows_are_partitioned(plans):
    for name, p in plans.items():
        if name in ONE_SERIES:
            continue
        for m in re.finditer(r"Window \[.*?\], \[(.*?)\], \[", p):
            assert m.group(1).strip(), f"{name}: window without partitionBy"


def test_pushdown_and_pruning(spark):
    p = plan_text(catalog.q21_stack_slices(spark, SF01))
    assert p.count("ReadSchema") == 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in p
    q02 = plan_text(catalog.q02_price_index(spark, SF01))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in q02
    q05 = plan_text(catalog.q05_regex_keep(spark, SF01))
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in q05


def test_index_window_form_one_exchange_on_entity(spark):
    p = plan_text(catalog.q02_price_index(spark, SF01))
    assert len(re.findall(r"Exchange hashpartitioning\(n_name#\d+, \d+\)", p)) == 1


def test_hot_customer_is_split_by_aqe(spark):
    """A third of all orders on one customer: with the join as a sort-merge join,
    AQE splits the hot partition (map outputs of many tasks) and the totals stay
    whole.  Thresholds are scaled down to the size of the test data."""
    from pyspark.sql import functions as F
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.shuffle.partitions": "32",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        o = spark.read.parquet(f"{SF01}/orders.parquet")
        hot = (o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(42))
                            .otherwise(F.col("o_custkey")))
                .repartition(16))          # many map tasks, as a large input has
        c = spark.read.parquet(f"{SF01}/customer.parquet").select("c_custkey", "c_nationkey")
        j = (hot.join(c, hot["o_custkey"] == c["c_custkey"])
                .groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"),
                                            F.sum("o_totalprice").alias("v")))
        assert sum(r.n for r in j.collect()) == o.count()
        final = plan_text(j).split("== Initial Plan ==")[0]
        assert "SortMergeJoin(skew=true)" in final and "skewed" in final
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_join_form_prunes_to_the_base_period(spark, tmpdir_path):
    """A panel stored partitioned by period: the base side of the join form reads
    one partition, and the base table is broadcast, so the panel is not shuffled."""
    from pinax.operators import index
    from pinax.plans.panels import nation_year_prices
    from pinax.sources.files import write_table
    path = f"{tmpdir_path}/panel"
    write_table(nation_year_prices(spark, SF01), path, partition_by=["year"])
    panel = spark.read.parquet(path)
    out = index.price_index(panel, ["n_name"], "year", 1995, ["price"], how="join")
    out.collect()
    final = plan_text(out).split("== Initial Plan ==")[0]
    assert re.search(r"PartitionFilters: \[isnotnull\(year#\d+\), \(year#\d+ = 1995\)\]", final)
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final
    # the only shuffle is the base side's aggregation of its one period
    assert len(re.findall(r"Exchange hashpartitioning\(n_name#\d+, \d+\)", final)) == 1
    assert len(re.findall(r"(?<!Broadcast)Exchange ", final)) == 1


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["q16_vs_national", "q18_long_series", "q17_pivot"])
def test_selection_is_applied_at_the_scan(spark, name):
    """The listed nations are filtered below the window and the aggregate."""
    lines = optimized(catalog.QUERIES[name](spark, SF01)).splitlines()
    depth = lambda ln: len(ln) - len(ln.lstrip(" :|+-"))
    window = max(i for i, ln in enumerate(lines) if "Window [" in ln and "n_name" in ln)
    aggregate = next(i for i, ln in enumerate(lines) if i > window and "Aggregate [n_name" in ln)
    chosen = [i for i, ln in enumerate(lines) if "Filter" in ln and "n_name" in ln and "IN" in ln]
    assert chosen and all(i > aggregate and depth(lines[i]) > depth(lines[aggregate]) for i in chosen)


def test_panel_is_computed_once(spark):
    for name in ("q13_index_base_join", "q33_delivery_vs_country"):  # staged
        p = plan_text(catalog.QUERIES[name](spark, SF01))
        assert "lineitem.parquet" not in p and "orders.parquet" not in p
    for name, table, n in (("q23_index_edge_cases", "orders", 1), ("q31_delivery_panel", "lineitem", 1),
                           ("q31_delivery_country", "lineitem", 1), ("q32_delivery_index", "lineitem", 1)):
        text = optimized_scans(catalog.QUERIES[name](spark, SF01), table)
        assert text == n, name


def optimized_scans(df, table: str) -> int:
    p = plan_text(df)
    return len([ln for ln in p.splitlines() if "FileScan" in ln and f"{table}.parquet" in ln])


def test_starred_cells_do_not_depend_on_the_size(spark):
    from pinax.plans.panels import STARRED
    for d in ("/root/testdata/sf0.001", SF01):
        rows = catalog.q31_delivery_panel(spark, d).collect()
        nulls = {(r.locality, r.year) for r in rows if r.average_price_nominal_euros is None}
        assert nulls == set(STARRED) & {(r.locality, r.year) for r in rows}
        assert len(nulls) < len(rows) / 10


def test_page_tables_parse_each_page_once(spark):
    p = plan_text(catalog.q36_page_tables(spark, SF01))
    assert len(re.findall(r"MapInPandas", p)) == 1
