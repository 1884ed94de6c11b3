"""Panels built from the test tables: entity = nation, period = year.

These are the inputs the catalogue queries index and check.  Money is summed
as whole cents (``bigint``) so sums are exact and independent of the order in
which partitions are combined; averages are then one IEEE division, which any
engine computes to the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Schemas of the test tables: passed to the reader, so no job looks into the files first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str | Column) -> Column:
    """Money with two decimals as exact whole cents."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(100)).cast("bigint")


def exact_avg(cents_col: str, count_col: str) -> Column:
    """Average in currency units from a cents sum and a row count."""
    return F.col(cents_col).cast("double") / F.col(count_col).cast("double") / F.lit(100.0)


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's nation and year: ``(n_name, year, o_*)``.

    orders -> customer is a many-to-one join on the customer key (sort-merge
    at scale, AQE splits a customer holding many orders); nation is 25 rows
    and broadcast by Spark's size check.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (o.join(c, o["o_custkey"] == c["c_custkey"])
             .join(n, F.col("c_nationkey") == n["n_nationkey"])
             .select("o_orderkey", "o_custkey", "o_totalprice", "year", "n_name"))


def nation_year_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel ``(n_name, year, price, n_orders)``: average order price per nation and year.

    The aggregation is partial before the shuffle, so the shuffle carries at
    most (tasks x nations x years) rows whatever the size of orders.
    """
    g = (orders_by_nation(spark, sf_dir)
         .groupBy("n_name", "year")
         .agg(F.sum(cents("o_totalprice")).alias("__c"), F.count(F.lit(1)).alias("n_orders")))
    return g.select("n_name", "year", exact_avg("__c", "n_orders").alias("price"), "n_orders")


def year_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National series ``(year, price, n_orders)`` over all orders (no join needed)."""
    o = table(spark, sf_dir, "orders")
    g = (o.groupBy(F.year("o_orderdate").alias("year"))
          .agg(F.sum(cents("o_totalprice")).alias("__c"), F.count(F.lit(1)).alias("n_orders")))
    return g.select("year", exact_avg("__c", "n_orders").alias("price"), "n_orders")


# Header texts of a delivery sheet, as they are printed in the workbook.
SHEET_HEADERS = ["Commune", "Nombre d'offres", "Prix moyen annoncé en € courant",
                 "Prix moyen annoncé au m² en € courant"]
# Cells that are published as '*': these nations in these years, at any size of the data.
STARRED = [("NATION_3", 1996), ("NATION_5", 1998), ("NATION_10", 1995), ("NATION_23", 2000)]


def delivery_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and line-item sums per (year, nation) and per year.

    Line items are summed per order first (partial aggregation before the
    shuffle; the result is already partitioned by order key for the join), so
    lineitem is shuffled once at the size of orders.  The sums add up, so the
    national rows are rolled up from the (year, nation) rows; ``is_nat`` marks them.
    """
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.sum(cents("l_extendedprice")).alias("ec"),
               F.sum(F.col("l_quantity").cast("bigint")).alias("q")))
    o = orders_by_nation(spark, sf_dir).select("o_orderkey", "n_name", "year",
                                               cents("o_totalprice").alias("c"))
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left")
    by_nation = j.groupBy("year", "n_name").agg(
        F.sum("c").alias("cents"), F.count(F.lit(1)).alias("n_orders"),
        F.sum("ec").alias("unit_cents"), F.sum("q").alias("qty"))
    return (by_nation.groupingSets([["year", "n_name"], ["year"]], "year", "n_name")
            .agg(*[F.sum(c).alias(c) for c in ("cents", "n_orders", "unit_cents", "qty")],
                 (F.grouping("n_name") == 1).alias("is_nat")))


def delivery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sheet rows as a statistics office would publish them, from the tables.

    One sheet per order year: a detail row per nation (name padded with spaces
    and a no-break space, numbers as text, '*' for the prices in ``STARRED``), then the national average, the offer total and a
    source note.  Every cell is a string; ``sheet`` holds the year.
    """
    g = delivery_sums(spark, sf_dir)
    txt = lambda c: c.cast("string")
    price = txt(exact_avg("cents", "n_orders"))
    unit = txt(F.col("unit_cents").cast("double") / F.col("qty").cast("double") / F.lit(100.0))
    none = F.lit(None).cast("string")
    names = ["name", "offers", "price", "unit"]
    starred = F.coalesce(F.concat_ws("@", "n_name", "year").isin([f"{n}@{y}" for n, y in STARRED]), F.lit(False))

    def row(*cells):
        return F.struct(*[c.alias(n) for c, n in zip(cells, names)])

    detail = row(F.concat(F.lit("  "), F.col("n_name"), F.lit("\u00a0")), txt(F.col("n_orders")),
                 F.when(starred, F.lit("*")).otherwise(price), unit)
    national = [row(F.lit("Moyenne nationale"), none, price, unit),
                row(F.lit("Total d'offres"), txt(F.col("n_orders")), none, none),
                row(F.lit("Source : order book"), none, none, none)]
    rows = g.select(txt(F.col("year")).alias("sheet"),
                    F.explode(F.when(F.col("is_nat"), F.array(*national))
                               .otherwise(F.array(detail))).alias("r"))
    return rows.select(*[F.col(f"r.{n}").alias(h) for n, h in zip(names, SHEET_HEADERS)], "sheet")
