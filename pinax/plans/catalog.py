"""

Each entry is a function ``(spark, sf_dir) -> DataFrame`` built from the
library's operators, plus (where SQL can say the same thing) an oracle SQL
string for DuckDB on the same parquet tables.  Every query reads whole tables;
computed columns carry the same names on both sides.

Numbers are made comparable bit for bit rather than rounded: money is summed
in whole cents and divided once, so both engines perform the same IEEE
operations on the same inputs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, columns, entities, hashtree, index, lineage, route, series
from ..operators.joins import join_lookup
from ..session import checkpoint_dir
from ..sources import html
from ..sources.files import (file_headers, quarantine, read_csv, read_csv_checked, read_series, read_sheet_exports,
                             read_tagged, stage, write_series_clustered, write_table)
from . import sqltext as S
from . import stages
from .panels import (STARRED, cents, delivery_rows, nation_year_prices, orders_by_nation, table,
                     year_prices)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- fixed parameters of the catalogue ---------------------------------------
BASE_YEAR = 1995
FILL_BASE_YEAR = 1997
SELECTED = ["NATION_1", "NATION_5", "NATION_10", "NATION_17", "NATION_23"]
PIVOTED = ["NATION_3", "NATION_7"]
# Q23 probes: null base price, zero base price, no base row.
NULL_BASE, ZERO_BASE, NO_BASE = "NATION_2", "NATION_4", "NATION_6"
EVENT_RULES = [("drop", "error"), ("total", "purchase|signup")]
RECODE_RULES = [("ring|bolt", "fastener"), ("fast", "FAST")]
# -----------------------------------------------------------------------------

_IN_SELECTED = ", ".join(f"'{n}'" for n in SELECTED)


def _indexed(spark, d, base=BASE_YEAR):
    p = nation_year_prices(spark, d).select("n_name", "year", "price")
    return index.price_index(p, ["n_name"], "year", base, {"price": ("p0", "pl")})


# Q02 (I1, H3, D8): the flagship, the reference's own shape (base value per
# entity carried over the years; window over the aggregated panel).
@register("q02_price_index", S.index_join(S.NATION_YEAR, "n_name", BASE_YEAR))
def q02_price_index(spark, d):
    return _indexed(spark, d)


# Q13 (E2): the same index with the base value joined per entity.  Both sides of
# the join read the panel, so it is staged: computed once.
@register("q13_index_base_join", S.index_join(S.NATION_YEAR, "n_name", BASE_YEAR))
def q13_index_base_join(spark, d):
    p = stage(nation_year_prices(spark, d).select("n_name", "year", "price"), "q13")
    return index.price_index(p, ["n_name"], "year", BASE_YEAR, {"price": ("p0", "pl")}, how="join")


# Q03 (D1, B7): Unicode strip of whole documents padded with space, tab, NBSP.
_PAD_SQL = "(' ' || chr(9) || chr(160) || text || chr(160) || chr(10) || ' ')"


@register("q03_strip_text", f"""
SELECT doc_id, CAST(length(text) AS INTEGER) AS n_raw,
       {S.strip(_PAD_SQL)} AS padded_stripped, {S.strip('text')} AS stripped
FROM documents""")
def q03_strip_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    pad = F.concat(F.lit(" \t\u00a0"), F.col("text"), F.lit("\u00a0\n "))
    return docs.select("doc_id", F.length("text").alias("n_raw"),
                       T.strip_ws(pad).alias("padded_stripped"), T.strip_ws("text").alias("stripped"))


# Q04 (D2): lenient cast of text cells.
@register("q04_lenient_cast", f"""
SELECT event_id, {S.lenient("regexp_extract(props, '[0-9]+', 0)")} AS k,
       {S.lenient('event_type')} AS event_type_num, {S.lenient('props')} AS props_num
FROM events""")
def q04_lenient_cast(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id",
                     T.lenient_double(F.regexp_extract("props", "[0-9]+", 0)).alias("k"),
                     T.lenient_double("event_type").alias("event_type_num"),
                     T.lenient_double("props").alias("props_num"))


# Q05 (C1, C2): regex filter and its negation.
@register("q05_regex_keep", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, 'PROMO|ECO')")
def q05_regex_keep(spark, d):
    return route.keep_matching(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "PROMO|ECO")


@register("q05_regex_drop", "SELECT p_partkey, p_type FROM part WHERE NOT regexp_matches(p_type, 'PROMO|ECO')")
def q05_regex_drop(spark, d):
    return route.drop_matching(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "PROMO|ECO")


# Q06 (C7): first-match routing of rows into classes.
@register("q06_route_rows", """
SELECT event_id, event_type,
       CASE WHEN event_type IS NULL THEN 'null'
            WHEN regexp_matches(event_type, 'error') THEN 'drop'
            WHEN regexp_matches(event_type, 'purchase|signup') THEN 'total'
            ELSE 'detail' END AS row_class
FROM events""")
def q06_route_rows(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type")
    return route.route(ev, "event_type", EVENT_RULES, default="detail")


# Q07 (B2, D9): the name rule as a row operator over whole texts.
@register("q07_name_rule", f"SELECT doc_id, {S.name_rule('text')} AS name_key FROM documents")
def q07_name_rule(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", T.name_rule("text").alias("name_key"))


# Q08 (D3, D4): regex replace and trailing-marker removal (the marker is added first).
@register("q08_regex_replace", r"""
SELECT p_partkey, p_name, regexp_replace(p_name, ' .*$', '', 'g') AS first_word,
       regexp_replace(p_name || ' †', ' .\z', '', 'g') AS no_marker,
       regexp_replace(p_type, ' .\z', '', 'g') AS type_no_marker
FROM part""")
def q08_regex_replace(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", "p_name", T.replace_all("p_name", " .*$", "").alias("first_word"),
                    T.drop_trailing_marker(F.concat("p_name", F.lit(" †"))).alias("no_marker"),
                    T.drop_trailing_marker("p_type").alias("type_no_marker"))


# Literal character replacement.
@register("q08_replace_chars", "SELECT doc_id, translate(text, 'éèêöüä', 'eeeoua') AS plain FROM documents")
def q08_replace_chars(spark, d):
    docs = table(spark, d, "documents")
    plain = T.replace_chars("text", dict(zip("éèêöüä", "eeeoua")))
    return docs.select("doc_id", plain.alias("plain"))


# Q09 (D6): ordered recode, the second rule sees the first rule's output.
@register("q09_recode", """
SELECT p_partkey, p_name, CASE WHEN regexp_matches(r1, 'fast') THEN 'FAST' ELSE r1 END AS recoded
FROM (SELECT p_partkey, p_name,
             CASE WHEN regexp_matches(p_name, 'ring|bolt') THEN 'fastener' ELSE p_name END AS r1
      FROM part)""")
def q09_recode(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return T.recode(p, "p_name", RECODE_RULES, to="recoded")


# Q09 report: what the ordered rules change, with counts (section 7.4 of the survey).
@register("q09_recode_report", """
SELECT before, after, count(*) AS n
FROM (SELECT p_name AS before,
             CASE WHEN regexp_matches(r1, 'fast') THEN 'FAST' ELSE r1 END AS after
      FROM (SELECT p_name,
                   CASE WHEN regexp_matches(p_name, 'ring|bolt') THEN 'fastener' ELSE p_name END AS r1
            FROM part))
WHERE before IS DISTINCT FROM after
GROUP BY before, after""")
def q09_recode_report(spark, d):
    return entities.recode_report(table(spark, d, "part"), "p_name", RECODE_RULES)


# Q10 (E1, B10, B6): national price joined to the yearly offer count.
@register("q10_country_join", f"""
SELECT 'ALL' AS locality, y.price, y.year, c.n_offers
FROM ({S.YEAR}) y
JOIN (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n_offers
      FROM lineitem GROUP BY 1) c ON y.year = c.year""")
def q10_country_join(spark, d):
    level = year_prices(spark, d).select(F.lit("national").alias("locality"), "price", "year")
    offers = (table(spark, d, "lineitem")
              .groupBy(F.year("l_shipdate").alias("year"))
              .agg(F.count(F.lit(1)).alias("n_offers")))
    out = join_lookup(level, offers, ["year"])
    return columns.with_constant(out.select("locality", "price", "year", "n_offers"), "locality", "ALL")


# Q11 (E3, C6): coverage - documents without a label.
@register("q11_unlabelled_docs", """
SELECT DISTINCT doc_id FROM documents d
WHERE doc_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q11_unlabelled_docs(spark, d):
    return entities.missing_from(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"))


# Q12 (H1, H2, D7): base value on the base row only, forward-filled.
@register("q12_forward_fill", f"""
WITH p AS ({S.NATION_YEAR}),
f AS (SELECT n_name, year, price,
             last_value(CASE WHEN year = {FILL_BASE_YEAR} THEN price END IGNORE NULLS)
               OVER (PARTITION BY n_name ORDER BY year
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0
      FROM p)
SELECT n_name, year, price, p0, price / nullif(p0, 0) * 100 AS pl FROM f""")
def q12_forward_fill(spark, d):
    p = nation_year_prices(spark, d).select("n_name", "year", "price")
    p = index.base_when(p, "year", FILL_BASE_YEAR, {"price": ("p0", "pl")})
    p = index.forward_fill(p, ["n_name"], "year", ["p0"])
    return p.withColumn("pl", F.try_divide(F.col("price"), F.col("p0")) * F.lit(100.0))


# Q14 (F2, G1, G2): two columns stacked, distinct, sorted.
@register("q14_distinct_union", """
SELECT DISTINCT value FROM (SELECT p_name AS value FROM part UNION ALL SELECT p_type FROM part)""")
def q14_distinct_union(spark, d):
    p = table(spark, d, "part")
    s = entities.stack([p.select(F.col("p_name").alias("value")),
                        p.select(F.col("p_type").alias("value"))])
    return entities.distinct_values(s, "value", sort=True)


# Q15 (I2): Laspeyres index per nation and year over part types.
_GOODS_SQL = f"""
SELECT n_name, p_type, CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST(round(CAST(sum({S.cents('l_extendedprice')}) AS DOUBLE)
                  / nullif(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE), 0)) AS BIGINT) AS unit_cents,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2, 3"""


_OK = "unit_cents IS NOT NULL AND p0 IS NOT NULL AND q0 IS NOT NULL"


@register("q15_basket_index", f"""
WITH g AS ({_GOODS_SQL}),
b AS (SELECT n_name, p_type, unit_cents AS p0, qty AS q0 FROM g WHERE year = {BASE_YEAR})
SELECT g.n_name, g.year,
       CAST(sum(CASE WHEN {_OK} THEN unit_cents * q0 END) AS DOUBLE)
         / nullif(CAST(sum(CASE WHEN {_OK} THEN p0 * q0 END) AS DOUBLE), 0) * 100 AS basket_index,
       count(*) FILTER (WHERE {_OK}) AS n_goods
FROM g JOIN b ON g.n_name = b.n_name AND g.p_type = b.p_type
GROUP BY 1, 2""")
def q15_basket_index(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", cents("l_extendedprice").alias("ec"),
        F.col("l_quantity").cast("bigint").alias("q"))
    pt = table(spark, d, "part").select("p_partkey", "p_type")
    ob = orders_by_nation(spark, d).select("o_orderkey", "n_name", "year")
    goods = (li.join(pt, li["l_partkey"] == pt["p_partkey"])
               .join(ob, F.col("l_orderkey") == ob["o_orderkey"])
               .groupBy("n_name", "p_type", "year")
               .agg(F.sum("ec").alias("ec"), F.sum("q").alias("qty")))
    goods = goods.withColumn(
        "unit_cents", F.round(F.try_divide(F.col("ec").cast("double"), F.col("qty").cast("double")))
                        .cast("bigint"))
    return index.basket_index(goods, ["n_name"], "p_type", "year", "unit_cents", "qty", BASE_YEAR)


# Q16 (J2): selected nations' index against the national index.
@register("q16_vs_national", f"""
WITH e AS ({S.index_join(S.NATION_YEAR, "n_name", BASE_YEAR)}),
n0 AS (SELECT max(price) AS p0 FROM ({S.YEAR}) WHERE year = {BASE_YEAR}),
y AS (SELECT year, price / nullif(CASE WHEN year >= {BASE_YEAR} THEN (SELECT p0 FROM n0) END, 0) * 100
             AS pl_country
      FROM ({S.YEAR}))
SELECT e.n_name, e.year, e.pl, y.pl_country, e.pl - y.pl_country AS gap
FROM e JOIN y ON e.year = y.year
WHERE e.n_name IN ({_IN_SELECTED})""")
def q16_vs_national(spark, d):
    ent = series.select_entities(_indexed(spark, d), "n_name", SELECTED)
    nat = index.price_index(year_prices(spark, d), [], "year", BASE_YEAR,
                            {"price": ("p0_country", "pl_country")})
    out = series.compare_to(ent, nat, ["year"], "pl", "pl_country")
    return out.select("n_name", "year", "pl", "pl_country", "gap")


# Q17 (J3): two nations side by side, one row per year.
@register("q17_pivot", f"""
WITH e AS ({S.index_join(S.NATION_YEAR, "n_name", BASE_YEAR)})
SELECT year, {", ".join(f"max(CASE WHEN n_name = '{n}' THEN pl END) AS \"{n}\"" for n in PIVOTED)}
FROM e GROUP BY year""")
def q17_pivot(spark, d):
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
    return series.pivot_wide(_indexed(spark, d), "year", "n_name", "pl", PIVOTED, periods=years)


# Q18 (J1, C5, A12): long series for a selection held in one list.
@register("q18_long_series", f"""
WITH e AS ({S.index_join(S.NATION_YEAR, "n_name", BASE_YEAR)})
SELECT n_name, year, 'price' AS series, price AS value FROM e WHERE n_name IN ({_IN_SELECTED})
UNION ALL
SELECT n_name, year, 'pl' AS series, pl AS value FROM e WHERE n_name IN ({_IN_SELECTED})""")
def q18_long_series(spark, d):
    e = series.select_entities(_indexed(spark, d), "n_name", SELECTED)
    return series.long_series(e, ["n_name"], "year", ["price", "pl"])


# Q19 (B1, B3, B4, B6, B8, B9, B10): human headers -> names -> typed frame.
@register("q19_columns", f"""
SELECT p_partkey AS part_key, p_name AS locality, 'ALL' AS type,
       CAST(p_size AS DOUBLE) AS average_size, p_retailprice AS average_price_nominal_euros
FROM part""")
def q19_columns(spark, d):
    p = table(spark, d, "part")
    raw = p.select(F.col("p_partkey").alias("Part key"),
                   F.col("p_name").alias("Nom de la pièce"),
                   F.col("p_brand").alias("Marque"),
                   F.col("p_type").alias("Type"),
                   F.col("p_size").cast("string").alias("Taille moyenne"),
                   F.col("p_retailprice").cast("string").alias("Prix moyen annoncé en € courant"))
    df = columns.clean_columns(raw)
    df = columns.rename_strict(df, {"nom_de_la_pice": "locality", "taille_moyenne": "average_size",
                                    "prix_moyen_annonc_en_courant": "average_price_nominal_euros"})
    df = df.drop("marque")
    df = columns.lenient_cast(df, columns.columns_matching(df, contains="average"))
    df = columns.with_constant(df, "type", "ALL")
    return df.select("part_key", "locality", "type", "average_size", "average_price_nominal_euros")


# Q20 (A7): links of list items, from whole pages.
@register("q20_page_links", """
SELECT page_id, CAST(unnest(generate_series(1, len(h))) AS INTEGER) AS pos, unnest(h) AS href
FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS h FROM pages)""")
def q20_page_links(spark, d):
    return html.list_links(table(spark, d, "pages")).select("page_id", "pos", "href")


# Q21 (A3, F1): yearly slices tagged with their origin and stacked by name, which on
# one table is a tag computed in one scan.  Rows outside the listed years are tagged too.
_SLICES = list(range(1995, 2002))
_LO, _HI = f"{_SLICES[0]}-01-01", f"{_SLICES[-1] + 1}-01-01"


@register("q21_stack_slices", " UNION ALL ".join(
    [f"SELECT o_orderkey, o_totalprice, '{y}' AS sheet FROM orders "
     f"WHERE o_orderdate >= TIMESTAMP '{y}-01-01' AND o_orderdate < TIMESTAMP '{y + 1}-01-01'"
     for y in _SLICES]
    + [f"SELECT o_orderkey, o_totalprice, 'other' AS sheet FROM orders WHERE o_orderdate IS NULL "
       f"OR o_orderdate < TIMESTAMP '{_LO}' OR o_orderdate >= TIMESTAMP '{_HI}'"]))
def q21_stack_slices(spark, d):
    year = F.year("o_orderdate")
    sheet = F.when(year.isin(_SLICES), year.cast("string")).otherwise(F.lit("other"))
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", sheet.alias("sheet"))


# Q23 (I1, D8): null base, zero base and missing base row.
_PROBE_SQL = f"""
SELECT n_name, year,
       CASE WHEN n_name = '{NULL_BASE}' AND year = {BASE_YEAR} THEN NULL
            WHEN n_name = '{ZERO_BASE}' AND year = {BASE_YEAR} THEN 0.0
            ELSE price END AS price
FROM ({S.NATION_YEAR})
WHERE NOT (n_name = '{NO_BASE}' AND year = {BASE_YEAR})"""


@register("q23_index_edge_cases", S.index_join(_PROBE_SQL, "n_name", BASE_YEAR))
def q23_index_edge_cases(spark, d):
    p = nation_year_prices(spark, d)
    at_base = F.col("year") == BASE_YEAR
    p = (p.filter(~((F.col("n_name") == NO_BASE) & at_base))
          .select("n_name", "year",
                  F.when((F.col("n_name") == NULL_BASE) & at_base, F.lit(None).cast("double"))
                   .when((F.col("n_name") == ZERO_BASE) & at_base, F.lit(0.0))
                   .otherwise(F.col("price")).alias("price")))
    return index.price_index(p, ["n_name"], "year", BASE_YEAR, {"price": ("p0", "pl")})


# Q24 (C4): null report after a lenient cast of '*' placeholders.
_STAR_SQL = "CASE WHEN event_type = 'error' THEN '*' ELSE CAST(value AS VARCHAR) END"


@register("q24_null_report", f"""
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE {S.lenient(_STAR_SQL)} IS NULL) AS value_nulls,
       count(*) FILTER (WHERE {S.lenient('props')} IS NULL) AS props_nulls,
       count(*) FILTER (WHERE event_type IS NULL) AS event_type_nulls
FROM events""")
def q24_null_report(spark, d):
    return checks.null_report(_starred_events(spark, d), ["value", "props", "event_type"])


def _starred_events(spark, d):
    ev = table(spark, d, "events")
    star = F.when(F.col("event_type") == "error", F.lit("*")).otherwise(F.col("value").cast("string"))
    return ev.select("event_id", T.lenient_double(star).alias("value"),
                     T.lenient_double("props").alias("props"), "event_type")


@register("q24_null_rows", f"""
SELECT event_id, event_type FROM events WHERE {S.lenient(_STAR_SQL)} IS NULL""")
def q24_null_rows(spark, d):
    return checks.null_rows(_starred_events(spark, d), "value").select("event_id", "event_type")


# Q25 (K1): the yearly total against the sum of the nation rows.
@register("q25_totals_check", f"""
WITH d AS ({S.NATION_YEAR}), t AS ({S.YEAR}),
s AS (SELECT year, CAST(sum(n_orders) AS DOUBLE) AS detail_sum FROM d GROUP BY year)
SELECT coalesce(t.year, s.year) AS year, CAST(t.n_orders AS DOUBLE) AS total, s.detail_sum,
       s.detail_sum - CAST(t.n_orders AS DOUBLE) AS diff,
       coalesce(abs(s.detail_sum - CAST(t.n_orders AS DOUBLE)) <= 0, false) AS ok
FROM t FULL OUTER JOIN s ON t.year = s.year""")
def q25_totals_check(spark, d):
    return checks.totals_match(nation_year_prices(spark, d), year_prices(spark, d),
                               "year", "n_orders", "n_orders")


# Q25 over prices (K1): the yearly sum of all order prices against the nations' sums.
_CENTS_SQL = f"""
SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, sum({S.cents('o_totalprice')}) AS c
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE NOT (n_name = 'NATION_7' AND year(o_orderdate) = 1999) GROUP BY 1, 2"""


@register("q25_totals_prices", f"""
WITH s AS (SELECT year, CAST(sum(c) AS DOUBLE) AS detail_sum FROM ({_CENTS_SQL}) GROUP BY year),
t AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum({S.cents('o_totalprice')}) AS DOUBLE) AS total
      FROM orders GROUP BY 1)
SELECT coalesce(t.year, s.year) AS year, total, detail_sum, detail_sum - total AS diff,
       coalesce(abs(detail_sum - total) <= 0, false) AS ok
FROM t FULL OUTER JOIN s ON t.year = s.year""")
def q25_totals_prices(spark, d):
    o = orders_by_nation(spark, d).filter(~((F.col("n_name") == "NATION_7") & (F.col("year") == 1999)))
    detail = o.groupBy("n_name", "year").agg(F.sum(cents("o_totalprice")).alias("c"))
    totals = (table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"))
              .agg(F.sum(cents("o_totalprice")).alias("c")))
    out = checks.totals_match(detail, totals, "year", "c", "c")
    return out.withColumn("detail_sum", F.col("detail_sum").cast("double"))


# Q26 (K2): revisions between two deliveries of orders.
_NEW_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN o_totalprice + 1.0
            ELSE o_totalprice END AS o_totalprice, o_orderstatus
FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'F')
UNION ALL
SELECT -o_orderkey - 1, o_totalprice, o_orderstatus FROM orders
WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O'"""


@register("q26_revisions", f"""
WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders), n AS ({_NEW_SQL})
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
       CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed'
            ELSE 'changed' END AS kind,
       o.o_totalprice AS old_o_totalprice, o.o_orderstatus AS old_o_orderstatus,
       n.o_totalprice AS new_o_totalprice, n.o_orderstatus AS new_o_orderstatus
FROM o FULL OUTER JOIN n ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL
   OR o.o_totalprice IS DISTINCT FROM n.o_totalprice
   OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus""")
def q26_revisions(spark, d):
    o = table(spark, d, "orders")
    old = o.select("o_orderkey", "o_totalprice", "o_orderstatus")
    urgent_p = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    kept = (o.filter(~((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F")))
             .select("o_orderkey",
                     F.when(urgent_p, F.col("o_totalprice") + F.lit(1.0))
                      .otherwise(F.col("o_totalprice")).alias("o_totalprice"),
                     "o_orderstatus"))
    added = (o.filter((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "O"))
              .select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_totalprice", "o_orderstatus"))
    new = entities.stack([kept, added])
    return checks.revisions(old, new, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


# Q27 (K3): share of cells a lenient cast cannot read, per source column.
_K3_COLS = [("value_s", "CAST(value AS VARCHAR)"), ("props", "props"),
            ("event_type", "event_type"), ("user_s", "CAST(user_id AS VARCHAR)")]
_K3_SHARES = ",\n       ".join(
    f"CAST(count(*) FILTER (WHERE ({x}) IS NOT NULL AND {S.lenient(x)} IS NULL) AS DOUBLE)"
    f" / CAST(count({x}) AS DOUBLE) AS {n}_fail_share" for n, x in _K3_COLS)
_K3_OK = " AND ".join(f"coalesce({n}_fail_share <= 0, true)" for n, _ in _K3_COLS)


@register("q27_cast_failures", f"""
SELECT *, {_K3_OK} AS ok FROM (SELECT {_K3_SHARES} FROM events)""")
def q27_cast_failures(spark, d):
    ev = table(spark, d, "events").select(
        F.col("value").cast("string").alias("value_s"), "props", "event_type",
        F.col("user_id").cast("string").alias("user_s"))
    return checks.cast_failures(ev, ["value_s", "props", "event_type", "user_s"])


# Q28 (K4): entities appearing and vanishing.
@register("q28_churn", """
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
s AS (SELECT o_custkey, min(year) AS first_period, max(year) AS last_period FROM y GROUP BY o_custkey),
b AS (SELECT min(year) AS lo, max(year) AS hi FROM y)
SELECT o_custkey, first_period, last_period, first_period > lo AS appeared, last_period < hi AS vanished
FROM s, b""")
def q28_churn(spark, d):
    y = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return checks.churn(y, "o_custkey", "year")


# Q29 (K5): order-free fingerprint.  Money as cents and dates as days, whose text
# both engines write alike.
_FP_COLS = ["CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus",
            f"CAST({S.cents('o_totalprice')} AS VARCHAR)", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)",
            "o_orderpriority"]
_FP_TEXT = " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in _FP_COLS)


@register("q29_fingerprint", f"""
SELECT count(*) AS n_rows,
       CAST(coalesce(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)), 0) AS VARCHAR) AS hash_sum,
       CAST(coalesce(sum(CAST(CAST('0x' || substr(h, 17, 15) AS BIGINT) AS HUGEINT)), 0) AS VARCHAR) AS hash_sum_2
FROM (SELECT md5({_FP_TEXT}) AS h FROM orders)""")
def q29_fingerprint(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice"),
                                         F.to_date("o_orderdate"), "o_orderpriority")
    return checks.fingerprint(o)


# Q30 (K6): keys that are not unique.
@register("q30_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q30_duplicate_keys(spark, d):
    li = table(spark, d, "lineitem")
    return checks.duplicate_keys(li, ["l_orderkey", "l_linenumber"])


# Q31-Q33: the reference's own flow - raw sheet rows -> names, strip, lenient
# cast, row routing -> commune panel and country table -> index -> comparison
# with the national index - on delivery rows derived from orders and lineitem.
_UNIT_SQL = f"""
SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year,
       sum({S.cents('l_extendedprice')}) AS unit_cents, sum(CAST(l_quantity AS BIGINT)) AS qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2"""
_UNIT = "CAST(u.unit_cents AS DOUBLE) / CAST(u.qty AS DOUBLE) / 100.0"
_STARS = ", ".join(f"'{n}@{y}'" for n, y in STARRED)
_DELIVERY_PANEL_SQL = f"""
SELECT p.n_name AS locality, p.n_orders AS n_offers,
       CASE WHEN p.n_name || '@' || p.year IN ({_STARS}) THEN NULL ELSE p.price END AS average_price_nominal_euros,
       {_UNIT} AS average_price_m2_nominal_euros, p.year
FROM ({S.NATION_YEAR}) p JOIN ({_UNIT_SQL}) u ON p.n_name = u.n_name AND p.year = u.year"""
_DELIVERY_COUNTRY_SQL = f"""
SELECT 'ALL' AS locality, y.price AS average_price_nominal_euros, {_UNIT} AS average_price_m2_nominal_euros,
       y.year, y.n_orders AS n_offers
FROM ({S.YEAR}) y JOIN (SELECT year, sum(unit_cents) AS unit_cents, sum(qty) AS qty
                        FROM ({_UNIT_SQL}) GROUP BY year) u ON y.year = u.year"""


def _deliveries(spark, d):
    return stages.clean_deliveries(delivery_rows(spark, d), country_name="ALL")


@register("q31_delivery_panel", _DELIVERY_PANEL_SQL)
def q31_delivery_panel(spark, d):
    return _deliveries(spark, d).panel


@register("q31_delivery_country", _DELIVERY_COUNTRY_SQL)
def q31_delivery_country(spark, d):
    return _deliveries(spark, d).country


def _fill(col, base):
    return (f"CASE WHEN year >= {base} THEN max(CASE WHEN year = {base} THEN {col} END) "
            f"OVER (PARTITION BY locality) END")


@register("q32_delivery_index", f"""
WITH p AS ({_DELIVERY_PANEL_SQL}),
b AS (SELECT *, {_fill('average_price_nominal_euros', BASE_YEAR)} AS p0,
             {_fill('average_price_m2_nominal_euros', BASE_YEAR)} AS p0_m2 FROM p)
SELECT *, average_price_nominal_euros / nullif(p0, 0) * 100 AS pl,
       average_price_m2_nominal_euros / nullif(p0_m2, 0) * 100 AS pl_m2 FROM b""")
def q32_delivery_index(spark, d):
    return stages.index_panel(_deliveries(spark, d).panel, BASE_YEAR)


@register("q33_delivery_vs_country", f"""
WITH p AS ({_DELIVERY_PANEL_SQL}),
b AS (SELECT locality, year, average_price_m2_nominal_euros
             / nullif({_fill('average_price_m2_nominal_euros', BASE_YEAR)}, 0) * 100 AS pl_m2 FROM p),
c AS ({_DELIVERY_COUNTRY_SQL}),
n AS (SELECT year, average_price_m2_nominal_euros / nullif(CASE WHEN year >= {BASE_YEAR} THEN
             (SELECT max(average_price_m2_nominal_euros) FROM c WHERE year = {BASE_YEAR}) END, 0) * 100
             AS pl_m2_country FROM c)
SELECT b.locality, b.year, b.pl_m2, n.pl_m2_country, b.pl_m2 - n.pl_m2_country AS gap
FROM b JOIN n ON b.year = n.year WHERE b.locality IN ({_IN_SELECTED})""")
def q33_delivery_vs_country(spark, d):
    # Panel and country table both read the classified rows: staged, lineitem is read once.
    c = stages.split_classified(stage(stages.classify(delivery_rows(spark, d)), "q33"), "ALL")
    _, _, versus = stages.index_and_series(c.panel, c.country, SELECTED, BASE_YEAR)
    return versus


# Q34 (A3, A4, F1): two tables of the same shape, each row tagged with the file it
# came from, stacked under common names after their schemas are compared.
_LIKE = {"customer": "c", "supplier": "s"}


@register("q34_tagged_scan", " UNION ALL ".join(
    f"SELECT {p}_{'custkey' if t == 'customer' else 'suppkey'} AS party, {p}_name AS name, "
    f"{p}_nationkey AS nationkey, {p}_acctbal AS acctbal, '{t}' AS source FROM {t}" for t, p in _LIKE.items()))
def q34_tagged_scan(spark, d):
    frames = []
    for t, p in _LIKE.items():
        rows = read_tagged(spark, f"{d}/{t}.parquet", tag_col="source")
        frames.append(rows.select(F.col(f"{p}_{'custkey' if t == 'customer' else 'suppkey'}").alias("party"),
                                  *[F.col(f"{p}_{c}").alias(c) for c in ("name", "nationkey", "acctbal")], "source"))
    return entities.stack(frames)


# Q35 (A5, A6, A10, A11): a table handed over as gzip CSV in Latin-1, several part
# files with a header each, and read back under its schema.
@register("q35_csv_hand_over", """
SELECT p_partkey, 'Pétange ' || p_name AS name, p_retailprice FROM part""")
def q35_csv_hand_over(spark, d):
    part = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("Pétange "), "p_name").alias("name"), "p_retailprice")
    path = f"{checkpoint_dir(spark).rstrip('/')}/pinax-stage/q35-{uuid.uuid4().hex}"
    write_table(part.repartition("p_partkey"), path, fmt="csv", encoding="ISO-8859-1", compression="gzip")
    return read_csv(spark, path, part.schema, encoding="ISO-8859-1")


# Q36 (A7, A8, A9): rows of orders written as page tables with a two-level header (in
# the query; a large page in parts that keep the header), parsed and read as columns again.
@register("q36_page_tables", """
SELECT o_custkey AS page_id, CAST(o_orderkey AS VARCHAR) AS order_key, o_orderpriority AS priority FROM orders""")
def q36_page_tables(spark, d):
    o = table(spark, d, "orders")
    cells = F.concat(F.lit("<tr><td>x</td><td>"), F.col("o_orderkey").cast("string"), F.lit("</td><td><b>"),
                     F.col("o_orderpriority"), F.lit("</b></td></tr>"))
    head = "<table><tr><td>other</td></tr></table><table><tr><th colspan=2>Order</th><th>Name</th></tr>" \
           "<tr><th>Name</th><th>Key</th><th>Name</th></tr>"
    pages = html.subpages(o, "o_custkey", "o_orderkey", cells, head, "</table>")
    rows = html.table_rows(html.html_tables(pages), 1, header_rows=2)
    both = html.columns(rows, {"order_key": ("Key", 1), "priority": ("Name", 2)})
    return both.select("page_id", "order_key", "priority")


# Q37, Q38 (K4): districts of nations (by customer number) as entities; in some nations two
# are merged, one is split or one is renamed from a year on.  Volumes are numbers of orders.
_LINEAGE_TOLERANCE, _LINEAGE_ROUNDS = 0.35, 6
_DISTRICT = """n_name || '-' || CASE
  WHEN o_custkey % 4 < 2 AND CAST(substr(n_name, 8) AS INT) % 3 = 0 AND year >= 1996 THEN '01'
  WHEN o_custkey % 4 = 2 AND CAST(substr(n_name, 8) AS INT) % 3 = 1 AND year >= 1997
    THEN CASE WHEN o_custkey % 8 = 2 THEN '2a' ELSE '2b' END
  WHEN o_custkey % 4 = 3 AND CAST(substr(n_name, 8) AS INT) % 5 = 0 AND year >= 1995 THEN '3x'
  ELSE CAST(o_custkey % 4 AS {text}) END"""


def _lineage_sql(last: str) -> str:
    """The rounds of acceptance written out, each with what the one before left open."""
    rounds = "".join(f""",
pairs{i} AS (SELECT o.since, o.n_name, o.entity AS old, n.entity AS new, o.volume AS old_volume, n.volume AS new_volume
  FROM open{i} o JOIN open{i} n ON o.side = 'old' AND n.side = 'new' AND o.since = n.since AND o.n_name = n.n_name),
cand{i} AS (
  SELECT 'new' AS side, new AS target, since, new_volume AS target_volume, old AS part, old_volume AS part_volume
  FROM pairs{i} WHERE old_volume <= new_volume * (1 + {_LINEAGE_TOLERANCE})
  UNION ALL
  SELECT 'old', old, since, old_volume, new, new_volume FROM pairs{i} WHERE new_volume <= old_volume * (1 + {_LINEAGE_TOLERANCE})),
run{i} AS (SELECT *, sum(part_volume) OVER w AS run, row_number() OVER w AS rank FROM cand{i}
  WINDOW w AS (PARTITION BY side, target ORDER BY part_volume DESC, part ROWS UNBOUNDED PRECEDING)),
err{i} AS (SELECT *, abs(run - target_volume) / target_volume AS e FROM run{i}),
best{i} AS (SELECT *, first_value(e) OVER w AS error, first_value(rank) OVER w AS parts FROM err{i}
  WINDOW w AS (PARTITION BY side, target ORDER BY e, rank)),
found{i} AS (SELECT * FROM best{i} WHERE rank <= parts AND error <= {_LINEAGE_TOLERANCE} AND (side = 'new' OR parts > 1)),
members{i} AS (
  SELECT side, target, parts, error, CASE side WHEN 'new' THEN 'old' ELSE 'new' END AS part_side, part AS entity FROM found{i}
  UNION SELECT side, target, parts, error, side, target FROM found{i}),
wish{i} AS (SELECT *, row_number() OVER (PARTITION BY part_side, entity ORDER BY error, side, target) AS nth FROM members{i}),
agreed{i} AS (SELECT side, target FROM wish{i} GROUP BY side, target, parts HAVING count(*) FILTER (nth = 1) = parts + 1),
accepted{i} AS (SELECT f.* FROM found{i} f JOIN agreed{i} USING (side, target)),
used{i} AS (SELECT side, target AS entity FROM accepted{i}
  UNION SELECT CASE side WHEN 'new' THEN 'old' ELSE 'new' END, part FROM accepted{i}),
open{i + 1} AS (SELECT o.* FROM open{i} o ANTI JOIN used{i} USING (side, entity))""" for i in range(_LINEAGE_ROUNDS))
    every = " UNION ALL ".join(f"SELECT * FROM accepted{i}" for i in range(_LINEAGE_ROUNDS))
    return f"""
WITH RECURSIVE rows AS (
  SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
panel AS (SELECT {_DISTRICT.format(text='VARCHAR')} AS entity, n_name, year, CAST(count(*) AS DOUBLE) AS volume FROM rows GROUP BY ALL),
periods AS (SELECT year, lead(year) OVER (ORDER BY year) AS after FROM (SELECT DISTINCT year FROM panel)),
spans AS (SELECT entity, min(n_name) AS n_name, min(year) AS lo, max(year) AS hi, arg_min(volume, year) AS first_volume,
                 arg_max(volume, year) AS last_volume FROM panel GROUP BY entity),
open0 AS (
  SELECT 'new' AS side, entity, lo AS since, first_volume AS volume, n_name FROM spans WHERE lo > (SELECT min(year) FROM panel)
  UNION ALL
  SELECT 'old', entity, after, last_volume, n_name FROM spans JOIN periods ON hi = year
  WHERE hi < (SELECT max(year) FROM panel)){rounds},
told AS (
  SELECT CASE WHEN parts = 1 THEN 'renamed' WHEN side = 'new' THEN 'merged' ELSE 'split' END AS kind, since,
         CASE side WHEN 'new' THEN part ELSE target END AS old, CASE side WHEN 'new' THEN target ELSE part END AS new,
         CASE side WHEN 'new' THEN part_volume ELSE target_volume END AS old_volume,
         CASE side WHEN 'new' THEN target_volume ELSE part_volume END AS new_volume, error FROM ({every}))
{last}"""


def _districts(spark, d):
    o = orders_by_nation(spark, d)
    return (o.withColumn("entity", F.expr(_DISTRICT.format(text="STRING")))
            .groupBy("entity", "n_name", "year").agg(F.count("*").alias("n_orders")))


def _lineage_events(spark, d):
    return lineage.lineage_events(stage(_districts(spark, d), "q37"), "entity", "year", "n_orders", ["n_name"],
                                  _LINEAGE_TOLERANCE)


@register("q37_lineage_events", _lineage_sql("SELECT * FROM told"))
def q37_lineage_events(spark, d):
    return _lineage_events(spark, d)


@register("q38_lineages", _lineage_sql("""
, edges AS (SELECT old AS a, new AS b FROM told UNION SELECT new, old FROM told),
reached(node, other) AS (SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reached r JOIN edges e ON r.other = e.a)
SELECT node AS entity, min(other) AS lineage FROM reached GROUP BY node"""))
def q38_lineages(spark, d):
    return lineage.lineages(_lineage_events(spark, d))


# Q39 (A2): parts written as delimited sheets (one for each size) with preamble rows before
# the header, and read as numbered lines.
@register("q39_sheet_exports", """
SELECT CAST(p_partkey AS VARCHAR) AS part, p_name AS name, CAST(p_size AS VARCHAR) AS sheet_size FROM part""")
def q39_sheet_exports(spark, d):
    rows = table(spark, d, "part").select(
        "p_size", F.col("p_partkey").alias("no"),
        F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), "p_name", F.lit('"')), "p_size").alias("value"))
    heads = rows.select("p_size").distinct().select("p_size", F.posexplode(F.array(
        *map(F.lit, ("House prices", "", "Published, revised", "Part,Name,Size")))).alias("no", "value"))
    sheets = rows.unionByName(heads.withColumn("no", F.col("no").cast("long") - 4))
    path = f"{checkpoint_dir(spark).rstrip('/')}/pinax-stage/q39-{uuid.uuid4().hex}"
    sheets.repartition("p_size").sortWithinPartitions("p_size", "no").select("p_size", "value").write.partitionBy(
        "p_size").text(path)
    read = read_sheet_exports(spark, path, ["Part", "Name", "Size"], skip_rows=3, glob="*.txt")
    return read.select(F.col("Part").alias("part"), F.col("Name").alias("name"), F.col("Size").alias("sheet_size"))


# Q40 (A5, A6): parts handed over as CSV in which some cells do not fit, rows are short or
# too long; read in one scan into clean rows and quarantined ones.
_SPOILED = """CASE WHEN p_partkey % 97 = 5 THEN p_partkey || ',n/a,' || p_retailprice
  WHEN p_partkey % 101 = 7 THEN p_partkey || ',' || p_size || ',1,2'
  WHEN p_partkey % 103 = 9 THEN CAST(p_partkey AS {text}) END"""


@register("q40_quarantine", f"""
WITH t AS (SELECT p_partkey, p_size, p_retailprice, {_SPOILED.format(text='VARCHAR')} AS bad_text
           FROM (SELECT p_partkey, p_size, CAST({S.cents('p_retailprice')} AS BIGINT) AS p_retailprice FROM part))
SELECT CASE WHEN bad_text IS NULL THEN 'clean' ELSE 'quarantined' END AS status,
       CASE WHEN bad_text IS NULL THEN p_partkey END AS p_partkey, CASE WHEN bad_text IS NULL THEN p_size END AS p_size,
       CASE WHEN bad_text IS NULL THEN p_retailprice END AS cents, bad_text FROM t""")
def q40_quarantine(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", cents("p_retailprice").alias("p_retailprice"))
    line = F.coalesce(F.expr(_SPOILED.format(text="STRING")), F.concat_ws(",", "p_partkey", "p_size", "p_retailprice"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pinax-stage/q40-{uuid.uuid4().hex}"
    part.select(line).write.text(f"{folder}/in")
    checked = read_csv_checked(spark, f"{folder}/in", "p_partkey bigint, p_size int, cents bigint", header=False)
    good, bad = quarantine(checked, f"{folder}/out")
    return good.select(F.lit("clean").alias("status"), "*", F.lit(None).cast("string").alias("bad_text")).unionByName(
        bad.select(F.lit("quarantined").alias("status"), F.col("text").alias("bad_text")), allowMissingColumns=True)


# Q41, Q42 (K5): a second version of orders with some prices raised, some rows taken out and
# some added; the buckets in which the versions differ, and the rows in them that do.
_ORDER_VALUES = ["cents", "o_orderpriority"]
_NEW_ORDERS = """SELECT o_orderkey + CASE WHEN n = 1 THEN 0 ELSE 100000000 END AS o_orderkey,
  cents + CASE WHEN n = 1 AND o_orderkey % 1997 = 5 THEN 1 ELSE 0 END AS cents, o_orderpriority
FROM old_orders CROSS JOIN (VALUES (1), (2)) AS v(n)
WHERE (n = 1 AND o_orderkey % 4999 <> 3) OR (n = 2 AND o_orderkey % 5003 = 7)"""
_CELL = "length({c}) || ':' || {c}"
_OLD_NEW = f"""
WITH old_orders AS (SELECT o_orderkey, {S.cents('o_totalprice')} AS cents, o_orderpriority FROM orders),
new_orders AS ({_NEW_ORDERS}),
both_orders AS (SELECT 'old' AS v, * FROM old_orders UNION ALL SELECT 'new', * FROM new_orders),
named AS (SELECT *, substr(md5({_CELL.format(c='CAST(o_orderkey AS VARCHAR)')}), 1, 3) AS bucket FROM both_orders)"""


def _order_versions(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", cents("o_totalprice").alias("cents"), "o_orderpriority")
    twice = old.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).filter(
        ((F.col("n") == 1) & (F.col("o_orderkey") % 4999 != 3)) | ((F.col("n") == 2) & (F.col("o_orderkey") % 5003 == 7)))
    raised = ((F.col("n") == 1) & (F.col("o_orderkey") % 1997 == 5)).cast("long")
    new = twice.select((F.col("o_orderkey") + F.when(F.col("n") == 1, 0).otherwise(100000000)).alias("o_orderkey"),
                       (F.col("cents") + raised).alias("cents"), "o_orderpriority")
    paths = []
    for name, rows in (("old", old), ("new", new)):
        paths.append(f"{checkpoint_dir(spark).rstrip('/')}/pinax-stage/q41-{name}-{uuid.uuid4().hex}")
        hashtree.write_bucketed(rows, paths[-1], ["o_orderkey"])
    return hashtree.changes(spark, *paths, ["o_orderkey"], _ORDER_VALUES)


@register("q41_changed_buckets", _OLD_NEW + """,
differ AS (SELECT bucket FROM named GROUP BY bucket, o_orderkey, cents, o_orderpriority HAVING count(DISTINCT v) < 2)
SELECT bucket AS node, CAST(count(*) FILTER (v = 'old') AS BIGINT) AS old_rows,
       CAST(count(*) FILTER (v = 'new') AS BIGINT) AS new_rows
FROM named WHERE bucket IN (SELECT bucket FROM differ) GROUP BY bucket""")
def q41_changed_buckets(spark, d):
    return _order_versions(spark, d)[0]


@register("q42_located_changes", _OLD_NEW + """
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
       CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS kind,
       o.cents AS old_cents, o.o_orderpriority AS old_o_orderpriority, n.cents AS new_cents,
       n.o_orderpriority AS new_o_orderpriority
FROM old_orders o FULL JOIN new_orders n ON o.o_orderkey = n.o_orderkey
WHERE o.cents IS DISTINCT FROM n.cents OR o.o_orderpriority IS DISTINCT FROM n.o_orderpriority""")
def q42_located_changes(spark, d):
    return _order_versions(spark, d)[1]


# Q43 (K3): parts delivered as one file for each size, in three layouts; the layouts found and how many files have them.
_LAYOUTS = {0: "Part,Name,Size", 1: "Part,Size,Name", 2: "Part,Name,Brand"}


@register("q43_schema_versions", f"""
SELECT * FROM (SELECT p_size % 3 AS k, count(DISTINCT p_size) AS n_files FROM part GROUP BY 1)
JOIN (VALUES (0, 'Part|Name|Size', '', '', false), (1, 'Part|Size|Name', '', '', true),
             (2, 'Part|Name|Brand', 'Size', 'Brand', false)) AS v(k, layout, missing, unexpected, moved) USING (k)""")
def q43_schema_versions(spark, d):
    rows = table(spark, d, "part").withColumn("k", F.col("p_size") % 3)
    cells = {0: ("p_partkey", "p_name", "p_size"), 1: ("p_partkey", "p_size", "p_name"), 2: ("p_partkey", "p_name", "p_brand")}
    line = F.coalesce(*[F.when(F.col("k") == k, F.concat_ws(",", *c)) for k, c in cells.items()])
    head = F.coalesce(*[F.when(F.col("k") == k, F.lit(x)) for k, x in _LAYOUTS.items()])
    heads = rows.select("p_size", "k").distinct().select("p_size", F.lit(-1).cast("long").alias("no"), head.alias("value"))
    sheets = rows.select("p_size", F.col("p_partkey").alias("no"), line.alias("value")).unionByName(heads)
    path = f"{checkpoint_dir(spark).rstrip('/')}/pinax-stage/q43-{uuid.uuid4().hex}"
    sheets.repartition("p_size").sortWithinPartitions("p_size", "no").select("p_size", "value").write.partitionBy(
        "p_size").text(path)
    found = checks.schema_versions(file_headers(spark, path, glob="*.txt"), _LAYOUTS[0].split(","))
    joined = lambda c: F.array_join(c, "|")
    k = F.coalesce(*[F.when(joined("columns") == x.replace(",", "|"), F.lit(i)) for i, x in _LAYOUTS.items()])
    return found.select(k.alias("k"), "n_files", joined("columns").alias("layout"), joined("missing").alias("missing"),
                        joined("unexpected").alias("unexpected"), "moved")


# Q44 (H2): the last purchase of each event's user, where one user has a third of all events;
# no task holds a user's events.
@register("q44_segmented_fill", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_no,
                  CASE WHEN event_type = 'purchase' THEN value END AS bought FROM events)
SELECT event_id, user_no, last_value(bought IGNORE NULLS) OVER (PARTITION BY user_no ORDER BY event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bought FROM e""")
def q44_segmented_fill(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).cast("long").alias("user_no"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("bought"))
    return index.forward_fill_segmented(e, ["user_no"], "event_id", ["bought"])


# Q45 (A12): yearly series of all customers, in files sorted by customer, read back.
@register("q45_clustered_series", f"""
SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum({S.cents('o_totalprice')}) AS BIGINT) AS cents
FROM orders GROUP BY 1, 2""")
def q45_clustered_series(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), cents("o_totalprice").alias("c"))
    long = o.groupBy("o_custkey", "year").agg(F.sum("c").alias("cents"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/pinax-stage/q45-{uuid.uuid4().hex}"
    write_series_clustered(long, path, "o_custkey", "year")
    return read_series(spark, path, "o_custkey")
