"""DuckDB SQL fragments for the oracle side of the catalogue.

They spell the same rules as ``pinax.functions.text`` with the same character
classes (the class strings only use escapes that Java, RE2 and Python share).
"""

from __future__ import annotations

from ..functions.text import ALNUM_CLASS, DECIMAL_BODY, NON_ASCII, PY_SPACE_CLASS, WHITE_SPACE_CLASS


def strip(x: str) -> str:
    ws = WHITE_SPACE_CLASS
    return f"regexp_replace({x}, '^[{ws}]+|[{ws}]+$', '', 'g')"


def lenient(x: str) -> str:
    s = strip(x)
    return f"CASE WHEN regexp_full_match({s}, '{DECIMAL_BODY}') THEN TRY_CAST({s} AS DOUBLE) END"


def name_rule(x: str) -> str:
    kept = f"regexp_replace({x}, '[^{ALNUM_CLASS}{PY_SPACE_CLASS}]', '', 'g')"
    under = f"regexp_replace(lower({kept}), '[{PY_SPACE_CLASS}]+', '_', 'g')"
    return f"regexp_replace({under}, '{NON_ASCII}', '', 'g')"


def cents(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


def exact_avg(cents_sum: str, n: str) -> str:
    return f"CAST({cents_sum} AS DOUBLE) / CAST({n} AS DOUBLE) / 100.0"


# Panel (n_name, year, price, n_orders) as in plans.panels.nation_year_prices.
NATION_YEAR = f"""
SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year,
       {exact_avg(f"sum({cents('o_totalprice')})", 'count(*)')} AS price,
       count(*) AS n_orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2
"""

# National series (year, price, n_orders) as in plans.panels.year_prices.
YEAR = f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
       {exact_avg(f"sum({cents('o_totalprice')})", 'count(*)')} AS price,
       count(*) AS n_orders
FROM orders GROUP BY 1
"""


def index_join(panel: str, keys: str, base: int, before_null: bool = True) -> str:
    """Index of ``price`` on the base year, base value joined per entity."""
    p0 = f"CASE WHEN p.year >= {base} THEN b.p0 END" if before_null else "b.p0"
    on = " AND ".join(f"p.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""
WITH p AS ({panel}),
b AS (SELECT {keys}, max(price) AS p0 FROM p WHERE year = {base} GROUP BY {keys})
SELECT {cols}, p.year, p.price, {p0} AS p0, p.price / nullif({p0}, 0) * 100 AS pl
FROM p LEFT JOIN b ON {on}
"""
