"""Base-period values, forward fill and price indices.

Panel = DataFrame with entity ``keys``, a period column ``order_col`` and
measure columns, unique on (keys, order_col) (``checks.duplicate_keys``).
Operators take the column names; nothing depends on row order in storage.

Two plans for the base value:

* ``how="window"`` (default): one exchange of the panel on ``keys`` and a sort.
  Each window partition holds one row per period, so its size does not grow
  with the data, and the panel is computed once.  The right plan for a panel
  that is itself an aggregate of large tables.  Without keys the panel is a
  single series, whose rows are its periods.
* ``how="join"``: base rows are filtered (the predicate reaches the scan, so a
  panel stored by period reads one period), aggregated per entity and
  left-joined back.  Spark chooses the join by the sizes it measures.  The
  right plan for a large panel read from storage; a derived panel would be
  computed for both sides, so stage it first (``sources.files.stage``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stage


def _measures(values) -> dict[str, tuple[str, str]]:
    """Normalise ``values`` to ``{measure: (base_col, index_col)}``."""
    if isinstance(values, Mapping):
        return {k: tuple(v) for k, v in values.items()}
    return {v: (f"{v}_base", f"{v}_index") for v in values}


def _unique_guard(keys: list[str], order_col: str, value: Column) -> Column:
    """``value``, or a job failure when (keys, order_col) repeats.

    The count runs over ``partitionBy(keys, order_col)``, which the exchange and
    sort on ``keys`` already satisfy, so the guard adds no shuffle.  It keeps
    the bound the window forms rely on: one row per period in a partition.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, order_col))
    msg = F.lit(f"rows are not unique on {keys + [order_col]}")
    return F.when(n > 1, F.raise_error(msg)).otherwise(value)


def _ratio(num: Column, den: Column, scale: float, digits: int | None) -> Column:
    out = F.try_divide(num, den) * F.lit(scale)
    return F.round(out, digits) if digits is not None else out


def base_values(df: DataFrame, keys: list[str], order_col: str, base, values) -> DataFrame:
    """One row per entity that has a base-period row, with its measures there.

    The base-period filter reaches the scan: a panel stored partitioned (or
    sorted) by period reads only the base period here.  Two base rows for one
    entity make the job fail (``raise_error``) instead of picking one silently;
    ``checks.duplicate_keys`` lists them.
    """
    m = _measures(values)
    agg = (df.filter(F.col(order_col) == F.lit(base))
             .groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("__n"),
                  *[F.max(F.col(v)).alias(b) for v, (b, _) in m.items()]))
    dup = F.col("__n") > 1
    msg = F.lit(f"more than one base row ({order_col} = {base}) for an entity")
    once = F.when(dup, F.raise_error(msg)).otherwise(F.lit(True))
    return agg.filter(once).select(*keys, *[b for b, _ in m.values()])


def price_index(df: DataFrame, keys: list[str], order_col: str, base, values,
                how: str = "window", before_base: str = "null", scale: float = 100.0,
                digits: int | None = None) -> DataFrame:
    """Base-period index per entity (I1): ``index = value / value_at_base * scale``.

    ``before_base="null"``: periods before the base get a null base value and
    index (forward-fill semantics); ``"index"``: they are indexed too.
    A null or zero base value gives a null index; an entity without a base row
    keeps its rows with null base and index.
    """
    m = _measures(values)
    if before_base not in ("null", "index"):
        raise ValueError("before_base must be 'null' or 'index'")
    after = F.col(order_col) >= F.lit(base)
    if how == "join" and keys:
        b = base_values(df, keys, order_col, base, m)
        out = df.join(b, on=keys, how="left")
        if before_base == "null":
            out = out.withColumns({bc: F.when(after, F.col(bc)) for bc, _ in m.values()})
    elif how == "join":
        # A single series: the base value is a scalar subquery, not a join.
        b = base_values(df, [], order_col, base, m)
        out = df.withColumns({bc: b.select(bc).scalar() for bc, _ in m.values()})
        if before_base == "null":
            out = out.withColumns({bc: F.when(after, F.col(bc)) for bc, _ in m.values()})
    elif how == "window":
        if before_base == "null":
            w = (Window.partitionBy(*keys).orderBy(order_col)
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
            base_expr = {bc: F.last(F.when(F.col(order_col) == F.lit(base), F.col(v)),
                                    ignorenulls=True).over(w)
                         for v, (bc, _) in m.items()}
        else:
            w = Window.partitionBy(*keys)
            base_expr = {bc: F.max(F.when(F.col(order_col) == F.lit(base), F.col(v))).over(w)
                         for v, (bc, _) in m.items()}
        out = df.withColumns({bc: _unique_guard(keys, order_col, e) for bc, e in base_expr.items()})
    else:
        raise ValueError("how must be 'join' or 'window'")
    return out.withColumns({ic: _ratio(F.col(v), F.col(bc), scale, digits)
                            for v, (bc, ic) in m.items()})


def base_when(df: DataFrame, order_col: str, base, values) -> DataFrame:
    """Base-period value on the base row only, null elsewhere."""
    m = _measures(values)
    return df.withColumns({bc: F.when(F.col(order_col) == F.lit(base), F.col(v))
                           for v, (bc, _) in m.items()})


def forward_fill(df: DataFrame, keys: list[str], order_col: str, cols: Iterable[str]) -> DataFrame:
    """Carry the last non-null value forward within each entity (H2).

    Needs (keys, order_col) unique (see ``checks.duplicate_keys``): the fill
    order is then total and each window partition holds one row per period.
    """
    w = (Window.partitionBy(*keys).orderBy(order_col)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns({c: _unique_guard(keys, order_col, F.last(F.col(c), ignorenulls=True).over(w))
                           for c in cols})


def basket_index(df: DataFrame, keys: list[str], good: str, period: str, price: str,
                 quantity: str, base, scale: float = 100.0, digits: int | None = None,
                 index_col: str = "basket_index") -> DataFrame:
    """Laspeyres index per (keys, period).

    ``sum(p_t * q_0) / sum(p_0 * q_0) * scale`` over the goods that have a base
    row; a good counts in a period only when its price then, its base price and
    its base quantity are all known, so numerator and denominator cover the
    same basket.  With one good this equals ``price_index``.

    ``df`` is a panel unique on (keys, good, period).  The base price and
    quantity reach every row through a window over (keys, good), which holds
    one row per period, so the (usually expensive) panel is computed once and
    no partition grows with the data; a self-join would recompute it.
    """
    w = Window.partitionBy(*keys, good)
    at_base = F.col(period) == F.lit(base)
    j = df.select(*keys, good, period, price, quantity).withColumns({
        "__nb": _unique_guard([*keys, good], period, F.count_if(at_base).over(w)),
        "__p0": F.max(F.when(at_base, F.col(price))).over(w),
        "__q0": F.max(F.when(at_base, F.col(quantity))).over(w),
    })
    msg = F.lit(f"more than one base row ({period} = {base}) for a good")
    j = j.filter(F.when(F.col("__nb") > 1, F.raise_error(msg)).otherwise(F.col("__nb") == 1))
    ok = F.col(price).isNotNull() & F.col("__p0").isNotNull() & F.col("__q0").isNotNull()
    num = F.sum(F.when(ok, F.col(price) * F.col("__q0")))
    den = F.sum(F.when(ok, F.col("__p0") * F.col("__q0")))
    return (j.groupBy(*keys, period)
             .agg(_ratio(num, den, scale, digits).alias(index_col),
                  F.count(F.when(ok, F.lit(1))).alias("n_goods")))


def forward_fill_segmented(df: DataFrame, keys: list[str], order_col: str, cols: Iterable[str],
                           rows_per_segment: int = 100_000) -> DataFrame:
    """``forward_fill`` for entities with very many rows (H2), such as a series of events.

    A window over an entity would be one task, however long its series.  Here
    the rows are sorted by range over all tasks, and each task's rows of an
    entity form a segment, cut again after ``rows_per_segment`` rows.  The last known value of
    each segment, a row for each, is carried over the entity's segments (a
    window over segments), and a row takes the last value known in its own
    segment or else what came in from the segments before.  Rows that are equal in
    (keys, order_col) fail, as they have no order.
    """
    cols = list(cols)
    spread = stage(df.repartitionByRange(*keys, order_col).sortWithinPartitions(*keys, order_col)
                   .withColumn("__task", F.spark_partition_id())
                   .withColumn("__nth", F.monotonically_increasing_id()), "segments")
    # Ids go up by one in order within a task, so a segment is a task's share of so many ids.
    segment = ["__task", "__cut"]
    cut = spread.withColumn("__cut", F.floor(F.col("__nth").bitwiseAND(F.lit((1 << 33) - 1)) / rows_per_segment))
    last = cut.groupBy(*keys, *segment).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__nth"))).alias(c) for c in cols],
                                            F.min(order_col).alias("__from"), F.max(order_col).alias("__upto"))
    before = (Window.partitionBy(*keys).orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *segment,
                          *[F.last(c, ignorenulls=True).over(before).alias(f"__in_{c}") for c in cols],
                          F.lag("__upto").over(Window.partitionBy(*keys).orderBy(*segment)).alias("__before"))
    own = Window.partitionBy(*keys, *segment).orderBy("__nth")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    inside = cut.withColumns({f"__own_{c}": F.last(c, ignorenulls=True).over(upto) for c in cols}
                             | {"__prev": F.lag(order_col).over(own)})
    on = [inside[c] == carried[c] for c in segment]
    joined = inside.join(carried, [*on, *same], "left").drop(carried["__task"], carried["__cut"])
    msg = F.lit(f"rows with equal ({', '.join([*keys, order_col])})")
    twice = F.coalesce(F.col("__prev"), F.col("__before")).eqNullSafe(F.col(order_col))
    checked = joined.filter(F.when(twice, F.raise_error(msg)).otherwise(F.lit(True)))
    filled = {c: F.coalesce(F.col(f"__own_{c}"), F.col(f"__in_{c}")) for c in cols}
    return checked.select(*[filled.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
