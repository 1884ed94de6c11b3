"""Exact top-k search of binary codes by incremental multi-index hashing (operator 6).

A code is cut into ``m`` segments.  If two codes differ in less than
``m * (r + 1)`` bits, some segment differs in at most ``r``.  So the search
grows the radius within which segments are looked up; as soon as ``k`` codes
are verified within the distance covered so far, they are the nearest.

Cases: a null vector, or one of another length, has no code; it is neither
found nor a query, and so are rows with a null id.  A component that is null or
not a number gives a 0.  Rows with equal codes share an index entry with its
smallest ids.  Ties in distance go to the smaller id.  Rows with a query's own
id are not among its neighbours; with fewer than ``k`` other rows all are returned.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Parts in which the ids of a code are cut to the smallest before they meet.
SALTS = 64


def code(vector: str, bits: int) -> Column:
    """The signs of a vector as a long, the first component in the highest bit."""
    if not 1 <= bits <= 64:
        raise ValueError("codes have 1 to 64 bits")
    sign = F.transform(F.col(vector), lambda x: F.when((x > 0) & ~F.isnan(x), "1").otherwise("0"))
    return F.when(F.size(vector) == bits, F.conv(F.array_join(sign, ""), 2, -10).cast("long"))


def segments(bits: int, n_codes: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment; a width near log2 of the codes makes buckets of about one."""
    m = max(1, min(bits, round(bits / max(1.0, math.log2(max(2, n_codes))))))
    cuts = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _part(name: str, at: tuple[int, int]) -> Column:
    shift, width = at
    return F.shiftrightunsigned(name, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def smallest_ids(coded: DataFrame, n: int) -> DataFrame:
    """``(code, ids)``: the ``n`` smallest ids of each code, first within salts, so that
    a code which very many rows share is spread over tasks."""
    rank = F.row_number().over(Window.partitionBy("code", "_salt").orderBy("id"))
    few = (coded.distinct().withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
           .withColumn("_rank", rank).filter(F.col("_rank") <= n))
    return few.groupBy("code").agg(F.slice(F.array_sort(F.collect_list("id")), 1, n).alias("ids"))


def _lookups(asking: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """``(segment, key, query)``: the values at ``radius`` bits from each segment of each query code."""

    def flip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            q = rb.column(0).to_numpy(zero_copy_only=False)
            for i, (shift, width) in enumerate(parts):
                if radius > width:
                    continue
                value = (q.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                masks = np.fromiter((sum(1 << b for b in c) for c in itertools.combinations(range(width), radius)),
                                    np.uint64)
                for at in range(0, len(masks), 4096):
                    keys = (value[:, None] ^ masks[None, at:at + 4096])
                    yield pa.RecordBatch.from_pydict({
                        "segment": pa.array(np.full(keys.size, i, np.int32)), "key": pa.array(keys.ravel().view(np.int64)),
                        "query": pa.array(np.repeat(q, keys.shape[1]))})

    # A few codes make very many rows, so they are dealt to a fixed number of tasks, which Spark does not put together by size.
    n = int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asking.select("query").repartition(n, "query").mapInArrow(flip, "segment int, key long, query long")


def search(rows: DataFrame, queries: DataFrame, k: int, bits: int, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, neighbour_id, distance)``: the ``k`` nearest rows of each query row.

    Equal codes are searched once.  Each round looks up one radius for the codes
    that are not done, and keeps ``k + 1`` verified ids of each (one may be a
    query's own).  A pair is verified only where its smallest segment distance is
    met first, so no pair is counted twice and none needs a distinct.  The joins
    are merge joins: what they meet grows with the data on both sides, and a
    broadcast in each round would add up in the driver.
    """
    as_coded = lambda df: (df.select(F.col(id_col).cast("long").alias("id"), code(vector_col, bits).alias("code"))
                           .filter(F.col("id").isNotNull() & F.col("code").isNotNull()))
    entries = staged(smallest_ids(as_coded(rows), k + 1), "search-codes")
    asked = staged(as_coded(queries).distinct(), "search-queries")
    parts = segments(bits, entries.count())
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), _part("code", p).alias("key"))
                                 for i, p in enumerate(parts)]))
    index = staged(entries.withColumn("_at", places).select("_at.segment", "_at.key", "code", "ids"), "search-index")
    total = entries.agg(F.sum(F.size("ids"))).first()[0] or 0
    asking = asked.select(F.col("code").alias("query")).distinct()
    done: list[DataFrame] = []
    best: DataFrame | None = None
    nearest = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    mine = Window.partitionBy("query")
    for radius in range(max(w for _, w in parts) + 1):
        far = [F.bit_count(_part("query", p).bitwiseXOR(_part("code", p))) for p in parts]
        first = F.lit(True)  # this segment is the first at the smallest distance
        for i, d in enumerate(far):
            first = first & F.when(F.col("segment") > i, d > radius).when(F.col("segment") < i, d >= radius).otherwise(True)
        found = (_lookups(asking, parts, radius).join(index.hint("merge"), ["segment", "key"]).filter(first)
                 .select("query", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int").alias("distance"),
                         F.explode("ids").alias("id")))
        if best is not None:
            found = found.unionByName(best)
        covered = len(parts) * (radius + 1) - 1
        # Open: not enough ids within the distance covered, and more to be found.
        open_ = ((F.count_if(F.col("distance") <= covered).over(mine) <= k) & (F.count("*").over(mine) < F.lit(total))
                 if covered < bits else F.lit(False))
        kept = staged(found.withColumn("_n", nearest).filter(F.col("_n") <= k + 1).drop("_n")
                      .withColumn("open", open_), "search-best")
        settled, best = kept.filter(~F.col("open")).drop("open"), kept.filter("open").drop("open")
        done.append(settled)
        asking = staged(asking.join(settled.hint("merge"), "query", "left_anti"), "search-asking")
        if asking.isEmpty():
            break
    sure = done[0]
    for settled in done[1:]:
        sure = sure.unionByName(settled)
    own = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return (asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(sure.hint("merge"), "query")
            .filter(F.col("id") != F.col("query_id"))
            .select("query_id", F.col("id").alias("neighbour_id"), "distance")
            .withColumn("rank", own).filter(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance"))
