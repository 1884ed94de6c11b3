"""Mixing sources to target weights by capped water-filling (operator 8).

Sources share a budget of words by weight.  A source whose share exceeds
``max_epochs`` times its size is clamped there, and the excess goes to the
others by weight until no share is above its clamp.  A source's documents are
repeated whole as often as its share allows, and a seeded selection once more,
until the words taken come as near to the share as whole documents can.

Cases: a null or empty text has size 0.  A null source is a source of its own,
last in order.  Rows with the same id and text are selected together.  Input
columns that carry an output's name are replaced, and names that start with
``_mix_`` are reserved.  No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, reserved, staged, without

#: Hash ranges by which the running sums of a source are dealt out.
RANGES = 4096
_SHIFT = 63 - 12


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def shares(sources: DataFrame, weights: list[float], budget: float, max_epochs: float) -> DataFrame:
    """``sources (source, source_size)`` with ``target``, words for each source.

    Weights go to the sources in code-point order, repeating, null last.  Each
    round clamps the shares above their limit and divides what is left; it
    collects two sums.  Rows here are sources, not documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = staged(sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                         (place % len(weights) + 1).cast("int")))
               .withColumn("limit", F.col("source_size") * F.lit(float(max_epochs))), "mix-sources")
    level, before = None, -1.0
    while level != before:
        before = level
        clamped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("limit")
        held, free, total = w.agg(F.sum(F.when(clamped, F.col("limit")).otherwise(0.0)),
                                  F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))),
                                  F.sum("source_size")).first()
        if not free:  # no source, or all at their limit
            break
        level = (budget * total - held) / free
    target = F.lit(0.0) if level is None else F.least(F.col("limit"), F.col("weight") * F.lit(level))
    return w.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: list[float], budget: float = 1.5, max_epochs: float = 2.0, seed: int = 0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``.

    A document's place in its source's seeded order is a hash.  Sums per source
    and hash range show in which range the selection ends; only that range's
    rows are then ordered, to find the last hash selected.  No window holds a
    source: the first runs over at most ``RANGES`` rows of each, the second over
    one range.  What joins the documents is one row per source.
    """
    docs = without(reserved(docs, "_mix_"), ["size", "source_size", "target", "copies"])
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 63) - 1))
    placed = docs.withColumn("_mix_place", place)
    # What the sums need of a document, under names of their own.
    narrow = docs.select(F.col(source_col).alias("source"), place.alias("place"), F.col(text_col).alias("text"))
    ranged = narrow.withColumn("range", F.shiftright("place", _SHIFT))
    sums = staged(ranged.groupBy("source", "range").agg(F.sum(n_words("text")).alias("words")), "mix-ranges")
    targets = shares(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("int")).withColumn(
        "need", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = staged(targets, "mix-targets").withColumnRenamed("source", "of")

    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = (sums.withColumn("before", before).join(targets, F.col("source").eqNullSafe(F.col("of")))
            .filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need")))
            .select("of", F.col("range").alias("end"), "before", "need"))
    ends = staged(ends, "mix-ends")  # a row per source: with its size known, no texts are shuffled to it
    last = (ranged.join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("end")))
            .groupBy("of", "end", "before", "need", "place").agg(F.sum(n_words("text")).alias("words")))
    upto = F.sum("words").over(Window.partitionBy("of").orderBy("place")
                               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = F.col("before") + F.col("upto") - F.col("words") / 2  # taken if that comes nearer to the need
    cut = (last.withColumn("upto", upto).groupBy("of", "end")
           .agg(F.max(F.when(middle <= F.col("need"), F.col("place"))).alias("last"))
           .select(F.col("of").alias("cut_of"), F.coalesce("last", F.shiftleft("end", _SHIFT) - 1).alias("last")))
    chosen = (targets.join(cut, F.col("of").eqNullSafe(F.col("cut_of")), "left")
              .select(F.col("of").alias("_mix_of"), "source_size", "target", F.col("whole").alias("_mix_whole"),
                      F.col("last").alias("_mix_last")))
    extra = F.coalesce((F.col("_mix_place") <= F.col("_mix_last")).cast("int"), F.lit(0))
    return (placed.join(staged(chosen, "mix-chosen"), F.col(source_col).eqNullSafe(F.col("_mix_of")))
            .withColumn("size", n_words(text_col)).withColumn("copies", F.col("_mix_whole") + extra)
            .drop("_mix_of", "_mix_place", "_mix_last", "_mix_whole"))


def repeated_rows(mixed: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` say."""
    once = mixed.filter(F.col("copies") > 0)
    return (once.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .drop("_mix_copy", "copies"))
