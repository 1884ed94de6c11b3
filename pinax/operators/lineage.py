"""Merged, split and renamed entities of a panel (K4).

Entities that vanish and entities that appear in the period after are matched by
their volumes: the volumes of merged entities add up to the new one's, those of
the parts of a split one to the old one's.  An *explanation* says which entities
one entity came from or went to; the best ones are accepted first, and what
they explain takes no part in others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import drop_staged, stage


def ends(panel: DataFrame, key: str, period: str, volume: str, within: list[str]) -> DataFrame:
    """``(side, entity, since, volume, within ...)``: entities that vanish (``old``) and appear (``new``).

    ``since`` is the period in which the entity is new, or the first one it lacks;
    ``volume`` is its first or last one.  A row per end of an entity, so an
    entity that appears and vanishes has two.  ``within`` are attributes of the entity.
    """
    per = (panel.filter(F.col(key).isNotNull() & F.col(period).isNotNull()).groupBy(key, period)
           .agg(F.coalesce(F.sum(volume).cast("double"), F.lit(0.0)).alias("__v"), *[F.min(w).alias(w) for w in within]))
    spans = per.groupBy(F.col(key).alias("entity")).agg(
        F.min(period).alias("first"), F.max(period).alias("last"), F.min_by("__v", period).alias("first_volume"),
        F.max_by("__v", period).alias("last_volume"), *[F.min(w).alias(w) for w in within])
    # A panel has few periods; their list is a scalar subquery over one aggregate.
    periods = per.select(F.array_sort(F.collect_set(period))).scalar()
    spans = spans.withColumn("periods", periods)
    born = spans.filter(F.col("first") > F.element_at("periods", 1)).select(
        F.lit("new").alias("side"), "entity", F.col("first").alias("since"), F.col("first_volume").alias("volume"), *within)
    after = F.element_at("periods", (F.array_position("periods", F.col("last")) + 1).cast("int"))
    gone = spans.filter(F.col("last") < F.element_at("periods", -1)).select(
        F.lit("old").alias("side"), "entity", after.alias("since"), F.col("last_volume").alias("volume"), *within)
    return born.unionByName(gone)


def _explanations(open_ends: DataFrame, within: list[str], tolerance: float) -> DataFrame:
    """``(side, target, since, target_volume, part, part_volume, error, parts)``: the best explanation of each end.

    Candidates meet by an equi-join on the period and the attributes in
    ``within``.  Taken from the largest that fits down, the parts whose sum comes nearest are used.
    """
    on = ["since", *within]
    side = lambda s, name: open_ends.filter(F.col("side") == s).select(
        *on, F.col("entity").alias(name), F.col("volume").alias(f"{name}_volume"))
    pairs = side("old", "old").join(side("new", "new"), on)
    grouped = lambda s, target, part: pairs.filter(
        (F.col(f"{part}_volume") <= F.col(f"{target}_volume") * (1 + tolerance)) & (F.col(f"{target}_volume") > 0)).select(
        F.lit(s).alias("side"), F.col(target).alias("target"), "since", F.col(f"{target}_volume").alias("target_volume"),
        F.col(part).alias("part"), F.col(f"{part}_volume").alias("part_volume"))
    candidates = grouped("new", "new", "old").unionByName(grouped("old", "old", "new"))
    largest = Window.partitionBy("side", "target").orderBy(F.desc("part_volume"), "part")
    run = F.sum("part_volume").over(largest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (candidates.withColumn("run", run).withColumn("rank", F.row_number().over(largest))
              .withColumn("error", F.abs(F.col("run") - F.col("target_volume")) / F.col("target_volume")))
    best = F.min(F.struct("error", "rank")).over(Window.partitionBy("side", "target"))
    found = (ranked.withColumn("best", best).filter((F.col("rank") <= F.col("best.rank")) & (F.col("best.error") <= tolerance))
             .select("side", "target", "since", "target_volume", "part", "part_volume", F.col("best.error").alias("error"),
                     F.col("best.rank").alias("parts")))
    return found.filter((F.col("side") == "new") | (F.col("parts") > 1))  # one to one is told once


def lineage_events(panel: DataFrame, key: str, period: str, volume: str, within: list[str] | None = None,
                   tolerance: float = 0.2) -> DataFrame:
    """``(kind, since, old, new, old_volume, new_volume, error)``: a row for each entity that went into another.

    ``kind`` is ``merged`` (several into one), ``split`` (one into several) or
    ``renamed``; ``error`` is the share by which the volumes do not add up, at
    most ``tolerance``.  ``within`` names attributes (a region, say) that
    entities of one explanation share, which also keeps the candidates few.
    In each round an explanation is accepted when it is the best one for all its
    entities, so at least the best of all is; rounds go on with the other
    entities until nothing more is explained.  Entities that no explanation
    fits are left out (``churn`` lists them).  The result reads staged rows;
    ``drop_staged`` removes them once it is read.
    """
    within = within or []
    open_ends, events = stage(ends(panel, key, period, volume, within), "lineage-ends"), None
    while True:
        found = stage(_explanations(open_ends, within, tolerance), "lineage-found")
        other = F.when(F.col("side") == "new", F.lit("old")).otherwise(F.lit("new"))
        parts = found.select("side", "target", "parts", "error", other.alias("end"), F.col("part").alias("entity"))
        targets = found.select("side", "target", "parts", "error", F.col("side").alias("end"),
                               F.col("target").alias("entity")).distinct()
        wish = F.min(F.struct("error", "side", "target")).over(Window.partitionBy("end", "entity"))
        agreed = (parts.unionByName(targets).withColumn("wish", wish)
                  .groupBy("side", "target", "parts")
                  .agg(F.count_if((F.col("wish.side") == F.col("side")) & (F.col("wish.target") == F.col("target"))).alias("n"))
                  .filter(F.col("n") == F.col("parts") + 1).select("side", "target"))
        accepted = stage(found.join(agreed, ["side", "target"]), "lineage-accepted")
        if accepted.isEmpty():
            for done in (found, open_ends):
                drop_staged(done)
            break
        events = accepted if events is None else events.unionByName(accepted)
        used = (accepted.select(F.col("side"), F.col("target").alias("entity"))
                .union(accepted.select(other, "part")).distinct())
        left = stage(open_ends.join(used, ["side", "entity"], "left_anti"), "lineage-open")
        for done in (found, open_ends):
            drop_staged(done)
        open_ends = left
    new_side = F.col("side") == "new"
    kind = (F.when(F.col("parts") == 1, F.lit("renamed")).when(new_side, F.lit("merged")).otherwise(F.lit("split")))
    return (accepted if events is None else events).select(
        kind.alias("kind"), "since", F.when(new_side, F.col("part")).otherwise(F.col("target")).alias("old"),
        F.when(new_side, F.col("target")).otherwise(F.col("part")).alias("new"),
        F.when(new_side, F.col("part_volume")).otherwise(F.col("target_volume")).alias("old_volume"),
        F.when(new_side, F.col("target_volume")).otherwise(F.col("part_volume")).alias("new_volume"), "error")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node that each node of an edge is connected with.

    Alternates two steps until nothing changes: larger neighbours, and then
    smaller ones, are linked to the smallest of each neighbourhood.  A
    neighbourhood is only ever aggregated and joined, never gathered in a row,
    and the number of rounds grows with the logarithm of the size.
    """
    links = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "components")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    seen, first = None, links
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        larger = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = larger.filter("a > b").unionByName(larger.filter("a < b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        smaller = (down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                   .unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        links, before = stage(smaller, "components"), links
        if before is not first:  # the nodes are read from the first
            drop_staged(before)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def lineages(events: DataFrame) -> DataFrame:
    """``(entity, lineage)``: entities linked by events over all periods, named by the smallest of them.

    Replacing an entity by its lineage gives a panel of constant territories.
    """
    return connected_components(events, "old", "new").select(F.col("node").alias("entity"),
                                                             F.col("component").alias("lineage"))
