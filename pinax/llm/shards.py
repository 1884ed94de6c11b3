"""Sharding by fixed virtual slots (operator 2).

Records hash into thousands of slots, whose number never changes.  Bytes are
summed per slot, and a versioned map says which shard holds each slot.  Shards
are balanced, added or removed by editing the map: slots move, records never
change slots.  Each version of the map is stored as a table in a shared folder;
the next run loads the newest one and edits it, so that few records move.

The law that holds is ``bytes``: the shards' sizes are near equal.

Cases: a null text counts as no bytes and as an empty one for its checksum.
Rows with equal id and text are interchangeable; their copies are dealt out in
lots, so that a row repeated very often does not weigh on one slot.  A null id
hashes like any other value, with the text.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

SLOTS = 8192
#: Copies of an equal row that hash together.
LOT = 256
#: Bytes a record takes beside its text.
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """Version and shard of each slot.  Edits return the next version."""

    shards: tuple[int, ...]
    n_shards: int
    version: int = 1

    @staticmethod
    def even(n_shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(tuple(s % n_shards for s in range(slots)), n_shards)

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shards):
            out[shard] += sizes[slot]
        return out

    def rebalanced(self, sizes: list[int], tolerance: float = 0.001) -> SlotMap:
        """The next version, whose shards' bytes are near equal, by few moves.

        Slots leave shards above the mean, largest first as long as they fit in
        the excess, and go to the shards that lack most; then the fullest and the emptiest
        shard exchange slots while that narrows their gap.
        """
        shards, load = list(self.shards), self.loads(sizes)
        mean = sum(load) / self.n_shards
        of: list[list[int]] = [[] for _ in load]
        for slot in sorted(range(len(shards)), key=lambda s: (sizes[s], s)):
            if sizes[slot]:
                of[shards[slot]].append(slot)  # ascending by size
        loose = []
        for k, own in enumerate(of):
            for slot in reversed(own):
                if load[k] - sizes[slot] >= mean or (load[k] > mean and len(own) > 1 and sizes[slot] > load[k] / 2):
                    load[k] -= sizes[slot]
                    loose.append(slot)
        for slot in sorted(loose, key=lambda s: (-sizes[s], s)):
            k = min(range(self.n_shards), key=lambda i: (load[i], i))
            shards[slot] = k
            load[k] += sizes[slot]
        for _ in range(20 * self.n_shards):
            high = max(range(self.n_shards), key=lambda i: (load[i], i))
            low = min(range(self.n_shards), key=lambda i: (load[i], i))
            gap = load[high] - load[low]
            if gap <= tolerance * mean:
                break
            mine = [s for s, k in enumerate(shards) if k == high and sizes[s]]
            theirs = [None, *(s for s, k in enumerate(shards) if k == low and sizes[s])]
            size = lambda s: 0 if s is None else sizes[s]
            theirs.sort(key=lambda s: (size(s), -1 if s is None else s))
            best, pick = gap, None
            for s in mine:  # the partner whose exchange moves nearest to half the gap
                want = sizes[s] - gap / 2
                lo, hi = 0, len(theirs)
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if size(theirs[mid]) < want else (lo, mid)
                for t in theirs[max(0, lo - 1):lo + 1]:
                    left = abs(gap - 2 * (sizes[s] - size(t)))
                    if left < best:
                        best, pick = left, (s, t)
            if pick is None:
                break
            s, t = pick
            shards[s] = low
            if t is not None:
                shards[t] = high
            load[high] += size(t) - sizes[s]
            load[low] += sizes[s] - size(t)
        return SlotMap(tuple(shards), self.n_shards, self.version + 1)

    def grown(self, sizes: list[int]) -> SlotMap:
        """The next version with one more shard, which alone takes slots."""
        new, shards, load = self.n_shards, list(self.shards), [*self.loads(sizes), 0]
        mean = sum(load) / (new + 1)
        for slot in sorted(range(len(shards)), key=lambda s: (-sizes[s], s)):
            k = shards[slot]
            if load[k] - sizes[slot] >= mean * 0.98 and load[new] + sizes[slot] <= mean * 1.02:
                load[k] -= sizes[slot]
                load[new] += sizes[slot]
                shards[slot] = new
        return SlotMap(tuple(shards), new + 1, self.version + 1)

    def moved(self, other: SlotMap) -> int:
        """Slots that another version holds elsewhere."""
        return sum(a != b for a, b in zip(self.shards, other.shards))

    def table(self, spark: SparkSession) -> DataFrame:
        """``(virtual_slot, shard, n_shards)``: as many rows as there are slots."""
        return spark.createDataFrame([(s, k, self.n_shards) for s, k in enumerate(self.shards)],
                                     "virtual_slot int, shard int, n_shards int")


def save_map(spark: SparkSession, slot_map: SlotMap, folder: str) -> None:
    """Store a version as ``folder/version=N``; a version that is there already is an error, not replaced."""
    slot_map.table(spark).coalesce(1).write.mode("error").parquet(f"{folder}/version={slot_map.version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap | None:
    """The newest version stored in ``folder`` (or a given one), null if there is none.

    A version counts once its write is complete, so one that a lost driver left half written is passed over.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(hadoop)
    if not fs.exists(path):
        return None
    found = [f.getPath() for f in fs.listStatus(path)]
    whole = [int(p.getName().removeprefix("version=")) for p in found if p.getName().startswith("version=")
             and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if version is not None:
        whole = [v for v in whole if v == version]
    if not whole:
        return None
    rows = spark.read.parquet(f"{folder}/version={max(whole)}").orderBy("virtual_slot").collect()  # SLOTS rows
    return SlotMap(tuple(r["shard"] for r in rows), rows[0]["n_shards"], max(whole))


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, n, virtual_slot)``: lots of equal records and their slots."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), F.when(F.col(text_col).isNull(), F.lit(0))
                         .otherwise(F.octet_length(text_col)).cast("long").alias("bytes"),
                         F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    same = narrow.groupBy("id", "bytes", "text_crc32", "_hash").agg(F.count("*").alias("n"))
    lots = same.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))))
    return lots.select("id", (F.col("bytes") + OVERHEAD).alias("size"), "text_crc32", "_hash",
                       F.least(F.col("n") - F.col("_lot") * LOT, F.lit(LOT)).alias("n"), "_lot",
                       F.pmod(F.xxhash64("id", "_hash", "_lot"), F.lit(SLOTS)).cast("int").alias("virtual_slot"))


def grow(spark: SparkSession, sizes: list[int], folder: str) -> SlotMap:
    """Store the next version of the newest map, with one more shard, which alone takes slots."""
    save_map(spark, load_map(spark, folder).grown(sizes), folder)
    return load_map(spark, folder)


def slot_sizes(lots: DataFrame) -> DataFrame:
    """``(virtual_slot, bytes, rows)``: at most ``SLOTS`` rows."""
    return lots.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"),
                                            F.sum("n").alias("rows"))


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
          folder: str | None = None, slot_map: SlotMap | None = None) -> tuple[DataFrame, SlotMap]:
    """Placed records and the map by which they are placed.

    With ``folder`` the newest map stored there is edited, and the next version
    stored if a slot moves; an empty folder gets an even map as version 1 first.
    Without, ``slot_map`` or an even one is edited and nothing is stored.

    The records have ``(id, size, text_crc32, shard, slot, virtual_slot,
    map_version)``; ``slot`` numbers a shard's records from 0 without gaps.
    The driver sees the slots' sums, never records.  Numbers come from the
    slots' row counts and a window within each slot, so no task holds a shard.
    """
    spark = docs.sparkSession
    lots = staged(records(docs, id_col, text_col), "shard-records")
    sums = {r[0]: (r[1], r[2]) for r in slot_sizes(lots).collect()}
    sizes = [sums.get(s, (0, 0))[0] for s in range(SLOTS)]
    if folder is not None:
        slot_map = load_map(spark, folder)
        if slot_map is None:
            save_map(spark, SlotMap.even(n_shards), folder)
            slot_map = load_map(spark, folder)
        if slot_map.n_shards != n_shards:
            raise ValueError(f"the map in {folder} has {slot_map.n_shards} shards, not {n_shards}")
    old = slot_map or SlotMap.even(n_shards)
    new = old.rebalanced(sizes)
    if folder is not None:
        new = new if new.moved(old) else old
        if new.version > old.version:
            save_map(spark, new, folder)
            new = load_map(spark, folder)
    first, offsets = [0] * n_shards, []
    for s, k in enumerate(new.shards):
        offsets.append((s, k, first[k]))
        first[k] += sums.get(s, (0, 0))[1]
    where = F.broadcast(spark.createDataFrame(offsets, "virtual_slot int, shard int, _first long"))  # SLOTS rows
    order = Window.partitionBy("virtual_slot").orderBy("id", "size", "text_crc32", "_hash", "_lot")
    earlier = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lots.withColumn("_at", earlier).join(where, "virtual_slot")
    copies = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return copies.select("id", "size", "text_crc32", "shard",
                         (F.col("_first") + F.col("_at") + F.col("_copy")).alias("slot"), "virtual_slot",
                         F.lit(new.version).alias("map_version")), new
