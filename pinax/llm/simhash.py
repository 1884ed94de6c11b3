"""SimHash near-duplicates by a generalised pigeonhole search (operator 9).

A document's fingerprint has 64 bits, each the majority over its shingles'
hashes.  Fingerprints link when at most ``distance`` bits differ.  Bits that
vary together are grouped into partitions; partition ``i`` is searched within
``t_i`` bits, where the ``t_i`` add up to ``distance - partitions + 1``: if
every partition differed in more bits than that, the whole would differ in more
than ``distance``.  A dynamic programme picks the thresholds (some may be -1:
not searched) with the least estimated cost.

Cases: texts with fewer words than a shingle hash their whole sequence of
words; null, empty and blank texts have fingerprint zero and link like any
other.  Repeated rows are equal documents.  A null id never names a component
that has another id.  Input columns that carry an output's name are replaced;
``deduplicate`` reserves names that start with ``_simhash_``, ``_r1`` or ``_r2``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .anchors import named
from .common import as_struct_type, blocks, is_separator, release_spare, reserved, staged, utf8, without, words
from .components import components

BITS = 64
#: Fixed seed of the shingle hash (XXH64).
SEED = 42

#: Fingerprints, at most, on which the partitions and thresholds are planned.
#: The plan decides cost only; every link is found under any plan.
SAMPLE = 4096
#: Rows of a key above which it is split through the shuffle.
SPLIT_ABOVE = 1 << 15


def _fingerprints(data: np.ndarray, offs: np.ndarray, shingle: int) -> np.ndarray:
    import xxhash

    n = len(offs) - 1
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, row = words(data, offs)
    out = np.zeros(n, np.uint64)
    if not len(starts):
        return out
    # Words joined by one space: their bytes, and a separator before all but a row's first.
    keep = ~is_separator(data)
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    keep[starts[~first] - 1] = True
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    joined = data[keep]
    joined[is_separator(joined)] = 32
    s, e, buf = at[starts], at[ends], joined.tobytes()

    rows, begin = np.unique(row, return_index=True)
    count = np.diff(np.append(begin, len(row)))
    last = np.minimum(np.arange(len(row)) + shingle - 1, np.repeat(begin + count - 1, count))
    whole = np.repeat(count < shingle, count)
    is_shingle = np.where(whole, first, np.arange(len(row)) + shingle - 1 == last)
    of = row[is_shingle]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(buf[a:b], SEED) for a, b in zip(s[is_shingle].tolist(), e[last[is_shingle]].tolist())),
                    np.uint64, len(of))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows, begin = np.unique(of, return_index=True)
    total = np.diff(np.append(begin, len(of)))
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    major = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little")
    out[rows] = major.reshape(-1, 8).copy().view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``fingerprint`` (long) of the whole text."""
    docs = without(docs, ["fingerprint"])
    shape = docs if keep_text else docs.drop(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in blocks(batches, text_col):
            at = rb.schema.get_field_index(text_col)
            found = _fingerprints(*utf8(rb.column(at)), shingle).view(np.int64)
            yield (rb if keep_text else rb.remove_column(at)).append_column("fingerprint", pa.array(found))

    return docs.mapInArrow(add, as_struct_type(shape, ("fingerprint", LongType())))


def _grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of even size, correlated ones together."""
    size = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        like = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(sample) > 1 else np.zeros((BITS, BITS))
    free, groups = set(range(BITS)), []
    for n in size:
        seed = max(sorted(free), key=lambda b: like[b, sorted(free)].sum())
        group = [seed]
        free.discard(seed)
        while len(group) < n:
            best = max(sorted(free), key=lambda b: like[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def plan(sample: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """Partitions (bit numbers) and their thresholds, of least estimated cost.

    For each partition and threshold the sampled pairs within it estimate the
    candidates; the keys to be dealt out add to the cost.
    """
    n = len(sample)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    pairs = (total / max(n, 1)) ** 2 / 2
    for parts in range(1, distance + 2):
        groups = _grouped_bits(sample, parts)
        costs = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            near = np.zeros(distance + 1)
            for at in range(0, n, 256):
                far = np.bitwise_count((sample[at:at + 256, None] ^ sample[None, :]) & mask)
                near += np.bincount(np.minimum(far, distance + 1).ravel(), minlength=distance + 2)[:distance + 1]
            near[0] -= n
            keys = [sum(math.comb(len(g), k) for k in range(t + 1)) for t in range(distance + 1)]
            costs.append([0.0, *(40.0 * keys[t] * total + near[:t + 1].sum() * pairs for t in range(distance + 1))])
        # least[s]: cost and thresholds of the partitions so far that add up to s (each from -1 on).
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for c in costs:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (cost, ts) in least.items():
                for t in range(-1, distance + 1):
                    new = (cost + c[t + 1], (*ts, t))
                    if s + t not in step or new < step[s + t]:
                        step[s + t] = new
            least = step
        cost, ts = least[distance - parts + 1]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


def _packed(x: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for i, b in enumerate(group):
        out |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def _keys(x: np.ndarray, parts: list[tuple[list[int], int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(partition, keys, fingerprints, own): each fingerprint's own key in each
    partition, and its keys at the allowed distance.  Of a pair that differs in
    some bits, the one with the lowest of these bits unset probes."""
    for i, (group, t) in enumerate(parts):
        own = _packed(x, group)
        yield i, own, x, True
        for k in range(1, t + 1):
            for flip in itertools.combinations(range(len(group)), k):
                low = (own >> np.uint64(flip[0])) & np.uint64(1) == 0
                yield i, own[low] ^ np.uint64(sum(1 << f for f in flip)), x[low], False


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(i + x, j + y) for i in range(0, len(a), 1024) for j in range(0, len(b), 1024)
             for x, y in [np.nonzero(np.bitwise_count(a[i:i + 1024, None] ^ b[None, j:j + 1024]) <= distance)]]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


#: Fingerprints of one key that are compared pair by pair; more are first split by their other bits.
BUCKET = 2048


def _bucket_links(own: np.ndarray, probes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links in one bucket, as a forest: enough edges to join what is linked."""
    nodes = np.unique(np.concatenate([own, probes]))
    if len(nodes) < 2 or not len(own):
        return nodes[:0], nodes[:0]
    top = np.arange(len(nodes))  # of each node a smaller one of its component, in the end the smallest

    def link(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal top
        x, y = _near(a, b, distance)
        x, y = np.searchsorted(nodes, a[x]), np.searchsorted(nodes, b[y])
        while True:
            low = np.minimum(top[x], top[y])
            new = top.copy()
            for i in (x, y, top[x], top[y]):
                np.minimum.at(new, i, low)
            new = new[new]
            if (new == top).all():
                return
            top = new

    if len(nodes) <= BUCKET:
        link(own, np.concatenate([own, probes]))
    else:
        # Pigeonhole again within the bucket: one of distance + 1 slices must be equal.
        everyone = np.concatenate([own, probes])
        width = BITS // (distance + 1)
        for k in range(distance + 1):
            shift = np.uint64(k * width)
            mask = np.uint64((1 << (width if k < distance else BITS - k * width)) - 1)
            oslice, eslice = (own >> shift) & mask, (everyone >> shift) & mask
            oorder, eorder = np.argsort(oslice, kind="stable"), np.argsort(eslice, kind="stable")
            oslice, eslice = oslice[oorder], eslice[eorder]
            values, at = np.unique(oslice, return_index=True)
            until = np.append(at[1:], len(oslice))
            lo, hi = np.searchsorted(eslice, values), np.searchsorted(eslice, values, side="right")
            for a, b, c, d in zip(at.tolist(), until.tolist(), lo.tolist(), hi.tolist()):
                if d - c > 1:
                    link(own[oorder[a:b]], everyone[eorder[c:d]])
    leaf = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[leaf], nodes[top[leaf]]


def _split(dealt: DataFrame, distance: int) -> DataFrame:
    """``dealt`` with the rows of keys that very many share dealt out again, by slices of the fingerprint.

    Of ``distance + 1`` slices two linked fingerprints have one in common, so
    each of a key's rows goes to as many smaller keys, and no link is lost.
    """
    big = staged(dealt.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT_ABOVE)
                 .select("part", "key"), "simhash-big")
    width = BITS // (distance + 1)
    slices = F.array(*[F.struct(F.lit(k).alias("slice"), F.shiftrightunsigned("fp", k * width).bitwiseAND(
        F.lit((1 << width) - 1 if k < distance else -1)).alias("bits")) for k in range(distance + 1)])
    again = (dealt.join(big, ["part", "key"], "left_semi").withColumn("at", F.explode(slices))
             .select("part", F.xxhash64("key", "at.slice", "at.bits").alias("key"), "own", "fp"))
    return dealt.join(big, ["part", "key"], "left_anti").unionByName(again)


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """Edges ``(a, b)`` that join exactly the fingerprints joined by chains of links.

    ``distinct`` has one row for each fingerprint.  Fingerprints are dealt out by
    their keys, and those of keys that very many share once more by slices; equal
    keys meet in a task, which reads them in order, verifies the distance, and
    returns a forest of a key's links instead of all its pairs.
    """
    drawn = distinct.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE)
    sample = np.array([r[0] for r in drawn.collect()], np.int64).view(np.uint64)
    parts = plan(sample, distinct.count(), distance)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            x = rb.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, key, fp, own in _keys(x, parts):
                if len(key):
                    yield pa.RecordBatch.from_pydict(
                        {"part": pa.array(np.full(len(key), i, np.int32)), "key": pa.array(key.view(np.int64)),
                         "own": pa.array(np.full(len(key), own)), "fp": pa.array(fp.view(np.int64))})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for rb in itertools.chain(batches, [None]):
            if rb is not None:
                held.append(np.stack([rb.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)]))
            x = np.concatenate(held, axis=1) if held else np.zeros((4, 0), np.int64)
            if not x.shape[1]:
                continue
            cut = np.flatnonzero((x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])) + 1
            cut = np.concatenate([[0], cut, [x.shape[1]] if rb is None else []]).astype(int)
            out_a, out_b = [], []
            big = np.flatnonzero(np.diff(cut) > 1)
            for a, b in zip(cut[big].tolist(), cut[big + 1].tolist()):
                own = x[2, a:b] == 1
                fp = x[3, a:b].view(np.uint64)
                p, q = _bucket_links(fp[own], fp[~own], distance)
                out_a.append(p)
                out_b.append(q)
            held = [x[:, cut[-1]:]]  # the last key may go on
            if out_a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(out_a).view(np.int64)),
                                                  "b": pa.array(np.concatenate(out_b).view(np.int64))})
        release_spare()

    dealt = distinct.select("fingerprint").mapInArrow(deal, "part int, key long, own boolean, fp long")
    dealt = _split(dealt, distance)
    return (dealt.repartition("part", "key").sortWithinPartitions("part", "key")
            .mapInArrow(verify, "a long, b long"))


def _classes(docs: DataFrame, shingle: int, distance: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, _r1, _r2, fingerprint, component, component_id)`` for each row; the hashes name its text."""
    marked = staged(fingerprints(named(docs.select(id_col, text_col), text_col), text_col, shingle,
                                 keep_text=False), "simhash")
    distinct = staged(marked.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "simhash-distinct")
    roots = components(links(distinct, distance))
    of = (distinct.join(roots, F.col("fingerprint") == F.col("node"), "left")
          .select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("component")))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(of.select("fingerprint", "component").join(least, "component"), "fingerprint")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component, component_id)`` for each row of ``docs``.

    ``component`` names the class (its smallest fingerprint), ``component_id``
    is the smallest id in it.
    """
    return (_classes(docs, shingle, distance, id_col, text_col)
            .select(id_col, "fingerprint", "component", "component_id"))


def deduplicate(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row of each class of near-duplicates: one with the smallest id.

    The rows that stay are chosen on numbers alone and found again by id and
    text hashes, so texts cross one exchange.  Rows that agree in both, of which
    one stays, need another; whether there are any is looked up first.
    """
    for prefix in ("_simhash_", "_r1", "_r2"):
        reserved(docs, prefix)
    text = [F.col("_r1"), F.col("_r2")]
    chosen = (_classes(docs, shingle, distance, id_col, text_col)
              .filter(F.col(id_col).eqNullSafe(F.col("component_id")))
              .groupBy("component", F.col(id_col).alias("id"), *text).agg(F.count("*").alias("n"))
              .groupBy("component").agg(F.min(F.struct("id", *text, "n")).alias("first"))
              .select(F.col("first.id").alias("_simhash_id"), F.col("first._r1").alias("_simhash_1"),
                      F.col("first._r2").alias("_simhash_2"), F.col("first.n").alias("_simhash_n")))
    chosen = staged(chosen, "simhash-chosen")
    kept = named(docs, text_col).join(
        chosen, F.col(id_col).eqNullSafe(F.col("_simhash_id")) & (F.col("_r1") == F.col("_simhash_1"))
        & (F.col("_r2") == F.col("_simhash_2")), "left_semi")
    if not chosen.filter(F.col("_simhash_n") > 1).isEmpty():
        kept = kept.dropDuplicates([id_col, "_r1", "_r2"])
    return kept.select(*[f"`{c}`" for c in docs.columns])
