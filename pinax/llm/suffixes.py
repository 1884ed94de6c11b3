"""Removal of repeated byte strings by hash-compared suffix sorting (operator 3).

A suffix array needs only the suffixes that can matter: those at anchors
(``anchors.py``) whose gram occurs again.  They are dealt out by gram and
sorted, once by what follows the anchor and once by what precedes it, in a
mergesort whose comparisons find the common extension of two suffixes by binary
search on prefix polynomial hashes.  Common extensions of neighbours then say
for every window around an anchor whether it occurs again: windows are equal
if they agree in both orders.  All comparisons are verified on the bytes; if a
hash misled the sort, it is repeated with another base.

Cases: a null or empty text has no bytes.  Every copy of a repeated string goes,
also the first, also within one text; rows with equal texts are copies of each
other.  Input columns that carry an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from . import anchors
from .common import BASE, BYTE_VALUES, as_struct_type, blocks, powers, staged, utf8, without
from .rlz import _removed, marked

WINDOW, GRAM = 200, 64
#: Bytes of a window at most: on longer texts there are some that hashes of any base take for equal.
LARGEST_WINDOW = 512
#: Texts of one gram that are sorted in one task; with more, windows are grouped by Spark.
CROWD = 1 << 16


class Extensions:
    """Longest common extensions of places in a byte string."""

    def __init__(self, data: np.ndarray, base: int):
        self.data = data
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(base, len(data))[:len(data)], dtype=np.uint64, out=self.prefix[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), len(data))

    def of(self, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes from ``p`` and ``q`` on agree, ``most`` at most: binary search on hashes."""
        n = np.zeros(len(p), np.int64)
        step = 1 << max(0, int(most.max(initial=1)).bit_length() - 1)
        while step:
            can = n + step <= most
            a, b = np.where(can, p + n, 0), np.where(can, q + n, 0)
            s = np.where(can, step, 0)
            same = ((self.prefix[a + s] - self.prefix[a]) * self.inverse[a]
                    == (self.prefix[b + s] - self.prefix[b]) * self.inverse[b])
            n += np.where(can & same, step, 0)
            step >>= 1
        return n

    def less(self, p: np.ndarray, lp: np.ndarray, q: np.ndarray, lq: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at p is before the one at q; ``equal``: what holds for equal ones."""
        most = np.minimum(lp, lq)
        n = self.of(p, q, most)
        at = len(self.data) - 1
        differ = self.data[np.minimum(p + n, at)] < self.data[np.minimum(q + n, at)]
        return np.where(n < most, differ, np.where(lp == lq, equal, lp < lq))


def suffix_sort(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes in each group (numbers that ascend), and each one's common
    extension with the one before it (-1 for the first of a group).

    Bottom-up mergesort of all groups at once: each element finds its rank in
    the neighbouring run by binary search.
    """
    n, base = len(starts), BASE
    new = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    while True:
        ext = Extensions(data, base)
        order, width = np.arange(n), 1
        while width < count.max(initial=0):
            local = np.arange(n) - first
            run = local // width
            beside = (run ^ 1) * width
            others = np.clip(count - beside, 0, width)
            slots = np.flatnonzero(others > 0)
            x, right = order[slots], run[slots] % 2 == 1
            lo, hi = np.zeros(len(slots), np.int64), others[slots].copy()
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                y, z = order[first[slots[open_]] + beside[slots[open_]] + mid], x[open_]
                up = ext.less(starts[y], sizes[y], starts[z], sizes[z], right[open_])  # equal ones stay in order
                lo[open_] = np.where(up, mid + 1, lo[open_])
                hi[open_] = np.where(up, hi[open_], mid)
            pair = first[slots] + (run[slots] // 2) * 2 * width
            merged = order.copy()
            merged[pair + local[slots] - run[slots] * width + lo] = x
            order, width = merged, width * 2
        common = np.full(n, -1, np.int64)
        inner = np.flatnonzero(~new)
        a, b = order[inner - 1], order[inner]
        most = np.minimum(sizes[a], sizes[b])
        common[inner] = ext.of(starts[a], starts[b], most)
        if _verified(data, starts[a], sizes[a], starts[b], sizes[b], common[inner], most):
            return order, common
        base = (base * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1


def _verified(data, p, lp, q, lq, n, most) -> bool:
    """Whether the bytes bear out the common extensions and the order of neighbours."""
    for i in range(int(n.max(initial=0))):
        on = n > i
        if (data[p[on] + i] != data[q[on] + i]).any():
            return False
    on = n < most
    return bool((data[p[on] + n[on]] < data[q[on] + n[on]]).all() and (lp[~on] <= lq[~on]).all())


def _classes(order: np.ndarray, common: np.ndarray, size: int) -> np.ndarray:
    """Number of each suffix's class: those that agree in their first ``size`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < size)
    return out


def _best(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Each suffix's longest common extension with any other of its group."""
    after = np.append(common[1:], -1)
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(np.maximum(common, after), 0)
    return out


SPAN = "_no long, start int, end int"


def _repeats(t: pa.Table, window: int, gram: int) -> pa.Table:
    """Spans of the passages' windows that occur at two places, for whole groups of grams."""
    h, no = t.column("_h").to_numpy(), t.column("_no").to_numpy()
    unit = pc.list_element(t.column("units"), 0).to_numpy()
    order = np.lexsort((unit, no, h))
    same = np.zeros(len(order), bool)
    same[1:] = np.all([c[order][1:] == c[order][:-1] for c in (h, no, unit)], axis=0)
    t = t.take(pa.array(order[~same])).combine_chunks()  # a place counts once
    h, back, ahead = (t.column(c).to_numpy().astype(np.int64) for c in ("_h", "back", "ahead"))
    unit = pc.list_element(t.column("units"), 0).to_numpy().astype(np.int64)
    times = pc.list_value_length(t.column("units")).to_numpy()
    data, offs = utf8(t.column("around"))
    anchor = offs[:-1] + back
    after, after_common = suffix_sort(data, anchor, ahead, h)
    before, before_common = suffix_sort(data[::-1].copy(), len(data) - anchor, back, h)
    longest, widest = _best(after, after_common), _best(before, before_common)
    hits = np.zeros((len(h), window - gram + 2), bool)
    for j in range(window - gram + 1):  # windows that start j bytes before their anchor
        alike = (widest >= j) & (longest >= window - j)
        able = np.flatnonzero((back >= j) & (ahead >= window - j) & (alike | (times > 1)))
        if not len(able):
            continue
        key = (_classes(after, after_common, window - j)[able] * (len(h) + 1)
               + _classes(before, before_common, j)[able])
        _, number = np.unique(key, return_inverse=True)
        hits[able, j] = np.bincount(number, times[able])[number] > 1
    edge = np.diff(hits.astype(np.int8), axis=1, prepend=0)
    who, low = np.nonzero(edge == 1)  # runs of hits, from the smallest j
    _, past = np.nonzero(edge == -1)
    no, start, end = anchors.at_all_units(t, who, unit[who] - (past - 1), unit[who] - low + window)
    return pa.table({"_no": no, "start": start.astype(np.int32), "end": end.astype(np.int32)})


def _crowded(shown: DataFrame, window: int, gram: int) -> DataFrame:
    """Spans of passages whose gram is at very many places: each window is a row, and
    whether equal windows lie at two places is an aggregate with map-side sums."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for rb in blocks(batches, "around", 1 << 18):
            keys, who, start = [], [], []
            for i, (s, b, a, u) in enumerate(zip(*(rb.column(c).to_pylist()
                                                   for c in ("around", "back", "ahead", "unit")))):
                for j in range(max(0, window - a), min(window - gram, b) + 1):
                    keys.append(digest(s[b - j:b - j + window]))
                    who.append(i)
                    start.append(u - j)
            pick = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys, pa.binary()), "_no": rb.column("_no").take(pick), "start": pa.array(start, pa.int32())})

    rows = shown.select("_no", F.explode("units").alias("unit"), "back", "ahead", "around").mapInArrow(
        spread, "key binary, _no long, start int")
    place = F.struct("_no", "start")
    many = (rows.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b"))
            .filter(F.col("a") != F.col("b")).select("key"))
    return rows.join(many, "key", "left_semi").select("_no", "start", (F.col("start") + window).alias("end"))


def repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD
            ) -> tuple[DataFrame, DataFrame]:
    """``(spans, copies)``: bytes of each text in windows that occur at another place."""
    if window > LARGEST_WINDOW:
        raise ValueError(f"a window has at most {LARGEST_WINDOW} bytes")
    texts = anchors.named(docs.select(text_col), text_col)
    copies = anchors.copies_of(texts)
    shared = anchors.shared_anchors(texts, text_col, anchors.byte_units, window, gram, within=True)
    shown, any_crowd = anchors.located(texts, copies, shared, text_col, anchors.byte_units, window, gram,
                                       crowd, ordered=False)
    cols = ["_h", "_no", "units", "back", "ahead", "around", "known", "known_id"]
    if not any_crowd:
        return anchors.by_gram(shown.select(*cols), lambda t: _repeats(t, window, gram), SPAN, window), copies
    shown = staged(shown, "suffix-passages")
    few = anchors.by_gram(shown.filter(~F.col("crowded")).select(*cols), lambda t: _repeats(t, window, gram), SPAN, window)
    return few.unionByName(_crowded(shown.filter("crowded"), window, gram)), copies


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                   crowd: int = CROWD) -> DataFrame:
    """``docs`` without the text but with ``kept`` (the bytes left, in order), ``n_bytes``
    (before), ``n_removed`` and ``n_spans`` (maximal removed runs)."""
    docs = without(docs, ["kept", "n_bytes", "n_removed", "n_spans", "_r1", "_r2", "first_id", "n", "_no", "_spans"])
    spans, copies = repeats(docs, text_col, window, gram, crowd)
    joined = marked(docs, spans, copies, text_col)
    shape = docs.drop(text_col)
    columns = shape.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in anchors.unpacked(batches, text_col):
            data, offs = utf8(rb.column(rb.schema.get_field_index(text_col)))
            size = np.diff(offs)
            copied = rb.column(rb.schema.get_field_index("n")).to_numpy() > 1
            gone = _removed(len(data), offs, rb.column(rb.schema.get_field_index("_spans")),
                            copied & (size >= window))
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(gone, out=total[1:])
            left = offs - total[offs]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = offs[:-1][size > 0]
            begins[heads] = gone[heads]
            runs = np.zeros(len(data) + 1, np.int64)
            np.cumsum(begins, out=runs[1:])
            kept = pa.Array.from_buffers(pa.binary(), len(size), [
                None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(data[~gone].tobytes())])
            out = {c: rb.column(rb.schema.get_field_index(c)) for c in columns}
            yield pa.RecordBatch.from_pydict(out | {
                "kept": kept, "n_bytes": pa.array(size.astype(np.int64)),
                "n_removed": pa.array(np.diff(total[offs])), "n_spans": pa.array(np.diff(runs[offs]))})

    return joined.mapInArrow(cut, as_struct_type(shape, ("kept", BinaryType()), ("n_bytes", LongType()),
                                                 ("n_removed", LongType()), ("n_spans", LongType())))
