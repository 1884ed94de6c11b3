"""Phrase collocation mining (operator 12).

Counts of all frequent phrases come from suffix trees built in parts, as ERA
builds them.  Every place where a phrase can begin is a suffix, cut off after
four words.  *Vertical partitioning*: suffixes are dealt out by the prefix of
two words they begin with; prefixes are put together into groups whose suffixes
fit a memory budget, and a prefix too large for it is extended by another word.
Each group's subtree is then built on its own, by sorting its suffixes; the
count of a node (a phrase) is the total of the leaves below it.  Nodes above an
extended prefix lie in several groups, and their counts are added up.

A word is told apart by a code of five to eight bytes, that of its language
included; the codes are checked against the vocabulary, so that no frequent
word shares its code (else wider codes, and then other hashes, are taken).
Suffixes end before an infrequent word, since no phrase with it can count.

Cases: a null or empty text has no words.  A null language is ``und``.  Repeated
rows count as often as they stand.  Phrases never cross a piece or a text.
Other columns are not used, so none can clash.  Ties are ranked by the
phrase's bytes.  An empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, mixed, range_hashes, runs, same_bytes, staged, utf8

#: Characters that end a piece, and those between words.
PIECE_ENDS, GAPS = b".,;:!?\n\v\f\r", b" \t"
LONGEST = 4
#: Suffixes that one subtree's task may hold, and bytes of text that one numpy step handles.
BUDGET, STEP_BYTES = 1 << 20, 3 << 20
#: Bits of the filter that knows the frequent words; a collision only lets a suffix run on.
FILTER_BITS = 1 << 23
#: Slots of prefixes for each group, at least; a group takes whole slots.
SLOTS_PER_GROUP = 16
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS, _INSIDE = np.zeros(256, bool), np.ones(256, bool)
_ENDS[list(PIECE_ENDS)] = True
_INSIDE[list(PIECE_ENDS + GAPS)] = False


class _Words:
    """Words of a block of texts: byte ranges, rows, codes, and which go on in the same piece."""

    def __init__(self, rb: pa.RecordBatch, seed: int):
        data, offs = utf8(rb.column(1))
        self.data = _LOWER[data]
        self.starts, self.ends, self.row = runs(_INSIDE[self.data], offs)
        piece = np.searchsorted(np.flatnonzero(_ENDS[self.data]), self.starts)
        n = len(self.starts)
        self.goes_on = np.zeros(n + LONGEST, bool)  # word i + 1 stands in the piece of word i
        self.goes_on[:max(0, n - 1)] = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        langs, at = utf8(rb.column(0))
        lang = range_hashes(langs, at[:-1], at[1:], seed + 1)
        self.codes = np.zeros(n + LONGEST, np.uint64)
        self.codes[:n] = np.maximum(mixed(range_hashes(self.data, self.starts, self.ends, seed) ^ lang[self.row]), 1)


def _slots(codes: list[np.ndarray], n_slots: int) -> np.ndarray:
    h = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        h = mixed(h ^ c) + np.uint64(1)
    return (mixed(h) & np.uint64(n_slots - 1)).astype(np.int64)


def _substrings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offs[1:])
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], ends - starts)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offs), pa.py_buffer(data[at])).cast(pa.string())


def _counted(texts: DataFrame, seed: int, n_slots: int) -> DataFrame:
    """``(kind, lang, word, code, n)``: kind 1 counts words, kinds 2 and 3 (``code`` is a slot) the suffixes
    that begin with the prefixes of two and of three words in a slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in blocks(batches, "text", STEP_BYTES):
            w = _Words(rb, seed)
            n = len(w.starts)
            order = np.argsort(w.codes[:n])
            codes, starts, size = w.codes[order], w.starts[order], (w.ends - w.starts)[order]
            new = np.ones(n, bool)  # equal codes of different words, which the check then finds, stay apart
            lang = rb.column(0).dictionary_encode().indices.to_numpy()[w.row[order]]
            new[1:] = (codes[1:] != codes[:-1]) | (size[1:] != size[:-1]) | (lang[1:] != lang[:-1])
            same = np.flatnonzero(~new)
            new[same] = ~same_bytes(w.data, starts[same], starts[same - 1], size[same])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, n))
            begin = np.flatnonzero(w.goes_on[:n])
            first, second = w.codes[begin], w.codes[begin + 1]
            third = np.where(w.goes_on[begin + 1], w.codes[begin + 2], 0)
            kinds, keys, counts = [np.ones(len(at), np.int32)], [codes[at].view(np.int64)], [times]
            for kind, prefix in ((2, [first, second]), (3, [first, second, third])):
                load = np.bincount(_slots(prefix, n_slots), minlength=n_slots)
                slot = np.flatnonzero(load)
                kinds.append(np.full(len(slot), kind, np.int32))
                keys.append(slot)
                counts.append(load[slot])
            none = len(kinds[1]) + len(kinds[2])
            word = _substrings(w.data, starts[at], starts[at] + size[at])
            lang = rb.column(0).take(pa.array(w.row[order][at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(kinds)), pa.concat_arrays([lang, pa.nulls(none, pa.string())]),
                 pa.concat_arrays([word, pa.nulls(none, pa.string())]), pa.array(np.concatenate(keys)),
                 pa.array(np.concatenate(counts).astype(np.int64))], ["kind", "lang", "word", "code", "n"])

    rows = texts.mapInArrow(count, "kind int, lang string, word string, code long, n long")
    return rows.groupBy("kind", "lang", "word", "code").agg(F.sum("n").alias("n"))


class _Plan:
    """Which group takes a suffix: by its prefix of two words, of three, or by all of it."""

    def __init__(self, loads: dict[int, np.ndarray], budget: int):
        """``loads``: suffixes in each slot of two-word (2) and three-word (3) prefixes."""
        self.n_groups = 0
        self.first = {2: self._packed(loads[2], budget)}
        self.parts = None
        if (self.first[2] < 0).any():
            self.first[3] = self._packed(loads[3], budget)
            large = np.flatnonzero(self.first[3] < 0)  # such prefixes' suffixes differ in one word only
            self.parts = np.ones(len(loads[3]), np.int64)
            self.parts[large] = -(-loads[3][large] // budget)
            self.first[3][large] = self.n_groups + np.cumsum(self.parts[large]) - self.parts[large]
            self.n_groups += int(self.parts[large].sum())

    def _packed(self, load: np.ndarray, budget: int) -> np.ndarray:
        """The group of each slot: slots in a row share one up to the budget; -1 for a slot above it."""
        out = np.full(len(load), -1, np.int64)
        used = budget
        for slot in np.flatnonzero(load <= budget).tolist():
            if used + load[slot] > budget:
                used = 0
                self.n_groups += 1
            used += int(load[slot])
            out[slot] = self.n_groups - 1
        return out

    def groups(self, c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The group of each suffix, and the words of the prefix it was chosen by."""
        n_slots = len(self.first[2])
        group = self.first[2][_slots(c[:2], n_slots)]
        depth = np.full(len(group), 2, np.int32)
        long = np.flatnonzero(group < 0)
        if len(long):
            part = [x[long] for x in c]
            slot = _slots(part[:3], n_slots)
            group[long] = self.first[3][slot] + _slots(part, 1 << 40) % self.parts[slot]
            depth[long] = np.where(self.parts[slot] > 1, 4, 3)
        return group, depth


def _narrow(codes: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widened(parts: pa.ChunkedArray, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts.to_pylist()), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _sorted_counts(c: list[np.ndarray], n: np.ndarray, *before: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Equal suffixes put together in order: their codes, counts and places of the first ones."""
    order = np.lexsort((*c[::-1], *before))
    c = [x[order] for x in c]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in c])
    at = np.flatnonzero(new)
    return [x[at] for x in c], np.add.reduceat(n[order], at) if len(at) else n[:0], order[at]


def _suffixes(texts: DataFrame, seed: int, frequent: np.ndarray, plan: _Plan, width: int) -> DataFrame:
    """``(group, depth, c1 ... c4, n)``: a row holds a step's suffixes of a group, sorted and counted."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << 8 * width) - 1)
        for rb in blocks(batches, "text", STEP_BYTES):
            w = _Words(rb, seed)
            at = w.codes & np.uint64(FILTER_BITS - 1)
            known = ((frequent[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
            known[len(w.starts):] = False
            follows = w.goes_on.copy()  # both words are frequent, too
            follows[:-1] &= known[:-1] & known[1:]
            begin = np.flatnonzero(follows)
            c, on = [w.codes[begin]], np.ones(len(begin), bool)
            for k in range(1, LONGEST):
                on &= follows[begin + k - 1]
                c.append(np.where(on, w.codes[begin + k], np.uint64(0)))
            del w
            group, depth = plan.groups(c)
            c, n, first = _sorted_counts(c, np.ones(len(begin), np.int64), group)
            group, depth = group[first], depth[first]
            cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)).tolist()
            spans = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[cuts[:-1]]), pa.array(depth[cuts[:-1]]),
                 *[pa.array([_narrow(x[a:b] & mask, width) for a, b in spans], pa.binary()) for x in c],
                 pa.array([n[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary())],
                ["group", "depth", "c1", "c2", "c3", "c4", "n"])

    return texts.mapInArrow(deal, "group long, depth int, c1 binary, c2 binary, c3 binary, c4 binary, n binary")


def _subtrees(dealt: DataFrame, width: int, min_count: int) -> DataFrame:
    """``(c1 ... c4, n)``: nodes of two words and more; those above a group's prefixes are part counts."""

    def build(table: pa.Table) -> pa.Table:
        depth = table.column("depth")[0].as_py()
        c, n, _ = _sorted_counts([_widened(table.column(f"c{k}"), width) for k in range(1, LONGEST + 1)],
                                 np.frombuffer(b"".join(table.column("n").to_pylist()), "<u4").astype(np.int64))
        out: list[list[np.ndarray]] = [[] for _ in range(LONGEST + 1)]
        new = np.zeros(len(n), bool)
        new[:1] = True
        for k in range(LONGEST):
            new[1:] |= c[k][1:] != c[k][:-1]
            at = np.flatnonzero(new)
            if k == 0:
                continue
            total = np.add.reduceat(n, at)
            keep = (c[k][at] != 0) & ((total >= min_count) | (k + 1 < depth))
            for j in range(LONGEST):
                out[j].append((c[j][at] if j <= k else np.zeros(len(at), np.uint64))[keep].view(np.int64))
            out[LONGEST].append(total[keep])
        return pa.table({name: np.concatenate(x) for name, x in zip(["c1", "c2", "c3", "c4", "n"], out)})

    return dealt.groupBy("group").applyInArrow(build, "c1 long, c2 long, c3 long, c4 long, n long")


def _narrow_code(width: int) -> Column:
    return F.col("code").bitwiseAND(F.lit((1 << 8 * width) - 1 if width < 8 else -1))


def _told_apart(words: DataFrame, width: int, min_count: int) -> bool:
    """Whether no frequent word shares its code of so many bytes with any other word, or has that of no word."""
    shared = (words.groupBy(_narrow_code(width).alias("code")).agg(F.count("*").alias("words"), F.max("n").alias("n"))
              .filter(((F.col("words") > 1) | (F.col("code") == 0)) & (F.col("n") >= min_count)))
    return shared.isEmpty()


def _frequent_filter(frequent: DataFrame) -> np.ndarray:
    """One bit for each frequent word; at most ``FILTER_BITS / 64`` rows reach the driver."""
    at = F.col("code").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = (frequent.groupBy(F.shiftright(at, 6).alias("at"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast((code & {FILTER_BITS - 1}) & 63 as int))")).alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for at, bits in rows:
        out[at] = bits & 0xFFFFFFFFFFFFFFFF
    return out


def phrase_counts(docs: DataFrame, min_count: int = 30, text_col: str = "text", lang_col: str = "lang",
                  budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """``(lang, words, f)`` of the phrases of one to four words that occur ``min_count`` times or more,
    and ``(lang, n)``, the number of words of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The driver keeps a few numbers for each group, which is a task of its own.
    n_slots = 1 << max(10, math.ceil(math.log2(SLOTS_PER_GROUP * (n_bytes / 4 / budget + 1))))
    width = 0
    for seed in range(100):
        counted = staged(_counted(texts, seed, n_slots), "phrase-words")
        words = counted.filter("kind = 1")
        frequent = words.filter(F.col("n") >= min_count)
        sizes = words.agg(F.count("*"), F.count_if(F.col("n") >= min_count)).first()
        likely = max(1, sizes[0] * sizes[1]) / 0.01  # pairs of words that must not share a code
        width = max(5, math.ceil(math.log2(likely) / 8))
        while width <= 8 and not _told_apart(words, width, min_count):
            width += 1
        if width <= 8:
            break
    loads = {kind: np.zeros(n_slots, np.int64) for kind in (2, 3)}
    for kind, slot, n in counted.filter("kind > 1").select("kind", "code", "n").collect():  # at most 2 * n_slots
        loads[kind][slot] = n
    plan = _Plan(loads, budget)
    dealt = _suffixes(texts, seed, _frequent_filter(frequent), plan, width)
    codes = [f"c{k}" for k in range(1, LONGEST + 1)]
    nodes = (_subtrees(dealt, width, min_count).groupBy(*codes).agg(F.sum("n").alias("f"))
             .filter(F.col("f") >= min_count))
    nodes = staged(nodes, "phrase-nodes")
    known = frequent.select(_narrow_code(width).alias("code"), "lang", "word")
    spelled = (nodes.select("*", F.posexplode(F.array(*codes)).alias("at", "code")).filter("code <> 0")
               .join(known, "code").groupBy(*codes, "f")
               .agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words")))
    # A filter's collision can let an infrequent word into a suffix: such a node finds no word there.
    whole = F.size("words") == sum((F.col(c) != 0).cast("int") for c in codes)
    found = (spelled.filter(whole).select("lang", F.transform("words", lambda x: x["word"]).alias("words"), "f")
             .unionByName(frequent.select("lang", F.array("word").alias("words"), F.col("n").alias("f"))))
    return staged(found, "phrases"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, scale: int = 2_000_000,
                 covered_percent: int = 80, text_col: str = "text", lang_col: str = "lang",
                 budget: int = BUDGET) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best ``top`` phrases of two to four words of each language.

    A phrase cut in two parts that occur ``l`` and ``r`` times scores
    ``floor(scale * a / (l + r))``; its worst cut counts (the first of equal
    ones).  A phrase inside a longer one with ``covered_percent`` of its count is dropped.
    """
    found, totals = phrase_counts(docs, min_count, text_col, lang_col, budget)
    joined = lambda w: F.array_join(w, " ")
    found = found.select("lang", "words", joined(F.col("words")).alias("phrase"), "f")
    long = found.filter(F.size("words") > 1)
    exact = lambda c: F.col(c).cast("decimal(20,0)")

    cuts = (long.select("lang", "words", "phrase", F.col("f").alias("a"),
                        F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
            .withColumn("left", joined(F.slice("words", 1, F.col("k"))))
            .withColumn("right", joined(F.slice("words", F.col("k") + 1, F.size("words")))))
    left = found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    scored = scored.withColumn("scaled", (exact("a") * F.lit(scale)).cast("decimal(38,0)")).withColumn(
        "parts", (exact("l") + exact("r")).cast("decimal(38,0)"))
    worst = (scored.groupBy("lang", "phrase", "a")
             .agg(F.min(F.struct(F.expr("scaled div parts").alias("score"), "k", "l", "r")).alias("cut")))

    inside = (found.filter(F.size("words") > 2)
              .select("lang", "words", "f", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("k"))
              .select("lang", "words", "f", "k", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)).alias("at"))
              .groupBy("lang", joined(F.slice("words", F.col("at"), F.col("k"))).alias("phrase"))
              .agg(F.max("f").alias("longer")))
    covered = exact("longer") * 100 >= exact("a") * covered_percent
    kept = (worst.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~covered)
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                              "n", "score")
