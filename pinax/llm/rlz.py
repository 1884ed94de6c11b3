"""Substring removal by relative Lempel-Ziv factors (operator 7).

The reference is the corpus itself, indexed in blocks: a block holds the
passages around the anchors (``anchors.py``) whose grams are dealt to it.  The
place where a window of a document can be found again is fixed by its anchor,
so the blocks of a document's shared anchors are every block in which it has a
match.  A block's index holds the suffixes of its passages in order, with the
number of words that neighbours share.  Each passage is factored greedily against
the documents that come before it: a factor is the longest sequence that one of
them has, and the next factor begins at its end.  Factors of at least ``window``
words are duplicate spans.  A window that crosses from one factor into the next
may still occur as a whole elsewhere, so the windows at factor boundaries are
looked up in the index on their own.

Cases: a null or empty text has no words and stays as it is.  Copies of a text
lose all words that lie in a window, but for those with the smallest id.  Rows with
the same id do not remove each other's words.  A null id comes after all others.
Input columns that carry an output's name, or one used on the way (``first_id``,
``n``, ``_r1`` and the like), are left out; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from . import anchors
from .common import as_struct_type, blocks, numbered, staged, utf8, without, words

WINDOW, GRAM = 13, 6
#: Texts of one gram that are factored in one block; with more, windows are grouped by Spark.
CROWD = 1 << 17

LAST = anchors.LAST


def _ids(column) -> np.ndarray:
    return column.fill_null(LAST).to_numpy()


def _passages(t: pa.Table) -> tuple:
    """Words of the passages in ``t``, their passage, where each passage's words begin and
    end, and the number in its text of a passage's first word."""
    data, offs = utf8(t.column("around"))
    starts, ends, record = words(data, offs)
    first = np.searchsorted(record, np.arange(t.num_rows), side="left")
    upto = np.searchsorted(record, np.arange(t.num_rows), side="right")
    unit = (pc.list_element(t.column("units"), 0) if "units" in t.column_names else t.column("unit")).to_numpy()
    return data, starts, ends, record, first, upto, unit - t.column("back").to_numpy()


class PassageIndex:
    """The suffixes of a block's passages in order, and the words each shares with the one before it."""

    def __init__(self, word: np.ndarray, left: np.ndarray):
        """``word``: numbers of the passages' words; ``left``: words from each to its passage's end."""
        n, self.left, ranks = len(word), left, [word]
        while 1 << (len(ranks) - 1) < left.max(initial=0):  # ranks by 1, 2, 4, ... words
            k, rank = 1 << (len(ranks) - 1), ranks[-1]
            then = np.zeros(n, np.int64)
            more = np.flatnonzero(left > k)
            then[more] = rank[more + k] + 1
            pair = rank * (int(then.max(initial=0)) + 1) + then
            order = np.argsort(pair)
            new = np.zeros(n, np.int64)
            new[1:] = pair[order][1:] != pair[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            ranks.append(rank)
        self.order = np.argsort(ranks[-1], kind="stable")
        a, b = self.order[:-1], self.order[1:]
        shared = np.zeros(len(a), np.int64)
        for j in reversed(range(len(ranks))):
            inside = np.flatnonzero((shared < left[a]) & (shared < left[b]))
            same = inside[ranks[j][a[inside] + shared[inside]] == ranks[j][b[inside] + shared[inside]]]
            shared[same] += 1 << j
        self.shared = np.minimum(shared, np.minimum(left[a], left[b]))

    def longest_before(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the longest sequence from it that a smaller id has, and the smallest such id."""
        of, left = ids[self.order], self.left[self.order]
        length, source = np.zeros(len(of), np.int64), of.copy()
        for size in range(1, int(left.max(initial=0)) + 1):
            new = np.concatenate([[True], self.shared < size])  # runs of suffixes that share so many words
            least = np.minimum.reduceat(of, np.flatnonzero(new))[np.cumsum(new) - 1]
            earlier = np.flatnonzero((least < of) & (left >= size))
            if not len(earlier):
                break
            length[earlier] = size
            source[earlier] = least[earlier]
        out = np.empty((2, len(of)), np.int64)
        out[:, self.order] = length, source
        return out[0], out[1]


def parsed(longest: np.ndarray, first: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the factors of each passage: greedily from its first word, a word
    that nobody has before being a factor of its own.  All passages go on at the same time."""
    at, end, starts, ends = first[first < upto], upto[first < upto], [], []
    while len(at):
        then = at + np.maximum(1, longest[at])
        starts.append(at)
        ends.append(then)
        at, end = then[then < end], end[then < end]
    none = np.zeros(0, np.int64)
    starts, ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
    order = np.argsort(starts)
    return starts[order], ends[order]


def _factors(t: pa.Table, window: int) -> pa.Table:
    """Duplicate spans of the passages of whole groups against those of smaller ids."""
    data, starts, ends, record, first, upto, place = _passages(t)
    ids = _ids(t.column("first_id"))
    index = PassageIndex(numbered(data, starts, ends), upto[record] - np.arange(len(record)))
    longest, source = index.longest_before(ids[record])
    begin, end = parsed(longest, first, upto)
    here = np.arange(len(record))
    # Windows that end beyond the factor they begin in, looked up as wholes.
    crosses = here + window > np.repeat(end, end - begin)
    spans = np.concatenate([begin[longest[begin] >= window], here[crosses & (longest >= window)]])
    rec = record[spans]
    start = place[rec] + spans - first[rec]
    no, start, end, by = anchors.at_all_units(t, rec, start, start + longest[spans], source[spans])
    return pa.table({"_no": no, "start": start.astype(np.int32), "end": end.astype(np.int32), "source_id": by})


SPAN = "_no long, start int, end int, source_id long"


def _crowded(shown: DataFrame, window: int) -> DataFrame:
    """Spans of passages whose gram is in very many texts: each window is a row,
    and the smallest id of equal windows is an aggregate with map-side sums."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in blocks(batches, "around"):
            t = pa.Table.from_batches([rb])
            data, starts, ends, record, first, upto, place = _passages(t)
            at = np.flatnonzero(np.arange(len(record)) + window <= upto[record])
            start = place[record[at]] + at - first[record[at]]
            buf = data.tobytes()
            keys = [xxhash.xxh3_128_digest(b" ".join(buf[a:b].split())) for a, b in
                    zip(starts[at].tolist(), ends[at + window - 1].tolist())]
            pick = pa.array(record[at])
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys, pa.binary()), "_no": rb.column("_no").take(pick), "id": pa.array(_ids(t.column("first_id"))[record[at]]),
                "start": pa.array(start.astype(np.int32))})

    single = shown.select("_no", "first_id", F.explode("units").alias("unit"), "back", "around")
    rows = single.mapInArrow(
        spread, "key binary, _no long, id long, start int").distinct()
    least = rows.groupBy("key").agg(F.min("id").alias("source_id"))
    return (rows.join(least, "key").filter(F.col("id") > F.col("source_id"))
            .select("_no", "start", (F.col("start") + window).alias("end"), "source_id"))


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
            crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """``(spans, copies)`` of the texts: words ``start`` to ``end`` of text ``_no`` occur in
    ``source_id`` before.  ``copies`` names the texts (``anchors.copies_of``)."""
    texts = anchors.named(docs.select(F.col(id_col).cast("long").alias("_id"), text_col), text_col)
    copies = anchors.copies_of(texts, "_id")
    shared = anchors.shared_anchors(texts, text_col, anchors.word_units, window, gram, within=False)
    shown, any_crowd = anchors.located(texts, copies, shared, text_col, anchors.word_units, window, gram,
                                       crowd, ordered=True)
    cols = ["_h", "_no", "first_id", "units", "back", "ahead", "around", "known", "known_id"]
    if not any_crowd:
        return anchors.by_gram(shown.select(*cols), lambda t: _factors(t, window), SPAN, window), copies
    shown = staged(shown, "rlz-passages")
    few = anchors.by_gram(shown.filter(~F.col("crowded")).select(*cols), lambda t: _factors(t, window), SPAN, window)
    return few.unionByName(_crowded(shown.filter("crowded"), window)), copies


def _removed(n: int, offs: np.ndarray, spans: pa.Array, whole: np.ndarray) -> np.ndarray:
    """Which of ``n`` units lie in their row's spans, or in a row of ``whole``."""
    edge = np.zeros(n + 1, np.int64)
    if len(spans):
        flat, counts = spans.flatten(), np.diff(spans.offsets.to_numpy())
        base = offs[np.repeat(np.arange(len(counts)), counts)]
        np.add.at(edge, base + flat.field(0).to_numpy(zero_copy_only=False), 1)
        np.add.at(edge, base + flat.field(1).to_numpy(zero_copy_only=False), -1)
    return (np.cumsum(edge[:n]) > 0) | np.repeat(whole, np.diff(offs))


def marked(docs: DataFrame, spans: DataFrame, copies: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with their text's spans ``_spans``, ``first_id`` and ``n``.

    A text's spans, few for each of its windows, travel to the text, by its hashes.
    """
    of_text = spans.groupBy("_no").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    facts = (copies.join(of_text, "_no", "left").drop("_no")
             .withColumn("_spans", F.coalesce("_spans", F.array().cast("array<struct<start:int,end:int>>"))))
    return anchors.packed(anchors.named(docs, text_col), text_col).join(facts, ["_r1", "_r2"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``docs`` with ``text`` less its duplicate spans, ``n_words`` (before) and ``n_removed``.

    What is left keeps its separators; a removed run goes with those after it.
    """
    docs = without(docs, ["n_words", "n_removed", "_r1", "_r2", "first_id", "n", "_no", "_spans"])
    spans, copies = factors(docs, id_col, text_col, window, gram, crowd)
    joined = marked(docs, spans, copies, text_col)
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in anchors.unpacked(batches, text_col):
            at = rb.schema.get_field_index(text_col)
            data, offs = utf8(rb.column(at))
            starts, ends, row = words(data, offs)
            uoffs = np.searchsorted(row, np.arange(len(offs)), side="left")
            count = np.diff(uoffs)
            id_at, first_at = rb.schema.get_field_index(id_col), rb.schema.get_field_index("first_id")
            later = _ids(rb.column(id_at).cast(pa.int64())) > _ids(rb.column(first_at))
            gone = _removed(len(starts), uoffs, rb.column(rb.schema.get_field_index("_spans")),
                            later & (count >= window))
            # A removed word takes the separators up to the next word, or the text's end, along.
            until = np.empty(len(starts), np.int64)
            if len(starts):
                until[:-1] = starts[1:]
                until[uoffs[1:][count > 0] - 1] = offs[1:][count > 0]
            edge = np.zeros(len(data) + 1, np.int8)
            np.add.at(edge, starts[gone], 1)
            np.add.at(edge, until[gone], -1)
            keep = np.cumsum(edge[:len(data)], dtype=np.int32) == 0
            new = np.zeros(len(data) + 1, np.int64)
            np.cumsum(keep, out=new[1:])
            text = pa.Array.from_buffers(pa.string(), len(offs) - 1, [
                None, pa.py_buffer(new[offs].astype(np.int32).tobytes()), pa.py_buffer(data[keep].tobytes())])
            nulls = rb.column(at).is_null()
            text = pc.if_else(nulls, pa.scalar(None, pa.string()), text)
            n_removed = np.bincount(row[gone], minlength=len(offs) - 1)
            out = {c: rb.column(rb.schema.get_field_index(c)) for c in columns}
            out[text_col] = text
            yield pa.RecordBatch.from_pydict(out | {"n_words": pa.array(count.astype(np.int64)),
                                                    "n_removed": pa.array(n_removed.astype(np.int64))})

    return joined.mapInArrow(cut, as_struct_type(docs, ("n_words", LongType()), ("n_removed", LongType())))
