"""Fill-in-middle transformation (operator 11).

A text is cut at two of its line ends into prefix, middle and suffix, which are
put in another order behind marks.  The places where texts may be cut form one
boundary set for a block of texts, kept as in Roaring bitmaps: offsets share a
container by their high bits, and a container holds its low 16 bits as a sorted
array, a bitmap or runs, whichever is smallest.  With the containers' cumulative
cardinalities, the k-th line end of a text is found by a search for its
container and a select inside it; both cuts of a text are two such selects.

Cases: a null or empty text has no lines and stays plain (and empty).  A text
that holds one of the marks stays plain, as it could not be taken apart again.
A null id counts as an empty one for the draw.  Repeated rows are cut alike.
Columns of ``docs`` that carry an output's name are replaced, and names that
start with ``_fim_`` are reserved.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .common import as_struct_type, blocks, utf8, without

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Low bits of an offset that a container holds.
LOW = 16
#: Values up to which an array is smaller than a bitmap.
ARRAY_MOST = 4096


class _Array:
    def __init__(self, low: np.ndarray):
        self.low = low

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.low[k].astype(np.int64)

    def rank(self, low: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, low)


class _Bitmap:
    """65,536 bits; the counts before each word of 64 lead a select to its word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << LOW, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, k, side="right") - 1
        left, bits, at = k - self.before[word], self.words[word], word * 64
        for half in (32, 16, 8, 4, 2, 1):  # into the half of the word that holds the bit
            lower = bits & np.uint64((1 << half) - 1)
            n = np.bitwise_count(lower).astype(np.int64)
            up = left >= n
            left, at = np.where(up, left - n, left), np.where(up, at + half, at)
            bits = np.where(up, bits >> np.uint64(half), lower)
        return at

    def rank(self, low: np.ndarray) -> np.ndarray:
        word, bit = low >> 6, (low & 63).astype(np.uint64)
        under = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(under)


class _Runs:
    """First values of runs of consecutive values, and the counts before each."""

    def __init__(self, low: np.ndarray):
        at = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
        self.first = low[at].astype(np.int64)
        self.before = np.append(at, len(low))

    def select(self, k: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, k, side="right") - 1
        return self.first[run] + k - self.before[run]

    def rank(self, low: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.first, low, side="right") - 1
        inside = np.where(run < 0, 0, self.before[run] + low - self.first[run])
        return np.where(run < 0, 0, np.minimum(inside, self.before[run + 1]))


class BoundarySet:
    """A set of offsets with ``rank`` (members below an offset) and ``select`` (the k-th member)."""

    def __init__(self, offsets: np.ndarray):
        """``offsets`` are ascending and distinct."""
        high = offsets >> LOW
        cuts = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[cuts]
        self.before = np.append(cuts, len(offsets))
        self.containers = [self._container((offsets[a:b] & ((1 << LOW) - 1)).astype(np.uint16))
                           for a, b in zip(self.before, self.before[1:])]

    @staticmethod
    def _container(low: np.ndarray) -> _Array | _Bitmap | _Runs:
        n_runs = 1 + int(np.count_nonzero(np.diff(low.astype(np.int64)) != 1))
        if 4 * n_runs < min(2 * len(low), 1 << (LOW - 3)):  # bytes of each form
            return _Runs(low)
        return _Array(low) if len(low) <= ARRAY_MOST else _Bitmap(low)

    def _each(self, where: np.ndarray, values: np.ndarray, ask: str) -> np.ndarray:
        out = np.empty(len(values), np.int64)
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            at = order[a:b]
            out[at] = getattr(self.containers[where[at[0]]], ask)(values[at])
        return out

    def select(self, k: np.ndarray) -> np.ndarray:
        box = np.searchsorted(self.before, k, side="right") - 1
        return (self.keys[box] << LOW) + self._each(box, k - self.before[box], "select")

    def rank(self, offsets: np.ndarray) -> np.ndarray:
        box = np.searchsorted(self.keys, offsets >> LOW)
        out = self.before[box].astype(np.int64)
        inside = np.flatnonzero((box < len(self.keys)) & (self.keys[np.minimum(box, len(self.keys) - 1)]
                                                          == offsets >> LOW))
        out[inside] += self._each(box[inside], (offsets[inside] & ((1 << LOW) - 1)), "rank")
        return out


def _marked(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that hold one of the marks."""
    if len(data) < 3:
        return np.zeros(len(offs) - 1, bool)
    names = np.frombuffer(bytes(m[1] for m in (PREFIX, SUFFIX, MIDDLE)), np.uint8)
    at = np.flatnonzero((data[:-2] == 60) & (data[2:] == 62))
    at = at[np.isin(data[at + 1], names)]
    row = np.searchsorted(offs[1:], at, side="right")
    out = np.zeros(len(offs) - 1, bool)
    out[row[at + 3 <= offs[row + 1]]] = True
    return out


def _cut(data: np.ndarray, offs: np.ndarray, draws: list[np.ndarray], rate: int, spm_rate: int) -> list[pa.Array]:
    """``n``, form, characters of prefix and middle, and the output of each text of a block."""
    ends = np.flatnonzero(data == 10) + 1
    places = BoundarySet(np.union1d(ends, offs))
    first = places.rank(offs)
    n = np.diff(first)
    a, b, rolled, order = draws
    one, two = a % (n + 1), b % (n + 1)
    plain = (np.diff(offs) == 0) | _marked(data, offs) | (rolled % 100 >= rate)
    low = places.select(first[:-1] + np.minimum(one, two))
    high = places.select(first[:-1] + np.maximum(one, two))
    spm = order % 100 < spm_rate
    text = data.tobytes()
    follows = (data & 0xC0) == 0x80  # bytes that go on a code point
    forms, prefixes, middles, outputs = [], [], [], []
    for i in range(len(n)):
        s, p, m, e = offs[i], low[i], high[i], offs[i + 1]
        if plain[i]:
            forms.append("plain")
            prefixes.append(None)
            middles.append(None)
            outputs.append(text[s:e])
            continue
        forms.append("spm" if spm[i] else "psm")
        prefixes.append(int(p - s - np.count_nonzero(follows[s:p])))
        middles.append(int(m - p - np.count_nonzero(follows[p:m])))
        parts = (SUFFIX, text[m:e], PREFIX, text[s:p]) if spm[i] else (PREFIX, text[s:p], SUFFIX, text[m:e])
        outputs.append(b"".join((*parts, MIDDLE, text[p:m])))
    return [pa.array(n.astype(np.int64)), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
            pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]


OUTPUTS = [("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()),
           ("output", StringType())]


def fill_in_middle(docs: DataFrame, seed: str = "7", rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``docs`` without the text but with ``n, form, prefix_chars, middle_chars, output``.

    ``rate`` per cent of the texts are transformed, ``spm_rate`` per cent of
    those with the suffix first.  All draws of a text come from the SHA-256 of
    the seed and its id, so reruns and lost tasks give the same result.
    """
    docs = without(docs, [name for name, _ in OUTPUTS])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    names = [f"_fim_{i}" for i in range(4)]
    drawn = docs.withColumns({name: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
                              for i, name in enumerate(names)})
    shape = docs.drop(text_col)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in blocks(batches, text_col):
            draws = [rb.column(rb.schema.get_field_index(x)).to_numpy() for x in names]
            data, offs = utf8(rb.column(rb.schema.get_field_index(text_col)))
            made = _cut(data, offs, draws, rate, spm_rate)
            rb = rb.drop_columns([text_col, *names])
            for (name, _), column in zip(OUTPUTS, made):
                rb = rb.append_column(name, column)
            yield rb

    return drawn.mapInArrow(transform, as_struct_type(shape, *OUTPUTS))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of this form was made from.

    A transformed text holds no mark of its own, and no two marks can overlap,
    so the first mark of each kind is the one that was put there.
    """
    first, second = F.col(output), {}
    for kind, mark in (("psm", SUFFIX), ("spm", PREFIX)):
        inside = F.substr(first, F.lit(4))
        head = F.substring_index(inside, mark.decode(), 1)
        rest = F.substr(inside, F.char_length(head) + 4)
        then = F.substring_index(rest, MIDDLE.decode(), 1)
        last = F.substr(rest, F.char_length(then) + 4)
        second[kind] = F.concat(head, last, then) if kind == "psm" else F.concat(then, last, head)
    return (F.when(F.col(form) == "psm", second["psm"]).when(F.col(form) == "spm", second["spm"])
            .otherwise(F.col(output)))
