"""Small helpers that several training-data operators share.

Text is handled as UTF-8 bytes in numpy arrays, a block of documents at a
time: words, lines and shingles are byte ranges, and the hash of a range comes
from prefix sums, so no per-word Python object is made.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir

#: Bytes of text that one numpy step handles; a longer document is a step of its own.
BLOCK_BYTES = 1 << 20

#: Separators of words: space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns whose names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def reserved(df: DataFrame, prefix: str) -> DataFrame:
    """``df``, refused if a column's name starts with the prefix that an operator keeps for its own columns."""
    taken = [c for c in df.columns if c.lower().startswith(prefix)]
    if taken:
        raise ValueError(f"column names that start with {prefix} are reserved: {taken}")
    return df


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back.

    Cuts the lineage with files every executor can read, and lets later steps
    share one computation.  The schema is passed on, so reading back needs no
    inference job and an empty result stays readable.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/pinax-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[str] = []


def staged_paths() -> list[str]:
    """Tables that this session has staged, oldest first."""
    return list(_STAGED)


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Remove staged tables that no later read needs."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
        _STAGED.remove(path)


def as_struct_type(df: DataFrame, *extra: tuple[str, object]) -> StructType:
    out = StructType(list(df.schema.fields))
    for name, kind in extra:
        out = out.add(name, kind)
    return out


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES
           ) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose ``column`` holds about ``limit`` bytes."""
    for rb in batches:
        if rb.num_rows == 0:
            continue
        col = rb.column(rb.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), rb.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield rb.slice(a, b - a)
    release_spare()


def release_spare() -> None:
    """Give memory that is no longer used back to the system.

    Spark keeps a task's Python worker for later tasks; what it holds meanwhile
    counts against its executor.  Allocators keep freed memory until asked.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of most Linux systems has it
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows in one array, and the rows' offsets in it (null: empty)."""
    a = column
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    empty = b"" if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else ""
    a = pc.fill_null(a, empty).cast(pa.large_binary())
    _, off, data = a.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[a.offset:a.offset + len(a) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that cross no row: their starts, ends and rows."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offs[:-1][(offs[:-1] < n)]
    first[edges] = inside[edges]
    before = offs[1:][offs[1:] > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs[1:], starts, side="right")


def is_separator(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words (``WORD``) of each row, and the row of each."""
    return runs(~is_separator(data), offs)


#: Fixed odd multiplier of the polynomial hashes, and the random value of each byte.
BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.Generator(np.random.PCG64(20240501))
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit values that spreads them evenly (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PrefixHash:
    """Polynomial hashes of any ranges of a sequence, from prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n)[:n], dtype=np.uint64, out=self.prefix[1:])
        self.inverse = powers(pow(BASE, -1, 1 << 64), n)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mixed(x + (ends - starts).astype(np.uint64))


#: Masks of the last bytes of a range, by the number of bytes in it.
_LANE_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes up to which a range is hashed eight bytes at a time; longer ones are digested.
LONG_RANGE = 512


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each byte, as one number."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges.

    Eight bytes at a time are mixed in by a bijection, so no regular pattern
    cancels out; ranges of over ``LONG_RANGE`` bytes take a keyed BLAKE2 digest.
    """
    size = ends - starts
    h = mixed(size.astype(np.uint64) + np.uint64((seed * BASE) % (1 << 64)))
    lanes, live, at = _lanes(data), np.flatnonzero((size > 0) & (size <= LONG_RANGE)), 0
    while len(live):
        left = size[live] - at
        h[live] = mixed(h[live] ^ (lanes[starts[live] + at] & _LANE_MASKS[np.minimum(left, 8)]))
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_RANGE):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        h[i] = int.from_bytes(digest.digest(), "little")
    return h


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each pair of ranges that start at ``a`` and ``b``, whether their ``size`` bytes are equal."""
    same = np.ones(len(a), bool)
    lanes, live, at = _lanes(data), np.flatnonzero((size > 0) & (size <= LONG_RANGE)), 0
    while len(live):
        left = size[live] - at
        differ = (lanes[a[live] + at] ^ lanes[b[live] + at]) & _LANE_MASKS[np.minimum(left, 8)]
        same[live[differ != 0]] = False
        at += 8
        live = live[(differ == 0) & (left > 8)]
    for i in np.flatnonzero(size > LONG_RANGE):
        same[i] = np.array_equal(data[a[i]:a[i] + size[i]], data[b[i]:b[i] + size[i]])
    return same


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number from 0 for each byte range; equal ranges, and only those, have the same.

    Ranges are brought together by their hashes and then compared; should
    different ranges share a hash, others are taken.
    """
    size, seed = ends - starts, 0
    while True:
        h = range_hashes(data, starts, ends, seed)
        order = np.argsort(h)
        at = np.flatnonzero(h[order][1:] == h[order][:-1])
        one, two = order[at], order[at + 1]
        if (size[one] == size[two]).all() and same_bytes(data, starts[one], starts[two], size[one]).all():
            break
        seed += 1
    new = np.ones(len(order), np.int64)
    new[at + 1] = 0
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def repeated(rows: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, whether its (row, keys) occurs more than once, and whether
    it has occurred at an earlier place."""
    n = len(rows)
    order = np.lexsort((*keys, rows))
    same = np.zeros(n + 1, bool)
    same[1:n] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (rows, *keys)])
    many, again = np.empty(n, bool), np.empty(n, bool)
    many[order] = same[:n] | same[1:]
    again[order] = same[:n]
    return many, again


def packed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of numbers from 0 as fewer columns with the same equalities: several in one where 63 bits hold them."""
    out: list[np.ndarray] = []
    room = 0
    for c in columns:
        bits = max(1, int(c.max(initial=0)).bit_length())
        if bits <= room:
            out[-1] = (out[-1] << bits) | c
            room -= bits
        else:
            out.append(c.copy())
            room = 63 - bits
    return out


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64)
