"""Byte-level BPE encoding and decoding (operator 1).

A long text is cut into overlapping chunks, which tasks split into pre-tokens
independently.  A chunk that starts inside a pre-token begins with wrong
boundaries, but the pattern only looks ahead, so from the first boundary that
it shares with the chunk before it the two agree.  At that place they are
stitched; the pieces between such places are encoded on their own.  Decoding
concatenates the tokens' bytes.

Cases: a null or empty text has no tokens and decodes to no bytes.  Repeated
rows, and null or repeated ids, are encoded row by row.  Input columns that
carry an output's name are replaced, and names that start with ``_bpe_`` are
reserved.  A pre-token longer than the overlap leaves no shared boundary; such
neighbours are joined and split anew together, until all neighbours share one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType
from pyspark.sql.window import Window

from .common import as_struct_type, blocks, release_spare, reserved, staged, without

#: Code points that a chunk adds to the one before, and by which it runs on.
CHUNK, OVERLAP = 1 << 15, 1 << 11
#: Bytes of text whose tokens are made in one step: lists of numbers take several times as many.
STEP_BYTES = 1 << 18
#: Tokens that one numpy step decodes; a longer row is a step of its own.
DECODED = 1 << 16
#: The pattern never looks further than this beyond the end of a match.
LOOKAHEAD = 4

def ranks(path: str) -> list[tuple[bytes, int]]:
    """Token bytes and ids of a vocabulary file (base64 bytes, blank, id)."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


def pretokens(pattern: str):
    """Function giving the pre-tokens of a text in order."""
    import regex

    return regex.compile(pattern).findall


def piece_encoder(vocabulary: list[tuple[bytes, int]], pattern: str):
    """Function giving the ids of a text that starts and ends at pre-token boundaries."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=dict(vocabulary), special_tokens={}).encode_ordinary


def _list_array(rows: list) -> pa.Array:
    """One array of all values, by rows; a row may be a list or an array."""
    offs = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offs[1:])
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int32()))


def _chunks(docs: DataFrame, text_col: str, chunk: int, overlap: int) -> DataFrame:
    """One row for each chunk of each (long) text: chunks ``_no`` up to ``_end``, ``_span`` code points
    of its own, and the text, which goes on over the next one's start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                key, text = rb.column("_bpe_row")[i].as_py(), rb.column(text_col)[i].as_py()
                for no, at in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_pydict(
                        {"_row": [key], "_no": pa.array([no], pa.int32()), "_end": pa.array([no + 1], pa.int32()),
                         "_span": pa.array([chunk], pa.int32()), "_text": [text[at:at + chunk + overlap]]})

    return docs.mapInArrow(cut, "_row string, _no int, _end int, _span int, _text string")


def _boundaries(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """Adds the pre-token boundaries near both ends: ``_head`` counts from the
    chunk's start, ``_tail`` from the next chunk's start."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = pretokens(pattern)
        for rb in batches:
            heads, tails = [], []
            for text, span in zip(rb.column("_text").to_pylist(), rb.column("_span").to_pylist()):
                at = np.cumsum([0, *map(len, find(text))])
                heads.append(at[at <= overlap])
                tails.append(at[(at >= span) & (at <= len(text) - LOOKAHEAD)] - span)
            yield rb.append_column("_head", _list_array(heads)).append_column("_tail", _list_array(tails))

    ints = ArrayType(IntegerType())
    return chunks.mapInArrow(split, as_struct_type(chunks, ("_head", ints), ("_tail", ints)))


def _links(bounds: DataFrame) -> DataFrame:
    """``(_row, _no, _sync)``: the first boundary each chunk shares with the one before it, null if none."""
    before = bounds.select("_row", F.col("_end").alias("_no"), F.col("_tail").alias("_before"))
    shared = F.array_min(F.array_intersect("_head", "_before"))
    return (bounds.join(before, ["_row", "_no"], "left")
            .select("_row", "_no", F.when(F.col("_no") == 0, F.lit(0)).otherwise(shared).alias("_sync")))


def _joined(bounds: DataFrame, links: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """The chunks, with runs of neighbours that share no boundary joined and split anew."""
    run = F.sum(F.col("_sync").isNotNull().cast("int")).over(Window.partitionBy("_row").orderBy("_no"))
    runs = links.withColumn("_run", run)
    many = (runs.groupBy("_row", "_run").agg(F.min("_no").alias("_first"), F.max("_no").alias("_last"))
            .filter(F.col("_first") < F.col("_last")))
    marked = bounds.join(runs.join(many, ["_row", "_run"]).select("_row", "_no", "_first", "_last"), ["_row", "_no"], "left")
    alone = marked.filter(F.col("_first").isNull()).select(bounds.columns)
    own = F.when(F.col("_no") == F.col("_last"), F.col("_text")).otherwise(F.substring("_text", F.lit(1), F.col("_span")))
    together = (marked.filter(F.col("_first").isNotNull()).withColumn("_own", own)
                .groupBy("_row", F.col("_first").alias("_no"))
                .agg(F.max("_end").alias("_end"), F.sum("_span").cast("int").alias("_span"),
                     F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_own"))),
                                              lambda x: x["_own"]), "").alias("_text")))
    return alone.unionByName(_boundaries(together, pattern, overlap))


def _stitched(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """Pieces ``(_row, _no, _piece)`` that tile each text at true boundaries.

    Neighbours meet by equi-joins on (text, chunk number), so no task holds all
    chunks of a text.  What a chain of shared boundaries links to the text's
    start is split rightly.  Where the chain breaks, the chunks on both sides
    become one and are split again from the start of the first; that goes on
    until no link is broken.
    """
    bounds = staged(_boundaries(chunks, pattern, overlap), "bpe-chunks")
    links = staged(_links(bounds), "bpe-links")
    while not links.filter(F.col("_sync").isNull()).isEmpty():
        bounds = staged(_joined(bounds, links, pattern, overlap), "bpe-chunks")
        links = staged(_links(bounds), "bpe-links")
    own = bounds.select("_row", "_no", "_end", "_span", "_text").join(links, ["_row", "_no"])
    after = links.select("_row", F.col("_no").alias("_end"), F.col("_sync").alias("_next"))
    # The text that a chunk adds: from its sync to the next one's.
    end = F.coalesce(F.col("_span") + F.col("_next"), F.char_length("_text"))
    return (own.join(after, ["_row", "_end"], "left")
            .select("_row", "_no", F.substring(F.col("_text"), F.col("_sync") + 1, end - F.col("_sync")).alias("_piece")))


def _encoder(vocabulary: list[tuple[bytes, int]], pattern: str, text_col: str):
    """What a task does to encode: batches with the text replaced by ``ids``."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_encoder(vocabulary, pattern)
        for rb in blocks(batches, text_col, STEP_BYTES):
            at = rb.schema.get_field_index(text_col)
            found = _list_array([encode(t or "") for t in rb.column(at).to_pylist()])
            yield rb.remove_column(at).append_column("ids", found)

    return ids


def _decoder(vocabulary: list[tuple[bytes, int]], ids_col: str):
    """What a task does to decode: batches with ``bytes`` added."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[bytes] = [b""] * (1 + max((i for _, i in vocabulary), default=0))
        for token, i in vocabulary:
            tokens[i] = token
        flat, sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
        starts = np.cumsum(sizes) - sizes
        for rb in batches:
            ids = rb.column(rb.schema.get_field_index(ids_col))
            n_ids = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            step = np.cumsum(n_ids) // DECODED
            cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), rb.num_rows] if rb.num_rows else []
            for a, b in zip(cuts, cuts[1:]):
                found = ids.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                upto = np.append(0, np.cumsum(sizes[found]))
                from_ = np.arange(upto[-1]) + np.repeat(starts[found] - upto[:-1], sizes[found])
                ends = upto[np.append(0, np.cumsum(n_ids[a:b]))]
                out = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(flat[from_])])
                yield rb.slice(a, b - a).append_column("bytes", out.cast(pa.binary()))
        release_spare()

    return join


_IDS, _BYTES = ("ids", ArrayType(IntegerType())), ("bytes", BinaryType())


def _split(docs: DataFrame, path: str, pattern: str, text_col: str, chunk: int, overlap: int
           ) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk, and the other rows with the ``ids`` of their texts.

    Longer texts are chunked into a staged table, whose row keys stay fixed when
    a lost executor's tasks rerun.
    """
    long = F.coalesce(F.char_length(text_col) > chunk, F.lit(False))
    rows = staged(docs.filter(long).withColumn("_bpe_row", F.expr("uuid()")), "bpe-long")
    spread = _chunks(rows.select("_bpe_row", text_col), text_col, chunk, overlap).repartition("_row", "_no")
    pieces = _stitched(spread, pattern, overlap)
    encoded = pieces.mapInArrow(_encoder(ranks(path), pattern, "_piece"), as_struct_type(pieces.drop("_piece"), _IDS))
    whole = encoded.groupBy(F.col("_row").alias("_bpe_row")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_no", "ids"))), lambda x: x["ids"])).alias("ids"))
    return docs.filter(~long), rows.drop(text_col).join(whole, "_bpe_row").drop("_bpe_row")


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """``docs`` without the text but with ``ids``, the tokens of each whole text.

    ``path`` names the vocabulary of ranks; each match of ``pattern`` is encoded
    separately and there are no special tokens.  A text of one chunk is its own
    only piece and is encoded where it is read.
    """
    docs = without(reserved(docs, "_bpe_"), ["ids"])
    short, long_ids = _split(docs, path, pattern, text_col, chunk, overlap)
    ids = short.mapInArrow(_encoder(ranks(path), pattern, text_col), as_struct_type(docs.drop(text_col), _IDS))
    return ids.unionByName(long_ids)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``bytes``, the concatenated bytes of the tokens."""
    encoded = without(encoded, ["bytes"])
    return encoded.mapInArrow(_decoder(ranks(path), ids_col), as_struct_type(encoded, _BYTES))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", chunk: int = CHUNK,
               overlap: int = OVERLAP) -> DataFrame:
    """``decode(encode(docs))``, with both steps of a text of one chunk in one Python worker instead of two."""
    docs, vocabulary = without(reserved(docs, "_bpe_"), ["ids", "bytes"]), ranks(path)
    short, long_ids = _split(docs, path, pattern, text_col, chunk, overlap)
    ids, back = _encoder(vocabulary, pattern, text_col), _decoder(vocabulary, "ids")
    both = short.mapInArrow(lambda batches: back(ids(batches)), as_struct_type(docs.drop(text_col), _IDS, _BYTES))
    return both.unionByName(decode(long_ids, path))
