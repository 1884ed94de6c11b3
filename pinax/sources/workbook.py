"""Multi-sheet workbook scan (A1-A4): Spark lists and reads the files, tasks decode them.

``read_workbooks`` gives one row per sheet row, every cell a string, with the
sheet's name; ``sheet_frame`` turns them into columns.  A file is one row of
Spark's ``binaryFile`` source, so any filesystem Spark reads works.  Decoding
has two steps: the task that has a file takes its sheets apart, still packed,
and the sheets are dealt out, so that each is streamed by a task of its own with
the standard library (``zipfile`` and ``xml.etree``) in batches of bounded size.
Rows ``1..skip_rows`` of a sheet are skipped, and the next row must be the
declared header.
"""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree as ET

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
_M = "{%s}" % _NS["m"]
_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def sheet_names(path) -> list[str]:
    """Sheet names of a workbook (a path or a binary file object)."""
    with zipfile.ZipFile(path) as z:
        wb = ET.fromstring(z.read("xl/workbook.xml"))
    return [s.get("name") for s in wb.find("m:sheets", _NS)]


def _sheet_member(z: zipfile.ZipFile, sheet: str) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rid = None
    for s in wb.find("m:sheets", _NS):
        if s.get("name") == sheet:
            rid = s.get("{%s}id" % _NS["r"])
    if rid is None:
        raise KeyError(f"sheet {sheet!r} not found")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for r in rels:
        if r.get("Id") == rid:
            target = r.get("Target")
            return target.lstrip("/") if target.startswith("/") else "xl/" + target
    raise KeyError(f"relationship {rid} not found")


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    try:
        data = z.open("xl/sharedStrings.xml")
    except KeyError:
        return []
    out = []
    for _, el in ET.iterparse(data):
        if el.tag == _M + "si":
            out.append("".join(t.text or "" for t in el.iter(_M + "t")))
            el.clear()
    return out


def iter_sheet_rows(path, sheet: str | None):
    """Yield ``(row_number, [cell strings])`` of one sheet, 1-based row numbers.

    ``path`` is a local path or a binary file object (e.g. ``io.BytesIO``); without
    a name, it is a packed sheet (``packed_sheets``).  Rows are forgotten once they are yielded."""
    with zipfile.ZipFile(path) as z:
        strings = _shared_strings(z)
        member = _sheet_member(z, sheet) if sheet is not None else PACKED
        with z.open(member) as f:
            holder = None
            for event, el in ET.iterparse(f, events=("start", "end")):
                if event == "start":
                    holder = el if el.tag == _M + "sheetData" else holder
                    continue
                if el.tag != _M + "row":
                    continue
                cells: dict[int, str | None] = {}
                for pos, c in enumerate(el.findall(_M + "c")):
                    ref = c.get("r")
                    m = _REF.match(ref) if ref else None
                    idx = _col_index(m.group(1)) if m else pos
                    t = c.get("t")
                    v = c.find(_M + "v")
                    if t == "s" and v is not None:
                        val = strings[int(v.text)]
                    elif t == "inlineStr":
                        val = "".join(x.text or "" for x in c.iter(_M + "t"))
                    elif t == "b" and v is not None:
                        val = "TRUE" if v.text == "1" else "FALSE"
                    else:
                        val = v.text if v is not None else None
                    cells[idx] = val
                row = [cells.get(i) for i in range(max(cells) + 1)] if cells else []
                yield int(el.get("r")), row
                if holder is not None:
                    holder.clear()


#: Name of the sheet in a packed sheet, and rows of one batch.
PACKED, BATCH_ROWS = "sheet.xml", 2048


def packed_sheets(content: bytes, sheets: list[str] | None) -> Iterator[tuple[str, bytes]]:
    """Name and bytes of each sheet of a workbook, the shared strings beside it: a small archive of its own."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for sheet in sheets or sheet_names(io.BytesIO(content)):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as own:
                for member, name in ((_sheet_member(z, sheet), PACKED), ("xl/sharedStrings.xml",) * 2):
                    if member in z.NameToInfo or name == PACKED:
                        with z.open(member) as source, own.open(name, "w", force_zip64=True) as target:
                            while block := source.read(1 << 20):
                                target.write(block)
            yield sheet, out.getvalue()


def dedupe(names: list[str]) -> list[str]:
    """``["Name", "Name"]`` -> ``["Name", "Name.1"]`` (what frame readers do)."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = n if n not in (None, "") else "Unnamed"
        k = seen.get(n, 0)
        out.append(n if k == 0 else f"{n}.{k}")
        seen[n] = k + 1
    return out


ROWS_SCHEMA = "path string, sheet string, row_idx int, cells array<string>, error string"
_PACKED_SCHEMA = "path string, no int, sheet string, packed binary, error string"


def _sheet_rows(packed: bytes, sheet: str, skip_rows: int | None, header: list[str] | None) -> Iterator[tuple[int, list]]:
    """Rows of one packed sheet; with ``header`` set, row ``skip_rows + 1`` must exist and
    equal it in all its cells, only the rows after it are returned, and none may
    have a filled cell beyond the header's columns."""
    rows = iter_sheet_rows(io.BytesIO(packed), None)
    if header is None:
        yield from rows
        return
    seen = False
    for rnum, row in rows:
        if rnum <= skip_rows:
            continue
        filled = len(row)
        while filled and row[filled - 1] in (None, ""):
            filled -= 1
        if not seen:
            got = ["" if x is None else str(x) for x in row[:max(filled, len(header))]]
            if rnum != skip_rows + 1 or got != list(header):
                raise ValueError(f"header of sheet {sheet!r} at row {rnum} is {got}, "
                                 f"expected {list(header)} at row {skip_rows + 1}")
            seen = True
            continue
        if filled > len(header):
            raise ValueError(f"row {rnum} of sheet {sheet!r} has {filled} cells, the header has {len(header)}")
        yield rnum, row
    if not seen:
        raise ValueError(f"sheet {sheet!r} has no header row after {skip_rows} rows")


def _taken_apart(sheets: list[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for path, content in zip(rb.column("path"), rb.column("content")):
                found, no = packed_sheets(content.as_py(), sheets), 0
                while True:
                    try:
                        name, packed, error = *next(found), None
                    except StopIteration:
                        break
                    except Exception as e:
                        name, packed, error = None, None, repr(e)
                    yield pa.RecordBatch.from_pydict(
                        {"path": [path.as_py()], "no": pa.array([no], pa.int32()), "sheet": pa.array([name], pa.string()),
                         "packed": pa.array([packed], pa.binary()), "error": pa.array([error], pa.string())})
                    no += 1  # a sheet at a time
    return run


def _checked(skip_rows: int | None, header: list[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row in rb.to_pylist():
                error = row["error"]
                if error is None:
                    try:
                        for _ in _sheet_rows(row["packed"], row["sheet"], skip_rows, header):
                            pass
                    except Exception as e:
                        error = repr(e)
                if error is not None:
                    yield pa.RecordBatch.from_pydict({"path": [row["path"]], "no": pa.array([row["no"]], pa.int32()),
                                                      "error": [error]})
    return run


def _decoded(skip_rows: int | None, header: list[str] | None):
    def batch(path: str, sheet: str, rows: list) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_pydict(
            {"path": [path] * n, "sheet": [sheet] * n, "row_idx": pa.array([r for r, _ in rows], pa.int32()),
             "cells": pa.array([c for _, c in rows], pa.list_(pa.string())), "error": pa.nulls(n, pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row in rb.to_pylist():
                held: list = []
                for one in _sheet_rows(row["packed"], row["sheet"], skip_rows, header):
                    held.append(one)
                    if len(held) == BATCH_ROWS:
                        yield batch(row["path"], row["sheet"], held)
                        held = []
                if held:
                    yield batch(row["path"], row["sheet"], held)
    return run


def _dealt(files: DataFrame, sheets: list[str] | None) -> DataFrame:
    """Packed sheets dealt out.  A packed sheet is small and slow to decode, so tasks are not put together by size."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.mapInArrow(_taken_apart(sheets), _PACKED_SCHEMA).repartition(n, "path", "no")


def read_workbooks(spark: SparkSession, paths: str | list[str], sheets: list[str] | None = None,
                   skip_rows: int = 0, header: list[str] | None = None,
                   glob: str = "*.xlsx") -> DataFrame:
    """Rows of every sheet of many workbooks: ``(path, sheet, row_idx, cells, error)``.

    Files are listed and read by Spark's ``binaryFile`` source, so any
    filesystem Spark can read works (HDFS, object stores).  The sheets of a file
    are dealt out, and each is streamed by the task that gets it.  ``row_idx``
    is the sheet's own 1-based row number.

    With ``header`` given, each sheet is checked in row order: row
    ``skip_rows + 1`` must hold exactly ``header`` (a blank or shifted header row
    is an error), and only the rows after it are returned.  A file with a sheet
    that cannot be read or checked gives one row with ``error`` set and none of
    its other rows, so no half-read file slips through: all sheets are read once
    to be checked, and those of sound files once more for their rows.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(paths).select("path", "content"))
    dealt = _dealt(files, sheets)
    bad = (dealt.mapInArrow(_checked(skip_rows, header), "path string, no int, error string")
           .groupBy("path").agg(F.min_by("error", "no").alias("error")))
    rows = (dealt.join(bad, "path", "left_anti").select("path", "no", "sheet", "packed", "error")
            .mapInArrow(_decoded(skip_rows, header), ROWS_SCHEMA))
    return rows.unionByName(bad, allowMissingColumns=True)


def sheet_headers(spark: SparkSession, paths: str | list[str], skip_rows: int = 0, sheets: list[str] | None = None,
                  glob: str = "*.xlsx") -> DataFrame:
    """``(path, part, columns)``: the header row of each sheet of many workbooks, null where there is none."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row in rb.to_pylist():
                found = None
                try:
                    for rnum, cells in iter_sheet_rows(io.BytesIO(row["packed"]), None):
                        if rnum > skip_rows:
                            found = ["" if c is None else c for c in cells] if rnum == skip_rows + 1 else None
                            break
                except Exception:  # an unreadable file has no header
                    found = None
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "part": pa.array([row["sheet"]], pa.string()),
                                                  "columns": pa.array([found], pa.list_(pa.string()))})

    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(paths).select("path", "content"))
    return _dealt(files, sheets).mapInArrow(first, "path string, part string, columns array<string>")


def sheet_frame(rows: DataFrame, header: list[str], sheet_col: str = "sheet",
                strict: bool = True) -> DataFrame:
    """Wide string frame from ``read_workbooks(..., header=header)`` rows (A2).

    Cell k goes to column k.  ``strict`` fails the job on any error row (a
    delivery that does not fit the declared layout); otherwise error rows are
    dropped and can be listed with ``rows.filter("error IS NOT NULL")``.
    """
    if strict:
        msg = F.concat(F.lit("workbook could not be read: "), F.col("path"), F.lit(" "), F.col("error"))
        rows = rows.filter(F.when(F.col("error").isNotNull(), F.raise_error(msg)).otherwise(F.lit(True)))
    else:
        rows = rows.filter(F.col("error").isNull())
    cols = [F.try_element_at(F.col("cells"), F.lit(i + 1)).alias(h) for i, h in enumerate(dedupe(header))]
    return rows.select(*cols, F.col("sheet").alias(sheet_col))
